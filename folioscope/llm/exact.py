"""Exact dedup by content-defined chunk recipes.

Texts are equal when they agree after every ASCII white space character is deleted. Each normalised text is cut where a
rolling hash of its last 32 bytes has its top ten bits, modulo MEAN, at zero, so that equal passages give equal chunks wherever they stand.
A chunk gets a 64-bit identifier. Identifiers are verified over the whole corpus: of all chunks with one identifier the
128-bit digests must agree; documents with an identifier that fails are compared by identifier and digest instead.
Documents are then compared by their ordered lists of identifiers only: texts are read once where they lie and are never
shuffled.

Defined results: a null text counts as empty, and all empty texts are equal; of equal texts the row with the most code
points in the original text stays, then the smallest doc_id (null last); rows that repeat the id of the row that stays
are that row, so all of them are kept; an empty table gives an empty result; only the named columns are read.

Scale: identifiers are verified and groups formed with partial aggregation, so a passage or a text that holds a third of
all rows meets each task as one row. The answer for recipes that occur more than once is a written table and goes back to
the documents by a plain equi join, which adaptive execution splits where one group is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import blobs, keyed, materialise, ship, table

#: A cut is allowed at one of so many bytes; chunk lengths lie between the other two, but for the last chunk.
MEAN, LEAST, MOST = 1024, 256, 8192

WHITE = b" \t\n\x0b\x0c\r"

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    rolling = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = rolling.copy()
        shifted[step:] += rolling[:-step] << np.uint32(step)
        rolling = shifted
    ends, start = [], 0
    for at in (np.flatnonzero((rolling >> np.uint32(22)) % np.uint32(MEAN) == 0) + 1).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def recipe(data: bytes, bits: int = 64) -> tuple[list[int], list[int], list[int]]:
    """Identifiers of a text's chunks in order, and both halves of the digests that verify them."""
    ids, low, high, start = [], [], [], 0
    for end in cuts(data):
        chunk = data[start:end]
        value = xxhash.xxh3_64_intdigest(chunk) & ((1 << bits) - 1)
        ids.append(value - (1 << 64) if value >> 63 else value)
        digest = hashlib.sha256(chunk).digest()
        low.append(int.from_bytes(digest[:8], "big", signed=True))
        high.append(int.from_bytes(digest[8:16], "big", signed=True))
        start = end
    return ids, low, high


def _cook(bits: int):
    longs = pa.list_(pa.int64())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [(t or b"").translate(None, WHITE) for t in blobs(batch.column(1))]
            made = [recipe(t, bits) for t in texts]
            columns = [batch.column(0), batch.column(2), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), *(pa.array([m[i] for m in made], longs) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "points", "text_sha256", "ids", "low", "high"])

    return run


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, points, text_sha256, ids, low, high."""
    ship(docs.sparkSession)
    read = keyed(docs, doc_id=doc_id, text=text).withColumn("points", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    return read.mapInArrow(_cook(bits), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, points bigint, text_sha256 string, ids array<bigint>, low array<bigint>, high array<bigint>")


def unverified(made: DataFrame) -> DataFrame:
    """Identifiers that stand for chunks with different digests (column id)."""
    chunks = made.select(F.explode(F.arrays_zip("ids", "low", "high")).alias("c")).select("c.*")
    ranges = chunks.groupBy("ids").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("low", "high") for f in (F.min, F.max)])
    return ranges.where("min_low <> max_low or min_high <> max_high").select(F.col("ids").alias("id"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    made = materialise(recipes(docs, doc_id, text, bits), "recipes")
    wrong = unverified(made)
    if wrong.isEmpty():
        listed = made.withColumn("recipe", F.col("ids"))
    else:
        bad = materialise(wrong, "unverified")
        touched = made.select("text_sha256", F.explode("ids").alias("id")).join(bad, "id", "left_semi").select("text_sha256").distinct()
        full = F.flatten(F.array("ids", "low", "high"))
        listed = made.join(touched.withColumn("doubt", F.lit(True)), "text_sha256", "left").withColumn("recipe", F.when(F.col("doubt"), full).otherwise(F.col("ids"))).drop("doubt")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("missing"), "doc_id")).alias("best")
    found = listed.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best).where("group_size > 1").select("recipe", "group_size", F.col("best.doc_id").alias("best_id"))
    joined = listed.join(materialise(found, "copies"), "recipe", "left")
    several = F.col("group_size").isNotNull()
    keep = F.when(several, F.col("best_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (~several | F.col("doc_id").eqNullSafe(F.col("best_id"))).alias("kept"), "text_sha256", F.size("ids").alias("n_chunks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for it."""
    return groups(table(spark, sf_dir, "documents")).drop("n_chunks")


SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
g as (select *, count(*) over (partition by t) as group_size, first_value(doc_id) over (partition by t order by points desc, doc_id nulls last) as keep_id from d)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256 from g
"""

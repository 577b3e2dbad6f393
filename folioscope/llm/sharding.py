"""Sharding by extendible hashing: a directory over the leading bits of a hash, where only oversized buckets split.

A document's bucket is the shortest prefix of its hash whose documents together fit the byte limit. The directory is not
grown step by step: documents are counted in fine cells of the hash, the sums of all prefixes of the cells follow, and
each cell looks up its shortest fitting prefix. Cells that are themselves too large are resolved on all bits.

Defined results: a null text has 0 bytes; a single document over the limit is a shard of its own (``oversize``); rows
that agree in id and text cannot be told apart by a hash, so where they exceed the limit together they are dealt into
numbered parts of equal count; null ids are hashed with their text like any other; an empty table gives an empty result.
Columns besides those named are passed on untouched.

Scale: the hash covers id and text, so neither a hot source nor a missing id makes a hot bucket; only ids' hashes and
byte counts are shuffled to build the directory, with partial aggregation; it is joined as a table, never collected. It
has 16 to 32 cells a shard, each summed on eight levels; higher ones start from sums, so work is linear in the shards.
Numbered parts are counted by input partition first, so no task gets all rows of one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import keyed, materialise, table

BITS = 60
LIMIT = 16 << 20
#: Levels of the directory that are summed from the cells themselves; those above come from the sums of the lowest of these.
TIER = 8


def hashed(doc_id: str, text: str) -> Column:
    """60 bits of the hash of a row's id and text."""
    whole = F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def resolved(keys: DataFrame, bits: int, least: int, limit: int) -> DataFrame:
    """For each key of ``bits`` bits with bytes and n: depth, shard_bytes and shard_rows of the shortest prefix, of at
    least ``least`` bits, that fits; keys that none fits are left out."""

    def shortest(keys: DataFrame, bits: int, least: int) -> DataFrame:
        levels = keys.select("key", "bytes", "n", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(key, {bits} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        return levels.select("key", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("key").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("leaf"))

    low = max(least, bits - TIER)
    found = shortest(keys, bits, low)
    if low > least:
        top = F.shiftright("key", bits - low)
        above = keys.groupBy(top.alias("key")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        higher = shortest(above, low, least).select(F.col("key").alias("top"), F.col("leaf").alias("higher"))
        found = found.withColumn("top", top).join(higher, "top", "left").select("key", F.coalesce("higher", "leaf").alias("leaf"))
    return found.select("key", "leaf.*")


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, spare: int = 4) -> DataFrame:
    """Rows of docs as a struct ``row`` with n_bytes, shard, depth, part, shard_bytes and oversize."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("bigint").alias("bytes"),
        hashed(doc_id, text).alias("hash"),
    )
    slim = materialise(rows.select("hash", "bytes"), "sharding")
    total = slim.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(BITS, spare + math.ceil(math.log2(max(1.0, total / limit))))
    cell = F.shiftright("hash", BITS - bits) if bits else F.lit(0).cast("bigint")
    cells = slim.groupBy(cell.alias("key")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    top = materialise(cells.select("key").join(resolved(cells, bits, 0, limit), "key", "left"), "directory")
    plain = rows.withColumn("key", cell).join(top, "key").withColumn("part", F.lit(0).cast("bigint"))
    if not top.where("depth is null").isEmpty():
        open_cells = top.where("depth is null").select("key")
        inside = slim.withColumn("key", cell).join(open_cells, "key", "left_semi")
        hashes = inside.groupBy(F.col("hash").alias("key")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        deep = materialise(hashes.select("key", F.col("bytes").alias("all_bytes"), F.col("n").alias("all_rows")).join(resolved(hashes, BITS, bits, limit), "key", "left"), "directory")
        deeper = plain.where("depth is null").drop("key", "depth", "shard_bytes", "shard_rows").join(deep.withColumnRenamed("key", "hash"), "hash")
        split = numbered(deeper.where("depth is null"), limit) if not deep.where("depth is null").isEmpty() else None
        columns = ["row", "bytes", "hash", "depth", "shard_bytes", "shard_rows", "part"]
        plain = plain.where("depth is not null").select(columns).unionByName(deeper.where("depth is not null").select(columns))
        if split is not None:
            plain = plain.unionByName(split.select(columns))
    bits_of = F.expr(f"lpad(bin(shiftright(hash, {BITS} - depth)), depth, '0')")
    name = F.concat(F.lit("b"), F.when(F.col("depth") > 0, bits_of).otherwise(F.lit("")), F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part").cast("string"))).otherwise(F.lit("")))
    return plain.select("row", F.col("bytes").alias("n_bytes"), name.alias("shard"), F.col("depth").cast("int").alias("depth"), "part", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that agree in hash, dealt into parts that fit; a row's number is counted by input partition first."""
    tagged = materialise(rows.withColumn("at", F.spark_partition_id()), "parts")
    before = Window.partitionBy("hash").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = tagged.groupBy("hash", "at").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    each = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))).cast("bigint"))
    placed = tagged.join(starts, ["hash", "at"]).withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("hash", "at").orderBy("bytes")) - 1)
    parted = placed.withColumn("part", F.expr("place").cast("bigint")).withColumn("part", F.floor(F.col("part") / each).cast("bigint"))
    held = F.least(each, F.col("all_rows") - F.col("part") * each)
    return parted.withColumn("shard_bytes", held * F.col("bytes")).withColumn("shard_rows", held).withColumn("depth", F.lit(BITS))


def write(docs: DataFrame, path: str, **options) -> None:
    """Write docs as one folder of Parquet files per shard below path."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    placed = assign(docs, **options)
    placed.select("row.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    placed = assign(keyed(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return placed.select("row.doc_id", "n_bytes", "shard", "depth", "part", "shard_bytes", "oversize")


def oracle(limit: int = LIMIT, source: str = "documents", more: str = "") -> str:
    return f"""
with r as materialized (
  select doc_id{more}, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h from {source}),
g as (select h, sum(n_bytes) as bytes, count(*) as n, any_value(n_bytes) as one from r group by h),
l as (select h, d, sum(bytes) over w as shard_bytes, sum(n) over w as shard_rows
      from (select h, bytes, n, unnest(range(0, {BITS} + 1)) as d from g) window w as (partition by d, h >> ({BITS} - d))),
f as (select h, min(d) as depth, min_by(shard_bytes, d) as shard_bytes from l where shard_bytes <= {limit} or shard_rows = 1 group by h),
p as (select r.*, f.depth, f.shard_bytes, g.n, greatest(1, {limit} // greatest(n_bytes, 1)) as each,
             row_number() over (partition by r.h) - 1 as k
      from r join g on r.h = g.h left join f on r.h = f.h),
q as (select *, case when depth is null then k // each else 0 end as part from p)
select doc_id{more}, n_bytes,
       'b' || case when coalesce(depth, {BITS}) > 0 then lpad(bin(h >> ({BITS} - cast(coalesce(depth, {BITS}) as int))), cast(coalesce(depth, {BITS}) as int), '0') else '' end
           || case when part > 0 then '-' || part else '' end as shard,
       cast(coalesce(depth, {BITS}) as int) as depth, cast(part as bigint) as part,
       cast(coalesce(shard_bytes, least(each, n - part * each) * n_bytes) as bigint) as shard_bytes,
       coalesce(shard_bytes, least(each, n - part * each) * n_bytes) > {limit} as oversize
from q
"""


SQL = oracle()

"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import ship, table

__all__ = ["blobs", "crc_fold", "discard", "few", "free", "keyed", "labelled", "labelled_sample", "materialise", "shared_dir", "ship", "table", "utf8_words"]

#: Turns every ASCII byte that is neither a letter nor a digit into a space; bytes of other characters stay.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Most bitmaps, of 4 KB each, that tell which ids have a label.
MAPS = 2048


def utf8_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after A-Z became a-z; null has none."""
    return text.lower().translate(_SPACED).split() if text else []


def blobs(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column of an Arrow batch."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names, so that no other column can clash."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in columns.items()])


def free(name: str, taken: list[str]) -> str:
    """A column name that is not taken: ``name`` with underscores behind it as need be. Spark's names ignore case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int, chars: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows of docs (doc_id, text, ...) for a bounded sample of labels (doc_id, label), and all labels' counts by class.

    Of each class the ``rows`` labels with the smallest hash of the id are taken among those that are not held out, so at
    most twice as many ids are broadcast to find their texts; texts of more than ``chars`` code points are left out. Of
    documents or labels that repeat an id, one counts: the row of the least hash. So at most 2 x ``rows`` rows come back.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = known.where("label = 0").orderBy(*by_hash).limit(rows).unionAll(known.where("label = 1").orderBy(*by_hash).limit(rows))
    rest = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(picked), "doc_id").where(F.length(F.coalesce("text", F.lit(""))) <= chars)
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64(*rest).alias("h"), *rest)).alias("r"))
    return one.select("doc_id", "label", *[F.col(f"r.{c}") for c in rest]), shares


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[DataFrame, int]:
    """All rows of docs (doc_id, text, ...) that have a label 0 or 1 (doc_id, label) and are not held out, and how many labels there are.

    Of documents that repeat an id one counts, the row of the least hash; an id with both labels gives two rows. Documents
    whose id has no label are left out before the shuffle by a bitmap of the labels' ids, of at most ``MAPS`` x 4 KB; where
    it is too small for the labels more of the others pass it, and the join is exact anyhow.
    """
    if labels.schema["doc_id"].dataType != docs.schema["doc_id"].dataType:
        labels = labels.withColumn("doc_id", F.col("doc_id").try_cast(docs.schema["doc_id"].dataType))
    usable = F.col("doc_id").isNotNull() & ~held_out
    known = labels.where(F.col("label").isin(0, 1) & usable).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    n = known.count()
    maps = min(MAPS, 1 << (n // 4096).bit_length())
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(maps << 15))
    marks = known.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % (1 << 15)).alias("marks"))
    met = docs.where(usable).withColumn("at", place).withColumn("part", F.shiftright("at", 15)).join(F.broadcast(marks), "part")
    met = met.where("shiftright(cast(conv(hex(substring(marks, cast(at % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) % 2 = 1")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*rest).alias("h"), *rest)).alias("r"))
    return one.join(known, "doc_id").select("doc_id", "label", *[F.col(f"r.{c}") for c in rest]), n


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a folder of the warehouse serves, but only for a local master, whose driver and executors
    are one process; on a cluster that is an error, since the warehouse's default is a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and no executor's loss undoes it.

    The table is deleted when the application ends, or before that by discard().
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    made = spark.read.schema(df.schema).parquet(path)
    made.__dict__["_written"] = path
    return made


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more; others are left alone."""
    for df in tables:
        path = None if df is None else df.__dict__.pop("_written", None)
        if path is not None:
            files, at = _folder(df.sparkSession, path)
            files.delete(at, True)


def few(df: DataFrame, rows: int, a_task: int) -> DataFrame:
    """The same rows in as few tasks as ``a_task`` rows each need; never in more than before."""
    return df.coalesce(max(1, -(-rows // a_task)))


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a stream of dictionaries."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)

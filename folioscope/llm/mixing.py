"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target number of words. Within a source every document has the same expected number of copies,
target / source size. Documents are put in an order, their expected copies are summed up along it, one random offset
is added, and a document is emitted once for each integer boundary that its interval crosses. Ordering by size keeps
the words taken within about one document of the target: copies of small and large documents are equally frequent
in every stretch of the order.

Defined results: a null text has size 0; a null source is a source of its own and comes last; sources are ordered by
code point and weigh ``weights`` in turn; a source of size 0 has target 0 and none of its documents is taken; an
empty table gives an empty result; repeated rows are sampled each on its own, and rows that differ in any column keep
one order. Only the named columns decide; mix() passes all columns on.

Scale: the order is a prefix sum in levels. Documents fall into cells (source, size class, hash); cells are counted
with partial aggregation, summed within the 16 stripes of a class, over the stripes and over the classes of a source (all bounded by constants: 256
hash values a stripe, about 130 classes per doubling of size). Inside a cell rows that agree in every column are one entry with a
count, made with partial aggregation, and only entries are ranked. So neither a source nor a text nor one row that holds a
third of all rows gathers in a task; an entry's rows are spread again in stretches of ``STRETCH``. Sources are numbered by
ranges of their names, and their level is found over the distinct pairs of size and weight, which are at most
3 sqrt(2 w) for w words in all. Everything is worked out on slim rows; mix() then joins the copies to the whole rows by
128 bits of hash, the one time that texts are shuffled.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import keyed, materialise, table

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
CAP = 2.0
SEED = 20_240_917
#: Equal rows, or copies of one row, that one task gives out in one go.
STRETCH = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def offset(seed: int) -> float:
    """The one random offset of a mix; the same seed gives the same mix."""
    return random.Random(seed).random()


def size_of(text: Column) -> Column:
    """Number of words, that is runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """The target of each source (columns source, source_size), where ``budget`` times all sizes is shared by weight.

    No target exceeds ``cap`` times its source's size. Sharing the excess again and again ends at one level: with
    sources ordered by cap / weight, the first whose share at the level fits under its cap fixes it.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    ranged = materialise(sizes.repartitionByRange(*by_name).withColumn("range", F.spark_partition_id()), "sources")
    ranges = ranged.groupBy("range").count().withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*by_name)) - 1
    listed = (
        ranged.join(ranges.select("range", "start"), "range")
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .select("source", "source_size", "weight", "most", "ratio")
    )
    by_ratio = Window.orderBy("ratio", "weight")
    level = (
        listed.groupBy("ratio", "weight", "most")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("words"))
        .withColumn("before", F.coalesce(F.sum(F.col("most") * F.col("n")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum(F.col("weight") * F.col("n")).over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.lit(budget) * F.sum("words").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("open"))
        .where("level * weight <= most")
        .agg(F.min(F.struct("ratio", "weight", "level")).alias("first"))
        .first()["first"]
    )
    aim = F.col("most") if level is None else F.when(F.col("ratio") < F.lit(level.ratio), F.col("most")).otherwise(F.lit(level.level) * F.col("weight"))
    return listed.select("source", "source_size", aim.alias("target"))


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The columns of docs as a struct ``row``, with size, source and the place in the order of sampling."""
    tie = F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary"))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"), tie.alias("tie"))
    return sized.select("row", "source", "size", classed("size").alias("class"), F.substring("tie", 1, 3).alias("cell"), F.substring("tie", 4, 16).alias("tie"))


def classed(size: str) -> Column:
    """A size with all but its eight leading bits cleared."""
    return F.expr(f"{size} - {size} % shiftleft(1L, greatest(length(bin({size})) - 8, 0))")


def entries(order: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """Rows that placed() made, equal ones as one with their count n; with start (rows before it), rate and its source's target."""
    cells = materialise(order.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "cells")
    aimed = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    cells = cells.withColumn("stripe", F.substring("cell", 1, 1))
    stripes = cells.groupBy("source", "class", "stripe").agg(F.sum("n").alias("n"))
    among = Window.partitionBy("source", "class").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    stripes = stripes.select("source", "class", "stripe", F.coalesce(F.sum("n").over(among), F.lit(0)).alias("stripes_before"))
    within = Window.partitionBy("source", "class", "stripe").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n")).select("source", "class", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("classes_before"))
    same = lambda a, b, *more: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.lit(True) if not more else F.expr(" and ".join(f"{a}.{c} = {b}.{c}" for c in more)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    starts = (
        cells.withColumn("cells_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .alias("c")
        .join(stripes.alias("p"), same("c", "p", "class", "stripe"))
        .join(classes.alias("k"), same("c", "k", "class"))
        .join(aimed.alias("t"), same("c", "t"))
        .select("c.source", "c.class", "c.cell", (F.col("cells_before") + F.col("stripes_before") + F.col("classes_before")).alias("cell_start"), "source_size", "target", rate.alias("rate"))
    )
    grouped = order.groupBy("source", "class", "cell", "size", "tie", F.xxhash64("row").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"))
    before = F.sum("n").over(Window.partitionBy("o.source", "o.class", "o.cell").orderBy("size", "tie", "key").rowsBetween(Window.unboundedPreceding, -1))
    ranked = grouped.alias("o").join(starts.alias("s"), same("o", "s", "class", "cell"))
    return ranked.select("row", "o.source", "size", "source_size", "target", "rate", "n", (F.col("cell_start") + F.coalesce(before, F.lit(0))).alias("start"))


def crossed(first: Column, last: Column, seed: int) -> Column:
    """The number of boundaries that the documents at places first + 1 to last cross, at ``rate`` each."""
    return (F.floor(last * F.col("rate") + F.lit(offset(seed))) - F.floor(first * F.col("rate") + F.lit(offset(seed)))).cast("bigint")


def spread(df: DataFrame, times: str, number: str) -> DataFrame:
    """Each row as often as ``times`` says, with the number of the repeat from 0; many repeats go to many tasks."""
    parts = df.withColumn("_part", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {STRETCH})")))
    dealt = parts.repartition(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    return dealt.withColumn(number, F.explode(F.expr(f"sequence(_part * {STRETCH}, least({times}, (_part + 1) * {STRETCH}) - 1)"))).drop("_part")


def sampled(order: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows that placed() made, which should be slim, with source_size, target and copies."""
    listed = materialise(entries(order, weights, budget, cap), "entries")
    columns = lambda df: df.select("row", "source", "size", "source_size", "target", crossed(F.col("start"), F.col("start") + 1, seed).alias("copies"))
    single, several = listed.where("n = 1"), listed.where("n > 1")
    if several.isEmpty():
        return columns(single)
    return columns(single).unionByName(columns(spread(several, "n", "i").withColumn("start", F.col("start") + F.col("i"))))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns."""
    key = lambda prefix: [F.xxhash64(F.lit(k), *[F.col(f"{prefix}`{c}`") for c in docs.columns]).alias(f"k{k}") for k in (0, 1)]
    slim = materialise(placed(docs, doc_id, text, source).withColumn("row", F.struct(*key("row."))), "mixing")
    taken = entries(slim, weights, budget, cap).select("row.k0", "row.k1", "n", crossed(F.col("start"), F.col("start") + F.col("n"), seed).alias("copies"))
    taken = materialise(taken.where("copies > 0"), "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key(""))
    single = rows.join(taken.where("n = 1"), ["k0", "k1"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
    if taken.where("n > 1").isEmpty():
        return single
    salted = rows.join(taken.where("n > 1"), ["k0", "k1"]).groupBy("k0", "k1", "copies", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    one = salted.agg(F.first("row").alias("row")).groupBy("k0", "k1", "copies").agg(F.first("row").alias("row"))
    return single.unionByName(spread(one, "copies", "copy").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of words that the mix takes from it."""
    docs = table(spark, sf_dir, "documents")
    slim = materialise(placed(keyed(docs, doc_id="doc_id", text="text", source="source")).withColumn("row", F.struct("row.doc_id")), "mixing")
    return sampled(slim).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = f"""
with o as materialized (
  select *, size - size % (1::bigint << greatest(length(bin(size)) - 8, 0)) as class, substr(m, 1, 3) as cell, substr(m, 4, 16) as tie
  from (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
               md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as m from documents)),
s as (select source, sum(size) as source_size, row_number() over (order by source is null, source) as rank from o group by source),
w as (select *, {list(WEIGHTS)}[(rank - 1) % {len(WEIGHTS)} + 1] as weight, {CAP}::double * source_size as most from s),
p as (select *, row_number() over r as position,
        coalesce(sum(most) over (order by most / weight, rank rows between unbounded preceding and 1 preceding), 0) as before,
        sum(weight) over (order by most / weight, rank rows between current row and unbounded following) as open,
        {BUDGET}::double * sum(source_size) over () as budget from w window r as (order by most / weight, rank)),
l as (select *, (budget - before) / open as level from p),
f as (select min_by(level, position) as level, min(position) as position from l where level * weight <= most),
t as (select source, source_size, case when l.position < f.position then most else f.level * weight end as target from l, f),
n as (select o.*, source_size, target, row_number() over (partition by o.source order by class, cell, size, tie, doc_id) as place
      from o join t on o.source is not distinct from t.source),
c as (select *, case when source_size > 0 then target / source_size else 0 end as rate from n)
select doc_id, size, cast(source_size as bigint) as source_size, target,
       cast(floor(place * rate + {offset(SEED)!r}::double) - floor((place - 1) * rate + {offset(SEED)!r}::double) as bigint) * size as taken,
       cast(floor(place * rate + {offset(SEED)!r}::double) - floor((place - 1) * rate + {offset(SEED)!r}::double) as bigint) as copies
from c
"""

"""Benchmark decontamination: one Aho-Corasick automaton over normalised test passages.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII characters after A-Z became a-z. A window is
``window`` consecutive words of a benchmark text; a shorter text with at least one word is one window. All windows
become patterns of one automaton over words: each word of the benchmark is a number, written in a few digits, so that no
state has many ways on, and any other word is one sign that no pattern has. So the automaton reads each document once,
a few steps a word, and an occurrence is mapped back to word numbers and to code point offsets of the original text.

Defined results: a null or wordless text has no words, no hits and is clean; a null or wordless benchmark text adds
no window; a benchmark row whose id is null marks words but is not listed; repeated rows are judged each on its own;
an empty benchmark leaves every document clean; columns besides those named are passed on untouched. Where docs have a
column ``name`` already, mark() puts underscores behind the new one's name until it is free.

Scale: documents are read in one pass without a shuffle. The benchmark's size is measured first; it is cut into
overlapping stretches of at most ``STRETCH`` windows, so that long items can be dealt like short ones. Up to
``block_bytes`` of words, an automaton of some 300 MB, make the one automaton. Beyond that there is an automaton for
each block, and one block at a time is collected, broadcast, used and destroyed: documents are written once with a row
number, each block reads them and writes its hits, and the hits, merged by row, are joined to the documents at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import blobs, free, keyed, materialise, ship, table, utf8_words

WINDOW = 13
#: Words' bytes of one automaton.
BLOCK_BYTES = 1 << 20
#: Windows of one stretch of a long item.
STRETCH = 4096

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("items", pa.list_(pa.string())), ("spans", _SPANS)])
_FOUND_SQL = "struct<n_words:bigint,runs:array<struct<first:int,last:int>>,items:array<string>,spans:array<struct<start:int,end:int>>>"
_BASE, _STRANGE = 16, "\x00"


@dataclass
class Matcher:
    """An automaton over words, and the digits of each word of the benchmark; a word's first digit looks like no other."""

    digits: dict[bytes, str]
    built: ahocorasick.Automaton


def automaton(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Matcher:
    """The automaton of a list of (item id, text); a pattern's value is (number of words, item ids)."""
    listed = [(item, utf8_words(text)) for item, text in items]
    known = list(dict.fromkeys(w for _, words in listed for w in words))
    width = 1
    while _BASE**width < len(known):
        width += 1
    digits = {w: "".join([chr(1 + _BASE * (not k) + n // _BASE**k % _BASE) for k in range(width)]) for n, w in enumerate(known)}
    owners: dict[str, set[str]] = {}
    for item, words in listed:
        whole = "".join(map(digits.__getitem__, words))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(whole[i * width : (i + window) * width], set()).update([] if item is None else [item])
    built = ahocorasick.Automaton()
    for p, ids in owners.items():
        built.add_word(p, (len(p) // width, tuple(sorted(ids))))
    if owners:
        built.make_automaton()
    return Matcher(digits, built)


def find(words: list[bytes], matcher: Matcher) -> tuple[np.ndarray, set[str]]:
    """Numbers of the words inside occurrences of windows, and the items that own these windows."""
    hit, items = np.zeros(len(words), bool), set()
    if words and len(matcher.built):
        digits, ends = matcher.digits.get, None
        written = [digits(w, _STRANGE) for w in words]
        for end, (n, ids) in matcher.built.iter("".join(written)):
            if ends is None:
                ends = np.cumsum([len(x) for x in written])
            last = int(np.searchsorted(ends, end, "right"))
            hit[last - n + 1 : last + 1] = True
            items.update(ids)
    return np.flatnonzero(hit), items


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) > 1)
    return list(zip(numbers[np.r_[0, cut + 1]].tolist(), numbers[np.r_[cut, len(numbers) - 1]].tolist(), strict=True))


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets in the original text of runs of words."""
    at = [m.span() for m in _WORD.finditer(text.lower())] if runs else []
    points = lambda a, b: len(text[a:b].decode("utf-8", "replace"))
    out, seen, count = [], 0, 0
    for first, last in runs:
        count += points(seen, at[first][0])
        start, seen = count, at[first][0]
        count += points(seen, at[last][1])
        seen = at[last][1]
        out.append({"start": start, "end": count})
    return out


_BUILT: dict[int, Matcher] = {}


def _matcher(items, window: int) -> Matcher:
    """The automaton of a broadcast list, made once per process; an earlier one goes."""
    listed = items.value
    key = hash((window, tuple(listed)))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(listed, window)
    return _BUILT[key]


def _scan(items, window: int, text_at: int, keep: int):
    """An Arrow function that passes the first ``keep`` columns on and adds what the one automaton found."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, window)
        for batch in stream:
            found = []
            for text in blobs(batch.column(text_at)):
                words = utf8_words(text)
                numbers, ids = find(words, matcher)
                runs = _runs(numbers)
                found.append({"n_words": len(words), "runs": [{"first": a, "last": b} for a, b in runs], "items": sorted(ids), "spans": _spans(text, runs) if runs else []})
            columns = [*batch.columns[:keep], pa.array(found, _FOUND)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return run


_HITS = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))
_HITS_SQL = "hits array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


def _hits(items, window: int):
    """An Arrow function from (row number, text) to the hits of one block; rows without any are left out."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, window)
        for batch in stream:
            rows, hits, owners = [], [], []
            for i, text in enumerate(blobs(batch.column(1))):
                numbers, ids = find(utf8_words(text), matcher)
                if len(numbers):
                    runs = _runs(numbers)
                    rows.append(i)
                    hits.append([{"first": a, "last": b, **s} for (a, b), s in zip(runs, _spans(text, runs), strict=True)])
                    owners.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(hits, _HITS), pa.array(owners, pa.list_(pa.string()))], names=["at", "hits", "items"])

    return run


def _merged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of all blocks in one document, of rows (row number, lists of hits, lists of items)."""
    for batch in stream:
        found = []
        for lists, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            runs: list[dict] = []
            for h in sorted((h for hits in lists for h in hits), key=lambda h: h["first"]):
                if runs and h["first"] <= runs[-1]["last"] + 1:
                    runs[-1] |= {"last": max(runs[-1]["last"], h["last"]), "end": max(runs[-1]["end"], h["end"])}
                else:
                    runs.append(dict(h))
            found.append({"n_words": 0, "runs": [{k: r[k] for k in ("first", "last")} for r in runs], "items": sorted({x for ids in items for x in ids}), "spans": [{k: r[k] for k in ("start", "end")} for r in runs]})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], names=["at", "found"])


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def stretches(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The benchmark's (item, text) as stretches (item, words) of at most STRETCH windows each; wordless texts have none."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _ABC, _ABC.lower()), F.lit(f"[^{_NO_WORD}]+"), F.lit(0))
    starts = F.expr(f"sequence(0, cast((greatest(size(w) - {window}, 0)) div {STRETCH} as int))")
    cut = benchmark.select("item", words.alias("w")).where("size(w) > 0").withColumn("at", F.explode(starts))
    return cut.select("item", F.array_join(F.slice("w", F.col("at") * STRETCH + 1, F.lit(STRETCH + window - 1)), " ").alias("words")).distinct()


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, name: str = "contamination", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and a struct of what was found in each text.

    The struct holds n_words, runs (first and last number of words that were hit), items (ids as strings) and spans
    (code point offsets of the runs in the original text).
    """
    spark = ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    name = free(name, keep)
    listed = stretches(keyed(benchmark, item=item_id, text=item_text).withColumn("item", F.col("item").cast("string")), window)
    size = listed.agg(F.coalesce(F.sum(F.octet_length("words") + 1), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) or 1
    sent = lambda part: spark.sparkContext.broadcast([(r.item, bytes(r.words)) for r in part.select("item", F.col("words").cast("binary").alias("words")).collect()])
    chosen = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    names, kinds = chosen.columns, [f.dataType.simpleString() for f in chosen.schema]
    plain, text_at = chosen.toDF(*[f"c{i}" for i in range(len(names))]), names.index(text)
    if blocks == 1:
        schema = ",".join([*(f"c{i} {kinds[i]}" for i in range(len(keep))), f"c{len(keep)} {_FOUND_SQL}"])
        return plain.mapInArrow(_scan(sent(listed), window, text_at, len(keep)), schema).toDF(*keep, name)
    listed = materialise(listed.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))), "benchmark")
    counted = F.regexp_count(F.coalesce(F.col(f"c{text_at}"), F.lit("")), F.lit(f"[^{_NO_WORD}]+")).cast("bigint")
    held = materialise(plain.withColumn("at", F.monotonically_increasing_id()).withColumn("words", counted), "numbered")
    parts = []
    for b in range(blocks):
        items = sent(listed.where(F.col("block") == b))
        parts.append(materialise(held.select("at", f"c{text_at}").mapInArrow(_hits(items, window), f"at bigint, {_HITS_SQL}"), "hits"))
        items.destroy()
    hits = reduce(DataFrame.unionByName, parts).groupBy("at").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    whole = held.select("at", "words", *[f"c{i}" for i in range(len(keep))]).join(materialise(hits.mapInArrow(_merged, f"at bigint, found {_FOUND_SQL}"), "hits"), "at", "left")
    none = lambda k, kind: F.coalesce(F.col(f"found.{k}"), F.array().cast(kind)).alias(k)
    found = F.struct(F.col("words").alias("n_words"), none("runs", "array<struct<first:int,last:int>>"), none("items", "array<string>"), none("spans", "array<struct<start:int,end:int>>"))
    return whole.select(*[f"c{i}" for i in range(len(keep))], found.alias("found")).toDF(*keep, name)


def verdict(found: str = "contamination") -> dict:
    """The digest columns of a struct made by mark(): a document is contaminated when 5% of its words are hit."""
    hit = F.aggregate(f"{found}.runs", F.lit(0).cast("bigint"), lambda a, r: a + r["last"] - r["first"] + 1)
    return {
        "n_words": F.col(f"{found}.n_words"),
        "n_hit": hit,
        "n_items": F.size(f"{found}.items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(f"{found}.items"), ",").cast("binary"), 256),
        "contaminated": (hit > 0) & (20 * hit >= F.col(f"{found}.n_words")),
    }


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    name = free("contamination", docs.columns)
    return mark(docs, benchmark, name=name, **options).where(~verdict(name)["contaminated"]).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its verdict."""
    found = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", *[c.alias(k) for k, c in verdict().items()])


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
with d as materialized (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
iw as (select distinct item, k, array_to_string(w[p : p + k - 1], ' ') as win
       from (select item, w, k, unnest(range(1, len(w) - k + 2)) as p
             from (select item, w, least(len(w), {WINDOW}) as k from i where len(w) > 0))),
dw as (select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') as win
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p
             from d cross join (select distinct k from iw) where len(w) >= k)),
occ as materialized (select dw.doc_id, dw.k, dw.p, iw.item from dw join iw on dw.k = iw.k and dw.win = iw.win),
h as (select doc_id, count(distinct q) as n_hit
      from (select distinct doc_id, unnest(range(p, p + k)) as q from occ) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from occ where item is not null) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
"""

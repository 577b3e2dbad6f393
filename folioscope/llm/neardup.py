"""Near-duplicate classes by order MinHash, with candidates verified by banded alignment.

A text is its sequence of shingles of ``size`` words (A-Z lower-cased; a shorter text with words is one shingle). The k-th
equal shingle of a text carries the number k, so repeats count. For each of ``bands`` hash functions the ``length``
shingles of least hash are taken and put in their order in the text; texts whose ordered samples agree are candidates.
A candidate pair is a link if the longest common subsequence m of both sequences satisfies m / (a + b - m) >= ``least``
for a and b shingles: an edit similarity over shingles that also bounds how far an alignment may leave the diagonal, so
only that band is aligned. Classes are the connected components of links.

Texts that are equal word by word are one node from the start, so copies are never compared. First each round takes one
centre per bucket, compares it with the members that are not yet in its component, and takes it out of the bucket. The
centre is the member whose buckets hold the most texts: among the copies of an original that is the original, which the
copies resemble more than each other. Rounds only make components cheaply and go on while at least one in ``YIELD`` of the
compared pairs is a link; how many there are does not change the result. For then, in every bucket that still holds
members of several components, all pairs of them that were not compared yet are: every two texts that share a bucket end
in one component or have been compared. Each text has a bitmap of its shingles; the cells that one text sets and the
other does not are shingles that no alignment has, so most unlike pairs are dropped exactly and unlisted.

Defined results: a text without words equals only the texts that are the same character by character; null is the empty
text; the class id is the smallest doc_id of the class (null last), and all rows that repeat it share ``kept``; an empty
table gives an empty result; only the named columns are read by classes(), and distinct() keeps all columns.

Scale: sketches are 8 x ``bands`` bytes a document and made in one pass. Buckets, centres and copies are formed with
partial aggregation; they go back to their members by equi joins of written tables, which adaptive execution splits where
a bucket or group is large. Texts that share no bucket are left out before words are shuffled, by a Bloom filter of at
most ``FILTER`` x 8 bytes over the keys of those that do; beyond some 10 million keys for each million of cells more and
more of the others pass it, until at last all words are shuffled once, and the join by key is exact anyhow. Pairs meet bitmaps
first, a tenth of the words' size, and words only if these allow a link. Each round's pairs are linear in the
members. In a bucket of unlike texts the comparison of bitmaps grows with the square of the members that are left; blocks
of members spread it over tasks, and only pairs that the bitmaps leave open become rows. An alignment holds some
``MASKS`` bytes besides its two texts, however long they are. Links and components stay in tables in the shared folder,
which go as soon as nothing reads them; nothing about documents is collected but the filter's cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import blobs, discard, few, keyed, materialise, ship, table, utf8_words

SIZE, BANDS, LENGTH, LEAST = 5, 16, 3, 0.8
REMEMBERED = 400_000
#: Rows of ids that are worth a task of their own.
SLIM = 200_000
#: Rounds of centres go on while one in so many of their pairs is a link.
YIELD = 20
#: Most cells, of 64 bits each, of the filter of keys.
FILTER = 1 << 20
#: Bytes that an alignment may use for where shingles stand.
MASKS = 32 << 20
#: Members of a bucket that are compared with each other in one go, about.
BLOCK = 256

_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (64, 2), dtype=np.uint64) | np.uint64(1)
_STEPS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], known: dict[bytes, int], size: int = SIZE) -> np.ndarray:
    """64-bit hashes of the shingles of a text in order."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(ids))):
        out += ids[k : k + n] * _STEPS[k]
    return _mixed(out)


def occurrences(s: np.ndarray) -> np.ndarray:
    """For each shingle how often it has occurred before in the text."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    if fresh.all():
        return np.zeros(len(s), np.uint64)
    starts = np.flatnonzero(fresh)
    out = np.empty(len(s), np.uint64)
    out[order] = (np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))).astype(np.uint64)
    return out


def sketch(s: np.ndarray, bands: int = BANDS, length: int = LENGTH) -> np.ndarray:
    """One bucket number per hash function: a hash of the least shingles in text order."""
    if not len(s):
        return np.zeros(0, np.int64)
    labelled = _mixed(s + occurrences(s) * _STEPS[63])
    out = np.empty(bands, np.uint64)
    step = max(1, min(bands, (1 << 21) // len(s)))
    for at in range(0, bands, step):
        seeds = _SEEDS[at : min(bands, at + step)]
        h = (labelled[None, :] ^ seeds[:, :1]) * seeds[:, 1:]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        picked = np.argpartition(h, length - 1, axis=1)[:, :length] if len(s) > length else np.tile(np.arange(len(s)), (len(seeds), 1))
        picked.sort(axis=1)
        value = seeds[:, 0] + np.uint64(len(s) if len(s) < length else 0)
        for k in range(picked.shape[1]):
            value = _mixed(value * _STEPS[62] + labelled[picked[:, k]])
        out[at : at + len(seeds)] = value
    return out.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> int:
    """Length of the longest common subsequence of two sequences inside the band that ``least`` allows.

    It is exact for sequences that are similar enough; for others it may be too small.
    """
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0
    band = int((len(a) + len(b)) * (1 - least) / (1 + least)) + 1
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    total, bits, common = head + tail, (1 << len(a)) - 1, set(a.tolist()) & set(b.tolist())
    inside_a, inside_b = np.isin(a, list(common)), np.isin(b, list(common))
    if np.array_equal(a[inside_a], b[inside_b]) and (np.abs(np.flatnonzero(inside_a) - np.flatnonzero(inside_b)) <= band).all():
        return total + int(inside_a.sum())
    return total + _in_band(a, b, band, least / (1 + least) * (len(a) + len(b) + 2 * total) - total)


def _in_band(a: np.ndarray, b: np.ndarray, band: int, need: float) -> int:
    """Length of the longest common subsequence of a and b within ``band`` of the diagonal; 0 once ``need`` is out of reach.

    A bit for each place of a, as far as the band reaches, is cleared where a row of b makes the subsequence longer. Rows
    come in blocks; places that the band has left are counted and dropped, so memory is that of one block.
    """
    step = max(16, min(len(b), 8 * MASKS // (4 * band + 64)))
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    state, base, top, cleared = 0, 0, 0, 0
    for start in range(0, len(b), step):
        rows = b[start : start + step]
        low, high = max(0, start - band), min(len(a), start + len(rows) + band)
        if low >= len(a):
            break
        cleared += low - base - (state & ((1 << (low - base)) - 1)).bit_count()
        state = state >> (low - base) | ((1 << (high - low)) - (1 << (top - low)) if high > top else 0)
        base, top, full = low, max(top, high), (1 << (max(top, high) - low)) - 1
        masks: dict[int, tuple[int, int, int]] = {}
        values = np.unique(rows)
        for x, i, j in zip(values.tolist(), np.searchsorted(ranked, values, "left").tolist(), np.searchsorted(ranked, values, "right").tolist(), strict=True):
            places = order[i:j]
            places = places[(places >= low) & (places < high)]
            if len(places) > 32:
                cells = np.zeros(high - low, np.bool_)
                cells[places - low] = True
                masks[x] = int.from_bytes(np.packbits(cells, bitorder="little").tobytes(), "little"), int(places[0]), int(places[-1])
            elif len(places):
                at = 0
                for place in places.tolist():
                    at |= 1 << (place - low)
                masks[x] = at, int(places[0]), int(places[-1])
        for i, x in enumerate(rows.tolist(), start):
            found = masks.get(x)
            if found is None:
                continue
            at, first, last = found
            if first < i - band or last > i + band:
                at &= ((1 << (2 * band + 1)) - 1) << (i - band - base) if i - band >= base else (1 << (i + band + 1 - base)) - 1
            hit = state & at
            if hit:
                state = ((state + hit) | (state - hit)) & full
        if cleared + (top - base) - state.bit_count() + len(b) - start - len(rows) < need - 1e-6:
            return 0
    return cleared + (top - base) - state.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two texts, as shingles, are a link."""
    m = aligned(a, b, least)
    return m > 0 and m >= least * (len(a) + len(b) - m)


def marks(s: np.ndarray) -> bytes:
    """A bitmap of a text's shingles, repeats told apart: 4 to 8 cells for each, a power of two in all."""
    cells = max(64, 1 << (4 * len(s) - 1).bit_length())
    out = np.zeros(cells, np.bool_)
    out[_mixed(s + occurrences(s) * _STEPS[63]) & np.uint64(cells - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size // 8), axis=0)


def possible(rows: list[tuple[int, bytes, int, bytes]], least: float = LEAST) -> Iterator[tuple[int, int]]:
    """Places of pairs with unlike roots that can be a link, of rows (block, root, n, bitmap); two blocks pair crosswise.

    A cell that only one of two texts sets has a shingle that the other lacks, which bounds their common subsequence.
    """
    order, known = sorted(range(len(rows)), key=lambda i: rows[i][2]), {}
    sides, roots, ns = np.array([(rows[i][0], known.setdefault(rows[i][1], len(known)), rows[i][2]) for i in order]).T
    crosswise = bool((sides != sides[0]).any())
    ends = np.searchsorted(ns * least, ns, side="right")
    held: tuple[int, int, np.ndarray | None] = (0, 0, None)
    for i in range(len(order) - 1):
        end, width = int(ends[i]), len(rows[order[i]][3])
        if end <= i + 1:
            continue
        if held[0] != width or held[2] is None or held[1] + len(held[2]) < end:
            last = int(ends[np.searchsorted(ns, ns[i : i + BLOCK][-1], side="right") - 1])
            held = (width, i, np.stack([_folded(rows[k][3], width) for k in order[i:max(end, last)]]))
        own, others = held[2][i - held[1]], held[2][i + 1 - held[1] : end - held[1]]
        n = ns[i + 1 : end]
        most = np.minimum(ns[i] - np.bitwise_count(own & ~others).sum(axis=1, dtype=np.int64), n - np.bitwise_count(others & ~own).sum(axis=1, dtype=np.int64))
        fits = (most >= least * (ns[i] + n - most)) & (roots[i + 1 : end] != roots[i])
        if crosswise:
            fits &= sides[i + 1 : end] != sides[i]
        for k in np.flatnonzero(fits):
            yield order[i], order[i + 1 + int(k)]


def may_link(n: int, left: bytes, m: int, right: bytes, least: float = LEAST) -> bool:
    """Whether bitmaps of two texts of n and m shingles allow a link."""
    size = min(len(left), len(right))
    a, b = _folded(left, size), _folded(right, size)
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return most >= least * (n + m - most)


def text_key(text: bytes | None, words: list[bytes]) -> bytes:
    """128 bits that texts share if their words agree, or if they have none and are the same."""
    return hashlib.sha256(b"w" + b" ".join(words) if words else b"t" + (text or b"")).digest()[:16]


def _sketched(size: int, bands: int, length: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in stream:
            keys, counts, sketches = [], [], []
            for text in blobs(batch.column(1)):
                words = utf8_words(text)
                s = shingles(words, known, size)
                keys.append(text_key(text, words))
                counts.append(len(s))
                sketches.append(sketch(s, bands, length))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sketch"])

    return run


def _places(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter's cell of each key, a row of 16 bytes, and the three bits that it sets there."""
    at = keys[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
    bits = np.bitwise_or.reduce([np.uint64(1) << (keys[:, k] & 63).astype(np.uint64) for k in (8, 9, 10)])
    return (at & np.uint64(cells - 1)).astype(np.int64), bits


def key_filter(keys: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of keys: cells of 64 bits, as many as fit ``rows`` keys but FILTER at most."""
    cells = min(FILTER, 1 << max(4, (rows // 4).bit_length()))
    at = F.conv(F.hex(F.substring("key", 5, 4)), 16, 10).cast("bigint").bitwiseAND(F.lit(cells - 1))
    bit = lambda k: F.expr(f"shiftleft(1L, cast(conv(hex(substring(key, {k + 1}, 1)), 16, 10) as int) & 63)")
    found = keys.groupBy(at.alias("at")).agg(F.bit_or(bit(8)).alias("x"), F.bit_or(bit(9)).alias("y"), F.bit_or(bit(10)).alias("z"))
    table = found.select("at", F.col("x").bitwiseOR(F.col("y")).bitwiseOR(F.col("z")).alias("bits")).toArrow()
    out = np.zeros(cells, np.uint64)
    out[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _worded(shared, size: int):
    """From texts to the keys, words and bitmaps of those that the filter lets through."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in stream:
            texts = blobs(batch.column(0))
            words = [utf8_words(t) for t in texts]
            keys = [text_key(t, w) for t, w in zip(texts, words, strict=True)]
            cells, bits = _places(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16), len(shared.value))
            held = np.flatnonzero((shared.value[cells] & bits) == bits).tolist()
            kept = [words[i] for i in held]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in held], pa.binary()), pa.array([b" ".join(w) for w in kept], pa.binary()), pa.array([marks(shingles(w, known, size)) if w else b"" for w in kept], pa.binary())], names=["key", "words", "marks"])

    return run


def _paired(least: float):
    """Pairs that can be links of rows (bucket, i, j, own, key, n, root, marks), which come sorted by block pair."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in stream for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*out, strict=True)], names=["a", "b", "ra", "rb"])
        for (_, i, j), members in groupby(rows, key=lambda r: r[:3]):
            held = list(members)
            if len({r[6] for r in held}) < 2 or i != j and len({r[3] for r in held}) < 2:
                continue
            for x, y in possible([(r[3], r[6], r[5], r[7]) for r in held], least):
                (a, ra), (b, rb) = sorted(((held[x][4], held[x][6]), (held[y][4], held[y][6])))
                out.append((a, b, ra, rb))
            if len(out) >= 4096:
                yield made()
                out = []
        if out:
            yield made()

    return run


def _allowed(least: float):
    """Pairs (a, b, ra, rb) of rows (a, b, ra, rb, an, am, bn, bm) whose bitmaps allow a link."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            good = [i for i, (n, left, m, right) in enumerate(zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)) if may_link(n, left, m, right, least)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(good, pa.int64())) for c in batch.columns[:4]], names=["a", "b", "ra", "rb"])

    return run


def _verified(size: int, least: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        last: tuple[bytes | None, np.ndarray | None] = (None, None)
        for batch in stream:
            a, left, right, *roots = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                if last[0] != a[i]:
                    last = (a[i], shingles(left[i].split(), known, size))
                if similar(last[1], shingles(right[i].split(), known, size), least):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.binary()) for x in roots], names=["a", "b"])

    return run


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """The connected components of links (a, b): one row (key, root) per node, root the least node of its component.

    Large and small stars alternate: neighbours move to the least node seen until every component is a star. ``rows`` is
    the number of links, if it is known; few links get few tasks.
    """
    rows = links.count() if rows is None else rows
    kept = lambda df: materialise(few(df, 2 * rows, SLIM), "edges")
    edges, seen = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, kept(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        discard(before, least, large, lower)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    out = kept(edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()))
    discard(edges)
    return out


def _left_open(members: DataFrame, bitmaps: DataFrame, least: float) -> DataFrame | None:
    """All pairs (a, b, ra, rb) of members (bucket, key, n, root) with one bucket, unlike roots and bitmaps that allow a link.

    Members of a bucket's largest component, in blocks of their own, meet only the blocks of the others.
    """
    by_root = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_root.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all")).where("all > top.c").selectExpr("bucket", "top.root as top", f"cast(ceil(top.c / {BLOCK}) as int) as g", f"cast(ceil((all - top.c) / {BLOCK}) as int) as h")
    mixed = materialise(mixed, "mixed")
    left = materialise(members.join(mixed, "bucket"), "left")
    discard(mixed)
    if left.isEmpty():
        discard(left)
        return None
    own = left.withColumn("own", F.expr("cast(if(root = top, h + pmod(xxhash64(key, bucket), g), pmod(xxhash64(key, bucket), h)) as int)"))
    met = own.withColumn("other", F.explode(F.expr("sequence(0, if(root = top, h, h + g) - 1)")))
    dealt = met.join(bitmaps, "key").select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "root", "marks")
    blocks = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    out = materialise(blocks.mapInArrow(_paired(least), "a binary, b binary, ra binary, rb binary").distinct(), "open")
    discard(left)
    return out


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, bands: int = BANDS, length: int = LENGTH, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, key of its words, root key of its class; a written table."""
    spark = ship(docs.sparkSession)
    read = keyed(docs, doc_id=doc_id, text=text)
    made = materialise(read.mapInArrow(_sketched(size, bands, length), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, key binary, n int, sketch array<bigint>"), "sketches")
    nodes = made.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    every = materialise(nodes.select("key", "n", F.explode("sketch").alias("bucket")), "members")
    shared = materialise(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    spread = F.sum("c").over(Window.partitionBy("key"))
    members = materialise(every.join(shared, "bucket").select("bucket", "key", "n", spread.alias("weight"), F.col("key").alias("root")), "members")
    discard(every, shared)
    wanted = materialise(members.select("key").distinct(), "wanted")
    sieve = spark.sparkContext.broadcast(key_filter(wanted, wanted.count()))
    texts = read.select("text").mapInArrow(_worded(sieve, size), "key binary, words binary, marks binary")
    words = materialise(texts.groupBy("key").agg(F.first("words").alias("words"), F.first("marks").alias("marks")).join(wanted, "key", "left_semi"), "words")
    bitmaps = words.select("key", "marks")
    sieve.destroy()
    discard(wanted)

    def linked(pairs: DataFrame, tested: int) -> DataFrame:
        """The pairs (a, b, ra, rb) that are links, as their roots (a, b); a written table."""
        side = lambda k, column, name: words.select(F.col("key").alias(k), F.col(column).alias(name))
        both = pairs.join(side("b", "words", "right"), "b").join(side("a", "words", "left"), "a")
        checked = both.select("a", "left", "right", "ra", "rb").mapInArrow(_verified(size, least), "a binary, b binary")
        return materialise(few(checked.distinct(), tested, SLIM), "links")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, an, b, bn, ra, rb) whose bitmaps allow a link; a written table."""
        side = lambda k: bitmaps.select(F.col("key").alias(k), F.col("marks").alias(f"{k}m"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        return materialise(both.select("a", "b", "ra", "rb", "an", "am", "bn", "bm").mapInArrow(_allowed(least), "a binary, b binary, ra binary, rb binary"), "allowed")

    def merged(roots: DataFrame | None, moved: DataFrame) -> DataFrame:
        if roots is None:
            return moved
        before = roots.join(moved.select(F.col("key").alias("root"), F.col("root").alias("to")), "root", "left").select("key", F.coalesce("to", "root").alias("root"))
        out = materialise(before.unionByName(moved).groupBy("key").agg(F.min("root").alias("root")), "roots")
        discard(roots, moved)
        return out

    roots, tried = None, []
    while True:
        many = members.count()
        first = F.min(F.struct((-F.col("weight")).alias("w"), F.xxhash64("key", "bucket").alias("h"), "key", "n", "root")).alias("c")
        centres = members.groupBy("bucket").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket", F.col("c.key").alias("a"), F.col("c.n").alias("an"), F.col("c.root").alias("ar"))
        centres = materialise(few(centres, many, SLIM), "centres")
        split = materialise(few(members.join(centres, "bucket"), many, SLIM), "split")
        discard(members, centres)
        near = f"root <> ar and least(n, an) >= {least} * greatest(n, an)"
        order = lambda x, y: F.when(F.col("a") < F.col("key"), F.col(x)).otherwise(F.col(y))
        pairs = split.where(near).select(order("a", "key").alias("a"), order("key", "a").alias("b"), order("an", "n").alias("an"), order("n", "an").alias("bn"), order("ar", "root").alias("ra"), order("root", "ar").alias("rb")).distinct()
        for earlier in tried:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        pairs = materialise(few(pairs, many, SLIM), "pairs")
        tested = pairs.count()
        tried.append(pairs.select("a", "b"))
        fit = allowed(pairs)
        found = linked(fit, tested)
        links = found.count()
        members = split.where("key <> a").select("bucket", "key", "n", "weight", "root")
        if links:
            moved = components(found, links)
            to = moved.select(F.col("key").alias("root"), F.col("root").alias("to"))
            members = members.join(to, "root", "left").select("bucket", "key", "n", "weight", F.coalesce("to", "root").alias("root"))
            members = materialise(few(members, many, SLIM), "members")
            roots = merged(roots, moved)
        else:
            members = materialise(few(members, many, SLIM), "members")
        discard(split, fit, found)
        if YIELD * links < tested or not links:
            break
    left = _left_open(members, bitmaps, least)
    if left is not None:
        rest = left
        for earlier in tried:
            rest = rest.join(earlier, ["a", "b"], "left_anti")
        rest = materialise(rest, "rest")
        found = linked(rest, rest.count())
        links = found.count()
        if links:
            roots = merged(roots, components(found, links))
        discard(left, rest, found)
    if roots is None:
        out = made.select("doc_id", "key", F.col("key").alias("root"))
    else:
        out = made.join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    out = materialise(out, "grouped")
    discard(made, members, words, roots)
    return out


def _chosen(rows: DataFrame) -> DataFrame:
    """For each root that more than one row has: the id and key of the row that stays, the size, and how many rows are it."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")).alias("best")
    return rows.groupBy("root").agg(best, F.count(F.lit(1)).alias("class_size")).where("class_size > 1").select("root", "class_size", F.col("best.doc_id").alias("best_id"), F.col("best.key").alias("best_key"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept."""
    rows = grouped(docs, doc_id, text, **options)
    joined = rows.join(materialise(_chosen(rows), "classes"), "root", "left")
    several = F.col("class_size").isNotNull()
    return joined.select("doc_id", F.when(several, F.col("best_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), (~several | F.col("doc_id").eqNullSafe(F.col("best_id"))).alias("kept"))


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of docs per class, with its columns.

    Rows are matched by id and words; of several rows that agree in both, one stays.
    """
    rows = grouped(docs, doc_id, text, **options)
    chosen = materialise(_chosen(rows), "classes")
    left = rows.join(chosen, "root", "left").where("class_size is null or (doc_id <=> best_id and key = best_key)")
    stays = materialise(left.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies")), "stays")
    names = docs.columns
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    at, ids = names.index(text), names.index(doc_id)

    def with_key(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keys = [text_key(t, utf8_words(t)) for t in blobs(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*(f"c{i}" for i in range(len(names))), "key"])

    marked = docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(with_key, f"{kinds}, key binary")
    on = [marked["key"] == stays["key"], marked[f"c{ids}"].eqNullSafe(stays["doc_id"])]
    out = marked.join(stays, on[0] & on[1]).drop(stays["key"]).drop(stays["doc_id"])
    if stays.where("copies > 1").isEmpty():
        return out.drop("key", "copies").toDF(*names)
    once = out.where("copies = 1").drop("key", "copies")
    again = out.where("copies > 1").dropDuplicates([f"c{ids}", "key"]).drop("key", "copies")
    return once.unionByName(again).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class."""
    return classes(table(spark, sf_dir, "documents"))


SQL = None

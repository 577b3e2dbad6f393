"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (A-Z lower-cased) and their beginnings of several lengths are hashed; a word's embedding is the sum of their rows,
so inflected forms share what their stem has learnt. Filters of one, two and three words run over the whole text, the
maximum over all positions is taken for each filter, and a logistic layer gives the score. At scoring time a word's
products with all filters are worked out once and remembered, so a text costs one look-up per word.

The model is fitted on all labelled rows and their whole texts. A fifth of them, by hash of the text, is kept from
fitting and calibrates a threshold per language (best F1, with ``least`` rows of either class; else the threshold of all
languages), for the column ``flagged`` only. Rows of the held-out fold are never used. Scores depend on the text alone.

Learning begins on the driver with a few rows, several times: up to ``sample_rows`` of each class, those with the smallest
hash of the id, with texts of at most ``sample_chars`` code points, ``sample_bytes`` in all and half of that for a class;
weights restore the classes' true shares. Unless these were all rows, ``ROUNDS`` passes over all of them follow: rows are
dealt by hash to shards of about ``SHARD_ROWS``, each shard goes on from the same model by itself, step by step in the
order of the hash, and the mean of what they come to is the next model (local steps, then averaging).

Defined results: null and empty texts are scored like a text of one unknown word; rows whose label is null teach nothing;
without labels of both classes every score is the share of label 1 (0.5 without labels); repeated rows are scored each
on its own, and one row of an id teaches; very long texts are scored whole, in memory linear in the text; only the named
columns are read.

Scale: texts of labelled rows are shuffled twice and written once; of other rows only those that a bitmap of the labels'
ids lets through are shuffled, once. A pass has ``TASKS`` tasks at most, takes memory for one batch of texts, and gives the
driver one model, whatever the input's size. From ``CELLS`` rows on calibration counts all its rows by score, to 1/64 of a
logit. Scoring is one pass without a shuffle; the model has a fixed size and is broadcast.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import blobs, crc_fold, discard, keyed, labelled, materialise, ship, table, utf8_words

FOLDS, HELD = 5, 0
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_BYTES = 2_000, 200_000, 64 << 20
#: One row in so many is for calibration.
CALIBRATE = 5
#: Passes over all rows after the start, their first rate, the rows of a learner, and most tasks of a pass.
ROUNDS, RATE, SHARD_ROWS, TASKS = 2, 0.01, 5_000, 64
#: Ranges of embeddings in which what tasks have learnt is put together.
PARTS = 16
#: Texts, and bytes unless a text is longer, of one step.
BATCH, BATCH_BYTES = 64, 4 << 20
#: Rows of calibration that are told apart one by one.
CELLS = 1 << 16
CUT = 0.5

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
BEGINNINGS = (4, 5, 6, 7)
REMEMBERED = 150_000
#: Of embeddings against the other weights.
STEP = 3

_PAD = BUCKETS  # the row that stays zero
_GAP = max(WIDTHS) - 1


def buckets(word: bytes) -> list[int]:
    """Rows of a word: of itself and of each longer word's beginnings (bytes of UTF-8)."""
    own = xxhash.xxh3_64_intdigest(word) % BUCKETS
    return [own, *(xxhash.xxh3_64_intdigest(word[:n], seed=n) % BUCKETS if len(word) > n else _PAD for n in BEGINNINGS)]


class Vocabulary:
    """Numbers for words, with their rows; number 0 is the pad."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.rows: list[list[int]] = [[_PAD] * (1 + len(BEGINNINGS))]
        self.held = np.array(self.rows)

    def array(self) -> np.ndarray:
        """The rows of all words by number."""
        if len(self.held) < len(self.rows):
            self.held = np.concatenate([self.held, np.array(self.rows[len(self.held) :])])
        return self.held

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each followed by pads, and the bounds of the texts' words as reduceat takes them."""
        flat: list[int] = []
        bounds = []
        for text in texts:
            words = utf8_words(text)
            for w in set(words).difference(self.numbers):
                self.numbers[w] = len(self.rows)
                self.rows.append(buckets(w))
            found = list(map(self.numbers.__getitem__, words)) or [0]
            bounds += [len(flat), len(flat) + len(found)]
            flat += found
            flat += [0] * _GAP
        return np.array(flat, np.int64), np.array(bounds, np.int64)


@dataclass
class Model:
    """Weights of the classifier; ``rate`` alone where there was nothing to learn from."""

    rate: float = 0.5
    table: np.ndarray | None = None
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    shift: np.ndarray | None = None
    out: np.ndarray | None = None
    bias: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=dict)
    learner: Learner | None = None


class Scorer:
    """A model with the products that it remembers for words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()
        if model.table is not None:
            self.folded = np.concatenate([model.filters[w][k] for k in range(max(WIDTHS)) for w in WIDTHS if w > k], 1)

    def forget(self) -> None:
        self.words, self.ready = Vocabulary(), 0
        self.products = np.zeros((1 << 14, FILTERS * sum(WIDTHS)), np.float32)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        m = self.model
        if m.table is None:
            return np.full(len(texts), m.rate)
        if not texts:
            return np.zeros(0)
        if len(self.words.rows) > REMEMBERED:
            self.forget()
        flat, bounds = self.words.read(texts)
        known = len(self.words.rows)
        if known > len(self.products):
            self.products = np.concatenate([self.products, np.zeros((max(known, len(self.products)), self.products.shape[1]), np.float32)])
        if known > self.ready:
            self.products[self.ready : known] = m.table[np.array(self.words.rows[self.ready :])].sum(1) @ self.folded
            self.ready = known
        n, at = FILTERS * len(WIDTHS), 0
        y = self.products[flat, :n]
        for k in range(1, max(WIDTHS)):
            at += FILTERS * (len(WIDTHS) - k + 1)
            y[:-k, k * FILTERS :] += self.products[flat[k:], at : at + FILTERS * (len(WIDTHS) - k)]
        top = np.maximum(np.maximum.reduceat(y, bounds, axis=0)[::2] + m.shift, 0)
        return 1 / (1 + np.exp(-np.clip(top.astype(np.float64) @ m.out + m.bias, -30, 30)))


class Learner:
    """Weights with the state of their optimisers: Adam for the dense ones, AdaGrad by row for the embeddings.

    ``seen`` are the squared gradients that each row had before this learner began, ``fresh`` those since.
    """

    def __init__(self, share: float, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.share, self.steps = share, 0.0
        self.table = rng.normal(0, 0.03, (BUCKETS + 1, DIM)).astype(np.float32)
        self.table[_PAD] = 0
        n = FILTERS * len(WIDTHS)
        self.dense = {("f", w): rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS} | {"shift": np.zeros(n, np.float32), "out": rng.normal(0, 0.3, n).astype(np.float32), "bias": np.array([np.log(share / (1 - share))], np.float32)}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.dense.items()} for _ in range(2))
        self.seen, self.fresh = (np.zeros(BUCKETS + 1, np.float32) for _ in range(2))
        self.rng = rng

    def again(self) -> Learner:
        """Another that begins where this one is; no step of it changes this one."""
        out = copy.copy(self)
        out.table, out.fresh = self.table.copy(), np.zeros_like(self.fresh)
        out.dense, out.first, out.second = dict(self.dense), dict(self.first), dict(self.second)
        return out

    def step(self, encoded: list[np.ndarray], rows_of: np.ndarray, labels: np.ndarray, weights: np.ndarray, now: float) -> None:
        """One step on the weighted logistic loss of a batch; embeddings get gradients at the pooled positions only."""
        dense, table = self.dense, self.table
        lengths = np.array([len(e) for e in encoded])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate(encoded)
        bounds = np.stack([starts, starts + lengths - _GAP], 1).ravel()
        fresh, inverse = np.unique(flat, return_inverse=True)
        x = table[rows_of[fresh]].sum(1)[inverse]
        tops, places = [], []
        for w in WIDTHS:
            y = x @ dense["f", w][0]
            for k in range(1, w):
                y[:-k] += x[k:] @ dense["f", w][k]
            tops.append(np.maximum.reduceat(y, bounds, axis=0)[::2])
            places.append(np.stack([p + np.argmax(y[p:q], axis=0) for p, q in zip(bounds[::2], bounds[1::2], strict=True)]))
        z = np.concatenate(tops, 1) + dense["shift"]
        active = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ dense["out"] + dense["bias"], -30, 30)))
        d = ((p - labels) * weights / len(encoded)).astype(np.float32)
        grads = {"out": active.T @ d + 1e-4 * dense["out"], "bias": np.array([d.sum()], np.float32)}
        dz = d[:, None] * dense["out"] * (z > 0)
        grads["shift"] = dz.sum(0)
        spots, parts = [], []
        for j, w in enumerate(WIDTHS):
            dy, g = dz[:, j * FILTERS : (j + 1) * FILTERS], np.zeros_like(dense["f", w])
            for k in range(w):
                at = places[j] + k
                g[k] = np.einsum("dfe,df->ef", x[at], dy)
                spots.append(at.ravel())
                parts.append((dy[:, :, None] * dense["f", w][k].T[None]).reshape(-1, DIM))
            grads["f", w] = g + 1e-4 * dense["f", w]
        self.steps += 1
        for k, g in grads.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            dense[k] = dense[k] - now * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
        rows = rows_of[flat[np.concatenate(spots)]]
        hit, inverse = np.unique(rows.ravel(), return_inverse=True)
        g = np.zeros((len(hit), DIM), np.float32)
        np.add.at(g, inverse, np.repeat(np.concatenate(parts), rows.shape[1], 0))
        self.fresh[hit] += (g * g).mean(1)
        table[hit] -= STEP * now * g / (np.sqrt(self.seen[hit] + self.fresh[hit])[:, None] + 1e-6)
        table[_PAD] = 0

    def model(self) -> Model:
        return Model(self.share, self.table, {w: self.dense["f", w] for w in WIDTHS}, self.dense["shift"], self.dense["out"].astype(np.float64), float(self.dense["bias"][0]), learner=self)


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Model:
    """Fit on texts that are at hand, epoch by epoch in an order by chance."""
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        return Model(rate=share)
    weights = weights / weights.mean()
    learner, words = Learner(share, seed), Vocabulary()
    encoded = [words.read([t])[0] for t in texts]
    rows_of = words.array()
    for epoch in range(epochs):
        order = learner.rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            learner.step([encoded[i] for i in pick], rows_of, labels[pick], weights[pick], rate * (1 - epoch / epochs) + 0.001)
    return learner.model()


def _parted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows that end in a text whether it is for calibration."""
    for batch in stream:
        apart = [zlib.crc32(t, 1) % CALIBRATE == 0 for t in blobs(batch.column(batch.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apart, pa.bool_())], names=[*batch.schema.names, "apart"])


class Gathered:
    """What learners that began at one place have come to, each on its own rows, and their mean.

    An embedding's mean weighs a learner by the squared gradients that the row had there, so a word that few rows have is
    not thinned out by those without it. ``seen`` grows by the mean over learners that met the row.
    """

    def __init__(self) -> None:
        self.moved, self.squares, self.met = np.zeros((BUCKETS + 1, DIM)), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1, np.int32)
        self.rows, self.steps = 0, 0.0
        self.sums: list[dict] = [{}, {}, {}]

    def add(self, base: Learner, learner: Learner, rows: int) -> None:
        hit = np.flatnonzero(learner.fresh)
        self.moved[hit] += learner.fresh[hit, None].astype(np.float64) * (learner.table[hit] - base.table[hit])
        self.squares[hit] += learner.fresh[hit]
        self.met[hit] += 1
        self.rows, self.steps = self.rows + rows, self.steps + rows * learner.steps
        for total, found in zip(self.sums, (learner.dense, learner.first, learner.second), strict=True):
            for k, v in found.items():
                total[k] = total.get(k, 0) + rows * v.astype(np.float64)

    def packed(self, part: int) -> bytes:
        """One of ``PARTS`` ranges of the embeddings; the first goes with all else."""
        low, high = part * (BUCKETS + 1) // PARTS, (part + 1) * (BUCKETS + 1) // PARTS
        hit = low + np.flatnonzero(self.met[low:high])
        mean = (self.moved[hit] / self.squares[hit, None]).astype(np.float32)
        return pickle.dumps((hit.astype(np.int32), mean, self.squares[hit].astype(np.float32), self.met[hit], *((0, 0.0, ()) if part else (self.rows, self.steps, self.sums))))

    def unpack(self, data: bytes) -> None:
        hit, mean, squares, met, rows, steps, sums = pickle.loads(data)
        self.moved[hit] += squares[:, None].astype(np.float64) * mean
        self.squares[hit] += squares
        self.met[hit] += met
        self.rows, self.steps = self.rows + rows, self.steps + steps
        for total, found in zip(self.sums, sums, strict=False):
            for k, v in found.items():
                total[k] = total.get(k, 0) + v

    def mean(self, base: Learner) -> Learner:
        out, hit = base.again(), np.flatnonzero(self.squares)
        out.table[hit] += (self.moved[hit] / self.squares[hit, None]).astype(np.float32)
        out.table[_PAD] = 0
        out.seen = base.seen.copy()
        out.seen[hit] += (self.squares[hit] / self.met[hit]).astype(np.float32)
        out.dense, out.first, out.second = ({k: (v / self.rows).astype(np.float32) for k, v in total.items()} for total in self.sums)
        out.steps = self.steps / self.rows
        return out


def _learned(shared, rate: float):
    """From rows (shard, label, text), in runs of one shard, to what the task's learners have come to, in parts; one learner a run."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, words, gathered = shared.value, Vocabulary(), Gathered()
        learner, now, first, n, held, size = base.again(), None, None, 0, [], 0

        def step() -> None:
            nonlocal words, held, size
            if held:
                if len(words.rows) > REMEMBERED:
                    words = Vocabulary()
                encoded = [words.read([t])[0] for t, _ in held]
                learner.step(encoded, words.array(), np.array([y for _, y in held], np.float64), np.ones(len(held)), rate)
            held, size = [], 0

        for batch in stream:
            for shard, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), strict=True):
                if shard != now:
                    step()
                    if n:
                        gathered.add(base, learner, n)
                    learner, now, n, first = base.again(), shard, 0, shard if first is None else first
                if len(held) == BATCH or held and size + len(text) > BATCH_BYTES:
                    step()
                held.append((text, label))
                size, n = size + len(text), n + 1
        step()
        if n:
            gathered.add(base, learner, n)
            yield pa.RecordBatch.from_pydict({"part": list(range(PARTS)), "shard": [first] * PARTS, "learnt": [gathered.packed(i) for i in range(PARTS)]}, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("learnt", pa.binary())]))

    return run


def _joined(found: pa.Table) -> pa.Table:
    """Rows (part, shard, learnt) of one part as one, so that the driver gets one model however many tasks there are."""
    gathered, found = Gathered(), found.sort_by("shard")
    for data in found["learnt"].to_pylist():
        gathered.unpack(data)
    part = found["part"][0].as_py()
    return pa.table({"part": pa.array([part], pa.int32()), "learnt": pa.array([gathered.packed(part)], pa.binary())})


def learn(rows: DataFrame, learner: Learner, rounds: int | None = None, rate: float = RATE) -> Learner:
    """Passes over all rows (shard, label, text): one learner for each shard, all from one place, then their mean."""
    spark = ship(rows.sparkSession)
    rounds = ROUNDS if rounds is None else rounds
    for k in range(rounds):
        base = learner.again()
        base.seen = learner.seen + learner.fresh if k == 0 else learner.seen
        sent = spark.sparkContext.broadcast(base)
        found = rows.select("shard", "label", "text").coalesce(TASKS).mapInArrow(_learned(sent, rate * (1 - k / rounds) + 0.001), "part int, shard int, learnt binary")
        gathered = Gathered()
        for r in sorted(found.groupBy("part").applyInArrow(_joined, "part int, learnt binary").collect()):
            gathered.unpack(bytes(r.learnt))
        sent.destroy()
        learner = gathered.mean(base)
    return learner


def calibrate(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list, least: int = 20) -> dict[str | None, float]:
    """Thresholds of best F1 by language; the key "*" holds for languages with fewer than ``least`` rows of a class.

    A row can stand for several: ``weights`` are its numbers.
    """

    def best(pick: np.ndarray) -> float:
        order = np.argsort(-scores[pick], kind="stable")
        s, y, w = scores[pick][order], labels[pick][order], weights[pick][order]
        hits, taken = np.cumsum(y * w), np.cumsum(w)
        f1 = 2 * hits / (taken + (y * w).sum())
        f1[:-1][s[:-1] == s[1:]] = -1
        i = int(np.argmax(f1))
        return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i])

    if not len(labels) or not 0 < labels.mean() < 1:
        return {"*": CUT}
    out: dict[str | None, float] = {"*": best(np.arange(len(labels)))}
    by_lang: dict = {}
    for i, x in enumerate(langs):
        by_lang.setdefault(x, []).append(i)
    for lang in sorted(x for x in by_lang if x is not None):
        pick = np.array(by_lang[lang])
        ones = (labels[pick] * weights[pick]).sum()
        if min(ones, weights[pick].sum() - ones) >= least:
            out[lang] = best(pick)
    return out


def thresholds(rows: DataFrame, n: int, model: Model) -> dict[str | None, float]:
    """calibrate() over all n rows (label, lang, text); from ``CELLS`` rows on those of about one score count as one, by number."""
    if not n:
        return calibrate(np.zeros(0), np.zeros(0), np.zeros(0), [])
    sent = ship(rows.sparkSession).sparkContext.broadcast(model)
    found = rows.select("label", "lang", "text").mapInArrow(_scored(sent), f"label int, lang {rows.schema['lang'].dataType.simpleString()}, score double")
    if n <= CELLS:
        found = found.withColumn("n", F.lit(1))
    else:
        cell = F.round(F.log(F.col("score") / (1 - F.col("score"))) * 64) / 64
        found = found.groupBy("label", "lang", (1 / (1 + F.exp(-cell))).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    found = found.collect()
    return calibrate(np.array([r.score for r in found]), np.array([r.label for r in found], np.float64), np.array([r.n for r in found], np.float64), [r.lang for r in found])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", folds: int = FOLDS, held: int = HELD, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model fitted on all labelled rows of docs that are not held out; the sample is where learning begins."""
    found, n = labelled(keyed(docs, doc_id=doc_id, text=text, lang=lang), keyed(labels, doc_id=doc_id, label=label), crc_fold("doc_id", folds) == held)
    shards = max(1, -(-n // SHARD_ROWS))
    whole = F.coalesce("text", F.lit(""))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    found = found.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), "label", h.alias("h"), F.length(whole).alias("chars"), F.octet_length(whole).alias("size"), "lang", whole.cast("binary").alias("text"))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in found.schema)
    ship(docs.sparkSession)
    found = found.mapInArrow(_parted, f"{kinds}, apart boolean")
    found = materialise(found.repartitionById(shards, F.col("shard")).sortWithinPartitions("h", "label"), "labelled")
    counts = {(r.label, r.apart): r.n for r in found.groupBy("label", "apart").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = counts.get((0, False), 0) > 0 < counts.get((1, False), 0)
    fitted, kept = (found.where("not apart"), found.where("apart")) if split else (found, found.limit(0))
    shares = {c: counts.get((c, False), 0) + (0 if split else counts.get((c, True), 0)) for c in (0, 1)}
    short = F.col("chars") <= sample_chars
    bounds = []
    for c in (0, 1):
        spent = 0
        for r in sorted(found.where(short & (F.col("label") == c)).select("h", "size").orderBy("h").limit(sample_rows).collect()):
            spent += r.size
            if spent > sample_bytes // 2:
                break
            bounds.append((c, r.h))
    last = dict(bounds)
    picked = [(F.col("label") == c) & (F.col("h") <= x) for c, x in last.items()]
    rows = [(r.label, bytes(r.text)) for r in fitted.where(short & reduce(Column.__or__, picked)).select("label", "text").collect()] if picked else []
    rows.sort(key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))
    y = np.array([r[0] for r in rows], np.float64)
    model = train([r[1] for r in rows], y, np.array([shares[r[0]] / max(1, (y == r[0]).sum()) for r in rows]))
    if all(shares.values()) and len(rows) < sum(shares.values()):
        model = learn(fitted, model.learner or Learner(shares[1] / sum(shares.values()))).model()
    elif model.table is None and any(shares.values()):
        model = Model(rate=shares[1] / sum(shares.values()))
    model.learner = None
    model.thresholds = thresholds(kept, sum(v for (_, apart), v in counts.items() if apart) if split else 0, model)
    discard(found)
    return model


def _scored(shared):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in stream:
            texts = blobs(batch.column(batch.num_columns - 1))
            scores = np.concatenate([scorer.score(texts[i : i + 64]) for i in range(0, len(texts), 64)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, score, threshold and flagged (by language)."""
    spark = ship(docs.sparkSession)
    read = keyed(docs, doc_id=doc_id, lang=lang, text=text)
    out = read.mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, lang {read.schema['lang'].dataType.simpleString()}, score double")
    limits = model.thresholds or {"*": CUT}
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in limits.items() if k != "*"], F.lit(limits["*"]))
    return out.withColumn("threshold", limit).withColumn("flagged", F.col("score") >= F.col("threshold"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; predicted is 1 from 0.5."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "flagged")


SQL = None

"""Classifiers, mixing, near-dedup, sharding, archives and the pipeline against brute force, SQL and held-out accuracy."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import types
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import common, decontaminate, mixing, neardup, quality, registry, sharding, toxicity, warc
from folioscope.llm.common import utf8_words
from folioscope.session import table

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def duck(folder, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"create view {n} as select * from '{folder}/{n}.parquet'")
    return con


def sorted_rows(columns, rows):
    return sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(columns)]) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    df = registry.queries()[name](spark, SMALL)
    wanted = duck(SMALL, "documents", "benchmark", "pages", "conversations").sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(df.columns, [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()])


def auc(scores, labels):
    pairs = sorted(zip(scores, labels, strict=True))
    ranks = sum(i + 1 for i, (_, y) in enumerate(pairs) if y)
    n = sum(labels)
    return (ranks - n * (n + 1) / 2) / (n * (len(labels) - n))


@needs_tables
@pytest.mark.parametrize(("name", "column", "folds", "held", "cut", "least"), [("op2_toxicity", "toxic", 5, 0, 0.5, 0.9), ("op5_quality", "quality", 4, 2, 0.7, 0.95)])
def test_held_out_accuracy(spark, name, column, folds, held, cut, least):
    rows = registry.queries()[name](spark, MORE).collect()
    labels = {r.doc_id: r[column] for r in table(spark, MORE, "labels").collect()}
    assert len(rows) == table(spark, MORE, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
    kept = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in kept], [labels[r.doc_id] for r in kept]) > least
    assert sum(r.predicted == labels[r.doc_id] for r in kept) / len(kept) > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_meet_odd_tables(spark, module):
    rows = [(i if i % 7 else None, [None, "", "bad word", "fine words here", "x " * 5000][i % 5], None if i % 3 else "en", 1.0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(40)] + [(None, 1), (3, 0)], "doc_id bigint, label int")
    for known in (labels, labels.where("label = 1"), labels.limit(0)):
        model = module.fit(docs, known, label="label")
        found = module.score(docs, model).select("score_" if module is quality else "score")
        assert found.count() == 40 and all(0 <= r[0] <= 1 for r in found.collect())
    assert module.score(docs.limit(0), model).count() == 0
    if module is quality:
        assert quality.accepted(docs, model).columns == docs.columns


def test_scores_depend_on_text_alone():
    model = toxicity.train([b"you idiot", b"a fine day", b"idiot again", b"nice words"] * 10, np.array([1.0, 0.0, 1.0, 0.0] * 10), np.ones(40))
    score = toxicity.Scorer(model).score
    s = score([b"an idiot", b"fine nice day", None, b""])
    assert s[0] > 0.5 > s[1] and s[2] == s[3]
    assert abs(score([b"an idiot"])[0] - s[0]) < 1e-6


def plain_convolution(model, text):
    """The score of one text by its whole matrix of embeddings, filter by filter."""
    words = utf8_words(text)
    x = np.zeros((max(1, len(words)) + max(toxicity.WIDTHS) - 1, toxicity.DIM))
    for i, w in enumerate(words):
        x[i] = model.table[toxicity.buckets(w)].astype(float).sum(0)
    n, logit, at = max(1, len(words)), model.bias, 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = max(sum(x[k : k + n] @ model.filters[width][k][:, f] for k in range(width)))
            logit += max(0.0, best + float(model.shift[at])) * float(model.out[at])
            at += 1
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


@needs_tables
def test_toxicity_query_agrees_with_plain_convolution(spark):
    docs = table(spark, SMALL, "documents")
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = toxicity.query(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert abs(r.score - plain_convolution(model, texts[r.doc_id])) < 1e-3


def plain_densities(model, data):
    """The log densities' difference of one text's statistics, from covariances that are put together again."""
    z = (np.array(quality.statistics(data)) - model.centre) / model.scale
    logs = []
    for mean, inverse in zip(model.means, model.factors, strict=True):
        covariance = np.linalg.inv(inverse.T @ inverse)
        logs.append(-0.5 * (z - mean) @ np.linalg.solve(covariance, z - mean) - 0.5 * np.linalg.slogdet(covariance)[1])
    return logs[1] - logs[0]


@needs_tables
def test_quality_query_agrees_with_plain_densities(spark):
    docs = table(spark, SMALL, "documents")
    model = quality.fit(docs, table(spark, SMALL, "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = quality.query(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        d = max(-30, min(30, model.scaled * plain_densities(model, texts[r.doc_id]) + model.shifted))
        assert abs(r.score - 1 / (1 + math.exp(-d))) < 1e-5


def test_toxicity_scores_agree_with_plain_convolution():
    r = random.Random(2)
    vocabulary = ["you", "idiot", "idiotic", "stupidity", "fine", "day", "é", "wonderful", "日本語"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30))).encode() for _ in range(80)]
    labels = np.array([float(b"idiot" in t or b"stupid" in t) for t in texts])
    model = toxicity.train(texts, labels, np.ones(80))
    odd = [None, b"", b"idiot", b"!!!", ("fine day " * 200_000 + "stupidity").encode()]
    got = toxicity.Scorer(model).score(texts + odd)
    assert np.allclose(got[:-1], [plain_convolution(model, t) for t in texts + odd[:-1]], atol=1e-4)
    assert abs(got[-1] - plain_convolution(model, b"fine day fine day fine day stupidity")) < 1e-4


def test_quality_scores_agree_with_plain_densities():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, len(quality.STATISTICS))) @ r.normal(size=(len(quality.STATISTICS),) * 2)
    y = (x[:, 0] ** 2 > np.median(x[:, 0] ** 2)).astype(float)
    model = quality.train(x, y, np.ones(400), 0.3, 0.05)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    covariances = [np.cov(z[y == c].T) for c in (0, 1)]
    logs = []
    for c in (0, 1):
        s = 0.7 * covariances[c] + 0.3 * (covariances[0] + covariances[1]) / 2
        s = 0.95 * s + 0.05 * np.trace(s) / len(s) * np.eye(len(s))
        off = z - z[y == c].mean(0)
        logs.append(-0.5 * (off * np.linalg.solve(s, off.T).T).sum(1) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.difference(x), logs[1] - logs[0], rtol=1e-8, atol=1e-8)
    texts = [b"a fine text. " * 9, b"", None, b"<<>>{}{}" * 7, b"long words " * 300_000]
    d = model.difference(np.array([quality.statistics(t) for t in texts]))
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-np.clip(model.scaled * d + model.shifted, -30, 30))))
    assert model.score([None])[0] == model.score([b""])[0]


def test_calibration_uses_rows_kept_from_fitting(spark, monkeypatch):
    texts = [f"{'idiot' if i % 2 else 'fine'} words {i}" for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 3, "doc_id bigint, toxic int")
    seen = {}
    train, calibrate = toxicity.train, toxicity.calibrate
    monkeypatch.setattr(toxicity, "train", lambda t, *a, **k: seen.update(train=t) or train(t, *a, **k))
    monkeypatch.setattr(toxicity, "calibrate", lambda s, *a, **k: seen.update(calibrated=len(s)) or calibrate(s, *a, **k))
    model = toxicity.fit(docs, labels)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200))
    assert len(set(seen["train"])) == len(seen["train"]) and seen["calibrated"] + len(seen["train"]) == 200 - held and seen["calibrated"] > 10
    assert set(model.thresholds) <= {"*", "en"}
    toxicity.fit(docs, labels, sample_bytes=400)
    assert sum(map(len, seen["train"])) <= 400


def vocabulary_fixture(spark):
    """Toxic words of which each is in a few rows only, one of them in long texts only; documents and labels."""
    r = random.Random(8)
    bad, fine = [f"vile{c}x" for c in "abcdefghijklmnopqrstuvwxyz"[:24]], ["day", "house", "river", "tree", "walk", "music", "paper"]
    rows = []
    for i in range(1200):
        words = [r.choice(fine) for _ in range(r.randint(4, 12))] + ([f"q{bad[i // 2 % 24][4]}z" if i % 4 == 1 else bad[i // 2 % 24]] if i % 2 else [])
        if i % 50 == 25:
            words = ["wordless"] + [r.choice(fine) for _ in range(200)]
        r.shuffle(words)
        rows.append((i, " ".join(words), "en" if i % 3 else "de", i % 2 if i % 50 != 25 else 1))
    docs = spark.createDataFrame([x[:3] for x in rows] + [(None, "day", "en"), (5000, "house", "en")], "doc_id bigint, text string, lang string")
    return rows, docs, spark.createDataFrame([(x[0], x[3]) for x in rows] + [(None, 1), (7000, 1)], "doc_id bigint, toxic int")


@pytest.mark.parametrize("cells", [1 << 16, 100])
def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch, cells):
    rows, docs, labels = vocabulary_fixture(spark)
    rest = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    apart = [x for x in rest if zlib.crc32(x[1].encode(), 1) % 5 == 0]
    seen = {}
    train, calibrate, mean = toxicity.train, toxicity.calibrate, toxicity.Gathered.mean
    monkeypatch.setattr(toxicity, "CELLS", cells)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 400)
    monkeypatch.setattr(toxicity, "train", lambda t, *a, **k: seen.update(start=len(t)) or train(t, *a, **k))
    monkeypatch.setattr(toxicity, "calibrate", lambda s, y, w, g, *a: seen.update(calibrated=w.sum(), cells=len(s), langs=set(g)) or calibrate(s, y, w, g, *a))
    monkeypatch.setattr(toxicity.Gathered, "mean", lambda self, base: seen.update(taught=self.rows) or mean(self, base))
    monkeypatch.setattr(toxicity, "ROUNDS", 6)
    model = toxicity.fit(docs, labels, sample_rows=12, sample_chars=300)
    assert seen["start"] <= 24 and seen["taught"] == len(rest) - len(apart) and seen["calibrated"] == len(apart)
    assert (seen["cells"] == len(apart)) == (cells > 100) and seen["langs"] == {"en", "de"} == set(model.thresholds) - {"*"}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    scores = toxicity.Scorer(model).score([x[1].encode() for x in held])
    assert auc(scores.tolist(), [x[3] for x in held]) > 0.99
    assert toxicity.Scorer(model).score([b"river wordless tree"])[0] > 0.5
    again = toxicity.fit(docs, labels, sample_rows=12, sample_chars=300)
    assert np.allclose(toxicity.Scorer(again).score([x[1].encode() for x in held]), scores, atol=1e-5)


@pytest.mark.parametrize(("maps", "kind"), [(1, "bigint"), (2048, "bigint"), (2048, "string")])
def test_labelled_rows_are_whole(spark, monkeypatch, maps, kind):
    monkeypatch.setattr(common, "MAPS", maps)
    docs = spark.createDataFrame([(i % 9000 if i % 11 else None, f"t{i}") for i in range(12_000)], "doc_id bigint, text string").select(F.col("doc_id").cast(kind), "text")
    labels = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(0, 10_000, 2)] * 2 + [(4, 0), (None, 1)], "doc_id bigint, label int")
    found, n = common.labelled(docs, labels, common.crc_fold("doc_id", 5) == 0)
    ids = {i % 9000 for i in range(12_000) if i % 11}
    known = {(i, i % 3) for i in range(0, 10_000, 2) if i % 5 and i % 3 < 2} | {(4, 0)}
    known = {(i, y) for i, y in known if zlib.crc32(str(i).encode()) % 5}
    rows = found.collect()
    assert n == len(known) and sorted((int(r.doc_id), r.label) for r in rows) == sorted(x for x in known if x[0] in ids)
    assert all(int(r.text[1:]) % 9000 == int(r.doc_id) for r in rows)


def test_intermediate_tables_go_and_need_a_shared_folder(spark):
    made = common.materialise(spark.range(3), "test")
    path = made.__dict__["_written"]
    assert made.count() == 3 and os.path.isdir(path.removeprefix("file:"))
    common.discard(made, None, spark.range(2))
    assert not os.path.exists(path.removeprefix("file:"))
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: d), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(cluster, "x")


def shared(total, sizes, weights, cap=2.0):
    """Targets by sharing the excess again and again."""
    aim = dict.fromkeys(sizes, 0.0)
    open_ones = set(sizes)
    while open_ones:
        rest = total - sum(aim[s] for s in sizes if s not in open_ones)
        w = sum(weights[s] for s in open_ones)
        over = {s for s in open_ones if rest * weights[s] / w > cap * sizes[s]}
        for s in open_ones:
            aim[s] = rest * weights[s] / w
        if not over:
            break
        for s in over:
            aim[s] = cap * sizes[s]
        open_ones -= over
    return aim


def test_mix_meets_targets(spark):
    r = random.Random(3)
    rows = [(i if i % 50 else None, None if i % 97 == 0 else " ".join(["w"] * r.choice([0, 1, 5, 50, 400])), r.choice(["a"] * 6 + ["b", "c", "É", None]), i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    found = mixing.sampled(mixing.placed(docs)).selectExpr("source", "size as words", "source_size", "target", "copies").collect()
    assert len(found) == 3000 and all(0 <= x.copies <= 2 for x in found)
    sizes = {}
    for x in found:
        sizes[x.source] = sizes.get(x.source, 0) + x.words
    order = sorted((s for s in sizes if s is not None)) + [None]
    aim = shared(1.5 * sum(sizes.values()), sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        mine = [x for x in found if x.source == s]
        assert all(x.source_size == sizes[s] and math.isclose(x.target, aim[s], rel_tol=1e-9) for x in mine)
        assert abs(sum(x.copies * x.words for x in mine) - aim[s]) <= 800
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in found)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_spreads_equal_rows_and_takes_huge_texts(spark):
    same = spark.range(100_000).selectExpr("cast(null as bigint) as doc_id", "'' as text", "'a' as source", "1 as lang")
    more = spark.range(300).selectExpr("id as doc_id", "'w v' as text", "'a' as source", "cast(id % 2 as int) as lang")
    again = spark.range(5000).selectExpr("7L as doc_id", "'x y z' as text", "'b' as source", "1 as lang")
    huge = spark.createDataFrame([(8, "w " * 300_000, "c", 1), (8, None, "d", None), (8, None, "d", 2)], "doc_id bigint, text string, source string, lang int")
    docs = same.unionAll(more).unionAll(again).unionAll(huge).repartition(6)
    order = mixing.materialise(mixing.placed(docs), "test")
    entries = mixing.entries(order).collect()
    assert max(e.n for e in entries) == 100_000 and len(entries) == 1 + 300 + 1 + 3
    found = mixing.sampled(order).groupBy("row", "source", "target", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("copies").alias("most")).collect()
    assert sum(r.n for r in found) == docs.count() and all(r.most <= 2 for r in found)
    b = next(r for r in found if r.source == "b")
    assert b.n == 5000 and abs(b.copies * 3 - b.target) <= 6
    out = mixing.mix(docs)
    counts = {tuple(r)[:4]: r["count"] for r in out.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.md5(F.coalesce("text", F.lit("-")).cast("binary")).alias("text"), "source", "lang").count().collect()}
    assert sum(counts.values()) == sum(r.copies for r in found)
    assert out.columns == docs.columns


def test_targets_of_many_sources(spark):
    r = random.Random(8)
    sizes = {f"s{i:04d}É"[: r.choice([5, 6])] if i else None: r.choice([0, 1, 7, 7, 300, 5000, 10**9]) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(5)
    order = sorted(s for s in sizes if s is not None) + [None]
    aim = shared(1.5 * sum(sizes.values()), sizes, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)})
    found = {x.source: x.target for x in mixing.targets(df).collect()}
    assert found.keys() == sizes.keys() and all(math.isclose(found[s], aim[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def brute_classes(texts):
    """Class number of each text by comparing all pairs."""
    known, parts = {}, [utf8_words(t.encode()) if t else [] for t in texts]
    made = [neardup.shingles(w, known) for w in parts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = parts[i] == parts[j] and (parts[i] or (texts[i] or "") == (texts[j] or ""))
            if same or (len(made[i]) and len(made[j]) and neardup.similar(made[i], made[j])):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def partition(pairs):
    groups = {}
    for item, group in pairs:
        groups.setdefault(group, set()).add(item)
    return {frozenset(g) for g in groups.values()}


def near_fixture():
    r = random.Random(9)
    base = [r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(r.randrange(60)) for _ in range(240)]
    passage = " ".join(f"shared{i}" for i in range(120))
    texts = [" ".join(base)] * 5 + [" ".join(base).upper() + "!"]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [passage + " " + " ".join(f"own{k}_{i}" for i in range(120)) for k in range(20)]
    return texts + [None, "", "", "!!!", "one two", "one two", "one two three four five six", " ".join(base[:230])]


def test_near_duplicates_agree_with_all_pairs(spark):
    texts = near_fixture()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, key int")
    rows = neardup.classes(docs).collect()
    want = brute_classes(texts)
    assert partition((r.doc_id, r.class_id) for r in rows) == partition(enumerate(want))
    assert all(r.class_size == want.count(want[r.doc_id]) and r.kept == (r.doc_id == r.class_id) for r in rows)
    left = neardup.distinct(docs.unionAll(docs.where("doc_id in (0, 70)")))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.distinct(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_distinct_does_not_depend_on_the_filter(spark, monkeypatch, cells):
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(40)]
    rows = [(k, t, "a") for k, t in enumerate(texts)] + [(100 + k, texts[k].upper(), "b") for k in range(5)] + [(7, texts[7], "a"), (None, None, None), (None, None, "c"), (200, "!", "a")]
    monkeypatch.setattr(neardup, "FILTER", cells)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    left = [tuple(r) for r in neardup.distinct(docs).collect()]
    assert len(left) == 42 and sorted(r[0] for r in left if r[0] is not None) == [*range(40), 200]
    assert all(r in rows for r in left)


def family_fixture():
    """Unlike texts of a family that share a long passage, a few of them with one near copy in the family."""
    r = random.Random(4)
    passage = [f"licence{i}" for i in range(264)]
    texts = []
    for k in range(200):
        own = [f"own{k}x{i}" for i in range(44)]
        texts.append(" ".join(passage + own))
        if k % 20 == 3:
            texts.append(" ".join(passage + own[:16] + [f"other{k}x{i}" for i in range(28)]))
    r.shuffle(texts)
    return texts


def test_near_pairs_inside_a_family_agree_with_all_pairs(spark, monkeypatch):
    texts = family_fixture()
    want = partition(enumerate(brute_classes(texts)))
    assert len(want) == 200 and max(map(len, want)) == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert partition((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()) == want
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert partition((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()) == want


def test_bitmaps_never_drop_a_link():
    r, known = random.Random(6), {}
    words = []
    for _ in range(60):
        w = [f"w{r.randrange(r.choice([3, 40, 4000]))}" for _ in range(r.choice([1, 4, 9, 60, 130, 700]))]
        words += [w] + [[x for x in w if r.random() > 0.02] + ["end"] * r.randrange(3) for _ in range(3)]
    made = [neardup.shingles([x.encode() for x in w], known) for w in words]
    links = {(i, j) for j in range(len(made)) for i in range(j) if neardup.similar(made[i], made[j])}
    rows = [(0, b"%d" % i, len(s), neardup.marks(s)) for i, s in enumerate(made)]
    found = {tuple(sorted(p)) for p in neardup.possible(rows)}
    assert links <= found and len(links) > 60 and len(found) < len(rows) * (len(rows) - 1) // 4
    halves = {tuple(sorted(p)) for p in neardup.possible([(i % 2, *row[1:]) for i, row in enumerate(rows)])}
    assert halves == {(i, j) for i, j in found if (i + j) % 2}


@needs_tables
def test_near_duplicates_of_the_small_table(spark):
    docs = table(spark, SMALL, "documents").orderBy("doc_id").collect()
    rows = neardup.query(spark, SMALL).collect()
    want = brute_classes([d.text for d in docs])
    assert partition((r.doc_id, r.class_id) for r in rows) == partition((d.doc_id, docs[w].doc_id) for d, w in zip(docs, want, strict=True))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(5)
    for _ in range(300):
        many = r.choice([5, 50, 1000])
        a = [r.randrange(many) for _ in range(r.randint(1, 120))]
        b = [x for x in a if r.random() > 0.04] or [1]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randrange(len(b) + 1), r.randrange(many))
        if r.random() < 0.2:
            k = r.randrange(len(b))
            b = b[k:] + b[:k]
        m = lcs(a, b)
        true = m >= 0.8 * (len(a) + len(b) - m)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert neardup.similar(x, y) == true and (not true or neardup.aligned(x, y) == m)


def test_banded_alignment_in_blocks(monkeypatch):
    r = random.Random(7)
    for blocks in (200, 3000, 32 << 20):
        monkeypatch.setattr(neardup, "MASKS", blocks)
        for _ in range(60):
            many = r.choice([1, 2, 40, 3000])
            a = [r.randrange(many) for _ in range(r.randint(100, 900))]
            b = [x for x in a if r.random() > 0.03]
            for _ in range(r.randint(0, 30)):
                b.insert(r.randrange(len(b) + 1), r.randrange(many))
            m = lcs(a, b)
            true = m >= 0.8 * (len(a) + len(b) - m)
            x, y = np.array(a, np.uint64), np.array(b, np.uint64)
            assert neardup.similar(x, y) == true and (not true or neardup.aligned(x, y) == m)


def test_long_alignments_stay_small():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 40, 60_000, dtype=np.uint64)
    b = np.delete(a, r.integers(0, len(a), 5_000))
    b[r.integers(0, len(b), 200)] = 1
    tracemalloc.start()
    assert neardup.similar(a, b)
    assert tracemalloc.get_traced_memory()[1] < 3 * neardup.MASKS
    tracemalloc.stop()
    assert neardup.similar(np.full(40_000, 5, np.uint64), np.full(39_000, 5, np.uint64))


def test_recall_of_planted_pairs(spark):
    """Pairs of an edit similarity of 0.8 to 0.95 over shingles, judged by a plain alignment; at least 0.99 are found."""
    r, known = random.Random(12), {}
    texts, links = [], set()
    for k in range(400):
        base = [f"w{k}x{r.randrange(900)}" for _ in range(r.randrange(120, 400))]
        copy = list(base)
        for _ in range(max(1, int(len(base) * r.uniform(0.006, 0.024)))):
            copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
        a, b = (neardup.shingles([x.encode() for x in t], known) for t in (base, copy))
        m = lcs(a.tolist(), b.tolist())
        if 0.8 <= m / (len(a) + len(b) - m) <= 0.95:
            links.add((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert len(links) > 250 and sum(found[a] == found[b] for a, b in links) >= 0.99 * len(links)


def test_answers_do_not_depend_on_other_buckets(spark):
    """Three texts in one bucket, of which two are a link and the third, unlike both, may be the centre."""
    r = random.Random(1)
    passage = [f"p{i}" for i in range(160)]
    texts = [" ".join(passage + [f"a{i}" for i in range(90)])]
    own = [f"b{i}" for i in range(60)]
    texts += [" ".join(passage + own), " ".join(passage + own[:30] + ["edit"] + own[31:])]
    more = [" ".join(f"m{k}x{i}" for i in range(50)) for k in range(4) for _ in (0, 1)]
    more = [t + f" end{i}" for i, t in enumerate(more)]
    for n in (3, len(texts) + len(more)):
        both = (texts + more)[:n]
        docs = spark.createDataFrame(list(enumerate(both)), "doc_id bigint, text string").orderBy(F.rand(r.randrange(99)))
        for bands in (1, 4):
            found = {x.doc_id: x.class_id for x in neardup.classes(docs, bands=bands, length=1).collect()}
            pairs = [(i, j) for i in range(n) for j in range(i) if set(sketch_of(both[i], bands, 1)) & set(sketch_of(both[j], bands, 1)) and brute_classes([both[i], both[j]])[1] == 0]
            assert all(found[i] == found[j] for i, j in pairs) and found[0] != found[1]


def sketch_of(text, bands, length):
    return neardup.sketch(neardup.shingles([w.encode() for w in text.split()], {}), bands, length).tolist()


def test_the_filter_keeps_every_key(spark):
    keys = [hashlib.sha256(b"%d" % i).digest()[:16] for i in range(3000)]
    made = neardup.key_filter(spark.createDataFrame([(bytearray(k),) for k in keys[:1500]], "key binary"), 1500)
    cells, bits = neardup._places(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16), len(made))
    passed = (made[cells] & bits) == bits
    assert passed[:1500].all() and passed[1500:].mean() < 0.1


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(25)]
    df = spark.createDataFrame([(b"%04d" % a, b"%04d" % b) for a, b in links if a != b], "a binary, b binary")
    found = {int(r.key): int(r.root) for r in neardup.components(df).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: m for n, m in root.items() if any(n in p and p[0] != p[1] for p in links)}


@pytest.mark.parametrize(("extra", "limit"), [(0, 20_000), (300, 3_000), (5, 100)])
@needs_tables
def test_shards_agree_with_sql(spark, extra, limit):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    more = [(7, "abc def")] * extra + [(None, None)] * 5 + [(None, "x" * 50)] * 200
    docs = docs.unionAll(spark.createDataFrame(more, "doc_id bigint, text string").repartition(3)) if extra else docs
    found = sharding.assign(docs, limit=limit).select("row.doc_id", "n_bytes", "shard", "depth", "part", "shard_bytes", "oversize")
    rows = [r.asDict() for r in found.collect()]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    wanted = con.sql(sharding.oracle(limit))
    assert sorted_rows(found.columns, rows) == sorted_rows(found.columns, [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()])
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r)
    for group in held.values():
        assert sum(r["n_bytes"] for r in group) == group[0]["shard_bytes"]
        assert group[0]["shard_bytes"] <= limit or len(group) == 1
    names = sorted(n.split("-")[0] for n in held)
    assert not any(b != a and b.startswith(a) for a, b in zip(names, names[1:], strict=False))


def test_shards_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 300, 1), (1, "a" * 300, 1), (None, None, 2), (2, "b" * 900, 3)], "doc_id bigint, text string, shard int")
    sharding.write(docs, f"{tmp_path}/shards", limit=400)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 4 and len([p for p in os.listdir(f"{tmp_path}/shards") if p.startswith("shard_=")]) >= 3
    assert sharding.assign(docs.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    big, other = "<p>" + "lorem ipsum " * 30, "x" * 99
    rows = [(5, "http://a/%20b?q=1", big), (2, None, big), (9, "u\r\nX: y", big), (1, "é", other), (3, "", other), (4, "n", None), (None, "n", big), (7, "", ""), (2, "again", big)]
    rows += [(100 + i, f"http://h/{i}", f"<html>{i} " + "word " * (50 + i)) for i in range(60)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id bigint, url string, html string, digest string")
    manifest = warc.write(pages, f"{tmp_path}/warc", archive_bytes=4000)
    assert manifest.count() > 2 and manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    found = {}
    for r in warc.read(manifest).collect():
        found.setdefault(r.page_id, []).append(r)
    assert {k: len(v) for k, v in found.items() if len(v) > 1} == {"2": 2}
    for page, url, html in rows:
        payload = (html or "").encode()
        for r in found[None if page is None else str(page)]:
            assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
            revisit = html == big and page != 2
            assert (r.record_type, r.refers_to) == (("revisit", "2") if revisit else ("response", None))
            assert r.payload == (None if revisit else payload)
    assert found["5"][0].url == "http://a/%20b?q=1" and found["9"][0].url == "u%0D%0AX: y" and found["1"][0].url == "é"
    assert warc.read(warc.write(pages.limit(0), f"{tmp_path}/none")).count() == 0


def test_archives_keep_string_ids(spark, tmp_path):
    big = "same payload " * 20
    rows = [("", big), ("a/b é>", big), (None, big), ("z", None), ("z", "short")]
    back = warc.read(warc.write(spark.createDataFrame(rows, "page_id string, html string").selectExpr("page_id", "'u' as url", "html"), f"{tmp_path}/w")).collect()
    found = sorted((r.page_id is None, r.page_id or "", r.record_type, r.refers_to, r.payload_bytes) for r in back)
    assert found == [(False, "", "response", None, 260), (False, "a/b é>", "revisit", "", 260), (False, "z", "response", None, 0), (False, "z", "response", None, 5), (True, "", "revisit", "", 260)]


def test_archive_has_a_dictionary_and_separate_frames():
    import struct

    import zstandard

    records = [warc.record(str(i), None, b"<html>common words of all pages " * 20 + str(i).encode(), "0" * 64, None) for i in range(80)]
    data = warc.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    left, frames = data[8 + size :], []
    while left:
        one = decoder.decompressobj()
        frames.append(one.decompress(left))
        left = one.unused_data
    assert frames == records
    assert list(warc.unpack(b"")) == [] and len(list(warc.unpack(warc.pack(records[:1])))) == 1


@needs_tables
def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, SMALL), f"test-{name}")
        after = docs.collect()
        kept[name] = (before, after)
        assert docs.columns[: len(columns)] == columns
    before, after = kept["quality"]
    model = quality.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    want = [r.doc_id for r, s in zip(before, model.score([(r.text or "").encode() for r in before]), strict=True) if s >= quality.CUT]
    assert sorted(r.doc_id for r in after) == sorted(want) and 0 < len(want) < len(before)
    before, after = kept["near_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(before[i].doc_id for i in set(brute_classes([r.text for r in before])))
    before, after = kept["decontamination"]
    items = [(str(r.item_id), (r.text or "").encode()) for r in table(spark, SMALL, "benchmark").collect()]
    built = decontaminate.automaton(items)
    clean = []
    for r in before:
        w = utf8_words((r.text or "").encode())
        n = len(decontaminate.find(w, built)[0])
        clean += [r.doc_id] * (not (n > 0 and 20 * n >= len(w)))
    assert sorted(r.doc_id for r in after) == sorted(clean)
    before, after = kept["mixing"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert abs(sum(map(size, after)) - 1.5 * sum(map(size, before))) < 0.05 * sum(map(size, before))
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = kept["sharding"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after) and all(r.shard.startswith("b") for r in after)
    assert corpus_pipeline.run(spark, SMALL).count() == len(after)


def test_pipeline_near_dedup_of_a_family_agrees_with_all_pairs(spark):
    texts = family_fixture()
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars int")
    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, None)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(brute_classes(texts)))

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import pages as G


def test_features(spark):
    rows = [(1, 1, 150, 0.0, 10), (1, 2, 150, 0.01, 9), (1, 3, 300, 0.125, 49), (1, 4, 0, 0.0499, 50)]
    found = G.features(spark.createDataFrame(rows, "doc_id bigint, page int, chars int, img_ratio double, draw_ops int")).orderBy("page").collect()
    assert [list(r.why) for r in found] == [["standalone figure page"], [], ["raster image 12% of page"], ["standalone figure page", "vector drawing (50 ops)"]]
    assert [r.img_ratio for r in found] == [0.0, 0.01, 0.125, 0.05]


def test_consistency(spark):
    rows = [(1, [], [2, 5], 4), (2, [3], [9], 3), (3, [], [], 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, captions array<int>, referenced array<int>, rendered int")
    found = G.consistency(df.drop("rendered"), df.select("doc_id", "rendered")).orderBy("doc_id").collect()
    assert [(r.expected, r.consistent, r.status) for r in found] == [(5, False, 3), (3, True, 0), (0, True, 0)]


def test_scanned_and_text(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, ""), (2, 1, "y" * 200)], "doc_id bigint, page int, text string").withColumn("chars", F.length("text"))
    assert [(r.scanned, r.poor) for r in G.scanned(pages).orderBy("doc_id").collect()] == [(True, True), (False, False)]
    assert G.text_file(pages).where("doc_id = 1").first().text == "\n===== PAGE 1 =====\n\nxxxxxxxxxx\n\n===== PAGE 2 =====\n\n[no text layer]\n"


def test_captions(spark):
    blocks = [(1, 2, 0, 5.0, "text\nFig. 1. second page"), (1, 1, 1, 9.0, "Supplementary Fig. 1. no\nintro\nFig.  1 |  (a) x\n(b) y"), (1, 1, 2, 1.0, "Fig. 2: a\nFig. 3: b"), (1, 1, 3, 0.0, "see Fig. 4.")]
    df = spark.createDataFrame(blocks, "doc_id bigint, page int, block int, y0 double, text string").selectExpr("*", "0D as x0", "1D as x1", "y0 + 1 as y1")
    found = G.captions(df).orderBy("num").collect()
    assert [(r.num, r.page, r.text, list(r.panels)) for r in found] == [(1, 1, "Fig. 1 | (a) x (b) y", ["a", "b"]), (2, 1, "Fig. 2: a Fig. 3: b", [])]


def test_pairing_consumes_captions():
    regions = [(1, 0, 0, 100, 50), (1, 0, 60, 100, 90), (2, 0, 0, 10, 10)]
    captions = [(1, 0, 92, 100, 99), (1, 0, 52, 100, 58), (3, 0, 0, 10, 10)]
    assert G.match_captions(regions, captions) == [1, 0, 2]
    assert G.match_captions(regions, captions[:1]) == [0, None, None]
    assert G.match_captions([], captions) == []


boxes = st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(5, 25), st.integers(5, 25)).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


@settings(max_examples=60, deadline=None)
@given(st.lists(boxes, max_size=12))
def test_clusters_cover_and_keep_apart(art):
    found = G.clusters(art, 3)
    assert all(any(c[0] <= a[0] and c[1] <= a[1] and c[2] >= a[2] and c[3] >= a[3] for c in found) for a in art)
    assert not any(G._meets((a[0] - 3, a[1] - 3, a[2] + 3, a[3] + 3), b) for i, a in enumerate(found) for b in found[i + 1 :])


def test_regions_take_labels_but_no_prose():
    art = [(100, 100, 300, 300)]
    found = G.regions_of(600, 800, art, [((90, 90, 110, 105), "(a)"), ((90, 310, 300, 320), "x" * 41), ((0, 100, 110, 110), "far column")])
    assert found == [(90, 90, 300, 300)]
    assert G.regions_of(600, 800, [(0, 0, 20, 20)], []) == []


def brute_pairs(doc, count):
    """The number that each region of a document of ``count`` lines takes, by trying all captions for every region."""
    regions = [(p, 1 + p % 3, doc * p % 50, p * 10, doc * p % 50 + 60, p * 10 + 30) for p in range(0, count, 2)]
    left = [(p + 1, 1 + (p + doc) % 3, (doc + p) % 40, p * 10 + 31, (doc + p) % 40 + 70, p * 10 + 40) for p in range(0, count, 3)]
    out = {}
    for idx, page, x0, y0, x1, y1 in regions:
        fits = [c for c in left if c[1] == page and min(x1, c[4]) - max(x0, c[2]) > 0.3 * min(x1 - x0, c[4] - c[2])]
        best = min(fits, key=lambda c: (min(abs(c[3] - y1), abs(y0 - c[5])), c[0]), default=None)
        out[idx] = best and best[0]
        left = [c for c in left if c is not best]
    for idx in out:
        if out[idx] is None and left:
            out[idx] = left.pop(0)[0]
    return out


def test_pair_captions_takes_every_line(spark, tmp_path):
    from folioscope.plans import catalog

    counts = {1: 1, 2: 12, 3: 13, 4: 40, 5: 333, 6: 2}
    spark.createDataFrame([(d, "\n".join(["x"] * n)) for d, n in counts.items()], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.pair_captions(spark, str(tmp_path)).collect()
    assert len(rows) == sum((n + 1) // 2 for n in counts.values())
    assert {(r.doc_id, r.idx): r.num for r in rows} == {(d, i): k for d, n in counts.items() for i, k in brute_pairs(d, n).items()}

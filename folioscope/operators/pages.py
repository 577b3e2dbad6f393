"""Pages: feature rules, scanned documents, captions in text blocks, figure regions and their pairing with captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.functions import text as T
from folioscope.session import ship


def features(pages: DataFrame) -> DataFrame:
    """Adds chars, img_ratio (3 digits), why and has_figure to pages (doc_id, page, chars, img_ratio, draw_ops)."""
    ratio, ops = F.col("img_ratio"), F.col("draw_ops")
    alone = (F.col("chars") < P.MIN_TEXT_CHARS) & ((ratio > P.ANY_IMAGE) | (ops >= P.BLANK_OPS))
    why = F.array_compact(
        F.array(
            F.when(alone, F.lit("standalone figure page")),
            F.when(ratio >= P.IMAGE_SHARE, F.concat(F.lit("raster image "), F.bround(ratio * 100).cast("int").cast("string"), F.lit("% of page"))),
            F.when(ops >= P.VECTOR_OPS, F.concat(F.lit("vector drawing ("), ops.cast("string"), F.lit(" ops)"))),
        )
    )
    return pages.withColumn("why", why).withColumn("has_figure", F.size("why") > 0).withColumn("img_ratio", F.round("img_ratio", 3))


def scanned(pages: DataFrame) -> DataFrame:
    """One row per document: pages, all chars, scanned (no page has body text) and poor (OCR found almost nothing)."""
    found = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").cast("bigint").alias("chars"), (F.max("chars") < P.MIN_TEXT_CHARS).alias("scanned"))
    return found.withColumn("poor", F.col("chars") < P.OCR_CHARS_A_PAGE * F.col("pages"))


def rendered(pages: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Pages to render, with the zoom that keeps them within the largest width; ``forced`` (doc_id, pages) replaces the rule."""
    zoom = F.least(F.lit(P.RENDER_DPI) / 72.0, F.lit(float(P.RENDER_WIDTH)) / F.col("width"))
    chosen = pages.where("has_figure") if forced is None else pages.join(forced.select("doc_id", F.explode("pages").alias("page")), ["doc_id", "page"], "left_semi")
    return chosen.withColumn("zoom", zoom)


def consistency(captioned: DataFrame, shown: DataFrame) -> DataFrame:
    """Per document whether as many pages were rendered as the greatest figure number asks for.

    ``captioned`` has doc_id, captions and referenced (arrays); captions count if there are any. ``shown`` has doc_id and
    rendered.
    """
    counted = F.when(F.size("captions") > 0, F.col("captions")).otherwise(F.col("referenced"))
    joined = captioned.join(shown, "doc_id", "left").withColumn("rendered", F.coalesce("rendered", F.lit(0)))
    expected = F.coalesce(F.array_max(counted), F.lit(0))
    return joined.withColumn("expected", expected).withColumn("consistent", (expected == 0) | (F.col("rendered") >= expected)).withColumn("status", F.when(F.col("consistent"), 0).otherwise(3))


def text_file(pages: DataFrame) -> DataFrame:
    """One row per document: the text of its pages with a mark before each."""
    part = F.concat(F.lit("\n===== PAGE "), F.col("page").cast("string"), F.lit(" =====\n\n"), F.when(F.col("text") == "", "[no text layer]").otherwise(F.col("text")), F.lit("\n"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", part.alias("p")))), lambda r: r["p"]), "").alias("text"))


def captions(blocks: DataFrame) -> DataFrame:
    """The captions of text blocks (doc_id, page, block, x0, y0, x1, y1, text), one per figure number and document.

    A block gives one caption at most, from the first of its lines that starts like one and does not start with a
    supplement's word. Its text is the rest of the block. Of equal numbers the first by page and height stays.
    """
    lines = F.transform(T.lines_of(F.col("text")), T.squeeze)
    starts = lambda line: T.caption_number(line).isNotNull() & ~F.rlike(line, F.lit(P.java("SUPPLEMENT_LINE")))
    places = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: starts(F.get("_lines", i)))
    found = blocks.withColumn("_lines", lines).where(F.size("_lines") > 0).withColumn("_at", F.get(places, F.lit(0))).where(F.col("_at").isNotNull())
    rest = T.squeeze(F.array_join(F.slice("_lines", F.col("_at") + 1, F.size("_lines")), " "))
    read = found.withColumn("num", T.caption_number(F.get("_lines", F.col("_at"))))
    first = F.row_number().over(Window.partitionBy("doc_id", "num").orderBy("page", "y0", "block"))
    kept = read.withColumn("_rn", first).where("_rn = 1").withColumn("_rest", rest).withColumn("_panels", T.panel_letters(F.col("_rest")))
    return kept.select("doc_id", "num", "page", "x0", "y0", "x1", "y1", F.substring("_rest", 1, P.CAPTION_CHARS).alias("text"), "_panels.panels", "_panels.panels_from")


def line_offsets(blocks: DataFrame) -> DataFrame:
    """The lines of text blocks (doc_id, block, text) with pos and offset, the place in the block where each starts.

    Every line end counts as one character, whatever it is.
    """
    lines = blocks.select("doc_id", "block", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line"))
    before = Window.partitionBy("doc_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def caption_census(texts: DataFrame) -> DataFrame:
    """The figure numbers that texts (doc_id, text) give before a bar, as captions in some journals do."""
    return texts.select("doc_id", T.figure_numbers(F.col("text"), "CAPTION_BAR").alias("figures"))


def match_captions(regions: list[tuple], found: list[tuple]) -> list[int | None]:
    """For each region (page, x0, y0, x1, y1), in order, the place of its caption in ``found`` (same form), or None.

    A region takes the nearest caption that is left on its page and overlaps it sideways; what remains on both sides is
    paired in order.
    """
    open_ones: dict[int, dict[int, tuple]] = {}
    for k, (p, *box) in enumerate(found):
        open_ones.setdefault(p, {})[k] = box
    taken: list[int | None] = []
    for page, x0, y0, x1, y1 in regions:
        near = []
        for k, (a0, b0, a1, b1) in open_ones.get(page, {}).items():
            shared = min(x1, a1) - max(x0, a0)
            if shared > P.PAIR_OVERLAP * min(x1 - x0, a1 - a0):
                near.append((min(abs(b0 - y1), abs(y0 - b1)), k))
        taken.append(min(near)[1] if near else None)
        open_ones.get(page, {}).pop(taken[-1], None)
    rest = iter(sorted(k for held in open_ones.values() for k in held))
    return [next(rest, None) if k is None else k for k in taken]


def pair_captions(regions: DataFrame, found: DataFrame) -> DataFrame:
    """Regions (doc_id, idx, page, box) with the number of the caption that each takes; one document is one row of lists."""
    ship(regions.sparkSession)
    box = ["x0", "y0", "x1", "y1"]
    item = lambda first, rest: F.struct(*[F.col(c).cast(t).alias(n) for c, t, n in ((first, "int", "k"), ("page", "int", "page"), *((c, "double", c) for c in rest))])
    none = F.lit(None)
    both = regions.select("doc_id", item("idx", box).alias("r"), none.alias("c")).unionByName(found.select("doc_id", none.alias("r"), item("num", ["y0", "x0", "x1", "y1"]).alias("c")))
    gathered = both.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("regions"), F.array_sort(F.collect_list("c")).alias("found"))

    def pair(batches):
        rows = lambda items: [(d["page"], *(d[c] for c in box)) for d in items]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                numbers = [d["k"] for d in r.found]
                out += [(r.doc_id, d["k"], None if k is None else numbers[k]) for d, k in zip(r.regions, match_captions(rows(r.regions), rows(r.found)), strict=True)]
            made = pd.DataFrame(out, columns=["doc_id", "idx", "num"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"), num=made["num"].astype("Int32"))

    return gathered.mapInPandas(pair, "doc_id bigint, idx int, num int")


def _meets(a: tuple, b: tuple) -> bool:
    return max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])


def _around(a: tuple, b: tuple) -> tuple:
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def _area(b: tuple) -> float:
    return abs((b[2] - b[0]) * (b[3] - b[1]))


def clusters(rects: list[tuple], gap: float) -> list[tuple]:
    """Bounding boxes of rectangles that come within ``gap`` of each other's, merged until none do."""
    done: list[tuple] = []
    for rect in rects:
        while True:
            wide = (rect[0] - gap, rect[1] - gap, rect[2] + gap, rect[3] + gap)
            hit = next((k for k, other in enumerate(done) if _meets(wide, other)), None)
            if hit is None:
                break
            rect = _around(rect, done.pop(hit))
        done.append(rect)
    return done


def regions_of(width: float, height: float, art: list[tuple], blocks: list[tuple[tuple, str]], share: float = P.REGION_SHARE, gap: float = P.REGION_GAP, label_chars: int = P.REGION_LABEL_CHARS) -> list[tuple]:
    """Figure regions of one page from the boxes of its artwork, grown by short text that lies mostly within reach."""
    out = []
    for box in clusters(art, gap):
        if _area(box) < share * (abs(width * height) or 1.0):
            continue
        reach = (box[0] - 2 * gap, box[1] - 2 * gap, box[2] + 2 * gap, box[3] + 2 * gap)
        for rect, text in blocks:
            inside = (max(reach[0], rect[0]), max(reach[1], rect[1]), min(reach[2], rect[2]), min(reach[3], rect[3]))
            valid = inside[0] <= inside[2] and inside[1] <= inside[3]
            if len(text.strip()) <= label_chars and valid and _area(inside) >= P.REGION_INSIDE * (_area(rect) or 1.0):
                box = _around(box, rect)
        out.append((max(box[0], 0.0), max(box[1], 0.0), min(box[2], width), min(box[3], height)))
    return sorted(out, key=lambda b: (b[1], b[0]))


def figure_regions(pages: DataFrame, art: DataFrame, blocks: DataFrame) -> DataFrame:
    """Figure regions (doc_id, page, idx, box) of pages (width, height), artwork boxes (ord, source) and text blocks.

    Drawings of 4 points or less in either direction are left out. One page is one group.
    """
    ship(pages.sparkSession)
    box = ["x0", "y0", "x1", "y1"]
    drawn = art.where("source = 'image' or (x1 - x0 > 4 and y1 - y0 > 4)")
    gathered = (
        pages.select("doc_id", "page", "width", "height")
        .join(drawn.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("source") != "image", "ord", *box))).alias("art")), ["doc_id", "page"])
        .join(blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block", *box, "text"))).alias("blocks")), ["doc_id", "page"], "left")
    )

    def find(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                shapes = [(a["x0"], a["y0"], a["x1"], a["y1"]) for a in r.art]
                texts = [((b["x0"], b["y0"], b["x1"], b["y1"]), b["text"] or "") for b in (r.blocks if r.blocks is not None else [])]
                rows += [(r.doc_id, r.page, i, *map(float, found)) for i, found in enumerate(regions_of(r.width, r.height, shapes, texts))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "idx", *box])

    return gathered.mapInPandas(find, "doc_id bigint, page int, idx int, x0 double, y0 double, x1 double, y1 double")

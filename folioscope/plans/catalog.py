"""All queries of the library and their SQL. Arrays are joined to text, so that results compare across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.functions import text as T
from folioscope.operators import boxes as B
from folioscope.operators import capability as C
from folioscope.operators import markdown as M
from folioscope.operators import pages as G
from folioscope.operators import pixels as PX
from folioscope.operators import records as R
from folioscope.plans import fixtures as X
from folioscope.plans.oracles import SQL
from folioscope.session import table
from folioscope.sources.docx import parse_docx


def joined(items: str | Column) -> Column:
    """An array as text."""
    col = F.col(items) if isinstance(items, str) else items
    return F.array_join(col.cast("array<string>"), ",")


def _classified(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return R.classify(X.records(spark, sf_dir, expression))


def figure_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the figures that captions carry, those that the text refers to, and what is missing."""
    found = R.census(_classified(spark, sf_dir, X.MENTIONS)).withColumn("problems", R.problems(F.col("captions"), F.col("referenced")))
    return found.select("doc_id", joined("captions").alias("captions"), joined("referenced").alias("referenced"), joined(F.array_except("referenced", "captions")).alias("missing"), F.when(F.size("problems") > 0, 3).otherwise(0).alias("status"))


def figure_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether enough pages are rendered for its greatest figure number."""
    shown = G.features(X.pages(spark, sf_dir)).groupBy("doc_id").agg(F.count_if("has_figure").alias("rendered"))
    return G.consistency(R.census(_classified(spark, sf_dir, X.MENTIONS)), shown).select("doc_id", "expected", "rendered", "consistent", "status")


def caption_first_per_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption of each figure number, from blocks of three lines."""
    flat = X.lines(spark, sf_dir, X.MENTIONS).withColumn("block", F.floor(F.col("pos") / 3).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n")
    blocks = flat.groupBy("doc_id", "block").agg(text.alias("text")).selectExpr("doc_id", "cast(1 + floor(block / 4) as int) as page", "block", "0.0D as x0", "cast((block * 7) % 11 as double) as y0", "1.0D as x1", "1.0D as y1", "text")
    return G.captions(blocks).select("doc_id", "num", "page", "y0", "text")


def section_skip_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its class and whether it is translated."""
    found = _classified(spark, sf_dir, X.SECTIONS).where("kind <> 'image'")
    return found.select("doc_id", "pos", "class", "translate", "section", "figure")


def heading_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are taken for headings."""
    return X.lines(spark, sf_dir).where(T.looks_like_heading(F.col("line"))).select("doc_id", "pos", "line")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.images(_classified(spark, sf_dir, X.MENTIONS), X.sizes(spark, sf_dir))


def doc_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, figure views and status of every document."""
    found = R.manifest(_classified(spark, sf_dir, X.MENTIONS), _numbered(spark, sf_dir))
    return found.select("doc_id", "records", "images", joined("numbered").alias("numbered"), joined("captions").alias("captions"), joined("referenced").alias("referenced"), "paragraphs", "chars", "skipped", F.array_join("problems", "; ").alias("problems"), "status")


def figure_numbering_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with its figure number."""
    return _numbered(spark, sf_dir).select("doc_id", "pos", "furniture", "figure")


def furniture_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least side of a figure in every document."""
    return R.furniture_floor(X.sizes(spark, sf_dir))


def media_first_seen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file name of every image."""
    return R.media_names(_numbered(spark, sf_dir)).select("doc_id", "pos", "media", "file")


def rendered_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's records as Markdown, by length and digest."""
    made = R.render_markdown(_classified(spark, sf_dir, X.SECTIONS).where("kind <> 'image'"))
    return made.select("doc_id", F.length("markdown").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


def page_figure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rules that make it a figure page."""
    return G.features(X.pages(spark, sf_dir)).select("doc_id", "page", "chars", "img_ratio", "draw_ops", "has_figure", F.array_join("why", "; ").alias("why"))


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a text layer."""
    return G.scanned(X.pages(spark, sf_dir))


def render_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to render, with their zoom."""
    return G.rendered(G.features(X.pages(spark, sf_dir))).select("doc_id", "page", "zoom")


def panel_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels that each document's caption names."""
    found = table(spark, sf_dir, "documents").select("doc_id", T.panel_letters(F.expr(X.PANELS)).alias("p"))
    return found.select("doc_id", joined("p.panels").alias("panels"), "p.panels_from")


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a list per document names."""
    spec = F.expr("(1 + doc_id % 9) || ', ' || (2 + doc_id % 5) || '-' || (1 + doc_id % 11) || ',,7'")
    return table(spark, sf_dir, "documents").select("doc_id", joined(T.page_list(spec, F.lit(8))).alias("pages"))


def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its place relative to fenced blocks."""
    return M.fenced(X.lines(spark, sf_dir, X.MARKDOWN)).select("doc_id", "pos", "fence", "inside")


def heading_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heading with its anchor."""
    return M.headings(X.lines(spark, sf_dir, X.MARKDOWN))


def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of a table of contents."""
    return M.toc_entries(X.lines(spark, sf_dir, X.MARKDOWN), depth=4).select("doc_id", "pos", "level", "title", "anchor", "indent")


def toc_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay when an earlier table of contents goes."""
    return M.strip_toc(X.lines(spark, sf_dir, X.TOC)).select("doc_id", "pos", "line")


def _chunk_docs(spark: SparkSession, sf_dir: str, expression: str = X.CHUNKS) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n\n")
    return X.lines(spark, sf_dir, expression).groupBy("doc_id").agg(text.alias("text"))


def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document."""
    return M.chunks(_chunk_docs(spark, sf_dir))


def figure_chunk_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figure of every chunk that shows one."""
    return M.chunks(_chunk_docs(spark, sf_dir)).select("doc_id", "pos", M.chunk_figure(F.col("chunk")).alias("figure")).where("figure is not null")


def image_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of every document."""
    return _chunk_docs(spark, sf_dir).select("doc_id", M.image_lines(F.col("text")).alias("images"))


def relocate_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its figures placed."""
    found = M.relocate_figures(_chunk_docs(spark, sf_dir, X.RELOCATE))
    told = F.array_join(F.transform("report", lambda r: F.concat(r["figure"].cast("string"), F.lit(": "), F.coalesce(r["after"], F.lit("-")))), "; ")
    return found.select("doc_id", F.length("markdown").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("digest"), F.size("report").alias("figures"), F.size(F.filter("report", lambda r: r["placed"])).alias("placed"), told.alias("report"), "status")


def toc_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a fresh table of contents."""
    return M.insert_toc(X.lines(spark, sf_dir, X.MARKDOWN)).select("doc_id", F.length("markdown").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


def pair_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of every document with their captions."""
    base = X.lines(spark, sf_dir)
    regions = base.where("pos % 2 = 0").selectExpr("doc_id", "cast(pos as int) as idx", "cast(1 + pos % 3 as int) as page", "cast((doc_id * pos) % 50 as double) as x0", "cast(pos * 10 as double) as y0", "cast((doc_id * pos) % 50 + 60 as double) as x1", "cast(pos * 10 + 30 as double) as y1")
    found = base.where("pos % 3 = 0").selectExpr("doc_id", "cast(pos + 1 as int) as num", "cast(1 + (pos + doc_id) % 3 as int) as page", "cast((doc_id + pos) % 40 as double) as x0", "cast(pos * 10 + 31 as double) as y0", "cast((doc_id + pos) % 40 + 70 as double) as x1", "cast(pos * 10 + 40 as double) as y1")
    return G.pair_captions(regions, found)


def figure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure regions of every page."""
    base = X.lines(spark, sf_dir).withColumn("page", F.floor(F.col("pos") / 6).cast("int") + 1)
    pages = base.select("doc_id", "page").distinct().selectExpr("doc_id", "page", "600.0D as width", "800.0D as height")
    art = base.selectExpr("doc_id", "page", "cast(pos as int) as ord", "case when pos % 4 = 0 then 'image' else 'drawing' end as source", "cast((doc_id * 7 + pos * 131) % 480 as double) as x0", "cast((doc_id * 3 + pos * 97) % 600 as double) as y0").selectExpr("*", "x0 + 3 + (ord * 29) % 150 as x1", "y0 + 3 + (ord * 41) % 120 as y1")
    blocks = base.selectExpr("doc_id", "page", "cast(pos as int) as block", "cast((doc_id * 5 + pos * 61) % 520 as double) as x0", "cast((doc_id + pos * 151) % 760 as double) as y0", "line as text").selectExpr("*", "x0 + 40 as x1", "y0 + 12 as y1")
    return G.figure_regions(pages, art, blocks)


def panel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel labels among the texts of every figure."""
    return B.panel_labels(X.panels(spark, sf_dir)[1])


def label_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop that holds each label."""
    crops, texts, _ = X.panels(spark, sf_dir)
    return B.label_hits(crops, B.panel_labels(texts))


def panel_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of every figure that stand above its labels."""
    crops, texts, _ = X.panels(spark, sf_dir)
    return B.furniture(crops, B.panel_labels(texts).where("y0 > 60")).select("fig_id", "name", "furniture")


def segmentation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well crops and labels agree in every figure."""
    crops, texts, _ = X.panels(spark, sf_dir)
    return B.segmentation_score(crops, B.panel_labels(texts))


def best_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of nine gutter widths for every figure."""
    widths = ", ".join(f"{g}D" for g in P.GUTTERS)
    tries = table(spark, sf_dir, "documents").selectExpr("doc_id as fig_id", f"posexplode(array({widths})) as (ord, gutter)").selectExpr("fig_id", "ord", "gutter", "cast((fig_id * 7 + ord * 5) % 9 - 3 as int) as score", "cast(2 + (fig_id + ord) % 4 as int) as panels").withColumn("hit", F.expr("panels = 2 + fig_id % 4"))
    return B.best_gutter(tries)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of every figure in reading order."""
    return B.ordered_panels(X.panels(spark, sf_dir)[0])


def merge_to_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of every figure fused to one less than there are."""
    crops, texts, targets = X.panels(spark, sf_dir)
    return B.merged_panels(crops, B.panel_labels(texts), targets)


def capability_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every machine can do."""
    return C.verdict(X.probes(spark, sf_dir)).select("machine", F.array_join("usable", ",").alias("usable"), "code", F.size("limits").alias("limits"))


def html_heading_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, navigation entries and list items of every page."""
    tags = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return table(spark, sf_dir, "pages").select("page_id", tags("<h1[ >]").alias("titles"), tags("<nav[ >]").alias("navs"), tags("<li[ >]").alias("items"))


def navigation_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a navigation made for it, tidied."""
    found = table(spark, sf_dir, "pages").select("page_id", M.tidy_navigation(F.expr(X.NAVIGATION)).alias("t"))
    return found.select("page_id", F.length("t.html").alias("chars"), F.md5(F.col("t.html").cast("binary")).alias("digest"), F.locate("<nav id=\"TOC\"", F.col("t.html")).alias("at"), "t.kept", "t.dropped")


def stitched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stitched from their fragments."""
    return X.lines(spark, sf_dir, X.BREAKS).select("doc_id", "pos", T.stitched(F.split("line", "(?<=e)", -1)).alias("text"))


def style_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels from styles."""
    found = X.lines(spark, sf_dir).selectExpr("doc_id", "pos", f"{X.STYLE} as style", f"{X.OUTLINE} as outline")
    return found.select("doc_id", "pos", T.style_level(F.col("style"), F.col("outline")).alias("level"))


def panel_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids, layouts and lists of panels, read from arguments."""
    found = table(spark, sf_dir, "documents").select("doc_id", T.grid_of(F.expr(X.GRID)).alias("g"), T.layout_of(F.expr(X.LAYOUT)).alias("l"), T.expected_of(F.expr(X.EXPECT)).alias("e"))
    return found.select("doc_id", "g.rows", "g.cols", joined("l").alias("layout"), joined(F.array_sort("e")).alias("expect"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pages as one text, by length and digest."""
    made = G.text_file(X.lines(spark, sf_dir).selectExpr("doc_id", "cast(pos + 1 as int) as page", "case when pos % 5 = 2 then '' else line end as text"))
    return made.select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with labels and crops of every figure."""
    crops, texts, _ = X.panels(spark, sf_dir)
    return B.label_problems(B.label_hits(crops, B.panel_labels(texts))).select("fig_id", F.array_join("problems", "; ").alias("problems"), "status")


def texts_in_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops that hold each recognised text whole."""
    crops, texts, _ = X.panels(spark, sf_dir)
    inner = texts.select("fig_id", *[F.col(c).alias(f"t_{c}") for c in ("text", "x0", "y0", "x1", "y1")])
    return crops.join(inner, "fig_id").where(B.contains("", "t_")).select("fig_id", "name", F.col("t_text").alias("text"))


def capability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine's probes as lines, by length and digest."""
    made = C.report(X.probes(spark, sf_dir))
    return made.select("machine", F.length("report").alias("chars"), F.md5(F.col("report").cast("binary")).alias("digest"))


def panel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels cut from the pixels of every figure."""
    return PX.split_figures(X.figures(spark, sf_dir)).select("fig_id", "panel", "x0", "y0", "x1", "y1", "method", F.array_join("problems", "; ").alias("problems"), "ink_kept", "status")


def rendered_markdown_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's records as Markdown with anchors of its figures, by length and digest."""
    made = R.render_markdown(_classified(spark, sf_dir, X.MENTIONS), R.media_names(_numbered(spark, sf_dir)))
    return made.select("doc_id", F.length("markdown").alias("chars"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


def readable_media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file name of every image where some cannot be read."""
    numbered = _numbered(spark, sf_dir)
    return R.media_names(numbered, numbered.where("(doc_id + pos) % 5 <> 1")).select("doc_id", "pos", "media", "file")


def caption_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that each document's captions with a bar number."""
    texts = X.lines(spark, sf_dir, X.BARS).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return G.caption_census(texts).select("doc_id", joined("figures").alias("figures"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of each text with its place in the text."""
    return G.line_offsets(table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("block"), F.translate("text", "\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029", "").alias("text"))).select("doc_id", "pos", "offset", F.length("line").alias("chars"))


def forced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a list per document asks for, with their zoom."""
    spec = F.expr("(1 + doc_id % 9) || ', ' || (2 + doc_id % 5) || '-' || (1 + doc_id % 11) || ',,7'")
    wanted = table(spark, sf_dir, "documents").select("doc_id", T.page_list(spec, F.lit(8)).alias("pages"))
    return G.rendered(G.features(X.pages(spark, sf_dir)), wanted).select("doc_id", "page", "zoom")


def strip_toc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the tables of contents that were written into it."""
    texts = X.lines(spark, sf_dir, X.TOC).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("text"))
    found = texts.select("doc_id", M.strip_toc_block(F.col("text")).alias("t"))
    return found.select("doc_id", F.length("t.text").alias("chars"), F.md5(F.col("t.text").cast("binary")).alias("digest"), "t.had")


def recognised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of what a recogniser found in every figure."""
    texts = X.panels(spark, sf_dir)[1]
    polygon = "array(array(x0 + 0.5D, y0 + 0.25D), array(x1 - 1.0D, y0 + 0.0D), array(x1 - 0.5D, y1 - 0.75D), array(x0 + 0.0D, y1 - 1.0D))"
    return B.recognised(texts.selectExpr("fig_id", "' ' || text || '\\t' as text", f"{polygon} as polygon"))


def capability_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every machine cannot do, in words."""
    return C.verdict(X.probes(spark, sf_dir)).select("machine", F.array_join("limits", "; ").alias("limits"))


def capability_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of modules and converter of every machine, the engine that comes first, and a path on its device."""
    there = "filter(array('a', 'b', 'c'), (m, i) -> (c_custkey + i) % 3 <> 0)"
    engines = "filter(array('one', 'two'), (m, i) -> shiftright(c_custkey, i) % 2 = 1)"
    base = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as machine", f"{there} as there", f"{engines} as engines", "c_custkey % 5 <> 0 as windows", "c_custkey % 7 <> 0 as bridge", "concat(char(cast(65 + c_custkey % 26 as int)), ':\\\\a\\\\', c_custkey) as path")
    module, converter = C.module_probe(F.array(F.lit("a"), F.lit("b")), F.col("there")), C.converter_probe(F.col("windows"), F.col("bridge"), F.col("engines"))
    found = base.select("machine", module.alias("m"), converter.alias("c"), C.first_success(*[F.when(F.array_contains("engines", e), F.lit(e)) for e in ("one", "two")]).alias("engine"), C.device_path(F.col("path")).alias("device"))
    return found.select("machine", F.col("m.ok").alias("modules_ok"), joined("m.missing").alias("missing"), F.col("c.ok").alias("converter_ok"), F.col("c.detail").alias("detail"), "engine", "device")


def word_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read from every document as a Word file."""
    return parse_docx(X.word_files(spark, sf_dir)).select(F.col("path").alias("doc_id"), "pos", "kind", "text", "level", "media", "error")


_QUERIES = (
    figure_census, figure_consistency, caption_first_per_number, section_skip_latch, heading_guess, doc_manifest, figure_numbering_zip,
    furniture_upper_median, media_first_seen_names, rendered_markdown, page_figure_rules, scanned_documents, render_zoom, panel_letters,
    page_ranges, fence_parity, heading_slugs, toc_entries, toc_strip, toc_insert, chunk_split, figure_chunk_number, image_conservation,
    relocate_figures, pair_captions, figure_regions, panel_labels, label_in_box, panel_furniture, segmentation_score, best_gutter,
    stitched_text, style_levels, panel_specs, page_text, label_problems, texts_in_crops, capability_report, panel_split,
    reading_order, merge_to_count, capability_verdict, html_heading_census, navigation_tidy, rendered_markdown_figures, readable_media_names,
    caption_census, line_offsets, forced_pages, strip_toc_blocks, recognised_texts, capability_limits, capability_probes, word_records,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

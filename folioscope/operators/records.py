"""Records of documents: classification, figure numbering, media names, reconciliation and rendering.

Records are rows (doc_id, pos, kind, text, level, media) with kind text, heading or image. One document's records are
ordered by pos; every window is over one document, so work spreads with the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.functions import text as T


def _ordered() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


def classify(records: DataFrame) -> DataFrame:
    """Adds class (image, heading, caption, text), translate, section, figure and depth (a heading's level, from 1).

    From the first record that opens a skipped section on, everything but captions and further such openings is text that
    is not translated, to the end of the document. Where no record is a styled heading, headings are guessed.
    """
    written = F.col("kind") != "image"
    opens = written & T.opens_skipped_section(F.col("text"))
    marked = records.withColumn("_opens", opens).withColumn("_caption", F.when(written & ~opens, T.caption_number(F.col("text"))))
    latched = F.coalesce(F.max("_opens").over(_ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    styled = F.max(F.col("kind") == "heading").over(Window.partitionBy("doc_id"))
    marked = marked.withColumn("_latched", latched & written & ~F.col("_opens") & F.col("_caption").isNull()).withColumn("_styled", styled)
    heading = F.when(F.col("_styled"), F.col("kind") == "heading").otherwise(T.looks_like_heading(F.col("text")))
    kind = (
        F.when(~written, "image")
        .when(F.col("_opens"), "heading")
        .when(F.col("_caption").isNotNull(), "caption")
        .when(F.col("_latched"), "text")
        .when(heading, "heading")
        .otherwise("text")
    )
    skipped = F.col("_opens") | F.col("_latched")
    plain = written & F.col("_caption").isNull() & ~F.col("_latched")
    return (
        marked.withColumn("class", kind)
        .withColumn("translate", F.when(written, ~skipped))
        .withColumn("section", F.when(skipped, "skip"))
        .withColumn("figure", F.col("_caption"))
        .withColumn("depth", F.when(plain, F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(1))))
        .drop("_opens", "_caption", "_latched", "_styled")
    )


def _figures() -> list[Column]:
    """Aggregates of one document's records: caption numbers, and its whole text in order."""
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text"))))
    return [
        F.array_sort(F.collect_set(F.when(F.col("class") == "caption", F.col("figure")))).alias("captions"),
        F.array_join(F.transform(texts, lambda r: r["text"]), " ").alias("_text"),
    ]


def census(records: DataFrame) -> DataFrame:
    """Per document the numbers that captions carry and those that the text refers to (arrays)."""
    return records.groupBy("doc_id").agg(*_figures()).select("doc_id", "captions", T.figure_numbers(F.col("_text")).alias("referenced"))


def furniture_floor(sizes: DataFrame) -> DataFrame:
    """Per document the least long side of an image that can be a figure, from sizes (doc_id, media, width, height)."""
    sides = sizes.groupBy("doc_id", "media").agg(F.max(F.greatest("width", "height")).cast("bigint").alias("side")).where("side > 0")
    middle = F.expr("percentile_disc(0.5) within group (order by side desc)")
    return sides.groupBy("doc_id").agg(F.greatest(F.lit(P.FURNITURE_FLOOR).cast("bigint"), F.floor(F.lit(P.FURNITURE_SHARE) * middle).cast("bigint")).alias("floor"))


def images(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """The image records with side, furniture and, by position among figures, the figure's number.

    Numbers are the captions', or those the text cites if only these are as many as the figures.
    """
    sides = sizes.groupBy("doc_id", "media").agg(F.max(F.greatest("width", "height")).cast("bigint").alias("side"))
    placed = (
        records.where(F.col("kind") == "image")
        .select("doc_id", "pos", "media")
        .join(sides, ["doc_id", "media"], "left")
        .join(furniture_floor(sizes), "doc_id", "left")
        .withColumn("side", F.coalesce("side", F.lit(0)))
        .withColumn("furniture", F.col("side") < F.coalesce("floor", F.lit(0)))
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "furniture").orderBy("pos"))
    many = F.sum(F.when(~F.col("furniture"), 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    numbers = F.when(F.size("captions") == F.col("_many"), F.col("captions")).when(F.size("referenced") == F.col("_many"), F.col("referenced")).otherwise(F.col("captions"))
    counted = placed.withColumn("_place", place).withColumn("_many", many).join(census(records), "doc_id", "left")
    return counted.withColumn("figure", F.when(~F.col("furniture"), F.get(numbers, F.col("_place") - 1))).select("doc_id", "pos", "media", "side", "furniture", "figure")


def media_names(numbered: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """Adds the file that each image is saved to; an image that occurs again has the file of its first occurrence.

    One counter runs over the first occurrences of a document. Where two would share a name, later ones get a suffix. With
    ``readable`` (doc_id, media) an image that is not among them has no file, and each of its occurrences is counted.
    """
    first = F.first("pos").over(Window.partitionBy("doc_id", "media").orderBy("pos"))
    own = numbered.withColumn("_first", first).withColumn("_ok", F.lit(True))
    if readable is not None:
        known = readable.select("doc_id", "media").distinct().withColumn("_there", F.lit(True))
        own = own.join(known, ["doc_id", "media"], "left").withColumn("_ok", F.coalesce("_there", F.lit(False))).drop("_there")
    firsts = own.where("pos = _first or not _ok").withColumn("_seq", F.row_number().over(_ordered())).where("_ok")
    ending = F.when(F.rlike("media", F.lit(r"[^/.][^/]*\.[^./]*\z")), F.concat(F.lit("."), F.regexp_extract("media", r"\.([^./]*)\z", 1))).otherwise(F.lit(".png"))
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    stem = F.when(F.col("furniture"), F.concat(F.lit("logo"), two(F.col("_seq")))).when(F.col("figure").isNotNull(), F.concat(F.lit("fig"), two(F.col("figure")))).otherwise(F.concat(F.lit("img"), two(F.col("_seq"))))
    named = firsts.withColumn("_stem", stem).withColumn("_end", ending)
    again = F.row_number().over(Window.partitionBy("doc_id", "_stem", "_end").orderBy("pos"))
    named = named.withColumn("file", F.concat(F.lit("media/"), "_stem", F.when(again > 1, F.concat(F.lit("_"), (F.col("_seq") + 1).cast("string"))).otherwise(F.lit("")), "_end"))
    return own.join(named.select("doc_id", F.col("pos").alias("_first"), "file"), ["doc_id", "_first"], "left").drop("_first", "_ok")


def manifest(records: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row per document: counts, the three views of its figures, status (0 or 3) and problems."""
    body = F.col("class").isin("text", "heading") & F.col("translate")
    counts = records.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if(body).alias("paragraphs"),
        F.coalesce(F.sum(F.when(body, F.length("text"))), F.lit(0)).cast("bigint").alias("chars"),
        F.count_if(~F.col("translate")).alias("skipped"),
        *_figures(),
    )
    counts = counts.withColumn("referenced", T.figure_numbers(F.col("_text"))).drop("_text")
    shown = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_set("figure")).alias("numbered"))
    joined = counts.join(shown, "doc_id", "left").withColumn("numbered", F.coalesce("numbered", F.array().cast("array<int>")))
    return joined.withColumn("problems", problems(F.col("captions"), F.col("referenced"), F.col("numbered"))).withColumn("status", F.when(F.size("problems") > 0, 3).otherwise(0))


def _listed(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]"))


def problems(captions: Column, referenced: Column, numbered: Column | None = None) -> Column:
    """What does not agree between captions, images (if given) and mentions."""
    found = [F.when(F.size(captions) == 0, F.lit("no caption was found"))]
    if numbered is not None:
        lost = F.size(F.array_except(captions, numbered)) > 0
        found.append(F.when(lost, F.concat(F.lit("captions name "), _listed(captions), F.lit(" but images are numbered "), _listed(numbered))))
    missing = F.array_except(referenced, captions)
    found.append(F.when(F.size(missing) > 0, F.concat(F.lit("the text refers to "), _listed(missing), F.lit(" without a caption"))))
    return F.array_compact(F.array(*found))


def render_markdown(records: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """One row per document: its records as Markdown with anchors where figures stand; furniture is left out."""
    shown = records.withColumn("_furniture", F.lit(False)).withColumn("_file", F.col("media")).withColumn("_figure", F.lit(None).cast("int"))
    if named is not None:
        keep = named.select("doc_id", "pos", F.col("furniture").alias("_furniture"), F.col("file").alias("_file"), F.col("figure").alias("_figure"))
        shown = records.join(keep, ["doc_id", "pos"], "left")
    anchor = F.concat(F.lit("[[FIG "), F.coalesce(F.col("_figure").cast("string"), F.lit("?")), F.lit(" -> "), F.coalesce("_file", "media"), F.lit("]]"))
    mark = F.when(F.col("translate"), F.lit("")).otherwise(F.lit(P.UNTRANSLATED))
    line = (
        F.when(F.col("class") == "image", F.when(~F.coalesce("_furniture", F.lit(False)), anchor))
        .when(F.col("class") == "caption", F.concat(F.lit("**CAPTION Fig "), F.col("figure").cast("string"), F.lit("** "), "text"))
        .when(F.col("class") == "heading", F.concat(F.expr("repeat('#', least(6, depth + 1))"), F.lit(" "), "text", mark))
        .otherwise(F.concat("text", mark))
    )
    rows = F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("pos", "_line"))))
    return shown.withColumn("_line", line).groupBy("doc_id").agg(F.concat(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n\n"), F.lit("\n")).alias("markdown"))

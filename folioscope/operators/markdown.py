"""Markdown: chunks and figure placement, headings and tables of contents, and HTML navigation.

Line and chunk tables hold one document's lines or chunks under doc_id in order of pos.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import patterns as P
from folioscope.functions import text as T
from folioscope.session import ship


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blank-line separated chunks (doc_id, pos, chunk), empty ones included."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), r"(?U)\n[\s\x1c-\x1f]*\n", -1)
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "chunk"))


def chunk_figure(chunk: Column) -> Column:
    """The figure that an image chunk shows: from its caption, else from its file's name; null for other chunks."""
    bare = T.strip(chunk)
    caption = F.regexp_extract(F.regexp_extract(bare, P.java("IMAGE_CHUNK"), 1), P.java("FIGURE_IN_CAPTION"), 1)
    file = F.regexp_extract(F.regexp_extract(F.regexp_extract(bare, P.java("IMAGE_CHUNK"), 2), r"([^/]*)\z", 1), P.java("FIGURE_IN_PATH"), 1)
    return F.when(F.rlike(bare, F.lit(P.java("IMAGE_CHUNK"))), F.coalesce(T.number(F.nullif(caption, F.lit(""))), T.number(F.nullif(file, F.lit("")))))


def image_lines(text: Column) -> Column:
    """Number of lines that begin an image."""
    return F.regexp_count(text, F.lit(r"(?md)^!\["))


# --- relocation: what a figure's place depends on is the order of the others, so one document is folded at a time --

_IMAGE = re.compile(P.IMAGE_CHUNK, re.S)
_HEADING = re.compile(P.HEADING_CHUNK)
_FENCED = re.compile(P.FENCED_CHUNK, re.S)
_SUPPLEMENT = re.compile(P.SUPPLEMENT_BEFORE, re.I)
_IN_CAPTION = re.compile(P.FIGURE_IN_CAPTION)
_IN_PATH = re.compile(P.FIGURE_IN_PATH, re.I)
_EMPTY_HEADING = re.compile(P.EMPTY_FIGURE_HEADING)


def _shown(chunk: str) -> int | None:
    image = _IMAGE.match(chunk.strip())
    if image is None:
        return None
    named = _IN_CAPTION.search(image[1]) or _IN_PATH.search(image[2].rsplit("/", 1)[-1])
    return int(named[1]) if named else None


def relocate(text: str) -> tuple[str, list[dict]]:
    """A document with each figure after the paragraph that first mentions it, and what became of each figure.

    Figures are placed in the order of their numbers and a paragraph hosts one at most. Fenced chunks that follow the
    paragraph stay with it. Figures that no paragraph is left for come at the end under a heading of their own.
    """
    body: list[str] = []
    figures: dict[int, list[str]] = {}
    open_number = None  # of the figure whose images stand directly before
    for chunk in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        number = _shown(chunk)
        if number is None:
            body.append(chunk)
        else:
            held = figures.setdefault(number, [])
            if number != open_number and body and _HEADING.match(body[-1].strip()):
                titled = _IN_CAPTION.search(body[-1])
                if titled and int(titled[1]) == number:
                    held.append(body.pop())
            held.append(chunk)
        open_number = number
    body = [c for c in body if not _EMPTY_HEADING.match(c.strip())]

    hosts = {i: c.strip() for i, c in enumerate(body) if c.strip() and not _HEADING.match(c.strip()) and not _IMAGE.match(c.strip())}
    after: dict[int, list[int]] = {}
    report = []
    for number in sorted(figures):
        mention = re.compile(P.FIGURE_MENTION.format(n=number))
        host = next((i for i, c in hosts.items() if any(not _SUPPLEMENT.search(c[max(0, m.start() - P.LOOK_BACK) : m.start()]) for m in mention.finditer(c))), None)
        if host is not None:
            del hosts[host]
            end = host
            while end + 1 < len(body) and _FENCED.match(body[end + 1].strip()):
                end += 1
            after.setdefault(end, []).append(number)
        report.append({"figure": number, "placed": host is not None, "after": None if host is None else " ".join(body[host].split())[: P.AFTER_CHARS]})

    out = []
    for i, chunk in enumerate(body):
        out += [chunk, *(c for n in after.get(i, []) for c in figures[n])]
    homeless = [r["figure"] for r in report if not r["placed"]]
    if homeless:
        out += [P.ORPHAN_HEADING, *(c for n in homeless for c in figures[n])]
    return "\n\n".join(c.strip("\n") for c in out if c.strip()) + "\n", report


def relocate_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: markdown with figures placed, report (figure, placed, after), status and problems.

    Status is 3 where the number of images would change; the document is then returned as it was.
    """
    ship(docs.sparkSession)
    kinds = "array<struct<figure:int,placed:boolean,after:string>>"

    def place(batches):
        count = lambda t: len(re.findall(r"^!\[", t, re.M))
        for pdf in batches:
            rows = []
            for doc_id, source in zip(pdf["doc_id"], pdf[text], strict=True):
                source = source or ""
                made, report = relocate(source)
                same = count(made) == count(source)
                problems = [] if same else [f"{count(source)} images before and {count(made)} after"]
                rows.append((doc_id, made if same else source, report, 0 if same else 3, problems))
            yield pd.DataFrame(rows, columns=["doc_id", "markdown", "report", "status", "problems"])

    return docs.select("doc_id", text).mapInPandas(place, f"doc_id bigint, markdown string, report {kinds}, status int, problems array<string>")


# --- tables of contents ---------------------------------------------------------------------------------------------


def fenced(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds fence (the line opens or closes a fenced block) and inside (it stands in one)."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("fence", F.rlike(line, F.lit(P.java("FENCE_LINE"))))
    return marked.withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)


def headings(lines: DataFrame, line: str = "line") -> DataFrame:
    """All headings outside fenced blocks: doc_id, pos, level, title and anchor.

    Repeats of an anchor are numbered over all headings, whether or not they reach a table of contents.
    """
    found = fenced(lines, line).where(~F.col("fence") & ~F.col("inside")).where(F.rlike(line, F.lit(P.java("ATX_HEADING"))))
    read = found.select("doc_id", "pos", F.length(F.regexp_extract(line, P.java("ATX_HEADING"), 1)).alias("level"), T.strip(F.regexp_extract(line, P.java("ATX_HEADING"), 2)).alias("title"))
    based = read.withColumn("_base", T.slug_base(F.col("title")))
    again = F.row_number().over(Window.partitionBy("doc_id", "_base").orderBy("pos")) - 1
    return based.withColumn("anchor", F.concat("_base", F.when(again > 0, F.concat(F.lit("-"), again.cast("string"))).otherwise(F.lit("")))).drop("_base")


def toc_entries(lines: DataFrame, depth: int = 3, include_figures: bool = False, line: str = "line") -> DataFrame:
    """The headings that a table of contents lists, with indent (steps below the shallowest one listed)."""
    kept = headings(lines, line).where(F.col("level").between(2, depth) & (F.col("title") != P.TOC_TITLE))
    if not include_figures:
        kept = kept.where(~F.rlike("title", F.lit(P.java("FIGURE_HEADING"))))
    return kept.withColumn("indent", F.col("level") - F.min("level").over(Window.partitionBy("doc_id")))


def strip_toc(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines without the first table of contents written earlier and one blank line after it."""
    whole = Window.partitionBy("doc_id")
    begin = F.min(F.when(F.col(line) == P.TOC_BEGIN, F.col("pos"))).over(whole)
    marked = lines.withColumn("_begin", begin)
    end = F.min(F.when((F.col(line) == P.TOC_END) & (F.col("pos") >= F.col("_begin")), F.col("pos"))).over(whole)
    marked = marked.withColumn("_end", end)
    blank = (F.col("pos") == F.col("_end") + 1) & (T.strip(F.col(line)) == "")
    drop = F.col("_end").isNotNull() & (F.col("pos").between(F.col("_begin"), F.col("_end")) | blank)
    return marked.where(~drop).drop("_begin", "_end")


def insert_toc(lines: DataFrame, depth: int = 3, include_figures: bool = False, line: str = "line") -> DataFrame:
    """One row per document: markdown with a fresh table of contents before its first section; none without entries."""
    base = strip_toc(lines, line).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("pos"), line)
    entry = F.concat(F.expr("repeat('  ', indent)"), F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda r: r["e"])
    block = toc_entries(base, depth, include_figures, line).groupBy("doc_id").agg(F.concat(F.array(F.lit(P.TOC_BEGIN), F.lit(f"## {P.TOC_TITLE}"), F.lit("")), listed, F.array(F.lit(""), F.lit(P.TOC_END))).alias("block"))
    first = headings(base, line).where(F.col("level") >= 2).groupBy("doc_id").agg(F.min("pos").alias("at"))
    whole = base.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line))), lambda r: r[line]).alias("all"))
    joined = whole.join(block, "doc_id", "left").join(first, "doc_id", "left")
    blank = F.array(F.lit(""))
    made = (
        F.when(F.col("block").isNull(), F.col("all"))
        .when(F.col("at").isNull(), F.concat("all", blank, "block"))
        .otherwise(F.concat(F.slice("all", F.lit(1), F.col("at") - 1), F.col("block"), blank, F.slice("all", F.col("at"), F.size("all"))))
    )
    return joined.select("doc_id", F.concat(F.regexp_replace(F.array_join(made, "\n"), r"\n+\z", ""), F.lit("\n")).alias("markdown"))


# --- HTML -------------------------------------------------------------------------------------------------------------


def strip_toc_block(text: Column) -> Column:
    """A struct of the text without tables of contents, and whether there was one."""
    pattern = f"(?smd){P.TOC_BLOCK}"
    return F.struct(F.regexp_replace(text, pattern, "").alias("text"), F.rlike(text, F.lit(pattern)).alias("had"))


def tidy_navigation(html: Column) -> Column:
    """A struct of HTML whose navigation has lost its figure entries and stands before the first section, with counts."""
    nav = F.regexp_extract(html, f"(?sd)({P.TOC_NAV})", 1)
    none = nav == ""
    entry = f"(?iUd){P.TOC_FIGURE_ENTRY}"
    clean = F.regexp_replace(F.regexp_replace(nav, entry, ""), r"(?U)<ul>\s*</ul>", "")
    start = F.locate('<nav id="TOC"', html) - 1
    rest = F.concat(F.substr(html, F.lit(1), start), F.substr(html, start + F.length(nav) + 1))
    section = F.regexp_instr(rest, F.lit("<h2[ >]")) - 1
    title = F.locate("</h1>", rest) - 1
    at = F.when(section >= 0, section).when(title >= 0, title + F.length(F.lit("</h1>"))).otherwise(start)
    placed = F.concat(F.substr(rest, F.lit(1), at), clean, F.substr(rest, at + 1))
    return F.struct(
        F.when(none, html).otherwise(placed).alias("html"),
        F.when(none, 0).otherwise(F.regexp_count(clean, F.lit('<li><a href="#'))).alias("kept"),
        F.when(none, 0).otherwise(F.regexp_count(nav, F.lit(entry))).alias("dropped"),
    )

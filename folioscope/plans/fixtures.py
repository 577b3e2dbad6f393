"""Paper-like tables made from the driver's documents by plain SQL, which the oracles use word for word.

The driver's texts hold no figure mentions, headings or fences, so each query first writes some into the lines. The
expressions are functions of doc_id, pos and line only.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import table

MENTIONS = """case when pos%4=1 then 'Fig. '||(1+(doc_id+pos)%6)||'. '||line
     when pos%3=2 then line||' (Fig. '||(1+(doc_id*7+pos)%8)||')'
     when pos%5=3 then line||' Supplementary Fig. 17'
     else line end"""
SECTIONS = """case when pos%6=5 then 'References '||line
     when pos%4=2 then 'Fig. '||(1+pos%5)||'. '||line
     else line end"""
MARKDOWN = """case when pos%5=0 then '## Part '||(pos%3)||'!'
     when pos%7=3 then '```'
     when pos%11=6 then '### Fig. '||(1+pos%4)||' x'
     when pos%13=4 then '#### [Deep *part*](x.md) '||(pos%2)
     else line end"""
TOC = """case when pos=2+doc_id%3 then '<!-- TOC -->' when pos=5+doc_id%4 then '<!-- /TOC -->' when pos=6+doc_id%4 then '' else line end"""
PANELS = """case doc_id%11 when 7 then 'a Map of x b Plot of y c View' when 8 then 'a-c Views of x d Detail' when 9 then 'a Only one b Two' when 10 then 'Xa Map a, b Z c View' else case doc_id%7 when 0 then '(a) x (b, c) y (d-f) z' when 1 then '(a1-a2) (b1) of it' when 2 then '(b) only and (c)'
     when 3 then '(a), (b) and (c-e), also (g)' when 4 then '(a&b) with (f-d)' when 5 then '(a)(a)(b)' else 'none' end end"""
CHUNKS = """case when pos%9=2 then '![图 '||(1+pos%5)||' x](media/fig0'||(1+pos%5)||'.png)'
     when pos%9=5 then '![plain](a/figure_'||(1+pos%7)||'b.png)'
     when pos%9=7 then '![plain](a/b.png)'
     when pos%4=1 then ''
     else line end"""
RELOCATE = """case (pos+doc_id)%11 when 1 then '### 图 '||(1+(pos+1+doc_id)%(6+doc_id%2))||' title'
     when 2 then '![图 '||(1+(pos+doc_id)%6)||' x](media/a.png)'
     when 3 then case when doc_id%2=0 then '![图 '||(1+(pos-1+doc_id)%6)||' y](media/b.png)' else line end
     when 5 then '见图 '||(1+(pos+doc_id)%6)||' 与 Fig. '||(1+pos%6)||' '||line
     when 6 then '``` code '||pos||' ```'
     when 7 then case when doc_id%3=0 then '~~~ x ~~~' else '## 图' end
     when 8 then '补充图 '||(1+pos%6)||' and Figure '||(1+(pos*5)%7)||' '||line
     when 9 then '![plain](x/figure_'||(1+(pos*doc_id)%7)||'.png)'
     else line end"""
NAVIGATION = """'<nav id="TOC"><ul><li><a href="#a" id="toc-a">Part</a></li><li><a href="#f" id="toc-f">Fig. ' || (page_id % 5) || ' x</a></li></ul></nav>' || html || case when page_id % 2 = 0 then '<h2 id="a">Part</h2>' else '' end"""
BARS = """case when pos%3=0 then 'Fig. '||(1+(doc_id+pos)%33)||' | '||line when pos%5=1 then 'see Figure '||(1+pos%9)||'| and Fig '||(1+pos%4)||': no bar'
     when pos%7=2 then 'Supplementary Fig. 3 | '||line||' Extended Data Figure 4 |' else line end"""
BREAKS = "replace(replace(line, 'tion ', 'tion- '), 'er ', 'e­r  ')"
STYLE = "case pos%7 when 0 then 'Heading '||(1+pos%9) when 1 then 'heading3' when 2 then 'Title' when 3 then 'Heading 12' when 4 then 'Body' end"
OUTLINE = "case pos%3 when 0 then cast(pos%11 as string) when 1 then 'x' end"
GRID = "case doc_id%5 when 0 then (1+doc_id%4)||'x'||(2+doc_id%3) when 1 then ' 3 * 12 ' when 2 then '4 by 3' when 3 then '2X'||(doc_id%7) else '' end"
LAYOUT = "case doc_id%5 when 0 then (1+doc_id%4)||','||(2+doc_id%3)||'+1' when 1 then ' 3 2' when 2 then '4,x' when 3 then '2,0' else '' end"
EXPECT = "case doc_id%5 when 0 then 'a-'||char(cast(97+doc_id%6 as int)) when 1 then 'A, b,a' when 2 then 'a1 a2+b' when 3 then 'd-b,c' else '' end"
WIDTH = "cast(150+((doc_id*37+pos*53)%9)*120 as bigint)"
HEIGHT = "cast(100+((doc_id*11+pos*29)%7)*150 as bigint)"
RATIO = "cast((doc_id*13+pos*7)%40 as double)/400"
OPS = "cast((doc_id*5+pos*17)%90 as int)"

#: The lines of all documents, for DuckDB.
LINES = """(select doc_id, cast(i - 1 as bigint) as pos, a[i] as line
  from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from (select doc_id, string_split(text, chr(10)) as a from documents)))"""


def lines(spark: SparkSession, sf_dir: str, expression: str = "line") -> DataFrame:
    """doc_id, pos and line of all documents, the line changed by an expression."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.select("doc_id", "pos", F.expr(expression).alias("line"))


def records(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """Records of text, with an image before each third line."""
    found = lines(spark, sf_dir, expression)
    text = found.selectExpr("doc_id", "cast(pos * 2 + 1 as int) as pos", "'text' as kind", "line as text", "0 as level", "cast(null as string) as media")
    image = found.where("pos % 3 = 0").selectExpr("doc_id", "cast(pos * 2 as int) as pos", "'image' as kind", "cast(null as string) as text", "0 as level", "'word/media/image' || pos || '.png' as media")
    return text.unionByName(image)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the images that records() places."""
    return lines(spark, sf_dir).where("pos % 3 = 0").selectExpr("doc_id", "'word/media/image' || pos || '.png' as media", f"{WIDTH} as width", f"{HEIGHT} as height")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per line."""
    return lines(spark, sf_dir).selectExpr("doc_id", "cast(pos + 1 as int) as page", "length(line) as chars", f"{RATIO} as img_ratio", f"{OPS} as draw_ops", "cast(400 + (doc_id * 3 + pos) % 300 as double) as width")


def panels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crops, recognised texts and targets of one figure per document: a grid of crops with labels, some astray."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as fig_id", "2 + cast(doc_id % 2 as int) as rows", "2 + cast(doc_id % 3 as int) as cols")
    cells = docs.withColumn("k", F.explode(F.expr("sequence(0, rows * cols - 1)")))
    crops = cells.selectExpr("fig_id", "k as ord", "char(97 + k) as name", *[f"cast({e} as int) as {c}" for c, e in CROP.items()])
    texts = cells.selectExpr("fig_id", f"{LABEL} as text", *[f"cast({e} as int) as {c}" for c, e in LABEL_BOX.items()])
    return crops, texts, docs.withColumn("doc_id", F.col("fig_id")).selectExpr("fig_id", f"cast({TARGET} as int) as target")


#: Crops stand askew, so that some reach into the row below and rows are not plain.
CROP = {"x0": "(k % cols) * 100 + (fig_id * k) % 9", "y0": "floor(k / cols) * 80 + 10 + (fig_id * (k + 1)) % 7 * 5", "x1": "(k % cols) * 100 + 90", "y1": "floor(k / cols) * 80 + 80 + (fig_id * (k + 2)) % 5 * 14"}
TARGET = "greatest(1, rows * cols - 1 - doc_id % 4)"
LABEL = "case when (fig_id + k) % 7 = 3 then 'axis' when fig_id % 3 = 0 then '(' || char(97 + k) || ')' when (fig_id + k) % 11 = 5 then 'R2' else char(97 + k) end"
LABEL_BOX = {
    "x0": "(k % cols) * 100 + case when (fig_id * 5 + k) % 13 = 0 then 100 else 3 end",
    "y0": "floor(k / cols) * 80 + 12",
    "x1": "(k % cols) * 100 + case when (fig_id * 5 + k) % 13 = 0 then 110 else 13 end",
    "y1": "floor(k / cols) * 80 + 22 + (fig_id + k) % 4",
}


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight probes per customer as a machine."""
    keys = ", ".join(f"'{k}'" for k in ("pymupdf", "lxml", "imaging", "converter", "ocr", "vision", "pandoc", "browser"))
    spread = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as machine", "c_custkey", f"posexplode(array({keys})) as (k, key)")
    return spread.selectExpr("machine", "key", "key as label", f"{PROBE} as ok", "'d' as detail", "'f' as fix")


PROBE = "(c_custkey * (k + 3) + k) % 5 not in (0, 2)"


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Word file (path, content): a paragraph per line, some with a style, a picture, a fallback or a break."""
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def block(pos: int, line: str) -> str:
        cut = len(line) // 2
        runs = "".join(f"<w:r><w:t>{escape(part)}</w:t></w:r>" for part in (line[:cut], line[cut:]))
        runs += "<w:r><w:br/><w:t>co\u00adda</w:t></w:r>" if pos % 4 == 1 else ""
        runs += "<mc:AlternateContent><mc:Fallback><w:t>twice</w:t></mc:Fallback></mc:AlternateContent>" if pos % 4 == 2 else ""
        runs += f'<a:blip r:embed="r{pos % 3}"/>' if pos % 4 == 3 else ""
        if pos % 6 == 5:
            return f"<w:tbl><w:tr><w:tc><w:p>{runs}</w:p></w:tc></w:tr></w:tbl>"
        style = f'<w:pPr><w:pStyle w:val="Heading{1 + pos % 3}"/></w:pPr>' if pos % 5 == 0 else ""
        return f"<w:p>{style}{runs}</w:p>"

    def pack(batches):
        rels = "".join(f'<Relationship Id="r{k}" Target="media/image{k}.png"/>' for k in range(3))
        for pdf in batches:
            files = []
            for text in pdf["text"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    lines = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text or "").split("\n")
                    z.writestr("word/document.xml", f"<w:document {names}><w:body>{''.join(block(i, x) for i, x in enumerate(lines))}</w:body></w:document>")
                    z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
                files.append(held.getvalue())
            yield pd.DataFrame({"path": pdf["path"], "content": files})

    texts = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as path", "text")
    return texts.repartition(spark.sparkContext.defaultParallelism).mapInPandas(pack, "path string, content binary")


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One picture per document: dark panels in two rows on a light ground, with the texts that name them.

    A quarter each comes with a layout, with the caption's names, with neither, and with a grid. Some of those without layout
    or grid have a bar above the panels, a text above the first label, or a caption that names a panel too many.
    """

    def draw(batches):
        for pdf in batches:
            rows = []
            for fig in pdf["fig_id"].tolist():
                cols, mode, kind = 2 + fig % 2, fig % 4, fig // 4 % 4
                picture = np.full((90, 40 * cols + 10, 3), 245, np.uint8)
                if mode in (1, 2) and kind == 1:
                    picture[1:4, 12:60] = 60
                ocr, names = [], [chr(97 + k) for k in range(2 * cols)]
                for k, name in enumerate(names):
                    x, y = 10 + 40 * (k % cols), 10 + 40 * (k // cols)
                    picture[y : y + 28, x : x + 26] = 20 + fig % 50
                    low = 2 * (mode in (1, 2) and kind == 2 and not k)
                    ocr += [{"text": "y", "x0": x, "y0": y, "x1": x + 6, "y1": y + 6}] * bool(low)
                    ocr.append({"text": f"({name})", "x0": x, "y0": y + low, "x1": x + 6, "y1": y + low + 6})
                expect = names + ["z"] * (kind == 3) if mode == 1 else None
                rows.append((fig, *picture.shape, picture[:, :, ::-1].tobytes(), ocr, [cols, cols] if mode == 0 else None, expect, [2, cols] if mode == 3 else None))
            yield pd.DataFrame(rows, columns=["fig_id", "height", "width", "nChannels", "data", "ocr", "layout", "expect", "grid"])

    ids = table(spark, sf_dir, "documents").selectExpr("doc_id as fig_id")
    return ids.repartition(spark.sparkContext.defaultParallelism).mapInPandas(draw, "fig_id bigint, height int, width int, nChannels int, data binary, ocr array<struct<text:string,x0:int,y0:int,x1:int,y1:int>>, layout array<int>, expect array<string>, grid array<int>")

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import markdown as M


def test_supplementary_mentions_do_not_count():
    made, report = M.relocate("见补充图 2 的说明\n\n正文图 2 在此\n\n![图 2 x](a.png)")
    assert made == "见补充图 2 的说明\n\n正文图 2 在此\n\n![图 2 x](a.png)\n"
    assert report == [{"figure": 2, "placed": True, "after": "正文图 2 在此"}]


def test_longer_numbers_do_not_match():
    assert M.relocate("图 20 在此\n\n![图 2 x](a.png)")[1][0]["placed"] is False


def test_a_paragraph_hosts_one_figure():
    made, report = M.relocate("图 1 与图 2 同段\n\n### 图 1 标题\n\n![图 1 x](1.png)\n\n![图 2 y](2.png)\n\n后文")
    assert [r["placed"] for r in report] == [True, False]
    assert made == "图 1 与图 2 同段\n\n### 图 1 标题\n\n![图 1 x](1.png)\n\n后文\n\n## 图\n\n![图 2 y](2.png)\n"


def test_fenced_chunks_stay_with_their_paragraph():
    made, _ = M.relocate("见图 1：\n\n```\nx\n```\n\n## 图\n\n![](fig-1.png)\n\n末段")
    assert made == "见图 1：\n\n```\nx\n```\n\n![](fig-1.png)\n\n末段\n"


chunks = st.sampled_from(["图 1 甲", "Fig. 2 乙", "补充图 1", "![图 1 a](x.png)", "![图 2 b](y.png)", "![c](fig3.png)", "![d](plain.png)", "## 图", "### 图 1 题", "```\nk\n```", "段"])


@settings(max_examples=150, deadline=None)
@given(st.lists(chunks, max_size=12))
def test_no_image_is_lost(parts):
    text = "\n\n".join(parts)
    made, _ = M.relocate(text)
    assert sorted(re.findall(r"^!\[.*", made, re.M)) == sorted(re.findall(r"^!\[.*", text, re.M))


def test_relocation_of_a_table(spark):
    df = spark.createDataFrame([(1, "图 1 在此\n\n末\n\n![图 1](a.png)"), (2, None), (3, "")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in M.relocate_figures(df).collect()}
    assert found[1].markdown == "图 1 在此\n\n![图 1](a.png)\n\n末\n" and found[1].status == 0 and found[2].report == []


def lines(spark, text):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id bigint, pos int, line string")


def test_headings_and_entries(spark):
    df = lines(spark, "# T\n## A\n### 图 2 | x\n## A\n```\n## no\n```\n## A-1\n#### deep ##\n## 目录")
    assert [r.anchor for r in M.headings(df).orderBy("pos").collect()] == ["t", "a", "图-2-x", "a-1", "a-1", "deep", "目录"]
    assert [(r.title, r.indent) for r in M.toc_entries(df, depth=4).orderBy("pos").collect()] == [("A", 0), ("A", 0), ("A-1", 0), ("deep", 2)]


def test_contents_can_be_refreshed(spark):
    text = "# T\n\nwho\n\n## A\n\nx\n\n### B\n\ny"
    once = M.insert_toc(lines(spark, text)).first().markdown
    assert once == "# T\n\nwho\n\n<!-- TOC -->\n## 目录\n\n- [A](#a)\n  - [B](#b)\n\n<!-- /TOC -->\n\n## A\n\nx\n\n### B\n\ny\n"
    assert M.insert_toc(lines(spark, once.rstrip("\n"))).first().markdown == once
    stripped = spark.createDataFrame([(once,)], "x string").select(M.strip_toc_block(F.col("x")).alias("s")).first().s
    assert stripped.had and "目录" not in stripped.text


def test_navigation(spark):
    nav = '<nav id="TOC" role="doc-toc"><ul><li><a href="#a" id="toc-a">A</a><ul><li><a href="#f" id="toc-f">图 1 x</a></li></ul></li></ul></nav>\n'
    tidy = lambda h: spark.createDataFrame([(h,)], "x string").select(M.tidy_navigation(F.col("x")).alias("s")).first().s
    found = tidy(f"<body>{nav}<h1>T</h1><p>who</p><h2 id='a'>A</h2></body>")
    clean = nav.replace('<ul><li><a href="#f" id="toc-f">图 1 x</a></li></ul>', "")
    assert found.html == f"<body><h1>T</h1><p>who</p>{clean}<h2 id='a'>A</h2></body>" and (found.kept, found.dropped) == (1, 1)
    assert tidy(f"<body>{nav}<h1>T</h1><p>x</p>").html == f"<body><h1>T</h1>{clean}<p>x</p>"
    assert tidy(f"<i>{nav}x").html == f"<i>{clean}x"
    assert tidy("<p>").html == "<p>"

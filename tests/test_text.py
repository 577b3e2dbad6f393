"""Literal cases for column functions."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T


def value(spark, make, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("Fig. 3 and Supplementary Fig. 17", [3]),
        ("Fig 123", [12]),
        ("Figs. 4-6", [4]),
        ("quasi Fig. 9", []),
        ("Figure 2, figure 2, FIG. 31, Fig. 0", [2]),
        ("Fig　５", [5]),
        ("", []),
    ],
)
def test_figure_numbers(spark, text, numbers):
    assert value(spark, T.figure_numbers, text) == numbers


@pytest.mark.parametrize(("text", "number"), [("Fig. 2. x", 2), ("**Figure 3 | x", 3), ("Supplementary Fig. 4: y", 4), ("see Fig. 2.", None), ("Fig 5 x", None)])
def test_caption_number(spark, text, number):
    assert value(spark, T.caption_number, text) == number


@pytest.mark.parametrize(("text", "opens"), [("References", True), ("5. References x", True), ("5.1 References", False), ("Funding was", True), ("competing interests", False), ("Supplementary materials", False), ("Supplementary data", True)])
def test_skipped_sections(spark, text, opens):
    assert value(spark, T.opens_skipped_section, text) is opens


@pytest.mark.parametrize(("parts", "text"), [(["ScienceDirec", "t"], "ScienceDirect"), (["measure- ment"], "measurement"), (["co- OP"], "co- OP"), (["a­b", " \t c"], "ab c"), ([], "")])
def test_stitched(spark, parts, text):
    assert value(spark, T.stitched, parts, "array<string>") == text


@pytest.mark.parametrize(
    ("text", "panels", "how"),
    [
        ("(a) x (b, c) y (d-f) z", list("abcdef"), "parenthesised"),
        ("(a)(b)(c)(d)(e)(f)(g)(h) and (i) a shift", list("abcdefghi"), "parenthesised"),
        ("(a1-a2) (b1)", ["a1", "a2", "b1"], "parenthesised"),
        ("a Map b Plot", [], "none"),
        ("a Map b Plot c–d Bars", list("abcd"), "bare"),
        ("(c) only", [], "none"),
        ("(d-a) (b)", [], "none"),
    ],
)
def test_panel_letters(spark, text, panels, how):
    assert value(spark, T.panel_letters, text).asDict() == {"panels": panels, "panels_from": how}


@pytest.mark.parametrize(("text", "slug"), [("1.1 背景", "11-背景"), ("A **bold** [link](x)!", "a-bold-link"), ("x ± y", "x-y"), ("![i](p) Title_1", "title1"), ("a - b", "a---b")])
def test_slug(spark, text, slug):
    assert value(spark, T.slug_base, text) == slug


def test_argument_languages(spark):
    assert value(spark, lambda c: T.page_list(c, F.lit(8)), "3,7-9") == [3, 7, 8]
    assert value(spark, lambda c: T.page_list(c, F.lit(8)), " 9-7,, 2") == [2]
    assert value(spark, T.grid_of, " 4 x 3").asDict() == {"rows": 4, "cols": 3}
    assert value(spark, T.grid_of, "4 by 3") is None
    assert value(spark, T.layout_of, "4,3+1") == [4, 3, 1]
    assert value(spark, T.layout_of, "4,0") is None
    assert value(spark, T.layout_of, "") is None
    assert value(spark, T.expected_of, "A-C, e,a") == ["a", "b", "c", "e"]
    assert value(spark, T.expected_of, None) == []


def test_lines_and_white_space(spark):
    assert value(spark, T.lines_of, "a\r\nb c\n") == ["a", "b", "c"]
    assert value(spark, T.lines_of, "a\n\nb") == ["a", "", "b"]
    assert value(spark, T.squeeze, "\x1c a \n b ") == "a b"
    assert value(spark, T.strip, "　x y\n") == "x y"


def test_style_levels(spark):
    rows = [("Heading 2", None, 2), ("heading3", None, 3), ("Subtitle", None, 1), ("Body", "9", 9), (None, "0", 1), (None, None, 0), ("Heading 10", None, 0)]
    for style, outline, level in rows:
        df = spark.createDataFrame([(style, outline)], "s string, o string")
        assert df.select(T.style_level(F.col("s"), F.col("o")).alias("y")).first().y == level


def test_captions_with_a_bar(spark):
    assert value(spark, lambda c: T.figure_numbers(c, "CAPTION_BAR"), "Fig. 3 | x, Fig. 4. y, Extended Data Fig. 5 | z") == [3]

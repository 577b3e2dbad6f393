"""Regular expressions that decide results.

Fixed values: results depend on them to the letter, so they are stated once, here, in the order of the operators that use
them. FLAGS holds the flags that each needs; java() gives the form for Spark, where classes must be Unicode-aware and only
a line feed ends a line.
"""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------------------------
CAPTION_START = r"^\**\s*(?:Supplementary\s+|Extended\s+Data\s+)?Fig(?:ure)?\.?\s*(\d{1,2})\s*[.|:｜]"
CAPTION_BAR = r"(Supplementary|Supp\.|Extended\s+Data|SI)?\s*\bFig(?:ure)?\.?\s*(\d{1,2})\s*\|"
REFERENCE = r"(Supplementary|Supp\.|Extended\s+Data|SI)?\s*\bFig(?:ure)?s?\.?\s*(\d{1,2})"
SUPPLEMENT_LINE = r"^\**\s*(Supplementary|Extended)"
SKIP_SECTION = r"^\s*(?:\d+\.?\s*)?(References|Bibliography|Acknowledge?ments?|Declaration of competing interest|CRediT|Data availability|Funding|Appendix|Supplementary (data|material))\b"
HYPHEN_BREAK = r"(\w)-\s+(?=[a-z])"
HEADING_STYLE = r"^[Hh]eading\s*([1-9])$"
PANEL_GROUP = r"\(\s*([a-z]\d?(?:\s*(?:,|and|&|-|–)\s*[a-z]\d?)*)\s*\)"
PANEL_BARE = r"(?<![A-Za-z])([a-z])\s+(?=[A-Z])"
PANEL_BARE_RANGE = r"(?<![A-Za-z])([a-z])\s*[-–]\s*([a-z])\s+(?=[A-Z])"
PANEL_LABEL = r"^\(?([a-zA-Z])\s?(\d{0,2})[).]?$"
IMAGE_CHUNK = r"^!\[(.*)\]\(([^)]*)\)\s*$"
HEADING_CHUNK = r"^#{1,6}\s"
FENCED_CHUNK = r"^(```|~~~).*\1\s*$"
FIGURE_MENTION = r"(?:图|图表|Fig(?:ure)?\.?)\s*{n}(?![0-9])"
SUPPLEMENT_BEFORE = r"(补充|附录|附|扩展数据|Supplementary|Extended\s+Data|SI)\s*$"
FIGURE_IN_CAPTION = r"图\s*(\d{1,2})"
FIGURE_IN_PATH = r"fig(?:ure)?[_\-]?(\d{1,2})"
EMPTY_FIGURE_HEADING = r"^#{1,6}\s*图\s*$"
FENCE_LINE = r"^\s{0,3}(```+|~~~+)"
ATX_HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
FIGURE_HEADING = r"^(图|表|figure|table|fig\.?|附图|补充图)\s*\d"
TOC_BLOCK = r"^<!-- TOC -->.*?^<!-- /TOC -->\n?"
TOC_FIGURE_ENTRY = r'<li><a href="#[^"]*" id="toc-[^"]*">\s*(?:图|表|Figure|Table|Fig\.?|附图|补充图)\s*\d[^<]*</a></li>\s*'
TOC_NAV = r'<nav id="TOC".*?</nav>\s*'

TOC_BEGIN, TOC_END, TOC_TITLE = "<!-- TOC -->", "<!-- /TOC -->", "目录"
ORPHAN_HEADING = "## 图"
UNTRANSLATED = "   <!-- 不翻译 -->"

#: Constants of the rules.
MIN_TEXT_CHARS, IMAGE_SHARE, VECTOR_OPS, BLANK_OPS, ANY_IMAGE = 200, 0.05, 50, 10, 0.01
LARGEST_NUMBER = 30
FURNITURE_FLOOR, FURNITURE_SHARE = 400, 0.25
GUESS_LENGTH = 60
CAPTION_CHARS = 1200
OCR_CHARS_A_PAGE = 20
RENDER_DPI, RENDER_WIDTH = 200, 1600
REGION_SHARE, REGION_GAP, REGION_LABEL_CHARS, REGION_INSIDE = 0.02, 12, 40, 0.6
PAIR_OVERLAP = 0.3
LOOK_BACK = 14
AFTER_CHARS = 60
INK_TOLERANCE, PANEL_PAD, RING_INK, INK_KEPT, TEXT_KEPT = 14, 6, 0.02, 0.97, 0.95
LABEL_HEIGHT, SMALLEST_PANEL = 0.9, 0.004
BLANK_SHARE, LEAST_GUTTER, DEEPEST_CUT = 0.002, 3, 10
GUTTERS = (0.006, 0.008, 0.010, 0.013, 0.016, 0.020, 0.025, 0.030, 0.040)
# --- end of fixed values ------------------------------------------------------------------------------------------

FLAGS = {
    **dict.fromkeys(("CAPTION_START", "CAPTION_BAR", "REFERENCE", "SUPPLEMENT_LINE", "SKIP_SECTION", "SUPPLEMENT_BEFORE", "FIGURE_IN_PATH", "FIGURE_HEADING", "TOC_FIGURE_ENTRY"), "i"),
    **dict.fromkeys(("IMAGE_CHUNK", "FENCED_CHUNK", "TOC_NAV"), "s"),
    "TOC_BLOCK": "sm",
}


def java(name: str) -> str:
    """A pattern with its flags, as Spark needs it."""
    return f"(?{FLAGS.get(name, '')}Ud){globals()[name]}"


def re2(name: str) -> str:
    """A pattern with its flags, as DuckDB needs it."""
    flags = FLAGS.get(name, "")
    return f"(?{flags}){globals()[name]}" if flags else globals()[name]

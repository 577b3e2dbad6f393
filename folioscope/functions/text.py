"""Column functions on text: white space, figure numbers, captions, panel letters, slugs and small argument languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import patterns as P

_WHITE = r"[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; none stays at either end."""
    return F.trim(F.regexp_replace(text, f"(?U){_WHITE}+", " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"(?U)^{_WHITE}+|{_WHITE}+\\z", "")


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at every Unicode line end; a final line end opens no further line."""
    cut = F.split(text, _LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def number(digits: Column) -> Column:
    """Decimal digits, full-width ones included, as an integer; null if there are none."""
    return F.translate(digits, "０１２３４５６７８９", "0123456789").try_cast("int")


def figure_numbers(text: Column, pattern: str = "REFERENCE") -> Column:
    """Sorted distinct numbers of the main paper's figures; mentions with a supplement's prefix do not count."""
    found = [F.regexp_extract_all(text, F.lit(P.java(pattern)), F.lit(g)) for g in (1, 2)]
    main = F.filter(F.arrays_zip(found[0].alias("p"), found[1].alias("n")), lambda m: F.trim(m["p"]) == "")
    numbers = F.transform(main, lambda m: number(m["n"]))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, P.LARGEST_NUMBER))))


def caption_number(text: Column) -> Column:
    """The figure number of a text that starts like a caption, else null."""
    return number(F.nullif(F.regexp_extract(text, P.java("CAPTION_START"), 1), F.lit("")))


def opens_skipped_section(text: Column) -> Column:
    return F.rlike(text, F.lit(P.java("SKIP_SECTION")))


def looks_like_heading(text: Column) -> Column:
    """The guess for documents without styled headings: short, and not ended like a sentence."""
    return (F.length(text) <= P.GUESS_LENGTH) & ~F.rlike(text, F.lit(r"[.。;]\z"))


def stitched(parts: Column) -> Column:
    """Text of the fragments of a paragraph: joined as they are, soft hyphens and hyphenation at line ends undone."""
    joined = F.regexp_replace(F.array_join(parts, ""), "­", "")
    return squeeze(F.regexp_replace(joined, P.java("HYPHEN_BREAK"), "$1"))


def style_level(style: Column, outline: Column) -> Column:
    """Heading level of a paragraph from its style's name, else from its outline level (from 0); 0 for none."""
    named = F.regexp_extract(F.coalesce(style, F.lit("")), P.java("HEADING_STYLE"), 1)
    return (
        F.when(named != "", named.cast("int"))
        .when(F.lower(style).isin("title", "subtitle"), F.lit(1))
        .when(outline.try_cast("int").isNotNull(), F.least(F.lit(9), outline.try_cast("int") + 1))
        .otherwise(F.lit(0))
    )


def _letters(low: Column, high: Column) -> Column:
    """Letters from low to high; none if they are in the wrong order."""
    spread = F.transform(F.sequence(F.ascii(low), F.greatest(F.ascii(low), F.ascii(high))), lambda o: F.char(o))
    return F.when(F.ascii(low) <= F.ascii(high), spread).otherwise(F.array().cast("array<string>"))


def _spread(part: Column) -> Column:
    """Panel names of one part of a bracketed group: single ones, a range of letters or a range of indices."""
    names = F.regexp_extract_all(part, F.lit(r"(?U)[a-z]\d?"), F.lit(0))
    low, high = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    ranged = (F.size(names) == 2) & F.rlike(part, F.lit("[-–]"))
    index = lambda x: F.substring(x, 2, 1).try_cast("int")
    numbered = F.transform(F.sequence(index(low), F.greatest(index(low), index(high))), lambda i: F.concat(F.substring(low, 1, 1), i.cast("string")))
    return (
        F.when(ranged & (F.length(low) == 2) & (F.length(high) == 2) & (F.substring(low, 1, 1) == F.substring(high, 1, 1)), F.when(index(low) <= index(high), numbered).otherwise(F.array().cast("array<string>")))
        .when(ranged & (F.length(low) == 1) & (F.length(high) == 1), _letters(low, high))
        .otherwise(names)
    )


def _from_a(names: Column) -> Column:
    """The unbroken run of letters from a."""
    plain = F.array_sort(F.array_distinct(F.filter(names, lambda x: F.length(x) == 1)))
    return F.filter(plain, lambda x, i: F.ascii(x) - 97 == i)


def panel_letters(text: Column) -> Column:
    """Panels that a caption names: a struct of their names and how they were written (parenthesised, bare, none)."""
    groups = F.regexp_extract_all(text, F.lit(P.java("PANEL_GROUP")), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"(?U)\s*(?:,|and|&)\s*")))
    named = F.array_distinct(F.flatten(F.transform(parts, _spread)))
    indexed = F.array_sort(F.filter(named, lambda x: F.length(x) == 2))
    ends = [F.regexp_extract_all(text, F.lit(P.java("PANEL_BARE_RANGE")), F.lit(g)) for g in (1, 2)]
    ranges = F.flatten(F.transform(F.arrays_zip(ends[0].alias("a"), ends[1].alias("b")), lambda r: _letters(r["a"], r["b"])))
    bare = F.concat(F.regexp_extract_all(text, F.lit(P.java("PANEL_BARE")), F.lit(1)), ranges)
    answer = lambda names, how: F.struct(names.alias("panels"), F.lit(how).alias("panels_from"))
    return (
        F.when(F.size(_from_a(named)) >= 2, answer(_from_a(named), "parenthesised"))
        .when((F.size(indexed) >= 2) & (F.get(indexed, F.lit(0)) == "a1"), answer(indexed, "parenthesised"))
        .when(F.size(_from_a(bare)) >= 3, answer(_from_a(bare), "bare"))
        .otherwise(answer(F.array().cast("array<string>"), "none"))
    )


def slug_base(heading: Column) -> Column:
    """A heading's anchor before repeats are told apart."""
    plain = F.regexp_replace(heading, r"!\[[^\]]*\]\([^)]*\)", "")
    plain = F.regexp_replace(plain, r"\[([^\]]*)\]\([^)]*\)", "$1")
    plain = strip(F.lower(F.regexp_replace(plain, r"[*_`~]+", "")))
    plain = F.regexp_replace(plain, r"[\p{P}\p{S}&&[^-_]]", "")
    return F.regexp_replace(F.regexp_replace(plain, f"(?U){_WHITE}+", "-"), r"^-+|-+\z", "")


def page_list(spec: Column, pages: Column) -> Column:
    """Pages that a list like ``3,7-9`` names, sorted, within 1 to ``pages``."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: strip(p)), lambda p: p != "")

    def spread(part: Column) -> Column:
        ends = F.split(part, "-", 2)
        low, high = strip(F.get(ends, F.lit(0))).cast("int"), strip(F.element_at(ends, -1)).cast("int")
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, spread)))), lambda p: p.between(F.lit(1), pages))


def grid_of(spec: Column) -> Column:
    """Rows and columns of a grid like ``4x3``; null if it is not one."""
    size = [F.regexp_extract(strip(spec), r"(?U)^(\d+)\s*[xX*]\s*(\d+)\z", g) for g in (1, 2)]
    return F.when(size[0] != "", F.struct(number(size[0]).alias("rows"), number(size[1]).alias("cols")))


def layout_of(spec: Column) -> Column:
    """Panels per row of a layout like ``4,3+1``; null unless all are whole numbers of at least 1."""
    parts = F.transform(F.filter(F.split(strip(spec), r"(?U)[,+\s]+"), lambda p: p != ""), lambda p: p.try_cast("int"))
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda n: n.isNotNull() & (n >= 1)), parts)


def expected_of(spec: Column) -> Column:
    """Panel names of a list like ``a-c,d``, in order, without repeats."""
    parts = F.filter(F.split(strip(F.coalesce(spec, F.lit(""))), r"(?U)[,\s+]+"), lambda p: p != "")
    ends = lambda p, g: F.lower(F.regexp_extract(p, r"(?iU)^([a-z])\s*[-–]\s*([a-z])\z", g))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(ends(p, 1) != "", _letters(ends(p, 1), ends(p, 2))).otherwise(F.array(F.lower(p))))))

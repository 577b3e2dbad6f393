"""Record operators on literal rows, and end to end from a Word document."""

import io
import struct
import zipfile
import zlib

import pytest

from folioscope.operators import records as R
from folioscope.sources import docx

RECORDS = "doc_id bigint, pos int, kind string, text string, level int, media string"


def rows(spark, *items):
    made = []
    for pos, item in enumerate(items):
        kind, value = item if isinstance(item, tuple) else ("text", item)
        made.append((1, pos, "image", None, 0, value) if kind == "image" else (1, pos, kind, value, 2 if kind == "heading" else 0, None))
    return spark.createDataFrame(made, RECORDS)


def classes(df):
    return [(r["class"], r.translate, r.section) for r in R.classify(df).orderBy("pos").collect()]


def test_latch_never_ends(spark):
    found = classes(rows(spark, ("heading", "Intro"), "Body text.", ("heading", "References"), "Item.", ("heading", "Later"), "Fig. 1. caption", ("heading", "Funding x")))
    assert found == [("heading", True, None), ("text", True, None), ("heading", False, "skip"), ("text", False, "skip"), ("text", False, "skip"), ("caption", True, None), ("heading", False, "skip")]


def test_headings_are_guessed_without_styles(spark):
    assert [c for c, _, _ in classes(rows(spark, "Short", "Short sentence.", "x" * 61, "条目。"))] == ["heading", "text", "text", "text"]
    assert [c for c, _, _ in classes(rows(spark, "Short", ("heading", "Real")))] == ["text", "heading"]


def sizes(spark, **sides):
    return spark.createDataFrame([(1, m, s, 10) for m, s in sides.items()], "doc_id bigint, media string, width int, height int")


def test_furniture_floor_is_from_the_upper_median(spark):
    assert R.furniture_floor(sizes(spark, a=271, b=950, c=1000, d=1200)).first().floor == 400
    assert R.furniture_floor(sizes(spark, a=3000, b=4000)).first().floor == 1000


@pytest.mark.parametrize(("captions", "cited", "numbers"), [((1, 2, 3, 5), (4,), [1, 2, 3, 5]), ((1, 2, 3), (4,), [1, 2, 3, 4]), ((1, 2), (), [1, 2, None, None])])
def test_numbering(spark, captions, cited, numbers):
    parts = [("image", m) for m in "abcd"] + [f"Fig. {n}. caption" for n in captions] + [f"see Fig. {n} there" for n in cited]
    found = R.images(R.classify(rows(spark, ("image", "logo"), *parts)), sizes(spark, logo=100, a=900, b=900, c=900, d=900))
    assert [(r.furniture, r.figure) for r in found.orderBy("pos").collect()] == [(True, None), *((False, n) for n in numbers)]
    named = R.media_names(found.withColumn("media", found.media))
    assert [r.file for r in named.orderBy("pos").collect()][0] == "media/logo01.png"


def test_repeated_media_keep_their_first_name(spark):
    found = R.images(R.classify(rows(spark, ("image", "w/a.jpg"), ("image", "w/b.jpg"), ("image", "w/a.jpg"))), sizes(spark, **{"w/a.jpg": 900, "w/b.jpg": 900}))
    assert [r.file for r in R.media_names(found).orderBy("pos").collect()] == ["media/img01.jpg", "media/img02.jpg", "media/img01.jpg"]


def test_problems(spark):
    df = R.classify(rows(spark, "plain text only."))
    made = R.manifest(df, R.images(df, sizes(spark, a=900))).first()
    assert made.problems == ["no caption was found"] and made.status == 3 and made.images == 0
    df = R.classify(rows(spark, ("image", "a"), "Fig. 1. x", "Fig. 2 is missing."))
    made = R.manifest(df, R.images(df, sizes(spark, a=900))).first()
    assert made.captions == [1] and made.referenced == [1, 2] and made.status == 3 and len(made.problems) == 1
    df = R.classify(rows(spark, ("image", "a"), "Fig. 1. x"))
    assert R.manifest(df, R.images(df, sizes(spark, a=900))).first().status == 0


def test_empty_table(spark):
    df = R.classify(rows(spark, "x").limit(0))
    assert R.manifest(df, R.images(df, sizes(spark, a=1).limit(0))).count() == 0


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + b"\xff" * width * 3 for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_word_document(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = """<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p>
      <w:p><mc:AlternateContent><mc:Choice><a:blip r:embed="r1"/><w:t>measure- </w:t></mc:Choice><mc:Fallback><w:t>twice</w:t></mc:Fallback></mc:AlternateContent><w:r><w:t>ment</w:t><w:tab/><w:t>x</w:t></w:r></w:p>
      <w:p><a:blip r:embed="r1"/><w:r><w:t>Fig. 1. Caption</w:t></w:r></w:p>
      <w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr/>"""
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/image1.png"/><Relationship Id="r2" Target="styles.xml"/></Relationships>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels)
        z.writestr("word/media/image1.png", png(500, 20))
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    found = docx.read_docx(spark, str(tmp_path)).orderBy("path", "pos").collect()
    good = [(r.kind, r.text, r.level, r.media) for r in found if r.error is None]
    assert good == [("heading", "Intro", 1, None), ("image", None, 0, "word/media/image1.png"), ("text", "measurement x", 0, None), ("text", "Fig. 1. Caption", 0, None), ("text", "AB", 0, None)]
    assert [r.error is not None for r in found if r.path.endswith("b.docx")] == [True]
    parts = docx.picture_sizes(docx.read_media(spark, str(tmp_path))).orderBy("media").collect()
    assert [(r.media, r.width, r.height, r.error is None) for r in parts] == [(None, None, None, False), ("word/media/image1.png", 500, 20, True)]


def test_picture_sizes_of_all_kinds():
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF".ljust(14, b"\0") + b"\xff\xc4" + struct.pack(">H", 4) + b"ab" + b"\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, 77, 640, 3) + b"\0" * 9
    known = {
        png(30, 20): (30, 20),
        jpeg: (640, 77),
        b"GIF89a" + struct.pack("<HH", 9, 8): (9, 8),
        b"BM" + b"\0" * 16 + struct.pack("<ii", 12, -5): (12, 5),
        b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"): (100, 50),
    }
    for data, size in known.items():
        assert docx.picture_size(data) == size
    assert [docx.picture_size(x) for x in (None, b"", b"\xff\xd8", jpeg[:30], b"text")] == [None] * 5

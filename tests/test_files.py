from pyspark.sql import functions as F

from folioscope.sources import files


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\nx\n")
    (tmp_path / "in/b.txt").write_text("no")
    assert [r.text for r in files.read_markdown(spark, f"{tmp_path}/in").collect()] == ["# A\n\nx\n"]
    files.write_markdown(spark.createDataFrame([(7, "a\n\n\n")], "doc_id int, markdown string"), f"{tmp_path}/out")
    assert [p.read_text() for p in (tmp_path / "out/doc_id=7").glob("part-*")] == ["a\n"]
    files.write_json(spark.range(2), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_markdown_in_buckets_and_in_place(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}\n\n") for i in range(20)], "doc_id int, markdown string")
    files.write_markdown(df, f"{tmp_path}/few", files=3)
    back = spark.read.parquet(f"{tmp_path}/few")
    assert {r.doc_id: r.markdown for r in back.collect()} == {i: f"text {i}\n" for i in range(20)} and len(back.inputFiles()) <= 3
    (tmp_path / "a.md").write_text("old\n")
    rows = spark.createDataFrame([(f"file://{tmp_path}/a.md", "new\n\n"), (f"{tmp_path}/b.md", "fresh")], "path string, markdown string")
    assert sorted(r.bytes for r in files.rewrite(rows).collect()) == [4, 6]
    assert not (tmp_path / "b.md.bak").exists()
    files.rewrite(rows).collect()
    assert [(tmp_path / n).read_text() for n in ("a.md", "a.md.bak", "b.md")] == ["new\n", "old\n", "fresh\n"]


def test_media_are_saved(spark, tmp_path):
    media = spark.createDataFrame([(1, "w/a.png", bytearray(b"abc")), (1, "w/b.png", bytearray(b"no"))], "doc_id bigint, media string, content binary")
    named = spark.createDataFrame([(1, "w/a.png", "media/fig01.png"), (1, "w/a.png", "media/fig01.png")], "doc_id bigint, media string, file string")
    assert [tuple(r) for r in files.save_media(media, named, f"file://{tmp_path}/m").collect()] == [(1, "media/fig01.png", 3)]
    assert (tmp_path / "m/1/media/fig01.png").read_bytes() == b"abc"
    none = media.withColumn("content", F.lit(None).cast("binary"))
    assert files.save_media(none, named, f"file://{tmp_path}/m").count() == 0 and not (tmp_path / "m/1/media/fig01.png").exists()


def test_pictures(spark, tmp_path):
    from test_records import png

    (tmp_path / "p.png").write_bytes(png(30, 20))
    r = files.read_images(spark, f"{tmp_path}/p.png").select("width", "height", F.length("data").alias("n")).first()
    assert (r.width, r.height, r.n) == (30, 20, 1800)

"""Markdown, images and outputs as files."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import ship


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole Markdown files (path, text)."""
    return spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pictures (path, height, width, nChannels, data); broken ones are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def write_json(df: DataFrame, path: str) -> None:
    """A manifest or report as JSON lines, replacing what was there."""
    df.write.mode("overwrite").json(path)


def write_markdown(df: DataFrame, path: str, key: str = "doc_id", text: str = "markdown", files: int | None = None) -> None:
    """Markdown as text whose end is one line feed: one folder per document.

    A file system takes some millions of folders at most. Beyond that ``files`` gives the number of Parquet files (key, text)
    that documents are dealt to by key instead, in order of the key, so that one is found by reading a single file.
    """
    ended = F.regexp_replace(text, r"\n+\z", "")
    if files is None:
        df.select(key, ended.alias("value")).write.mode("overwrite").partitionBy(key).text(path)
    else:
        df.select(key, F.concat(ended, F.lit("\n")).alias(text)).repartition(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def _store(path: str):
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(local)


def rewrite(df: DataFrame, backup: bool = True) -> DataFrame:
    """Write each row's markdown to its path, with a copy of what was there at path.bak; returns (path, bytes), lazily.

    An existing copy is kept, so that a repeated task does not put its own output in place of the original.
    """
    ship(df.sparkSession)

    def save(batches):
        for pdf in batches:
            sizes = []
            for target, text in zip(pdf["path"], pdf["markdown"], strict=True):
                data = (text.rstrip("\n") + "\n").encode()
                store, path = _store(target)
                held, copied = (f.type == fs.FileType.File for f in store.get_file_info([path, f"{path}.bak"]))
                if backup and held and not copied:
                    store.copy_file(path, f"{path}.bak")
                with store.open_output_stream(path) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pdf.assign(bytes=sizes)[["path", "bytes"]]

    return df.select("path", "markdown").mapInPandas(save, "path string, bytes bigint")


def save_media(media: DataFrame, named: DataFrame, folder: str) -> DataFrame:
    """Write media (doc_id, media, content) under the names of records.media_names(); returns what was written.

    What an earlier run left below ``folder`` goes first. Media without content are not written.

    Each document has a folder of its own below ``folder``, which all executors must reach. A file is written whole and
    again if its task is repeated. The result (doc_id, file, bytes) is lazy: reading it does the work.
    """
    ship(media.sparkSession)
    store, path = _store(folder)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir_contents(path)
    wanted = named.where("file is not null").select("doc_id", "media", "file").distinct().join(media.where("content is not null"), ["doc_id", "media"])

    def save(batches):
        for pdf in batches:
            for doc, file, content in zip(pdf["doc_id"], pdf["file"], pdf["content"], strict=True):
                store, path = _store(f"{folder}/{doc}/{file}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(bytes(content))
            yield pdf.assign(bytes=[len(c) for c in pdf["content"]])[["doc_id", "file", "bytes"]]

    return wanted.select("doc_id", "file", "content").mapInPandas(save, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, file string, bytes bigint")

"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of up to ``chunk`` code points is encoded at once. A longer one is encoded in overlapping chunks with offsets, and
neighbours are spliced at a position of their overlap where both have a token boundary and which the tokenizer cannot
read across. The pre-tokenizer of byte-level BPE reads runs of letters, of digits, of other characters and of white
space, each run with at most one space before it, and merges never cross its pieces. So a piece always ends between a
letter and what is none, between a digit and what is none, and between any other character and white space or a digit
(a letter may follow an apostrophe in one piece), whatever stands on either side. Only characters whose class is beyond
doubt count here, and no place inside a special token's string does. Stable places are looked for before anything is encoded: first in the overlap, which is
doubled until it holds one, then beyond the chunk, which grows to the next one; so every character is encoded at most
about twice, and a text without any is encoded whole, once. Where the encodings do not agree on a place after all, the
overlap is doubled as well. Shorter texts fall apart before spaces, so the count of each distinct piece is looked up in a
bounded memory before it is encoded. A tokenizer whose pre-tokenizer is not of this kind gets every text whole.

Defined results: a null text counts as empty and has no tokens; strings of special tokens inside a text are handled as
the library does by default; rows are counted each on its own; only the named columns are read.

Scale: one pass without a shuffle; time is linear in the text and memory is bounded by the longest single text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import keyed, ship, table

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP, LIMIT = 65_536, 1_024, 512

#: Pieces whose counts a process remembers; beyond it starts anew.
REMEMBERED = 1_000_000

_ODD = re.compile(r" \s|\s |\A | \Z")
_STABLE = re.compile(r"(?<=\S)(?= \S)")
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_OTHER = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: Places that no piece of the pre-tokenizer spans.
_BREAK = re.compile(rf"(?<=[{_LETTER}])(?=[0-9 \n\r\t{_OTHER}])|(?<=[0-9])(?=[{_LETTER} \n\r\t{_OTHER}])|(?<=[{_OTHER}])(?=[0-9 \n\r\t])")
_LOADED: dict[str, object] = {}


def tokenizer(path: str | None = None):
    """The tokenizer of a vocabulary file, loaded once per process; by default the public one of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    path = str(path)
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _LOADED[path] = made
    return _LOADED[path]


def separable(coder) -> bool:
    """Whether no token crosses a single space between characters: byte-level BPE and no normaliser."""
    import json

    made = json.loads(coder.to_str())
    pre = made.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(plain) and not made.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in made["added_tokens"])


def pieces(text: str) -> list[str]:
    """The parts of a text between stable positions; they join to the text."""
    if _ODD.search(text):
        return _STABLE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def counts(texts: list[str], coder, known: dict[str, int]) -> list[int]:
    """Numbers of tokens of texts by their pieces; ``known`` remembers pieces between calls."""
    if len(known) > REMEMBERED:
        known.clear()
    parts = [pieces(t) for t in texts]
    new = list({p for ps in parts for p in ps if p not in known})
    known.update(zip(new, map(len, coder.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    return [sum(map(known.__getitem__, ps)) for ps in parts]


def specials(coder) -> list[str]:
    """The strings of added tokens, which are cut out of a text before anything else."""
    return [t.content for t in coder.get_added_tokens_decoder().values()]


def stable(text: str, start: int, end: int, special: list[str]) -> Iterator[int]:
    """Stable places p with start < p < end that no special string spans, in order."""
    for m in _BREAK.finditer(text, start, end):
        p = m.start()
        if start < p < end and not any(text.find(x, max(0, p - len(x) + 1), p + len(x) - 1) >= 0 for x in special):
            yield p


def last_stable(text: str, start: int, end: int, special: list[str]) -> int | None:
    """The last stable place with start < p < end, looked for in strips from the end."""
    high, wide = end, 256
    while high > start:
        low = max(start, high - wide)
        found = None
        for found in stable(text, max(start, low - 1), high, special):
            pass
        if found is not None:
            return found
        high, wide = low, 2 * wide
    return None


def count(text: str, coder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a text, as encoding it whole gives."""
    n = len(text)
    if n <= chunk:
        return len(coder.encode(text, add_special_tokens=False).ids)
    special = specials(coder)
    encode = lambda a, b: [(x + a, y + a) for x, y in coder.encode(text[a:b], add_special_tokens=False).offsets]

    def closed(begin: int, end: int) -> tuple[int, int | None]:
        """An end of the chunk at or after ``end`` with the last stable place before it; None where the text ends first."""
        if end >= n:
            return n, None
        at = last_stable(text, begin, end, special)
        if at is None:
            at = next(stable(text, max(begin, end - 1), n, special), None)
            return (n, None) if at is None else (min(n, at + overlap), at)
        return end, at

    total, left, begin = 0, 0, 0
    end, at = closed(begin, min(n, chunk))
    now = encode(begin, end)
    while at is not None:
        start = max(left, at - overlap)
        stop, after_at = closed(at, min(n, at + chunk))
        after = encode(start, stop)
        while not (any(b == at for _, b in now) and any(a == at for a, _ in after)):
            if start == left:  # no common boundary although all of the chunk was read again: give up chunks
                return total + len([1 for a, _ in encode(left, n) if a >= left])
            start = max(left, start - 2 * (at - start))
            after = encode(start, stop)
        total += sum(left <= a and b <= at for a, b in now)
        left, now, at = at, after, after_at
    return total + sum(left <= a for a, _ in now)


def _counted(path: str | None, chunk: int, overlap: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = tokenizer(path), {}
        apart = separable(coder)
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if apart:
                short = counts([t if len(t) <= chunk else "" for t in texts], coder, known)
                found = [n if len(t) <= chunk else count(t, coder, chunk, overlap) for n, t in zip(short, texts, strict=True)]
            else:
                found = [len(coder.encode(t, add_special_tokens=False).ids) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. ``path`` is a vocabulary file on every executor."""
    ship(docs.sparkSession)
    read = keyed(docs, doc_id=doc_id, text=text).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint"))
    out = read.mapInArrow(_counted(path, chunk, overlap), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its tokens."""
    return token_counts(table(spark, sf_dir, "documents"))


SQL = None

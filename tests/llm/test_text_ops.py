"""Decontamination, exact dedup, token counts and chat formatting against brute force and round trips."""

import base64
import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import chat, decontaminate, exact, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    """n_words, numbers of hit words, item ids."""
    doc, hit, ids = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        for window in [w[i : i + 13] for i in range(max(1, len(w) - 12))] if w else []:
            for p in range(len(doc) - len(window) + 1):
                if doc[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    if item is not None:
                        ids.add(str(item))
    return len(doc), hit, ids


BIG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, BIG), (10, "Short É-item"), (2, None), (3, ""), (4, "a a a"), (None, "lonely words here"), (1, "w5 w6 w7")]
DOCS = [
    (1, "x " + BIG + " y"),
    (2, "W3, w4; w5.\nW6 " + " ".join(f"w{i}" for i in range(7, 16)) + " tail"),
    (3, "short é item SHORT é\titem"),
    (4, None),
    (5, ""),
    (6, "a a a a b a a"),
    (7, " ".join(["pad"] * 200) + " lonely words here"),
    (7, " ".join(["pad"] * 200) + " lonely words here"),
    (None, "w5 w6 w7"),
    (8, "日本語 " * 50),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, "en", 5) for d, t in DOCS], "doc_id bigint, text string, found string, n_words int")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_marks_agree_with_brute_force(tables, block_bytes):
    docs, items = tables
    found = decontaminate.mark(docs, items, block_bytes=block_bytes).select("doc_id", "text", "contamination.*", *[c.alias(f"v_{k}") for k, c in decontaminate.verdict().items()]).collect()
    assert len(found) == len(DOCS)
    for r in found:
        n, hit, ids = brute(r.text, ITEMS)
        assert r.v_n_words == n and r.v_n_hit == len(hit) and set(r["items"]) == ids and r.v_n_items == len(ids)
        assert r.v_items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert r.v_contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        assert [w for s in r.spans for w in words(r.text[s.start : s.end])] == [words(r.text)[i] for i in sorted(hit)]


def test_blocks_are_handled_one_at_a_time(spark, tables, monkeypatch):
    docs, items = tables
    live, most, sizes = [], [], []
    real = type(spark.sparkContext).broadcast

    def broadcast(context, value):
        made = real(context, value)
        sizes.append(sum(len(t) + 1 for _, t in value))
        live.append(1)
        most.append(len(live))
        gone = made.destroy
        made.destroy = lambda *a: (live.pop(), gone(*a))
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(decontaminate, "STRETCH", 4)
    found = decontaminate.mark(docs, items, block_bytes=150, name="found")
    assert found.columns == [*docs.columns, "found_"] and len(sizes) > 3 and max(most) == 1 and not live and max(sizes) < 600
    for r in found.collect():
        n, hit, ids = brute(r.text, ITEMS)
        assert r.found_.n_words == n and set(r.found_["items"]) == ids
        assert [x for a, b in r.found_.runs for x in range(a, b + 1)] == sorted(hit)


def test_decontaminated_documents_keep_their_columns(spark, tables):
    docs, items = tables
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 7, 8]
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(DOCS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=30), st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=4), max_size=4))
def test_windows_overlap(doc, items):
    named = [(str(i), " ".join(x).encode()) for i, x in enumerate(items)]
    hit, ids = decontaminate.find([w.encode() for w in doc], decontaminate.automaton(named, 3))
    want, owners = set(), set()
    for i, x in enumerate(items):
        for w in [x[k : k + 3] for k in range(max(1, len(x) - 2))] if x else []:
            for p in range(len(doc) - len(w) + 1):
                if doc[p : p + len(w)] == w:
                    want.update(range(p, p + len(w)))
                    owners.add(str(i))
    assert set(hit.tolist()) == want and ids == owners


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_groups(spark, bits):
    long = "".join(chr(97 + (i * i) % 23) for i in range(30_000))
    texts = ["a b", "ab", "a\tb ", None, "", " \n", long, long[:15_000] + " " + long[15_000:], long + "x", long[1:], "é b", "éb", "ab"]
    docs = spark.createDataFrame([(i if i != 12 else None, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    found = exact.groups(docs, bits=bits).collect()
    assert len(found) == len(texts)
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i == 12, i))
    keep = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in by.items()}
    for r in found:
        assert (r.keep_id, r.group_size) == keep[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)
    assert exact.groups(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000).map(lambda b: b * 5))
def test_chunks_join_to_the_text(data):
    ends = exact.cuts(data)
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
    assert all(b - a <= exact.MOST for a, b in zip([0, *ends], ends, strict=False))


def test_equal_passages_share_chunks():
    body = hashlib.shake_256(b"x").digest(60_000)
    recipe = exact.recipe(body)[0]
    other = exact.recipe(b"another beginning" * 20 + body)[0]
    assert len(set(recipe) & set(other)) > 0.8 * len(recipe)


PIECES = ["a", "word", " the", " ", "  ", "\n", "é", "'s", "<|endoftext|>", "12", "!", "日本", "\x1c", "\x85", "\xa0", "\t", " x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.sampled_from([5, 20]), st.sampled_from([2, 5]))
def test_counts_equal_whole_encoding(text, chunk, overlap):
    coder = tokens.tokenizer()
    whole = len(coder.encode(text, add_special_tokens=False).ids)
    assert tokens.counts([text], coder, {})[0] == whole == tokens.count(text, coder, chunk, overlap)


def test_texts_without_a_stable_place_are_encoded_whole():
    coder = tokens.tokenizer()
    text = "ab" * 3000
    assert tokens.count(text, coder, 100, 10) == len(coder.encode(text, add_special_tokens=False).ids)


def cjk(n, stops):
    r = random.Random(2)
    return "".join(chr(r.randrange(0x4E00, 0x9FA5)) + "。" * (stops and r.random() < 0.05) for _ in range(n))


@pytest.mark.parametrize(
    "text",
    [cjk(1_000_000, True), cjk(420_000, False), base64.b64encode(random.Random(1).randbytes(750_000)).decode(), "\n" * 1_000_000, "ab<|endoftext|>cd" * 40_000, "x's'" * 100_000],
    ids=["stops", "cjk", "base64", "lines", "special", "apostrophes"],
)
def test_long_texts_without_spaces_take_linear_time(text):
    coder = tokens.tokenizer()
    began = time.perf_counter()
    whole = len(coder.encode(text, add_special_tokens=False).ids)
    took = time.perf_counter() - began
    assert tokens.count(text, coder) == whole
    assert time.perf_counter() - began - took < 3 * took + 1


def test_stable_places_spare_special_strings():
    text = "ab<|endoftext|>cd1 x"
    assert [*tokens.stable(text, 0, len(text), ["<|endoftext|>"])] == [2, 17, 18]
    assert tokens.last_stable(text, 0, 17, ["<|endoftext|>"]) == 2


def test_token_table(spark):
    rows = [(1, "hello world", 3), (2, None, 3), (3, "", 3), (None, "x " * 2000, 3), (1, "hello world", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    found = tokens.token_counts(docs, chunk=1000, overlap=50).collect()
    coder = tokens.tokenizer()
    want = sorted((d or -1, len((t or "").encode()), len(coder.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in found) == want
    assert [r.over_limit for r in found if r.doc_id is None] == [True]
    assert tokens.token_counts(docs.limit(0)).count() == 0


control = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "assistant", "é", "x", "<\\|"]), max_size=12).map("".join)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\\b", "sys\ntem", "<|x"]), control), max_size=40)


@settings(max_examples=150, deadline=None)
@given(turns)
def test_formatted_chats_round_trip(conversation):
    whole, spans = chat.locate(conversation)
    assert chat.parse(whole) == conversation and whole.count("<|im_start|>") == len(conversation)
    assert [chat.unescape(whole[s[2] : s[3]]) for s in spans] == [t for _, t in conversation]
    assert "".join(whole[s[0] : s[1]] for s in spans) == whole


def test_templates_that_rewrite_history_are_found():
    forgetful = lambda ts: f"[{len(ts)}]" + "".join(t for _, t in ts)
    assert chat.locate([("user", "a"), ("assistant", "b")], forgetful)[1] is None
    headed = lambda ts: "<s>" + chat.chatml(ts)
    whole, spans = chat.locate([("user", str(i)) for i in range(50)], headed)
    assert [whole[s[2] : s[3]] for s in spans] == [str(i) for i in range(50)]


def test_rewriting_at_one_length_only_is_found(spark):
    at_35 = lambda ts: "[X]" * (len(ts) == 35) + chat.chatml(ts)
    assert chat.locate([("user", str(i)) for i in range(34)], at_35)[1] is not None
    assert chat.locate([("user", str(i)) for i in range(40)], at_35) == (chat.chatml([("user", str(i)) for i in range(40)]), None)
    rows = [(c, t, "assistant" if t % 2 else "user", f"t{t}") for c, n in ((1, 34), (2, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = {r.conv_id: (r.rewrites, len(r.loss), r.unlocated) for r in chat.format_chats(df, template=at_35).collect()}
    assert found == {1: (False, 17, 0), 2: (True, 0, 20)}


def test_texts_that_cannot_be_located_are_counted(spark):
    shouting = lambda ts: "".join(f"{r}: {t.upper() if t != chat.MARKER else '?'}\n" for r, t in ts)
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    found = {r.conv_id: (r.rewrites, len(r.spans), len(r.loss), r.unlocated) for r in chat.format_chats(df, template=shouting).collect()}
    assert found == {1: (False, 2, 0, 1), 2: (False, 1, 0, 0)}


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", "late"), (2, 5, "assistant", "first"), (2, 5, "assistant", "first"), (3, 0, "user", "only")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, spans int")
    found = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {1: 2, None: 1, 2: 3, 3: 1}
    learnt = lambda r: [r.formatted[s.text_start : s.text_end] for s in r.loss]
    assert learnt(found[1]) == ["b"] and learnt(found[2]) == ["first", "first", "late"] and learnt(found[3]) == []
    assert chat.format_chats(df.limit(0)).count() == 0
    assert not any(r.rewrites for r in found.values())


def test_one_conversation_with_many_turns(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = chat.format_chats(df).first()
    assert r.n_turns == 3000 and chat.parse(r.formatted)[2999] == ("assistant", "t2999") and len(r.loss) == 1500

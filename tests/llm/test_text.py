import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notefathom.llm import bpe, splitting


# ---- encoding ----


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["Hello world", "<|endoftext|> x", "", None, "a" * 20_000, " " * 3000 + "x", "'s 'S don't we'll", "naïve 日本語 🌱👩‍👩‍👧", "\r\n\t\x0b\x85  ", "x  y   ", "½ ² ٣ Ⅷ", "é"]


def test_ids_are_those_of_the_public_tokenizer(spark, public):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab é'\n 1٣._日🌱") for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as tokens")
    got = {r.doc_id: r.x for r in df.select("doc_id", bpe.token_ids(F.col("text")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == public([t or "" for t in texts])
    counts = {r.doc_id: r.n for r in df.select("doc_id", bpe.token_count(F.col("text")).alias("n")).collect()}
    assert all(counts[i] == len(got[i]) for i in got)


def test_queue_takes_the_least_rank_first():
    q, rng = bpe.RankQueue(), random.Random(1)
    want = sorted((rng.randrange(50_000), i) for i in range(500))
    for rank, i in rng.sample(want, len(want)):
        q.push(rank, i)
    got = []
    while x := q.pop():
        got += [(x[0], i) for i in x[1]]
    assert got == want


def test_slices_and_nulls(enc):
    arr = pa.array([["a", " b"], None, [], [" hello", " hello"]], pa.list_(pa.string()))
    ids, per_doc = bpe._gathered(arr.slice(1), enc, True)
    assert list(per_doc) == [0, 0, 2] and ids[0] == ids[1]


# ---- splitting ----


def units(t):
    return len(t.encode("utf-16-le", "surrogatepass")) // 2


def check(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    if units(text) <= limit:
        assert len(got) == (1 if text else 0)
        return got
    assert got[0][0] == got[0][1] == 0 and got[-1][2] == len(text) and len(got) > 1
    for (a, fresh, b, _), (c, next_fresh, d, _) in zip(got, got[1:]):
        assert next_fresh == b and a <= c <= b < d
        assert min(overlap - 1, units(text[a:b])) <= units(text[c:b]) <= overlap
    assert all(units(text[a:b]) <= limit for a, _, b, _ in got)
    return got


ALPHABET = st.sampled_from(["a", "bc", " ", ". ", "\n", "\n\n", "# h\n", "```\n", "🌱", "。", "x" * 30])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join))
def test_pieces(text):
    check(text, 60, 9)


def test_strongest_boundaries_win():
    para = "One sentence here. Another one there.\n\n"
    text = para * 4 + "# Section\n\n" + para * 4
    cuts = [p[2] for p in splitting.split(text, len(text) - 1, 10)][:-1]
    assert cuts == [len(para) * 4]
    fence = "```\n" + "code line\n" * 8 + "```\n"
    text = "intro words\n" * 6 + fence + "outro words\n" * 6
    assert all(not 72 < p[2] < 72 + len(fence) for p in splitting.split(text, 160, 10)[:-1])


def test_forced_only_without_boundaries():
    got = splitting.split("x" * 5000 + " " + "y" * 50, 2000, 200)
    assert any(p[3] for p in got) and not got[-1][3]
    assert not any(p[3] for p in splitting.split("word " * 1000, 2000, 200))


def test_long_text_is_quick():
    check("some words and more. " * 100_000, 2000, 200)


def test_found(spark):
    rows = [(1, "x" * 2001), (2, "w " * 1500), (3, "short"), (4, None), (5, ""), (6, "🌱" * 1001), (7, "🌱" * 1000), (8, "a" * 1999 + " " + "b" * 1999), (1, "y " * 1001)]
    nodes = spark.createDataFrame(rows, "row_id long, content string").selectExpr("*", "1 as piece", "2 as text")
    got = sorted((r.row_id, r.stretch > 2000) for r in splitting.pieces(nodes).where("piece = 0").collect())
    assert got == [(1, False), (1, True), (2, False), (6, True), (8, False)]
    assert splitting.pieces(nodes.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a" * 30, "。", " ", "\n", "🌱" * 7, "b" * 61, "\u00a0", "c. "]), min_size=1, max_size=40).map("".join))
def test_a_cut_lies_in_every_long_run(text):
    if units(text) > 60:
        parts = splitting.split(text, 60, 9)
        longest = max(units(x) for x in re.split("[ \t\r\n]", text))
        assert (max(splitting.stretch(text, fresh, 60) for _, fresh, _, _ in parts[1:]) > 60) == (longest > 60)


def test_pieces_join_to_the_text(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["word ", "x" * 900, "\n\n", "# h\n", "🌱", "end. ", "```\n"]) for _ in range(200))) for i in range(12)]
    nodes = spark.createDataFrame(rows, "row_id long, content string")
    back = {}
    for r in splitting.pieces(nodes).orderBy("row_id", "piece").collect():
        u = r.text.encode("utf-16-le")
        assert r.n_units * 2 == len(u) <= 4000 and (r.piece == 0) == (r.overlap_units == 0)
        assert back.get(r.row_id, b"").endswith(u[: 2 * r.overlap_units])
        back[r.row_id] = back.get(r.row_id, b"") + u[2 * r.overlap_units :]
    assert {k: v.decode("utf-16-le") for k, v in back.items()} == dict(rows)

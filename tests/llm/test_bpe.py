"""BPE against the tokenizers library and an exact round trip of the join rule."""

import hashlib
import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SMALL
from threadmill.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "   \n ", "<|startoftext|>Hi<|endoftext|> don't ISTANBUL İ Σ ΟΔΟΣ", "a\x1cb\x85c\xa0d​e f᠎g", "aaaaaaaaa aaaaaa bbbbbb aaaaab" * 3,
    "é ́x", "x²½Ⅷ ①", "日本語 한국어 \U0001f389\U0001f44d\U0001f3fd", "it's THEY'LL we'Re", "<|END|> <|endoftext", "\x00\x01", "w" * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.PairIndexBpe(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_odd_rows(spark, library):
    rows = [(i, t, "x", [7]) for i, t in enumerate(ODD)] + [(None, "The End", "y", None), (None, "The End", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")  # columns that clash with the results
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["ids"], r["decoded"]) == expected(library, r["text"])


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_outside_the_vocabulary(spark):
    df = spark.createDataFrame([(1, [320, -5, 10**6, None, 320]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    assert got == {1: "a</w> a</w>", 2: "", 3: ""}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids, lens = own.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert lens.tolist() == [len(ids)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=12), min_size=1, max_size=8))
def test_overlapping_pairs(words):
    """Runs of one letter and pairs that arise from merges, against the plain rule word by word."""
    signs = bpe.byte_symbols()
    vocab = {s: i for i, s in enumerate([*signs, *(s + "</w>" for s in signs)])}
    merges = [("a", "a"), ("a", "b"), ("a", "b</w>"), ("aa", "a"), ("ab", "ab"), ("b", "b</w>"), ("aa", "aa"), ("abab", "ab</w>")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = {"model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab, "merges": [list(m) for m in merges]}, "decoder": None, "added_tokens": []}
    made = bpe.PairIndexBpe(json.dumps(spec))
    ids, lens = made.merge([w.encode() for w in words])
    want = []
    for w in words:
        s = [*w[:-1], w[-1] + "</w>"]
        while ranks := [merges.index(p) for p in zip(s, s[1:]) if p in merges]:
            a, b = merges[min(ranks)]
            i = next(i for i in range(len(s) - 1) if (s[i], s[i + 1]) == (a, b))
            s[i : i + 2] = [a + b]
        want.append([vocab[x] for x in s])
    assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_query_against_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, text = expected(library, texts[r["doc_id"]])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert tuple(r) == (r["doc_id"], len(ids), digest, hashlib.sha256(text.encode()).hexdigest())

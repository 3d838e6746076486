"""Token files: exact round trips of the boundaries, and the library's ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SMALL
from threadmill.llm import queries, tokenfiles
from threadmill.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return tokenfiles.Encoder(f.read())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.sampled_from([1, 1000]))
def test_elias_fano(gaps, scale):
    values = np.cumsum([0, *(g * scale for g in gaps)])
    coded = tokenfiles.EliasFano.of(values)
    assert coded.select(np.arange(len(values))).tolist() == values.tolist()
    assert coded.select(np.arange(len(values))[::-3]).tolist() == values[::-3].tolist()


def test_boundaries_take_little_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    c = tokenfiles.EliasFano.of(values)
    assert (c.low.nbytes + c.high.nbytes + c.ones.nbytes) * 8 < len(values) * (2.2 + np.log2(values[-1] / len(values)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t\x1c\x85\xa0'sé"), max_size=40), max_size=4))
def test_any_text(own, library, texts):
    ids, lens = own.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def check(got, rows, library):
    """rows: (doc_id, text), ids distinct."""
    start = 0
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(by[d]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_query_against_library(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(queries.op6_token_files(spark, SMALL).collect(), rows, library)


def test_many_files_and_odd_rows(spark, library):
    rows = [(None, "null id"), (-3, None), (0, ""), (7, "<|endoftext|> a <|endoftext|>"), (8, " lead  two \n tail "), (9, "don't\nstop " * 20_000), (2**40, "x"), *((i, f"row {i}") for i in range(100, 300))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    folder = scratch_path(spark, "tokens")
    manifest = tokenfiles.write(df, folder, PATH, 2, file_tokens=50)
    assert manifest.count() > 2
    check(tokenfiles.read(manifest, folder).collect(), rows, library)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b")] * 3 + [(1, "c")], "doc_id long, text string")
    got = sorted((r["start"], r["n_tokens"]) for r in tokenfiles.round_trip(df, PATH).collect())
    assert len(got) == 4 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_empty_table(spark):
    assert tokenfiles.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

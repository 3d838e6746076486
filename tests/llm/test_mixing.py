"""Mixing against a plain loop over one list."""

import hashlib
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from threadmill.llm import mixing, queries
from tools.check_oracle import duck, rows_of


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Target of each source by resharing in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return {s: 2.0 * sizes[s] for s in order}
        unit = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit >= 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * unit for s in order}
        full |= above


def plain_mix(rows, seed=17):
    """rows: (doc_id, source, text, quality). Returns sorted (doc_id, size, source_size, target, taken)."""
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = plain_targets(sizes)
    out = []
    for s, total in sizes.items():
        epochs = int(target[s] // total) if total else 0
        rest, before = target[s] - epochs * total, 0
        keyed = []
        for d, _, t, q in (r for r in rows if r[1] == s):
            u = (int(hashlib.md5(f"{'null' if d is None else d}:{seed}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            keyed.append((-math.log(u) / q, d is not None, d or 0, words(t), t is not None and xxhash.xxh64_intdigest(t.encode(), 42), d))
        for *_, n, _, d in sorted(keyed, key=lambda k: k[:4]):
            extra = int(n > 0 and before + n / 2 < rest)
            before += n
            out.append((d, n, total, target[s], (epochs + extra) * n))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in df.collect()), key=repr)


def same(a, b):
    assert [x[:3] + x[4:] for x in a] == [x[:3] + x[4:] for x in b]
    assert [x[3] for x in a] == pytest.approx([x[3] for x in b])


def test_word_count(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", " a b  c\n", "x" * 50_000, " ", "a b " * 30_000, "\x1c \x1d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r["i"]: r["n"] for r in df.select("i", mixing.n_words(F.col("t")).alias("n")).collect()} == {i: words(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("range_rows", [1, 7, 50_000])
def test_against_a_plain_loop(spark, range_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("mix_quality", F.lit(0.5) + F.col("doc_id") % 3)
    rows = [(r["doc_id"], r["source"], r["text"], r["mix_quality"]) for r in docs.collect()]
    same(result(mixing.mix(docs, quality=F.col("mix_quality"), range_rows=range_rows)), plain_mix(rows))


def test_query_against_sql(spark):
    df = queries.op5_mixing(spark, SMALL)
    cur = duck(SMALL).execute(queries.ORACLES["op5_mixing"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_query_keeps_its_bounds(spark):
    got = queries.op5_mixing(spark, SMALL).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] % max(r["size"], 1) == 0
        s = taken.setdefault(source[r["doc_id"]], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
    assert all(abs(t - target) <= most / 2 for t, target, most in taken.values())
    assert sum(t for _, t, _ in taken.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    again = queries.op5_mixing(spark, SMALL).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows(spark):
    rows = [(1, None, "a b c", 1.0), (1, None, "a b c", 1.0), (2, None, None, 1.0), (None, "b", "x " * 9, 1.0), (None, "b", "x " * 8, 1.0), (3, "B", "", 1.0), (4, "é", "y " * 5_000, 1.0), (5, "z", " ", 1.0)]
    df = spark.createDataFrame([(*r[:3], 7, "k") for r in rows], "doc_id long, source string, text string, size int, key string")
    got = result(mixing.mix(df))
    assert [x[:3] for x in got] == [x[:3] for x in plain_mix(rows)]
    same([x for x in got if x[0] is not None], [x for x in plain_mix(rows) if x[0] is not None])


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted((r["target"], r["taken"]) for r in mixing.mix(blank).collect()) == [(0.0, 0)] * 2


def test_quality_weights_matter(spark):
    rows = [(i, "a", "w w", 9.0 if i % 2 else 0.1) for i in range(400)] + [(1000 + i, "b", "w " * 400, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, q double")
    taken = {r["doc_id"]: r["epochs"] for r in mixing.mix(df, quality=F.col("q"), share=0.9, weights=(1.0, 8.0)).collect()}
    good, bad = sum(taken[i] for i in range(1, 400, 2)), sum(taken[i] for i in range(0, 400, 2))
    assert good > 3 * bad > 0 or bad == 0 < good


def test_label_weights(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert {r["id"]: r["weight"] for r in mixing.label_weights(labels).collect()} == {1: 2.0, 2: 0.5, 4: 1.0}


def test_ratings_equal_a_quality_column(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ratings = docs.where("doc_id % 3 > 0").selectExpr("doc_id AS id", "cast(doc_id % 3 as double) AS weight")
    column = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3).otherwise(F.lit(1))
    same(result(mixing.mix(docs, ratings=ratings)), result(mixing.mix(docs, quality=column)))

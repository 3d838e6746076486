"""The hidden Markov model against sums over all state paths, and the contract's base score."""

import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tests.conftest import SMALL
from threadmill.llm import hmm, queries


def model(states=3, classes=6, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def by_paths(m, seq):
    total = 0.0
    for path in product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        total += p
    return total


SEQS = [[0], [1, 2, 3], [5, 5, 5, 5, 0, 1], [2], [4, 3]]


def test_forward_is_exact():
    m = model()
    got = m.log10(np.array([c for s in SEQS for c in s]), np.array([len(s) for s in SEQS]))
    assert got.tolist() == pytest.approx([math.log10(by_paths(m, s)) for s in SEQS])


def test_expected_counts_are_exact():
    m = model()
    flat, lens = np.array([c for s in SEQS for c in s]), np.array([len(s) for s in SEQS])
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    m.expected(flat, np.cumsum(lens) - lens, lens, start, move, emit)
    w_start, w_move, w_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s in SEQS:
        for path in product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            p /= by_paths(m, s)
            w_start[path[0]] += p
            for t, c in enumerate(s):
                w_emit[c, path[t]] += p
                if t:
                    w_move[path[t - 1], path[t]] += p
    assert np.allclose(start, w_start) and np.allclose(move, w_move) and np.allclose(emit, w_emit)


def test_expected_counts_carry_over_borders(monkeypatch):
    monkeypatch.setattr(hmm, "STRETCH", 2)
    test_expected_counts_are_exact()


def test_rounds_see_whole_texts(spark):
    """One start a text, one move a neighbour pair, and the counts of a plain forward-backward pass over each whole text."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in (1500, 700, 3)]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    chunks = hmm.chunked(spark.createDataFrame(list(zip(held, texts)), "doc_id long, text string").coalesce(1), "doc_id", "text", 7, 2)
    m = hmm.Hmm.first(np.full(hmm.CLASSES + 1, 1 / (hmm.CLASSES + 1)), 3)
    m.start = np.array([0.7, 0.2, 0.1])
    start, move, emit, likelihood = hmm._expected(chunks, m, 3)
    plain = 0.0
    w_start, w_move, w_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES + 1, 3))
    for t in texts:
        seq = [hmm.xxhash.xxh64_intdigest(w) & (hmm.CLASSES - 1) for w in t.encode().split()] + [hmm.END]
        e = m.emit[seq]
        f, b, c = np.zeros((len(seq), 3)), np.ones((len(seq), 3)), np.zeros(len(seq))
        for i in range(len(seq)):
            f[i] = (m.start if i == 0 else f[i - 1] @ m.move) * e[i]
            c[i] = f[i].sum()
            f[i] /= c[i]
        plain += np.log(c).sum()
        for i in range(len(seq) - 2, -1, -1):
            b[i] = m.move @ (e[i + 1] * b[i + 1]) / c[i + 1]
            w_move += m.move * np.outer(f[i], e[i + 1] * b[i + 1] / c[i + 1])
        w_start += f[0] * b[0]
        np.add.at(w_emit, seq, f * b)
    assert start.sum() == pytest.approx(3) and move.sum() == pytest.approx(2203)
    assert np.allclose(start, w_start) and np.allclose(move, w_move) and np.allclose(emit, w_emit) and likelihood == pytest.approx(plain)


@pytest.mark.parametrize("parts", [6, 40])
def test_scores_do_not_depend_on_the_split(spark, parts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in hmm.score(docs.coalesce(1)).collect()}
    other = {r["doc_id"]: r["score"] for r in hmm.score(docs.repartition(parts, "text")).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 * max(1, abs(one[k])) for k in one)


def test_the_score_is_a_plain_baum_welch(spark):
    """The whole query against loops over single tokens of single texts."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "e"], rng.integers(0, 9), p=[0.4, 0.3, 0.1, 0.1, 0.1]))) for i in range(40)] + [(50, "a zz b")]
    rounds, states = 3, 2
    got = {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=states, rounds=rounds, settled=0.0).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    of = lambda w: hmm.END if w == "</end>" else hmm.xxhash.xxh64_intdigest(w.encode()) & (hmm.CLASSES - 1)
    weight = np.ones(hmm.CLASSES + 1)  # of a class: counts, one more for each known word, one for the unseen
    for w, c in count.items():
        weight[of(w)] += c + (w != "</end>")
    share = weight / weight.sum()
    m = hmm.Hmm.first(share, states)
    start, move, emit = m.start, m.move, m.emit
    for _ in range(rounds):
        n_start, n_move, n_emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(emit)
        for d, t in rows:
            if held(d):
                continue
            e = [emit[of(w)] for w in tokens(t)]
            f = [start * e[0]]
            for x in e[1:]:
                f.append((f[-1] @ move) * x)
            b = [np.ones(states)]
            for x in e[:0:-1]:
                b.insert(0, move @ (x * b[0]))
            z = f[-1].sum()
            n_start += f[0] * b[0] / z
            for i, w in enumerate(tokens(t)):
                n_emit[of(w)] += f[i] * b[i] / z
                if i:
                    n_move += np.outer(f[i - 1], e[i] * b[i]) * move / z
        n_start, n_move, n_emit = n_start + hmm.EVEN, n_move + hmm.EVEN, n_emit + hmm.KEEP * share[:, None]
        start, move, emit = n_start / n_start.sum(), n_move / n_move.sum(axis=1, keepdims=True), n_emit / n_emit.sum(axis=0)
    for d, t in rows:
        a, log = start, 0.0
        for i, w in enumerate(tokens(t)):
            a = (a @ move if i else a) * emit[of(w)]
            log += math.log10((count[w] + 1) / weight[of(w)]) if w != "</end>" else 0.0
        assert got[d] == pytest.approx(log + math.log10(a.sum()), abs=1e-8)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</end>"]


def check_base(got, rows):
    counts, held = Counter(), lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for d, t in rows:
        if not held(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        own = tokens(t)
        want.append((d, held(d), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    key = lambda r: repr((*r[:5], round(r[5], 6)))
    assert sorted(map(key, (tuple(r)[:6] for r in got))) == sorted(map(key, want))
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got)


def test_query_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op9_lm_scoring(spark, SMALL).collect()
    check_base(got, rows)
    train = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in train) > sum(r["base_score"] for r in train)


def test_states_help_on_held_out_texts(spark):
    data = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    four = sum(r["score"] for r in hmm.score(docs).collect() if r["held_out"])
    held = [r for r in hmm.score(docs, states=1).collect() if r["held_out"]]
    assert four > sum(r["score"] for r in held)
    assert four > sum(r["base_score"] for r in held)


def test_model_is_a_distribution(spark):
    """The probabilities of all texts of one word, of seen and unseen words, and of the empty text, add up with the rest to 1 at most."""
    rows = [(i, t) for i, t in enumerate(["a b a", "b", "", "a c"] * 4)]
    some = [(100 + i, w) for i, w in enumerate(["", "a", "b", "c", "never"])]
    held = [(d, t) for d, t in some]
    df = spark.createDataFrame(rows + held, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in hmm.score(df).collect()}
    assert sum(10 ** got[100 + i] for i in range(5)) < 1


def test_odd_rows(spark):
    rows = [(None, "the end"), (None, "the end"), (1, None), (2, ""), (3, " \n"), (4, "A a \x1c é É"), (5, "w x " * 30_000), (12, "unseen only here"), (12, "unseen only here")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = hmm.score(df).collect()
    assert len(got) == len(rows)
    check_base(got, rows)


def test_nothing_to_learn_from(spark):
    assert hmm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    rows = [(d, "a b") for d in held]
    check_base(hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)

"""Set-based operators against direct loops on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from threadmill.operators import encode as X
from threadmill.operators import model as M
from threadmill.operators import sentences as S
from threadmill.operators import vocab as D


def merge_loop(lens, min_length):
    """Direct simulation of the short-sentence merge on lengths."""
    groups = [[n, i, i] for i, n in enumerate(lens)]
    while True:
        short = [k for k, g in enumerate(groups) if g[0] < min_length]
        if not short:
            return groups
        k, m = short[0], len(groups)
        if m == 1:
            return []
        if 0 < k < m - 1:
            if groups[k - 1][0] < groups[k + 1][0]:
                a, b = k - 1, k
            else:
                a, b = k, k + 1
        elif k == m - 1:
            a, b = k - 1, k
        else:
            a, b = k, k + 1
        groups[a:b + 1] = [[groups[a][0] + groups[b][0], groups[a][1], groups[b][2]]]


def test_merge_plan_matches_loop(spark):
    rnd = random.Random(5)
    cases = [[rnd.randint(0, 14) for _ in range(rnd.randint(0, 9))] for _ in range(400)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<int>")
    got = df.select("i", S.merge_plan(F.col("l"), 10).alias("p")).orderBy("i").collect()
    for r, c in zip(got, cases):
        assert [[x["n"], x["first"], x["last"]] for x in r["p"]] == merge_loop(c, 10)


def trunc_loop(a, b, target, tie_first):
    while a + b > target:
        if a > b or (a == b and tie_first):
            a -= 1
        else:
            b -= 1
    return a, b


def test_truncation_closed_forms(spark):
    cases = [(a, b) for a in range(0, 80, 3) for b in range(0, 80, 4)]
    df = spark.createDataFrame(cases, "la int, lb int").select(
        "la", "lb", F.array_repeat(F.lit("t"), F.col("la")).alias("A"), F.array_repeat(F.lit("t"), F.col("lb")).alias("B"))
    a, b = X.truncate_pair("A", "B")
    t, x = X.truncate_topic_pair("A", "B")
    for r in df.select("la", "lb", F.size(a).alias("a"), F.size(b).alias("b"), F.size(t).alias("t"), F.size(x).alias("x")).collect():
        assert (r["a"], r["b"]) == trunc_loop(r["la"], r["lb"], 61, tie_first=False)
        assert (r["t"], r["x"]) == trunc_loop(r["la"], r["lb"], 61, tie_first=True)


def greedy(word, vocab, max_chars=100):
    if len(word) > max_chars:
        return ["[UNK]"]
    out, start = [], 0
    while start < len(word):
        end = len(word)
        piece = None
        while end > start:
            cand = word[start:end] if start == 0 else "##" + word[start:end]
            if cand in vocab:
                piece = cand
                break
            end -= 1
        if piece is None:
            return ["[UNK]"]
        out.append(piece)
        start = end
    return out


def test_wordpiece_matches_greedy_loop(spark):
    rnd = random.Random(9)
    letters = "abcde"
    vocab = ["[PAD]", "[UNK]"] + list("abcd") + ["##" + c for c in "abcd"] + ["ab", "abc", "##bc", "##cd", "dd", "##aa", "bca"]
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(500)})
    v = spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "token string, id int")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = {r["word"]: r["pieces"] for r in D.wordpiece_table(w, v).collect()}
    vs = set(vocab)
    for x in words:
        assert got[x] == greedy(x, vs), x


def repair_loop(tokens):
    names = {"rt": "[RT]", "men": "[MEN]", "tag": "[TAG]"}
    i = 0
    while i + 2 < len(tokens) + 0 and i <= len(tokens) - 3:
        if tokens[i] == "[" and tokens[i + 2] == "]" and tokens[i + 1] in names:
            tokens = tokens[:i] + [names[tokens[i + 1]]] + tokens[i + 3:]
            i = 0
            continue
        i += 1
    return tokens


def test_repair_matches_loop(spark):
    rnd = random.Random(2)
    pool = ["[", "]", "rt", "men", "tag", "url", "x"]
    cases = [[rnd.choice(pool) for _ in range(rnd.randint(0, 10))] for _ in range(500)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<string>")
    got = df.select("i", D.repair_specials(F.col("t")).alias("r")).orderBy("i").collect()
    for r, c in zip(got, cases):
        assert r["r"] == repair_loop(list(c))


def merges_loop(counts, min_frequency, alphabet):
    """Greedy merges, one at a time, on plain lists."""
    words = [([c if i == 0 else "##" + c for i, c in enumerate(w)], n) for w, n in counts]
    words = [([s if s[-1] in alphabet else None for s in w], n) for w, n in words]
    out = []
    while True:
        pairs = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                if None not in p:
                    pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            return out
        (l, r), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < min_frequency:
            return out
        piece = l + (r[2:] if r.startswith("##") else r)
        out.append((l, r, piece, n))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == (l, r):
                    w[i : i + 2] = [piece]
                i += 1


@pytest.mark.parametrize("letters, n, limit, budget", [
    ("abc", 25, 1000, 400_000), ("abc", 25, 1000, 60), ("abcdef", 40, 1000, 60), ("aab", 12, 1000, 8), ("abcdefg", 30, 3, 400_000), ("abcdefg", 30, 3, 20)])
def test_learn_merges_matches_loop(spark, letters, n, limit, budget):
    rnd = random.Random(len(letters) + n)
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))): rnd.randint(1, 30) for _ in range(n)}
    df = spark.createDataFrame(list(counts.items()), "word string, count long")
    weight = {}
    for w, k in counts.items():
        for c in w:
            weight[c] = weight.get(c, 0) + k
    alphabet = sorted(weight, key=lambda c: (-weight[c], c))[:limit]
    got = [tuple(r)[1:] for r in D.learn_merges(df, limit_alphabet=limit, budget=budget).orderBy("rank").collect()]
    assert got == merges_loop(list(counts.items()), 2, set(alphabet))


def test_pairs_outside_the_alphabet_do_not_end_the_merges(spark):
    df = spark.createDataFrame([("bc", 9), ("de", 8), ("fg", 7), ("hi", 6), ("jk", 6), ("aa", 5), ("a", 1000)], "word string, count long")
    (r,) = D.learn_merges(df, limit_alphabet=1, budget=4).collect()
    assert tuple(r) == (1, "a", "##a", "aa", 5)


def test_merges_over_a_large_alphabet(spark):
    """More characters than the frequency vocabulary has room for still give merges, and the vocabulary is dense."""
    rnd = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(500)]
    counts = {"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 4))): rnd.randint(1, 9) for _ in range(600)}
    df = spark.createDataFrame(list(counts.items()), "word string, count long")
    merges = D.learn_merges(df, budget=900)
    got = [tuple(r)[1:] for r in merges.orderBy("rank").collect()]
    assert got == merges_loop(list(counts.items()), 2, set(letters)) and len(got) > 100
    vocab = [r["id"] for r in D.build_vocab(df, merges).orderBy("id").collect()]
    assert vocab == list(range(len(vocab))) and len(vocab) == 9 + 2 * len({c for w in counts for c in w}) + len({g[2] for g in got})


def test_small_vocabulary_holds_words(spark):
    df = spark.createDataFrame([("w" + "abcdefghij"[i % 10] * (i // 10 + 1), 50) for i in range(50)], "word string, count long")
    v = D.vocab_by_frequency(df, vocab_size=60)
    tokens = [r["token"] for r in v.orderBy("id").collect()]
    assert len(tokens) == 60 and [r["id"] for r in v.orderBy("id").collect()] == list(range(60))
    assert sum(t.startswith("w") and len(t) > 1 for t in tokens) == 60 - 9 - 2 * 11


def test_merge_of_a_very_long_document(spark):
    n = 100_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_repeat(F.lit("t"), (i % 13).cast("int"))).alias("s"))
    (r,) = df.select(F.size(S.merge_short_sentences(F.col("s"), 10)).alias("n")).collect()
    assert r["n"] == len(merge_linear([i % 13 for i in range(n)], 10))


def merge_linear(lens, min_length):
    """Sizes after merging, with one list of the sentences before the first short one."""
    done, rest = [], list(reversed(lens))
    while rest:
        cur = rest.pop()
        if cur >= min_length:
            done.append(cur)
        elif not rest:
            if done:
                done[-1] += cur
        elif done and done[-1] < rest[-1]:
            done[-1] += cur
        else:
            rest[-1] += cur
    return done


def test_linear_reference_is_the_loop():
    rnd = random.Random(8)
    for _ in range(500):
        c = [rnd.randint(0, 14) for _ in range(rnd.randint(0, 9))]
        assert merge_linear(c, 10) == [g[0] for g in merge_loop(c, 10)]


def test_softmax_of_many_classes(spark):
    import math

    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: (i % 7).cast("double")).alias("s"))
    (r,) = df.select(M.softmax_scores("s").alias("p")).collect()
    total = sum(math.exp(i % 7 - 6) for i in range(5000))
    assert abs(sum(r["p"]) - 1) < 1e-9 and abs(r["p"][6] - 1 / total) < 1e-12

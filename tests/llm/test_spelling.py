"""Operator 12 against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from threadmill.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def vocabulary(seed, n, letters="abé𐍈", lengths=(6, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)}
    return {w: int(5 * 8 ** rng.uniform(0, 5)) for w in words}


@pytest.mark.parametrize("tile", [2048, 16])
@pytest.mark.parametrize("lengths", [(6, 9), (1, 4)])
def test_near_words_forms_and_roots(spark, monkeypatch, tile, lengths):
    monkeypatch.setattr(spelling, "TILE", tile)
    counts = vocabulary(tile + lengths[0], 260, lengths=lengths)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.variants(words.repartition(5)).collect()
    assert len(rows) == len(counts) and {tuple(r) for r in rows} == plain(counts)


def test_every_link_comes_once_each_way(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 32)
    counts = vocabulary(3, 200, "ab", (5, 8))
    pairs = [(r["word"], r["near"]) for r in spelling.links(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counts for b in counts if one_edit(a, b)}


def test_very_long_words_have_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_LETTERS", 5000)
    base = "ab" * 1000
    counts = {base: 500, base[:-1]: 50, base + "x": 40, "x" + base[1:]: 60, base[:900] + base[901:]: 5, "short": 9}
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in rows} == plain(counts)


def test_words_of_documents(spark):
    rng = random.Random(1)
    stems = ["Winter", "SOMMER", "Éventail", "naïveté", "harvest", "tiny"]
    docs = [(i if i % 11 else None, " ".join(rng.choice(stems) for _ in range(60)) + ("," if i % 2 else "9")) for i in range(120)]
    docs += [(500, None), (501, ""), (7, docs[7][1]), (502, "y" * 30_000)]
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    due = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert any(w not in {"winter", "sommer", "Éventail", "naïveté", "harvest"} for w in due)  # some are spoilt
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert {r["word"]: r["n"] for r in spelling.noisy_words(df).collect()} == due
    assert {tuple(r) for r in spelling.variants(spelling.noisy_words(df)).collect()} == plain(due)


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.noisy_words(empty)).collect() == []

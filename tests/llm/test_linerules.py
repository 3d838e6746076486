"""Operator 13 against a plain count."""

import random
import re
from collections import Counter, defaultdict

from threadmill.llm import linerules

SCHEMA = "doc_id long, text string, source string, host string, kept int"
SPLIT = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPLIT, text) if w]


def norm(line):
    return " ".join(words_of(line.lower()))


def plain(docs, max_docs, max_lost=50):
    seen = defaultdict(set)
    for i, text, source, *_ in docs:
        for line in (text or "").split("\n"):
            if norm(line):
                seen[source, norm(line)].add(i if i is not None else ("none", text))
    out = []
    for i, text, source, *_ in docs:
        text = text or ""
        w = words_of(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        gone = [len(seen[source, norm(x)]) > max_docs if norm(x) else False for x in text.split("\n")]
        lost = sum(len(words_of(x)) for x, g in zip(text.split("\n"), gone) if g)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and 100 * lost <= max_lost * len(w)
        clean = "\n".join(x for x, g in zip(text.split("\n"), gone) if not g) if kept else None
        out.append((i, source, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, lost, kept, clean))
    return sorted(out, key=repr)


def check(spark, docs, max_docs):
    rows = linerules.judge(spark.createDataFrame(docs, SCHEMA).repartition(3), max_docs=max_docs).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == plain(docs, max_docs)
    return rows


def corpus():
    rng = random.Random(5)
    common = ["Subscribe to our\tletter  now", "  ALL rights Reserved €", "menu # home $", "x"]
    docs = []
    for i in range(60):
        own = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 6))]
        lines = own + rng.sample(common, rng.randint(0, 4)) * rng.randint(1, 2)
        rng.shuffle(lines)
        docs.append((i, "\n".join(x.upper() if rng.random() < 0.3 else x for x in lines), rng.choice(["a", "b", None]), "h", 1))
    docs += [(100, None, "a", None, 0), (101, "", "a", "h", 0), (102, "\n \n\t\n", None, "h", 0), (None, docs[3][1], "a", "h", 1), (None, docs[3][1], "a", "h", 1)]
    docs += [docs[7], docs[7], (103, "one two three " * 40, "b", "h", 1), (104, "a b c a b c " + " ".join(map(str, range(60))), "b", "h", 1), (105, "q r\r\nq r\n", "b", "h", 1)]
    shared = " ".join(f"s{i}" for i in range(60))
    docs += [(200 + i, f"{shared}\n{' '.join(f'v{i}x{j}' for j in range(5 * i))}", "b", "h", 1) for i in range(14)]
    return docs


def test_counts_verdicts_and_clean_texts(spark):
    rows = check(spark, corpus(), 8)
    assert any(r["lost_words"] and r["kept"] for r in rows) and any(not r["kept"] and not r["base_failed"] for r in rows)


def test_lines_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linerules, "HOT_LINES", 2)
    check(spark, corpus(), 2)


def test_overlapping_windows_and_long_texts(spark):
    docs = [(1, "a a a a", "s", None, 1), (2, "a b a b a", "s", None, 1), (3, "a b c d", "s", None, 1), (4, "a b c x a b c b c y", "s", None, 1), (5, "lorem ipsum dolor " * 20_000, "s", None, 1)]
    check(spark, docs, 20)


def test_no_rows(spark):
    assert check(spark, [], 20) == []

"""Operator 11 against a plain count over all orders."""

from itertools import permutations

from pyspark.sql import functions as F

from threadmill.llm import filteraudit

DOCS = "doc_id long, text string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    return out


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source, *_ in docs:
        f = fails(text or "")
        if i is not None and i > least[text or ""]:
            f.add("E")
        rows.append((source or "", f, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        mine = {}
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in rows if r[0] == part]
                removed = [r for r in here if letter in r[1] and not r[1] & before]
                shapley[letter] += len(removed)
                mine[("".join(order), step)] = (
                    sum(not r[1] & (before | {letter}) for r in here), len(removed), sum(letter in r[1] and bool(r[1] & before) for r in here),
                    sum(r[1] == {letter} for r in here), sum(r[2] for r in removed), sum(r[3] for r in removed), letter,
                )
        for (order, step), v in mine.items():
            out[part, order, step] = (*v[:6], shapley[v[6]])
    return out


def found(spark, docs, labels):
    cells = filteraudit.mask_cells(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    rows = filteraudit.audit(cells).collect()
    assert len(rows) == len({(r["part"], r["filter_order"], r["step"]) for r in rows})
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


LONG = " ".join(f"w{i}" for i in range(250))


def test_all_orders_with_nulls_copies_and_repeated_rows(spark):
    docs = [
        (1, LONG, "a", "x", 1), (2, LONG, "a", "x", 1), (3, LONG, "b", None, 2), (4, LONG + " $", "b", "x", 1), (5, "A b", "a", "x", 1), (6, None, None, "x", 1),
        (7, "", "", "x", 1), (None, LONG, "a", "x", 1), (None, LONG, "b", "x", 1), (8, "the " * 400, "a", "x", 1), (8, "the " * 400, "a", "x", 1),
        (9, "the " * 400, "b", "x", 1), (10, "THE " * 400 + "#", "b", "x", 1), (1, LONG, "b", "x", 1), (0, "ÄÖ", "a", "x", 1),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (4, 1, 1), (5, 0, 1), (None, 1, 1), (8, 1, None), (99, 1, 1)]
    assert found(spark, docs, labels) == plain(docs, labels)


def test_an_empty_table_and_no_labels(spark):
    assert found(spark, [], []) == {}
    docs = [(1, "x", None, "p", 0)]
    assert found(spark, docs, []) == plain(docs, [])


def test_copies_collapse_before_they_meet(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(LONG).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    cells = {(r["part"], r["mask"]): r["n"] for r in filteraudit.mask_cells(docs, spark.createDataFrame([], LABELS)).collect()}
    assert cells == {("s0", 0): 1, ("s0", 16): 999, ("s1", 16): 1000, ("s2", 16): 1000}

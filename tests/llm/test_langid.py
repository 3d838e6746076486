"""Language identification: held-out accuracy, proper distributions, defined cases."""

import math
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL
from threadmill.llm import langid, queries

DATA = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{DATA}/documents.parquet"), per_language=60)


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, DATA).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 350
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["rejected"] for r in got)


def test_probabilities_sum_to_one(spark):
    docs = [("en", "the cat and the hat"), ("en", "a hat"), ("fr", "le chat et la tête")] * 3
    model = langid.Identifier.fit(docs, 3)
    letters = sorted({c for _, t in docs for c in t if c != " "})
    for context in ["t", "th", "xq", "at"]:
        places, kept = model.log2([context + c for c in letters] + [context])
        ends = np.cumsum(kept)
        after = sum(np.exp2(places[e - 2]) for e in ends[: len(letters)]) + np.exp2(places[ends[-1] - 1])  # letters, and the end of the word
        assert after.tolist() == pytest.approx([1.0, 1.0])


def test_defined_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 -- ①"), (4, "the and of"), (None, "the and of"), (5, "xqzt vvkp qqxj wzzk jxqv " * 40), (6, "the and that with " * 20_000), (7, "ß́")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] == got[None]["lang_pred"] == got[6]["lang_pred"] == "en"
    assert got[5]["rejected"] and not got[6]["rejected"]
    assert langid.identify(df.limit(0), model).count() == 0


def test_no_training_rows(spark):
    df = spark.createDataFrame([(None, "the and", "en"), (1, "the", None), (2, None, "en")], "doc_id long, text string, lang string")
    none = langid.train(df)
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(df, none).collect()] == [("und", 0.0, True)] * 3


def test_sample_is_bounded_and_repeats(spark):
    df = spark.createDataFrame([(1, "the end", "en")] * 50 + [(i, "das ende", "de") for i in range(100, 150)], "doc_id long, text string, lang string")
    a, b = langid.train(df, per_language=10), langid.train(df.repartition(7), per_language=10)
    assert a.languages == b.languages
    assert all((x[1] == y[1]).all() for x, y in zip(a.grams, b.grams))


def test_sample_is_read_by_all_tasks_at_once(spark):
    """Neither jobs nor rows at the driver grow with the partitions."""
    rows = [(i, f"der tag und die nacht {i}", "de") for i in range(400)]
    jobs = []
    for parts in (2, 40):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        spark.sparkContext.setJobGroup(f"sample-{parts}", "")
        langid.train(df, per_language=20)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sample-{parts}")))
    spark.sparkContext.setJobGroup("tests", "")
    assert 0 < jobs[1] <= jobs[0] + 2


def test_sample_is_bounded_in_characters(spark):
    rows = [(i, "das ende " * 100, "de") for i in range(50)] + [(100, "zu lang " * 5000, "de"), (101, "the end", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_ = langid.train(df, most_chars=3000), langid.train(df)
    assert few.languages == all_.languages == ["de", "en"] and len(few.grams) and len(all_.learn(["zu"])[0])


def test_a_plain_kneser_ney(spark):
    """The probability of each sign against counts and continuation counts taken straight from the definition."""
    from collections import defaultdict

    words = Counter({"banana": 3, "bandana": 2, "an": 5, "cab": 1})
    order, letters = 3, 26
    model = langid.Identifier.of(["x"], [langid.KneserNey(words, order, letters)], np.zeros((1, 3)))
    pad, end = chr(langid.START), chr(langid.END)
    full = Counter()
    for w, n in words.items():
        s = pad * (order - 1) + w + end
        for i in range(order - 1, len(s)):
            full[s[i - order + 1 : i + 1]] += n
    levels = {order: full}
    for m in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in levels[m + 1]:
            before[g[1:]].add(g[0])
        levels[m] = Counter({g: len(b) for g, b in before.items()})

    def p(context, sign):
        m = len(context) + 1
        lower = p(context[1:], sign) if context else 1 / (letters + 1)
        own = {g: n for g, n in levels[m].items() if g[:-1] == context}
        total = sum(own.values())
        if not total:
            return lower
        return max(own.get(context + sign, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(own) / total * lower

    for w in ("banana", "cabana", "zzz", "a"):
        s = pad * (order - 1) + w + end
        due = sum(math.log2(p(s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s)))
        got = model.learn([w])[0].reshape(1, -1)[0, 0]
        assert got == pytest.approx(due, rel=1e-5)


def test_lang_is_no_input(spark, model):
    df = spark.createDataFrame([(1, "the and of that", "de"), (2, "the and of that", None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()} == {("en", langid.identify(df, model).first()["score"])}


def test_unlearnt_language_is_rejected(spark):
    """Whole texts of a language that was not learnt, and with a many-character language among the learnt ones also random letters."""
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    draw = np.random.default_rng(9)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    many = [("zh", " ".join("".join(draw.choice(signs, 8)) for _ in range(100))) for _ in range(60)]
    for out in ("de", "fr"):
        learnt = [r for lang in sorted({lang for lang, _ in rows} - {out}) for r in [x for x in rows if x[0] == lang][:60]]
        own = [t for lang in {lang for lang, _ in learnt} for t in [x for name, x in rows if name == lang][60:80]]
        foreign = [t for lang, t in rows if lang == out][:60]
        for sample in (learnt, learnt + many):
            one = langid.Identifier.fit(sample)
            assert one.judge(foreign)[2].mean() > 0.95
            assert one.judge(own)[2].mean() < 0.02
            rubbish = [" ".join("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(50)) for _ in range(20)]
            assert one.judge(rubbish)[2].all()

"""Simple texts give the same tokens in one pass as all steps of the normalisation give."""

import random

import pytest
from pyspark.sql import functions as F

from threadmill.functions import tokens as T

ALPHABET = [*"abzAZ059 \t\n\r.,:;()[]{}$+<=>^`|~_'\"#@-/\\!?&%*", *"éÉñßÅøÆœŸĳŉſıİ¡§«¶·»¿¨¯´¸ªº²×÷­ ", *"‐–—‘’“”…‧ ​€", *"\x00\x0b\x0c\x1f\x7f\x85�́",
            *"中가日😀ΣǅKÅ;", "[MASK]", "[UNK]", "[mask]", "[SEP", "CLS]", "[PAD]"]


@pytest.mark.parametrize("lower, accents, cjk", [(False, False, False), (True, True, True), (True, False, False), (False, True, True)])
def test_simple_texts_keep_their_tokens(spark, monkeypatch, lower, accents, cjk):
    draw = random.Random(7)
    texts = [None, "", " ", *ALPHABET, *(f"a{x}b" for x in ALPHABET), *(chr(c) for c in range(1, 0x3000))]
    texts += ["".join(draw.choices(ALPHABET[: draw.choice([20, 40, 60, len(ALPHABET)])], k=draw.randrange(1, 40))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    fast = {r["i"]: r["w"] for r in df.select("i", T.pretokenize(F.col("t"), lower, accents, cjk).alias("w")).collect()}
    monkeypatch.setattr(T, "is_simple", lambda text: F.lit(False))
    slow = {r["i"]: r["w"] for r in df.select("i", T.pretokenize(F.col("t"), lower, accents, cjk).alias("w")).collect()}
    assert [(t, fast[i], slow[i]) for i, t in enumerate(texts) if fast[i] != slow[i]] == []


def test_which_texts_are_simple(spark):
    texts = {"Plain text, 1 (one) [URL]\n\tend": True, "déjà vu – “quoted”": True, "": True, "a [MASK] b": False, "a b": False, "İ": False, "中": False, "a\x00b": False}
    df = spark.createDataFrame(list(texts.items()), "t string, want boolean")
    assert [r["t"] for r in df.where(T.is_simple(F.col("t")) != F.col("want")).collect()] == []


def test_links_as_without_the_look_ahead(spark):
    from threadmill.functions import patterns as P
    from threadmill.operators import clean as C

    texts = ["see https://www.ab.com/p?q=1 now", "xhttp://w.co/x", "www.a.bc www.abc.de/f", "http:/no https://www ww.w", "wwww.abc.de hhttps://ab-c.org", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(C.mask_urls("t").alias("a"), F.regexp_replace("t", P.URL_PATTERN, P.URL_TOKEN).alias("b")).collect():
        assert r["a"] == r["b"]

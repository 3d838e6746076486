"""Sentences and sentence pairs (F1-F8)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import hashing as H
from threadmill.functions.ranking import hash_rank
from threadmill.session import materialize, written

SENT_T = "array<array<string>>"


def split_sentences(df: DataFrame, key_cols, text: str, delims=(".",)) -> DataFrame:
    """for every delimiter separately, the non-empty pieces of every
    non-null text: (keys, delim, sidx, piece). With several delimiters a
    document appears once per delimiter, each a segmentation of its own."""
    keys = list(key_cols)
    ds = F.array(*[F.struct(F.lit(d).alias("delim"), F.lit(re.escape(d)).alias("pat")) for d in delims])
    d = df.where(F.col(text).isNotNull()).select(*keys, F.explode(ds).alias("_d"), F.col(text).alias("_t"))
    d = d.select(*keys, F.col("_d.delim").alias("delim"),
                 F.filter(F.split(F.col("_t"), F.col("_d.pat"), -1), lambda x: F.length(x) > 0).alias("_p"))
    return d.select(*keys, "delim", F.posexplode("_p").alias("sidx", "piece"))


def merge_plan(lengths: Column, min_length: int) -> Column:
    """F3 on lengths only: array<struct<n,first,last>> of the final sentences
    as ranges of the original ones. The first sentence shorter than
    ``min_length`` is merged until none is short: a middle one joins the strictly shorter previous one, else
    the next; the last joins the previous, the first the next; a lone short
    sentence empties the document.

    Everything before the first short sentence is final but for its last
    member, so one pass with a stack does it, linear in the sentences; Spark's
    array functions would copy the array at each step, so the pass over the lengths is an Arrow
    helper on the batch's flat lengths: a document without a short sentence is copied as a slice, only the
    others are walked. Texts never leave the JVM for it. A null document has no sentence, a null length is 0."""

    def plans(docs: pa.Array) -> pa.Array:
        size = pc.fill_null(docs.values, 0).to_numpy(zero_copy_only=False).astype(np.int32)
        n, first, last, ends = _plans(docs.offsets.to_numpy(), size, min_length)
        merged = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (n, first, last)], ["n", "first", "last"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), merged)

    return _once(F.arrow_udf(plans, "array<struct<n:int,first:int,last:int>>"))(F.coalesce(lengths, F.array().cast("array<int>")))


def _once(udf):
    """Not to be copied: a filter on the sentences would otherwise be pushed below them, and with it, into every
    element, all that makes them."""
    return udf.asNondeterministic()


def _plans(offsets, size, min_length: int) -> tuple[list, list, list, list]:
    """Flat sizes of all sentences and where each document starts -> sizes, first and last places of the merged ones, and where each document starts in these."""
    shorts = np.concatenate([[0], np.cumsum(size < min_length)])
    has_short = (shorts[offsets[1:]] > shorts[offsets[:-1]]).tolist()
    n, first, last, ends = [], [], [], [0]
    for start, stop, short in zip(offsets[:-1].tolist(), offsets[1:].tolist(), has_short):
        sizes = size[start:stop].tolist()
        if short:
            _merge(sizes, min_length, n, first, last)
        else:
            n += sizes
            first += range(len(sizes))
            last += range(len(sizes))
        ends.append(len(n))
    return n, first, last, ends


def _merge(sizes: list[int], min_length: int, n: list[int], first: list[int], last: list[int]) -> None:
    """Append the merged sentences of one document to the flat lists."""
    base = len(n)
    held, since = None, 0  # size and start of a short sentence that waits for the next
    for i, size in enumerate(sizes):
        start = i
        if held is not None:
            if len(n) > base and n[-1] < size:
                n[-1] += held
                last[-1] = i - 1
            else:
                size, start = held + size, since
            held = None
        if size < min_length:
            held, since = size, start
        else:
            n.append(size)
            first.append(start)
            last.append(i)
    if held is not None and len(n) > base:
        n[-1] += held
        last[-1] = len(sizes) - 1


def merge_short_sentences(sentences: Column, min_length: int = 10) -> Column:
    """sentences (array<array<token>>) -> merged sentences."""
    plan = merge_plan(F.transform(sentences, lambda s: F.size(s)), min_length)
    return F.transform(plan, lambda r: F.flatten(F.slice(sentences, r["first"] + 1, r["last"] - r["first"] + 1)))


def merge_packed(sentences: Column, min_length: int = 10) -> Column:
    """F3 on packed sentences (``pack``): array<string> -> the merged ones. A null is a sentence without tokens."""

    def merged(docs: pa.Array) -> pa.Array:
        offsets = docs.offsets.to_numpy()
        texts = pc.fill_null(docs.values, "")
        some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        size = (pc.count_substring(texts, " ").to_numpy() + some).astype(np.int32)
        _, first, last, ends = _plans(offsets, size, min_length)
        made = np.diff(ends)
        start = np.repeat(offsets[:-1].astype(np.int64), made)
        first, last = start + np.array(first, np.int64), start + np.array(last, np.int64)
        # the merged sentences follow each other but for documents that have none left, whose texts go
        kept = np.zeros(len(some) + 1, np.int64)
        np.add.at(kept, first, 1)
        np.add.at(kept, last + 1, -1)
        kept = (np.cumsum(kept[:-1]) > 0) & some
        before = np.concatenate([[0], np.cumsum(kept)])
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([before[first], [before[-1]]]), pa.int32()), texts.filter(pa.array(kept)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.binary_join(members, " "))

    return _once(F.arrow_udf(merged, "array<string>"))(F.coalesce(sentences, F.array().cast("array<string>")))


def documents_of_sentences(tokens: DataFrame, key_cols, tokens_col: str = "tokens", min_length: int = 10, tokenize=None, cut=None, mend=None, packed: bool = False) -> DataFrame:
    """Pieces (keys, delim, sidx, tokens) -> one row per (keys, delim) with the merged sentence list ``sentences``.
    ``tokenize`` makes the tokens of a piece after the pieces have met (texts are far smaller than their tokens), ``cut``
    those of all pieces of a document, which ``mend`` mends. ``packed``: the tokens of a piece are one string (``pack``), and so are the sentences."""
    keys = list(key_cols) + ["delim"]
    g = tokens.groupBy(*keys).agg(F.collect_list(F.struct("sidx", F.col(tokens_col).alias("t"))).alias("_s"))
    made = F.transform("_s", lambda s: F.struct(s["sidx"].alias("sidx"), tokenize(s["t"]).alias("t"))) if tokenize else F.col("_s")
    g = g.select(*keys, F.array_sort(made).alias("_s"))
    raw = F.col("_s.t")
    g = g.select(*keys, (cut(raw) if cut else raw).alias("_raw"))
    g = g.select(*keys, mend(F.col("_raw")).alias("_raw")) if mend else g
    return g.select(*keys, (merge_packed if packed else merge_short_sentences)(F.col("_raw"), min_length).alias("sentences"))


def flatten_sentences(docs: DataFrame, key_cols) -> DataFrame:
    """one row per sentence (keys, delim, sno, sentence)."""
    keys = list(key_cols) + ["delim"]
    return docs.select(*keys, F.posexplode("sentences").alias("sno", "sentence"))


def min_two_sentences(docs: DataFrame) -> DataFrame:
    """F5."""
    return docs.where(F.size("sentences") > 1)


def adjacent_pairs(docs: DataFrame, key_cols) -> DataFrame:
    """every consecutive pair (A, B), y = 1. No shuffle: built in-row."""
    keys = list(key_cols) + ["delim"]
    pairs = F.transform(F.sequence(F.lit(1), F.size("sentences") - 1),
                        lambda i: F.struct(i.alias("pno"), F.element_at("sentences", i).alias("A"), F.element_at("sentences", i + 1).alias("B")))
    return min_two_sentences(docs).select(*keys, F.explode(pairs).alias("_p")).select(
        *keys, "_p.pno", "_p.A", "_p.B", F.lit(1).alias("y"))


def _document_index(docs: DataFrame, keys: list[str], seed) -> DataFrame:
    """Keys, number of sentences ``n`` and dense index ``doc_idx`` 1..N in a
    hash order (no single-partition window). Narrow, and written once."""
    o = docs.select(*keys, F.size("sentences").alias("n")).withColumn("_o", H.shuffle_key(*keys, seed=f"docs:{seed}"))
    return materialize(hash_rank(o, "_o", rank_col="doc_idx", tie_cols=keys).select(*keys, "doc_idx", "n"))


def _draws(positives: DataFrame, idx: DataFrame, keys: list[str], seed) -> DataFrame:
    """For each positive the two sentences of its negative, as places only:
    ``a`` and ``b``, structs of a document's keys and a sentence number. No text moves, and what follows
    from the positive's key is made where it is read."""
    n = idx.agg(F.count(F.lit(1))).scalar()
    pk = [*keys, "pno"]
    own = [f"_k_{k}" for k in pk]
    ia = H.hash60(*own, seed=f"a:{seed}") % n + 1
    # a single document has no other: its draws are null and meet nothing
    ib = F.try_mod(H.hash60(*own, seed=f"b:{seed}"), F.lit(n - 1)) + 1
    draws = positives.select(*[F.col(k).alias(f"_k_{k}") for k in pk])
    for side, at in (("a", ia), ("b", F.when(ib >= ia, ib + 1).otherwise(ib))):
        place = F.struct(*keys, (H.hash60(*own, seed=f"s{side}:{seed}") % F.col("n")).cast("int").alias("sno")).alias(side)
        draws = draws.withColumn("_i", at).join(idx.withColumnRenamed("doc_idx", "_i"), "_i").select(*draws.columns, place)
    return draws.select(*[F.col(f"_k_{k}").alias(k) for k in pk], "a", "b")


def pack(sentence: Column) -> Column:
    """A sentence as one string of its tokens (which hold no blank): a quarter of the bytes of an array. What only moves sentences, such as ``pair_dataset``, takes them packed."""
    return F.array_join(sentence, " ")


def unpack(sentence) -> Column:
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ", -1))


def _fetch(asked: DataFrame, docs: DataFrame, keys: list[str], snos: dict[str, str]) -> DataFrame:
    """``asked``: a document's keys ``_d`` (struct), sentence numbers (the keys of ``snos``) and other columns -> the other columns
    and the sentences, named by the values of ``snos``; a null number gives a null.

    What is asked of a document meets it as one narrow list, so a document moves once, however often it is asked."""
    rest = [c for c in asked.columns if c not in snos and c != "_d"]
    of = asked.groupBy("_d").agg(F.collect_list(F.struct(*rest, *snos)).alias("_asked"))
    # structs are equal if their nulls are, so the lists are where they meet the documents
    met = of.join(docs.select(_at(keys).alias("_d"), "sentences"), "_d")
    given = F.transform("_asked", lambda r: F.struct(*[r[c].alias(c) for c in rest], *[F.get("sentences", r[n]).alias(to) for n, to in snos.items()]))
    return met.select(F.explode(given).alias("_g")).select("_g.*")


def _at(keys: list[str], place: str | None = None) -> Column:
    """The keys of a document, or those of a place, as one struct."""
    return F.struct(*[F.col(f"{place}.{k}" if place else k).alias(k) for k in keys])


def _fetch_pairs(pairs: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of places ``a`` and ``b``, both null for neighbours (number ``pno`` - 1 and ``pno`` of their own document) -> the same rows
    with sentences A and B. Only the B of two documents moves, to the document of its A; all others are taken where they are."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    far = pairs.where(F.col("b").isNotNull()).select(*rest, "a", F.col("b.sno").alias("_no"), _at(keys, "b").alias("_d"))
    far = _fetch(far, docs, keys, {"_no": "_other"}).select(*rest, F.col("a.sno").alias("_no"), F.lit(None).cast("int").alias("_next"), "_other", _at(keys, "a").alias("_d"))
    near = pairs.where(F.col("b").isNull()).select(*rest, (F.col("pno") - 1).cast("int").alias("_no"), F.col("pno").cast("int").alias("_next"),
                                                   F.lit(None).cast(far.schema["_other"].dataType).alias("_other"), _at(keys).alias("_d"))
    found = _fetch(far.unionByName(near), docs, keys, {"_no": "A", "_next": "_near"})
    return found.select(*rest, "A", F.coalesce("_other", "_near").alias("B"))


def negative_pairs(docs: DataFrame, positives: DataFrame, key_cols, seed=42) -> DataFrame:
    """one negative per positive. Document a uniform, document b uniform
    among the others (by list position), one uniform sentence of each; y = 0.

    Draws are hashes of the positive's key, so each negative is a few
    equi-joins on a narrow document index. Never a cross join."""
    keys = list(key_cols) + ["delim"]
    d = min_two_sentences(docs)
    pairs = _fetch_pairs(_draws(positives, _document_index(d, keys, seed), keys, seed), d, keys)
    return pairs.select(*keys, "pno", "A", "B", F.lit(0).alias("y"))


def pair_dataset(docs: DataFrame, key_cols, seed=42) -> DataFrame:
    """F8: positives (F6) and negatives (F7), in a repeatable random order (``rank``).

    Both kinds are drawn and ranked as places of sentences; the sentences are fetched last, so neither the draws nor the
    rank move a text."""
    keys = list(key_cols) + ["delim"]
    d = min_two_sentences(docs)
    idx = _document_index(d, keys, seed)
    pos = idx.select(*keys, F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("pno"))
    draws = _draws(pos, idx, keys, seed).withColumn("y", F.lit(0))
    nowhere = {c: F.lit(None).cast(draws.schema[c].dataType) for c in "ab"}
    both = pos.select(*keys, "pno", *[c.alias(k) for k, c in nowhere.items()], F.lit(1).alias("y")).unionByName(draws)
    # the rank reads its rows twice, the sentences the ranked ones: narrow rows, written once
    both = written(both, "pairs-drawn").withColumn("_o", H.shuffle_key(*keys, "pno", "y", seed=f"pairs:{seed}"))
    ranked = written(hash_rank(both, "_o", rank_col="rank", tie_cols=[*keys, "pno", "y"]).drop("_o"), "pairs-ranked")
    return _fetch_pairs(ranked, d, keys).select(*keys, "pno", "A", "B", "y", "rank")

"""the three encoders, composed from the token and encode operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadmill.functions import patterns as P
from threadmill.operators import encode as X
from threadmill.operators import labels as L
from threadmill.operators import sentences as S
from threadmill.operators import vocab as D
from threadmill.session import written

SEP_ID = P.SPECIAL_TOKENS.index("[SEP]")


CLS_ID = P.SPECIAL_TOKENS.index("[CLS]")


def _finish(d: DataFrame, segments) -> DataFrame:
    d = d.withColumn("input_mask", X.input_mask("ids")).withColumn("segment_ids", segments).withColumn("x", X.pad("ids"))
    return X.check_lengths(d)


def encode_claims(df: DataFrame, vocab: DataFrame, mode: str = "twitter", mapping: DataFrame | None = None,
                  key_cols=("id",)) -> DataFrame:
    """Claim samples: (id, x, y[, topic]) -> (id, tokens, x, input_mask, segment_ids, y).
    ``mode='twitter'`` repairs mask tokens; ``mode='topic'`` encodes the pair
    [CLS] topic [SEP] x [SEP]. Rows without a text are dropped. The label
    mapping is the one of the training split; it is fitted on ``df`` only if
    none is given, and a label that it does not know raises.

    Word pieces carry their ids through repair, truncation and assembly, so
    there is no second lookup."""
    df = df.where(F.col("x").isNotNull())
    mapping = mapping if mapping is not None else L.ordinal_fit(df, "y")
    d = L.ordinal_transform(df, mapping, "y", "y")
    keys = list(key_cols)
    t = D.tokenize(d, keys, "x", vocab, out="xt", ids="xi", repair=(mode == "twitter"))
    if mode == "topic":
        t = D.tokenize(t, keys, "topic", vocab, out="tt", ids="ti")
        (tt, xt), (ti, xi) = X.truncate_topic_pair("tt", "xt"), X.truncate_topic_pair("ti", "xi")
        t = t.withColumn("tokens", X.assemble_pair(tt, xt)).withColumn("ids", X.assemble_pair(ti, xi, CLS_ID, SEP_ID))
        t = t.withColumn("_f", F.size(tt) + 2).withColumn("_s", F.size(xt) + 1)
        seg = X.segment_ids(F.col("_f"), F.col("_s"))
    else:
        t = t.withColumn("tokens", X.assemble_single(X.truncate_single("xt"))).withColumn("ids", X.assemble_single(X.truncate_single("xi"), CLS_ID, SEP_ID))
        seg = X.segment_ids(None)
    out = _finish(t, seg)
    return out.select(*keys, "tokens", "x", "input_mask", "segment_ids", "y")


def sentence_docs(df: DataFrame, key_cols, text: str, vocab: DataFrame, delims=(".",), min_length: int = 10,
                  repair: bool = True) -> DataFrame:
    """(keys, delim, sentences) - split, tokenised, short ones merged.
    A sentence is an array of struct<piece,pid>."""
    keys = list(key_cols)
    # together by key before they are split: one shuffle, of the texts, and none of words or pieces
    pieces = S.split_sentences(df.select(*keys, text).repartition(*keys), keys, text, delims)
    words = D.words_of(pieces, keys + ["delim", "sidx"], "piece")
    # the words of a document meet before they are cut, where its texts are; each token goes with its id
    mend = (lambda s: F.transform(s, lambda p: D.repair_pieces(p))) if repair else (lambda s: s)
    return S.documents_of_sentences(words, keys, "_words", min_length, cut=lambda s: D.wordpieces(s, vocab, nested=True), mend=mend)


def _has_ids(df: DataFrame, col: str) -> bool:
    return "struct" in df.schema[col].dataType.simpleString()


def encode_pairs(docs: DataFrame, key_cols, vocab: DataFrame, seed=42) -> DataFrame:
    """Next-sentence samples: pairs -> truncated -> [CLS] A [SEP] B [SEP] -> ids."""
    keys = list(key_cols) + ["delim"]
    # A pair keeps at most its target of one sentence and cuts all longer ones alike, so that many tokens of each
    # are written once, packed, for the index and the pairs to read; ids are looked up when the pairs are made.
    cut = lambda s: F.slice(s, 1, X.L - 3)
    packed = (lambda s: S.pack(cut(s)["piece"])) if _has_ids(docs, "sentences") else (lambda s: S.pack(cut(s)))
    kept = written(docs.select(*keys, F.transform("sentences", packed).alias("sentences")), "pair-sentences")
    p = S.pair_dataset(kept, key_cols, seed).withColumns({c: S.unpack(c) for c in "AB"})
    a, b = X.truncate_pair("A", "B")
    p = p.withColumn("_f", F.size(a) + 2).withColumn("_s", F.size(b) + 1).withColumn("tokens", X.assemble_pair(a, b))
    p = D.tokens_to_ids(p, keys + ["pno", "y"], "tokens", vocab, "ids", unique=True)
    out = _finish(p, X.segment_ids(F.col("_f"), F.col("_s")))
    return out.select(*keys, "pno", "rank", "tokens", "x", "input_mask", "segment_ids", "y")


def masked_corpus(docs: DataFrame, key_cols, vocab: DataFrame) -> DataFrame:
    """Masked-token corpus before masking: one row per sentence with ids
    truncated to 64 ([SEP] kept last), ``length``, mask and segments."""
    keys = list(key_cols) + ["delim"]
    s = S.flatten_sentences(docs, key_cols)
    if _has_ids(s, "sentence"):
        d = s.withColumn("tokens", X.assemble_single("sentence.piece")).withColumn("ids", X.assemble_single("sentence.pid", CLS_ID, SEP_ID))
    else:
        # one token more than fits tells that a sentence is cut; the rest needs no look-up
        packed = isinstance(s.schema["sentence"].dataType, StringType)
        few, whole = (S.unpack(F.substring_index("sentence", " ", X.L)), S.unpack("sentence")) if packed else (F.col("sentence"), F.col("sentence"))
        s = s.withColumns({"_t": F.slice(X.assemble_single(few), 1, X.L + 1), "tokens": X.assemble_single(whole), "sentence": whole})
        d = D.tokens_to_ids(s, keys + ["sno"], "_t", vocab, "ids", unique=True).drop("_t")
    d = d.withColumn("ids", X.truncate_ids("ids", SEP_ID)).withColumn("length", F.size("ids"))
    d = d.withColumn("input_mask", X.input_mask("ids")).withColumn("segment_ids", X.segment_ids(None)).withColumn("x", X.pad("ids"))
    return X.check_lengths(d)


def encode_masked(corpus: DataFrame, key_cols, vocab_size: int, seed=42, epoch: int = 0) -> DataFrame:
    """Masked samples for one pass; a new epoch draws new positions
    and corruptions (the seed includes the epoch). Nothing is cached."""
    keys = list(key_cols) + ["delim", "sno"]
    s = f"{seed}:{epoch}"
    d = corpus.withColumn("positions", X.mask_positions(F.col("length"), keys, f"pos:{s}"))
    d = d.withColumn("targets", X.mask_targets("x", "positions"))
    d = d.withColumn("masked_x", X.mask_corrupt("x", "positions", keys, s, vocab_size))
    return d

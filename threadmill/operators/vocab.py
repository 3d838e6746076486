"""Vocabulary and tokens.

The vocabulary is bounded by its size parameter, so it travels to the tasks, and tokens are
looked up and cut where their rows are, once per distinct word of an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.functions import tokens as T
from threadmill.session import work_partitions

UNK_ID = P.SPECIAL_TOKENS.index("[UNK]")


def corpus_words(df: DataFrame, text: str = "text", lower: bool = False, strip_accents: bool = False) -> DataFrame:
    """Exploded words of a corpus (training config: no lower, no accent strip)."""
    return df.select(F.explode(T.pretokenize(F.col(text), lower, strip_accents)).alias("word"))


def word_counts(df: DataFrame, text: str = "text", min_count: int = 1, lower: bool = False, strip_accents: bool = False) -> DataFrame:
    """(word, count) with partial aggregation; ``count >= min_count``."""
    c = corpus_words(df, text, lower, strip_accents).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return c.where(F.col("count") >= min_count) if min_count > 1 else c


def alphabet(counts: DataFrame, limit: int = P.LIMIT_ALPHABET) -> DataFrame:
    """D3: the ``limit`` commonest characters, weighted by word count:
    (ch, count, rank)."""
    ch = counts.select(F.explode(T.chars(F.col("word"))).alias("ch"), "count")
    agg = ch.groupBy("ch").agg(F.sum("count").alias("count"))
    top = agg.orderBy(F.col("count").desc(), F.col("ch")).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("ch"))))


def vocab_by_frequency(counts: DataFrame, vocab_size: int = P.VOCAB_SIZE, min_frequency: int = P.MIN_FREQUENCY,
                       limit_alphabet: int = P.LIMIT_ALPHABET, specials=P.SPECIAL_TOKENS) -> DataFrame:
    """D5 (set-based variant): specials in order, then the alphabet (plain
    and '##' continuation forms), then the commonest whole words of at least
    ``min_frequency`` occurrences, up to ``vocab_size`` entries: (token, id)."""
    spark = counts.sparkSession
    sp = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    alpha = alphabet(counts, limit_alphabet)
    n_sp = len(specials)
    plain = alpha.select(F.col("ch").alias("token"), (F.lit(n_sp) + F.col("rank") - 1).cast("int").alias("id"))
    n_alpha = alpha.agg(F.count(F.lit(1))).scalar()
    cont = alpha.select(F.concat(F.lit("##"), F.col("ch")).alias("token"), (F.lit(n_sp) + n_alpha + F.col("rank") - 1).cast("int").alias("id"))
    base = sp.unionByName(plain).unionByName(cont)
    words = (counts.where((F.col("count") >= min_frequency) & (F.length("word") > 1))
             .join(base.select(F.col("token").alias("word")), "word", "left_anti"))
    # no more words than entries can get in; the id decides how many do
    top = words.orderBy(F.col("count").desc(), F.col("word")).limit(vocab_size)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("word"))))
    wid = ranked.select(F.col("word").alias("token"), (F.lit(n_sp) + 2 * n_alpha + F.col("rank") - 1).cast("int").alias("id"))
    return base.unionByName(wid).where(F.col("id") < vocab_size)


def _entries(vocab: DataFrame):
    """Tokens and ids of a vocabulary as Arrow columns, with the unknown token last. A vocabulary is bounded
    by its size parameter; it travels with the task."""
    t = vocab.select("token", F.col("id").cast("int").alias("id")).orderBy("id").toArrow()
    tokens = pa.array([*t.column("token").to_pylist(), None], pa.string())
    return tokens, pa.array([*t.column("id").to_pylist(), UNK_ID], pa.int32())


def wordpieces(words: Column, vocab: DataFrame, max_chars: int = P.MAX_WORD_CHARS, unk: str = "[UNK]", nested: bool = False) -> Column:
    """Words (array<string>) -> their pieces in order, array<struct<piece,pid>>, by greedy longest match; ``nested``: the same for
    each list of an array<array<string>>.

    Row by row, so no word is shuffled: the distinct words of an Arrow batch are cut once each, and the cuts are
    put in the words' places by index arithmetic. Any position without a match, or a word longer than
    ``max_chars``, gives one unknown token."""
    tokens, ids = _entries(vocab)
    state: dict = {}

    def cut(word: str, numbers: dict[str, int], longest: int) -> list[int]:
        unknown = [len(tokens) - 1]
        if word is None or len(word) > max_chars:
            return unknown
        out, s, n = [], 0, len(word)
        while s < n:
            lead = "##" if s else ""
            for e in range(min(n, s + longest - len(lead)), s, -1):
                found = numbers.get(lead + word[s:e])
                if found is not None:
                    break
            else:
                return unknown
            out.append(found)
            s = e
        return out or unknown

    def pieces(docs: pa.Array) -> pa.Array:
        if not state:  # once a task
            known = tokens.to_pylist()[:-1]
            state["numbers"] = {t: i for i, t in enumerate(known)}
            state["longest"] = max(map(len, known), default=0)
            state["names"] = pa.array([*known, unk], pa.string())
        coded = docs.values.dictionary_encode(null_encoding="encode")
        at = coded.indices.to_numpy()
        cuts = [cut(w, state["numbers"], state["longest"]) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((i for c in cuts for i in c), np.int64, int(size.sum()))
        start = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[at])])  # of each word's pieces
        place = np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], size[at])
        number = pa.array(flat[place])
        made = pa.StructArray.from_arrays([state["names"].take(number), ids.take(number)], ["piece", "pid"])
        return pa.ListArray.from_arrays(pa.array(ends[docs.offsets.to_numpy()], pa.int32()), made)

    def nested_pieces(docs: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(docs.offsets, pieces(docs.values))

    udf = F.arrow_udf(nested_pieces if nested else pieces, "array<array<struct<piece:string,pid:int>>>" if nested else "array<struct<piece:string,pid:int>>")
    return udf.asNondeterministic()(F.coalesce(words, F.array().cast("array<array<string>>" if nested else "array<string>")))


def wordpiece_table(words: DataFrame, vocab: DataFrame, max_chars: int = P.MAX_WORD_CHARS, unk: str = "[UNK]") -> DataFrame:
    """(word) -> (word, pieces array<string>, piece_ids array<int>) of every word that is not null."""
    # few bytes but much work: an explicit count, so AQE does not fold them into one task
    w = words.select("word").where(F.col("word").isNotNull()).repartition(work_partitions(words.sparkSession), "word")
    p = w.select("word", wordpieces(F.array("word"), vocab, max_chars, unk).alias("p"))
    return p.select("word", F.col("p.piece").alias("pieces"), F.col("p.pid").alias("piece_ids"))


def repair_specials(tokens: Column, include_url: bool = False) -> Column:
    """Token triples '[', 'rt'|'men'|'tag', ']' -> one mask token,
    left to right. '[URL]' stays three tokens unless ``include_url``."""
    joined = F.concat(F.lit("\u0001"), F.array_join(tokens, "\u0002\u0001"), F.lit("\u0002"))
    for nm in _masks(include_url):
        joined = F.replace(joined, F.lit(f"\u0001[\u0002\u0001{nm}\u0002\u0001]\u0002"), F.lit(f"\u0001[{nm.upper()}]\u0002"))
    body = joined.substr(F.lit(2), F.length(joined) - 2)  # strip the outer markers
    return F.when(F.size(tokens) == 0, tokens).otherwise(F.split(body, "\u0002\u0001", -1))


def _masks(include_url: bool) -> list[str]:
    return ["rt", "men", "tag"] + (["url"] if include_url else [])


def repair_pieces(pieces: Column, include_url: bool = False) -> Column:
    """D7 on array<struct<piece,pid>>: the mask tokens have fixed ids, so the
    ids of the others are carried along and nothing is looked up again."""
    packed = F.transform(pieces, lambda p: F.concat(F.lit("\u0001"), p["piece"], F.lit("\u0003"), p["pid"].cast("string"), F.lit("\u0002")))
    joined = F.array_join(packed, "")
    for nm in _masks(include_url):
        triple = f"\u0001\\[\u0003[0-9]+\u0002\u0001{nm}\u0003[0-9]+\u0002\u0001\\]\u0003[0-9]+\u0002"
        token = f"[{nm.upper()}]"
        joined = F.regexp_replace(joined, triple, f"\u0001{token}\u0003{P.SPECIAL_TOKENS.index(token)}\u0002")
    body = joined.substr(F.lit(2), F.length(joined) - 2)  # strip the outer markers
    again = F.transform(
        F.split(body, "\u0002\u0001", -1),
        lambda t: F.struct(F.substring_index(t, "\u0003", 1).alias("piece"), F.substring_index(t, "\u0003", -1).cast("int").alias("pid")),
    )
    return F.when(F.size(pieces) == 0, pieces).otherwise(again)


def _one_row_a_key(df: DataFrame, keys: list[str], items: str, out: str) -> DataFrame:
    """Rows with the same keys as one: the lists in ``items`` dealt out in turn by position, the other columns of any row."""
    rest = [c for c in df.columns if c not in keys and c != items]
    g = df.groupBy(*keys).agg(F.any_value(F.struct(*rest)).alias("_rest") if rest else F.lit(True).alias("_rest"), F.collect_list(items).alias("_l"))
    placed = F.array_sort(F.flatten(F.transform("_l", lambda x: F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v"))))))
    together = F.when(F.size("_l") == 1, F.element_at("_l", 1)).otherwise(F.transform(placed, lambda p: p["v"]))
    return g.select(*[F.col(c) if c in keys else F.col("_rest")[c].alias(c) for c in df.columns if c != items], together.alias(out))


def tokens_to_ids(df: DataFrame, key_cols, tokens: str, vocab: DataFrame, out: str = "ids", unique: bool = False) -> DataFrame:
    """Vocabulary lookup per token; unknown -> [UNK] id, null list -> empty. Each Arrow batch of lists is looked up
    as one flat column, so no token is exploded or shuffled. Rows with the same keys become one;
    ``unique`` says that there are none, and rows stay where they are."""
    known, ids = _entries(vocab)

    def look_up(docs: pa.Array) -> pa.Array:
        number = pc.fill_null(pc.index_in(docs.values, value_set=known.slice(0, len(known) - 1)), len(known) - 1)
        return pa.ListArray.from_arrays(docs.offsets, ids.take(number))

    # not to be copied by a filter that is pushed below it
    found = F.arrow_udf(look_up, "array<int>").asNondeterministic()(F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    d = df.withColumn("_ids", found)
    return d.withColumnRenamed("_ids", out) if unique else _one_row_a_key(d, list(key_cols), "_ids", out)


def words_of(df: DataFrame, key_cols, text: str, lower: bool = True, strip_accents: bool = True, cjk: bool = True) -> DataFrame:
    """Rows with their words ``_words``: rows with the same keys become one, with their words dealt out in turn. Null text -> no word."""
    keys = list(key_cols)
    words = F.coalesce(T.pretokenize(F.col(text), lower, strip_accents, cjk), F.array().cast("array<string>"))
    return _one_row_a_key(df.select("*", words.alias("_words")), keys, "_words", "_words")


def tokenize(df: DataFrame, key_cols, text: str, vocab: DataFrame, out: str = "tokens", ids: str | None = None,
             lower: bool = True, strip_accents: bool = True, cjk: bool = True, repair: bool = False) -> DataFrame:
    """Text -> word pieces (and their ids) per row, keyed by ``key_cols``: rows with the same keys become one, with
    their words dealt out in turn. Null text -> empty list. What is shuffled for it are rows with words, not
    word by word; rows that are already together by their keys stay."""
    keys = list(key_cols)
    rest = [c for c in df.columns if c not in keys and c not in (out, ids)]
    g = words_of(df.select(*keys, *rest), keys, text, lower, strip_accents, cjk)
    g = g.withColumn("_p", wordpieces(F.col("_words"), vocab))
    if repair:
        g = g.withColumn("_p", repair_pieces(F.col("_p")))
    made = [F.col("_p.piece").alias(out)] + ([F.col("_p.pid").alias(ids)] if ids else [])
    return g.select(*[c for c in df.columns if c in keys or c in rest], *made)


def word_symbols(counts: DataFrame, alphabet: list[str] | None = None) -> DataFrame:
    """Distinct words as symbol lists: first character plain, the rest with
    the '##' continuation prefix: (word, count, syms). A character outside
    ``alphabet`` is a null symbol, which no pair holds."""
    ch = T.chars(F.col("word"))
    syms = F.transform(ch, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit("##"), c)))
    if alphabet is not None:
        known = F.array(*[F.lit(a) for a in alphabet]).cast("array<string>")
        syms = F.transform(syms, lambda x: F.when(F.array_contains(known, F.substring(x, -1, 1)), x))
    return counts.select("word", "count", syms.alias("syms"))


def pair_counts(words: DataFrame, min_frequency: int = 1) -> DataFrame:
    """Adjacent symbol pairs weighted by word count: (l, r, count)."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("syms") - 2),
                        lambda i: F.struct(F.get("syms", i).alias("l"), F.get("syms", i + 1).alias("r")))
    ex = words.where(F.size("syms") > 1).select("count", F.explode(pairs).alias("p")).where("p.l is not null and p.r is not null")
    c = ex.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("count").alias("count"))
    return c.where(F.col("count") >= min_frequency) if min_frequency > 1 else c


def learn_merges(counts: DataFrame, vocab_size: int = P.VOCAB_SIZE, min_frequency: int = P.MIN_FREQUENCY,
                 limit_alphabet: int = P.LIMIT_ALPHABET, budget: int = 400_000, most_open: int = 100_000,
                 specials=P.SPECIAL_TOKENS) -> DataFrame:
    """Grow pieces by merging the most frequent adjacent pair (weighted by
    word count; ties by symbol text) until ``vocab_size`` pieces or no pair
    reaches ``min_frequency``. The order is exactly the greedy one, decided in phases of many merges
    (``operators.merges``); ``budget`` symbols and ``most_open`` pairs bound what the driver holds.
    A character outside the alphabet belongs to no pair. Returns (rank, l, r, piece, count)."""
    from threadmill.operators.merges import learn

    alpha = [r["ch"] for r in alphabet(counts, limit_alphabet).orderBy("rank").collect()]  # at most limit_alphabet
    merges = learn(counts, alpha, vocab_size - len(specials) - 2 * len(alpha), min_frequency, budget, most_open)
    return counts.sparkSession.createDataFrame([(i + 1, *m) for i, m in enumerate(merges)], "rank int, l string, r string, piece string, count long")


def build_vocab(counts: DataFrame, merges: DataFrame, limit_alphabet: int = P.LIMIT_ALPHABET, specials=P.SPECIAL_TOKENS) -> DataFrame:
    """Specials in order, then the alphabet (plain, then '##' forms),
    then the learned pieces in merge order: (token, id)."""
    spark = counts.sparkSession
    sp = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    alpha = alphabet(counts, limit_alphabet)
    n_sp = len(specials)
    n_alpha = alpha.agg(F.count(F.lit(1))).scalar()
    plain = alpha.select(F.col("ch").alias("token"), (F.lit(n_sp) + F.col("rank") - 1).cast("int").alias("id"))
    cont = alpha.select(F.concat(F.lit("##"), F.col("ch")).alias("token"), (F.lit(n_sp) + n_alpha + F.col("rank") - 1).cast("int").alias("id"))
    # a piece that two merges make counts once, at its first merge
    first = merges.groupBy("piece").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.orderBy("rank")))  # at most a vocabulary
    pieces = first.select(F.col("piece").alias("token"), (F.lit(n_sp) + 2 * n_alpha + F.col("rank") - 1).cast("int").alias("id"))
    return sp.unionByName(plain).unionByName(cont).unionByName(pieces)

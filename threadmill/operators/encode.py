"""Fixed-length encoded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import hashing as H
from threadmill.functions import patterns as P

L = P.MAX_SEQ_LENGTH
CLS, SEP, MASK_ID, PAD_ID = "[CLS]", "[SEP]", P.SPECIAL_TOKENS.index("[MASK]"), 0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate_pair(a, b, target: int = L - 3):
    """drop the last token of the longer list until the total fits; a
    tie drops from B. Closed form of that loop."""
    a, b = _c(a), _c(b)
    la, lb = F.size(a), F.size(b)
    na = F.least(la, F.greatest(F.lit((target + 1) // 2), F.lit(target) - lb))
    nb = F.least(lb, F.greatest(F.lit(target // 2), F.lit(target) - la))
    return F.slice(a, 1, na), F.slice(b, 1, nb)


def truncate_topic_pair(topic, x, target: int = L - 3):
    """the same loop, a tie drops from the topic."""
    t, x = _c(topic), _c(x)
    lt, lx = F.size(t), F.size(x)
    nt = F.least(lt, F.greatest(F.lit(target // 2), F.lit(target) - lx))
    nx = F.least(lx, F.greatest(F.lit((target + 1) // 2), F.lit(target) - lt))
    return F.slice(t, 1, nt), F.slice(x, 1, nx)


def truncate_single(x, target: int = L - 3) -> Column:
    """F11."""
    return F.slice(_c(x), 1, target)


def assemble_pair(a, b, cls=CLS, sep=SEP) -> Column:
    """[CLS] A [SEP] B [SEP] (with ids: their ids as ``cls`` and ``sep``)."""
    return F.concat(F.array(F.lit(cls)), _c(a), F.array(F.lit(sep)), _c(b), F.array(F.lit(sep)))


def assemble_single(x, cls=CLS, sep=SEP) -> Column:
    """[CLS] x [SEP]."""
    return F.concat(F.array(F.lit(cls)), _c(x), F.array(F.lit(sep)))


def truncate_ids(ids, sep_id: int, max_len: int = L) -> Column:
    """longer than ``max_len`` -> first max_len-1 ids and [SEP]."""
    x = _c(ids)
    return F.when(F.size(x) > max_len, F.concat(F.slice(x, 1, max_len - 1), F.array(F.lit(sep_id)))).otherwise(x)


def segment_ids(first_len, second_len=None, max_len: int = L) -> Column:
    """0 over the first part, 1 over the second, 0 as padding."""
    f = _c(first_len)
    if second_len is None:
        return F.array_repeat(F.lit(0), max_len)
    s = _c(second_len)
    return F.concat(F.array_repeat(F.lit(0), f), F.array_repeat(F.lit(1), s),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - f - s, F.lit(0))))


def pad(ids, max_len: int = L) -> Column:
    """F16: ids padded with 0 to ``max_len``."""
    x = _c(ids)
    return F.concat(x, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(max_len) - F.size(x), F.lit(0))))


def input_mask(ids, max_len: int = L) -> Column:
    """F16: 1 per real id, 0 per pad."""
    x = _c(ids)
    return F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(x), F.lit(0))))


def check_lengths(df: DataFrame, cols=("x", "input_mask", "segment_ids"), max_len: int = L) -> DataFrame:
    """fail unless every array has exactly ``max_len`` entries. The
    check is a column of the result, evaluated with it (no extra job)."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.size(c) == max_len)
    err = F.raise_error(F.lit(f"encoded arrays must all have length {max_len}")).cast("boolean")
    return df.where(F.when(ok, F.lit(True)).otherwise(err))


def mask_positions(length, key_cols, seed, share: float = P.MASK_SHARE) -> Column:
    """int(share * length) distinct positions among 1..length-2."""
    n = _c(length)
    k = F.floor(n * F.lit(float(share))).cast("int")
    keys = [F.col(c) for c in key_cols]
    cand = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
                       lambda i: F.struct(H.shuffle_key(*keys, i, seed=seed).alias("o"), i.alias("i")))
    chosen = F.transform(F.slice(F.array_sort(cand), 1, k), lambda s: s["i"])
    return F.when(n >= 3, chosen).otherwise(F.array().cast("array<int>"))


def mask_targets(ids, positions) -> Column:
    """distinct original ids at the chosen positions (sparse multi-hot)."""
    # ids enter through one lambda binding: made once per row, not once per position
    picked = F.transform(F.array(_c(ids)), lambda x: F.transform(_c(positions), lambda i: F.element_at(x, i + 1)))
    return F.array_distinct(F.element_at(picked, 1))


def mask_corrupt(ids, positions, key_cols, seed, vocab_size: int, mask_id: int = MASK_ID) -> Column:
    """per chosen position u < .8 -> [MASK]; < .9 -> a uniform id in
    [0, V-1]; else unchanged."""
    x = _c(ids)
    keys = [F.col(c) for c in key_cols]

    def per_row(pos):
        def f(v, i):
            u = H.uniform(*keys, i, seed=f"u:{seed}")
            r = (H.hash60(*keys, i, seed=f"r:{seed}") % vocab_size).cast("int")
            return F.when(~F.array_contains(pos, i), v).when(u < P.MASK_TOKEN_SHARE, F.lit(mask_id)).when(
                u < P.RANDOM_TOKEN_SHARE, r).otherwise(v)

        return F.transform(x, f)

    # positions enter through one lambda binding: evaluated once per row,
    # not once per element (a collapsed projection would inline them)
    return F.element_at(F.transform(F.array(_c(positions)), per_row), 1)


def batches(df: DataFrame, rank: str = "rank", size: int = P.BATCH_SIZE) -> DataFrame:
    """batch id from the order rank; the last batch may be short."""
    return df.withColumn("batch_id", F.floor((F.col(rank) - 1) / size).cast("bigint"))


def train_steps(df: DataFrame, size: int = P.BATCH_SIZE) -> DataFrame:
    """ceil(n / batch size)."""
    return df.agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("steps"))


def tensor_projection(df: DataFrame, cols=("x", "input_mask", "segment_ids"), y: str = "y", keys=()) -> DataFrame:
    """the model inputs as long arrays, in order, and the label."""
    return df.select(*keys, *[F.col(c).cast("array<bigint>").alias(c) for c in cols], F.col(y).cast("bigint").alias(y))

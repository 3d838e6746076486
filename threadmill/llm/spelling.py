"""Operator 12: spelling variants by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point parts them. A
vocabulary is indexed by one bitset over its words for each (position, letter). A query
word is followed letter by letter with four sets of vocabulary words at once: ``exact`` (no error
yet) and, by the error already made, ``replaced`` (same position), ``longer`` (the
vocabulary word has a letter more, so positions are shifted by one up) and ``shorter`` (one
down). Each step is an ``and`` with a position's bitset and an ``or`` with the exact set
before, 64 words at a time; many queries run side by side.

Candidates. Of two near words the shorter has L code points. They agree in their
first k(L) = ceil((L - 1) / 2) code points or in their last ones, since the common
prefix and suffix together hold L - 1. So a word of m code points is in the blocks
(L, prefix) and (L, suffix) for L = m and L = m - 1, and every near pair meets in one; it is
reported by the prefix block if it shares that, else by the suffix block, once. Blocks of
more than ``TILE`` words are cut into tiles by a hash, and each pair of tiles is a work unit of its
own, so no task holds a block whole; small blocks share one index. Nothing is capped.

Words of a corpus are counted by a grouped sum with map-side combining. Roots follow forms by doubling: each
round looks up the form's own pointer, so a chain of n links takes log2(n) rounds.

Defined results: null texts have no words, a null id is the empty string in the hash. Repeated rows
count each. Words compare by code point. A word without near words has n_near 0 and is its own root. No
words give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import cut, work_parts

#: Words of a tile, and of one index that small blocks share; code points of a tile.
TILE, TILE_LETTERS = 2048, 400_000
#: Fixed value of the contract: runs of these code points.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): lower-cased runs, of which about one in ``every`` has lost the
    code point that a checksum of id and run names; long and frequent ones only."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    # a shorter run is not a word whatever it loses; lower() is the same as A-Z where all is ASCII
    runs = runs.where(F.length("run") >= min_length)
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("id", lowered.alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def shared(length: Column) -> Column:
    """Code points that near words agree in at one end, if the shorter has ``length``."""
    return (length / 2).cast("int")


def blocks(words: DataFrame) -> DataFrame:
    """(word, n, block): the blocks of each word, four at most."""
    m = F.length("word")
    keys = []
    for less in (0, 1):
        k = shared(m - less)
        label = F.concat((m - less).cast("string"), F.lit(":"))
        # a word of one code point is near all such words: a block for each end would be the same
        keys += [F.concat(label, F.lit("<"), F.substring("word", F.lit(1), k)), F.concat(label, F.lit(">"), F.expr(f"right(word, cast((length(word) - {less}) / 2 as int))"))]
    return words.select("word", "n", F.explode(F.array_distinct(F.array(*keys))).alias("block"))


def work_units(words: DataFrame) -> DataFrame:
    """(unit, side, word, n): a unit is a block, or a pair of its tiles (``side``
    0 and 1; one tile with itself has side 0 alone)."""
    placed = cut(blocks(words))
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("word")).alias("letters")).where("size > 1")
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("letters") / TILE_LETTERS)).cast("int")
    sizes = sizes.select(F.col("block").alias("b"), tiles.alias("tiles"))
    placed = placed.join(sizes, F.col("block") == F.col("b")).drop("b")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    first, second = F.least("tile", "other"), F.greatest("tile", "other")
    unit = F.concat_ws("/", "block", first, second)
    return placed.select(unit.alias("unit"), (F.col("tile") != first).alias("side"), (first != second).alias("two"), "word", "n")


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, code points of all words in a row)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return lens, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def near_pairs(words: list[str], queries: list[str], step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, word) of all pairs that are one edit apart."""
    lens, codes = letters_of(words)
    slots = -(-len(words) // 64)
    owner = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    # a bitset for each (position, letter) that occurs; the last row is the empty set
    keys, row = np.unique(place << 21 | codes, return_inverse=True)
    index = np.zeros((len(keys) + 1, slots), np.uint64)
    bit = lambda w: np.left_shift(np.uint64(1), (w & 63).astype(np.uint64))
    np.bitwise_or.at(index, (row, owner >> 6), bit(owner))

    def sets(position: int, letters: np.ndarray) -> np.ndarray:
        wanted = position << 21 | letters
        at = np.searchsorted(keys, wanted)
        if position < 0 or not len(keys):
            return index[np.full(len(letters), len(keys))]
        return index[np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))]

    def chosen(which: np.ndarray) -> np.ndarray:
        out = np.zeros(slots, np.uint64)
        where = np.flatnonzero(which)
        np.bitwise_or.at(out, where >> 6, bit(where))
        return out

    of_length = {int(n): chosen(lens == n) for n in np.unique(lens)}
    none, every = np.zeros(slots, np.uint64), chosen(lens >= 0)
    q_lens, q_codes = letters_of(queries)
    q_starts = np.cumsum(q_lens) - q_lens
    found_q, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(q_lens).tolist():
        one_less, same, one_more = (of_length.get(m + d, none) for d in (-1, 0, 1))
        if not (one_less | same | one_more).any():
            continue
        members = np.flatnonzero(q_lens == m)
        for start in range(0, len(members), step):
            part = members[start : start + step]
            letters = q_codes[q_starts[part][:, None] + np.arange(m)]
            exact = np.tile(every, (len(part), 1))
            replaced, longer, shorter = (np.zeros_like(exact) for _ in range(3))
            for i in range(m):
                here, above, below = (sets(i + d, letters[:, i]) for d in (0, 1, -1))
                longer = (longer | exact) & above
                replaced = (replaced & here) | exact
                shorter = (shorter & below) | exact
                exact &= here
            hit = (replaced & ~exact & same) | ((longer | exact) & one_more) | (shorter & one_less)
            q, w = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
            found_q.append(part[q])
            found_w.append(w)
    return np.concatenate(found_q), np.concatenate(found_w)


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of whole work units, both ways round. Units come in a row; small ones share an index."""
    held: list[tuple[str, str, int, bool, bool]] = []

    def flush(rows):
        if len(rows) < 2:
            return
        units, words, ns, sides, twos = (list(c) for c in zip(*rows))
        number = {u: i for i, u in enumerate(dict.fromkeys(units))}
        group = np.fromiter((number[u] for u in units), np.int64, len(units))
        side, two, n = np.array(sides), np.array(twos), np.array(ns, np.int64)
        left, right = np.flatnonzero(~(two & side)), np.flatnonzero(side | ~two)  # words of the index, queries
        if not len(left) or not len(right):
            return
        q, w = near_pairs([words[i] for i in left], [words[i] for i in right])
        q, w = right[q], left[w]
        same = group[q] == group[w]
        q, w = q[same], w[same]
        if not len(q):
            return
        # the block's length is the shorter word's, and a suffix block leaves to the prefix block what that has
        lens = np.fromiter(map(len, words), np.int64, len(words))
        least = np.minimum(lens[q], lens[w])
        block = [u.split(":", 1) for u in units]
        of_block = np.fromiter((int(b[0]) for b in block), np.int64, len(block))
        suffix = np.fromiter((b[1][0] == ">" for b in block), bool, len(block))
        keep = least == of_block[q]
        ends = np.flatnonzero(keep & suffix[q])
        keep[ends] = [words[a][: n_ // 2] != words[b][: n_ // 2] for a, b, n_ in zip(q[ends], w[ends], least[ends])]
        q, w = q[keep], w[keep]
        # a tile with itself finds each pair both ways; two tiles one way
        turned = two[q]
        a, b = np.concatenate([q, w[turned]]), np.concatenate([w, q[turned]])
        texts = pa.array(words, pa.string())
        for start in range(0, len(a), 100_000):
            x, y = a[start : start + 100_000], b[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(x)), pa.array(n[x]), texts.take(pa.array(y)), pa.array(n[y])], ["word", "n", "near", "near_n"])

    letters = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("unit", "word", "n", "side", "two"))):
            if held and row[0] != held[-1][0] and (len(held) >= TILE or letters >= TILE_LETTERS):
                yield from flush(held)
                held, letters = [], 0
            held.append(row)
            letters += len(row[1])
    yield from flush(held)


def links(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every near pair of distinct words, both ways round."""
    units = work_units(words)
    dealt = units.repartition(work_parts(words.sparkSession), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(_links, "word string, n long, near string, near_n long")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words."""
    words = cut(words)
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best")
    near = links(words).groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(near, F.col("word") == F.col("of"), "left")
    has = -F.col("best.minus_n") >= ratio * F.col("n")
    rows = cut(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.minus_n")).alias("form_n"),
    ))
    # pointers double until none moves; a form is more frequent than its word, so there is no circle
    ahead = rows.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        hop = ahead.select(F.col("word").alias("w"), F.col("to").alias("further"))
        moved = cut(ahead.join(hop, F.col("to") == F.col("w"), "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        ahead = moved.select("word", "to")
        if moved.where("moved").isEmpty():
            break
    roots = ahead.select(F.col("word").alias("w"), F.col("to").alias("root"))
    rows = rows.join(roots, F.col("word") == F.col("w"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

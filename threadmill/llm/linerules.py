"""Operator 13: quality rules with cross-document line frequency.

Each text gets base counts (words, symbols, repeated lines, words in repeated
3-word windows). Then its ``\\n``-split lines are normalised (lower case, runs of white
space as one blank, trimmed) and hashed, and the distinct documents of each
(host, line) are counted. A line in more than ``max_docs`` documents of its host is
removed from all of them. A document fails if its base counts do, or if it is
depleted: more than ``max_lost`` percent of its words stood in removed lines.

All of it is DataFrame functions. The lines are hashed once and written narrow (id, host, two
hashes, a word count); counting first drops the repeats of a document. The
``HOT_LINES`` most frequent lines are broadcast, a bound in rows; a line that is not
among them has at most 1/``HOT_LINES`` of all rows, so the shuffled join of
the rest has no hot key. The texts themselves are not shuffled unless ``clean_text`` is read.

Defined results: null and empty texts have no words and fail. Documents are told
apart by their id; a null id is told apart by its text. Repeated rows give one row each and count as one
document. A null host is a host of its own. Lines without a word
are neither counted nor removed. Two lines are one if their 64 bits of XXH64 agree. No rows
give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import cut

#: Fixed values of the base rules.
WORD, SPACE, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", "[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED = 50, 50

#: Lines that are joined by a broadcast.
HOT_LINES = 10_000


def bind(value: Column, body) -> Column:
    """``body`` of a value that is made once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more among the words."""
    n = F.size(words)
    windows = F.when(n < 4, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )

    def starts(sorted_: Column) -> Column:
        # (hash, place) in order: a window is repeated if a neighbour has its hash
        again = F.filter(sorted_, lambda s, i: (s["h"] == F.get(sorted_, i - 1)["h"]) | (s["h"] == F.get(sorted_, i + 1)["h"]))
        return F.sort_array(F.transform(again, lambda s: s["i"]))

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(bind(bind(placed, starts), covered))

    return bind(windows, count)


def base_counts(text: Column) -> dict[str, Column]:
    """The base counts of a text that is not null."""
    squeezed = F.regexp_replace(text, SPACE, "")
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    both = bind(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("bigint").alias("words"), repeated_words(w).alias("repeated")),
    )
    return {
        "_both": both,
        "word_chars": F.length(squeezed).cast("bigint"),
        "n_symbols": (F.length(squeezed) - F.length(F.regexp_replace(squeezed, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": bind(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    }


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, max_lost: int = 50) -> DataFrame:
    """Per document: doc_id, host, the base counts, base_failed, lost_words, kept,
    and clean_text, the text without the removed lines (null if the document is not kept)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "host", "text_hash"]

    line = F.transform(F.split("text", "\n", -1), normal_line)
    words = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    lines = rows.select(*key, F.posexplode(line).alias("nth", "line")).where("line <> ''")
    lines = cut(lines.select(*key, "nth", F.xxhash64("line").alias("h"), words.alias("words")))

    seen = F.when(F.col("doc_id").isNull(), F.col("text_hash")).otherwise(F.xxhash64("doc_id"))
    seen = lines.select("host", "h", F.col("doc_id").isNull().alias("no_id"), seen.alias("seen")).distinct()
    frequent = cut(seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs).withColumnsRenamed({"host": "f_host", "h": "f"}))

    hot = F.broadcast(frequent.orderBy(F.col("n_docs").desc(), "f_host", "f").limit(HOT_LINES).drop("n_docs"))
    same = F.col("h").eqNullSafe(F.col("f")) & F.col("host").eqNullSafe(F.col("f_host"))
    found = lines.join(hot, same, "left_semi")
    if frequent.count() > HOT_LINES:
        rest = frequent.drop("n_docs").exceptAll(hot)
        found = found.unionByName(lines.join(hot, same, "left_anti").join(rest, same, "left_semi"))
    # a repeated row's lines are the same places again, so they count once
    lost = found.groupBy(*[F.col(c).alias(f"l_{c}") for c in key]).agg(F.collect_set(F.struct("nth", "words", "h")).alias("found"))

    counts = base_counts(F.col("text"))
    judged = rows.select(*key, "text", *[c.alias(name) for name, c in counts.items()])
    judged = judged.withColumns({"n_words": F.col("_both.words"), "n_repeat_words": F.col("_both.repeated")}).drop("_both")
    on = F.col("text_hash") == F.col("l_text_hash")
    for c in ("doc_id", "host"):
        on = on & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    lost_words = F.aggregate(F.col("found"), F.lit(0).cast("bigint"), lambda a, s: a + s["words"])
    judged = judged.join(lost, on, "left").withColumn("lost_words", F.coalesce(lost_words, F.lit(0).cast("bigint")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost * F.col("n_words"))
    judged = judged.withColumn("base_failed", base_failed).withColumn("kept", kept)
    gone = F.transform(F.coalesce("found", F.array().cast("array<struct<nth:int,words:int,h:bigint>>")), lambda s: s["nth"])
    clean = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return judged.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept",
        F.when(F.col("kept"), clean).alias("clean_text"),
    )

"""Operator 11: interaction audit of five filters over all their orders.

A document's failures are a mask of five bits. What the audit needs of the
corpus are mask cells: documents, good and toxic ones per (part, mask), at most 32 a part.
A recursive CTE then enumerates filter orders: a prefix is extended with
each letter it does not hold yet, joins the mask cells and carries the applied bits, and each
level emits that step's counts of the cell (kept, removed, redundant, unique). The
recursion runs over the 32 masks themselves, 325 prefixes x 32 rows whatever the data, and its levels meet
the parts' counts by an equi-join on the mask; so the orders cost nothing that grows with the corpus.

Filters (a failure condition each): A fewer than 200 words; B fewer than 50 distinct
words in 100; C more than 2 capitals ``[A-Z]`` in 100 code points; D holds one of
``#$%&*|``; E the same text as a document with a smaller id. Copies are
counted by the text's SHA-256 and id, then pre-aggregated per (text, part), so a
text with a third of all rows is one row a part before it meets the others.

Defined results: a null text is empty (fails A only, and E if an empty text has a smaller id). A null
part is the empty part. A null id has no label, fails no E and is nobody's smaller id. Repeated rows
count each; rows of one id and text are no copies of each other. Of several labels of an id the largest
counts. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import cut

LETTERS = "ABCDE"
#: Fixed values of the filters.
WORD, MARKS, MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = r"[^\x20\x09-\x0D]+", "[#$%&*|]", 200, 50, 2


def failures(text: Column) -> Column:
    """Bits 0-3 of the mask: A, B, C, D of a text that is not null."""
    words = F.element_at(
        F.transform(
            F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
            lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT * F.size(w), 2).otherwise(0),
        ),
        1,
    )
    # all but the capitals are ever fewer characters than the text
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return words + F.when(100 * capitals > MAX_CAPITALS * F.length(text), 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    marks = labels.select(F.col("doc_id").alias("l_id"), "quality", "toxic").where("l_id is not null")
    marks = marks.groupBy("l_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, F.col("id") == F.col("l_id"), "left")
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    one = rows.select("digest", "mask", "part", "id", F.lit(1).cast("bigint").alias("n"), zero("good").alias("good"), zero("toxic").alias("toxic"))
    # counts of one id, then of one part: all of its documents, and those of its smallest id
    one = one.groupBy("digest", "mask", "part", "id").agg(*sums("n", "good", "toxic"))
    none = F.when(F.col("id").isNull(), F.struct("n", "good", "toxic"))
    groups = one.groupBy("digest", "mask", "part").agg(
        *sums("n", "good", "toxic"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", "good", "toxic"))).alias("first"),
        F.max(none).alias("none"),
    )
    # the smallest id of the text over all parts keeps clear of E, as rows without an id do
    split = groups.withColumn("least", F.min("first").over(Window.partitionBy("digest", "mask"))["id"])
    own = F.coalesce(F.col("first.id") == F.col("least"), F.lit(False))

    def clear(c: str) -> Column:
        return F.when(own, F.col(f"first.{c}")).otherwise(0) + F.coalesce(F.col(f"none.{c}"), F.lit(0))

    kinds = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), *[clear(c).alias(c) for c in ("n", "good", "toxic")]),
            F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - clear(c)).alias(c) for c in ("n", "good", "toxic")]),
        )
    )
    return split.select("part", kinds.alias("k")).where("k.n > 0").groupBy("part", "k.mask").agg(*[F.sum(f"k.{c}").alias(c) for c in ("n", "good", "toxic")])


#: One level of the recursion per filter. ``step_bit`` is the bit of the letter applied last.
STEPS = """
with recursive letters as (
    select substr('{letters}', i + 1, 1) as letter, shiftleft(1, i) as bit from (select explode(sequence(0, {last})) as i)
),
masks as (select explode(sequence(0, {top})) as mask),
steps(prefix, step, letter, applied, step_bit, mask, before) as (
    select cast('' as string), 0, cast('' as string), 0, 0, mask, 0 from masks
    union all
    select concat(s.prefix, l.letter), s.step + 1, l.letter, s.applied | l.bit, l.bit, m.mask, s.applied
    from steps s join letters l on (s.applied & l.bit) = 0 join masks m on m.mask = s.mask
    where s.step <= {last}
)
select prefix, step, letter, mask,
    (mask & applied) = 0 as kept,
    (mask & step_bit) <> 0 and (mask & before) = 0 as removed,
    (mask & step_bit) <> 0 and (mask & before) <> 0 as redundant,
    mask = step_bit as only
from steps where step > 0
"""


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every part x filter_order x step of the mask cells, with the step's counts."""
    spark = cells.sparkSession
    steps = spark.sql(STEPS.format(letters=letters, last=len(letters) - 1, top=(1 << len(letters)) - 1))
    steps = cut(steps)  # 325 x 32 rows for five letters, fixed by their number
    parts = cells.select("part").distinct()
    total = lambda flag, c, name: F.sum(F.when(F.col(flag), F.col(c)).otherwise(0)).alias(name)
    prefixes = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix").agg(
        total("kept", "n", "kept"), total("removed", "n", "removed"), total("redundant", "n", "redundant"), total("only", "n", "unique_fails"),
        total("removed", "good", "good_lost"), total("removed", "toxic", "toxic_lost"),
    )
    # a prefix of k letters stands for (n - k)! orders
    orders = steps.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substr(filter_order, 1, step)"))
    shares = prefixes.groupBy("part", F.expr("right(prefix, 1)").alias("letter")).agg(
        F.sum(F.col("removed") * F.factorial(F.lit(len(letters)) - F.length("prefix"))).alias("shapley")
    )
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    whole = prefixes.withColumn("letter", F.expr("right(prefix, 1)")).join(shares, ["part", "letter"]).join(F.broadcast(orders), "prefix")
    return whole.select("part", "filter_order", "step", *[F.col(c).cast("bigint").alias(c) for c in names])

"""Model-shaped data jobs.

The transformer itself is not rebuilt. What is built: a count-based
classifier trained and scored entirely with grouped aggregates and joins, a
frequency baseline for masked tokens, and one Python door (``batch_predict``)
through which a user's own model scores Arrow batches on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.session import work_partitions, written


@dataclass
class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing.

    ``token_counts``: (token, counts map<int,bigint>) - per-token class counts.
    ``classes``: (y, n_docs, n_tokens). ``vocab_size``: distinct training tokens."""

    token_counts: DataFrame
    classes: DataFrame


def train_classifier(train: DataFrame, tokens: str = "tokens", y: str = "y") -> NaiveBayes:
    """G1: class and token counts by grouped aggregation (partial combine)."""
    ex = train.select(F.col(y).cast("int").alias("y"), F.explode(tokens).alias("token"))
    pair = ex.groupBy("token", "y").agg(F.count(F.lit(1)).alias("cnt"))
    per_tok = pair.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("y", "cnt"))).alias("counts"))
    docs = train.groupBy(F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n_docs"))
    toks = ex.groupBy("y").agg(F.count(F.lit(1)).alias("n_tokens"))
    classes = docs.join(toks, "y", "left").fillna(0, ["n_tokens"])
    return NaiveBayes(per_tok, classes)


def _class_params(model: NaiveBayes):
    """Priors and log denominators per class: k rows (the label alphabet)."""
    v = model.token_counts.count()
    rows = model.classes.orderBy("y").collect()
    n = sum(r["n_docs"] for r in rows)
    return [(r["y"], math.log(r["n_docs"] / n), math.log(r["n_tokens"] + v)) for r in rows]


#: Tokens whose counts are broadcast.
COMMON_TOKENS = 50_000


def score_classifier(model: NaiveBayes, df: DataFrame, key_cols, tokens: str = "tokens") -> DataFrame:
    """Per row an array of class log-scores (index = class id).

    score(c) = log prior(c) + sum over known tokens of log(count(c, t) + 1)
               - (number of known tokens) * log(tokens(c) + |V|)."""
    keys = list(key_cols)
    params = _class_params(model)
    ex = df.select(*keys, F.explode(tokens).alias("token"))
    # The commonest tokens are broadcast and added up where their rows are; only the rare ones are
    # shuffled to meet the whole table.
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    common = F.broadcast(model.token_counts.orderBy(total.desc(), "token").limit(COMMON_TOKENS))
    j = ex.join(common, "token").unionByName(ex.join(common, "token", "left_anti").join(model.token_counts, "token"))
    aggs = [F.count(F.lit(1)).alias("_nv")] + [
        F.sum(F.log(F.coalesce(F.element_at("counts", F.lit(c)), F.lit(0)) + 1.0)).alias(f"_s{c}") for c, _, _ in params
    ]
    per = j.groupBy(*keys).agg(*aggs)
    out = df.join(per, keys, "left")
    nv = F.coalesce(F.col("_nv"), F.lit(0))
    scores = F.array(*[F.lit(p) + F.coalesce(F.col(f"_s{c}"), F.lit(0.0)) - nv * F.lit(d) for c, p, d in params])
    return out.withColumn("scores", scores).drop("_nv", *[f"_s{c}" for c, _, _ in params])


def softmax_scores(scores) -> Column:
    """Probabilities, shifted by the maximum for stability."""
    s = F.col(scores) if isinstance(scores, str) else scores

    # the maximum and the sum enter through one binding each: once per row, not once per element
    def bind(value, body):
        return F.element_at(F.transform(F.array(value), body), 1)

    def shifted(a):
        return bind(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))

    def divided(e):
        return bind(F.aggregate(e, F.lit(0.0), lambda p, q: p + q), lambda t: F.transform(e, lambda x: x / t))

    return bind(s, lambda a: bind(shifted(a), divided))


def argmax_class(probs) -> Column:
    """Index of the largest value, first on ties."""
    p = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def pair_features(a: str = "A", b: str = "B") -> Column:
    """G5 features: tokens of A and B tagged by side, plus shared tokens."""
    return F.concat(
        F.transform(a, lambda t: F.concat(F.lit("a:"), t)),
        F.transform(b, lambda t: F.concat(F.lit("b:"), t)),
        F.transform(F.array_intersect(a, b), lambda t: F.concat(F.lit("s:"), t)),
    )


SPECIAL_IDS = (0, 1, 2, 3, 4)


def associations(corpus: DataFrame, ids: str = "x", length: str = "length", window: int = 2, exclude=SPECIAL_IDS, held: int = 4_000_000) -> DataFrame:
    """How often two ids stand within ``window`` places of each other: (v, t, n), both ways round, all pairs.

    Neighbours are counted on the flat ids of Arrow batches, ``held`` pairs at a time, and only the counts of
    distinct pairs are summed up over all tasks, one way round."""
    kind = corpus.select(F.col(ids)[0]).schema.fields[0].dataType.simpleString()

    def counted(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(codes):
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            lo, hi = code >> 32, (code & 0xFFFFFFFF).astype(np.uint32).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(n, pa.int64())], ["v", "t", "n"])

        codes, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            skipped = flat.is_null().to_numpy(zero_copy_only=False) | np.isin(flat_ids := pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), exclude)
            each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(each)
            most = np.minimum(each, pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False))
            last = np.repeat(ends - each + most, each)  # where the real ids of each place's row end
            for d in range(1, min(window, len(flat_ids) - 1) + 1):
                at = np.flatnonzero((np.arange(d, len(flat_ids)) < last[:-d]) & ~skipped[:-d] & ~skipped[d:])
                one, two = flat_ids[at].astype(np.int64), flat_ids[at + d].astype(np.int64)
                codes.append(np.minimum(one, two) << 32 | np.maximum(one, two) & 0xFFFFFFFF)
                size += len(at)
            if size >= held:
                yield rows(codes)
                codes, size = [], 0
        if size:
            yield rows(codes)

    some = corpus.select(F.col(ids).cast("array<int>").alias("x"), F.col(length).cast("int").alias("length")).mapInArrow(counted, "v int, t int, n bigint")
    one = some.groupBy("v", "t").agg(F.sum("n").alias("n"))
    way = lambda v, t, n: F.struct(F.col(v).cast(kind).alias("v"), F.col(t).cast(kind).alias("t"), n.alias("n"))
    ways = F.when(F.col("v") == F.col("t"), F.array(way("v", "t", 2 * F.col("n")))).otherwise(F.array(way("v", "t", F.col("n")), way("t", "v", F.col("n"))))
    return one.select(F.explode(ways).alias("p")).select("p.v", "p.t", "p.n")


#: Candidates whose votes every sample adds up first.
HEAD = 128


def _places(ids, tie):
    """The places of ids that break ties, and the order by them; an id without a place comes after the others, by itself."""
    tie_ids, tie_places = tie
    at = np.minimum(np.searchsorted(tie_ids, ids), max(len(tie_ids) - 1, 0))
    known = tie_ids[at] == ids if len(tie_ids) else np.zeros(len(ids), bool)
    places = np.where(known, tie_places[at] if len(tie_ids) else 0, len(tie_ids)).astype(np.int32)
    return places, np.lexsort((ids, places))


def settled(near, k, assoc: DataFrame, tie: tuple, head: int = HEAD) -> Column:
    """The ``k`` best candidates by the votes of all partners of the ids ``near``, in order, where the ``head`` candidates with
    the most votes in all are proved to hold them, else null. Any other candidate has at most the sum, over the sample's ids, of
    the largest count an id has outside the head; the k best are settled if the last of them has more. No vote is left out:
    a sample that this does not settle takes all partners (``vote``).

    What travels with the tasks has ``head`` numbers for each id: at most a vocabulary of rows."""
    top = assoc.groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "t").limit(head).toArrow().column("t").to_numpy()
    ids = top[_places(top, tie)[1]].astype(np.int64)
    inside = F.col("t").isin(ids.tolist())
    rows, other = assoc.where(inside).toArrow(), assoc.where(~inside).groupBy("v").agg(F.max("n").alias("n")).toArrow()
    known = np.unique(np.concatenate([rows.column("v").to_numpy(), other.column("v").to_numpy()]).astype(np.int64))
    n, width = rows.column("n").to_numpy(), len(ids)
    # one row more for ids without a partner
    counts = np.zeros((len(known) + 1, width), np.int32 if n.max(initial=0) < 2**31 else np.int64)
    by_id = np.argsort(ids)
    counts[np.searchsorted(known, rows.column("v").to_numpy()), by_id[np.searchsorted(ids, rows.column("t").to_numpy(), sorter=by_id)]] = n
    beyond = np.zeros(len(known) + 1, np.int64)
    beyond[np.searchsorted(known, other.column("v").to_numpy())] = other.column("n").to_numpy()

    def best(lists, most):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        most = pc.fill_null(most, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        at = np.where(known[at] == flat, at, len(known)) if len(known) else at
        begin = np.cumsum(each) - each
        todo = np.flatnonzero((each > 0) & (most > 0) & (most <= width))
        sure, found, sizes = np.zeros(len(most), bool), [np.zeros(0, np.int64)], np.zeros(len(most), np.int64)
        for some in np.array_split(todo, max(1, int(each[todo].sum()) // 4096)):
            if not len(some):
                continue
            size = each[some]
            start = np.cumsum(size) - size
            of = at[np.arange(size.sum()) + np.repeat(begin[some] - start, size)]
            # votes, and among equal ones the candidate that comes first
            key = np.add.reduceat(counts[of], start, axis=0, dtype=np.int64) * width + np.arange(width - 1, -1, -1)
            k = most[some]
            high = -np.sort(-np.partition(key, width - k.max(), axis=1)[:, width - k.max() :], axis=1)
            good = high[np.arange(len(some)), k - 1] // width > np.add.reduceat(beyond[of], start)
            sure[some] = good
            sizes[some[good]] = k[good]
            found.append(ids[width - 1 - high[good][np.arange(high.shape[1]) < k[good][:, None]] % width])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()), mask=pa.array(~sure))

    return F.arrow_udf(best, "array<int>").asNondeterministic()(near, k)


def tile_counts(votes: int, pairs: int, samples: int, workers: int, slice_pairs: int, task_votes: int) -> tuple[int, int]:
    """Slices of candidates and blocks of samples. Every block takes all pairs and every slice all samples, so blocks beyond
    one tile for each worker end where the copies of the pairs would outgrow those of the samples; a
    tile then has more votes to add up, row by row in the same memory."""
    slices = max(1, -(-pairs // slice_pairs))
    blocks = max(1, -(-max(-(-votes // task_votes), workers) // slices))
    return slices, max(1, min(blocks, max(-(-slices * samples // max(1, pairs)), -(-workers // slices))))


def vote(seen: DataFrame, assoc: DataFrame, tie: tuple, keys: list[str], slice_pairs: int = 2_000_000, task_votes: int = 20_000_000) -> DataFrame:
    """The ``_k`` best candidates of each key in each slice of candidates, by the summed counts of all partners of its ids:
    (keys, best array<struct<lost,tie,id_>>), ``lost`` the votes times -1. ``seen``: (keys, near array<int>, _k); ``assoc``: (v, t, n);
    ``tie``: ids and the places that break ties, as arrays.

    A product of two sparse matrices in tiles. The candidates are dealt into slices by a hash of their id (``slice_pairs`` pairs each) and the
    samples into blocks by a hash of their key, so that a tile has about ``task_votes`` votes to add up, or more where smaller ones would only
    copy the pairs (``tile_counts``). Within a tile all votes for its candidates meet, so only the best of each sample leave it: no vote is
    shuffled, and an id with many partners or many readers is spread over all tiles. Pairs travel as lists, one for each id and slice."""
    spark = seen.sparkSession
    degrees = assoc.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    reads = seen.select(F.explode("near").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("s"))
    load = reads.join(degrees, "v").agg(F.sum(F.col("s") * F.col("d")).alias("votes")).first()["votes"] or 0
    slices, blocks = tile_counts(load, assoc.count(), seen.count(), work_partitions(spark), slice_pairs, task_votes)
    deal = lambda *cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = seen.select(*keys, "near", "_k", deal(*keys, n=blocks).alias("_b"), numbers(slices).alias("_s"))
    lists = assoc.groupBy("v", deal("t", n=slices).alias("_s")).agg(F.collect_list(F.struct("t", "n")).alias("p"))
    right = lists.select("v", F.col("p.t").alias("t"), F.col("p.n").alias("n"), "_s", numbers(blocks).alias("_b"))
    sides = [d.withColumn("_tile", F.col("_b") * slices + F.col("_s")).drop("_b", "_s").repartition(blocks * slices, "_tile").groupBy("_tile") for d in (left, right)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.select(*keys).schema.fields) + ", best array<struct<lost:bigint,tie:int,id_:int>>"

    def tile(samples, pairs):
        import numpy as np
        import pyarrow as pa

        lists = pairs.column("t").combine_chunks()
        t, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        n = pairs.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # candidates in the order that breaks ties, so that a stable sort by votes is the whole order
        ids = np.unique(t)
        places, rank = _places(ids, tie)
        place = np.argsort(rank)[np.searchsorted(ids, t)]
        ids, places = ids[rank], places[rank]
        readers = pairs.column("v").to_numpy()
        ends = np.cumsum(size)
        span = {v: (e - z, e) for v, z, e in zip(readers.tolist(), size.tolist(), ends.tolist())}
        near = samples.column("near").combine_chunks()
        near_ids, offsets = near.values.to_numpy(zero_copy_only=False).tolist(), near.offsets.to_numpy().tolist()
        found, votes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
        for row, most in enumerate(samples.column("_k").to_pylist()):
            total = np.zeros(len(ids), np.int64)
            for v in near_ids[offsets[row] : offsets[row + 1]]:
                if v in span:
                    a, b = span[v]
                    total[place[a:b]] += n[a:b]  # an id has each partner once
            hit = np.flatnonzero(total)
            if len(hit) > most:
                hit = hit[total[hit] >= np.partition(total[hit], -most)[-most]] if most else hit[:0]
            hit = hit[np.argsort(-total[hit], kind="stable")][:most]
            found.append(hit)
            votes.append(total[hit])
            counts.append(len(hit))
        hit = np.concatenate(found)
        best = pa.StructArray.from_arrays([pa.array(-np.concatenate(votes)), pa.array(places[hit], pa.int32()), pa.array(ids[hit], pa.int32())], ["lost", "tie", "id_"])
        best = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), best)
        return pa.Table.from_arrays([*[samples.column(k) for k in keys], best], [*keys, "best"])

    return sides[0].cogroup(sides[1]).applyInArrow(tile, schema)


def masked_predictor(samples: DataFrame, assoc: DataFrame, freq: DataFrame, key_cols, ids: str = "x", length: str = "length",
                     positions: str = "positions", targets: str = "targets", window: int = 2, exclude=SPECIAL_IDS, out: str = "predicted", head: int = HEAD, **tiling) -> DataFrame:
    """For each sample as many ids as it has targets, from the visible
    tokens near its masked places. Each visible token votes for all its partners
    (``associations``) with their counts; ties and gaps are filled by corpus
    frequency (``freq``: id, logp; at most a vocabulary), then by id. Keys must be unique; ``head`` goes to ``settled``, ``tiling`` to ``vote``."""
    keys = list(key_cols)
    x, n, pos = F.col(ids), F.col(length), F.col(positions)
    near = F.flatten(F.transform(pos, lambda p: F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda d: F.when(
        (d != 0) & (p + d >= 0) & (p + d < n) & ~F.array_contains(pos, p + d), F.get(x, p + d)))))
    near = F.filter(near, lambda v: v.isNotNull() & ~v.isin(list(exclude))).cast("array<int>")
    order = freq.select("id", "logp").toArrow().sort_by([("logp", "descending"), ("id", "ascending")]).column("id").to_numpy()
    by_id = np.argsort(order, kind="stable")
    tie = (order[by_id], by_id.astype(np.int32))
    assoc = written(assoc.select("v", "t", "n"), "associations")
    # most samples find their best among few candidates, where their rows are; the others meet all partners
    own = samples.columns
    first = written(samples.select("*", near.alias("_near"), F.size(targets).alias("_k")).withColumn(out, settled(F.col("_near"), F.col("_k"), assoc, tie, head)), "first-votes")
    done = first.where(F.col(out).isNotNull()).select(*own, out)
    samples = first.where(F.col(out).isNull()).select(*own, "_near", "_k")
    most = samples.agg(F.max("_k").alias("k")).first()["k"] or 0
    common = order[:most].tolist()
    seen = samples.select(*keys, F.col("_near").alias("near"), "_k").where((F.size("near") > 0) & (F.col("_k") > 0))
    votes = vote(seen, assoc, tie, keys, **tiling)
    best = votes.groupBy(*keys).agg(F.flatten(F.collect_list("best")).alias("_best"))
    filler = F.array(*[F.struct(F.lit(0).cast("bigint").alias("lost"), F.lit(i).alias("tie"), F.lit(int(c)).cast("int").alias("id_")) for i, c in enumerate(common)])
    none = F.array().cast("array<struct<lost:bigint,tie:int,id_:int>>")
    met = samples.join(best, keys, "left").withColumn("_best", F.coalesce("_best", none))
    named = F.transform("_best", lambda b: b["id_"])
    # a filler without votes stands behind every candidate with some
    gaps = F.filter(filler, lambda f: ~F.array_contains(named, f["id_"])) if common else none
    ranked = F.slice(F.array_sort(F.concat("_best", gaps)), 1, F.size(targets))
    late = met.withColumn(out, F.coalesce(F.transform(ranked, lambda b: b["id_"]), F.array().cast("array<int>")))
    return done.unionByName(late.select(*own, out))


def id_log_probs(train_corpus: DataFrame, ids: str = "x", length: str = "length", exclude=SPECIAL_IDS) -> DataFrame:
    """log relative frequency of every id in the real (unpadded) positions."""
    ex = train_corpus.select(F.explode(F.slice(ids, 1, F.col(length))).alias("id"))
    ex = ex.where(~F.col("id").isin(list(exclude)))
    c = ex.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).scalar()
    return c.select("id", (F.log(F.col("n")) - F.log(total)).alias("logp"))


def batch_predict(df: DataFrame, load_model: Callable, predict: Callable, schema: str, batch_size: int = 16) -> DataFrame:
    """Score a user's model over Arrow batches on the executors.

    ``load_model()`` runs once per task (one load per worker process task),
    ``predict(model, pdf)`` gets pandas frames of at most ``batch_size`` rows
    and returns a pandas frame matching ``schema``."""

    def run(batches):
        model = load_model()
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                yield predict(model, pdf.iloc[i : i + batch_size])

    return df.mapInPandas(run, schema)

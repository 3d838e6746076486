"""Operator 3: SimHash near-duplicates by tiled exact comparison.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words with repeats (fewer words: the whole sequence). Each shingle
gives its XXH64 (seed 42); a bit is 1 if more than half of the hashes set it.
No words: fingerprint zero.

Links: two fingerprints link at ``radius`` or fewer differing bits. Copies fall
together first (distinct fingerprints). Fingerprints lie in cells by the
population counts of ``blocks`` equal stretches of their bits, and each cell is
cut into tiles, ``LANE`` of which make a lane: a task's unit is a lane and the tiles that meet it, so a cell of any size
is the work of many tasks. Two fingerprints within the radius have population counts that
differ by the radius at most, summed over the stretches, so tiles meet only
tiles of their own and of such neighbouring cells (an equi-join on the cell);
all other pairs of tiles are skipped. A pair of tiles is compared in full by
exclusive-or and bit counts. Only a spanning forest of the links of a pair of
tiles leaves the task, so a group of thousands of near copies gives no square of
links. Nothing is left out: every pair within the radius meets.

Components: smallest neighbour by alternating stars; each round is checkpointed.
``component_id`` is the smallest id reachable. Null texts count as empty. A null
id takes part in links, and is never a component id unless all ids of its
component are null. Repeated rows give one row each. Other columns are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import cut, give_back, text_steps, work_parts

SEED = 42
#: Fingerprints of a tile, tiles of a lane.
TILE, LANE = 256, 16


def text_hashes(text: str, shingle: int) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()  # on bytes: A-Z and the six ASCII spaces only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(line[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprints_of(texts: list[str], shingle: int) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = text_hashes(text, shingle)
        if hashes:
            ones = np.zeros(64, np.int64)
            for k in range(0, len(hashes), 100_000):
                raw = np.array(hashes[k : k + 100_000], "<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fp (the fingerprint's 64 bits as a signed long)."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches):
        for batch, texts in text_steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fingerprints_of(texts, shingle).view(np.int64))], ["doc_id", "text_hash", "fp"])
            del batch, texts
        give_back()

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def cell(fp: Column, blocks: int) -> Column:
    """Population counts of the stretches, as one number with 8 bits for each."""
    width = 64 // blocks
    mask = (1 << width) - 1
    out = F.lit(0).cast("long")
    for b in range(blocks):
        stretch = F.shiftrightunsigned(fp, b * width)
        stretch = stretch.bitwiseAND(F.lit(mask).cast("long")) if blocks > 1 else stretch
        out = out + F.shiftleft(F.bit_count(stretch).cast("long"), 8 * b)
    return out


def neighbour_steps(blocks: int, radius: int) -> list[int]:
    """Differences of cell numbers that can hold a link; of each pair of opposite ones the one that is not below 0."""
    out = set()
    for step in product(range(-radius, radius + 1), repeat=blocks):
        if sum(map(abs, step)) <= radius:
            out.add(sum(s << (8 * b) for b, s in enumerate(step)))
    return sorted(s for s in out if s >= 0)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a, b), each tree as a star on its smallest member."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # smallest neighbour, then shortcuts
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    kept = np.flatnonzero(root != np.arange(len(nodes)))
    return list(zip(nodes[root[kept]].tolist(), nodes[kept].tolist()))


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the two tiles within the radius."""
    far = np.bitwise_count(left[:, None] ^ right[None, :])
    i, j = np.nonzero(far <= radius)
    return left[i], right[j]


def links(distinct: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) that join the fingerprints ``fp`` (distinct) within the radius: a spanning forest of each pair of tiles."""
    # tiles: a cell's fingerprints dealt by a hash into as many tiles as its count asks for
    cells = distinct.withColumn("cell", cell(F.col("fp"), blocks))
    counts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(TILE))).cast("int").alias("tiles"))
    tiles = (
        cells.join(counts, "cell")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .groupBy("cell", "tile").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    tiles = cut(tiles)
    steps = F.array(*[F.lit(s).cast("long") for s in neighbour_steps(blocks, radius)])
    left = tiles.select(F.col("cell").alias("l_cell"), F.col("tile").alias("l_tile"), F.col("fps").alias("l_fps"), F.explode(steps).alias("step"))
    left = left.withColumn("cell", F.col("l_cell") + F.col("step"))
    # few bytes and much work: a left tile goes to every lane of the cell it meets, and the lanes to a fixed number of parts
    lanes = tiles.groupBy("cell").agg((F.max("tile") / F.lit(LANE)).cast("int").alias("last"))
    left = left.join(lanes, "cell").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    right = tiles.withColumn("lane", (F.col("tile") / F.lit(LANE)).cast("int"))
    parts = work_parts(distinct.sparkSession)
    pairs = (
        left.repartition(parts, "cell", "lane").join(right.repartition(parts, "cell", "lane"), ["cell", "lane"])
        .where("step > 0 or l_tile <= tile")
        .select("l_fps", "fps")
    )

    def run(batches):
        for batch in batches:
            found = []
            left_values, right_values = (batch.column(c).values.to_numpy().view(np.uint64) for c in ("l_fps", "fps"))
            left_at, right_at = (batch.column(c).offsets.to_numpy() for c in ("l_fps", "fps"))
            for i in range(len(batch)):
                p, q = tile_links(left_values[left_at[i] : left_at[i + 1]], right_values[right_at[i] : right_at[i + 1]], radius)
                own = p != q
                if own.any():
                    found += forest(p[own].view(np.int64), q[own].view(np.int64))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for every node of the
    edges (a, b). Large star and small star take turns until nothing changes; a hub's
    neighbours are only ever reduced to their minimum and mapped, never gathered."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    parts = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    while parts["n"]:
        # large star: link every larger neighbour to the smallest of the neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: link the smaller neighbours and the node to the smallest of them
        down = large.select(F.col("b").alias("n"), F.col("a").alias("v"))
        low = down.groupBy("n").agg(F.min("v").alias("m"))
        small = down.join(low, "n").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("n").alias("b")))
        edges = cut(small.where("a < b").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == parts:
            break
        parts = now
    # all is stars now: each node has one smaller neighbour, the root
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, text_hash and root
    (a fingerprint of the component, the same for all its rows) of every row."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(links(distinct.select("fp"), radius, blocks))
    rooted = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id", "root")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias
    return fps.join(by_fp, "fp").select("doc_id", digits("fp")("fingerprint"), "component_id", "text_hash", digits("root")("root"))

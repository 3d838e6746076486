"""The merge learner.

The greedy order (most frequent adjacent pair first, ties by symbol text) is kept
exactly, but many merges are decided per pass over the distinct-word table:

* A phase counts all pairs on the executors and leaves the most frequent ones
  *open*. Every word is cut between symbols whose pair is not open, and equal segments are summed
  over all words. A pair below the least open count cannot be merged before the open ones,
  so the summed segments are all that the next merges depend on: a table of bounded size, however
  many words there are (``budget`` symbols; fewer pairs are opened until it fits).
* On the segments runs an inverted index pair -> segments: a merge rewrites only the segments
  that hold its pair and adds their count deltas.
* The phase ends when a count is no longer certain. A piece that is made in a second way may stand next to a cut, where its
  pairs are not counted; what such pairs can add at most is bounded by the symbols at the cuts.
* The executors then replace each segment by its final form, and the next phase counts again.
"""

from __future__ import annotations

import heapq
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks bring these functions along


def joined_piece(l: str, r: str) -> str:
    return l + (r[2:] if r.startswith("##") else r)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows in a row, and how many each row has."""
    lists = batch.column("syms")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(lists.offsets.to_numpy())


def _pairs(values: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key) of each adjacent pair."""
    row = np.repeat(np.arange(len(lens)), lens)
    place = np.flatnonzero(row[1:] == row[:-1])
    return row, place, values[place].astype(np.int64) << 32 | values[place + 1]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def _segments(values: np.ndarray, lens: np.ndarray, open_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, length, symbols) of the segments of all rows, in order."""
    row, place, keys = _pairs(values, lens)
    starts = np.ones(len(values), bool)
    if len(open_keys):
        at = np.minimum(np.searchsorted(open_keys, keys), len(open_keys) - 1)
        starts[place[open_keys[at] == keys] + 1] = False
    first = np.flatnonzero(starts)
    ends = np.append(first[1:], len(values))
    raw = values.tobytes()
    return row[first], ends - first, [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist())]


def symbol_table(counts: DataFrame, symbols: dict[str, int]) -> DataFrame:
    """(syms array<int>, count): each word's runs of known characters, two symbols at least."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(ord(s) for s in symbols if len(s) == 1), np.int64)
        plain = np.array([symbols[chr(c)] for c in known], np.int32)
        inner = np.array([symbols["##" + chr(c)] for c in known], np.int32)
        for batch in batches:
            words = batch.column("word").to_pylist()
            lens = np.fromiter(map(len, words), np.int64, len(words))
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if not len(codes) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            syms = np.where(known[at] == codes, inner[at], -1)
            heads = (np.cumsum(lens) - lens)[lens > 0]
            syms[heads] = np.where(syms[heads] < 0, -1, plain[at[heads]])
            row = np.repeat(np.arange(len(words)), lens)
            # an unknown character ends a run
            run = np.cumsum((syms < 0) | np.concatenate([[True], row[1:] != row[:-1]]))[syms >= 0]
            row, syms = row[syms >= 0], syms[syms >= 0]
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(syms)))
            keep = np.repeat(size > 1, size)
            n = batch.column("count").to_numpy()[row[first[size > 1]]] if len(first) else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(size[size > 1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(syms[keep], pa.int32())), pa.array(n, pa.int64())], ["syms", "count"])

    return counts.select("word", "count").mapInArrow(number, "syms array<int>, count long")


def _pair_table(words: DataFrame) -> DataFrame:
    """(key, n) of all pairs."""

    def count(batches):
        for batch in batches:
            values, lens = _flat(batch)
            row, place, keys = _pairs(values, lens)
            keys, n = _summed(keys, batch.column("count").to_numpy()[row[place]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return words.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _segment_table(words: DataFrame, open_keys: np.ndarray) -> DataFrame:
    """(segment, n) of all distinct segments of two symbols or more."""
    shared = words.sparkSession.sparkContext.broadcast(open_keys)

    def split(batches):
        for batch in batches:
            row, lens, segments = _segments(*_flat(batch), shared.value)
            n = batch.column("count").to_numpy()
            found: Counter = Counter()
            for i in np.flatnonzero(lens > 1).tolist():
                found[segments[i]] += int(n[row[i]])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["segment", "n"])

    return words.mapInArrow(split, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def _rewritten(words: DataFrame, open_keys: np.ndarray, forms: dict[bytes, bytes]) -> DataFrame:
    """Every word with its segments in their final form; words of one symbol are done and go."""
    shared = words.sparkSession.sparkContext.broadcast((open_keys, forms))

    def replace(batches):
        opened, final = shared.value
        for batch in batches:
            values, lens = _flat(batch)
            row, _, segments = _segments(values, lens, opened)
            segments = [final.get(s, s) for s in segments]
            size = np.bincount(row, np.fromiter(map(len, segments), np.int64, len(segments)) // 4, len(lens)).astype(np.int64)
            syms = np.frombuffer(b"".join(segments), np.int32)
            keep = size > 1
            offsets = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(syms[np.repeat(keep, size)], pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("count").filter(pa.array(keep))], ["syms", "count"])

    return words.mapInArrow(replace, "syms array<int>, count long")


def _first_by_text(pairs: DataFrame, names: list[str]) -> int:
    """The key of the first pair in order of its symbols' texts."""
    spark = pairs.sparkSession
    texts = spark.createDataFrame(list(enumerate(names)), "id int, name string")  # at most a vocabulary
    l, r = (texts.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name")) for side in ("l", "r"))
    split = pairs.select("key", F.shiftright("key", 32).cast("int").alias("l"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("r"))
    return split.join(l, "l").join(r, "r").orderBy("l_name", "r_name").first()["key"]


class Phase:
    """The merges that a table of segments decides.

    ``floor`` is the least count of an open pair; all pairs that are not open
    are less frequent. Symbols are numbers, ``names`` their texts; new pieces are added to
    ``names`` and ``numbers``."""

    def __init__(self, segments: list[tuple[bytes, int]], opened: set[tuple[int, int]], floor: int, names: list[str], numbers: dict[str, int]):
        self.before = [s for s, _ in segments]
        self.segments = [np.frombuffer(s, np.int32).tolist() for s, _ in segments]
        self.weights = [n for _, n in segments]
        self.opened, self.floor, self.names, self.numbers = opened, floor, names, numbers
        self.count: Counter = Counter()
        self.holders: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.beside: dict[int, set[tuple[int, int]]] = defaultdict(set)
        # symbols at the phase's start that may be the first (last) of a symbol, if not itself
        self.firsts: dict[int, frozenset[int]] = {}
        self.lasts: dict[int, frozenset[int]] = {}
        self.widest = [1, 1]
        self.heap: list = []
        self.doubtful: list = []
        for i, (s, n) in enumerate(zip(self.segments, self.weights)):
            for p in zip(s, s[1:]):
                self.count[p] += n
                self.holders[p].add(i)
        for p, n in self.count.items():
            self.beside[p[0]].add(p)
            self.beside[p[1]].add(p)
            self.heap.append((-n, names[p[0]], names[p[1]], p))
        heapq.heapify(self.heap)

    def _cut_places(self, p: tuple[int, int]) -> int:
        """Pairs at cuts that may have become this one."""
        return sum((x, y) not in self.opened for x in self.lasts.get(p[0], (p[0],)) for y in self.firsts.get(p[1], (p[1],)))

    def _push(self, p: tuple[int, int]) -> None:
        n = self.count[p]
        if n <= 0:
            return
        heapq.heappush(self.heap, (-n, self.names[p[0]], self.names[p[1]], p))
        if self.floor > 1 and (len(self.lasts.get(p[0], "1")) > 1 or len(self.firsts.get(p[1], "1")) > 1):
            places = self._cut_places(p)
            if places:
                heapq.heappush(self.doubtful, (-n - places * (self.floor - 1), n, p))

    def _best(self):
        """The next pair and its count, or None if that is not certain."""
        while self.heap and self.count[self.heap[0][3]] != -self.heap[0][0]:
            heapq.heappop(self.heap)
        if not self.heap:
            return None
        n, p = -self.heap[0][0], self.heap[0][3]
        if self.floor > 1:
            if n <= self.widest[0] * self.widest[1] * (self.floor - 1):
                return None
            while self.doubtful and self.count[self.doubtful[0][2]] != self.doubtful[0][1]:
                heapq.heappop(self.doubtful)
            if self.doubtful and -self.doubtful[0][0] >= n:
                return None  # a pair (this one, too) whose count is not known as well as needed
        return p, n

    def _merge(self, p: tuple[int, int]) -> int:
        l, r = p
        name = joined_piece(self.names[l], self.names[r])
        new = self.numbers.get(name)
        again = new is not None
        if not again:
            new = self.numbers[name] = len(self.names)
            self.names.append(name)
        if self.floor > 1:
            for ends, part, side in ((self.firsts, l, 0), (self.lasts, r, 1)):
                made = ends.get(part, frozenset((part,)))
                ends[new] = made | ends.get(new, frozenset((new,))) if again else made
                self.widest[side] = max(self.widest[side], len(ends[new]))
        changed: set[tuple[int, int]] = set()
        for i in sorted(self.holders.pop(p)):
            s, n = self.segments[i], self.weights[i]
            for q in zip(s, s[1:]):
                self.count[q] -= n
                changed.add(q)
            out, k = [], 0
            while k < len(s):
                if k + 1 < len(s) and s[k] == l and s[k + 1] == r:
                    out.append(new)
                    k += 2
                else:
                    out.append(s[k])
                    k += 1
            self.segments[i] = out
            after = set(zip(out, out[1:]))
            for q in set(zip(s, s[1:])) - after:
                self.holders[q].discard(i)
            for q in zip(out, out[1:]):
                self.count[q] += n
            for q in after:
                self.holders[q].add(i)
                self.beside[q[0]].add(q)
                self.beside[q[1]].add(q)
            changed |= after
        if again:
            changed |= self.beside[new]
        for q in changed:
            if self.count[q] <= 0:
                del self.count[q]
                self.beside[q[0]].discard(q)
                self.beside[q[1]].discard(q)
            else:
                self._push(q)
        return new

    def run(self, pieces: set[int], room: int, min_frequency: int, most: int) -> list[tuple[int, int, int, int]]:
        """(l, r, piece, count) of the decided merges, ``most`` at most, in order; ``pieces`` grows."""
        out: list[tuple[int, int, int, int]] = []
        while len(pieces) < room and len(out) < most:
            best = self._best()
            if best is None or best[1] < max(min_frequency, self.floor):
                break
            p, n = best
            new = self._merge(p)
            pieces.add(new)
            out.append((*p, new, n))
        return out

    def forms(self) -> dict[bytes, bytes]:
        """The final form of each segment that has changed."""
        return {b: s.tobytes() for b, s in ((b, np.array(s, np.int32)) for b, s in zip(self.before, self.segments)) if len(b) != 4 * len(s)}


def learn(counts: DataFrame, alphabet: list[str], room: int, min_frequency: int, budget: int, most_open: int) -> list[tuple[str, str, str, int]]:
    """(l, r, piece, count) of all merges, in order, until ``room`` pieces or no pair reaches ``min_frequency``."""
    names = list(alphabet) + ["##" + c for c in alphabet]
    numbers = {s: i for i, s in enumerate(names)}
    words = materialize(symbol_table(counts, numbers).groupBy("syms").agg(F.sum("count").alias("count")))
    merges: list[tuple[str, str, str, int]] = []
    pieces: set[int] = set()
    opening = 1024
    while len(pieces) < room:
        size = words.agg(F.sum(F.size("syms"))).first()[0] or 0
        if size <= budget:  # all words fit: nothing is cut
            opened, floor, crowd, whole = None, 1, False, words.collect()
            segments = [(np.array(r["syms"], np.int32).tobytes(), r["count"]) for r in whole]
        else:
            pairs = materialize(_pair_table(words).where(F.col("n") >= min_frequency))
            while True:
                top = pairs.orderBy(F.col("n").desc()).limit(opening + 1).collect()
                floor = top[-1]["n"] + 1 if len(top) > opening else min_frequency
                held = [r["key"] for r in top if r["n"] >= floor]
                crowd = not held and bool(top)
                if crowd:  # more equal counts than may be open: the first by text alone, for one merge
                    floor, held = top[0]["n"], [_first_by_text(pairs.where(F.col("n") == top[0]["n"]), names)]
                opened = np.array(sorted(held), np.int64)
                table = materialize(_segment_table(words, opened))
                if len(held) <= 1 or (table.agg(F.sum(F.length("segment"))).first()[0] or 0) <= 4 * budget:
                    break
                opening = max(1, len(held) // 4)
            segments = [(bytes(r["segment"]), r["n"]) for r in table.collect()]
            opening = min(2 * opening, most_open)
        if not segments:
            break
        keys = {(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in opened} if opened is not None else set()
        phase = Phase(segments, keys, floor, names, numbers)
        made = phase.run(pieces, room, min_frequency, 1 if crowd else room)
        merges += [(names[l], names[r], names[p], n) for l, r, p, n in made]
        if opened is None or not made:
            break
        words = materialize(_rewritten(words, opened, phase.forms()))
    return merges

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from threadmill.session import ensure_checkpoint_dir
from threadmill.sources.tables import table

#: Bytes of text that one in-task step works on (a longer single text is a step of its own).
STEP_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def work_parts(spark: SparkSession) -> int:
    """Partitions for a shuffle whose tasks do much work on few bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_steps(batches: Iterable[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most ``size`` bytes of text each (one row
    at least), with their texts; a null text is read as empty."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        start = 0
        while start < len(batch):
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + size, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            start = stop


def give_back() -> None:
    """Hand freed memory back at the end of a task: Spark keeps its Python
    workers, and what they hold on to counts for the tasks that run next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no GNU C library
        pass


def ragged(arena: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces arena[start : start + len], one after the other."""
    total = int(lens.sum())
    if not total:
        return arena[:0]
    before = np.cumsum(lens) - lens
    return arena[np.repeat(starts - before, lens) + np.arange(total)]


def sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of ``lens`` rows of ``values`` (0 for an empty run)."""
    out = np.zeros((len(lens), *values.shape[1:]), np.float64)
    full = np.flatnonzero(lens)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(lens) - lens)[full], axis=0, dtype=np.float64)
    return out


def int_lists(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Memo:
    """Bounded memo from a string to a run of values in one array. When it is
    full it starts anew, so it only saves work and never changes a result."""

    def __init__(self, learn, dtype, most: int = 400_000):
        self.learn, self.dtype, self.most = learn, dtype, most
        self.clear()

    def clear(self):
        self.at = Numbers()
        self.arena, self.starts, self.lens, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _grown(self, a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def find(self, words: list[str]) -> np.ndarray:
        """Entry number of each word; unknown words are learnt together."""
        if len(self.at) > self.most:
            self.clear()
        n = len(self.at)
        found = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        new = list(islice(self.at, n, None))
        if new:
            values, lens = self.learn(new)
            self.arena = self._grown(self.arena, self.used + len(values))
            self.arena[self.used : self.used + len(values)] = values
            self.starts, self.lens = self._grown(self.starts, n + len(new)), self._grown(self.lens, n + len(new))
            self.lens[n : n + len(new)] = lens
            self.starts[n : n + len(new)] = self.used + np.cumsum(lens) - lens
            self.used += len(values)
        return found

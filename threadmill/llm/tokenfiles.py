"""Operator 6: token ids in binary files with Elias-Fano document boundaries.

Documents are dealt out by ranges of their id, sorted, encoded with the
tokenizers library and written by the same task, so files follow each other in
ascending order of the ids. A file holds one array of token ids (2 bytes each
if the vocabulary allows, else 4) and its document boundaries in Elias-Fano
form: the low bits of each boundary packed, the high bits in unary, and one
32-bit count of ones for each 512 bits of these. ``select`` finds boundary i
from that count and one block: there is no table of 64-bit offsets.

File: 8 bytes mark, then seven little-endian unsigned 64-bit numbers (documents,
tokens, bytes of an id, low bits, bytes of the low, high and count sections),
the document ids (8 bytes each) with one byte each that is 1 for a null id, the
three sections, the token ids.

A task writes under a name of its own attempt, and only the files in the
returned manifest count; so a repeated task or a lost executor leaves at most files
that nobody reads. Files go through pyarrow's file systems into the folder that
all executors share. A file is closed at ``FILE_TOKENS`` ids; a document is never parted.

Each stretch between two spaces is encoded once by the library and its ids are
kept in a bounded memo. A text with white space beside a space, or with the
string of an added token, goes to the library whole.

Null and empty texts hold the end id alone. A null id comes first; equal ids
follow in the order of a hash of the text, and equal rows give one row each.
No rows give no files and an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.common import Memo, cut, ragged, text_steps, work_parts
from threadmill.session import scratch_path

MARK = b"TOKEF001"
BLOCK = 512
FILE_TOKENS = 8_000_000
SPACE_SIGN = "\u0120"  # how a byte-level vocabulary writes the space
WHOLE = -1  # stands for ids that only the whole text tells


class EliasFano:
    """A rising sequence of numbers, read through ``select``."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.int64)
        bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> bits) + np.arange(n)
        blocks = int(places[-1]) // BLOCK + 1 if n else 0
        marks = np.zeros(blocks * BLOCK, np.uint8)
        marks[places] = 1
        counts = marks.reshape(blocks, BLOCK).sum(axis=1, dtype=np.uint32)
        return cls(n, bits, low, np.packbits(marks, bitorder="little"), (np.cumsum(counts) - counts).astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``."""
        out = np.zeros(len(i), np.int64)
        for k in range(0, len(i), 4096):
            at = i[k : k + 4096].astype(np.int64)
            block = np.searchsorted(self.ones, at, side="right") - 1
            rows = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
            place = (np.cumsum(rows, axis=1, dtype=np.int32) > (at - self.ones[block])[:, None]).argmax(axis=1) + block * BLOCK
            bit = at[:, None] * self.bits + np.arange(self.bits)
            low = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.int64) if self.bits else np.zeros((len(at), 0), np.int64)
            out[k : k + 4096] = ((place - at) << self.bits) + (low << np.arange(self.bits)).sum(axis=1)
        return out


def packed(doc_ids: list, lens: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One file."""
    edges = EliasFano.of(np.concatenate([[0], np.cumsum(lens)]))
    head = np.array([len(doc_ids), len(ids), width, edges.bits, len(edges.low), len(edges.high), edges.ones.nbytes], "<u8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    void = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MARK, head.tobytes(), keys.tobytes(), void.tobytes(), edges.low.tobytes(), edges.high.tobytes(), edges.ones.tobytes(), ids.astype(f"<u{width}").tobytes()])


def unpacked(raw: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """Document ids, boundaries and token ids of one file."""
    if raw[:8] != MARK:
        raise ValueError("not a token file")
    docs, tokens, width, bits, low, high, ones = (int(x) for x in np.frombuffer(raw, "<u8", 7, 8))
    at = 64
    keys, at = np.frombuffer(raw, "<i8", docs, at), at + 8 * docs
    void, at = np.frombuffer(raw, np.uint8, docs, at), at + docs
    edges = EliasFano(docs + 1, bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low), np.frombuffer(raw, "<u4", ones // 4, at + low + high))
    ids = np.frombuffer(raw, f"<u{width}", tokens, at + low + high + ones)
    return [None if v else k for k, v in zip(keys.tolist(), void.tolist())], edges, ids


class Encoder:
    """The tokenizers library behind a memo of stretches between spaces."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(SPACE_SIGN)]] = True
        self.first, self.later = Memo(self.learn_first, np.int32, 100_000), Memo(self.learn, np.int32, 800_000)

    def alone(self, units: list[str]) -> list[bool]:
        """Whether each stretch can be encoded by itself: it is not empty, has no
        white space at its ends and no string of an added token in it."""
        whole = " ".join(units)
        if any(a in whole for a in self.added):
            return [u.strip() == u != "" and not any(a in u for a in self.added) for u in units]
        return [u.strip() == u != "" for u in units]

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, each after a space; WHOLE alone for one that cannot be encoded by itself.
        Many are encoded as one text: its spaces stand at the starts of the
        stretches only, and a token holds a space at its start only, so these tokens part the ids."""
        alone = self.alone(units)
        kept = units if all(alone) else list(compress(units, alone))
        texts = [" " + " ".join(kept[i : i + 500]) for i in range(0, len(kept), 500)]
        ids = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(kept):
            raise ValueError("the vocabulary has tokens with a space inside")
        size = np.diff(np.append(starts, len(ids)))
        if len(kept) == len(units):
            return ids, size
        lens = np.ones(len(units), np.int64)
        lens[alone] = size
        out = np.full(int(lens.sum()), WHOLE, np.int32)
        out[np.repeat(alone, lens)] = ids
        return out, lens

    def learn_first(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches at the start of a text, where an empty one is plain."""
        ids = [i if a or not u else [WHOLE] for u, a, i in zip(units, self.alone(units), self.whole(units))]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        heads, units, counts = [], [], []
        for t in texts:
            u = t.split(" ")
            heads.append(u[0])
            counts.append(len(u) - 1)
            units += u[1:]
        head, later = self.first.find(heads), self.later.find(units)
        len_h, len_l = self.first.lens[head], self.later.lens[later]
        ids_h = ragged(self.first.arena, self.first.starts[head], len_h)
        ids_l = ragged(self.later.arena, self.later.starts[later], len_l)
        ends = np.cumsum(counts, dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(len_l)])
        own = edge[ends] - edge[ends - counts]
        # heads and the rest in turn
        parts = np.empty((len(texts), 2), np.int64)
        parts[:, 0], parts[:, 1] = len_h, own
        first = np.repeat(np.tile([True, False], len(texts)), parts.ravel())
        ids = np.empty(len(first), np.int32)
        ids[first], ids[~first] = ids_h, ids_l
        lens = parts.sum(axis=1)
        if not (ids == WHOLE).any():
            return ids, lens
        edge = np.concatenate([[0], np.cumsum(lens)])
        out = [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]
        redo = [k for k, x in enumerate(out) if (x == WHOLE).any()]
        for k, x in zip(redo, self.whole([texts[k] for k in redo])):
            out[k] = np.array(x, np.int32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files and return the manifest: part, seq (their order), file, docs, tokens."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # of fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    # half the usual partitions: a range's distinct words are encoded once, and twice the text has fewer than twice the words
    parts = max(spark.sparkContext.defaultParallelism, work_parts(spark) // 2)
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, (files, root) = Encoder(spec.value), _file_system(folder)
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        doc_ids, lens, parts = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal seq, held, doc_ids, lens, parts
            name = f"part-{part:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.tok"
            ids = np.concatenate(parts)
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(packed(doc_ids, np.concatenate(lens), ids, encoder.width))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "docs": [len(doc_ids)], "tokens": [len(ids)]})
            seq, held, doc_ids, lens, parts = seq + 1, 0, [], [], []
            return row

        files.create_dir(root, recursive=True)
        for batch, texts in text_steps(batches, "text", 2_000_000):
            ids, n = encoder.encode(texts)
            ids = np.insert(ids, np.cumsum(n), end_id)
            if held and held + len(ids) > file_tokens:
                yield close()
            doc_ids += batch.column("doc_id").to_pylist()
            lens.append(n + 1)
            parts.append(ids.astype(f"<u{encoder.width}"))
            held += len(ids)
        if held:
            yield close()

    return cut(rows.mapInArrow(run, "part int, seq int, file string, docs long, tokens long"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (over 4-byte ids)."""
    spark: SparkSession = manifest.sparkSession
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))  # one row for each task of the writer
    before = F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("before") + F.coalesce(F.sum("tokens").over(in_part), F.lit(0))
    files = manifest.join(parts.select("part", before.alias("before")), "part").select("file", start.alias("start"))

    def run(batches):
        store, root = _file_system(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    doc_ids, edges, ids = unpacked(f.read())
                at = edges.select(np.arange(len(doc_ids) + 1))
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(at[:-1] + first), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crcs, pa.int64())})

    return files.repartition(work_parts(spark), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder in the shared one and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id), folder)

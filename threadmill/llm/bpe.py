"""Operator 1: byte-level BPE with word ends, encoding and decoding.

Encoding works on the distinct words of a step. Their symbols lie in one array
with links to the next and the previous symbol of the word. The pair occurrence
index maps each merge rank to all positions where its pair stands. The active
ranks are taken in ascending order from a heap: every occurrence of the pair is
merged at once and the pairs that arise left and right of it enter the lists of
their ranks. A bounded memo keeps the ids of words already seen by the task.

Rules of the tokenizer file (kind ``word_bpe``): NFC, lower case per character,
white space parts words and is dropped, word pattern as in the file, bytes as
symbols, the last symbol of a word carries the end mark. The strings of added
tokens in a text get their own ids, as the file says. Decoding joins the tokens
of the ids with one space, since the file names no decoder.

Null and empty texts give no ids and an empty decoded text. Rows are never
joined or grouped, so repeated rows, ties and null ids give one row each.
Columns of the input other than the text pass through; an input column that
bears the name of an output column is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import Memo, give_back, int_lists, ragged, text_steps

# Fixed values of the tokenizer family: white space as its patterns see it, and the pattern of words.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"

NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        self.spec, self.library = spec, None
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        # a symbol must exist before a pair that holds it is merged: then all occurrences of a pair can be merged at once
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(made, self.merged, np.arange(len(pairs)))
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before a merge that makes one of its parts")
        self.width = len(made)
        keys = left * self.width + right
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word = regex.compile(WORD)
        tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)])
        self.memo = Memo(self.learn, np.int32, 200_000)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank[i], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, stop = len(raw), np.cumsum(lens) - 1
        sym = self.inner[raw]
        sym[stop] = self.last[raw[stop]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[stop] = -1
        prv[stop - lens + 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(pos: np.ndarray) -> None:
            """Put the pairs that start at these positions into the lists of their ranks."""
            rank = self.rank_of(sym[pos], sym[nxt[pos]])
            pos, rank = pos[rank != NONE], rank[rank != NONE]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            edge = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(pos)]
            for i, j in zip(edge[:-1], edge[1:]):
                r = int(rank[i])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(pos[i:j])

        enter(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            pos = pos[(sym[pos] == a) & (nxt[pos] >= 0)]
            pos = np.unique(pos[sym[nxt[pos]] == b])
            if not len(pos):
                continue
            if a == b:  # in a run of one symbol every second pair counts, from the left
                first = np.ones(len(pos), bool)
                first[1:] = nxt[pos[:-1]] != pos[1:]
                run = np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone], nxt[pos] = self.merged[r], -1, after
            more = after >= 0
            prv[after[more]] = pos[more]
            before = prv[pos]
            enter(np.concatenate([before[before >= 0], pos[more]]))
        kept = sym >= 0
        return sym[kept], np.add.reduceat(kept, stop - lens + 1, dtype=np.int64)

    def library_pieces(self, unit: str) -> list[bytes]:
        """Words of a stretch with characters younger than this Python's Unicode tables, by the tokenizers library's tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.byte = {s: b for b, s in enumerate(byte_symbols())}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(unit))
        return [bytes(self.byte[s] for s in w) for w, _ in words]

    def pieces(self, unit: str) -> list[str | bytes | int]:
        """Words of a stretch without spaces, and ids of added tokens in it."""
        if self.cut is not None and "<" in unit and len(parts := self.cut.split(unit)) > 1:
            return [x for k, part in enumerate(parts) for x in ([self.special[part]] if k % 2 else self.pieces(part))]
        if not unit.isascii():
            if any(unicodedata.category(c) == "Cn" for c in unit):
                return self.library_pieces(unit)
            unit = unicodedata.normalize("NFC", unit).replace("Σ", "σ")  # lower() would look at the place in the word
        return self.word.findall(unit.lower())

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stretches."""
        at: dict[str | bytes, int] = {}
        held, counts = [], []
        for u in units:
            found = self.pieces(u)
            counts.append(len(found))
            held += [-1 - w if isinstance(w, int) else at.setdefault(w, len(at)) for w in found]
        if not held:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        ids, lens = self.merge([w if isinstance(w, bytes) else w.encode("utf-8", "replace") for w in at]) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        starts = np.cumsum(lens) - lens
        size = max(self.special.values(), default=-1) + 1
        arena = np.concatenate([ids, np.arange(size)])  # the ids of added tokens stand for themselves
        use = np.array(held, np.int64)
        own = use < 0
        word = np.where(own, 0, use)
        start, length = (np.where(own, len(ids) - 1 - use, starts[word]), np.where(own, 1, lens[word])) if len(at) else (len(ids) - 1 - use, np.ones(len(use), np.int64))
        edge = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(counts)
        return ragged(arena, start, length), edge[ends] - edge[ends - counts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        units, counts = [], []
        for t in texts:
            u = t.split(" ")
            counts.append(len(u))
            units += u
        found = self.memo.find(units)
        lens = self.memo.lens[found]
        edge = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(counts)
        return ragged(self.memo.arena, self.memo.starts[found], lens), edge[ends] - edge[ends - np.array(counts)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids; an id outside the vocabulary adds nothing."""
        flat = ids.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens)))
        if not pc.all(known, min_count=0).as_py():
            lists = [[i for i in x or () if i is not None and 0 <= i < len(self.tokens)] for x in ids.to_pylist()]
            ids = pa.array(lists, pa.list_(pa.int32()))
            flat = ids.flatten()
        words = pc.take(self.tokens, flat)
        lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")


def _mapped(df: DataFrame, made: dict[str, T.DataType], step) -> DataFrame:
    """The input with the columns ``made``; ``step`` turns batches into pairs of a batch and its new columns."""
    kept = [c for c in df.columns if c not in made]
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), *(T.StructField(c, k) for c, k in made.items())])
    names = [*kept, *made]

    def run(batches):
        for batch, columns in step(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names)
            del batch, columns
        give_back()

    return df.mapInArrow(run, schema)


def _spec(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # of fixed size


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add column ``ids`` (array of int) with the token ids of ``text``."""
    spec = _spec(df, path)

    def step(batches) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        bpe = PairIndexBpe(spec.value)
        for batch, texts in text_steps(batches, text, 1_000_000):
            yield batch, [int_lists(*bpe.encode(texts), pa.int32())]

    return _mapped(df, {ids: T.ArrayType(T.IntegerType())}, step)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add column ``decoded`` with the text of the token ids."""
    spec = _spec(df, path)

    def step(batches) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        bpe = PairIndexBpe(spec.value)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                yield part, [bpe.decode(part.column(ids))]

    return _mapped(df, {decoded: T.StringType()}, step)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass of the tasks: one Python worker a task instead of two."""
    spec = _spec(df, path)

    def step(batches) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        bpe = PairIndexBpe(spec.value)
        for batch, texts in text_steps(batches, text, 1_000_000):
            lists = int_lists(*bpe.encode(texts), pa.int32())
            yield batch, [lists, bpe.decode(lists)]

    return _mapped(df, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, step)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents, by way of ``encode_decode``."""
    out = encode_decode(df.select("doc_id", "text"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

"""Operator 9: scoring texts with a hidden Markov language model.

Tokens: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+``, then one end token a text.
A token belongs to a class: one of ``CLASSES`` by the hash of the word, or the
class of the end token. A latent state emits classes, and a class emits its
words in proportion to their corpus count plus one, with one share for all unseen
words. So the model is a distribution over all texts, and its size is fixed, however many words there are.

The corpus is read once into chunks: token numbers local to the chunk, and the
words' hashes with their counts among training documents. Word counts are summed by a
shuffle on the hash and sent back to the chunks that hold the word. Baum-Welch
runs over all training documents of all chunks, each a whole sequence: the forward pass keeps its vector at every
``STRETCH``-th token, and the backward pass, from the document's end, makes the forward vectors between these anew.
Each task sums its expected counts and a shuffle adds them up by class. Where the states begin depends on the words'
hashes and corpus counts alone, and every round reads all training documents, so the scores do not depend on how the input is split (but
for the rounding of sums). Rounds end when the likelihood settles, or after ``rounds``. The scaled forward recursion over the whole text gives its exact likelihood.

Words are told apart by 64 bits of XXH64; among a billion words, two share
one with a chance of 3 %.

Defined results: null and empty texts hold the end token alone. A null id is not held out.
Repeated rows give one row each. Without training documents all words are unseen. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import cut, sums, text_steps

CLASSES, STATES, STRETCH, GROUP = 1 << 15, 4, 256, 2048
END = CLASSES
CHUNK_CHARS = 32_000_000
#: Strength of the corpus share of a class in a state's emissions, and of even odds in its transitions.
KEEP, EVEN = 200.0, 1.0


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def spread(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def is_held_out(doc_id, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def chunked(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    """One row a chunk: ids, lens (tokens of each text, end included), train (1 or 0
    each), tokens (local numbers; the end is the last number), classes (of the
    numbers), and for the words h (hash) and n (count in training texts)."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids, lens, train, parts, counts, at, chars = [], [], [], [], [], {}, 0

        def close() -> pa.RecordBatch:
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in at), np.uint64, len(at))
            n = np.zeros(len(at), np.int32)
            for p, t in zip(parts, train):
                if t:
                    np.add.at(n, p, 1)
            tokens = np.concatenate([x for p in parts for x in (p, np.array([len(at)], np.int32))]).astype("<i4")
            classes = np.append(h & np.uint64(CLASSES - 1), np.uint64(END)).astype("<u2")
            row = {
                "chunk": pa.array([chunk], pa.int64()), "ids": pa.array([ids], pa.list_(id_type)), "lens": pa.array([lens], pa.list_(pa.int32())),
                "train": pa.array([train], pa.list_(pa.int32())), "tokens": pa.array([squeeze(tokens)], pa.binary()), "classes": pa.array([squeeze(classes)], pa.binary()),
                "h": pa.array([h.view(np.int64)], pa.list_(pa.int64())), "n": pa.array([n], pa.list_(pa.int32())),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch, texts in text_steps(batches, "text", 1_000_000):
            id_type = batch.column("doc_id").type
            if ids and chars + sum(map(len, texts)) > CHUNK_CHARS:
                yield close()
                chunk += 1
                ids, lens, train, parts, at, chars = [], [], [], [], {}, 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                words = text.encode("utf-8", "replace").lower().split()  # on bytes: A-Z and the six ASCII spaces only
                known = at.setdefault
                parts.append(np.fromiter((known(w, len(at)) for w in words), np.int32, len(words)))
                ids.append(doc_id)
                lens.append(len(words) + 1)
                train.append(int(not is_held_out(doc_id, folds, fold)))
                chars += len(text)
        if ids:
            yield close()

    return read.mapInArrow(run, f"chunk long, ids array<{kind}>, lens array<int>, train array<int>, tokens binary, classes binary, h array<long>, n array<int>")


class Hmm:
    """start (states), move (states x states), emit (classes x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, share: np.ndarray, states: int) -> Hmm:
        """A start from the classes' corpus shares, each state leaning to other classes."""
        lean = np.random.default_rng(5).uniform(0.5, 1.5, (len(share), states))
        emit = share[:, None] * lean
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(move, 0.9)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Hmm:
        """From expected counts."""
        emit = emit + KEEP * share[:, None]
        move = move + EVEN
        start = start + EVEN
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10(self, classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Scaled forward recursion: log10 likelihood of each of the texts that lie one after the other."""
        order = np.argsort(-lens, kind="stable")
        first = (np.cumsum(lens) - lens)[order]
        size = lens[order]
        out = np.zeros(len(lens))
        a = self.start * self.emit[classes[first]]
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))  # texts with more than t tokens
            if t:
                a = (a[:n] @ self.move) * self.emit[classes[first[:n] + t]]
            s = a.sum(axis=1)
            a /= s[:, None]
            out[:n] += np.log10(s)
        back = np.empty(len(lens))
        back[order] = out
        return back

    def forward(self, classes: np.ndarray, at: np.ndarray, n: np.ndarray, begin: int, a: np.ndarray | None):
        """(classes, scaled forward vectors, scales) of the tokens begin .. begin + STRETCH - 1 of the texts, longest
        first, that begin at the places and have n tokens; a holds the vectors of the tokens before."""
        steps = np.arange(begin, min(begin + STRETCH, int(n[0])))
        for t, m in zip(steps.tolist(), np.searchsorted(-n, -steps, side="left").tolist()):
            seen = classes[at[:m] + t]
            a = (self.start if t == 0 else a[:m] @ self.move) * self.emit[seen]
            s = a.sum(axis=1, keepdims=True)
            a = a / s
            yield seen, a, s

    def expected(self, classes: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
        """Add the expected counts of the texts (their first places and sizes) to start, move and emit; their log likelihood."""
        likelihood = 0.0
        states = len(self.start)
        order = np.argsort(-size, kind="stable")
        for k in range(0, len(order), GROUP):
            at, n = first[order[k : k + GROUP]], size[order[k : k + GROUP]]
            borders = [None]  # the forward vectors before each stretch
            for begin in range(0, int(n[0]) - STRETCH, STRETCH):
                for _, a, _ in self.forward(classes, at, n, begin, borders[-1]):
                    pass
                borders.append(a)
            on = np.zeros((0, states))  # what the token after says, for the texts that have one
            for i in range(len(borders) - 1, -1, -1):
                seen, forward, scale = map(list, zip(*self.forward(classes, at, n, i * STRETCH, borders.pop())))
                for t in range(len(seen) - 1, -1, -1):
                    m = len(on)
                    move += self.move * (forward[t][:m].T @ on)
                    b = np.concatenate([on @ self.move.T, np.ones((len(seen[t]) - m, states))])
                    on = self.emit[seen[t]] * b / scale[t]
                    forward[t] = forward[t] * b
                likelihood += float(np.log(np.concatenate(scale)).sum())
                places, weights = np.concatenate(seen), np.concatenate(forward)
                for s in range(states):
                    emit[:, s] += np.bincount(places, weights=weights[:, s], minlength=len(emit))
            start += forward[0].sum(axis=0)
        return likelihood


def _expected(chunks: DataFrame, model: Hmm, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of start, move and emit over all chunks, and the log likelihood. What reaches the driver has the size of the model."""
    held = chunks.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches):
        model = Hmm(*held.value)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states))
        likelihood = np.zeros((1, states))
        for batch in batches:
            for row in batch.to_pylist():
                classes = spread(row["classes"], "<u2")[spread(row["tokens"], "<i4")]
                lens, used = np.array(row["lens"], np.int64), np.array(row["train"]) > 0
                if used.any():
                    likelihood[0, 0] += model.expected(classes, (np.cumsum(lens) - lens)[used], lens[used], start, move, emit)
        # rows 0 .. CLASSES: emissions of a class; then transitions from a state; then the start and the likelihood
        table = np.concatenate([emit, move, start[None, :], likelihood])
        kept = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_pydict({"row": pa.array(kept), **{f"s{s}": pa.array(table[kept, s]) for s in range(states)}})

    schema = "row long, " + ", ".join(f"s{s} double" for s in range(states))
    added = chunks.select("lens", "train", "tokens", "classes").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)])
    table = np.zeros((CLASSES + 1 + states + 2, states))
    for r in added.collect():
        table[r["row"]] = r[1:]
    return table[-2], table[CLASSES + 1 : -2], table[: CLASSES + 1], float(table[-1, 0])


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2,
    states: int = STATES, rounds: int = 6, settled: float = 0.01,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text. Training ends when a
    round adds less than ``settled`` nats a token."""
    chunks = cut(chunked(docs, id_col, text_col, folds, fold))
    places = chunks.select("chunk", F.posexplode(F.arrays_zip("h", "n")).alias("at", "word")).select("chunk", "at", "word.h", "word.n")
    counts = cut(places.groupBy("h").agg(F.sum("n").alias("c")))
    word_class = F.col("h").bitwiseAND(F.lit(CLASSES - 1).cast("long"))
    per_class = counts.where("c > 0").groupBy(word_class.alias("g")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # one row a class
    mass, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in per_class:
        mass[r["g"]], kinds[r["g"]] = r["c"], r["v"]
    texts = chunks.agg(F.sum(F.aggregate("train", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    mass[END], kinds[END] = texts, 0  # the end is the only token of its class
    total, distinct = int(mass.sum()), int(kinds.sum()) + (texts > 0)
    share = (mass + kinds + 1) / (mass + kinds + 1).sum()

    model = Hmm.first(share, states)
    if total:
        before = -math.inf
        for _ in range(rounds):
            *counted, likelihood = _expected(chunks, model, states)
            model = Hmm.of(*counted, share)
            if likelihood - before < settled * total:
                break
            before = likelihood

    # counts of the words back to their chunks, in the order of the local numbers
    routed = places.select("chunk", "at", "h").join(counts, "h").select("chunk", "at", "c")

    def gather(table):
        at, c = (table.column(k).to_numpy() for k in ("at", "c"))
        out = np.zeros(len(at), "<i8")
        out[at] = c
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([squeeze(out)], pa.binary())})

    counted = routed.groupBy("chunk").applyInArrow(gather, "chunk long, counts binary")
    whole = chunks.select("chunk", "ids", "lens", "train", "tokens", "classes").join(counted, "chunk", "left").drop("chunk")
    held = docs.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit, np.log10(mass + kinds + 1)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        *parts, spent = held.value
        model = Hmm(*parts)
        for batch in batches:
            id_type = batch.column("ids").type.value_type
            for row in batch.to_pylist():
                lens = np.array(row["lens"], np.int64)
                tokens = spread(row["tokens"], "<i4")
                classes = spread(row["classes"], "<u2")
                c = np.append(spread(row["counts"], "<i8") if row["counts"] is not None else np.zeros(0, np.int64), texts)
                seen = sums(np.log10(c + 1.0)[tokens], lens)
                of_class = np.log10(c + 1.0) - spent[classes]  # log10 of a word's share of its class
                of_class[-1] = 0.0
                hidden = model.log10(classes[tokens], lens)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["ids"], id_type), "held_out": pa.array(np.array(row["train"]) == 0),
                    "n_tokens": pa.array(lens), "n_known": pa.array(sums((c > 0)[tokens].astype(np.int64), lens).astype(np.int64)), "train_tokens": pa.array(np.full(len(lens), total, np.int64)),
                    "base_score": pa.array(seen - lens * math.log10(total + distinct + 1)), "score": pa.array(hidden + sums(of_class[tokens], lens)),
                })

    return whole.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


"""Operator 4: language identification by character language models.

One interpolated Kneser-Ney model of character ``order``-grams per language.
A model sees a text as its words (runs of letters with their marks, lower
case), each between two border signs; contexts do not cross borders. N-gram
probabilities and context weights lie in arrays sorted by the 64-bit hash of the
n-gram and are found by binary search. A text's cross-entropy under a model is
the negative log2 probability of its words divided by their characters (ends
included); the language with the lowest one is predicted, ties by code point.

Training uses whole texts of at most ``per_language`` documents of each
language, those with the smallest hash of their id among the rows that are not
held out. This bound is the only sample; every row is judged on its whole text.

Rejection is calibrated for each language on sample documents that were left out of the
counts (of a language with few documents, each under a model without it). m is the ``HIGH`` quantile of the cross-entropies of its own documents.
g is the least of the ``LOW`` quantiles of what is foreign to it: its own documents with their letters
shuffled, and the documents of each other language under its model, unless these lie below m (a
language that it cannot be told from). With w the deviation of a single word's cross-entropy, a text of n words is
rejected when its cross-entropy is above m + LIMIT (g - m) + 3 w / sqrt(n): when it is half of
the way to the nearest foreign texts, with an allowance for few words. ``score`` is the softmax of the log
probabilities of the text, at most as sure as ``SURE`` characters make it.

Defined results: null text or no letter: ``und``, score 0, rejected. Without
any training row: ``und`` and score 0 for all, rejected. Repeated rows and null ids give one row
each (a null id counts as not held out, and is never learnt from). Ids that
repeat may bring more than ``per_language`` rows with the same smallest hashes; rows beyond that bound
are not learnt from. Other columns pass through; an input column named as an
output column is replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import Memo, cut, give_back, sums, text_steps
from threadmill.session import bounded_broadcast

UND = "und"
ORDER, PER_LANGUAGE, MOST_CHARS, DISCOUNT, SURE = 4, 300, 5_000_000, 0.75, 50
HIGH, LOW, LIMIT = 0.95, 0.25, 0.5
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START, END = 0xE000, 0xE001  # border signs: code points for private use, which no word holds
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each place (places before n - 1 are void)."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(n - 1, -1, -1):
        out[n - 1 :] = (out[n - 1 :] ^ (codes[n - 1 - k : len(codes) - k].astype(np.uint64) + np.uint64(1))) * MIX
        out ^= out >> np.uint64(29)
    return out


def laid_out(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after order - 1 start signs and before an end sign; lengths with these."""
    joined = "".join(chr(START) * (order - 1) + w + chr(END) for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(codes == END)
    return codes, np.diff(ends, prepend=-1)


class KneserNey:
    """One language: for each n, sorted n-gram hashes with discounted
    probabilities, and sorted context hashes with the weight of the next lower model."""

    def __init__(self, words: Counter, order: int, letters: int):
        self.order, self.floor = order, 1.0 / (letters + 1)
        names = sorted(words)
        codes, lens = laid_out(names, order)
        ends = np.cumsum(lens)
        own = np.concatenate([np.arange(e - n + order - 1, e) for e, n in zip(ends, lens)]) if names else np.zeros(0, int)
        times = np.repeat(np.array([words[w] for w in names], np.float64), lens - (order - 1))
        self.grams, self.probs, self.contexts, self.weights = [], [], [], []
        count, gram = times, hashes(codes, order)[own] if len(codes) >= order else np.zeros(0, np.uint64)
        for n in range(order, 0, -1):
            keys, first, at = np.unique(gram, return_index=True, return_inverse=True)
            total = np.bincount(at, weights=count, minlength=len(keys))
            where = own[first]
            context = hashes(codes, n - 1)[where - 1] if n > 1 else np.zeros(len(keys), np.uint64)
            heads, at = np.unique(context, return_inverse=True)
            mass = np.bincount(at, weights=total, minlength=len(heads))
            kinds = np.bincount(at, minlength=len(heads))
            self.grams.append(keys)
            self.probs.append((total - DISCOUNT * np.minimum(total, 1)) / mass[at] if len(keys) else total)
            self.contexts.append(heads)
            self.weights.append(DISCOUNT * kinds / np.maximum(mass, 1e-9))
            # the next lower model counts the distinct signs that stand before its n-grams
            own = where
            gram, count = hashes(codes, n - 1)[where] if n > 1 else gram, np.ones(len(keys))


class Identifier:
    """Models of all languages side by side (one sorted hash array for each n,
    with a column for each language) and their limits of rejection."""

    def __init__(self, languages: list[str], order: int, floor: float, grams: list, contexts: list, limits: np.ndarray):
        self.languages, self.order, self.floor, self.grams, self.contexts, self.limits = languages, order, floor, grams, contexts, limits
        self.memo = None

    @classmethod
    def of(cls, languages: list[str], models: list[KneserNey], limits: np.ndarray) -> Identifier:
        if not models:
            return cls([], 0, 1.0, [], [], limits)
        grams = cls.beside([m.grams for m in models], [m.probs for m in models], 0.0)
        contexts = cls.beside([m.contexts for m in models], [m.weights for m in models], 1.0)
        return cls(languages, models[0].order, models[0].floor, grams, contexts, limits)

    def parts(self) -> tuple:
        """What ``Identifier(*parts)`` needs: plain arrays."""
        return self.languages, self.order, self.floor, self.grams, self.contexts, self.limits

    @staticmethod
    def beside(keys: list, values: list, other: float) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for k in range(len(keys[0])):
            union = np.unique(np.concatenate([x[k] for x in keys]))
            table = np.full((len(union) + 1, len(keys)), other)  # the last row stands for n-grams that no model has
            for m, (x, v) in enumerate(zip(keys, values)):
                table[np.searchsorted(union, x[k]), m] = v[k]
            out.append((union, table))
        return out

    @staticmethod
    def found(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        keys, values = table
        i = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return values[np.where(keys[i] == wanted, i, len(keys))]

    def log2(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each place of the words under each model, and the places of each word."""
        order = self.order
        codes, lens = laid_out(words, order)
        kept = lens - (order - 1)
        own = np.arange(int(kept.sum())) + np.repeat(np.arange(1, len(lens) + 1) * (order - 1), kept)
        runs = [np.zeros(len(codes), np.uint64), *(hashes(codes, n) for n in range(1, order + 1))]
        p = np.full((len(own), len(self.languages)), self.floor)
        for n in range(1, order + 1):
            k = order - n
            p = self.found(self.grams[k], runs[n][own]) + self.found(self.contexts[k], runs[n - 1][own - 1]) * p
        return np.log2(p), kept

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: log2 probability under each model, then its characters (end included)."""
        places, kept = self.log2(words)
        table = np.column_stack([sums(places, kept), kept])
        return table.ravel(), np.full(len(words), table.shape[1], np.int64)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sums of ``learn`` over its words, and the number of its words."""
        if self.memo is None:
            self.memo = Memo(self.learn, np.float32, most=300_000)
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = words_of(t)
            counts[i] = len(w)
            words += w
        wide = len(self.languages) + 1
        found = self.memo.find(words)
        return sums(self.memo.arena[: self.memo.used].reshape(-1, wide)[found], counts), counts

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        totals, counts = self.totals(texts)
        chars = np.maximum(totals[:, -1:], 1)
        entropy = -totals[:, :-1] / chars
        best = entropy.argmin(axis=1)
        lowest = entropy.min(axis=1)
        sure = np.exp2(-(entropy - lowest[:, None]) * np.minimum(chars, SURE))
        score = 1.0 / sure.sum(axis=1)
        m, g, w = self.limits[best].T
        rejected = lowest > m + LIMIT * (g - m) + 3 * w / np.sqrt(np.maximum(counts, 1))
        void = counts == 0
        return [UND if v else self.languages[b] for v, b in zip(void, best)], np.where(void, 0.0, score), rejected | void

    @classmethod
    def fit(cls, sample: list[tuple[str, str]], order: int = ORDER) -> Identifier:
        """From (language, text) rows. Every fifth document of a language calibrates."""
        by: dict[str, list[list[str]]] = {}
        for lang, text in sorted(sample):
            if words := words_of(text):
                by.setdefault(lang, []).append(words)
        languages = sorted(by)
        alphabet = sorted({c for docs in by.values() for d in docs for w in d for c in w})
        held = {lang: docs[::5] if len(docs) >= 10 else docs for lang, docs in by.items()}
        models = []
        for lang in languages:
            counted: Counter = Counter()
            for k, d in enumerate(by[lang]):
                if len(by[lang]) < 10 or k % 5:
                    counted.update(d)
            models.append(KneserNey(counted, order, len(alphabet)))
        limits = np.zeros((len(languages), 3))
        one = cls.of(languages, models, limits)
        draw = np.random.default_rng(3)

        def entropies(model: Identifier, docs: list[list[str]]) -> np.ndarray:
            """Cross-entropy of each document under each model."""
            tables = [model.learn(d)[0].reshape(len(d), -1).sum(axis=0) for d in docs]
            return np.array([-t[:-1] / t[-1] for t in tables])

        def shuffled(d: list[str]) -> list[str]:
            signs, ends = draw.permutation(list("".join(d))), np.cumsum([len(w) for w in d])
            return ["".join(signs[e - len(w) : e]) for w, e in zip(d, ends)]

        under = [entropies(one, held[lang]) for lang in languages]
        for k, lang in enumerate(languages):
            own, few = under[k][:, k], by[lang]
            if 1 < len(few) < 10:
                rest = [KneserNey(Counter(w for j, d in enumerate(few) if j != i for w in d), order, len(alphabet)) for i in range(len(few))]
                own = np.array([entropies(cls.of([lang], [m], limits), [d])[0, 0] for m, d in zip(rest, few)])
            m = np.quantile(own, HIGH)
            noise = entropies(one, [shuffled(d) for d in held[lang]])[:, k]
            others = [np.quantile(under[j][:, k], LOW) for j in range(len(languages)) if j != k]
            g = max(m, min([np.quantile(noise, LOW), *(x for x in others if x > m)]))
            words = one.learn([w for d in held[lang] for w in d])[0].reshape(-1, len(languages) + 1)
            limits[k] = m, g, (-words[:, k] / words[:, -1]).std() + 0.02
        return one


def held_out(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, order: int = ORDER,
          most_chars: int = MOST_CHARS) -> Identifier:
    """Models from the bounded sample: ``per_language`` documents and about ``most_chars`` characters a language, whole texts
    of at most that length. Ids alone are ranked; texts are read for the chosen ones only, by all tasks at once."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    keyed = known.withColumn("k", F.xxhash64(F.col("id").cast("string"), F.lit("sample")))
    chosen = keyed.select("lang", "k", "id").withColumn("salt", F.pmod("k", F.lit(64)))
    for part in (["lang", "salt"], ["lang"]):  # the smallest of each salt, then of each language: no task sees a whole language
        first = F.row_number().over(Window.partitionBy(*part).orderBy("k", "id"))
        chosen = chosen.withColumn("r", first).where(F.col("r") <= per_language)
    chosen = bounded_broadcast(cut(chosen.select("lang", "k", "id").distinct()))
    rows = known.withColumn("k", F.xxhash64(F.col("id").cast("string"), F.lit("sample"))).join(chosen, ["lang", "k", "id"], "left_semi")
    rows = rows.groupBy("lang", "k", "id").agg(F.min("text").alias("text"))  # repeated rows of an id are one
    # whole texts in the sample's order, as long as the characters before them are fewer than the bound
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("k", "id")) - F.length("text")
    rows = rows.withColumn("before", before).where((F.col("before") < most_chars) & (F.length("text") <= most_chars))
    sample = [(r["lang"], r["text"]) for r in rows.select("lang", "text").collect()]
    return Identifier.fit(sample, order)


def identify(docs: DataFrame, model: Identifier, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Add the predicted language, its score and whether the text was rejected."""
    made = [lang_pred, score, rejected]
    kept = [c for c in docs.columns if c not in made]
    held = docs.sparkSession.sparkContext.broadcast(model.parts())  # bounded by the training sample
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in kept), T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])

    def run(batches):
        own = Identifier(*held.value)
        for batch, texts in text_steps(batches, text_col):
            lang, p, no = own.judge(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(p, pa.float64()), pa.array(no, pa.bool_())], [*kept, *made])
            del batch, texts
        del own
        give_back()

    return docs.mapInArrow(run, schema)

"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order four over the letters of words: a letter is predicted from up to three
letters before it in its word (a space stands before and after). Highest-order counts are plain, lower
orders count distinct left contexts, except for sequences that start a word, which have none. Counts
come from all training rows, are summed per worker over distinct words first, and end in sorted arrays
of whole sequences, so no two share a count; the arrays are as long as there are distinct sequences. A text goes to the
language with the lowest cross-entropy per letter. Texts are rejected above a limit that is halfway
between what training texts reach under the counts of the others and what the same texts with reversed words reach; short texts get more room.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import whole
from flowtide.session import cut

ORDER = 4
#: size of the alphabet that unknown letters are spread over
ALPHABET = 1 << 10
#: distinct words a worker keeps the scores of, or counts before it hands counts on
KEPT_WORDS = 150_000
#: words whose letters are scored or counted at a time
PART_WORDS = 8192
#: one of so many training documents is left out of the counts that the limits are taken under
CALIBRATION = 8
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = " "


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def letters(word: str) -> str:
    """The word without numerals that count as word characters."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def sequences(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter and closing space of the words: the codes of it and of up to three characters
    before it packed into 64 bits, how many characters that are (2 to 4), and the word's number."""
    padded = [f"{_SPACE}{w}{_SPACE}" for w in found]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where(codes < 65536, codes, codes % np.uint64(65521))
    ends = np.cumsum(lengths)
    within = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    key = codes.copy()
    for back in range(1, ORDER):
        before = np.concatenate((np.zeros(back, np.uint64), codes[:-back])) if len(codes) > back else np.zeros(len(codes), np.uint64)
        key |= np.where(within >= back, before, np.uint64(0)) << np.uint64(16 * back)
    predicted = within > 0
    return key[predicted], np.minimum(within[predicted] + 1, ORDER), np.repeat(np.arange(len(found)), lengths)[predicted]


def buckets(keys: np.ndarray, order: int, context: bool) -> np.ndarray:
    """The last ``order`` characters, or the context before the last one, packed as in ``sequences``."""
    keys = keys >> np.uint64(16) if context else keys
    size = order - 1 if context else order
    return keys & np.uint64((1 << (16 * size)) - 1)


@dataclass
class Model:
    """Per order: sorted packed sequences with counts per language, of sequences and of contexts."""

    languages: list[str]
    sequence_keys: list[np.ndarray]
    sequence_counts: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_totals: list[np.ndarray]
    context_kinds: list[np.ndarray]
    discounts: np.ndarray
    limit: float = float("inf")
    spread: float = 0.0
    sharpness: float = 1.0

    def word_bits(self, found: list[str]) -> np.ndarray:
        """Per word: bits under each language, and the number of predictions in the last column."""
        keys, sizes, of = sequences(found)
        # a sequence says how long it is, and the same ones come up in many words
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        sizes = sizes[at]
        p = np.full((len(keys), len(self.languages)), 1.0 / ALPHABET)
        for k in range(ORDER):
            rows = np.flatnonzero(sizes > k)
            count = _lookup(self.sequence_keys[k], self.sequence_counts[k], buckets(keys[rows], k + 1, False))
            context = buckets(keys[rows], k + 1, True)
            total = _lookup(self.context_keys[k], self.context_totals[k], context)
            kinds = _lookup(self.context_keys[k], self.context_kinds[k], context)
            d = self.discounts[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = (np.maximum(count - d, 0.0) + d * kinds * p[rows]) / total
            p[rows] = np.where(total > 0, mixed, p[rows])
        bits = np.zeros((len(found), len(self.languages) + 1))
        cost = -np.log2(np.maximum(p, 1e-12))[back]
        for j in range(len(self.languages)):
            bits[:, j] = np.bincount(of, cost[:, j], minlength=len(found))
        bits[:, -1] = np.bincount(of, minlength=len(found))
        return bits


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0.0)


class Scorer:
    """Bits of whole texts; keeps the bits of the words it has met."""

    def __init__(self, model: Model, reverse: bool = False):
        self.model, self.reverse = model, reverse
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages) + 1))

    def texts(self, texts: list[str]) -> np.ndarray:
        found = [words(t) for t in texts]
        if len(self.numbers) > KEPT_WORDS:
            self.numbers, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in self.numbers]
        if new:
            self.numbers.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            parts = [self.table]
            for i in range(0, len(new), PART_WORDS):
                spelled = [letters(w)[::-1] if self.reverse else letters(w) for w in new[i : i + PART_WORDS]]
                bits = self.model.word_bits(spelled)
                bits[[not s for s in spelled]] = 0.0
                parts.append(bits)
            self.table = np.concatenate(parts)
        out = np.zeros((len(texts), self.table.shape[1]))
        get = self.numbers.__getitem__
        for i, w in enumerate(found):
            if w:
                out[i] = self.table[np.fromiter(map(get, w), np.int64, len(w))].sum(axis=0)
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, size, n): plain counts of all character sequences that end in each letter, at full
    length, and at two or three characters where the word has just begun."""
    counts: dict[str, Counter] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            merged: dict[str, int] = Counter()
            for w, n in counter.items():
                if s := letters(w):
                    merged[s] += n
            found, times = list(merged), np.fromiter(merged.values(), np.int64, len(merged))
            tagged, size, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i in range(0, len(found), PART_WORDS):
                keys, sizes, of = sequences(found[i : i + PART_WORDS])
                keys, sizes, weights = np.concatenate((tagged, keys)), np.concatenate((size, sizes)), np.concatenate((n, times[i + of]))
                tagged, where = np.unique(keys, return_inverse=True)
                n = np.bincount(where, weights, len(tagged)).astype(np.int64)
                size = np.zeros(len(tagged), np.int64)
                size[where] = sizes
            if not len(tagged):
                continue
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(tagged)), pa.array(tagged.view(np.int64)), pa.array(size), pa.array(n)], ["lang", "key", "size", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_t"), strict=True):
            counts.setdefault(lang, Counter()).update(words(text.as_py()))
        if sum(map(len, counts.values())) > KEPT_WORDS:
            yield from emit()
            counts = {}
    yield from emit()


def _tables(grams: DataFrame) -> list[DataFrame]:
    """Per order from one to four: (lang, key, n) with continuation counts below the highest."""
    high = cut(grams.groupBy("lang", "key", "size").agg(F.sum("n").alias("n")))
    out = [high.where("size = 4").select("lang", "key", "n")]
    for size in (3, 2, 1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << (16 * size)) - 1)).alias("key")
        continued = out[0].select("lang", shorter).groupBy("lang", "key").agg(F.count("*").alias("n"))
        begun = high.where(F.col("size") == size).select("lang", "key", "n")
        out.insert(0, cut(continued.union(begun).groupBy("lang", "key").agg(F.sum("n").alias("n"))))
    return out


def _hashed(order: int, languages: list[str], table: DataFrame) -> tuple:
    """The arrays of one order; a row per language and distinct sequence or context comes back."""

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy().view(np.uint64)
            own, context = (buckets(keys, order, side).astype(np.int64) for side in (False, True))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(own), pa.array(context), b.column("n")], ["lang", "own", "context", "n"])

    hashed = cut(table.mapInArrow(to_buckets, "lang string, own long, context long, n long"))
    by_sequence = hashed.groupBy("lang", F.col("own").alias("k")).agg(F.sum("n").alias("n"), F.lit(0).alias("kinds"))
    by_context = hashed.groupBy("lang", F.col("context").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    once, twice = (hashed.where(F.col("n") == i).groupBy("lang").agg(F.count("*").alias("c")) for i in (1, 2))
    position = {lang: i for i, lang in enumerate(languages)}

    def arrays(frame: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = frame.toArrow()
        keys, where = np.unique(got.column("k").to_numpy().astype(np.uint64), return_inverse=True)
        lang = np.array([position[x] for x in got.column("lang").to_pylist()], np.int64)
        n, kinds = np.zeros((len(keys), len(languages))), np.zeros((len(keys), len(languages)))
        n[where, lang] = got.column("n").to_numpy()
        kinds[where, lang] = got.column("kinds").to_numpy()
        return keys, n, kinds

    n1, n2 = ({r["lang"]: r["c"] for r in f.collect()} for f in (once, twice))
    d = [n1.get(x, 0) / (n1.get(x, 0) + 2 * n2.get(x, 0)) if n1.get(x, 0) else 0.5 for x in languages]
    keys, counts, _ = arrays(by_sequence)
    context_keys, totals, kinds = arrays(by_context)
    return keys, counts, context_keys, totals, kinds, np.clip(d, 0.05, 0.95)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _counted(grams: DataFrame) -> Model | None:
    """A model of the counts, without a limit; None without counts."""
    tables = _tables(grams)
    languages = sorted(r["lang"] for r in tables[0].select("lang").distinct().collect())
    if not languages:
        return None
    parts = [_hashed(k + 1, languages, t) for k, t in enumerate(tables)]
    return Model(languages, *([p[i] for p in parts] for i in range(5)), np.array([p[5] for p in parts]))


def fit(train: DataFrame, calibration: DataFrame) -> Model | None:
    """A model of all rows (lang, _t) of both tables; None without rows. Its limits are what ``calibration``
    reaches under a model of ``train`` alone; there are none if either is empty."""
    spark = train.sparkSession
    counted, rest = (cut(rows.mapInArrow(_count_words, "lang string, key long, size long, n long")) for rows in (train, calibration))
    model, part = _counted(counted.unionAll(rest)), _counted(counted)
    if model is None or part is None:
        return model
    shared = spark.sparkContext.broadcast(part)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, noise = Scorer(shared.value), Scorer(shared.value, reverse=True)
        known = {x: i for i, x in enumerate(shared.value.languages)}
        for b in batches:
            texts = b.column("_t").to_pylist()
            bits, other = scorer.texts(texts), noise.texts(texts)
            own = np.array([known.get(x, -1) for x in b.column("lang").to_pylist()])
            # a language that is only in the calibration rows says nothing about texts of known ones
            kept = (bits[:, -1] > 0) & (own >= 0)
            rate, own = bits[kept, :-1] / bits[kept, -1:], own[kept]
            best = rate.min(axis=1)
            rivals = rate.copy()
            rivals[np.arange(len(own)), own] = np.inf
            margin = rivals.min(axis=1) - rate[np.arange(len(own)), own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(best), pa.array(other[kept, :-1].min(axis=1) / other[kept, -1]), pa.array(bits[kept, -1]), pa.array(np.where(np.isfinite(margin), margin, 10.0))],
                ["best", "noise", "n", "margin"],
            )

    seen = calibration.mapInArrow(measure, "best double, noise double, n double, margin double").agg(
        F.percentile_approx("best", 0.999, 1000).alias("top"), F.percentile_approx("noise", 0.5, 1000).alias("noise"),
        F.avg("best").alias("mean"), F.percentile_approx("margin", 0.5, 1000).alias("margin"), F.stddev_pop(F.col("best") * F.sqrt("n")).alias("spread"),
    ).first()
    if seen["top"] is not None:
        model.limit = (seen["top"] + max(seen["noise"], seen["top"])) / 2
        model.spread = 3.0 * (seen["spread"] or 0.0) / max(1.0, seen["mean"])
        model.sharpness = float(np.clip(6.0 / max(seen["margin"] or 0.0, 1e-3), 1.0, 1e4))
    return model


def score(docs: DataFrame, model: Model | None, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score, entropy and rejected."""
    spark = docs.sparkSession
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for b in batches:
            bits = scorer.texts(b.column("_t").to_pylist())
            n = bits[:, -1]
            rate = bits[:, :-1] / np.maximum(n, 1)[:, None]
            best = rate.argmin(axis=1)
            entropy = rate[np.arange(len(best)), best]
            weight = np.exp2(-np.minimum((rate - entropy[:, None]) * m.sharpness, 1000.0))
            known = n > 0
            limit = m.limit + m.spread / np.sqrt(np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in keep),
                    pa.array([m.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]),
                    pa.array(np.where(known, 1.0 / weight.sum(axis=1), 0.0)),
                    pa.array(np.where(known, entropy, 0.0), mask=~known),
                    pa.array(~known | (entropy > limit)),
                ],
                [*keep, "lang_pred", "score", "entropy", "rejected"],
            )

    return docs.select(*keep, whole(F.col(text)).alias("_t")).mapInArrow(predict, f"{kinds}, lang_pred string, score double, entropy double, rejected boolean")


def learned(docs: DataFrame, doc_id: str, text: str, lang: str) -> Model | None:
    """The model of the rows of ``docs`` that may be learned from."""
    number = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    rows = docs.where(F.col(lang).isNotNull() & (fold(F.col(doc_id)) != 1)).select(
        F.col(lang).alias("lang"), whole(F.col(text)).alias("_t"), (F.floor(number / 3) % CALIBRATION == 0).alias("_c")
    )
    return fit(rows.where("not _c").drop("_c"), rows.where("_c").drop("_c"))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, entropy (bits per letter), rejected.

    The models learn from rows with a language whose crc32(id) mod 3 is not 1; rows where it is 1 are
    held out. A null or empty text, or one without letters, is `und` with score 0 and is rejected; so is
    every text when no row can be learned from. Ties go to the language first in order. A null id is
    neither held out nor learned from. Rows that repeat are scored alike; other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.coalesce(fold(F.col(doc_id)) == 1, F.lit(False)).alias("held_out"))
    return score(base, learned(docs, doc_id, text, lang), "_text", ["doc_id", "held_out"])


def recognised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    names = docs.columns
    numbered = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    scored = score(numbered, learned(docs, doc_id, text, lang), f"_c{names.index(text)}", numbered.columns)
    return scored.where("not rejected").select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)))

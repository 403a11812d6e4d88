"""Benchmark decontamination: one FM-index per training shard, searched backward for every test window.

A shard is about a million words of whole documents. Words that no benchmark item has can be in no
occurrence; runs of them become one separator, and so do stretches shorter than the shortest
window. Over what is left a shard has its suffix array, the Burrows-Wheeler transform in a wavelet matrix
with rank counts, and every ``SAMPLE``-th suffix position. All windows are searched backward at
once; the rows found walk to the next sampled position, and the spans found are merged per document.
Everything about a document is found in its shard, so documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import row_key, utf8, without_rows

WINDOW = 13
#: a document of n words with h hit words is contaminated if h > 0 and LEAST * h >= n
LEAST = 20
SHARD_WORDS = 1 << 20
SAMPLE = 8
#: bytes of benchmark text that are searched at once; more text is searched in several passes
PASS_BYTES = 32 << 20

#: word bytes are digits, letters and all bytes above 0x7F; A-Z are lowered, the rest becomes a space
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


class Windows:
    """The distinct windows of benchmark items over a vocabulary, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, data in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(data)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(name)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.zeros((len(found), size), np.int32)
        for i, window in enumerate(found):
            self.ids[i, : len(window)] = window
        self.shortest = int(self.lengths.min()) if len(found) else 0


class FmIndex:
    """Backward search and location over a sequence of symbols >= 1; 0 ends it."""

    def __init__(self, symbols: np.ndarray, top: int):
        text = np.append(symbols, 0).astype(np.int32)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1)))).astype(np.int64)
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled)))
        self.positions = order[sampled]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.bwt
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = ((row >> shift) & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~ones))).astype(np.int32)
            self.levels.append((shift, zeros, int(zeros[-1])))
            row = np.concatenate((row[~ones], row[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each position."""
        first = np.zeros(len(symbol), np.int64)
        at = at.astype(np.int64)
        for shift, zeros, n_zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            z_at, z_first = zeros[at], zeros[first]
            at = np.where(one, n_zeros + at - z_at, z_at)
            first = np.where(one, n_zeros + first - z_first, z_first)
        return at - first

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, and their ranges of rows [low, high)."""
        low = np.zeros(len(windows.lengths), np.int64)
        high = np.full(len(windows.lengths), len(self.bwt), np.int64)
        alive = np.arange(len(low))
        for step in range(windows.ids.shape[1]):
            active = alive[windows.lengths[alive] > step]
            if not len(active):
                break
            symbol = windows.ids[active, windows.lengths[active] - 1 - step]
            low[active] = self.less[symbol] + self.rank(symbol, low[active])
            high[active] = self.less[symbol] + self.rank(symbol, high[active])
            alive = alive[low[alive] < high[alive]]
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the transform to a sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.less[symbol] + self.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.positions[self.sample_rank[rows]] + steps


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; only suffixes that still share their rank are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    bounds = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(bounds, np.arange(n), 0))
    width = 1
    while True:
        firsts = np.flatnonzero(np.append(bounds, True))
        sizes = np.diff(firsts)
        many = np.flatnonzero(sizes > 1)
        if not len(many):
            return order
        at = np.repeat(firsts[:-1][many], sizes[many]) + _within(sizes[many])
        own = order[at]
        behind = own + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        again = np.lexsort((second, rank[own]))
        own, second = own[again], second[again]
        order[at] = own
        group = rank[own]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        bounds[at] = new
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        width *= 2


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def search_shard(texts: list[bytes], windows: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Per text: its number of words, its merged hit spans [start, end) in words, the items found."""
    get = windows.vocabulary.get
    tokens = [[get(w, 0) for w in words(t)] for t in texts]
    counts = np.fromiter(map(len, tokens), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(counts)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not windows.shortest or not starts[-1]:
        return counts, spans, items
    flat = np.fromiter((x for t in tokens for x in t), np.int32, int(starts[-1]))
    known = flat > 0
    cut = np.zeros(len(flat) + 1, bool)
    cut[starts] = True
    begins = np.flatnonzero(known & (cut[:-1] | np.concatenate(([True], ~known[:-1]))))
    ends = np.flatnonzero(known & (cut[1:] | np.concatenate((~known[1:], [True])))) + 1
    long = ends - begins >= windows.shortest
    begins, sizes = begins[long], (ends - begins)[long]
    if not len(begins):
        return counts, spans, items
    at = np.repeat(begins, sizes) + _within(sizes)
    places = np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.ones(len(at) + len(sizes), np.int32)
    symbols[places] = flat[at]
    origin = np.zeros(len(symbols) + 1, np.int64)
    origin[places] = at
    index = FmIndex(symbols, len(windows.vocabulary) + 1)
    found, low, high = index.search(windows)
    if not len(found):
        return counts, spans, items
    rows = np.repeat(low, high - low) + _within(high - low)
    window = np.repeat(found, high - low)
    position = origin[index.locate(rows)]
    doc = np.searchsorted(starts, position, side="right") - 1
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, position, 1)
    np.add.at(edge, position + windows.lengths[window], -1)
    hit = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    # spans end at document bounds even if the next document starts with a hit
    on = hit[1:-1]
    span_starts = np.flatnonzero(on & (~hit[:-2] | cut[:-1]))
    span_ends = np.flatnonzero(on & (~hit[2:] | cut[1:])) + 1
    for d, a, b in zip((np.searchsorted(starts, span_starts, side="right") - 1).tolist(), span_starts.tolist(), span_ends.tolist(), strict=True):
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    for pair in np.unique(doc * len(windows.lengths) + window).tolist():
        d, w = divmod(pair, len(windows.lengths))
        items[d].update(windows.items[w])
    return counts, spans, items


_FOUND = "doc_id long, _key {}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(benchmark: DataFrame, item_id: str, text: str) -> list[list[tuple[str, bytes]]]:
    """The items in passes of ``PASS_BYTES``; a benchmark is a test set of known, small size, and its
    size is what is checked here."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), utf8(F.col(text)).alias("t"))
    out: list[list[tuple[str, bytes]]] = [[]]
    size = 0
    for row in rows.toLocalIterator():
        if size > PASS_BYTES:
            out.append([])
            size = 0
        out[-1].append((row["i"], bytes(row["t"])))
        size += len(row["t"])
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted as strings),
    contaminated, and ``spans`` (merged hit words [start, end)).

    Null texts have no words: no hits, not contaminated. Null item ids count as the item "". Items
    without words are ignored, repeated items count once. An empty documents table gives no rows,
    an empty benchmark no hits; other columns are ignored.
    """
    return _contamination(docs, benchmark, doc_id, text, item_id, F.xxhash64("_t"), "long").drop("_key")


def _contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, key: Column, key_type: str) -> DataFrame:
    """``find_contamination`` with a ``_key`` of the text (its bytes are ``_t``) beside each row."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("_t")).withColumn("_key", key)
    passes = _passes(benchmark, item_id, text)

    def one_pass(items: list[tuple[str, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value)

            def emit(ids: list, keys: list, texts: list[bytes]) -> pa.RecordBatch:
                counts, spans, found = search_shard(texts, windows)
                pairs = [[{"start": a, "end": b} for a, b in x] for x in spans]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(keys), pa.array(counts),
                        pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                    ],
                    ["doc_id", "_key", "n_words", "spans", "items"],
                )

            ids, keys, texts, size = [], [], [], 0
            for batch in batches:
                for i, k, t in zip(batch.column("doc_id").to_pylist(), batch.column("_key").to_pylist(), batch.column("_t"), strict=True):
                    ids.append(i)
                    keys.append(k)
                    texts.append(t.as_py())
                    size += len(texts[-1])
                    if size > 6 * SHARD_WORDS:
                        yield emit(ids, keys, texts)
                        ids, keys, texts, size = [], [], [], 0
            if ids:
                yield emit(ids, keys, texts)

        return source.mapInArrow(search, _FOUND.format(key_type))

    found = one_pass(passes[0]) if len(passes) == 1 else _joined_passes([one_pass(p) for p in passes])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (n_hit * LEAST >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def _joined_passes(parts: list[DataFrame]) -> DataFrame:
    """The spans and items of several passes over the same documents, merged per document."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    merge = F.udf(lambda lists: [{"start": a, "end": b} for a, b in _merged([(s["start"], s["end"]) for x in lists for s in x])], "array<struct<start:long,end:long>>")
    one = union.groupBy("doc_id", "_key", "n_words").agg(
        F.collect_set("spans").alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count("*") / len(parts)).cast("int").alias("_rows"),
    )
    return one.select("doc_id", "_key", "n_words", merge("_spans").alias("spans"), "items", F.explode(F.sequence(F.lit(1), "_rows")).alias("_row"))


def clean_of(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; clean rows that repeat all stay."""
    found = _contamination(docs, benchmark, doc_id, text, "item_id", F.sha2("_t", 256), "string")
    key = row_key(F.col(doc_id).cast("long"), utf8(F.col(text)))
    return without_rows(docs, key, found.where("contaminated").select("doc_id", "_key"))

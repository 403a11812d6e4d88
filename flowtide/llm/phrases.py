"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are four words, edges the five-word grams that join two nodes, weighted by how often they occur. Only these
longest grams are aggregated over the corpus. The last four words of a piece start shorter grams; they are edges to the
end of the piece (word 0) and correct what the flow misses: a gram occurs as often as the weights of all edges that
start with it, ends included. So the edges are dealt out in ranges of their order, a range sums its sorted edges
once per length of prefix, and only grams that reach the threshold, or may reach it together with the next range,
leave it.

Words are numbers of a dictionary of the words that reach the threshold by themselves; any other word
ends a gram like the end of a piece, as no candidate holds it. In the graph of what is left, unary paths (every node passes its whole
flow from one edge to one edge) are compacted into one string with one weight: inside a path no node can be a
candidate, its edges are read off the string.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtide.llm.common import column, grouped_rows, runs, tasks_for, utf8
from flowtide.operators.ordered import global_row_number
from flowtide.session import cut

LONGEST = 5
LEAST = 100
TOP = 2000
SCALE = 1000
#: words of a dictionary that is broadcast; larger ones are joined by a shuffle
SENT_WORDS = 1 << 20
#: windows that a task sums before it hands them on, and that one range of the order takes, about
FLUSH = 1 << 20
RANGE = 1 << 22
#: nodes a range that are drawn to place the borders, and the texts they are drawn from, about
KEYS, SAMPLE = 16, 1 << 14
#: candidates of a language that are ranked in one task
RANKED = 1 << 20

#: separators of pieces become a full stop, a tab a space, A-Z small letters; all single bytes in UTF-8
_TABLE = bytes(
    ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
STOP = b"."


def words_of(data: bytes) -> list[bytes]:
    """The words of a text with ``STOP`` between pieces."""
    return data.translate(_TABLE).replace(STOP, b" . ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words of all its texts in a batch)."""
    texts: dict[str, list[bytes]] = {}
    for lang, data in zip(batch.column("lang").to_pylist(), batch.column("_t").to_pylist(), strict=True):
        texts.setdefault(lang, []).append(data)
    for lang, parts in texts.items():
        yield lang, words_of(STOP.join(parts))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, words in _by_lang(batch):
            counts = Counter(words)
            # the full stop, which is no word, carries the number of all words
            counts[STOP] = len(words) - counts[STOP]
            names = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), names, pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def _after(words: np.ndarray) -> list[np.ndarray]:
    """For each place the LONGEST words from there, 0 from the first 0 on."""
    long = np.concatenate((words, np.zeros(LONGEST - 1, np.int64)))
    out = [words]
    for k in range(1, LONGEST):
        out.append(np.where(out[-1] > 0, long[k : k + len(words)], 0))
    return out


Edges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def edges_of(words: np.ndarray, weight: int = 1) -> Edges:
    """The edges of numbered words: (first two, next two, last, weight) at each place that has a word."""
    a, b, c, d, e = (x[words > 0] for x in _after(words))
    return (a << 31) | b, (c << 31) | d, e.astype(np.int32), np.full(len(a), weight, np.int64)


def summed(parts: list[Edges]) -> Edges:
    """Equal edges added up, in order."""
    x, y, z, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((z, y, x))
    x, y, z, n = x[order], y[order], z[order], n[order]
    if not len(x):
        return x, y, z, n
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1]))))
    return x[new], y[new], z[new], np.add.reduceat(n, new)


def _places(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Where the nodes (bx, by) come first in the sorted nodes (x, y)."""
    low, high = np.searchsorted(x, bx, "left"), np.searchsorted(x, bx, "right")
    while (low < high).any():
        middle = (low + high) // 2
        less = (low < high) & (y[np.minimum(middle, len(y) - 1)] < by)
        low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
    return low


def _packed(edges: Edges) -> bytes:
    x, y, z, n = edges
    return zstandard.ZstdCompressor(1).compress(b"".join((np.diff(x, prepend=np.int64(0)).tobytes(), y.tobytes(), z.tobytes(), n.tobytes())))


def _unpacked(data: bytes) -> Edges:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 28
    return (
        np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int32, n, 16 * n),
        np.frombuffer(raw, np.int64, n, 20 * n),
    )


def _dealt(parts: Iterator[Edges], bx: np.ndarray, by: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sum edges up to FLUSH at a time and cut them at the borders: (range, edges)."""
    held: list[Edges] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        made = summed(held)
        at = np.concatenate(([0], _places(made[0], made[1], bx, by), [len(made[0])]))
        found = [(k, _packed(tuple(c[at[k] : at[k + 1]] for c in made))) for k in np.flatnonzero(np.diff(at)).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["range", "edges"])

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= FLUSH:
            yield flushed()
            held, size = [], 0
    if size:
        yield flushed()


GRAM = [f"w{k}" for k in range(1, LONGEST + 1)]
_GRAM_TYPE = ", ".join(f"{c} int" for c in GRAM) + ", f long"


def prefix_counts(edges: Edges, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts) of the prefixes of sorted, summed edges that reach ``least``, and of the first and last
    prefix of up to three words, which neighbouring ranges may hold too."""
    x, y, z, n = edges
    a, b, c, d = x >> 31, x & 0x7FFFFFFF, y >> 31, y & 0x7FFFFFFF
    words = np.stack((a, b, c, d, z.astype(np.int64)), axis=1)
    new = np.zeros(len(x), bool)
    new[:1] = True
    for k in range(1, LONGEST + 1):
        new[1:] |= words[1:, k - 1] != words[:-1, k - 1]
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(n, starts)
        keep = counts >= least
        if k < LONGEST - 1:
            keep[[0, -1]] = True
        # a prefix that reaches the end of a piece is no gram of this length
        keep &= words[starts, k - 1] > 0
        chosen = words[starts[keep]].copy()
        chosen[:, k:] = 0
        yield chosen, counts[keep]


def _range_counts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_rows(batches, "range"):
            bounds = runs(column(batch, "range"))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                edges = summed([_unpacked(v.as_py()) for v in batch.column("edges").slice(lo, hi - lo)])
                for words, counts in prefix_counts(edges, least):
                    yield pa.RecordBatch.from_arrays([*(pa.array(words[:, k].astype(np.int32)) for k in range(LONGEST)), pa.array(counts)], [*GRAM, "f"])

    return run


class Dictionary:
    """Words that occur ``least`` times in their language, with numbers from 1, and the words of each language."""

    def __init__(self, texts: DataFrame, least: int):
        counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counted = cut(counted.where((F.col("n") >= least) | (F.col("word") == STOP.decode())))
        self.langs = counted.where(F.col("word") == STOP.decode()).select("lang", "n")
        self.words = cut(global_row_number(counted.where(F.col("word") != STOP.decode()).drop("n"), ["lang", "word"], "id").select("lang", "word", "id"))
        self.size = self.words.count()
        self.total = self.langs.agg(F.sum("n")).first()[0] or 0


def _numbered(texts: DataFrame, words: Dictionary):
    """``texts`` as a table, and a function from its batches to edges."""
    if words.size <= SENT_WORDS:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.words.collect():
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        sent = texts.sparkSession.sparkContext.broadcast(known)

        def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[Edges]:
            for batch in batches:
                for lang, found in _by_lang(batch):
                    get = sent.value.get(lang, {}).get
                    yield edges_of(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))

        return texts, edges

    # one row per different text, its words numbered by a join
    different = cut(texts.groupBy("lang", F.sha2("_t", 256).alias("_sha")).agg(F.any_value("_t").alias("_t"), F.count("*").alias("weight")).withColumn("_row", F.monotonically_increasing_id()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = words_of(batch.column("_t")[k].as_py())
                if found:
                    same = [pa.array([batch.column(c)[k].as_py()] * len(found)) for c in ("_row", "weight", "lang")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(found)), pa.int32()), pa.array(found, pa.binary()).cast(pa.string())], ["_row", "weight", "lang", "at", "word"])

    placed = different.select("_row", "weight", "lang", "_t").mapInArrow(explode, "_row long, weight long, lang string, at int, word string")
    joined = placed.join(words.words, ["lang", "word"], "left").groupBy("_row", "weight").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id")))), lambda w: w["id"]).alias("ids")
    )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[Edges]:
        for batch in batches:
            for weight, ids in zip(batch.column("weight").to_pylist(), batch.column("ids"), strict=True):
                yield edges_of(ids.values.to_numpy().astype(np.int64), weight)

    return cut(joined.select("weight", "ids")), numbered


def grams(texts: DataFrame, words: Dictionary, least: int = LEAST) -> DataFrame:
    """(w1 .. w5, f): the grams of one to five words (0 after the last) that occur ``least`` times."""
    spark = texts.sparkSession
    # a range is a task
    ranges = tasks_for(spark, words.total, RANGE) if words.total > FLUSH else 1
    rows, edges = _numbered(texts, words)
    bx = by = np.zeros(0, np.int64)
    if ranges > 1:
        n = rows.count()
        some = rows.sample(min(1.0, SAMPLE / n), seed=1)
        step = max(1, words.total * min(n, SAMPLE) // n // (KEYS * ranges))

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y, _, _ in edges(batches):
                yield pa.RecordBatch.from_arrays([pa.array(x[step // 2 :: step]), pa.array(y[step // 2 :: step])], ["x", "y"])

        keys = sorted((r["x"], r["y"]) for r in some.mapInArrow(drawn, "x long, y long").collect())
        borders = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []
        bx, by = (np.array([b[k] for b in borders], np.int64) for k in (0, 1))
    dealt = rows.mapInArrow(lambda it: _dealt(edges(it), bx, by), "range long, edges binary")
    held = dealt.repartitionById(ranges, F.col("range").cast("int")).sortWithinPartitions("range")
    found = held.mapInArrow(_range_counts(least), _GRAM_TYPE).groupBy(*GRAM).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return cut(found)


def _gram(names: list[str]) -> Column:
    return F.filter(F.array(*names), lambda w: w > 0)


def unary_paths(counted: DataFrame) -> DataFrame:
    """(words, f): the longest-gram edges of ``counted`` with unary paths compacted, one row a path.

    Two edges are joined at their node where both carry all its flow; then they have the same weight. Edges
    find the head of their path by doubling, log2(longest path) rounds; flow ends where a piece does, so no path is a ring.
    """
    node = GRAM[:-1]
    edges = cut(counted.where(F.col(GRAM[-1]) > 0).withColumn("at", F.monotonically_increasing_id()))
    nodes = counted.where((F.col(node[-1]) > 0) & (F.col(GRAM[-1]) == 0)).select(*node, "f")
    into = edges.select(F.col("at").alias("up"), *[F.col(b).alias(a) for a, b in zip(node, GRAM[1:], strict=True)], "f")
    joined = edges.select(*node, "f", "at").join(nodes, [*node, "f"]).join(into, [*node, "f"]).select("at", "up")
    step = cut(edges.join(joined, "at", "left").select("at", F.coalesce("up", "at").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    inner, ends = step.where("steps > 0"), step.where("steps = 0")
    done = ends
    while not inner.isEmpty():
        above = done.union(inner).select(F.col("at").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        moved = cut(inner.join(above, "up").select("at", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_steps") == 0).alias("_end")))
        done = done.union(moved.where("_end").drop("_end"))
        inner = moved.where("not _end").drop("_end")
    placed = edges.join(done, "at").select("up", "steps", "f", *GRAM)
    held = placed.groupBy("up", "f").agg(F.array_sort(F.collect_list(F.struct("steps", F.struct(*GRAM).alias("g")))).alias("e"))
    first = F.array(*[F.col("e")[0]["g"][c] for c in node])
    return held.select(F.concat(first, F.transform("e", lambda e: e["g"][GRAM[-1]])).alias("words"), "f")


def _slices(paths: DataFrame, k: int) -> DataFrame:
    """(g, f): the grams of ``k`` words along the paths."""
    starts = F.sequence(F.lit(1), F.size("words") - (k - 1))
    return paths.select(F.explode(F.transform(starts, lambda i: F.slice("words", i, k))).alias("g"), "f")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of two to five words of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks; null texts are
    empty, null languages ``und``. A phrase occurs ``a >= least`` times; of its cuts into two parts, which occur l and r
    times, the one with the lowest floor(SCALE * a * n / (l * r)) counts, then the one after the fewest words; n are all words of
    the language. A phrase inside a longer one that occurs as often is left out. Repeated rows count each
    time; languages without a phrase and empty tables give no rows; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8(F.col(text)).alias("_t"))
    words = Dictionary(texts, least)
    counted = grams(texts, words, least)
    paths = cut(unary_paths(counted))
    known = counted.select(_gram(GRAM).alias("g"), "f")
    shorter = known.where((F.size("g") > 1) & (F.size("g") < LONGEST))
    # what a gram one word longer that occurs as often covers; below an edge, read off the paths
    mid = shorter.where(F.size("g") > 2)
    ends = [mid.select(F.slice("g", 1, F.size("g") - 1).alias("g"), "f"), mid.select(F.slice("g", 2, F.size("g") - 1).alias("g"), "f")]
    covered = _slices(paths, LONGEST - 1).union(ends[0]).union(ends[1]).distinct()
    kept = cut(shorter.join(covered, ["g", "f"], "left_anti").union(_slices(paths, LONGEST)).withColumnRenamed("f", "a"))

    cuts = kept.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.select("g", "a", "k", F.expr("slice(g, 1, k)").alias("_l"), F.expr("slice(g, k + 1, size(g) - k)").alias("_r"))
    left, right = (known.select(F.col("g").alias(f"_{c}"), F.col("f").alias(c)) for c in "lr")
    of = words.words.select(F.col("id").cast("int").alias("_first"), "lang").join(words.langs, "lang")
    scored = cuts.join(left, "_l").join(right, "_r").withColumn("_first", F.col("g")[0]).join(of, "_first")
    # 1000 * a * n has 31 digits for tables of 10^14 words, l * r less
    score = F.expr(f"cast({SCALE} as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = scored.withColumn("score", score).groupBy("g", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    best = cut(best.select("g", "a", "lang", "n", "s.score", "s.l", "s.r"))

    spelt = best.select("g", F.posexplode("g").alias("at", "id")).join(words.words.select(F.col("id").cast("int").alias("id"), "word"), "id")
    spelt = spelt.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    named = cut(best.join(spelt, "g").drop("g"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    shares = 1 + named.count() // RANKED
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    first = named.withColumn("rank", F.row_number().over(W.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Jaccard join of word n-gram sets by vertical partitioning of the global n-gram order.

The order puts n-grams of rare words first and the n-grams of passages that many texts share last; the
frequent words and n-grams come from a bounded sample, which only moves n-grams in the order: any order gives
the same links. An n-gram is its place in the order: four bits of class, then 59 bits of a hash of the hashes of its words.

Equal sets are one node. Two sets that reach the threshold share one of the first few n-grams of both,
at a place that still lets them reach it, so nodes meet in the buckets of their first n-grams. For the pairs that
meet, the order is cut into fragments of about equal load, the overlap of each fragment is counted by itself,
and the partial overlaps are summed per pair.

No bucket's pairs are all written out where its members hang together: first every member meets one centre of the
bucket, which is linear, then only members that do not hang together yet meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import SENT_IDS, utf8
from flowtide.llm.components import components
from flowtide.session import cut

WORDS = 3
#: two sets are linked when DEN * intersection >= NUM * union
NUM, DEN = 90, 100
#: texts of the sample that the order is drawn from, about
SAMPLE = 1 << 14
#: words and n-grams of the sample that count as frequent, at most, and the texts they are in, at least
FREQUENT_WORDS, FREQUENT_GRAMS, LEAST_WORD, LEAST_GRAM = 1 << 15, 1 << 17, 4, 3
FRAGMENTS = 8
#: rounds in which members meet a centre before members of different components meet
CENTRES = 1
#: n-grams before an n-gram that tell whether two sets meet at it for the first time
BEFORE = 8
#: steps that the smallest label moves along the links between these rounds
HOPS = 3


class WordHashes(dict):
    """64-bit hashes of words, worked out once per distinct word; the lowest bit tells whether the word is frequent."""

    def __init__(self, frequent: frozenset[bytes] = frozenset()):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        value = self[word] = (xxhash.xxh64_intdigest(word) & ~1) | (word in self.frequent)
        return value

    def of(self, data: bytes) -> np.ndarray:
        """The hashes of the words of a text in lower-case A-Z."""
        found = data.lower().split()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the n-grams of a text from those of its words; fewer words than an n-gram has are one n-gram."""
    n = max(len(words) - size + 1, 1) if len(words) else 0
    grams = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        grams = _mixed(grams + (words[k : k + n] >> np.uint64(1)) + np.uint64(k + 1))
    return grams


class Order:
    """Places of n-grams: the number of frequent words in it, then, for frequent n-grams, how frequent."""

    def __init__(self, words: frozenset[bytes], grams: np.ndarray, counts: np.ndarray):
        by = np.argsort(grams)
        self.words, self.grams = words, grams[by]
        self.classes = (4 + np.minimum(np.log2(np.maximum(counts[by], 1)).astype(np.uint64), 11)).astype(np.uint64)

    def places(self, words: np.ndarray, size: int) -> np.ndarray:
        """The places of the set of a text whose words have these hashes, ascending."""
        own = shingles(words, size)
        if not len(own):
            return np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum((words & np.uint64(1)).astype(np.int64))))
        kind = (total[size:] - total[:-size] if len(words) > size else total[-1:]).clip(0, 3).astype(np.uint64)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            kind = np.where(self.grams[at] == own, self.classes[at], kind)
        return np.unique((kind << np.uint64(59)) | (own >> np.uint64(5))).view(np.int64)


def least_overlap(a: Column, b: Column) -> Column:
    """The intersection that sets of these sizes need."""
    return F.ceil((a + b) * NUM / (NUM + DEN))


def _sampled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = WordHashes()
            words, grams = [], []
            for data in batch.column("_t"):
                found = hashes.of(data.as_py())
                words.append(np.unique(found))
                grams.append(np.unique(shingles(found, size)))
            values, counts = np.unique(np.concatenate(words), return_counts=True)
            named = {h: w for w, h in hashes.items()}
            names = pa.array([named[h] for h in values.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), names, pa.array(counts.astype(np.int64))], ["gram", "word", "n"])
            values, counts = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.nulls(len(values), pa.binary()), pa.array(counts.astype(np.int64))], ["gram", "word", "n"])

    return run


def draw_order(texts: DataFrame, rows: int, size: int = WORDS) -> Order:
    """The order of the n-grams of column ``_t``, from the frequent words and n-grams of about ``SAMPLE`` different texts."""
    one_in = max(1, rows // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("_t"), F.lit(one_in)) == 0).select("_t").distinct()
    counted = cut(sample.mapInArrow(_sampled(size), "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_GRAM}"))
    words = counted.where(f"word is not null and n >= {LEAST_WORD}").orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word").toArrow()
    grams = counted.where("gram is not null").orderBy(F.desc("n"), "gram").limit(FREQUENT_GRAMS).select("gram", "n").toArrow()
    keys, counts = (grams.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    return Order(frozenset(words.column("word").to_pylist()), keys.view(np.uint64), counts)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _prefixes(order, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = WordHashes(order.value.words)
            sizes, digests, firsts = [], [], []
            for data in batch.column("_t"):
                places = order.value.places(hashes.of(data.as_py()), size)
                n = len(places)
                sizes.append(n)
                digests.append(hashlib.sha256(places.tobytes()).digest())
                # a partner shares at least ceil(NUM / DEN * n) of the n places
                firsts.append(places[: n - -(-NUM * n // DEN) + 1] if n else places)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(firsts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "prefix"])

    return run


def _segments(order, pivots: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = WordHashes(order.value.words)
            digests, fragments, parts = [], [], []
            for data in batch.column("_t"):
                places = order.value.places(hashes.of(data.as_py()), size)
                digest = hashlib.sha256(places.tobytes()).digest()
                at = np.concatenate(([0], np.searchsorted(places, pivots), [len(places)]))
                for k in np.flatnonzero(np.diff(at)).tolist():
                    digests.append(digest)
                    fragments.append(k)
                    parts.append(places[at[k] : at[k + 1]])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(fragments, pa.int32()), _lists(parts)], ["digest", "fragment", "segment"])

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast while the number of rows is bounded."""
    return F.broadcast(df) if rows <= SENT_IDS else df


class Sets:
    """The sets of a table of texts: nodes, their buckets, and the overlap of pairs of nodes."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, size: int):
        self.size = size
        self.texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("_t"))
        spark = docs.sparkSession
        self.order = spark.sparkContext.broadcast(draw_order(self.texts, self.texts.count(), size))
        self.rows = cut(self.texts.mapInArrow(_prefixes(self.order, size), "doc_id long, n long, digest binary, prefix array<long>"))
        classes = self.rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.any_value("prefix").alias("prefix"))
        self.nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
        self.pivots = self._pivots()

    def _pivots(self) -> np.ndarray:
        """Where the order is cut: each fragment has about the same share of the places of some 512 nodes."""
        rate = max(1, self.nodes.count() // 512)
        some = self.nodes.where(F.pmod(F.xxhash64("digest"), F.lit(rate)) == 0).select("digest", "first")
        whole = self._places(some, 0, np.zeros(0, np.int64)).join(F.broadcast(some), "digest").select(F.explode("segment").alias("p"))
        found = whole.agg(F.percentile_approx("p", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000).alias("c")).first()["c"]
        return np.unique(np.array(found or [], np.int64))

    def _places(self, wanted: DataFrame, rows: int, pivots: np.ndarray) -> DataFrame:
        """(digest, fragment, segment) of the texts whose id is the ``first`` of a row of ``wanted`` (at most ``rows`` rows)."""
        ids = wanted.select(F.col("first").alias("_id")).distinct()
        texts = self.texts.join(_small(ids, rows), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return texts.mapInArrow(_segments(self.order, pivots, self.size), "digest binary, fragment int, segment array<long>")

    def _first_fragment(self, pairs: DataFrame, rows: int) -> DataFrame:
        """The pairs that can still reach the threshold when the overlap of their first n-grams is counted: up to the
        place where the shorter list of the two ends, what only one of them has is lost."""
        pairs = _small(pairs, rows)
        left = self.nodes.select(F.col("node").alias("x"), F.col("prefix").alias("px"), F.col("digest").alias("dx"), F.col("first").alias("fx"))
        right = self.nodes.select(F.col("node").alias("y"), F.col("prefix").alias("py"), F.col("digest").alias("dy"), F.col("first").alias("fy"))
        both = left.join(pairs, "x").join(right.join(pairs.select("x", "y"), "y"), ["x", "y"])
        end = F.least(F.element_at("px", -1), F.element_at("py", -1))
        rest = [F.col(n) - F.size(F.filter(p, lambda v: v <= F.col("_end"))) for n, p in (("nx", "px"), ("ny", "py"))]
        most = F.size(F.array_intersect("px", "py")) + F.least(*rest)
        return both.withColumn("_end", end).where(most >= least_overlap(F.col("nx"), F.col("ny"))).drop("px", "py", "_end")

    def linked(self, pairs: DataFrame, rows: int) -> DataFrame:
        """The pairs (x, y, nx, ny) that reach the threshold, as (a, b): partial overlaps summed over the fragments."""
        close = cut(self._first_fragment(pairs, rows))
        rows = 2 * close.count()
        pair = ["x", "y", "nx", "ny"]
        asked = [close.select(F.col(f"d{c}").alias("digest"), F.col(f"f{c}").alias("first"), *pair, F.lit(c).alias("side")) for c in ("x", "y")]
        asked = asked[0].union(asked[1])
        cells = self._places(asked, rows, self.pivots).join(_small(asked.drop("first"), rows), "digest")
        segment = lambda c: F.first(F.when(F.col("side") == c, F.col("segment")), ignorenulls=True)
        met = cells.groupBy(*pair, "fragment").agg(segment("x").alias("sx"), segment("y").alias("sy"))
        partial = met.where("sx is not null and sy is not null").select(*pair, F.size(F.array_intersect("sx", "sy")).alias("shared"))
        summed = partial.groupBy(*pair).agg(F.sum("shared").alias("i"))
        return cut(summed.where(F.col("i") >= least_overlap(F.col("nx"), F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _meeting(pairs: DataFrame, first: Column | None = None) -> DataFrame:
    """Pairs of bucket members (node, n, pos and their ``_`` twins) that can still reach the threshold when this is their first shared place.

    ``first`` may tell whether it is; the comparison of numbers goes before it."""
    rest = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos"))
    fits = (F.least("n", "_n") * DEN >= F.greatest("n", "_n") * NUM) & (rest >= least_overlap(F.col("n"), F.col("_n")))
    low = F.col("node") < F.col("_node")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return pairs.where(fits if first is None else fits & first).select(pick("node", "_node").alias("x"), pick("_node", "node").alias("y"), pick("n", "_n").alias("nx"), pick("_n", "n").alias("ny"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A text's set are its distinct shingles of ``words`` words, the whole text if it has fewer. Sets whose Jaccard
    similarity is at least NUM / DEN are linked; component_id is the smallest id reachable, the own
    included; null ids do not count (null if there is no other). Rows with equal sets are one
    node, whether they repeat an id or not. Texts without words (null, empty, white space) have an
    empty set and no links: their component is their own id. N-grams are told apart by 59 bits of their hash.
    An empty table gives no rows; other columns are ignored.
    """
    sets = Sets(docs, doc_id, text, words)
    tokens = sets.nodes.select("node", "n", "prefix", F.posexplode("prefix").alias("pos", "token")).withColumn(
        "before", F.slice("prefix", F.greatest(F.col("pos") - BEFORE, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(BEFORE)))
    ).drop("prefix")
    shared = tokens.groupBy("token").agg(F.count("*").alias("_c")).where("_c > 1").select("token")
    met = cut(tokens.join(shared, "token").withColumn("root", F.col("node")))
    # the centre is the member with the fewest n-grams of its own before the shared one: most others are near it
    links = compared = first = None
    for turn in range(CENTRES + 1):
        if turn < CENTRES:
            centre = met.groupBy("token").agg(F.min(F.struct("pos", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n")).alias("c"))
            other = centre.select("token", F.col("c.node").alias("_node"), F.col("c.n").alias("_n"), F.col("c.pos").alias("_pos"))
            pairs = met.join(other, "token").where("node <> _node")
        else:
            # a pair whose lists share an n-gram just before this one has met there: what counts is where it first meets
            other = met.select("token", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "pos", "root", "before")])
            pairs = met.join(other, "token").where(F.col("root") < F.col("_root"))
            first = ~F.arrays_overlap("before", "_before")
        pairs = _meeting(pairs, first).distinct()
        pairs = cut(pairs if compared is None else pairs.join(compared, ["x", "y"], "left_anti"))
        compared = pairs.select("x", "y") if compared is None else compared.union(pairs.select("x", "y"))
        rows = pairs.count()
        if rows:
            found = sets.linked(pairs, rows)
            links = found if links is None else links.union(found)
        if turn < CENTRES:
            met = _apart(met, links)
            if met.isEmpty():
                break
    roots = sets.nodes.select("node", F.col("node").alias("root")).limit(0) if links is None else components(links)

    placed = sets.nodes.join(roots, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(placed.join(least, "root").select("digest", "component_id"))
    return sets.rows.join(classes, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _apart(met: DataFrame, links: DataFrame | None) -> DataFrame:
    """The members of buckets that may hold more than one component. Members with one ``root`` hang together: it is the
    smallest node that HOPS steps along the links reach, which need not be that of the component."""
    if links is None:
        return met
    both = links.union(links.select("b", "a")).union(links.select("a", "a")).union(links.select("b", "b")).toDF("node", "b")
    roots = cut(both.groupBy("node").agg(F.min("b").alias("root")))
    for _ in range(HOPS - 1):
        ahead = roots.select(F.col("node").alias("b"), "root")
        roots = cut(both.join(ahead, "b").groupBy("node").agg(F.min("root").alias("root")))
    named = met.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("token")
    return cut(named.join(several, "token"))

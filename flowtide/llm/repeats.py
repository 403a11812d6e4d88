"""Repeated byte strings across documents, by prefix-free parsing.

A rolling hash picks the triggers: in every window of 50 bytes the 24-byte string with the smallest hash,
the first one on ties. The windows that share a trigger make a phrase, so a text is cut the same way wherever
it stands, and each window lies in one phrase. The dictionary is the distinct phrases with the smallest id
of a document that has each; the parse is the phrases of the documents in order.

A window repeats an earlier document's if its phrase does, or if another phrase with the same trigger holds
the same 50 bytes. The first is settled on hashes of phrases. Only for triggers with several phrases are
the dictionary's strings gathered; their suffixes are sorted to the depth of a window, and equal
neighbours take the smallest id. Both results meet the parse again at the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import runs, tasks_for, utf8
from flowtide.session import cut

SIZE = 50
TRIGGER = 24
#: bytes of text that are parsed together; longer documents are parsed in parts that overlap by a window
SHARD_BYTES = 2 << 20
#: bytes of text per bucket of triggers and per bucket of documents; a task takes several
BUCKET_BYTES = 6 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = 30


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def phrases(data: np.ndarray, starts: np.ndarray, size: int = SIZE, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts laid end to end (text d is data[starts[d]:starts[d + 1]]): where each
    phrase's first window starts, how many windows it has, and its trigger's hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none.astype(np.uint64)
    up, down = _powers((n // (1 << 18) + 1) << 18)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * up[:n], dtype=np.uint64)))
    hashes = _mixed((sums[trigger:] - sums[:-trigger]) * down[: n - trigger + 1])
    low = np.uint64((1 << _POSITION_BITS) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = size - trigger + 1
    least, span = key, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(starts) >= size
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - size + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    at = at[valid]
    bounds = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)))) if len(at) else none
    counts = np.diff(np.append(bounds, len(at)))
    return valid[bounds], counts, hashes[at[bounds]]


def _plane(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, byte by byte, which compresses better."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplane(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :size] = raw.T
    return out.reshape(-1).view("<u8")


_SPOTS = "ids binary, keys binary, docs binary, at binary, n binary"
_SPOT_NAMES = ["ids", "keys", "docs", "at", "n"]
_PLACES = f"bucket long, settled boolean, trigger binary, {_SPOTS}"


def _spots(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Places in documents: the documents used, and per place document number, offset, windows."""
    used, number = np.unique(doc, return_inverse=True)
    return [_plane(ids[used].view(np.uint64), 8), _plane(keys[used].view(np.uint64), 8), _plane(number, 4), _plane(at, 5), _plane(n, 1)]


def _read_spots(rows: dict[str, list]) -> tuple[np.ndarray, ...]:
    """Document id, document key, offset and windows of all places in several rows."""
    ids, keys, at, n = [], [], [], []
    for i, k, d, a, m in zip(*(rows[c] for c in _SPOT_NAMES), strict=True):
        number = _unplane(d, 4).astype(np.int64)
        ids.append(_unplane(i, 8).view(np.int64)[number])
        keys.append(_unplane(k, 8).view(np.int64)[number])
        at.append(_unplane(a, 5).astype(np.int64))
        n.append(_unplane(m, 1).astype(np.int64))
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (ids, keys, at, n))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """A table of rows in the order of a schema of long, boolean and binary columns."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


_ASKED = f"bucket long, settled boolean, trigger binary, digest binary, {_SPOTS}"


def _parse(n_buckets: int):
    """Tasks over documents: per bucket of triggers the phrases to settle there, and in any
    bucket the places already settled among the documents of the task."""

    def emit(held: list[tuple[int, int, int, bytes]], part: int) -> Iterator[pa.RecordBatch]:
        ids, keys, bases = (np.array([h[i] for h in held], np.int64) for i in range(3))
        starts = np.concatenate(([0], np.cumsum(np.fromiter((len(h[3]) for h in held), np.int64, len(held)))))
        joined = b"".join([h[3] for h in held])
        at, n, trigger = phrases(np.frombuffer(joined, np.uint8), starts)
        if not len(at):
            return
        ends = at + n + SIZE - 1
        digest = np.frombuffer(b"".join([xxhash.xxh3_64_digest(joined[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]), np.uint64)
        doc = np.searchsorted(starts, at, side="right") - 1
        offset = at - starts[doc] + bases[doc]
        own_id = ids[doc]
        order = np.lexsort((own_id, digest))
        bounds = runs(digest[order])
        first = np.empty(len(at), np.int64)
        first[order] = np.repeat(own_id[order[bounds[:-1]]], np.diff(bounds))
        later = own_id > first
        rows = []
        if later.any():
            rows.append((part % n_buckets, True, None, None, *_spots(ids, keys, doc[later], offset[later], n[later])))
        bucket = (trigger % np.uint64(n_buckets)).astype(np.int64)
        bucket[later] = -1
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                rows.append((b, False, _plane(trigger[own] >> np.uint64(16), 6), digest[own].tobytes(), *_spots(ids, keys, doc[own], offset[own], n[own])))
        yield from _table(rows, _ASKED).to_batches()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for i, k, t in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("_t"), strict=True):
                data = t.as_py()
                for base in range(0, len(data) - SIZE + 1, SHARD_BYTES) if i is not None else ():
                    piece = data[base : base + SHARD_BYTES + SIZE - 1]
                    if held and size + len(piece) > SHARD_BYTES:
                        yield from emit(held, part)
                        held, size = [], 0
                    held.append((i, k, base, piece))
                    size += len(piece)
        if held:
            yield from emit(held, part)

    return parse


def _by_document(settled: bool, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, n: np.ndarray, n_buckets: int, trigger: np.ndarray | None = None) -> list[tuple]:
    """Places in documents as rows of ``_PLACES``, one for each bucket of documents."""
    bucket = keys % n_buckets
    order = np.lexsort((at, keys, bucket))
    out = []
    bounds = runs(bucket[order])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = order[a:b]
        _, one, doc = np.unique(keys[own], return_index=True, return_inverse=True)
        tag = None if trigger is None else _plane(trigger[own], 6)
        out.append((int(bucket[own[0]]), settled, tag, *_spots(ids[own][one], keys[own][one], doc, at[own], n[own])))
    return out


def _settle(n_buckets: int):
    """One bucket of triggers: places whose phrase an earlier document has are settled; places whose
    trigger has other phrases besides, first found in different documents, are left open."""

    def settle(table: pa.Table) -> pa.Table:
        flags = table.column("settled").to_pylist()
        rows = {c: table.column(c).to_pylist() for c in ("trigger", "digest", *_SPOT_NAMES)}
        known = {c: [v for v, f in zip(rows[c], flags, strict=True) if f] for c in _SPOT_NAMES}
        asked = {c: [v for v, f in zip(rows[c], flags, strict=True) if not f] for c in rows}
        out = _by_document(True, *_read_spots(known), n_buckets)
        if asked["digest"]:
            trigger = np.concatenate([_unplane(x, 6) for x in asked["trigger"]])
            digest = np.concatenate([np.frombuffer(x, np.uint64) for x in asked["digest"]])
            ids, keys, at, n = _read_spots(asked)
            order = np.lexsort((ids, digest, trigger))
            trigger, digest, ids, keys, at, n = (x[order] for x in (trigger, digest, ids, keys, at, n))
            new_trigger = np.concatenate(([True], trigger[1:] != trigger[:-1]))
            new_phrase = new_trigger | np.concatenate(([True], digest[1:] != digest[:-1]))
            phrase = np.cumsum(new_phrase) - 1
            firsts = ids[new_phrase]
            later = ids > firsts[phrase]
            out += _by_document(True, ids[later], keys[later], at[later], n[later], n_buckets)
            edges = np.flatnonzero(new_trigger[new_phrase])
            mixed = np.minimum.reduceat(firsts, edges) < np.maximum.reduceat(firsts, edges)
            left = ~later & mixed[np.cumsum(new_trigger) - 1]
            out += _by_document(False, ids[left], keys[left], at[left], n[left], n_buckets, trigger[left])
        return _table(out, _PLACES)

    return settle


def _rows_of(docs: pa.Table) -> tuple[dict[int, int], np.ndarray]:
    """The first row of each document key, and for each row that first row (rows that repeat share it)."""
    first: dict[int, int] = {}
    return first, np.array([first.setdefault(k, i) for i, k in enumerate(docs.column("key").to_pylist())], np.int64)


_STRINGS = f"bucket long, strings binary, {_SPOTS}"


def _gather(n_buckets: int):
    """One bucket of documents: the strings of the phrases left open, dealt by trigger."""

    def gather(key: tuple, docs: pa.Table, places: pa.Table) -> pa.Table:
        rows = {c: places.column(c).to_pylist() for c in ("trigger", *_SPOT_NAMES)}
        if not rows["at"]:
            return _table([], _STRINGS)
        ids, keys, at, n = _read_spots(rows)
        trigger = np.concatenate([_unplane(x, 6) for x in rows["trigger"]])
        first, _ = _rows_of(docs)
        texts = docs.column("_t")
        bucket = (trigger % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((at, keys, bucket))
        out = []
        bounds = runs(bucket[order])
        held: dict[int, bytes] = {}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = order[a:b]
            parts = []
            for k, i, m in zip(keys[own].tolist(), at[own].tolist(), n[own].tolist(), strict=True):
                if (data := held.get(k)) is None:
                    data = held[k] = texts[first[k]].as_py()
                parts.append(data[i : i + m + SIZE - 1])
            _, one, doc = np.unique(keys[own], return_index=True, return_inverse=True)
            out.append((int(bucket[own[0]]), b"".join(parts), *_spots(ids[own][one], keys[own][one], doc, at[own], n[own])))
        return _table(out, _STRINGS)

    return gather


def suffix_order(strings: np.ndarray, starts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``starts`` sorted to the depth of ``size`` bytes, and where in that
    order a suffix differs from the one before it."""
    windows = np.lib.stride_tricks.sliding_window_view(strings, size)[starts]
    words = np.zeros((len(starts), -(-size // 8) * 8), np.uint8)
    words[:, :size] = windows
    parts = words.view(">u8").astype(np.uint64)
    # a multiplicative digest brings equal suffixes together; all bytes decide in what follows
    mixed = np.zeros(len(starts), np.uint64)
    for j in range(parts.shape[1]):
        mixed = _mixed(mixed ^ parts[:, j])
    order = np.argsort(mixed, kind="stable")
    near = runs(mixed[order])
    sizes = np.diff(near)
    if (several := np.flatnonzero(sizes > 1)).size:
        run = np.repeat(np.arange(len(sizes)), sizes)
        own = np.flatnonzero(np.isin(run, several))
        again = np.lexsort((*(parts[order[own], j] for j in range(parts.shape[1] - 1, -1, -1)), run[own]))
        order[own] = order[own[again]]
    differs = np.concatenate(([True], (parts[order[1:]] != parts[order[:-1]]).any(axis=1)))
    return order, differs


def _compare(n_buckets: int):
    """One bucket of triggers: the open windows that a phrase of an earlier document holds too."""

    def compare(table: pa.Table) -> pa.Table:
        ids, keys, at, n = _read_spots({c: table.column(c).to_pylist() for c in _SPOT_NAMES})
        strings = np.frombuffer(b"".join(table.column("strings").to_pylist()), np.uint8)
        begins = np.concatenate(([0], np.cumsum(n + SIZE - 1)))[:-1]
        of = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        order, differs = suffix_order(strings, begins[of] + step)
        edges = np.flatnonzero(differs)
        least = np.minimum.reduceat(ids[of][order], edges)
        repeated = np.empty(len(of), bool)
        repeated[order] = ids[of][order] > np.repeat(least, np.diff(np.append(edges, len(order))))
        found = np.flatnonzero(repeated)
        if not len(found):
            return _table([], _PLACES)
        new = np.concatenate(([True], (found[1:] != found[:-1] + 1) | (of[found[1:]] != of[found[:-1]])))
        head = found[new]
        count = np.diff(np.append(np.flatnonzero(new), len(found)))
        return _table(_by_document(True, ids[of[head]], keys[of[head]], at[of[head]] + step[head], count, n_buckets), _PLACES)

    return compare


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _finish(key: tuple, docs: pa.Table, places: pa.Table) -> pa.Table:
    """One bucket of documents: the spans removed and the bytes kept."""
    ids, keys, at, n = _read_spots({c: places.column(c).to_pylist() for c in _SPOT_NAMES})
    first, canonical = _rows_of(docs)
    texts = docs.column("_t").to_pylist()
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    edge = np.zeros(int(starts[-1]) + 1, np.int32)
    if len(keys):
        begin = starts[np.fromiter(map(first.__getitem__, keys.tolist()), np.int64, len(keys))] + at
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + n + SIZE - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    data = np.frombuffer(b"".join(texts), np.uint8)
    spans, kept = [], []
    for row, c in enumerate(canonical.tolist()):
        own = gone[starts[c] : starts[c + 1]]
        if not own.any():
            spans.append([])
            kept.append(texts[row])
            continue
        change = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
        spans.append([{"start": a, "end": b} for a, b in change.reshape(-1, 2).tolist()])
        kept.append(data[starts[c] : starts[c + 1]][~own].tobytes())
    sizes = pa.array(np.diff(starts))
    return pa.table([docs.column("doc_id"), sizes, pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (removed byte ranges), kept (the bytes left).

    A byte goes when a 50-byte string of the document that covers it also starts in a document with a
    smaller id. Null and empty texts, and texts below 50 bytes, keep what they have. Rows that repeat an
    id are not earlier than each other; rows with a null id are neither changed nor compared. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("_t")).withColumn("key", F.xxhash64("doc_id", "_t"))
    size = source.agg(F.sum(F.octet_length("_t")).alias("n")).first()["n"] or 0
    n = tasks_for(spark, size, BUCKET_BYTES)
    asked = source.mapInArrow(_parse(n), _ASKED)
    first = cut(asked.groupBy("bucket").applyInArrow(_settle(n), _PLACES))
    by_bucket = source.withColumn("bucket", F.pmod("key", F.lit(n))).groupBy("bucket")
    left = first.where("not settled").groupBy("bucket")
    strings = by_bucket.cogroup(left).applyInArrow(_gather(n), _STRINGS)
    second = strings.groupBy("bucket").applyInArrow(_compare(n), _PLACES)
    settled = first.where("settled").unionByName(second).groupBy("bucket")
    return by_bucket.cogroup(settled).applyInArrow(_finish, _RESULT)

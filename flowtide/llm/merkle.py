"""A Merkle manifest of a table, with every level of a block of nodes kept as one hex string.

Rows are leaves, numbered per group. Nodes are cut into aligned blocks of ``ARITY ** LEVELS``; a block
keeps each of its levels as one string of hex digests, 64 digits a node. Parents are the hashes of
substrings of fixed width, and the siblings of a node are the substrings that flank it in its
run. The roots of the blocks are the nodes of the next tier, which recurses until a group is one block; the
groups' roots go through the same steps once more. Everything is built-in functions, and a task holds a
few blocks of 32 KB of digits a level, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.ordered import global_row_number
from flowtide.session import cut

ARITY = 8
#: levels of a block: it holds ARITY ** LEVELS nodes
LEVELS = 3
WIDTH = ARITY**LEVELS
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: groups whose paths are broadcast to the blocks; more are joined by a shuffle
SENT_GROUPS = 1 << 12


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _part(level: Column, start: Column, count: Column) -> Column:
    """``count`` digests of a level from number ``start`` (from 0). Levels are bytes: a substring takes no scan."""
    return F.substring(level, start * DIGITS + 1, count * DIGITS)


def _size(level: Column) -> Column:
    return F.shiftright(F.octet_length(level), 6)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "").cast("binary")


def _parents(level: Column) -> Column:
    """The level above: the hash of each run of up to ARITY digests."""
    runs = F.sequence(F.lit(0), F.shiftright(_size(level) - 1, 3))
    return _joined(F.transform(runs, lambda i: F.sha2(_part(level, i * ARITY, F.lit(ARITY)), 256)))


def _flanks(level: Column, i: Column) -> Column:
    """What stands left and right of node ``i`` in its run."""
    first = F.shiftright(i, 3) * ARITY
    end = F.least(first + ARITY, _size(level))
    return F.struct(_part(level, first, i - first).alias("l"), _part(level, i + 1, end - i - 1).alias("r"))


def _path(i: Column) -> Column:
    """The flanks of node ``i`` of a block and of its ancestors below the block's root."""
    return F.array_compact(F.array(*[F.when(F.col(f"_{k}").isNotNull(), _flanks(F.col(f"_{k}"), F.shiftright(i, 3 * k))) for k in range(LEVELS)]))


NO_PATH = "array<struct<l:binary,r:binary>>"


def climb(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """The blocks of nodes (``g`` without nulls, ``pos`` from 0, ``hash``, ``total`` of the group, payload).

    One row per block: ``g``, ``block``, ``members`` (pos, hash, payload, in order), its levels ``_0`` and up, ``path``
    (flanks above the block, up to the group's root) and ``root`` of the group. A group of one block ends
    at its root; blocks of larger groups go all LEVELS up, however few nodes they have.
    """
    alone = F.col("total") <= WIDTH
    held = nodes.groupBy("g", F.shiftright("pos", 3 * LEVELS).alias("block"), "total").agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", *payload))).alias("members")
    )
    row = held.withColumn("_0", _joined(F.transform("members", lambda m: m["hash"])))
    for k in range(1, LEVELS + 1):
        below = F.col(f"_{k - 1}")
        row = row.withColumn(f"_{k}", F.when(alone & (_size(below) == 1), below).otherwise(_let(below, _parents)))
    # a level that only repeats the root of a small group has no siblings
    ends = [F.when(~(alone & (_size(F.col(f"_{k}")) == 1)), F.col(f"_{k}")).alias(f"_{k}") for k in range(LEVELS)]
    blocks = cut(row.select("g", "block", "total", "members", *ends, F.col(f"_{LEVELS}").cast("string").alias("root")))
    several = blocks.where(~alone)
    if several.isEmpty():
        return blocks.withColumn("path", F.array().cast(NO_PATH)).drop("total")
    tier = several.select("g", F.col("block").alias("pos"), F.col("root").alias("hash"), F.ceil(F.col("total") / WIDTH).alias("total"))
    above = members(climb(tier)).select("g", F.col("pos").alias("block"), F.col("path").alias("_above"), F.col("root").alias("_top"))
    joined = blocks.join(above, ["g", "block"], "left")
    return cut(
        joined.withColumn("path", F.coalesce("_above", F.array().cast(NO_PATH))).withColumn("root", F.coalesce("_top", "root")).drop("_above", "_top", "total")
    )


def members(blocks: DataFrame, of: Callable[[Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """One row per member of ``climb``'s blocks: g, root, and what ``of`` makes of the member and its whole path
    (left out: its pos, hash and path)."""
    of = of or (lambda m, path: {"pos": m["pos"], "hash": m["hash"], "path": path})

    def one(m: Column) -> Column:
        whole = F.concat(_path((m["pos"] % WIDTH).cast("int")), F.col("path"))
        return _let(whole, lambda p: F.struct(*[v.alias(n) for n, v in of(m, p).items()]))

    return blocks.select("g", "root", F.inline(F.transform("members", one)))


def siblings(path: Column) -> Column:
    """All digests of a path in one string, from the leaf up, left to right."""
    return F.aggregate(path, F.lit("").cast("binary"), lambda s, f: F.concat(s, f["l"], f["r"]))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda h, f: F.sha2(F.concat(f["l"], h.cast("binary"), f["r"]), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes ``fields``. Per value of ``group`` leaves ascend by ``order`` (null first, rows that repeat it by leaf) and every ARITY
    consecutive nodes become one until one is left, the subroot; subroots ascend by group, null first, and become the root in the same way. ``proof_sha256`` hashes the
    siblings on the way from the leaf to the root. ``folded_root`` is worked out from these siblings and the
    leaf; where ``where`` holds, from the leaf of the ``changed`` fields instead. Nulls are values of their own in a
    leaf; an empty table gives no rows; other columns are ignored.
    """
    values = {f: F.col(f) for f in fields}
    other = F.when(where, leaf(list({**values, **(changed or {})}.values()))) if where is not None else F.lit(None).cast("string")
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = cut(docs.select(g.alias("g"), F.col(order).alias("_id"), leaf(list(values.values())).alias("hash"), other.alias("other")))
    numbered = global_row_number(leaves, ["_id", "hash", "other"], "pos", ["g"])
    blocks = climb(numbered.select("g", (F.col("pos") - 1).alias("pos"), "hash", F.col("pos_total").alias("total"), "_id", "other"), ["_id", "other"])

    roots = blocks.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("root").alias("hash"))
    roots = global_row_number(roots, ["of"], "pos", ["g"]).select("g", (F.col("pos") - 1).alias("pos"), "hash", F.col("pos_total").alias("total"), "of")
    top = cut(
        members(climb(roots, ["of"]), lambda m, path: {"of": m["of"], "_above": path}).select(F.col("of").alias("g"), F.col("root").alias("_top"), "_above")
    )
    few = top.count() <= SENT_GROUPS
    placed = blocks.join(F.broadcast(top) if few else top, "g").withColumn("path", F.concat("path", "_above"))
    # the groups' root travels as the block's root, its own as a column of the member
    rows = members(
        placed.select("g", F.struct("root", "_top").alias("root"), "members", *[f"_{k}" for k in range(LEVELS)], "path"),
        lambda m, path: {"_id": m["_id"], "leaf": m["hash"], "proof_sha256": F.sha2(siblings(path), 256), "folded_root": folded(F.coalesce(m["other"], m["hash"]), path)},
    )
    return rows.select(
        F.col("_id").alias(order), "leaf", F.col("root.root").alias("subroot"), F.col("root._top").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root._top")).alias("verified"),
    )


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """``manifest`` of documents in which every row whose id has a CRC-32 divisible by three was changed: its text lost its capital letters A-Z."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, changed={"text": F.translate("text", LETTERS, LETTERS.lower())}, where=third)

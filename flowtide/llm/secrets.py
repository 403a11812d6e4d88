"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Base spans come from three patterns. Their values are hashed and counted over the corpus by distinct
owners and documents: a value that many owners have is an example that was copied around, one that few have
looks like a live credential of its owner. A live-looking value is then looked for everywhere: where it
stands by itself outside a base span, that is a span of the kind ``reuse``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import SENT_IDS, whole
from flowtide.session import cut

#: values of at least so many owners are examples
EXAMPLE_OWNERS = 3

# fixed values: kind, pattern, capturing group of the value, least length of the value; in order of kinds.
# Runs shorter than the least length fail as a whole, so the length is part of the last two patterns.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: a run of credential characters with a letter and a digit
RUN = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])(?=[0-9+/_.=-]*+[A-Za-z])[A-Za-z0-9+/_.=-]{12,}"
REUSE = "reuse"


def matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """An array with an entry per match: kind, number, characters since the match before, the match's
    length and its value."""
    quoted = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, quoted, F.lit(0))
    values = F.regexp_extract_all(text, quoted, F.lit(group))
    numbers = F.sequence(F.lit(0), F.size(found) - 1)
    entry = F.transform(
        numbers,
        lambda i: F.struct(
            F.lit(kind).alias("kind"), i.alias("number"), F.get(gaps, i).alias("gap"), F.length(F.get(found, i)).alias("size"), F.get(values, i).alias("value")
        ),
    )
    none = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(pattern), entry).otherwise(none)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, base (array of ``kind:start:end``), spans (base and reuse),
    n_assign, n_access, n_hex, n_reuse, n_live (base spans whose value few owners have), n_example.

    Offsets are code points, ends exclusive; spans are ordered by start, then kind. Null text is empty and
    has no spans. A null owner counts as one owner of its own. Rows that repeat id and text are found alike,
    and count once. An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), whole(F.col(text)).alias("_t"))
    source = source.withColumn("key", F.xxhash64("doc_id", "_t"))
    arrays = [matches(F.col("_t"), i, p, g) for i, (_, p, g, _) in enumerate(KINDS)] + [matches(F.col("_t"), len(KINDS), RUN, 0)]
    rows = source.select("key", "owner", F.explode(F.flatten(F.array(*arrays))).alias("m")).select("key", "owner", "m.*")
    # rows that repeat a document give the same matches
    once = rows.groupBy("key", "kind", "number").agg(F.min("owner").alias("owner"), F.min("gap").alias("gap"), F.min("size").alias("size"), F.min("value").alias("value"))
    before = Window.partitionBy("key", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS), F.lit(12)), F.col("kind") + 1)
    found = cut(
        once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
        .where(F.length("value") >= least)
        .select("key", "owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", F.sha2("value", 256).alias("hash"))
    )
    base, runs = found.where(F.col("kind") < len(KINDS)), found.where(F.col("kind") == len(KINDS))
    # distinct (value, owner, document) first: a value that is everywhere is counted where it is read
    used = base.groupBy("hash", "owner", "key").agg(F.lit(1).alias("_one")).groupBy("hash", "owner").agg(F.count("*").alias("documents"))
    values = cut(used.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("documents").alias("documents")))
    small = values.count() <= SENT_IDS
    known = F.broadcast(values) if small else values
    judged = base.join(known.select("hash", "owners"), "hash").withColumn("live", F.col("owners") < EXAMPLE_OWNERS)
    live = values.where(F.col("owners") < EXAMPLE_OWNERS).select("hash")
    again = runs.join(F.broadcast(live) if small else live, "hash").withColumn("live", F.lit(True))
    names = ["key", "kind", "start", "end", "live"]
    spans = judged.select(*names).union(again.select(*names))
    earlier = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("kind") < len(KINDS), F.col("end"))).over(earlier)
    kept = spans.withColumn("_reach", reach).where((F.col("kind") < len(KINDS)) | F.col("_reach").isNull() | (F.col("_reach") < F.col("end")))
    label = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS), F.lit(REUSE)), F.col("kind") + 1)
    entry = F.struct("start", "kind", F.concat_ws(":", label, "start", "end").alias("span"))
    count = lambda condition: F.count(F.when(condition, 1))
    per_document = kept.groupBy("key").agg(
        F.array_sort(F.collect_list(entry)).alias("_all"),
        *(count(F.col("kind") == i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)),
        count(F.col("kind") == len(KINDS)).alias("n_reuse"),
        count((F.col("kind") < len(KINDS)) & F.col("live")).alias("n_live"),
        count((F.col("kind") < len(KINDS)) & ~F.col("live")).alias("n_example"),
    )
    text_of = lambda c: F.coalesce(F.transform(c, lambda x: x["span"]), F.array().cast("array<string>"))
    return source.select("doc_id", "key").join(per_document, "key", "left").select(
        "doc_id",
        text_of(F.filter("_all", lambda x: x["kind"] < len(KINDS))).alias("base"), text_of(F.col("_all")).alias("spans"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assign", "n_access", "n_hex", "n_reuse", "n_live", "n_example")),
    )

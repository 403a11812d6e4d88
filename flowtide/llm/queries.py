"""The registered queries of this folder, each over its whole table, and the SQL of those SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import decontam, exact, jaccard, langid, maintext, merkle, packing, phrases, rangecoder, repeats, secrets, simhash, warc
from flowtide.llm.common import prepare, read_table
from flowtide.session import configure, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(prepare(configure(spark)), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(read_table(spark, sf_dir, "pages"))


@query("op2_repeat_removal")
def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, sha256({NORMAL}) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(read_table(spark, sf_dir, "documents"))


@query(
    "op4_warc",
    """
    WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT payload_digest, min(page_id) AS first FROM t WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM t LEFT JOIN g USING (payload_digest)
    """,
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(read_table(spark, sf_dir, "documents"))


def _sql_matches(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, source, '{kind}' AS kind, {number} AS number, p + len(found[i]) AS "end", p AS start, value[i] AS value FROM (
      SELECT doc_id, source, found, value, i,
             list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS p
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
        SELECT doc_id, source, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found,
               regexp_extract_all(text, '{pattern}', {group}) AS value FROM documents WHERE regexp_matches(text, '{pattern}')))
    ) WHERE len(value[i]) >= {least}"""


def _secrets_sql() -> str:
    kinds = [_sql_matches(k, i, p.replace("'", "''"), g, least) for i, (k, p, g, least) in enumerate(secrets.KINDS)]
    runs = _sql_matches(secrets.REUSE, len(kinds), "[A-Za-z0-9+/_.=-]+", 0, 12)
    base = " UNION ALL ".join(f"({k})" for k in kinds)
    return f"""
    WITH base AS ({base}),
    vals AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM base GROUP BY 1),
    runs AS (SELECT * FROM ({runs}) WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
    again AS (
      SELECT r.* FROM runs r JOIN vals v ON r.value = v.value AND v.owners < {secrets.EXAMPLE_OWNERS}
      WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start <= r.start AND b."end" >= r."end")),
    spans AS (SELECT * FROM base UNION ALL SELECT * FROM again),
    g AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number) FILTER (kind <> 'reuse') AS b,
             string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number) AS spans,
             count(*) FILTER (kind = 'reuse') AS n_reuse, count(*) FILTER (kind <> 'reuse' AND owners < {secrets.EXAMPLE_OWNERS}) AS n_live,
             count(*) FILTER (kind <> 'reuse' AND owners >= {secrets.EXAMPLE_OWNERS}) AS n_example
      FROM spans JOIN vals USING (value) GROUP BY 1)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_reuse, 0) AS n_reuse, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM documents d LEFT JOIN g USING (doc_id)"""


@query("op7_secrets", _secrets_sql())
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"),
        "n_reuse", "n_live", "n_example",
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    rangecoder.write_ids(read_table(spark, sf_dir, "documents"), path)
    return rangecoder.checksums(rangecoder.read_ids(spark, path))


def _words_sql(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT {key}, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


CONTAMINATION_SQL = f"""
WITH d AS ({_words_sql('documents', 'doc_id')}), b AS ({_words_sql('benchmark', 'item_id')}),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + {decontam.WINDOW - 1}) AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {decontam.WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
occ AS (SELECT doc_id, i, n, x FROM (
    SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS x FROM (
      SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(x) AS n FROM win) WHERE len(w) >= n))
  WHERE x IN (SELECT x FROM win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM occ JOIN win USING (x) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontam.LEAST} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op10_decontamination", CONTAMINATION_SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATION_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS k) WHERE len(w) >= k)
  GROUP BY 1, 2, 3 HAVING count(*) >= {phrases.LEAST}),
covered AS (SELECT DISTINCT lang, k, part AS g FROM (
    SELECT h.lang, h.f, j AS k, unnest(list_transform(range(1, h.k - j + 2), lambda i: list_slice(h.g, i, i + j - 1))) AS part
    FROM g AS h, (SELECT unnest(range(2, {phrases.LONGEST})) AS j) WHERE j < h.k) AS x
  WHERE EXISTS (SELECT 1 FROM g AS s WHERE s.lang = x.lang AND s.g = x.part AND 100 * x.f >= 100 * s.f)),
cuts AS (SELECT c.lang, c.g, c.f AS a, j, list_slice(c.g, 1, j) AS lg, list_slice(c.g, j + 1, c.k) AS rg
  FROM (SELECT c.*, unnest(range(1, c.k)) AS j FROM g AS c WHERE c.k > 1 AND (c.lang, c.g) NOT IN (SELECT lang, g FROM covered)) AS c),
scored AS (SELECT cuts.lang, cuts.g, a, j, x.f AS l, y.f AS r, n, CAST({phrases.SCALE}::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN g AS x ON x.lang = cuts.lang AND x.g = lg JOIN g AS y ON y.lang = cuts.lang AND y.g = rg JOIN total ON total.lang = cuts.lang),
best AS (SELECT *, array_to_string(g, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {phrases.TOP}"""


@query("op11_phrase_collocations", COLLOCATION_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: list_slice(w, i, i + 2))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g AS x JOIN g AS y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
joined AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM joined UNION SELECT r.a, t.b FROM reach AS r JOIN joined AS t ON t.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN least_of ON a = doc_id"""


@query("op12_jaccard_join", JACCARD_SQL)
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(read_table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR) END" for f in fields) + ")"


_CRC_STEP = "list_reduce([xor(c, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
_TREE = """
  SELECT l, g, p, h FROM (SELECT l + 1 AS l, g, p // 8 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY l, g, p // 8)"""

MERKLE_SQL = rf"""
WITH RECURSIVE leaves AS (
  SELECT coalesce('=' || lang, '-') AS g, doc_id, {_leaf_sql('text')} AS h, {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT), lambda c, b: {_CRC_STEP}), 4294967295) % 3 = 0 AS third
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM leaves),
tree AS (SELECT 0 AS l, g, p, h FROM placed UNION ALL {_TREE.format(name='tree')}),
subs AS (SELECT g AS lang_of, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p FROM (SELECT g, arg_max(h, l) AS h FROM tree GROUP BY 1)),
top AS (SELECT 0 AS l, 0 AS g, p, subroot AS h FROM subs UNION ALL {_TREE.format(name='top')}),
root AS (SELECT arg_max(h, l) AS root FROM top),
sizes AS (SELECT g, max(l) AS steps FROM tree GROUP BY 1),
-- every node below a root: its level, the siblings left and right of it; the languages' tree goes on where theirs ends
runs AS (SELECT l, g, p, string_agg(h, '') OVER (PARTITION BY l, g, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt,
    string_agg(h, '') OVER (PARTITION BY l, g, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rt FROM tree),
top_runs AS (SELECT l, p, string_agg(h, '') OVER (PARTITION BY l, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt,
    string_agg(h, '') OVER (PARTITION BY l, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rt FROM top),
tops AS (SELECT max(l) AS steps FROM top),
steps AS (
  SELECT d.g, d.p AS leaf_no, r.l, coalesce(r.lt, '') AS lt, coalesce(r.rt, '') AS rt FROM placed d JOIN sizes z USING (g) JOIN runs r ON r.g = d.g AND r.l < z.steps AND r.p = d.p >> (3 * r.l)
  UNION ALL
  SELECT d.g, d.p, z.steps + r.l, coalesce(r.lt, ''), coalesce(r.rt, '') FROM placed d JOIN sizes z USING (g) JOIN subs s ON s.lang_of = d.g, tops t JOIN top_runs r ON r.l < t.steps AND r.p = s.p >> (3 * r.l)),
proofs AS (SELECT g, leaf_no, sha256(string_agg(lt || rt, '' ORDER BY l)) AS proof, list(struct_pack(a := lt, b := rt) ORDER BY l) AS path FROM steps GROUP BY 1, 2),
folds AS (SELECT d.g, d.p AS leaf_no, 0 AS l, CASE WHEN third THEN other ELSE h END AS h, path FROM placed d LEFT JOIN proofs q ON q.g = d.g AND q.leaf_no = d.p
  UNION ALL SELECT g, leaf_no, l + 1, sha256(path[l + 1].a || h || path[l + 1].b), path FROM folds WHERE l < len(path)),
ends AS (SELECT g, leaf_no, arg_max(h, l) AS folded_root FROM folds GROUP BY 1, 2)
SELECT d.doc_id, d.h AS leaf, s.subroot, root, coalesce(q.proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed d JOIN ends e ON e.g = d.g AND e.leaf_no = d.p JOIN subs s ON s.lang_of = d.g LEFT JOIN proofs q ON q.g = d.g AND q.leaf_no = d.p, root"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(read_table(spark, sf_dir, "documents"))

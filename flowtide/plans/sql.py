"""SQL texts of the shared inputs, for checking every query against another engine."""

from __future__ import annotations

from flowtide import bindings as B
from flowtide import schema as S

R = 6  # digits kept in results


def week_sql(ts: str) -> str:
    return (
        f"CASE WHEN extract('isoyear' FROM {ts}) < extract('year' FROM {ts})"
        f" THEN 'WEEK-' || CAST(extract('year' FROM {ts}) AS VARCHAR) || '-00'"
        f" ELSE 'WEEK-' || CAST(extract('isoyear' FROM {ts}) AS VARCHAR) || '-' ||"
        f" lpad(CAST(extract('week' FROM {ts}) AS VARCHAR), 2, '0') END"
    )


def packets_sql(rst: bool = True, jump: str = "0") -> str:
    """CTE ``pk``: events as packets, numbered per key in arrival order."""
    flag = "CASE WHEN event_type='error' THEN 4 ELSE 0 END" if rst else "0"
    fin = "CASE WHEN k < 15 THEN 1 ELSE 0 END" if rst else "0"
    return f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
pk AS (
  SELECT user_id AS flow_key, epoch_us(ts) - {jump} AS ts_us, event_id AS pkt_id,
    CASE WHEN event_type IN ('click','signup','error') THEN 0 ELSE 1 END AS side,
    CASE WHEN event_type='signup' THEN 0 ELSE CAST(floor(value*10.0::DOUBLE) AS BIGINT) END AS payload_len,
    16 + CASE WHEN event_type='signup' THEN 2 ELSE 0 END + {flag}
      + CASE WHEN event_type='view' THEN 8 ELSE 0 END + {fin} AS flags,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM ev)"""


def flows_sql(t: B.Timeouts = B.EV_TIMEOUTS, rst: bool = True, jump: str = "0") -> str:
    """WITH list ending in ``fl`` (one row per flow) and ``pp`` (recorded packets).

    The closing rules are folded packet by packet with a recursive CTE.
    """
    active = 10**18 if t.active_us is None else t.active_us
    linger = 0 if t.linger_us is None else t.linger_us
    fin_on = "FALSE" if t.linger_us is None else "TRUE"
    split = (
        f"(f.rst_last OR (f.close_at IS NOT NULL AND p.ts_us >= f.close_at)"
        f" OR p.ts_us - f.last_ts >= {t.idle_us} OR p.ts_us - f.start_ts >= {active})"
    )
    new_fin = (
        f"((CASE WHEN {split} THEN 0 ELSE f.fin END) |"
        f" (CASE WHEN {fin_on} AND (p.flags & 1) > 0 THEN (1 << p.side) ELSE 0 END))"
    )
    return f"""WITH RECURSIVE {packets_sql(rst, jump)},
fold AS (
  SELECT flow_key, rn, pkt_id, ts_us, 0 AS flow_no, ts_us AS start_ts, ts_us AS last_ts,
    CASE WHEN {fin_on} AND (flags & 1) > 0 THEN (1 << side) ELSE 0 END AS fin,
    CAST(NULL AS BIGINT) AS close_at, (flags & 4) > 0 AS rst_last, FALSE AS jumped
  FROM pk WHERE rn = 1
  UNION ALL
  SELECT p.flow_key, p.rn, p.pkt_id, p.ts_us,
    f.flow_no + CASE WHEN {split} THEN 1 ELSE 0 END,
    CASE WHEN {split} THEN p.ts_us ELSE f.start_ts END,
    CASE WHEN {split} THEN p.ts_us ELSE greatest(f.last_ts, p.ts_us) END,
    {new_fin},
    CASE WHEN {fin_on} AND (p.flags & 1) > 0 AND {new_fin} = 3 THEN p.ts_us + {linger}
         WHEN {split} THEN NULL ELSE f.close_at END,
    (p.flags & 4) > 0,
    NOT {split} AND p.ts_us < f.last_ts
  FROM fold f JOIN pk p ON p.flow_key = f.flow_key AND p.rn = f.rn + 1),
lab AS (
  SELECT p.*, f.flow_no, f.jumped,
    first_value(p.side) OVER w AS initiator, first_value(p.pkt_id) OVER w AS flow_id,
    lead(p.ts_us) OVER (PARTITION BY p.flow_key ORDER BY p.rn) AS next_ts
  FROM pk p JOIN fold f ON p.flow_key=f.flow_key AND p.rn=f.rn
  WINDOW w AS (PARTITION BY p.flow_key, f.flow_no ORDER BY p.rn)),
agg AS (
  SELECT flow_key, flow_no, flow_id, any_value(initiator) AS initiator,
    arg_min(ts_us, rn) AS start_us, max(ts_us) AS end_us,
    CAST(sum(CASE WHEN side=initiator THEN 1 ELSE 0 END) AS BIGINT) AS packets,
    CAST(sum(CASE WHEN side<>initiator THEN 1 ELSE 0 END) AS BIGINT) AS packets_rev,
    CAST(sum(CASE WHEN side=initiator THEN payload_len ELSE 0 END) AS BIGINT) AS bytes,
    CAST(sum(CASE WHEN side<>initiator THEN payload_len ELSE 0 END) AS BIGINT) AS bytes_rev,
    CAST(bit_or(flags) AS INTEGER) AS flags_seen,
    CAST(sum(CASE WHEN jumped THEN 1 ELSE 0 END) AS BIGINT) AS clock_jumps,
    arg_max(next_ts, rn) FILTER (next_ts IS NOT NULL OR TRUE) AS next_any,
    max(rn) AS last_rn,
    count(DISTINCT CASE WHEN (flags & 1) > 0 THEN side END) = 2 AS fin_both,
    arg_max(ts_us, rn) FILTER ((flags & 1) > 0) AS fin_us,
    arg_max((flags & 4) > 0, rn) AS rst_last
  FROM lab GROUP BY flow_key, flow_no, flow_id),
pay AS (
  SELECT *, row_number() OVER w AS j, lag(ts_us) OVER w AS prev_ts FROM lab WHERE payload_len > 0
  WINDOW w AS (PARTITION BY flow_key, flow_no ORDER BY rn)),
pp AS (
  SELECT flow_key, flow_no, flow_id, CAST(j AS INTEGER) AS j,
    CAST(CASE WHEN j=1 OR ts_us <= prev_ts THEN 0
      ELSE least(floor((ts_us-prev_ts)/{float(t.ipt_unit_us)} + 0.5), {S.IPT_MAX}) END AS INTEGER) AS ipt,
    CASE WHEN side=initiator THEN 1 ELSE -1 END AS dir,
    CAST(least(payload_len, {S.SIZE_MAX}) AS INTEGER) AS size,
    CASE WHEN (flags & 8) > 0 THEN 1 ELSE 0 END AS push
  FROM pay WHERE j <= {S.K_MAX}),
pl AS (SELECT flow_id, CAST(count(*) AS INTEGER) AS ppi_len FROM pp GROUP BY flow_id),
fl AS (
  SELECT a.*, p.ts_us AS next_us, coalesce(pl.ppi_len, 0) AS ppi_len,
    CAST(a.flow_key % 7 AS INTEGER) AS label, CAST(a.flow_key % 3 AS INTEGER) AS category,
    CAST(a.flow_key % 20 AS INTEGER) AS session_id,
    {week_sql("make_timestamp(a.start_us)")} AS period
  FROM agg a LEFT JOIN pk p ON p.flow_key=a.flow_key AND p.rn = a.last_rn+1
  LEFT JOIN pl ON pl.flow_id=a.flow_id)"""


def reason_sql(t: B.Timeouts = B.EV_TIMEOUTS) -> str:
    now = "coalesce(next_us, (SELECT max(ts_us) FROM pk))"
    return f"""CASE WHEN rst_last THEN 'rst'
  WHEN fin_both AND {now} >= fin_us + {t.linger_us} THEN 'fin'
  WHEN {now} - end_us >= {t.idle_us} THEN 'idle'
  WHEN {now} - start_us >= {t.active_us} THEN 'active'
  WHEN fin_both THEN 'fin' ELSE 'eof' END"""


def bin_sql(v: str, edges: list[int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {v} > {e} THEN 1 ELSE 0 END" for e in edges) + ")"


def prefix_stats_sql(k: str = "30", source: str = "pp", keys: str = "flow_id") -> str:
    """SELECT of the 46 prefix statistics over rows (flow_id, j, ipt, dir, size, push)."""
    cols = [
        ("bytes", "sum(CASE WHEN dir=1 THEN size ELSE 0 END)"),
        ("bytes_rev", "sum(CASE WHEN dir=-1 THEN size ELSE 0 END)"),
        ("packets", "sum(CASE WHEN dir=1 THEN 1 ELSE 0 END)"),
        ("packets_rev", "sum(CASE WHEN dir=-1 THEN 1 ELSE 0 END)"),
        ("duration", "sum(ipt)/1000.0"),
        ("ppi_len", "count(*)"),
        ("ppi_duration", "sum(ipt)"),
        ("ppi_roundtrips", "sum(turn)//2"),
    ]
    for block, (d, v, edges) in {
        "psize_hist": (1, "size", S.SIZE_EDGES),
        "psize_hist_rev": (-1, "size", S.SIZE_EDGES),
        "ipt_hist": (1, "ipt", S.IPT_EDGES),
        "ipt_hist_rev": (-1, "ipt", S.IPT_EDGES),
    }.items():
        for i in range(S.N_BINS):
            cols.append((f"{block}_{i}", f"sum(CASE WHEN dir={d} AND {bin_sql(v, edges)}={i} THEN 1 ELSE 0 END)"))
    for f in S.FLAG_BITS:
        cols.append((f"flag_{f.lower()}", "max(push)" if f == "PSH" else "0"))
    body = ",\n  ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in cols)
    return f"""SELECT {keys}, {body}
FROM (SELECT *, CASE WHEN dir <> lag(dir) OVER (PARTITION BY {keys} ORDER BY j) THEN 1 ELSE 0 END AS turn
      FROM {source} WHERE j <= {k}) GROUP BY {keys}"""


# --- embeddings as prefix scores ----------------------------------------------------------------

EM_LOGITS = """WITH RECURSIVE em AS (
  SELECT vec_id AS flow_id, CAST(label AS INTEGER) AS class_id,
    CASE WHEN label IN (8, 9) THEN -1 ELSE CAST(label AS INTEGER) END AS label,
    CASE WHEN vec_id % 5 <= 2 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split,
    CAST(3 + (vec_id * 7) % 28 AS INTEGER) AS ppi_len, CAST(vec_id // 100 AS INTEGER) AS period, embedding
  FROM embeddings),
dv AS MATERIALIZED (SELECT flow_id, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM em),
mu AS MATERIALIZED (SELECT label AS c, d, round(avg(v), 9) AS m FROM dv JOIN em USING (flow_id)
  WHERE split = 'train' AND label >= 0 AND d <= 60 GROUP BY label, d),
cum AS (SELECT flow_id, c, d, sum((v - m) * (v - m)) OVER (PARTITION BY flow_id, c ORDER BY d) AS s FROM dv JOIN mu USING (d)),
lg AS MATERIALIZED (SELECT flow_id, CAST(d // 2 AS INTEGER) AS k, c, round(-80.0::DOUBLE * s, 9) AS z FROM cum WHERE d % 2 = 0),
ef AS MATERIALIZED (SELECT em.flow_id, em.label, em.split, em.ppi_len, em.period, CAST(g.k AS INTEGER) AS k, lg.c, lg.z
  FROM em CROSS JOIN (SELECT unnest(range(1, 31)) AS k) g JOIN lg ON lg.flow_id = em.flow_id AND lg.k = least(g.k, em.ppi_len))"""


def class_scores_sql(adj: str = "0.0::DOUBLE", temp: str = "1.0::DOUBLE", name: str = "cs", digits: int = 6) -> str:
    """CTE ``name`` from ``ef``; ``adj`` may use column c, ``temp`` column k."""
    return f"""{name} AS MATERIALIZED (
  SELECT flow_id, any_value(label) AS label, any_value(split) AS split, any_value(ppi_len) AS ppi_len, any_value(period) AS period, k,
    CAST(min(c) FILTER (a = m) AS INTEGER) AS pred, CAST(min(c) FILTER (z = mr) AS INTEGER) AS pred_raw,
    round(1.0::DOUBLE / sum(exp((a - m) / t)), {digits}) AS conf,
    round((1.0::DOUBLE - exp((list_sort(list(a), 'DESC')[2] - any_value(m)) / any_value(t))) / sum(exp((a - m) / t)), {digits}) AS margin,
    round(-any_value(t) * (any_value(m) / any_value(t) + ln(sum(exp((a - m) / t)))), {digits}) AS energy,
    round(-(any_value(mr) + ln(sum(exp(z - mr)))), {digits}) AS energy_raw
  FROM (SELECT *, max(a) OVER (PARTITION BY flow_id, k) AS m, max(z) OVER (PARTITION BY flow_id, k) AS mr
        FROM (SELECT *, z + {adj} AS a, {temp} AS t FROM ef))
  GROUP BY flow_id, k)"""


EM_SCORED = (
    EM_LOGITS
    + ",\n"
    + class_scores_sql()
    + """,
sc AS MATERIALIZED (SELECT cs.*, conf AS p_safe, coalesce(round((SELECT avg(1.0::DOUBLE - b.conf) FROM cs b
    WHERE b.flow_id = cs.flow_id AND b.k >= 2 AND b.k <= least(cs.k, cs.ppi_len)), 12), 0.0::DOUBLE) AS surprise FROM cs)"""
)

#: diagonal relative distance on the 60 features that prefixes fill, shrunk by 0.1, classes with >= 10 flows
EM_MAHAL = """,
tr AS MATERIALIZED (SELECT em.flow_id, em.label AS c, em.ppi_len, d, v FROM em JOIN dv USING (flow_id)
  WHERE split = 'train' AND label >= 0 AND d <= 60),
ks AS (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k),
vc AS MATERIALIZED (SELECT k, label AS c, count(*) AS n FROM em, ks WHERE split = 'train' AND label >= 0 AND ppi_len >= k
  GROUP BY k, label HAVING count(*) >= 10),
cm AS MATERIALIZED (SELECT k, c, d, avg(v) AS m FROM tr JOIN vc USING (c) WHERE ppi_len >= k AND d <= 2 * k GROUP BY k, c, d),
pv0 AS (SELECT k, d, sum((v - m) * (v - m)) / (count(*) - count(DISTINCT c)) AS v FROM tr JOIN cm USING (c, d)
  WHERE ppi_len >= k GROUP BY k, d),
pv AS MATERIALIZED (SELECT k, d, 0.9::DOUBLE * v + 0.1::DOUBLE * avg(v) OVER (PARTITION BY k) AS v FROM pv0),
bg0 AS (SELECT k, d, avg(v) AS m, var_pop(v) AS v FROM tr, ks WHERE ppi_len >= k AND d <= 2 * k GROUP BY k, d),
bg AS MATERIALIZED (SELECT k, d, m, 0.9::DOUBLE * v + 0.1::DOUBLE * avg(v) OVER (PARTITION BY k) AS v FROM bg0),
dc AS (SELECT dv.flow_id, cm.k, cm.c, sum((dv.v - cm.m) * (dv.v - cm.m) / pv.v) AS q FROM dv JOIN cm USING (d)
  JOIN pv ON pv.k = cm.k AND pv.d = cm.d GROUP BY dv.flow_id, cm.k, cm.c),
db AS (SELECT dv.flow_id, bg.k, sum((dv.v - bg.m) * (dv.v - bg.m) / bg.v) AS q FROM dv JOIN bg USING (d) GROUP BY dv.flow_id, bg.k),
mh AS MATERIALIZED (SELECT em.flow_id, ks.k, coalesce(round(min(dc.q) - any_value(db.q), 6), 0.0::DOUBLE) AS mahal
  FROM em CROSS JOIN ks LEFT JOIN dc ON dc.flow_id = em.flow_id AND dc.k = least(ks.k, em.ppi_len)
  LEFT JOIN db ON db.flow_id = em.flow_id AND db.k = least(ks.k, em.ppi_len) GROUP BY em.flow_id, ks.k)"""

EM_SCORES = (
    EM_SCORED
    + EM_MAHAL
    + """,
s0 AS MATERIALIZED (SELECT sc.*, mh.mahal FROM sc JOIN mh USING (flow_id, k)),
zp AS MATERIALIZED (SELECT k, avg(energy) AS em, CASE WHEN count(*) >= 2 AND stddev_pop(energy) > 1e-8 THEN stddev_pop(energy) END AS es,
  avg(mahal) AS mm, CASE WHEN count(*) >= 2 AND stddev_pop(mahal) > 1e-8 THEN stddev_pop(mahal) END AS ms,
  avg(surprise) AS sm, CASE WHEN count(*) >= 2 AND stddev_pop(surprise) > 1e-8 THEN stddev_pop(surprise) END AS ss
  FROM s0 WHERE split = 'val' AND label >= 0 AND k <= ppi_len GROUP BY k),
su AS MATERIALIZED (SELECT s0.*, round(coalesce((energy - em) / es, 0) + coalesce((mahal - mm) / ms, 0)
   + 0.5::DOUBLE * coalesce((surprise - sm) / ss, 0), 6) AS u, round(coalesce((energy - em) / es, 0), 6) AS z_energy
  FROM s0 LEFT JOIN zp USING (k))"""
)


def theta_sql(f: float = 0.02, name: str = "th") -> str:
    return f"""{name} AS MATERIALIZED (SELECT k, round(quantile_cont(u, {1.0 - f}::DOUBLE), 9) AS theta FROM su
  WHERE split = 'val' AND label >= 0 AND k <= ppi_len GROUP BY k HAVING count(*) >= 2)"""

"""The comparison in plain SQL, as DuckDB runs it on the given tables.

Averages use whole-number arithmetic because DuckDB divides decimals as
doubles; texts are hashed as UTF-8, which is what DuckDB's sha256 does.
"""

from __future__ import annotations

from contract.inputs import plan_xml

LINE_SIDE = ("CASE WHEN l_partkey % 50 IN (14,15) THEN 'H' WHEN l_partkey % 50 IN (22,23) THEN 'L' "
             "WHEN l_linestatus='F' THEN 'L' ELSE 'H' END AS side")

# --- derived inputs -------------------------------------------------------

RUN_INPUTS = f"""
rs AS (
 SELECT {LINE_SIDE},
  l_partkey*10 + CASE WHEN CAST(floor(l_partkey/4) AS BIGINT) % 3 = 0 THEN 0 ELSE l_linenumber % 3 END AS plan_id,
  CAST(year(l_shipdate)*12 + month(l_shipdate) AS BIGINT) AS runtime_stats_interval_id,
  CAST(1 AS INT) AS replica_group_id,
  CAST(l_quantity AS BIGINT) AS count_executions,
  CASE WHEN l_partkey % 50 IN (26,27) AND l_linestatus='F' THEN CAST(0 AS DECIMAL(18,2))
       ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS avg_logical_io_reads,
  CAST(CAST(CAST(l_discount AS DECIMAL(18,2))*100 AS BIGINT) + 1 AS DECIMAL(18,2)) AS avg_cpu_time,
  CAST(CAST(CAST(l_tax AS DECIMAL(18,2))*100 AS BIGINT)*10 + l_linenumber AS DECIMAL(18,2)) AS avg_duration
 FROM lineitem),
ivl AS (
 SELECT DISTINCT {LINE_SIDE},
  CAST(year(l_shipdate)*12 + month(l_shipdate) AS BIGINT) AS runtime_stats_interval_id,
  CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS start_time,
  CAST(date_trunc('month', l_shipdate) + INTERVAL '1' MONTH AS TIMESTAMP) AS end_time FROM lineitem),
pln AS (
 SELECT side, p_partkey*10 + d AS plan_id, p_partkey AS query_id, {plan_xml()} AS query_plan
 FROM part, (SELECT unnest([0,1,2]) AS d), (SELECT unnest(['L','H']) AS side)),
qry AS (
 SELECT s.side, p_partkey AS query_id, p_partkey AS query_text_id,
  CASE WHEN CAST(floor(p_partkey/4) AS BIGINT) % 3 = 0 THEN 1000000000 + p_partkey
       ELSE CAST(floor(p_partkey/2) AS BIGINT) END AS query_hash,
  CASE WHEN CAST(floor(p_partkey/4) AS BIGINT) % 5 = 0 THEN CAST(NULL AS INT)
       WHEN CAST(floor(p_partkey/4) AS BIGINT) % 5 = 1 THEN 0
       ELSE CAST(CAST(floor(p_partkey/4) AS BIGINT) % 25 + 1 AS INT) END AS object_id,
  CAST(CASE WHEN p_partkey % 61 = 0 THEN 1 ELSE 0 END AS INT) AS is_internal_query
 FROM part CROSS JOIN (SELECT 'L' AS side UNION ALL SELECT 'H') s),
txt AS (
 SELECT s.side, p_partkey AS query_text_id, concat(
  CASE CAST(floor(p_partkey/4) AS BIGINT) % 7 WHEN 0 THEN 'SELECT * FROM t' WHEN 1 THEN '(@p int)SELECT c FROM t'
   WHEN 2 THEN 'INSERT INTO t' WHEN 3 THEN 'UPDATE t' WHEN 4 THEN 'DELETE FROM t'
   WHEN 5 THEN 'WITH c AS (SELECT 1 AS x) UPDATE t' ELSE 'MERGE t' END,
  CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE chr(9) END, 'K',
  CAST(CASE WHEN CAST(floor(p_partkey/4) AS BIGINT) % 10 = 0 THEN CAST(floor(p_partkey/4) AS BIGINT)
       ELSE CAST(floor(p_partkey/2) AS BIGINT) END AS VARCHAR)) AS query_sql_text
 FROM part CROSS JOIN (SELECT 'L' AS side UNION ALL SELECT 'H') s),
obj AS (SELECT CAST(n_nationkey+1 AS INT) AS object_id, n_name AS name, n_regionkey AS schema_id FROM nation),
sch AS (SELECT r_regionkey AS schema_id, r_name AS name FROM region)"""


# --- expressions ----------------------------------------------------------

def average(total: str, n: str) -> str:
    """total / n to six places, halves up; 0 for n = 0."""
    return (f"CASE WHEN {n} = 0 THEN CAST(0 AS DECIMAL(38,6)) ELSE CAST(CAST((CAST({total}*100 AS HUGEINT)*20000 + {n})"
            f"//(2*{n}) AS DECIMAL(38,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(38,6)) END")


def ratio(high: str, low: str) -> str:
    """high / low to six places, halves up; both have six places."""
    h, low_int = f"CAST({high}*1000000 AS HUGEINT)", f"CAST({low}*1000000 AS HUGEINT)"
    return (f"CASE WHEN {low} IS NULL OR {low} = 0 THEN NULL ELSE CAST(CAST(({h}*2000000 + {low_int})//(2*{low_int}) "
            f"AS DECIMAL(38,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(19,6)) END")


def hex0x(digest: str) -> str:
    return f"('0x' || upper({digest}))"


def pair(low: str, high: str) -> str:
    return f"(coalesce(CAST({low} AS VARCHAR),'?') || ' - ' || coalesce(CAST({high} AS VARCHAR),'?'))"


def two(value: str, kind: str = "DECIMAL(38,2)") -> str:
    return f"CAST(round({value}, 2) AS {kind})"


SPACED = "replace(replace(replace({t}, chr(13), ' '), chr(10), ' '), chr(9), ' ')"
NORMAL = "lower(trim(" + SPACED + ", ' '))"


# --- steps ----------------------------------------------------------------

METRIC = {"LogicalReads": "reads", "CPU": "cpu", "Duration": "dur"}
FEATURES = f"""
tf0 AS (SELECT side, query_text_id, query_sql_text AS sample, {NORMAL.format(t='query_sql_text')} AS norm,
 ltrim({SPACED.format(t='query_sql_text')}, ' ') AS raw FROM txt),
tf1 AS (SELECT *, upper(CASE WHEN raw LIKE '(%' AND instr(raw, ')') > 0
 THEN ltrim(substr(raw, instr(raw, ')') + 1), ' ') ELSE raw END) AS clean FROM tf0),
tf2 AS (SELECT *, nullif(instr(clean,'SELECT'),0) AS ps, nullif(instr(clean,'INSERT'),0) AS pi,
 nullif(instr(clean,'UPDATE'),0) AS pu, nullif(instr(clean,'DELETE'),0) AS pd FROM tf1),
tf AS (SELECT side, query_text_id, sample, norm, sha256(sample) AS text_hash, sha256(norm) AS norm_hash,
 CASE least(ps,pi,pu,pd) WHEN ps THEN 'SELECT' WHEN pi THEN 'INSERT' WHEN pu THEN 'UPDATE' WHEN pd THEN 'DELETE' END AS detected
 FROM tf2)"""


def plan_agg(where: str = "TRUE") -> str:
    return f"""
pa AS (
 SELECT r.side, p.plan_id, q.query_id, q.query_text_id, q.object_id, q.query_hash,
  CAST(sum(r.count_executions) AS BIGINT) AS sum_exec,
  CAST(sum(r.avg_logical_io_reads * r.count_executions) AS DECIMAL(38,2)) AS t_reads,
  CAST(sum(r.avg_cpu_time * r.count_executions) AS DECIMAL(38,2)) AS t_cpu,
  CAST(sum(r.avg_duration * r.count_executions) AS DECIMAL(38,2)) AS t_dur,
  min(i.start_time) AS start_min, max(i.end_time) AS end_max
 FROM rs r JOIN ivl i ON i.side = r.side AND i.runtime_stats_interval_id = r.runtime_stats_interval_id
  JOIN pln p ON p.side = r.side AND p.plan_id = r.plan_id
  JOIN qry q ON q.side = r.side AND q.query_id = p.query_id
 WHERE (q.object_id >= 0 OR q.object_id IS NULL) AND {where}
 GROUP BY r.side, p.plan_id, q.query_id, q.query_text_id, q.object_id, q.query_hash)"""


def identified(group_by: str, metric: str, statement_type: str = "ALL") -> str:
    key = {"QueryHash": "sha256(unhex(lpad(to_hex(pa.query_hash), 16, '0')))",
           "QueryText": "tf.text_hash", "NormalizedText": "tf.norm_hash"}[group_by]
    m = METRIC[metric]
    typed = "" if statement_type == "ALL" else f" WHERE tf.detected = '{statement_type}'"
    return f"""
idp AS (
 SELECT pa.side, pa.plan_id, pa.query_id, pa.object_id, pa.query_hash, pa.sum_exec, pa.t_{m} AS t_metric, pa.t_dur,
  {average(f'pa.t_{m}', 'pa.sum_exec')} AS a_metric, {average('pa.t_dur', 'pa.sum_exec')} AS a_dur,
  pa.start_min, pa.end_max,
  CASE WHEN pa.object_id > 0 THEN 'SP' ELSE 'Adhoc' END AS qtype,
  CASE WHEN pa.object_id > 0 THEN sch.name || '.' || obj.name END AS oname,
  {key} AS gkey, tf.sample
 FROM pa JOIN tf ON tf.side = pa.side AND tf.query_text_id = pa.query_text_id
  LEFT JOIN obj ON obj.object_id = pa.object_id LEFT JOIN sch ON sch.schema_id = obj.schema_id{typed})"""


def groups(split: bool = False) -> str:
    keys = "side, qtype, oname, gkey" + (", query_hash" if split else "")
    other = "" if split else "min(query_hash) AS query_hash,"
    return f"""
gs AS (
 SELECT {keys}, min(object_id) AS object_id, {other} min(sample) AS sample, min(query_id) AS qmin, max(query_id) AS qmax,
  CAST(count(DISTINCT plan_id) AS INTEGER) AS plan_count, CAST(sum(sum_exec) AS BIGINT) AS exec_count,
  CAST(sum(t_metric) AS DECIMAL(38,6)) AS total_metric,
  {average('CAST(sum(t_metric) AS DECIMAL(38,2))', 'CAST(sum(sum_exec) AS BIGINT)')} AS avg_metric,
  CAST(sum(t_dur) AS DECIMAL(38,6)) AS total_duration,
  {average('CAST(sum(t_dur) AS DECIMAL(38,2))', 'CAST(sum(sum_exec) AS BIGINT)')} AS avg_duration,
  min(start_min) AS start_min, max(end_max) AS end_max
 FROM idp GROUP BY {keys})"""


SIDE_VALUES = ("plan_count", "exec_count", "total_metric", "avg_metric", "total_duration", "avg_duration")


def compared(min_exec: int, split: bool = False) -> str:
    """Both sides folded into one row per key: a value of a side is that side's only one."""
    def of(column: str, side: str) -> str:
        return f"any_value({column}) FILTER (WHERE side = '{side}')"

    folded = [f"{of(c, s)} AS {c}_{t}" for t, s in (("l", "L"), ("h", "H"))
              for c in (*SIDE_VALUES, "query_hash", "sample", "qmin", "qmax")]
    filled = [f"coalesce({c}_{t}, 0) AS {c}_{t}" for c in SIDE_VALUES for t in "lh"]
    ranges = [f"CAST(qmin_{t} AS VARCHAR) || '-' || CAST(qmax_{t} AS VARCHAR) AS query_id_range_{t}" for t in "lh"]
    worst = "least(coalesce(exec_count_l, 0), coalesce(exec_count_h, 0))"
    flags = [(f"{worst} = 0", "MISSING_ONE_SIDE"), (f"{worst} < {min_exec}", "LOW_EXEC"),
             ("greatest(plan_count_l, plan_count_h) > 1", "MULTI_PLAN"),
             *[(f"exec_count_{t} IS NOT NULL", note) for t in "lh" for note in ("WEIGHTED_TOTAL", "PLAN_FIRST_PREAGG")]]
    raised = " || ".join(f"if({condition}, '{name};', '')" for condition, name in flags)
    return f"""
both_sides AS (SELECT gkey, qtype, any_value(oname) AS oname, {', '.join(folded)}
 FROM gs GROUP BY gkey, qtype, coalesce(oname, ''){', query_hash' if split else ''}),
cmp AS (SELECT gkey, qtype, oname, query_hash_l, query_hash_h, {', '.join(ranges)}, {', '.join(filled)},
 {ratio('avg_metric_h', 'avg_metric_l')} AS regression_ratio,
 CAST(coalesce(avg_metric_h, 0) - coalesce(avg_metric_l, 0) AS DECIMAL(38,6)) AS delta_avg_metric,
 CASE WHEN avg_metric_l <> 0 THEN CAST(CAST(CAST((coalesce(avg_metric_h, 0) - avg_metric_l)*1000000 AS HUGEINT)
  * coalesce(exec_count_h, 0) AS DECIMAL(38,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(38,6)) END AS impact_score,
 {raised} AS confidence_flags, coalesce(sample_h, sample_l) AS query_text_sample FROM both_sides)"""


def regressions(min_exec: int, min_ratio: str = "1.25", multi: bool = False) -> str:
    only = " AND (plan_count_l > 1 OR plan_count_h > 1)" if multi else ""
    return f"""
reg AS (SELECT * FROM cmp WHERE regression_ratio IS NOT NULL AND avg_metric_h > avg_metric_l
 AND exec_count_l >= {min_exec} AND exec_count_h >= {min_exec} AND regression_ratio >= {min_ratio}{only})"""


def _best(side: str) -> str:
    """The plan that the most executions, then the highest average, then the highest id make first."""
    return (f"max({{'n': sum_exec, 'a': a_metric, 'p': plan_id, 'q': query_id}}) FILTER (WHERE side = '{side}')")


def _regressed_only(rows: str, keys: str) -> str:
    return (f"SELECT {rows}.* FROM {rows} SEMI JOIN {keys} k ON k.gkey = {rows}.gkey AND k.qtype = {rows}.qtype "
            f"AND coalesce(k.oname,'') = coalesce({rows}.oname,'')")


DOMINANT = f"""
cand AS ({_regressed_only('idp', 'reg')}),
best AS (SELECT gkey, qtype, any_value(oname) AS oname, {_best('L')} AS l, {_best('H')} AS h
 FROM cand GROUP BY gkey, qtype, coalesce(oname,'')),
prs AS (SELECT gkey, qtype, oname, l.p AS plan_id_l, h.p AS plan_id_h, l.q AS query_id_l, h.q AS query_id_h FROM best),
dom AS (SELECT s.side, gkey, qtype, oname, s.b.p AS plan_id, s.b.q AS query_id, s.b.n AS sum_exec, s.b.a AS a_metric
 FROM (SELECT gkey, qtype, oname, unnest([{{'side': 'L', 'b': l}}, {{'side': 'H', 'b': h}}]) AS s FROM best)
 WHERE s.b.p IS NOT NULL)"""

# here a key keeps one plan per side, whatever its type and name
MULTI = f"""
mreg AS (SELECT * FROM reg WHERE greatest(plan_count_l, plan_count_h) > 1),
mcand AS ({_regressed_only('idp', 'mreg')}),
mpl AS (SELECT mcand.*, sha256(p.query_plan) AS xml_hash FROM mcand JOIN pln p USING (side, plan_id)),
mdom AS (SELECT side, gkey, unnest(max({{'sum_exec': sum_exec, 'a_metric': a_metric, 'plan_id': plan_id,
  'query_id': query_id, 'qtype': qtype, 'oname': oname}})) FROM mpl GROUP BY side, gkey),
mbest AS (SELECT gkey, qtype, any_value(oname) AS oname, {_best('L')} AS l, {_best('H')} AS h
 FROM mdom GROUP BY gkey, qtype, coalesce(oname,'')),
mprs AS (SELECT gkey, qtype, oname, l.p AS plan_id_l, h.p AS plan_id_h, l.q AS query_id_l, h.q AS query_id_h,
 l.n AS exec_l, h.n AS exec_h, l.a AS avg_l, h.a AS avg_h FROM mbest)"""


def comparison(group_by: str = "QueryHash", metric: str = "LogicalReads", statement_type: str = "ALL",
               min_exec: int = 300, multi: bool = False, split: bool = False, where: str = "TRUE") -> str:
    """Everything up to the regressed rows, as a WITH clause."""
    return "WITH " + ",".join([
        RUN_INPUTS, FEATURES, plan_agg(where), identified(group_by, metric, statement_type), groups(split),
        compared(min_exec, split), regressions(min_exec, multi=multi),
    ])


# --- plan XML -------------------------------------------------------------

def _physical(op: str) -> str:
    return f'PhysicalOp="{op}"'


# name, kind, pattern in the derived XML
XML_FACTS = (
    ("index_seek_count", "count", _physical("Index Seek")),
    ("index_scan_count", "count", _physical("Index Scan")),
    ("table_scan_count", "count", _physical("Table Scan")),
    ("has_hash_join", "bit", _physical("Hash Match")),
    ("has_merge_join", "bit", _physical("Merge Join")),
    ("has_nested_loops", "bit", _physical("Nested Loops")),
    ("has_parallelism", "bit", _physical("Parallelism")),
    ("has_spill", "bit", "<SpillToTempDb"),
    ("has_missing_index", "bit", "<MissingIndexes"),
    ("key_lookup_count", "count", _physical("Key Lookup")),
    ("rid_lookup_count", "count", _physical("RID Lookup")),
    ("sort_count", "count", _physical("Sort")),
    ("hash_agg_count", "count", 'PhysicalOp="Hash Match" LogicalOp="Aggregate"'),
    ("stream_agg_count", "count", _physical("Stream Aggregate")),
    ("spool_count", "count", 'PhysicalOp="[^"]*Spool'),
    ("filter_count", "count", _physical("Filter")),
    ("compute_scalar_count", "count", _physical("Compute Scalar")),
    ("has_adaptive_join", "bit", _physical("Adaptive Join")),
    ("has_batch_mode", "bit", 'EstimatedExecutionMode="Batch"'),
    ("has_columnstore", "bit", 'Storage="ColumnStore"'),
    ("requested_memory_kb", "value", "RequestedMemory"),
    ("granted_memory_kb", "value", "GrantedMemory"),
    ("used_memory_kb", "value", "UsedMemory"),
    ("has_memory_grant_warning", "bit", "<MemoryGrantWarning"),
    ("has_implicit_conversion", "bit", "<PlanAffectingConvert"),
    ("has_no_join_predicate", "bit", "<NoJoinPredicate"),
    ("has_missing_stats", "bit", "<MissingStatistics"),
)


def xml_fact(kind: str, pattern: str, xml: str) -> str:
    """A fact of well-formed XML, of which the last thing is the end of its root."""
    xml = f"CASE WHEN {xml} LIKE '%</ShowPlanXML>' THEN {xml} END"
    if kind == "value":
        return f"TRY_CAST(regexp_extract({xml}, '{pattern}=\"([0-9]+)\"', 1) AS BIGINT)"
    count = f"CAST(len(regexp_extract_all({xml}, '{pattern}')) AS INTEGER)"
    return count if kind == "count" else f"CASE WHEN {xml} IS NULL THEN NULL WHEN {count} > 0 THEN 1 ELSE 0 END"


def indicators() -> str:
    facts = ", ".join(f"{xml_fact(kind, pattern, 'p.query_plan')} AS {name}" for name, kind, pattern in XML_FACTS)
    return f"""
ind AS (SELECT m.side, m.gkey, m.qtype, m.oname, m.plan_id, p.query_plan,
 CASE WHEN p.query_plan IS NULL THEN NULL ELSE sha256(p.query_plan) END AS xml_hash, {facts}
 FROM mdom m JOIN pln p ON p.side = m.side AND p.plan_id = m.plan_id)"""

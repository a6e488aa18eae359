"""Registered audits and ratios of sessions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import adapters as A
from quarry.operators import sessions
from quarry.registry import register

_TOOLS = {
    "view": ("get_symbols_overview", "find_symbol", "get_file_diagnostics", "explore_codebase"),
    "click": ("review_changes", "get_changed_files", "impact_report", "verify_change_readiness"),
    "purchase": ("rename_symbol", "replace_symbol_body", "safe_rename_report", "unresolved_reference_check"),
    "signup": ("prepare_harness_session", "prepare_harness_session", "claim_files", "find_symbol"),
    "error": ("read_file", "read_file", "find_scoped_references", "onboard_project"),
}
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_TOOL = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN CASE {_K} % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END" for t, names in _TOOLS.items()
) + " END"
# a session is a user's calls of one day; a third of the calls name no path
_COLUMNS = [
    "concat(CAST(user_id AS STRING), '/', CAST(CAST(ts AS DATE) AS STRING)) AS session", "event_id AS seq", f"{_TOOL} AS tool",
    f"CASE WHEN {_K} % 3 > 0 THEN concat('f', CAST({_K} % 2 AS STRING)) END AS path",
]
_TL = f"tl AS (SELECT {', '.join(_COLUMNS)} FROM events)".replace("AS STRING", "AS VARCHAR")


def _timeline(spark, d):
    return A.table(spark, d, "events").selectExpr(*_COLUMNS)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@register(
    "session_types",
    f"""WITH {_TL}, g AS (SELECT session, count(*) AS n, count(*) FILTER (tool IN ('rename_symbol', 'replace_symbol_body')) AS m,
  count(*) FILTER (tool IN ('get_changed_files', 'impact_report', 'verify_change_readiness')) AS v, count(*) FILTER (tool IN ('get_symbols_overview', 'explore_codebase', 'onboard_project')) AS e,
  count(*) FILTER (tool IN ('safe_rename_report', 'unresolved_reference_check', 'find_scoped_references')) AS r FROM tl GROUP BY 1)
SELECT session, CASE WHEN r >= 2 OR (m >= 1 AND r >= 1) THEN 'refactoring' WHEN v >= 2 THEN 'code_review' WHEN m >= 2 THEN 'code_modification' WHEN e >= 2 THEN 'onboarding' WHEN n < 5 THEN 'brief' ELSE 'mixed' END AS session_type FROM g""",
)
def session_types(spark, d):
    return sessions.types(_timeline(spark, d))


def _kpi_sql() -> str:
    total = lambda names: " + ".join(names)
    rates = [f"round(coalesce(({total(a)}) / nullif(({total(b)}), 0), 0), 6) AS {name}" for name, (a, b) in sessions.KPIS.items()]
    counters = [f"count(*) FILTER (k % {i + 2} = 0) AS {c}" for i, c in enumerate(sessions.COUNTERS)]
    return f"""WITH g AS (SELECT session, {", ".join(counters)} FROM (SELECT CAST(user_id AS VARCHAR) AS session, {_K} AS k FROM events) GROUP BY 1)
SELECT session, {", ".join(rates)}, round(1 - coalesce(repeated_low_level_chain_count / nullif(low_level_calls, 0), 0), 6) AS low_level_chain_reduction FROM g"""


@register("session_kpis", _kpi_sql())
def session_kpis(spark, d):
    """The counters are made from the calls' argument: the n-th counts the multiples of n + 2."""
    rows = A.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.expr(_K).alias("k"))
    counters = rows.groupBy("session").agg(*[F.count_if(F.col("k") % (i + 2) == 0).alias(c) for i, c in enumerate(sessions.COUNTERS)])
    return sessions.kpis(counters)


_CHAINS = f"""lo AS (SELECT *, tool IN {_in(("find_symbol", "get_symbols_overview", "get_file_diagnostics", "read_file"))} AS low FROM tl),
l3 AS (SELECT *, coalesce(lag(low) OVER w, false) AS a, coalesce(lag(low, 2) OVER w, false) AS b FROM lo WINDOW w AS (PARTITION BY session ORDER BY seq)),
ch AS (SELECT session, count(*) FILTER (low AND a AND b) AS chains FROM l3 GROUP BY 1)"""


@register("low_level_chains", f"WITH {_TL}, {_CHAINS} SELECT session, chains FROM ch")
def low_level_chains(spark, d):
    return sessions.chains(_timeline(spark, d))


_MUT, _PRE, _REN = _in(("rename_symbol", "replace_symbol_body")), _in(sessions.PREFLIGHTS), _in(sessions.RENAME_PREFLIGHTS)
_BUILDER = f"""mu AS (SELECT m.session, m.path, m.seq, m.tool,
    EXISTS (SELECT 1 FROM tl x WHERE x.session = m.session AND x.path = m.path AND x.seq < m.seq AND x.tool IN {_PRE}) AS checked,
    EXISTS (SELECT 1 FROM tl x WHERE x.session = m.session AND x.path = m.path AND x.seq < m.seq AND x.tool IN {_REN}) AS rchecked,
    EXISTS (SELECT 1 FROM tl x WHERE x.session = m.session AND x.path = m.path AND x.seq < m.seq AND x.tool = 'get_file_diagnostics') AS before,
    EXISTS (SELECT 1 FROM tl x WHERE x.session = m.session AND x.path = m.path AND x.seq > m.seq AND x.tool = 'get_file_diagnostics') AS after
  FROM tl m WHERE m.tool IN {_MUT} AND m.path IS NOT NULL),
to_ AS (SELECT DISTINCT session, path FROM tl WHERE path IS NOT NULL AND (tool IN {_MUT} OR tool IN {_PRE} OR tool = 'claim_files')),
bg AS (SELECT session, min(seq) FILTER (tool = 'prepare_harness_session') AS up, min(seq) FILTER (tool IN {_MUT} OR tool IN {_PRE} OR tool = 'claim_files') AS began FROM tl GROUP BY 1),
bf AS (SELECT session, 'bootstrap_order' AS code FROM bg WHERE began IS NOT NULL AND (up IS NULL OR up > began)
  UNION SELECT session, 'mutation_gate' FROM mu WHERE NOT checked OR (tool = 'rename_symbol' AND NOT rchecked)
  UNION SELECT session, 'structure_evidence' FROM to_ WHERE NOT EXISTS (SELECT 1 FROM tl x WHERE x.session = to_.session AND x.path = to_.path AND x.tool = 'get_symbols_overview')
  UNION SELECT session, 'diagnostics_before_mutation' FROM mu WHERE NOT before
  UNION SELECT session, 'diagnostics_after_mutation' FROM mu WHERE NOT after),
ba AS (SELECT bg.session, 'builder' AS role, CASE WHEN count(*) FILTER (code = 'mutation_gate') > 0 THEN 'fail' WHEN count(code) > 0 THEN 'warn' ELSE 'pass' END AS status,
  coalesce(string_agg(code, ',' ORDER BY code), '') AS findings FROM bg LEFT JOIN bf ON bf.session = bg.session WHERE began IS NOT NULL GROUP BY bg.session)"""
_ASKED = _in(sessions.WORKFLOWS)
_PLANNER = f"""pg AS (SELECT session, min(seq) FILTER (tool = 'prepare_harness_session') AS up, min(seq) FILTER (tool IN {_ASKED}) AS began, count(*) FILTER (tool IN {_MUT}) AS mut,
  count(*) FILTER (tool = 'get_changed_files' AND path IS NOT NULL) AS ev, count(*) FILTER (tool IN {_in(sessions.CHANGE_WORKFLOWS)} AND path IS NULL) AS blind FROM tl GROUP BY 1),
pr AS (SELECT DISTINCT session, path FROM tl WHERE path IS NOT NULL AND (tool IN {_ASKED} OR tool = 'get_changed_files')),
pf AS (SELECT session, 'bootstrap_order' AS code FROM pg WHERE up IS NULL OR up > began UNION SELECT session, 'read_side_mutation_attempt' FROM pg WHERE mut > 0
  UNION SELECT session, 'change_evidence' FROM pg WHERE blind > 0 AND ev = 0 UNION SELECT session, 'workflow_first' FROM ch WHERE chains > 0
  UNION SELECT session, 'read_side_evidence' FROM pr WHERE NOT EXISTS (SELECT 1 FROM tl x WHERE x.session = pr.session AND x.path = pr.path AND x.tool IN ('get_symbols_overview', 'get_file_diagnostics', 'find_symbol'))),
pa AS (SELECT pg.session, 'planner' AS role, CASE WHEN count(*) FILTER (code = 'read_side_mutation_attempt') > 0 THEN 'fail' WHEN count(code) > 0 THEN 'warn' ELSE 'pass' END AS status,
  coalesce(string_agg(code, ',' ORDER BY code), '') AS findings FROM pg LEFT JOIN pf ON pf.session = pg.session WHERE began IS NOT NULL GROUP BY pg.session)"""


def _text(audit):
    return audit.withColumn("findings", F.array_join("findings", ","))


@register("session_audit", f"WITH {_TL}, {_BUILDER} SELECT * FROM ba")
def session_audit(spark, d):
    return _text(sessions.builder_audit(_timeline(spark, d)))


@register("planner_session_audit", f"WITH {_TL}, {_CHAINS}, {_PLANNER} SELECT * FROM pa")
def planner_session_audit(spark, d):
    return _text(sessions.planner_audit(_timeline(spark, d)))


def _audits(spark, d):
    t = _timeline(spark, d)
    return sessions.builder_audit(t).unionByName(sessions.planner_audit(t))


@register(
    "audit_pass_rate",
    f"WITH {_TL}, {_CHAINS}, {_BUILDER}, {_PLANNER}, a AS (SELECT * FROM ba UNION ALL SELECT * FROM pa) SELECT role, count(*) AS sessions, round(count(*) FILTER (status = 'pass') / count(*), 6) AS pass_rate FROM a GROUP BY 1",
)
def audit_pass_rate(spark, d):
    return sessions.pass_rates(_audits(spark, d))


@register(
    "audit_failing_codes",
    f"WITH {_TL}, {_CHAINS}, {_BUILDER}, {_PLANNER}, a AS (SELECT session, 'b' AS r, code FROM bf WHERE session IN (SELECT session FROM ba) UNION ALL SELECT session, 'p', code FROM pf WHERE session IN (SELECT session FROM pa)) SELECT code, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, code LIMIT 8",
)
def audit_failing_codes(spark, d):
    return sessions.failing_codes(_audits(spark, d))


_RECORDS = [
    "event_id AS id", f"CASE {_K} % 6 WHEN 0 THEN 'verifying' WHEN 1 THEN 'applied' WHEN 2 THEN 'no_op' WHEN 3 THEN 'rolled_back' WHEN 4 THEN 'failed' ELSE 'denied' END AS status",
    "CASE event_type WHEN 'view' THEN 'Applying' WHEN 'click' THEN 'Verifying' WHEN 'purchase' THEN 'Audited' END AS state_from",
    "CASE user_id % 5 WHEN 0 THEN 'Verifying' WHEN 1 THEN 'Audited' WHEN 2 THEN 'RolledBack' WHEN 3 THEN 'Failed' ELSE 'Denied' END AS state_to",
]


@register(
    "invalid_audit_records",
    f"""WITH r AS (SELECT {", ".join(_RECORDS)} FROM events) SELECT id FROM r WHERE NOT coalesce(CASE status WHEN 'verifying' THEN state_from IS NULL AND state_to = 'Verifying'
  WHEN 'applied' THEN state_from = 'Applying' AND state_to = 'Audited' WHEN 'no_op' THEN state_from = 'Applying' AND state_to = 'Audited' WHEN 'rolled_back' THEN state_from = 'Applying' AND state_to = 'RolledBack'
  WHEN 'failed' THEN (state_from IS NULL OR state_from IN ('Verifying', 'Applying')) AND state_to = 'Failed' ELSE (state_from IS NULL OR state_from = 'Verifying') AND state_to = 'Denied' END, false)""",
)
def invalid_audit_records(spark, d):
    return sessions.invalid_records(A.table(spark, d, "events").selectExpr(*_RECORDS)).select("id")


@register(
    "stale_analysis_jobs",
    """WITH j AS (SELECT user_id AS job, event_id AS seq, epoch_ms(ts) AS moment, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END AS state FROM events),
l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY job ORDER BY moment DESC, seq DESC) = 1)
SELECT job, CASE WHEN state IN ('queued', 'running') AND moment < 1706572800000 - 86400000 THEN 'error' ELSE state END AS state FROM l""",
)
def stale_analysis_jobs(spark, d):
    state = F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END")
    rows = A.table(spark, d, "events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), state.alias("state")
    )
    return sessions.stale_jobs(rows, 1706572800000, 86400000)


@register(
    "over_visible_tools",
    f"""WITH {_TL}, n AS (SELECT tool, count(DISTINCT path) AS n FROM tl GROUP BY 1), t AS (SELECT DISTINCT tool, CASE WHEN tool LIKE 'get%' THEN 1 ELSE 2 END AS allowed FROM tl UNION ALL SELECT DISTINCT p_type, 1 FROM part)
SELECT t.tool, CASE WHEN coalesce(n, 0) = 0 THEN 'unreachable' ELSE 'over_visible' END AS problem FROM t LEFT JOIN n USING (tool) WHERE coalesce(n, 0) = 0 OR n > allowed""",
)
def over_visible_tools(spark, d):
    """Paths stand in for surfaces; part types are tools that none shows."""
    t = _timeline(spark, d)
    shown = t.where("path IS NOT NULL").select(F.col("path").alias("surface"), "tool")
    tools = t.select("tool", F.when(F.col("tool").startswith("get"), 1).otherwise(2).alias("allowed")).distinct()
    foreign = A.table(spark, d, "part").select(F.col("p_type").alias("tool"), F.lit(1).alias("allowed")).distinct()
    return sessions.invisible(tools.unionByName(foreign), shown)

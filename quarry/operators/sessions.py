"""What sessions of tool calls were: ratios, types, chains and audits, from a timeline (session, seq, tool, path).

Every rule is a comparison of first and last calls per session, or per session and path, so that a timeline is
aggregated map-side and a long session is not ordered in one task.  Only chains look at neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Classes of tools.
MUTATIONS = (
    "rename_symbol", "replace_symbol_body", "replace_content", "replace_lines", "delete_lines", "insert_content", "insert_at_line",
    "create_text_file", "add_import", "refactor_extract_function", "refactor_inline_function", "refactor_move_to_file",
    "refactor_change_signature",
)
REVIEWS = (
    "get_changed_files", "get_impact_analysis", "diff_aware_references", "review_architecture", "analyze_change_impact",
    "audit_security_context", "cleanup_duplicate_logic", "impact_report", "verify_change_readiness",
)
EXPLORATIONS = (
    "explore_codebase", "trace_request_path", "onboard_project", "get_project_structure", "get_symbols_overview",
    "get_current_config", "activate_project",
)
REFACTORS = ("plan_safe_refactor", "safe_rename_report", "refactor_safety_report", "unresolved_reference_check", "find_scoped_references")
PREFLIGHTS = ("verify_change_readiness", "safe_rename_report", "unresolved_reference_check")
RENAME_PREFLIGHTS = ("safe_rename_report", "unresolved_reference_check")
BOOTSTRAP, OVERVIEW, DIAGNOSTICS, CHANGES, SEARCH, CLAIM, RENAME = (
    "prepare_harness_session", "get_symbols_overview", "get_file_diagnostics", "get_changed_files", "find_symbol", "claim_files", "rename_symbol"
)
WORKFLOWS = (
    "explore_codebase", "review_architecture", "cleanup_duplicate_logic", "review_changes", "diagnose_issues", "analyze_change_request",
    "verify_change_readiness", "impact_report", "refactor_safety_report", "diff_aware_references", "semantic_code_review",
    "module_boundary_report", "mermaid_module_graph", "onboard_project",
)
CHANGE_WORKFLOWS = ("review_changes", "impact_report", "semantic_code_review", "diff_aware_references", "verify_change_readiness", "refactor_safety_report")
PRIMITIVES = ("find_symbol", "get_symbols_overview", "get_file_diagnostics", "read_file", "search_for_pattern", "find_referencing_symbols")

#: ratio -> (numerator, denominator): sums of counters.
KPIS = {
    "composite_ratio": (("composite_calls",), ("total_calls",)),
    "surface_token_efficiency": (("total_tokens",), ("success_count",)),
    "handle_reuse_rate": (("handle_reuse_count",), ("handle_reads",)),
    "analysis_cache_hit_rate": (("analysis_cache_hit_count",), ("composite_calls",)),
    "quality_contract_present_rate": (("quality_contract_emitted_count",), ("composite_calls",)),
    "recommended_check_followthrough_rate": (("recommended_check_followthrough_count",), ("quality_contract_emitted_count",)),
    "quality_focus_reuse_rate": (("quality_focus_reuse_count",), ("handle_reuse_count",)),
    "performance_watchpoint_emit_rate": (("performance_watchpoint_emit_count",), ("quality_contract_emitted_count",)),
    "verifier_contract_present_rate": (("verifier_contract_emitted_count",), ("composite_calls",)),
    "blocker_emit_rate": (("blocker_emit_count",), ("verifier_contract_emitted_count",)),
    "verifier_followthrough_rate": (("verifier_followthrough_count",), ("verifier_contract_emitted_count",)),
    "coordination_overlap_rate": (("coordination_overlap_emit_count",), ("verifier_contract_emitted_count",)),
    "coordination_caution_rate": (("coordination_caution_emit_count",), ("verifier_contract_emitted_count",)),
    "coordination_release_ratio": (("coordination_release_count",), ("coordination_claim_count",)),
    "mutation_preflight_gate_deny_rate": (("mutation_preflight_gate_denied_count",), ("mutation_preflight_checked_count",)),
    "deferred_hidden_tool_call_deny_rate": (("deferred_hidden_tool_call_denied_count",), ("deferred_namespace_expansion_count",)),
    "truncation_followup_rate": (("truncation_followup_count",), ("truncated_response_count",)),
    "composite_guidance_followthrough_rate": (("composite_guidance_followed_count",), ("composite_guidance_emitted_count",)),
    "composite_guidance_miss_rate": (("composite_guidance_missed_count",), ("composite_guidance_emitted_count",)),
    "suggestion_acceptance_rate": (("suggestion_accepted_count",), ("suggestion_accepted_count", "suggestion_diverted_count")),
    "suggestion_resolution_rate": (
        ("suggestion_accepted_count", "suggestion_diverted_count"),
        ("suggestion_accepted_count", "suggestion_diverted_count", "suggestion_unresolved_count"),
    ),
    "suggestion_successful_outcome_rate": (("suggestion_outcome_success_count",), ("suggestion_accepted_count",)),
    "suggestion_value_rate": (("suggestion_outcome_success_count",), ("suggestion_accepted_count", "suggestion_diverted_count")),
    "analysis_job_success_rate": (("analysis_jobs_completed",), ("analysis_jobs_started",)),
    "watcher_lock_contention_rate": (("lock_contention_batches",), ("events_processed",)),
    "watcher_recent_failure_share": (("recent_failures",), ("total_failures",)),
}
COUNTERS = tuple(dict.fromkeys(c for pair in KPIS.values() for side in pair for c in side)) + ("low_level_calls", "repeated_low_level_chain_count")


def kpis(counters: DataFrame) -> DataFrame:
    """Guarded ratios of each session's counters: 0 without a denominator; a counter that is no column is 0."""

    def total(names: tuple[str, ...]) -> Column:
        return sum((F.coalesce(F.col(c), F.lit(0)) for c in names if c in counters.columns), F.lit(0)).cast("double")

    def ratio(up: tuple[str, ...], down: tuple[str, ...]) -> Column:
        return F.coalesce(total(up) / F.nullif(total(down), F.lit(0.0)), F.lit(0.0))

    chains = 1 - ratio(("repeated_low_level_chain_count",), ("low_level_calls",))
    rates = [F.round(ratio(*sides), 6).alias(name) for name, sides in KPIS.items()]
    return counters.select("session", *rates, F.round(chains, 6).alias("low_level_chain_reduction"))


def types(timeline: DataFrame) -> DataFrame:
    """(session, session_type) by how many calls of each class a session has."""
    n = lambda tools: F.count_if(F.col("tool").isin(*tools))
    g = timeline.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), n(MUTATIONS).alias("m"), n(REVIEWS).alias("v"), n(EXPLORATIONS).alias("e"), n(REFACTORS).alias("r")
    )
    label = (
        F.when((F.col("r") >= 2) | ((F.col("m") >= 1) & (F.col("r") >= 1)), "refactoring")
        .when(F.col("v") >= 2, "code_review")
        .when(F.col("m") >= 2, "code_modification")
        .when(F.col("e") >= 2, "onboarding")
        .when(F.col("n") < 5, "brief")
        .otherwise("mixed")
    )
    return g.select("session", label.alias("session_type"))


def chains(timeline: DataFrame) -> DataFrame:
    """(session, chains): calls that make three primitive ones in a row with the two before them."""
    by = Window.partitionBy("session").orderBy("seq")
    low = F.col("tool").isin(*PRIMITIVES)
    three = low & F.coalesce(F.lag(low, 1).over(by), F.lit(False)) & F.coalesce(F.lag(low, 2).over(by), F.lit(False))
    return timeline.withColumn("three", three).groupBy("session").agg(F.count_if("three").alias("chains"))


def _marks(timeline: DataFrame) -> DataFrame:
    """Per session and path the first and last calls that the audits compare."""
    first = lambda tools: F.min(F.when(F.col("tool").isin(*tools), F.col("seq")))
    last = lambda tools: F.max(F.when(F.col("tool").isin(*tools), F.col("seq")))
    return timeline.where("path IS NOT NULL").groupBy("session", "path").agg(
        first(MUTATIONS).alias("mutated"), last(MUTATIONS).alias("mutated_last"), first(PREFLIGHTS).alias("checked"),
        first((RENAME,)).alias("renamed"), first(RENAME_PREFLIGHTS).alias("rename_checked"), first((CLAIM,)).alias("claimed"),
        first((OVERVIEW,)).alias("seen"), first((DIAGNOSTICS,)).alias("diagnosed"), last((DIAGNOSTICS,)).alias("diagnosed_last"),
        first((SEARCH,)).alias("searched"), first(WORKFLOWS).alias("asked"), first((CHANGES,)).alias("changed"),
    )


def _late(done: str, before: str) -> Column:
    """Something was done to a path without the other call, or ahead of it."""
    return F.col(done).isNotNull() & (F.col(before).isNull() | (F.col(done) < F.col(before)))


def _findings(checks: dict[str, Column]) -> Column:
    rows = [F.struct(F.lit(code).alias("code"), status.alias("status")) for code, status in checks.items()]
    return F.array(*rows)


def _judged(rows: DataFrame, role: str, checks: dict[str, Column]) -> DataFrame:
    found = rows.select("session", _findings(checks).alias("checks"))
    bad = lambda s: F.exists("checks", lambda c: c["status"] == s)
    status = F.when(bad("fail"), "fail").when(bad("warn"), "warn").otherwise("pass")
    findings = F.transform(F.filter("checks", lambda c: c["status"].isin("warn", "fail")), lambda c: c["code"])
    return found.select("session", F.lit(role).alias("role"), status.alias("status"), F.array_sort(findings).alias("findings"))


def _ok(wrong: Column, otherwise: str = "warn") -> Column:
    return F.when(wrong, otherwise).otherwise("pass")


def builder_audit(timeline: DataFrame) -> DataFrame:
    """(session, role, status, findings) of sessions that changed something or checked before a change.

    Fails if a path was changed before any check of it, or renamed before one of its symbols; warns if the session
    was not set up first, or paths lack an overview, or diagnostics before the first or after the last change.
    """
    first = lambda tools: F.min(F.when(F.col("tool").isin(*tools), F.col("seq")))
    s = timeline.groupBy("session").agg(
        first((BOOTSTRAP,)).alias("set_up"), first(MUTATIONS + PREFLIGHTS + (CLAIM,)).alias("began"), first(MUTATIONS).alias("any_mutation")
    )
    touched = F.coalesce("mutated", "checked", "claimed").isNotNull()
    p = _marks(timeline).groupBy("session").agg(
        F.count_if(_late("mutated", "checked") | _late("renamed", "rename_checked")).alias("ungated"),
        F.count_if(touched & F.col("seen").isNull()).alias("unseen"),
        F.count_if(_late("mutated", "diagnosed")).alias("undiagnosed"),
        F.count_if(F.col("mutated").isNotNull() & (F.col("diagnosed_last").isNull() | (F.col("diagnosed_last") < F.col("mutated_last")))).alias("unverified"),
    )
    rows = s.where("began IS NOT NULL").join(p, "session", "left").na.fill(0, ["ungated", "unseen", "undiagnosed", "unverified"])
    return _judged(rows, "builder", {
        "bootstrap_order": _ok(F.col("set_up").isNull() | (F.col("set_up") > F.col("began"))),
        "mutation_gate": _ok(F.col("any_mutation").isNotNull() & (F.col("ungated") > 0), "fail"),
        "structure_evidence": _ok(F.col("unseen") > 0),
        "diagnostics_before_mutation": _ok(F.col("undiagnosed") > 0),
        "diagnostics_after_mutation": _ok(F.col("unverified") > 0),
    })


def planner_audit(timeline: DataFrame) -> DataFrame:
    """(session, role, status, findings) of sessions that ran read-side workflows.

    Fails if it changed something; warns if it was not set up first, ran workflows on changes without any evidence
    of what had changed, fell back to chains of primitive calls, or asked about paths that it never looked at.
    """
    first = lambda tools: F.min(F.when(F.col("tool").isin(*tools), F.col("seq")))
    s = timeline.groupBy("session").agg(
        first((BOOTSTRAP,)).alias("set_up"), first(WORKFLOWS).alias("began"), F.count_if(F.col("tool").isin(*MUTATIONS)).alias("mutations"),
        F.count_if((F.col("tool") == CHANGES) & F.col("path").isNotNull()).alias("evidence"),
        F.count_if(F.col("tool").isin(*CHANGE_WORKFLOWS) & F.col("path").isNull()).alias("blind"),
    )
    looked = F.coalesce("seen", "diagnosed", "searched").isNotNull()
    p = _marks(timeline).groupBy("session").agg(F.count_if((F.col("asked").isNotNull() | F.col("changed").isNotNull()) & ~looked).alias("unread"))
    rows = s.where("began IS NOT NULL").join(p, "session", "left").join(chains(timeline), "session").na.fill(0, ["unread"])
    return _judged(rows, "planner", {
        "bootstrap_order": _ok(F.col("set_up").isNull() | (F.col("set_up") > F.col("began"))),
        "read_side_mutation_attempt": _ok(F.col("mutations") > 0, "fail"),
        "change_evidence": _ok((F.col("blind") > 0) & (F.col("evidence") == 0)),
        "workflow_first": _ok(F.col("chains") > 0),
        "read_side_evidence": _ok(F.col("unread") > 0),
    })


def pass_rates(audits: DataFrame) -> DataFrame:
    """(role, sessions, pass_rate): of audits that passed, warned or failed; null without any."""
    judged = F.col("status").isin("pass", "warn", "fail")
    return audits.groupBy("role").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.count_if(F.col("status") == "pass") / F.nullif(F.count_if(judged), F.lit(0)), 6).alias("pass_rate"),
    )


def failing_codes(audits: DataFrame, most: int = 8) -> DataFrame:
    """(code, n): the findings that most audits have."""
    n = audits.select(F.explode("findings").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "code").limit(most)


# Status of an audit record -> states that it may come from (none as a dash) and the state that it leads to.
AUDIT_STEPS = {
    "verifying": (("-",), "Verifying"),
    "applied": (("Applying",), "Audited"),
    "no_op": (("Applying",), "Audited"),
    "rolled_back": (("Applying",), "RolledBack"),
    "failed": (("-", "Verifying", "Applying"), "Failed"),
    "denied": (("-", "Verifying"), "Denied"),
}


def invalid_records(records: DataFrame) -> DataFrame:
    """Audit records (status, state_from, state_to) whose step is not one of those allowed."""
    came = F.coalesce("state_from", F.lit("-"))
    ok = reduce(
        lambda acc, kv: acc | ((F.col("status") == kv[0]) & came.isin(*kv[1][0]) & (F.col("state_to") == kv[1][1])), AUDIT_STEPS.items(), F.lit(False)
    )
    return records.where(~F.coalesce(ok, F.lit(False)))


def stale_jobs(events: DataFrame, now: int, timeout: int) -> DataFrame:
    """(job, state): the last state of each job (job, at, seq, state); running ones without a sign of life in time are errors."""
    last = events.groupBy("job").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("at").alias("at"))
    lost = F.col("state").isin("queued", "running") & (F.col("at") < now - timeout)
    return last.select("job", F.when(lost, "error").otherwise(F.col("state")).alias("state"))


def invisible(tools: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(tool, problem): tools that too many surfaces show, or none (tools: tool, allowed; surfaces: surface, tool)."""
    n = surfaces.groupBy("tool").agg(F.countDistinct("surface").alias("n"))
    rows = tools.join(n, "tool", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.where((F.col("n") > F.col("allowed")) | (F.col("n") == 0)).select(
        "tool", F.when(F.col("n") == 0, "unreachable").otherwise("over_visible").alias("problem")
    )

"""Facades: a verb and a mode name a registered query."""

from __future__ import annotations

VERBS = {
    "search": {
        "symbol": "find_symbol_exact", "refs": "text_references", "defn": "index_definitions", "impl": "type_hierarchy",
        "scoped": "scoped_references", "workspace": "find_symbol_substring", "bm25": "bm25_symbol_search",
        "fuzzy": "hybrid_search", "semantic": "semantic_search", "ranked": "ranked_context_budget",
    },
    "graph": {
        "callers": "get_callers", "callees": "get_callees", "types": "type_hierarchy", "trace": "call_trace",
        "impact": "impact_report", "diff-refs": "diff_aware_references",
    },
    "review": {
        "architecture": "architecture_overview", "changes": "diff_symbols", "boundary": "boundary_report", "dead": "dead_code_report",
        "dupes": "duplicate_pairs_filtered", "similar": "similar_code", "misplaced": "misplaced_code",
    },
    "overview": {"file": "symbols_overview", "explore": "onboard_project", "classify": "classify_symbol"},
    "diagnose": {"file": "parse_symbols", "symbol": "safe_rename_report", "unresolved": "unresolved_references", "issues": "change_readiness"},
    "analyze": {"jobs": "analysis_jobs", "stale": "stale_analysis_jobs", "artifacts": "analysis_artifacts"},
}

#: Workflows: the queries that each is made of, in order.
WORKFLOWS = {
    "explore_codebase": ("onboard_project", "ranked_context_budget", "symbols_overview"),
    "trace_request_path": ("call_trace", "get_callers", "get_callees"),
    "review_architecture": ("architecture_overview", "boundary_report", "mermaid_module_graph", "import_cycles"),
    "plan_safe_refactor": ("refactor_safety_report", "safe_rename_report", "unresolved_references"),
    "review_changes": ("diff_symbols", "impact_report", "diff_aware_references"),
    "diagnose_issues": ("change_readiness", "unresolved_references", "missing_imports"),
    "cleanup_duplicate_logic": ("duplicate_pairs_filtered", "redundant_wrappers", "dead_code"),
    "analyze_change_request": ("analyze_change_request", "impact_report", "change_readiness"),
}


def workflow(name: str, spark, sf_dir: str) -> dict:
    """The DataFrames of a workflow, by query."""
    from quarry import registry

    if name not in WORKFLOWS:
        raise KeyError(f"no workflow {name}; there are {', '.join(WORKFLOWS)}")
    known = registry.queries()
    return {q: known[q](spark, sf_dir) for q in WORKFLOWS[name]}


def batch(requests: list[tuple[str, str]], spark, sf_dir: str, most: int = 20) -> list:
    """A DataFrame, or the error, for each (verb, mode) of a request; no more than ``most`` at once."""
    from quarry import registry

    if len(requests) > most:
        raise ValueError(f"more than {most} requests")
    out = []
    for verb, mode in requests:
        try:
            out.append(registry.queries()[resolve(verb, mode)](spark, sf_dir))
        except KeyError as e:
            out.append(e)
    return out


def resolve(verb: str, mode: str) -> str:
    """Name of the registered query."""
    if verb not in VERBS:
        raise KeyError(f"no verb {verb}; there are {', '.join(VERBS)}")
    if mode not in VERBS[verb]:
        raise KeyError(f"{verb} has no mode {mode}; there are {', '.join(VERBS[verb])}")
    return VERBS[verb][mode]

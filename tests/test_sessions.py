"""Session types, chains, audits and job states over hand-made timelines."""

from quarry.operators import sessions


def timeline(spark, **calls):
    rows = [(s, i, *(c.split("@") + [None])[:2]) for s, cs in calls.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "session string, seq long, tool string, path string")


def audits(df):
    return {r.session: (r.status, list(r.findings)) for r in df.collect()}


def test_types(spark):
    got = sessions.types(timeline(
        spark, a=["safe_rename_report", "rename_symbol"], b=["impact_report", "get_changed_files"], c=["replace_lines", "add_import"],
        d=["onboard_project", "explore_codebase"], e=["x"], f=["x"] * 5,
    ))
    assert {r.session: r.session_type for r in got.collect()} == {
        "a": "refactoring", "b": "code_review", "c": "code_modification", "d": "onboarding", "e": "brief", "f": "mixed",
    }


def test_chains_are_three_in_a_row(spark):
    got = sessions.chains(timeline(spark, a=["find_symbol"] * 4, b=["find_symbol", "x", "read_file", "read_file"]))
    assert {r.session: r.chains for r in got.collect()} == {"a": 2, "b": 0}


def test_builder_audit(spark):
    good = ["prepare_harness_session", "get_symbols_overview@f", "get_file_diagnostics@f", "verify_change_readiness@f", "replace_lines@f", "get_file_diagnostics@f"]
    df = timeline(
        spark, good=good, late=[*good, "replace_lines@f"], wild=["replace_lines@f", "verify_change_readiness@f"],
        rename=["prepare_harness_session", "get_symbols_overview@f", "get_file_diagnostics@f", "verify_change_readiness@f", "rename_symbol@f", "get_file_diagnostics@f"],
        none=["find_symbol@f"],
    )
    got = audits(sessions.builder_audit(df))
    assert got["good"] == ("pass", []) and got["late"] == ("warn", ["diagnostics_after_mutation"])
    assert got["wild"][0] == "fail" and "mutation_gate" in got["wild"][1] and got["rename"] == ("fail", ["mutation_gate"]) and "none" not in got


def test_planner_audit_and_rates(spark):
    df = timeline(
        spark, good=["prepare_harness_session", "get_symbols_overview@f", "get_changed_files@f", "review_changes@f"],
        blind=["prepare_harness_session", "review_changes"], broken=["review_changes@g", "add_import@g"], none=["find_symbol"],
    )
    planner = sessions.planner_audit(df)
    got = audits(planner)
    assert got["good"] == ("pass", []) and got["blind"] == ("warn", ["change_evidence"]) and "none" not in got
    assert got["broken"] == ("fail", ["bootstrap_order", "read_side_evidence", "read_side_mutation_attempt"])
    assert [tuple(r) for r in sessions.pass_rates(planner).collect()] == [("planner", 3, 0.333333)]
    assert [tuple(r) for r in sessions.failing_codes(planner, 2).collect()] == [("bootstrap_order", 1), ("change_evidence", 1)]


def test_kpis_guard_their_denominators(spark):
    df = spark.createDataFrame([("a", 3, 6, 0, 2, 1, 1)], "session string, composite_calls int, total_calls int, handle_reads int, suggestion_accepted_count int, suggestion_diverted_count int, suggestion_unresolved_count int")
    r = sessions.kpis(df).first()
    assert (r.composite_ratio, r.handle_reuse_rate, r.low_level_chain_reduction) == (0.5, 0.0, 1.0)
    assert (r.suggestion_acceptance_rate, r.suggestion_resolution_rate) == (0.666667, 0.75) and len(r) == len(sessions.KPIS) + 2


def test_audit_records_jobs_and_surfaces(spark):
    rows = [("verifying", None, "Verifying"), ("verifying", "Applying", "Verifying"), ("applied", "Applying", "Audited"), ("no_op", None, "Audited"),
            ("failed", None, "Failed"), ("denied", "Applying", "Denied"), ("other", None, "x"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, status string, state_from string, state_to string")
    assert sorted(r.id for r in sessions.invalid_records(df).collect()) == [1, 3, 5, 6, 7]
    jobs = spark.createDataFrame([("a", 1, 1, "running"), ("b", 90, 1, "running"), ("c", 1, 1, "completed")], "job string, at int, seq int, state string")
    assert {r.job: r.state for r in sessions.stale_jobs(jobs, 100, 50).collect()} == {"a": "error", "b": "running", "c": "completed"}
    tools = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2)], "tool string, allowed int")
    shown = spark.createDataFrame([("s", "x"), ("t", "x"), ("s", "z"), ("t", "z")], "surface string, tool string")
    assert {tuple(r) for r in sessions.invisible(tools, shown).collect()} == {("x", "over_visible"), ("y", "unreachable")}

"""Voting outcomes and run metrics on small recorded inputs."""

from pyspark.sql import functions as F

from arbiter.operators import runs as M
from arbiter.operators import voting as V


def outcome(spark, cands):
    """cands: list of (idx, errored, rows)."""
    c = spark.createDataFrame([(0, i, e) for i, e, _ in cands], "question_id long, idx int, errored boolean")
    rows = [(0, i, p, v) for i, e, rs in cands if not e for p, v in enumerate(rs)]
    r = spark.createDataFrame(rows or [(0, 99, 0, 0)], "question_id long, idx int, row_pos long, v long")
    if not rows:
        r = r.filter("false")
    return V.majority_vote(V.candidate_fingerprints(r, c, ["v"])).collect()[0].asDict()


def test_unanimous(spark):
    o = outcome(spark, [(0, False, [1]), (1, False, [1]), (2, False, [1])])
    assert (o["selected_index"], o["agreement"], o["n_groups"], o["tie"]) == (0, 3, 1, False)


def test_two_of_three(spark):
    o = outcome(spark, [(0, False, [2]), (1, False, [1]), (2, False, [1])])
    assert (o["selected_index"], o["agreement"], o["n_groups"]) == (1, 2, 2)


def test_all_different_tie_goes_to_earliest(spark):
    o = outcome(spark, [(0, False, [3]), (1, False, [1]), (2, False, [2])])
    assert (o["selected_index"], o["tie"]) == (0, True)


def test_all_errored(spark):
    o = outcome(spark, [(0, True, []), (1, True, [])])
    assert (o["selected_index"], o["agreement"], o["n_votable"]) == (0, 0, 0)


def test_empty_result_is_votable(spark):
    o = outcome(spark, [(0, True, []), (1, False, []), (2, False, [])])
    assert (o["selected_index"], o["agreement"], o["n_votable"]) == (1, 2, 2)


def test_order_never_matters_in_a_vote(spark):
    o = outcome(spark, [(0, False, [1, 2]), (1, False, [2, 1])])
    assert o["n_groups"] == 1


RUNS = "case_id long, model string, attempts long, guard_rejected boolean, error string, matches_gold boolean, " \
       "input_tokens long, output_tokens long, latency_ms double, provider_cost_usd double"


def runs(spark):
    rows = [
        (1, "x/claude-haiku-4-5", 1, False, None, True, 100, 10, 10.0, None),
        (2, "x/claude-haiku-4-5", 2, False, None, True, 101, 11, 20.0, None),
        (3, "x/claude-haiku-4-5", 1, True, None, True, 0, 0, 5.0, None),
        (4, "unknown", 3, False, "no such table: t", None, 9, 9, 1.0, 0.5),
        (5, "unknown", 1, False, "boom", None, 9, 9, 1.0, None),
        (6, "unknown", 1, False, None, False, 9, 9, 1.0, None),
    ]
    return M.case_results(spark.createDataFrame(rows, RUNS))


def test_terminal_states(spark):
    got = {r["case_id"]: r["terminal_state"] for r in runs(spark).collect()}
    assert got == {1: "success", 2: "success", 3: "guardrail_rejected", 4: "retry_exhausted",
                   5: "execution_error_final", 6: "wrong_answer"}


def test_derive_pass1_and_twin(spark):
    r = runs(spark)
    d = {x["case_id"]: x for x in M.derive_pass1(r).collect()}
    assert d[2]["correct"] is False and d[2]["terminal_state"] == "execution_error_final"
    assert d[2]["input_tokens"] == 50 and d[2]["latency_ms"] == 10.0
    t = M.twin_report(M.derive_pass1(r), r, "claude-haiku-4-5").collect()[0]
    assert t["n_correct_1"] == 1 and t["n_correct_k"] == 2 and abs(t["recovery_rate"] - 0.2) < 1e-12


def test_unknown_model_cost_is_null(spark):
    r = runs(spark).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    got = {x["model"]: x["list_cost_usd"] for x in M.list_cost(r, M.prices_frame(spark)).collect()}
    assert got["unknown"] is None and abs(got["x/claude-haiku-4-5"] - (201 * 1.0 + 21 * 5.0) / 1e6) < 1e-15


def test_terminal_counts_zero_filled(spark):
    got = {r["terminal_state"]: r["n"] for r in M.terminal_counts(runs(spark)).collect()}
    assert len(got) == 6 and got["retrieval_empty"] == 0


def test_empty_batch_accuracy_zero(spark):
    empty = runs(spark).filter("false")
    m = M.batch_metrics(empty).collect()[0]
    assert m["total"] == 0 and m["accuracy"] == 0.0


def test_a_forced_collision_is_separated(spark):
    """Every candidate gets one fingerprint; classes must still come out as the rows say."""
    results = {0: [1, 1, 2], 1: [2, 1, 1], 2: [1, 2, 2], 3: [1], 4: [], 5: [2, 2, 1], 6: [None, 1, 2], 7: []}
    rows = spark.createDataFrame([(0, i, p, v) for i, vs in results.items() for p, v in enumerate(vs)], "question_id long, idx int, row_pos long, v long")
    same = spark.createDataFrame([(0, i, False, "x") for i in results] + [(0, 8, True, "x"), (1, 0, False, "x")], "question_id long, idx int, errored boolean, fp string")
    got = {}
    for r in V.exact_classes(rows, same, ["v"]).where("question_id = 0 and not errored").collect():
        got.setdefault(r.fp, set()).add(r.idx)
    assert sorted(map(sorted, got.values())) == [[0, 1], [2, 5], [3], [4, 7], [6]]
    o = V.majority_vote(V.exact_classes(rows, same, ["v"])).where("question_id = 0").first()
    assert (o.selected_index, o.agreement, o.n_groups, o.tie, o.n_votable) == (0, 2, 5, True, 8)


def test_exact_classes_change_nothing_without_collisions(spark):
    rows = spark.createDataFrame([(q, i, 0, q + i // 2) for q in range(5) for i in range(4)], "question_id long, idx int, row_pos long, v long")
    cands = spark.createDataFrame([(q, i, False) for q in range(5) for i in range(4)], "question_id long, idx int, errored boolean")
    fps = V.candidate_fingerprints(rows, cands, ["v"])
    assert sorted(V.exact_classes(rows, fps, ["v"]).collect()) == sorted(fps.collect())

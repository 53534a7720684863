"""The held-out report counts rows by group and by posterior instead of writing every decision of every row."""

from assay import session
from assay.operators import resample as rs, selection
from assay.plans.reports import held_out_report


def test_nothing_written_grows_with_rows_of_equal_groups(spark, monkeypatch):
    """20 groups of 30 rows; before, four decisions of each row were written."""
    rows = [(m, f"{g}-{i}", f"p{g}", g % 2, [0.55, 0.45] if (g + i + len(m)) % 3 else [0.3, 0.7]) for m in ("a", "bb") for g in range(20) for i in range(30)]
    d = spark.createDataFrame(rows, "method string, path string, patient_id string, y_true int, p array<double>")
    written, real = {}, session.write_and_read

    def spy(df, name):
        out = real(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(session, "write_and_read", spy)
    t = held_out_report(d, [0.5, 0.4], 2, 0, n_rep=60)
    assert max(written.values()) <= 2 * 20 < len(rows) // 20
    # intervals and scores as from the decisions of the rows themselves
    rules = selection.decision_rules(d, [0.5, 0.4], 2, 0, 1.0, ("patient_id", "y_true"))
    of_rows = rules.where("rule = 'threshold'").withColumnRenamed("decision", "y_pred")
    want = {r["method"]: r for r in rs.cluster_bootstrap_accuracy(of_rows, ["a", "bb"], 60, 42).collect()}
    got = {r["method"]: r for r in t["intervals"].where("level = 'slice'").collect()}
    assert all(got[m][c] == want[m][c] for m in want for c in ("mean", "lo", "hi", "n_units")) and len(got) == 2
    hits = {(r["method"], r["rule"]): r[2] for r in rules.selectExpr("method", "rule", "cast(decision = y_true as int) as ok").groupBy("method", "rule").avg("ok").collect()}
    assert all(abs(r["accuracy"] - hits[r["method"], r["rule"]]) < 1e-12 for r in t["rules"].where("level = 'slice'").collect())


def test_values_that_miss_in_a_posterior_are_left_out_of_means(spark):
    rows = [("a", "x", "g", 1, [None, 0.9]), ("a", "y", "g", 1, [0.2, 0.7]), ("a", "z", "g", 0, [0.9, 0.1])]
    d = spark.createDataFrame(rows, "method string, path string, patient_id string, y_true int, p array<double>")
    r = held_out_report(d, [0.5, 0.5], 2, 0, n_rep=50)["rules"].where("level = 'group' and rule = 'argmax'").first()
    assert (r["n"], r["accuracy"]) == (1, 1.0)  # means 0.55 and 0.5666...

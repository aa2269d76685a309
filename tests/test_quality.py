import pytest
from pyspark.sql import functions as F

from strata.operators.quality import ExpectationFailed, assert_no_failures, check, expectation_metrics

RULES = {
    "positive": {"expr": "amount >= 0", "action": "drop"},
    "known": {"expr": "customer_id IS NOT NULL", "action": "warn"},
    "sane": {"expr": "amount < 1000", "action": "fail"},
}


def _df(spark):
    rows = [(1, 10, 5.0), (2, None, -1.0), (3, 7, None), (4, 8, 20.0)]
    return spark.createDataFrame(rows, "id int, customer_id int, amount double")


def test_null_counts_as_violated_and_drop_applies(spark):
    c = check(_df(spark), RULES, "t", observe=True)
    kept = sorted(r.id for r in c.df.collect())
    assert kept == [1, 4]  # -1 fails, NULL amount fails
    m = c.metrics()
    assert m["positive"] == {"action": "drop", "failed": 2, "passed": 2}
    assert m["known"]["failed"] == 1  # warn: counted, rows kept where drop allows
    assert m["sane"]["failed"] == 1  # NULL amount violates the fail rule too
    with pytest.raises(ExpectationFailed):
        c.raise_on_fail()


def test_metrics_frame(spark):
    got = {r.rule: (r.action, r.passed, r.failed) for r in expectation_metrics(_df(spark), RULES).collect()}
    assert got == {"positive": ("drop", 2, 2), "known": ("warn", 3, 1), "sane": ("fail", 3, 1)}


def test_assert_no_failures(spark):
    ok = _df(spark).where(F.col("amount").isNotNull())
    assert_no_failures(ok, RULES)
    with pytest.raises(ExpectationFailed, match="sane"):
        assert_no_failures(_df(spark), RULES)

"""Row statistics, sampling, eval gate and the threshold verdicts."""
import pytest
from pyspark.sql import functions as F

from corpusgate.operators import profile as P
from corpusgate.operators.verdict import source_stat_verdicts

LONG = "x" * 300


def stats_of(spark, texts, seq=1024, exact=False):
    df = spark.createDataFrame([("s", t) for t in texts], "source string, text string")
    return P.row_stats(df, ["source"], sequence_length=seq, exact=exact).collect()[0].asDict()


def test_row_stats_golden(spark):
    s = stats_of(spark, ["a" * 5000, "b" * 300, "", ""])
    assert s["rows"] == 4
    assert s["short_share"] == 0.5
    assert s["long_share"] == 0.25
    assert s["dup_share"] == 0.0
    assert s["median_chars"] == 150


def test_median_is_truncated_and_null_is_empty(spark):
    assert stats_of(spark, ["abc", "abcd"])["median_chars"] == 3  # 3.5 → 3
    assert stats_of(spark, [None, "a" * 10])["median_chars"] == 5


def test_repeated_rows(spark):
    s = stats_of(spark, [LONG] * 50)
    assert s["dup_share"] == pytest.approx(0.98)


@pytest.mark.parametrize("exact", [False, True])
def test_hashed_and_exact_prefix_keys_agree(spark, exact):
    texts = [f"{i % 7:05d} {LONG}" for i in range(40)] + ["short"]
    s = stats_of(spark, texts, exact=exact)
    assert s["dup_share"] == pytest.approx(1 - 7 / 40)
    assert s["short_share"] == pytest.approx(1 - 40 / 41)


def test_no_usable_rows_has_zero_dup_share(spark):
    assert stats_of(spark, ["a", "b"])["dup_share"] == 0.0


def verdicts(spark, texts):
    df = spark.createDataFrame([("s", t) for t in texts], "source string, text string")
    st = P.row_stats(df, ["source"])
    return [(r.level, r.message) for r in
            source_stat_verdicts(st, ["source"], F.col("source"), F.lit("contents")).orderBy("ord").collect()]


def test_good_rows_are_ok(spark):
    out = verdicts(spark, [f"{i:05d} {LONG}" for i in range(50)])
    assert out == [("ok", "streams, and 'contents' is usable text (50 rows sampled)")]


def test_mostly_short_rows_fail(spark):
    out = verdicts(spark, [f"short {i}" for i in range(50)])
    assert out[0][0] == "error" and "under 200 characters" in out[0][1]
    assert out[0][1].startswith("100% of sampled rows")
    assert all(level != "ok" for level, _ in out)


def test_repeated_rows_fail(spark):
    out = verdicts(spark, [LONG] * 50)
    assert ("error", "98% of sampled rows share their first 200 characters with another row; "
                     "the eval would measure memorising a few documents") in out


def test_some_short_rows_only_warn(spark):
    out = verdicts(spark, [f"{i:05d} {LONG}" for i in range(40)] + ["x"] * 10)
    assert out[0] == ("warning", "20% of sampled rows are under 200 characters and would be dropped from evaluation")
    assert out[-1][0] == "ok"


def test_percent_rounds_half_to_even(spark):
    # 1/8 = 12.5% → "12%" as Python formats it
    out = verdicts(spark, [f"{i:05d} {LONG}" for i in range(7)] + ["x"])
    assert out[0][1].startswith("12% of sampled rows")


def test_first_n_and_eval_gate(spark):
    rows = [(i, "a" if i % 2 else "b", (LONG if i % 3 else "y" * 300)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    first = P.first_n(df, ["source"], ["id"], 3).collect()
    assert sorted(r.id for r in first) == [0, 1, 2, 3, 4, 5]
    kept = P.eval_gate(df, ["source"], "text", ["id"]).collect()
    # per source: one row per distinct prefix, the lowest id
    assert sorted((r.source, r.id) for r in kept) == [("a", 1), ("a", 3), ("b", 0), ("b", 2)]


def test_window_estimate(spark):
    df = spark.createDataFrame([("s", "a" * 4096), ("s", "a" * 4097), ("s", "")], "k string, text string")
    r = P.window_estimate(df, ["k"], sequence_length=1024).collect()[0]
    assert (r.rows, r.windows, r.over_window_rows) == (3, 3, 1)
    assert r.approx_tokens == pytest.approx((4096 + 4097) / 4)


def test_approximate_row_stats_are_close(spark):
    texts = [f"{i % 50:05d} {LONG}" for i in range(400)] + ["short"] * 40
    df = spark.createDataFrame([("s", t) for t in texts], "source string, text string")
    exact = P.row_stats(df, ["source"]).collect()[0]
    approx = P.row_stats_approx(df, ["source"]).collect()[0]
    assert approx.rows == exact.rows and approx.short_share == exact.short_share
    assert abs(approx.dup_share - exact.dup_share) < 0.02
    assert abs(approx.median_chars - exact.median_chars) <= 1

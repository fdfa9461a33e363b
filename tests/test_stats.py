"""Statistics, chart data and reports."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from clicktrail.operators import (
    click_order_distribution,
    domain_share,
    facet_counts,
    first_n,
    in_window,
    rank_distribution,
    summary_report,
    top_domains,
    top_n_with_other,
    top_queries,
    total_searches,
    user_frequency,
    with_share,
)
from clicktrail.plans import preview, traffic_report, write_report

START, END = "06:00:00", "20:00:00"


@pytest.fixture(scope="module")
def win(logs):
    return in_window(logs, START, END)


@pytest.fixture(scope="module")
def rows(logs_list):
    return [r for r in logs_list if START <= r.access_time <= END]


def ordered(counts):
    return sorted(counts.items(), key=lambda item: (-item[1], item[0]))


def test_window(win, rows):
    assert sorted(win.collect()) == sorted(rows)
    plan = win._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ms" in plan.split("PushedFilters")[1]


def test_window_is_strict_and_knows_midnight(spark, logs):
    times = ["24:00:00", "00:00:00", "0:00:00", "25:00:00", "01:00:00", "1:00:00", "00:60:00"]
    ms = [86_400_000, 0, 0, 90_000_000, 3_600_000, 3_600_000, 3_600_000]
    df = spark.createDataFrame(list(zip(times, ms)), "access_time string, ts_ms bigint")

    def found(start, end):
        by_ms = {r.access_time for r in in_window(df, start, end).collect()}
        assert {r.access_time for r in in_window(df.drop("ts_ms"), start, end).collect()} == by_ms
        return by_ms

    assert found("00:00:00", "23:59:59") == {"24:00:00", "00:00:00", "01:00:00"}
    assert found("00:30:00", "23:59:59") == {"01:00:00"}
    assert found("24:00:00", "00:00:00") == {"24:00:00", "00:00:00"}
    assert found("0:00:00", "23:59:59") == found("00:00:00", "25:00:00") == set()


def test_counts_per_key(win, rows):
    assert total_searches(win).first()[0] == len(rows)
    for statistic, key in ((top_queries, "query"), (top_domains, "domain"), (user_frequency, "user_id")):
        counts = ordered(Counter(r[key] for r in rows))
        assert [tuple(r) for r in statistic(win, 5).collect()] == counts[:5]
        assert [tuple(r) for r in statistic(win).collect()] == counts[:20]
        whole = statistic(win, 10**6).collect()
        assert sum(r[1] for r in whole) == len(rows)


def test_distributions(win, rows):
    ranks = sorted(Counter(r["rank"] for r in rows).items())
    assert [tuple(r) for r in rank_distribution(win).collect()] == ranks
    assert [tuple(r) for r in rank_distribution(win, 10).collect()] == [(k, n) for k, n in ranks if k <= 10]
    clicks = sorted(Counter(r.click_order for r in rows).items())
    assert [tuple(r) for r in click_order_distribution(win).collect()] == clicks
    assert [tuple(r) for r in first_n(rank_distribution(win), "rank", 3).collect()] == ranks[:3]


def test_rank_distribution_has_no_lower_bound(spark):
    df = spark.createDataFrame([(-3,), (0,), (10,), (11,)], "rank int")
    assert [r["rank"] for r in rank_distribution(df, 10).collect()] == [-3, 0, 10]


@pytest.mark.parametrize(("part", "whole", "percent"), [(1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (1, 1, 100.0)])
def test_share_is_rounded_half_up(spark, part, whole, percent):
    df = spark.range(whole).select(F.when(F.col("id") < part, "a").otherwise("b").alias("domain"))
    shares = {r.domain: r.percentage for r in domain_share(df).collect()}
    assert shares["a"] == percent


def test_summary(win, rows):
    expected = (START, END, len(rows), *(len({r[c] for r in rows}) for c in ("user_id", "query", "domain")))
    assert tuple(summary_report(win, START, END).first()) == expected
    estimate = tuple(summary_report(win, START, END, approx=True).first())
    assert estimate[:3] == expected[:3]
    assert all(abs(a - b) <= 0.15 * b for a, b in zip(estimate[3:], expected[3:]))


def test_summary_of_an_empty_window(logs):
    nothing = in_window(logs, "x", "y")
    assert tuple(summary_report(nothing, "x", "y").first()) == ("x", "y", 0, 0, 0, 0)
    assert domain_share(nothing).count() == 0
    assert total_searches(nothing).first()[0] == 0


def test_missing_values_are_no_distinct_values(spark):
    df = spark.createDataFrame([("u", None, ""), ("u", None, "d"), (None, "q", "")], "user_id string, query string, domain string")
    assert tuple(summary_report(df, "a", "b").first()) == ("a", "b", 3, 1, 1, 2)


def test_facets_are_counted_in_one_shuffle(win, rows):
    counts = facet_counts(win)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    got = {(r.facet, r[r.facet]): r.n for r in counts.collect()}
    assert got == Counter((f, r[f]) for r in rows for f in ("query", "domain", "user_id", "rank", "click_order"))


def test_a_hot_value_is_combined_before_the_shuffle(spark):
    df = spark.range(0, 90_000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("query"))
    top = top_queries(df, 2)
    assert [tuple(r) for r in top.collect()] == [("hot", 30_000), ("1", 1)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "TakeOrderedAndProject" in plan


# --- Chart data --------------------------------------------------------------------------------


def counted(spark, counts):
    return spark.createDataFrame([(f"k{i:03d}", n) for i, n in enumerate(counts)], "key string, n bigint")


def chart(df, **options):
    return {(r.key, r.is_other): r.n for r in top_n_with_other(df, "key", "n", **options).collect()}


def test_other_sums_the_rows_up_to_the_cap(spark):
    df = counted(spark, range(200, 0, -1))
    top = {(f"k{i:03d}", False): 200 - i for i in range(8)}
    assert chart(df) == top | {("其他", True): sum(range(1, 193))}
    assert chart(df, cap=100) == top | {("其他", True): sum(range(101, 193))}
    assert chart(df, n=2, cap=100, other="rest") == {("k000", False): 200, ("k001", False): 199, ("rest", True): sum(range(101, 199))}


def test_other_is_left_out_when_nothing_remains(spark):
    assert len(chart(counted(spark, [5] * 8))) == 8
    assert ("其他", True) not in chart(counted(spark, [5] * 8 + [0, 0]))
    assert chart(counted(spark, [])) == {}
    assert chart(counted(spark, [5] * 8 + [1])) == {(f"k{i:03d}", False): 5 for i in range(8)} | {("其他", True): 1}


def test_a_key_named_like_the_rest_stays_apart(spark):
    df = spark.createDataFrame([("其他", 50)] + [(f"k{i}", 9 - i) for i in range(9)], "key string, n bigint")
    shown = chart(df)
    assert shown["其他", False] == 50 and shown["其他", True] == 2 + 1


def test_shares_of_a_chart_add_up(spark):
    shared = with_share(top_n_with_other(counted(spark, range(20, 0, -1)), "key", "n"), "n").collect()
    assert sum(r.share for r in shared) == pytest.approx(1)
    assert {r.key: r.share for r in shared}["k000"] == 20 / sum(range(21))


# --- Reports -----------------------------------------------------------------------------------


def test_report_parts_equal_the_single_statistics(logs, win, rows):
    with traffic_report(logs, START, END, k=15) as report:
        assert [tuple(r) for r in report["query_statistics"].collect()] == [tuple(r) for r in top_queries(win, 15).collect()]
        assert report["domain_statistics"].collect() == top_domains(win, 15).collect()
        assert report["user_frequency"].collect() == user_frequency(win, 15).collect()
        assert report["rank_statistics"].collect() == rank_distribution(win).collect()
        assert report["top10_rank_statistics"].collect() == rank_distribution(win, 10).collect()
        assert report["click_order_statistics"].collect() == click_order_distribution(win).collect()
        assert report["domain_distribution"].collect() == domain_share(win, 15).collect()
        assert report["summary_report"].collect() == summary_report(win, START, END).collect()
        assert report["total_searches"].first()[0] == len(rows)
        for name, part in report.items():
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert "InMemoryRelation" in plan, name


def test_a_report_keeps_little_and_frees_it(spark, logs):
    many = spark.range(20_000).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in logs.schema.fields if f.name not in ("user_id", "access_time", "ts_ms", "rank")), F.concat(F.lit("u"), "id").alias("user_id"), F.lit("10:00:00").alias("access_time"), F.lit(36_000_000).cast("bigint").alias("ts_ms"), (F.col("id") % 7).cast("int").alias("rank"))
    with traffic_report(many, START, END, k=15) as report:
        assert report["summary_report"].first()["unique_users"] == 20_000
        assert report._kept.count() < 100
    single = traffic_report(logs, START, END, keep=False)
    assert single["user_frequency"].count() > 0
    assert not single._kept.is_cached
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_report_files(spark, logs, win, tmp_path):
    with traffic_report(logs, START, END, k=15) as report:
        folder = write_report(report, str(tmp_path), "20260101_000000")
    assert folder == f"{tmp_path}/20260101_000000"
    names = {p.name for p in (tmp_path / "20260101_000000").iterdir()}
    assert names == {
        "query_statistics",
        "domain_statistics",
        "user_frequency",
        "rank_statistics",
        "click_order_statistics",
        "domain_distribution",
        "summary_report",
    }
    for name in names:
        assert len(list((tmp_path / "20260101_000000" / name).glob("part-*.csv"))) == 1, name
    lines = [r.value for r in spark.read.text(f"{folder}/query_statistics").collect()]
    assert lines == [f"{r.query},{r.search_count}" for r in top_queries(win, 15).collect()]
    ranks = [r.value for r in spark.read.text(f"{folder}/rank_statistics").collect()]
    assert ranks == [f"{r['rank']},{r.visit_count}" for r in rank_distribution(win).collect()]


def test_report_folder_is_named_by_time(logs, tmp_path):
    with traffic_report(logs) as report:
        folder = write_report({"summary_report": report["summary_report"]}, str(tmp_path))
    name = folder.rsplit("/", 1)[1]
    assert len(name) == 15 and name[8] == "_" and name.replace("_", "").isdigit()


def test_report_of_an_empty_window(logs):
    with traffic_report(logs, "09:00:00", "08:00:00") as report:
        assert tuple(report["summary_report"].first()) == ("09:00:00", "08:00:00", 0, 0, 0, 0)
        assert report["domain_distribution"].count() == 0


def test_preview(win, capsys):
    preview(win.select("user_id").orderBy("row_key"), 3)
    assert capsys.readouterr().out.count("user") == 4

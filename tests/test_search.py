"""Conditions, searches, lookups by key and saved results."""

import math
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktrail import SearchCondition
from clicktrail.functions import row_key
from clicktrail.operators import (
    get_by_key,
    get_by_keys,
    hits,
    page,
    page_after,
    page_info,
    scan_time_range,
    search,
    search_by_key_parts,
    search_count,
    search_summary,
    to_result,
)
from clicktrail.plans import load_result, save_result, search_saved

C = SearchCondition


@pytest.mark.parametrize(
    ("text", "condition"),
    [
        ("", C()),
        (None, C()),
        ("  ", C()),
        ("nonsense + more", C()),
        ("rank:5", C(rank=(5, 5))),
        ("rank: 1 - 10 ", C(rank=(1, 10))),
        ("rank:5-", C()),
        ("rank:5-x", C()),
        ("rank:-5", C()),
        ("rank:x", C()),
        ("rank:1-2-3", C()),
        ("rank:99999999999", C()),
        ("rank:1-9 + rank:5-x", C(rank=(5, 9))),
        ("click:1-3", C(click=(1, 3))),
        ("user:ann|bob + rank:3-17", C(users=["ann", "bob"], rank=(3, 17))),
        ("user:a | b", C(users=["a ", " b"])),
        ("user:a|b||", C(users=["a", "b"])),
        ("user:|a", C(users=["", "a"])),
        ("query:", C(query=[""])),
        ("user:", C(users=[""])),
        ("user:|", C()),
        ("Time:00:00:00|01:00:00", C()),
        ("user :a", C()),
        ("time:00:00:00", C()),
        ("time:00:00:00|01:00:00|02:00:00", C()),
        ("time: 00:00:00 | 01:00:00 ", C(time=("00:00:00", "01:00:00"))),
        ("time:25:00:00|26:00:00", C(time=("01:00:00", "02:00:00"))),
        ("user:a + user:b", C(users=["b"])),
        ("user:a+query:b+domain:c+url:http://d", C(users=["a"], query=["b"], domain=["c"], url=["http://d"])),
    ],
)
def test_parse(text, condition):
    assert C.parse(text) == condition


@pytest.mark.parametrize("text", ["time:xx:00:00|01:00:00", "time:1:2|3:4:5"])
def test_parse_refuses_wrong_times(text):
    with pytest.raises(ValueError):
        C.parse(text)


def test_condition_takes_lists():
    with pytest.raises(TypeError):
        C(users="user1")


def test_key_is_canonical():
    text = "click:1-1 + rank:2 + url:u + domain:d1|d2 + query:q + user:a|b + time:25:00:00|02:00:00"
    key = "time:01:00:00|02:00:00+user:a|b+query:q+domain:d1|d2+url:u+rank:2-2+click:1-1"
    assert C.parse(text).key() == key
    assert C.parse(key).key() == key
    assert C().key() == ""


def test_identity_tells_conditions_apart():
    assert C(query=["click|view"]).key() == C(query=["click", "view"]).key()
    assert C(query=["click|view"]).identity() != C(query=["click", "view"]).identity()
    assert C(users=["a", ""]).identity() != C(users=["a"]).identity()
    assert C(query=["c++"]).identity() != C(query=["c"]).identity()
    assert C.parse("rank:1-5+query:x").identity() == C(query=["x"], rank=(1, 5)).identity()


def matches(c, row, mode="substring"):
    """The condition tested on one row, in Python."""

    def holds(keywords, cell):
        return any(k.lower() in cell.lower() if mode == "substring" else k in cell for k in keywords)

    return (
        (c.time is None or c.time[0] <= row.access_time <= c.time[1])
        and (c.users is None or row.user_id in c.users)
        and (c.query is None or holds(c.query, row.query))
        and (c.domain is None or holds(c.domain, row.domain))
        and (c.url is None or holds(c.url, row.url))
        and (c.rank is None or c.rank[0] <= row["rank"] <= c.rank[1])
        and (c.click is None or c.click[0] <= row.click_order <= c.click[1])
    )


def keyword(*words):
    return st.none() | st.lists(st.sampled_from(words), min_size=1, max_size=2)


def bounds(top):
    return st.none() | st.tuples(st.integers(0, top), st.integers(0, top))


clock = st.builds("{:02d}:{:02d}:{:02d}".format, st.integers(0, 23), st.integers(0, 59), st.integers(0, 59))
CONDITIONS = st.builds(
    C,
    time=st.none() | st.tuples(clock, clock),
    users=keyword("user1", "user5", "user9", "USER1"),
    query=keyword("click", "VIEW", "Sign", "[", ""),
    domain=keyword("th", "FARM", "x"),
    url=keyword("ref", "/FR/", "#top"),
    rank=bounds(16),
    click=bounds(8),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(CONDITIONS, st.sampled_from(["substring", "like"]))
def test_hits_equal_a_test_row_by_row(logs, logs_list, condition, mode):
    assert sorted(hits(logs, condition, mode).collect()) == sorted(r for r in logs_list if matches(condition, r, mode))


def test_like_patterns_and_quotes_are_data(spark, logs):
    assert hits(logs, C(query=["c_ick"]), "like").count() == hits(logs, C(query=["click"]), "like").count() > 0
    assert hits(logs, C(query=["%"]), "like").count() == logs.count()
    assert hits(logs, C(query=["%"])).count() == 0
    assert hits(logs, C(query=["' OR 1=1 --"], users=["o'x"]), "like").count() == 0


def test_like_takes_backslashes_as_they_are(spark, logs):
    urls = ["x/a\\b", "a\\", "a", "50%", "5_0", "a\\%b"]
    rows = logs.limit(1).drop("url").join(spark.createDataFrame([(u,) for u in urls], "url string"))

    def found(keyword):
        return sorted(r.url for r in hits(rows, C(url=[keyword]), "like").collect())

    assert found("a\\b") == ["x/a\\b"]
    assert found("a\\") == sorted(["x/a\\b", "a\\", "a\\%b"])
    assert found("\\%b") == sorted(["x/a\\b", "a\\%b"])
    assert found("5_") == sorted(["50%", "5_0"])
    assert found("%") == sorted(urls)


def test_empty_keyword_and_empty_user(logs):
    assert hits(logs, "query:").count() == logs.count()
    assert hits(logs, "user:").count() == 0
    assert hits(logs).count() == logs.count()


def test_search_is_cut_in_key_order(logs, logs_list):
    keys = sorted(r.row_key for r in logs_list)
    assert [r.row_key for r in search(logs).collect()] == keys[:100]
    assert [r.row_key for r in search(logs, limit=7).collect()] == keys[:7]
    assert search(logs, limit=None).count() == len(keys)


def test_missing_cells_show_as_empty(spark, logs):
    row = spark.createDataFrame([(None,) * 10], logs.schema)
    assert tuple(to_result(row).first()) == ("", "", "", "", 0, 0, "", "")
    assert to_result(row, with_key=False).columns == ["accessTime", "userId", "query", "rank", "clickOrder", "url", "domain"]
    assert hits(row, "rank:0-99").count() == 0


def test_count_and_summary(logs, logs_list):
    found = [r for r in logs_list if "click" in r.query]
    assert tuple(search_count(logs, "query:click", "like").first()) == (len(found), len(found) > 100)
    assert search_summary(logs, "query:click", k=1000).agg(F.sum("count")).first()[0] == len(found)


def test_pages_join_up_to_the_whole(logs):
    found = hits(logs, "query:view")
    whole = [r.row_key for r in search(logs, "query:view", limit=10**6).collect()]
    total, pages, first, last = page_info(found, 2, 30).first()
    assert (total, pages, first, last) == (len(whole), math.ceil(len(whole) / 30), 31, min(60, len(whole)))
    by_number = [r.row_key for n in range(1, pages + 1) for r in page(found, n, 30).collect()]
    by_key, last_key = [], None
    while rows := page_after(found, last_key, 30).collect():
        by_key += [r.row_key for r in rows]
        last_key = by_key[-1]
    assert by_number == by_key == whole
    assert page(found, pages + 1, 30).count() == 0
    with pytest.raises(ValueError):
        page(found, 0)


def test_pages_read_only_the_salts_they_need(logs, logs_list):
    keys = sorted(r.row_key for r in logs_list)
    for df in (page(logs, 2, 20), page_after(logs, keys[100], 20)):
        assert "salt" in plan_of(df).split("PartitionFilters")[1].split("]")[0]


def test_pages_of_times_outside_a_day(spark, logs, monkeypatch):
    monkeypatch.setattr(sys.modules["clicktrail.operators.search"], "_SORTED", 10)
    spread = spark.range(20_000).select(
        F.lit(6).alias("salt"), ((F.col("id") - 500) * 360_000_000).alias("ts_ms"), F.lit("user1").alias("user_id"), F.lit("acme").alias("domain")
    )
    found = spread.select(row_key("salt", "ts_ms", "user_id", "domain").alias("row_key"), "salt")
    keys = sorted(r.row_key for r in found.collect())
    for number in (1, 60, 777, 1000):
        assert [r.row_key for r in page(found, number, 20).collect()] == keys[(number - 1) * 20 : number * 20]


def test_a_page_takes_two_counts_at_most(logs, logs_list, monkeypatch):
    module, calls = sys.modules["clicktrail.operators.search"], []
    count = module._per_salt
    monkeypatch.setattr(module, "_per_salt", lambda found: calls.append(1) or count(found))
    in_first = sum(r.salt == 0 for r in logs_list)
    size = max(1, in_first // 2)
    for number, jobs in ((1, 1 if in_first else 2), (4, 2), (len(logs_list) // size, 2)):
        calls.clear()
        page(logs, number, size)
        assert len(calls) == jobs, number


def test_deep_pages(logs, logs_list, monkeypatch):
    keys = sorted(r.row_key for r in logs_list)
    monkeypatch.setattr(sys.modules["clicktrail.operators.search"], "_SORTED", 0)
    for number in (1, 4, 7, len(keys) // 50, len(keys) // 50 + 1, len(keys) // 50 + 2):
        expected = keys[(number - 1) * 50 : number * 50]
        assert [r.row_key for r in page(logs, number, 50).collect()] == expected


# --- Keys --------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_get_by_key(logs, logs_list):
    wanted = logs_list[17]
    found = get_by_key(logs, wanted.row_key)
    assert found.collect() == [wanted]
    plan = plan_of(found)
    assert f"(salt#" in plan and f"= {wanted.salt})]" in plan.split("PartitionFilters")[1]
    assert "EqualTo(row_key" in plan.split("PushedFilters")[1]
    for key in ("", "x", "99|0", wanted.row_key + "x", "٣٣|"):
        assert get_by_key(logs, key).count() == 0


def test_get_by_keys(spark, logs, logs_list):
    rows = [logs_list[i] for i in (40, 3, 90, 3)]
    keys = [rows[0].row_key, "00|missing", *(r.row_key for r in rows[1:]), "junk"]
    assert get_by_keys(logs, keys).collect() == rows
    table = spark.createDataFrame(list(enumerate(keys)), "pos bigint, row_key string")
    assert get_by_keys(logs, table).collect() == rows
    assert get_by_keys(logs, []).collect() == []
    assert "salt" in plan_of(get_by_keys(logs, keys)).split("PartitionFilters")[1].split("]")[0]


def test_long_key_lists_are_not_broadcast_by_force(logs, logs_list):
    keys = [r.row_key for r in logs_list] + [f"00|{i}" for i in range(1000)]
    found = get_by_keys(logs, keys)
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan_of(found).split("PartitionFilters")[1].split("]")[0]
    assert found.collect() == logs_list


def test_search_by_key_parts(logs, logs_list):
    row = logs_list[5]
    for prefix in (row.row_key[:1], row.row_key[:2], row.row_key[:12], row.row_key, "77|", "x"):
        expected = sorted(r for r in logs_list if r.row_key.startswith(prefix))
        assert sorted(search_by_key_parts(logs, prefix).collect()) == expected
    parts = {"access_time": row.access_time, "user": row.user_id, "domain": row.domain}
    assert row in search_by_key_parts(logs, **parts).collect()
    for name, value in parts.items():
        column = {"user": "user_id"}.get(name, name)
        expected = sorted(r for r in logs_list if r[column] == value)
        assert sorted(search_by_key_parts(logs, **{name: value}).collect()) == expected
    assert search_by_key_parts(logs).count() == len(logs_list)


def test_scan_time_range(logs, logs_list):
    found = scan_time_range(logs, "06:00:00", "12:00:00")
    assert sorted(found.collect()) == sorted(r for r in logs_list if 21_600_000 <= r.ts_ms <= 43_200_000)
    assert "GreaterThanOrEqual(ts_ms" in plan_of(found)
    assert scan_time_range(logs, "12:00:00", "06:00:00").count() == 0


def test_users_prune_partitions(logs):
    plan = plan_of(hits(logs, C(users=["user1", "user123"])))
    assert "salt#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "IN (6,9)" in plan


def test_search_sorts_only_the_top(logs):
    assert "TakeOrderedAndProject" in plan_of(search(logs, "rank:1-5"))


# --- Saved results -----------------------------------------------------------------------------


def test_saved_results(spark, logs, tmp_path):
    path = str(tmp_path / "saved")
    condition = "query:view + rank:1-5"
    expected = search(logs, condition, limit=40).collect()
    assert search_saved(logs, condition, path, limit=40).collect() == expected
    loaded = load_result(logs, condition, path, limit=40)
    assert loaded.collect() == expected
    assert "row_key" in plan_of(loaded).split("PushedFilters")[1].split("]")[0].replace("IsNotNull(row_key)", "")
    # Another condition stands beside it; one without hits leaves nothing.
    save_result(logs, "rank:2", path)
    save_result(logs, "user:nobody", path)
    assert load_result(logs, "user:nobody", path).count() == 0
    # Rows that are gone vanish, the others show their cells of today.
    changed = logs.where(F.col("row_key") != expected[0].row_key).withColumn("rank", F.lit(77))
    now = load_result(changed, condition, path, limit=40).collect()
    assert [r.row_key for r in now] == [r.row_key for r in expected[1:]]
    assert {r["rank"] for r in now} == {77}
    # Equal conditions share a result, and saving again replaces it.
    assert search_saved(changed, "rank:1-5+query:view", path, limit=40).count() == len(expected) - 1
    fewer = logs.where(F.col("row_key") != expected[0].row_key)
    save_result(fewer, condition, path, limit=40)
    assert expected[0].row_key not in {r.row_key for r in load_result(logs, condition, path, limit=40).collect()}
    assert load_result(logs, "rank:2", path).count() == min(100, hits(logs, "rank:2").count())


def test_a_saved_result_serves_its_own_limit_and_mode(logs, tmp_path):
    path = str(tmp_path / "saved")
    total = hits(logs, "query:view").count()
    assert search_saved(logs, "query:view", path, limit=5).count() == 5
    assert search_saved(logs, "query:view", path, limit=100).count() == min(100, total)
    assert search_saved(logs, C(query=["V_EW"]), path, mode="like").count() == search(logs, C(query=["V_EW"]), "like").count()
    assert search_saved(logs, C(query=["V_EW"]), path).count() == 0
    assert search_saved(logs, C(query=["click", "view"]), path).count() > 0
    assert search_saved(logs, C(query=["click|view"]), path).count() == 0


def test_a_search_without_hits_under_a_new_path(logs, tmp_path):
    assert search_saved(logs, "user:nobody", str(tmp_path / "new")).count() == 0

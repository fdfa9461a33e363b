"""Reading, parsing, upserting and writing."""

from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as examples
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktrail.functions import row_key, salt
from clicktrail.operators import clicks, latest, load_stats, parse_lines, rejects, upsert
from clicktrail.operators.merge import key_ordered
from clicktrail.plans import load_documents, load_files
from clicktrail.schema import LOG_COLUMNS, LOGS
from clicktrail.sources import (
    clear_table,
    compact_table,
    create_table,
    drop_replaced,
    drop_table,
    loads,
    read_logs,
    read_raw,
    register,
    table_logs,
    upsert_table,
    write_logs,
)
from clicktrail.sources import tables
from clicktrail.sources.settings import settings
from clicktrail.sources.tables import partitions_for

GOOD = "07:41:12\tann\t[hotel 7]\t4 2\thttp://shop.acme.com/rooms?id=3"


def line(time="07:41:12", user="ann", query="[hotel 7]", numbers="4 2", url="http://shop.acme.com/rooms?id=3"):
    return "\t".join((time, user, query, numbers, url))


REASONS = [
    (GOOD, None),
    ("  " + GOOD + " \r", None),
    (line(time="25:99:99"), None),
    (line(time="12:30:00:"), None),
    (line(time=" 12:30:00 "), None),
    (line(query=""), None),
    (line(time="１２:٣0:00", numbers="１ ２"), None),
    (line(numbers="1\x0b 2"), None),
    (line(numbers=" +1  -2 "), None),
    (line(numbers="2147483647 -2147483648"), None),
    (line(url=""), "field_count"),
    (line(time=""), "field_count"),
    (GOOD + "\tmore", "field_count"),
    ("stack trace", "field_count"),
    (line(user=" "), "required_empty"),
    (line(user="", numbers="x"), "required_empty"),
    (line(numbers="1 1 1"), "rank_click_format"),
    (line(numbers="1"), "rank_click_format"),
    (line(numbers=""), "rank_click_format"),
    (line(numbers="1\x011"), "rank_click_format"),
    (line(numbers="x"), "rank_click_format"),
    (line(numbers="99999999999 1"), "rank_click_number"),
    (line(numbers="x 1"), "rank_click_number"),
    (line(numbers="1 1.5"), "rank_click_number"),
    (line(numbers="1 -", time="x"), "rank_click_number"),
    (line(time="12:30"), "time_format"),
    (line(time=":::"), "time_format"),
    (line(time="12:30:00:1"), "time_format"),
    (line(time="12: 30:00"), "time_number"),
    (line(time="aa:30:00"), "time_number"),
    (line(time="::5"), "time_number"),
    (line(time="99999999999:0:0"), "time_number"),
]


def test_reasons(spark):
    rows = [(i, text) for i, (text, _) in enumerate(REASONS)]
    got = parse_lines(spark.createDataFrame(rows, "line_no int, line string")).orderBy("line_no").collect()
    assert [(text, r.reason) for (_, text), r in zip(rows, got, strict=True)] == REASONS


def test_parsed_cells(spark):
    row = clicks(parse_lines(spark.createDataFrame([(7, "\x00 " + GOOD)], "line_no int, line string"))).first()
    assert row.asDict() == {
        "line_no": 7,
        "row_key": "01|9223372036827103807#ann#acme",
        "salt": 1,
        "ts_ms": 27_672_000,
        "access_time": "07:41:12",
        "user_id": "ann",
        "query": "[hotel 7]",
        "rank": 4,
        "click_order": 2,
        "url": "http://shop.acme.com/rooms?id=3",
        "domain": "acme",
    }


def test_blank_lines_are_skipped(spark):
    assert parse_lines(spark.createDataFrame([(" \t\x01",), ("",)], "line string")).count() == 0


def test_reject_keeps_the_line(spark):
    rows = rejects(parse_lines(spark.createDataFrame([(3, " bad line ")], "line_no int, line string"))).collect()
    assert [tuple(r) for r in rows] == [(3, "bad line", "field_count")]


LINES = st.lists(
    st.one_of(
        st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\n\r"), max_size=20),
        st.builds(
            line,
            time=st.sampled_from(["00:00:01", "1:2", "23:59:59", "a:b:c"]),
            user=st.sampled_from(["u1", "u2", ""]),
            numbers=st.sampled_from(["1 2", "3 4", "x 1", "1"]),
            url=st.sampled_from(["http://a.b.com/", "c.d", "http://_x y"]),
        ),
    ),
    max_size=40,
)


@examples(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(LINES)
def test_counters_add_up_and_later_lines_win(spark, texts):
    raw = spark.createDataFrame(list(enumerate(texts)), "line_no int, line string")
    parsed = parse_lines(raw)
    good = [r.asDict() for r in clicks(parsed).orderBy("line_no").collect()]
    last = {r["row_key"]: r for r in good}
    stored = latest(clicks(parsed), "line_no")
    assert {r.row_key: r.asDict() for r in stored.collect()} == {
        k: {c: r[c] for c in LOG_COLUMNS} for k, r in last.items()
    }
    n = {r.counter: r.n for r in load_stats(raw, stored).collect()}
    not_blank = sum(bool(t.strip("".join(map(chr, range(33))))) for t in texts)
    assert n.get("lines", 0) == len(texts)
    assert n.get("parsed", 0) == len(good)
    assert n.get("parsed", 0) + n.get("rejected", 0) == not_blank
    assert sum(v for k, v in n.items() if k.startswith("rejected:")) == n.get("rejected", 0)
    assert n["stored"] == len(last)


def some_clicks(spark, *texts, first=0):
    raw = spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "line_no int, line string")
    return clicks(parse_lines(raw))


def test_upsert_twice_changes_nothing(spark, logs):
    numbered = logs.withColumn("line_no", F.lit(0))
    assert sorted(upsert(logs, numbered, "line_no").collect()) == sorted(logs.collect())


def test_upsert_new_beats_stored_whatever_its_order(spark):
    stored = latest(some_clicks(spark, line(numbers="1 1"), line(user="u2"), first=100), "line_no")
    new = some_clicks(spark, line(numbers="2 2"), line(numbers="3 3"), line(user="u3"))
    rows = {r.user_id: r["rank"] for r in upsert(stored, new, "line_no").collect()}
    assert rows == {"ann": 3, "u2": 4, "u3": 4}


def test_upsert_combines_a_hot_key_before_the_shuffle(spark):
    n = 50_000
    raw = spark.range(0, n, 1, 8).select(
        F.col("id").alias("line_no"), F.concat_ws("\t", F.lit("00:00:01"), F.lit("u"), F.lit("q"), F.concat("id", F.lit(" 1")), F.lit("a.b")).alias("line")
    )
    result = latest(clicks(parse_lines(raw)), "line_no")
    assert [(r["rank"], r.user_id) for r in result.collect()] == [(n - 1, "u")]
    plan = result._jdf.queryExecution().executedPlan().toString()
    combined, shuffled = plan.index("partial_max_by"), plan.index("Exchange hashpartitioning(ts_ms")
    assert shuffled < combined  # a plan prints its inputs below


def test_a_hot_user_is_spread_over_the_written_ranges(spark):
    # A third of all rows is by one user, so in one salt.
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("user_id"),
        (F.col("id") % 86_400 * 1000).alias("ts_ms"),
        F.lit("acme").alias("domain"),
    )
    keyed = rows.withColumn("salt", salt("user_id")).withColumn("row_key", row_key("salt", "ts_ms", "user_id", "domain"))
    with settings(spark, adaptive__coalescePartitions__enabled="false", shuffle__partitions="32"):
        parts = key_ordered(keyed).groupBy(F.spark_partition_id().alias("p")).agg(
            F.count("*").alias("n"), F.count_if(F.col("user_id") == "hot").alias("hot"), F.count_distinct("salt").alias("salts")
        )
        sizes = parts.collect()
    assert max(r.n for r in sizes) < 2.5 * 60_000 / 32
    assert sum(r.hot > 0 for r in sizes) >= 8
    assert max(r.salts for r in sizes) <= 3


# --- Files -------------------------------------------------------------------------------------


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def in_order(raw):
    return [r.line for r in raw.orderBy("load_seq").collect()]


def test_read_raw_keeps_load_order(spark, tmp_path):
    write(tmp_path / "raw" / "b.txt", b"3\r\n\n4")
    write(tmp_path / "raw" / "a.txt", b"1\n2\n")
    assert in_order(read_raw(spark, str(tmp_path / "raw"))) == ["1", "2", "3", "", "4"]


def test_read_raw_orders_the_splits_of_a_file(spark, tmp_path):
    wanted = [f"line {i}" for i in range(5000)]
    write(tmp_path / "big.txt", "\n".join(wanted).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = read_raw(spark, str(tmp_path / "big.txt"))
        assert raw.rdd.getNumPartitions() > 5
        assert in_order(raw) == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("encoding", ["GBK", "GB18030", "ISO-8859-1", "Shift_JIS", "UTF-8"])
def test_read_raw_decodes(spark, tmp_path, encoding):
    text = "café" if encoding == "ISO-8859-1" else "旅行\tabc"
    write(tmp_path / "x.txt", f"{text}\n\n{text}2\n".encode(encoding))
    setting = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert in_order(read_raw(spark, str(tmp_path), encoding)) == [text, "", text + "2"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == setting


@pytest.mark.parametrize("encoding", ["UTF-8", "GBK"])
def test_read_raw_replaces_broken_bytes(spark, tmp_path, encoding):
    write(tmp_path / "x.txt", b"a\xffb\n")
    assert in_order(read_raw(spark, str(tmp_path), encoding)) == ["a�b"]


def test_read_raw_refuses_wide_charsets(spark, tmp_path):
    for encoding in ("UTF-16LE", "UTF-32", "x-UTF-16LE-BOM", "cp037", "IBM1047"):
        with pytest.raises(ValueError, match="UTF-8"):
            read_raw(spark, str(tmp_path), encoding)


# --- Tables ------------------------------------------------------------------------------------


def test_write_and_read_back(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    write_logs(logs, path)
    back = read_logs(spark, path)
    assert back.schema.names == LOGS.names
    assert sorted(back.collect()) == sorted(logs.collect())
    assert {p.name for p in (tmp_path / "logs").glob("salt=*")} == {f"salt={s}" for s, in logs.select("salt").distinct().collect()}


def test_files_are_in_key_order(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    write_logs(logs, path)
    for file in (tmp_path / "logs").glob("salt=*/*.parquet"):
        keys = [r.row_key for r in spark.read.parquet(str(file)).collect()]
        assert keys == sorted(keys)


@pytest.fixture
def table(spark):
    name = "clicks_under_test"
    drop_table(spark, name)
    yield name
    drop_table(spark, name)


def test_create_clear_table(spark, table):
    assert not clear_table(spark, table)
    create_table(spark, table)
    create_table(spark, table)
    upsert_table(spark, table, some_clicks(spark, GOOD), "line_no")
    assert table_logs(spark, table).count() == 1
    assert clear_table(spark, table)
    assert table_logs(spark, table).count() == 0
    assert table_logs(spark, table).columns == LOG_COLUMNS


def table_rows(spark, table):
    return sorted((r.user_id, r.access_time, r["rank"]) for r in table_logs(spark, table).collect())


def test_a_load_leaves_all_earlier_files(spark, table):
    users = ["ann", "user1", "user123", "旅游"]
    upsert_table(spark, table, some_clicks(spark, *(line(user=u) for u in users)), "line_no")
    before = set(spark.table(table).inputFiles())
    upsert_table(spark, table, some_clicks(spark, line(numbers="5 5"), line(time="01:00:00")), "line_no")
    after = set(spark.table(table).inputFiles())
    assert before < after
    expected = [("ann", "01:00:00", 4), ("ann", "07:41:12", 5), *((u, "07:41:12", 4) for u in users[1:])]
    assert table_rows(spark, table) == expected
    assert len(loads(spark, table)) == 2
    compact_table(spark, table)
    assert table_rows(spark, table) == expected
    assert len(loads(spark, table)) == 1
    # Readers that began before still have their files, until these are dropped.
    assert set(spark.table(table).inputFiles()) == after
    assert drop_replaced(spark, table, timedelta(hours=1)) == []
    assert len(drop_replaced(spark, table, timedelta(0))) == 2
    assert not set(spark.table(table).inputFiles()) & after
    assert table_rows(spark, table) == expected
    # A load after a compaction still comes last, and one row more is one more load.
    upsert_table(spark, table, some_clicks(spark, line(numbers="6 6")), "line_no")
    assert table_rows(spark, table)[1] == ("ann", "07:41:12", 6)
    compact_table(spark, table)
    compact_table(spark, table)
    assert table_rows(spark, table)[1] == ("ann", "07:41:12", 6)


def test_the_oldest_load_is_not_grouped(spark, table):
    for numbers in ("1 1", "2 2", "3 3"):
        upsert_table(spark, table, some_clicks(spark, line(numbers=numbers), line(user="u2")), "line_no")
    plan = table_logs(spark, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan
    assert plan.index("Join LeftAnti") < plan.index("Aggregate")
    assert table_rows(spark, table) == [("ann", "07:41:12", 3), ("u2", "07:41:12", 4)]


def add(spark, table, *lines):
    return upsert_table(spark, table, some_clicks(spark, *lines), "line_no")


def test_a_reader_goes_on_across_loads_and_compactions(spark, table):
    """A DataFrame built before gives the state of the moment in which it runs."""
    add(spark, table, line(user="u1"), line(user="u2"))
    reader = table_logs(spark, table)
    ranks = lambda: sorted((r.user_id, r["rank"]) for r in reader.select("user_id", "rank").collect())
    assert ranks() == [("u1", 4), ("u2", 4)]
    add(spark, table, line(user="u2", numbers="7 7"), line(user="u3"))
    assert ranks() == [("u1", 4), ("u2", 7), ("u3", 4)]
    for _ in range(2):
        assert compact_table(spark, table)
        assert ranks() == [("u1", 4), ("u2", 7), ("u3", 4)]
        drop_replaced(spark, table, timedelta(0))
        assert ranks() == [("u1", 4), ("u2", 7), ("u3", 4)]
        add(spark, table, line(user="u2", numbers="7 7"))
    assert reader.where(F.col("user_id") == "u2").count() == 1


def test_two_compactions_at_once(spark, table, monkeypatch):
    """The second one has waited for a claim that went stale, and ends first."""
    add(spark, table, *(line(user=f"u{i}") for i in range(40)))
    add(spark, table, *(line(user=f"u{i}", numbers="9 9") for i in range(20, 60)))
    expected = table_rows(spark, table)
    assert len(expected) == 60
    commit, second = tables._commit, []

    def slow(spark, name, load, kind, *rest):
        if kind == tables.MERGED and not second:
            second.append(None)
            assert compact_table(spark, name) is None  # the claim is held
            second[0] = compact_table(spark, name, stale_after=timedelta(0))
            assert second[0] and table_rows(spark, name) == expected
            add(spark, name, line(user="u0", numbers="3 3"))
        commit(spark, name, load, kind, *rest)

    monkeypatch.setattr(tables, "_commit", slow)
    first = compact_table(spark, table)
    expected = sorted([r for r in expected if r[0] != "u0"] + [("u0", "07:41:12", 3)])
    assert {first, second[0]} < {r.load for r in spark.table(f"{table}__log").collect()}
    assert table_rows(spark, table) == expected
    drop_replaced(spark, table, timedelta(0))
    assert table_rows(spark, table) == expected
    compact_table(spark, table)
    drop_replaced(spark, table, timedelta(0))
    assert table_rows(spark, table) == expected and len(loads(spark, table)) == 1
    # Of both merged loads and all others only the last merged one is left.
    assert {p["load"] for p in tables._partitions(spark, f"{table}__base")} == set(loads(spark, table))
    assert tables._partitions(spark, table) == []


def test_a_load_that_began_before_a_compaction(spark, table, monkeypatch):
    add(spark, table, line(user="u1"), line(user="u2"))
    commit = tables._commit

    def late(spark, name, load, kind, *rest):
        monkeypatch.setattr(tables, "_commit", commit)
        assert table_rows(spark, name) == [("u1", "07:41:12", 4), ("u2", "07:41:12", 4)]  # written, but not in the log
        assert compact_table(spark, name)
        commit(spark, name, load, kind, *rest)

    monkeypatch.setattr(tables, "_commit", late)
    add(spark, table, line(user="u2", numbers="5 5"))
    for _ in range(2):
        assert table_rows(spark, table) == [("u1", "07:41:12", 4), ("u2", "07:41:12", 5)]
        compact_table(spark, table)
        drop_replaced(spark, table, timedelta(0))


def test_a_killed_compaction_changes_nothing(spark, table, monkeypatch):
    add(spark, table, line(user="u1"), line(user="u2"))
    add(spark, table, line(user="u2", numbers="5 5"))
    expected = table_rows(spark, table)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            compact_table(spark, table)
        with pytest.raises(KeyboardInterrupt):
            add(spark, table, line(user="u9"))
    assert table_rows(spark, table) == expected
    merged = compact_table(spark, table)
    assert merged and table_rows(spark, table) == expected
    # What both have left goes with the loads that were merged.
    drop_replaced(spark, table, timedelta(0))
    assert {p["load"] for p in tables._partitions(spark, f"{table}__base")} == {merged} and not tables._partitions(spark, table)
    assert table_rows(spark, table) == expected


def test_a_claim_ends(spark, table):
    add(spark, table, line(user="u1"))
    assert tables._claim(spark, table, timedelta(hours=1))
    assert compact_table(spark, table) is None
    assert compact_table(spark, table, stale_after=timedelta(0))
    assert compact_table(spark, table) is None  # nothing new
    assert not spark.catalog.tableExists(f"{table}__claim")


def test_the_base_is_not_shuffled(spark, table):
    """Later loads over the limit are shuffled to the base's buckets; fewer are broadcast."""
    add(spark, table, *(line(user=f"u{i}") for i in range(30)))
    compact_table(spark, table)
    add(spark, table, *(line(user=f"u{i}", numbers="2 2") for i in range(20, 40)))
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false"):
        many, few = table_logs(spark, table, broadcast_rows=5), table_logs(spark, table)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (many, few)]
        rows = [sorted(df.collect()) for df in (many, few)]
    assert rows[0] == rows[1] and len(rows[0]) == 40
    lines = plans[0].splitlines()
    at = next(i for i, x in enumerate(lines) if f"{table}__base" in x or ("FileScan" in x and "Bucketed: true" in x))
    above = []
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    level = depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            above.append(x)
            level = depth(x)
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above), above
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]


def test_only_the_loads_that_count_are_read(spark, table):
    """The subquery over the log prunes partitions when the query runs."""
    for numbers in ("1 1", "2 2", "3 3"):
        add(spark, table, *(line(user=f"u{i}", numbers=numbers) for i in range(10)))
    compact_table(spark, table)
    add(spark, table, line(user="u1", numbers="4 4"))
    reader = table_logs(spark, table).where(F.col("salt") >= 0)
    with settings(spark, adaptive__enabled="false"):
        assert len(reader.collect()) == 10
        plan = reader._jdf.queryExecution().executedPlan()
        spans = []

        def scans(node):
            if node.nodeName().startswith("Scan parquet"):
                spans.append((node.toString(), node.metrics().apply("numPartitions").value()))
            for i in range(node.children().size()):
                scans(node.children().apply(i))

        scans(plan)
    loaded = [n for text, n in spans if f"{table}__base" not in text]
    assert loaded and max(loaded) <= 1, spans


def test_a_reader_that_was_built_for_few_rows_says_when_there_are_many(spark, table):
    add(spark, table, line(user="u1"))
    reader = table_logs(spark, table, broadcast_rows=2)
    add(spark, table, *(line(user=f"u{i}") for i in range(30)))
    with pytest.raises(Exception, match="call table_logs again"):
        reader.collect()
    assert table_logs(spark, table, broadcast_rows=2).count() == 30


def test_more_input_gives_more_files(spark, table, tmp_path):
    texts = [line(user=f"u{i}") for i in range(4000)]
    write(tmp_path / "small" / "a.log", "\n".join(texts[:400]).encode())
    write(tmp_path / "large" / "a.log", "\n".join(texts).encode())
    target = 20_000
    ranges = {name: partitions_for(spark, str(tmp_path / name), target) for name in ("small", "large")}
    assert ranges["large"] > 5 * ranges["small"]
    files = []
    for name in ranges:
        clear_table(spark, table)
        load_files(spark, str(tmp_path / name), table, bytes_per_file=target)
        files.append(len(spark.table(table).inputFiles()))
    assert files[1] > files[0]


def test_upsert_table_with_nothing_new(spark, table):
    upsert_table(spark, table, some_clicks(spark, "bad"), "line_no")
    assert table_logs(spark, table).count() == 0


def test_load_files(spark, table, tmp_path):
    write(tmp_path / "day1" / "a.log", "\n".join([line(query="[旅游]"), "bad", line(query="[旅游]", numbers="2 2"), ""]).encode("GBK"))
    write(tmp_path / "day2" / "a.log", "\n".join([line(numbers="3 3"), line(user="u2")]).encode())
    rejected = str(tmp_path / "rejects")
    first = load_files(spark, str(tmp_path / "day1"), table, rejected, "GBK")
    assert (first.lines, first.parsed, first.rejected) == (3, 2, {"field_count": 1})
    assert [(r.query, r["rank"]) for r in table_logs(spark, table).collect()] == [("[旅游]", 2)]
    second = load_files(spark, str(tmp_path / "day2"), table, rejected)
    assert (second.lines, second.parsed, second.rejected) == (2, 2, {})
    assert sorted((r.user_id, r["rank"]) for r in table_logs(spark, table).collect()) == [("ann", 3), ("u2", 4)]
    # The same files again: the same rows, and the same bad lines once.
    load_files(spark, str(tmp_path / "day1"), table, rejected, "GBK")
    load_files(spark, str(tmp_path / "day2"), table, rejected)
    assert sorted((r.user_id, r["rank"]) for r in table_logs(spark, table).collect()) == [("ann", 3), ("u2", 4)]
    assert [(r.line, r.reason) for r in spark.read.parquet(rejected).collect()] == [("bad", "field_count")]


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_documents_are_appended(spark, tmp_path, kind):
    write(tmp_path / "in" / "a.log", f"{GOOD}\nbad\n{GOOD}\n".encode())
    out = str(tmp_path / "out")
    for _ in range(2):
        load_documents(spark, str(tmp_path / "in"), out, kind)
    back = spark.read.format(kind).load(out)
    assert back.count() == 4
    row = back.first().asDict()
    assert row["tokens"] is None
    assert (row["ts"], row["tsStr"], row["userId"], row["clickOrder"], row["domain"]) == (27_672_000, "07:41:12", "ann", 2, "acme")
    if kind == "json":
        assert all('"tokens":null' in r.value for r in spark.read.text(out).collect())


def test_register(spark, logs):
    register(logs, "clicks_view")
    assert spark.sql("SELECT count(*) FROM clicks_view").first()[0] == logs.count()

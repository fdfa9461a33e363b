"""Every registered query, with its SQL for the check."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derive, oracle
from clicktrail.functions import extract_domain, in_time_window, java_hash, params_to_map, reverse_ts, row_key, salt
from clicktrail.operators import (
    SearchCondition,
    click_order_distribution,
    clicks,
    domain_share,
    first_n,
    get_by_key,
    get_by_keys,
    hits,
    in_window,
    incomplete_tasks,
    latest,
    load_stats,
    page,
    page_after,
    page_info,
    parse_task_log,
    rank_distribution,
    recent_operations,
    rejects,
    scan_time_range,
    search,
    search_by_key_parts,
    search_count,
    search_summary,
    summary_report,
    task_info,
    to_result,
    top_domains,
    top_n_with_other,
    top_queries,
    total_searches,
    upsert,
    user_frequency,
    with_share,
)
from clicktrail.plans import first_rows, load_documents, load_files, load_result, save_result, search_saved, traffic_report, write_report
from clicktrail.schema import LOG_COLUMNS
from clicktrail.sources import (
    clear_table,
    compact_table,
    create_table,
    drop_replaced,
    drop_table,
    read_raw,
    read_task_log,
    register,
    table_logs,
    to_documents,
)
from clicktrail.sources.scratch import new_path, written
from clicktrail.sources.settings import settings

Query = Callable[[SparkSession, str], DataFrame]

START, END = "09:00:00", "18:00:00"
COLUMNS = ", ".join(LOG_COLUMNS)
# The documented kinds of condition in one: time, users, keywords and ranges.
CONDITION = "time:06:00:00|20:00:00 + user:user1|user2|user3|user5|user7|user9 + query:CLICK|view + rank:1-10 + click:1-5"
CONDITION_SQL = (
    "access_time BETWEEN '06:00:00' AND '20:00:00' AND user_id IN ('user1','user2','user3','user5','user7','user9')"
    " AND (contains(lower(query), 'click') OR contains(lower(query), 'view'))"
    " AND rank BETWEEN 1 AND 10 AND click_order BETWEEN 1 AND 5"
)
RESULT = (
    "row_key AS \"rowKey\", access_time AS \"accessTime\", user_id AS \"userId\", query, rank,"
    " click_order AS \"clickOrder\", url, domain"
)

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        _QUERIES[name] = build
        _SQL[name] = sql
        return build

    return add


def _on_logs(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over the stored clicks."""
    _query(name, sql)(lambda spark, sf_dir: build(derive.stored(spark, sf_dir)))


def _on_window(name: str, build: Callable[[DataFrame], DataFrame], select: str) -> None:
    """A statistic over the window of the stored clicks."""
    _on_logs(name, lambda logs: build(in_window(logs, START, END)), oracle.windowed(select, START, END))


# --- Loading -----------------------------------------------------------------------------------


@_query("read_raw", oracle.raw("SELECT line FROM raw_lines"))
def _read_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, derive.raw_files(spark, sf_dir)).select("line")


@_query(
    "parse_lines",
    oracle.parsed(
        "SELECT ts_ms, access_time, user_id, query, rank, click_order, url FROM parsed WHERE reason IS NULL"
    ),
)
def _parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = derive.loaded(spark, sf_dir).where(F.col("reason").isNull())
    return good.select("ts_ms", "access_time", "user_id", "query", "rank", "click_order", "url")


@_query("rejects", oracle.parsed("SELECT line_no, line, reason FROM parsed WHERE reason IS NOT NULL"))
def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(derive.parsed(spark, sf_dir))


@_query("clicks", oracle.clicks(f"SELECT {COLUMNS} FROM clicks"))
def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(derive.loaded(spark, sf_dir)).select(*LOG_COLUMNS)


@_query(
    "load_stats",
    oracle.stored(
        """SELECT 'lines' AS counter, count(*) AS n FROM raw_lines
UNION ALL SELECT 'parsed', count(*) FROM parsed WHERE reason IS NULL
UNION ALL SELECT 'rejected', count(*) FROM parsed WHERE reason IS NOT NULL
UNION ALL SELECT 'rejected:' || reason, count(*) FROM parsed WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'stored', count(*) FROM stored"""
    ),
)
def _load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_stats(read_raw(spark, derive.raw_files(spark, sf_dir)), derive.stored(spark, sf_dir))


@_query("upsert_one_load", oracle.stored(f"SELECT {COLUMNS} FROM stored"))
def _upsert_one_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(clicks(derive.loaded(spark, sf_dir)))


@_query("upsert_second_load", oracle.stored(f"SELECT {COLUMNS} FROM stored"))
def _upsert_second_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = latest(clicks(derive.loaded(spark, sf_dir, delivery=1)))
    return upsert(first, clicks(derive.loaded(spark, sf_dir, delivery=2)))


def _with_table(spark: SparkSession, work: Callable[[str], None]) -> DataFrame:
    """Rows of a new catalog table after some work on it; the table is dropped again."""
    name = f"clicks_{uuid.uuid4().hex}"
    try:
        work(name)
        return written(table_logs(spark, name), "loaded")
    finally:
        drop_table(spark, name)


@_query("load_table_twice", oracle.stored(f"SELECT {COLUMNS} FROM stored"))
def _load_table_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(name: str) -> None:
        for delivery in (1, 2, 2):
            load_files(spark, derive.raw_files(spark, sf_dir, delivery), name)

    return _with_table(spark, work)


@_query("load_then_compact", oracle.stored(f"SELECT {COLUMNS} FROM stored"))
def _load_then_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(name: str) -> None:
        load_files(spark, derive.raw_files(spark, sf_dir, 1), name)
        load_files(spark, derive.raw_files(spark, sf_dir, 2), name)
        compact_table(spark, name)

    return _with_table(spark, work)


@_query("read_across_compaction", oracle.stored(f"SELECT {COLUMNS} FROM stored"))
def _read_across_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader built before the second load, a compaction and the removal of what it replaced."""
    readers = []

    def work(name: str) -> None:
        load_files(spark, derive.raw_files(spark, sf_dir, 1), name)
        readers.append(table_logs(spark, name))
        load_files(spark, derive.raw_files(spark, sf_dir, 2), name)
        compact_table(spark, name)
        drop_replaced(spark, name, timedelta(0))
        readers.append(written(readers[0], "across"))

    _with_table(spark, work)
    return readers[1]


@_query("create_clear_reload", oracle.stored(f"SELECT {COLUMNS} FROM clicks WHERE line_no < 10000000 QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY line_no DESC) = 1"))
def _create_clear_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(name: str) -> None:
        create_table(spark, name)
        load_files(spark, derive.raw_files(spark, sf_dir), name)
        clear_table(spark, name)
        load_files(spark, derive.raw_files(spark, sf_dir, 1), name)

    return _with_table(spark, work)


@_query(
    "load_result",
    oracle.parsed(
        """SELECT 'lines' AS counter, count(*) AS n FROM raw_lines
UNION ALL SELECT 'parsed', count(*) FROM parsed WHERE reason IS NULL
UNION ALL SELECT reason, count(*) FROM parsed WHERE reason IS NOT NULL GROUP BY reason"""
    ),
)
def _load_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = []
    _with_table(spark, lambda name: done.append(load_files(spark, derive.raw_files(spark, sf_dir), name)))
    counters = {"lines": done[0].lines, "parsed": done[0].parsed} | done[0].rejected
    return spark.createDataFrame(list(counters.items()), "counter string, n bigint")


@_query("rejects_of_repeated_load", oracle.parsed("SELECT line, reason FROM parsed WHERE reason IS NOT NULL"))
def _rejects_of_repeated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "rejects")

    def work(name: str) -> None:
        for _ in range(2):
            load_files(spark, derive.raw_files(spark, sf_dir), name, out)

    _with_table(spark, work)
    return spark.read.parquet(out).select("line", "reason")


@_query("read_raw_gbk", oracle.raw("SELECT replace(line, '[', '[旅游') AS line FROM raw_lines"))
def _read_raw_gbk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "gbk")
    lines = derive.raw_lines(spark, sf_dir).select(F.replace("line", F.lit("["), F.lit("[旅游")).alias("line"))
    with settings(spark, legacy__javaCharsets="true"):
        lines.write.option("encoding", "GBK").option("sep", "\x01").option("quote", "").csv(path)
    return read_raw(spark, path, "GBK").select("line")


_on_logs("stored_table", lambda logs: logs, oracle.stored(f"SELECT {COLUMNS} FROM stored"))


@_query(
    "documents",
    oracle.clicks(
        """SELECT ts_ms AS ts, access_time AS "tsStr", user_id AS "userId", query, rank, click_order AS "clickOrder", url,
domain, CAST(NULL AS VARCHAR[]) AS tokens FROM clicks"""
    ),
)
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_documents(clicks(derive.loaded(spark, sf_dir)))


@_query(
    "documents_appended",
    oracle.clicks(
        """SELECT ts_ms AS ts, access_time AS "tsStr", user_id AS "userId", query, rank, click_order AS "clickOrder", url, domain
FROM clicks, (VALUES (1), (2)) AS twice(turn)"""
    ),
)
def _documents_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "documents")
    for _ in range(2):
        load_documents(spark, derive.raw_files(spark, sf_dir), out)
    schema = "ts bigint, tsStr string, userId string, query string, rank int, clickOrder int, url string, domain string"
    return spark.read.schema(schema).json(out)


# --- Column functions --------------------------------------------------------------------------


@_query(
    "extract_domain",
    r"""SELECT page_id, url, CASE WHEN len(labels) >= 2 THEN labels[-2] ELSE labels[1] END AS domain
FROM (SELECT page_id, url, string_split(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '.') AS labels FROM pages)""",
)
def _extract_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", extract_domain("url").alias("domain"))


# A host that no URI parser takes, a blank, a pipe, no scheme, and a web address as it is.
_DAMAGED = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://a_') WHEN 1 THEN url || ' b'
  WHEN 2 THEN url || '|c' WHEN 3 THEN replace(replace(url, 'https://', ''), 'http://', '') || '|d'
  ELSE replace(url, '://', '://www.b_') END AS url FROM pages"""


@_query(
    "extract_domain_fallback",
    f"""SELECT page_id, url, string_split(regexp_extract(url, '^(?:https?://)?(?:www\\.)?([^/]+)', 1), '.')[-2] AS domain
FROM ({_DAMAGED})""",
)
def _extract_domain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, url = F.col("page_id") % 5, F.col("url")
    damaged = (
        F.when(kind == 0, F.replace(url, F.lit("://"), F.lit("://a_")))
        .when(kind == 1, F.concat(url, F.lit(" b")))
        .when(kind == 2, F.concat(url, F.lit("|c")))
        .when(kind == 3, F.concat(F.regexp_replace(url, "^https?://", ""), F.lit("|d")))
        .otherwise(F.replace(url, F.lit("://"), F.lit("://www.b_")))
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", damaged.alias("url"))
    return pages.select("page_id", "url", extract_domain("url").alias("domain"))


@_query("user_salt", oracle.clicks("SELECT user_id, hash, salt FROM clicks"))
def _user_salt(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = derive.loaded(spark, sf_dir).where(F.col("reason").isNull())
    return good.select("user_id", java_hash("user_id").alias("hash"), salt("user_id").alias("salt"))


@_query("row_keys", oracle.stored("SELECT reverse_ts, row_key FROM clicks"))
def _row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Keys built again from the parts of every click.
    good = derive.loaded(spark, sf_dir).where(F.col("reason").isNull())
    parts = good.select("ts_ms", "user_id", salt("user_id").alias("salt"), extract_domain("url").alias("domain"))
    return parts.select(
        reverse_ts("ts_ms").alias("reverse_ts"), row_key("salt", "ts_ms", "user_id", "domain").alias("row_key")
    )


@_query(
    "strict_time",
    oracle.parsed(
        """SELECT line_no, coalesce(regexp_full_match(tm, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]')
  AND tm BETWEEN '09:00:00' AND '18:00:00', false) AS inside FROM named"""
    ),
)
def _strict_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.substring_index("line", "\t", 1)
    return derive.raw_lines(spark, sf_dir).select("line_no", in_time_window(given, START, END).alias("inside"))


# --- Reads by time and key ---------------------------------------------------------------------

_on_logs(
    "scan_time_range",
    lambda logs: scan_time_range(logs, "08:30:00", "10:15:30"),
    oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE ts_ms BETWEEN 30600000 AND 36930000"),
)


@_query("get_by_key", oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE row_key = (SELECT max(row_key) FROM stored)"))
def _get_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = derive.stored(spark, sf_dir)
    return get_by_key(logs, logs.agg(F.max("row_key")).first()[0])


@_query(
    "get_by_keys",
    oracle.stored(
        f"""SELECT {COLUMNS} FROM stored WHERE row_key IN
(SELECT max(row_key) FROM stored GROUP BY domain)"""
    ),
)
def _get_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The greatest key of each domain, and for each one more that no row has.
    logs = derive.stored(spark, sf_dir)
    greatest = logs.groupBy("domain").agg(F.max("row_key").alias("row_key"))
    keys = greatest.select(
        F.monotonically_increasing_id().alias("pos"),
        F.explode(F.array("row_key", F.concat("row_key", F.lit("?")))).alias("row_key"),
    )
    return get_by_keys(logs, keys)


@_query(
    "get_by_key_list",
    oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE row_key IN (SELECT max(row_key) FROM stored GROUP BY salt)"),
)
def _get_by_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One key of each salt and many that no row has.
    logs = derive.stored(spark, sf_dir)
    keys = [r[1] for r in logs.groupBy("salt").agg(F.max("row_key")).collect()]
    return get_by_keys(logs, keys + [f"{k}?{i}" for k in keys for i in range(100)])


_on_logs(
    "key_prefix",
    lambda logs: search_by_key_parts(logs, prefix="06|92233720367"),
    oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE starts_with(row_key, '06|92233720367')"),
)
_on_logs(
    "key_parts",
    lambda logs: search_by_key_parts(logs, user="user1", domain="ththan"),
    oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE user_id = 'user1' AND domain = 'ththan'"),
)


@_query(
    "sql_view",
    oracle.stored("SELECT domain, min(rank) AS best_rank, count(*) AS visits FROM stored GROUP BY domain"),
)
def _sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(derive.stored(spark, sf_dir), "search_logs")
    return spark.sql("SELECT domain, min(rank) AS best_rank, count(*) AS visits FROM search_logs GROUP BY domain")


# --- Search ------------------------------------------------------------------------------------


@_query(
    "hits_time_equal",
    oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE access_time = (SELECT max(access_time) FROM stored)"),
)
def _hits_time_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = derive.stored(spark, sf_dir)
    moment = logs.agg(F.max("access_time")).first()[0]
    return hits(logs, SearchCondition(time=(moment, moment)))


for _name, _condition, _where in (
    ("time", SearchCondition(time=("25:00:00", "26:30:00")), "access_time BETWEEN '01:00:00' AND '02:30:00'"),
    ("users", SearchCondition(users=["user1", "user12", "nobody"]), "user_id IN ('user1', 'user12', 'nobody')"),
    (
        "query",
        SearchCondition(query=["Error1", "SIGN"]),
        "contains(lower(query), 'error1') OR contains(lower(query), 'sign')",
    ),
    ("domain", SearchCondition(domain=["THTH", "farm"]), "contains(lower(domain), 'thth') OR contains(lower(domain), 'farm')"),
    ("url", SearchCondition(url=["/FR/", "ref=x"]), "contains(lower(url), '/fr/') OR contains(lower(url), 'ref=x')"),
    ("rank", SearchCondition(rank=(2, 5)), "rank BETWEEN 2 AND 5"),
    ("click_order", SearchCondition(click=(3, 3)), "click_order BETWEEN 3 AND 3"),
    (
        "all_criteria",
        SearchCondition(
            time=("06:00:00", "22:00:00"),
            users=[f"user{i}" for i in range(15)],
            query=["view", "click", "error"],
            domain=["th"],
            url=["http"],
            rank=(1, 12),
            click=(1, 6),
        ),
        "access_time BETWEEN '06:00:00' AND '22:00:00' AND user_id IN ("
        + ", ".join(f"'user{i}'" for i in range(15))
        + ") AND (contains(lower(query), 'view') OR contains(lower(query), 'click') OR contains(lower(query), 'error'))"
        " AND contains(lower(domain), 'th') AND contains(lower(url), 'http') AND rank BETWEEN 1 AND 12"
        " AND click_order BETWEEN 1 AND 6",
    ),
    ("condition_text", CONDITION, CONDITION_SQL),
):
    _on_logs(
        f"hits_{_name}",
        lambda logs, condition=_condition: hits(logs, condition),
        oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE {_where}"),
    )

_on_logs(
    "search_first_100",
    lambda logs: to_result(search(logs, "rank:1-5 + query:click|view")),
    oracle.stored(
        f"""SELECT {RESULT} FROM stored WHERE rank BETWEEN 1 AND 5
  AND (contains(lower(query), 'click') OR contains(lower(query), 'view')) ORDER BY row_key LIMIT 100"""
    ),
)
_on_logs(
    "search_like",
    lambda logs: to_result(search(logs, SearchCondition(query=["c_ick1%", "VIEW"], rank=(1, 8)), "like", None), False),
    oracle.stored(
        f"""SELECT {RESULT.split(', ', 1)[1]} FROM stored
WHERE (query LIKE '%c_ick1%%' OR query LIKE '%VIEW%') AND rank BETWEEN 1 AND 8"""
    ),
)
_on_logs(
    "search_like_backslash",
    lambda logs: hits(logs.withColumn("url", F.replace("url", F.lit("/"), F.lit("\\"))), SearchCondition(url=["\\en\\", "fr\\"]), "like"),
    oracle.stored(
        f"""SELECT {COLUMNS.replace("url", "replace(url, '/', chr(92)) AS url")} FROM stored
WHERE contains(url, '/en/') OR contains(url, 'fr/')"""
    ),
)
_on_logs(
    "search_count",
    lambda logs: search_count(logs, CONDITION),
    oracle.stored(f"SELECT count(*) AS hits, count(*) > 100 AS over_cap FROM stored WHERE {CONDITION_SQL}"),
)
_on_logs(
    "search_preview",
    lambda logs: to_result(search(logs, CONDITION, limit=10)),
    oracle.stored(f"SELECT {RESULT} FROM stored WHERE {CONDITION_SQL} ORDER BY row_key LIMIT 10"),
)
_on_logs(
    "search_summary",
    lambda logs: search_summary(logs, "query:click"),
    oracle.stored(
        """SELECT user_id, query, domain, count(*) AS count FROM stored WHERE query LIKE '%click%'
GROUP BY user_id, query, domain ORDER BY count DESC, user_id, query, domain LIMIT 10"""
    ),
)
_on_logs(
    "search_page",
    lambda logs: page(hits(logs, "query:purchase"), 3),
    oracle.stored(
        f"SELECT {COLUMNS} FROM stored WHERE contains(lower(query), 'purchase') ORDER BY row_key LIMIT 20 OFFSET 40"
    ),
)


_PURCHASES = "FROM stored WHERE contains(lower(query), 'purchase')"


def _on_page(name: str, number: Callable[[int], int], sql_number: str) -> None:
    """A page of the purchases whose number follows the number of pages."""

    def build(logs: DataFrame) -> DataFrame:
        found = hits(logs, "query:purchase")
        return page(found, number(page_info(found, 1).first()["pages"]))

    place = "row_number() OVER (ORDER BY row_key) - 1"
    pages = f"(SELECT CAST(ceil(count(*) / 20) AS BIGINT) AS pages {_PURCHASES})"
    _on_logs(
        name,
        build,
        oracle.stored(
            f"""SELECT {COLUMNS} FROM (SELECT *, {place} AS place {_PURCHASES}), {pages} WHERE place // 20 + 1 = {sql_number}"""
        ),
    )


_on_page("search_page_first", lambda pages: 1, "1")
_on_page("search_page_middle", lambda pages: pages // 2 + 1, "pages // 2 + 1")
_on_page("search_page_last", lambda pages: pages, "pages")


@_query(
    "search_page_after",
    oracle.stored(
        f"""SELECT {COLUMNS} FROM stored WHERE contains(lower(query), 'purchase')
  AND row_key > (SELECT median_key.row_key FROM (SELECT min(row_key) AS row_key FROM stored WHERE salt = 8) AS median_key)
ORDER BY row_key LIMIT 20"""
    ),
)
def _search_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = derive.stored(spark, sf_dir)
    last = logs.where(F.col("salt") == 8).agg(F.min("row_key")).first()[0]
    return page_after(hits(logs, "query:purchase"), last)


_on_logs(
    "search_page_info",
    lambda logs: page_info(hits(logs, "query:purchase"), 3),
    oracle.stored(
        """SELECT count(*) AS hits, CAST(ceil(count(*) / 20) AS BIGINT) AS pages, least(count(*), 41) AS first_row,
  least(count(*), 60) AS last_row FROM stored WHERE contains(lower(query), 'purchase')"""
    ),
)


@_query(
    "saved_result",
    oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE {CONDITION_SQL} ORDER BY row_key LIMIT 100"),
)
def _saved_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = derive.stored(spark, sf_dir)
    path = new_path(spark, "saved")
    save_result(logs, CONDITION, path)
    return load_result(logs, CONDITION, path)


_CLICK_OR_VIEW = "contains(lower(query), 'click') OR contains(lower(query), 'view')"


@_query(
    "saved_result_larger_limit",
    oracle.stored(f"SELECT {COLUMNS} FROM stored WHERE {_CLICK_OR_VIEW} ORDER BY row_key LIMIT 100"),
)
def _saved_result_larger_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, path = derive.stored(spark, sf_dir), new_path(spark, "saved")
    search_saved(logs, "query:click|view", path, limit=5)
    return search_saved(logs, "query:click|view", path, limit=100)


@_query(
    "saved_result_ambiguous_text",
    oracle.stored(
        f"""SELECT {COLUMNS} FROM (SELECT * FROM stored WHERE contains(lower(query), 'click|view')
UNION ALL SELECT * FROM stored WHERE {_CLICK_OR_VIEW}) ORDER BY row_key LIMIT 100"""
    ),
)
def _saved_result_ambiguous_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both conditions read ``query:click|view``; the first one has no hits.
    logs, path = derive.stored(spark, sf_dir), new_path(spark, "saved")
    one, two = SearchCondition(query=["click|view"]), SearchCondition(query=["click", "view"])
    save_result(logs, two, path)
    save_result(logs, one, path)
    return search_saved(logs, one, path).unionByName(search_saved(logs, two, path))


@_query(
    "saved_condition_text",
    oracle.stored(
        f"""SELECT 'time:06:00:00|20:00:00+user:user1|user2|user3|user5|user7|user9+query:CLICK|view+rank:1-10+click:1-5' AS condition,
  count(*) AS keys FROM (SELECT 1 FROM stored WHERE {CONDITION_SQL} ORDER BY row_key LIMIT 100) HAVING count(*) > 0"""
    ),
)
def _saved_condition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display text that is saved with the keys of a result."""
    path = new_path(spark, "saved")
    save_result(derive.stored(spark, sf_dir), CONDITION, path)
    return spark.read.parquet(path).groupBy("condition").agg(F.count("*").alias("keys"))


# --- Statistics --------------------------------------------------------------------------------

_on_window("window_clicks", lambda win: win, f"SELECT {COLUMNS} FROM win")
_on_window("total_searches", total_searches, "SELECT count(*) AS total_searches FROM win")

_TOP = "SELECT {key}, count(*) AS {name} FROM win GROUP BY {key} ORDER BY {name} DESC, {key} LIMIT {k}"
_TOP_QUERIES = _TOP.format(key="query", name="search_count", k=20)
_TOP_DOMAINS = _TOP.format(key="domain", name="visit_count", k=20)
_TOP_USERS = _TOP.format(key="user_id", name="search_count", k=20)
_RANKS = "SELECT rank, count(*) AS visit_count FROM win {where} GROUP BY rank"
_CLICK_ORDERS = "SELECT click_order, count(*) AS count FROM win GROUP BY click_order"
_SHARES = """SELECT domain, count, CAST((20000 * count + whole) // (2 * whole) AS DOUBLE) / 100 AS percentage
FROM (SELECT domain, count(*) AS count, CAST(sum(count(*)) OVER () AS BIGINT) AS whole FROM win GROUP BY domain)
ORDER BY count DESC, domain LIMIT {k}"""
_SUMMARY = """SELECT '09:00:00' AS start_time, '18:00:00' AS end_time, count(*) AS total_searches,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT query) AS unique_queries, count(DISTINCT domain) AS unique_domains
FROM win"""

_on_window("top_queries", top_queries, _TOP_QUERIES)
_on_window("top_domains", top_domains, _TOP_DOMAINS)
_on_window("user_frequency", user_frequency, _TOP_USERS)
_on_window("rank_distribution", rank_distribution, _RANKS.format(where=""))
_on_window(
    "rank_distribution_to_10", lambda win: rank_distribution(win, 10), _RANKS.format(where="WHERE rank <= 10")
)
_on_window("click_order_distribution", click_order_distribution, _CLICK_ORDERS)
_on_window("domain_share", domain_share, _SHARES.format(k=100))
_on_window("summary_report", lambda win: summary_report(win, START, END), _SUMMARY)

for _part, _select in (
    ("total_searches", "SELECT count(*) AS total_searches FROM win"),
    ("query_statistics", _TOP.format(key="query", name="search_count", k=100)),
    ("domain_statistics", _TOP.format(key="domain", name="visit_count", k=100)),
    ("user_frequency", _TOP.format(key="user_id", name="search_count", k=100)),
    ("rank_statistics", _RANKS.format(where="")),
    ("top10_rank_statistics", _RANKS.format(where="WHERE rank <= 10")),
    ("click_order_statistics", _CLICK_ORDERS),
    ("domain_distribution", _SHARES.format(k=100)),
    ("summary_report", _SUMMARY),
):
    _on_logs(
        f"report_{_part}",
        lambda logs, part=_part: traffic_report(logs, START, END, keep=False)[part],
        oracle.windowed(_select, START, END),
    )


@_query("report_files", oracle.windowed(_SHARES.format(k=100), START, END))
def _report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with traffic_report(derive.stored(spark, sf_dir), START, END) as report:
        folder = write_report(report, new_path(spark, "report"), "run")
    return spark.read.csv(f"{folder}/domain_distribution", schema="domain string, count bigint, percentage double")


_on_logs(
    "report_preview",
    lambda logs: first_rows(traffic_report(logs, START, END, keep=False)["domain_statistics"]),
    oracle.windowed(_TOP.format(key="domain", name="visit_count", k=10), START, END),
)


def _on_report_file(name: str, schema: str, select: str) -> None:
    """One of the files that a report writes, read back."""

    @_query(f"report_file_{name}", oracle.windowed(select, START, END))
    def _report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = traffic_report(derive.stored(spark, sf_dir), START, END, keep=False)
        folder = write_report({name: report[name]}, new_path(spark, "report"), "run")
        return spark.read.csv(f"{folder}/{name}", schema=schema)


for _part, _schema, _select in (
    ("query_statistics", "query string, search_count bigint", _TOP.format(key="query", name="search_count", k=100)),
    ("domain_statistics", "domain string, visit_count bigint", _TOP.format(key="domain", name="visit_count", k=100)),
    ("user_frequency", "user_id string, search_count bigint", _TOP.format(key="user_id", name="search_count", k=100)),
    ("rank_statistics", "rank int, visit_count bigint", _RANKS.format(where="")),
    ("click_order_statistics", "click_order int, count bigint", _CLICK_ORDERS),
    (
        "summary_report",
        "start_time string, end_time string, total_searches bigint, unique_users bigint, unique_queries bigint, unique_domains bigint",
        _SUMMARY,
    ),
):
    _on_report_file(_part, _schema, _select)


# --- Chart data --------------------------------------------------------------------------------

def _chart_sql(key: str, name: str, cap: int | None) -> str:
    counts = f"SELECT {key}, count(*) AS {name} FROM win GROUP BY {key}"
    return oracle.windowed(
        f"""SELECT {key}, {name}, is_other FROM (
  SELECT CASE WHEN place <= 8 THEN {key} ELSE '其他' END AS {key}, place > 8 AS is_other, CAST(sum({name}) AS BIGINT) AS {name}
  FROM (SELECT *, row_number() OVER (ORDER BY {name} DESC, {key}) AS place FROM ({counts}))
  WHERE place <= {cap or 9223372036854775807} GROUP BY 1, 2)""",
        START,
        END,
    )


for _name, _key, _value, _cap in (
    ("queries", "query", "search_count", None),
    ("domains", "domain", "visit_count", None),
    ("users", "user_id", "search_count", None),
    ("queries_true_rest", "query", "search_count", None),
):
    _on_logs(
        f"chart_{_name}",
        lambda logs, key=_key, value=_value, cap=_cap: top_n_with_other(
            in_window(logs, START, END).groupBy(key).agg(F.count("*").alias(value)), key, value, cap=cap
        ),
        _chart_sql(_key, _value, _cap),
    )

_on_window(
    "chart_ranks", lambda win: first_n(rank_distribution(win), "rank"), _RANKS.format(where="") + " ORDER BY rank LIMIT 8"
)
_on_window(
    "chart_click_orders",
    lambda win: first_n(click_order_distribution(win), "click_order"),
    _CLICK_ORDERS + " ORDER BY click_order LIMIT 8",
)
_on_window(
    "chart_domain_shares",
    lambda win: with_share(top_n_with_other(win.groupBy("domain").agg(F.count("*").alias("count")), "domain", "count"), "count"),
    """SELECT domain, count, is_other, count / sum(count) OVER () AS share FROM (
  SELECT CASE WHEN place <= 8 THEN domain ELSE '其他' END AS domain, place > 8 AS is_other, CAST(sum(count) AS BIGINT) AS count
  FROM (SELECT domain, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, domain) AS place FROM win GROUP BY domain)
  GROUP BY 1, 2)""",
)


# --- Task log ----------------------------------------------------------------------------------

RECORD = "ts, task_id, status, type, details"


def _task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_task_log(spark, derive.task_files(spark, sf_dir))


@_query("read_task_log", oracle.tasks("SELECT line FROM task_lines"))
def _read_task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task_log(spark, sf_dir).select("line")


@_query("task_records", oracle.tasks(f"SELECT {RECORD} FROM records"))
def _task_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_task_log(_task_log(spark, sf_dir)).drop("load_seq")


@_query(
    "incomplete_tasks",
    oracle.tasks(
        """SELECT task_id, count(*) AS starts, min_by(ts, line_no) AS ts, min_by(type, line_no) AS type,
  min_by(details, line_no) AS details
FROM records WHERE status = 'START'
  AND task_id NOT IN (SELECT task_id FROM records WHERE status IN ('SUCCESS', 'FAILURE')) GROUP BY task_id"""
    ),
)
def _incomplete_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incomplete_tasks(parse_task_log(_task_log(spark, sf_dir)))


@_query(
    "task_info",
    oracle.tasks(
        """SELECT task_id, type, details AS parameters FROM records
WHERE status = 'START' AND task_id = (SELECT max(task_id) FROM records) ORDER BY line_no LIMIT 1"""
    ),
)
def _task_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse_task_log(_task_log(spark, sf_dir))
    return task_info(records, records.agg(F.max("task_id")).first()[0])


@_query(
    "recent_operations",
    oracle.tasks(
        f"SELECT {RECORD} FROM records ORDER BY ts DESC, line_no LIMIT 10"
    ),
)
def _recent_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_operations(_task_log(spark, sf_dir)).drop("load_seq")


@_query(
    "task_parameters",
    oracle.tasks(
        r"""SELECT task_id, CASE WHEN type = 'DATA_LOAD' THEN regexp_extract(details, 'file=([^,]*)', 1) END AS file,
  CASE WHEN type = 'DATA_LOAD' THEN regexp_extract(details, 'batch=([^,]*)', 1) END AS batch,
  CASE WHEN type = 'SPARK_ANALYSIS' THEN regexp_extract(details, ', start = ([0-9:]*)', 1) END AS start,
  CASE type WHEN 'DATA_LOAD' THEN 4 WHEN 'CLEAN_TABLE' THEN 0 ELSE 2 END AS n FROM records WHERE status = 'START'"""
    ),
)
def _task_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = parse_task_log(_task_log(spark, sf_dir)).where(F.col("status") == "START")
    given = starts.select("task_id", params_to_map("details").alias("p"))
    values = (F.try_element_at("p", F.lit(name)).alias(name) for name in ("file", "batch", "start"))
    return given.select("task_id", *values, F.size("p").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From log files to the hot queries of a window in one plan."""
    stored = latest(clicks(derive.loaded(spark, sf_dir)))
    return top_queries(in_window(stored, START, END))


_query("raw_to_top_queries", oracle.windowed(_TOP_QUERIES, START, END))(flagship)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

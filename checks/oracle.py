"""The derived inputs in SQL, written apart from the library: line rules, keys and upsert by hand."""

from __future__ import annotations

RAW_LINES = r"""
base AS (
  SELECT event_id,
         strftime(ts, '%H:%M:%S') AS tm,
         'user' || user_id AS usr,
         '[' || CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || (event_id % 23) || ']' AS qry,
         (1 + event_id % 15) || '' AS rk,
         (1 + event_id % 7) || '' AS ck,
         replace(url, '.example.', '.') AS url,
         event_id % 97 AS fault
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)
),
raw_lines AS (
  SELECT event_id AS line_no,
         CASE fault
           WHEN 0 THEN tm || chr(9) || usr || chr(9) || qry || chr(9) || rk || ' ' || ck
           WHEN 1 THEN tm || chr(9) || chr(9) || qry || chr(9) || rk || ' ' || ck || chr(9) || url
           WHEN 2 THEN tm || chr(9) || usr || chr(9) || qry || chr(9) || 'x ' || ck || chr(9) || url
           WHEN 3 THEN tm || chr(9) || usr || chr(9) || qry || chr(9) || rk || chr(9) || url
           WHEN 4 THEN substr(tm, 1, 5) || chr(9) || usr || chr(9) || qry || chr(9) || rk || ' ' || ck || chr(9) || url
           WHEN 5 THEN 'aa' || substr(tm, 3) || chr(9) || usr || chr(9) || qry || chr(9) || rk || ' ' || ck || chr(9) || url
           ELSE tm || chr(9) || usr || chr(9) || qry || chr(9) || rk || ' ' || ck || chr(9) || url
         END AS line
  FROM base
  UNION ALL
  SELECT event_id + 10000000, tm || chr(9) || usr || chr(9) || qry || chr(9) || '99 9' || chr(9) || url
  FROM base WHERE event_id % 11 = 0 AND fault > 5
)"""

PARSED = (
    RAW_LINES
    + r""",
trimmed AS (
  SELECT line_no, regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line FROM raw_lines
),
fields AS (
  SELECT line_no, line, string_split(line, chr(9)) AS p FROM trimmed WHERE line <> ''
),
named AS (
  SELECT line_no, line, len(p) AS n, trim(p[1]) AS tm, trim(p[2]) AS usr, trim(p[3]) AS qry,
         string_split_regex(trim(p[4]), '\s+') AS rc, string_split(rtrim(trim(p[1]), ':'), ':') AS tp, trim(p[5]) AS url
  FROM fields
),
numbers AS (
  SELECT *,
         CASE WHEN regexp_full_match(rc[1], '[+-]?[0-9]+') THEN TRY_CAST(rc[1] AS INTEGER) END AS rk,
         CASE WHEN regexp_full_match(rc[2], '[+-]?[0-9]+') THEN TRY_CAST(rc[2] AS INTEGER) END AS ck,
         CASE WHEN regexp_full_match(tp[1], '[+-]?[0-9]+') THEN TRY_CAST(tp[1] AS INTEGER) END AS hh,
         CASE WHEN regexp_full_match(tp[2], '[+-]?[0-9]+') THEN TRY_CAST(tp[2] AS INTEGER) END AS mi,
         CASE WHEN regexp_full_match(tp[3], '[+-]?[0-9]+') THEN TRY_CAST(tp[3] AS INTEGER) END AS ss
  FROM named
),
parsed AS (
  SELECT line_no, line,
         CASE WHEN n <> 5 THEN 'field_count'
              WHEN tm = '' OR usr = '' OR url = '' THEN 'required_empty'
              WHEN len(rc) <> 2 THEN 'rank_click_format'
              WHEN rk IS NULL OR ck IS NULL THEN 'rank_click_number'
              WHEN len(tp) <> 3 THEN 'time_format'
              WHEN hh IS NULL OR mi IS NULL OR ss IS NULL THEN 'time_number' END AS reason,
         ((hh::BIGINT * 60 + mi) * 60 + ss) * 1000 AS ts_ms,
         tm AS access_time, usr AS user_id, qry AS query, rk AS rank, ck AS click_order, url
  FROM numbers
)"""
)

CLICKS = (
    PARSED
    + r""",
labelled AS (
  SELECT *, string_split(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '.') AS labels,
         list_reduce(list_prepend(0::BIGINT, list_transform(string_split(user_id, ''), lambda x: unicode(x)::BIGINT)),
                     lambda a, b: (a * 31 + b) & 4294967295) AS unsigned_hash
  FROM parsed WHERE reason IS NULL
),
hashed AS (
  SELECT *, CASE WHEN len(labels) >= 2 THEN labels[-2] ELSE labels[1] END AS domain,
         CASE WHEN unsigned_hash > 2147483647 THEN unsigned_hash - 4294967296 ELSE unsigned_hash END AS hash
  FROM labelled
),
clicks AS (
  SELECT line_no, hash, lpad((9223372036854775807 - ts_ms)::VARCHAR, 19, '0') AS reverse_ts,
         lpad(abs(hash % 16)::VARCHAR, 2, '0') || '|' || lpad((9223372036854775807 - ts_ms)::VARCHAR, 19, '0')
           || '#' || user_id || '#' || domain AS row_key,
         abs(hash % 16)::INTEGER AS salt, ts_ms, access_time, user_id, query, rank, click_order, url, domain
  FROM hashed
)"""
)

STORED = (
    CLICKS
    + r""",
stored AS (
  SELECT row_key, salt, ts_ms, access_time, user_id, query, rank, click_order, url, domain
  FROM clicks QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY line_no DESC) = 1
)"""
)

TASK_LINES = r"""
tasks AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN 'DATA_LOAD' WHEN 'click' THEN 'SPARK_SEARCH'
                            WHEN 'signup' THEN 'CLEAN_TABLE' ELSE 'SPARK_ANALYSIS' END AS kind,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS written_at
  FROM events
),
task_lines AS (
  SELECT event_id * 3 AS line_no,
         written_at || '|' || kind || '_' || event_id || '|START|' || kind || '|' ||
         CASE kind WHEN 'DATA_LOAD' THEN 'file=f' || user_id || '.tsv,zk=h:1,batch=' || (event_id % 7 * 1000) || ',encoding=UTF-8'
                   WHEN 'SPARK_SEARCH' THEN 'condition=user:user' || user_id || '|user1,zkQuorum=h'
                   WHEN 'CLEAN_TABLE' THEN ''
                   ELSE 'start=00:00:00,end=23:59:59,x, start = 0' || (event_id % 9) || ':00:00' END AS line
  FROM tasks
  UNION ALL
  SELECT event_id * 3 + 1,
         written_at || '|' || kind || '_' || event_id || CASE WHEN event_type = 'error' THEN '|FAILURE|' ELSE '|SUCCESS|' END
            || kind || CASE WHEN event_type = 'error' THEN '|refused' ELSE '|ok' END
  FROM tasks WHERE event_id % 13 <> 0
  UNION ALL
  SELECT event_id * 3 + 2, 'stack trace of ' || event_id FROM tasks WHERE event_id % 1000003 = 3
  UNION ALL
  SELECT event_id * 3 + 2, '  at frame ' || event_id FROM tasks WHERE event_id % 1000003 <> 3 AND event_id % 29 = 4
)"""

# A record is a line of four parts at least; the fifth runs to the end of the line.
TASK_RECORDS = (
    TASK_LINES
    + r""",
records AS (
  SELECT line_no, p[1] AS ts, p[2] AS task_id, p[3] AS status, p[4] AS type,
         coalesce(array_to_string(p[5:], '|'), '') AS details
  FROM (SELECT line_no, string_split(line, '|') AS p FROM task_lines) WHERE len(p) >= 4
)"""
)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def raw(select: str) -> str:
    return _with(RAW_LINES, select)


def parsed(select: str) -> str:
    return _with(PARSED, select)


def clicks(select: str) -> str:
    return _with(CLICKS, select)


def stored(select: str) -> str:
    return _with(STORED, select)


def windowed(select: str, start: str = "09:00:00", end: str = "18:00:00") -> str:
    """A select over ``win``, the stored clicks of a window."""
    window = (
        ",\nwin AS (SELECT * FROM stored WHERE regexp_full_match(access_time, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]')"
        f" AND access_time BETWEEN '{start}' AND '{end}')"
    )
    return _with(STORED + window, select)


def tasks(select: str) -> str:
    return _with(TASK_RECORDS, select)

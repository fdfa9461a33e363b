"""Time the jobs on copies of the derived click lines: ``python -m checks.scale [sf_dir] [copies]``.

Copies have users of their own, but every third one is all by a single user, who so holds a third of all
lines and sits in one salt. Prints seconds per job and how even the written files are.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import derive
from checks.compare import session
from clicktrail.operators import (
    clicks,
    domain_share,
    hits,
    in_window,
    latest,
    load_stats,
    scan_time_range,
    search,
    search_summary,
    summary_report,
    top_queries,
    user_frequency,
)
from clicktrail.plans import parsed_files, traffic_report
from clicktrail.sources import read_logs, read_raw, write_logs
from clicktrail.sources.scratch import new_path
from clicktrail.sources.tables import partitions_for


def copied_lines(lines: DataFrame, copies: int) -> DataFrame:
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    user = F.when(F.col("copy") % 3 == 0, "hot").otherwise(F.concat(F.col("p")[1], F.lit("x"), F.col("copy")))
    renamed = lines.select("line", copy.alias("copy")).withColumn("p", F.split("line", "\t"))
    return renamed.select(
        F.when(
            (F.size("p") == 5) & (F.col("p")[1] != ""),
            F.concat_ws("\t", F.get("p", F.lit(0)), user, F.get("p", F.lit(2)), F.get("p", F.lit(3)), F.get("p", F.lit(4))),
        )
        .otherwise(F.col("line"))
        .alias("line")
    )


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    spark = session()
    raw = new_path(spark, "copies-raw")
    table = new_path(spark, "copies-logs")
    copied_lines(derive.raw_lines(spark, sf_dir), copies).write.text(raw)
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        started = time.perf_counter()
        result = run()
        if isinstance(result, DataFrame):
            result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 2)

    timed("load", lambda: write_logs(latest(clicks(parsed_files(spark, raw))), table, partitions=partitions_for(spark, raw)))
    logs = read_logs(spark, table)
    win = in_window(logs, "09:00:00", "18:00:00")
    timed("load_stats", lambda: load_stats(read_raw(spark, raw)))
    timed("upsert_again", lambda: latest(clicks(parsed_files(spark, raw))))
    timed("search_first_100", lambda: search(logs, "query:click + rank:1-5"))
    timed("hits_hot_user", lambda: hits(logs, "user:hot"))
    timed("scan_time_range", lambda: scan_time_range(logs, "08:30:00", "08:40:00"))
    timed("search_summary", lambda: search_summary(logs, "query:click"))
    timed("top_queries", lambda: top_queries(win))
    timed("user_frequency", lambda: user_frequency(win))
    timed("domain_share", lambda: domain_share(win))
    timed("summary_report", lambda: summary_report(win, "09:00:00", "18:00:00"))

    def whole_report() -> None:
        with traffic_report(logs, "09:00:00", "18:00:00") as report:
            for part in report.values():
                part.write.format("noop").mode("overwrite").save()

    timed("report_all_parts", whole_report)
    files = [r.n for r in logs.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    print(
        json.dumps(
            {
                "copies": copies,
                "lines": spark.read.text(raw).count(),
                "stored": logs.count(),
                "hot_user": hits(logs, "user:hot").count(),
                "files": len(files),
                "rows_in_largest_file": max(files),
                "seconds": seconds,
            }
        )
    )


if __name__ == "__main__":
    main()

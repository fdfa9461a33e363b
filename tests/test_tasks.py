"""Task log analysis."""

import pytest

from clicktrail.operators import incomplete_tasks, parse_task_log, recent_operations, task_info
from clicktrail.sources import read_task_log

LOG = """\
2026-01-09 10:00:00|A_1|START|DATA_LOAD|file=f.tsv,zk=h:1,batch=5000,encoding=UTF-8
2026-01-09 10:00:05|A_1|SUCCESS|DATA_LOAD|ok
2026-01-09 10:01:00|B_2|START|SPARK_SEARCH|condition=user:a|b,zkQuorum=h
2026-01-09 10:02:00|C_3|START|CLEAN_TABLE|
2026-01-09 10:02:01|C_3|FAILURE|CLEAN_TABLE|refused
2026-01-09 10:02:02|D_4|START|CLEAN_TABLE
2026-01-09 10:02:03|D_4|START|CLEAN_TABLE|again
2026-01-09 10:02:04|E_5|START
stack trace line
"""
NEXT_DAY = "2026-01-10 00:00:01|B_2|SUCCESS|SPARK_SEARCH|ok\n2026-01-10 00:00:01|F_6|START|DATA_LOAD|x\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("task_logs")
    (where / "tasks_2026-01-09.log").write_text(LOG)
    (where / "tasks_2026-01-10.log").write_text(NEXT_DAY)
    (where / "notes.txt").write_text("2026-01-11 00:00:00|X|START|Y|z\n")
    return str(where)


def records(spark, folder, day=None):
    return parse_task_log(read_task_log(spark, folder, day))


def test_records(spark, folder):
    rows = records(spark, folder, "2026-01-09").orderBy("load_seq").drop("load_seq").collect()
    assert [tuple(r) for r in rows[2:4]] == [
        ("2026-01-09 10:01:00", "B_2", "START", "SPARK_SEARCH", "condition=user:a|b,zkQuorum=h"),
        ("2026-01-09 10:02:00", "C_3", "START", "CLEAN_TABLE", ""),
    ]
    assert [r.task_id for r in rows] == ["A_1", "A_1", "B_2", "C_3", "C_3", "D_4", "D_4"]
    assert records(spark, folder).count() == 9


def test_incomplete_tasks(spark, folder):
    one_day = incomplete_tasks(records(spark, folder, "2026-01-09")).orderBy("task_id").collect()
    assert [tuple(r) for r in one_day] == [
        ("B_2", 1, "2026-01-09 10:01:00", "SPARK_SEARCH", "condition=user:a|b,zkQuorum=h"),
        ("D_4", 2, "2026-01-09 10:02:02", "CLEAN_TABLE", ""),
    ]
    assert {r.task_id for r in incomplete_tasks(records(spark, folder)).collect()} == {"D_4", "F_6"}


def test_lines_that_end_after_the_status_do_not_count(spark):
    lines = ["t|A|START|X|", "t|A|SUCCESS||", "t|B|START||", "t|C|START||d", "t|C|FAILURE|X|"]
    df = parse_task_log(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))
    assert {r.task_id for r in incomplete_tasks(df, "line_no").collect()} == {"A"}


def test_task_info(spark, folder):
    all_records = records(spark, folder)
    assert tuple(task_info(all_records, "B_2").first()) == ("B_2", "SPARK_SEARCH", "condition=user:a|b,zkQuorum=h")
    assert tuple(task_info(all_records, "C_3").first()) == ("C_3", "CLEAN_TABLE", "")
    assert tuple(task_info(all_records, "D_4").first()) == ("D_4", "CLEAN_TABLE", "")
    assert task_info(all_records, "nobody").count() == 0


def test_recent_operations(spark, folder):
    lines = read_task_log(spark, folder)
    # A text line sorts above all times, but makes no record.
    recent = [(r.task_id, r.status) for r in recent_operations(lines, 4).collect()]
    assert len(recent) == 4 and recent[:2] == [("B_2", "SUCCESS"), ("F_6", "START")]
    assert len(recent_operations(lines, 100).collect()) == 9
    # Where lines are picked first, such lines take some of the places.
    early = recent_operations(lines, 4, lines_first=True).collect()
    assert [(r.task_id, r.status) for r in early] == [("B_2", "SUCCESS"), ("F_6", "START")]


def test_a_stack_trace_hides_no_operation(spark):
    texts = [f"2026-03-04 05:06:0{i}|T_{i}|START|X|" for i in range(5)] + [f"trace {i}" for i in range(10)]
    lines = spark.createDataFrame(list(enumerate(texts)), "load_seq int, line string")
    assert [r.task_id for r in recent_operations(lines, 5).collect()] == [f"T_{i}" for i in (4, 3, 2, 1, 0)]

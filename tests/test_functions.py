"""Column functions against rows worked out by hand."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktrail.functions import (
    extract_domain,
    in_time_window,
    java_hash,
    normalize_time,
    params_to_map,
    reverse_ts,
    row_key,
    salt,
    salt_of,
    time_to_ms,
    trim_control,
)


def column_of(spark, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, v {kind}")


def apply(spark, expression, values, kind="string"):
    out = column_of(spark, values, kind).select("i", expression.alias("r")).orderBy("i").collect()
    return [row.r for row in out]


DOMAINS = {
    "http://shop.acme.com/rooms?id=3": "acme",
    "news.acme.com:8080/x": "acme",
    "HTTP://WWW.ACME.COM/": "ACME",
    "http://www.acme.com./": "acme",
    "http://user@www.acme.com/": "acme",
    "http://192.168.1.1/": "1",
    "http://shop.x.co.uk/": "co",
    "http://localhost/": "localhost",
    "http://localhost./": "localhost.",
    "localhost:80": "localhost",
    # No parsable host.
    "http://foo_bar.acme.com/x": "acme",
    "foo_bar.acme.com./x": "acme",
    "http://a.com/x|y": "a",
    "http://www.com/a b": "com",
    "http://中文.com/a": "中文",
    "http://www.中文.com/a": "中文",
    "ftp://h_x.com/a": "ftp:",
    "http:///p": "http:",
    "http://": "http:",
    "a_..b/": "",
    "..../x y": "....",
    "": "",
    " \t": "",
    None: "",
}


def test_extract_domain(spark):
    assert apply(spark, extract_domain("v"), list(DOMAINS)) == list(DOMAINS.values())


# Hash and bucket as the JVM gives them.
HASHES = {
    "user1": (111578566, 6),
    "user123": (-147178873, 9),
    "旅游": (835859, 3),
    "😀a": (54959966, 14),
    "polygenelubricants": (-2147483648, 0),
    "": (0, 0),
}


def test_java_hash_and_salt(spark):
    assert apply(spark, java_hash("v"), list(HASHES)) == [h for h, _ in HASHES.values()]
    assert apply(spark, salt("v"), list(HASHES)) == [s for _, s in HASHES.values()]
    assert [salt_of(u) for u in HASHES] == [s for _, s in HASHES.values()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=20, max_size=60))
def test_salt_of_a_literal_equals_the_column(spark, users):
    assert apply(spark, salt("v"), users) == [salt_of(u) for u in users]


TIMES = {
    "00:00:01": 1000,
    "25:99:99": 96_039_000,
    "12:30:00:": 45_000_000,
    "12:30:00:::": 45_000_000,
    "9:5:7": 32_707_000,
    "+1:00:00": 3_600_000,
    "-1:00:00": -3_600_000,
    " 00:00:01\t": 1000,
    "12: 30:00": None,
    "12:30": None,
    "12:30:00:1": None,
    "::": None,
    "99999999999:00:00": None,
    "1２:00:00": 43_200_000,
    "": None,
}


def test_time_to_ms(spark):
    assert apply(spark, time_to_ms("v"), list(TIMES)) == list(TIMES.values())


def test_reverse_ts(spark):
    assert apply(spark, reverse_ts("v"), [0, 1000, 96_039_000, -3_600_000, 9_223_372_036_854_775_800], "bigint") == [
        "9223372036854775807",
        "9223372036854774807",
        "9223372036758736807",
        "-9223372036851175809",
        "0000000000000000007",
    ]


def test_row_key(spark):
    df = spark.createDataFrame([("user1", 1000, "acme"), ("旅游", 0, "")], "u string, t bigint, d string")
    keys = [r[0] for r in df.select(row_key(salt("u"), "t", "u", "d")).collect()]
    assert keys == ["06|9223372036854774807#user1#acme", "03|9223372036854775807#旅游#"]


@pytest.mark.parametrize(
    ("text", "normal"),
    [("00:00:01", "00:00:01"), ("25:00:00", "01:00:00"), ("00:99:00", "01:39:00"), (" 9:5:7: ", "09:05:07"), ("-1:00:00", "23:00:00")],
)
def test_normalize_time(text, normal):
    assert normalize_time(text) == normal


@pytest.mark.parametrize("text", ["xx:00:00", "12:30", "", "1:2:3:4", "99999999999:0:0"])
def test_normalize_time_refuses(text):
    with pytest.raises(ValueError):
        normalize_time(text)


CLOCK = ["09:00:00", "9:00:00", "17:59:59", "18:00:00", "18:00:01", "24:00:00", "25:00:00", "00:00:00", " 10:00:00 ", "10:00:00 ", "", None]


@pytest.mark.parametrize(
    ("start", "end", "inside"),
    [
        ("09:00:00", "18:00:00", {"09:00:00", "17:59:59", "18:00:00", " 10:00:00 "}),
        ("00:00:00", "00:00:00", {"24:00:00", "00:00:00"}),
        ("24:00:00", "00:00:01", {"24:00:00", "00:00:00"}),
        ("18:00:00", "09:00:00", set()),
        ("9:00:00", "18:00:00", set()),
        ("00:00:00", "25:00:00", set()),
    ],
)
def test_in_time_window(spark, start, end, inside):
    assert apply(spark, in_time_window("v", start, end), CLOCK) == [t in inside for t in CLOCK]


def test_trim_control(spark):
    values = ["a", " a", "a\x01", "\x00\x1f a b \t", "  ", "", "　a", None]
    assert apply(spark, trim_control("v"), values) == ["a", "a", "a", "a b", "", "", "　a", None]


def test_params_to_map(spark):
    values = ["file=f.tsv,zk=h:1, batch = 5000 ,encoding=UTF-8", "a=1,b,a=2,=x,c=d=e,f=", "", None, "x"]
    assert apply(spark, params_to_map("v"), values) == [
        {"file": "f.tsv", "zk": "h:1", "batch": "5000", "encoding": "UTF-8"},
        {"a": "2", "": "x", "c": "d=e", "f": ""},
        {},
        {},
        {},
    ]


def test_functions_take_columns(spark):
    row = spark.range(1).select(extract_domain(F.lit("http://a.b.c/")), salt(F.lit("user1")), time_to_ms(F.lit("00:00:01"))).first()
    assert tuple(row) == ("b", 6, 1000)

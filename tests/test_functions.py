from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import score as sc
from millrace.functions import text as tx
from millrace.functions import url as ur


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_company_names(spark):
    got = one(spark, tx.company_name(F.col("v")), "  VELLOR, Inc. ", "Vellor and Company", "Vellor Co. Ltd", "Inc", None, "Ｂａｒ　Ltd", "Éinc", "Foo & Bar LLC")
    assert got == ["vellor", "vellor", "vellor", "", None, "bar", "é", "foo and bar"]


def test_role_names(spark):
    got = one(spark, tx.role_name(F.col("v")), "Snr. Back End Engineer", "Jr Crane Operator", None, "Lead backend software engineer", "C++ / C# Dev")
    assert got == ["senior backend engineer", "junior crane operator", "", "lead backend engineer", "c++ c# dev"]


def test_space_is_the_wide_class(spark):
    assert one(spark, tx.collapsed(F.col("v")), "﻿ a b\n c　") == ["a b c"]


def test_tokens_and_jaccard(spark):
    assert one(spark, tx.tokens(F.col("v")), "Find the Senior C++ roles, and C# in Oslo a b") == [["senior", "c++", "roles", "c#", "oslo"]]
    df = spark.createDataFrame([("a b c", "b c d"), ("", ""), ("a", "")], "x string, y string")
    assert [r[0] for r in df.select(tx.jaccard(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0, 0.0]


def test_csv_fields(spark):
    assert one(spark, tx.csv_field(F.col("v")), "a,b", 'say "x"', "=1+1", "\t-2", "@x", None, "line\nend") == ['"a,b"', '"say ""x"""', "'=1+1", "'\t-2", "'@x", "", '"line\nend"']


def test_readable_keeps_first_of_equal_lines(spark):
    assert one(spark, tx.readable(F.col("v")), "A  b\n\na B\n c \n", "", None) == ["A b\nc", "", None]


def test_negative_and_restricted(spark):
    assert one(spark, tx.negative(F.col("v")), "a hiring freeze now", "hiring freezer", "no longer hiring") == [True, False, True]
    assert one(spark, tx.restricted(F.col("v")), "Please solve the CAPTCHA", "all fine") == [True, False]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("https://Q.example/w?utm_medium=y&k=2&c=1#top", "https://q.example/w?c=1&k=2"),
        (" HTTPS://Q.Example:443/w?z=9&b=1#end ", "https://q.example/w?b=1&z=9"),
        ("http://x.example", "http://x.example/"),
        ("http://x.example/a/../b/./c/..", "http://x.example/b/"),
        ("http://x.example:8080/a?ref=1", "http://x.example:8080/a"),
        ("ftp://x.example/", None),
        ("www.x.example", None),
        ("https://user:pw@x.example/", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_addresses(spark, given, expected):
    assert one(spark, ur.canonical(F.col("v")), given) == [expected]


def test_domains_and_hosts(spark):
    df = spark.createDataFrame([("https://www.ACME.example/", "https://jobs.example/a"), (None, "https://www.jobs.example/a"), ("acme.example", "https://jobs.example/a")], "w string, s string")
    assert [r[0] for r in df.select(ur.domain(F.col("w"), F.col("s"))).collect()] == ["acme.example", "jobs.example", "jobs.example"]
    assert one(spark, ur.private_host(F.col("v")), "10.0.0.1", "8.8.8.8", "172.20.1.1", "localhost", "::1", "example.org", "256.0.0.1") == [True, False, True, True, True, False, False]


def test_links(spark):
    df = spark.createDataFrame([("/a#x",), ("mailto:x@y",), ("https://b.example/c#d",), ("javascript:void",), (None,), ("next?x=1",), ("../up/./b",), ("/x/../y/..",), ("#top",)], "v string")
    assert [r[0] for r in df.select(ur.absolute_link(F.col("v"), F.lit("https://a.example/d/p"))).collect()] == ["https://a.example/a", None, "https://b.example/c", None, None, "https://a.example/d/next?x=1", "https://a.example/up/b", "https://a.example/", None]


@pytest.mark.parametrize(("days", "expected"), [(-5, 1.0), (30, 1.0), (31, 0.8), (90, 0.8), (91, 0.6), (180, 0.6), (365, 0.4), (366, 0.2), (None, 0.5)])
def test_freshness(spark, days, expected):
    now = datetime(2026, 6, 3)
    from datetime import timedelta

    at = None if days is None else now - timedelta(days=days)
    assert one(spark, sc.freshness(F.col("v"), F.lit(now).cast("timestamp")), at, schema="v timestamp") == [expected]


def test_rounding_is_half_up_and_clamp_keeps_null(spark):
    assert one(spark, sc.rounded(F.col("v")), 0.1234565, 2.5e-7, schema="v double") == [0.123457, 0.0]
    assert one(spark, sc.clamped(F.col("v")), 1.5, -1.0, None, schema="v double") == [1.0, 0.0, None]


def test_credibility_branches(spark):
    rows = [(0.3, "w", "a.example", "https://a.example/x"), (None, "w", "a.example", "https://www.a.example/x"), (None, None, "a.example", "https://a.example/x"), (None, "w", "b.example", "http://a.example/x")]
    df = spark.createDataFrame(rows, "c double, w string, d string, u string")
    assert [r[0] for r in df.select(sc.credibility(F.col("c"), F.col("w"), F.col("d"), F.col("u"))).collect()] == [0.3, 0.9, 0.7, 0.5]


def test_durations_and_outcomes(spark):
    assert one(spark, rules.duration_text(F.col("v")), 999, 59_999, 65_000, 3_600_000, 7_260_000, schema="v bigint") == ["0s", "59s", "1m 5s", "1h 0m", "2h 1m"]
    got = one(spark, rules.http_outcome(F.col("v")), 200, 408, 429, 503, 403, 404, None, schema="v int")
    assert [None if g is None else (g.code, g.retryable, g.blocked) for g in got] == [
        None, ("REQUEST_TIMEOUT", True, False), ("RATE_LIMITED", True, False), ("HTTP_SERVER_ERROR", True, False), ("ACCESS_RESTRICTED", False, True), ("HTTP_CLIENT_ERROR", False, False), None,
    ]


def test_progress(spark):
    df = spark.createDataFrame([(0, 0, 0), (3, 1, 1), (3, 3, 0), (3, 0, 3), (3, 2, 1)], "t int, s int, f int")
    assert [r[0] for r in df.select(rules.progress_status(F.col("t"), F.col("s"), F.col("f"))).collect()] == ["RUNNING", "RUNNING", "COMPLETED", "FAILED", "PARTIAL"]

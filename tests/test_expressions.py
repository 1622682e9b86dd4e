"""Cleaning, channel and time expressions on literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopgrain.functions import channel, text
from shopgrain.functions.metrics import pct, ratio
from shopgrain.functions.timebucket import Span, period, yearweek
from tests.conftest import one, rows, ts


def test_tags_ignore_case_and_blanks(shop):
    got = {r["s"] for r in rows(shop.sessions.select(text.tag("utm_source").alias("s")))}
    assert got == {"gsearch", None, "", "socialbook", "otherads", "bsearch"}


def test_referer_null_empty_and_blank_are_one(shop):
    got = {
        r["website_session_id"]: r["r"]
        for r in rows(shop.sessions.select("website_session_id", text.referer().alias("r")))
    }
    assert got[7] == got[8] == "" and got[2] == "https://www.gsearch.com"


def test_channel_labels(shop):
    got = {
        r["website_session_id"]: r["c"]
        for r in rows(shop.sessions.select("website_session_id", channel.label().alias("c")))
    }
    assert got[2] == "gsearch_nonbrand" and got[6] == "organic"
    assert got[7] == got[8] == "direct"
    assert got[9] == "other"  # an empty source is neither missing nor known
    assert got[11] == got[12] == "paid_brand"  # brand of any source


def test_brand_of_unlisted_source_is_in_no_split_channel(shop):
    six = shop.sessions.where("website_session_id = 11").select(
        channel.label(channel.six_channels()).alias("c")
    )
    assert one(six)["c"] == "other"


def test_scope_keeps_missing_sources(shop):
    kept = {r["website_session_id"] for r in rows(shop.sessions.where(channel.in_scope()))}
    assert kept == set(range(1, 14)) - {10}


@pytest.mark.parametrize(
    ("day", "week"),
    [
        ("2012-06-16", 201224),
        ("2012-06-17", 201225),
        ("2012-07-28", 201230),
        ("2012-07-29", 201231),
        ("2012-08-05", 201232),
        ("2013-01-01", 201253),
        ("2013-01-06", 201301),
    ],
)
def test_weeks_start_on_sunday(spark, day, week):
    df = spark.createDataFrame([(ts(day),)], "created_at timestamp_ntz")
    assert one(df.select(yearweek().alias("w")))["w"] == week


def test_closed_end_stops_at_midnight(spark):
    times = ["2013-09-24 00:00:00", "2013-09-24 00:00:01", "2013-09-25 00:00:00"]
    df = spark.createDataFrame([(ts(t),) for t in times], "created_at timestamp_ntz")
    spans = {
        "before": Span.inclusive("2013-08-25", "2013-09-24"),
        "after": Span.inclusive("2013-09-25", "2013-10-24"),
    }
    got = [r["p"] for r in rows(df.select(period(spans).alias("p"), "created_at").orderBy("created_at"))]
    assert got == ["before", None, "after"]


def test_open_start(spark):
    df = spark.createDataFrame(
        [(ts("2012-07-28"),), (ts("2012-07-28 00:00:01"),)], "created_at timestamp_ntz"
    )
    kept = rows(df.where(Span("2012-07-28", start_open=True).holds()))
    assert [r["created_at"] for r in kept] == [dt.datetime(2012, 7, 28, 0, 0, 1)]


def test_month_span_crosses_year():
    assert Span.of_month(2014, 12) == Span("2014-12-01", "2015-01-01")
    assert Span.of_month(2015, 2) == Span("2015-02-01", "2015-03-01")


def test_ratios_are_guarded(spark):
    df = spark.createDataFrame([(1, 0), (1, 8)], "n bigint, d bigint")
    got = [(r["p"], r["q"]) for r in rows(df.select(pct("n", "d").alias("p"), ratio("n", "d", 2).alias("q")))]
    assert got == [(None, None), (12.5, 0.13)]


def test_untrimmed_ignores_nulls(shop):
    dirty = shop.sessions.where(text.untrimmed("utm_source", "utm_campaign", "device_type"))
    assert {r["website_session_id"] for r in rows(dirty)} == {2, 3, 4}
    assert shop.sessions.where(F.col("http_referer") != F.trim("http_referer")).count() == 2

"""The stored baseline: deliveries add up, weekdays are compared, planted days are found."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.registry import QUERIES
from shopgrain.plans import baseline
from tests.conftest import rows

SCHEMA = "created_at timestamp_ntz, price_usd decimal(18,2)"


def _orders(spark, counts: dict[str, int], price="10"):
    text = [(f"{day} 12:00:00", price) for day, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(text, "t string, p string")
    return df.select(F.col("t").cast("timestamp_ntz").alias("created_at"), F.col("p").cast("decimal(18,2)").alias("price_usd"))


def test_deliveries_add_up_and_replace_themselves(spark, tmp_path):
    folder = str(tmp_path / "base")
    baseline.update(_orders(spark, {"2024-01-01": 3, "2024-01-02": 1}), folder, "a")
    baseline.update(_orders(spark, {"2024-01-02": 2}, price=None), folder, "b")
    baseline.update(_orders(spark, {"2024-01-02": 4}, price="30"), folder, "b")
    got = {r["day"]: r for r in rows(baseline.daily(spark, folder))}
    second = got[dt.date(2024, 1, 2)]
    assert len(got) == 2 and second["n_rows"] == 5 and second["null_price_pct"] == 0
    assert (second["min_price"], second["max_price"], second["avg_price"]) == (10, 30, 26)


def test_days_are_held_against_their_weekday(spark, tmp_path):
    folder, counts = str(tmp_path / "base"), {}
    for n in range(10 * 7):  # Mondays have ten orders, other days two
        day = dt.date(2024, 1, 1) + dt.timedelta(days=n)
        counts[day.isoformat()] = 10 if day.weekday() == 0 else 2
    counts["2024-03-05"] = 10  # a Tuesday like a Monday
    baseline.update(_orders(spark, counts), folder, "all")
    got = rows(baseline.compare(baseline.daily(spark, folder), weeks=4, least=2))
    assert {(r["day"].isoformat(), r["metric"]) for r in got if r["flagged"]} == {("2024-03-05", "n_rows")}
    tuesday = next(r for r in got if r["day"].isoformat() == "2024-03-05" and r["metric"] == "n_rows")
    assert (tuesday["value"], tuesday["baseline"], tuesday["n_days"]) == (10, 2, 4)
    assert not any(r["flagged"] for r in got if r["n_days"] < 2)


def test_missing_times_and_empty_deliveries(spark, tmp_path):
    folder = str(tmp_path / "base")
    baseline.update(spark.createDataFrame([(None, None)], SCHEMA), folder, "lost")
    baseline.update(spark.createDataFrame([], SCHEMA), folder, "none")
    assert [r["n_rows"] for r in rows(baseline.daily(spark, folder))] == [1]
    assert baseline.compare(baseline.daily(spark, folder)).count() == 0


@pytest.mark.parametrize("day, metric", [("1999-03-10", "n_rows"), ("1999-05-20", "null_price_pct"), ("1999-05-20", "avg_price")])
def test_planted_days_are_found(spark, day, metric):
    found = QUERIES["v3_stored_baseline"](spark, "/root/testdata/sf0.01")
    row = found.where((F.col("day") == day) & (F.col("metric") == metric)).first()
    assert row["flagged"] and row["n_days"] >= 4

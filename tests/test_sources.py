"""Loading, previews, export, views and the ingestion stream."""

import pytest
from pyspark.sql import functions as F

from shopgrain import schemas
from shopgrain.operators import grain, keys
from shopgrain.plans import growth
from shopgrain.session import work_folder
from shopgrain.sources import tables
from shopgrain.streaming.intake import run_intake
from tests.conftest import one, rows


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, shop, tmp_path, fmt):
    for name in ("orders", "website_sessions"):
        tables.export(shop.named()[name], str(tmp_path / name), fmt)
    back = tables.read_shop(spark, str(tmp_path), fmt)
    assert back.orders.schema.simpleString() == schemas.ORDERS.simpleString()
    assert back.orders.exceptAll(shop.orders).count() == 0
    assert back.sessions.exceptAll(shop.sessions).count() == 0
    assert back.sessions.where("utm_source = ''").count() == 1


def test_load_once_keeps_first_row(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "c"), (1, 3, "a"), (2, 9, None)], "id int, at int, x string")
    got = sorted(tuple(r.values()) for r in rows(tables.load_once(df, ["id"], ["at"])))
    assert got == [(1, 3, "a"), (2, 9, None)]
    only_keys = tables.load_once(df.select("id"), ["id"])
    assert only_keys.count() == 2


def test_reading_a_shop_skips_rows_whose_key_is_there(spark, shop, tmp_path):
    for name, df in shop.named().items():
        tables.export(df.unionByName(df), str(tmp_path / name), "parquet")
    clean = tables.read_shop(spark, str(tmp_path))
    assert clean.sessions.count() == shop.sessions.count()
    assert rows(growth.conversion_rate(clean.sessions, clean.orders)) == rows(
        growth.conversion_rate(shop.sessions, shop.orders)
    )
    stored = tables.read_shop(spark, str(tmp_path), unique=True)
    assert stored.sessions.count() == 2 * shop.sessions.count()


def test_preview_and_views(spark, shop):
    assert [r["website_session_id"] for r in rows(tables.preview(shop.sessions, ["website_session_id"]))] == [1, 2, 3, 4, 5]
    shop.register_views()
    got = spark.sql(
        "SELECT count(DISTINCT o.order_id) AS n FROM website_sessions s "
        "LEFT JOIN orders o ON s.website_session_id = o.website_session_id AND o.price_usd > 0"
    )
    assert one(got)["n"] == 4


def test_entry_page_forms_agree(shop):
    pages = ["/home", "/lander-1"]
    cols = ["website_session_id", "entry_page", "entered_at", "n_views"]
    general = grain.entry_page(shop.pageviews).where(F.col("entry_page").isin(pages)).select(*cols)
    special = grain.entered_on(shop.pageviews, pages).select(*cols)
    assert general.exceptAll(special).count() == 0 and special.exceptAll(general).count() == 0


def test_orphans_include_null_keys(spark):
    child = spark.createDataFrame([(1,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert {r["k"] for r in rows(keys.orphans(child, parent, "k"))} == {9, None}


def test_work_folder_follows_the_session():
    class Session:
        def __init__(self, **settings):
            self.conf = self
            self.settings = settings

        def get(self, key, default=None):
            return self.settings.get(key, default)

    shared = {"spark.checkpoint.dir": "hdfs:///shared/", "spark.sql.warehouse.dir": "hdfs:///house"}
    assert work_folder(Session(**shared), "x").startswith("hdfs:///shared/x-")
    del shared["spark.checkpoint.dir"]
    assert work_folder(Session(**shared), "x").startswith("hdfs:///house/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session(), "x")
    own = {"spark.sql.warehouse.dir": "file:/home/driver/spark-warehouse"}
    assert work_folder(Session(**own, **{"spark.master": "local[4]"}), "x").startswith("file:/home")
    with pytest.raises(ValueError, match="not shared"):
        work_folder(Session(**own, **{"spark.master": "yarn"}), "x")


def test_stream_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = run_intake(spark, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["id"], folder=str(tmp_path / "run"))
    assert run.progress.endswith("/progress")


SCHEMA = "id bigint, created_at timestamp_ntz, price_usd decimal(18,2), utm_source string"


def _batch(spark, folder, data):
    df = spark.createDataFrame([(*row, " GSearch") for row in data], "id bigint, t string, p string, utm_source string")
    time, price = F.col("t").cast("timestamp_ntz"), F.col("p").cast("decimal(18,2)")
    df.select("id", time.alias("created_at"), price.alias("price_usd"), "utm_source").coalesce(1).write.mode(
        "append"
    ).parquet(folder)


def test_stream_logs_every_reject_with_its_reason(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "run")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        return run_intake(spark, stream, ["id"], folder=base)

    copies = [(1, "2024-01-01 10:00:00", "5")] * 3000
    _batch(spark, src, [*copies, (2, "2024-01-01 10:05:00", "0"), (None, "2024-01-01 10:00:00", "1")])
    run()
    # A repeat in a later batch and after a restart; null keys are one key.
    _batch(spark, src, [(1, "2024-01-01 10:10:00", "5"), (3, "2024-01-01 14:00:00", None), (4, "2024-01-01 14:00:00", "-1")])
    run()
    _batch(spark, src, [(5, "2024-01-01 09:00:00", "7"), (6, "2024-01-01 14:30:00", "7"), (None, None, "7"), (7, None, "7")])
    last = run()
    accepted = rows(spark.read.parquet(last.accepted))
    assert sorted((r["id"] is None, r["id"] or 0) for r in accepted) == [(False, i) for i in (1, 3, 6, 7)] + [(True, 0)]
    assert {r["utm_source"] for r in accepted} == {"gsearch"}
    rejected = rows(spark.read.parquet(last.rejected).groupBy("reason", "id").count())
    assert {(r["reason"], r["id"], r["count"]) for r in rejected} == {
        ("bad_price", 2, 1), ("bad_price", 4, 1), ("late", 5, 1), ("key_exists", 1, 3000), ("key_exists", None, 1),
    }
    assert sum(r["n_rows"] for r in rows(spark.read.parquet(last.progress))) == len(accepted) + 3004


def test_stream_remembers_keys_without_its_outputs(spark, tmp_path):
    """Earlier outputs may be moved away: what was accepted is known from the state."""
    src, base = str(tmp_path / "in"), str(tmp_path / "run")
    seen = []
    for n in range(4):
        _batch(spark, src, [(n, f"2024-01-0{n + 1} 10:00:00", "5"), (None if n else 50, f"2024-01-0{n + 1} 10:00:00", "1"), (0, f"2024-01-0{n + 1} 11:00:00", "2")])
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        run = run_intake(spark, stream, ["id"], folder=base)
        accepted, rejected = rows(spark.read.parquet(run.accepted)), rows(spark.read.parquet(run.rejected))
        seen += [r["id"] for r in accepted]
        assert {(r["reason"], r["id"]) for r in rejected} <= {("key_exists", 0), ("key_exists", None)}
        assert len(accepted) + len(rejected) == 3
        for part in ("accepted", "rejected"):
            (tmp_path / "run" / part).rename(tmp_path / f"{part}-{n}")
    assert sorted(i for i in seen if i is not None) == [0, 1, 2, 3, 50] and seen.count(None) == 1
    # Of the first query's clock, only the last value is read.
    assert [r["n_rows"] for r in rows(spark.read.parquet(run.progress))] == [3] * 4


def test_stream_judges_many_batches_at_once_without_a_call_per_key(spark, tmp_path, monkeypatch):
    """Batches that wait together: the least one has the first row, also where one is empty."""
    from pyspark.sql import GroupedData

    def called(*_, **__):
        raise AssertionError("Python is called for each key")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", called)
    src, base = str(tmp_path / "in"), str(tmp_path / "run")
    at = "2024-01-01 10:00:00"
    runs = [
        [[(1, at, "1"), (2, at, "1")], [(3, at, "0")], [(2, at, "2"), (None, at, "2"), (1, at, "2")]],
        [[(9, at, "-1")]],
        [[(1, at, "3"), (None, at, "3")], [(4, at, "3"), (4, at, "4")]],
    ]
    for waiting in runs:
        for data in waiting:
            _batch(spark, src, data)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        run = run_intake(spark, stream, ["id"], folder=base)
    accepted = rows(spark.read.parquet(run.accepted))
    assert sorted((str(r["id"]), int(r["price_usd"])) for r in accepted) == [("1", 1), ("2", 1), ("4", 3), ("None", 2)]
    rejected = rows(spark.read.parquet(run.rejected))
    assert sorted((r["reason"], str(r["id"]), int(r["price_usd"])) for r in rejected) == [
        ("bad_price", "3", 0), ("bad_price", "9", -1), ("key_exists", "1", 2), ("key_exists", "1", 3),
        ("key_exists", "2", 2), ("key_exists", "4", 4), ("key_exists", "None", 3),
    ]

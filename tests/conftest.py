from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shopgrain import schemas  # noqa: E402
from shopgrain.session import build_session  # noqa: E402
from shopgrain.sources.tables import Shop  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(
        "local[8]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def usd(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


G, B = "https://www.gsearch.com", "https://www.bsearch.com"

SESSIONS = [
    (1, "2012-03-20 10:00:00", 1, 0, "gsearch", "nonbrand", "desktop", G),
    (2, "2012-06-16 09:00:00", 2, 0, "Gsearch", "NonBrand ", "Desktop", f" {G}"),
    (3, "2012-06-17 09:00:00", 3, 0, " gsearch", "nonbrand", "mobile", G),
    (4, "2012-07-28 00:00:00", 4, 0, "gsearch", "nonbrand", "mobile ", G),
    (5, "2012-07-28 10:00:00", 5, 0, "gsearch", "nonbrand", "desktop", G),
    (6, "2012-08-06 12:00:00", 1, 1, None, None, "desktop", B),
    (7, "2012-08-07 12:00:00", 2, 1, None, None, "desktop", "  "),
    (8, "2012-08-08 12:00:00", 6, 0, None, None, "mobile", None),
    (9, "2012-08-09 12:00:00", 7, 0, "", None, "desktop", None),
    (10, "2012-08-10 12:00:00", 8, 0, "socialbook", "pilot", "desktop", None),
    (11, "2012-08-11 12:00:00", 9, 0, "otherads", "brand", "desktop", None),
    (12, "2012-08-12 12:00:00", 9, 1, "bsearch", "brand", "desktop", B),
    (13, "2012-08-13 12:00:00", 10, 0, "gsearch", "nonbrand", "desktop", G),
]
PAGES = {
    1: ["/home"],
    2: ["/lander-1", "/Products", "/item-1", "/Cart", "/cart", "/billing", "/thank-you-for-your-order"],
    3: ["/lander-1"],
    4: ["/Lander-1"],
    5: ["/home", "/lander-1"],
    13: ["/lander-1", "/billing", "/billing", "/billing-2"],
}
ORDERS = [
    (101, 2, 2, "50.00", "20.00"),
    (102, 5, 5, "0.00", "0.00"),
    (103, 6, 1, "60.00", "24.00"),
    (104, 13, 10, "40.00", "16.00"),
    (105, 12, 9, "-59.99", "-22.49"),
    (106, 7, 2, "30.00", "12.00"),
    (107, 8, 6, None, "1.00"),
]
ITEMS = [
    (1, 101, 1, 1, "50.00", "20.00"),
    (2, 101, 2, 0, "10.00", "4.00"),
    (3, 101, 2, 0, "12.00", "5.00"),
    (4, 103, 1, 1, "60.00", "24.00"),
    (5, 103, 99, 0, "5.00", "2.00"),
    (6, 104, 99, 1, "40.00", "16.00"),
]
REFUNDS = [(1, 1), (2, 1), (3, 6)]


@pytest.fixture(scope="session")
def shop(spark) -> Shop:
    """The hand-made shop; expected figures in the tests are worked out by hand."""
    start = {row[0]: ts(row[1]) for row in SESSIONS}
    views, n = [], 0
    for session, pages in PAGES.items():
        for i, page in enumerate(pages):
            n += 1
            early = dt.timedelta(minutes=1 if session == 3 else 0)
            views.append((n, start[session] + dt.timedelta(minutes=i) - early, session, page))
    order_time = {o[0]: start[o[1]] + dt.timedelta(minutes=20) for o in ORDERS}
    rows = {
        "website_sessions": [(r[0], ts(r[1]), *r[2:]) for r in SESSIONS],
        "website_pageviews": views,
        "orders": [(o, order_time[o], s, u, 1, usd(p), usd(c)) for o, s, u, p, c in ORDERS],
        "order_items": [
            (i, order_time[o], o, p, main, usd(price), usd(cost))
            for i, o, p, main, price, cost in ITEMS
        ],
        "order_item_refunds": [(r, ts("2012-09-01"), i) for r, i in REFUNDS],
        "products": [(1, "one"), (2, "two"), (3, "three")],
    }
    frames = {
        name: spark.createDataFrame(rows[name], schema).cache()
        for name, schema in schemas.TABLES.items()
    }
    return Shop(frames.__getitem__)


def rows(df) -> list[dict]:
    return [
        {k: float(v) if isinstance(v, Decimal) else v for k, v in r.asDict().items()}
        for r in df.collect()
    ]


def one(df) -> dict:
    (row,) = rows(df)
    return row

"""SQL statements that DuckDB runs on the given tables, one per registered query.

They are written at row level, with joins that multiply rows and DISTINCT
counts, so that they check the session-grain plans by another route.
"""

from __future__ import annotations

# --- the logical tables as common table expressions --------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


_cte(
    "ev",
    """
    SELECT event_id, ts, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           user_id * 100000 + date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS sid,
           ts + to_days(CAST(
               date_diff('day', DATE '2024-01-01', DATE '2012-03-19')
               + (36 * CASE user_id % 5 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 1 END - 1)
                 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))
               + CASE user_id % 5 WHEN 3 THEN 690 ELSE 0 END
               + (user_id * 7 + 5 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) % 36
               AS INTEGER)) AS seen_at
    FROM events""",
)
_cte(
    "visit",
    """
    SELECT sid, min(user_id) AS user_id, min(seen_at) AS started, arg_min(k, event_id) AS k
    FROM ev GROUP BY sid""",
    "ev",
)
_cte(
    "raw_tags",
    """
    SELECT *,
      CASE WHEN k < 45 THEN 'gsearch' WHEN k < 55 THEN 'bsearch' WHEN k < 61 THEN 'gsearch'
           WHEN k < 65 THEN 'bsearch' WHEN k < 70 THEN 'socialbook' WHEN k < 72 THEN 'otherads'
           WHEN k < 73 THEN '' END AS so,
      CASE WHEN k = 83 THEN 'brand' WHEN k < 55 THEN 'nonbrand' WHEN k < 65 THEN 'brand'
           WHEN k < 70 THEN 'pilot' WHEN k < 72 THEN 'brand' END AS ca,
      CASE WHEN (user_id + k) % 10 < 7 THEN 'desktop' ELSE 'mobile' END AS dv
    FROM visit""",
    "visit",
)
_cte(
    "raw_referer",
    """
    SELECT *,
      CASE WHEN k = 72 THEN NULL
           WHEN so IS NOT NULL THEN 'https://www.' || so || '.com'
           WHEN k < 87 AND k % 2 = 0 THEN 'https://www.gsearch.com'
           WHEN k < 87 THEN 'https://www.bsearch.com'
           WHEN k < 92 THEN NULL WHEN k < 96 THEN '' ELSE '  ' END AS rf
    FROM raw_tags""",
    "raw_tags",
)
_cte(
    "website_sessions",
    """
    SELECT sid AS website_session_id,
      CASE WHEN k % 50 = 7 THEN started + INTERVAL 3 MINUTE
           WHEN k % 50 = 9 THEN TIMESTAMP '2014-06-01' ELSE started END AS created_at,
      user_id,
      CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY sid) > 1 THEN 1 ELSE 0 END
        AS is_repeat_session,
      CASE k % 10 WHEN 1 THEN upper(so[1]) || so[2:] WHEN 2 THEN upper(so) WHEN 3 THEN ' ' || so
                  ELSE so END AS utm_source,
      CASE k % 10 WHEN 4 THEN upper(ca) WHEN 5 THEN ca || ' ' ELSE ca END AS utm_campaign,
      CASE k % 10 WHEN 6 THEN upper(dv[1]) || dv[2:] WHEN 7 THEN dv || ' ' ELSE dv END
        AS device_type,
      CASE WHEN k % 10 = 8 THEN ' ' || rf ELSE rf END AS http_referer
    FROM raw_referer""",
    "raw_referer",
)
_cte(
    "website_pageviews",
    """
    SELECT event_id AS website_pageview_id, seen_at AS created_at, sid AS website_session_id,
      CASE event_type
        WHEN 'view' THEN CASE WHEN k < 45 THEN '/home' WHEN k < 90 THEN '/lander-1'
                              ELSE '/Home' END
        WHEN 'click' THEN CASE WHEN k < 20 THEN '/lander-1' WHEN k < 35 THEN '/home'
                               WHEN k < 65 THEN '/products' WHEN k < 68 THEN '/Products'
                               WHEN k < 78 THEN '/item-1' WHEN k < 86 THEN '/item-2'
                               WHEN k < 93 THEN '/item-3' ELSE '/Item-4' END
        WHEN 'signup' THEN CASE WHEN k < 25 THEN '/item-1' WHEN k < 40 THEN '/item-2'
                                WHEN k < 75 THEN '/cart' WHEN k < 80 THEN '/Cart'
                                ELSE '/shipping' END
        WHEN 'error' THEN CASE WHEN k < 45 THEN '/billing' WHEN k < 90 THEN '/billing-2'
                               ELSE '/shipping' END
        WHEN 'purchase' THEN '/thank-you-for-your-order' END AS pageview_url
    FROM ev""",
    "ev",
)
_cte(
    "web_priced",
    """
    SELECT event_id AS order_id, ts, seen_at AS created_at, sid AS website_session_id, user_id, k,
      CAST(1 + k % 6 AS BIGINT) AS primary_product_id,
      CAST(CASE WHEN k = 77 THEN NULL WHEN k % 25 = 0 THEN 0
                WHEN k % 25 = 1 THEN -CAST(value AS DECIMAL(18,2))
                ELSE CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS price_usd
    FROM ev WHERE event_type = 'purchase'""",
    "ev",
)
_cte(
    "web_orders",
    """
    SELECT order_id, created_at, website_session_id, user_id, primary_product_id, price_usd,
      CASE WHEN k = 33 THEN price_usd
           ELSE CAST(price_usd * CAST(0.40 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS cogs_usd
    FROM web_priced""",
    "web_priced",
)
_cte(
    "store_priced",
    """
    SELECT *, CAST(CASE WHEN o_orderkey % 50 = 7 THEN 0
                        WHEN o_orderkey % 50 = 8 THEN -CAST(o_totalprice AS DECIMAL(18,2))
                        ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS price_usd
    FROM orders""",
)
_cte(
    "store_orders",
    """
    SELECT o_orderkey AS order_id, o_orderdate AS created_at, o_custkey AS user_id, price_usd,
      CAST(price_usd * CAST(0.60 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS cogs_usd
    FROM store_priced""",
    "store_priced",
)
_cte(
    "order_items",
    """
    SELECT l_orderkey * 8 + l_linenumber AS order_item_id, l_shipdate AS created_at,
      l_orderkey AS order_id,
      CAST(CASE WHEN l_partkey % 23 = 0 THEN 99 ELSE 1 + l_partkey % 6 END AS BIGINT)
        AS product_id,
      CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS is_primary_item,
      CAST(l_extendedprice AS DECIMAL(18,2)) AS price_usd,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
           AS DECIMAL(18,2)) AS cogs_usd
    FROM lineitem""",
)
_cte(
    "order_item_refunds",
    """
    SELECT (l_orderkey * 8 + l_linenumber) * 10 + 1 AS order_item_refund_id,
      l_shipdate + to_days(l_linenumber) AS created_at,
      l_orderkey * 8 + l_linenumber AS order_item_id
    FROM lineitem WHERE l_returnflag = 'R'""",
)
_cte(
    "products",
    """
    SELECT CAST(1 + p_partkey % 6 AS BIGINT) AS product_id,
      min(p_name) || ' #' || CAST(1 + p_partkey % 6 AS VARCHAR) AS product_name
    FROM part GROUP BY p_partkey % 6""",
)

# Visits with readable tags, and with orders and lines attached row by row.
_cte(
    "v",
    """
    SELECT *, lower(trim(utm_source)) AS src, lower(trim(utm_campaign)) AS cmp,
      lower(trim(device_type)) AS dev,
      utm_source IS NULL AND coalesce(trim(http_referer), '') <> '' AS is_organic,
      utm_source IS NULL AND coalesce(trim(http_referer), '') = '' AS is_direct,
      coalesce(lower(trim(utm_source)), '') <> 'socialbook' AS listed,
      CAST(year(created_at) AS INTEGER) AS yr, CAST(month(created_at) AS INTEGER) AS mo,
      CAST(quarter(created_at) AS INTEGER) AS qtr,
      CAST(created_at AS DATE) - CAST(dayofweek(created_at) AS INTEGER) AS sunday
    FROM website_sessions""",
    "website_sessions",
)
_cte(
    "vo",
    """
    SELECT v.*, ord.order_id, ord.price_usd
    FROM v LEFT JOIN (SELECT * FROM web_orders WHERE price_usd > 0) ord USING (website_session_id)""",
    "v",
    "web_orders",
)
_cte(
    "vol",
    """
    SELECT vo.*, line.order_item_id, line.price_usd AS line_price
    FROM vo LEFT JOIN order_items line ON line.order_id = vo.order_id
    WHERE line.product_id IS NULL OR line.product_id <> 99""",
    "vo",
    "order_items",
)
_cte(
    "pg",
    """SELECT *, lower(pageview_url) AS page FROM website_pageviews""",
    "website_pageviews",
)
_cte(
    "landing",
    """
    SELECT website_session_id AS lsid, page AS entry, created_at AS entered,
      count(*) OVER (PARTITION BY website_session_id) AS n_views
    FROM pg QUALIFY row_number() OVER (PARTITION BY website_session_id
                                       ORDER BY website_pageview_id) = 1""",
    "pg",
)
_cte(
    "sale",
    """
    SELECT s.order_id, s.created_at, CAST(year(s.created_at) AS INTEGER) AS yr,
      CAST(month(s.created_at) AS INTEGER) AS mo, line.order_item_id, line.product_id,
      line.is_primary_item, line.price_usd AS line_price, line.cogs_usd AS line_cost
    FROM store_orders s JOIN order_items line ON line.order_id = s.order_id
    WHERE s.price_usd > 0 AND line.product_id <> 99""",
    "store_orders",
    "order_items",
)
_cte(
    "sale_refund",
    """
    SELECT sale.*, back.order_item_refund_id
    FROM sale LEFT JOIN order_item_refunds back USING (order_item_id)""",
    "sale",
    "order_item_refunds",
)


# Tables with events, and their keys: every seventh row by key may stand twice.
KEYED = {
    "website_sessions": "website_session_id",
    "website_pageviews": "website_pageview_id",
    "web_orders": "order_id",
    "store_orders": "order_id",
    "order_items": "order_item_id",
    "order_item_refunds": "order_item_refund_id",
}


def _rows(name: str, copies: bool) -> str:
    body = CTES[name][1]
    if not copies or name not in KEYED:
        return body
    return f"SELECT * FROM ({body}) UNION ALL SELECT * FROM ({body}) WHERE {KEYED[name]} % 7 = 0"


def sql(body: str, *needs: str, copies: bool = False) -> str:
    """The statement with the table expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for need in needs:
        visit(need)
    head = ",\n".join(f"{name} AS ({_rows(name, copies)}\n)" for name in order)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def half_up(x: str, k: int) -> str:
    """Round a quotient half up, as decimal arithmetic does.

    DuckDB divides as double; an exact tie such as 4.475 would come out a hair
    below and be rounded down. Nine digits bring the tie back.
    """
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {k}) AS DOUBLE)"


def pct(n: str, d: str, k: int = 2) -> str:
    return half_up(f"CAST({n} AS DOUBLE) * 100 / nullif(CAST({d} AS DOUBLE), 0)", k)


def ratio(n: str, d: str, k: int = 2) -> str:
    return half_up(over(n, d), k)


def over(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


SES = "count(DISTINCT website_session_id)"
ORD = "count(DISTINCT order_id)"
G_NB = "src = 'gsearch' AND cmp = 'nonbrand'"
B_NB = "src = 'bsearch' AND cmp = 'nonbrand'"
IN_2014 = "created_at >= TIMESTAMP '2014-01-01' AND created_at < TIMESTAMP '2015-01-01'"
DETAIL = "('/item-1', '/item-2', '/item-3', '/item-4')"
THANKS = "'/thank-you-for-your-order'"

ORACLE: dict[str, str] = {}


_PARTS: dict[str, tuple] = {}


def _put(name: str, body: str, *needs: str) -> None:
    _PARTS[name] = (body, *needs)
    ORACLE[name] = sql(body, *needs)


# --- audit ---------------------------------------------------------------------

for _name in ("website_sessions", "website_pageviews", "order_items", "order_item_refunds", "products"):
    _put(f"a1_rows_{_name}", f"SELECT count(*) AS row_count FROM {_name}", _name)
_put("a1_rows_orders", "SELECT count(*) AS row_count FROM web_orders", "web_orders")
_put(
    "a2_table_counts",
    " UNION ALL ".join(
        f"SELECT '{label}' AS tbl, count(*) AS row_count FROM {table}"
        for label, table in [
            ("website_sessions", "website_sessions"),
            ("website_pageviews", "website_pageviews"),
            ("orders", "web_orders"),
            ("order_items", "order_items"),
            ("order_item_refunds", "order_item_refunds"),
            ("products", "products"),
        ]
    ),
    "website_sessions", "website_pageviews", "web_orders", "order_items",
    "order_item_refunds", "products",
)
_put(
    "a3_time_range",
    "SELECT min(created_at) AS first_record, max(created_at) AS last_record FROM website_sessions",
    "website_sessions",
)
_put(
    "a4_preview",
    "SELECT * FROM website_sessions ORDER BY website_session_id LIMIT 5",
    "website_sessions",
)
_put(
    "a5_copies_of_key",
    "SELECT order_item_id, count(*) AS cnt FROM order_items WHERE order_item_id = 1009 GROUP BY 1",
    "order_items",
)
_put(
    "a5_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
_put(
    "a6_duplicate_user_time",
    """SELECT o_custkey, o_orderdate, count(*) AS cnt FROM orders
       GROUP BY o_custkey, o_orderdate HAVING count(*) > 1""",
)
_put(
    "a6_duplicate_sessions",
    """SELECT user_id, created_at, count(*) AS cnt FROM website_sessions
       GROUP BY user_id, created_at HAVING count(*) > 1""",
    "website_sessions",
)
for _key, _table, _col in [
    ("sessions", "website_sessions", "null_timestamps"),
    ("orders", "web_orders", "null_order_timestamps"),
    ("pageviews", "website_pageviews", "null_pageview_timestamps"),
    ("refunds", "order_item_refunds", "null_refund_timestamps"),
]:
    _put(
        f"a7_null_times_{_key}",
        f"SELECT count(*) - count(created_at) AS {_col} FROM {_table}",
        _table,
    )
BAD = "price_usd <= 0 OR cogs_usd >= price_usd"
_put("a8_bad_price_count", f"SELECT count(*) AS bad_prices FROM web_orders WHERE {BAD}", "web_orders")
_put(
    "a8_bad_price_rows",
    f"""SELECT order_id, created_at, website_session_id, user_id, primary_product_id,
          {dbl('price_usd')} AS price_usd, {dbl('cogs_usd')} AS cogs_usd
        FROM web_orders WHERE {BAD}""",
    "web_orders",
)
_put(
    "a9_null_prices",
    "SELECT count(*) AS null_prices FROM web_orders WHERE price_usd IS NULL OR cogs_usd IS NULL",
    "web_orders",
)
_put(
    "a10_bad_item_prices",
    f"SELECT count(*) AS bad_item_prices FROM order_items WHERE {BAD}",
    "order_items",
)
_put(
    "a11_null_item_prices",
    "SELECT count(*) AS null_prices FROM order_items WHERE price_usd IS NULL OR cogs_usd IS NULL",
    "order_items",
)
_put(
    "a12_early_pageview_count",
    """SELECT count(*) AS early_rows FROM website_pageviews p, website_sessions s
       WHERE p.website_session_id = s.website_session_id AND p.created_at < s.created_at""",
    "website_pageviews", "website_sessions",
)
_put(
    "a12_early_lineitem_count",
    """SELECT count(*) AS early_rows FROM lineitem, orders
       WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate""",
)
_put(
    "a13_early_pageviews",
    """SELECT website_pageview_id, p.created_at AS pageview_created_at,
         s.created_at AS session_created_at
       FROM website_pageviews p, website_sessions s
       WHERE p.website_session_id = s.website_session_id AND p.created_at < s.created_at""",
    "website_pageviews", "website_sessions",
)
_put(
    "a14_orphan_count",
    """SELECT count(*) AS orphan_rows FROM order_items i
       WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)""",
    "order_items", "products",
)
_put(
    "a14_orphan_rows",
    f"""SELECT order_item_id, created_at, order_id, product_id, is_primary_item,
          {dbl('price_usd')} AS price_usd, {dbl('cogs_usd')} AS cogs_usd
        FROM order_items i
        WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)""",
    "order_items", "products",
)
_put(
    "a15_heavy_users",
    """SELECT user_id, count(*) AS session_count FROM website_sessions GROUP BY user_id
       HAVING count(*) > 25 ORDER BY session_count DESC, user_id LIMIT 20""",
    "website_sessions",
)
_put(
    "a16_busiest_user",
    """SELECT max(n) AS max_sessions_per_user
       FROM (SELECT count(*) AS n FROM website_sessions GROUP BY user_id)""",
    "website_sessions",
)
_put(
    "a17_distinct_tags",
    "SELECT utm_source, utm_campaign, device_type FROM website_sessions GROUP BY ALL",
    "website_sessions",
)
_put("a18_distinct_urls", "SELECT pageview_url FROM website_pageviews GROUP BY 1", "website_pageviews")
DIRTY = """utm_source <> trim(utm_source) OR utm_campaign <> trim(utm_campaign)
       OR device_type <> trim(device_type)"""
_put(
    "a19_untrimmed_count",
    f"SELECT count(*) AS dirty_sources FROM website_sessions WHERE {DIRTY}",
    "website_sessions",
)
_put("a19_untrimmed_rows", f"SELECT * FROM website_sessions WHERE {DIRTY}", "website_sessions")
_put(
    "a20_untrimmed_referer_count",
    "SELECT count(*) AS dirty_referers FROM website_sessions WHERE http_referer <> trim(http_referer)",
    "website_sessions",
)
_put(
    "a20_untrimmed_referer_rows",
    "SELECT * FROM website_sessions WHERE http_referer <> trim(http_referer)",
    "website_sessions",
)
_put("a21_distinct_referers", "SELECT http_referer FROM website_sessions GROUP BY 1", "website_sessions")
_put(
    "a22_exclusion_summary",
    f"""WITH found(issue, records, action) AS (
      SELECT 'duplicate sessions', count(*) - count(DISTINCT website_session_id),
             'excluded at load' FROM website_sessions
      UNION ALL SELECT 'bad price orders', count(*), 'excluded from revenue'
        FROM web_orders WHERE {BAD}
      UNION ALL SELECT 'early page views', count(*), 'excluded from funnels'
        FROM website_pageviews p JOIN website_sessions s USING (website_session_id)
        WHERE p.created_at < s.created_at
      UNION ALL SELECT 'orphan order items', count(*), 'excluded from product reports'
        FROM order_items WHERE product_id NOT IN (SELECT product_id FROM products)
      UNION ALL SELECT 'untrimmed tags', count(*), 'corrected when read'
        FROM website_sessions WHERE {DIRTY}
      UNION ALL SELECT 'untrimmed referers', count(*), 'corrected when read'
        FROM website_sessions WHERE http_referer <> trim(http_referer)),
    size AS (SELECT (SELECT count(*) FROM website_sessions) + (SELECT count(*) FROM website_pageviews)
      + (SELECT count(*) FROM web_orders) + (SELECT count(*) FROM order_items)
      + (SELECT count(*) FROM order_item_refunds) + (SELECT count(*) FROM products) AS n)
    SELECT issue, records, {pct('records', '(SELECT n FROM size)', 4)} AS share_pct, action
    FROM found""",
    "website_sessions", "website_pageviews", "web_orders", "order_items",
    "order_item_refunds", "products",
)
_put(
    "n8_timely_pageviews",
    """SELECT p.pageview_url, count(*) AS pageviews
       FROM website_pageviews p WHERE NOT EXISTS (SELECT 1 FROM website_sessions s
         WHERE s.website_session_id = p.website_session_id AND p.created_at < s.created_at)
       GROUP BY 1""",
    "website_pageviews", "website_sessions",
)
_put(
    "s2_load_once",
    """SELECT * FROM lineitem QUALIFY row_number() OVER (
         PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                  l_tax, l_returnflag, l_linestatus) = 1""",
)

# --- growth --------------------------------------------------------------------

_put(
    "b1_quarterly_growth",
    f"""SELECT yr, qtr, {SES} AS sessions, {ORD} AS orders,
          CASE WHEN qtr = 1 AND (yr = 2012 OR yr = 2015) THEN 'Partial' ELSE 'Complete' END
            AS quarter_status
        FROM vo GROUP BY yr, qtr""",
    "vo",
)
_put(
    "b2_channel_growth",
    f"SELECT yr, mo, {SES} AS sessions, {ORD} AS orders FROM vo WHERE {G_NB} GROUP BY yr, mo",
    "vo",
)


def _sides(rules: dict[str, str]) -> str:
    return ",\n".join(
        f"{SES} FILTER (WHERE {rule}) AS {name}_sessions, {ORD} FILTER (WHERE {rule}) AS {name}_orders"
        for name, rule in rules.items()
    )


_put(
    "b3_campaign_split",
    f"""SELECT yr, mo, {_sides({'nonbrand': "cmp = 'nonbrand'", 'brand': "cmp = 'brand'"})}
        FROM vo WHERE src = 'gsearch' AND cmp IN ('nonbrand', 'brand') GROUP BY yr, mo""",
    "vo",
)
_put(
    "b4_device_split",
    f"""SELECT yr, mo, {_sides({'desktop': "dev = 'desktop'", 'mobile': "dev = 'mobile'"})}
        FROM vo WHERE {G_NB} GROUP BY yr, mo""",
    "vo",
)
_put(
    "b5_channel_split",
    "SELECT yr, mo, "
    + _sides(
        {
            "gsearch_nonbrand": G_NB,
            "bsearch_nonbrand": B_NB,
            "gsearch_brand": "src = 'gsearch' AND cmp = 'brand'",
            "bsearch_brand": "src = 'bsearch' AND cmp = 'brand'",
            "organic": "is_organic",
            "direct": "is_direct",
        }
    )
    + " FROM vo GROUP BY yr, mo",
    "vo",
)
_put(
    "e1_conversion_rate",
    f"""SELECT yr, qtr, {SES} AS sessions, {ORD} AS orders, {pct(ORD, SES)} AS conv_rate_pct
        FROM vo GROUP BY yr, qtr""",
    "vo",
)
_put(
    "e2_average_order_value",
    f"""SELECT yr, qtr, {ORD} AS orders, {dbl('round(sum(price_usd), 2)')} AS total_revenue,
          {ratio('sum(price_usd)', ORD)} AS avg_order_value FROM vo GROUP BY yr, qtr""",
    "vo",
)
_put(
    "e3_revenue_per_session",
    f"""SELECT yr, qtr, {SES} AS sessions, {dbl('round(sum(price_usd), 2)')} AS total_revenue,
          {ratio('sum(price_usd)', SES)} AS rev_per_session FROM vo GROUP BY yr, qtr""",
    "vo",
)
_put(
    "e4_monthly_conversion",
    f"""SELECT yr, mo, {SES} AS sessions, {ORD} AS orders, {pct(ORD, SES)} AS conv_rate_pct
        FROM vo GROUP BY yr, mo""",
    "vo",
)
KPIS = f"""{SES} AS sessions, {ORD} AS orders, {pct(ORD, SES)} AS conv_rate_pct,
  {ratio('sum(line_price)', ORD)} AS avg_order_value,
  {ratio('sum(line_price)', SES)} AS rev_per_session,
  {dbl('round(sum(line_price), 2)')} AS total_revenue"""
Q4_2014 = "created_at >= TIMESTAMP '2014-10-01' AND created_at < TIMESTAMP '2015-01-01'"
_put("k1_master_kpis", f"SELECT yr, qtr, {KPIS} FROM vol WHERE listed GROUP BY yr, qtr", "vol")
_put(
    "k5_monthly_baseline",
    f"SELECT yr, mo, {KPIS} FROM vol WHERE listed AND {Q4_2014} GROUP BY yr, mo",
    "vol",
)

# --- channels --------------------------------------------------------------------

_put(
    "c1_monthly_mix",
    f"""SELECT yr, mo, count(*) FILTER (WHERE {G_NB}) AS gsearch_nonbrand,
          count(*) FILTER (WHERE {B_NB}) AS bsearch_nonbrand,
          count(*) FILTER (WHERE cmp = 'brand') AS paid_brand,
          count(*) FILTER (WHERE is_organic) AS organic_search,
          count(*) FILTER (WHERE is_direct) AS direct_typein,
          {SES} AS total_sessions,
          {pct("sum(coalesce((cmp = 'brand')::INT, 0) + is_organic::INT + is_direct::INT)",
               f"count(*) FILTER (WHERE {G_NB})", 1)} AS free_brand_pct_of_nonbrand
        FROM v WHERE listed GROUP BY yr, mo""",
    "v",
)
_put(
    "c2_quarterly_order_mix",
    f"""WITH q AS (SELECT yr, qtr, {ORD} AS total_orders,
          count(order_id) FILTER (WHERE {G_NB}) AS gsearch_nb_orders,
          count(order_id) FILTER (WHERE {B_NB}) AS bsearch_nb_orders,
          count(order_id) FILTER (WHERE cmp = 'brand') AS brand_orders,
          count(order_id) FILTER (WHERE is_organic) AS organic_orders,
          count(order_id) FILTER (WHERE is_direct) AS direct_orders
        FROM vo WHERE listed GROUP BY yr, qtr)
        SELECT *, {pct('gsearch_nb_orders', 'total_orders', 1)} AS gsearch_nb_pct,
          {pct('(organic_orders + direct_orders + brand_orders)', 'total_orders', 1)}
            AS free_and_brand_pct FROM q""",
    "vo",
)
_put(
    "c3_source_by_device",
    f"""SELECT src AS channel, dev AS device, {SES} AS sessions, {ORD} AS orders,
          {pct(ORD, SES)} AS conv_rate_pct
        FROM vo WHERE cmp = 'nonbrand' AND (src = 'gsearch' OR src = 'bsearch')
        GROUP BY src, dev""",
    "vo",
)
_put(
    "c4_weekly_volume",
    """SELECT CAST(min(created_at) AS DATE) AS week_start,
         count(*) FILTER (WHERE src = 'gsearch') AS gsearch_sessions,
         count(*) FILTER (WHERE src = 'bsearch') AS bsearch_sessions
       FROM v WHERE created_at >= TIMESTAMP '2012-08-22' AND cmp = 'nonbrand'
         AND src IN ('gsearch', 'bsearch')
       GROUP BY sunday""",
    "v",
)
_put(
    "c5_resilience",
    f"""WITH r AS (SELECT count(*) AS total_sessions,
          count(*) FILTER (WHERE utm_source IS NULL OR cmp = 'brand') AS free_and_brand_sessions
        FROM v WHERE listed AND {IN_2014})
        SELECT *, {pct('free_and_brand_sessions', 'total_sessions', 1)} AS resilience_score_pct
        FROM r""",
    "v",
)
CHANNEL = f"""CASE WHEN {G_NB} THEN 'gsearch_nonbrand' WHEN {B_NB} THEN 'bsearch_nonbrand'
  WHEN cmp = 'brand' THEN 'paid_brand' WHEN is_organic THEN 'organic' WHEN is_direct THEN 'direct'
  ELSE 'other' END"""
_put(
    "k2_quarterly_channels",
    f"""SELECT yr, qtr, {CHANNEL} AS channel, {SES} AS sessions, {ORD} AS orders,
          {dbl('round(sum(line_price), 2)')} AS revenue
        FROM vol WHERE listed GROUP BY yr, qtr, channel""",
    "vol",
)
_put(
    "k7_reconcile_channels",
    f"""WITH parts AS (SELECT yr, qtr, {CHANNEL} AS channel, {SES} AS s, {ORD} AS o
          FROM vol WHERE listed GROUP BY 1, 2, 3),
        sums AS (SELECT yr, qtr, CAST(sum(s) AS BIGINT) AS channel_sessions,
          CAST(sum(o) AS BIGINT) AS channel_orders FROM parts GROUP BY yr, qtr),
        whole AS (SELECT yr, qtr, {SES} AS sessions, {ORD} AS orders
          FROM vol WHERE listed GROUP BY yr, qtr)
        SELECT *, sessions = channel_sessions AND orders = channel_orders AS matches
        FROM whole JOIN sums USING (yr, qtr)""",
    "vol",
)

# --- funnel ----------------------------------------------------------------------

STEP_RULES = {
    "products": "page = '/products'",
    "product_detail": f"page IN {DETAIL}",
    "cart": "page = '/cart'",
    "shipping": "page = '/shipping'",
    "billing": "page LIKE '/billing%'",
    "thankyou": f"page = {THANKS}",
}
STEPS = list(STEP_RULES)


def _short(step: str) -> str:
    return "detail" if step == "product_detail" else step


def _landed(since: str) -> str:
    """Sessions of the main channel that viewed the lander, with all their pages."""
    return f"""f AS (SELECT v.website_session_id AS id, v.dev, pg.page
      FROM v JOIN pg USING (website_session_id)
      WHERE {G_NB} AND v.created_at >= TIMESTAMP '{since}' AND website_session_id IN
        (SELECT website_session_id FROM pg WHERE page = '/lander-1'))"""


def _reach(rule: str | None, extra: str = "") -> str:
    rules = [r for r in (rule, extra) if r]
    where = f" FILTER (WHERE {' AND '.join(rules)})" if rules else ""
    return f"count(DISTINCT id){where}"


_D1 = f"""SELECT {_reach(None)} AS sessions_at_lander,
  {', '.join(f'{_reach(r)} AS sessions_at_{s}' for s, r in STEP_RULES.items())} FROM f"""
_put("d1_funnel_counts", f"WITH {_landed('2012-08-05')} {_D1}", "v", "pg")
_path = ["lander", *STEPS]
_put(
    "d2_funnel_rates",
    f"""WITH {_landed('2012-08-05')}, c AS ({_D1}) SELECT *,
      {', '.join(pct(f'sessions_at_{b}', f'sessions_at_{a}', 1) + f' AS {_short(a)}_to_{_short(b)}_pct'
                 for a, b in zip(_path, _path[1:]))} FROM c""",
    "v", "pg",
)


def _product_funnel(products: dict[str, str], since: str) -> str:
    tail = ["cart", "shipping", "billing", "thankyou"]
    counts, rates = [], []
    for name, page in products.items():
        saw = f"id IN (SELECT id FROM f WHERE page = '{page}')"
        counts.append(f"{_reach(saw)} AS {name}_at_detail")
        counts += [f"{_reach(STEP_RULES[s], saw)} AS {name}_at_{s}" for s in tail]
        path = ["detail", *tail]
        rates += [
            pct(f"{name}_at_{b}", f"{name}_at_{a}", 1) + f" AS {name}_{a}_to_{b}_pct"
            for a, b in zip(path, path[1:])
        ]
    flags = ", ".join(
        f"bool_or(page = '{p}') OVER (PARTITION BY id) AS saw_{n}" for n, p in products.items()
    )
    body = ", ".join(counts)
    for name, page in products.items():
        body = body.replace(f"id IN (SELECT id FROM f WHERE page = '{page}')", f"saw_{name}")
    return f"""WITH {_landed(since)}, m AS (SELECT *, {flags} FROM f), c AS (SELECT {body} FROM m)
      SELECT *, {', '.join(rates)} FROM c"""


_put(
    "d3_funnel_by_product_page",
    _product_funnel({"item1": "/item-1", "item2": "/item-2"}, "2013-01-06"),
    "v", "pg",
)


def _device_funnel(devices: list[str]) -> str:
    counts, rates = [], []
    for d in devices:
        own = f"dev = '{d}'"
        counts.append(f"{_reach(own)} AS {d}_at_lander")
        counts += [f"{_reach(r, own)} AS {d}_at_{s}" for s, r in STEP_RULES.items()]
        rates += [
            pct(f"{d}_at_{b}", f"{d}_at_{a}", 1) + f" AS {d}_{_short(a)}_to_{_short(b)}_pct"
            for a, b in zip(_path, _path[1:])
        ]
    return f"""WITH {_landed('2012-08-05')}, c AS (SELECT {', '.join(counts)} FROM f)
      SELECT *, {', '.join(rates)} FROM c"""


_put("d4_funnel_by_device", _device_funnel(["desktop", "mobile"]), "v", "pg")
_REACHED = ", ".join(
    f"count(DISTINCT v.website_session_id) FILTER (WHERE {r}) AS reached_{s}"
    for s, r in STEP_RULES.items()
)
_put(
    "k3_site_funnel",
    f"""SELECT count(DISTINCT v.website_session_id) AS total_sessions, {_REACHED}
        FROM v LEFT JOIN pg ON pg.website_session_id = v.website_session_id
        WHERE listed AND v.created_at >= TIMESTAMP '2014-01-01'
          AND v.created_at < TIMESTAMP '2015-01-01'""",
    "v", "pg",
)
_K6 = f"""SELECT yr, mo, count(DISTINCT v.website_session_id) AS total_sessions, {_REACHED}
        FROM v LEFT JOIN pg ON pg.website_session_id = v.website_session_id
        WHERE listed AND v.created_at >= TIMESTAMP '2014-10-01'
          AND v.created_at < TIMESTAMP '2015-01-01' GROUP BY yr, mo"""
_put("k6_monthly_funnel", _K6, "v", "pg")

# --- experiments -------------------------------------------------------------------

_put(
    "h1_entry_pages",
    """SELECT entry AS entry_page, count(*) AS sessions, CAST(sum(n_views) AS BIGINT) AS pageviews
       FROM landing JOIN website_sessions ON lsid = website_session_id GROUP BY 1""",
    "landing", "website_sessions",
)
_put(
    "x1_first_seen",
    f"""SELECT min(entered) AS first_seen FROM landing JOIN v ON lsid = website_session_id
        WHERE {G_NB} AND entry = '/lander-1'""",
    "landing", "v",
)
_put(
    "x2_first_sessions",
    f"""SELECT website_session_id, created_at AS session_start, entered AS first_pageview_at,
          entry AS landing_page
        FROM landing JOIN v ON lsid = website_session_id
        WHERE {G_NB} AND entry = '/lander-1' ORDER BY entered, website_session_id LIMIT 5""",
    "landing", "v",
)
TEST = f"""{G_NB} AND entry IN ('/home', '/lander-1')
  AND v.created_at BETWEEN TIMESTAMP '2012-06-19' AND TIMESTAMP '2012-07-28'"""
_put(
    "x3_bounce_rate",
    f"""SELECT entry AS landing_page, count(*) AS total_sessions,
          count(*) FILTER (WHERE n_views = 1) AS bounced_sessions,
          {pct('count(*) FILTER (WHERE n_views = 1)', 'count(*)')} AS bounce_rate_pct
        FROM landing JOIN v ON lsid = website_session_id WHERE {TEST} GROUP BY entry""",
    "landing", "v",
)
_put(
    "x4_weekly_routing",
    f"""SELECT CAST(year(sunday) * 100 + (dayofyear(sunday) + 6) // 7 AS INTEGER) AS yr_wk,
          CAST(min(created_at) AS DATE) AS week_start,
          count(*) FILTER (WHERE entry = '/home') AS home_sessions,
          count(*) FILTER (WHERE entry = '/lander-1') AS lander1_sessions
        FROM landing JOIN v ON lsid = website_session_id
        WHERE {G_NB} AND entry IN ('/home', '/lander-1')
          AND v.created_at >= TIMESTAMP '2012-06-01' GROUP BY 1""",
    "landing", "v",
)
_X5 = f"""SELECT entry AS landing_page, {SES} AS sessions, {ORD} AS orders,
          {pct(ORD, SES)} AS conv_rate_pct
        FROM landing JOIN vo v ON lsid = website_session_id WHERE {TEST} GROUP BY entry"""
_X6 = f"""SELECT {SES} AS post_test_sessions, {ORD} AS total_orders,
          {ratio('sum(price_usd)', ORD)} AS overall_aov
        FROM landing JOIN vo ON lsid = website_session_id
        WHERE {G_NB} AND entry = '/lander-1' AND created_at > TIMESTAMP '2012-07-28'"""
_put("x5_landing_conversion", _X5, "landing", "vo")
_put("x6_after_test", _X6, "landing", "vo")
_put(
    "z2_landing_value",
    f"""WITH t AS ({_X5}), a AS ({_X6}),
        l AS (SELECT max(conv_rate_pct) FILTER (WHERE landing_page = '/home') AS control_pct,
                max(conv_rate_pct) FILTER (WHERE landing_page = '/lander-1') AS variant_pct FROM t)
        SELECT control_pct, variant_pct, round(variant_pct - control_pct, 2) AS lift_pp,
          post_test_sessions, overall_aov,
          round(round(variant_pct - control_pct, 2) / 100 * post_test_sessions * overall_aov, 2)
            AS incremental_revenue
        FROM l, a""",
    "landing", "vo",
)


def _checkout(safe: bool) -> str:
    hit = "SELECT DISTINCT website_session_id, page FROM pg" if safe else "SELECT * FROM pg"
    return f"""SELECT page AS billing_page, {SES} AS billing_sessions, {ORD} AS orders,
          {pct(ORD, SES)} AS billing_conv_rate_pct,
          {ratio('sum(price_usd)', SES)} AS revenue_per_billing_session
        FROM ({hit}) h JOIN (SELECT website_session_id, created_at AS t, order_id, price_usd FROM vo)
          USING (website_session_id)
        WHERE page IN ('/billing', '/billing-2')
          AND t BETWEEN TIMESTAMP '2012-09-10' AND TIMESTAMP '2012-11-10'
        GROUP BY page"""


_X8 = f"""SELECT {SES} AS page_sessions FROM v
        WHERE created_at >= TIMESTAMP '2015-02-01' AND created_at < TIMESTAMP '2015-03-01'
          AND website_session_id IN (SELECT website_session_id FROM pg WHERE page = '/billing-2')"""
_put("x7_checkout_test", _checkout(False), "vo", "pg")
_put("x7_checkout_test_grain_safe", _checkout(True), "vo", "pg")
_put("x8_page_sessions", _X8, "v", "pg")
_put(
    "z2_checkout_value",
    f"""WITH t AS ({_checkout(False)}), m AS ({_X8}),
        l AS (SELECT
          max(revenue_per_billing_session) FILTER (WHERE billing_page = '/billing') AS control_value,
          max(revenue_per_billing_session) FILTER (WHERE billing_page = '/billing-2') AS variant_value
          FROM t)
        SELECT control_value, variant_value,
          round(variant_value - control_value, 2) AS lift_per_session, page_sessions,
          round(round(variant_value - control_value, 2) * page_sessions, 2) AS monthly_value
        FROM l, m""",
    "vo", "pg",
)
_put(
    "l7_two_arm_test",
    f"""WITH arm AS (SELECT website_session_id, CAST(bool_or(page = '/billing-2') AS INTEGER) AS saw_variant
          FROM pg WHERE page IN ('/billing', '/billing-2') GROUP BY 1)
        SELECT saw_variant, {SES} AS sessions, {ORD} AS orders, {pct(ORD, SES)} AS conversion_rate
        FROM arm LEFT JOIN (SELECT * FROM web_orders WHERE price_usd > 0) USING (website_session_id)
        GROUP BY saw_variant""",
    "pg", "web_orders",
)

# --- products -----------------------------------------------------------------------

REV, MAR = "sum(line_price)", "sum(line_price - line_cost)"
_put(
    "p1_monthly_margin",
    f"""SELECT yr, mo, {ORD} AS orders, {dbl(f'round({REV}, 2)')} AS total_revenue,
          {dbl(f'round({MAR}, 2)')} AS total_margin, {pct(MAR, REV, 1)} AS margin_pct
        FROM sale GROUP BY yr, mo""",
    "sale",
)
_put(
    "p2_monthly_efficiency",
    f"""SELECT yr, mo, {SES} AS sessions, {ORD} AS orders, {pct(ORD, SES)} AS conv_rate_pct,
          {ratio('sum(line_price)', SES)} AS rev_per_session
        FROM vol WHERE created_at >= TIMESTAMP '2013-04-01' GROUP BY yr, mo""",
    "vol",
)


def _per_product(suffix: str, extra: str = "") -> str:
    return ", ".join(
        f"{ORD} FILTER (WHERE product_id = {i}{extra}) AS product{i}_{suffix}" for i in range(1, 7)
    )


_put(
    "p3_product_orders",
    f"""SELECT yr, mo, {ORD} AS total_orders, {_per_product('orders')}
        FROM sale WHERE created_at >= TIMESTAMP '1996-04-01' GROUP BY yr, mo""",
    "sale",
)


def _launch(day: str, lo: str, hi: str) -> str:
    return f"""SELECT CASE WHEN created_at < TIMESTAMP '{day}' THEN 'A_before' ELSE 'B_after' END
          AS period, {SES} AS sessions, {ORD} AS orders, {pct(ORD, SES)} AS conv_rate_pct,
          {ratio('sum(line_price)', ORD)} AS avg_order_value,
          {ratio('count(order_item_id)', ORD)} AS products_per_order,
          {ratio('sum(line_price)', SES)} AS rev_per_session
        FROM vol WHERE created_at >= TIMESTAMP '{lo}' AND created_at < TIMESTAMP '{hi}'
        GROUP BY 1"""


_put("p4_launch_impact", _launch("2013-12-12", "2013-11-12", "2014-01-12"), "vol")
_put("p7_launch_impact_other", _launch("2013-01-06", "2012-12-06", "2013-02-06"), "vol")
_put(
    "p5_month_by_product",
    f"""SELECT yr, mo, product_id, product_name, {ORD} AS orders,
          {dbl(f'round({REV}, 2)')} AS revenue, {dbl(f'round({MAR}, 2)')} AS margin,
          {pct(MAR, REV, 1)} AS margin_pct
        FROM sale JOIN products USING (product_id) GROUP BY yr, mo, product_id, product_name""",
    "sale", "products",
)
_put(
    "p6_primary_orders",
    f"""SELECT yr, mo, {ORD} AS total_orders, {_per_product('primary', ' AND is_primary_item = 1')}
        FROM sale GROUP BY yr, mo""",
    "sale",
)
LINES = "FROM sale_refund"
SAFE = """FROM (SELECT sale.*, order_item_id IN (SELECT order_item_id FROM order_item_refunds) AS back
  FROM sale) s"""


def _refunds(safe: bool) -> tuple[str, str, str]:
    if safe:
        return SAFE, "count(*)", "count(*) FILTER (WHERE back)"
    return LINES, "count(order_item_id)", "count(order_item_refund_id)"


def _p8(safe: bool) -> str:
    source, sold, back = _refunds(safe)
    return f"""SELECT yr, mo, product_id, product_name, {sold} AS items_sold,
          {back} AS items_refunded, {pct(back, sold)} AS refund_rate_pct
        {source} JOIN products USING (product_id) GROUP BY yr, mo, product_id, product_name"""


def _p10(safe: bool) -> str:
    source, sold, back = _refunds(safe)
    return f"""SELECT product_id, product_name, {ORD} AS lifetime_orders,
          {dbl(f'round({REV}, 2)')} AS lifetime_revenue,
          {dbl(f'round({MAR}, 2)')} AS lifetime_margin, {pct(MAR, REV, 1)} AS margin_pct,
          {pct(back, sold)} AS lifetime_refund_rate_pct
        {source} JOIN products USING (product_id) GROUP BY product_id, product_name"""


_REFUND_NEEDS = ("sale", "sale_refund", "order_item_refunds", "products")
_put("p8_monthly_refunds", _p8(False), *_REFUND_NEEDS)
_put("p8_monthly_refunds_grain_safe", _p8(True), *_REFUND_NEEDS)
_put(
    "p9_refund_periods",
    f"""SELECT CASE WHEN created_at < TIMESTAMP '1998-09-01' THEN 'A_before'
                    WHEN created_at < TIMESTAMP '1998-10-01' THEN 'B_change' ELSE 'C_after' END
          AS period, count(order_item_id) AS items_sold,
          count(order_item_refund_id) AS items_refunded,
          {pct('count(order_item_refund_id)', 'count(order_item_id)')} AS refund_rate_pct
        FROM sale_refund WHERE product_id = 1 AND created_at >= TIMESTAMP '1998-06-01'
          AND created_at < TIMESTAMP '1999-01-01' GROUP BY 1""",
    "sale_refund",
)
_put("p10_lifetime_summary", _p10(False), *_REFUND_NEEDS)
_put("p10_lifetime_summary_grain_safe", _p10(True), *_REFUND_NEEDS)
_put(
    "z3_net_margin",
    f"""WITH p AS ({_p10(False)}) SELECT product_id, product_name, margin_pct,
          lifetime_refund_rate_pct,
          round(margin_pct * (1 - lifetime_refund_rate_pct / 100), 1) AS net_margin_pct FROM p""",
    *_REFUND_NEEDS,
)

# --- baskets ------------------------------------------------------------------------


def _feature(safe: bool) -> str:
    views = "SELECT DISTINCT website_session_id FROM pg" if safe else "SELECT website_session_id FROM pg"
    return f"""WITH c AS (
          SELECT CASE WHEN vo.created_at BETWEEN TIMESTAMP '2013-08-25' AND TIMESTAMP '2013-09-24'
                      THEN 'before'
                      WHEN vo.created_at BETWEEN TIMESTAMP '2013-09-25' AND TIMESTAMP '2013-10-24'
                      THEN 'after' END AS period,
            vo.website_session_id, vo.order_id, i.order_item_id, i.price_usd AS line_price
          FROM ({views} WHERE page = '/cart') h JOIN vo USING (website_session_id)
          LEFT JOIN (SELECT * FROM order_items WHERE product_id <> 99) i ON i.order_id = vo.order_id)
        SELECT period, {SES} AS cart_sessions, {ORD} AS orders,
          {pct(ORD, SES)} AS cart_to_order_ctr_pct,
          {ratio('count(order_item_id)', ORD)} AS avg_products_per_order,
          {ratio('sum(line_price)', ORD)} AS aov_usd,
          {ratio('sum(line_price)', SES)} AS rev_per_cart_session_usd
        FROM c WHERE period IS NOT NULL GROUP BY period"""


_put("m1_feature_launch", _feature(False), "vo", "pg", "order_items")
_put("m1_feature_launch_grain_safe", _feature(True), "vo", "pg", "order_items")
_PAIRS = """two AS (SELECT a.order_id, a.product_id AS p, b.product_id AS x
          FROM sale a JOIN sale b USING (order_id)
          WHERE a.is_primary_item = 1 AND b.is_primary_item = 0
            AND a.created_at > TIMESTAMP '1998-12-05')"""
_put(
    "m2_attachment_matrix",
    f"""WITH {_PAIRS},
        base AS (SELECT product_id AS p, {ORD} AS n FROM sale
          WHERE is_primary_item = 1 AND created_at > TIMESTAMP '1998-12-05' GROUP BY 1)
        SELECT p AS primary_product_id, x AS crosssell_product_id, {ORD} AS orders_with_pairing,
          n AS total_primary_orders, {pct(ORD, 'n')} AS attachment_rate_pct
        FROM two JOIN base USING (p) GROUP BY p, x, n""",
    "sale",
)
_TOTALS = """tot AS (SELECT order_id, sum(price_usd) AS t FROM order_items
          WHERE product_id <> 99 GROUP BY order_id)"""


def _baskets(safe: bool) -> str:
    rows = "(SELECT DISTINCT * FROM two)" if safe else "two"
    return f"""WITH {_PAIRS}, {_TOTALS}
        SELECT p AS primary_product_id, x AS crosssell_product_id, {ORD} AS orders_with_pairing,
          {ratio('sum(t)', ORD)} AS avg_basket_value_usd
        FROM {rows} JOIN tot USING (order_id) GROUP BY p, x"""


_put("m3_basket_values", _baskets(False), "sale", "order_items")
_put("m3_basket_values_grain_safe", _baskets(True), "sale", "order_items")
_put(
    "m4_attach_rate",
    f"""WITH m AS (SELECT DISTINCT order_id, product_id AS primary_product FROM order_items
          WHERE is_primary_item = 1 AND product_id <> 99
            AND created_at >= TIMESTAMP '1996-02-12')
        SELECT primary_product, {ORD} AS primary_orders,
          {ORD} FILTER (WHERE order_id IN (SELECT order_id FROM order_items WHERE product_id = 4))
            AS xsell_orders,
          {pct(ORD + ' FILTER (WHERE order_id IN (SELECT order_id FROM order_items WHERE product_id = 4))',
               ORD)} AS attach_rate
        FROM m GROUP BY primary_product""",
    "order_items",
)
_put(
    "z4_pairing_totals",
    f"""WITH b AS ({_baskets(False)})
        SELECT *, round(orders_with_pairing * avg_basket_value_usd, 2) AS total_value_usd FROM b""",
    "sale", "order_items",
)

# --- customers ----------------------------------------------------------------------

_put(
    "l1_visit_buckets",
    f"""WITH u AS (SELECT user_id, count(*) AS n FROM v WHERE {IN_2014} GROUP BY user_id)
        SELECT CASE WHEN n >= 4 THEN '4+ sessions' WHEN n = 1 THEN '1 session'
                    ELSE n || ' sessions' END AS session_bucket, count(*) AS user_count
        FROM u GROUP BY 1""",
    "v",
)
_put(
    "l2_days_to_return",
    f"""WITH r AS (SELECT user_id, created_at, row_number() OVER w AS n,
            lead(created_at) OVER w AS nxt
          FROM v WHERE {IN_2014}
          WINDOW w AS (PARTITION BY user_id ORDER BY created_at, website_session_id)),
        g AS (SELECT date_diff('day', CAST(created_at AS DATE), CAST(nxt AS DATE)) AS d
          FROM r WHERE n = 1 AND nxt IS NOT NULL)
        SELECT CAST(min(d) AS INTEGER) AS min_days_to_return,
          CAST(max(d) AS INTEGER) AS max_days_to_return,
          {ratio('sum(d)', 'count(*)', 1)} AS avg_days_to_return FROM g""",
    "v",
)
TYPE = "CASE is_repeat_session WHEN 0 THEN 'New' WHEN 1 THEN 'Repeat' END AS session_type"
_put(
    "l3_channel_mix",
    f"""SELECT {TYPE}, {SES} FILTER (WHERE {G_NB}) AS gsearch_nonbrand,
          {SES} FILTER (WHERE {B_NB}) AS bsearch_nonbrand,
          {SES} FILTER (WHERE cmp = 'brand') AS paid_brand,
          {SES} FILTER (WHERE is_organic) AS organic, {SES} FILTER (WHERE is_direct) AS direct,
          {SES} AS total_sessions
        FROM v WHERE listed AND {IN_2014} GROUP BY 1""",
    "v",
)
_put(
    "l4_conversion",
    f"""SELECT {TYPE}, {SES} AS sessions, {ORD} AS orders, {pct(ORD, SES)} AS conv_rate_pct,
          {ratio('sum(price_usd)', SES)} AS rev_per_session_usd
        FROM vo WHERE listed AND {IN_2014} GROUP BY 1""",
    "vo",
)
_L5 = f"""SELECT CASE WHEN s = 1 THEN 'Single visit' ELSE 'Returned at least once' END AS user_type,
          count(*) AS users, {ratio('sum(s)', 'count(*)', 1)} AS avg_sessions_per_user,
          {ratio('sum(o)', 'count(*)')} AS avg_orders_per_user,
          {ratio('sum(r)', 'count(*)')} AS avg_revenue_per_user
        FROM (SELECT user_id, {SES} AS s, {ORD} AS o, coalesce(sum(price_usd), 0) AS r
              FROM vo WHERE listed AND {IN_2014} GROUP BY user_id) GROUP BY 1"""
_put("l5_value_per_user", _L5, "vo")
_put(
    "l6_repeat_buyers",
    f"""WITH good AS (SELECT * FROM store_orders WHERE price_usd > 0),
        again AS (SELECT user_id FROM good GROUP BY user_id HAVING {ORD} > 1)
        SELECT user_id, {ORD} AS total_orders, {dbl('sum(price_usd - cogs_usd)')} AS lifetime_margin,
          min(created_at) AS first_order, max(created_at) AS last_order
        FROM again JOIN good USING (user_id) GROUP BY user_id""",
    "store_orders",
)

# --- sizing -------------------------------------------------------------------------

_put(
    "z1_leak_value",
    f"""WITH {_landed('2012-08-05')}, c AS ({_D1}),
        a AS (SELECT {ratio('sum(price_usd)', ORD)} AS aov FROM vo),
        m AS (SELECT round(sessions_at_product_detail / 31.5::DOUBLE, 1) AS n,
          {pct('sessions_at_cart', 'sessions_at_product_detail', 1)} AS rate FROM c)
        SELECT n AS avg_monthly_sessions_at_detail, rate AS current_detail_to_cart_pct,
          round(rate + 10.0::DOUBLE, 1) AS improved_detail_to_cart_pct,
          round(n * 0.1::DOUBLE, 0) AS additional_orders_per_month,
          round(n * 0.1::DOUBLE * aov, 2) AS additional_revenue_per_month
        FROM m, a""",
    "v", "vo", "pg",
)
_K5 = f"SELECT yr, mo, {KPIS} FROM vol WHERE listed AND {Q4_2014} GROUP BY yr, mo"
_AVERAGES = f"""base AS ({_K5}), fun AS ({_K6}),
   av AS (SELECT {over('sum(sessions)', 'count(*)')} AS sessions,
      {over('sum(orders)', 'count(*)')} AS orders,
      {over('sum(CAST(total_revenue AS DECIMAL(38,2)))', 'sum(orders)')} AS order_value,
      {over('sum(orders)', 'sum(sessions)')} AS conversion,
      {over('sum(CAST(total_revenue AS DECIMAL(38,2)))', 'sum(sessions)')} AS revenue_per_session
      FROM base),
   st AS (SELECT {over('sum(reached_product_detail)', 'count(*)')} AS detail,
      {over('sum(reached_cart)', 'sum(reached_product_detail)')} AS detail_to_cart,
      {over('sum(reached_thankyou)', 'sum(reached_cart)')} AS cart_to_order FROM fun)"""
_put(
    "z5_page_redesign",
    f"""WITH {_AVERAGES}
        SELECT round(detail, 0) AS sessions_at_detail, round(detail_to_cart * 100, 1) AS current_rate_pct,
          round(detail * 0.1::DOUBLE, 0) AS extra_carts,
          round(detail * 0.1::DOUBLE * cart_to_order, 0) AS extra_orders,
          round(detail * 0.1::DOUBLE * cart_to_order * order_value, 2) AS extra_revenue,
          round(40000::DOUBLE / nullif(detail * 0.1::DOUBLE * cart_to_order * order_value, 0), 1)
            AS payback_months,
          round(detail * 0.1::DOUBLE * cart_to_order * order_value * 12, 2) AS annual_value
        FROM av, st""",
    "vol", "v", "pg",
)
_put(
    "z5_cross_sell_push",
    f"""WITH {_AVERAGES}
        SELECT round(orders, 0) AS orders_per_month, round(orders * 0.05::DOUBLE, 0) AS extra_units,
          round(orders * 0.05::DOUBLE * 24.99::DOUBLE, 2) AS extra_revenue,
          round(25000::DOUBLE / nullif(orders * 0.05::DOUBLE * 24.99::DOUBLE, 0), 1)
            AS payback_months
        FROM av, st""",
    "vol", "v", "pg",
)
_put(
    "z5_paid_scale_up",
    f"""WITH {_AVERAGES}, users AS ({_L5}),
        mult AS (SELECT max(avg_revenue_per_user) FILTER (WHERE user_type LIKE 'Returned%')
          / nullif(max(avg_revenue_per_user) FILTER (WHERE user_type = 'Single visit'), 0) AS m
          FROM users),
        cpc(click_cost) AS (SELECT unnest([0.75::DOUBLE, 1.5::DOUBLE]))
        SELECT click_cost, round(m, 2) AS value_multiple,
          round(revenue_per_session * m, 2) AS break_even_cost,
          round(35000::DOUBLE / click_cost, 0) AS sessions,
          round(35000::DOUBLE / click_cost * conversion, 0) AS orders,
          round(35000::DOUBLE / click_cost * conversion * order_value, 2) AS revenue,
          round(35000::DOUBLE / click_cost * conversion * order_value / 35000::DOUBLE, 1)
            AS return_on_spend
        FROM av, mult, cpc""",
    "vol", "vo", "v", "pg",
)

# --- validation gates -----------------------------------------------------------------

_put(
    "v1_intake_accepted",
    f"""SELECT order_id, website_session_id, user_id, {dbl('price_usd')} AS price_usd
        FROM web_orders WHERE price_usd > 0 OR price_usd IS NULL""",
    "web_orders",
)
_V1_LINES = """priced AS (SELECT l_orderkey, l_linenumber,
    CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END AS price_usd
  FROM lineitem)"""
_put(
    "v1_intake_rejects",
    f"""WITH {_V1_LINES},
        taken AS (SELECT l_orderkey, l_linenumber, count(*) - 1 AS n_rows FROM priced
          WHERE price_usd > 0 GROUP BY ALL)
        SELECT l_orderkey, l_linenumber, count(*) AS n_rows, 'bad_price' AS reason FROM priced
        WHERE price_usd <= 0 GROUP BY 1, 2
        UNION ALL SELECT *, 'key_exists' FROM taken WHERE n_rows > 0""",
)
_put(
    "v1_intake_stream",
    """WITH o AS (SELECT *, least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 8, 3)
          + CASE WHEN k % 13 = 5 THEN 1 ELSE 0 END AS part,
          CASE WHEN k < 45 THEN 'gsearch' WHEN k < 55 THEN 'bsearch' WHEN k < 61 THEN 'gsearch'
               WHEN k < 65 THEN 'bsearch' WHEN k < 70 THEN 'socialbook' WHEN k < 72 THEN 'otherads'
               WHEN k < 73 THEN '' END AS tag FROM web_priced),
        a AS (SELECT * FROM o UNION ALL
          SELECT * REPLACE (part + k % 2 AS part) FROM o WHERE k % 11 = 3),
        clock AS (SELECT p.part, (SELECT max(ts) FROM a WHERE a.part < p.part) AS latest
          FROM (SELECT DISTINCT part FROM a) p),
        judged AS (SELECT a.*, CASE WHEN price_usd <= 0 THEN 'bad_price'
            WHEN ts < latest - INTERVAL 1 DAY THEN 'late' END AS fault FROM a JOIN clock USING (part)),
        named AS (SELECT *, CASE WHEN fault IS NOT NULL THEN fault
            WHEN row_number() OVER (PARTITION BY order_id, fault ORDER BY part) > 1 THEN 'key_exists'
            ELSE 'accepted' END AS r FROM judged)
       SELECT CAST(created_at AS DATE) AS day, count(*) AS n_rows,
         count(*) FILTER (WHERE r = 'accepted') AS accepted,
         count(*) FILTER (WHERE r = 'bad_price') AS bad_price,
         count(*) FILTER (WHERE r = 'key_exists') AS key_exists,
         count(*) FILTER (WHERE r = 'late') AS late,
         count(DISTINCT tag) FILTER (WHERE r = 'accepted') AS tags
       FROM named GROUP BY 1""",
    "web_priced",
)
_put(
    "v2_quarantine",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM (
         SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders)
       WHERE n > 1""",
)
_put(
    "v2_to_load",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM (
         SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders)
       WHERE n = 1""",
)


def _profile(name: str, where: str) -> str:
    return f"""{name} AS (SELECT unnest(['row_count', 'rows_per_day', 'null_price_pct',
        'null_time_pct', 'min_price', 'max_price']) AS metric, unnest([CAST(count(*) AS DOUBLE),
        {ratio('count(*)', "date_diff('day', CAST(min(created_at) AS DATE), CAST(max(created_at) AS DATE)) + 1", 4)},
        {pct('count(*) - count(price_usd)', 'count(*)', 4)},
        {pct('count(*) - count(created_at)', 'count(*)', 4)},
        {dbl('min(price_usd)')}, {dbl('max(price_usd)')}]) AS x
      FROM web_orders WHERE {where})"""


_put(
    "v3_deviations",
    f"""WITH {_profile('cur', "created_at >= TIMESTAMP '2014-01-01'")},
          {_profile('old', "created_at < TIMESTAMP '2014-01-01'")}
        SELECT metric, cur.x AS current_value, old.x AS baseline_value,
          metric <> 'row_count' AND coalesce(abs(cur.x - old.x) > abs(old.x) * 0.1::DOUBLE, true) AS flagged
        FROM cur JOIN old USING (metric)""",
    "web_orders",
)

# Copies of rows in the stored tables leave every figure as it is: at row level they are
# told apart by DISTINCT ids.
for _name in ("b5_channel_split", "e1_conversion_rate", "k1_master_kpis", "d2_funnel_rates", "l6_repeat_buyers"):
    ORACLE[f"s2_{_name}"] = ORACLE[_name]

# The stored load leaves one row of each key, so figures are those of the clean tables; of
# lines with one key the least by all other columns stays.
_put("s2_stored_sessions", "SELECT * FROM website_sessions", "website_sessions")
_put("s2_stored_orders_by_id", f"SELECT * REPLACE ({dbl('price_usd')} AS price_usd, {dbl('cogs_usd')} AS cogs_usd) FROM web_orders", "web_orders")
_put(
    "s2_stored_order_items",
    f"""SELECT * REPLACE ({dbl('price_usd')} AS price_usd, {dbl('cogs_usd')} AS cogs_usd) FROM order_items
        QUALIFY row_number() OVER (PARTITION BY order_item_id ORDER BY created_at, order_id,
          product_id, is_primary_item, price_usd, cogs_usd) = 1""",
    "order_items",
)
for _name in ("b5_channel_split", "d2_funnel_rates"):
    ORACLE[f"s2_stored_{_name}"] = ORACLE[_name]

# The same statements, with their DISTINCT counts, on tables that keep their copies.
for _name in ("b1_quarterly_growth", "e1_conversion_rate", "e3_revenue_per_session", "k1_master_kpis",
              "p5_month_by_product", "p8_monthly_refunds", "p10_lifetime_summary"):
    ORACLE[f"g3_copies_{_name}"] = sql(*_PARTS[_name], copies=True)
for _name in ("b5_channel_split", "d2_funnel_rates"):
    ORACLE[f"g4_copies_{_name}"] = sql(*_PARTS[_name], copies=True)

_put(
    "v3_stored_baseline",
    f"""WITH faulty AS (SELECT CAST(created_at AS DATE) AS day,
            CASE WHEN CAST(created_at AS DATE) <> DATE '1999-05-20' THEN price_usd END AS price,
            unnest(range(CASE WHEN CAST(created_at AS DATE) = DATE '1999-03-10' THEN 6 ELSE 1 END)) AS copy
          FROM store_orders),
        days AS (SELECT day, CAST(isodow(day) - 1 AS INTEGER) AS weekday, CAST(count(*) AS DOUBLE) AS n_rows,
            {pct('count(*) - count(price)', 'count(*)', 4)} AS null_price_pct,
            {ratio('sum(price)', 'count(price)', 4)} AS avg_price,
            {dbl('min(price)')} AS min_price, {dbl('max(price)')} AS max_price FROM faulty GROUP BY day),
        tall AS (
          SELECT day, weekday, 'n_rows' AS metric, n_rows AS value FROM days
          UNION ALL SELECT day, weekday, 'null_price_pct', null_price_pct FROM days
          UNION ALL SELECT day, weekday, 'avg_price', avg_price FROM days
          UNION ALL SELECT day, weekday, 'min_price', min_price FROM days
          UNION ALL SELECT day, weekday, 'max_price', max_price FROM days),
        usual AS (SELECT *, {ratio('sum(value) OVER w', 'count(value) OVER w', 4)} AS baseline, count(value) OVER w AS n_days FROM tall
          WINDOW w AS (PARTITION BY weekday, metric ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
       SELECT *, n_days >= 4 AND coalesce(abs(value - baseline) > abs(baseline) * 1.5::DOUBLE, true) AS flagged
       FROM usual WHERE day BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'""",
    "store_orders",
)

# Reports from stored session facts are those from the tables.
for _key, _name in (("k1", "k1_master_kpis"), ("k2", "k2_quarterly_channels"), ("k3", "k3_site_funnel"),
                    ("k5", "k5_monthly_baseline"), ("k6", "k6_monthly_funnel")):
    ORACLE[f"{_key}_from_facts"] = ORACLE[_name]

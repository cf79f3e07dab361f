"""Common table expressions shared by the oracle SQL."""

from __future__ import annotations

import re

BASE: dict[str, str] = {
    "check_lines": """
SELECT l_orderkey AS check_id, CAST(l_shipdate AS DATE) AS date, s_nationkey AS store, n_name AS city,
       p_brand AS product, p_type AS category, l_partkey AS part, l_suppkey AS supplier,
       l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice AS amount,
       CASE l_returnflag WHEN 'N' THEN 'sale' WHEN 'R' THEN 'return' ELSE 'cancel' END AS event_type,
       CASE l_linestatus WHEN 'O' THEN 'fresh' ELSE 'yesterday' END AS freshness
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey""",
    "sales": "SELECT * FROM check_lines WHERE event_type = 'sale'",
    "daily": """
SELECT store, category AS product, city, date, sum(qty) AS sold, substr(category, 1, 1) AS category
FROM sales s GROUP BY s.store, s.category, s.city, s.date""",
    "daily_fine": """
SELECT date, store, category, product, sum(qty) AS sold FROM sales GROUP BY date, store, category, product""",
    "stock_daily": """
SELECT *, CASE WHEN stock = 0 THEN 1 ELSE 0 END AS is_censored,
       CAST(CASE WHEN stock = 0 THEN (dayofyear(date) + store) % 5 ELSE 0 END AS DOUBLE) AS lost_qty,
       sold + CASE WHEN stock = 0 THEN (dayofyear(date) + store) % 5 ELSE 0 END AS demand
FROM (SELECT *, sold + (dayofyear(date) + store * 7) % 11 AS produced,
             CAST(greatest((dayofyear(date) + store * 7) % 11 - 3, 0) AS DOUBLE) AS stock FROM daily)""",
    "hourly": """
SELECT user_id AS store, event_type AS product, CAST(ts AS DATE) AS date, hour(ts) AS hour,
       CAST(count(*) AS DOUBLE) AS qty, sum(value) AS amount
FROM events GROUP BY user_id, event_type, CAST(ts AS DATE), hour(ts)""",
    "daily_prices": """
SELECT s.store, s.category AS product, s.date, sum(price * qty) / sum(qty) AS avg_price
FROM sales s GROUP BY s.store, s.category, s.date""",
    "weather": """
SELECT city, date, temp_mean + dayofyear(date) % 7 AS temp_max, temp_mean - dayofyear(date) % 5 AS temp_min,
       temp_mean, rain + snowfall AS precipitation, rain, snowfall, windspeed_max, weathercode
FROM (SELECT n_name AS city, date, CAST((dayofyear(date) * 7 + n_nationkey * 13) % 50 - 20 AS DOUBLE) AS temp_mean,
             ((dayofyear(date) * 3 + n_nationkey) % 8) * 0.5e0 AS rain,
             ((dayofyear(date) + n_nationkey * 3) % 5) * 0.25e0 AS snowfall,
             CAST((dayofyear(date) * 11 + n_nationkey) % 45 AS DOUBLE) AS windspeed_max,
             CAST(([0, 2, 45, 61, 71, 80, 95])[((dayofyear(date) + n_nationkey) % 7 + 1)] AS DOUBLE) AS weathercode
      FROM (SELECT DISTINCT c_nationkey, CAST(o_orderdate AS DATE) AS date
            FROM orders JOIN customer ON o_custkey = c_custkey) JOIN nation ON c_nationkey = n_nationkey)""",
}


def add_base(name: str, sql: str) -> None:
    """Register one more shared expression; it may use those registered before it."""
    BASE[name] = sql


def with_base(sql: str) -> str:
    """`name AS (...), ` for every shared expression `sql` needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in BASE.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)
    visit(sql)
    return "".join(f"{n} AS ({BASE[n].strip()}),\n" for n in BASE if n in needed)

"""shopgrain: e-commerce analyses as PySpark DataFrame functions.

Every analysis takes logical tables (sessions, page views, orders, order items,
refunds, products) as DataFrames and returns a DataFrame. The common idea is the
*session grain*: facts are pre-aggregated to one row per session (or order, or
item) before they are joined, so reports are plain sums over a 1:1 join.
"""

__version__ = "0.1.0"

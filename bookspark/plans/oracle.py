"""DuckDB SQL that computes the same result as each named query, over the
driver's pre-registered views.  Column names equal the Spark aliases."""
from __future__ import annotations

ORACLE: dict[str, str] = {}

SALES = """
sales AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS order_id,
         CAST(l.l_shipdate AS DATE) AS date,
         p.p_name AS product,
         l.l_quantity AS qty,
         CAST(floor((2 * CAST(round(l.l_extendedprice * 100) AS BIGINT) + CAST(l.l_quantity AS BIGINT))
                    / (2 * CAST(l.l_quantity AS BIGINT))) AS BIGINT) / 100.0 AS unit_price,
         l.l_extendedprice AS total,
         s.s_name AS vendor,
         o.o_orderpriority AS channel,
         o.o_orderstatus AS payment_method,
         concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS line_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

MONEY = "CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))), 0) AS DECIMAL(38,2))"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PRODUCTS = f"""
prod AS (
  SELECT product, {MONEY} AS revenue, CAST(COALESCE(SUM(qty), 0) AS DOUBLE) AS units,
         COUNT(*) AS orders
  FROM sales GROUP BY product
)"""

ORACLE["revenue_summary"] = _with(SALES) + f"""
SELECT {MONEY} AS total_revenue, COUNT(*) AS orders, MIN(date) AS first_date,
       MAX(date) AS last_date,
       CAST({MONEY} AS DOUBLE) / CAST(GREATEST(COUNT(*), 1) AS DOUBLE) AS avg_order_value
FROM sales"""

ORACLE["half_period_change"] = _with(SALES) + f"""
, b AS (SELECT MIN(date) AS mn, MAX(date) AS mx, COUNT(*) AS orders FROM sales)
, h AS (
  SELECT b.orders,
         CAST(COALESCE(SUM(CASE WHEN 2 * (s.date - DATE '1970-01-01') <= (b.mn - DATE '1970-01-01') + (b.mx - DATE '1970-01-01')
                           THEN CAST(s.total AS DECIMAL(18,2)) END), 0) AS DECIMAL(38,2)) AS first_half,
         CAST(COALESCE(SUM(CASE WHEN 2 * (s.date - DATE '1970-01-01') > (b.mn - DATE '1970-01-01') + (b.mx - DATE '1970-01-01')
                           THEN CAST(s.total AS DECIMAL(18,2)) END), 0) AS DECIMAL(38,2)) AS second_half
  FROM sales s CROSS JOIN b GROUP BY b.orders
)
SELECT orders, first_half, second_half,
       CASE WHEN orders > 20 AND first_half <> 0
            THEN (CAST(second_half AS DOUBLE) - CAST(first_half AS DOUBLE)) / CAST(first_half AS DOUBLE) * 100 END AS change_pct,
       (orders > 20 AND first_half <> 0) AS reported
FROM h"""

ORACLE["top_products"] = _with(SALES, PRODUCTS) + """
SELECT product, revenue, units, orders,
       ROW_NUMBER() OVER (ORDER BY revenue DESC, product ASC) AS rank
FROM prod ORDER BY revenue DESC, product ASC LIMIT 5"""

ORACLE["bottom_products"] = _with(SALES, PRODUCTS) + """
SELECT product, revenue, units, orders,
       ROW_NUMBER() OVER (ORDER BY revenue ASC, product ASC) AS rank
FROM prod ORDER BY revenue ASC, product ASC LIMIT 5"""

ORACLE["top_concentration"] = _with(SALES, PRODUCTS) + """
SELECT (SELECT CAST(SUM(revenue) AS DECIMAL(38,2)) FROM (SELECT revenue FROM prod ORDER BY revenue DESC, product LIMIT 5)) AS top_revenue,
       CAST(SUM(revenue) AS DECIMAL(38,2)) AS total_revenue,
       COUNT(*) AS products,
       CAST((SELECT CAST(SUM(revenue) AS DECIMAL(38,2)) FROM (SELECT revenue FROM prod ORDER BY revenue DESC, product LIMIT 5)) AS DOUBLE)
         / CAST(CAST(SUM(revenue) AS DECIMAL(38,2)) AS DOUBLE) * 100 AS top_share_pct
FROM prod"""

ORACLE["tail_share"] = _with(SALES, PRODUCTS) + """
SELECT (SELECT CAST(SUM(revenue) AS DECIMAL(38,2)) FROM (SELECT revenue FROM prod ORDER BY revenue ASC, product LIMIT 5)) AS bottom_revenue,
       CAST(SUM(revenue) AS DECIMAL(38,2)) AS total_revenue,
       COUNT(*) AS products,
       CAST((SELECT CAST(SUM(revenue) AS DECIMAL(38,2)) FROM (SELECT revenue FROM prod ORDER BY revenue ASC, product LIMIT 5)) AS DOUBLE)
         / CAST(CAST(SUM(revenue) AS DECIMAL(38,2)) AS DOUBLE) * 100 AS bottom_share_pct
FROM prod"""

ORACLE["volume_vs_value"] = _with(SALES, PRODUCTS) + """
SELECT (SELECT product FROM prod ORDER BY revenue DESC, product LIMIT 1) AS revenue_leader,
       MAX(revenue) AS leader_revenue,
       (SELECT product FROM prod ORDER BY units DESC, product LIMIT 1) AS units_leader,
       MAX(units) AS leader_units,
       (SELECT product FROM prod ORDER BY revenue DESC, product LIMIT 1)
         <> (SELECT product FROM prod ORDER BY units DESC, product LIMIT 1) AS differs
FROM prod"""

ORACLE["volume_warning"] = _with(SALES, PRODUCTS) + """
, bottom AS (SELECT product, revenue, units, orders,
                    ROW_NUMBER() OVER (ORDER BY revenue ASC, product ASC) AS rank
             FROM prod ORDER BY revenue ASC, product ASC LIMIT 5)
, by_units AS (SELECT product FROM prod ORDER BY units DESC, product ASC LIMIT 5)
SELECT * FROM bottom WHERE product IN (SELECT product FROM by_units)"""

ORACLE["top_products_by_vendor"] = _with(SALES) + f"""
, g AS (SELECT vendor, product, {MONEY} AS revenue, CAST(COALESCE(SUM(qty), 0) AS DOUBLE) AS units,
               COUNT(*) AS orders FROM sales GROUP BY vendor, product)
SELECT * FROM (
  SELECT vendor, product, revenue, units, orders,
         ROW_NUMBER() OVER (PARTITION BY vendor ORDER BY revenue DESC, product ASC) AS rank
  FROM g) WHERE rank <= 3"""

MONTHS = f"""
m AS (SELECT date_trunc('month', date) AS month, {MONEY} AS revenue, COUNT(*) AS orders
      FROM sales GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m),
trend AS (
  SELECT cal.month, strftime(cal.month, '%b %Y') AS month_label,
         COALESCE(m.revenue, CAST(0 AS DECIMAL(38,2))) AS revenue,
         COALESCE(m.orders, 0) AS orders
  FROM cal LEFT JOIN m ON CAST(m.month AS DATE) = cal.month
)"""

ORACLE["monthly_trend"] = _with(SALES, MONTHS) + "SELECT * FROM trend"

ORACLE["monthly_trend_by_vendor"] = _with(SALES) + f"""
, m AS (SELECT vendor, CAST(date_trunc('month', date) AS DATE) AS month, {MONEY} AS revenue, COUNT(*) AS orders
        FROM sales GROUP BY 1, 2)
, cal AS (SELECT vendor, CAST(unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month
          FROM m GROUP BY vendor)
SELECT cal.vendor, cal.month, strftime(cal.month, '%b %Y') AS month_label,
       COALESCE(m.revenue, CAST(0 AS DECIMAL(38,2))) AS revenue, COALESCE(m.orders, 0) AS orders
FROM cal LEFT JOIN m ON m.vendor = cal.vendor AND m.month = cal.month"""

ORACLE["monthly_change"] = _with(SALES, MONTHS) + """
, a AS (SELECT COUNT(*) AS months, MAX(month) AS last_month,
               arg_max(revenue, month) AS last_revenue FROM trend)
, p AS (SELECT arg_max(t.revenue, t.month) AS previous_revenue
        FROM trend t, a WHERE t.month < a.last_month)
SELECT a.months, a.last_month, a.last_revenue, p.previous_revenue,
       CASE WHEN a.months >= 2 AND p.previous_revenue <> 0
            THEN (CAST(a.last_revenue AS DOUBLE) - CAST(p.previous_revenue AS DOUBLE)) / CAST(p.previous_revenue AS DOUBLE) * 100
       END AS change_pct,
       COALESCE(a.months >= 2 AND p.previous_revenue <> 0, false) AS reported
FROM a CROSS JOIN p"""

ORACLE["month_extremes"] = _with(SALES, MONTHS) + """
SELECT (SELECT month FROM trend ORDER BY revenue DESC, month LIMIT 1) AS best_month,
       MAX(revenue) AS best_revenue,
       (SELECT month FROM trend ORDER BY revenue ASC, month LIMIT 1) AS worst_month,
       MIN(revenue) AS worst_revenue,
       COUNT(*) AS months
FROM trend"""

ORACLE["basket_drift"] = _with(SALES, MONTHS) + """
, a AS (
  SELECT COUNT(*) AS months,
         CAST(arg_min(revenue, month) AS DOUBLE) / CAST(GREATEST(arg_min(orders, month), 1) AS DOUBLE) AS aov_first,
         CAST(arg_max(revenue, month) AS DOUBLE) / CAST(GREATEST(arg_max(orders, month), 1) AS DOUBLE) AS aov_last
  FROM trend)
SELECT months, aov_first, aov_last,
       (months >= 2 AND abs(aov_last - aov_first) / GREATEST(aov_first, 1.0) > 0.10) AS reported,
       CASE WHEN aov_last > aov_first THEN 'spending more' ELSE 'spending less' END AS direction
FROM a"""


def _dimension(col: str) -> str:
    return _with(SALES) + f"""
, g AS (SELECT {col} AS value, {MONEY} AS revenue, COUNT(*) AS orders FROM sales GROUP BY 1)
SELECT value, revenue, orders,
       CAST(revenue AS DOUBLE) / CAST((SELECT SUM(revenue) FROM g) AS DOUBLE) * 100 AS share_pct
FROM g"""


ORACLE["by_vendor"] = _dimension("vendor")
ORACLE["by_channel"] = _dimension("channel")
ORACLE["by_payment"] = _dimension("payment_method")

ORACLE["dimension_flags"] = _with(SALES) + f"""
, g AS (SELECT channel AS value, {MONEY} AS revenue, COUNT(*) AS orders FROM sales GROUP BY 1)
, d AS (SELECT value, revenue, orders,
               CAST(revenue AS DOUBLE) / CAST((SELECT SUM(revenue) FROM g) AS DOUBLE) * 100 AS share_pct,
               CAST(revenue AS DOUBLE) / CAST(orders AS DOUBLE) AS aov
        FROM g)
, f AS (
  SELECT (SELECT value FROM d ORDER BY revenue DESC, value LIMIT 1) AS leader,
         MAX(share_pct) AS leader_share_pct,
         (SELECT value FROM d ORDER BY aov DESC, value LIMIT 1) AS high_aov_value,
         MAX(aov) AS high_aov,
         (SELECT value FROM d ORDER BY aov ASC, value LIMIT 1) AS low_aov_value,
         MIN(aov) AS low_aov,
         COUNT(*) AS "values",
         COALESCE(MAX(CASE WHEN value = 'unknown' THEN share_pct END), 0.0) AS unknown_share_pct
  FROM d)
SELECT *, leader_share_pct > 50 AS concentration_risk,
       ("values" >= 2 AND high_aov > low_aov * 1.2) AS basket_gap,
       unknown_share_pct > 2 AS data_gap
FROM f"""

WEEKDAYS = f"""
wd AS (SELECT dayname(date) AS weekday, {MONEY} AS revenue, COUNT(*) AS orders FROM sales GROUP BY 1)"""

ORACLE["quiet_days"] = _with(SALES, WEEKDAYS) + """
SELECT weekday, revenue, orders, ROW_NUMBER() OVER (ORDER BY revenue ASC, weekday ASC) AS rank FROM wd"""

ORACLE["weekday_spread"] = _with(SALES, WEEKDAYS) + """
SELECT (SELECT weekday FROM wd ORDER BY revenue ASC, weekday ASC LIMIT 1) AS quietest_day,
       MIN(revenue) AS quietest_revenue,
       (SELECT weekday FROM wd ORDER BY revenue DESC, weekday DESC LIMIT 1) AS busiest_day,
       MAX(revenue) AS busiest_revenue,
       CAST(MAX(revenue) AS DOUBLE) / GREATEST(CAST(MIN(revenue) AS DOUBLE), 1.0) AS ratio
FROM wd"""

ORACLE["weekend_effect"] = _with(SALES) + """
, d AS (SELECT date, CAST(COALESCE(SUM(CAST(total AS DECIMAL(18,2))), 0) AS DECIMAL(38,2)) AS revenue FROM sales GROUP BY date)
, a AS (
  SELECT CAST(COALESCE(SUM(CASE WHEN dayname(date) IN ('Saturday', 'Sunday') THEN revenue END), 0) AS DOUBLE) / 2 AS weekend_avg,
         CAST(COALESCE(SUM(CASE WHEN dayname(date) NOT IN ('Saturday', 'Sunday') THEN revenue END), 0) AS DOUBLE) / 5 AS weekday_avg,
         COUNT(*) FILTER (WHERE dayname(date) IN ('Saturday', 'Sunday')) AS weekend_dates,
         COUNT(*) FILTER (WHERE dayname(date) NOT IN ('Saturday', 'Sunday')) AS weekday_dates
  FROM d)
SELECT *, COALESCE(weekday_avg <> 0 AND abs(weekend_avg - weekday_avg) / weekday_avg > 0.15, false) AS reported,
       CASE WHEN weekend_avg > weekday_avg THEN 'weekend' ELSE 'weekday' END AS higher
FROM a"""


# ----------------------------------------------------------------- cleaning

RAW = """
j AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
         CAST(l.l_shipdate AS DATE) AS d, p.p_name, s.s_name, s.s_nationkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
k AS (
  SELECT *, l_orderkey * 10 + l_linenumber AS _k,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS tc,
         CAST(floor((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
                    / (2 * CAST(l_quantity AS BIGINT))) AS BIGINT) AS uc
  FROM j
),
base AS (
  SELECT 'shop_' || CAST(s_nationkey AS VARCHAR) AS _file, _k,
         CASE WHEN _k % 211 = 0 THEN 'not a date'
              WHEN _k % 100 < 80 THEN CASE WHEN s_nationkey % 2 = 1 THEN strftime(d, '%m/%d/%Y')
                                           ELSE strftime(d, '%d/%m/%Y') END
              WHEN _k % 100 < 92 THEN strftime(d, '%d-%b-%Y')
              ELSE strftime(d, '%Y-%m-%d') END AS "Date",
         CAST(l_orderkey AS VARCHAR) AS "order id",
         CASE WHEN _k % 10 = 0 THEN '  ' || upper(p_name) || '  ' ELSE p_name END AS "Product ",
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "Qty",
         CASE WHEN _k % 25 = 0 THEN 'NGN' || format('{:,}', uc // 100) || '.' || lpad(CAST(uc % 100 AS VARCHAR), 2, '0')
              ELSE CAST(uc // 100 AS VARCHAR) || '.' || lpad(CAST(uc % 100 AS VARCHAR), 2, '0') END AS "Unit Price (NGN)",
         CAST((CASE WHEN _k % 997 = 0 THEN tc * 2 ELSE tc END) // 100 AS VARCHAR) || '.'
           || lpad(CAST((CASE WHEN _k % 997 = 0 THEN tc * 2 ELSE tc END) % 100 AS VARCHAR), 2, '0') AS "Total",
         s_name AS "Vendor",
         CASE WHEN _k % 37 = 0 THEN NULL
              ELSE ['app', 'App', 'APP', 'walk-in', 'Walk In', 'walkin', 'phone', 'Phone'][_k % 8 + 1] END AS channel,
         CASE WHEN _k % 33 = 0 THEN NULL
              ELSE ['transfer', 'Transfer', 'cash', 'Cash', 'card', 'POS', 'pos'][_k % 7 + 1] END AS "Payment Method"
  FROM k
),
raw AS (
  SELECT _file, _k * 2 AS _row, * EXCLUDE (_file, _k) FROM base
  UNION ALL
  SELECT _file, _k * 2 + 1 AS _row, * EXCLUDE (_file, _k) FROM base WHERE _k % 401 = 0
)"""

DEDUPED = """
dd AS (
  SELECT _file, "Date" AS date, "order id" AS order_id, "Product " AS product, "Qty" AS qty,
         "Unit Price (NGN)" AS unit_price, "Total" AS total, "Vendor" AS vendor, channel,
         "Payment Method" AS payment_method, MIN(_row) AS _row, COUNT(*) AS _copies
  FROM raw GROUP BY ALL
),
pd AS (
  SELECT *, COALESCE(CAST(try_strptime(date, '%Y-%m-%d') AS DATE), CAST(try_strptime(date, '%d-%b-%Y') AS DATE)) AS _u,
         CAST(try_strptime(date, '%d/%m/%Y') AS DATE) AS _dmy,
         CAST(try_strptime(date, '%m/%d/%Y') AS DATE) AS _mdy
  FROM dd
),
fs AS (
  SELECT _file,
         COUNT(*) FILTER (WHERE _u IS NULL AND _dmy IS NOT NULL) AS dmy_hits,
         COUNT(*) FILTER (WHERE _u IS NULL AND _mdy IS NOT NULL) AS mdy_hits,
         bool_and(unit_price IS NULL OR TRY_CAST(unit_price AS DOUBLE) IS NOT NULL) AS price_plain
  FROM pd GROUP BY _file
),
fl AS (
  SELECT pd._file, pd._row, pd._copies, pd.order_id,
         COALESCE(pd._u, CASE WHEN fs.dmy_hits >= fs.mdy_hits THEN pd._dmy ELSE pd._mdy END) AS date,
         TRY_CAST(regexp_replace(pd.qty, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS qty,
         TRY_CAST(regexp_replace(pd.unit_price, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS unit_price,
         TRY_CAST(regexp_replace(pd.total, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS total,
         COALESCE(NOT fs.price_plain AND regexp_matches(pd.unit_price, '[^\\d.]'), false) AS _currency,
         pd.product IS NULL AS _blank_product, pd.vendor IS NULL AS _blank_vendor,
         pd.channel IS NULL AS _blank_channel, pd.payment_method IS NULL AS _blank_payment_method,
         regexp_replace(
           array_to_string(list_transform(
             regexp_extract_all(lower(regexp_replace(COALESCE(pd.product, 'unknown'), '^\\s+|\\s+$', '', 'g')), '(\\pL+|[^\\pL]+)'),
             lambda x: upper(x[1]) || x[2:]), ''),
           '\\s+', ' ', 'g') AS product,
         regexp_replace(COALESCE(pd.vendor, 'unknown'), '^\\s+|\\s+$', '', 'g') AS vendor,
         CASE regexp_replace(regexp_replace(lower(regexp_replace(COALESCE(pd.channel, 'unknown'), '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')
              WHEN 'walk in' THEN 'walk-in' WHEN 'walkin' THEN 'walk-in'
              ELSE regexp_replace(regexp_replace(lower(regexp_replace(COALESCE(pd.channel, 'unknown'), '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') END AS channel,
         CASE regexp_replace(regexp_replace(lower(regexp_replace(COALESCE(pd.payment_method, 'unknown'), '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')
              WHEN 'pos' THEN 'card'
              ELSE regexp_replace(regexp_replace(lower(regexp_replace(COALESCE(pd.payment_method, 'unknown'), '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') END AS payment_method
  FROM pd JOIN fs USING (_file)
),
fm AS (
  SELECT *, qty * unit_price AS _expected,
         COALESCE(abs(total - qty * unit_price) > 1, false) AS _mismatch,
         date IS NOT NULL AS _date_ok
  FROM fl
),
rep AS (
  SELECT _file,
         CAST(SUM(_copies) AS BIGINT) AS rows_in,
         COUNT(*) FILTER (WHERE _date_ok) AS rows_out,
         CAST(SUM(_copies - 1) AS BIGINT) AS duplicates_removed,
         COUNT(*) FILTER (WHERE _date_ok) AS dates_parsed,
         COUNT(*) FILTER (WHERE NOT _date_ok) AS dates_failed,
         COUNT(*) FILTER (WHERE _date_ok AND _currency) AS currency_stripped,
         COUNT(*) FILTER (WHERE _date_ok AND _mismatch) AS total_mismatches,
         COUNT(*) FILTER (WHERE _date_ok AND _blank_product) AS blanks_product,
         COUNT(*) FILTER (WHERE _date_ok AND _blank_vendor) AS blanks_vendor,
         COUNT(*) FILTER (WHERE _date_ok AND _blank_channel) AS blanks_channel,
         COUNT(*) FILTER (WHERE _date_ok AND _blank_payment_method) AS blanks_payment_method
  FROM fm GROUP BY _file
)"""

ORACLE["clean_rows"] = _with(RAW, DEDUPED) + """
SELECT _file, _row, order_id, date, product, qty, unit_price, total, vendor, channel, payment_method
FROM fm WHERE _date_ok"""

ORACLE["clean_report"] = _with(RAW, DEDUPED) + "SELECT * FROM rep"

ORACLE["dedupe_exact"] = _with(RAW) + """
SELECT _file, CAST(SUM(_copies) AS BIGINT) AS rows_in, COUNT(*) AS distinct_rows,
       CAST(SUM(_copies - 1) AS BIGINT) AS duplicates_removed
FROM (SELECT _file, "Date", "order id", "Product ", "Qty", "Unit Price (NGN)", "Total", "Vendor", channel,
             "Payment Method", COUNT(*) AS _copies FROM raw GROUP BY ALL) g
GROUP BY _file"""

ORACLE["date_order_by_file"] = _with(RAW, DEDUPED) + """
SELECT _file, dmy_hits, mdy_hits, dmy_hits >= mdy_hits AS day_first FROM fs"""

ORACLE["parse_mixed_dates"] = _with(RAW, DEDUPED) + "SELECT _file, _row, order_id, date FROM fm"

ORACLE["parse_numbers"] = _with(RAW, DEDUPED) + """
SELECT _file, _row, qty, unit_price, total FROM fm WHERE _date_ok"""

ORACLE["currency_count"] = _with(RAW, DEDUPED) + "SELECT _file, currency_stripped FROM rep"

ORACLE["fill_blanks"] = _with(RAW, DEDUPED) + """
SELECT _file, blanks_product, blanks_vendor, blanks_channel, blanks_payment_method FROM rep"""

ORACLE["normalise_categories"] = _with(RAW) + """
, c AS (SELECT 'channel' AS "column", channel AS raw_value, COUNT(*) AS "rows" FROM raw GROUP BY 2
        UNION ALL
        SELECT 'payment_method', "Payment Method", COUNT(*) FROM raw GROUP BY 2)
, n AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(COALESCE(raw_value, 'unknown'), '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS v FROM c)
SELECT "column", raw_value,
       CASE WHEN "column" = 'channel' AND v IN ('walk in', 'walkin') THEN 'walk-in'
            WHEN "column" = 'payment_method' AND v = 'pos' THEN 'card' ELSE v END AS value,
       "rows"
FROM n"""

ORACLE["title_products"] = _with(RAW) + """
, g AS (SELECT "Product " AS raw_value, COUNT(*) AS "rows" FROM raw GROUP BY 1)
SELECT raw_value,
       regexp_replace(array_to_string(list_transform(
         regexp_extract_all(lower(regexp_replace(COALESCE(raw_value, 'unknown'), '^\\s+|\\s+$', '', 'g')), '(\\pL+|[^\\pL]+)'),
         lambda x: upper(x[1]) || x[2:]), ''), '\\s+', ' ', 'g') AS product,
       "rows"
FROM g"""

ORACLE["arithmetic_mismatches"] = _with(RAW, DEDUPED) + """
SELECT _file, _row, order_id, total AS recorded_total, _expected AS expected_total
FROM fm WHERE _date_ok AND _mismatch"""

ORACLE["mismatch_sample"] = _with(RAW, DEDUPED) + """
SELECT _file, _row, order_id, recorded_total, expected_total FROM (
  SELECT _file, _row, order_id, total AS recorded_total, _expected AS expected_total,
         ROW_NUMBER() OVER (PARTITION BY _file ORDER BY _row, order_id, total, _expected) AS _k
  FROM fm WHERE _date_ok AND _mismatch) WHERE _k <= 50"""

ORACLE["summary_lines"] = _with(RAW, DEDUPED) + """
SELECT _file, list_filter([
  'Loaded ' || rows_in || ' rows, kept ' || rows_out || '.',
  CASE WHEN duplicates_removed > 0 THEN 'Removed ' || duplicates_removed || ' duplicate rows.' END,
  CASE WHEN currency_stripped > 0 THEN 'Stripped currency text from ' || currency_stripped || ' price cells.' END,
  CASE WHEN dates_failed > 0 THEN dates_failed || ' dates could not be parsed.' END,
  CASE WHEN blanks_product > 0 THEN 'Filled ' || blanks_product || ' blank values in ''product'' as ''unknown''.' END,
  CASE WHEN blanks_vendor > 0 THEN 'Filled ' || blanks_vendor || ' blank values in ''vendor'' as ''unknown''.' END,
  CASE WHEN blanks_channel > 0 THEN 'Filled ' || blanks_channel || ' blank values in ''channel'' as ''unknown''.' END,
  CASE WHEN blanks_payment_method > 0 THEN 'Filled ' || blanks_payment_method || ' blank values in ''payment_method'' as ''unknown''.' END,
  CASE WHEN total_mismatches > 0 THEN 'Found ' || total_mismatches || ' rows where Total does not equal Qty x Unit Price — likely manual entry errors.' END
], lambda x: x IS NOT NULL) AS lines
FROM rep"""

ORACLE["clean_status"] = _with(RAW, DEDUPED) + """
SELECT _file, CASE WHEN rows_out > 0 THEN 'ok' ELSE 'empty' END AS status,
       CASE WHEN rows_out > 0 THEN NULL
            WHEN rows_in = 0 THEN 'The file has no data rows — only a header, or nothing at all.'
            WHEN dates_failed > 0 AND dates_failed >= rows_in - duplicates_removed
              THEN 'All ' || rows_in || ' row(s) were read, but every date failed to parse — check the date column''s format.'
            WHEN duplicates_removed >= rows_in THEN 'All ' || rows_in || ' row(s) were exact duplicates of each other.'
            ELSE rows_in || ' row(s) were read, but none survived cleaning.' END AS error
FROM rep"""


# ---------------------------------------------------------------- retrieval

def _values(rows) -> str:
    return ", ".join(f"({i}, '{t}')" for i, t in rows)


def _bm25(docs_sql: str, queries, top_k: int, q_sql: str | None = None) -> str:
    q_cte = q_sql if q_sql is not None else f"SELECT * FROM (VALUES {_values(queries)}) t(query_id, text)"
    return f"""
docs AS ({docs_sql}),
lens AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS length FROM docs),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM docs),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM toks GROUP BY ALL),
st AS (SELECT COUNT(*) AS n, CAST(SUM(length) AS DOUBLE) / GREATEST(COUNT(*), 1) AS avg_len FROM lens),
idf AS (SELECT term, COUNT(*) AS df, ln(1 + ((SELECT n FROM st) - COUNT(*) + 0.5) / (COUNT(*) + 0.5)) AS idf
        FROM tf GROUP BY term),
q AS ({q_cte}),
qt AS (SELECT query_id, term, COUNT(*) AS qtf
       FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM q) GROUP BY ALL),
sc AS (SELECT qt.query_id, tf.doc_id,
              SUM(idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * lens.length / st.avg_len)) * qt.qtf) AS score
       FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (doc_id) CROSS JOIN st
       GROUP BY ALL),
hits AS (SELECT query_id, doc_id, score, rank FROM (
           SELECT query_id, doc_id, round(score, 6) AS score,
                  ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id ASC) AS rank
           FROM sc WHERE score > 0) WHERE rank <= {top_k})"""


SALES_DOCS = ("SELECT line_id AS doc_id, concat_ws(' ', product, vendor, channel, payment_method, "
              "strftime(date, '%B %Y %A')) AS text FROM sales")

from bookspark.plans.catalog import DOCUMENT_QUERIES, SEARCH_QUERIES  # noqa: E402

ORACLE["row_documents"] = _with(SALES) + ", docs AS (" + SALES_DOCS + ") SELECT * FROM docs"

ORACLE["bm25_terms"] = _with(SALES, _bm25(SALES_DOCS, SEARCH_QUERIES, 20)) + "SELECT term, df, idf FROM idf"

ORACLE["bm25_search"] = _with(SALES, _bm25(SALES_DOCS, SEARCH_QUERIES, 20)) + "SELECT * FROM hits"

ORACLE["bm25_documents"] = _with(_bm25("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents",
                                       DOCUMENT_QUERIES, 10)) + "SELECT * FROM hits"


def _period(rows: str, key: str = "") -> str:
    """A1 with A2 over ``rows`` (date, total), by ``key`` if given."""
    by, join = (f"GROUP BY {key}", f"USING ({key})") if key else ("", "ON true")
    days = "2 * (r.date - DATE '1970-01-01') {} (b.mn - DATE '1970-01-01') + (b.mx - DATE '1970-01-01')"
    half = "CAST(COALESCE(SUM(CASE WHEN " + days + " THEN CAST(r.total AS DECIMAL(18,2)) END), 0) AS DECIMAL(38,2))"
    k = f"{key}, " if key else ""
    return f"""(SELECT *, CAST(total_revenue AS DOUBLE) / CAST(GREATEST(orders, 1) AS DOUBLE) AS avg_order_value,
       CASE WHEN orders > 20 AND first_half <> 0
            THEN (CAST(second_half AS DOUBLE) - CAST(first_half AS DOUBLE)) / CAST(first_half AS DOUBLE) * 100 END AS change_pct
FROM (SELECT {k}{MONEY.replace('total', 'r.total')} AS total_revenue, COUNT(*) AS orders, MIN(r.date) AS first_date, MAX(r.date) AS last_date,
             {half.format('<=')} AS first_half, {half.format('>')} AS second_half
      FROM {rows} r JOIN (SELECT {k}MIN(date) AS mn, MAX(date) AS mx FROM {rows} {by}) b {join} {by}))"""


SUMMARY = ["total_revenue", "orders", "first_date", "last_date", "avg_order_value", "first_half", "second_half", "change_pct"]
RETRIEVED = f"""
, hr AS (SELECT h.query_id, s.date, s.total FROM hits h JOIN sales s ON s.line_id = h.doc_id)
, agg AS {_period('hr', 'query_id')}
, whole AS {_period('sales')}"""
PICKED = ", ".join(f"CASE WHEN a.orders IS NOT NULL THEN a.{c} ELSE w.{c} END AS {c}" for c in SUMMARY)
PICKED_HEAD = """CASE WHEN a.orders IS NOT NULL THEN 'Summary of the ' || a.orders || ' orders most relevant to your question'
            ELSE 'Overall sales performance' END AS headline"""

ORACLE["retrieval_summary"] = _with(SALES, _bm25(SALES_DOCS, SEARCH_QUERIES, 50)) + RETRIEVED + f"""
SELECT q.query_id, {PICKED}, {PICKED_HEAD}
FROM q LEFT JOIN agg a USING (query_id) CROSS JOIN whole w"""


# ------------------------------------------------------------- verification

NARRATIONS = f"""
g AS (SELECT vendor, product, {MONEY} AS revenue, COUNT(*) AS orders, SUM(qty) AS units
      FROM sales GROUP BY vendor, product),
nar AS (
  SELECT vendor || ' | ' || product AS id,
         'Sales of ' || product || ' via ' || vendor || chr(10) || 'revenue: NGN ' || format('{{:,}}', CAST(floor(revenue) AS BIGINT))
           || chr(10) || 'orders: ' || format('{{:,}}', orders) || chr(10) || 'units: ' || printf('%.1f', units) AS context,
         'You earned NGN ' || format('{{:,}}', CASE WHEN orders % 3 = 0 THEN CAST(floor(revenue) AS BIGINT) + 1000
                                                   ELSE CAST(floor(revenue) AS BIGINT) END)
           || ' from ' || product || ' across ' || orders || ' orders.' AS answer1,
         CASE WHEN orders % 7 = 0 THEN NULL
              ELSE '<think>checking</think> Your ' || product || ' sales reached NGN ' || format('{{:,}}', CAST(floor(revenue) AS BIGINT))
                   || ' over ' || orders || ' orders, ' || printf('%.1f', CASE WHEN orders % 5 = 0 THEN units + 7 ELSE units END)
                   || ' units in 3 years.' END AS answer2
  FROM g
)"""

NUM = r"\d[\d,]*(?:\.\d+)?%?"


def _norm(x: str) -> str:
    return f"regexp_replace(replace(regexp_replace({x}, '%$', ''), ',', ''), '\\.0$', '')"


def _unsupported(answer: str, context: str) -> str:
    return (f"list_filter(regexp_extract_all({answer}, '{NUM}'), lambda x: NOT regexp_matches(x, '^\\d$') "
            f"AND NOT list_contains(list_transform(regexp_extract_all({context}, '{NUM}'), lambda y: {_norm('y')}), {_norm('x')}))")


ORACLE["extract_numbers"] = _with(SALES, NARRATIONS) + f"""
SELECT id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS token
FROM (SELECT id, regexp_extract_all(answer1, '{NUM}') AS l FROM nar)"""

ORACLE["unsupported_numbers"] = _with(SALES, NARRATIONS) + f"""
SELECT id, {_unsupported('answer1', 'context')} AS unsupported FROM nar"""

STRIP2 = ("regexp_replace(CASE WHEN contains(answer2, '</think>') THEN regexp_replace(answer2, '(?s)^.*?</think>', '') "
          "ELSE answer2 END, '^\\s+|\\s+$', '', 'g')")
STRIP1 = ("regexp_replace(CASE WHEN contains(answer1, '</think>') THEN regexp_replace(answer1, '(?s)^.*?</think>', '') "
          "ELSE answer1 END, '^\\s+|\\s+$', '', 'g')")

RESOLVED = f"""
r0 AS (SELECT id, context, answer2, {STRIP1} AS a1, {STRIP2} AS a2 FROM nar),
r1 AS (SELECT *, {_unsupported('a1', 'context')} AS bad1, {_unsupported('a2', 'context')} AS bad2 FROM r0),
r AS (
  SELECT id,
         CASE WHEN len(bad1) = 0 THEN 'verified' WHEN answer2 IS NULL THEN 'needs_retry'
              WHEN len(bad2) = 0 THEN 'verified_after_retry' ELSE 'flagged' END AS state,
         (len(bad1) = 0 OR (answer2 IS NOT NULL AND len(bad2) = 0)) AS verified,
         (len(bad1) > 0 AND answer2 IS NOT NULL) AS retried,
         CASE WHEN len(bad1) = 0 THEN []::VARCHAR[] WHEN answer2 IS NULL THEN bad1
              WHEN len(bad2) = 0 THEN []::VARCHAR[] ELSE bad2 END AS unsupported,
         a2 || chr(10) || chr(10) || '⚠️ Unverified: this answer states a number not found in the computed figures ('
           || array_to_string(list_sort(list_distinct(bad2)), ', ') || ') — treat it with caution.' AS flagged_text
  FROM r1)"""

ORACLE["resolve_attempts"] = _with(SALES, NARRATIONS, RESOLVED) + \
    "SELECT id, state, verified, retried, unsupported FROM r"

ORACLE["flag_text"] = _with(SALES, NARRATIONS, RESOLVED) + \
    "SELECT id, flagged_text AS text FROM r WHERE state = 'flagged'"


# ------------------------------------------------------------------ routing

def _hint_sql(col: str) -> str:
    from bookspark.operators.routing import HINT_WORDS
    parts = []
    for label, words in HINT_WORDS:
        cond = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


ORACLE["dimension_hint"] = f"""
SELECT conv_id, turn, {_hint_sql('text')} AS hint FROM conversations WHERE role = 'user'"""

ORACLE["parse_label"] = """
WITH t AS (
  SELECT conv_id, turn,
         lower(regexp_replace(CASE WHEN contains(text, '</think>') THEN regexp_replace(text, '(?s)^.*?</think>', '')
                                   ELSE text END, '^\\s+|\\s+$', '', 'g')) AS x
  FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, turn, regexp_replace(regexp_extract(x, '^(\\S+)', 1), '^[:.,]+|[:.,]+$', '', 'g') AS w FROM t)
SELECT conv_id, turn, CASE WHEN w IN ('ranking_by_product', 'worst_by_product', 'monthly_trend', 'ranking_by_vendor',
       'ranking_by_channel', 'ranking_by_payment', 'quiet_days', 'revenue_summary') THEN w END AS label
FROM f"""

ORACLE["csv_roundtrip"] = _with(RAW) + """
SELECT _file AS shop,
       CASE CAST(regexp_extract(_file, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter,
       'utf-8-sig' AS encoding, 'csv' AS container, COUNT(*) AS "rows"
FROM raw GROUP BY _file"""


# The same clean rows, whatever the files' headers or containers.
_LOADED = _with(RAW, DEDUPED) + """
SELECT _file AS shop, order_id, date, product, qty, unit_price, total, vendor, channel, payment_method FROM fm WHERE _date_ok"""
ORACLE["mixed_case_load"] = _LOADED
ORACLE["xlsx_load"] = _LOADED

ORACLE["csv_values"] = _with(RAW) + """
SELECT _file AS shop, "order id" || '-' || CAST(_row AS VARCHAR) AS key,
       "Product " || chr(10) || '"x, y; z"' || chr(9) || '€ “é” –' || chr(13) || chr(10) || "Vendor" AS text, "Qty" AS qty,
       CASE n % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter,
       CASE n % 3 WHEN 1 THEN 'windows-1252' ELSE 'utf-8-sig' END AS encoding
FROM (SELECT *, CAST(regexp_extract(_file, '(\\d+)$', 1) AS INTEGER) AS n FROM raw)"""

ORACLE["load_outcomes"] = _with(RAW) + """
SELECT _file AS shop, CASE n % 6 WHEN 0 THEN 'ok' WHEN 3 THEN 'missing_columns' WHEN 4 THEN 'error' WHEN 5 THEN 'error' ELSE 'empty' END AS status,
       CASE n % 6 WHEN 1 THEN 'The file has no data rows — only a header, or nothing at all.'
                  WHEN 2 THEN 'All ' || CAST("rows" AS VARCHAR) || ' row(s) were read, but every date failed to parse — check the date column''s format.'
                  WHEN 3 THEN 'Missing columns: product, qty. Needs: date, product, qty, unit_price, total. Found: Date, Qty, Total.'
                  WHEN 4 THEN 'Couldn''t read that as a CSV: 1 row(s) have more fields than the header.'
                  WHEN 5 THEN 'Couldn''t read that as a CSV: a quoted field is never closed.' END AS error
FROM (SELECT _file, CAST(regexp_extract(_file, '(\\d+)$', 1) AS INTEGER) AS n, COUNT(*) AS "rows" FROM raw GROUP BY _file)"""

ORACLE["dedupe_typed"] = """
WITH t AS (
  SELECT l_partkey % 4 AS kind, l_orderkey * 10 + l_linenumber AS _row, l_orderkey // 8 AS n FROM lineitem
), v AS (
  SELECT 'f' || CAST(kind AS VARCHAR) AS _file, kind, _row,
         CASE kind WHEN 0 THEN CAST(12345678901200000 + n AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) || ['D', 'F', 'L'][_row % 3 + 1]
                   WHEN 2 THEN '0x1p' || CAST(n % 500 AS VARCHAR) ELSE '184467440737095' || lpad(CAST(n % 50000 AS VARCHAR), 5, '0') END AS id,
         CASE kind WHEN 0 THEN ['1', '1.0', '1e0'][_row % 3 + 1] WHEN 1 THEN CASE WHEN _row % 7 = 0 THEN 'x' ELSE ['1', '1.0', '2'][_row % 3 + 1] END
                   WHEN 2 THEN ['007', '7', '+7'][_row % 3 + 1] ELSE ['TRUE', 'true', 'False'][_row % 3 + 1] END AS num
  FROM t
)
SELECT _file, MIN(_row) AS _row, id, arg_min(num, _row) AS num, COUNT(*) AS copies
FROM v GROUP BY _file, id, CASE kind WHEN 0 THEN '1' WHEN 2 THEN '7' WHEN 3 THEN lower(num) ELSE num END"""


# ------------------------------------------------------- mapping, sheets, sinks

ORACLE["apply_mapping"] = _with(RAW) + """
SELECT _file, _row, "order id" AS order_id, "Date" AS date, "Product " AS product, "Qty" AS qty,
       "Unit Price (NGN)" AS unit_price, "Total" AS total, "Vendor" AS vendor, channel,
       "Payment Method" AS payment_method
FROM raw"""

ORACLE["report_rows"] = _with(SALES, PRODUCTS) + """
, top AS (SELECT product, revenue FROM prod ORDER BY revenue DESC, product ASC LIMIT 5)
SELECT 0 AS ord, 0 AS pos, 'question' AS section, 'Question' AS label, 'top products' AS value
UNION ALL SELECT 1, 0, 'headline', 'Headline', 'Top 5 products by revenue'
UNION ALL SELECT 2, ROW_NUMBER() OVER (ORDER BY revenue DESC, product ASC) - 1, 'table', product, CAST(revenue AS VARCHAR) FROM top"""

CELLS = """
cols AS (SELECT * FROM (VALUES (0, 'Date'), (1, 'order id'), (2, 'Product '), (3, 'Qty'), (4, 'Unit Price (NGN)'),
                               (5, 'Total'), (6, 'Vendor'), (7, 'channel'), (8, 'Payment Method')) t(col, name)),
files AS (SELECT DISTINCT _file FROM raw),
data AS (
  SELECT _file, CAST(_row + 10 AS INTEGER) AS row, col, value FROM (
    SELECT _file, _row, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS col,
           unnest(["Date", "order id", "Product ", "Qty", "Unit Price (NGN)", "Total", "Vendor", channel, "Payment Method"]) AS value
    FROM raw) WHERE value IS NOT NULL),
cells AS (
  SELECT _file, 'Sales' AS sheet, row, col,
         CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'text' END AS type, value FROM data
  UNION ALL SELECT _file, 'Sales', 0, 0, 'text', 'Sales export' FROM files
  UNION ALL SELECT _file, 'Sales', 1, 0, 'text', 'Generated by the till' FROM files
  UNION ALL SELECT _file, 'Sales', 1, 1, 'number', '2026' FROM files
  UNION ALL SELECT f._file, 'Sales', 2, c.col, 'text', c.name FROM files f CROSS JOIN cols c
)"""

ORACLE["sheet_listing"] = _with(RAW, CELLS) + """
, dims AS (SELECT _file, sheet, MAX(row) + 1 AS rows, MAX(col) + 1 AS cols FROM cells GROUP BY ALL)
, pv AS (SELECT _file, sheet, list(regexp_replace(value, '^\\s+|\\s+$', '', 'g') ORDER BY col)[1:6] AS preview
         FROM cells WHERE row = 0 AND regexp_replace(value, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL)
SELECT dims._file, dims.sheet, rows, cols, preview FROM dims LEFT JOIN pv USING (_file, sheet)"""

ROW_PROFILE = """
sc AS (SELECT _file, sheet, CAST(unnest(range(0, LEAST(MAX(row), 14) + 1)) AS INTEGER) AS row FROM cells GROUP BY _file, sheet),
wd AS (SELECT _file, sheet, MAX(col) + 1 AS width FROM cells GROUP BY ALL),
nb AS (SELECT c.* FROM cells c JOIN sc USING (_file, sheet, row)
       WHERE regexp_replace(c.value, '^\\s+|\\s+$', '', 'g') <> ''),
p AS (SELECT _file, sheet, row, COUNT(*) AS non_empty, COUNT(*) FILTER (WHERE type = 'text') AS t,
             COUNT(DISTINCT lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g'))) AS d, AVG(length(value)) AS avg_len
      FROM nb GROUP BY ALL),
rp AS (
  SELECT sc._file, sc.sheet, sc.row, COALESCE(p.non_empty, 0) AS non_empty,
         COALESCE(p.non_empty, 0) / GREATEST(wd.width, 1) AS fill_ratio,
         CASE WHEN COALESCE(p.non_empty, 0) > 0 THEN p.t / p.non_empty ELSE 0.0 END AS text_ratio,
         CASE WHEN COALESCE(p.non_empty, 0) > 0 THEN p.d / p.non_empty ELSE 0.0 END AS distinct_ratio,
         COALESCE(p.avg_len, 0.0) AS avg_len
  FROM sc LEFT JOIN p USING (_file, sheet, row) JOIN wd USING (_file, sheet))"""

ORACLE["row_profile"] = _with(RAW, CELLS, ROW_PROFILE) + "SELECT * FROM rp"

ORACLE["header_scores"] = _with(RAW, CELLS, ROW_PROFILE) + """
, f AS (SELECT *, COALESCE(AVG(text_ratio) OVER (PARTITION BY _file, sheet ORDER BY row
                                                  ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), text_ratio) AS follow FROM rp)
, s AS (SELECT _file, sheet, row,
               CASE WHEN non_empty < 2 THEN -1.0
                    ELSE fill_ratio * 1.0 + text_ratio * 1.5 + distinct_ratio * 0.5 - follow * 0.8
                         - CASE WHEN avg_len > 40 THEN 0.3 ELSE 0.0 END END AS score FROM f)
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY _file, sheet ORDER BY score DESC, row ASC) AS rank,
               COALESCE(LEAD(score) OVER (PARTITION BY _file, sheet ORDER BY score DESC, row ASC), -999.0) AS second
        FROM s)
SELECT _file, sheet, row, round(score, 3) AS score, rank,
       (rank = 1 AND score - second >= 0.3 AND score >= 1.2) AS confident
FROM r"""

PROFILE_CELLS = """
names AS (SELECT * FROM (VALUES (0, 'Date', 'date'), (1, 'order id', 'order_id'), (2, 'Product ', 'product'),
                                (3, 'Qty', 'qty'), (4, 'Unit Price (NGN)', 'unit_price'), (5, 'Total', 'total'),
                                (6, 'Vendor', 'vendor'), (7, 'channel', 'channel'),
                                (8, 'Payment Method', 'payment_method')) t(position, "column", normalized)),
long AS (
  SELECT _file, _row, position, value FROM (
    SELECT _file, _row, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS position,
           unnest(["Date", "order id", "Product ", "Qty", "Unit Price (NGN)", "Total", "Vendor", channel, "Payment Method"]) AS value
    FROM raw)
  WHERE value IS NOT NULL AND regexp_replace(value, '^\\s+|\\s+$', '', 'g') <> ''),
ranked AS (SELECT *, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS text,
                  ROW_NUMBER() OVER (PARTITION BY _file, position ORDER BY _row, value) AS rn FROM long),
grid AS (SELECT f._file, n.* FROM (SELECT DISTINCT _file FROM raw) f CROSS JOIN names n)"""

DATE_FORMATS_SQL = ("['%Y-%m-%d', '%d-%b-%Y', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%Y', "
                    "'%d.%m.%Y', '%d %b %Y', '%d %B %Y']")

ORACLE["column_profile"] = _with(RAW, PROFILE_CELLS) + f"""
, kd AS (
  SELECT _file, position, COUNT(*) AS n,
         COUNT(*) FILTER (WHERE TRY_CAST(regexp_replace(value, '[^0-9.\\-]', '', 'g') AS DOUBLE) IS NOT NULL) AS num,
         COUNT(*) FILTER (WHERE regexp_matches(text, '\\d') AND regexp_matches(text, '[/-]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec', 'i')
                          AND try_strptime(text, {DATE_FORMATS_SQL}) IS NOT NULL) AS dt
  FROM ranked WHERE rn <= 6 GROUP BY ALL)
SELECT g._file, g."column", g.position, g.normalized,
       CASE WHEN COALESCE(k.n, 0) = 0 THEN 'empty'
            WHEN k.dt / k.n >= 0.5 THEN 'date' WHEN k.num / k.n >= 0.5 THEN 'numeric' ELSE 'text' END AS kind,
       CASE WHEN COALESCE(k.n, 0) > 0 THEN k.num / k.n ELSE 0.0 END AS numeric_ratio,
       CASE WHEN COALESCE(k.n, 0) > 0 THEN k.dt / k.n ELSE 0.0 END AS date_ratio
FROM grid g LEFT JOIN kd k USING (_file, position)"""

ORACLE["column_samples"] = _with(RAW, PROFILE_CELLS) + """
, firsts AS (SELECT _file, position, text, MIN(rn) AS first FROM ranked GROUP BY ALL)
, top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY _file, position ORDER BY first) AS k FROM firsts) WHERE k <= 3)
, s AS (SELECT _file, position, list(text ORDER BY k) AS samples FROM top GROUP BY ALL)
SELECT g._file, g."column", COALESCE(s.samples, []::VARCHAR[]) AS samples
FROM grid g LEFT JOIN s USING (_file, position)"""


# Shops with their own headers (shop number modulo 4): 2 has no order id, vendor or
# payment method and keeps a note; 3 lacks required columns and is rejected.
MIXED = RAW.replace("raw AS (", "raw_all AS (") + """,
raw AS (
  SELECT _file, _row, "Date", CASE WHEN kind = 2 THEN NULL ELSE "order id" END AS "order id", "Product ", "Qty",
         "Unit Price (NGN)", "Total", CASE WHEN kind = 2 THEN NULL ELSE "Vendor" END AS "Vendor", channel,
         CASE WHEN kind = 2 THEN NULL ELSE "Payment Method" END AS "Payment Method",
         CASE WHEN kind = 2 THEN (_row // 2) % 3 END AS note
  FROM (SELECT *, CAST(regexp_extract(_file, '(\\d+)$', 1) AS INTEGER) % 4 AS kind FROM raw_all) WHERE kind <> 3
)"""
MIXED_KIND = "CAST(regexp_extract(_file, '(\\d+)$', 1) AS INTEGER) % 4"

ORACLE["mixed_clean_rows"] = _with(MIXED, DEDUPED.replace("MIN(_row) AS _row", "note, MIN(_row) AS _row")) + f"""
SELECT _file, _row, order_id, date, product, qty, unit_price, total,
       CASE WHEN {MIXED_KIND} <> 2 THEN vendor END AS vendor, channel,
       CASE WHEN {MIXED_KIND} <> 2 THEN payment_method END AS payment_method,
       CASE WHEN {MIXED_KIND} = 2 THEN 'note-' || CAST((_row // 2) % 3 AS VARCHAR) END AS note
FROM fm WHERE _date_ok"""

ORACLE["mixed_clean_report"] = _with(MIXED, DEDUPED.replace("MIN(_row) AS _row", "note, MIN(_row) AS _row")) + f"""
SELECT * REPLACE (CASE WHEN {MIXED_KIND} = 2 THEN 0 ELSE blanks_vendor END AS blanks_vendor,
                  CASE WHEN {MIXED_KIND} = 2 THEN 0 ELSE blanks_payment_method END AS blanks_payment_method)
FROM rep"""

ORACLE["mixed_mapping"] = _with(RAW) + f"""
SELECT f._file, m.target, m.source
FROM (SELECT DISTINCT _file, {MIXED_KIND} AS kind FROM raw) f
JOIN (VALUES (0, 'date', 'Date'), (0, 'order_id', 'order id'), (0, 'product', 'Product '), (0, 'qty', 'Qty'),
             (0, 'unit_price', 'Unit Price (NGN)'), (0, 'total', 'Total'),
             (1, 'date', 'Day'), (1, 'order_id', 'Receipt No'), (1, 'product', 'Goods'), (1, 'qty', 'Pieces'),
             (1, 'unit_price', 'Price'), (1, 'total', 'Amount'),
             (2, 'date', 'Date'), (2, 'product', 'Item'), (2, 'qty', 'Quantity'), (2, 'unit_price', 'Rate'), (2, 'total', 'Amount'),
             (3, 'date', 'Date'), (3, 'product', 'Total'), (3, 'qty', 'Qty'), (3, 'unit_price', 'Qty'), (3, 'total', 'Total')
     ) m(kind, target, source) USING (kind)"""

ORACLE["file_outcomes"] = _with(RAW) + f"""
SELECT DISTINCT _file, CASE WHEN {MIXED_KIND} = 3 THEN 'missing_columns' ELSE 'ok' END AS status,
       CASE WHEN {MIXED_KIND} = 3 THEN 'Missing columns: product, qty. Needs: date, product, qty, unit_price, total. Found: Date, Qty, Total.' END AS error
FROM raw"""


LABEL_SQL = """CASE WHEN w IN ('ranking_by_product', 'worst_by_product', 'monthly_trend', 'ranking_by_vendor',
       'ranking_by_channel', 'ranking_by_payment', 'quiet_days', 'revenue_summary') THEN w END"""

QUESTIONS = f"""
rp AS (
  SELECT conv_id, turn - 1 AS turn,
         regexp_replace(regexp_extract(lower(regexp_replace(CASE WHEN contains(text, '</think>')
             THEN regexp_replace(text, '(?s)^.*?</think>', '') ELSE text END, '^\\s+|\\s+$', '', 'g')), '^(\\S+)', 1),
           '^[:.,]+|[:.,]+$', '', 'g') AS w
  FROM conversations WHERE role = 'assistant'),
questions AS (
  SELECT u.conv_id * 1000 + u.turn AS question_id, u.text, {LABEL_SQL} AS label
  FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') u
  LEFT JOIN rp ON rp.conv_id = u.conv_id AND rp.turn = u.turn)"""

from bookspark.sources.tables import LOG_LABELS, LOG_QUESTIONS  # noqa: E402

ROUTED = f"""
l AS (SELECT conv_id * 1000 + turn AS id, {LOG_LABELS!r} AS labels, {LOG_QUESTIONS!r} AS questions FROM conversations),
o AS (SELECT id, CAST(id % 3 AS INTEGER) AS run, questions[id % 8 + 1] AS question, labels[id % 8 + 1] AS expected,
             CAST((id % 7) / 2 AS DOUBLE) AS seconds,
             CASE id % 5 WHEN 2 THEN 'i' WHEN 3 THEN labels[(id + 3) % 8 + 1] ELSE labels[id % 8 + 1] END AS word FROM l),
routed AS (SELECT *, CASE WHEN word <> 'i' THEN word END AS got FROM o)"""

ORACLE["routed_log"] = _with(ROUTED) + f"SELECT id, {_hint_sql('question')} AS hint, got FROM routed"

ORACLE["routing_by_label"] = _with(ROUTED) + """
SELECT expected, COUNT(*) FILTER (WHERE got = expected) AS correct, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE got = expected) / COUNT(*) AS accuracy
FROM routed GROUP BY expected"""

ORACLE["routing_overall"] = _with(ROUTED) + """
SELECT COUNT(*) FILTER (WHERE got = expected) AS correct, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE got = expected) / COUNT(*) AS accuracy, AVG(seconds) AS mean_seconds, SUM(seconds) AS total_seconds
FROM routed"""

ORACLE["routing_stability"] = _with(ROUTED) + """
SELECT (SELECT quantile_cont(score, 0.5) FROM (SELECT COUNT(*) FILTER (WHERE got = expected) AS score FROM routed GROUP BY run)) AS median_score,
       (SELECT COUNT(DISTINCT run) FROM routed) AS runs,
       (SELECT COUNT(*) FROM (SELECT question FROM routed GROUP BY question HAVING COUNT(DISTINCT COALESCE(got, '<none>')) > 1)) AS flaky_questions"""


# ------------------------------------------------------ answers to questions

def _ranked(label: str, source: str, order: str, texts: list[str], numbers: list[str], rows: int = 10) -> str:
    """The first rows of a finding's table, one row per cell."""
    head = f"(SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS ord FROM {source})"
    cells = [f"SELECT '{label}' AS label, CAST(ord AS INTEGER) AS ord, '{c}' AS key, CAST({c} AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS number "
             f"FROM {head} WHERE ord <= {rows}" for c in texts]
    cells += [f"SELECT '{label}' AS label, CAST(ord AS INTEGER) AS ord, '{c}' AS key, CAST(NULL AS VARCHAR) AS text, CAST({c} AS DOUBLE) AS number "
              f"FROM {head} WHERE ord <= {rows}" for c in numbers]
    return " UNION ALL ".join(cells)


def _dimension_rows(column: str) -> str:
    return (f"(SELECT {column} AS value, {MONEY} AS revenue, COUNT(*) AS orders, CAST({MONEY} AS DOUBLE) / "
            f"(SELECT CAST({MONEY} AS DOUBLE) FROM sales) * 100 AS share_pct FROM sales GROUP BY 1)")


STORE = "store AS (" + " UNION ALL ".join([
    _ranked("ranking_by_product", "prod", "revenue DESC, product", ["product"], ["revenue", "units", "orders"], 5),
    _ranked("worst_by_product", "prod", "revenue, product", ["product"], ["revenue", "units", "orders"], 5),
    _ranked("monthly_trend", "trend", "month", ["month", "month_label"], ["revenue", "orders"]),
    _ranked("quiet_days", "wd", "revenue, weekday", ["weekday"], ["revenue", "orders"]),
    *(_ranked(label, _dimension_rows(c), "revenue DESC, value", ["value"], ["revenue", "orders", "share_pct"])
      for label, c in (("ranking_by_vendor", "vendor"), ("ranking_by_channel", "channel"), ("ranking_by_payment", "payment_method")))]) + ")"
LOGGED = "questions AS (SELECT id AS question_id, question AS text, got AS label FROM routed)"

ORACLE["answer_figures"] = _with(SALES, PRODUCTS, MONTHS, WEEKDAYS, ROUTED, STORE, LOGGED) + """
SELECT question_id, label, s.ord, s.key, s.text, s.number FROM questions JOIN store s USING (label)"""


def _answers(*questions: str) -> str:
    return _with(SALES, PRODUCTS, MONTHS, WEEKDAYS, STORE, *questions, _bm25(
        SALES_DOCS, [], 50, q_sql="SELECT question_id AS query_id, text FROM questions WHERE label IS NULL")) + RETRIEVED + f"""
, leads AS (SELECT label, MAX(CASE WHEN key IN ('product', 'value', 'month_label', 'weekday') THEN text END) AS lead,
                   CAST(MAX(CASE WHEN key = 'revenue' THEN number END) AS DECIMAL(38,2)) AS lead_revenue
            FROM store WHERE ord = 1 GROUP BY label)
SELECT question_id, label, 'analysis' AS route,
       CASE label WHEN 'ranking_by_product' THEN 'Top 5 products by revenue'
                  WHEN 'worst_by_product' THEN '5 weakest-selling products by revenue (lowest earners)'
                  WHEN 'monthly_trend' THEN 'Revenue by month'
                  WHEN 'ranking_by_vendor' THEN 'Revenue by vendor'
                  WHEN 'ranking_by_channel' THEN 'Revenue by channel'
                  WHEN 'ranking_by_payment' THEN 'Revenue by payment method'
                  WHEN 'quiet_days' THEN 'Revenue by day of week, weakest first'
                  ELSE 'Overall sales performance' END AS headline,
       {", ".join("w." + c for c in SUMMARY)}, lead, lead_revenue
FROM questions LEFT JOIN leads USING (label) CROSS JOIN whole w WHERE label IS NOT NULL
UNION ALL
SELECT q.question_id, CAST(NULL AS VARCHAR) AS label, 'retrieval' AS route, {PICKED_HEAD}, {PICKED},
       CAST(NULL AS VARCHAR) AS lead, CAST(NULL AS DECIMAL(38,2)) AS lead_revenue
FROM questions q LEFT JOIN agg a ON a.query_id = q.question_id CROSS JOIN whole w
WHERE q.label IS NULL"""


ORACLE["answer_questions"] = _answers(QUESTIONS)
ORACLE["answer_log"] = _answers(ROUTED, LOGGED)

ORACLE["volume_warning_by_year"] = _with(SALES) + f"""
, g AS (SELECT vendor, year(date) AS year, product, {MONEY} AS revenue, CAST(COALESCE(SUM(qty), 0) AS DOUBLE) AS units, COUNT(*) AS orders
        FROM sales GROUP BY 1, 2, 3)
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vendor, year ORDER BY revenue ASC, product ASC) AS rank,
               ROW_NUMBER() OVER (PARTITION BY vendor, year ORDER BY units DESC, product ASC) AS by_units FROM g)
SELECT vendor, year, product, revenue, units, orders, rank FROM r WHERE rank <= 5 AND by_units <= 5"""

ORACLE["data_gaps"] = _with(RAW, DEDUPED) + f"""
, g AS (SELECT _file, channel AS value, {MONEY} AS revenue, COUNT(*) AS orders FROM fm WHERE _date_ok GROUP BY 1, 2)
, d AS (SELECT *, CAST(revenue AS DOUBLE) / CAST(SUM(revenue) OVER (PARTITION BY _file) AS DOUBLE) * 100 AS share_pct,
               CAST(revenue AS DOUBLE) / CAST(orders AS DOUBLE) AS aov FROM g)
, f AS (SELECT _file, arg_min(value, (-revenue, value)) AS leader, MAX(share_pct) AS leader_share_pct,
               arg_min(value, (-aov, value)) AS high_aov_value, MAX(aov) AS high_aov,
               arg_min(value, (aov, value)) AS low_aov_value, MIN(aov) AS low_aov, COUNT(*) AS "values",
               COALESCE(MAX(CASE WHEN value = 'unknown' THEN share_pct END), 0.0) AS unknown_share_pct
        FROM d GROUP BY _file)
SELECT *, leader_share_pct > 50 AS concentration_risk, ("values" >= 2 AND high_aov > low_aov * 1.2) AS basket_gap,
       unknown_share_pct > 2 AS data_gap
FROM f"""

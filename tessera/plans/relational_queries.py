"""Relational operators of the SQL lane, as Spark SQL or DataFrame plans over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import asof_join, range_join
from .registry import Registry, Tables

reg = Registry()

reg.text(
    "sql_project_filter",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
       CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'medium' ELSE 'small' END AS size_class
FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R')""",
)
reg.text("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
reg.text(
    "sql_distinct_on",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}) AS t WHERE k = 1""",
)
reg.text("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
reg.text(
    "sql_cross_join",
    "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
)
reg.text(
    "sql_inner_hash_join",
    """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
)
reg.text("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
reg.text(
    "sql_right_join",
    "SELECT n_nationkey, count(s_suppkey) AS suppliers FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_nationkey",
)
reg.text(
    "sql_full_join",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k""",
)
reg.text("sql_semi_join", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
reg.text("sql_anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
reg.text("sql_not_in", "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 49)")
reg.text("sql_natural_using", "SELECT o_custkey, count(*) AS n FROM (SELECT o_orderkey AS k, o_custkey FROM {orders}) a JOIN (SELECT l_orderkey AS k FROM {lineitem}) b USING (k) GROUP BY o_custkey")
reg.text(
    "sql_lateral",
    """SELECT c_custkey, x.top_price FROM {customer}, LATERAL (SELECT max(o_totalprice) AS top_price FROM {orders} WHERE o_custkey = c_custkey) AS x WHERE x.top_price IS NOT NULL""",
)
reg.text(
    "sql_group_agg",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
reg.text("sql_distinct_agg", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
reg.text("sql_filter_agg", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_total FROM {orders} GROUP BY o_orderpriority")
reg.text("sql_having", "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > (SELECT count(*) / count(DISTINCT l_suppkey) FROM {lineitem})")
reg.text(
    "sql_grouping_sets",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2, count(*) AS n
FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
)
reg.text("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
reg.text("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
reg.text("sql_group_by_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ALL")
reg.text(
    "sql_ordered_agg",
    """SELECT c_nationkey, array_join(array_sort(collect_list(c_mktsegment)), ',') AS segments, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS poorest
FROM {customer} GROUP BY c_nationkey""",
    """SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, arg_max(c_custkey, row(c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, row(c_acctbal, c_custkey)) AS poorest
FROM customer GROUP BY c_nationkey""",
)
reg.text(
    "sql_stat_agg",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c,
       round(covar_pop(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(kurtosis(l_quantity), 6) AS k FROM {lineitem} GROUP BY l_returnflag""",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c,
       round(covar_pop(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(kurtosis_pop(l_quantity), 6) AS k FROM lineitem GROUP BY l_returnflag""",
)
reg.text(
    "sql_quantiles",
    """SELECT l_shipyear, round(percentile(p, 0.5), 6) AS median, round(percentile(p, 0.95), 6) AS p95, percentile_disc(0.9) WITHIN GROUP (ORDER BY p) AS d90
FROM (SELECT CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_shipyear, l_extendedprice AS p FROM {lineitem}) AS t GROUP BY l_shipyear""",
    """SELECT l_shipyear, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.95), 6) AS p95, quantile_disc(p, 0.9) AS d90
FROM (SELECT extract(YEAR FROM l_shipdate) AS l_shipyear, l_extendedprice AS p FROM lineitem) GROUP BY l_shipyear""",
)
reg.text(
    "sql_window_rank",
    """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr,
       round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS q
FROM {orders} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)""",
)
reg.text(
    "sql_window_analytic",
    """SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2, first_value(value) OVER w AS first_v, nth_value(value, 2) OVER w AS second_v
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
reg.text(
    "sql_window_frame",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS near_sum,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_count FROM {events}""",
)
reg.text(
    "sql_window_groups",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n
FROM (SELECT event_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS g FROM {events}) AS t""",
    "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events",
)
reg.text(
    "sql_qualify",
    "SELECT event_type, event_id, value FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM {events}) AS t WHERE k <= 3",
    "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3",
)
reg.text("sql_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
reg.text("sql_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) AS t GROUP BY k")
reg.text("sql_intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 0")
reg.text("sql_except", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_discount > 0.09")
reg.text("sql_except_all", "SELECT l_partkey AS k FROM {lineitem} EXCEPT ALL SELECT p_partkey FROM {part}")
reg.text(
    "sql_cte",
    """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), best AS (SELECT max(total) AS m FROM spend)
SELECT o_custkey, round(total, 2) AS total FROM spend, best WHERE total > 0.9 * m""",
)
reg.text(
    "sql_recursive_cte",
    """WITH RECURSIVE months(m, start) AS (SELECT 0, (SELECT CAST(min(o_orderdate) AS DATE) FROM {orders}) UNION ALL SELECT m + 1, CAST(start + INTERVAL '1' MONTH AS DATE) FROM months WHERE m < 11)
SELECT m, count(o_orderkey) AS n FROM months LEFT JOIN {orders} ON CAST(o_orderdate AS DATE) >= start AND CAST(o_orderdate AS DATE) < CAST(start + INTERVAL '1' MONTH AS DATE) GROUP BY m""",
)
reg.text("sql_subquery_scalar", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
reg.text("sql_subquery_in", "SELECT count(*) AS n FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size > 40)")
reg.text("sql_values", "SELECT v.label, count(*) AS n FROM {orders} JOIN (VALUES ('F', 'done'), ('O', 'open')) AS v(code, label) ON o_orderstatus = v.code GROUP BY v.label")
reg.text(
    "sql_unnest_select",
    "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, explode(split(text, ' ')) AS word FROM {documents} WHERE kind = 'semi_structured') AS t GROUP BY doc_id, word",
    "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE kind = 'semi_structured') GROUP BY doc_id, word",
)


@reg("sql_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def sql_pivot(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return wide.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@reg("sql_unpivot", "SELECT s_suppkey AS k, name, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (v FOR name IN (nation, balance))")
def sql_unpivot(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "name", "v").withColumnRenamed("s_suppkey", "k")


@reg(
    "sql_asof_join",
    """SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def sql_asof_join(t: Tables) -> DataFrame:
    events = t.events
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view_id").select("event_id", "user_id", "view_id")


@reg(
    "sql_theta_join",
    """SELECT a.event_id, count(b.event_id) AS near FROM (SELECT * FROM events WHERE event_type = 'error') a
JOIN (SELECT * FROM events WHERE event_type = 'click') b ON b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE GROUP BY a.event_id""",
)
def sql_theta_join(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    errors = t.events.where("event_type = 'error'").select("event_id", at.alias("at"))
    clicks = t.events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), at.alias("click_at"))
    return range_join(errors, clicks, "at", "click_at", 600_000_000).groupBy("event_id").agg(F.count("click_id").alias("near"))


@reg("sql_approx")
def sql_approx(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))


@reg("sql_sample")
def sql_sample(t: Tables) -> DataFrame:
    return t.orders.sample(0.1, seed=7).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@reg("sql_union_by_name", "SELECT k, name, balance FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer UNION ALL BY NAME SELECT s_name AS name, s_suppkey AS k FROM supplier)")
def sql_union_by_name(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


@reg(
    "sql_topk_per_group",
    "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3",
)
def sql_topk_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("k")).where("k <= 3")


QUERIES, SQL = reg.queries, reg.sql

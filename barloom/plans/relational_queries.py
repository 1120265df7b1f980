"""The relational idioms of the engine over the business tables, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import asof_join, interval_join, outer_concat, sampled
from ..functions.rolling import average_rank
from ..operators.bars import daily_with_gaps
from ..operators.labels import quantile_regime
from ..sources.tables import read_table
from .registry import query, rounded


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_quantity), 6) AS avg_qty, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2""")(
    lambda spark, d: t(spark, d, "lineitem").where("l_shipdate <= timestamp'2001-06-01'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").cast("double").alias("n")))
query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")(
    lambda spark, d: t(spark, d, "customer").join(t(spark, d, "orders").where("o_orderdate >= timestamp'1996-01-01'"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    .join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    .groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")))
query("top_customers", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda spark, d: t(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent")).orderBy(F.desc("spent"), "o_custkey").limit(20))
query("value_counts", "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")(
    lambda spark, d: (lambda c: c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).select("c_mktsegment", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")))(t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))))
query("status_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")(
    lambda spark, d: t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0))
query("average_rank", "SELECT p_partkey, round(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0, 6) AS r FROM part")(
    lambda spark, d: t(spark, d, "part").select("p_partkey", F.round(average_rank(F.col("p_size"), Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand", "p_size")), 6).alias("r")))
query("quantile_cut", "SELECT c_custkey, (CASE WHEN c_acctbal > q1 THEN 1 ELSE 0 END) + (CASE WHEN c_acctbal > q2 THEN 1 ELSE 0 END) + (CASE WHEN c_acctbal > q3 THEN 1 ELSE 0 END) AS bin FROM (SELECT *, quantile_cont(c_acctbal, 0.25) OVER w AS q1, quantile_cont(c_acctbal, 0.5) OVER w AS q2, quantile_cont(c_acctbal, 0.75) OVER w AS q3 FROM customer WINDOW w AS (PARTITION BY c_mktsegment))")(
    lambda spark, d: quantile_regime(t(spark, d, "customer").withColumnRenamed("c_mktsegment", "symbol"), "c_acctbal", 4, "bin").select("c_custkey", "bin"))
query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda spark, d: t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))
query("customers_with_orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")(
    lambda spark, d: t(spark, d, "customer").join(t(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))
query("nation_overlap", "SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")(
    lambda spark, d: t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(t(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey")))
query("balances_side_by_side", """SELECT coalesce(a.nation, b.nation) AS nation, round(a.x, 4) AS customers, round(b.y, 4) AS suppliers FROM (SELECT c_nationkey AS nation, avg(c_acctbal) AS x FROM customer WHERE c_nationkey < 15 GROUP BY 1) a
  FULL JOIN (SELECT s_nationkey AS nation, avg(s_acctbal) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.nation = b.nation""")(
    lambda spark, d: outer_concat([t(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.avg("c_acctbal"), 4).alias("customers")),
                                   t(spark, d, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.avg("s_acctbal"), 4).alias("suppliers"))], ("nation",)))
query("daily_orders_with_gaps", """SELECT k.s AS symbol, k.day, round(coalesce(sum(o_totalprice), 0), 2) AS v FROM (SELECT o_orderstatus AS s, CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM orders GROUP BY 1) k
  LEFT JOIN orders ON o_orderstatus = k.s AND CAST(o_orderdate AS DATE) = k.day GROUP BY 1, 2""")(
    lambda spark, d: rounded(daily_with_gaps(t(spark, d, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v")), "v"), ["v"], 2, ("symbol", "day")))
query("asof_join", """SELECT a.event_id, a.user_id, a.ts, round(b.value, 6) AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""")(
    lambda spark, d: asof_join(t(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id"), t(spark, d, "events").where("event_type = 'click'").select("user_id", "ts", "event_id", F.round("value", 6).alias("last_value")), ("user_id",), "ts", ("last_value",), "event_id")
    .select("event_id", "user_id", "ts", "last_value"))
query("interval_join", """SELECT a.event_id, count(*) AS n, round(max(b.value), 6) AS top FROM (SELECT * FROM events WHERE event_type = 'purchase') a JOIN (SELECT * FROM events WHERE event_type <> 'purchase') b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts GROUP BY 1""")(
    lambda spark, d: (lambda e: interval_join(
        e.where("event_type <> 'purchase'").select("user_id", "s", "value"), e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("s").alias("s0")), ("user_id",), F.col("s"), F.col("s0") - 6 * 3600 * 1_000_000, F.col("s0"), 6 * 3600 * 1e6)
        .groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top")))(t(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))))
query("monthly_shipments", "SELECT year(l_shipdate) AS y, quarter(l_shipdate) AS q, month(l_shipdate) AS m, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2, 3")(
    lambda spark, d: t(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers")))
query("sampled_rows", "SELECT o_orderkey FROM orders WHERE (o_orderkey * 2654435761) % 4294967296 < 429496729")(lambda spark, d: sampled(t(spark, d, "orders"), "o_orderkey", 0.1).select("o_orderkey"))
query("label_metrics", """SELECT toxic, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(length(text)), 4) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1""")(
    lambda spark, d: t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", F.char_length("text").alias("c")), "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("c"), 4).alias("chars")))
query("embedding_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")(
    lambda spark, d: t(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("norm")))
query("event_props", "SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS INT)), 6) AS k FROM events GROUP BY 1")(
    lambda spark, d: t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.get_json_object("props", "$.k").cast("int")), 6).alias("k")))

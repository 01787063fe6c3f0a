"""Tables of the engine made from the general test tables, in Spark and (for the oracle) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys

NOW = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_of(table(spark, sf_dir, "events"))


def observations_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user, ev, k = F.col("user_id"), F.col("event_id"), F.col("k")
    o = e.select(
        ev.alias("observation_id"), user.alias("panelist_id"), F.col("ts").alias("observed_at"), (F.col("ts") + F.make_dt_interval(secs=k.cast("decimal(18,6)"))).alias("received_at"),
        F.when(user % 3 == 0, "instacart").when(user % 3 == 1, "target").otherwise("walmart").alias("retailer"),
        F.lit(None).cast("string").alias("store_id"), F.when(ev % 8 < 6, F.concat(F.lit("Store "), (user % 2).cast("string"))).alias("store_label"),
        F.col("event_type").alias("sku"), F.col("event_type").alias("title"), F.when(k % 2 == 0, "delivery").otherwise("pickup").alias("fulfillment"),
        F.when(k % 5 != 0, F.concat(F.lit("08"), (k % 2).cast("string"))).alias("zip3"),
        (199 + 50 * (k % 3) + F.when(ev % 97 == 0, 1000).otherwise(0)).cast("long").alias("price_minor"), F.lit("USD").alias("currency"),
        F.when(ev % 4 == 0, "logged_out").when(ev % 4 == 3, "unknown").otherwise("logged_in").alias("session_state"),
        F.when(ev % 4 == 0, True).when(ev % 4 == 1, False).alias("clean_session"), (ev % 10 == 0).alias("is_estimate"), "props", "k",
    )
    return o.withColumn("adapter", F.concat("retailer", F.lit("@1."), (F.col("panelist_id") % 2).cast("string"), F.lit(".0"))).withColumn("cell_key", keys.cell_key())


OBS = """
e AS (SELECT *, CAST(props ->> '$.k' AS INTEGER) AS k FROM events),
o0 AS (SELECT event_id AS observation_id, user_id AS panelist_id, ts AS observed_at, ts + to_seconds(k) AS received_at,
       CASE user_id % 3 WHEN 0 THEN 'instacart' WHEN 1 THEN 'target' ELSE 'walmart' END AS retailer,
       CAST(NULL AS VARCHAR) AS store_id, CASE WHEN event_id % 8 < 6 THEN 'Store ' || (user_id % 2) END AS store_label,
       event_type AS sku, event_type AS title, CASE WHEN k % 2 = 0 THEN 'delivery' ELSE 'pickup' END AS fulfillment,
       CASE WHEN k % 5 <> 0 THEN '08' || (k % 2) END AS zip3,
       CAST(199 + 50 * (k % 3) + CASE WHEN event_id % 97 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS price_minor, 'USD' AS currency,
       CASE event_id % 4 WHEN 0 THEN 'logged_out' WHEN 3 THEN 'unknown' ELSE 'logged_in' END AS session_state,
       CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS clean_session, event_id % 10 = 0 AS is_estimate, props, k FROM e),
o AS (SELECT *, retailer || '@1.' || (panelist_id % 2) || '.0' AS adapter,
      retailer || '|' || coalesce(store_id, '') || '|' || sku || '|' || fulfillment || '|' || coalesce(zip3, '') AS cell_key FROM o0),
flags AS (SELECT DISTINCT panelist_id, CASE WHEN panelist_id % 50 = 0 THEN 'suspect' ELSE 'cleared' END AS status FROM o WHERE panelist_id % 50 < 2),
t72 AS (SELECT * FROM o WHERE observed_at BETWEEN TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR AND TIMESTAMP '2024-01-30'),
clean AS (SELECT * FROM t72 WHERE panelist_id NOT IN (SELECT panelist_id FROM flags WHERE status = 'suspect')),
votes AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY cell_key, panelist_id ORDER BY observed_at DESC, received_at DESC, observation_id DESC) = 1)
"""


def flags(obs: DataFrame) -> DataFrame:
    """Every fiftieth panelist a suspect, the next one cleared."""
    return obs.where(F.col("panelist_id") % 50 < 2).select("panelist_id", F.when(F.col("panelist_id") % 50 == 0, "suspect").otherwise("cleared").alias("status")).distinct()


def panel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a panel: parts are cells, customers panelists, quantities prices."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")).alias("observation_id"), F.col("o_custkey").alias("panelist_id"), F.col("l_partkey").alias("cell_key"), F.col("l_partkey").alias("sku"),
        F.col("o_orderdate").alias("observed_at"), F.col("o_orderdate").alias("received_at"), F.col("l_quantity").cast("long").alias("price_minor"), F.col("l_returnflag").alias("title"), F.lit("USD").alias("currency"),
    )


ORDERS = """
po AS (SELECT (l_orderkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS observation_id, o_custkey AS panelist_id, l_partkey AS cell_key, l_partkey AS sku, o_orderdate AS observed_at,
       o_orderdate AS received_at, CAST(l_quantity AS BIGINT) AS price_minor, l_returnflag AS title, 'USD' AS currency FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" oz")).alias("title"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("size_text"), F.when(F.col("p_partkey") % 5 == 0, F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("upc"))


PRODUCTS = """
p0 AS (SELECT p_partkey AS product_id, p_name || ' ' || p_size || ' oz' AS title, p_brand AS brand, p_name, p_size,
       CASE WHEN p_partkey % 5 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '0') END AS upc FROM part),
tok AS (SELECT product_id, brand, p_size, upc, title,
        list_sort(list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(brand || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' '),
            lambda w: w <> '' AND NOT list_contains(['a','an','the','of','and','or','with','by','for','in','to','per','on','at','from','sold'], w)),
            lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us') THEN w[:-2] ELSE w END))) AS tokens,
        list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))) AS brand_tokens,
        p_size * 28.3495::DOUBLE AS g FROM p0)
"""

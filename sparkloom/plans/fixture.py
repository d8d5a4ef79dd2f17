"""Ad impressions and user histories, derived from the star-schema tables.

The SQL strings say the same for an oracle that only sees those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: when, who, where, what was advertised, and revenue."""
    events, customer, part = (table(spark, sf_dir, n) for n in ("events", "customer", "part"))
    parts = part.count()  # from the file footers
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    users = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    adverts = part.select("p_partkey", F.col("p_brand").alias("advertiser_bundle"), F.col("p_type").alias("advertiser_category"))
    own = events.withColumn("_part", F.col("event_id") % F.lit(parts))
    revenue = F.when(F.col("event_type") == "purchase", F.coalesce("value", F.lit(0.0))).otherwise(0.0)
    return own.join(users, F.col("user_id") == F.col("c_custkey"), "left").join(adverts, F.col("_part") == F.col("p_partkey"), "left").select(
        F.col("event_id").alias("row_id"),
        F.date_format("ts", "yyyy-MM-dd-HH-mm").alias("datetime"),
        "ts",
        "user_id",
        F.hour("ts").alias("hour"),
        "country",
        "region",
        F.when(F.col("user_id") % 2 == 0, "android").otherwise("ios").alias("dev_os"),
        "advertiser_bundle",
        "advertiser_category",
        "event_type",
        revenue.alias("iap_revenue_d7"),
        (revenue > 0).cast("int").alias("buyer_d7"),
    )


IMPRESSIONS = """imp AS (
    SELECT e.event_id AS row_id, strftime(e.ts, '%Y-%m-%d-%H-%M') AS datetime, e.ts, e.user_id,
           CAST(extract(hour FROM e.ts) AS INTEGER) AS hour, n.n_name AS country, r.r_name AS region,
           CASE WHEN e.user_id % 2 = 0 THEN 'android' ELSE 'ios' END AS dev_os,
           p.p_brand AS advertiser_bundle, p.p_type AS advertiser_category, e.event_type,
           CASE WHEN e.event_type = 'purchase' THEN coalesce(e.value, 0.0) ELSE 0.0 END AS iap_revenue_d7,
           CAST(CASE WHEN e.event_type = 'purchase' THEN coalesce(e.value, 0.0) ELSE 0.0 END > 0 AS INTEGER) AS buyer_d7
    FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
         LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
         LEFT JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part))"""


#: Rows up to which sellers are broadcast.
MOST_SELLERS = 500_000


def purchases(spark: SparkSession, sf_dir: str, users: DataFrame | None = None) -> DataFrame:
    """One row per order line: user, brand, type, seller's country, revenue, time; with `users` (one column user_id) only theirs."""
    lineitem, orders, part, supplier, nation = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "nation"))
    sellers = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("seller"))
    if supplier.count() <= MOST_SELLERS:  # from the file footers
        sellers = F.broadcast(sellers)
    owned = orders.select("o_orderkey", F.col("o_custkey").alias("user_id"))
    if users is not None:
        owned = owned.join(users.distinct(), "user_id", "left_semi")
    # Values are narrowed before the lines are shuffled.
    lines = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("revenue"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("bought_at"))
    joined = lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("user_id", F.col("p_brand").alias("bundle"), F.col("p_type").alias("category"), "seller", "revenue", "bought_at")


PURCHASES = """buy AS (
    SELECT o.o_custkey AS user_id, p.p_brand AS bundle, p.p_type AS category, n.n_name AS seller,
           CAST(l.l_extendedprice AS DECIMAL(18, 2)) AS revenue, CAST(epoch(l.l_shipdate) AS BIGINT) AS bought_at
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
         LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey)"""


#: What makes a user a whale of a bundle.
WHALE_BUYS, WHALE_REVENUE = 2, 50_000.0


def _map(kind: str, value: Column) -> Column:
    """Map from key to value of a user's keys of this kind; null if there are none."""
    entries = F.collect_list(F.when(F.col("kind") == kind, F.struct("key", value.alias("value"))))
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def user_history(spark: SparkSession, sf_dir: str, users: DataFrame | None = None) -> DataFrame:
    """One row per user with map and list columns of what was bought, when and from whom, and of actions; with `users` only purchases of theirs.

    Purchases and events are shuffled by user once, as they are; keys are
    counted and collected where they then lie, so no map is shuffled or joined.
    """
    buy = purchases(spark, sf_dir, users).select("user_id", F.lit(True).alias("bought"), F.col("bundle").alias("a"), F.col("category").alias("b"), F.col("seller").alias("c"), "revenue", "bought_at")
    act = table(spark, sf_dir, "events").select("user_id", F.lit(False).alias("bought"), F.col("event_type").alias("a"), F.hour("ts").cast("string").alias("b"), (F.weekday("ts") >= 5).cast("string").alias("c"))
    rows = buy.unionByName(act, allowMissingColumns=True).repartition("user_id")
    kinds = {"a": ("bundle", "action"), "b": ("category", "hour"), "c": ("seller", "weekend")}
    entries = F.array(*(F.struct(F.when(F.col("bought"), x).otherwise(y).alias("kind"), F.col(c).alias("key")) for c, (x, y) in kinds.items()))
    each = rows.select("user_id", "revenue", "bought_at", F.explode(entries).alias("e")).select("user_id", "e.*", "revenue", "bought_at").where("key is not null")
    counted = each.groupBy("user_id", "kind", "key").agg(F.count("*").alias("n"), F.sum("revenue").cast("double").alias("revenue"), F.max("bought_at").alias("last"), F.min("bought_at").alias("first"))
    n, revenue, last, first = map(F.col, ("n", "revenue", "last", "first"))
    of = lambda condition: F.sum(F.when(condition, F.col("n")))
    out = counted.groupBy("user_id").agg(
        _map("bundle", n).alias("num_buys_bundle"),
        _map("bundle", revenue).alias("iap_revenue_usd_bundle"),
        _map("bundle", last).alias("last_buy_ts_bundle"),
        _map("bundle", first).alias("first_request_ts_bundle"),
        _map("category", n).alias("num_buys_category"),
        _map("category", revenue).alias("iap_revenue_usd_category"),
        _map("category", last).alias("last_buy_ts_category"),
        _map("seller", n).alias("country_hist"),
        _map("action", n).alias("user_actions_bundles_action_count"),
        _map("hour", n).alias("hours"),
        of(F.col("kind") == "hour").alias("all"),
        (F.coalesce(of((F.col("kind") == "weekend") & (F.col("key") == "true")), F.lit(0)) / of(F.col("kind") == "weekend")).alias("weekend_ratio"),
    )
    more = {
        "bundles_ins": F.flatten(F.transform(F.sort_array(F.map_entries("num_buys_bundle")), lambda e: F.array_repeat(e["key"], e["value"].cast("int")))),
        "hour_ratio": F.transform_values("hours", lambda _, v: v / F.col("all")),
        "whale_users_bundle_total_num_buys": F.map_filter("num_buys_bundle", lambda _, v: v >= WHALE_BUYS),
        "whale_users_bundle_total_revenue": F.map_filter("iap_revenue_usd_bundle", lambda _, v: v >= WHALE_REVENUE),
    }
    return out.withColumns(more).withColumn("user_bundles", F.sort_array(F.map_keys("num_buys_bundle"))).drop("hours", "all")


def with_history(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The impressions (or `rows` of them) with their users' history; purchases of users without impressions aren't carried along."""
    users = table(spark, sf_dir, "events").select("user_id")
    return (impressions(spark, sf_dir) if rows is None else rows).join(user_history(spark, sf_dir, users), "user_id", "left")

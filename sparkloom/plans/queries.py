"""The registered queries of the feature and analytics operators, each with the SQL that says the same.

Doubles are rounded on both sides after a shift that keeps exact ties apart.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import binning, nested, scalar
from sparkloom.operators import compiled, encoding, evaluate, features, model, sampling, sketches, stats
from sparkloom.operators.ranks import quantile_values, running
from sparkloom.plans.fixture import IMPRESSIONS, PURCHASES, WHALE_BUYS, WHALE_REVENUE, impressions, table, user_history, with_history
from sparkloom.sources import scan
from sparkloom.sources.scratch import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TRAIN_END, VAL_START = "2024-01-25-00-00", "2024-01-25-00-01"
CURRENT = "2024-02-01"


def r(c: Column | str, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-7), digits)


def q(sql: str, digits: int = 4) -> str:
    return f"round({sql} + 1e-7, {digits})"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def imp(body: str) -> str:
    """SQL over impressions; a body that starts with a comma has further common tables."""
    return f"WITH {IMPRESSIONS} {body}"


def buy(body: str) -> str:
    """SQL over purchases."""
    return f"WITH {PURCHASES} {body}"


# Scans, filters, targets


@query(imp(f"SELECT row_id, datetime FROM imp WHERE datetime >= '2024-01-05-00-00' AND datetime <= '{TRAIN_END}'"))
def scan_window_inclusive(spark, d):
    return scan.window(impressions(spark, d).select("row_id", "datetime"), "2024-01-05-00-00", TRAIN_END)


@query(imp("SELECT row_id, datetime FROM imp WHERE datetime >= '2024-01-05' AND datetime < '2024-01-07'"))
def scan_window_half_open(spark, d):
    return scan.window(impressions(spark, d).select("row_id", "datetime"), "2024-01-05", "2024-01-07", closed=False)


@query(imp("SELECT row_id, country FROM imp WHERE datetime LIKE '2024-01-09%' AND dev_os IN ('ios')"))
def day_prefix_filter(spark, d):
    return scan.day(impressions(spark, d), "2024-01-09").where(F.col("dev_os").isin("ios")).select("row_id", "country")


@query(imp(f"SELECT row_id, buyer_d7, {q('ln(1 + iap_revenue_d7)', 6)} AS log_rev_d7, CAST(ln(1 + iap_revenue_d7) > 4.0 AS INTEGER) AS is_whale FROM imp"))
def derived_targets(spark, d):
    own = stats.with_targets(impressions(spark, d).drop("buyer_d7"), 4.0)
    return own.select("row_id", "buyer_d7", r("log_rev_d7", 6).alias("log_rev_d7"), "is_whale")


# Lookup tables

_RATES = f"{q('avg(buyer_d7)', 6)} AS buyer_rate, {q('avg(iap_revenue_d7)')} AS avg_rev_d7, {q('avg(CAST(ln(1 + iap_revenue_d7) > 4.0 AS INTEGER))', 6)} AS whale_rate, count(buyer_d7) AS count"
_SEGMENT = "coalesce(country, 'None') || '_' || coalesce(dev_os, 'None')"


def _rates(df: DataFrame) -> DataFrame:
    return df.select("key", r("buyer_rate", 6).alias("buyer_rate"), r("avg_rev_d7").alias("avg_rev_d7"), r("whale_rate", 6).alias("whale_rate"), "count")


def _stats_sql(key: str) -> str:
    return imp(f"SELECT {key} AS key, {_RATES} FROM imp WHERE {key} IS NOT NULL GROUP BY 1")


@query(_stats_sql("advertiser_bundle"))
def bundle_stats(spark, d):
    return _rates(stats.group_stats(impressions(spark, d), "advertiser_bundle", 4.0))


@query(_stats_sql("advertiser_category"))
def category_stats(spark, d):
    return _rates(stats.group_stats(impressions(spark, d), "advertiser_category", 4.0))


@query(_stats_sql("country"))
def country_stats(spark, d):
    return _rates(stats.group_stats(impressions(spark, d), "country", 4.0))


@query(_stats_sql(_SEGMENT))
def segment_stats(spark, d):
    return _rates(stats.group_stats(impressions(spark, d), stats.segment_key(), 4.0))


_LOOKUP = ", ".join(f"""{n} AS (SELECT {k} AS key, avg(buyer_d7) AS buyer_rate, avg(iap_revenue_d7) AS avg_rev_d7,
    avg(CAST(ln(1 + iap_revenue_d7) > 4.0 AS INTEGER)) AS whale_rate FROM imp WHERE datetime <= '{TRAIN_END}' AND {k} IS NOT NULL GROUP BY 1)""" for n, k in (("bundle", "advertiser_bundle"), ("category", "advertiser_category"), ("country_t", "country"), ("segment", _SEGMENT)))
_ENRICHED = ", ".join(f"{q(f'coalesce({t}.{x}, 0.0)', 4 if x == 'avg_rev_d7' else 6)} AS {n}_{x}" for n, t, k in (("bundle", "bundle", 3), ("category", "category", 3), ("country", "country_t", 3), ("segment", "segment", 2)) for x in features.RATES[:k])
_LOOKUP_JOINS = f"LEFT JOIN bundle ON bundle.key = advertiser_bundle LEFT JOIN category ON category.key = advertiser_category LEFT JOIN country_t ON country_t.key = imp.country LEFT JOIN segment ON segment.key = {_SEGMENT}"
_ADDED = [f"{n}_{x}" for n, (_, k) in features.LOOKUPS.items() for x in features.RATES[:k]]


def _tables(df: DataFrame) -> dict[str, DataFrame]:
    return stats.lookup_tables(scan.window(df, None, TRAIN_END), 4.0)


def _rounded_lookups() -> list[Column]:
    return [r(c, 4 if c.endswith("avg_rev_d7") else 6).alias(c) for c in _ADDED]


@query(imp(f", {_LOOKUP} SELECT row_id, {_ENRICHED} FROM imp {_LOOKUP_JOINS}"))
def online_lookup_join(spark, d):
    df = impressions(spark, d)
    return features.enrich(df, _tables(df)).select("row_id", *_rounded_lookups())


# Scalar functions


@query(imp(f"SELECT row_id, {q('sin(2 * pi() * hour / 24)', 6)} AS hour_sin, {q('cos(2 * pi() * hour / 24)', 6)} AS hour_cos FROM imp"))
def hour_cyclical(spark, d):
    sin, cos = scalar.hour_cyclical(F.col("hour").cast("string"))
    return impressions(spark, d).select("row_id", sin, cos).select("row_id", r("hour_sin", 6).alias("hour_sin"), r("hour_cos", 6).alias("hour_cos"))


@query(imp("SELECT row_id, CAST(CASE WHEN hour <= 6 THEN 0 WHEN hour <= 12 THEN 1 WHEN hour <= 18 THEN 2 ELSE 3 END AS TINYINT) AS hour_bin FROM imp"))
def hour_bin(spark, d):
    return impressions(spark, d).select("row_id", scalar.hour_bin(F.col("hour").cast("string")).alias("hour_bin"))


@query(imp("SELECT row_id, CASE WHEN hour <= 6 THEN 'night' WHEN hour <= 12 THEN 'morning' WHEN hour <= 18 THEN 'afternoon' ELSE 'evening' END AS hour_group, CAST(hour <= 6 AS INTEGER) AS is_night, CAST(hour >= 18 AS INTEGER) AS is_evening FROM imp"))
def hour_group_flags(spark, d):
    h = F.col("hour").cast("string")
    return impressions(spark, d).select("row_id", scalar.hour_group(h).alias("hour_group"), *scalar.hour_flags(h))


@query(f"SELECT event_id, CAST(floor((epoch(TIMESTAMP '{CURRENT}') - floor(epoch(ts))) / 86400) AS BIGINT) AS days_ago, {q(f'''exp(-floor((epoch(TIMESTAMP '{CURRENT}') - floor(epoch(ts))) / 86400) / 30.0)''', 6)} AS decay FROM events")
def days_ago_decay(spark, d):
    days = scalar.days_ago("ts", CURRENT)
    return table(spark, d, "events").select("event_id", days.alias("days_ago"), r(scalar.decay(days), 6).alias("decay"))


_FIRST = "(SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1)"


def _firsts(spark, d):
    events = table(spark, d, "events")
    return events.join(events.groupBy("user_id").agg(F.min("ts").alias("first_ts")), "user_id")


@query(f"SELECT event_id, CAST(greatest(floor(epoch(ts)) - floor(epoch(first_ts)), 0) AS BIGINT) AS recency FROM events JOIN {_FIRST} USING (user_id)")
def recency_seconds(spark, d):
    return _firsts(spark, d).select("event_id", scalar.recency_seconds("ts", "first_ts").alias("recency"))


@query(f"SELECT event_id, {q('(epoch_us(ts) - epoch_us(first_ts)) / 86400000000.0', 6)} AS recency FROM events JOIN {_FIRST} USING (user_id)")
def recency_days(spark, d):
    return _firsts(spark, d).select("event_id", r(scalar.recency_days("ts", "first_ts"), 6).alias("recency"))


@query(f"SELECT p_partkey, {q('p_retailprice / (p_size + 1)', 6)} AS ratio FROM part")
def activity_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", r(scalar.activity_ratio("p_retailprice", "p_size"), 6).alias("ratio"))


@query("SELECT event_id, coalesce(TRY_CAST(split_part(CASE WHEN event_id % 3 = 0 THEN 'x.1' ELSE CAST(event_id % 17 AS VARCHAR) || '.4.1' END, '.', 1) AS INTEGER), -1) AS os_major FROM events")
def os_major(spark, d):
    version = F.when(F.col("event_id") % 3 == 0, "x.1").otherwise(F.concat((F.col("event_id") % 17).cast("string"), F.lit(".4.1")))
    return table(spark, d, "events").select("event_id", scalar.os_major(version).alias("os_major"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) || '.25' END AS DOUBLE) AS parsed, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) || '.25' END AS DOUBLE), 0.0) AS filled FROM events")
def safe_float(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.concat((F.col("event_id") % 100).cast("string"), F.lit(".25")))
    return table(spark, d, "events").select("event_id", scalar.to_double(text).alias("parsed"), scalar.to_double(text, 0.0).alias("filled"))


@query(imp(f"SELECT row_id, {q('ln(1 + iap_revenue_d7)', 6)} AS log_rev, {q('exp(ln(1 + iap_revenue_d7)) - 1', 6)} AS back FROM imp"))
def log_target(spark, d):
    log = F.log1p("iap_revenue_d7")
    return impressions(spark, d).select("row_id", r(log, 6).alias("log_rev"), r(F.expm1(log), 6).alias("back"))


@query(imp(f"SELECT row_id, {q('least(iap_revenue_d7, (SELECT quantile_cont(iap_revenue_d7, 0.999) FROM imp))')} AS clipped FROM imp"))
def clip_quantile(spark, d):
    df = impressions(spark, d)
    top = quantile_values(df, "iap_revenue_d7", [0.999])[0]
    return df.select("row_id", r(scalar.clip("iap_revenue_d7", high=top)).alias("clipped"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 2000.0 WHEN 2 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS x FROM events")
def finite_values(spark, d):
    n = F.col("event_id") % 4
    x = F.when(n == 0, float("nan")).when(n == 1, float("inf")).when(n == 2, float("-inf")).otherwise(F.col("event_id").cast("double"))
    return table(spark, d, "events").select("event_id", scalar.finite(x).alias("x"))


@query(imp(f"SELECT row_id, {_SEGMENT.replace('country,', 'nullif(country, (SELECT min(country) FROM imp)),')} AS segment FROM imp"))
def segment_key(spark, d):
    df = impressions(spark, d)
    least = df.agg(F.min("country")).first()[0]
    return df.withColumn("country", F.nullif("country", F.lit(least))).select("row_id", stats.segment_key().alias("segment"))


# Map and list columns, against the groups they were made of


def _per_user(select: str, key: str, value: str) -> str:
    return buy(f", g AS (SELECT user_id, {key} AS k, {value} AS v FROM buy GROUP BY 1, 2) SELECT user_id, {select} FROM g GROUP BY 1")


def _buyers(spark, d) -> DataFrame:
    return user_history(spark, d).where("num_buys_bundle is not null")


@query(buy("SELECT user_id, CAST(count(*) AS INTEGER) AS n, CAST(count(DISTINCT bundle) AS INTEGER) AS n_unique FROM buy GROUP BY 1"))
def list_lengths(spark, d):
    return _buyers(spark, d).select("user_id", nested.list_len("bundles_ins").alias("n"), nested.list_unique("bundles_ins").alias("n_unique"))


@query(_per_user(f"CAST(sum(v) AS DOUBLE) AS total_buys, CAST(count(*) AS INTEGER) AS num_bought_bundles", "bundle", "count(*)"))
def map_sum_count(spark, d):
    return _buyers(spark, d).select("user_id", nested.map_sum("num_buys_bundle").alias("total_buys"), nested.map_len("num_buys_bundle").alias("num_bought_bundles"))


@query(_per_user("CAST(count(*) AS INTEGER) AS country_n_unique, CAST(sum(v) AS DOUBLE) AS country_total_count", "seller", "count(*)"))
def hist_diversity(spark, d):
    return _buyers(spark, d).select("user_id", *(c.alias(n) for n, c in features.histogram_columns(user_history(spark, d).select("country_hist")).items()))


@query(_per_user(f"{q('CAST(sum(v) AS DOUBLE)', 2)} AS rev_sum, {q('CAST(max(v) AS DOUBLE)', 2)} AS rev_max, CAST(count(*) AS INTEGER) AS rev_n_keys, {q('CAST(sum(v) AS DOUBLE) / count(*)')} AS rev_mean", "bundle", "sum(revenue)"))
def map_rev_stats(spark, d):
    m = "iap_revenue_usd_bundle"
    return _buyers(spark, d).select("user_id", r(nested.map_sum(m), 2).alias("rev_sum"), r(nested.map_max(m), 2).alias("rev_max"), nested.map_len(m).alias("rev_n_keys"), r(nested.map_mean(m)).alias("rev_mean"))


@query(f"WITH {IMPRESSIONS}, {PURCHASES}, g AS (SELECT user_id, bundle, count(*) AS v, CAST(sum(revenue) AS DOUBLE) AS w FROM buy GROUP BY 1, 2) SELECT row_id, CAST(coalesce(v, 0) AS DOUBLE) AS buys, {q('coalesce(w, 0.0)', 2)} AS revenue FROM imp LEFT JOIN g ON g.user_id = imp.user_id AND g.bundle = imp.advertiser_bundle")
def map_current_adv(spark, d):
    return with_history(spark, d).select("row_id", nested.map_get("num_buys_bundle", "advertiser_bundle").alias("buys"), r(nested.map_get("iap_revenue_usd_bundle", "advertiser_bundle"), 2).alias("revenue"))


@query(buy("SELECT user_id, CAST(count(DISTINCT bundle) AS INTEGER) AS last_buy_n_items, CAST(count(DISTINCT category) AS INTEGER) AS last_buy_cat_n_items, CAST(count(DISTINCT bundle) AS INTEGER) AS first_req_n_items FROM buy GROUP BY 1"))
def ts_map_items(spark, d):
    h = _buyers(spark, d)
    return h.select("user_id", *(c.alias(n) for n, c in features.time_columns(h).items()))


@query(buy(f"SELECT user_id, CAST(floor((epoch(TIMESTAMP '{CURRENT}') - max(bought_at)) / 86400) AS BIGINT) AS newest FROM buy GROUP BY 1"))
def ts_map_recency(spark, d):
    h = _buyers(spark, d).select("user_id", "last_buy_ts_bundle")
    return h.select("user_id", features.time_columns(h, True, CURRENT)["last_buy_min_days_ago"].cast("long").alias("newest"))


@query("SELECT user_id, CAST(count(*) AS DOUBLE) AS user_action_total, CAST(count(DISTINCT event_type) AS INTEGER) AS user_action_n_types FROM events GROUP BY 1")
def action_totals(spark, d):
    h = user_history(spark, d).where("user_actions_bundles_action_count is not null")
    return h.select("user_id", *(c.alias(n) for n, c in features.action_columns(h).items()))


@query(_per_user(f"{q('avg(v)', 6)} AS mean, {q('CASE WHEN count(*) > 1 THEN stddev_pop(v) ELSE 0.0 END', 6)} AS std, CAST(max(v) AS DOUBLE) AS max, CAST(min(v) AS DOUBLE) AS min, CAST(count(*) AS INTEGER) AS n", "bundle", "count(*)"))
def dict_mean_std_max_min(spark, d):
    m = "num_buys_bundle"
    h = _buyers(spark, d).select("user_id", *nested.dict_features(m))
    return h.select("user_id", r(f"{m}_mean", 6).alias("mean"), r(f"{m}_std", 6).alias("std"), F.col(f"{m}_max").alias("max"), F.col(f"{m}_min").alias("min"), F.col(f"{m}_count").alias("n"))


@query(buy(f""", g AS (SELECT user_id, seller, CAST(count(*) AS DOUBLE) AS v FROM buy WHERE seller IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT user_id, v, sum(v) OVER (PARTITION BY user_id) AS s, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) AS k FROM g)
    SELECT user_id, {', '.join(f'coalesce(max(CASE WHEN k = {i} THEN v END), 0.0) AS top{i}' for i in range(1, 6))}, {q('-sum(v / s * ln(v / s + 1e-10))', 6)} AS entropy FROM t GROUP BY 1"""))
def hist_topk_entropy(spark, d):
    h = _buyers(spark, d).select("user_id", *nested.histogram_features("country_hist"))
    return h.select("user_id", *(F.col(f"country_hist_top{i}").alias(f"top{i}") for i in range(1, 6)), r("country_hist_entropy", 6).alias("entropy"))


@query(buy(f""", g AS (SELECT user_id, bundle, CAST(count(*) AS DOUBLE) AS v FROM buy GROUP BY 1, 2), t AS (SELECT user_id, v, sum(v) OVER (PARTITION BY user_id) AS s FROM g)
    SELECT user_id, CAST(max(s) AS INTEGER) AS h_len, {q('avg(v)', 6)} AS h_mean, {q('-sum(v / s * ln(v / s + 1e-9))', 6)} AS h_entropy FROM t GROUP BY 1"""))
def list_compress_entropy(spark, d):
    h = _buyers(spark, d).select("user_id", *nested.compressed("bundles_ins", "h"))
    return h.select("user_id", "h_len", r("h_mean", 6).alias("h_mean"), r("h_entropy", 6).alias("h_entropy"))


# Encoders

_CODES = "(SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL{w}))"


@query(imp(f"SELECT row_id, coalesce(code, -1) AS country_code FROM imp LEFT JOIN {_CODES.format(c='country', t='imp', w='')} ON v = country"))
def ordinal_encode(spark, d):
    df = impressions(spark, d)
    return encoding.apply_codes(df, "country", encoding.fit_codes(df, "country"), "country_code").select("row_id", "country_code")


@query(imp(f"SELECT row_id, coalesce(code, -1) AS code FROM imp LEFT JOIN {_CODES.format(c='user_id', t='imp', w=" AND datetime < '2024-01-03'").replace('SELECT DISTINCT user_id', 'SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id')} ON v = CAST(user_id AS VARCHAR)"))
def ordinal_encode_unknown(spark, d):
    df = impressions(spark, d)
    codes = encoding.fit_codes(scan.window(df, None, "2024-01-03", closed=False), "user_id")
    return encoding.apply_codes(df, "user_id", codes, "code").select("row_id", "code")


@query(imp(f"SELECT row_id, coalesce(code, -1) AS code FROM imp LEFT JOIN {_CODES.format(c='bundle', t='(SELECT nullif(advertiser_bundle, (SELECT min(advertiser_bundle) FROM imp)) AS bundle FROM imp)', w='')} ON v = advertiser_bundle"))
def label_encode(spark, d):
    df = impressions(spark, d)
    least = df.agg(F.min("advertiser_bundle")).first()[0]
    own = df.select("row_id", F.nullif("advertiser_bundle", F.lit(least)).alias("bundle"))
    return encoding.label_encode(own, "bundle", "code").select("row_id", "code")


@query(imp("SELECT row_id, CASE WHEN country IS NULL OR country = (SELECT min(country) FROM imp) THEN '__MISSING__' WHEN country IN (SELECT country FROM imp WHERE datetime < '2024-01-01-01-00') THEN country END AS country FROM imp"))
def category_align(spark, d):
    df = impressions(spark, d)
    least = df.agg(F.min("country")).first()[0]
    known = scan.window(df, None, "2024-01-01-01-00", closed=False).select(F.col("country").alias("value")).where("value is not null")
    return encoding.align_categories(df.withColumn("country", F.nullif("country", F.lit(least))), "country", known, "country").select("row_id", "country")


@query(imp(f", m AS (SELECT country AS k, {q('avg(iap_revenue_d7)')} AS v FROM imp WHERE datetime < '2024-01-01-02-00' GROUP BY 1) SELECT row_id, v FROM imp LEFT JOIN m ON k = country"))
def value_map(spark, d):
    df = impressions(spark, d)
    means = scan.window(df, None, "2024-01-01-02-00", closed=False).groupBy(F.col("country").alias("key")).agg(r(F.avg("iap_revenue_d7")).alias("value"))
    return encoding.map_values(df, "country", means, "v").select("row_id", "v")


# Feature builders

_CODED = ("country", "region", "dev_os", "advertiser_bundle", "advertiser_category")
_CODE_CTES = ", ".join(f"code_{c} AS {_CODES.format(c=c, t='imp', w=f' AND datetime <= {TRAIN_END!r}')}" for c in _CODED)
_CODE_COLUMNS = ", ".join(f"coalesce(code_{c}.code, -1) AS {c}" for c in _CODED)
_CODE_JOINS = " ".join(f"LEFT JOIN code_{c} ON code_{c}.v = imp.{c}" for c in _CODED)
_USER = f"""u1 AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS total_buys, CAST(count(DISTINCT bundle) AS INTEGER) AS nb, CAST(count(DISTINCT category) AS INTEGER) AS nc, CAST(sum(revenue) AS DOUBLE) AS rev FROM buy GROUP BY 1),
    w1 AS (SELECT user_id, avg(CAST(isodow(ts) >= 6 AS INTEGER)) AS weekend FROM events GROUP BY 1)"""
_USER_JOINS = "LEFT JOIN u1 ON u1.user_id = imp.user_id LEFT JOIN w1 ON w1.user_id = imp.user_id"
_ONLINE_OWN = f"""CAST(coalesce(u1.total_buys, 0) AS INTEGER) AS num_bundles_ins, coalesce(nb, 0) AS num_user_bundles, coalesce(u1.total_buys, 0.0) AS total_buys,
    coalesce(nb, 0) AS num_bought_bundles, coalesce(nb, 0) AS num_revenue_bundles, {q('coalesce(u1.rev, 0.0)', 2)} AS total_past_revenue, {q('coalesce(u1.rev, 0.0)', 2)} AS total_category_revenue,
    {q('coalesce(weekend, 0.0)', 6)} AS weekend_ratio, hour, {q('sin(2 * pi() * hour / 24)', 6)} AS hour_sin, {q('cos(2 * pi() * hour / 24)', 6)} AS hour_cos,
    CASE WHEN hour <= 6 THEN 0 WHEN hour <= 12 THEN 1 WHEN hour <= 18 THEN 2 ELSE 3 END AS hour_bin, {_ENRICHED}"""
_ONLINE = f"row_id, {_CODE_COLUMNS}, {_ONLINE_OWN}"
_MONEY = {"total_past_revenue", "total_category_revenue"}
_SIX = {"weekend_ratio", "hour_sin", "hour_cos"}


def _fitted(df: DataFrame) -> DataFrame:
    return encoding.fit_encoders(scan.window(df, None, TRAIN_END), list(_CODED))


def _digits(c: str) -> int | None:
    """Digits that a column of features is compared to; None for whole numbers."""
    if c in _ADDED:
        return 4 if c.endswith("avg_rev_d7") else 6
    if c in _MONEY or c.startswith(("rev_", "whale_total_rev")):
        return None if c.endswith(("n_keys", "n_bundles")) else 4 if c.endswith("_mean") else 2
    return 6 if c in _SIX or c.endswith("_mean") or c == "hour_total_count" else None


def _compared(df: DataFrame) -> DataFrame:
    return df.select(*(r(c, _digits(c)).alias(c) if _digits(c) else c for c in df.columns))


@query(f"WITH {IMPRESSIONS}, {PURCHASES}, {_LOOKUP}, {_CODE_CTES}, {_USER} SELECT {_ONLINE}, datetime FROM imp {_LOOKUP_JOINS} {_CODE_JOINS} {_USER_JOINS}")
def online_features(spark, d):
    """All online columns of the impressions."""
    df = impressions(spark, d)
    out, _ = features.online(with_history(spark, d), _tables(df), _fitted(df))
    return _compared(out)


def _amounts_sql(of: str, key: str, prefix: str, value: str, digits: int) -> str:
    x = "CAST({} AS DOUBLE)".format
    money = (lambda e, n: q(f"coalesce({e}, 0.0)", n)) if digits else (lambda e, n: f"coalesce({e}, 0.0)")
    return f"{money(f'{of}.s', 2)} AS {prefix}_sum, {money(f'{of}.mx', 2)} AS {prefix}_max, coalesce({of}.n, 0) AS {prefix}_n_keys, {q(f'coalesce({of}.s / {of}.n, 0.0)', 4 if digits else 6)} AS {prefix}_mean"


def _per_key(name: str, key: str, value: str) -> str:
    """Common tables: the map of each user by key, and its sum, maximum and size."""
    return f"{name} AS (SELECT user_id, {key} AS k, CAST({value} AS DOUBLE) AS v FROM buy GROUP BY 1, 2), {name}_u AS (SELECT user_id, sum(v) AS s, max(v) AS mx, CAST(count(*) AS INTEGER) AS n FROM {name} GROUP BY 1)"


_MAPS = {"bb": ("bundle", "count(*)", "buys_bundle", 0), "bc": ("category", "count(*)", "buys_category", 0), "rb": ("bundle", "sum(revenue)", "rev_bundle", 2), "rc": ("category", "sum(revenue)", "rev_category", 2)}
_MAP_CTES = ", ".join(_per_key(n, k, v) for n, (k, v, _, _) in _MAPS.items())
_MAP_COLUMNS = ", ".join(_amounts_sql(f"{n}_u", k, p, v, x) for n, (k, v, p, x) in _MAPS.items())
_MAP_JOINS = " ".join(f"LEFT JOIN {n}_u ON {n}_u.user_id = imp.user_id" for n in _MAPS) + " LEFT JOIN bb ON bb.user_id = imp.user_id AND bb.k = imp.advertiser_bundle LEFT JOIN rb ON rb.user_id = imp.user_id AND rb.k = imp.advertiser_bundle"
_WHALE_CTES = f"wb AS (SELECT user_id, max(v) AS mx, CAST(count(*) AS INTEGER) AS n FROM bb WHERE v >= {WHALE_BUYS} GROUP BY 1), wr AS (SELECT user_id, max(v) AS mx, CAST(count(*) AS INTEGER) AS n FROM rb WHERE v >= {WHALE_REVENUE} GROUP BY 1)"
_WHALE_COLUMNS = f"""coalesce(wb.mx, 0.0) AS whale_total_buys_max, coalesce(wb.n, 0) AS whale_total_buys_n_bundles, CASE WHEN bb.v >= {WHALE_BUYS} THEN bb.v ELSE 0.0 END AS whale_total_buys_current,
    {q('coalesce(wr.mx, 0.0)', 2)} AS whale_total_rev_max, coalesce(wr.n, 0) AS whale_total_rev_n_bundles, {q(f'CASE WHEN rb.v >= {WHALE_REVENUE} THEN rb.v ELSE 0.0 END', 2)} AS whale_total_rev_current"""
_WHALE_JOINS = "LEFT JOIN wb ON wb.user_id = imp.user_id LEFT JOIN wr ON wr.user_id = imp.user_id"


@query(f"WITH {IMPRESSIONS}, {PURCHASES}, {_MAP_CTES}, {_WHALE_CTES} SELECT row_id, {_WHALE_COLUMNS} FROM imp {_MAP_JOINS} {_WHALE_JOINS}")
def whale_maps(spark, d):
    h = with_history(spark, d)
    return _compared(h.select("row_id", *(c.alias(n) for n, c in features.whale_columns(h).items())))


@query(f"""WITH {IMPRESSIONS}, {PURCHASES}, {_LOOKUP}, {_CODE_CTES}, {_USER}, {_MAP_CTES}, {_WHALE_CTES},
    s AS (SELECT user_id, CAST(count(DISTINCT seller) AS INTEGER) AS ns, CAST(count(seller) AS DOUBLE) AS ts FROM buy GROUP BY 1),
    a AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT event_type) AS INTEGER) AS k, CAST(count(DISTINCT extract(hour FROM ts)) AS INTEGER) AS h FROM events GROUP BY 1)
    SELECT row_id, datetime, {_CODE_COLUMNS.replace(", coalesce(code_advertiser_bundle.code, -1) AS advertiser_bundle", "")}, {_ONLINE_OWN}, {_MAP_COLUMNS}, coalesce(bb.v, 0.0) AS buys_bundle_current_adv, {q('coalesce(rb.v, 0.0)', 2)} AS rev_bundle_current_adv, {_WHALE_COLUMNS},
    coalesce(ns, 0) AS country_n_unique, coalesce(s.ts, 0.0) AS country_total_count, coalesce(h, 0) AS hour_n_unique, {q('CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END', 6)} AS hour_total_count,
    coalesce(nb, 0) AS last_buy_n_items, coalesce(nc, 0) AS last_buy_cat_n_items, coalesce(nb, 0) AS first_req_n_items, coalesce(a.n, 0.0) AS user_action_total, coalesce(a.k, 0) AS user_action_n_types
    FROM imp {_LOOKUP_JOINS} {_CODE_JOINS} {_USER_JOINS} {_MAP_JOINS} {_WHALE_JOINS} LEFT JOIN s ON s.user_id = imp.user_id LEFT JOIN a ON a.user_id = imp.user_id""")
def offline_features(spark, d):
    """All offline columns of the impressions."""
    df = once(impressions(spark, d))
    out, _ = features.offline(with_history(spark, d, df), _tables(df), _fitted(df))
    return _compared(out)


_ALL_CODES = ", ".join(f"code_{c} AS {_CODES.format(c=c, t='imp', w='')}" for c in _CODED)


@query(f"WITH {IMPRESSIONS}, {_ALL_CODES} SELECT row_id, user_id, hour, {_CODE_COLUMNS} FROM imp {_CODE_JOINS}")
def simple_features(spark, d):
    return features.simple(impressions(spark, d)).select("row_id", "user_id", "hour", *_CODED)


# Descriptive statistics


@query(imp("SELECT dev_os, count(*) AS count FROM imp GROUP BY 1"))
def value_counts_os(spark, d):
    return stats.value_counts(impressions(spark, d), "dev_os")


@query(imp(f"SELECT country, {q('count(*) / sum(count(*)) OVER ()', 6)} AS freq FROM imp WHERE country IS NOT NULL GROUP BY 1"))
def country_freq(spark, d):
    return stats.relative_frequency(impressions(spark, d), "country").select("country", r("freq", 6).alias("freq"))


@query(f"SELECT 'kind' AS \"column\", {q("avg(CAST(event_type = 'view' AS INTEGER))", 6)} AS null_pct FROM events UNION ALL SELECT 'event_id', {q('avg(0.0)', 6)} FROM events")
def null_pct(spark, d):
    own = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return stats.null_share(own).select("column", r("null_pct", 6).alias("null_pct"))


@query(imp(f"SELECT count(*) AS count, {q('avg(x)')} AS mean, {q('stddev_samp(x)')} AS std, {q('min(x)')} AS min, {q('quantile_cont(x, 0.25)')} AS q25, {q('quantile_cont(x, 0.5)')} AS q50, {q('quantile_cont(x, 0.75)')} AS q75, {q('max(x)')} AS max FROM (SELECT iap_revenue_d7 AS x FROM imp)"))
def describe_revenue(spark, d):
    out = stats.describe(impressions(spark, d), "iap_revenue_d7")
    return out.select("count", *(r(c).alias(c) for c in out.columns[1:]))


@query(imp(" UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS q, {q(f'quantile_cont(iap_revenue_d7, {p})')} AS value FROM imp" for p in (0.8, 0.9, 0.999))))
def revenue_quantiles(spark, d):
    return stats.quantiles(impressions(spark, d), "iap_revenue_d7", [0.8, 0.9, 0.999]).select("q", r("value").alias("value"))


@query("SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice) + 1e-7, 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount) + 1e-7, 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount) + 1e-7, 6) FROM lineitem)")
def corr_pairs(spark, d):
    return stats.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r("r", 6).alias("r"))


@query("SELECT \"column\", round(c + 1e-7, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr({c}, l_extendedprice) AS c FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ") ORDER BY abs(c) DESC LIMIT 1")
def strongest_correlation(spark, d):
    own = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return stats.strongest(own, "l_extendedprice", 1).select("column", r("r", 6).alias("r"))


@query(imp(f"SELECT country, {q('(SELECT avg(buyer_d7) FROM imp) * (1 - 1 / (1 + exp(-(count(*) - 200.0)))) + avg(buyer_d7) / (1 + exp(-(count(*) - 200.0)))', 6)} AS te FROM imp WHERE country IS NOT NULL GROUP BY 1"))
def target_encode(spark, d):
    return stats.target_encoding(impressions(spark, d), "country", "buyer_d7").select("country", r("te", 6).alias("te"))


def _whale_sql(c: str) -> str:
    return imp(f"SELECT {c}, {q('avg(CAST(iap_revenue_d7 >= (SELECT quantile_cont(iap_revenue_d7, 0.9) FROM imp) AS INTEGER))', 6)} AS whale_rate FROM imp WHERE {c} IS NOT NULL GROUP BY 1")


@query(_whale_sql("advertiser_category"))
def whale_rate_category(spark, d):
    return stats.whale_rate(impressions(spark, d), "advertiser_category", q=0.9).select("advertiser_category", r("whale_rate", 6).alias("whale_rate"))


@query(_whale_sql("country"))
def whale_rate_country(spark, d):
    return stats.whale_rate(impressions(spark, d), "country", q=0.9).select("country", r("whale_rate", 6).alias("whale_rate"))


@query(imp(f"SELECT country, {q('avg(iap_revenue_d7)')} AS avg_rev FROM imp GROUP BY 1"))
def avg_rev_country(spark, d):
    return impressions(spark, d).groupBy("country").agg(r(F.avg("iap_revenue_d7")).alias("avg_rev"))


_EDGES = ", ".join(f"quantile_cont(l_extendedprice, {i / 10})" for i in range(11))


@query(f"WITH e AS (SELECT list_distinct([{_EDGES}]) AS edges FROM lineitem), b AS (SELECT l_quantity, greatest(len(list_filter(edges, lambda x: x < l_extendedprice)) - 1, 0) AS bin FROM lineitem, e) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {q('avg(l_quantity)')} AS mean FROM b GROUP BY 1")
def qcut_group_mean(spark, d):
    return binning.qcut(table(spark, d, "lineitem"), "l_extendedprice", 10, "bin").groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean"))


_BIN = "CASE WHEN x < 0 THEN NULL WHEN x <= 1 THEN 0 WHEN x <= 3 THEN 1 WHEN x <= 6 THEN 2 WHEN x <= 10 THEN 3 ELSE 4 END"


@query(imp(f"SELECT {_BIN.replace('x ', 'iap_revenue_d7 ')} AS bin, count(*) AS n FROM imp GROUP BY 1"))
def revenue_bins(spark, d):
    return impressions(spark, d).groupBy(binning.cut("iap_revenue_d7", sampling.BINS).alias("bin")).agg(F.count("*").alias("n"))


@query(imp("SELECT CAST(least(floor(iap_revenue_d7 / 4.0), 99) AS INTEGER) AS bin, count(*) AS count FROM imp WHERE iap_revenue_d7 BETWEEN 0 AND 400 GROUP BY 1"))
def revenue_histogram(spark, d):
    return stats.histogram(impressions(spark, d), "iap_revenue_d7", 0.0, 400.0, 100)


@query(imp(f"SELECT buyer_d7, {q('min(iap_revenue_d7)')} AS low, {q('quantile_cont(iap_revenue_d7, 0.25)')} AS q25, {q('quantile_cont(iap_revenue_d7, 0.5)')} AS q50, {q('quantile_cont(iap_revenue_d7, 0.75)')} AS q75, {q('max(iap_revenue_d7)')} AS high FROM imp GROUP BY 1"))
def box_by_buyer(spark, d):
    out = stats.box(impressions(spark, d), "buyer_d7", "iap_revenue_d7")
    return out.select("buyer_d7", *(r(c).alias(c) for c in out.columns[1:]))


@query(imp(f"SELECT hour, {q('avg(iap_revenue_d7)')} AS mean, {q('1.96 * stddev_samp(iap_revenue_d7) / sqrt(count(*))')} AS half_width, count(*) AS n FROM imp GROUP BY 1"))
def revenue_by_hour(spark, d):
    x = "iap_revenue_d7"
    return impressions(spark, d).groupBy("hour").agg(r(F.avg(x)).alias("mean"), r(1.96 * F.stddev_samp(x) / F.sqrt(F.count("*"))).alias("half_width"), F.count("*").alias("n"))


@query(imp("SELECT row_id, country FROM imp WHERE country IN (SELECT country FROM imp WHERE country IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 10)"))
def top10_semi_filter(spark, d):
    return stats.in_top_k(impressions(spark, d), "country", 10).select("row_id", "country")


@query(imp(f"SELECT buyer_d7, {q('sum(count(*)) OVER () / (2.0 * count(*))', 6)} AS weight FROM imp GROUP BY 1"))
def class_weights(spark, d):
    return stats.class_weights(impressions(spark, d), "buyer_d7").select("buyer_d7", r("weight", 6).alias("weight"))


@query("SELECT count(*) FILTER (WHERE o IS NULL) AS only_a, count(*) FILTER (WHERE c IS NULL) AS only_b, count(*) FILTER (WHERE c IS NOT NULL AND o IS NOT NULL) AS both FROM (SELECT DISTINCT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o")
def key_integrity(spark, d):
    return stats.integrity(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(imp("SELECT row_id, iap_revenue_d7 FROM imp ORDER BY iap_revenue_d7 DESC, row_id LIMIT 25"))
def top_revenue(spark, d):
    return impressions(spark, d).select("row_id", "iap_revenue_d7").orderBy(F.desc("iap_revenue_d7"), "row_id").limit(25)


@query(imp("SELECT DISTINCT country, dev_os FROM imp WHERE datetime < '2024-01-02' INTERSECT SELECT DISTINCT country, dev_os FROM imp WHERE datetime >= '2024-01-28'"))
def common_segments(spark, d):
    df = impressions(spark, d)
    return scan.window(df, None, "2024-01-02", closed=False).select("country", "dev_os").intersect(scan.window(df, "2024-01-28").select("country", "dev_os"))


# Sampling and splits


@query(imp(f", b AS (SELECT {_BIN.replace('x ', 'iap_revenue_d7 ')} AS bin FROM imp), w AS (SELECT * FROM (VALUES (0, 0.3), (1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0)) t(bin, weight)) SELECT b.bin, count(*) AS n_original, CAST(any_value(weight) AS DOUBLE) AS weight, CAST(floor(count(*) * CAST(any_value(weight) AS DOUBLE)) AS BIGINT) AS n_samples FROM b JOIN w ON w.bin = b.bin GROUP BY 1"))
def bin_sample_plan(spark, d):
    return sampling.sample_plan(impressions(spark, d))


@query(imp(f", b AS (SELECT {_BIN.replace('x ', 'iap_revenue_d7 ')} AS bin FROM imp), w AS (SELECT * FROM (VALUES (0, 0.3), (1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0)) t(bin, weight)) SELECT b.bin, CAST(floor(count(*) * CAST(any_value(weight) AS DOUBLE)) AS BIGINT) AS n FROM b JOIN w ON w.bin = b.bin GROUP BY 1"))
def bin_sample_counts(spark, d):
    return sampling.bin_sample(impressions(spark, d), "row_id").groupBy("bin").agg(F.count("*").alias("n"))


def _drawn(*parts: str) -> str:
    """SQL of the number that a row's or a draw's digest gives."""
    return f"CAST('0x' || md5('42:' || {" || ':' || ".join(parts)})[1:15] AS BIGINT)"


_BIN_ROWS = f""", b AS (SELECT row_id, iap_revenue_d7, {_BIN.replace('x ', 'iap_revenue_d7 ')} AS bin FROM imp),
    w AS (SELECT * FROM (VALUES (0, 0.3), (1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0)) t(bin, weight)),
    k AS (SELECT b.*, CAST(weight AS DOUBLE) AS weight, row_number() OVER (PARTITION BY b.bin ORDER BY {_drawn('row_id')}, row_id) AS place, count(*) OVER (PARTITION BY b.bin) AS n FROM b JOIN w ON w.bin = b.bin),
    p AS (SELECT bin, any_value(n) AS n, any_value(weight) AS weight, CAST(floor(any_value(n) * any_value(weight)) AS BIGINT) AS m FROM k GROUP BY bin),
    r AS (SELECT bin, n, unnest(range(1, m + 1)) AS draw FROM p WHERE weight > 1)"""


@query(imp(f"{_BIN_ROWS} SELECT row_id, iap_revenue_d7, k.bin FROM k JOIN p ON p.bin = k.bin WHERE k.weight <= 1 AND place <= m UNION ALL SELECT row_id, iap_revenue_d7, k.bin FROM r JOIN k ON k.bin = r.bin AND k.place = {_drawn('r.bin', 'draw')} % r.n + 1"))
def bin_sample_rows(spark, d):
    return sampling.bin_sample(impressions(spark, d).select("row_id", "iap_revenue_d7"), "row_id")


_Q5 = ", ".join(f"quantile_cont(l_extendedprice, {i / 5})" for i in range(6))


@query(f"WITH e AS (SELECT list_distinct([{_Q5}]) AS edges FROM lineitem), b AS (SELECT greatest(len(list_filter(edges, lambda x: x < l_extendedprice)) - 1, 0) AS bin FROM lineitem, e) SELECT CAST(bin AS INTEGER) AS stratum, count(*) AS n_original, CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) AS n_samples FROM b GROUP BY 1")
def stratified_plan(spark, d):
    own = sampling.stratified_plan(table(spark, d, "lineitem"), "l_extendedprice")
    return own.select(F.col("stratum").cast("int").alias("stratum"), "n_original", "n_samples")


_R5 = ", ".join(f"quantile_cont(iap_revenue_d7, {i / 5})" for i in range(6))


@query(imp(f""", e AS (SELECT list_distinct([{_R5}]) AS edges FROM imp),
    b AS (SELECT row_id, iap_revenue_d7, CAST(greatest(len(list_filter(edges, lambda x: x < iap_revenue_d7)) - 1, 0) AS INTEGER) AS stratum FROM imp, e),
    k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_drawn('row_id')}, row_id) AS place, count(*) OVER (PARTITION BY stratum) AS n FROM b)
    SELECT row_id, iap_revenue_d7, stratum FROM k WHERE place <= greatest(1, floor(n * 0.1))"""))
def stratified_rows(spark, d):
    return sampling.stratified_sample(impressions(spark, d).select("row_id", "iap_revenue_d7"), "row_id", "iap_revenue_d7")


@query(imp("SELECT CAST(iap_revenue_d7 > 100 AS INTEGER) AS whale, CAST(count(*) * CASE WHEN iap_revenue_d7 > 100 THEN 4 ELSE 1 END AS BIGINT) AS n FROM imp GROUP BY iap_revenue_d7 > 100"))
def oversample_whales(spark, d):
    big = F.col("iap_revenue_d7") > 100
    return sampling.oversample(impressions(spark, d), big, 4).groupBy(big.cast("int").alias("whale")).agg(F.count("*").alias("n"))


@query(imp(", t AS (SELECT row_id, row_number() OVER (ORDER BY datetime, row_id) AS k, count(*) OVER () AS n FROM imp) SELECT row_id, CASE WHEN k <= floor(0.85 * n) THEN 'train' ELSE 'val' END AS part FROM t"))
def ordered_split(spark, d):
    first, rest = sampling.ordered_split(impressions(spark, d).select("row_id", "datetime"), "datetime", "row_id")
    return first.select("row_id", F.lit("train").alias("part")).unionByName(rest.select("row_id", F.lit("val").alias("part")))


@query(imp("SELECT row_id, country, CAST(NULL AS VARCHAR) AS region FROM imp WHERE datetime < '2024-01-02' UNION ALL SELECT row_id, NULL, region FROM imp WHERE datetime >= '2024-01-29'"))
def union_batches(spark, d):
    df = impressions(spark, d)
    return stats.union_all(scan.window(df, None, "2024-01-02", closed=False).select("row_id", "country"), scan.window(df, "2024-01-29").select("row_id", "region"))


# Metrics and combinations, over pseudo-scores that both engines compute

_SCORED = f"WITH {IMPRESSIONS}, s AS (SELECT row_id, buyer_d7, iap_revenue_d7 AS y, (row_id * 7919 % 1000) / 1000.0 AS p, ln(1.0 + row_id % 50) AS lr, CAST(row_id % 40 AS DOUBLE) AS pred FROM imp) "


def _scored(spark, d) -> DataFrame:
    return impressions(spark, d).select("row_id", "buyer_d7", F.col("iap_revenue_d7").alias("y"), ((F.col("row_id") * 7919 % 1000) / 1000.0).alias("p"), F.log1p((F.col("row_id") % 50).cast("double")).alias("lr"), (F.col("row_id") % 40).cast("double").alias("pred"))


def _reg_sql(p: str, prefix: str = "") -> str:
    le = f"pow(ln(1 + y) - ln(1 + greatest({p}, 0)), 2)"
    parts = {"msle": f"avg({le})", "rmsle": f"sqrt(avg({le}))", "rmse": f"sqrt(avg(pow(y - {p}, 2)))", "rmse_log": f"sqrt(avg({le}))", "mae": f"avg(abs(y - {p}))", "mae_log": f"avg(abs(ln(1 + y) - ln(1 + greatest({p}, 0))))", "mean_true": "avg(y)", "mean_pred": f"avg(greatest({p}, 0))", "zero_rate_true": "avg(CAST(y = 0 AS INTEGER))", "zero_rate_pred": f"avg(CAST(greatest({p}, 0) = 0 AS INTEGER))"}
    return ", ".join(f"{q(s)} AS {prefix}{n}" for n, s in parts.items())


_COUNTS = "count(*) FILTER (WHERE p >= 0.5 AND buyer_d7 = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND buyer_d7 <> 1) AS fp, count(*) FILTER (WHERE p < 0.5 AND buyer_d7 = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND buyer_d7 <> 1) AS tn"


@query(_SCORED + f"SELECT {_reg_sql('pred')} FROM s")
def regressor_report(spark, d):
    out = evaluate.regressor_report(_scored(spark, d), "y", "pred")
    return out.select(*(r(c).alias(c) for c in out.columns))


@query(_SCORED + f", c AS (SELECT {_COUNTS} FROM s) SELECT tp, fp, fn, tn, {q('tp / (tp + fp)', 6)} AS precision, {q('tp / (tp + fn)', 6)} AS recall, {q('2.0 * tp / (2 * tp + fp + fn)', 6)} AS f1, {q('(tp + tn) / (tp + fp + fn + tn)', 6)} AS accuracy, {q('(tp + fn) / (tp + fp + fn + tn)', 6)} AS pos_rate_true, {q('(tp + fp) / (tp + fp + fn + tn)', 6)} AS pos_rate_pred FROM c")
def classifier_report(spark, d):
    out = evaluate.classifier_report(_scored(spark, d), "buyer_d7", "p")
    return out.select("tp", "fp", "fn", "tn", *(r(c, 6).alias(c) for c in out.columns[4:]))


@query(_SCORED + f", k AS (SELECT buyer_d7, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s), n AS (SELECT sum(k) FILTER (WHERE buyer_d7 = 1) AS w, count(*) FILTER (WHERE buyer_d7 = 1) AS a, count(*) FILTER (WHERE buyer_d7 = 0) AS b FROM k) SELECT {q('(w - a * (a + 1) / 2.0) / (CAST(a AS DOUBLE) * b)', 8)} AS auc_roc FROM n")
def auc_roc(spark, d):
    return evaluate.auc_roc(_scored(spark, d), "buyer_d7", "p").select(r("auc_roc", 8).alias("auc_roc"))


@query(_SCORED + f", g AS (SELECT p, sum(buyer_d7) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY p DESC)) SELECT {q('sum(pos * (CAST(cp AS DOUBLE) / cn)) / sum(pos)', 8)} AS average_precision FROM c")
def average_precision(spark, d):
    return evaluate.average_precision(_scored(spark, d), "buyer_d7", "p").select(r("average_precision", 8).alias("average_precision"))


@query(_SCORED + f"SELECT row_id, {q('CASE WHEN p >= 0.5 THEN greatest(exp(lr) - 1, 0.0) ELSE 0.0 END')} AS gated, {q('CASE WHEN p > 0.5 THEN greatest(exp(lr) - 1, 0.0) ELSE 0.0 END')} AS strict FROM s")
def two_stage_gate(spark, d):
    return _scored(spark, d).select("row_id", r(evaluate.gate("p", "lr")).alias("gated"), r(evaluate.gate("p", "lr", strict=True)).alias("strict"))


@query(_SCORED + f"SELECT row_id, {q('greatest(p * (exp(lr) - 1), 0.0)')} AS soft FROM s")
def two_stage_product(spark, d):
    return _scored(spark, d).select("row_id", r(evaluate.product("p", "lr")).alias("soft"))


def _cls_sql() -> str:
    """Counts of the classifier at 0.5, and the rates that follow."""
    n = {k: f"count(*) FILTER (WHERE {'' if k[1] == 'p' else 'NOT '}p >= 0.5 AND buyer_d7 {'=' if k in ('tp', 'fn') else '<>'} 1)" for k in ("tp", "fp", "fn", "tn")}
    rates = {"precision": "{tp} / nullif({tp} + {fp}, 0)", "recall": "{tp} / nullif({tp} + {fn}, 0)", "f1": "2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)", "accuracy": "({tp} + {tn}) / count(*)", "pos_rate_true": "({tp} + {fn}) / count(*)", "pos_rate_pred": "({tp} + {fp}) / count(*)"}
    return ", ".join([f"{sql} AS cls_{k}" for k, sql in n.items()] + [f"{q(f'coalesce({sql.format(**n)}, 0.0)', 6)} AS cls_{k}" for k, sql in rates.items()])


@query(_SCORED + f"SELECT {_cls_sql()}, {_reg_sql('greatest(p * (exp(lr) - 1), 0)', 'final_')}, {_reg_sql('greatest(exp(lr) - 1, 0)', 'reg_')} FROM s")
def two_stage_report(spark, d):
    out = evaluate.two_stage_report(_scored(spark, d), "buyer_d7", "p", "y", "lr")
    return out.select(*(F.col(c) if c[4:] in ("tp", "fp", "fn", "tn") else r(c, 6).alias(c) if c.startswith("cls_") else r(c).alias(c) for c in out.columns))


@query(_SCORED + f"SELECT row_id, {q('0.8 * p + 0.2 * buyer_d7', 6)} AS p_label, {q('0.8 * lr + 0.2 * ln(1 + y)', 6)} AS r_label FROM s")
def distill_blend(spark, d):
    return _scored(spark, d).select("row_id", r(evaluate.blend("p", "buyer_d7"), 6).alias("p_label"), r(evaluate.blend(F.col("lr"), F.log1p("y")), 6).alias("r_label"))


@query(_SCORED + f"SELECT row_id, {q('0.2 * pred + 0.6 * y + 0.2 * lr')} AS meta_revenue, {q('p * (0.2 * pred + 0.6 * y + 0.2 * lr)')} AS buyer_x_revenue FROM s")
def meta_stack(spark, d):
    own = _scored(spark, d)
    return own.select("row_id", *evaluate.stack("pred", "y", "lr", "p")).select("row_id", r("meta_revenue").alias("meta_revenue"), r("buyer_x_revenue").alias("buyer_x_revenue"))


@query(_SCORED + f"SELECT 'teacher' AS model, 'msle' AS metric, {q('avg(pow(ln(1 + y) - ln(1 + pred), 2))')} AS value FROM s UNION ALL SELECT 'student', 'msle', {q('avg(pow(ln(1 + y) - ln(1 + pred / 2), 2))')} FROM s")
def teacher_student(spark, d):
    own = _scored(spark, d).withColumn("half", F.col("pred") / 2)
    both = {"teacher": evaluate.regressor_report(own, "y", "pred").select("msle"), "student": evaluate.regressor_report(own, "y", "half").select("msle")}
    return evaluate.compared(both.items()).select("model", "metric", r("value").alias("value"))


@query(None)
def gbt_two_stage_predict(spark, d):
    """Teachers fitted on the training window, and what they predict after it.

    Features are written once: each of the fits' many jobs reads the columns it
    needs, and none plans the features again.
    """
    df = once(impressions(spark, d))
    out, _ = features.online(with_history(spark, d, df), _tables(df), _fitted(df))
    own = once(out.join(df.select("row_id", "iap_revenue_d7", "buyer_d7"), "row_id"))
    names = [c for c in stats.numeric_columns(own) if c not in ("row_id", "iap_revenue_d7", "buyer_d7", "advertiser_bundle")]
    fitted = model.fit_teachers(scan.window(own, None, TRAIN_END), names, model.Boosting(3, 3))
    return fitted.score(scan.window(own, VAL_START)).select("row_id", "p_buyer", "log_rev", "gated", "soft")


# Further operators


@query("SELECT event_id FROM events")
def sparse_dropped(spark, d):
    own = table(spark, d, "events").select("event_id", F.lit(None).cast("string").alias("empty"), F.when(F.col("event_id") < 0, 1).alias("never"))
    return stats.drop_sparse(own)


@query(imp(f"SELECT row_id, coalesce(nullif(country, (SELECT min(country) FROM imp)), 'UNK') AS country, {q('coalesce(nullif(iap_revenue_d7, 0.0), (SELECT avg(nullif(iap_revenue_d7, 0.0)) FROM imp))')} AS revenue, CASE WHEN hour = 0 THEN -1 ELSE hour END AS hour FROM imp"))
def filled_columns(spark, d):
    df = impressions(spark, d)
    least = df.agg(F.min("country")).first()[0]
    own = df.select("row_id", F.nullif("country", F.lit(least)).alias("country"), F.nullif("iap_revenue_d7", F.lit(0.0)).alias("revenue"), F.nullif("hour", F.lit(0)).alias("hour"))
    return stats.filled(own, {"country": "UNK", "hour": -1}, ["revenue"]).select("row_id", "country", r("revenue").alias("revenue"), "hour")


@query(imp(f"SELECT row_id, hour, {q('iap_revenue_d7')} AS revenue, buyer_d7, {q('ln(1 + iap_revenue_d7)', 6)} AS log_rev_d7 FROM imp"))
def aligned_targets(spark, d):
    """Features and targets of the same rows, whatever the order of either."""
    df = impressions(spark, d)
    built = df.select("row_id", "hour").orderBy(F.desc("row_id"))
    targets = stats.with_targets(df.select("row_id", "iap_revenue_d7"))
    return built.join(targets, "row_id").select("row_id", "hour", r("iap_revenue_d7").alias("revenue"), "buyer_d7", r("log_rev_d7", 6).alias("log_rev_d7"))


@query(buy(f""", g AS (SELECT user_id, bundle, CAST(count(*) AS DOUBLE) AS v FROM buy GROUP BY 1, 2), h AS (SELECT user_id, seller, CAST(count(*) AS DOUBLE) AS v FROM buy WHERE seller IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, CAST(sum(v) AS INTEGER) AS bundles_ins_count, CAST(count(*) AS INTEGER) AS bundles_ins_unique, {q('avg(v)', 6)} AS num_buys_bundle_mean, max(v) AS num_buys_bundle_max, min(v) AS num_buys_bundle_min, CAST(count(*) AS INTEGER) AS num_buys_bundle_count,
    coalesce((SELECT max(v) FROM h WHERE h.user_id = g.user_id), 0.0) AS country_hist_top1 FROM g GROUP BY 1"""))
def flatten_nested(spark, d):
    h = _buyers(spark, d).select("user_id", "num_buys_bundle", "bundles_ins", "country_hist")
    out = features.flatten_all(h, ["num_buys_bundle"], ["bundles_ins"], ["country_hist"], top_k=1)
    return out.drop("country_hist_entropy", "num_buys_bundle_std").withColumn("num_buys_bundle_mean", r("num_buys_bundle_mean", 6))


@query(imp(f"SELECT row_id, row_number() OVER (ORDER BY {_drawn('row_id')}, row_id) - 1 AS place FROM imp"))
def shuffled_rows(spark, d):
    """Every row with its place in the shuffled order."""
    own = sampling.shuffled(impressions(spark, d).select("row_id"), "row_id").select("row_id", F.monotonically_increasing_id().alias("_at"), F.lit(1).alias("one"))
    return running(own, ["_at"], ["one"]).select("row_id", F.col("one_before").alias("place"))


@query(imp("SELECT 'country' AS \"column\", count(DISTINCT country) AS n FROM imp UNION ALL SELECT 'advertiser_bundle', count(DISTINCT advertiser_bundle) FROM imp UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM imp"))
def distinct_counts(spark, d):
    return stats.n_unique(impressions(spark, d), ["country", "advertiser_bundle", "user_id"])


@query(imp(", f AS (SELECT CAST(user_id AS VARCHAR) AS value, min(row_id) AS first FROM imp GROUP BY 1) SELECT value, CAST(row_number() OVER (ORDER BY first, value) - 1 AS INTEGER) AS code FROM f"))
def first_seen_codes(spark, d):
    return encoding.first_seen_codes(impressions(spark, d), "user_id", "row_id")


@query(imp("SELECT row_id, datetime FROM imp ORDER BY datetime DESC, row_id DESC LIMIT 20"))
def last_rows(spark, d):
    return stats.tail(impressions(spark, d).select("row_id", "datetime"), ["datetime", "row_id"], 20)


@query(imp(f"SELECT buyer_d7, {q('avg(iap_revenue_d7)')} AS iap_revenue_d7, {q('avg(hour)')} AS hour FROM imp GROUP BY 1"))
def means_by_buyer(spark, d):
    return stats.group_means(impressions(spark, d), "buyer_d7", ["iap_revenue_d7", "hour"]).select("buyer_d7", r("iap_revenue_d7").alias("iap_revenue_d7"), r("hour").alias("hour"))


@query(imp(f"SELECT country, {q('avg(buyer_d7)', 6)} AS buyer_rate, count(*) AS n FROM imp WHERE country IS NOT NULL GROUP BY 1"))
def out_of_fold_totals(spark, d):
    """Out-of-fold rates, each weighed by its fold's rows elsewhere, add up to the rates of all rows."""
    found = stats.out_of_fold(impressions(spark, d).select("row_id", "country", "buyer_d7", "iap_revenue_d7").where("country is not null"), "country", "row_id", 4)
    folds = found.groupBy("country", F.pmod(F.xxhash64(F.col("row_id"), F.lit(42)), F.lit(4)).alias("fold")).agg(F.first("buyer_rate").alias("rate"), F.count("*").alias("n"), F.sum("buyer_d7").alias("own"))
    whole = folds.groupBy("country").agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.collect_list(F.struct("rate", "n")).alias("parts"), F.sum("own").alias("own"))
    elsewhere = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.coalesce(p["rate"], F.lit(0.0)) * (F.col("all") - p["n"]))
    rate = F.when(F.col("k") > 1, elsewhere / (F.col("k") - 1)).otherwise(F.col("own")) / F.col("all")
    return whole.select("country", r(rate, 6).alias("buyer_rate"), F.col("all").alias("n"))


@query(imp("SELECT user_id, hour, iap_revenue_d7, buyer_d7 FROM imp"))
def predictor_input(spark, d):
    return features.predictor_input(impressions(spark, d))


@query(imp(f", t AS (SELECT {q('avg(iap_revenue_d7)')} AS x, {q('avg(buyer_d7)')} AS y FROM imp) SELECT unnest(['[mean]', '  mean_buyer: ' || printf('%.6f', y), '  mean_revenue: ' || printf('%.6f', x)]) AS line FROM t"))
def metric_lines(spark, d):
    row = impressions(spark, d).agg(r(F.avg("iap_revenue_d7")).alias("mean_revenue"), r(F.avg("buyer_d7")).alias("mean_buyer")).first().asDict()
    return spark.createDataFrame([(x,) for x in evaluate.lines_of(row)], "line string")


@query(imp(f""", f AS (SELECT * FROM imp WHERE datetime <= '{TRAIN_END}'), c AS (SELECT country, avg(iap_revenue_d7) AS v FROM f GROUP BY 1),
    t AS (SELECT country, (SELECT avg(buyer_d7) FROM f) * (1 - 1 / (1 + exp(-(count(*) - 200.0)))) + avg(buyer_d7) / (1 + exp(-(count(*) - 200.0))) AS v FROM f GROUP BY 1),
    t2 AS (SELECT advertiser_category AS cat, (SELECT avg(buyer_d7) FROM f) * (1 - 1 / (1 + exp(-(count(*) - 200.0)))) + avg(buyer_d7) / (1 + exp(-(count(*) - 200.0))) AS v FROM f GROUP BY 1),
    k2 AS (SELECT country, avg(CAST(iap_revenue_d7 >= (SELECT quantile_cont(iap_revenue_d7, 0.8) FROM f) AS INTEGER)) AS v FROM f GROUP BY 1),
    k AS (SELECT advertiser_category AS cat, avg(CAST(iap_revenue_d7 >= (SELECT quantile_cont(iap_revenue_d7, 0.8) FROM f) AS INTEGER)) AS v FROM f GROUP BY 1)
    SELECT row_id, CAST(isodow(strptime(datetime, '%Y-%m-%d-%H-%M')) - 1 AS INTEGER) AS weekday, {q('coalesce(t.v, (SELECT avg(buyer_d7) FROM f))', 6)} AS country_te, {q('coalesce(k.v, 0.0)', 6)} AS cat_whale_rate, {q('coalesce(c.v, 0.0)')} AS country_avg_rev,
        {q('coalesce(t2.v, (SELECT avg(buyer_d7) FROM f))', 6)} AS advertiser_category_te, {q('coalesce(k2.v, 0.0)', 6)} AS country_whale_rate, {q('sin(hour * pi() / 12)', 6)} AS hour_sin, {q('cos(hour * pi() / 12)', 6)} AS hour_cos
    FROM imp LEFT JOIN c ON c.country = coalesce(imp.country, 'UNK') LEFT JOIN t ON t.country = coalesce(imp.country, 'UNK') LEFT JOIN k ON k.cat = coalesce(imp.advertiser_category, 'UNK')
         LEFT JOIN t2 ON t2.cat = coalesce(imp.advertiser_category, 'UNK') LEFT JOIN k2 ON k2.country = coalesce(imp.country, 'UNK')"""))
def research_features(spark, d):
    df = impressions(spark, d)
    out = features.research(df, scan.window(df, None, TRAIN_END))
    return out.select("row_id", "weekday", r("country_te", 6).alias("country_te"), r("country_avg_rev").alias("country_avg_rev"), *(r(c, 6).alias(c) for c in ("cat_whale_rate", "country_whale_rate", "advertiser_category_te", "hour_sin", "hour_cos")))


# Ordered target statistics, states of hours, compiled models


def _ordered_sql(c: str) -> str:
    key = f"coalesce({c}, '__MISSING__')"
    over = f"OVER (PARTITION BY {key} ORDER BY md5('42:' || row_id), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return q(f"(coalesce(sum(buyer_d7) {over}, 0) + 2.0 * p) / (count(buyer_d7) {over} + 2.0)", 6) + f" AS {c}_ts"


@query(imp(f", own AS (SELECT row_id, buyer_d7, nullif(country, (SELECT min(country) FROM imp)) AS country, advertiser_category, dev_os, (SELECT avg(buyer_d7) FROM imp) AS p FROM imp) SELECT row_id, {', '.join(map(_ordered_sql, ('country', 'advertiser_category', 'dev_os')))} FROM own"))
def ordered_target_statistics(spark, d):
    df = impressions(spark, d)
    least, prior = df.agg(F.min("country"), F.avg("buyer_d7")).first()
    own = df.select("row_id", "buyer_d7", F.nullif("country", F.lit(least)).alias("country"), "advertiser_category", "dev_os")
    cats = ["country", "advertiser_category", "dev_os"]
    return encoding.ordered_statistics(own, cats, "buyer_d7", "row_id", prior, 2.0).select("row_id", *(r(f"{c}_ts", 6).alias(f"{c}_ts") for c in cats))


STATE_WINDOWS = [("2024-01-01", "2024-01-10"), ("2024-01-05", "2024-01-20"), (None, None)]


def _state_sql() -> str:
    keys = {"bundle": "advertiser_bundle", "category": "advertiser_category", "country": "country", "segment": "coalesce(country, 'None') || '_' || coalesce(dev_os, 'None')"}
    parts = []
    for n, (start, end) in enumerate(STATE_WINDOWS):
        where = "TRUE" if start is None else f"datetime >= '{start}' AND datetime <= '{end}'"
        for name, key in keys.items():
            rates = f"{q('avg(buyer_d7)')} AS buyer_rate, {q('avg(iap_revenue_d7)')} AS avg_rev_d7, {q('avg(CAST(ln(1 + iap_revenue_d7) > 4.0 AS INTEGER))')} AS whale_rate, count(buyer_d7) AS count"
            parts.append(f"SELECT {n} AS win, '{name}' AS tab, {key} AS key, {rates} FROM imp WHERE {where} AND {key} IS NOT NULL GROUP BY {key}")
    return imp(" UNION ALL ".join(parts))


@query(_state_sql())
def lookup_state_windows(spark, d):
    """Three windows' lookup tables from one hourly state."""
    state = once(stats.hourly_state(impressions(spark, d), 4.0))
    parts = []
    for n, window in enumerate(STATE_WINDOWS):
        parts += [t.select(F.lit(n).alias("win"), F.lit(name).alias("tab"), "key", r("buyer_rate").alias("buyer_rate"), r("avg_rev_d7").alias("avg_rev_d7"), r("whale_rate").alias("whale_rate"), "count") for name, t in stats.tables_of_state(state, *window).items()]
    return stats.union_all(*parts)


#: Fitted once on impressions up to TRAIN_END, and kept as text: the query and its SQL are made from the same trees.
TWO_STAGE = compiled.Scorer.of((Path(__file__).parent / "two_stage.json").read_text())


def _two_stage_sql() -> str:
    body = TWO_STAGE.sql("given")
    scored = f"SELECT row_id, {q('p_buyer', 6)} AS p_buyer, {q('log_rev', 6)} AS log_rev, {q('gated')} AS gated, {q('soft')} AS soft FROM ({body})"
    return imp(f""", given AS (SELECT row_id, hour, user_id % 97 AS "user", length(advertiser_category) AS "name", length(country) AS "where" FROM imp WHERE datetime >= '{VAL_START}') {scored}""")


@query(_two_stage_sql())
def compiled_two_stage(spark, d):
    """A stored two-stage model as column expressions over the rows after its training window."""
    df = scan.window(impressions(spark, d), VAL_START)
    own = df.select("row_id", "hour", (F.col("user_id") % 97).alias("user"), F.length("advertiser_category").alias("name"), F.length("country").alias("where"))
    return TWO_STAGE.score(own).select("row_id", r("p_buyer", 6).alias("p_buyer"), r("log_rev", 6).alias("log_rev"), r("gated").alias("gated"), r("soft").alias("soft"))


def _sketch_sql() -> str:
    parts = []
    for n, (start, end) in enumerate(STATE_WINDOWS):
        where = "TRUE" if start is None else f"datetime >= '{start}' AND datetime <= '{end}'"
        parts += [f"SELECT {n} AS win, '{c}' AS \"column\", count(DISTINCT {c}) AS n, TRUE AS near FROM imp WHERE {where}" for c in ("user_id", "advertiser_category")]
        parts.append(f"SELECT {n}, 'iap_revenue_d7', count(iap_revenue_d7), TRUE FROM imp WHERE {where}")
    return imp(" UNION ALL ".join(parts))


@query(_sketch_sql())
def sketch_windows(spark, d):
    """Three windows from stored sketches beside the exact numbers: distinct counts within 4 %, and quantiles whose ranks are within 2 %."""
    df = impressions(spark, d)
    stored = once(sketches.hourly(df, ["user_id", "advertiser_category"], ["iap_revenue_d7"]))
    parts = []
    for k, (start, end) in enumerate(STATE_WINDOWS):
        own = scan.window(df, start, end)
        about = sketches.distinct_counts(stored, start, end).withColumnRenamed("n", "about")
        exact = stats.n_unique(own, ["user_id", "advertiser_category"]).join(about, "column")
        parts.append(exact.select(F.lit(k).alias("win"), "column", "n", (F.abs(F.col("about") - F.col("n")) <= 0.04 * F.col("n")).alias("near")))
        x = F.col("iap_revenue_d7")
        edges = F.array(*(F.struct(F.lit(e["q"]).alias("q"), F.lit(e["value"]).alias("value")) for e in sketches.quantiles(stored, [0.25, 0.5, 0.9, 0.99], start, end).collect()))
        ranks = own.select("iap_revenue_d7", F.explode(edges).alias("e")).groupBy("e.q").agg(F.count(x).alias("n"), F.count_if(x < F.col("e.value")).alias("below"), F.count_if(x <= F.col("e.value")).alias("upto"))
        slack = 0.02 * F.col("n")
        met = (F.col("below") <= F.col("q") * F.col("n") + slack) & (F.col("upto") >= F.col("q") * F.col("n") - slack)
        parts.append(ranks.agg(F.max("n").alias("n"), F.bool_and(met).alias("near")).select(F.lit(k).alias("win"), F.lit("iap_revenue_d7").alias("column"), "n", "near"))
    return stats.union_all(*parts)


#: Columns of the wide correlation.
WIDE = 24


def _wide() -> list[str]:
    """Expressions of numbers of an order line, some of them missing; the same in both engines."""
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    return [f"CASE WHEN (l_orderkey + l_linenumber) % {3 + i} > 0 THEN CAST({base[i % 6]} AS DOUBLE) + {i} * CAST({base[(i + 1) % 6]} AS DOUBLE) END" for i in range(WIDE)]


def _wide_sql() -> str:
    each = ", ".join(f"{e} AS x{i}" for i, e in enumerate(_wide()))
    pairs = [f"SELECT 'x{i}' AS a, 'x{j}' AS b, {q(f'corr(x{i}, x{j})', 6)} AS r FROM own" for i in range(WIDE) for j in range(i + 1, WIDE)]
    return f"WITH own AS MATERIALIZED (SELECT {each} FROM lineitem) {' UNION ALL '.join(pairs)}"


@query(_wide_sql())
def correlations_wide(spark, d):
    own = table(spark, d, "lineitem").selectExpr(*(f"{e} AS x{i}" for i, e in enumerate(_wide())))
    return stats.correlations(own, own.columns).select("a", "b", r("r", 6).alias("r"))

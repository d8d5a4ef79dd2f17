"""Feature builders: online, offline, simple, and feature-set classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import nested as N
from sparkloom.functions.scalar import activity_ratio, hour_bin, hour_cyclical, os_major, recency_days
from sparkloom.operators import encoding, stats
from sparkloom.operators.settled import hinted, settled

CATEGORICAL = ["country", "region", "dev_os", "dev_osv", "dev_make", "dev_model", "carrier", "advertiser_bundle", "advertiser_category", "advertiser_subcategory", "advertiser_bottom_taxonomy_level"]
SCALARS = ["avg_act_days", "avg_daily_sessions", "avg_days_ins", "avg_duration", "weekend_ratio", "weeks_since_first_seen", "wifi_ratio"]
LISTS = {"user_bundles": "num_user_bundles", "user_bundles_l28d": "num_user_bundles_l28d", "bundles_ins": "num_bundles_ins", "new_bundles": "num_new_bundles"}
HISTOGRAMS = ["city_hist", "country_hist", "region_hist", "dev_language_hist", "dev_osv_hist", "hour_ratio"]
#: Kept as they are.
TEMPORAL = ["hour", "release_date"]
# Fixed names: map columns and what the names of their features begin with.
AMOUNTS = {"num_buys_bundle": "buys_bundle", "num_buys_category": "buys_category", "num_buys_category_bottom_taxonomy": "buys_tax", "iap_revenue_usd_bundle": "rev_bundle", "iap_revenue_usd_category": "rev_category", "iap_revenue_usd_category_bottom_taxonomy": "rev_tax"}
WHALES = {"whale_users_bundle_revenue_prank": "whale_rev_prank", "whale_users_bundle_num_buys_prank": "whale_buys_prank", "whale_users_bundle_total_revenue": "whale_total_rev", "whale_users_bundle_total_num_buys": "whale_total_buys"}
TIMES = {"last_buy_ts_bundle": "last_buy", "last_buy_ts_category": "last_buy_cat", "last_install_ts_bundle": "last_install", "last_install_ts_category": "last_install_cat", "first_request_ts_bundle": "first_req", "first_request_ts_category_bottom_taxonomy": "first_req_tax"}
ACTIONS = {"advertiser_actions_action_count": "adv_action", "user_actions_bundles_action_count": "user_action"}
#: Lookup tables and what each adds; segments have no whale rate.
LOOKUPS = {"bundle": ("advertiser_bundle", 3), "category": ("advertiser_category", 3), "country": ("country", 3), "segment": (None, 2)}
RATES = ["buyer_rate", "avg_rev_d7", "whale_rate"]


def list_columns(df: DataFrame) -> dict:
    return {out: N.list_len(c) for c, out in LISTS.items() if c in df.columns}


def map_columns(df: DataFrame) -> dict:
    out = {}
    if "num_buys_bundle" in df.columns:
        out |= {"total_buys": N.map_sum("num_buys_bundle"), "num_bought_bundles": N.map_len("num_buys_bundle")}
    if "iap_revenue_usd_bundle" in df.columns:
        out |= {"total_past_revenue": N.map_sum("iap_revenue_usd_bundle"), "num_revenue_bundles": N.map_len("iap_revenue_usd_bundle")}
    if "iap_revenue_usd_category" in df.columns:
        out["total_category_revenue"] = N.map_sum("iap_revenue_usd_category")
    return out


def hour_columns(df: DataFrame) -> dict:
    if "hour" not in df.columns:
        return {}
    sin, cos = hour_cyclical("hour")
    return {"hour_sin": sin, "hour_cos": cos, "hour_bin": F.coalesce(hour_bin("hour"), F.lit(0)).cast("int")}


def enrich(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """`df` with the lookup tables' rates (0 on a miss); keys are unique, so rows stay as they are."""
    out = df
    for name, (key, n) in LOOKUPS.items():
        parts = ["country", "dev_os"] if key is None else [key]
        if name not in tables or any(c not in df.columns for c in parts):
            continue
        table = tables[name].select(F.col("key").alias("_key"), *(F.col(r).alias(f"{name}_{r}") for r in RATES[:n]))
        own = stats.segment_key() if key is None else F.col(key).cast("string")
        out = out.join(hinted(tables[name], table), own == F.col("_key"), "left").drop("_key")
        out = out.withColumns({f"{name}_{r}": F.coalesce(f"{name}_{r}", F.lit(0.0)) for r in RATES[:n]})
    return out


def _flat_scalars(df: DataFrame) -> dict:
    """User scalars as doubles; those that are really maps by the mean of their values."""
    nested = set(stats.nested_columns(df))
    return {c: N.map_mean(c) if c in nested else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SCALARS if c in df.columns}


def online(df: DataFrame, tables: dict[str, DataFrame] | None = None, encoders: DataFrame | None = None, fit: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Cheap features and the encoders that were fitted or given.  row_id stays in front."""
    derived = list_columns(df) | map_columns(df) | hour_columns(df)
    cats = [c for c in CATEGORICAL if c in df.columns]
    scalars = _flat_scalars(df)
    base = df.select(*(c for c in ("row_id", "datetime", *TEMPORAL) if c in df.columns), *cats, *(c.alias(n) for n, c in scalars.items()), *(c.alias(n) for n, c in derived.items()))
    rich = enrich(base, tables or {})
    if encoders is None and fit:
        encoders = encoding.fit_encoders(df, cats)
    if encoders is not None:
        rich = encoding.apply_encoders(rich, encoders, cats)
    return rich.na.fill(0.0, subset=_fillable(rich, cats)), encoders


def _fillable(df: DataFrame, cats: list[str]) -> list[str]:
    return [c for c in stats.numeric_columns(df) if c not in {"row_id", *TEMPORAL, *cats}]


def histogram_columns(df: DataFrame, rich: bool = False) -> dict:
    out = {}
    for c in (c for c in HISTOGRAMS if c in df.columns):
        prefix = c.removesuffix("_hist").removesuffix("_ratio")
        out |= {f"{prefix}_n_unique": N.map_len(c), f"{prefix}_total_count": N.map_sum(c)}
        if rich:
            out |= {f"{prefix}_entropy": N.map_entropy(c), f"{prefix}_top1": N.top_values(c, 1)[0]}
    return out


def amount_columns(df: DataFrame) -> dict:
    out = {}
    for c, prefix in AMOUNTS.items():
        if c not in df.columns:
            continue
        out |= {f"{prefix}_sum": N.map_sum(c), f"{prefix}_max": N.map_max(c), f"{prefix}_n_keys": N.map_len(c), f"{prefix}_mean": N.map_mean(c)}
        if "bundle" in c and "advertiser_bundle" in df.columns:
            out[f"{prefix}_current_adv"] = N.map_get(c, "advertiser_bundle")
    return out


def whale_columns(df: DataFrame) -> dict:
    out = {}
    for c, prefix in WHALES.items():
        if c not in df.columns:
            continue
        out |= {f"{prefix}_max": N.map_max(c), f"{prefix}_n_bundles": N.map_len(c)}
        if "advertiser_bundle" in df.columns:
            out[f"{prefix}_current"] = N.map_get(c, "advertiser_bundle")
    return out


def time_columns(df: DataFrame, rich: bool = False, reference: str = "2025-10-08") -> dict:
    out = {}
    for c, prefix in TIMES.items():
        if c not in df.columns:
            continue
        out[f"{prefix}_n_items"] = N.map_len(c)
        if rich:
            days = lambda x: F.when(N.map_len(c) > 0, F.floor((F.unix_timestamp(F.lit(reference).cast("timestamp")) - x) / 86400)).otherwise(9999)  # noqa: B023, E731
            out |= {f"{prefix}_min_days_ago": days(N.map_max(c)), f"{prefix}_max_days_ago": days(N.map_min(c))}
    return out


def action_columns(df: DataFrame) -> dict:
    out = {}
    for c, prefix in ACTIONS.items():
        if c in df.columns:
            out |= {f"{prefix}_total": N.map_sum(c), f"{prefix}_n_types": N.map_len(c)}
    return out


def offline(df: DataFrame, tables: dict[str, DataFrame] | None = None, encoders: DataFrame | None = None, keep_bundle: bool = False, rich: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Online features and those of the maps.  Keys are looked up by the raw bundle; its code is dropped unless kept.

    `rich` adds entropies, top values and recencies.
    """
    more = histogram_columns(df, rich) | amount_columns(df) | whale_columns(df) | time_columns(df, rich) | action_columns(df)
    # Map features become columns of the same rows before anything is joined.
    raw = df.withColumns({f"_off_{n}": c for n, c in more.items()})
    cats = [c for c in CATEGORICAL if c in df.columns]
    scalars = _flat_scalars(df)
    derived = list_columns(df) | map_columns(df) | hour_columns(df)
    base = raw.select(*(c for c in ("row_id", "datetime", *TEMPORAL) if c in df.columns), *cats, *(c.alias(n) for n, c in scalars.items()), *(c.alias(n) for n, c in derived.items()), *(F.col(f"_off_{n}").alias(n) for n in more))
    out = enrich(base, tables or {})
    encoders = encoding.fit_encoders(df, cats) if encoders is None else encoders
    out = encoding.apply_encoders(out, encoders, cats)
    out = out.na.fill(0.0, subset=_fillable(out, cats))
    return (out if keep_bundle else out.drop("advertiser_bundle")), encoders


# Fixed names: the feature lists of the research variant (teacher classifier, teacher regressor, student), and the columns that leak.
RESEARCH_STUDENT = ["hour", "hour_sin", "hour_cos", "weekday", "avg_act_days", "weekend_ratio", "wifi_ratio", "weeks_since_first_seen", "advertiser_category", "country", "dev_os", "cat_whale_rate", "country_whale_rate", "country_avg_rev"]
RESEARCH_TEACHER = ["hour", "hour_sin", "hour_cos", "weekday", "avg_act_days", "weekend_ratio", "wifi_ratio", "weeks_since_first_seen", "recency_buy", "recency_install", "activity_intensity", "advertiser_category", "country", "dev_os", "advertiser_category_te", "country_te", "cat_whale_rate", "country_whale_rate", "country_avg_rev"]
RESEARCH_REGRESSOR = ["hour", "hour_sin", "hour_cos", "weekday", "avg_act_days", "weekend_ratio", "wifi_ratio", "weeks_since_first_seen", "advertiser_category", "country", "dev_os", "advertiser_category_te", "country_te", "cat_whale_rate", "country_whale_rate", "country_avg_rev", "buy_d7", "ctr_clean", "ctr_pct_rk_clean", "cpm_clean", "cpm_pct_rk_clean", "ctr_bin", "cpm_bin", "dev_osv_major"]
RESEARCH_LEAKS = ["iap_revenue_usd_bundle", "iap_revenue_usd_category", "iap_revenue_usd_category_bottom_taxonomy"]


def research(df: DataFrame, fit: DataFrame | None = None, min_samples: int = 200) -> DataFrame:
    """`df` with the columns of the research feature lists that its own columns allow.

    Encodings and rates are fitted on `fit` (None: on `df`): target encodings of
    category and country, filled with the mean of the buyers; whale rates and
    mean revenue, filled with 0.  Missing categories are "UNK", recencies
    without a time 999; columns that leak are dropped.
    """
    cats = {c: "UNK" for c in ("country", "advertiser_category", "dev_os")}
    known = stats.with_targets(stats.filled(df if fit is None else fit, cats))
    out = stats.filled(df.drop(*RESEARCH_LEAKS), cats)
    new = hour_columns(out)
    if "datetime" in out.columns:
        at = F.try_to_timestamp("datetime", F.lit("yyyy-MM-dd-HH-mm"))
        new["weekday"] = F.weekday(at)
        new |= {n: recency_days(at, c) for n, c in (("recency_buy", "last_buy"), ("recency_install", "last_ins")) if c in out.columns}
    if {"avg_act_days", "weeks_since_first_seen"} <= set(out.columns):
        new["activity_intensity"] = activity_ratio("avg_act_days", "weeks_since_first_seen")
    if "dev_osv" in out.columns:
        new["dev_osv_major"] = os_major("dev_osv")
    out = out.withColumns(new)
    mean = known.agg(F.avg("buyer_d7")).first()[0]
    parts = [(c, stats.target_encoding(known, c, "buyer_d7", min_samples), "te", f"{c}_te", mean or 0.0) for c in ("advertiser_category", "country")]
    parts += [(c, stats.whale_rate(known, c), "whale_rate", n, 0.0) for c, n in (("advertiser_category", "cat_whale_rate"), ("country", "country_whale_rate"))]
    parts += [("country", stats.group_means(known, "country", ["iap_revenue_d7"]), "iap_revenue_d7", "country_avg_rev", 0.0)]
    for c, table, value, name, missing in parts:
        pairs = settled(table.select(F.col(c).alias("_key"), F.col(value).alias(name)))
        out = out.join(hinted(pairs), F.col(c) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(missing)))
    return out


SIMPLE_CATEGORICAL = ["country", "region", "dev_os", "dev_make", "advertiser_bundle", "advertiser_category"]


def simple(df: DataFrame, targets: tuple[str, ...] = ("buyer_d7", "iap_revenue_d7")) -> DataFrame:
    """Numeric columns and label-encoded categories, missing numbers 0."""
    numeric = [c for c in stats.numeric_columns(df) if c not in targets and c != "row_id"]
    out = df.select(*(["row_id"] if "row_id" in df.columns else []), *numeric, *(c for c in SIMPLE_CATEGORICAL if c in df.columns))
    cats = [c for c in SIMPLE_CATEGORICAL if c in df.columns]
    return encoding.apply_encoders(out, encoding.fit_encoders(out, cats), cats).na.fill(0.0, subset=numeric)


def predictor_input(df: DataFrame) -> DataFrame:
    """Numeric columns without keys, missing numbers 0."""
    return df.select(*(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in stats.numeric_columns(df) if c not in ("row_id", "datetime")))


def feature_sets(df: DataFrame, sparse: float = 0.9) -> dict[str, list[str]]:
    """Columns by their share of nulls: empty, sparse (above the limit), dense; and those of the research lists that are there."""
    shares = {r["column"]: r["null_pct"] for r in stats.null_share(df).collect()}
    lists = {"teacher": RESEARCH_TEACHER, "regressor": RESEARCH_REGRESSOR, "student": RESEARCH_STUDENT}
    return {n: [c for c in own if c in df.columns] for n, own in lists.items()} | {"empty": [c for c in df.columns if shares[c] >= 1], "sparse": [c for c in df.columns if sparse < shares[c] < 1], "dense": [c for c in df.columns if shares[c] <= sparse]}


def flatten_all(df: DataFrame, maps: list[str], lists: list[str], histograms: list[str], times: list[str] = (), reference: str = "2025-10-08", top_k: int = 5) -> DataFrame:
    """All nested columns of the lists flattened in one projection; their sources go."""
    from sparkloom.functions.scalar import days_ago, decay

    have = set(df.columns)
    columns = [c for m in maps if m in have for c in N.dict_features(m)] + [c for a in lists if a in have for c in N.list_features(a)] + [c for h in histograms if h in have for c in N.histogram_features(h, top_k)]
    for t in times:
        if t in have:
            columns += [days_ago(t, reference).alias(f"{t}_days_ago"), decay(days_ago(t, reference)).alias(f"{t}_decay")]
    return df.select(*(c for c in df.columns if c not in {*maps, *lists, *histograms, *times}), *columns)

"""Every registered query against its SQL."""

import collections
import datetime

import pytest

from sparkloom.plans import fixture
from sparkloom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_history_of_odd_rows(spark, tmp_path):
    """Maps of users against brute force: missing brands, types, sellers, prices and event types, users without events or purchases."""
    day = datetime.datetime(2024, 1, 6, 5)  # a Saturday
    lines = [(0, 0, 0, 60_000.0, 1), (0, 1, 1, 7.5, 3), (1, 0, 9, None, 2), (2, 2, 0, 1.0, 4), (2, 3, 0, 2.0, 4), (3, 1, 0, 5.0, 9), (3, 1, 1, 5.25, 1), (4, 0, 0, 1.0, 1), (9, 0, 0, 1.0, 1)]
    orders = {0: 10, 1: 10, 2: 11, 3: 12, 4: None}
    parts = {0: ("B", "t"), 1: ("A", "t"), 2: (None, "u"), 3: ("A", None)}
    events = [(0, day, 10, "view"), (1, day + datetime.timedelta(days=2, hours=1), 10, "view"), (2, day, 11, None), (3, day, 13, "purchase"), (4, day, None, "view")]
    tables = {
        "region": ([(0, "r")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0), (1, None, 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, 0) for k in (10, 11, 12, 13)], "c_custkey long, c_nationkey int"),
        "supplier": ([(0, 0), (1, 1)], "s_suppkey long, s_nationkey int"),
        "part": ([(k, *v) for k, v in parts.items()], "p_partkey long, p_brand string, p_type string"),
        "orders": (list(orders.items()), "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, p, s, x, datetime.datetime(2024, 1, d)) for o, p, s, x, d in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp"),
        "events": ([(*e, 1.0) for e in events], "event_id long, ts timestamp, user_id long, event_type string, value double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    def counted(keys):
        return dict(collections.Counter(k for k in keys if k is not None)) or None

    found = {r["user_id"]: r for r in fixture.user_history(spark, str(tmp_path)).collect()}
    assert set(found) == {10, 11, 12, 13, None}
    for user, r in found.items():
        own = [(*parts[p], "N" if s == 0 else None, x, d) for o, p, s, x, d in lines if o in orders and orders[o] == user]
        acts = [(kind, ts) for _, ts, who, kind in events if who == user]
        assert r["num_buys_bundle"] == counted(b for b, *_ in own) and r["num_buys_category"] == counted(c for _, c, *_ in own) and r["country_hist"] == counted(s for _, _, s, *_ in own)
        assert r["bundles_ins"] == (sorted(b for b, *_ in own if b) or None) and r["user_bundles"] == (sorted({b for b, *_ in own if b}) or None)
        for b in r["num_buys_bundle"] or ():
            prices = [x for k, _, _, x, _ in own if k == b and x is not None]
            assert r["iap_revenue_usd_bundle"][b] == (sum(prices) if prices else None)
            assert r["last_buy_ts_bundle"][b] - r["first_request_ts_bundle"][b] == 86400 * (max(d for k, *_, d in own if k == b) - min(d for k, *_, d in own if k == b))
        assert r["user_actions_bundles_action_count"] == counted(k for k, _ in acts)
        assert r["hour_ratio"] == ({str(h): n / len(acts) for h, n in counted(ts.hour for _, ts in acts).items()} if acts else None)
        assert r["weekend_ratio"] == (sum(ts.weekday() >= 5 for _, ts in acts) / len(acts) if acts else None)
    assert found[10]["whale_users_bundle_total_revenue"] == {"B": 60_000.0} and found[12]["whale_users_bundle_total_num_buys"] == {"A": 2}
    joined = {r["row_id"]: r["num_buys_bundle"] for r in fixture.with_history(spark, str(tmp_path)).collect()}
    assert joined == {0: {"B": 2, "A": 1}, 1: {"B": 2, "A": 1}, 2: {"A": 1}, 3: None, 4: None}


def test_histories_are_shuffled_once(spark, small):
    """Order lines are read once, and no rows that hold maps are shuffled."""
    plan = fixture.with_history(spark, small)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [l_orderkey") == 1
    dealt = [plan.executedPlan()]
    while dealt:
        node = dealt.pop()
        children = node.children()
        dealt += [children.apply(i) for i in range(children.size())] if node.nodeName() != "AdaptiveSparkPlan" else [node.initialPlan()]
        if node.nodeName() == "Exchange":
            assert "map<" not in node.schema().catalogString()


def test_models_read_features_that_were_written(spark, small):
    """The jobs of the fits and the predictions don't plan histories and features again."""
    plan = QUERIES["gbt_two_stage_predict"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" in plan and "l_orderkey" not in plan

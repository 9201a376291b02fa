"""Every catalogue query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

from sealstone.plans import catalog, oracles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def normal(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(oracles.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, want.fetchall())


def test_only_the_fold_has_no_oracle():
    assert set(catalog.QUERIES) - set(oracles.ORACLES) == {"optimistic_conflicts"}


def test_conflicts_equal_a_fold(spark):
    rows = catalog.QUERIES["optimistic_conflicts"](spark, DATA).collect()
    events = {r.event_id: r for r in catalog.b.events(spark, DATA).collect()}
    done = {}
    for r in sorted(rows, key=lambda r: (r.analysis_id, events[r.event_id].ts, r.event_id)):
        n = done.get(r.analysis_id, 0)
        ok = r.expected_version is None or r.expected_version == n
        assert r.accepted == ok and r.version == (n + 1 if ok else None)
        done[r.analysis_id] = n + ok


def test_fields_of_every_order_are_matched(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    orders = [(100, 1, day, 10.5, "1-URGENT"), (101, 1, day, None, "1-URGENT"), (7, 2, day, 1250.0, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Ana Lima"), (2, "Hugo Rocha")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = lambda name: {(r.field, r.kind, r.matched, r.conflict): r.n for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    by_order, by_customer = got("match_field_orders"), got("match_field")
    # Order 101 has no price, so no text but the customer's name.
    assert by_order["valor", "money", True, False] == 2 and by_order["valor", "text", False, False] == 1
    assert by_order["pedido", "number", True, False] == by_order["pedido", "number", False, True] == by_order["pedido", "number", False, False] == 1
    assert by_order["destinatario", "text", True, False] == 3 and by_order["codigo", "code", False, False] == 3
    assert by_customer["valor", "money", True, False] == 2 and by_customer["valor", "text", False, False] == 1


def test_lines_hold_whole_turns(spark):
    rows = catalog.b.read(spark, DATA, "conversations").collect()
    got = {r.doc: r.text for r in catalog.QUERIES["line_text_whole"](spark, DATA).collect()}
    assert any(len(r.text) > 20 for r in rows) and all(f"{r.role}:{r.text}" in got[r.conv_id] for r in rows if r.text is not None)


def test_no_block_of_an_image_is_broadcast(spark):
    """The grid is an explode of `part`, which the planner takes for small at any size."""
    df = catalog.QUERIES["ghost_candidate"](spark, DATA)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

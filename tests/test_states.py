from tests.conftest import rows
from tidemark.operators.states import gated
from tidemark.operators.universe import tier_inclusion, tier_sets, token_universe


def test_gates_of_any_number(spark):
    keys = [f"k{i}" for i in range(61)]
    states = spark.createDataFrame([(k,) for k in [*keys, "none", None]], "gate_key string")
    gates = spark.createDataFrame([(k, True) for k in keys] + [("k1", False), ("k2", True), ("k3", None), (None, True)], "gate_key string, gate boolean")
    got = dict(tuple(r) for r in gated(states, gates).collect())
    assert all(got[k] == (k not in ("k1", "k3")) for k in keys) and not got["none"] and not got[None]
    assert not any(g for _, g in gated(states, gates.limit(0)).collect())


def test_universe_and_tiers(spark):
    tokens = spark.createDataFrame(
        [("a", "aaa", 3, "top_3"), ("b", "BBB ", 1, None), ("c", "usdx", 2, "all"), ("d", "x", 1, None), ("e", "a_b", 1, None), ("f", "old", 4, "selected"), ("g", "NEW", 9, "selected"), ("h", "nor", None, None)],
        "id string, symbol string, market_cap_rank int, tier string",
    )
    known = spark.createDataFrame([("aaa",), ("aaa",), (None,)], "symbol string")
    got = [tuple(r) for r in token_universe(tokens, known, ["USDX"], {"OLD": "NEW"}, 3).collect()]
    assert got == [("AAA", 3, "top_3", True), ("BBB", 1, None, False), ("NEW", 4, "selected", False)]
    assert rows(tier_inclusion(tier_sets(tokens))) == [("all", 8, 0), ("selected", 3, 0), ("top_3", 1, 0)]
    loose = spark.createDataFrame([("top_3", "Q"), ("selected", "R"), ("all", "R")], "tier string, symbol string")
    assert rows(tier_inclusion(loose)) == [("all", 1, 0), ("selected", 1, 0), ("top_3", 1, 1)]

from __future__ import annotations

from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stacklore.operators import rules, transactions

BASKETS = ["abc", "abc", "ab", "ac", "b", "d"]


def baskets(spark, rows):
    return transactions.transactions(spark.createDataFrame([(i, list(x) if x is not None else None) for i, x in enumerate(rows)], "id bigint, items array<string>"), "id", "items")


def test_itemsets_and_rules(spark):
    sets = rules.frequent_itemsets(baskets(spark, BASKETS), 0.3, 3)
    assert {("".join(r["items"]), r["count"]) for r in sets.collect()} == {("a", 4), ("b", 4), ("c", 3), ("ab", 3), ("ac", 3), ("bc", 2), ("abc", 2)}
    got = [(",".join(r["antecedent"]), ",".join(r["consequent"]), *r[2:8]) for r in rules.association_rules(sets).collect()]
    assert set(got) == {
        ("a", "b", 0.5, 3, 0.75, 1.125, 1.33333, 0.05556), ("b", "a", 0.5, 3, 0.75, 1.125, 1.33333, 0.05556), ("a", "c", 0.5, 3, 0.75, 1.5, 2.0, 0.16667),
        ("c", "a", 0.5, 3, 1.0, 1.5, 999.0, 0.16667), ("a", "b,c", 0.33333, 2, 0.5, 1.5, 1.33333, 0.11111), ("c", "a,b", 0.33333, 2, 0.66667, 1.33333, 1.5, 0.08333),
        ("a,b", "c", 0.33333, 2, 0.66667, 1.33333, 1.5, 0.08333), ("b,c", "a", 0.33333, 2, 1.0, 1.5, 999.0, 0.11111),
    }
    assert [g[5] for g in got] == sorted((g[5] for g in got), reverse=True)
    summary = {r["name"]: r["value"] for r in rules.itemset_summary(sets, 0.3).collect()}
    assert summary == {"frequent_1_itemsets": 3, "frequent_2_itemsets": 3, "frequent_3_itemsets": 1, "min_support_count": 2}


def test_tiers_best_and_recommendation(spark):
    found = rules.association_rules(rules.frequent_itemsets(baskets(spark, BASKETS), 0.3))
    tiered = rules.rule_tiers(found, 2)
    assert {r["tier"] for r in tiered.collect()} == {"exploratory"}
    assert rules.best_tier(tiered).count() == 8
    assert [r["recommend"] for r in rules.recommend_stack(found, ["b", "c"]).collect()] == ["a"]
    assert rules.recommend_stack(found, ["nothing"]).count() == 0


@pytest.mark.parametrize("rows", [[], [None], [[]], [["a"]]])
def test_empty(spark, rows):
    sets = rules.frequent_itemsets(baskets(spark, rows), 0.3)
    assert sets.count() == 0
    assert rules.association_rules(sets).count() == 0


def test_null_and_repeated_items(spark):
    tx = baskets(spark, [["a", "a", None, "b"], ["b", "a"]])
    assert [r["items"] for r in tx.orderBy("id").collect()] == [["a", "b"], ["a", "b"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdef"), max_size=5), min_size=1, max_size=12))
def test_itemsets_equal_counting_all(spark, rows):
    n = sum(bool(r) for r in rows)
    least = rules.min_count(n, 0.2)
    expected = {}
    for size in (1, 2, 3, 4):
        for row in rows:
            for c in combinations(sorted(row), size):
                expected[c] = expected.get(c, 0) + 1
    expected = {k: v for k, v in expected.items() if v >= least}
    assert {tuple(r["items"]): r["count"] for r in rules.frequent_itemsets(baskets(spark, [sorted(r) for r in rows]), 0.2, 4).collect()} == expected


def test_fpgrowth_agrees(spark):
    tx = baskets(spark, BASKETS)
    ours = {(tuple(r["items"]), r["count"]) for r in rules.frequent_itemsets(tx, 0.3).collect()}
    assert {(tuple(r["items"]), r["count"]) for r in rules.fpgrowth_itemsets(tx, 0.3, 100).collect()} == ours

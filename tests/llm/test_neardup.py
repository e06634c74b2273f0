from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from stacklore.llm import neardup, pairs
from stacklore.llm.wordhash import WORD


def exact(texts, width, least, share):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        s = set(zip(*(w[k:] for k in range(width)), strict=False))
        if len(s) >= least:
            sets[i] = s
    return {(i, j) for i, j in combinations(sets, 2) if len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])}


def found(spark, texts, share=Fraction(1, 2), width=3, least=6):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id bigint, text string, rep string")
    links, members = neardup.near_duplicates(df, share, width, least)
    return {(r["id_a"], r["id_b"]) for r in pairs.expand(links, members, []).collect()}, members


def edited(random, words, n):
    words = list(words)
    for _ in range(n):
        words[random.integers(0, len(words))] = f"new{random.integers(0, 10**6)}"
    return " ".join(words)


def test_recall_over_brute_force(spark):
    random = np.random.default_rng(1)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in random.integers(0, 400, 80)]
        texts += [" ".join(base), edited(random, base, 3), edited(random, base, 9)]
    truth = exact(texts, 3, 6, 0.5)
    got, _ = found(spark, texts)
    assert got <= truth
    assert len(got) >= 0.97 * len(truth) > 50


def test_null_empty_short_long_and_copies(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    texts = [None, "", "a b c", "  ", long, long + " end", "One, two three four five six seven eight nine", "one two three four five six seven eight NINE!"]
    got, members = found(spark, texts)
    assert got == {(4, 5), (6, 7)}
    assert {(r["id"], r["rep"]) for r in members.collect()} == {(4, 4), (5, 5), (6, 6), (7, 6)}
    assert found(spark, [])[0] == set()


def test_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (None, text), (1, text), (2, text + " x")], "id bigint, text string")
    links, members = neardup.near_duplicates(df, Fraction(1, 2), 3, 6)
    assert [(r["rep_a"], r["rep_b"]) for r in links.collect()] == [(1, 2)]
    assert members.count() == 2


def test_large_shards_are_cut_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 20)
    monkeypatch.setattr(neardup, "WATCH", 1)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(90)]
    got, _ = found(spark, texts)
    assert got == exact(texts, 3, 6, 0.5)
    assert len(got) == 90 * 89 // 2


def test_large_classes_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 3)
    members = spark.createDataFrame([(i, 0) for i in range(11)] + [(20, 20), (21, 20)] + [(30, 30)], "id bigint, rep bigint")
    links = spark.createDataFrame([(0, 20), (20, 30)], "rep_a bigint, rep_b bigint")
    got = sorted((r["id_a"], r["id_b"]) for r in pairs.expand(links, members, []).collect())
    classes = [list(range(11)), [20, 21], [30]]
    expected = [p for c in classes for p in combinations(c, 2)] + [(a, b) for i in (0, 1) for a in classes[i] for b in classes[i + 1]]
    assert got == sorted(expected)


def test_the_tree_compares_few_of_the_pairs(monkeypatch):
    """Clusters of near copies: vantage points rule most comparisons out and lose no pair."""
    random = np.random.default_rng(3)
    codes = np.repeat(random.integers(0, 1 << 63, (20, 4), dtype=np.uint64), 100, 0)
    for row in codes:
        for bit in random.integers(0, 256, 8):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    reach = neardup.radius(Fraction(1, 2))
    truth = int((np.bitwise_count(codes[:, None] ^ codes[None]).sum(-1) <= reach).sum() - 2000) // 2
    seen = []
    monkeypatch.setattr(neardup, "_distance", lambda a, b: (lambda d: (seen.append(d.size), d)[1])(np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)))
    found = sum(len(x) for x, _ in neardup.vantage_pairs(codes, reach))
    assert found == truth >= 20 * 100 * 99 // 2
    assert sum(seen) < 2000 * 2000 / 5


@pytest.mark.parametrize("spread", [3, 20, 128])
def test_vantage_point_tree_equals_brute_force(spread):
    random = np.random.default_rng(2)
    centres = random.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    codes = centres[random.integers(0, 12, 600)].copy()
    for row in codes:
        for bit in random.integers(0, 128, spread):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    reach = 40
    d = np.bitwise_count(codes[:, None] ^ codes[None]).sum(-1)
    truth = {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= reach, 1)), strict=True)}
    got = [(min(i, j), max(i, j)) for x, y in neardup.vantage_pairs(codes, reach) for i, j in zip(x, y, strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == truth


def test_vantage_point_tree_of_equal_points():
    codes = np.zeros((200, 2), np.uint64)
    assert sum(len(x) for x, _ in neardup.vantage_pairs(codes, 0)) == 200 * 199 // 2


def test_stricter_default(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base[:50], "edit", *base[51:]]), " ".join([*base[:30], *["x"] * 40, *base[70:]])]
    assert found(spark, texts, Fraction(4, 5), 5, 1)[0] == {(0, 1)}

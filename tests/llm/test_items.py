"""Problems 1, 2, 5 and 6 against brute force."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import log

import numpy as np
import pytest

from stacklore.llm import cooccurrence, distinctive, frequency, pairs, queries, setjoin


def sets(spark, rows, src="s"):
    return spark.createDataFrame([(src, i, sorted(set(r)) if r is not None else None, "clash") for i, r in enumerate(rows)], "src string, id bigint, items array<string>, item_a string")


@pytest.mark.parametrize("block", [2, 3, 128])
def test_pairs_of_small_and_large_baskets(spark, block):
    rows = [list("abcdefgh"), list("abc"), list("abc"), ["a"], [], None, list("bdfh")]
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence.cooccurrence(sets(spark, rows), ["src"], "id", "items", block=block).collect()}
    both = Counter(p for r in rows if r for p in combinations(sorted(r), 2))
    one = Counter(x for r in rows if r for x in r)
    assert {k: r["n_both"] for k, r in got.items()} == both
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["n_baskets"]) == (one[a], one[b], 5)
        assert r["lift"] == pytest.approx(both[a, b] * 5 / one[a] / one[b])
        assert r["pmi"] == pytest.approx(np.log2(r["lift"]))


def test_pairs_of_independent_items_have_no_association(spark):
    r = cooccurrence.cooccurrence(sets(spark, [["a", "b"], ["a"], ["b"], ["c"]]), ["src"], "id", "items").first()
    assert (r["lift"], r["llr"]) == (pytest.approx(1), pytest.approx(0, abs=1e-9))


def test_pairs_of_an_item_in_every_basket(spark):
    rows = [["hub", f"x{i}"] for i in range(50)]
    got = cooccurrence.cooccurrence(sets(spark, rows), ["src"], "id", "items")
    assert got.count() == 50
    assert cooccurrence.cooccurrence(sets(spark, rows), ["src"], "id", "items", min_count=2).count() == 0
    assert cooccurrence.cooccurrence(sets(spark, []), ["src"], "id", "items").count() == 0


def test_term_scores(spark):
    texts = ["red red green", "Green blue!", "blue blue blue 7", None, "  ", "!!!"]
    df = spark.createDataFrame([("t", i, t, 1) for i, t in enumerate(texts)], "src string, id bigint, text string, tf int")
    got = {(r["id"], r["term"]): r for r in distinctive.score_terms(distinctive.text_terms(df, ["src"], "text"), ["src"]).collect()}
    words = {0: Counter(red=2, green=1), 1: Counter(green=1, blue=1), 2: Counter({"blue": 3, "7": 1})}
    assert set(got) == {(i, w) for i, c in words.items() for w in c}
    total = sum(sum(c.values()) for c in words.values())
    for (i, w), r in got.items():
        df_, cf, size = sum(w in c for c in words.values()), sum(c[w] for c in words.values()), sum(words[i].values())
        table = np.array([[words[i][w], size - words[i][w]], [cf - words[i][w], total - size - cf + words[i][w]]], float)
        expected = np.outer(table.sum(1), table.sum(0)) / total
        llr = 2 * sum(o * log(o / e) for o, e in zip(table.ravel(), expected.ravel(), strict=True) if o > 0)
        assert abs(r["llr"]) == pytest.approx(llr, abs=1e-9)
        assert (r["llr"] >= 0) == (table[0, 0] >= expected[0, 0] - 1e-12)
        assert r["n_records"] == 4  # '!!!' is a text without words
        assert r["tfidf"] == pytest.approx(words[i][w] * log(4 / df_))


def test_term_scores_of_sets(spark):
    got = distinctive.score_terms(distinctive.set_terms(sets(spark, [["a", "b"], ["a"], [], None]), ["src"], "items"), ["src"])
    assert {(r["id"], r["term"], r["df"], r["n_records"]) for r in got.collect()} == {(0, "a", 2, 2), (0, "b", 1, 2), (1, "a", 2, 2)}


def test_the_ratio_selects_the_cases_and_loses_none(spark):
    random = np.random.default_rng(7)
    rows = []
    for i in range(150):  # few frequent words, many rare ones, one record that repeats a word very often
        words = Counter(f"w{int(x)}" for x in random.pareto(0.7, random.integers(1, 30)).clip(0, 5000))
        words["all"] = 1
        if i == 3:
            words["w1"] = 1000
        rows += [("s", i, w, n, sum(words.values()), at == 0) for at, (w, n) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "src string, id bigint, term string, tf bigint, size bigint, first boolean")
    scored = distinctive.score_terms(df, ["src"])
    for share in (0.3, 0.7, 1.0, 1.25, 3.0):
        expected = {(r["id"], r["term"]) for r in scored.collect() if r["df"] >= 2 and r["tfidf"] >= share * log(150) - 1e-9}
        got = {(r["id"], r["term"]) for r in distinctive.distinctive_terms(scored, distinctive.F.lit(share)).collect()}
        assert got == expected
        assert "all" not in {t for _, t in got}
    assert len(expected) >= 1  # the least frequent case: only the repeated word


def test_the_ratio_grows_with_the_times(spark):
    df = spark.range(0, 61).selectExpr("id AS tf", "60L AS size", "90L AS cf", "1000L AS n_terms")
    got = [r["x"] for r in df.orderBy("tf").select(distinctive.ratio(df.tf).alias("x")).collect()]
    assert got == sorted(got) and got[0] < 0 < got[-1]


def values(spark, rows):
    out = []
    for i, row in enumerate(rows):
        for at, (v, n) in enumerate(Counter(row).items()):
            out.append(("f", i, v, n, at == 0, "clash"))
    return spark.createDataFrame(out, "field string, id bigint, value string, times bigint, first boolean, code string")


def test_frequencies(spark):
    rows = [["hot", f"v{i}"] for i in range(300)] + [["hot", "hot"], ["twice", "twice"], ["twice"], [None], []]
    rows += [["often"]] * 35
    got = {r["value"]: r for r in frequency.frequencies(values(spark, [[v for v in r if v is not None] for r in rows])).collect()}
    assert len(got) == 303
    assert (got["hot"]["occurrences"], got["hot"]["records"], got["hot"]["mark"]) == (302, 301, "common")
    assert (got["twice"]["occurrences"], got["twice"]["records"], got["twice"]["mark"]) == (3, 2, "rare")
    assert (got["often"]["records"], got["often"]["n_records"], got["often"]["mark"]) == (35, 338, "common")
    assert frequency.frequencies(values(spark, [])).count() == 0


def test_frequencies_over_several_ranges(spark):
    rows = [[f"v{i}", f"v{i // 2}", "hot"] for i in range(9000)]
    times, records = Counter(v for r in rows for v in r), Counter(v for r in rows for v in set(r))
    got = {r["value"]: (r["occurrences"], r["records"]) for r in frequency.frequencies(values(spark, rows), blocks=3).collect()}
    assert got == {v: (n, records[v]) for v, n in times.items()}


def test_dictionary_has_no_gaps(spark):
    codes = frequency._number(spark.createDataFrame([("f", f"v{i:05d}") for i in range(5000)], "field string, value string")).orderBy("value").collect()
    assert [r["code"] for r in codes] == list(range(5000))


def brute(rows, least=4):
    rows = [(i, set(r)) for i, r in enumerate(rows) if r and len(set(r)) >= least]
    return {(i, j) for (i, a), (j, b) in combinations(rows, 2) if 5 * len(a & b) >= 3 * len(a | b)}


def linked(spark, rows):
    links, members = setjoin.similar_sets(sets(spark, rows), ["src"], "items")
    return {(r["id_a"], r["id_b"]) for r in pairs.expand(links, members, ["src"]).collect()}, pairs.class_links(links, members, ["src"])


@pytest.mark.parametrize("shard", [20_000, 3])
def test_similar_sets_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(setjoin, "SHARD", shard)
    random = np.random.default_rng(5)
    rows = []
    for size in [*range(1, 15), 15, 16, 17, 18, 20, 26, 40]:
        for _ in range(6):
            base = {f"v{x}" for x in random.integers(0, 60, size)}
            rows.append(base)
            for _ in range(3):  # near copies
                near = set(base)
                for _ in range(random.integers(0, max(2, size // 3))):
                    near ^= {f"v{random.integers(0, 60)}"}
                rows.append(near)
    rows += [rows[30], rows[30], None, []]
    found, classes = linked(spark, rows)
    assert found == brute(rows)
    assert classes.count() == sum(bool(r) and len(r) >= 4 for r in rows)


def test_rows_without_id(spark):
    df = spark.createDataFrame([("s", None, list("abcd")), ("s", 1, list("abcd")), ("s", 2, list("abcd"))], "src string, id bigint, items array<string>")
    links, members = setjoin.similar_sets(df, ["src"], "items")
    assert [(r["id_a"], r["id_b"]) for r in pairs.expand(links, members, ["src"]).collect()] == [(1, 2)]
    assert cooccurrence.cooccurrence(df, ["src"], "id", "items", block=2).first()["n_both"] == 3


def test_equal_sets_are_one_class(spark):
    rows = [list("abcd")] * 40 + [list("abce")]
    found, classes = linked(spark, rows)
    assert found == brute(rows)
    got = {r["id"]: r for r in classes.collect()}
    assert (got[7]["class_id"], got[7]["n_copies"], got[7]["n_links"], got[40]["n_links"]) == (0, 40, 1, 1)
    assert linked(spark, [])[0] == set()


def test_pairs_seen_once_are_in_the_result(spark, tmp_path):
    raw = spark.createDataFrame([("r", None, 1, ["a", "b"]), ("s", None, 2, ["b", "c"]), ("t", None, 3, ["B ", "c"])], "name string, collected_at timestamp, row_id bigint, topics array<string>")
    raw.write.parquet(str(tmp_path / "github_repos.parquet"))
    spark.createDataFrame([(1, ["x", "y"])], "repo_id bigint, tech_stack array<string>").write.parquet(str(tmp_path / "repos.parquet"))
    got = {(r["src"], r["item_a"], r["item_b"], r["n_both"], r["lift"]) for r in queries.p1_all_pairs(spark, str(tmp_path)).collect()}
    assert got == {("github_repos", "a", "b", 1, 1.0), ("github_repos", "b", "c", 2, 1.0), ("repos", "x", "y", 1, 1.0)}


@pytest.mark.parametrize("block", [2, 128])
def test_repeated_rows_of_large_baskets_count_each(spark, block):
    df = spark.createDataFrame([("s", 1, list("abcde"))] * 3 + [("s", 1, list("abc")), ("s", 2, list("abcde"))], "src string, id bigint, items array<string>")
    got = {(r["item_a"], r["item_b"]): r["n_both"] for r in cooccurrence.cooccurrence(df, ["src"], "id", "items", block=block).collect()}
    assert got == {p: 5 if set(p) <= set("abc") else 4 for p in combinations("abcde", 2)}

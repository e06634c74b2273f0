from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stacklore.functions import scalars as S


def value(spark, column, kind, x):
    return spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("Fast <b>React</b> framework for AI apps! https://example.com", "fast react framework for ai apps"),
        ("x https://a.b\xa0tail", "x tail"),
        ("a\n```py\ncode\n``` b ```c``` d", "a b d"),
        ("C++ / C# v1.2-rc", "c++ c# v1.2-rc"),
        (None, ""),
        ("", ""),
        ("   ", ""),
    ],
)
def test_clean_text(spark, text, clean):
    assert value(spark, S.clean_text, "string", text) == clean


def test_clean_text_takes_whole_texts(spark):
    assert len(value(spark, S.clean_text, "string", "word " * 100_000)) == 499_999
    assert value(spark, lambda c: S.clean_text(c, 4), "string", "abcdef") == "abcd"


@pytest.mark.parametrize(
    ("topics", "clean"),
    [
        (["ML", "awesome", "k8s", "React Native"], ["kubernetes", "machine-learning", "react-native"]),
        (["go", "ai"], ["artificial-intelligence"]),
        (["a_b c", "A-B-C", None, ""], ["a-b-c"]),
        (None, []),
        ([], []),
    ],
)
def test_normalize_topics(spark, topics, clean):
    assert value(spark, S.normalize_topics, "array<string>", topics) == clean


@pytest.mark.parametrize(("x", "year"), [(None, 2020), ("2019-05-01", 2019), ("abcd", 2020), ("", 2020), ("20", 20)])
def test_parse_year(spark, x, year):
    assert value(spark, S.parse_year, "string", x) == year


@pytest.mark.parametrize(("x", "name"), [(999, "rising"), (1000, "mid"), (10_000, "high"), (50_000, "mega"), (None, "rising")])
def test_popularity(spark, x, name):
    assert value(spark, S.popularity, "bigint", x) == name


@pytest.mark.parametrize(("x", "name"), [(2017, "Pre-2018"), (2018, "2018-2021"), (2021, "2018-2021"), (2022, "2022+")])
def test_era(spark, x, name):
    assert value(spark, S.era, "int", x) == name


@pytest.mark.parametrize(("x", "n"), [("12.5", 0), ("12", 12), (None, 0), ("x", 0)])
def test_safe_int(spark, x, n):
    assert value(spark, S.safe_int, "string", x) == n


def test_safe_int_cuts_fractions(spark):
    assert value(spark, S.safe_int, "double", 12.7) == 12


@pytest.mark.parametrize(("x", "title"), [("machine-learning", "Machine-Learning"), ("c++ x2y", "C++ X2Y"), ("", "")])
def test_title_case(spark, x, title):
    assert value(spark, S.title_case, "string", x) == title


def test_stack_takes_the_language_as_it_is(spark):
    df = spark.createDataFrame([(["zig"], "C"), (["zig"], "Unknown")], "t array<string>, l string")
    assert [r[0] for r in df.select(S.tech_stack(F.col("t"), F.col("l"))).collect()] == [["c", "zig"], ["zig"]]


def test_percent_clip_and_escape(spark):
    assert value(spark, S.percent, "double", 0.125) == "13%"
    assert value(spark, lambda c: S.clip(c, 0.0, 1.0), "double", 1.5) == 1.0
    assert value(spark, lambda c: S.clip(c, 0.0, 1.0), "double", None) is None
    assert value(spark, S.escape_html, "string", "<a & 'b'>") == "&lt;a &amp; &#039;b&#039;&gt;"

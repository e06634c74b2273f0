"""Column functions of the cleaning stage. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stacklore.functions.vocabulary import ALIASES, STOPWORDS

#: White space as a character class: ASCII, separators, and the Unicode spaces.
SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def strip(column: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(column, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def clean_text(column: Column, limit: int | None = None) -> Column:
    """Lower-cased words: without fenced code, tags, addresses and signs other than + - # .

    Null gives ''. ``limit`` keeps that many characters of the result; None keeps all.
    """
    steps = (r"```[\s\S]*?```", "<[^>]+>", f"https?://[^{SPACE}]+")
    text = reduce(lambda c, p: F.regexp_replace(c, p, " "), steps, F.coalesce(column, F.lit("")))
    # Runs of other signs and white space become one space. With \w in place of its three ranges
    # the class is matched some twenty times faster, so the underscore goes before.
    text = F.regexp_replace(F.translate(text, "_", " "), r"[^\w+\-#.]+", " ")
    text = F.lower(F.trim(text))
    return text if limit is None else F.substring(text, 1, limit)


def mapped(column: Column, names: Mapping[str, str]) -> Column:
    """The value's entry in a small map, else the value itself. One step, not transitive."""
    if not names:
        return column
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), column)


def norm_topic(column: Column, aliases: Mapping[str, str] = ALIASES) -> Column:
    """Lower case, trimmed, with - for _ and for runs of white space, then its alias's entry."""
    return mapped(_plain_topic(column), aliases)


def _plain_topic(column: Column) -> Column:
    return F.regexp_replace(F.replace(strip(F.lower(column)), F.lit("_"), F.lit("-")), f"[{SPACE}]+", "-")


def normalize_topics(column: Column, aliases: Mapping[str, str] = ALIASES, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Sorted distinct topics of an array; without null, stop words and those of up to 2 characters. [] for null."""
    plain = F.transform(F.coalesce(column, F.array().cast("array<string>")), _plain_topic)
    values = F.transform(plain, lambda t: mapped(t, aliases))  # apart, so that each value is worked out once
    keep = F.filter(values, lambda t: t.isNotNull() & (F.length(t) > 2) & ~t.isin(*stopwords))
    return F.array_sort(F.array_distinct(keep))


def parse_year(column: Column, default: int = 2020) -> Column:
    """The first four characters as a number, else ``default``."""
    return F.coalesce(F.substring(column, 1, 4).try_cast("int"), F.lit(default))


def safe_int(column: Column) -> Column:
    """The value as a whole number; 0 for null and for texts that are none, fractions cut."""
    return F.coalesce(column.try_cast("bigint"), F.lit(0))


def first_count(*columns: Column) -> Column:
    """The first that is neither null nor 0, as a whole number, else 0."""
    return F.coalesce(*[F.nullif(safe_int(c), F.lit(0)) for c in columns], F.lit(0))


def bucket(column: Column, bounds: Iterable[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that the value reaches, bounds descending; ``rest`` below all and for null."""
    pairs = list(bounds)
    start = F.when(column >= pairs[0][0], pairs[0][1])
    return reduce(lambda c, p: c.when(column >= p[0], p[1]), pairs[1:], start).otherwise(rest)


def popularity(stars: Column) -> Column:
    return bucket(stars, ((50_000, "mega"), (10_000, "high"), (1_000, "mid")), "rising")


def era(year: Column) -> Column:
    return bucket(year, ((2022, "2022+"), (2018, "2018-2021")), "Pre-2018")


def language_or_unknown(column: Column) -> Column:
    return F.coalesce(blank_to_null(strip(column)), F.lit("Unknown"))


def tech_stack(topics: Column, language: Column) -> Column:
    """Sorted distinct topics and the lower-cased language; the language is taken as it is."""
    own = F.when(language != "Unknown", F.array(F.lower(language))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(topics, own)))


def combined_text(description: Column, readme: Column, topics: Column, language: Column) -> Column:
    """The non-empty parts of a record in one text; the language stands once with the tags and once alone."""
    tags = F.concat(topics, F.when(language != "Unknown", F.array(F.lower(language))).otherwise(F.array().cast("array<string>")))
    return F.concat_ws(" ", blank_to_null(description), blank_to_null(readme), blank_to_null(F.array_join(tags, " ")), F.lower(language))


def title_case(column: Column) -> Column:
    """A capital after every character that is no letter, small letters elsewhere."""
    pieces = F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def search_blob(*columns: Column) -> Column:
    """What a search looks into: all parts in lower case; arrays by their members."""
    return F.lower(F.concat_ws(" ", *columns))


def percent(column: Column) -> Column:
    """A share as a whole percentage, halves up."""
    return F.concat(F.floor(column * 100 + 0.5).cast("string"), F.lit("%"))


def clip(column: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Null stays null."""
    value = column
    if low is not None:
        value = F.when(column.isNotNull(), F.greatest(value, F.lit(low) if not isinstance(low, Column) else low))
    if high is not None:
        value = F.when(column.isNotNull(), F.least(value, F.lit(high) if not isinstance(high, Column) else high))
    return value


def escape_html(column: Column) -> Column:
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))
    return reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), marks, F.coalesce(column, F.lit("")))


def bubble_radius(value: Column, factor: float, most: float) -> Column:
    """A drawing size: ``factor`` times the value, from 4 to ``most``."""
    return clip(value * factor, 4.0, most)

"""A paged search API as a Spark data source; its shards are the partitions.

``spark.dataSource.register(PagedSearch)`` and
``spark.read.format("paged_search").option("url", ...).load()``. The address may be a folder
(file://...) of pages named <shard>/<page>.json, as in tests.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stacklore.operators.cleaning import flatten_record, upsert
from stacklore.storage import cut, drop

# Topics, the star ranges that split a topic's results, and queries without a topic.
TOPICS = (
    "machine-learning", "deep-learning", "artificial-intelligence", "nlp", "computer-vision", "generative-ai", "llm", "data-science", "react", "vue", "angular",
    "nextjs", "typescript", "javascript", "python", "go", "rust", "java", "flutter", "react-native", "android", "ios", "devops", "docker", "kubernetes", "terraform",
    "security", "blockchain", "web3", "database", "postgresql", "redis", "game-development",
)
STARS = ("stars:100..499", "stars:500..999", "stars:1000..4999", "stars:5000..19999", "stars:>=20000")
PLAIN = (
    "stars:>=100000", "stars:50000..99999", "stars:20000..49999", "language:Python stars:1000..20000", "language:JavaScript stars:1000..20000",
    "language:TypeScript stars:1000..20000", "language:Go stars:1000..20000", "language:Rust stars:1000..20000",
)
#: Seconds a reply may take.
TIMEOUT = 30
SCHEMA = (
    "full_name string, stargazers_count bigint, forks_count bigint, watchers_count bigint, open_issues_count bigint, size bigint, language string, "
    "topics array<string>, description string, homepage string, created_at string, updated_at string, pushed_at string, license struct<spdx_id: string>, "
    "html_url string, default_branch string, archived boolean, owner struct<type: string>"
)


def query_plan(topics: Iterable[str] = TOPICS, stars: Iterable[str] = STARS, fixed: Iterable[str] = PLAIN) -> list[str]:
    """Each topic with each star range, then the fixed queries: 173 shards by default."""
    stars = list(stars)
    return [f"topic:{t} {s}" for t in topics for s in stars] + list(fixed)


def pages(per_query: int, size: int = 100) -> int:
    """Pages to ask for, from 1 to 10."""
    return max(1, min(10, -(-per_query // size)))


def request_json(url: str, token: str | None = None, sleep=time.sleep, clock=time.time, opener=urllib.request.urlopen) -> dict:
    """One page; waits and asks again while the service limits its rate (403, 429), {} for 422.

    If the service says that no requests remain and until when, it waits until then and 3 s
    more, at least 5 s; else 60 s. A reply may take TIMEOUT seconds.
    """
    headers = {"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})}
    while True:
        try:
            with opener(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if e.code == 422:
                return {}
            if e.code not in (403, 429):
                raise
            said = e.headers or {}
            reset = said.get("X-RateLimit-Reset") if said.get("X-RateLimit-Remaining") == "0" else None
            sleep(max(5, int(reset) - clock() + 3) if reset else 60)


def request_with_retries(url: str, token: str | None = None, attempts: int = 5, sleep=time.sleep, opener=urllib.request.urlopen) -> dict:
    """One page; asks up to ``attempts`` times, waiting 5 s (rate limit) or 3 s (5xx) doubled each time, at most 60 s."""
    headers = {"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})}
    for attempt in range(attempts):
        try:
            with opener(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            if attempt == attempts - 1 or not (e.code in (403, 429) or e.code >= 500):
                raise
            sleep(min(60, 2**attempt * (3 if e.code >= 500 else 5)))
    raise ValueError("no attempts")


class Shard(InputPartition):
    def __init__(self, query: str, number: int):
        self.query, self.number = query, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.options, self.fields = options, fields

    def partitions(self):
        plan = json.loads(self.options.get("queries", "[]"))
        return [Shard(q, i) for i, q in enumerate(plan)] or [Shard("", 0)]

    def read(self, shard):
        url = self.options["url"]
        for page in range(1, pages(int(self.options.get("perQuery", "100"))) + 1):
            if url.startswith("file://"):
                path = Path(url.removeprefix("file://")) / str(shard.number) / f"{page}.json"
                reply = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
            else:
                query = urllib.parse.urlencode({"q": shard.query, "sort": "stars", "order": "desc", "per_page": 100, "page": page})
                reply = request_json(f"{url}?{query}", self.options.get("token"))
            items = reply.get("items") or []
            if not items:  # an empty page ends the shard
                return
            for item in items:
                yield tuple(self._value(item, f) for f in self.fields)

    @staticmethod
    def _value(item: dict, field: str):
        value = item.get(field)
        if field == "license":
            return {"spdx_id": (value or {}).get("spdx_id")}
        if field == "owner":
            return {"type": (value or {}).get("type")}
        return value


class PagedSearch(DataSource):
    """Options: url, queries (a JSON list), perQuery, token."""

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options), schema.fieldNames())


def search(spark: SparkSession, url: str, queries: list[str], per_query: int = 900, token: str | None = None) -> DataFrame:
    """Flat records of all queries, a partition per query, with their place in ``seq``."""
    spark.dataSource.register(PagedSearch)
    options = {"url": url, "queries": json.dumps(queries), "perQuery": str(per_query), **({"token": token} if token else {})}
    rows = flatten_record(spark.read.format("paged_search").options(**options).load())
    return rows.filter(F.col("name") != "").withColumn("seq", F.monotonically_increasing_id())


def collect(spark: SparkSession, url: str, queries: list[str], target: int = 30_000, per_query: int = 900, at_once: int = 1, existing: DataFrame | None = None, token: str | None = None) -> DataFrame:
    """Records by name, of equal names the last, by stars descending and name; stops asking when ``target`` names are there.

    ``at_once`` shards are asked in parallel between two looks at the number of names. The
    table is written at every look, so a run that breaks off can go on from it with
    ``existing``.
    """
    table = existing
    for at in range(0, len(queries), at_once):
        if table is not None and table.count() >= target:
            break
        new = cut(search(spark, url, queries[at : at + at_once], per_query, token))
        old, table = table, cut(upsert(new.limit(0) if table is None else table, new, "name", "seq"))
        for done in (old, new):
            drop(done)
    if table is None:
        table = search(spark, url, [], per_query, token).limit(0)
    return table.orderBy(F.desc_nulls_last("stars"), "name")


def with_readmes(repos: DataFrame, fetch: Callable[[str], str], top: int = 1500) -> DataFrame:
    """Fills the empty readmes of the ``top`` records by stars with what ``fetch`` gives for their name, '' where it fails."""
    wanted = repos.orderBy(F.desc_nulls_last("stars"), "name").limit(top).filter(F.coalesce("readme", F.lit("")) == "").select("name")

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for name in batch.column(0).to_pylist():
                try:
                    texts.append(fetch(name))
                except Exception:  # any failure means no readme
                    texts.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["name", "__readme"])

    got = cut(wanted.mapInArrow(load, "name string, __readme string"))
    return repos.join(got, "name", "left").withColumn("readme", F.coalesce("__readme", "readme")).drop("__readme").select(repos.columns)


def languages_by_bytes(sizes: Column) -> Column:
    """The keys of a map language -> bytes, the largest first, ties by name."""
    pairs = F.transform(F.map_entries(sizes), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    return F.transform(F.array_sort(pairs), lambda e: e["k"])

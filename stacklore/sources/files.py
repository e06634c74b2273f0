"""JSON, CSV and Markdown sources and sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMA = (
    "name string, full_name string, stars bigint, stargazers_count bigint, forks bigint, forks_count bigint, watchers bigint, watchers_count bigint, "
    "open_issues bigint, open_issues_count bigint, size_kb bigint, language string, topics array<string>, description string, readme string, "
    "readme_snippet string, homepage string, created_at string, updated_at string, pushed_at string, license string, html_url string, "
    "default_branch string, archived boolean, owner_type string, data_origin string, source string, category string"
)


def read_json_array(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """Records of files that each hold a JSON array of objects; an error if one holds anything else.

    A file is one task, as its array cannot be split; use ``read_json_lines`` for large data.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    checked = whole.select(F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.raise_error(F.lit("the file must contain a JSON list"))).alias("v"))
    rows = checked.select(F.posexplode(F.from_json("v", f"array<struct<{_fields(schema)}>>", {"mode": "FAILFAST"})).alias("row_no", "r"))
    return rows.select(F.col("row_no").cast("bigint").alias("row_no"), "r.*")


def _fields(schema: str) -> str:
    return ", ".join("{}: {}".format(*part.strip().split(" ", 1)) for part in schema.split(", "))


def read_json_lines(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """One object per line: splittable."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object per line in as many files as there are partitions; replaces what is there."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str, indent: int | None = None) -> None:
    """One JSON array in one local file, in the order of the rows, read one partition at a time; for exports."""
    import json

    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    part = out.with_suffix(out.suffix + ".part")
    with part.open("w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            text = row["j"] if indent is None else json.dumps(json.loads(row["j"]), indent=indent, ensure_ascii=False)
            f.write(("," if i else "") + ("\n" if indent is not None else "") + text)
        f.write("\n]" if indent is not None else "]")
    part.replace(out)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; arrays as JSON text."""
    df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def decode_readme(content: Column, most: int | None = 4000) -> Column:
    """Base64 text as UTF-8, invalid bytes left out; '' where it is no base64. ``most`` characters are kept, None: all."""
    raw = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    kept = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�", "")
    text = F.coalesce(kept, F.lit(""))
    return text if most is None else F.substring(text, 1, most)


def register_views(spark: SparkSession, folder: str, tables: list[str]) -> None:
    """The parquet tables of a folder as temporary views, for SQL."""
    for table in tables:
        spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)


def markdown_report(path: str, nodes: DataFrame, rules: DataFrame, insights: DataFrame, top: int = 12) -> None:
    """The best rules, nodes and the insights as a Markdown file."""
    lines = ["# Project report", "", "## Insights", ""]
    lines += [f"- {r['text']}" for r in insights.orderBy("place").collect()]
    lines += ["", "## Association rules", "", "| # | rule | lift | confidence | support |", "|---|---|---:|---:|---:|"]
    best = rules.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support_count"), "antecedent", "consequent").limit(top).collect()
    lines += [f"| {i} | {' + '.join(r['antecedent'])} -> {' + '.join(r['consequent'])} | {r['lift']} | {r['confidence']} | {r['support']} |" for i, r in enumerate(best, 1)]
    lines += ["", "## Central technologies", "", "| # | technology | pagerank | repositories |", "|---|---|---:|---:|"]
    lines += [f"| {i} | {r['id']} | {r['pagerank']} | {r['count']:,} |" for i, r in enumerate(nodes.orderBy(F.desc("pagerank"), F.desc("count"), "id").limit(top).collect(), 1)]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")

"""Problem 8: filling containers of fixed capacity with items of varying length.

Sum-of-squares packing: the open containers are counted by fill level; an item goes to
the level (or a new container) that leaves the least sum of squared counts. Items are
dealt to shards of bounded size and packed there one after another; a shard keeps its
level counts in one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a shard, on average.
SHARD = 20_000
#: Runs of word characters, and runs of other characters except space and \\t\\n\\r\\f\\v.
_TOKEN = "\\w+|[^\\w \\t\\n\\r\\f\\x0B]+"  # \\w is ASCII here and, unlike its ranges, matched fast


def token_count(text: Column) -> Column:
    """Tokens of the word/punctuation tokenizer in ASCII mode; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("bigint")


def model_token_count(path: str):
    """A column function that counts tokens of a public tokenizer file (``tokenizers`` JSON)."""

    @F.pandas_udf("bigint")
    def count(texts):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        filled = texts.fillna("").tolist()
        return type(texts)([len(e) for e in model.encode_batch(filled, add_special_tokens=False)])

    return count


def _packer(capacity: int):
    def pack(batches):
        shard = None
        for batch in batches:
            rows = []
            for key, item, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != shard:
                    shard, made = key, 0
                    count = np.zeros(capacity + 1)
                    count[capacity] = -0.5  # a full container costs nothing
                    open_at: list[list[int]] = [[] for _ in range(capacity)]
                whole, rest = divmod(size, capacity) if size > capacity else (0, size)
                for piece in range(whole):
                    rows.append((item, piece, capacity, key, made))
                    made += 1
                if not rest:
                    continue
                levels = np.flatnonzero(count[1 : capacity - rest + 1] > 0) + 1
                change = 2 * (count[levels + rest] - count[levels]) + 2
                new = 2 * count[rest] + 1
                best = len(levels) - 1 - int(np.argmin(change[::-1])) if len(levels) else -1  # the fullest of equals
                if best >= 0 and change[best] <= new:
                    level = int(levels[best])
                    number = open_at[level].pop()
                    count[level] -= 1
                else:
                    level, number, made = 0, made, made + 1
                if level + rest < capacity:
                    open_at[level + rest].append(number)
                    count[level + rest] += 1
                rows.append((item, whole, rest, key, number))
            names = ["id", "piece", "tokens", "shard", "container"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)

    return pack


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """Assign items(id bigint, size bigint) to containers of ``capacity``.

    Returns id, piece, tokens, shard, container: (shard, container) names a container,
    and no container holds more than ``capacity``. An item up to the capacity is one
    piece. A larger one is split: all but its last piece fill a container each, the rest is
    packed like an item. Items of size 0 or null take no container and yield no row.
    Items are taken in the order of a hash of their id, so the result is the same
    however the input is stored; equal ids are items of their own.
    """
    sized = items.select("id", "size").filter(F.col("size") > 0)
    shards = max(1, -(-items.count() // SHARD))
    dealt = sized.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "size", F.xxhash64("id", F.lit("order")).alias("order"))
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order", "id", "size").select("shard", "id", "size")
    return ordered.mapInArrow(_packer(capacity), "id bigint, piece bigint, tokens bigint, shard bigint, container bigint")

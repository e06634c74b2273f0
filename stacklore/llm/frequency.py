"""Problem 5: frequency of every distinct value.

A global integer dictionary numbers the distinct values (sorted, without gaps). Blocks
of records are counted on their own, their values encoded, and the counts laid into
arrays, one per block and range of identifiers. Ranges are dealt to tasks, where the arrays
of a range are summed.
A value reaches the dictionary and the arrays at most once per block, however often it
occurs, so that no value makes a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklore.storage import cut

#: Identifiers per array.
RANGE = 4096
#: Parts in which the dictionary is numbered.
LANES = 64


def _number(values: DataFrame) -> DataFrame:
    """Adds ``code``: 0, 1, 2 ... in the order of (field, value), without one big sort task.

    Values are dealt to LANES lanes by their order; each lane is ranked on its own and
    starts where the lanes before it end.
    """
    laned = values.repartitionByRange(LANES, "field", "value").sortWithinPartitions("field", "value")
    laned = cut(laned.select("field", "value", F.spark_partition_id().alias("lane"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    sizes = laned.groupBy("lane").agg(F.count(F.lit(1)).alias("n"))  # at most LANES rows
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return laned.join(F.broadcast(starts), "lane").select("field", "value", (F.col("start") + F.col("place")).alias("code"))


def _arrays(batches):
    """Lays the (span, block, code, occ, rec) rows of each block into arrays and sums those of a range.

    Rows come sorted by range and block, whole ranges to a task; two arrays for the block at
    hand and two for the range are held.
    """
    last, own = None, None
    total = np.zeros((2, RANGE), np.int64)
    array = np.zeros((2, RANGE), np.int64)

    def out():
        at = np.flatnonzero(total[0])
        return pa.RecordBatch.from_arrays([pa.array(last * RANGE + at, pa.int64()), pa.array(total[0][at]), pa.array(total[1][at])], names=["code", "occurrences", "records"])

    for batch in batches:
        span, block, code, occ, rec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        starts = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (block[1:] != block[:-1])]) if len(span) else []
        for a, b in zip(starts, [*starts[1:], len(span)], strict=True):
            if last is not None and (span[a], block[a]) != (last, own):
                total += array
                array[:] = 0
                if span[a] != last:
                    yield out()
                    total[:] = 0
            last, own = int(span[a]), int(block[a])
            np.add.at(array[0], code[a:b] % RANGE, occ[a:b])
            np.add.at(array[1], code[a:b] % RANGE, rec[a:b])
    if last is not None:
        total += array
        yield out()


def frequencies(values: DataFrame, rare: int = 2, common_one_in: int = 10, blocks: int = 64) -> DataFrame:
    """Occurrences and records of every distinct value of values(field, id, value, times, first).

    One row per record and value; ``times`` is how often the record holds it, ``first``
    is true for one row of each record. Columns:
    field, value, occurrences, records, n_records, mark. n_records counts the field's
    records with a value; mark is 'rare' up to ``rare`` records, else 'common' from
    one in ``common_one_in`` of n_records, else ''. A value that is both counts as rare. Rows
    with null value are ignored. ``blocks`` blocks of records are counted apart.
    """
    rows = values.filter(F.col("value").isNotNull())
    local = rows.groupBy("field", "value", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.sum("times").alias("occ"), F.count(F.lit(1)).alias("rec"))
    local = cut(local)
    codes = cut(_number(local.select("field", "value").distinct()))
    encoded = local.join(codes, ["field", "value"]).select(F.floor(F.col("code") / RANGE).alias("span"), "block", "code", "occ", "rec")
    # A range has at most RANGE * blocks rows, so it fits a task, and each array is made where it is summed.
    summed = encoded.repartition("span").sortWithinPartitions("span", "block").mapInArrow(_arrays, "code bigint, occurrences bigint, records bigint")
    total = rows.groupBy("field").agg(F.sum(F.col("first").cast("bigint")).alias("n_records"))
    done = codes.join(summed, "code").join(F.broadcast(total), "field")  # a row per field
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common_one_in >= F.col("n_records"), "common").otherwise("")
    return done.select("field", "value", "occurrences", "records", "n_records", mark.alias("mark"))

"""Problem 3: near-duplicate texts.

A text is the set of its runs of ``width`` words. Minimum hashes of the set give a
fingerprint of 256 bits, whose Hamming distance estimates the similarity, and the keys
of the coarse shards the text is sent to, of which two near copies share at least one.
In each shard a vantage-point tree splits the fingerprints by their Hamming distance from a
vantage point, where the split saves most comparisons; the triangle inequality rules
branches out, and only fingerprints near a branch's boundary are compared across it. Where
no vantage point saves comparisons, as in shards of unrelated texts, all are compared (README.md
has the figures).
Pairs within the radius are verified on the exact sets. Exact copies form classes that are
searched once. Shards too large for a task are cut into blocks, and pairs of blocks are
searched apart.
"""

from __future__ import annotations

from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import BROADCAST_IDS, semi_by_ids
from stacklore.llm.wordhash import WordCodes, mix, shingles
from stacklore.storage import cut

BITS = 256
#: The fingerprint's columns.
CODES = [f"code{i}" for i in range(BITS // 64)]
#: Minimum hashes in a key, and how often at most a pair at the threshold shares no key.
KEY, MISS = 2, 0.001
#: A tree's leaf is searched directly up to this many fingerprints.
LEAF = 16
#: A vantage point is used if it saves this many comparisons for each distance to it.
WORTH = 8
#: Fingerprints of a shard that one task searches together.
SHARD = 4096
#: One record in so many is counted to foresee large shards; it only decides on blocks.
WATCH = 16


def banding(similarity: Fraction) -> int:
    """Keys of a text, so that a pair at the threshold shares a shard but MISS of the times, and more similar ones nearly always."""
    return min(BITS // KEY, max(6, int(np.ceil(np.log(MISS) / np.log(1 - float(similarity) ** KEY + 1e-12)))))


def radius(similarity: Fraction) -> int:
    """Hamming distance that a pair at the threshold exceeds once in ten thousand times."""
    p = (1 - float(similarity)) / 2
    return int(BITS * p + 3.8 * sqrt(BITS * p * (1 - p)) + 1)


#: Runs of words that are hashed together, of one text or many.
TOGETHER = 512


def _minima(sets: list[np.ndarray], times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The minimum of every hash over each of the sets, none empty; (sets, hashes)."""
    values = np.concatenate(sets).view(np.uint32).reshape(-1, 2).T.copy()
    ends = np.cumsum([0, *map(len, sets)]).tolist()
    out = np.full((2, len(sets), times.shape[1]), 0xFFFFFFFF, np.uint32)
    room = np.empty((TOGETHER, times.shape[1]), np.uint32)
    for side in (0, 1):  # one half of the hashes is taken from each half of the 64 bits
        text = 0
        for at in range(0, ends[-1], TOGETHER):
            part = values[side, at : at + TOGETHER]
            hashed = np.multiply(part[:, None], times[side], out=room[: len(part)])
            hashed += plus[side]
            stop = at + len(part)
            while True:
                a, b = max(ends[text], at), min(ends[text + 1], stop)
                own = hashed[a - at : b - at].min(0)
                if a == ends[text]:
                    out[side, text] = own
                else:
                    np.minimum(out[side, text], own, out=out[side, text])
                if ends[text + 1] > stop or ends[text + 1] == ends[-1]:
                    break
                text += 1
                if ends[text] == stop:
                    break
    return out.transpose(1, 2, 0).reshape(len(sets), -1)


def _sketcher(width: int, least: int, keys: int):
    def sketch(batches):
        random = np.random.default_rng(20240229)
        times = random.integers(0, 1 << 32, (2, BITS // 2), dtype=np.uint32) | np.uint32(1)
        plus = random.integers(0, 1 << 32, (2, BITS // 2), dtype=np.uint32)
        known = WordCodes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, width, known) if t else () for t in part.column(1).to_pylist()]
                kept = [i for i, h in enumerate(sets) if len(h) >= max(1, least)]
                sets = [sets[i] for i in kept]
                if not sets:
                    continue
                minima = _minima(sets, times, plus)
                k = np.broadcast_to(np.arange(1, keys + 1, dtype=np.uint64), (len(sets), keys))
                for c in range(KEY):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + minima[:, c : KEY * keys : KEY])
                codes = np.packbits(((minima * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8), axis=1).view(np.int64)
                low = np.array([h.sum(dtype=np.uint64) for h in sets]).view(np.int64)
                high = np.array([np.bitwise_xor.reduce(mix(h)) for h in sets]).view(np.int64)
                key = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, keys), pa.int32()), pa.array(np.ascontiguousarray(k).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(low), pa.array(high), *map(pa.array, codes.T.copy()), key], names=["id", "low", "high", *CODES, "keys"])

    return sketch


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _block(codes, a, b, reach):
    """Pairs of a x b within reach, in slices of bounded size."""
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        x, y = np.nonzero(_distance(codes[part][:, None], codes[b][None]) <= reach)
        yield part[x], b[y]


def _across(codes, a, b, reach):
    """Pairs within reach between two branches; prunes by the triangle inequality."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= LEAF * LEAF:
            yield from _block(codes, a, b, reach)
            continue
        if len(a) < len(b):
            a, b = b, a
        vantage = codes[a[0]]
        da, db = _distance(codes[a], vantage), np.sort(_distance(codes[b], vantage))
        s = np.sort(da)
        ends = np.flatnonzero(s[1:] > s[:-1])

        def near(low, high):
            """How many of b may be within reach of what is low to high from the vantage point."""
            return np.searchsorted(db, high + reach, "right") - np.searchsorted(db, low - reach, "left")  # noqa: B023

        cost = (ends + 1) * near(s[0], s[ends]) + (len(a) - ends - 1) * near(s[ends + 1], s[-1])
        if not len(ends) or cost.min() + WORTH * (len(a) + len(b)) > len(a) * len(b):
            yield from _block(codes, a, b, reach)
            continue
        bound = s[ends[cost.argmin()]]
        db = _distance(codes[b], vantage)
        for part, d in ((a[da <= bound], da[da <= bound]), (a[da > bound], da[da > bound])):
            stack.append((part, b[(db >= d.min() - reach) & (db <= d.max() + reach)]))


def _split(d: np.ndarray, reach: int) -> int | None:
    """The distance at which to split, so that least is compared within the branches and across their boundary; None if no split saves enough."""
    s = np.sort(d)
    ends = np.flatnonzero(s[1:] > s[:-1])
    if not len(ends):
        return None
    inner, outer = ends + 1, len(s) - ends - 1
    across = np.maximum(inner - np.searchsorted(s, s[ends + 1] - reach, "left"), 0) * np.maximum(np.searchsorted(s, s[ends] + reach, "right") - inner, 0)
    cost = (inner**2 + outer**2) / 2 + across
    best = int(cost.argmin())
    return int(s[ends[best]]) if cost[best] + WORTH * len(s) <= len(s) ** 2 / 2 else None


def vantage_pairs(codes: np.ndarray, reach: int):
    """Index pairs of fingerprints codes(n, words) within ``reach`` of each other."""
    stack = [np.arange(len(codes))]
    while stack:
        own = stack.pop()
        bound = None
        if len(own) > LEAF:
            for point in (own[0], own[len(own) // 2], own[-1]):
                d = _distance(codes[own], codes[point])
                bound = _split(d, reach)
                if bound is not None:
                    break
        if bound is None:  # a leaf, or all are as far from each other as from any vantage point
            for x, y in _block(codes, own, own, reach):
                yield x[x < y], y[x < y]
            continue
        near = d <= bound
        inner, outer, di, do = own[near], own[~near], d[near], d[~near]
        stack += [inner, outer]
        yield from _across(codes, inner[di >= do.min() - reach], outer[do <= di.max() + reach], reach)


def _searcher(reach: int):
    def groups(batches):
        """(key, part, side, id, codes ...) of whole groups; rows come sorted by key and part."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + len(CODES))]
            if not len(cols[0]):
                continue
            change = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            end = change[-1] + 1 if len(change) else 0
            if end or (held and (held[-1][0][-1] != cols[0][0] or held[-1][1][-1] != cols[1][0])):
                held.append([c[:end] for c in cols])
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append([c[end:] for c in cols])
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def search(batches):
        for key, part, side, ids, *columns in groups(batches):
            codes = np.stack(columns, 1).view(np.uint64)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            length = np.diff(np.r_[start, len(key)])
            found = []
            leaf = np.repeat((length > 1) & (length <= LEAF), length) & (side == 0)  # trees of one leaf, searched together
            for step in range(1, min(LEAF, length.max(initial=1))):
                x = np.flatnonzero(leaf[:-step] & (key[:-step] == key[step:]) & (part[:-step] == part[step:]))
                x = x[_distance(codes[x], codes[x + step]) <= reach]
                found.append((x, x + step))
            for s, n in zip(start, length, strict=True):
                if n > 1 and side[s : s + n].any():
                    at = np.arange(s, s + n)
                    found += _across(codes, at[side[at] == 1], at[side[at] == 2], reach)
                elif n > LEAF:
                    found += [(x + s, y + s) for x, y in vantage_pairs(codes[s : s + n], reach)]
            if found:
                x, y = (ids[np.concatenate(z)] for z in zip(*found, strict=True))
                ends = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
                yield pa.RecordBatch.from_arrays(ends, names=["rep_a", "rep_b"])

    return search


def _blocks(index: DataFrame) -> DataFrame:
    """Adds part and side: large shards are cut, each block meets itself and every other."""
    watched = index.filter(F.pmod(F.xxhash64("id", F.lit("watch")), F.lit(WATCH)) == 0)
    large = watched.groupBy("key").agg((F.count(F.lit(1)) * WATCH).alias("seen")).filter(F.col("seen") > SHARD)
    large = cut(large.select("key", F.ceil(F.col("seen") / SHARD).cast("int").alias("n")))
    count = large.limit(BROADCAST_IDS + 1).count()
    if not count:  # no join, so the index is shuffled once
        return index.select("key", F.lit(0).alias("part"), F.lit(0).alias("side"), "id", *CODES)
    rows = index.join(F.broadcast(large) if count <= BROADCAST_IDS else large, "key", "left")
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("n").cast("bigint")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda o: F.struct(
            (F.least(o, own) * F.col("n") + F.greatest(o, own)).cast("int").alias("part"),
            F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side"),
        ),
    )
    alone = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("side")))
    rows = rows.select("key", "id", *CODES, F.explode(F.when(F.col("n").isNull(), alone).otherwise(meets)).alias("m"))
    return rows.select("key", F.col("m.part").alias("part"), F.col("m.side").alias("side"), "id", *CODES)


def near_duplicates(texts: DataFrame, similarity: Fraction = Fraction(4, 5), width: int = 5, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Links between similar texts and the classes of texts with equal sets.

    texts(id bigint unique, text). A text of fewer than ``least`` distinct runs of
    ``width`` words (null and empty ones too) or without an id takes no part. Returns links(rep_a, rep_b,
    shared, united) with rep_a < rep_b and shared / united >= ``similarity``, exact, and
    members(id, rep): rep is the least id of the texts with the same set. A pair at the
    threshold meets in a shard with probability 0.999, which rises steeply above; the tree
    search within a shard misses one in ten thousand.
    """
    texts = texts.select("id", "text").filter(F.col("id").isNotNull())
    longs = ", ".join(f"{c} bigint" for c in ("id", "low", "high", *CODES))
    sketch = texts.mapInArrow(_sketcher(width, least, banding(similarity)), f"{longs}, keys array<bigint>")
    sketch = cut(sketch)
    copies = sketch.groupBy("low", "high").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    copies = cut(sketch.join(copies, ["low", "high"]).select("id", "rep"))
    others = copies.filter(F.col("id") != F.col("rep")).select("id")
    members = sketch.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    index = sketch.join(others, "id", "left_anti").select(F.explode("keys").alias("key"), "id", *CODES)
    shards = _blocks(index).repartition("key", "part").sortWithinPartitions("key", "part")
    met = cut(shards.mapInArrow(_searcher(radius(similarity)), "rep_a bigint, rep_b bigint").distinct())

    ends = met.select(F.col("rep_a").alias("id")).union(met.select("rep_b")).distinct()

    def sets(batches):
        known = WordCodes()
        for batch in batches:
            hashes = [shingles(t, width, known).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "items"])

    exact = semi_by_ids(texts.select("id", "text"), ends, "id").mapInArrow(sets, "id bigint, items array<bigint>")
    for side in "ab":
        met = met.join(exact.select(F.col("id").alias(f"rep_{side}"), F.col("items").alias(f"items_{side}")), f"rep_{side}")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    met = met.select("rep_a", "rep_b", shared.alias("shared"), (F.size("items_a") + F.size("items_b") - shared).alias("united"))
    return met.filter(F.col("shared") * similarity.denominator >= F.col("united") * similarity.numerator), members

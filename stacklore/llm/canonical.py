"""Problem 7: mapping free-entered values to a canonical list.

The reference entries form a BK-tree under the edit distance (single-character
insertions, deletions, replacements). Queries descend together, as arrays: at each node
the distances of all queries still there are computed bit-parallel, and by the triangle
inequality a query goes on only to children whose edge differs from its distance by at
most its radius, so every entry within the threshold is met. A reference of up to SHARD
entries goes to every task. A longer one is dealt to shards of that size, which meet the
blocks of distinct values as rows, each pair of shard and block in one task; the shards'
winners are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import dictionary_join
from stacklore.storage import cut

#: Reference entries that are sent to the tasks at once.
SHARD = 20_000
#: Distinct values that search a shard together.
BLOCK = 500_000
#: Results that a worker remembers between batches.
REMEMBER = 200_000
#: Edits allowed at most, whatever the length.
MOST = 2
_IGNORED = dict.fromkeys(map(ord, " \t _-./"))
_BLANK = " \t "


def plain(value: str) -> str:
    """Lower case without spaces, tabs, no-break spaces, and the characters _ - . /"""
    return value.lower().translate(_IGNORED)


def limit(entry: str) -> int:
    return min(MOST, len(entry) // 4)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


class BKTree:
    """Distinct entries in a tree; the child of a node at distance d hangs on edge d."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.children: list[dict[int, int]] = [{} for _ in entries]
        letters = sorted(set("".join(entries)))
        self.letters = {x: k + 1 for k, x in enumerate(letters)}  # 0 is any other
        self.longest = max(map(len, entries), default=0)
        text, length = self._numbers(entries)
        stack = [np.arange(len(entries))] if entries else []
        while stack:  # all entries below a node at once; the first at each distance is a child
            own = stack.pop()
            node, rest = int(own[0]), own[1:]
            d = self._distances(entries[node], text[rest], length[rest])
            for edge in np.unique(d).tolist():
                below = rest[d == edge]
                self.children[node][edge] = int(below[0])
                stack.append(below)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter numbers of the texts, a row each, and the lengths."""
        length = np.array([len(t) for t in texts], np.int64)
        text = np.zeros((len(texts), length.max(initial=0)), np.int64)
        get = self.letters.get
        for k, t in enumerate(texts):
            text[k, : len(t)] = [get(x, 0) for x in t]
        return text, length

    def _distances(self, entry: str, text: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Edit distances of ``entry`` to the rows of ``text``, letter numbers per row."""
        m = len(entry)
        if not 0 < m < 64:
            back = {k: x for x, k in self.letters.items()}
            return np.array([edit_distance(entry, "".join(back.get(c, "\0") for c in t[:n])) for t, n in zip(text.tolist(), length, strict=True)], np.int64)
        match = np.zeros(len(self.letters) + 1, np.uint64)
        for i, x in enumerate(entry):
            match[self.letters[x]] |= np.uint64(1 << i)
        one, top = np.uint64(1), np.uint64(m - 1)
        up = np.full(len(text), (1 << 64) - 1, np.uint64)
        down = np.zeros(len(text), np.uint64)
        score = np.full(len(text), m, np.int64)
        result = score.copy()
        for j in range(int(length.max(initial=0))):
            eq = match[text[:, j]]
            zero = (((eq & up) + up) ^ up) | eq | down
            plus = down | ~(zero | up)
            minus = zero & up
            score += ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64)
            plus = (plus << one) | one
            up = (minus << one) | ~(zero | plus)
            down = plus & zero
            np.copyto(result, score, where=length == j + 1)
        return result

    def search(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query: the least distance within an entry's limit (MOST + 1: none), an entry at it, and how many."""
        best = np.full(len(queries), MOST + 1, np.int64)
        entry = np.full(len(queries), -1, np.int64)
        ties = np.zeros(len(queries), np.int64)
        fits = [i for i, q in enumerate(queries) if 0 < len(q) <= self.longest + MOST]
        if not fits or not self.entries:
            return best, entry, ties
        where = np.array(fits)
        text, length = self._numbers([queries[i] for i in fits])
        stack = [(0, np.arange(len(fits)))]
        while stack:
            node, own = stack.pop()
            d = self._distances(self.entries[node], text[own], length[own])
            most = limit(self.entries[node])
            hit = where[own[d <= most]]
            dist = d[d <= most]
            better, equal = dist < best[hit], dist == best[hit]
            best[hit[better]], entry[hit[better]], ties[hit[better]] = dist[better], node, 1
            ties[hit[equal]] += 1
            for edge, child in self.children[node].items():
                near = own[np.abs(d - edge) <= MOST]
                if len(near):
                    stack.append((child, near))
        return best, entry, ties


def _matcher(reference: list[str], aliases: dict[str, str]):
    """(plain values) -> list of (distance, canonical, ties); distance -1 for an alias."""
    by_plain: dict[str, list[str]] = {}
    for name in sorted(set(reference)):
        by_plain.setdefault(plain(name), []).append(name)
    tree = BKTree(sorted(by_plain))
    short = {plain(a): c for a, c in sorted(aliases.items())}

    def match(values: list[str]) -> list[tuple[int, str, int]]:
        best, entry, ties = tree.search(values)
        out = []
        for value, d, e, n in zip(values, best.tolist(), entry.tolist(), ties.tolist(), strict=True):
            if value in short:
                out.append((-1, short[value], 1))
            elif e < 0:
                out.append((MOST + 1, "", 0))
            else:
                names = by_plain[tree.entries[e]]
                out.append((d, names[0], n + len(names) - 1))
        return out

    return match


def _searcher(short: dict[str, str]):
    """Searches rows(shard, block, is_value, text) that come sorted: first a shard's entries, then a block of values."""

    def search(batches):
        at, names, match = None, [], None
        for batch in batches:
            shard, block, is_value, text = (batch.column(i).to_pylist() for i in range(4))
            start = 0
            while start < len(text):
                key, kind = (shard[start], block[start]), is_value[start]
                end = start
                while end < len(text) and (shard[end], block[end]) == key and is_value[end] == kind:
                    end += 1
                if not kind:
                    if at != key:
                        at, names = key, []
                    names += text[start:end]
                    match = None
                else:
                    if at != key:  # no entry came before
                        at, names, match = key, [], None
                    if match is None:
                        match, exact = _matcher(names, short), set(names)
                    found = match([plain(v) for v in text[start:end]])
                    columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(text[start:end], pa.string()), *columns, pa.array([v in exact for v in text[start:end]], pa.bool_())], names=["value", "distance", "canonical", "ties", "exact"])
                start = end

    return search


def _winners(uses: DataFrame, names: DataFrame, short: dict[str, str]) -> DataFrame:
    """(value, distance, canonical, ties, exact) of the distinct values ``uses``(value, uses) over all entries ``names``(name)."""
    shards, blocks = (max(1, -(-df.count() // most)) for df, most in ((names, SHARD), (uses, BLOCK)))
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (shards, blocks)]
    entries = names.select(F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), every[1].alias("block"), F.lit(False).alias("is_value"), F.col("name").alias("text"))
    asked = uses.select(every[0].alias("shard"), F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_value"), F.col("value").alias("text"))
    rows = entries.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "is_value", "text")
    found = cut(rows.mapInArrow(_searcher(short), "value string, distance int, canonical string, ties int, exact boolean"))
    best = found.groupBy("value").agg(F.min("distance").alias("distance"), F.max("exact").alias("exact"))
    nearest = found.join(best.select("value", "distance"), ["value", "distance"]).groupBy("value").agg(F.max("canonical").alias("canonical"), F.sum("ties").alias("ties"))
    ties = F.when(F.col("distance") < 0, F.lit(1)).otherwise(F.col("ties"))
    return best.join(nearest, "value").select("value", "distance", "canonical", ties.cast("int").alias("ties"), "exact")


def map_values(values: DataFrame, reference: DataFrame, aliases: DataFrame, by: list[str]) -> DataFrame:
    """The canonical entry of each distinct raw value of a record.

    values(by, value): one row per record and value; reference(canonical);
    aliases(alias, canonical), at most SHARD rows. Values that are null, blank or exactly
    an entry are left out. Returns by, value, canonical: an alias gives its entry, else the
    one entry of fewest edits within its limit, else '' (none, or several equally near).
    Values are resolved where they stand, once per batch, so a frequent value makes no
    hot key; a very long value is unmatched.
    """
    if aliases.limit(SHARD + 1).count() > SHARD:
        raise ValueError(f"more than {SHARD} aliases")
    short = {r[0]: r[1] for r in aliases.filter("alias IS NOT NULL AND canonical IS NOT NULL").select("alias", "canonical").collect()}
    names = reference.select(F.col("canonical").alias("name")).filter(F.col("name").isNotNull()).distinct()
    small = [r[0] for r in names.limit(SHARD + 1).collect()]
    rows = values.select(*by, "value").filter(F.btrim("value", F.lit(_BLANK)) != "")
    adds = "distance int, canonical string, ties int, exact boolean"

    def resolved(values: DataFrame, names: list[str]) -> DataFrame:
        """values, the value being their last column, with what ``names`` have for it."""
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)

        def resolve(batches):
            match, exact = _matcher(names, short), set(names)
            known: dict[str, tuple[int, str, int]] = {}
            for batch in batches:
                codes = batch.column(batch.num_columns - 1).dictionary_encode()
                distinct = codes.dictionary.to_pylist()
                forms = [plain(v) for v in distinct]
                if len(known) > REMEMBER:
                    known.clear()
                fresh = sorted({p for p in forms if p not in known}, key=lambda p: (len(p), p))
                for at in range(0, len(fresh), 4096):
                    part = fresh[at : at + 4096]
                    known.update(zip(part, match(part), strict=True))
                found = [known[p] for p in forms]
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.int32()))]
                columns.append(pa.array([v in exact for v in distinct], pa.bool_()))
                columns = [c.take(codes.indices) for c in columns]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "distance", "canonical", "ties", "exact"])

        return values.mapInArrow(resolve, f"{kinds}, {adds}")

    if len(small) <= SHARD:
        found = resolved(rows, small)
    else:
        uses = cut(rows.groupBy("value").agg(F.count(F.lit(1)).alias("uses")))
        found = dictionary_join(rows, _winners(uses, cut(names), short).join(uses, "value"), ["value"], ["distance", "canonical", "ties", "exact"], "uses")
    one = (F.col("ties") == 1) & (F.col("distance") <= MOST)
    return found.filter(~F.col("exact")).select(*by, "value", F.when(one, F.col("canonical")).otherwise("").alias("canonical"))


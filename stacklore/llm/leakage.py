"""Problem 9: evaluation passages in training text.

Size-partitioned containment search by minimum hashes. A passage of an item is the set of
its runs of SHINGLE words; documents are read in overlapping pieces, one of which holds
any passage whole. Pieces are partitioned by size: in a piece of u runs, a contained passage
of q runs has similarity q / u, so a piece is looked up under as many minimum hashes as
find that similarity but MISS of the times: one if it is as small as a passage, more the
larger it is. The items' minimum hashes are a distributed index. What meets is verified
on the words: the document must hold the passage, run by run and in order.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.functions.tables import BROADCAST_IDS
from stacklore.llm.wordhash import WORD, WordCodes, mix, runs
from stacklore.storage import cut

#: Words of the runs of which a passage is made.
SHINGLE = 5
#: Pieces hold this many times the runs of a passage.
LARGER = 2
#: How often at most a contained passage shares no minimum hash with its piece.
MISS = 1e-4
#: Words of a document that are looked at together.
SLICE = 65_536


@cache
def bands(passage: int) -> list[int]:
    """Minimum hashes for pieces by their number of runs; 0 where no passage fits."""
    own = passage - SHINGLE + 1
    sizes = range(own * LARGER + 1)
    return [0 if u < own else 1 if u == own else int(np.ceil(np.log(MISS) / np.log(1 - own / u))) for u in sizes]


@cache
def _times(count: int) -> np.ndarray:
    return np.random.default_rng(915).integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)


def _hashes(codes: np.ndarray, count: int) -> np.ndarray:
    """``count`` hashes of every run of words; (runs, hashes). The runs are hashes themselves, so a product is enough."""
    return runs(codes, SHINGLE)[:, None] * _times(count)


def _minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The minima over every ``width`` consecutive rows."""
    span, low = 1, hashes
    while span * 2 <= width:  # by doubling
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _keys(minima: np.ndarray) -> np.ndarray:
    """A key for each minimum, different for different hash functions."""
    return mix(minima * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, minima.shape[-1] + 1, dtype=np.uint64))


def passage_keys(codes: np.ndarray, passage: int) -> np.ndarray:
    """The keys of all passages of an item, distinct."""
    own = passage - SHINGLE + 1
    if len(codes) < passage:
        return np.empty(0, np.uint64)
    return np.unique(_keys(_minima(_hashes(codes, bands(passage)[-1]), own)))


def piece_keys(codes: np.ndarray, passage: int) -> np.ndarray:
    """The keys of all pieces of a document, distinct; each piece has those of its size."""
    own, count = passage - SHINGLE + 1, bands(passage)
    full, found = own * LARGER, []
    step = full - own + 1  # so that every passage lies in a piece
    for at in range(0, max(1, len(codes) - passage + 1), SLICE // step * step):
        h = _hashes(codes[at : at + SLICE + full + SHINGLE], count[-1])
        if len(h) >= full:
            found.append(_keys(_minima(h, full)[::step]).ravel())
        left = (max(0, len(h) - full) // step + 1) * step if len(h) >= full else 0
        if len(h) - left >= own:  # the last piece is shorter
            found.append(_keys(h[left:].min(0)[None])[0, : count[len(h) - left]])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _sketcher(passage: int, keys_of):
    def sketch(batches):
        known = WordCodes()
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text.lower())
                found.append(keys_of(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), passage).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "keys"])

    return sketch


def _runs_of(text: str, passage: int, known: WordCodes) -> tuple[list[str], np.ndarray]:
    words = WORD.findall(text.lower())
    return words, runs(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), passage)


def held(document: str, items: list[str], passage: int, known: WordCodes, seen: dict) -> list[bool]:
    """Whether the document holds ``passage`` consecutive words of each of the items; ``seen`` keeps items from call to call."""
    words, own = _runs_of(document, passage, known)
    order = np.argsort(own)
    own = own[order]
    for text in items:
        if text not in seen:
            if len(seen) > 20_000:
                seen.clear()
            seen[text] = _runs_of(text, passage, known)
    theirs = [seen.get(text) or _runs_of(text, passage, known) for text in items]
    ends = np.cumsum([0, *(len(r) for _, r in theirs)])
    wanted = np.concatenate([r for _, r in theirs]) if theirs else own[:0]
    place = np.searchsorted(own, wanted)
    met = np.flatnonzero(own[np.minimum(place, len(own) - 1)] == wanted) if len(own) else []
    out = [False] * len(items)
    for at in met:  # equal hashes; the words decide
        k = int(np.searchsorted(ends, at, "right")) - 1
        start = at - ends[k]
        passage_words = theirs[k][0][start : start + passage]
        first, last = np.searchsorted(own, wanted[at], "left"), np.searchsorted(own, wanted[at], "right")
        out[k] = out[k] or any(words[i : i + passage] == passage_words for i in order[first:last])
    return out


def _verifier(passage: int):
    def verify(batches):
        known, seen = WordCodes(), {}
        for batch in batches:
            docs, hits = [], []
            for doc, text, items in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = held(text, [x["text"] for x in items], passage, known, seen)
                own = [x["item_id"] for x, yes in zip(items, found, strict=True) if yes]
                docs += [doc] * len(own)
                hits += own
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "rep"])

    return verify


def leaks(documents: DataFrame, items: DataFrame, passage: int = 10) -> DataFrame:
    """(doc_id, item_id) of documents holding ``passage`` consecutive words of an item, in order.

    documents(doc_id bigint, text), items(item_id bigint, text). Null and empty texts and
    items shorter than a passage or without an id match nothing; repeated items are reported
    each, and so are repeated documents. A passage that stands alone in a document is missed
    MISS of the times at most; longer ones have a chance at each of their words. ``passage`` must
    be SHINGLE words or more. The index is broadcast only if it was counted small; the corpus is
    read once for it, and its candidates once more.
    """
    texts = items.filter((F.length("text") > 0) & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    classes = cut(texts.groupBy("text").agg(F.min("item_id").alias("rep")).repartition(16))
    index = classes.select("rep", "text").mapInArrow(_sketcher(passage, passage_keys), "id bigint, keys array<bigint>")
    index = cut(index.select(F.explode("keys").alias("key"), F.col("id").alias("rep")))

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length("text") > 0)
    row = F.xxhash64("doc_id", "text").alias("row")  # rows that share it are only verified more often
    looked = rows.select(row, "text").mapInArrow(_sketcher(passage, piece_keys), "id bigint, keys array<bigint>").select(F.col("id").alias("row"), F.explode("keys").alias("key"))
    small = index.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = cut(looked.join(F.broadcast(index) if small else index, "key").select("row", "rep").distinct())

    asked = met.join(classes, "rep").groupBy("row").agg(F.collect_list(F.struct(F.col("rep").alias("item_id"), "text")).alias("items"))  # what the document met
    few = met.select("row").distinct().limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    near = rows.select("doc_id", "text", row)
    if few:  # the texts stay where they are read, and only those that met something move
        near = near.join(F.broadcast(met.select("row").distinct()), "row", "left_semi")
    found = near.join(asked, "row").select("doc_id", "text", "items").mapInArrow(_verifier(passage), "doc_id bigint, rep bigint")
    return found.join(texts.join(classes, "text").select("rep", "item_id"), "rep").select("doc_id", "item_id")

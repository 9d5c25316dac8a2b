"""Shards of nearly equal bytes: best-fit-decreasing bin packing of indivisible groups of equal texts.

The packing runs over a histogram of group sizes: a class of equally large groups enters the tightest bin that has
room, as many as fit, then the next tightest, which is what best-fit decreasing does with the groups one by one.
Groups then take the planned places by their rank within their size (ranks inside a written part, plus the parts
before it). The driver and the broadcast plan hold a row for each distinct size and bin change; distinct sizes
sum up to at most all bytes, so there are fewer than ``sqrt(2 * bytes)`` of them, however many groups there are.
Sizes are summed before the shuffle, and rows join their groups under skew handling, which bounds the cost of a
group that holds a third of all rows.

Odd input: a null text is a group of size 8 per row (no bytes) and shares it with nothing but null and empty
texts; rows that repeat an id are rows of their own; a very long text is one group, and if it is larger than a
shard's share of all bytes the shards get its size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans import Scratch

SHARDS = 24
ROW_BYTES = 8


class RoomTree:
    """A balanced (AVL) search tree of (room, bin) with the least room that suffices."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(t) -> int:
        return t[3] if t else 0

    def _node(self, left, key, right):
        return (left, key, right, 1 + max(self._height(left), self._height(right)))

    def _balanced(self, left, key, right):
        tilt = self._height(left) - self._height(right)
        if tilt > 1:
            a, k, b, _ = left
            if self._height(a) >= self._height(b):
                return self._node(a, k, self._node(b, key, right))
            return self._node(self._node(a, k, b[0]), b[1], self._node(b[2], key, right))
        if tilt < -1:
            a, k, b, _ = right
            if self._height(b) >= self._height(a):
                return self._node(self._node(left, key, a), k, b)
            return self._node(self._node(left, key, a[0]), a[1], self._node(a[2], k, b))
        return self._node(left, key, right)

    def _add(self, t, key):
        if not t:
            return self._node(None, key, None)
        left, k, right, _ = t
        return self._balanced(self._add(left, key), k, right) if key < k else self._balanced(left, k, self._add(right, key))

    def _least(self, t):
        while t[0]:
            t = t[0]
        return t[1]

    def _cut(self, t, key):
        left, k, right, _ = t
        if key < k:
            return self._balanced(self._cut(left, key), k, right)
        if key > k:
            return self._balanced(left, k, self._cut(right, key))
        if not left or not right:
            return left or right
        k = self._least(right)
        return self._balanced(left, k, self._cut(right, k))

    def add(self, room: int, box: int) -> None:
        self.root = self._add(self.root, (room, box))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the entry of least room that holds ``size``."""
        t, best = self.root, None
        while t:
            if t[1][0] >= size:
                best, t = t[1], t[0]
            else:
                t = t[2]
        if best:
            self.root = self._cut(self.root, best)
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most: int) -> list[tuple[int, int, int]] | None:
    """Runs (size, first rank, bin) from (size, count) in falling order of size; None when over ``most`` bins are needed.

    A run lasts to the next one of its size.
    """
    tree, bins, out = RoomTree(), 0, []
    for size, count in classes:
        rank = 0
        while rank < count:
            found = tree.tightest(size)
            if not found:
                if size > capacity or bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            take = min(count - rank, found[0] // size)
            out.append((size, rank, found[1]))
            rank += take
            tree.add(found[0] - take * size, found[1])
    return out


def even_bins(counts: dict[int, int], shards: int) -> list[tuple[int, int, int]]:
    """The runs of least capacity (to one part in 200,000 of the mean) that need no more than ``shards`` bins."""
    classes = sorted(counts.items(), reverse=True)
    if not classes:
        return []
    low = max(classes[0][0], -(-sum(s * n for s, n in classes) // shards))
    step = max(1, low // 200_000)
    tried = {0: best_fit_decreasing(classes, low, shards)}
    width = 0
    while tried[width] is None:
        width = max(step, 2 * width)
        tried[width] = best_fit_decreasing(classes, low + width, shards)
    bad, good = width // 2, width
    while width and good - bad > step:
        mid = (good + bad) // 2
        tried[mid] = best_fit_decreasing(classes, low + mid, shards)
        bad, good = (bad, mid) if tried[mid] is not None else (mid, good)
    return tried[good]


def _ranked(df: DataFrame, by: str) -> DataFrame:
    """``df`` with the part it is computed in and each row's rank among those of the part with the same ``by``.

    Ranks hold only where the result is written at once.
    """
    names = df.columns

    def run(it):
        own, seen = TaskContext.get().partitionId(), {}
        for batch in it:
            keys, which = np.unique(batch.column(by).to_numpy(), return_inverse=True)
            order = np.argsort(which, kind="stable")
            sizes = np.bincount(which, minlength=len(keys))
            nth = np.empty(len(which), np.int64)
            nth[order] = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            nth += np.array([seen.get(k, 0) for k in keys.tolist()], np.int64)[which] if len(keys) else 0
            for k, n in zip(keys.tolist(), sizes.tolist()):
                seen[k] = seen.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(which), own, np.int32)), pa.array(nth)], [*names, "part", "nth"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("part", IntegerType()), StructField("nth", LongType())]))


def _with_rank(ranked: DataFrame, by: str, name: str) -> DataFrame:
    """Ranks within ``by`` over all parts. Only sums for each part and value of ``by`` are ordered."""
    sums = ranked.groupBy("part", by).agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", by, F.coalesce(before, F.lit(0)).alias("before"))
    return ranked.join(sums, ["part", by]).withColumn(name, F.col("before") + F.col("nth")).drop("before", "nth", "part")


def _planned(groups: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(group, shard) of groups (group, bytes, rank)."""
    shared = groups.sparkSession.sparkContext.broadcast(np.array(sorted(plan), np.int64).reshape(-1, 3))

    def run(it):
        size, rank, shard = shared.value.T
        sizes, number = np.unique(size, return_inverse=True)
        keys = (number << 40) | rank
        for batch in it:
            own, nth = batch.column("bytes").to_numpy(), batch.column("rank").to_numpy()
            # Runs are in order of (size, rank): classes by number, ranks as the smaller part of one key.
            at = np.searchsorted(keys, (np.searchsorted(sizes, own) << 40) | nth, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(shard[at].astype(np.int32))], ["group", "shard"])

    return groups.mapInArrow(run, "group binary, shard int")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"))
    base = scratch.save(base, "rows")
    groups = scratch.save(_ranked(base.groupBy("group").agg(F.sum("size").alias("bytes")), "bytes"), "groups")
    counts = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow().to_pydict()
    plan = even_bins(dict(zip(counts["bytes"], counts["n"])), shards)
    owner = scratch.save(_planned(_with_rank(groups, "bytes", "rank").select("group", "bytes", "rank"), plan), "owners")
    placed = scratch.save(_ranked(base.join(owner, "group").drop("group"), "shard"), "placed")
    scratch.keep("placed")
    out = _with_rank(placed, "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

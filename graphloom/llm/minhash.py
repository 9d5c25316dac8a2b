"""Near-duplicate groups: MinHash bands for candidates, odd sketches to filter them, full sets to decide.

Sets that are equal collapse to one representative first. Within a band's bucket every set is paired with
the bucket's smallest id only; what that links falls into components. A second pass takes the buckets that
still hold several components, in blocks of bounded size (a bucket larger than a block is spread over block
pairs), so no candidate of a bucket is lost and no bucket meets in one task. Each block compares sketches
(a pair only in the first bucket that it shares) and names the sets that have a candidate in another component;
the full sets of these travel to the block and decide there. A block keeps its own union of components and
returns one link for each that it joins, so what leaves it grows with its sets and not with its pairs.

Odd input: null, empty or blank texts have an empty set and link with nothing; very long texts are one set of
all their shingles; rows that repeat a ``doc_id`` are one document with the links of all of them; rows without
a ``doc_id`` are left out of the groups and stay in :func:`drop_near_copies`; an empty table gives no rows; other
columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from ..plans import Scratch, bound_batches, shuffle_partitions
from .kernels import LANES, LOWER, U64, _odd, batches, mix, shingle_hashes, text_bytes, word_hashes


@dataclass(frozen=True)
class NearRule:
    """``percent``: least similarity. A pair that has just that misses all ``bands`` of ``rows`` samples with
    probability ``(1 - (percent / 100) ** rows) ** bands``: 3e-6 for 80 with 4 rows, 8e-7 for 85 with 5."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    sketch_bits: int = 1024
    block: int = 2048
    block_items: int = 1 << 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def loose(self) -> float:
        """Sketch estimates below this are rejected: about five standard deviations under the threshold."""
        j = self.percent / 100
        return j - 5.5 * (j * (1 - j) / self.samples) ** 0.5

    @property
    def most(self) -> int:
        """The largest XOR count of two sketches that may still be near: the estimate falls as the count grows."""
        counts = np.arange(self.sketch_bits // 2 + 1)
        return int(np.flatnonzero(estimate(counts, self.samples, self.sketch_bits) >= self.loose)[-1])


def _sets(batch: pa.RecordBatch, words: int):
    data, offsets = text_bytes(batch.column("text"))
    for a, b in batches(offsets):
        own = offsets[a : b + 1]
        hashes, bounds = word_hashes(LOWER[data[own[0] : own[-1]]], own - own[0])
        yield a, shingle_hashes(hashes, bounds, words)


def sketches_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of ``(n, samples)`` MinHash values: each sample toggles one bit."""
    n, k = values.shape
    spot = mix(values + LANES[40 : 40 + k] if k <= 200 else values + np.arange(k, dtype=U64) * LANES[40]) % U64(bits)
    flat = (np.arange(n, dtype=np.int64)[:, None] * bits + spot.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1)


def estimate(differing: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR."""
    share = np.minimum(2.0 * differing / bits, 1 - 1e-9)
    return 1 + bits / (4.0 * samples) * np.log(1 - share)


def signatures(docs: DataFrame, rule: NearRule) -> DataFrame:
    """doc_id, n_shingles, 128-bit set print, band keys and odd sketch of every text."""
    seeds, adds = _odd(41, rule.samples), _odd(42, rule.samples)
    lanes = rule.sketch_bits // 64

    def run(it):
        for batch in it:
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            prints = np.zeros((n, 2), U64)
            keys = np.zeros((n, rule.bands), U64)
            sketch = np.zeros((n, rule.sketch_bits // 8), np.uint8)
            for a, sets in _sets(batch, rule.words):
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                own = np.array(full) + a
                sizes = np.array([len(sets[i]) for i in full])
                heads = np.cumsum(sizes) - sizes
                flat = np.concatenate([sets[i] for i in full])
                count[own] = sizes
                prints[own, 0] = np.add.reduceat(mix(flat + LANES[4]), heads)
                prints[own, 1] = np.add.reduceat(mix(flat ^ LANES[5]), heads)
                least = np.empty((len(full), rule.samples), U64)
                for j in range(rule.samples):
                    least[:, j] = np.minimum.reduceat((flat ^ adds[j]) * seeds[j], heads)
                folded = np.zeros((len(full), rule.bands), U64)
                for j in range(rule.rows):
                    folded += least[:, j :: rule.rows] * LANES[60 + j]
                keys[own] = mix(folded + np.arange(rule.bands, dtype=U64) * LANES[6])
                sketch[own] = sketches_of(least, rule.sketch_bits)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(count), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * rule.bands + 1, rule.bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * lanes + 1, lanes, dtype=np.int32)), pa.array(sketch.view(np.int64).ravel())),
            ], ["doc_id", "n_shingles", "print_a", "print_b", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>, sketch array<bigint>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(it):
        for batch in it:
            out: list[np.ndarray] = []
            for _, sets in _sets(batch, words):
                out += sets
            sizes = np.array([0, *[len(s) for s in out]], np.int32)
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))], ["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, items array<bigint>")


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    bounds = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


class _Sets:
    """Full sets of a block, for counts of what one of them shares with others."""

    def __init__(self, column: pa.ChunkedArray):
        items, self.bounds = _ragged(column)
        self.sizes = np.diff(self.bounds)
        distinct, self.items = np.unique(items, return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def of(self, i: int) -> np.ndarray:
        return self.items[self.bounds[i] : self.bounds[i + 1]]

    def similar(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``others`` that are similar enough to ``i``."""
        self.mark[self.of(i)] = True
        if 4 * len(others) > len(self.sizes):
            both = np.add.reduceat(self.mark[self.items], self.bounds[:-1], dtype=np.int64)[others]
        else:
            both = np.array([np.count_nonzero(self.mark[self.of(j)]) for j in others.tolist()], np.int64)
        self.mark[self.of(i)] = False
        return others[100 * both >= percent * (self.sizes[i] + self.sizes[others] - both)]


def _pairs(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _confirmed(rule: NearRule):
    """Of rows (a, id, items), where ``a``'s own set is among its rows: the pairs (a, id) that are similar enough."""

    def run(table: pa.Table) -> pa.Table:
        a, ids = table["a"].to_numpy(), table["id"].to_numpy()
        sets = _Sets(table["items"])
        order = np.lexsort((ids != a, a))
        cuts = np.flatnonzero(np.diff(a[order])) + 1
        out: tuple[list, list] = ([], [])
        for group in np.split(order, cuts):
            hubs = np.count_nonzero(ids[group] == a[group])  # several where rows repeat an id
            for hub in group[:hubs].tolist():
                found = sets.similar(hub, group[hubs:], rule.percent)
                out[0].extend([ids[hub]] * len(found))
                out[1].extend(ids[found].tolist())
        return _pairs(*out)

    return run


def _near_rows(table: pa.Table, rule: NearRule):
    """(row, rows of other components that may be near), each pair of a block once and only in its first bucket."""
    component, side, n = (table[c].to_numpy() for c in ("component", "side", "n"))
    lanes = _ragged(table["sketch"])[0].view(U64).reshape(len(n), -1)
    bands = _ragged(table["bands"])[0].reshape(len(n), -1)[:, : table["band"][0].as_py()]
    diagonal = table["x"][0].as_py() == table["y"][0].as_py()
    _, own = np.unique(component, return_inverse=True)
    largest = np.bincount(own).argmax()
    at = np.arange(len(n))
    for i in np.flatnonzero(own != largest).tolist():
        maybe = (own != own[i]) & ((own == largest) | (at > i)) & (100 * np.minimum(n, n[i]) >= rule.percent * np.maximum(n, n[i]))
        others = np.flatnonzero(maybe if diagonal else maybe & (side != side[i]))
        if len(others):
            others = others[np.bitwise_count(lanes[others] ^ lanes[i]).sum(axis=1) <= rule.most]
            others = others[~(bands[others] == bands[i]).any(axis=1)]
            if len(others):
                yield i, others


def _with_candidates(rule: NearRule):
    def run(table: pa.Table) -> pa.Table:
        named = np.zeros(table.num_rows, bool)
        for i, others in _near_rows(table, rule):
            named[i] = True
            named[others] = True
        return table.select(BLOCK).filter(pa.array(named))

    return run


BLOCK = ["band", "key", "x", "y", "side", "id"]


def _joined(rule: NearRule):
    """Links of a block on full sets: one for each component that they join to another."""

    def run(table: pa.Table) -> pa.Table:
        ids, component = table["id"].to_numpy(), table["component"].to_numpy()
        sets = _Sets(table["items"])
        _, own = np.unique(component, return_inverse=True)
        label = np.arange(own.max() + 1)
        out: tuple[list, list] = ([], [])
        for i, others in _near_rows(table, rule):
            others = others[label[own[others]] != label[own[i]]]
            if len(others):
                for j in sets.similar(i, others, rule.percent).tolist():
                    if label[own[i]] != label[own[j]]:
                        out[0].append(ids[i])
                        out[1].append(ids[j])
                        label[label == label[own[j]]] = label[own[i]]
        return _pairs(*out)

    return run


def near_groups(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, a row for each doc_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.save(signatures(docs, rule), "signatures").where("doc_id is not null")
    same = ["print_a", "print_b", "n_shingles"]
    leads = scratch.save(sig.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("lead")), "leads")
    found = sig.select("doc_id", *same).join(leads, same, "left")
    # A lead is the least id of its set, so the least lead that a document reaches is the least id that it reaches.
    owners = scratch.save(found.groupBy("doc_id").agg(F.min("lead").alias("lead"), F.max("lead").alias("last"), F.max("n_shingles").alias("n_shingles")), "owners")
    split = owners.where("lead != last").select("doc_id", F.col("lead").alias("a"))
    links = found.join(split, "doc_id").where("lead != a").select("a", F.col("lead").alias("b"))

    members = sig.join(leads.withColumnRenamed("lead", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id", "print_a"])
    members = scratch.save(members.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch"), "members")
    rows = members.select("id", "n", F.posexplode("bands").alias("band", "key"))
    tops = scratch.save(rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").drop("z"), "tops")
    rows = scratch.save(rows.join(tops, "key"), "shared")
    wanted = rows.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.save(_full_sets(docs.join(wanted, "doc_id", "left_semi"), rule.words).withColumnRenamed("doc_id", "id"), "sets")
    spokes = scratch.save(_sketch_filter(rows.where("id != a").select("a", F.col("id").alias("b")).distinct(), members, rule), "spokes")
    links = scratch.save(links.unionByName(_spoke_links(spokes, sets, rule)), "links")
    comp = scratch.save(component_labels(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")

    placed = scratch.save(rows.drop("a").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    pieces = F.greatest(F.ceil(F.count("*") / rule.block), F.ceil(F.sum("n") / rule.block_items)).cast("int")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), pieces.alias("blocks")).where("lo != hi")
    mixed = scratch.save(mixed.select("key", "blocks"), "mixed")
    spread = placed.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "component")
    # By number, so that small but slow blocks are not put together by their bytes.
    dealt = lambda df: df.repartition(shuffle_partitions(spark), "key", "x", "y").groupBy("key", "x", "y")
    blocks = spread.join(members, "id")
    named = scratch.save(dealt(blocks).applyInArrow(_with_candidates(rule), "band int, key bigint, x int, y int, side int, id bigint"), "named")
    own = members.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    decided = dealt(named.join(own, "id").join(sets, "id")).applyInArrow(_joined(rule), "a bigint, b bigint")
    late = scratch.save(decided, "late")
    # Late links join whole components, so only these are labelled anew.
    label = comp.withColumnRenamed("component", "c")
    ends = late.join(label.select(F.col("id").alias("a"), F.col("c").alias("src")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("c").alias("dst")), "b", "left")
    again = component_labels(scratch.save(ends.select(F.coalesce("src", "a").alias("src"), F.coalesce("dst", "b").alias("dst")), "joins"))
    scratch.keep("owners", "components", "joins")
    out = owners.join(comp.select(F.col("id").alias("lead"), "component"), "lead", "left").withColumn("component", F.coalesce("component", "lead", "doc_id"))
    out = out.join(again.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").withColumn("component_id", F.coalesce("whole", "component"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))


def _spoke_links(spokes: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """Those of ``spokes(a, b, n)`` that the full sets confirm; ``n``: shingles of ``b``. A bucket's first set meets its partners in parts of bounded size."""
    share = max(1, rule.block_items // 4)
    total = spokes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // share))
    many = spokes.groupBy("a").agg(F.ceil(F.sum("n") / share).cast("int").alias("pieces"))
    salted = spokes.select("a", F.col("b").alias("id")).join(many, "a").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    hubs = many.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("a", F.col("a").alias("id"), "piece")
    both = salted.unionByName(hubs).withColumn("part", F.pmod(F.xxhash64("a", "piece"), F.lit(parts)))
    return both.join(sets, "id").groupBy("part").applyInArrow(_confirmed(rule), "a bigint, b bigint")


def _sketch_filter(pairs: DataFrame, members: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs (a, b) whose sketches agree well enough, with b's shingles ``n``, by the population count of their XOR on the JVM."""
    lanes = members.select("id", "n", "sketch")
    both = pairs.join(lanes.select(F.col("id").alias("a"), F.col("sketch").alias("p"), F.col("n").alias("m")), "a").join(lanes.select(F.col("id").alias("b"), F.col("sketch").alias("q"), "n"), "b")
    differing = sum((F.bit_count(F.get("p", F.lit(i)).bitwiseXOR(F.get("q", F.lit(i)))) for i in range(rule.sketch_bits // 64)), F.lit(0))
    return both.where((100 * F.least("m", "n") >= rule.percent * F.greatest("m", "n")) & (differing <= rule.most)).select("a", "b", "n")


def drop_near_copies(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """``docs`` with the first document of each group; rows without a ``doc_id`` stay."""
    gone = Scratch(docs.sparkSession, "near-out").save(near_groups(docs, rule).where("not kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

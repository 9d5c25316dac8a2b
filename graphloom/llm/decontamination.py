"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are runs of letters, digits and combining marks, lower-cased. An item's ``LEAST_TILE``-word
runs have Karp-Rabin hashes; a text keeps the places of its runs that may be some item's (told by a bit table whose
size is bounded). Texts and items are joined on seeds: a leak needs ``COVERAGE`` of the item's words in tiles, so at
least ``need`` of its runs, and each item seeds with all but its ``need - 1`` runs that most texts have, hence no leak
is missed and a phrase that many texts and items share does not pair them all. Each pair is then tiled: the longest
common run of words that no tile covers yet is marked again and again, so passages in another order count in
full. A text leaks an item when tiles cover ``COVERAGE`` of its words.

A pair is tiled by itself, from diagonal runs that are gathered in bounded steps, so a text that repeats one word
or phrase costs memory in proportion to its length. Neither table is collected.

Odd input: null or empty texts and items match nothing; items shorter than a tile are sought as a whole; very long
texts are judged whole; repeated items and documents are judged row by row; empty tables give no rows; other columns,
whatever their names, are ignored or kept.
"""

from __future__ import annotations

import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import Scratch, bound_batches
from .kernels import LANES, U64, batches, mix, text_bytes, word_hashes

LEAST_TILE = 5
COVERAGE = 0.6
#: Bits of the table that tells which runs may be an item's: at least 16 for each run, within these powers of two.
BITS = (22, 27)
#: Matches that are held at once while a pair's diagonal runs are gathered.
STEP = 1 << 20
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def folded(text: str | None) -> str:
    """Lower-cased, with a blank for every mark beyond ASCII that is no letter, digit or combining mark."""
    low = (text or "").lower()
    if low.isascii():
        return low
    marks = {ord(c): " " for c in set(low) if c > "\x7f" and unicodedata.category(c)[0] not in "LNM"}
    return low.translate(marks) if marks else low


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    h = np.zeros(max(n, 0), U64)
    for j in range(width if n > 0 else 0):
        h += words[j : j + n] * LANES[100 + j]
    return mix(h + U64(width))


def diagonals(text: np.ndarray, places: np.ndarray, item: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal diagonal runs (place in text, in item, matches) of equal hashes at ``places`` of a text and in an item."""
    order = np.lexsort((places, text))
    text, places = text[order], places[order]
    first, last = np.searchsorted(text, item, "left"), np.searchsorted(text, item, "right")
    ends = np.cumsum(last - first)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(item):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
        n = (last - first)[a:b]
        q = np.repeat(np.arange(a, b), n)
        p = places[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)].astype(np.int64)
        parts.append(_merged(p, q, np.ones(len(q), np.int64)))
        a = b
    return _merged(*(np.concatenate(x) for x in zip(*parts)))


def _merged(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs joined where one goes on along the diagonal of another."""
    order = np.lexsort((q, p - q))
    p, q, n = p[order], q[order], n[order]
    heads = np.flatnonzero(np.append(True, (np.diff(p - q) != 0) | (q[1:] != q[:-1] + n[:-1]))) if len(p) else np.zeros(0, np.int64)
    return p[heads], q[heads], np.add.reduceat(n, heads) if len(p) else n


def tiles(p: np.ndarray, q: np.ndarray, lengths: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from maximal common runs: (place in text, in item, words), longest first, ties by place."""
    queue = [(-n, a, b) for n, a, b in zip(lengths.tolist(), p.tolist(), q.tolist())]
    heapq.heapify(queue)
    in_text = np.zeros(max((a - n for n, a, _ in queue), default=0), bool)
    in_item = np.zeros(max((b - n for n, _, b in queue), default=0), bool)
    out, left = [], len(in_item)
    while queue and left >= width:
        n, a, b = heapq.heappop(queue)
        taken = in_text[a : a - n] | in_item[b : b - n]
        if not taken.any():
            out.append((a, b, -n))
            in_text[a : a - n] = in_item[b : b - n] = True
            left += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for start, stop in edges.reshape(-1, 2).tolist():
            if stop - start >= width:
                heapq.heappush(queue, (start - stop, a + start, b + start))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, width, grams) of every item with words; ``item`` numbers the rows."""

    def run(it):
        number = TaskContext.get().partitionId() << 33
        for batch in it:
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                raw = np.frombuffer(folded(text).encode(), np.uint8)
                words, _ = word_hashes(raw, np.array([0, len(raw)]), BREAKS)
                if len(words):
                    width = min(LEAST_TILE, len(words))
                    rows.append((number, item_id, len(words), width, _runs(words, width).view(np.int64)))
                    number += 1
            yield pa.RecordBatch.from_pydict(dict(zip(ITEM_NAMES, zip(*rows) if rows else [[]] * 5)), schema=ITEM)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item bigint, item_id bigint, words bigint, width int, grams array<bigint>")


ITEM_NAMES = ["item", "item_id", "words", "width", "grams"]
ITEM = pa.schema(list(zip(ITEM_NAMES, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))))


def _bits(grams: DataFrame) -> np.ndarray:
    """The bit table of all grams; put together by words of 64 bits, so what is collected is bounded by ``BITS``."""
    size = 1 << min(BITS[1], max(BITS[0], (16 * grams.count()).bit_length()))
    spot = F.col("gram").bitwiseAND(size - 1)
    words = grams.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(U64)


def _held(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(text, doc_id, grams, places) of every text with a run that may be an item's; ``text`` numbers them."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(it):
        bits, number = shared.value, TaskContext.get().partitionId() << 33
        last = U64(len(bits) * 64 - 1)
        for batch in it:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = text_bytes(pa.array([folded(t) for t in batch.column("text").to_pylist()], pa.large_string()))
            for a, b in batches(offsets):
                own = offsets[a : b + 1]
                words, bounds = word_hashes(data[own[0] : own[-1]], own - own[0], BREAKS)
                found = []
                for width in widths:
                    h = _runs(words, width)
                    spot = h & last
                    at = np.flatnonzero((bits[(spot >> U64(6)).astype(np.int64)] >> (spot & U64(63))) & U64(1))
                    text = np.searchsorted(bounds, at, "right") - 1
                    whole = at + width <= bounds[text + 1]
                    at, text = at[whole], text[whole]
                    found.append((text, h[at], at - bounds[text]))
                text, h, at = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(text, kind="stable")
                text, h, at = text[order], h[order], at[order]
                heads = np.flatnonzero(np.append(True, np.diff(text) != 0)) if len(text) else np.zeros(0, np.int64)
                cuts = pa.array(np.append(heads, len(text)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(len(heads))), pa.array([ids[a + t] for t in text[heads].tolist()], pa.int64()),
                    pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))),
                ], ["text", "doc_id", "grams", "places"])
                number += len(heads)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "text bigint, doc_id bigint, grams array<bigint>, places array<int>")


def _tiled(coverage: float):
    def run(it):
        for batch in it:
            rows = []
            get = {n: batch.column(n) for n in batch.schema.names}
            for doc_id, item_id, words, width, grams, own, places in zip(*(get[n].to_pylist() for n in ("doc_id", "item_id", "words", "width")), get["grams"], get["own"], get["places"]):
                item, text, at = (np.asarray(x.values) for x in (grams, own, places))
                p, q, n = diagonals(text, at, item)
                could = np.zeros(words + 1, np.int64)
                np.add.at(could, q, 1)
                np.add.at(could, q + n + width - 1, -1)
                if np.count_nonzero(np.cumsum(could)[:-1]) < coverage * words:
                    continue
                found = tiles(p, q, n + width - 1, width)
                share = sum(x for *_, x in found) / words
                if share >= coverage:
                    rows.append((doc_id, item_id, share, words, len(found), min(x for x, *_ in found)))
            yield pa.RecordBatch.from_pydict(dict(zip(LEAK.names, zip(*rows) if rows else [[]] * 6)), schema=LEAK)

    return run


LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("item_words", pa.int64()), ("tiles", pa.int64()), ("first_word", pa.int64())])


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "leaks")
    items = scratch.save(_items(benchmark.where("text is not null")), "items")
    grams = items.select("item", "words", "width", F.explode("grams").alias("gram"))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    held = scratch.save(_held(docs, _bits(grams), widths or [LEAST_TILE]), "held")
    seen = held.select("text", F.explode(F.array_distinct("grams")).alias("gram"))
    # What a leak must cover takes at least this many runs, one for each tile of the least length.
    need = F.ceil(F.ceil(F.col("words") * coverage - 1e-9) / F.col("width"))
    common = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "gram"))
    seeds = grams.join(seen.groupBy("gram").agg(F.count("*").alias("n")), "gram").withColumn("common", common)
    seeds = seeds.where(F.col("common") >= need).select("gram", "item").distinct()
    pairs = seen.join(scratch.save(seeds, "seeds"), "gram").select("text", "item").distinct()
    both = scratch.save(pairs, "pairs").join(items, "item").join(held.withColumnRenamed("grams", "own"), "text")
    return both.select("doc_id", "item_id", "words", "width", "grams", "own", "places").mapInArrow(_tiled(coverage), "doc_id bigint, item_id bigint, coverage double, item_words bigint, tiles bigint, first_word bigint")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without documents that leak an item (rows that share a leaking row's id go with it)."""
    gone = Scratch(docs.sparkSession, "leaking").save(leaks(docs.where("doc_id is not null"), benchmark, coverage).select("doc_id").distinct(), "ids")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Document fingerprints by winnowing.

Hashes of all ``gram``-byte substrings; from every window of ``window`` consecutive ones the least is
selected, the rightmost of ties, so any two texts that share ``gram + window - 1`` bytes share a selected
hash. A fingerprint is the selected (hash, position) pairs in order of position, 16 hex digits each; its
hashes are 32 bits, positions count bytes of the UTF-8 text.

Odd input: null texts count as empty and have an empty fingerprint; a text shorter than a gram is one gram, a
text with fewer grams than a window is one window. Two empty fingerprints are alike (1.0), an empty and another
one are not (0.0). Rows that repeat a ``doc_id`` follow each other by text; rows without one come last; a very long
text is selected from in pieces that overlap by a window, with the same result; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bound_batches, shuffle_partitions
from .kernels import U64, rolling_hashes, window_minima

GRAM = 20
WINDOW = 40
LONG = 1 << 22


def _selected(data: np.ndarray, starts: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, text) of the grams that winnowing selects in concatenated texts of whole windows."""
    h = rolling_hashes(data, gram)
    at = window_minima(h, window)
    bounds = np.append(starts, len(data))
    owner = np.repeat(np.arange(len(starts)), np.diff(bounds))
    reach = gram + window - 1
    at = at[owner[: len(at)] == owner[reach - 1 :]]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    own = owner[at]
    return at - starts[own], (h[at] >> U64(32)).astype(np.uint32), own


def winnow(texts: list[bytes], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) for each text."""
    reach = gram + window - 1
    out: list = [None] * len(texts)
    group, size = [], 0

    def flush():
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        lengths = np.array([len(texts[i]) for i in group])
        pos, h, own = _selected(data, np.cumsum(lengths) - lengths, gram, window)
        cuts = np.searchsorted(own, np.arange(1, len(group)))
        for i, p, v in zip(group, np.split(pos, cuts), np.split(h, cuts)):
            out[i] = (p.astype(np.uint32), v)

    for i, t in enumerate(texts):
        if len(t) < reach:
            h = rolling_hashes(np.frombuffer(t, np.uint8), gram)
            if len(h):
                k = len(h) - 1 - int(np.argmin(h[::-1] >> U64(24)))
                out[i] = (np.array([k], np.uint32), (h[[k]] >> U64(32)).astype(np.uint32))
            else:
                whole = int.from_bytes(hashlib.blake2b(t, digest_size=4).digest(), "big")
                out[i] = (np.zeros(min(1, len(t)), np.uint32), np.full(min(1, len(t)), whole, np.uint32))
        elif len(t) > LONG:
            parts = [winnow([t[a : a + LONG]], gram, window)[0] for a in range(0, len(t) - reach + 1, LONG - reach + 1)]
            shift = [np.uint32(k * (LONG - reach + 1)) for k in range(len(parts))]
            pos, first = np.unique(np.concatenate([p + s for (p, _), s in zip(parts, shift)]), return_index=True)
            out[i] = (pos, np.concatenate([h for _, h in parts])[first])
        else:
            group.append(i)
            size += len(t)
            if size > 1 << 18:
                flush()
                group, size = [], 0
    if group:
        flush()
    return out


def encoded(print_: tuple[np.ndarray, np.ndarray]) -> str:
    pos, h = print_
    return np.stack([h, pos], 1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of either that both have."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(it):
        for batch in it:
            prints = winnow([(t or "").encode() for t in batch.column("text").to_pylist()], gram, window)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encoded(p) for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def with_successor(docs: DataFrame) -> DataFrame:
    """Rows in order inside buckets of neighbouring ids, each bucket closed by its last row's successor as a guest.

    The order is by descending ``doc_id``; after the last row comes the first. There are twice as many buckets
    as shuffle partitions, however large the table is; their bounds are quantiles of ``doc_id``, and only each
    bucket's largest id meets the driver. Each bucket is a partition of its own, sorted (and spilled) by Spark and
    never held as a whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rank = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rank", rank).withColumn("at", F.col("rank").cast("double"))
    n = 2 * shuffle_partitions(spark)
    cuts = sorted(set(docs.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n))))
    docs = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket").transform(docs) if cuts else docs.withColumn("bucket", F.lit(0.0))
    docs = docs.withColumn("bucket", F.col("bucket").cast("int")).drop("at")
    tops = sorted((r["bucket"], r["top"]) for r in docs.groupBy("bucket").agg(F.max("rank").alias("top")).collect())
    above = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    targets = spark.createDataFrame(above, "rank long, target int")
    sent = docs.join(F.broadcast(targets), "rank", "left")
    both = F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("guest")))
    out = sent.select("doc_id", "rank", "text", F.explode(F.filter(both, lambda x: x["bucket"].isNotNull())).alias("to")).select("doc_id", "rank", "text", "to.bucket", "to.guest")
    return out.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("rank"), "text")


def compared_with_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of the text whose last third the next document's start replaces."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(it):
        held: tuple = ()  # the row whose successor has not come yet: bucket, guest, doc_id, text, fingerprint
        for batch in it:
            cols = [batch.column(n).to_pylist() for n in ("bucket", "guest", "doc_id", "text")]
            prints = winnow([t.encode() for t in cols[3]], gram, window)
            rows = [*([held] if held else []), *zip(*cols, prints)]
            # A guest has no result here, and a row's successor is the next row, the first guest at the latest.
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
            edited = [(a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3]).encode() for a, b in pairs]
            changed = winnow(edited, gram, window)
            held = rows[-1] if rows else ()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                [a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], [hashlib.sha256(e).hexdigest() for e in edited],
                [encoded(a[4]) for a, _ in pairs], [encoded(c) for c in changed],
                [likeness(a[4][1], c[1]) for (a, _), c in zip(pairs, changed)], [likeness(a[4][1], b[4][1]) for a, b in pairs],
            ), schema)], schema=schema)

    return with_successor(docs).select("bucket", "guest", "doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

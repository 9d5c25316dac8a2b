"""Exact removal of byte strings that occur earlier, by bucket-pointer refinement.

Every 100-byte string is owned by one *anchor*: the least 32-byte gram in it (rightmost of ties), so
equal strings meet under equal grams and only about 3 % of all positions leave their block. A key's
occurrences are reduced to at most two distinct contexts per block before the shuffle, hence a passage
that a third of all texts share costs one record per block. Where one key has different contexts, their
strings are classed by bucket-pointer refinement (:func:`refine_buckets`): eight-byte buckets first, then
sorting on the bucket identifiers found 8, 16, 32 and 36 bytes on, each pass reusing the identifiers that
the last one updated. The contexts of a key meet in one task for that, unless the key is hot (over
``HOT_CONTEXTS``): then each block refines its own, and only the first member of every local class goes on,
spread by a 128-bit fingerprint of the string itself.

Results for odd input: null or short texts lose nothing; rows with one ``doc_id`` count as one document,
equal strings at equal starts of such rows both stay; a null ``doc_id`` ranks after all others; a very long text
is hashed in pieces that overlap by a string less a byte, so nothing at a border is missed; an empty table gives no
rows; other columns, whatever their names, are ignored by :func:`repeated_spans` and kept by :func:`drop_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import bound_batches, shuffle_partitions
from .kernels import LANES, U64, gram_hashes, mix, pack, text_bytes, unpack, window_minima

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 16 << 20
SEGMENT = 1 << 18
HOT_CONTEXTS = 64
LAST_ID = np.iinfo(np.int64).max


def refine_buckets(data: np.ndarray, positions: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A class number for each position; equal numbers mean equal ``length``-byte strings.

    Buckets of eight-byte grams are refined by the bucket identifiers of later offsets. A pass sorts only
    members of buckets that hold several suffixes, and reads identifiers that earlier passes updated.
    """
    n = len(data) - 7
    ids = np.zeros(len(data), np.int64)
    grams = np.zeros(n, U64)
    for j in range(8):
        grams = (grams << U64(8)) | data[j : j + n].astype(U64)
    _, first, counts = np.unique(grams, return_inverse=True, return_counts=True)
    ids[:n] = (np.cumsum(counts) - counts)[first]
    active = np.flatnonzero(counts[first] > 1)
    depth = 8
    while depth < length and len(active):
        shift = min(depth, length - depth)
        active = active[active + shift < len(data)]
        own, later = ids[active], ids[active + shift]
        order = np.lexsort((later, own))
        own, later, active = own[order], later[order], active[order]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (later[1:] != later[:-1])
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(own)))
        bucket = np.ones(len(own), bool)
        bucket[1:] = own[1:] != own[:-1]
        start = np.maximum.accumulate(np.where(bucket, np.arange(len(own)), 0))
        ids[active] = own + np.repeat(heads - start[heads], sizes)
        active = active[np.repeat(sizes, sizes) > 1]
        depth += shift
    return ids[positions]


def _segments(offsets: np.ndarray, length: int):
    """(row, first byte, end byte): whole texts, long ones in pieces that overlap by ``length - 1``."""
    group, size = [], 0
    for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[row]), int(offsets[row + 1])
        while b - a > 4 * SEGMENT:
            yield [(row, a, a + 4 * SEGMENT)]
            a += 4 * SEGMENT - length + 1
        group.append((row, a, b))
        size += b - a
        if size >= SEGMENT:
            yield group
            group, size = [], 0
    if group:
        yield group


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """key, context, row, first and last window start (in the text) of every anchor."""
    out = [[], [], [], [], []]
    width = length - GRAM + 1
    for group in _segments(offsets, length):
        buf = np.concatenate([data[a:b] for _, a, b in group]) if len(group) > 1 else data[group[0][1] : group[0][2]]
        sizes = np.array([b - a for _, a, b in group])
        owner = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
        grams = gram_hashes(buf, GRAM)
        at = window_minima(grams, width)
        whole = owner[: len(at)] == owner[length - 1 :]
        new, end = whole.copy(), whole.copy()
        same = (at[1:] == at[:-1]) & whole[1:] & whole[:-1]
        new[1:] &= ~same
        end[:-1] &= ~same
        lo, hi = np.flatnonzero(new), np.flatnonzero(end)
        a = at[lo]
        h64 = lambda p: mix(grams[p] * LANES[20] + grams[p + 32])
        tail = length - 64
        context = mix(h64(lo) * LANES[21] + h64((lo + hi + tail) // 2) * LANES[22] + h64(hi + tail) * LANES[23] + (hi - lo).astype(U64) * LANES[24] + (a - lo).astype(U64) * LANES[25])
        member = owner[lo]
        begin = np.cumsum(sizes) - sizes
        shift = np.array([g[1] - offsets[g[0]] for g in group]) - begin
        for o, v in zip(out, (grams[a], context, np.array([g[0] for g in group])[member].astype(np.uint32), (lo + shift[member]).astype(np.uint32), (hi + shift[member]).astype(np.uint32))):
            o.append(v)
    kinds = (U64, U64, np.uint32, np.uint32, np.uint32)
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds)]


def _block(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The block's rows in an order that does not depend on the shuffle, and their texts."""
    ids = table["doc_id"].fill_null(LAST_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        texts = table["text"].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] is not None, texts[i] or "")))
    table = table.take(pa.array(order))
    data, offsets = text_bytes(table["text"])
    return table, ids[order], data, offsets


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(sorted_columns[0]), bool)
    if len(fresh):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return fresh


def _leaders(fresh: np.ndarray) -> np.ndarray:
    """For sorted rows: the index of the first row of each row's group."""
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


KEYS = (U64, U64, np.int64, np.uint32, np.uint8)
CONTEXT = (np.int64, np.uint32, np.uint32, np.uint32)
REPLY = (U64, U64, np.uint8)
CLASS = (U64, U64, np.int64, np.uint32, np.uint32)
RANGE = (np.uint32, np.uint32, np.uint32)
ROUTED = "part int, block int, kind int, blob binary"


def _routed(part: np.ndarray, kind: int, block: int, columns: tuple) -> list[tuple]:
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    columns = [np.split(c[order], cuts) for c in columns]
    heads = part[np.append(0, cuts)].tolist()
    return [(p, block, kind, pack(*c)) for p, c in zip(heads, zip(*columns))]


def _table(rows: list[tuple]) -> pa.Table:
    part, block, kind, blob = zip(*rows) if rows else ((),) * 4
    return pa.table({"part": pa.array(part, pa.int32()), "block": pa.array(block, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _send_keys(parts: int, length: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, ids, data, offsets = _block(table)
        key, context, row, lo, _ = _anchors(data, offsets, length)
        doc = ids[row]
        order = np.lexsort((lo, doc, context, key))
        key, context, doc, lo = key[order], context[order], doc[order], lo[order]
        first = _heads(key, context)
        key, context, doc, lo = key[first], context[first], doc[first], lo[first]
        own = _leaders(_heads(key))
        many = (np.bincount(own, minlength=len(own))[own] > hot // 4).astype(np.uint8)
        keep = np.arange(len(key)) - own < 2
        return _table(_routed((key[keep] % U64(parts)).astype(np.int32), 0, block, tuple(c[keep] for c in (key, context, doc, lo, many))))

    return run


def _meet_keys(hot: int):
    return lambda table: _met_keys(table, hot)


def _met_keys(table: pa.Table, most: int) -> pa.Table:
    blobs, blocks = table["blob"].to_pylist(), table["block"].to_numpy()
    block = np.repeat(blocks, [int.from_bytes(b[:8], "little") for b in blobs])
    columns = unpack(blobs, KEYS)
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    key, context, doc, lo, many = (c[order] for c in columns)
    block = block[order]
    lead = _leaders(_heads(key, context))
    later = (doc > doc[lead]) | (lo > lo[lead])
    by_key = _leaders(_heads(key))
    groups, sizes = np.unique(by_key, return_counts=True)
    last = groups + sizes - 1
    several = np.repeat(context[groups] != context[last], sizes)
    hot = np.repeat((sizes > most) | (np.add.reduceat(many, groups, dtype=np.int64) > 0 if len(groups) else sizes > 0), sizes)
    code = later.astype(np.uint8) | (several.astype(np.uint8) << np.uint8(1)) | ((several & hot).astype(np.uint8) << np.uint8(2))
    said = code > 0
    return _table([(p, p, 0, b) for p, _, _, b in _routed(block[said], 0, 0, (key[said], context[said], code[said]))])


def _settle(parts: int, length: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        block = table["block"][0].as_py()
        _, ids, data, offsets = _block(table)
        key, context, row, lo, hi = _anchors(data, offsets, length)
        doc = ids[row]
        order = np.lexsort((lo, doc, context, key))
        key, context, row, lo, hi, doc = (c[order] for c in (key, context, row, lo, hi, doc))
        lead = _leaders(_heads(key, context))
        gone = (doc > doc[lead]) | (lo > lo[lead])
        k, c, code = unpack(replies["blob"].to_pylist(), REPLY)
        spread, hot = np.isin(key, k[code >= 2]), np.isin(key, k[code >= 4])
        again = code[(code & 1) > 0], k[(code & 1) > 0], c[(code & 1) > 0]
        gone |= np.isin(mix(key * LANES[30] + context), mix(again[1] * LANES[30] + again[2]))
        out = _routed(np.full(int(gone.sum()), block % parts, np.int32), 0, block, (row[gone], lo[gone], hi[gone]))
        out += _classes(np.flatnonzero(hot & ~gone), data, offsets, row, lo, hi, doc, length, parts, block)
        sent = np.flatnonzero(spread & ~hot & ~gone)
        sent = sent[np.argsort(key[sent] % U64(parts), kind="stable")]
        part = (key[sent] % U64(parts)).astype(np.int32)
        for own in np.split(sent, np.flatnonzero(np.diff(part)) + 1) if len(sent) else []:
            head = pack(doc[own], row[own], lo[own], hi[own])
            out.append((int(key[own[0]] % U64(parts)), block, 2, head + _contexts(own, data, offsets, row, lo, hi, length)[0].tobytes()))
        return _table(out)

    return run


def _contexts(chosen, data, offsets, row, lo, hi, length):
    """The bytes of the chosen anchors' contexts, with each byte's anchor and place in its context."""
    sizes = (hi[chosen] - lo[chosen]).astype(np.int64) + length
    begin = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(chosen)), sizes)
    within = np.arange(int(sizes.sum())) - begin[own]
    return data[(offsets[row[chosen]] + lo[chosen])[own] + within], own, within, sizes


def _classes(chosen, data, offsets, row, lo, hi, doc, length, parts, block) -> list[tuple]:
    """Local classes of the strings in the chosen anchors' contexts: later members go, first ones are sent on."""
    if not len(chosen):
        return []
    raw, own, within, sizes = _contexts(chosen, data, offsets, row, lo, hi, length)
    buf = np.append(raw, np.zeros(length, np.uint8))
    starts = np.flatnonzero(within <= (sizes - length)[own])
    classes = refine_buckets(buf, starts, length)
    own, within = own[starts], within[starts].astype(np.uint32)
    r, p, d = row[chosen][own], lo[chosen][own] + within, doc[chosen][own]
    order = np.lexsort((p, d, classes))
    classes, r, p, d, starts = classes[order], r[order], p[order], d[order], starts[order]
    fresh = _heads(classes)
    lead = _leaders(fresh)
    later = (d > d[lead]) | (p > p[lead])
    out = _routed(np.full(int(later.sum()), block % parts, np.int32), 0, block, (r[later], p[later], p[later]))
    keep = ~later
    starts, r, p, d = starts[keep], r[keep], p[keep], d[keep]
    prints = []
    for family in (0, 1):
        h = gram_hashes(buf, 64, family)
        prints.append(mix(h[starts] * LANES[26 + family] + h[starts + length - 64]))
    return out + _routed((prints[1] % U64(parts)).astype(np.int32), 1, block, (*prints, d, r, p))


def _meet_classes(length: int):
    return lambda table: _met_classes(table, length)


def _met_classes(table: pa.Table, length: int) -> pa.Table:
    kind = table["kind"].to_numpy()
    done = table.filter(pa.array(kind == 0))
    sent = table.filter(pa.array(kind == 1))
    out = [(b, b, 0, v) for b, v in zip(done["block"].to_pylist(), done["blob"].to_pylist())]
    blobs = sent["blob"].to_pylist()
    if blobs:
        block = np.repeat(sent["block"].to_numpy(), [int.from_bytes(b[:8], "little") for b in blobs])
        one, two, doc, row, pos = unpack(blobs, CLASS)
        order = np.lexsort((pos, doc, two, one))
        one, two, doc, row, pos, block = (c[order] for c in (one, two, doc, row, pos, block))
        lead = _leaders(_heads(one, two))
        later = (doc > doc[lead]) | (pos > pos[lead])
        out += [(p, p, 0, b) for p, _, _, b in _routed(block[later], 0, 0, (row[later], pos[later], pos[later]))]
    return _table(out + _refined(table.filter(pa.array(kind == 2)), length))


def _refined(sent: pa.Table, length: int) -> list[tuple]:
    """Strings of contexts of one part's keys that occur earlier in another of these contexts."""
    blobs = sent["blob"].to_pylist()
    if not blobs:
        return []
    counts = [int.from_bytes(b[:8], "little") for b in blobs]
    block = np.repeat(sent["block"].to_numpy(), counts)
    doc, row, lo, hi = unpack(blobs, CONTEXT)
    width = sum(np.dtype(k).itemsize for k in CONTEXT)
    buf = np.frombuffer(b"".join([*(b[8 + n * width :] for b, n in zip(blobs, counts)), bytes(length)]), np.uint8)
    sizes = (hi - lo).astype(np.int64) + length
    own = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(own)) - (np.cumsum(sizes) - sizes)[own]
    starts = np.flatnonzero(within <= (sizes - length)[own])
    classes = refine_buckets(buf, starts, length)
    own, pos = own[starts], lo[own[starts]] + within[starts].astype(np.uint32)
    order = np.lexsort((pos, doc[own], classes))
    classes, own, pos = classes[order], own[order], pos[order]
    lead = _leaders(_heads(classes))
    d = doc[own]
    later = (d > d[lead]) | (pos > pos[lead])
    own, pos = own[later], pos[later]
    return [(p, p, 0, b) for p, _, _, b in _routed(block[own], 0, 0, (row[own], pos, pos))]


def _runs(row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Maximal runs per row of intervals that overlap or touch."""
    order = np.lexsort((lo, row))
    row, lo, end = row[order].astype(np.int64), lo[order].astype(np.int64), end[order].astype(np.int64)
    span = int(end.max()) + 2 if len(end) else 1
    reach = np.maximum.accumulate(row * span + end)
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] * span + lo[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    stops = np.append(heads[1:], len(row)) - 1 if len(heads) else heads
    return [row[heads], lo[heads], reach[stops] - row[heads] * span]


def _finish(length: int, shape):
    def run(table: pa.Table, flagged: pa.Table) -> pa.Table:
        if not table.num_rows:
            return shape(table, [], [])
        table, _, data, offsets = _block(table)
        row, lo, hi = unpack(flagged["blob"].to_pylist(), RANGE)
        runs = _runs(row, lo, hi.astype(np.int64) + length)
        bounds = np.searchsorted(runs[0], np.arange(table.num_rows + 1))
        kept, spans = [], []
        raw = data.tobytes()
        for i in range(table.num_rows):
            a, b = int(offsets[i]), int(offsets[i + 1])
            own = [(int(s), int(e)) for s, e in zip(runs[1][bounds[i] : bounds[i + 1]], runs[2][bounds[i] : bounds[i + 1]])]
            at, left = a, []
            for s, e in own:
                left.append(raw[at : a + s])
                at = a + e
            left.append(raw[at:b])
            kept.append(b"".join(left))
            spans.append(own)
        return shape(table, kept, spans)

    return run


def _counts(total: int, least: int) -> tuple[int, int]:
    """Blocks of texts and parts of keys. A pass sends a record from each block to each part and one back, so their product
    bounds the records, whatever the texts hold; a few blocks for each task would square that for small tables."""
    return max(2 * least, -(-total // BLOCK_BYTES)), max(least, -(-total // (BLOCK_BYTES // 4)))


def _over_blocks(docs: DataFrame, length: int, shape, schema: str, hot: int) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = shuffle_partitions(spark)
    n_blocks, parts = _counts(total, least)
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    keys = blocks.groupBy("block").applyInArrow(_send_keys(parts, length, hot), ROUTED)
    replies = keys.groupBy("part").applyInArrow(_meet_keys(hot), ROUTED)
    settled = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_settle(parts, length), ROUTED)
    flagged = settled.groupBy("part").applyInArrow(_meet_classes(length), ROUTED)
    return blocks.groupBy("block").cogroup(flagged.groupBy("block")).applyInArrow(_finish(length, shape), schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs of each row (needs doc_id, text).

    ``hot``: contexts beyond which a key is settled by fingerprints of its strings in many tasks; results are the same.
    """

    def shape(table, kept, spans):
        sizes = [sum(e - s for s, e in own) for own in spans]
        return pa.table({
            "doc_id": pa.array(table["doc_id"].to_pylist() if kept else [], pa.int64()),
            "n_bytes": pa.array([len(k) + n for k, n in zip(kept, sizes)], pa.int64()),
            "n_removed": pa.array(sizes, pa.int64()),
            "n_spans": pa.array([len(own) for own in spans], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "removed": pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start: bigint, end: bigint>>"
    return _over_blocks(docs.select(F.col("doc_id").cast("long"), "text"), length, shape, schema, hot)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text`` and ``n_chars`` (if there) set anew.

    A character that loses some of its bytes goes altogether. Null texts stay null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    named = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(named)])
    schema = to_arrow_schema(inner.schema)

    def shape(table, kept, spans):
        table = table.select(schema.names)
        if kept:
            was = table["text"].to_pylist()
            new = [t if not own else k.decode("utf-8", "ignore") for t, k, own in zip(was, kept, spans)]
            table = table.set_column(1, "text", pa.array(new, table["text"].type))
        return table.cast(pa.schema([pa.field(f.name, table.schema.field(f.name).type) for f in schema]))

    out = _over_blocks(inner, length, shape, inner.schema, HOT_CONTEXTS)
    out = out.select("doc_id", "text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(named)])
    if "n_chars" in named:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Language identification by n-gram filters that answer with a bitmask of languages.

One bit-sliced Bloom filter serves all languages, however many: each slot holds a mask with a bit per language, in
words of 64 bits, an n-gram's answer is the AND of its slots. A text's n-grams are counted per language, the counts corrected
for the expected false positives of that language's slice, and the largest corrected share decides.

Learning counts every labelled document that the caller allows; an n-gram belongs to a language when it is at least
``LEAST_SHARE`` of the language's n-grams, so no more than ``1 / LEAST_SHARE`` are kept for each.

Whether a text is in a learned language at all is decided by a gate for its number of n-grams. The gates lie between
two measured distributions: scores of all labelled documents that were not learned, and scores of the same documents
with their own language (and its kin, such as ``en-US`` of ``en``) left out; starts of them stand for short texts.

Odd input: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from every
text is ``und``; a text that matches no n-gram gets the most frequent language with score 0; rows that repeat are
judged alike and all stay; very long texts are judged whole; an empty table gives no rows; other columns, whatever
their names, are ignored or kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..plans import bound_batches
from .kernels import LANES, U64, batches, gram_hashes, mix, text_bytes

LEAST_SHARE = 5e-5
SLOTS = 1 << 19
PROBES = 3
GRAM = 4
WORD = 64
#: Gates by the power of two of a text's n-grams.
SIZES = 13
STEPS = 100
#: A lost text of a learned language weighs as much as this many kept texts of an unlearned one.
LOSS = 20
KIN = 0.6
ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes as letters (lower-cased, every byte beyond ASCII counts) or blanks.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    slots: np.ndarray
    false_rates: np.ndarray
    documents: list[int]
    kin: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all grams within a text, and each text's bounds among them; grams with two blanks are left out."""
    folded = FOLD[data]
    h = gram_hashes(folded, GRAM)
    blank = np.cumsum(np.append(0, folded == 32))
    whole = (blank[GRAM:] - blank[:-GRAM])[: len(h)] < 2
    for e in offsets[1:-1].tolist():
        whole[max(0, e - GRAM + 1) : e] = False
    at = np.flatnonzero(whole)
    return h[at], np.searchsorted(at, offsets)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def learn(docs: DataFrame, allowed: Column) -> LanguageModel:
    """A model from the rows of ``docs(doc_id, text, lang)`` that ``allowed`` admits."""
    bound_batches(docs.sparkSession)
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    languages = list(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, SLOTS), U64), np.zeros(0), [], np.zeros((0, 0), bool))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(it):
        found: dict[int, list] = {}
        for batch in it:
            data, offsets = text_bytes(batch.column("text"))
            own = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for a, b in batches(offsets):
                h, bounds = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = np.repeat(own[a:b], np.diff(bounds))
                for k in np.unique(own[a:b]).tolist():
                    found.setdefault(k, []).append(np.unique(h[of == k], return_counts=True))
                    if len(found[k]) > 40:
                        found[k] = [_summed(found[k])]
        for k, parts in found.items():
            grams, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "gram", "n"])

    tally = labelled.select("lang", "text").mapInArrow(count, "k int, gram bigint, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    totals = tally.groupBy("k").agg(F.sum("n").alias("total"))
    kept = tally.join(F.broadcast(totals), "k").where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * LEAST_SHARE)).select("k", "gram").toPandas()
    slots = np.zeros((-(-len(languages) // WORD), SLOTS), U64)
    grams, owner = kept["gram"].to_numpy(np.int64).view(U64), kept["k"].to_numpy(np.int64)
    bits = U64(1) << (owner % WORD).astype(U64)
    for spot in _spots(grams):
        np.bitwise_or.at(slots, (owner // WORD, spot), bits)
    rates = np.array([_bit(slots, k).mean() for k in range(len(languages))]) ** PROBES
    alike = np.zeros((len(languages), len(languages)))
    for k in range(len(languages)):
        answer = _answers(slots, grams[owner == k])
        alike[k] = [_bit(answer, j).mean() if answer.size else 0.0 for j in range(len(languages))]
    alike = (alike - rates) / np.maximum(1 - rates, 1e-9)
    kin = (np.maximum(alike, alike.T) >= KIN) | np.eye(len(languages), dtype=bool)
    return LanguageModel(languages, slots, rates, list(counts.values()), kin)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def _spots(grams: np.ndarray):
    for j in range(PROBES):
        yield (mix(grams * LANES[70 + j]) % U64(SLOTS)).astype(np.int64)


def _answers(slots: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The masks (words x n-grams) of what ``slots`` says of each n-gram."""
    return np.bitwise_and.reduce([slots[:, s] for s in _spots(grams)])


def _bit(masks: np.ndarray, k: int) -> np.ndarray:
    return (masks[k // WORD] >> masks.dtype.type(k % WORD)) & masks.dtype.type(1)


def measure_gates(docs: DataFrame, model: LanguageModel, unseen: Column) -> np.ndarray:
    """The least score of each size class, from all labelled rows of ``docs`` that ``unseen`` admits.

    Costs are means over languages. With no language to leave out, the gate is half of the median score; without any
    labelled unseen row nothing is rejected.
    """
    bound_batches(docs.sparkSession)
    number = {lang: i for i, lang in enumerate(model.languages)}
    labelled = docs.where(unseen & F.col("lang").isin(model.languages) & F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.false_rates, model.kin))

    def measure(it):
        slots, rates, kin = shared.value
        found = np.zeros((2, len(kin), SIZES, STEPS + 1), np.int64)
        for batch in it:
            data, offsets = text_bytes(batch.column("text"))
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in batches(offsets):
                h, bounds = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                answer, n, lang = _answers(slots, h), np.diff(bounds), own[a:b]
                score = np.zeros((SIZES, b - a, len(kin)))
                for k in range(len(kin)):
                    hits = np.append(0, np.cumsum(_bit(answer, k), dtype=np.int64))
                    for c in range(SIZES):
                        at = np.flatnonzero(n >= 1 << c)
                        start = bounds[:-1][at]
                        score[c, at, k] = np.clip(((hits[start + (1 << c)] - hits[start]) / (1 << c) - rates[k]) / (1 - rates[k]), 0, 1)
                for c in range(SIZES):
                    at = np.flatnonzero(n >= 1 << c)
                    inside = score[c, at].max(1)
                    outside = np.where(kin[lang[at]], -1, score[c, at]).max(1)
                    np.add.at(found, (0, lang[at], c, (inside * STEPS).astype(np.int64)), 1)
                    at, outside = at[outside >= 0], outside[outside >= 0]
                    np.add.at(found, (1, lang[at], c, (outside * STEPS).astype(np.int64)), 1)
        side, k, c, step = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (side, k, c, step, found[side, k, c, step])], ["side", "k", "c", "step", "n"])

    rows = labelled.select("lang", "text").mapInArrow(measure, "side bigint, k bigint, c bigint, step bigint, n bigint")
    found = np.zeros((2, len(model.languages), SIZES, STEPS + 1))
    for r in rows.groupBy("side", "k", "c", "step").agg(F.sum("n").alias("n")).collect():
        found[r["side"], r["k"], r["c"], r["step"]] = r["n"]
    return np.array([_gate(found[0, :, c], found[1, :, c]) for c in range(SIZES)])


def _gate(inside: np.ndarray, outside: np.ndarray) -> float:
    """The score of least cost, from counts of scores (languages x steps); the middle of equally good ones."""
    inside, outside = (x[x.sum(1) > 0] for x in (inside, outside))
    if not len(inside):
        return 0.0
    below = np.cumsum(inside / inside.sum(1, keepdims=True), 1).mean(0)
    if not len(outside):
        return np.searchsorted(below, 0.5) / STEPS / 2
    lost = np.append(0, below[:-1])
    kept = 1 - np.append(0, np.cumsum(outside / outside.sum(1, keepdims=True), 1).mean(0)[:-1])
    cost = LOSS * lost + kept
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    return best[len(best) // 2] / STEPS


def _judge(languages: list[str], slots: np.ndarray, false_rates: np.ndarray, column: pa.Array, gates: np.ndarray | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it passes its gate of every text of a batch."""
    texts = column.to_pylist()
    data, offsets = text_bytes(column)
    best, score, fits = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts), bool)
    for a, b in batches(offsets) if languages else []:
        h, bounds = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        answer = _answers(slots, h)
        found = np.stack([np.add.reduceat(_bit(answer, k).astype(np.int32), bounds[:-1][full]) for k in range(len(languages))], 1)
        share = np.clip((found / n[full][:, None] - false_rates) / (1 - false_rates), 0, 1)
        best[a + full], score[a + full] = share.argmax(1), share.max(1)
        if gates is not None:
            fits[a + full] = share.max(1) >= gates[np.minimum(np.log2(n[full]).astype(np.int64), SIZES - 1)]
    letters = [bool(languages) and has_letter(t) for t in texts]
    return [languages[k] if x else "und" for k, x in zip(best.tolist(), letters)], np.where(letters, score, 0.0), fits


def _narrowed(slots: np.ndarray, languages: list[str]) -> np.ndarray:
    """``slots`` in the smallest words that hold a bit for each language."""
    kinds = (np.uint8, np.uint16, np.uint32, np.uint64)
    return slots.astype(next(k for k in kinds if min(len(languages), WORD) <= np.dtype(k).itemsize * 8))


def _renamed(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score from ``text`` alone."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.false_rates))
    inner = _renamed(docs, [*keep, "text"])
    schema = StructType([*inner.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(it):
        languages, slots, false_rates = shared.value
        slots = _narrowed(slots, languages)
        for batch in it:
            lang, score, _ = _judge(languages, slots, false_rates, batch.column(batch.num_columns - 1), None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out() -> Column:
    """Documents kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without rows that have no letters or whose text fits no learned language.

    Texts too short for a single n-gram fit. Each row travels to Python and back once.
    """
    model = learn(docs, ~held_out())
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    gates = measure_gates(docs, model, held_out())
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.false_rates, gates))
    inner, at = _renamed(docs, docs.columns), docs.columns.index("text")

    def run(it):
        languages, slots, false_rates, gates = shared.value
        slots = _narrowed(slots, languages)
        for batch in it:
            lang, _, fits = _judge(languages, slots, false_rates, batch.column(at), gates)
            yield batch.filter(pa.array(fits & np.array([x != "und" for x in lang], bool)))

    return inner.mapInArrow(run, inner.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

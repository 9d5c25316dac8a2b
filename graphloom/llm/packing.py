"""Packing of tokenised texts into fixed-length sequences from a length histogram.

Best-fit decreasing runs over the counts of each length and not over documents, so the plan on the driver
is bounded by the sequence length. Pieces learn their rank within their length (ranks inside a written
part, plus the parts before it) and take the planned slot of that rank.

Odd input: null and empty texts are the end token alone; rows that repeat an id are packed one by one; a very
long text is as many whole pieces as it takes and one more; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import Scratch, bound_batches
from .kernels import LOWER

SEQUENCE = 2048
CACHE_WORDS = 400_000
RUN_WORDS = 1000
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
TABLE = bytes(LOWER)
#: Bytes: marks, letters and digits, white space, and second bytes of small accented Latin letters (after 0xC3).
_SETS = {"end": b",.;:!?", "plain": b"abcdefghijklmnopqrstuvwxyz0123456789", "blank": b" \t\n\r\f\v", "accent": bytes(x for x in range(0xA0, 0xC0) if x != 0xB7)}
_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in _SETS.items()}


def _plain_end(word: bytes) -> bool:
    """Whether the last character is a letter that lower-casing leaves alone."""
    last = word.decode()[-1]
    return last.isalpha() and last.lower() == last


def _words(texts: list[bytes]) -> list[list[bytes]]:
    """Lower-cased words; a lone mark that ends one after a letter or digit is a piece, and so a word, of its own."""
    raw = np.frombuffer(b"  " + b" ".join(texts).translate(TABLE) + b" ", np.uint8)
    ends = np.flatnonzero(_IS["end"][raw[:-1]])
    ends = ends[_IS["blank"][raw[ends + 1]]]
    ends = ends[_IS["plain"][raw[ends - 1]] | (raw[ends - 2] == 0xC3) & _IS["accent"][raw[ends - 1]]]
    data = np.insert(raw, ends, 32).tobytes()
    starts = 2 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = (starts + np.searchsorted(ends, starts)).tolist()
    return [data[a:b].split() for a, b in zip(starts, starts[1:])]


class WordCoder:
    """Exact ids of a tokenizer whose pieces never cross ASCII white space and that lower-cases.

    Words are looked up in packed little-endian ids; only new ones are encoded. The cache holds two generations of
    at most ``CACHE_WORDS``: when the young one is full it becomes the old one, and words that come again move over,
    so frequent words stay. A final run of punctuation after a letter is a piece of its own and is cached apart;
    words of letters alone are one piece each, so many are encoded as one text and told apart by their piece numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.old = Tokenizer.from_file(path), {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, words: set[bytes]) -> set[bytes]:
        """Moves what the old generation knows of ``words`` to the young one; returns the rest."""
        new = words.difference(self.cache)
        again = new.difference(new.difference(self.old))
        self.cache.update(zip(again, map(self.old.__getitem__, again)))
        return new - again

    def _learn(self, words: set[bytes]) -> None:
        letters, rest, split, cores = [], [], [], set()
        for w, alone in self._told(self._known(words)):
            core = w if alone else w.rstrip(MARKS)
            if alone:
                letters.append(w)
            elif len(core) == len(w) or not core or not (97 <= core[-1] <= 122 or core[-1] > 127 and _plain_end(core)):
                rest.append(w)
            else:
                split.append((w, core, w[len(core) :]))
                cores.update(split[-1][1:])
        for w, alone in self._told(self._known(cores).difference(letters, rest)):
            (letters if alone else rest).append(w)
        for first in range(0, len(letters), RUN_WORDS):
            run = letters[first : first + RUN_WORDS]
            got = self.tokenizer.encode(b" ".join(run).decode(), add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(run)))
            if len(ends) != len(run):  # lower-casing made something else than letters of a word
                rest += run
                continue
            raw, ends = np.array(got.ids, "<u4").tobytes(), (4 * ends).tolist()
            self.cache.update(zip(run, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()
        for w, core, tail in split:
            self.cache[w] = self.cache[core] + self.cache[tail]

    @staticmethod
    def _told(words: set[bytes]):
        """Words with whether they are letters alone."""
        words = list(words)
        return zip(words, map(str.isalpha, b" ".join(words).decode().split(" "))) if words else ()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode() for t in texts]
        # Special tokens' strings are found in the raw text before it is cut into words.
        words = [None if b"<|" in t else w for t, w in zip(raw, _words(raw))]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.old = {}, self.cache
        self._learn(set().union(*(w for w in words if w)))
        get = self.cache.__getitem__
        return [self._whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _groups(texts: list, size: int = 1 << 20):
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Token pieces of every text, with the part they are written in and their rank by length in it."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * sequence

    def run(it):
        own, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in it:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in _groups(texts):
                rows = []
                for doc, coded in zip(ids[a:b], coder(tokenizer).encode(texts[a:b])):
                    coded += end
                    for k, at in enumerate(range(0, len(coded), step)):
                        part = coded[at : at + step]
                        n = len(part) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(part), own, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def best_fit_plan(counts: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, number): slots for consecutive ranks of a length.

    Sequences with equal room are handled together: those with least sufficient room take as many pieces of
    the length as fit, before roomier ones do; new ones are opened only when none has room.
    """
    room: dict[int, list[list[int]]] = defaultdict(list)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = [r for r, bins in room.items() if r >= length and bins]
            free = min(fits, default=sequence)
            each = free // length
            whole = left // each
            take, fill = (whole, each) if whole else (1, left)
            if fits:
                base, there = room[free].pop()
                if there > take:
                    room[free].append([base + take, there - take])
                take = min(take, there)
            else:
                base, opened = opened, opened + take
            for j in range(fill):
                out.append((length, rank, base, sequence - free + j * length, take))
                rank += take
            left -= take * fill
            if rest := free - fill * length:
                room[rest].append([base, take])
    return np.array(out, np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs.select(F.col("doc_id").cast("long"), "text"), tokenizer, sequence, end_id), "pieces")
    parts = cut.groupBy("part", "length").count()
    plan = best_fit_plan({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}, sequence)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(parts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
    heads = (plan[:, 0] << 44) | plan[:, 1]
    order = np.argsort(heads)
    heads, plan = heads[order], plan[order]

    def place(it):
        for batch in it:
            get = {n: batch.column(n) for n in batch.schema.names}
            rank = get["before"].to_numpy() + get["nth"].to_numpy()
            row = np.searchsorted(heads, (get["length"].to_numpy() << 44) | rank, "right") - 1
            seq = plan[row, 2] + rank - plan[row, 1]
            yield pa.RecordBatch.from_arrays([*(get[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(plan[row, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

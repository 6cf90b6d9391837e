"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of m characters may occur with up to k = floor(rate * m) edits.  Cut
into k + 1 pieces, at least one piece must occur unchanged, so an automaton over all pieces
finds every possible place; Myers' bit-parallel distance (JACM 1999) confirms or rejects it.
Places that lack too many of the item's trigrams for k edits (each edit breaks three at most) are
rejected before that.

Items go to the executors in blocks of bounded size (BLOCK_CHARS; a block's automaton and trigrams take some 70
bytes a character in each worker, measured); a larger benchmark is several blocks, each one pass over the documents.
Documents are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import free_name

RATE = 1 / 12
BLOCK_CHARS = 2_000_000
_last: list = []


def normal(text: str | None) -> str:
    """NFC, lower case, white space runs as one space."""
    text = text or ""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of nearly equal length, with their offsets."""
    m = len(item)
    cuts = [j * m // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams, sorted: three code points of 21 bits in one number each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and where the first best one ends; (most + 1, -1) if above."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | (1 << i)
    pv, mv, score = mask, 0, m
    best, at = (m, 0) if m <= most else (most + 1, -1)
    for j, c in enumerate(text):
        x = eq.get(c, 0)
        d0 = ((((x & pv) + pv) ^ pv) | x | mv) & mask
        hp = mv | (~(d0 | pv) & mask)
        hn = pv & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & mask
        hn = (hn << 1) & mask
        pv = hn | (~(d0 | hp) & mask)
        mv = hp & d0
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """All items of one block: (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items: dict[str, tuple[list[int], int]] = {}
        for item_id, text in items:
            if text:
                self.items.setdefault(text, ([], int(rate * len(text))))[0].append(item_id)
        self.texts = list(self.items)
        self.trigrams = [trigrams(t) for t in self.texts]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, text in enumerate(self.texts):
            for a, piece in pieces(text, self.items[text][1]):
                found.setdefault(piece, []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """Index of each item that occurs in the normalised text -> (distance, end of the best place)."""
        if self.empty or not text:
            return {}
        hits: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, a in where:
                hits.setdefault(n, set()).add(end + 1 - size - a)
        out = {}
        for n, starts in hits.items():
            item = self.texts[n]
            m, k = len(item), self.items[item][1]
            exact = next((s for s in sorted(starts) if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                out[n] = (0, exact + m)
                continue
            best = (k + 1, -1)
            lo = hi = None
            for s in [*sorted(starts), None]:  # windows that overlap are searched once
                if s is not None and lo is not None and s - k <= hi:
                    hi = s + m + k
                    continue
                if lo is not None:
                    window, need = text[max(0, lo) : hi], len(self.trigrams[n]) - 3 * k
                    if need <= 0 or common(self.trigrams[n], trigrams(window)) >= need:
                        d, at = myers(item, window, k)
                        if d < best[0]:
                            best = (d, max(0, lo) + at)
                if s is not None:
                    lo, hi = s - k, s + m + k
            if best[0] <= k:
                out[n] = best
        return out


def _matcher(block: tuple) -> Matcher:
    """The matcher of a broadcast block; a reused worker keeps it from task to task."""
    if not (_last and _last[0] is block):
        _last[:] = [block, Matcher(*block)]
    return _last[1]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in blocks of about block_chars characters, one block on the driver at a time."""
    named = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    for i in range(n):
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else named
        yield sorted((r.item_id, normal(r.text)) for r in rows.collect() if r.item_id is not None)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): one row for each input row and item that occurs in it.

    Both sides are compared in NFC, lower case, with runs of white space as one space; `end` is the
    code point of the normalised text where the best occurrence ends.  An item of fewer than
    1 / rate characters must occur unchanged.  Items with null, empty or blank text, or a null
    id, match nothing; so do documents without text.  Equal items each get their rows, and so do
    repeated documents.  Texts are searched whole, however long.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast((items, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value)
            for batch in K.slices(batches):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for n, (d, end) in matcher.matches(normal(text)).items():
                        rows += [(doc, item, d, end) for item in matcher.items[matcher.texts[n]][0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "distance", "end"])

        part = named.mapInArrow(run, "doc_id long, item_id long, distance int, end long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item occurs.

    Rows of any null column stay if clean, and so do empty texts.  Repeated rows stay or go together.  Texts are
    searched whole, however long; an empty table or benchmark changes nothing.
    """
    out = docs
    spark = docs.sparkSession
    flag = free_name(docs, "clean")
    for items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast((items, rate))

        @F.pandas_udf("boolean")
        def clean(texts, shared=shared):
            matcher = _matcher(shared.value)
            return texts.map(lambda t: not matcher.matches(normal(t)))

        out = out.withColumn(flag, clean(F.col(text_col).cast("string"))).where(flag).drop(flag)
    return out

"""Best-fit packing of token sequences by swap-based local search.

Texts become token ids once; what is packed are only lengths.  Documents longer than a
sequence are cut into full sequences plus one shorter first piece; only pieces below the
limit take part in the search.  They are dealt by their place in the stored table (equal rows fall
apart like any others) into blocks of about BLOCK pieces, however many documents there are, and each
block is packed by itself: best fit decreasing, then a local search over the bins that are not full.
A second round takes the pieces of all bins that are not full and packs them again in fewer
blocks, so what a block wastes does not add up; it counts if it needs fewer bins.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from . import textkit as K
from .shared import dropped, stored

LIMIT = 2048
BLOCK = 8192
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def _byte_pairs(path: str):
    """A faster encoder for the same merges, or None if the file isn't a plain byte-level one whose ids follow its merges."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec["added_tokens"]}
    byte = {shown: b for b, shown in P.byte_alphabet().items()}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not plain or merged != sorted(merged) or not set(byte) <= set(model["vocab"]) or max(model["vocab"][c] for c in byte) > merged[0]:
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte pairs", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoded(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian uint32 ids of whole texts as the tokenizers library gives them, without added special tokens.

    Texts with rare characters (whose classes may differ between Unicode versions) or with a special token's string
    go to the library itself.
    """
    tok, fast = P.tokenizer(path), _byte_pairs(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    out = []
    for text in texts:
        if not text:
            out.append(b"")
        elif fast is None or P.uncommon(text) or any(s in text for s in special):
            out.append(array("I", tok.encode(text, add_special_tokens=False).ids).tobytes())
        else:
            out.append(array("I", fast(text)).tobytes())
    return out


def pieces_of(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, and at, a number of each row; the end id closes each document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        at = (context.partitionId() if context else 0) << 36
        for batch in K.slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), path)):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)]
                view = memoryview(ids)
                rows += [(doc, i, a, b - a, zlib.crc32(view[4 * a : 4 * b]), at + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                at += len(cuts) - 1
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "at"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, at long")


def best_fit(lengths: Iterable[int], limit: int) -> list[list[int]]:
    """Best fit decreasing: positions of the lengths in each bin."""
    lengths = list(lengths)
    bins: list[list[int]] = []
    gaps: list[int] = []  # ascending gaps with room, one entry a bin
    at: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect.bisect_left(gaps, lengths[i])
        if k < len(gaps):
            gap = gaps.pop(k)
            b = at[gap].pop()
        else:
            gap, b = limit, len(bins)
            bins.append([])
        bins[b].append(i)
        gap -= lengths[i]
        if gap:
            bisect.insort(gaps, gap)
            at.setdefault(gap, []).append(b)
    return bins


class _Bins:
    """Bins under search: fills, contents by length, and what a bin can give back, as padded matrices."""

    def __init__(self, lengths: list[int], bins: list[list[int]], limit: int):
        self.limit, self.lengths = limit, lengths
        self.content: list[dict[int, list[int]]] = [{} for _ in bins]
        self.fill = np.zeros(len(bins), np.int64)
        #: What a taker may give back, without (0), as one piece, as two pieces: rows by bin, padded with more than any piece has.
        self.backs = [np.zeros((len(bins), 1), np.int64), np.full((len(bins), 1), 2 * limit, np.int64), np.full((len(bins), 1), 2 * limit, np.int64)]
        for b, members in enumerate(bins):
            for i in members:
                self.content[b].setdefault(lengths[i], []).append(i)
            self.fill[b] = sum(lengths[i] for i in members)
            if self.fill[b] < limit:
                self._renew(b)

    def _renew(self, b: int) -> None:
        one = np.sort(np.fromiter(self.content[b], np.int64))
        two = (one[:, None] + one[None, :])[np.triu_indices(len(one), 1)]
        twice = [2 * x for x, ids in self.content[b].items() if len(ids) > 1]
        for k, totals in ((1, one), (2, np.unique(np.concatenate([two, np.array(twice, np.int64)])))):
            totals = totals[totals < self.limit]
            if len(totals) > self.backs[k].shape[1]:
                self.backs[k] = np.pad(self.backs[k], ((0, 0), (0, len(totals) - self.backs[k].shape[1])), constant_values=2 * self.limit)
            self.backs[k][b] = 2 * self.limit
            self.backs[k][b, : len(totals)] = totals

    def step(self, giver: int) -> tuple[int, int, int, int] | None:
        """(taker, length that goes, total that comes back, pieces that come back): the step that raises the squared fill most.

        Moves are looked at first, then exchanges for one piece, then for two.
        """
        takers = np.flatnonzero((self.fill >= self.fill[giver]) & (self.fill < self.limit))
        takers = takers[takers != giver]
        if not len(takers):
            return None
        gap, ahead = (self.limit - self.fill[takers])[:, None], (self.fill[takers] - self.fill[giver])[:, None]
        for k, backs in enumerate(self.backs):
            back, best, found = backs[takers], 0, None
            for size in sorted(self.content[giver], reverse=True):
                change = size - back
                gain = np.where((change > 0) & (change <= gap), change * (ahead + change), 0)
                at = int(gain.argmax())
                if gain.flat[at] > best:
                    best, found = int(gain.flat[at]), (int(takers[at // back.shape[1]]), size, int(back.flat[at]), k)
            if found:
                return found
        return None

    def apply(self, giver: int, taker: int, size: int, total: int, pieces: int) -> None:
        mine, theirs = self.content[giver], self.content[taker]
        if pieces == 0:
            come: list[int] = []
        elif pieces == 1:
            come = [total]
        else:
            come = next([x, total - x] for x in sorted(theirs) if total - x in theirs and (2 * x != total or len(theirs[x]) > 1))
        for source, target, x in [(mine, theirs, size), *[(theirs, mine, x) for x in come]]:
            target.setdefault(x, []).append(source[x].pop())
            if not source[x]:
                del source[x]
        self.fill[giver] -= size - total
        self.fill[taker] += size - total
        self._renew(giver)
        self._renew(taker)


def improved(lengths: list[int], bins: list[list[int]], limit: int) -> list[list[int]]:
    """Local search on under-filled bins: move, one-for-one and two-for-one exchanges that raise the squared fill.

    The emptiest bin gives: it moves a piece into a fuller bin, or exchanges one of
    its pieces for a shorter piece, or for two pieces that are shorter together, of a fuller
    bin.  Each step makes the fuller bin fuller still, so the sum of squared fills rises
    and the search ends: when no step raises it, or once there are as few bins as all lengths need.
    A bin has at most sqrt(2 * limit) different lengths, which bounds what one step looks at.
    """
    state = _Bins(lengths, bins, limit)
    least, used = -(-sum(lengths) // limit), sum(1 for b in bins if b)
    again = True
    while again and used > least:  # a bin that couldn't give may be able to once others have changed
        again = False
        for giver in sorted((b for b in range(len(bins)) if 0 < state.fill[b] < limit), key=lambda b: (state.fill[b], b)):
            while 0 < state.fill[giver] < limit and used > least:
                step = state.step(giver)
                if step is None:
                    break
                again = True
                state.apply(giver, *step)
                used -= not state.fill[giver]
    return [[i for x in sorted(c, reverse=True) for i in c[x]] for c in state.content if c]


def _packed(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "at"], ascending=[False, True, True, True], kind="stable")
    lengths = rows["length"].tolist()
    bins = improved(lengths, best_fit(lengths, limit), limit)
    number, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        o = 0
        for i in b:
            number[i], offset[i] = k, o
            o += lengths[i]
        fill[b] = o
    return rows.assign(bin=number, offset=offset, fill=fill)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, at long, block long, bin long, offset long, fill long"


def _in_blocks(pieces: DataFrame, blocks: int, limit: int, seed: int) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _packed(rows.drop(columns="block"), limit).assign(block=key[0])[[c.split()[0] for c in _PACKED.split(", ")]]

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(blocks)).cast("long"))
    return dealt.groupBy("block").applyInPandas(run, _PACKED)


def best_fit_packing(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = 0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `limit` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; a null or empty text is
    its end id alone.  A text of any length is encoded whole and cut into as few pieces as it needs.  Repeated rows
    are packed as rows of their own.  An empty table packs to nothing.  Other input columns are ignored.
    """
    path = path or P.vocabulary("byte_bpe_50k.json")
    all_ = stored(pieces_of(docs, path, limit, end_id, id_col, text_col), "pieces")
    short = all_.where(F.col("length") < limit)
    n = short.count()
    first = stored(_in_blocks(short, max(1, -(-n // block)), limit, 0), "packed")
    # what is left over: the bins that are not full, from all blocks
    poor = F.col("fill") < limit
    m, bins = first.where(poor).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
    again = stored(_in_blocks(first.where(poor).drop("block", "bin", "offset", "fill"), max(1, -(-m // block)), limit, 1), "repacked")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def numbered(df: DataFrame, kind: int) -> DataFrame:
        # kind in the lowest bits, then the bin, then the block: no two rounds share a number
        return df.withColumn("sequence_id", ((F.col("block") * (1 << 24) + F.col("bin")) * 4 + kind).cast("long")).select(*out)

    whole = all_.where(F.col("length") == limit).select(*out[:5], (F.col("at") * 4 + 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if again.where("offset = 0").count() < bins:
        return whole.unionByName(numbered(first.where(~poor), 0)).unionByName(numbered(again, 1))
    dropped(again)
    return whole.unionByName(numbered(first, 0))

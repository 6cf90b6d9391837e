"""Exact top-k inner products with a bit-sliced index.

Components are quantised to integers and stored as bit slices: bitmap b of attribute d has
one bit per row (O'Neil and Quass, SIGMOD 1997; Rinfret et al., SIGMOD 2001).  A query's
score is the sum of its attributes' slices, shifted by the set bits of its own components,
added column by column with full adders over whole bitmaps.  The sum is itself bit-sliced,
so the best rows are selected from the most significant slice downward; rows that tie at the
boundary are resolved by exact score, then by smaller id.

Rows are dealt into blocks of a bounded size, and so are queries; a task holds one block of
each, and makes the index of its rows once for all its queries.  Query blocks are as large as leaves enough
tasks for the cluster, up to QUERIES_A_BLOCK: a row is moved once a query block, so few of them keep the shuffle small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: A block of rows holds about so many components, which bounds a task; large bitmaps also make each operation worth its call.
COMPONENTS_A_BLOCK, QUERIES_A_BLOCK, LEAST_QUERIES = 1 << 22, 16_384, 128


class BitSlicedIndex:
    """Slices of one block: matrix (rows x dims, int64) and their ids."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, matrix = ids[order], matrix[order]
        self.n, self.dims = matrix.shape
        self.low = matrix.min(axis=0)
        shifted = (matrix - self.low).astype(np.uint64)
        self.width = np.array([int(x).bit_length() for x in shifted.max(axis=0)])
        self.words = -(-self.n // 64)
        self.slices = [[self._bitmap((shifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(self.width[d])] for d in range(self.dims)]
        self.all = self._bitmap(np.ones(self.n, np.uint64))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: self.n] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of the scores less a constant, least significant first, and the constant."""
        bits = int(np.abs(query).max()).bit_length() if len(query) else 0
        at: list[list[np.ndarray]] = [[] for _ in range(int(self.width.max(initial=0)) + bits + self.dims.bit_length() + 2)]
        base = 0
        for d in range(self.dims):
            q = int(query[d])
            base += q * int(self.low[d])
            w = int(self.width[d])
            if not q or not w:
                continue
            use = self.slices[d]
            if q < 0:  # -|q| x = |q| (2^w - 1 - x) - |q| (2^w - 1): complemented slices keep all summands positive
                base -= -q * ((1 << w) - 1)
                use = [s ^ self.all for s in use]
            for shift in range(abs(q).bit_length()):
                if abs(q) >> shift & 1:
                    for b, s in enumerate(use):
                        at[b + shift].append(s)
        out = []
        for weight in range(len(at) - 1):
            column = at[weight]
            carry = at[weight + 1]
            while len(column) >= 3:  # full adders: three bitmaps of a weight become a sum and a carry
                rest = []
                for i in range(0, len(column) - 2, 3):
                    a, b, c = column[i : i + 3]
                    x = a ^ b
                    rest.append(x ^ c)
                    carry.append((a & b) | (x & c))
                column = rest + column[len(column) - len(column) % 3 :]
            if len(column) == 2:
                carry.append(column[0] & column[1])
                column = [column[0] ^ column[1]]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
        while out and not out[-1].any():
            out.pop()
        return out, base

    def top(self, query: np.ndarray, k: int, without: int | None = None) -> list[tuple[int, int]]:
        """The k best (id, score), score descending, then id ascending; the row with id `without` takes no part."""
        slices, base = self.scores(query)
        tied = self.all.copy()
        if without is not None:
            lo, hi = np.searchsorted(self.ids, [without, without + 1])
            for i in range(lo, hi):
                tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure = np.zeros(self.words, np.uint64)
        n_sure = 0
        for s in reversed(slices):
            ones = tied & s
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                tied = ones
            else:
                sure |= ones
                n_sure += n
                tied = tied & ~s
        rows = [*self._places(sure), *self._places(tied)[: k - n_sure]]  # ids ascend within a block, so the first tied rows win
        found = [(int(self.ids[i]), base + sum((int(s[i >> 6]) >> (i & 63) & 1) << b for b, s in enumerate(slices))) for i in rows]
        return sorted(found, key=lambda r: (-r[1], r[0]))[:k]

    def _places(self, bitmap: np.ndarray) -> list[int]:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")).tolist()


def quantised(vector: pd.Series, scale: int) -> np.ndarray:
    return np.floor(scale * np.stack(vector.to_numpy()).astype(np.float64)).astype(np.int64)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_block: int | None = None, queries_a_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by `every`.

    Components become floor(scale * x); the score is their integer inner product.  Scores are longs: if a
    component is so large that the inner product of vectors like it need not fit one (over 3.0e9 / sqrt(dimensions)
    once scaled), a ValueError names the row; no score is ever wrong or cut.  A vector that is null
    or empty, or holds a null or a non-finite component, takes no part, nor does a row with a null id;
    vectors are compared with those of the same length.  Candidates are all rows but those with the
    query's own id; ties go to the smaller id.  Repeated rows are candidates of their own, and a
    repeated query is answered once.  Other columns are ignored; an empty table gives no rows.
    """
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dims"))
    is_query = F.col("vec_id") % every == 0
    largest = F.array_max(F.transform("v", lambda x: F.abs(x))) * abs(scale)
    n, q, widest, worst = usable.agg(F.count("*"), F.count_if(is_query), F.max("dims"), F.max(F.struct((largest * F.sqrt("dims")).alias("size"), "vec_id"))).first()
    if worst and worst["size"] + math.sqrt(widest) >= 2**31.5:
        raise ValueError(f"a component of vector {worst['vec_id']} is too large: scores need not fit a long")
    rows_a_block = rows_a_block or max(256, COMPONENTS_A_BLOCK // (widest or 1))
    blocks = max(1, -(-n // rows_a_block))
    wanted = -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // blocks)
    queries_a_block = queries_a_block or min(QUERIES_A_BLOCK, max(LEAST_QUERIES, -(-q // wanted)))
    qblocks = max(1, -(-q // queries_a_block))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    rows = usable.select("dims", deal(blocks).alias("block"), F.lit(0).alias("kind"), "vec_id", "v").withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    asks = usable.where(is_query).dropDuplicates(["vec_id", "v"]).select("dims", deal(qblocks).alias("qblock"), F.lit(1).alias("kind"), "vec_id", "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        is_row = part["kind"].to_numpy() == 0
        mine, queries = part[is_row], part[~is_row]
        out: list[tuple[int, int, int]] = []
        if len(mine) and len(queries):
            index = BitSlicedIndex(quantised(mine["v"], scale), mine["vec_id"].to_numpy())
            for query_id, q in zip(queries["vec_id"].tolist(), quantised(queries["v"], scale)):
                out += [(query_id, i, s) for i, s in index.top(q, k, query_id)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = stored(rows.unionByName(asks).groupBy("dims", "block", "qblock").applyInPandas(run, "query_id long, vec_id long, score long"), "best")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

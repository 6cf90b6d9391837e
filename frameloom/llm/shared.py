"""Intermediate tables in the folder that all executors share, and a filter of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, shared_dir, stored

__all__ = ["dropped", "free_name", "maybe_among", "shared_dir", "stored"]


def free_name(df: DataFrame, name: str) -> str:
    """A column name of ours that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__frameloom_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def maybe_among(df: DataFrame, column: str, ids: DataFrame, id_column: str, flag: str, bits: int = 24) -> DataFrame:
    """df with a boolean column `flag`: false means that df[column] surely isn't among ids.

    The ids are hashed into a bitmap of 2 ** bits bits (2 MB by default, whatever the number of ids),
    whose pieces are the only thing broadcast.  So rows that can't match need not be shuffled; when
    there are far more ids than bits, all rows may match and nothing is lost but the saving.
    """
    spread = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    place, piece, bitmap = (free_name(df, x) for x in ("place", "piece", "bitmap"))
    pieces = ids.where(F.col(id_column).isNotNull()).select(spread(id_column).alias(place)).groupBy(F.shiftright(place, 15).alias(piece)).agg(F.bitmap_construct_agg(F.col(place) % 32768).alias(bitmap))
    hit = F.expr(f"shiftright(CAST(conv(hex(substring({bitmap}, CAST(({place} % 32768) DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST({place} % 8 AS INT)) & 1") == 1
    joined = df.withColumn(place, spread(column)).withColumn(piece, F.shiftright(place, 15)).join(F.broadcast(pieces), piece, "left")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(place, piece, bitmap)

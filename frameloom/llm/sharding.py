"""Sharding by extendible hashing (Fagin et al., TODS 1979), in DataFrame operations only.

Keys hash to 60 bits; the directory is indexed by hash prefixes.  A bucket that is over its
byte limit splits on one more bit, others stay whole.  All depths of a level are decided at once:
one aggregation gives bytes by a prefix some bits longer than an even spread would need, each prefix adds to
its ancestors, and a shard is the shortest prefix that fits.  Only the buckets that are over the limit at that
depth go on to the next level, with bits enough for the largest of them.

Equal hashes cannot be told apart by more key bits.  Where such a group alone is over the
limit (copies of one key, perhaps a third of the table), its rows go on splitting in the same way by the
bits of a second hash, of the row's text and position.

Texts are read once: keys, sizes and hashes are stored, and what a level leaves over is stored again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

LIMIT = 16 << 20
_BITS = 60


def hash_bits(text: Column) -> Column:
    """60 bits of an MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _leaves(grain: DataFrame, deep: int, limit: int) -> DataFrame:
    """__bits, __fine, leaf_bits, leaf_bytes, rest: the shortest prefix of each finest bucket that fits, or all its bits.

    rest: 0 where the leaf is done, 1 where it is over the limit and more bits of the same hash can part it,
    2 where it is over the limit and all its hashes are equal.
    """
    every = grain.select("__bits", "__fine", "bytes", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(__fine, {deep} - depth)"))
    node = ["__bits", "depth", "prefix"]
    fits = every.groupBy(*node).agg(F.sum("bytes").alias("leaf_bytes")).where((F.col("leaf_bytes") <= limit) | (F.col("depth") == deep))
    least = every.join(fits, node).groupBy("__bits", "__fine").agg(F.min(F.struct("depth", "prefix", "leaf_bytes", "low", "high")).alias("leaf"))
    bits = F.expr("CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(leaf.prefix), leaf.depth, '0') END")
    rest = F.when(F.col("leaf.leaf_bytes") <= limit, 0).when(F.col("leaf.low") < F.col("leaf.high"), 1).otherwise(2)
    return least.select("__bits", "__fine", F.concat("__bits", bits).alias("leaf_bits"), F.col("leaf.leaf_bytes").alias("leaf_bytes"), rest.alias("rest"))


def _split(rows: DataFrame, hash_: str, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows (with __bits so far) in their shards, and rows of equal hashes that are over the limit together."""
    done, equal, used = [], [], 0
    while True:
        worst = rows.groupBy("__bits").agg(F.sum("__bytes").alias("b")).agg(F.max("b")).first()[0]
        if worst is None:
            return done, equal
        deep = min(_BITS - used, max(1, math.ceil(math.log2(max(2.0, worst / limit)))) + 3)
        fine = F.expr(f"shiftright({hash_}, {_BITS - used - deep}) & {(1 << deep) - 1}L")
        grain = rows.groupBy("__bits", fine.alias("__fine")).agg(F.sum("__bytes").alias("bytes"), F.min(hash_).alias("low"), F.max(hash_).alias("high"))
        leaves = stored(_leaves(grain, deep, limit), "directory")
        placed = rows.withColumn("__fine", fine).join(leaves, ["__bits", "__fine"])
        done.append(placed.where("rest = 0"))
        left = {r.rest for r in leaves.select("rest").distinct().collect()}
        keep = [c for c in rows.columns if c != "__bits"]
        again = lambda kind: placed.where(F.col("rest") == kind).select(*keep, F.col("leaf_bits").alias("__bits"), F.col("leaf_bytes").alias("__leaf_bytes"))
        if 2 in left:
            equal.append(again(2))
        used += deep
        if 1 not in left:
            return done, equal
        rows = stored(again(1).drop("__leaf_bytes"), "oversized")


def shards(docs: DataFrame, limit: int = LIMIT, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", row_overhead: int = 64) -> DataFrame:
    """One row per input row: the key columns, n_bytes, shard (hash bits of its bucket), depth, shard_bytes, oversized.

    A row has its text's UTF-8 bytes plus row_overhead, however long it is; a null text has no bytes of its own
    and a null key hashes as the empty string.  Every shard fits the limit, but for one row that is larger by
    itself: its shard is flagged oversized.  Repeated rows are rows of their own.  Other columns are
    ignored; an empty table has no shards.
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    text = F.col(text_col).cast("string")
    names = [f"__key{i}" for i in range(len(key_cols))]
    rows = stored(
        docs.withColumn("__at", F.monotonically_increasing_id()).select(
            *[F.col(c).alias(n) for c, n in zip(key_cols, names)],
            (F.coalesce(F.octet_length(text), F.lit(0)) + row_overhead).cast("long").alias("__bytes"),
            hash_bits(key).alias("__h1"),
            hash_bits(F.concat_ws("\x1f", "__at", text)).alias("__h2"),
            F.lit("").alias("__bits"),
        ),
        "sharding",
    )

    def named(placed: DataFrame) -> DataFrame:
        return placed.select(*[F.col(n).alias(c) for c, n in zip(key_cols, names)], F.col("__bytes").alias("n_bytes"), F.col("leaf_bits").alias("shard"), F.length("leaf_bits").alias("depth"), F.col("leaf_bytes").alias("shard_bytes"), (F.col("leaf_bytes") > limit).alias("oversized"))

    done, equal = _split(rows, "__h1", limit)
    for same in equal:  # groups of one key; a level has at most one such set
        more, alone = _split(stored(same.drop("__leaf_bytes"), "hot_keys"), "__h2", limit)
        done += more
        done += [a.select("*", F.col("__bits").alias("leaf_bits"), F.col("__leaf_bytes").alias("leaf_bytes")) for a in alone]
    if not done:
        return named(rows.withColumn("leaf_bits", F.lit("")).withColumn("leaf_bytes", F.lit(0).cast("long")))
    out = named(done[0])
    for more in done[1:]:
        out = out.unionByName(named(more))
    return out

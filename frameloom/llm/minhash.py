"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Sketch: Dahlgaard, Knudsen, Thorup, "Fast Similarity Sketching" (FOCS 2017).  A set is
thrown into t bins in rounds; round i < t hashes each element to a random bin, round
i >= t puts every element into bin i - t, so all t coordinates are filled after 2t rounds
at the latest, in O(t log t + n) expected time and with Chernoff-type concentration.

Plan, for one row per document:

1. one pass over the texts gives shingle counts, a 128-bit set digest, band keys and an
   8-bit form of the sketch (kept in the shared folder; no text is kept);
2. equal sets collapse to the smallest doc_id, by aggregation;
3. round 1 compares each representative with one hub, the least representative of the
   bucket it shares most bands with;
4. in buckets whose members are still in different components, those outside the largest one are compared with
   all by sketch, in blocks, inside tasks (a pair that shares several buckets in the first of them only).  Round 2
   verifies the best two pairs of each component (Boruvka's scheme), which joins most of a
   group; round 3 verifies every candidate pair that is left, block by block, each block
   getting a set once and skipping pairs that it has already joined;
5. every link is confirmed on full shingle sets; components come from the links.

Nothing emits all pairs of a bucket, and no bucket, hub or component is gathered in one
task: hubs are salted by their number of partners, buckets are dealt in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .components import connected_components
from .shared import dropped, free_name, maybe_among, stored

_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """k-word shingles, linked when den * |A & B| >= num * |A | B|; bands of rows sketch coordinates."""

    k: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5
    bands: int = 36

    @property
    def size(self) -> int:
        return self.rows * self.bands

    @property
    def least_agreement(self) -> int:
        """Sketch coordinates that a pair at the threshold agrees on, less five standard deviations."""
        p = self.num / self.den
        return int(self.size * p - 5 * math.sqrt(self.size * p * (1 - p)))


def sketch(elements: np.ndarray, per: np.ndarray, t: int) -> np.ndarray:
    """Sketches (sets x t, uint64) of consecutive sets of uint64 hashes; empty sets give all ones."""
    n = len(per)
    out = np.full((n, t), ~_U(0), np.uint64)
    owner = np.repeat(np.arange(n), per)
    x = elements
    for i in range(2 * t):
        if not len(x):
            break
        h = K.mix(x + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (_U(i) << _U(48)) | (K.mix(h ^ _U(0xA5A5A5A5)) >> _U(16))
        bin_ = ((h >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out.reshape(-1), owner * t + bin_, value)
        if i < 3 or i % 4 == 0 or i >= t:
            open_ = (out == ~_U(0)).any(axis=1)
            keep = open_[owner]
            if not keep.all():
                x, owner = x[keep], owner[keep]
    return out


def _sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, _, _, counts = K.word_hashes(buf, offsets)
    return K.distinct_sets(*K.shingle_hashes(words, counts, k))


def _digests(elements: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = K.mix(K.sum_by(K.mix(elements ^ _U(0x243F6A8885A308D3)), per) + per.astype(np.uint64))
    b = K.mix(K.sum_by(K.mix(elements + _U(0x13198A2E03707344)), per) ^ _U(0xA4093822299F31D0))
    return a.astype(np.int64), b.astype(np.int64)


def signatures(docs: DataFrame, how: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), d1, d2 (set digest), bands (keys), sk (8 bits a coordinate, then 32 bits a band)."""
    t, rows, bands, k = how.size, how.rows, how.bands, how.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            buf, offsets = K.utf8(batch.column(1))
            for lo, hi, b, o in K.chunks(buf, offsets):
                elements, per = _sets(b, o, k)
                s = sketch(elements, per, t)
                d1, d2 = _digests(elements, per)
                keys = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    keys = K.mix(keys * _U(0x9E3779B97F4A7C15) + s.reshape(-1, bands, rows)[:, :, r])
                keys += np.arange(bands, dtype=np.uint64) * _U(0xD1B54A32D192ED03)
                keys = K.mix(keys)
                small = np.concatenate([(s & _U(0xFF)).astype(np.uint8), (keys & _U(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(hi - lo, -1)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi].cast(pa.int64()),
                        pa.array(per, pa.int64()),
                        pa.array(d1),
                        pa.array(d2),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.astype(np.int64).reshape(-1)),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "bands", "sk"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, sk binary")


def _shingle_sets(cand: DataFrame, k: int) -> DataFrame:
    """(node, text) -> (node, elements): the sorted distinct shingle hashes as little-endian bytes."""

    def run(batches):
        for batch in K.slices(batches):
            buf, offsets = K.utf8(batch.column(1))
            for lo, hi, b, o in K.chunks(buf, offsets):
                elements, per = _sets(b, o, k)
                ends = np.cumsum(per)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([elements[e - c : e].tobytes() for e, c in zip(ends, per)], pa.binary())], names=["node", "elements"])

    return cand.select("node", "text").mapInArrow(run, "node long, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, how: Similarity, block: int = 64) -> DataFrame:
    """Of (a, b) pairs those that meet the threshold on full sets, as links (u, v).

    Partners of one a are dealt in blocks of about `block`, each with one copy of a's set.  Only hubs of more
    partners than that need to know their number: a bitmap tells their pairs, which are salted before they meet it.
    """
    num, den = how.num, how.den
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")).where("blocks > 1")
    marked = maybe_among(pairs.select("a", "b"), "a", hubs, "a", "big")
    part = F.pmod(F.xxhash64("b"), F.lit(64))
    salted = marked.where("big").withColumn("part", part).join(hubs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))), ["a", "part"], "left")
    dealt = salted.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b", F.lit(1)), F.col("blocks")), F.lit(0).cast("long")).alias("salt"))
    dealt = dealt.unionByName(marked.where("NOT big").select("a", "b", F.lit(0).cast("long").alias("salt")))
    rows = dealt.select("a", "salt", "a").toDF("a", "salt", "node").withColumn("role", F.lit(0)).distinct().unionByName(dealt.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("role")))
    full = rows.join(sets, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        hub, hub_key = None, None
        for batch in K.slices(batches):
            us, vs = [], []
            for a, salt, role, node, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    hub, hub_key = s.copy(), (a, salt)
                elif hub_key == (a, salt):
                    least, most = sorted((len(s), len(hub)))
                    if den * least >= num * most:
                        both = np.concatenate([s, hub])
                        both.sort()
                        same = int((both[1:] == both[:-1]).sum())
                        if den * same >= num * (len(s) + len(hub) - same):
                            us.append(a)
                            vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return full.select("a", "salt", "role", "node", "elements").mapInArrow(run, "u long, v long")


def _candidates(group: list[tuple], how: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (p, q) of the pairs of a block that may be similar, and their agreement; best first.

    Rows are (band, side, node, component, n, sk); side is 0 for an outsider of the bucket, 1 for any other member
    and 2 for a member that is an outsider too (so that a pair of outsiders is seen once).  Pairs within a component, of sizes too far apart, of too
    little agreement, or that share an earlier band (and are looked at there) are left out.
    """
    least, num, den, t = how.least_agreement, how.num, how.den, how.size
    band, side = group[0][0], np.array([g[1] for g in group])
    node = np.array([g[2] for g in group], np.int64)
    comp = np.array([g[3] for g in group], np.int64)
    size = np.array([g[4] for g in group], np.int64)
    raw = np.frombuffer(b"".join(g[5] for g in group), np.uint8).reshape(len(group), -1)
    sk, keys = raw[:, :t], np.ascontiguousarray(raw[:, t:]).view("<u4")
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    firsts, seconds, agrees = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left:
        js = right[(side[right] == 1) | (node[right] > node[i])]
        js = js[(comp[js] != comp[i]) & (den * np.minimum(size[js], size[i]) >= num * np.maximum(size[js], size[i]))]
        if band and len(js):
            js = js[~(keys[js, :band] == keys[i, :band]).any(axis=1)]
        if len(js):
            same = (sk[js] == sk[i]).sum(axis=1)
            js, same = js[same >= least], same[same >= least]
            firsts.append(np.full(len(js), i))
            seconds.append(js)
            agrees.append(same)
    p, q, agree = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(agrees)
    order = np.lexsort((node[q], node[p], -agree))
    return p[order], q[order], agree[order]


def _by_part(batches, emit, empty):
    """Run emit on the rows of each part; rows come sorted by part, their first column."""
    key, group = None, []
    for batch in K.slices(batches):
        out = []
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part != key:
                out += emit(key, group) if group else []
                key, group = part, []
            group.append(tuple(row))
        yield empty(out)
    yield empty(emit(key, group) if group else [])


def _batch(rows: list[tuple], names: str, *types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names.split())


_BLOCK_COLUMNS = ("part", "band", "side", "node", "component", "n", "sk")


def _best_pairs(rows: DataFrame, how: Similarity, most: int) -> DataFrame:
    """(a, b): pairs that are among the `most` best candidates of either component in a block (Boruvka's scheme)."""

    def emit(_, group):
        p, q, _ = _candidates(group, how)
        comp = np.unique([g[3] for g in group], return_inverse=True)[1].tolist()
        taken, out = [0] * (max(comp) + 1), []
        for i, j in zip(p.tolist(), q.tolist()):
            a, b = comp[i], comp[j]
            if taken[a] < most or taken[b] < most:
                taken[a] += 1
                taken[b] += 1
                out.append((min(group[i][2], group[j][2]), max(group[i][2], group[j][2])))
        return out

    run = lambda batches: _by_part(batches, emit, lambda out: _batch(out, "a b", pa.int64(), pa.int64()))
    return rows.repartition("part").sortWithinPartitions("part").select(*_BLOCK_COLUMNS).mapInArrow(run, "a long, b long").distinct()


def _all_candidates(rows: DataFrame, how: Similarity) -> DataFrame:
    """(part, node, component, partners): every candidate pair of a block, as a list at one of its nodes; one row a node involved."""

    def emit(part, group):
        p, q, _ = _candidates(group, how)
        partners: dict[int, list[int]] = {}
        component: dict[int, int] = {}
        for i, j in zip(p.tolist(), q.tolist()):
            a, b = group[i], group[j]
            partners.setdefault(a[2], []).append(b[2])
            component[a[2]], component[b[2]] = a[3], b[3]
        return [(part, n, c, partners.get(n, [])) for n, c in component.items()]

    run = lambda batches: _by_part(batches, emit, lambda out: _batch(out, "part node component partners", pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))
    return rows.repartition("part").sortWithinPartitions("part").select(*_BLOCK_COLUMNS).mapInArrow(run, "part string, node long, component long, partners array<long>")


def _verified_in_blocks(cand: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """Links (u, v) that join components, from all candidates of each block.

    A block gets each set once, however many pairs it is in.  Pairs whose components the block
    has already joined need no check.
    """
    num, den = how.num, how.den

    def emit(_, group):
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        elements = {g[0]: np.frombuffer(g[3], np.uint64) for g in group}
        component = {g[0]: g[1] for g in group}
        out = []
        for node, mine, partners, _ in group:
            s = elements[node]
            for other in partners:
                a, b = find(mine), find(component[other])
                if a == b:
                    continue
                o = elements[other]
                both = np.concatenate([s, o])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if den * same >= num * (len(s) + len(o) - same):
                    root[a] = b
                    out.append((node, other))
        return out

    run = lambda batches: _by_part(batches, emit, lambda out: _batch(out, "u v", pa.int64(), pa.int64()))
    full = cand.join(sets, "node").repartition("part").sortWithinPartitions("part").select("part", "node", "component", "partners", "elements")
    return full.mapInArrow(run, "u long, v long")


def _blocks(now: DataFrame, sketches: DataFrame, block: int = 256) -> DataFrame:
    """Deal the rows (key, band, node, component, n) of buckets that hold several components, with their sketches, into blocks.

    Every bucket has a main component, the one with most of its members; other members are its outsiders.  A pair of
    different components has an outsider in it, so blocks of outsiders meet blocks of all members: where one
    component holds nearly all of a bucket, rows grow with the bucket, not with its square.
    """
    sizes = now.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("members"), F.count("*").alias("components")).where("components > 1")
    rows = now.join(mixed, "key").withColumn("outside", F.col("component") != F.col("main.component")).join(sketches, "node")
    parts = lambda n: F.ceil(n / block).cast("int")
    rows = rows.withColumn("blocks", parts(F.col("members"))).withColumn("outer", parts(F.col("members") - F.col("main.size")))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("string")
    each = lambda n, part, side: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.struct(part(i.cast("string")).alias("part"), side.alias("side")))
    left = each("blocks", lambda i: F.concat_ws(":", "key", mine("outer"), i), F.lit(0))
    right = each("outer", lambda i: F.concat_ws(":", "key", i, mine("blocks")), F.when(F.col("outside"), 2).otherwise(1))
    placed = rows.withColumn("place", F.explode(F.when(F.col("outside"), F.concat(left, right)).otherwise(right)))
    return placed.select("place.part", "band", "place.side", "node", "component", "n", "sk")


def near_duplicates(docs: DataFrame, how: Similarity | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased.  A null or empty text (or
    one of white space) has no shingles and is linked with nothing; with fewer than k words the
    whole sequence is the only shingle.  Repeated rows with one doc_id are each returned, with
    the same component.  doc_id identifies a document; rows with a null doc_id are returned with
    their own null component and kept true.  Texts are taken whole, however long.  Other input columns are ignored.  An empty table
    gives an empty result.
    """
    how = how or Similarity()
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = stored(signatures(named, how), "signatures")
    some = sig.where("n > 0 and doc_id is not null")
    reps = stored(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sk").alias("sk")), "representatives")
    keyed = reps.select("node", "n", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1")
    member = stored(keyed.join(buckets, "key").select("key", "band", "node", "n", "hub", "members"), "buckets")

    nodes = stored(member.select("node").distinct(), "nodes")
    near = maybe_among(named, "doc_id", nodes, "node", "maybe").where("maybe").drop("maybe")  # most texts stay where they are
    cand = near.join(nodes, F.col("doc_id") == F.col("node")).dropDuplicates(["node"])
    sets = stored(_shingle_sets(cand, how.k), "shingles")
    dropped(nodes)

    shared = member.where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("same"))
    best = shared.groupBy("node").agg(F.max(F.struct("same", -F.col("hub"))).alias("best"))
    links = stored(_verified(best.select((-F.col("best.col2")).alias("a"), F.col("node").alias("b")), sets, how), "verified")
    parts = connected_components(links)

    def mixed_blocks() -> DataFrame:
        """Blocks of the buckets whose members are still in different components."""
        now = member.drop("hub", "members").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return _blocks(now, reps.select("node", "sk"))

    def joined(more: DataFrame) -> DataFrame:
        out = stored(links.unionByName(more), "verified")
        dropped(links)
        return out

    # what joins most of a group: the best pairs of each component
    pairs = stored(_best_pairs(mixed_blocks(), how, 2), "pairs")
    links = joined(_verified(pairs, sets, how))
    dropped(pairs)
    parts = connected_components(links)
    # the rest, in full
    left = stored(_all_candidates(mixed_blocks(), how), "candidates")
    links = joined(_verified_in_blocks(left, sets, how))
    dropped(left)
    parts = connected_components(links)
    dropped(sets)
    dropped(member)

    of = reps.select("node", "d1", "d2", "n").join(parts, "node", "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("least"))
    return sig.select("doc_id", "n", "d1", "d2").join(of, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("least"))).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, how: Similarity | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that near_duplicates keeps; rows with a null id stay.

    Only rows that may have to go meet the list of ids in a shuffle.
    """
    gone = stored(near_duplicates(docs, how, id_col, text_col).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    maybe, out = free_name(docs, "maybe"), free_name(docs, "gone")
    flagged = maybe_among(docs, id_col, gone, "doc_id", maybe)
    stay = flagged.where(~F.col(maybe)).drop(maybe)
    check = flagged.where(F.col(maybe)).join(gone.withColumnRenamed("doc_id", out), F.col(id_col) == F.col(out), "left_anti").drop(maybe)
    return stay.unionByName(check)

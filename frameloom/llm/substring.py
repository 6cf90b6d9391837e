"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes decides where chunks end: at its minimum among the
places up to REACH bytes away.  A boundary depends only on the text around it, so an insertion
disturbs only the chunk it falls in, and no long stretch of varied text is without one.  Where a
repetitive stretch has none, its equal minima are boundaries, LEAST_BYTES or more apart.  Small
chunks keep what a passage loses at its ends small, but a few common words are no evidence:
so from each boundary on, as many chunks as make LEAST_BYTES are taken as one window, and
windows are matched by digest.  Overlapping repeated windows form passages.

Texts are chunked twice (it is cheap and vectorised) instead of storing one row per window:
first to find digests in two or more documents, by aggregation with map-side combining,
then to mark the windows that have one; windows that a bitmap of fixed size excludes aren't shuffled for that.
The join's aggregated side has one row a digest, so a passage in a third of all documents only skews the streamed side.

What windows find falls short of a passage at both ends, by MARGIN at most, so that a run of them alone can't tell fifty
repeated words from forty.  A run of LEAST_WORDS words or more stands.  For a shorter one, all stretches of LEAST_WORDS
words within MARGIN of it are hashed, and one must occur in another document's passages; only hashes that a bitmap of fixed
size can't exclude are shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .shared import dropped, free_name, maybe_among, stored

REACH, LONGEST, LEAST_BYTES, LEAST_WORDS = 11, 512, 48, 50
#: So many characters at either end of a passage may lie outside its windows: a boundary depends on 26 before it, and chunks are no longer than that.
MARGIN = 26 + 2 * LEAST_BYTES
#: In a run that smaller documents have parts of, what only larger ones share is given from so many code points on.
LEAST_OWN = 100
_U = np.uint64
_GEAR = np.random.Generator(np.random.PCG64(73)).integers(0, 1 << 32, 256, dtype=np.uint32)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of h[i], ..., h[i + width - 1], as far as there are so many."""
    out, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def boundaries(buf: np.ndarray, offsets: np.ndarray, reach: int = REACH, longest: int = LONGEST, least_bytes: int = LEAST_BYTES) -> np.ndarray:
    """Ends of all chunks, ascending.  A document's end is one; none falls inside a UTF-8 character."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    h = _GEAR[buf]
    for width in (1, 2, 4, 8):  # h[i] = sum of gear[b[i - j]] << j over the last 16 bytes
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    ahead = _least(h, reach)
    before, after = np.full(n, 0xFFFFFFFF, np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    before[reach:] = ahead[: n - reach]
    after[:-1] = ahead[1:]
    starts = np.ones(n + 1, bool)
    starts[:-1] = (buf & 0xC0) != 0x80
    equal = (h <= before) & (h <= after) & starts[1:]
    ends = np.flatnonzero(equal & (h < before)) + 1
    ends = np.unique(np.concatenate([ends, offsets[1:][offsets[1:] > offsets[:-1]]]))
    sizes = np.diff(ends, prepend=0)
    wide = np.flatnonzero(sizes > 2 * least_bytes)
    if len(wide):
        minima = np.flatnonzero(equal) + 1
        extra = []
        for k in wide:
            at, end = int(ends[k] - sizes[k]), int(ends[k])
            mine = minima[np.searchsorted(minima, at, "right") : np.searchsorted(minima, end)]
            while end - at > 2 * least_bytes:
                i = int(np.searchsorted(mine, at + least_bytes))
                c = int(mine[i]) if i < len(mine) and mine[i] <= at + longest else at + longest
                if c >= end:
                    break
                while not starts[c]:
                    c -= 1
                extra.append(c)
                at = c
        ends = np.unique(np.concatenate([ends, np.array(extra, np.int64)]))
    return ends


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version, text of the rows with an id and a text."""
    text = F.col(text_col).cast("string")
    return docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def window_rows(docs: DataFrame, reach: int = REACH, longest: int = LONGEST, least_bytes: int = LEAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest, doc_id, version (a hash of the text), span of every window of chunks; span is start << 32 | end, in code points, end exclusive.

    Rows that share a doc_id but not the text are told apart by version.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, offsets = K.utf8(batch.column(2))
            for lo, hi, b, o in K.chunks(buf, offsets):
                ends = np.union1d(boundaries_by_document(b, o, reach, longest), o[1:][o[1:] > o[:-1]])
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                owner = np.searchsorted(o, starts, "right") - 1
                # each window ends at the first chunk end that gives it least_bytes; the last ones of a document are dropped
                upto = np.searchsorted(ends, starts + least_bytes)
                upto = np.minimum(upto, len(ends) - 1)
                keep = (ends[upto] - starts >= least_bytes) & (ends[upto] <= o[1:][owner]) if len(ends) else np.zeros(0, bool)
                starts, owner, ends = starts[keep], owner[keep], ends[upto][keep] if len(ends) else ends
                points = np.zeros(len(b) + 1, np.int64)
                np.cumsum((b & 0xC0) != 0x80, out=points[1:])
                total = np.zeros(len(b) + 1, np.uint64)
                np.cumsum(K._BYTE[b] * K._pow("p", K._P, len(b)), out=total[1:])
                digest = K.mix((total[ends] - total[starts]) * K._pow("q", K._PINV, len(b))[starts] + (ends - starts).astype(np.uint64)) if len(ends) else np.zeros(0, np.uint64)
                first = points[o[:-1]][owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest.astype(np.int64)), pa.array(ids[lo:hi][owner].astype(np.int64)), pa.array(versions[lo:hi][owner].astype(np.int64)), pa.array((points[starts] - first) << 32 | points[ends] - first)],
                    names=["digest", "doc_id", "version", "span"],
                )

    return _texts(docs, id_col, text_col).mapInArrow(run, "digest long, doc_id long, version long, span long")


def boundaries_by_document(buf: np.ndarray, offsets: np.ndarray, reach: int, longest: int) -> np.ndarray:
    """boundaries() with the rolling hash started afresh in each document, so equal documents have equal chunks."""
    gap = 16 + reach
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    at = np.arange(len(buf)) + (owner + 1) * gap
    wide = np.zeros(len(buf) + (n + 1) * gap, np.uint8)
    wide[at] = buf
    ends = boundaries(wide, np.stack([offsets[:-1] + (np.arange(n) + 1) * gap, offsets[1:] + (np.arange(n) + 1) * gap], 1).reshape(-1), reach, longest)
    place = np.zeros(len(wide) + 1, bool)
    place[ends] = True
    return np.flatnonzero(place[at + 1]) + 1


def _regions(spans: DataFrame, texts: DataFrame, least_words: int) -> DataFrame:
    """doc_id, version, run, sure, region: whether the run itself has least_words words, and its text with the words within MARGIN on either side.

    A region of fewer words is left out: no passage of that many can hold its run.

    spans: doc_id, version, run, start, end.
    """
    key = ["doc_id", "version"]
    by_doc = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "run"))).alias("spans"))  # runs of one text
    near = maybe_among(texts, "doc_id", by_doc, "doc_id", "maybe").where("maybe").join(by_doc, key).dropDuplicates(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in K.slices(batches):
            rows = []
            for doc, version, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = [m.span() for m in word.finditer(text)]
                begins, ends = [a for a, _ in words], [b for _, b in words]
                for s in spans:
                    whole = bisect_right(ends, s["end"]) - bisect_left(begins, s["start"])
                    a, b = bisect_right(ends, s["start"] - MARGIN), bisect_left(begins, s["end"] + MARGIN)
                    if b - a >= least_words:
                        rows.append((doc, version, s["run"], whole >= least_words, text[begins[a] : ends[b - 1]]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "version", "run", "sure", "region"])

    return near.select("doc_id", "version", "text", "spans").mapInArrow(run, "doc_id long, version long, run long, sure boolean, region string")


def _stretches(regions: DataFrame, least_words: int) -> DataFrame:
    """doc_id, version, run, stretch: the hash of every least_words consecutive words of the regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            buf, offsets = K.utf8(batch.column(3))
            for lo, hi, b, o in K.chunks(buf, offsets):
                words, _, _, counts = K.word_hashes(b, o, lower=False)
                hashes, per = K.shingle_hashes(words, counts, least_words)
                at = pa.array(np.repeat(np.arange(lo, hi), per))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(hashes.astype(np.int64))], names=["doc_id", "version", "run", "stretch"])

    return regions.select("doc_id", "version", "run", "region").mapInArrow(run, "doc_id long, version long, run long, stretch long")


def _confirmed(spans: DataFrame, texts: DataFrame, least_words: int) -> DataFrame:
    """doc_id, version, run of the runs that are, or lie in, least_words words that another document has too."""
    regions = stored(_regions(spans, texts, least_words), "regions")
    sure, open_ = regions.where("sure"), stored(_stretches(regions.where("NOT sure"), least_words), "stretches")
    others = maybe_among(_stretches(sure, least_words), "stretch", open_, "stretch", "maybe", 26).where("maybe").drop("maybe")
    common = open_.unionByName(others).groupBy("stretch").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    shared = stored(open_.join(common.select("stretch"), "stretch").select("doc_id", "version", "run").distinct(), "confirmed")
    dropped(open_)
    return sure.select("doc_id", "version", "run").distinct().unionByName(shared)


def repeated_passages(docs: DataFrame, reach: int = REACH, longest: int = LONGEST, least_bytes: int = LEAST_BYTES, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_windows, first_doc_id, version): passages that also occur in another document.

    A run of overlapping or adjoining windows whose digests occur in two or more documents counts if it
    has least_words words, or lies in a stretch of that many that another document's runs have too.  In it, windows that a
    smaller document has and windows that no smaller one has form passages of their own, which may overlap; start and
    end are code points, end exclusive.  first_doc_id is the smallest document with any of the passage's windows.  Where
    it is doc_id itself, this is the copy to keep (beside other passages of a run, from LEAST_OWN code points on); every other passage can be cut, however short: all of it is in smaller
    documents.
    Null and empty texts and rows with a null id have no passages, clean documents no rows.  Two rows
    with one doc_id count as one document: what only they share is no repetition; version, a hash of the text, tells
    which text a passage is of.  Texts are taken whole, however long.  Other input columns are ignored; an empty table
    gives an empty result.
    """
    rows = window_rows(docs, reach, longest, least_bytes, id_col, text_col)
    many = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last"), "digests")
    likely = maybe_among(rows, "digest", many, "digest", "maybe", 26).where("maybe").drop("maybe")  # most windows stay where they are
    marked = stored(likely.join(many, "digest").select("doc_id", "version", F.shiftright("span", 32).alias("start"), F.col("span").bitwiseAND(0xFFFFFFFF).alias("end"), "first_doc_id"), "marked")
    dropped(many)
    key = ["doc_id", "version"]
    by = Window.partitionBy(*key).orderBy("start", "end", "first_doc_id")  # windows of one text
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("first_doc_id") == F.col("doc_id")
    past = lambda end: F.coalesce((F.col("start") > F.max(end).over(before)).cast("int"), F.lit(1))
    alike = F.when(own, past(F.when(own, F.col("end")))).otherwise(past(F.when(~own, F.col("end"))))
    fresh = marked.distinct().select("*", own.alias("own"), past(F.col("end")).alias("fresh"), alike.alias("part_fresh"))
    runs = fresh.select("*", F.sum("fresh").over(upto).alias("run"), F.when(F.col("own"), F.sum(F.when(F.col("own"), F.col("part_fresh"))).over(upto)).otherwise(F.sum(F.when(~F.col("own"), F.col("part_fresh"))).over(upto)).alias("part"))
    parts = stored(runs.groupBy(*key, "run", "own", "part").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.count("*").alias("n_windows"), F.min("first_doc_id").alias("first_doc_id")), "passages")
    dropped(marked)
    spans = parts.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    good = _confirmed(spans, _texts(docs, id_col, text_col), least_words)
    alone = ~F.max(~F.col("own")).over(Window.partitionBy(*key, "run"))
    return parts.withColumn("alone", alone).where(~F.col("own") | F.col("alone") | (F.col("end") - F.col("start") >= LEAST_OWN)).join(good, [*key, "run"]).select("doc_id", "start", "end", "n_windows", "first_doc_id", "version")


def without_repeats(docs: DataFrame, reach: int = REACH, longest: int = LONGEST, least_bytes: int = LEAST_BYTES, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every repeated passage cut out of text_col but in the document that holds its first copy.

    A character is cut only with a window that a smaller document has too, so each one stays in some document.  All rows
    and columns stay; null and empty texts stay as they are, and so does an empty table.
    """
    found = repeated_passages(docs, reach, longest, least_bytes, least_words, id_col, text_col).where("doc_id != first_doc_id")
    id_, version, cut = (free_name(docs, x) for x in ("id", "version", "cuts"))
    cuts = found.groupBy(F.col("doc_id").alias(id_), F.col("version").alias(version)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    text = F.col(text_col)
    rest = F.aggregate(
        cut,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, c: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, c["start"] - a["at"])).alias("out"), F.greatest(a["at"], c["end"]).alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    joined = docs.join(cuts, (docs[id_col] == F.col(id_)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(version)), "left")
    return joined.withColumn(text_col, F.when(F.col(cut).isNull(), text).otherwise(rest)).drop(id_, version, cut)

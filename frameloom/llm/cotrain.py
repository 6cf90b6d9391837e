"""Quality classifier by co-training.

Blum and Mitchell (COLT 1998): one classifier sees a document's text (its words and layout), the other its page
metadata (source, language, length in characters) and nothing else.  In each round each of them labels the rows of
an unlabelled pool that it is surest of, and the other learns from those labels.  After the last
round both are calibrated on labelled rows held out from training, and their log odds are
combined by a logistic model fitted on the same rows.

Two targets are learned this way, good quality and toxicity; a document is kept if it is likely good and
not likely toxic.  Models are fitted in one task on bounded, documented samples
(FIT_ROWS labelled, POOL_ROWS unlabelled), chosen by hash, and only models come to the driver; of a class with few rows in FIT_ROWS more
are taken, up to a quarter of FIT_ROWS, and weigh as much less.  All documents are scored, in one
pass without a shuffle.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K

FIT_ROWS, POOL_ROWS, FEATURES, ROUNDS, EXCHANGED = 12_000, 4_000, 512, 3, 300
#: A word feature is used if so many fitted rows have it and so many don't.
LEAST_ROWS = 3
#: Rows that are worked on at once while a model is fitted, so that what is made on the way stays small.
BLOCK_ROWS = 2_048
#: Bytes of text that features are made of at once; some twenty arrays of that many numbers are alive then.
PIECE = 1 << 19
#: Word features are hashed to so many bits: counting them needs no sort.
FEATURE_BITS = 20
_U = np.uint64
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_LETTERS[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~(_LETTERS | _DIGIT | K._SPACE)
LAYOUT = ("log_words", "words_a_line", "upper", "digits", "marks", "repeats", "caps_words", "marked_words", "distinct", "lines")
_META_BUCKETS = 64


def features(texts: pa.Array, sources: list[str], langs: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, distinct word features, how many of each row, layout matrix, metadata matrix) of pieces of a batch."""
    buf, offsets = K.utf8(texts)
    for lo, hi, b, o in K.chunks(buf, offsets, PIECE):
        n = hi - lo
        words, ws, we, wc = K.word_hashes(b, o, inside=_LETTERS)
        tokens, ts, te, tc = K.word_hashes(b, o, lower=False)
        owner = np.repeat(np.arange(n), tc)
        upper, digit, mark = (_running(t[b]) for t in (_UPPER, _DIGIT, _MARK))
        letters = _running(_LETTERS[b])
        size, marks = te - ts, mark[te] - mark[ts]
        caps = (upper[te] - upper[ts] >= 3) & (upper[te] - upper[ts] == letters[te] - letters[ts])
        marked = (marks >= 2) & (size > marks)
        alone = (marks == size) & (size > 0)
        again = np.zeros(len(tokens), bool)
        again[1:] = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
        # words, and for tokens how they look: all capitals, said twice, the marks at their end
        shape = K.mix(np.where(caps, _U(11), np.where(again, _U(12), np.where(alone, _U(13) + tokens % _U(1 << 20), np.where(marked, _U(14), _U(15))))))
        words, shape = _feature(words), _feature(shape)
        all_, per = [], np.zeros(n, np.int64)
        wend, tend = np.cumsum(wc), np.cumsum(tc)
        distinct = np.zeros(n)
        for i in range(n):
            w = np.unique(words[wend[i] - wc[i] : wend[i]])
            distinct[i] = len(w) / max(1, wc[i])
            s = np.unique(shape[tend[i] - tc[i] : tend[i]])
            all_ += [w, s]
            per[i] = len(w) + len(s)
        length = np.maximum(np.diff(o), 1).astype(float)
        lines = np.diff(np.concatenate([[0], np.cumsum(b == 10)])[o]) + 1.0
        t = np.maximum(tc, 1).astype(float)
        by = lambda x: K.sum_by(x.astype(np.int64), tc) / t
        part = lambda c: (c[o[1:]] - c[o[:-1]]) / length
        measured = np.stack([np.log(t), np.log(t / lines), part(upper), part(digit), part(mark), by(again), by(caps), by(marked), distinct, np.log(lines)], 1)
        layout = np.concatenate([measured, measured**2], 1).astype(np.float32)
        chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        size = np.log1p(chars[o[1:]] - chars[o[:-1]])
        meta = np.zeros((n, 2 + 2 * _META_BUCKETS), np.float32)
        meta[:, 0], meta[:, 1] = size, size**2
        for i in range(n):
            meta[i, 2 + _bucket(sources[lo + i])] = 1
            meta[i, 2 + _META_BUCKETS + _bucket(langs[lo + i])] = 1
        yield lo, hi, np.concatenate(all_) if all_ else np.zeros(0, np.uint32), per, layout, meta


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - FEATURE_BITS)).astype(np.uint32)


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def _bucket(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % _META_BUCKETS


def present(found: np.ndarray, per: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Rows x chosen features, 1 where a row has the feature; chosen is sorted."""
    out = np.zeros((len(per), len(chosen)), np.float32)
    _mark(out, found, per, chosen)
    return out


def _mark(out: np.ndarray, found: np.ndarray, per: np.ndarray, chosen: np.ndarray) -> None:
    if not len(chosen):
        return
    for lo, hi, a, b in _row_blocks(per):
        i = np.minimum(np.searchsorted(chosen, found[a:b]), len(chosen) - 1)
        ok = chosen[i] == found[a:b]
        out[np.repeat(np.arange(lo, hi), per[lo:hi])[ok], i[ok]] = 1


def _row_blocks(per: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first feature, last feature + 1) of blocks of BLOCK_ROWS rows."""
    ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    for lo in range(0, len(per), BLOCK_ROWS):
        hi = min(lo + BLOCK_ROWS, len(per))
        yield lo, hi, int(ends[lo]), int(ends[hi])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1e-3, steps: int = 150, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights with the intercept last, by accelerated gradient descent on the mean logistic loss.

    rows: the rows of x that y and weight are of, all by default; they are copied once.
    """
    rows = np.arange(len(x)) if rows is None else rows
    a = np.ones((len(rows), x.shape[1] + 1), x.dtype)
    for lo in range(0, len(rows), BLOCK_ROWS):
        a[lo : lo + BLOCK_ROWS, :-1] = x[rows[lo : lo + BLOCK_ROWS]]
    sample = np.ones(len(y)) if weight is None else weight
    sample = (sample / sample.sum()).astype(a.dtype)
    w = np.zeros(a.shape[1], a.dtype)
    v = w.copy()
    norm = np.ones(a.shape[1], a.dtype) / math.sqrt(a.shape[1])
    for _ in range(8):
        norm = a.T @ (sample * (a @ norm))
        top = float(np.linalg.norm(norm)) or 1.0
        norm /= top
    step = 1.0 / (0.25 * top + decay)
    ridge = np.full(len(w), decay, a.dtype)
    ridge[-1] = 0
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        new = v - step * (a.T @ (sample * (p - y)) + ridge * v)
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _choose(found: np.ndarray, per: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Features that tell the classes apart best, by the chi-square statistic, sorted."""
    n, pos, size = len(y), float(y.sum()), 1 << FEATURE_BITS
    have, hit = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for lo, hi, a, b in _row_blocks(per):
        have += np.bincount(found[a:b], minlength=size)
        hit += np.bincount(found[a:b][np.repeat(y[lo:hi] > 0, per[lo:hi])], minlength=size)
    used = np.flatnonzero((have >= LEAST_ROWS) & (have <= n - LEAST_ROWS))
    have, hit = have[used].astype(float), hit[used].astype(float)
    expected = have * pos / max(n, 1)
    other = have - expected
    chi = (hit - expected) ** 2 / np.maximum(expected, 1e-9) + (hit - expected) ** 2 / np.maximum(other, 1e-9)
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(used[best[chi[best] > 0]]).astype(np.uint32)


def _text_view(found: np.ndarray, per: np.ndarray, layout: np.ndarray, model: dict) -> np.ndarray:
    k = len(model["chosen"])
    out = np.zeros((len(per), k + layout.shape[1]), np.float32)
    _mark(out, found, per, model["chosen"])
    out[:, k:] = ((layout - model["layout_mean"]) / model["layout_spread"]).clip(-8, 8)
    return out


def _page_view(meta: np.ndarray, model: dict) -> np.ndarray:
    return ((meta - model["mean"]) / model["spread"]).clip(-8, 8).astype(np.float32)


def co_train(found: np.ndarray, per: np.ndarray, layout: np.ndarray, meta: np.ndarray, y: np.ndarray, labelled: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS, exchanged: int = EXCHANGED, most: int = FEATURES) -> dict:
    """Fit both views.  y is 0 or 1 where labelled, with a row of each; other rows are the pool.  A third of each class calibrates.

    weight: of each row, 1 by default.  The only row of a class is both fitted and calibrated on.
    """
    weight = np.ones(len(y)) if weight is None else weight
    rows = np.flatnonzero(labelled)
    classes = [rows[y[rows] == c] for c in (0, 1)]
    hold = np.sort(np.concatenate([c[::3] for c in classes]))
    fit = np.union1d(np.setdiff1d(rows, hold), [c[0] for c in classes if len(c) == 1]).astype(np.int64)
    model = {"chosen": _choose(found[np.repeat(np.isin(np.arange(len(per)), fit), per)], per[fit], y[fit], most)}
    model |= {"mean": meta[fit].mean(axis=0), "spread": meta[fit].std(axis=0) + 1e-3, "layout_mean": layout[fit].mean(axis=0), "layout_spread": layout[fit].std(axis=0) + 1e-3}
    views = (_text_view(found, per, layout, model), _page_view(meta, model))
    known = [dict(zip(fit.tolist(), y[fit].tolist())) for _ in views]
    pool = set(np.flatnonzero(~labelled).tolist())
    share = float(np.average(y[fit], weights=weight[fit]))
    for r in range(rounds + 1):
        weights = []
        for x, k in zip(views, known):
            at = np.fromiter(k, np.int64)
            weights.append(fit_logistic(x, np.array([k[i] for i in at.tolist()], np.float32), weight[at], rows=at))
        if r == rounds or not pool:
            break
        free = np.array(sorted(pool))
        for v in range(2):
            z = log_odds(views[v][free], weights[v])
            order = np.argsort(z, kind="stable")
            n_pos = min(max(1, round(exchanged * share)), len(free) // 2)
            n_neg = min(max(1, exchanged - n_pos), len(free) // 2)
            # only what this view is sure of is passed on
            for i, label in [(i, 1.0) for i in order[::-1][:n_pos] if z[i] > 2] + [(i, 0.0) for i in order[:n_neg] if z[i] < -2]:
                known[1 - v].setdefault(int(free[i]), label)
                pool.discard(int(free[i]))
    z = np.stack([log_odds(x[hold], w) for x, w in zip(views, weights)], 1).astype(np.float64).clip(-15, 15)
    blend = fit_logistic(z, y[hold].astype(np.float64), weight[hold], decay=1e-4, steps=600)
    for v in range(2):  # a view that is no better than chance takes no part
        if blend[v] < 0:
            one = fit_logistic(z[:, [1 - v]], y[hold].astype(np.float64), weight[hold], decay=1e-4, steps=600)
            blend = np.zeros(3)
            blend[1 - v], blend[2] = one
            break
    score = 1 / (1 + np.exp(-log_odds(z, blend)))
    # calibration done, the views learn from the held rows as well
    page = views[1]
    del views, x
    model["chosen"] = _choose(found[np.repeat(labelled, per)], per[rows], y[rows], most)
    views = (_text_view(found, per, layout, model), page)
    weights = []
    for x, k in zip(views, known):
        k = k | dict(zip(hold.tolist(), y[hold].tolist()))
        at = np.fromiter(k, np.int64)
        weights.append(fit_logistic(x, np.array([k[i] for i in at.tolist()], np.float32), weight[at], rows=at))
    return model | {"text": weights[0], "page": weights[1], "blend": blend, "held_accuracy": float(np.average((score >= 0.5) == (y[hold] >= 0.5), weights=weight[hold])), "held_rows": len(hold)}


def view_scores(model: dict, found: np.ndarray, per: np.ndarray, layout: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the text view, of the metadata view, and of both combined."""
    t = log_odds(_text_view(found, per, layout, model), model["text"]).astype(np.float64)
    p = log_odds(_page_view(meta, model), model["page"]).astype(np.float64)
    both = log_odds(np.stack([t, p], 1).clip(-15, 15), model["blend"])
    return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (t, p, both))


def _columns(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> list[Column]:
    return [F.col(text_col).cast("string").alias("__text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__lang")]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> dict:
    """Models for both targets, {} for a target without labelled rows of both classes.

    A share of the labels is taken by hash, of each class at least a quarter of fit_rows or all its rows;
    what is taken beyond the share weighs less, so that classes keep their shares.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counts = marks.agg(F.count("*"), *[F.count_if(x) for t in ("quality", "toxic") for x in (F.col(t) >= 1, F.col(t) < 1)]).first()
    n_labels, n_docs = counts[0], docs.count()
    share = min(1.0, fit_rows / max(1, n_labels))
    rate = [min(1.0, fit_rows / 4 / max(1, n)) for n in counts[1:]]
    taken = F.greatest(F.lit(share), *[F.when(F.col(t) >= 1, a).when(F.col(t) < 1, b).otherwise(0.0) for t, a, b in (("quality", *rate[:2]), ("toxic", *rate[2:]))])
    u = F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(1 << 30))
    # at most about 1.5 x fit_rows rows of numbers
    picked = marks.where(u < taken * (1 << 30)).select("__id", F.col("quality").cast("double").alias("__quality"), F.col("toxic").cast("double").alias("__toxic"), (F.lit(share) / taken).alias("__weight"), F.lit(True).alias("__wanted"))
    plain = docs.select(F.col(id_col).cast("long").alias("__id"), *_columns(docs, text_col, source_col, lang_col)).where("__id is not null")
    kinds = "id long, quality double, toxic double, weight double, found binary, layout binary, meta binary"

    def run(batches):
        for batch in K.slices(batches):
            for lo, hi, found, per, layout, meta in features(batch.column(4), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                ends = np.cumsum(per)
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i)[lo:hi] for i in range(4)], pa.array([found[e - c : e].tobytes() for e, c in zip(ends, per)], pa.binary()), raw(layout), raw(meta)],
                    names=["id", "quality", "toxic", "weight", "found", "layout", "meta"],
                )

    in_pool = F.pmod(F.xxhash64(F.lit("pool"), "__id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, pool_rows / max(1, n_docs)))
    rows = plain.join(F.broadcast(picked), "__id", "left").where(F.coalesce("__wanted", in_pool))  # one pass over the documents
    made = rows.select("__id", "__quality", "__toxic", "__weight", "__text", "__source", "__lang").mapInArrow(run, kinds)
    # one row an id, the one with most features: at most about 1.5 x fit_rows + pool_rows rows go to the task that fits
    least = made.groupBy("id").agg(F.max(F.struct(F.length("found").alias("size"), "found", "layout", "meta", "quality", "toxic", "weight")).alias("r"))
    sample = least.select("id", "r.quality", "r.toxic", "r.weight", "r.found", "r.layout", "r.meta").repartition(1)
    model = sample.mapInArrow(lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(batches))], pa.binary())], names=["model"])]), "model binary").first()
    return pickle.loads(model[0]) if model else {"quality": {}, "toxic": {}}


def _fitted(batches: Iterator[pa.RecordBatch]) -> dict:
    """Models of both targets from the sample's rows (id, quality, toxic, weight, found, layout, meta), in whatever order they come."""
    parts = [(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), *(_numbers(batch.column(i), kind) for i, kind in ((4, np.uint32), (5, np.float32), (6, np.float32)))) for batch in batches if batch.num_rows]
    if not parts:
        return {"quality": {}, "toxic": {}}
    ids, quality, toxic, weight = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((ids, [hash_of(i) for i in ids]))  # so that the calibration third is a random one
    found, layout, meta = ([row for p in parts for row in p[i]] for i in (4, 5, 6))
    del parts
    per = np.array([len(found[i]) for i in order], np.int64)
    found = np.concatenate([found[i] for i in order])
    layout, meta = (np.stack([x[i] for i in order]) for x in (layout, meta))
    weight = np.nan_to_num(weight[order].astype(float), nan=1.0)
    out = {}
    for target, y in (("quality", quality[order].astype(float)), ("toxic", toxic[order].astype(float))):
        labelled = ~np.isnan(y)
        value = np.where(labelled, y >= 1, False).astype(np.float32)
        least = min(value[labelled].sum(), (1 - value[labelled]).sum()) if labelled.any() else 0
        out[target] = co_train(found, per, layout, meta, value, labelled, weight) if least else {}
    return out


def _numbers(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The numbers in each row of a binary column."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def hash_of(i: int) -> int:
    return (int(i) * 0x9E3779B97F4A7C15 + 0x1234567) * 0xBF58476D1CE4E5B9 >> 20 & 0xFFFFFFFF


def _judged(model: dict, texts: pa.Array, sources: list[str], langs: list[str], threshold: float, toxic_threshold: float) -> dict[str, np.ndarray]:
    parts = []
    for lo, hi, found, per, layout, meta in features(texts, sources, langs):
        n = hi - lo
        text, page, good = view_scores(model["quality"], found, per, layout, meta) if model["quality"] else (np.ones(n),) * 3
        bad = view_scores(model["toxic"], found, per, layout, meta)[2] if model["toxic"] else np.zeros(n)
        good = np.where(meta[:, 0] <= 0, 0.0, good)
        parts.append((text, page, good, bad, (good >= threshold) & (bad < toxic_threshold)))
    columns = zip(*parts) if parts else [[np.zeros(0)]] * 5
    return {name: np.concatenate(list(c)) for name, c in zip(("text_score", "page_score", "quality_score", "toxic_score", "kept"), columns)}


def scored(docs: DataFrame, model: dict, threshold: float = 0.5, toxic_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, text_score, page_score, quality_score, toxic_score, kept of every row.

    A null or empty text has quality_score 0 and is not kept; a target without a model scores 1 (quality) or
    0 (toxic).  A null source or language is a value of its own.  Repeated rows are scored as rows, texts as a whole,
    however long; an empty table gives an empty result.  Other input columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in K.slices(batches):
            got = _judged(shared.value, batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), threshold, toxic_threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c.astype(bool) if k == "kept" else c) for k, c in got.items()]], names=["doc_id", *got])

    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_columns(docs, text_col, source_col, lang_col))
    return inner.mapInArrow(run, "doc_id long, text_score double, page_score double, quality_score double, toxic_score double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """Fit on labels (doc_id, quality, toxic; repeated ids count at their worst) and score every row of docs.

    Null and empty texts, repeated rows and empty tables are as in scored().
    """
    return scored(docs, train(docs, labels, **names), **names)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, toxic_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps.  Only the decision comes back from Python.

    Null and empty texts go; repeated rows go or stay together; an empty table stays empty.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, source_col=source_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keep(text: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.array(_judged(shared.value, text, source.to_pylist(), lang.to_pylist(), threshold, toxic_threshold)["kept"].astype(bool))

    return docs.where(keep(*_columns(docs, text_col, source_col, lang_col))).select(*docs.columns)

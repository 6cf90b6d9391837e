"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order 5 over padded, lower-cased words (Kneser and
Ney, ICASSP 1995; Chen and Goodman 1999): counts at the highest order, continuation counts
below, one absolute discount an order.  The models are stored as sorted hash arrays, one an order for every
BLOCK languages: n-gram hash -> log probability in each of them, context hash -> log back-off weight in each of
them; so the arrays grow with the sum of the models, not with their number times their union.  A document gets the
language with the least cross-entropy a character.

Models are fitted on a bounded, documented sample of labelled training rows (FIT_ROWS a
language, chosen by hash), all words and all n-grams of it, for every language there is; so what goes to the
executors is bounded by the sample too.  Cross-entropies of a second such sample calibrate the score
(temperature) and the rejection threshold of each language.  A word's cross-entropy depends on the word only,
so workers compute it once a word and look it up after that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .shared import dropped, stored

ORDER, FIT_ROWS, CALIBRATION_ROWS = 5, 4000, 1000
#: So many languages share an array.
BLOCK = 8
_U = np.uint64
#: Bytes of a worker's memo of words; it is emptied when full.
_MEMO_BYTES = 96 << 20
#: Runs of letters; one of more than 256 counts as several words.
words_of = re.compile(r"[^\W\d_]{1,256}").findall
_last: list = []


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of padded words: code points, word of each, place in word, and hashes of the n-grams ending there and of their contexts.

    hashes[m] belong to order m + 1; a context is cut at the word's start.
    """
    text = "".join(f" {w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = K.mix(codes + _U(0x9E3779B97F4A7C15))
    hashes, contexts = [], []
    ctx = np.full(len(codes), 0x1234567, np.uint64)
    for m in range(order):
        hashes.append(K.mix(ctx * _U(0xD6E8FEB86659FD93) + mixed + _U(m)))
        contexts.append(K.mix(ctx + _U(m)))
        step = np.zeros(len(codes), np.uint64)
        step[m + 1 :] = mixed[: max(0, len(codes) - m - 1)]
        ctx = ctx + np.where(place > m, step * _U(pow(0x9E3779B97F4A7C15, m + 1, 1 << 64)) + _U(m + 1), _U(0))
    return codes, owner, place, hashes, contexts


def fit_kneser_ney(counts: dict[str, int], order: int) -> list[dict[str, np.ndarray]]:
    """For each order: gram hashes, their probabilities, context hashes, their back-off weights."""
    words = list(counts)
    _, owner, place, hashes, contexts = _grams(words, order)
    weight = np.array([counts[w] for w in words], np.float64)[owner]
    inner = place > 0  # the leading space is context only
    out: list[dict[str, np.ndarray]] = []
    n_codes = len(np.unique(hashes[0][inner])) + 1
    for m in range(order):
        g, c = hashes[m][inner], contexts[m][inner]
        grams, first, back = np.unique(g, return_index=True, return_inverse=True)
        if m == order - 1:
            n = np.bincount(back, weights=weight[inner])
        else:  # continuation counts: distinct longer n-grams that end with this one
            longer = np.unique(np.stack([hashes[m + 1][inner], back.astype(np.uint64)]), axis=1)[1].astype(np.int64)
            n = np.bincount(longer, minlength=len(grams)).astype(np.float64)
        n1, n2 = float((n == 1).sum()), float((n == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx_of = c[first]
        ctxs, which = np.unique(ctx_of, return_inverse=True)
        total = np.bincount(which, weights=n)
        gamma = np.bincount(which, weights=np.minimum(n, d)) / total
        if m == 0:
            lower = np.full(len(grams), 1.0 / n_codes)
        else:
            below = out[m - 1]
            lower = below["p"][np.searchsorted(below["grams"], hashes[m - 1][inner][first])]
        p = np.maximum(n - d, 0) / total[which] + gamma[which] * lower
        out.append({"grams": grams, "p": p, "n": n, "contexts": ctxs, "gamma": gamma, "below": hashes[m - 1][inner][first] if m else None, "in": which})
    return out


class Scorer:
    """The models of all languages together, in blocks of a few languages."""

    def __init__(self, model: dict):
        self.langs, self.order, self.blocks = model["langs"], model["order"], model["blocks"]
        self.size = 0
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)), np.float32)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
        return i, table[i] == keys if len(table) else np.zeros(len(keys), bool)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word (its end included) in every language."""
        _, owner, place, hashes, contexts = _grams(words, self.order)
        inner = np.flatnonzero(place > 0)
        parts = []
        for block in self.blocks:
            left, out = inner, np.zeros((len(owner), len(block["floor"])), np.float32)
            for m in range(self.order - 1, -1, -1):  # from the highest order down: the n-gram if a language has it, else back off
                t = block["tables"][m]
                i, ok = self._find(t["grams"], hashes[m][left])
                out[left[ok]] += t["logp"][i[ok]]
                left = left[~ok]
                j, seen = self._find(t["contexts"], contexts[m][left])
                out[left[seen]] += t["loggamma"][j[seen]]
            out[left] += block["floor"]
            total = np.zeros((len(words), len(block["floor"])), np.float32)
            np.add.at(total, owner, out)
            parts.append(total)
        return np.concatenate(parts, axis=1)

    def learn(self, words: set[str]) -> None:
        """Have all these words in the memo, which is emptied first if they don't fit beside what it holds."""
        new = [w for w in words if w not in self.at]
        cost = lambda: sum(map(len, new)) + len(new) * (4 * len(self.langs) + 160)
        if new and self.size + cost() > _MEMO_BYTES:
            self.at.clear()
            self.rows = np.zeros((1024, len(self.langs)), np.float32)
            self.size, new = 0, list(words)
        self.size += cost()
        while len(self.at) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        step = max(64, 80_000 // len(self.langs))
        for lo in range(0, len(new), step):
            part = new[lo : lo + step]
            k = len(self.at)
            self.rows[k : k + len(part)] = self.log_probabilities(part)
            self.at.update(zip(part, range(k, k + len(part))))

    def entropies(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """Cross-entropy (nats a character) in each language, and characters scored; None without a letter."""
        found = [words_of(t.lower()) if t else [] for t in texts]
        self.learn({w for ws in found for w in ws})
        out: list[tuple[np.ndarray, int] | None] = []
        for ws in found:
            if not any(c.isalpha() for w in ws for c in w):
                out.append(None)
                continue
            n = sum(map(len, ws)) + len(ws)
            out.append((-self.rows[list(map(self.at.__getitem__, ws))].sum(axis=0, dtype=np.float64) / n, n))
        return out


def _scorer(model: dict) -> Scorer:
    """The scorer of a broadcast model; a reused worker keeps it, with its memo, from task to task."""
    if not (_last and _last[0] is model):
        _last[:] = [model, Scorer(model)]
    return _last[1]


def _joint(langs: list[str], fitted: dict[str, list[dict]], order: int) -> dict:
    blocks = [_block([fitted[x] for x in langs[i : i + BLOCK]], order) for i in range(0, len(langs), BLOCK)]
    return {"langs": langs, "order": order, "blocks": blocks}


def _block(fitted: list[list[dict]], order: int) -> dict:
    """Sorted hash arrays of the n-grams that any of a few languages has, with a value for each of them: where a language lacks one, that of backing off."""
    floor = np.array([math.log(1.0 / (len(f[0]["grams"]) + 1)) for f in fitted], np.float32)
    tables: list[dict[str, np.ndarray]] = []
    for m in range(order):
        grams = np.unique(np.concatenate([f[m]["grams"] for f in fitted]))
        contexts = np.unique(np.concatenate([f[m]["contexts"] for f in fitted]))
        loggamma = np.zeros((len(contexts), len(fitted)), np.float32)
        below, ctx = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.int64)
        for k, one in enumerate(fitted):
            f = one[m]
            loggamma[np.searchsorted(contexts, f["contexts"]), k] = np.log(np.maximum(f["gamma"], 1e-12))
            i = np.searchsorted(grams, f["grams"])
            ctx[i] = np.searchsorted(contexts, f["contexts"][f["in"]])
            if m:
                below[i] = f["below"]
        lower = tables[m - 1]["logp"][np.searchsorted(tables[m - 1]["grams"], below)] if m else floor
        logp = (loggamma[ctx] + lower).astype(np.float32)
        for k, one in enumerate(fitted):
            logp[np.searchsorted(grams, one[m]["grams"]), k] = np.log(one[m]["p"])
        tables.append({"grams": grams, "logp": logp, "contexts": contexts, "loggamma": loggamma})
    return {"floor": floor, "tables": tables}


def train(training: DataFrame, order: int = ORDER, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Fit and calibrate on rows with text and language.  Bounds: fit_rows and calibration_rows a language, about.

    All languages are learned.  The driver fits one after another; it holds the n-grams of their samples.
    """
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    u = F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = lambda n: F.element_at(F.create_map(*[x for a in langs for x in (F.lit(a), F.lit(float(n) / sizes[a]))]), F.col("lang"))
    part = rows.withColumn("u", u)
    cut = F.least(share(fit_rows), F.lit(0.8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in K.slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((lang, w) for w in words_of(text.lower()))
            if len(seen) > 300_000:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    counted = stored(part.where(F.col("u") < cut).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    fitted = {}
    for x in langs:
        table = counted.where(F.col("lang") == x).select("word", "n").toArrow()
        fitted[x] = fit_kneser_ney(dict(sorted(zip(table["word"].to_pylist(), table["n"].to_pylist()))) or {"": 1}, order)
    dropped(counted)
    model = _joint(langs, fitted, order)
    held = part.where((F.col("u") >= cut) & (F.col("u") < cut + share(calibration_rows)))
    return _calibrated(model, held)


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "word", "n"])


def _calibrated(model: dict, held: DataFrame) -> dict:
    """Temperature and per-language rejection thresholds from cross-entropies of held rows."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in K.slices(batches):
            found = [(lang, e) for lang, e in zip(batch.column(0).to_pylist(), scorer.entropies(batch.column(1).to_pylist())) if e]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1][0].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[1][1] for f in found], pa.int64())], names=["lang", "h", "n"])

    rows = held.select("lang", "text").mapInArrow(run, "lang string, h array<double>, n long").toArrow()
    langs = model["langs"]
    temperature, most = 10.0, {x: float("inf") for x in langs}
    if rows.num_rows:
        h, y = np.array(rows["h"].to_pylist()), np.array([langs.index(x) for x in rows["lang"].to_pylist()])
        grid = np.geomspace(0.5, 200, 60)
        losses = []
        for t in grid:
            z = -h * t
            z -= z.max(axis=1, keepdims=True)
            losses.append(float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean()))
        temperature = float(grid[int(np.argmin(losses))])
        for k, x in enumerate(langs):
            own = h[y == k, k]
            if len(own) >= 20:
                most[x] = float(np.quantile(own, 0.995) + 3 * own.std())
    return model | {"temperature": temperature, "most": most}


def identified(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", passed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the passed columns, lang_pred, score, cross_entropy, rejected of every row.

    lang_pred is `und`, with score 0 and no cross-entropy, for a null text or one without a letter, and for
    every text if nothing could be learned.  score is the calibrated share of the predicted
    language.  rejected: the text is unlike that language's held rows, or und.
    """
    passed = passed or {}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in passed.items()], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        scorer = _scorer(shared.value) if shared.value["langs"] else None
        for batch in K.slices(batches):
            rows = []
            for e in scorer.entropies(batch.column(batch.num_columns - 1).to_pylist()) if scorer else [None] * batch.num_rows:
                if e is None:
                    rows.append(("und", 0.0, None, True))
                    continue
                h, _ = e
                k = int(np.argmin(h))
                z = np.exp(-(h - h[k]) * shared.value["temperature"])
                rows.append((scorer.langs[k], float(1 / z.sum()), float(h[k]), bool(h[k] > shared.value["most"][scorer.langs[k]])))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=[*batch.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, cross_entropy double, rejected boolean")


def in_fold(id_col: str, fold: int = 2, of: int = 4) -> Column:
    """crc32 of the id as text, modulo `of`, equals `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == fold, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected: learned from the rows that are not held out.

    Rows with a null language or text teach nothing; all rows, repeated ones too, are predicted.
    Other input columns are ignored; an empty table gives an empty result.
    """
    held = in_fold(id_col)
    model = train(docs.where(~held), order, fit_rows, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return identified(docs, model, id_col, text_col, {"held_out": held})

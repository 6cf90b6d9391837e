"""Exact BPE token counts at every prefix of a text, by dynamic programming.

A BPE encoding is valid exactly if each of its tokens encodes to itself and each
adjacent pair of tokens encodes to that pair.  So every prefix of a piece has one last
token, found from the last tokens of shorter prefixes:

    last[i] = the token t ending at i with (last[i - len t], t) compatible
    count[i] = count[i - len t] + 1

The vocabulary marks the end of a word (``</w>``), so a prefix counted as a text of its
own ends with a marked token; ``open`` tables hold the unmarked dynamic program and
``closed`` the marked last step.  The table of a piece is made once and looked up after
that; a text's table is the running sum over its pieces.  ``PrefixCounts`` then answers
counts, token budgets and truncation without encoding anything again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from . import textkit as K

LIMIT = 2048
#: The memos of pieces and of token pairs are emptied at so many entries; longer pieces are not kept, so their bytes are bounded too.
_MEMO_MOST, _MEMO_LONGEST = 500_000, 64
_WORD = re.compile(r"[^ \t\n\r]+")


class Vocabulary:
    """Tokens, merge ranks and pair compatibility of a word-end BPE file."""

    def __init__(self, path: str):
        self.path = path
        self.library = P.tokenizer(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.tokens = {t for t in model["vocab"] if t not in self.special}
        self.longest = max(map(len, self.tokens))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}
        self.counts: dict[str, int] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols, only to decide whether two tokens may stand together."""
        s = list(symbols)
        while len(s) > 1:
            r, i = min(((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(s, s[1:]))))
            if r == 1 << 60:
                break
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def fits(self, before: str | None, token: str) -> bool:
        ok = self._alone.get(token)
        if ok is None:
            ok = self._alone[token] = token in self.tokens and self.merged(self.symbols(token)) == [token]
        if not ok or before is None:
            return ok
        pair = (before, token)
        ok = self._pairs.get(pair)
        if ok is None:
            if len(self._pairs) > _MEMO_MOST:
                self._pairs.clear()
            ok = self._pairs[pair] = self.merged(self.symbols(before) + self.symbols(token)) == [before, token]
        return ok

    def table(self, piece: str, every: bool = True) -> list[int]:
        """Token counts of piece[:1], piece[:2], ... each closed as a text's last word; piece is in shown bytes."""
        n = len(piece)
        last: list[str | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        closed = []
        for i in range(1, n + 1):
            if every or i == n:
                closed.append(self._step(piece, i, last, count, self.end)[1])
            if i < n or not self.end:
                last[i], count[i] = self._step(piece, i, last, count, "")
        return closed

    def _step(self, piece, i, last, count, end):
        for size in range(1, min(i, self.longest) + 1):
            token = piece[i - size : i] + end
            if token in self.tokens and (i == size or last[i - size] is not None) and self.fits(last[i - size], token):
                return token, count[i - size] + 1
        return None, count[i - 1] + 1

    def count(self, piece: str) -> int:
        """Tokens of one piece."""
        have = self.counts.get(piece)
        if have is None:
            have = self.table(P.as_bytes_shown(piece), False)[-1]
            if len(piece) <= _MEMO_LONGEST:
                if len(self.counts) > _MEMO_MOST:
                    self.counts.clear()
                self.counts[piece] = have
        return have

    def pieces(self, segment: str) -> list[str]:
        """Pieces of a text without special strings, normalised."""
        if P.uncommon(segment):
            text = self.library.normalizer.normalize_str(segment)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return P.word_pieces_list(segment.lower())

    def total(self, text: str) -> int:
        """Tokens of a whole text, special strings in it counted as single tokens."""
        if not text:
            return 0
        get, count = self.counts.get, self.count
        out = 0
        for segment in self.split(text) if self.split and any(s in text for s in self.special) else (text,):
            if segment in self.special:
                out += 1
            else:
                pieces = self.pieces(segment)
                try:
                    out += sum(map(get, pieces))
                except TypeError:
                    out += sum(map(count, pieces))
        return out

    def text_table(self, text: str) -> "PrefixCounts":
        return PrefixCounts(self, text)


class PrefixCounts:
    """Counts at every code-point prefix of one text, and the answers that follow from them.

    Prefixes are of the text as it is given.  The text is a sequence of units, each counted once; a prefix is the
    running sum of the whole units before it and a part of one unit.  Units are the tokenizer's pieces, but for a word that holds
    a special string or whose normal form is not made character by character (composed or context-dependent
    characters): such a word is one unit, and only its own part is looked at again when a prefix cuts it.
    """

    def __init__(self, vocabulary: Vocabulary, text: str | None):
        self.v, self.text = vocabulary, text or ""
        low = self.text.lower()
        if not (P.uncommon(self.text) or any(s in self.text for s in vocabulary.special)) and len(low) == len(self.text):
            self.spans = [m.span() for m in P.word_pieces(low)]
            counts = (vocabulary.count(low[a:b]) for a, b in self.spans)
            self.odd: set[int] = set()
        else:
            self.spans, counts, self.odd = [], [], set()
            for m in _WORD.finditer(self.text):
                pieces = self._pieces(m[0])
                if pieces is None:
                    self.odd.add(len(self.spans))
                    pieces = [(0, len(m[0]), vocabulary.total(m[0]))]
                self.spans += [(m.start() + a, m.start() + b) for a, b, _ in pieces]
                counts += [n for *_, n in pieces]
        self.starts = [a for a, _ in self.spans]
        self.before = [0, *accumulate(counts)]

    def _pieces(self, word: str) -> list[tuple[int, int, int]] | None:
        """(start, end, tokens) of the pieces of a word without white space, if it is normalised character by character."""
        if any(s in word for s in self.v.special):
            return None
        if not P.uncommon(word):
            low = word.lower()
            return [(*m.span(), self.v.count(m[0])) for m in P.word_pieces(low)] if len(low) == len(word) else None
        normal = self.v.library.normalizer.normalize_str
        shown = normal(word)
        if len(shown) != len(word) or any(normal(a) != b for a, b in zip(word, shown)):
            return None
        return [(a, b, self.v.count(shown[a:b])) for _, (a, b) in self.v.library.pre_tokenizer.pre_tokenize_str(shown)]

    def at(self, prefix: int) -> int:
        """Tokens of text[:prefix]."""
        prefix = max(0, min(prefix, len(self.text)))
        k = bisect_right(self.starts, prefix - 1)
        if not k:
            return 0
        a, b = self.spans[k - 1]
        if prefix >= b:
            return self.before[k]
        # a piece cut short splits as ordinary text: an apostrophe's letters, for one
        return self.before[k - 1] + self.v.total(self.text[a:prefix])

    @property
    def total(self) -> int:
        return self.before[-1]

    def longest_within(self, budget: int) -> int:
        """Length of the longest prefix that ends with a whole unit and has at most `budget` tokens; all of the text if it fits."""
        k = bisect_right(self.before, budget) - 1
        return len(self.text) if k == len(self.spans) else (self.spans[k - 1][1] if k else 0)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def prefix_token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest whole-piece prefix within the limit).

    A null text counts as empty: 0 bytes, 0 tokens, fit_chars 0.  Texts are counted whole, however long.  Repeated
    rows are counted as rows; other input columns are ignored; an empty table gives an empty result.
    """
    path = path or P.vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in K.slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            totals = [v.total(t) for t in texts]
            fits = [len(t) if n <= limit else v.text_table(t).longest_within(limit) for t, n in zip(texts, totals)]
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")

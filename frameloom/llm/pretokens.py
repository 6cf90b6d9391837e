"""Splitting texts as public BPE tokenizers do, with a fast path for common scripts.

For texts of printable ASCII, Latin letters up to U+024F and general punctuation, the
character classes are written out, so the split cannot depend on a library's Unicode
version.  Any other text takes the tokenizer library's own normaliser and splitter.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_POINTS = [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]


def _ranges(first: str) -> str:
    out: list[list[int]] = []
    for c in _POINTS:
        if unicodedata.category(chr(c))[0] == first:
            if out and c == out[-1][1] + 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


_L, _N = _ranges("L"), _ranges("N")
#: A character outside the fast path.
uncommon = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞]").search
#: Pieces of the word-end BPE with 49k tokens, of normalised text.
word_pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+").finditer
word_pieces_list = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+").findall


@lru_cache(maxsize=4)
def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that byte-level BPE files write for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


def as_bytes_shown(piece: str) -> str:
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    table = byte_alphabet()
    return "".join(table[b] for b in piece.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizers library's object for a file, once a process, with one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)

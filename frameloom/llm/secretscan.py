"""Secret scanning with structural confirmation.

Three base kinds are plain patterns.  The structural kinds are reported only after the
candidate has been decoded and its structure holds:

* ``der``   base64 (on one line or wrapped over several) or hex text that decodes to a DER private key: lengths fill
            their parents exactly and the fields are those of PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA;
* ``jwt``   a signed token: two base64url JSON objects, the first with an "alg", then a signature;
* ``pem``   a PEM private-key block whose body decodes to DER or to the OpenSSH container;
* ``ssh``   an OpenSSH private key: the container's magic, then length-prefixed fields that fill it.

Public keys and certificates have none of these structures and are left alone.  Every pattern and
parser takes time in proportion to the text, whatever it holds: runs of an alphabet are found once, PEM
markers are paired by one scan, and a wrapped key is checked by its length fields alone.

Columns of a result row never hold the secrets, only kinds and code-point spans.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

KINDS = ("assign", "access", "hex", "der", "jwt", "pem", "ssh")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ANYHEX = re.compile(r"[0-9A-Fa-f]{48,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}"))
#: Lines of base64, the first of 20 characters or more; line ends may be spelled out, as in JSON.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:(?:\r?\n|\\+r\\+n|\\+n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}+")
_LINE = re.compile(r"(?:^|(?<=[\n \t])|(?<=\\n))[A-Za-z0-9+/_-]++")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]++")
_MARKER = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----")
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,.-]|\\++[nr])*+")
_WORDS = ("password", "passwd", "secret", "token", "api")
_OPENSSH = b"openssh-key-v1\0"
#: Object identifiers: password-based encryption (PKCS#5, PKCS#12), RSA, elliptic-curve keys.
_ENCRYPTED, _RSA, _EC = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")), bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
#: Bytes [at, at + n) of decoded data, fewer at its end.
Peek = Callable[[int, int], bytes]


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def base64_runs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the longest runs over the standard and over the url-safe alphabet; a run over both is given once."""
    for m in _BASE64.finditer(text):
        yield from sorted({c.span() for a in _ALPHABETS for c in a.finditer(text, *m.span())})


def der_fields(data: bytes, depth: int = 0) -> list[tuple[int, int]] | None:
    """(tag, length) of every field, nested ones included, if lengths fill the data exactly; else None."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data) or depth > 12:
            return None
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
        if i + n > len(data):
            return None
        out.append((tag, n))
        if tag & 0x20:
            inner = der_fields(data[i : i + n], depth + 1)
            if inner is None:
                return None
            out += inner
        i += n
    return out


def is_der_key(data: bytes | None) -> bool:
    """A sequence that fills the data, with an object identifier or an integer or octet string of 16 bytes or more in it.

    Enough where a PEM marker has already named the data a private key.
    """
    if not data or len(data) < 24 or data[0] != 0x30:
        return False
    fields = der_fields(data)
    return bool(fields) and any((t == 0x06 and n >= 3) or (t in (0x02, 0x03, 0x04) and n >= 16) for t, n in fields[1:])


def _field(peek: Peek, at: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of the field at `at`."""
    head = peek(at, 6)
    if len(head) < 2:
        return None
    tag, n, at = head[0], head[1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(head) < 2 + k:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), at + k
    return tag, at, at + n


def _fields(peek: Peek, at: int, end: int, most: int = 12) -> list[tuple[int, int, int]]:
    """The fields that fill [at, end) exactly; none at all if they don't, or are more than `most`."""
    out: list[tuple[int, int, int]] = []
    while at < end:
        f = _field(peek, at)
        if f is None or f[2] > end or len(out) == most:
            return []
        out.append(f)
        at = f[2]
    return out


def _is_private(peek: Peek, at: int, end: int) -> bool:
    """Whether [at, end) is one DER private key.  Reads heads of fields and object identifiers only."""
    top = _field(peek, at)
    if top is None or top[0] != 0x30 or top[2] != end:
        return False
    inner = _fields(peek, *top[1:])
    tags, sizes = [f[0] for f in inner], [f[2] - f[1] for f in inner]
    if tags[:2] == [0x30, 0x04]:  # PKCS#8, encrypted
        scheme = _fields(peek, *inner[0][1:])
        return len(tags) == 2 and sizes[1] >= 16 and bool(scheme) and scheme[0][0] == 0x06 and peek(scheme[0][1], 9).startswith(_ENCRYPTED)
    if len(tags) < 3 or tags[0] != 0x02 or sizes[0] != 1:
        return tags[:2] == [0x02, 0x04] and sizes[0] == 1 and peek(inner[0][1], 1) == b"\x01" and len(tags) == 2 and sizes[1] >= 16
    version = peek(inner[0][1], 1)[0]
    if tags[1] == 0x04:  # SEC1
        return version == 1 and sizes[1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8
        scheme = _fields(peek, *inner[1][1:])
        if version > 1 or not scheme or scheme[0][0] != 0x06 or sizes[2] < 16 or not set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
            return False
        name = peek(scheme[0][1], scheme[0][2] - scheme[0][1]) if scheme[0][2] - scheme[0][1] <= 16 else b""
        return _is_private(peek, *inner[2][1:]) if name in (_RSA, _EC) else True
    # PKCS#1 (nine integers; several primes add a sequence) and DSA (six)
    return version <= 1 and set(tags[:9]) == {0x02} and (tags[9:] == [] if version == 0 else tags[9:] == [0x30]) and len(tags) in (6, 9, 10) and sizes[1] >= 16


def _openssh_end(peek: Peek) -> int | None:
    """Where the OpenSSH container that starts at 0 ends."""
    if peek(0, len(_OPENSSH)) != _OPENSSH:
        return None
    at = len(_OPENSSH)
    for n in range(3):  # cipher, key derivation, its options
        at += 4 + int.from_bytes(peek(at, 4).ljust(4, b"\0"), "big")
    keys = int.from_bytes(peek(at, 4), "big")
    if not 1 <= keys <= 64:
        return None
    at += 4
    for n in range(keys + 1):  # public keys, then the private part
        size = peek(at, 4)
        if len(size) < 4:
            return None
        at += 4 + int.from_bytes(size, "big")
    return at


def _of(data: bytes) -> Peek:
    return lambda at, n: data[at : at + n]


def is_private_key(data: bytes | None) -> bool:
    return bool(data) and len(data) >= 24 and _is_private(_of(data), 0, len(data))


def is_ssh_key(data: bytes | None) -> bool:
    return bool(data) and data.startswith(_OPENSSH) and _openssh_end(_of(data)) == len(data)


def _json_object(text: str) -> dict | None:
    try:
        out = json.loads(unbase64(text) or b"")
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _is_header(text: str) -> bool:
    return isinstance((_json_object(text) or {}).get("alg"), str)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of header.body.signature.  The header is the end of its part of the run, from its first or last ``eyJ`` on."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 2 or "eyJ" not in run[0]:
            continue
        parts = run[0].split(".")
        ends, at = [], run.start()
        for p in parts:
            ends.append(at + len(p))
            at += len(p) + 1
        k = 0
        while k + 2 < len(parts):
            head, body, signature = parts[k : k + 3]
            starts = {head.find("eyJ"), head.rfind("eyJ")} - {-1}
            if starts and body.startswith("eyJ") and len(unbase64(signature) or b"") >= 16 and _json_object(body) is not None:
                good = [i for i in sorted(starts) if _is_header(head[i:])]
                if good:
                    yield ends[k] - len(head) + good[0], ends[k + 2]
                    k += 3
                    continue
            k += 1


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a private key's BEGIN to the END of the same label, no other marker between them, if the body decodes."""
    begin = None
    for m in _MARKER.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            body = text[begin.end() : m.start()]
            if begin[2] == m[2] and _PEM_BODY.fullmatch(body):
                lines = re.sub(r"\\++[nr]", "\n", body).split("\n")
                data = unbase64("".join("".join(x for x in lines if ":" not in x).split()))
                if is_der_key(data) or is_ssh_key(data):
                    yield begin.start(), m.end()
            begin = None


def wrapped_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of private keys in base64 over several lines, without markers.

    A key may begin with any line of a block.  Its first bytes tell its length, so it must end where a line does, and
    only heads of fields are decoded: the time for a line doesn't depend on how many follow.
    """
    for block in _WRAPPED.finditer(text):
        body = block[0]
        lines = [m.span() for m in _LINE.finditer(body)]
        joined = "".join(body[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
        ends, n = [], 0
        for a, b in lines:
            n += b - a
            ends.append(n)
        k = 0
        while k < len(lines) - 1:
            start = ends[k] - (lines[k][1] - lines[k][0])

            def peek(at: int, n: int, start=start) -> bytes:
                lo, hi = start + at // 3 * 4, start + -(-(at + n) // 3) * 4
                part = joined[lo:hi]
                if len(part) % 4 == 1:
                    part = part[:-1]
                return base64.b64decode(part + "=" * (-len(part) % 4))[at % 3 : at % 3 + n]

            size, kind = None, ""
            if joined.startswith("M", start):
                top = _field(peek, 0)
                size, kind = (top[2] if top else None), "der"
            elif joined.startswith("b3BlbnNzaC1r", start):
                size, kind = _openssh_end(peek), "ssh"
            if size is not None and size >= 24:
                last = bisect_left(ends, start + -(-size * 8 // 6))
                if k < last < len(ends) and ends[last] == start + -(-size * 8 // 6) and (kind == "ssh" or _is_private(peek, 0, size)):
                    end = block.start() + lines[last][1]
                    while text.startswith("=", end) and (end - block.start() - lines[last][1]) < 2:
                        end += 1
                    yield block.start() + lines[k][0], end, kind
                    k = last
            k += 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    if "-----BEGIN" in text:
        out += [(a, b, "pem") for a, b in pem_blocks(text)]
    if "eyJ" in text:
        out += [(a, b, "jwt") for a, b in signed_tokens(text)]
    for a, b in base64_runs(text):
        data = unbase64(text[a:b])
        if is_private_key(data):
            out.append((a, b, "der"))
        elif is_ssh_key(data):
            out.append((a, b, "ssh"))
    out += wrapped_keys(text)
    for m in _ANYHEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "der"))
    return out


def spans(text: str | None, long_word: bool = True) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, by start, then kind as listed.  long_word=False: no word has 20 bytes or more."""
    if not text:
        return [], []
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    if long_word:
        base, more = base_spans(text), structural_spans(text)
    else:
        low = text.lower()
        base = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in _WORDS) else []
        more = _pem_only(text)
    return sorted(base, key=order), sorted({*base, *more}, key=order)


def _pem_only(text: str) -> list[tuple[int, int, str]]:
    return [s for s in structural_spans(text) if s[2] == "pem"] if "-----BEGIN" in text else []


def shown(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with every span (overlapping ones together) replaced by [kind] of the first of them."""
    if not text or not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        a, b, kind = found[i]
        i += 1
        while i < len(found) and found[i][0] < b:
            b = max(b, found[i][1])
            i += 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _long_words(batch: pa.Array) -> list[bool]:
    """For each text, whether it has a word of 20 bytes or more; only those can hold keys or digests."""
    buf, offsets = K.utf8(batch)
    out: list[bool] = []
    for lo, hi, b, o in K.chunks(buf, offsets):
        starts, ends, counts = K.word_bounds(b, o)
        out += (K.sum_by((ends - starts >= 20).astype(np.int64), counts) > 0).tolist()
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_structural of every row.

    Null and empty texts have no spans.  A text of any length is scanned whole, in time in proportion to it.
    Repeated rows are scanned as rows; other input columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            rows = []
            for doc, text, long_word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _long_words(batch.column(1))):
                base, found = spans(text, long_word)
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((doc, *n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(found), len(found) - len(base)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_structural"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every secret in text_col replaced by its kind in brackets; length_col, if given, is set to the new length.

    All rows and columns stay, repeated rows as rows; a null text stays null, with its length as it was, and an
    empty text or table stays empty.  Texts are masked whole, however long.
    """

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: redacted(t, spans(t)[1]), na_action="ignore")

    out = docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
    if length_col:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)))
    return out

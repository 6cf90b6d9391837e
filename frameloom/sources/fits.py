"""FITS files: parsing and writing by the public standard, and their relations.

Files are read by Spark's ``binaryFile`` source, so any file system that Spark knows will do, and
decoded in Arrow batches.  ``frames()`` reads no more than headers, and ``written()`` writes in tasks, where pyarrow
knows the file system too; ``pixels()`` gives one row a sample, a block of rows at a time.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FRAMES, PIXELS

BLOCK, CARD = 2880, 80
_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
SUFFIXES = (".fits", ".fit", ".fts")


@dataclass
class Header:
    bools: dict[str, bool] = field(default_factory=dict)
    ints: dict[str, int] = field(default_factory=dict)
    floats: dict[str, float] = field(default_factory=dict)
    strings: dict[str, str] = field(default_factory=dict)
    dates: dict[str, str] = field(default_factory=dict)
    comments: list[str] = field(default_factory=list)
    history: list[str] = field(default_factory=list)


@dataclass
class Image:
    """Planar samples data[ch, y, x] with missing values NaN, and what the header said."""

    data: np.ndarray | None
    header: Header = field(default_factory=Header)
    bitpix: int = -32
    naxisn: tuple[int, ...] = ()
    exposure: float = 0.0


_VALUE = re.compile(r"\s*(?:'(?P<s>(?:[^']|'')*)'|(?P<b>[TF])|(?P<n>[+-]?(?:\d+\.?\d*|\.\d+)(?:[EeDd][+-]?\d+)?))?\s*(?:/.*)?$")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?$")


def unzipped(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def parse_header(raw: bytes) -> tuple[Header, int]:
    """The header and where the data begin.  Long strings continued on CONTINUE cards are joined."""
    h, at, last = Header(), 0, None
    while True:
        block = raw[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("header without END card")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key, rest = card[:8].strip(), card[8:]
            if key == "END" and not rest.strip():
                return h, at
            if key == "COMMENT":
                h.comments.append(rest.strip())
            elif key == "HISTORY":
                h.history.append(rest.strip())
            elif key == "CONTINUE" and last:
                m = _VALUE.match(rest)
                if m and m["s"] is not None and h.strings[last].endswith("&"):
                    h.strings[last] = h.strings[last][:-1] + m["s"].replace("''", "'").rstrip()
            elif rest.startswith("="):
                m = _VALUE.match(rest[1:])
                last = None
                if not m:
                    continue
                if m["s"] is not None:
                    text = m["s"].replace("''", "'").rstrip()
                    if _DATE.match(text):
                        h.dates[key] = text
                    else:
                        h.strings[key], last = text, key
                elif m["b"]:
                    h.bools[key] = m["b"] == "T"
                elif m["n"]:
                    if re.fullmatch(r"[+-]?\d+", m["n"]):
                        h.ints[key] = int(m["n"])
                    else:
                        h.floats[key] = float(m["n"].upper().replace("D", "E"))


def parse(raw: bytes, with_data: bool = True) -> Image:
    """A FITS file (plain or gzip).  BZERO and BSCALE are applied; promoted keys leave the header maps."""
    raw = unzipped(raw)
    h, at = parse_header(raw)
    if not h.bools.pop("SIMPLE", False):
        raise ValueError("not a FITS file: SIMPLE is not T")
    bitpix, naxis = h.ints.pop("BITPIX", None), h.ints.pop("NAXIS", None)
    if bitpix not in _TYPES or naxis is None:
        raise ValueError("BITPIX or NAXIS is missing or unknown")
    naxisn = tuple(h.ints.pop(f"NAXIS{i + 1}") for i in range(naxis))
    number = lambda k, d: h.floats.pop(k) if k in h.floats else float(h.ints.pop(k)) if k in h.ints else d
    bzero, bscale = number("BZERO", 0.0), number("BSCALE", 1.0)
    exposure = number("EXPOSURE", None)
    exposure = number("EXPTIME", 0.0) if exposure is None else exposure
    image = Image(None, h, bitpix, naxisn, exposure)
    if with_data:
        n = int(np.prod(naxisn)) if naxisn else 0
        v = np.frombuffer(raw, _TYPES[bitpix], n, at).astype(np.float32)
        if bscale != 1 or bzero != 0:
            v = (v * np.float32(bscale) + np.float32(bzero)).astype(np.float32)
        w, hgt = (naxisn[0], naxisn[1]) if naxis >= 2 else (naxisn[0] if naxisn else 0, 1)
        image.data = v.reshape(-1, hgt, w) if n else np.zeros((0, hgt, w), np.float32)
    return image


def _card(key: str, value, comment: str = "") -> str:
    key = key[:8]
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{int(value):>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value):>20.9G}"
    else:
        text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'"
    return f"{key:<8}= {text}{' / ' + comment if comment else ''}"[:CARD].ljust(CARD)


def _string_cards(key: str, value: str) -> list[str]:
    value = value.replace("'", "''")
    if len(value) <= 66:
        return [f"{key[:8]:<8}= '{value:<8}'".ljust(CARD)]
    parts = [value[i : i + 66] for i in range(0, len(value), 66)]
    out = []
    for i, p in enumerate(parts):
        more = "&" if i + 1 < len(parts) else ""
        out.append((f"{key[:8]:<8}= " if i == 0 else "CONTINUE  ") + f"'{p}{more}'")
    return [c.ljust(CARD) for c in out]


def encode(image: Image, compress: bool = False) -> bytes:
    """A file with BITPIX -32; NaN is written as 0, blocks are filled with zeros."""
    data = np.nan_to_num(np.asarray(image.data, np.float32), nan=0.0)
    shape = data.shape[::-1] if data.shape[0] > 1 else data.shape[:0:-1]
    cards = [_card("SIMPLE", True, "FITS standard"), _card("BITPIX", -32, "32-bit floating point"), _card("NAXIS", len(shape))]
    cards += [_card(f"NAXIS{i + 1}", n) for i, n in enumerate(shape)]
    if image.exposure:
        cards.append(_card("EXPOSURE", float(image.exposure), "seconds"))
    cards.append(_card("PROGRAM", "frameloom"))
    h = image.header
    for table in (h.bools, h.ints, h.floats):
        cards += [_card(k, v) for k, v in table.items()]
    for table in (h.strings, h.dates):
        cards += [c for k, v in table.items() if k != "PROGRAM" for c in _string_cards(k, v)]
    cards += [f"COMMENT {c}"[:CARD].ljust(CARD) for c in h.comments] + [f"HISTORY {c}"[:CARD].ljust(CARD) for c in h.history]
    head = ("".join(cards) + "END".ljust(CARD)).encode("ascii", "replace")
    body = data.astype(">f4").tobytes()
    out = head.ljust(-(-len(head) // BLOCK) * BLOCK, b" ") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
    return gzip.compress(out) if compress else out


def safe_path(pattern: str) -> str:
    """Refuse absolute paths and any that climb out of the base folder."""
    if pattern.startswith("/") or ":" in pattern or ".." in pattern.replace("\\", "/").split("/"):
        raise ValueError(f"unsafe path: {pattern}")
    return pattern


def decode_any(path: str, raw: bytes, with_data: bool = True) -> Image:
    from . import tiff

    name = path.lower()
    if name.endswith((".tif", ".tiff")):
        return tiff.parse(raw)
    return parse(raw, with_data)


def files(spark: SparkSession, patterns: list[str], base: str, first_id: int = 0) -> DataFrame:
    """frame_id, path: files of each pattern in turn, by name, numbered from first_id; no content is read."""
    found = None
    for i, p in enumerate(patterns):
        part = spark.read.format("binaryFile").load(f"{base.rstrip('/')}/{safe_path(p)}").select(F.lit(i).alias("pattern"), "path")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no file pattern")
    # one row a file: the numbering window is over file names only
    return found.withColumn("frame_id", (F.row_number().over(Window.orderBy("pattern", "path")) - 1 + first_id).cast("int")).select("frame_id", "path")


def _decoded(spark: SparkSession, patterns: list[str], base: str, first_id: int) -> DataFrame:
    ids = files(spark, patterns, base, first_id)
    raw = None
    for p in dict.fromkeys(patterns):
        part = spark.read.format("binaryFile").load(f"{base.rstrip('/')}/{safe_path(p)}").select("path", "content")
        raw = part if raw is None else raw.unionByName(part)
    return raw.dropDuplicates(["path"]).join(ids, "path").select("frame_id", "path", "content") if len(patterns) > 1 else raw.join(ids, "path").select("frame_id", "path", "content")


def file_system(uri: str):
    """(pyarrow's file system, path) of a URI that tasks can open by themselves; None if only Hadoop knows it."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    except (ValueError, OSError, ImportError):
        return None


def head(path: str) -> bytes:
    """The header blocks of a FITS file, plain or gzip; all of any other file."""
    system, name = file_system(path)
    with system.open_input_stream(name, compression=None) as f:
        if path.lower().endswith((".tif", ".tiff")):
            return f.read()
        first = f.read(2)
        unpack = zlib.decompressobj(31) if first == b"\x1f\x8b" else None
        out, more = b"", first
        while more:
            out += unpack.decompress(more) if unpack else more
            whole = len(out) // BLOCK * BLOCK
            if any(out[i : i + 8] == b"END     " for i in range(0, whole, CARD)):
                return out[:whole]
            more = f.read(BLOCK)
        return out


def frames(spark: SparkSession, patterns: list[str], base: str, first_id: int = 0) -> DataFrame:
    """FRAMES rows from headers."""
    by_tasks = file_system(base) is not None
    found = files(spark, patterns, base, first_id).withColumn("content", F.lit(None).cast("binary")) if by_tasks else _decoded(spark, patterns, base, first_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path, raw in zip(b["frame_id"], b["path"], b["content"]):
                m = decode_any(path, head(path) if by_tasks else raw, False)
                n = list(m.naxisn) + [1] * (3 - len(m.naxisn))
                header = {k: dict(getattr(m.header, k)) for k in ("bools", "ints", "floats", "strings", "dates")} | {"comments": m.header.comments, "history": m.header.history}
                rows.append((i, path, list(m.naxisn), n[0], n[1], n[2], m.bitpix, 0.0, 1.0, m.exposure, header))
            yield pd.DataFrame(rows, columns=FRAMES.names)

    return found.mapInPandas(run, FRAMES)


def pixels(spark: SparkSession, patterns: list[str], base: str, first_id: int = 0, rows_a_block: int = 1 << 18) -> DataFrame:
    """PIXELS rows of files; NaN becomes NULL."""
    return samples(_decoded(spark, patterns, base, first_id), rows_a_block)


def tiles(spark: SparkSession, patterns: list[str], base: str, first_id: int = 0) -> DataFrame:
    """The tiles of files (see operators.planes), without a row a pixel anywhere."""
    from ..operators import planes

    def run(batches):
        for b in batches:
            for i, path, raw in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                for row in planes.cut(decode_any(path, raw).data, i):
                    rows.append(row)
                    if len(rows) == 16:
                        yield planes.batch_of(rows)
                        rows = []
                if rows:
                    yield planes.batch_of(rows)

    return _decoded(spark, patterns, base, first_id).mapInArrow(run, planes.SCHEMA)


def samples(files: DataFrame, rows_a_block: int = 1 << 18) -> DataFrame:
    """PIXELS rows of (frame_id, path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, path, raw in zip(b["frame_id"], b["path"], b["content"]):
                data = decode_any(path, raw).data
                flat = data.reshape(-1)
                _, h, w = data.shape
                for lo in range(0, len(flat), rows_a_block):
                    at = np.arange(lo, min(len(flat), lo + rows_a_block))
                    v = flat[at]
                    out = pd.DataFrame({"frame_id": np.int32(i), "ch": (at // (h * w)).astype(np.int32), "y": (at // w % h).astype(np.int32), "x": (at % w).astype(np.int32), "v": v}, index=range(len(at)))
                    yield out.assign(v=pd.array(np.where(np.isnan(v), 0, v), dtype="Float32")).mask(np.isnan(v)[:, None] & (np.array(out.columns) == "v")[None, :])

    return files.mapInPandas(run, PIXELS)


def images(pixels: DataFrame, frames: DataFrame | None = None, encode_one=None) -> DataFrame:
    """frame_id, content: each frame's samples put together and encoded, in one task a frame."""
    encode_one = encode_one or (lambda data, exposure: encode(Image(data, exposure=exposure)))
    full = pixels.select(F.col("frame_id").cast("int"), "ch", "y", "x", F.col("v").cast("double"))
    full = full.join(frames.select(F.col("frame_id").cast("int"), F.col("exposure").cast("double")), "frame_id", "left") if frames is not None else full.withColumn("exposure", F.lit(0.0))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        c, y, x = (part[k].to_numpy() for k in ("ch", "y", "x"))
        data = np.full((c.max() + 1, y.max() + 1, x.max() + 1), np.nan, np.float32)
        data[c, y, x] = part["v"].to_numpy(float)
        e = part["exposure"].iloc[0]
        return pd.DataFrame({"frame_id": [key[0]], "content": [encode_one(data, 0.0 if e is None or e != e else float(e))]})

    return full.groupBy("frame_id").applyInPandas(run, "frame_id int, content binary")


def written(contents: DataFrame, folder: str, name_of) -> None:
    """Write each row of (frame_id, content) to folder/name_of(frame_id), replaced if it exists.

    Tasks write, each file under another name first, so that one that is run again does no harm.  Where only Hadoop knows
    the file system, the driver passes one file at a time.
    """
    folder = folder.rstrip("/")
    if file_system(folder) is None:
        for row in contents.toLocalIterator():
            write_bytes(contents.sparkSession, f"{folder}/{name_of(row.frame_id)}", bytes(row.content))
        return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, content in zip(b["frame_id"], b["content"]):
                system, path = file_system(f"{folder}/{name_of(i)}")
                system.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(content)
                system.move(part, path)
            yield pd.DataFrame({"n": [len(b)]})

    contents.mapInPandas(run, "n long").agg(F.sum("n")).collect()  # one number


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file through Hadoop's file systems, replaced if it exists."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for lo in range(0, len(content), 1 << 24):
            out.write(bytearray(content[lo : lo + (1 << 24)]))
    finally:
        out.close()

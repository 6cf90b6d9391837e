"""Baseline TIFF: uncompressed 8 and 16 bit, one channel or RGB."""

from __future__ import annotations

import struct

import numpy as np

from .fits import Image

_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


def parse(raw: bytes) -> Image:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(order + "HHII", raw[at + 2 + 12 * i : at + 14 + 12 * i])
        if kind in _SIZES:
            code, size = _SIZES[kind]
            where = at + 10 + 12 * i if n * size <= 4 else struct.unpack(order + "I", raw[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = list(struct.unpack(f"{order}{n}{code}", raw[where : where + n * size]))
    w, h = tags[256][0], tags[257][0]
    bits, samples = tags.get(258, [1])[0], tags.get(277, [1])[0]
    if tags.get(259, [1])[0] != 1 or bits not in (8, 16) or samples not in (1, 3):
        raise ValueError("only uncompressed TIFF of 8 or 16 bits with 1 or 3 channels is read")
    data = b"".join(raw[o : o + n] for o, n in zip(tags[273], tags[279]))
    v = np.frombuffer(data, np.dtype("u1") if bits == 8 else np.dtype(order + "u2"), w * h * samples).astype(np.float32)
    planar = tags.get(284, [1])[0] == 2
    v = v.reshape(samples, h, w) if planar else v.reshape(h, w, samples).transpose(2, 0, 1)
    return Image(np.ascontiguousarray(v), bitpix=bits, naxisn=(w, h) if samples == 1 else (w, h, samples))


def levels(data: np.ndarray, low: float, high: float, gamma: float, top: int) -> np.ndarray:
    """(v - low) / (high - low) clamped to [0, 1], to the power 1 / gamma, times top; NaN is 0.  Shape (y, x, ch)."""
    v = (np.asarray(data, float) - low) / ((high - low) or 1.0)
    v = np.clip(np.nan_to_num(v, nan=0.0), 0, 1)
    return np.rint(v ** (1 / gamma) * top).transpose(1, 2, 0)


def encode(data: np.ndarray, low: float, high: float, gamma: float = 1.0, bits: int = 16) -> bytes:
    ch, h, w = data.shape
    ch = 3 if ch >= 3 else 1
    body = levels(data[:ch], low, high, gamma, (1 << bits) - 1).astype("<u2" if bits == 16 else "u1").tobytes()
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * ch), (259, 3, [1]), (262, 3, [2 if ch == 3 else 1]), (273, 4, [0]), (277, 3, [ch]), (278, 4, [h]), (279, 4, [len(body)]), (284, 3, [1])]
    at = 8 + 2 + 12 * len(entries) + 4
    extra = b""
    out = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries))
    data_at = at + (6 if ch == 3 else 0)
    for tag, kind, values in entries:
        if tag == 273:
            values = [data_at]
        code = "H" if kind == 3 else "I"
        packed = struct.pack(f"<{len(values)}{code}", *values)
        if len(packed) > 4:
            out += struct.pack("<HHII", tag, kind, len(values), at + len(extra))
            extra += packed
        else:
            out += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return out + b"\0\0\0\0" + extra + body

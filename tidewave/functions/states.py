"""States as bytes: nested tuples of numbers, arrays and nothing, in a fixed layout that does not depend on classes and runs no code when read.

A header of three bytes, then one item: a tag and its contents, little-endian. Tags: ``n`` nothing, ``f`` a double, ``i`` a 64-bit integer, ``d`` and ``l`` an array of
doubles or integers (a count of dimensions, their lengths, the values), ``b`` bytes, ``t`` a tuple (its length, its items).
"""

from __future__ import annotations

import struct

import numpy as np

HEADER = b"TW1"
_KINDS = {b"d": np.dtype("<f8"), b"l": np.dtype("<i8")}


def pack(state) -> bytes:
    out = [HEADER]
    _put(state, out)
    return b"".join(out)


def _put(x, out: list[bytes]) -> None:
    if x is None:
        out.append(b"n")
    elif isinstance(x, (tuple, list)):
        out.append(b"t" + struct.pack("<I", len(x)))
        for v in x:
            _put(v, out)
    elif isinstance(x, np.ndarray):
        tag = b"l" if np.issubdtype(x.dtype, np.integer) else b"d"
        out.append(tag + struct.pack(f"<B{x.ndim}q", x.ndim, *x.shape) + np.ascontiguousarray(x, _KINDS[tag]).tobytes())
    elif isinstance(x, bytes):
        out.append(b"b" + struct.pack("<q", len(x)) + x)
    elif isinstance(x, (bool, int, np.integer)):
        out.append(b"i" + struct.pack("<q", int(x)))
    elif isinstance(x, (float, np.floating)):
        out.append(b"f" + struct.pack("<d", float(x)))
    else:
        raise TypeError(f"a state holds no {type(x).__name__}")


def unpack(data: bytes):
    data = bytes(data)
    if data[:3] != HEADER:
        raise ValueError("no saved state, or one of another layout")
    x, at = _take(data, 3)
    if at != len(data):
        raise ValueError("a saved state with more after it")
    return x


def _take(data: bytes, at: int):
    tag, at = data[at : at + 1], at + 1
    if tag == b"n":
        return None, at
    if tag == b"f":
        return struct.unpack_from("<d", data, at)[0], at + 8
    if tag == b"i":
        return struct.unpack_from("<q", data, at)[0], at + 8
    if tag == b"b":
        (n,) = struct.unpack_from("<q", data, at)
        return data[at + 8 : at + 8 + n], at + 8 + n
    if tag == b"t":
        (n,), at, out = struct.unpack_from("<I", data, at), at + 4, []
        for _ in range(n):
            x, at = _take(data, at)
            out.append(x)
        return tuple(out), at
    if tag in _KINDS:
        dims = data[at]
        shape = struct.unpack_from(f"<{dims}q", data, at + 1)
        at += 1 + 8 * dims
        n = int(np.prod(shape, dtype=np.int64))
        return np.frombuffer(data, _KINDS[tag], n, at).reshape(shape).copy(), at + 8 * n
    raise ValueError("no saved state, or one of another layout")

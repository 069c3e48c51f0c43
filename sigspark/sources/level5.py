"""The numeric file format of level 5: named variables of numbers, text, cells and structures, nested to any depth.

A structure is a list of dicts, one an element; a cell array a list; text a string (or a list of them, one a row);
numbers an array of their shape. Elements may be compressed, and of either byte order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Fixed values of the format: numbers by the kind of an element, kinds of elements, classes of matrices.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCTURE, TEXT, SPARSE, DOUBLE = 1, 2, 4, 5, 6
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
HEAD = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H2s", 0x0100, b"IM")


def elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(kind, body) of elements behind one another."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # a short element: both in one word, the body in the next
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def numbers(kind: int, body: bytes, order: str) -> np.ndarray:
    return np.frombuffer(body, np.dtype(order + NUMBERS[kind]))


def letters(kind: int, body: bytes, order: str) -> str:
    if kind in TEXTS:
        return body.decode(TEXTS[kind] + ("" if kind == 16 else "-le" if order == "<" else "-be"))
    return "".join(map(chr, numbers(kind, body, order).tolist()))


def matrix(body: bytes, order: str) -> tuple[str, object]:
    """(name, value)."""
    if not body:
        return "", np.empty((0, 0))
    parts = elements(body, order)
    flags = numbers(*next(parts), order)
    what = int(flags[0]) & 0xFF
    shape = tuple(numbers(*next(parts), order).tolist())
    name, count = next(parts)[1].decode("latin-1"), int(np.prod(shape))
    if what == CELL:
        return name, [matrix(next(parts)[1], order)[1] for _ in range(count)]
    if what == STRUCTURE:
        width = int(numbers(*next(parts), order)[0])
        told = next(parts)[1]
        fields = [told[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(told), width)]
        return name, [{f: matrix(next(parts)[1], order)[1] for f in fields} for _ in range(count)]
    if what == TEXT:
        text = letters(*next(parts, (16, b"")), order)
        rows = ["".join(text[i :: shape[0]]) for i in range(shape[0])] if shape and shape[0] > 1 else [text]
        return name, rows if len(rows) > 1 else rows[0]
    if what not in CLASSES:
        raise ValueError(f"{name}: matrices of class {what} are not known")
    real = numbers(*next(parts, (9, b"")), order).astype(CLASSES[what])
    if int(flags[0]) & 0x800:
        real = real + 1j * numbers(*next(parts), order)
    return name, real.reshape(shape, order="F")


def read(raw: bytes) -> dict[str, object]:
    """The variables of a file."""
    order = {b"IM": "<", b"MI": ">"}.get(raw[126:128])
    if order is None:
        raise ValueError("not a file of level 5")
    out, waiting = {}, [raw[128:]]
    while waiting:
        for kind, body in elements(waiting.pop(), order):
            if kind == COMPRESSED:
                waiting.append(zlib.decompress(body))
            elif kind == MATRIX:
                name, value = matrix(body, order)
                out[name] = value
    return out


def element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def variable(name: str, value: object) -> bytes:
    """A matrix of numbers (a number, or an array of one or two dimensions), text, a cell array (list) or a structure (list of
    dicts, or a dict)."""
    value = [value] if isinstance(value, dict) else value
    if isinstance(value, str):
        code, shape, rest = TEXT, (1, len(value)), element(4, value.encode("utf-16-le"))
    elif isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        fields = list(value[0])
        width = max(map(len, fields)) + 1
        rest = element(5, struct.pack("<i", width)) + element(1, b"".join(f.encode().ljust(width, b"\0") for f in fields))
        code, shape, rest = STRUCTURE, (1, len(value)), rest + b"".join(variable("", x[f]) for x in value for f in fields)
    elif isinstance(value, list):
        code, shape, rest = CELL, (1, len(value)), b"".join(variable("", x) for x in value)
    else:
        value = np.atleast_2d(np.asarray(value, np.float64))
        code, shape, rest = DOUBLE, value.shape, element(9, value.astype("<f8").tobytes("F"))
    return element(MATRIX, element(6, struct.pack("<II", code, 0)) + element(5, struct.pack("<2i", *shape)) + element(1, name.encode()) + rest)


def packed(variables: dict[str, object], compress: bool = True) -> bytes:
    """A file of variables."""
    parts = [variable(n, v) for n, v in variables.items()]
    if compress:
        parts = [struct.pack("<II", COMPRESSED, len(z)) + z for z in map(zlib.compress, parts)]
    return HEAD + b"".join(parts)

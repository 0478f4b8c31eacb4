"""Size, mode and bits a sample of image files from their headers: PNG, JPEG, BMP, GIF and TIFF.

Modes are named L, LA, P, RGB, RGBA, CMYK and 1; samples of more than 8 bits, or floating point, are `deep`.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import NamedTuple


class Header(NamedTuple):
    format: str
    width: int
    height: int
    mode: str
    bits: int
    deep: bool


_BY_SAMPLES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}


def _png(read: Callable[[int, int], bytes]) -> Header | None:
    head = read(0, 26)
    if head[12:16] != b"IHDR":
        return None
    width, height, bits, kind = struct.unpack(">IIBB", head[16:26])
    mode = {0: "1" if bits == 1 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind)
    return Header("PNG", width, height, mode, bits, bits > 8) if mode else None


def _jpeg(read: Callable[[int, int], bytes]) -> Header | None:
    at = 2
    while True:
        head = read(at, 10)
        if len(head) < 10 or head[0] != 0xFF:
            return None
        kind = head[1]
        if kind == 0xFF:  # fill byte
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame; the others are tables
            bits, height, width, parts = struct.unpack(">BHHB", head[4:10])
            mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(parts)
            return Header("JPEG", width, height, mode, bits, bits > 8) if mode else None
        else:
            at += 2 + struct.unpack(">H", head[2:4])[0]


def _bmp(read: Callable[[int, int], bytes]) -> Header | None:
    head = read(0, 30)
    if len(head) < 30:
        return None
    if struct.unpack("<I", head[14:18])[0] == 12:
        width, height, _, bits = struct.unpack("<HHHH", head[18:26])
    else:
        width, height, _, bits = struct.unpack("<iiHH", head[18:30])
    mode = "1" if bits == 1 else "P" if bits <= 8 else "RGBA" if bits == 32 else "RGB"
    return Header("BMP", width, abs(height), mode, min(bits, 8), False)


def _gif(read: Callable[[int, int], bytes]) -> Header | None:
    head = read(0, 10)
    return Header("GIF", *struct.unpack("<HH", head[6:10]), "P", 8, False) if len(head) == 10 else None


def _tiff(read: Callable[[int, int], bytes]) -> Header | None:
    order = "<" if read(0, 2) == b"II" else ">"
    at = struct.unpack(order + "I", read(4, 4))[0]
    count = struct.unpack(order + "H", read(at, 2))[0]
    table = read(at + 2, 12 * count)
    found: dict[int, list[int]] = {}
    for i in range(count):
        tag, kind, n = struct.unpack(order + "HHI", table[12 * i : 12 * i + 8])
        size = {1: 1, 3: 2, 4: 4}.get(kind)
        if size is None or tag not in (256, 257, 258, 262, 277, 338, 339) or n > 64:
            continue
        raw = table[12 * i + 8 : 12 * i + 12]
        if size * n > 4:
            raw = read(struct.unpack(order + "I", raw)[0], size * n)
        found[tag] = list(struct.unpack(f"{order}{n}{ {1: 'B', 2: 'H', 4: 'I'}[size]}", raw[: size * n]))
    first = lambda tag, default: found.get(tag, [default])[0]
    bits, samples, colour = max(found.get(258, [1])), first(277, 1), first(262, 1)
    floating = 3 in found.get(339, [])
    mode = "P" if colour == 3 else "CMYK" if colour == 5 else "1" if samples == 1 and bits == 1 else _BY_SAMPLES.get(samples)
    return Header("TIFF", first(256, 0), first(257, 0), mode, bits, bits > 8 or floating) if mode else None


_KINDS = ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8\xff", _jpeg), (b"BM", _bmp), (b"GIF8", _gif), (b"II*\0", _tiff), (b"MM\0*", _tiff))


def inspect(read: Callable[[int, int], bytes]) -> Header | None:
    """The header of an image, or None for anything else.  `read(at, n)` gives up to n bytes from a position."""
    head = read(0, 8)
    for magic, of in _KINDS:
        if head.startswith(magic):
            try:
                return of(read)
            except (struct.error, KeyError, ValueError):
                return None
    return None

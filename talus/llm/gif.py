"""The GIF format in numpy: LZW code streams, palettes, disposal, transparency, timed frames.

LZW is decoded a table's life at a time. Between two clear codes the width of
each code depends on its place alone, so all codes are cut out of the bit
stream at once. The entry that a code refers to is a stretch of the output
itself (it begins where an earlier code's string begins), so every output pixel
points at an earlier pixel; following these pointers by doubling resolves a
whole table's life in a few steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MOST_CODES = 4096
#: Pixels of the largest canvas or frame that is decoded: 64 MB of RGBA. A header can name 65535 x 65535 in a few bytes.
MOST_PIXELS = 1 << 24
#: Pixels of a table's life that are built at once.
_PIECE = 1 << 18


def _widths(min_size: int, n: int) -> np.ndarray:
    """Bits of the k-th code after a clear code."""
    size = np.arange(n) + (1 << min_size) + 1
    return np.minimum(12, np.frexp(size.astype(np.float64))[1]).astype(np.int64)


_WIDTHS = {m: _widths(m, MOST_CODES + 2) for m in range(1, 9)}
_PLACES = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in _WIDTHS.items()}


def lzw_encode(pixels: bytes) -> bytes:
    """The code stream of 8-bit pixels."""
    codes, table, free = [256], {}, 258
    places = [0]  # of the codes since the last clear code
    if pixels:
        rest = iter(pixels)
        prefix = next(rest)
        get, put = table.get, codes.append
        for b in rest:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if free < MOST_CODES:
                table[key] = free
                free += 1
            else:
                put(256)
                places.append(len(codes) - 1)
                table.clear()
                free = 258
            prefix = b
        put(prefix)
    codes.append(257)
    number = np.arange(len(codes)) - np.repeat(places, np.diff([*places, len(codes)])) - 1
    # a clear code still has the width of its place in the life before it
    number[places[1:]] = np.diff(places) - 1
    number[0] = 0
    width = _WIDTHS[8][number]
    bits = (np.array(codes, np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)).astype(np.uint8) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def _strings(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The pixels of the codes of one table's life, so many at most (but the last code's string is whole).

    Lengths are known before any pixel: codes beyond ``most`` are cut off first, and
    pixels are built ``_PIECE`` at a time, so a small stream that stands for very many takes little memory.
    """
    place = np.arange(len(codes))
    literal = codes < clear
    refers = np.where(literal, place, codes - clear - 2)
    if (refers > place).any() or (refers[~literal] == place[~literal]).any() or (codes == clear + 1).any():
        raise ValueError("an LZW code refers to a later entry")
    length, step = np.where(literal, 0, 1), refers
    while (more := length[step]).any():
        length = length + more
        step = step[step]
    length = length + 1
    ends = np.cumsum(length)
    n = min(len(codes), int(np.searchsorted(ends, most)) + 1)
    codes, literal, refers, length, ends = (x[:n] for x in (codes, literal, refers, length, ends))
    start = ends - length
    source = np.where(literal, start, start[refers])
    out = np.zeros(int(ends[-1]), np.uint8)
    i = 0
    while i < n:
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
        own = np.arange(int(ends[j - 1]) - low)
        points = np.repeat(source[i:j] - start[i:j], length[i:j]) + own
        known = np.zeros(len(own), np.uint8)
        before = points < 0  # strings of earlier pieces
        known[before] = out[points[before] + low]
        points[before] = own[before]
        known[start[i:j][literal[i:j]] - low] = codes[i:j][literal[i:j]]
        while (points != (far := points[points])).any():
            points = far
        out[low : low + len(own)] = known[points]
        i = j
    return out


def lzw_decode(raw: bytes, min_size: int, pixels: int) -> np.ndarray:
    """At most so many pixels of a code stream; a stream that breaks off gives what it has."""
    if min_size not in _WIDTHS:
        raise ValueError(f"an LZW code size of {min_size}")
    clear, widths, places = 1 << min_size, _WIDTHS[min_size], _PLACES[min_size]
    b = np.frombuffer(raw + bytes(4), np.uint8).astype(np.uint32)
    window = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    total, at, have, out = 8 * len(raw), 0, 0, []
    while at < total and have < pixels:
        life: list[np.ndarray] = []
        k, stop = 0, None
        while stop is None and at < total:
            n = len(widths) - 1 - k if k < MOST_CODES else MOST_CODES
            width = widths[k : k + n] if k < MOST_CODES else np.full(n, 12)
            place = at + (places[k : k + n] - places[k] if k < MOST_CODES else 12 * np.arange(n))
            fits = int(np.searchsorted(place + width, total, "right"))
            place, width = place[:fits], width[:fits]
            if not fits:
                at = total
                break
            codes = ((window[place >> 3] >> (place & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)).astype(np.int64)
            ends = (codes == clear) | (codes == clear + 1)
            i = int(ends.argmax()) if ends.any() else fits
            life.append(codes[:i])
            if i < fits:
                stop = codes[i]
                at = int(place[i] + width[i])
            else:
                k, at = k + fits, int(place[-1] + width[-1])
            if stop is None and sum(map(len, life)) >= pixels - have:
                stop = clear + 1  # each code stands for a pixel at least
        if life and len(own := np.concatenate(life)):
            out.append(_strings(own, clear, pixels - have))
            have += len(out[-1])
        if stop == clear + 1:
            break
    return np.concatenate(out)[:pixels] if out else np.zeros(0, np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    #: The whole canvas as it is shown, (height, width, 4) with alpha 0 or 255.
    canvas: np.ndarray


def _blocks(media: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := media[at]) != 0:
        if at + 1 + n > len(media):
            raise ValueError("a block breaks off")
        parts.append(media[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def decode(media: bytes) -> Iterator[Frame]:
    """The frames in order, each as the whole canvas shows it."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    width, height, flags = int.from_bytes(media[6:8], "little"), int.from_bytes(media[8:10], "little"), media[10]
    at = 13

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        table = np.zeros((256, 3), np.uint8)
        table[:n] = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table

    overall = palette(flags & 7) if flags & 0x80 else np.zeros((256, 3), np.uint8)
    if width * height > MOST_PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            kind = media[at + 1]
            data, at = _blocks(media, at + 2)
            if kind == 0xF9:
                disposal, delay = data[0] >> 2 & 7, int.from_bytes(data[1:3], "little")
                clear_index = data[3] if data[0] & 1 else None
            continue
        if media[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h = (int.from_bytes(media[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
        own_flags = media[at + 9]
        at += 10
        colours = palette(own_flags & 7) if own_flags & 0x80 else overall
        min_size = media[at]
        data, at = _blocks(media, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError(f"a frame of {w} x {h}")
        index = lzw_decode(data, min_size, w * h)
        if len(index) < w * h:
            raise ValueError("a code stream breaks off")
        index = index.reshape(h, w)
        if own_flags & 0x40:
            rows = np.concatenate([np.arange(a, h, b) for a, b in _PASSES])
            plain = np.empty_like(index)
            plain[rows] = index
            index = plain
        shown = np.ones((h, w), bool) if clear_index is None else index != clear_index
        before = canvas.copy() if disposal == 3 else None
        h, w = max(0, min(h, height - top)), max(0, min(w, width - left))
        part = canvas[top : top + h, left : left + w]
        if clear_index is None:
            part[..., :3], part[..., 3] = colours[index[:h, :w]], 255
        else:
            shown = shown[:h, :w]
            part[shown, :3], part[shown, 3] = colours[index[:h, :w][shown]], 255
        yield Frame(left, top, w, h, delay, disposal, canvas.copy())
        if disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


#: Pixels in a row, and rows in a frame, of stored bytes.
WIDTH, ROWS, DELAY_CS = 64, 1024, 4
#: One colour for each byte: three bits of red, three of green, two of blue.
_BYTE = np.arange(256)
PALETTE = np.stack([(_BYTE >> 5) * 36, (_BYTE >> 2 & 7) * 36, (_BYTE & 3) * 85], 1).astype(np.uint8)


def encode_bytes(payload: bytes) -> bytes:
    """Bytes as the pixels of timed frames, 64 in a row; the length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(rows, ROWS).to_bytes(2, "little"), bytes([0xF7, 0, 0]), PALETTE.tobytes()]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for first in range(0, rows, ROWS):
        own = payload[first * WIDTH : (first + ROWS) * WIDTH]
        out.append(bytes([0x21, 0xF9, 4, 1 << 2]) + DELAY_CS.to_bytes(2, "little") + b"\x00\x00")
        out.append(b"\x2c\x00\x00\x00\x00" + WIDTH.to_bytes(2, "little") + (len(own) // WIDTH).to_bytes(2, "little") + b"\x00\x08")
        codes = lzw_encode(own)
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\x00")
    out.append(b"\x3b")
    return b"".join(out)


def frame_bytes(frame: Frame) -> bytes:
    """The bytes that a frame of encode_bytes shows."""
    seen = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
    return (seen[..., 0] // 36 << 5 | seen[..., 1] // 36 << 2 | seen[..., 2] // 85).astype(np.uint8).tobytes()


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels of each of 64 colours: two bits of each channel."""
    top = canvas[..., :3] >> 6
    colour = top[..., 0] << 4 | top[..., 1] << 2 | top[..., 2]
    return np.bincount(colour[canvas[..., 3] > 0], minlength=64)

"""Code streams that stand for far more pixels than a frame has, and streams without clear codes."""

import random
import tracemalloc

import numpy as np
import pytest

from talus.llm import gif


def packed(codes, size):
    """A code stream; after the first clear code widths grow with the table, as the format says."""
    bits, free, width = [], (1 << size) + 1, size + 1
    for c in codes:
        bits += [c >> i & 1 for i in range(width)]
        if c == 1 << size:
            free, width = (1 << size) + 1, size + 1
            continue
        free += 1
        if free < 4096 and free >= 1 << width and width < 12:
            width += 1
    return np.packbits(bits, bitorder="little").tobytes()


def plain(codes, size):
    """The pixels, code by code."""
    clear, out, table, before = 1 << size, [], None, None
    for c in codes:
        if c == clear:
            table, before = [[i] for i in range(clear)] + [None, None], None
            continue
        if c == clear + 1:
            break
        own = table[c] if c < len(table) else before + before[:1]
        out += own
        if before is not None and len(table) < 4096:
            table.append(before + own[:1])
        before = own
    return bytes(out)


def longest(size, n):
    """Codes that each stand for one pixel more than the one before, as long as the table grows; then the last one again and again."""
    clear = 1 << size
    grow = [clear, 0] + list(range(clear + 2, 4096))
    return grow + [4095] * n


@pytest.mark.parametrize("size", [2, 8])
def test_streams_decode_as_code_by_code(size):
    r = random.Random(size)
    for deferred in (0, 3000):
        for _ in range(6):
            codes, free = [1 << size], (1 << size) + 1
            for _ in range(r.randrange(1, 700) + deferred * 2):
                codes.append(r.choice([r.randrange(1 << size), r.randrange((1 << size) + 2, free + 1) if free > (1 << size) + 1 else 0]))
                free = min(4095, free + 1)
            want = plain(codes, size)
            got = gif.lzw_decode(packed([*codes, (1 << size) + 1], size), size, len(want) + 5)
            assert bytes(got) == want
            for most in (1, 2, len(want) // 2, len(want)):
                assert bytes(gif.lzw_decode(packed(codes, size), size, most)) == want[:most]


def test_a_small_stream_for_one_pixel_takes_little_memory():
    raw = packed(longest(8, 8000), 8)
    assert len(raw) < 20_000 and len(plain(longest(8, 10), 8)) > 5_000_000
    for most in (1, 1 << 20):
        tracemalloc.start()
        got = gif.lzw_decode(raw, 8, most)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == most and not got.any() and peak < 50_000_000


def test_pieces_do_not_show(monkeypatch):
    r = np.random.default_rng(5)
    payload = np.repeat(r.integers(0, 7, 3000), r.integers(1, 90, 3000)).astype(np.uint8).tobytes()
    raw = gif.lzw_encode(payload)
    monkeypatch.setattr(gif, "_PIECE", 50)
    assert bytes(gif.lzw_decode(raw, 8, len(payload))) == payload

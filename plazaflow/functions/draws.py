"""Keyed uniforms of many pairs at once: the numbers of :func:`scalar.uniform`, on arrays.

A pair's text is a head and a tail, and MD5 works on its sixteen words; words that depend on the head or the tail alone
are made once for each. All pairs go through a step together, and only what the first eight digits need is worked out.
"""

from __future__ import annotations

import math

import numpy as np

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: The longest text of one MD5 block.
LONGEST = 55


def heads(texts: np.ndarray) -> np.ndarray:
    """Words (texts, 16) of texts of one length, at the front."""
    return _words(texts, 0, texts.dtype.itemsize, b"")


def tails(texts: np.ndarray, at: int, end: bytes) -> np.ndarray:
    """Words (texts, 16) of texts of one length and ``end`` that follow a head of ``at`` characters, and of MD5's own ending."""
    return _words(texts, at, texts.dtype.itemsize, end, closed=True)


def _words(texts: np.ndarray, at: int, long: int, end: bytes, closed: bool = False) -> np.ndarray:
    out = np.zeros((len(texts), 64), np.uint8)
    out[:, at : at + long] = np.frombuffer(texts.tobytes(), np.uint8).reshape(len(texts), long)
    if closed:
        size = at + long + len(end)
        if size > LONGEST:
            raise ValueError("text too long")
        out[:, at + long : size] = np.frombuffer(end, np.uint8)
        out[:, size] = 0x80
        out[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
    return out.view("<u4")


def uniforms(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The uniforms (heads, tails) of all pairs of :func:`heads` and :func:`tails`."""
    fixed, varied = [], []
    for h, t in zip(head.T, tail.T, strict=True):
        one_h, one_t = bool((h == h[0]).all()), bool((t == t[0]).all())
        fixed.append((int(h[0]) if one_h else 0) + (int(t[0]) if one_t else 0))
        # heads and tails have no byte in common
        varied.append(None if one_h and one_t else h[:, None] if one_t else t[None, :] if one_h else h[:, None] | t[None, :])
    shape = (len(head), len(tail))
    a, b, c, d = (np.full(shape, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the three steps left don't change the first word
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif part == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif part == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        place, turn = _PLACES[part](i), _TURNS[part][i % 4]
        t += a
        t += np.uint32((_ADDED[i] + fixed[place]) & 0xFFFFFFFF)
        if varied[place] is not None:
            t += varied[place]
        np.left_shift(t, np.uint32(turn), out=u)
        np.right_shift(t, np.uint32(32 - turn), out=t)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    b += np.uint32(0x67452301)
    out = b.byteswap(inplace=True).astype(np.float64)
    out += 0.5
    out /= 4294967296.0
    return out

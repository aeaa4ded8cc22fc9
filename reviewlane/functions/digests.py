"""MD5 of many short messages at once.

A resampled draw costs one digest for each group, far more than the few additions after it.
hashlib makes one at a time, at a microsecond each; here the 64 steps of MD5 (RFC 1321) run on
arrays of messages.
"""

from __future__ import annotations

import math

import numpy as np

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
STRIDES = ((1, 0), (5, 1), (3, 5), (7, 0))  # which word a step of each round adds
SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MOST_BYTES = 55  # of a message in one block


def _blocks(prefix: int, texts: list[bytes]) -> list[np.ndarray | int]:
    """The 16 words of each message behind a prefix that is still to be filled in; words that all messages share are numbers."""
    size = np.array([len(t) for t in texts])
    width = int(size.max()) + 1
    cells = np.zeros((len(texts), 64), np.uint8)
    cells[:, prefix : prefix + width] = np.frombuffer(b"".join((t + b"\x80").ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    cells[:, 56:] = ((size + prefix) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    words = np.ascontiguousarray(cells.view("<u4").T)
    return [int(w[0]) if (w == w[0]).all() else w for w in words]


def md5_words(prefixes: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The four words (uint32, by prefix and text) of MD5(prefix + text), little-endian; prefixes of one length, MOST_BYTES in all."""
    length = len(prefixes[0])
    words, shape = _blocks(length, texts), (len(prefixes), len(texts))
    head = np.frombuffer(b"".join(p.ljust(-(-length // 4) * 4, b"\0") for p in prefixes), "<u4").reshape(len(prefixes), -1)
    for i in range(head.shape[1]):
        words[i] = head[:, i : i + 1] | np.broadcast_to(np.asarray(words[i], np.uint32), shape[1])
    a, b, c, d = (np.full(shape, s, np.uint32) for s in START)
    mixed, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for step, sine in enumerate(SINES):
        turn, i = divmod(step, 16)
        if turn == 0:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=mixed), b, out=mixed), d, out=mixed)
        elif turn == 1:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=mixed), d, out=mixed), c, out=mixed)
        elif turn == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=mixed), d, out=mixed)
        else:
            np.bitwise_xor(np.bitwise_or(np.invert(d, out=mixed), b, out=mixed), c, out=mixed)
        a += mixed
        word = words[(STRIDES[turn][0] * i + STRIDES[turn][1]) % 16]
        if isinstance(word, int):
            a += np.uint32((word + sine) & 0xFFFFFFFF)
        else:
            a += word
            a += np.uint32(sine)
        shift = SHIFTS[turn][i % 4]
        np.right_shift(a, np.uint32(32 - shift), out=turned)
        a <<= np.uint32(shift)
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    return tuple(np.add(x, np.uint32(s), out=x) for x, s in zip((a, b, c, d), START))

"""md5 of many short texts at once, on arrays: what a read's key costs."""

from __future__ import annotations

import hashlib

import numpy as np

#: Texts that are hashed at once, so that their words stay near the processor.
AT_ONCE = 1 << 13
_ROTATE = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_ADD = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_WORD = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def _block(words: np.ndarray) -> np.ndarray:
    """Digests (n, 16) of one block of 16 words (16, n) each."""
    a, b, c, d = (np.full(words.shape[1], x, dtype=np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    some = words.any(axis=1)
    for k in range(64):
        if k < 32:
            x, y, z = (b, c, d) if k < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        f += _ADD[k]
        if some[_WORD[k]]:
            f += words[_WORD[k]]
        np.right_shift(f, np.uint32(32 - _ROTATE[k]), out=g)
        np.left_shift(f, np.uint32(_ROTATE[k]), out=f)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    out = np.stack([a, b, c, d], axis=1) + _START
    return out.astype("<u4").view(np.uint8).reshape(-1, 16)


def numbered(prefixes: list[bytes], which: np.ndarray, i: np.ndarray) -> np.ndarray:
    """md5 (n, 16) of each prefix with a positive number behind it, in digits."""
    sizes = np.array([len(p) for p in prefixes], dtype=np.int64)
    padded = np.ascontiguousarray(np.frombuffer(b"".join(p[:64].ljust(64, b"\0") for p in prefixes), dtype="<u4").reshape(-1, 16).T.astype(np.uint32))
    out = np.empty((len(i), 16), dtype=np.uint8)
    for begin in range(0, len(i), AT_ONCE):
        own, n = which[begin : begin + AT_ONCE], i[begin : begin + AT_ONCE]
        digits, top = np.ones(len(n), dtype=np.int64), 10
        while top <= n.max():
            digits += n >= top
            top *= 10
        end = sizes[own] + digits
        fits = end <= 55  # one block with its mark and length
        row = np.flatnonzero(fits)
        of, last, rest, left = own[row], end[row], n[row], digits[row]
        words, at = np.take(padded, of, axis=1), np.arange(len(row))
        words[last >> 2, at] |= np.uint32(0x80) << ((last & 3) << 3).astype(np.uint32)
        words[14] |= (last << 3).astype(np.uint32)
        while len(at):
            last, (rest, digit) = last - 1, np.divmod(rest, 10)
            words[last >> 2, at] |= (48 + digit).astype(np.uint32) << ((last & 3) << 3).astype(np.uint32)
            left = left - 1
            go = left > 0
            at, last, rest, left = at[go], last[go], rest[go], left[go]
        out[begin + row] = _block(words)
        for k in np.flatnonzero(~fits).tolist():
            out[begin + k] = np.frombuffer(hashlib.md5(prefixes[own[k]] + b"%d" % n[k], usedforsecurity=False).digest(), dtype=np.uint8)
    return out

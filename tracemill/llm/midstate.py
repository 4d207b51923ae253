"""SHA-256 with states that can be copied, kept in a table and resumed, over many messages at once.

A digest written as 64 hexadecimal digits fills exactly one block of SHA-256, so the state of a hash over
joined digests is, before every one of them, eight words and nothing else. All functions take
and give uint32 arrays with one row per message.
"""

from __future__ import annotations

import math

import numpy as np


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle - 1)
    return low


# By the standard's rule: fractions of the square and cube roots of the first primes.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
#: The four hexadecimal digits of 16 bits as one word of a message.
_FOUR = np.zeros(1 << 16, np.uint32)
for _shift in (12, 8, 4, 0):
    _FOUR = (_FOUR << np.uint32(8)) | _DIGITS[(np.arange(1 << 16) >> _shift) & 15]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def resume(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The state after one more block: (n, 8) and (n, 16) give (n, 8)."""
    w = list(np.ascontiguousarray(block.T))
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        small = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        large = _turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))
        w.append(w[i - 16] + small + w[i - 7] + large)
    start = np.ascontiguousarray(state.T)
    a, b, c, d, e, f, g, h = start
    for i in range(64):
        mixed = _turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)
        first = h + mixed + (g ^ (e & (f ^ g))) + w[i] + _ROUND[i]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return (start + np.stack([a, b, c, d, e, f, g, h])).T


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block that holds a digest's hexadecimal text: (n, 8) gives (n, 16)."""
    halves = np.empty((len(digests), 16), np.uint32)
    halves[:, 0::2], halves[:, 1::2] = digests >> np.uint32(16), digests & np.uint32(0xFFFF)
    return _FOUR[halves]


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digest of messages of so many whole blocks, from the state after them."""
    end = np.zeros((len(state), 16), np.uint32)
    end[:, 0], end[:, 15] = 0x80000000, blocks * 512
    return resume(state, end)


def words(raw: bytes) -> np.ndarray:
    """Digests, or states, that stand one after the other in bytes."""
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


def raw(values: np.ndarray) -> bytes:
    return values.astype(">u4").tobytes()


def texts(values: np.ndarray) -> list[bytes]:
    """The hexadecimal text of each digest."""
    whole = raw(values).hex().encode()
    return [whole[i : i + 64] for i in range(0, len(whole), 64)]

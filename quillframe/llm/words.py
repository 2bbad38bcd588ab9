"""Word and window digests of one text, vectorised with numpy; called inside tasks that Spark has dealt out."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASES = {0: 0x9E3779B97F4A7C17, 1: 0xC2B2AE3D27D4EB53, 2: 0xD6E8FEB86659FD93}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close values in, unrelated values out."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a lane's base and of its inverse, modulo 2 ** 64."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base = _BASES[lane]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[lane] = have = (both[0], both[1])
        if size > 1 << 22:  # a very long text's powers are not kept
            del _powers[lane]
    return have


class Prefix:
    """Digests of any run of values, from running sums."""

    def __init__(self, values: np.ndarray, lane: int):
        power, self.inverse = powers(lane, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U) * U(0x165667B19E3779F9))

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n] + U(k * 0x165667B19E3779F9 % (1 << 64)))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between space and \\t \\n \\v \\f \\r, as UTF-8; lower: A-Z become a-z, other letters stay."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_digests(words: list[bytes]) -> np.ndarray:
    """64 bits for each word."""
    if not words:
        return np.zeros(0, dtype=U)
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    return Prefix(_BYTES[raw], 0).runs(starts, ends)


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The sorted distinct digests of k-word runs; of the whole sequence when it is shorter; none without words."""
    if not words:
        return np.zeros(0, dtype=U)
    return np.unique(Prefix(word_digests(words), 1).windows(min(k, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

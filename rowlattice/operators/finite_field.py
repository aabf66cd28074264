"""Arithmetic modulo the prime 2**61 - 1, on numpy arrays and plain integers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

P = (1 << 61) - 1
_P = np.uint64(P)
_LOW31 = np.uint64((1 << 31) - 1)
_LOW30 = np.uint64((1 << 30) - 1)
_S31, _S30, _S61, _ONE = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of residues, element by element, without 128-bit integers."""
    ah, al, bh, bl = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = ah * bl + al * bh
    total = ((ah * bh) << _ONE) + (middle >> _S30) + ((middle & _LOW30) << _S31) + al * bl
    total = (total & _P) + (total >> _S61)
    return np.where(total >= _P, total - _P, total)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return np.where(total >= _P, total - _P, total)


@lru_cache(maxsize=64)
def sample_points(count: int, skip: int = 0) -> tuple[int, ...]:
    """``count`` of a fixed sequence of evaluation points, after the first ``skip``."""
    out, state = [], 0x9E3779B97F4A7C15
    for i in range(skip + 1, skip + count + 1):
        z = (state * i) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append((z ^ (z >> 31)) % P)
    return tuple(out)


def segment_products(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Product of each run of rows; ``starts`` are the runs' first rows.

    ``values`` is rows x points. Neighbouring rows of a run are multiplied
    pairwise until one row is left of each.
    """
    lengths = np.diff(np.append(starts, len(values)))
    while len(lengths) and lengths.max() > 1:
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(values)) - np.repeat(first, lengths)
        even = np.flatnonzero(place % 2 == 0)
        paired = even[place[even] + 1 < np.repeat(lengths, lengths)[even]]
        values = values.copy()
        values[paired] = mul(values[paired], values[paired + 1])
        values = values[even]
        lengths = (lengths + 1) // 2
    return values


def trim(poly: list[int]) -> list[int]:
    while poly and poly[-1] == 0:
        poly.pop()
    return poly


def poly_mul(a: list[int], b: list[int]) -> list[int]:
    out = [0] * (len(a) + len(b) - 1) if a and b else []
    for i, x in enumerate(a):
        if x:
            for j, y in enumerate(b):
                out[i + j] = (out[i + j] + x * y) % P
    return trim(out)


def poly_divmod(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    rest, inverse = a[:], pow(b[-1], -1, P)
    quotient = [0] * max(0, len(a) - len(b) + 1)
    for shift in range(len(a) - len(b), -1, -1):
        factor = rest[shift + len(b) - 1] * inverse % P
        if factor:
            quotient[shift] = factor
            for j, y in enumerate(b):
                rest[shift + j] = (rest[shift + j] - factor * y) % P
    return quotient, trim(rest[: len(b) - 1])


def poly_at(poly: list[int], z: int) -> int:
    total = 0
    for c in reversed(poly):
        total = (total * z + c) % P
    return total


class Interpolator:
    """Finds the monic rational function behind its values at fixed points."""

    def __init__(self, points: tuple[int, ...]) -> None:
        self.points = points
        self.modulus = [1]
        self.inverse = []
        for i, z in enumerate(points):
            self.modulus = poly_mul(self.modulus, [P - z, 1])
            self.inverse.append([pow((z - points[j]) % P, -1, P) for j in range(i)])

    def polynomial(self, values: list[int]) -> list[int]:
        """Newton's divided differences, expanded to coefficients."""
        m = len(values)
        d = list(values)
        for level in range(1, m):
            for i in range(m - 1, level - 1, -1):
                d[i] = (d[i] - d[i - 1]) * self.inverse[i][i - level] % P
        out = [d[-1]]
        for i in range(m - 2, -1, -1):
            z = self.points[i]
            grown = [0, *out]
            for j, c in enumerate(out):
                grown[j] = (grown[j] - z * c) % P
            grown[0] = (grown[0] + d[i]) % P
            out = grown
        return trim(out)

    def rational(self, values: list[int], excess: int) -> tuple[list[int], list[int]] | None:
        """Monic numerator and denominator, their degrees ``excess`` apart.

        None if no such pair has degrees within the number of points.
        """
        most = (len(self.points) - 1 + excess) // 2
        if most < 0 or most - excess < 0:
            return None
        r0, r1, t0, t1 = self.modulus, self.polynomial(values), [], [1]
        while len(r1) - 1 > most:
            q, r = poly_divmod(r0, r1)
            step = poly_mul(q, t1)
            t = [((t0[i] if i < len(t0) else 0) - (step[i] if i < len(step) else 0)) % P for i in range(max(len(t0), len(step)))]
            r0, r1, t0, t1 = r1, r, t1, trim(t)
        if not r1 or not t1 or r1[-1] != t1[-1] or len(r1) - len(t1) != excess:
            return None
        scale = pow(r1[-1], -1, P)
        return [c * scale % P for c in r1], [c * scale % P for c in t1]

"""Vectorised words of whole texts: a few numpy passes over many documents at a time.

A word is a longest run of code points other than U+0020 and U+0009 to U+000D. Texts are put
behind one another with a line feed after each, so words never reach across documents. Hashes are
64 bits, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Odd multipliers (fixed values; any odd 64-bit numbers serve).
STEP = np.uint64(0x9E3779B97F4A7C15)
UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHAIN = np.uint64(0xC2B2AE3D27D4EB4F)
#: Code points that one pass takes at most, but for a single longer text.
CHUNK = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of successive texts of about ``size`` code points together."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total and total + n > size:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, a line feed after each text, and where each text begins (and the end)."""
    joined = "\n".join([t or "" for t in texts]) + "\n"
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([(len(t) if t else 0) + 1 for t in texts], out=begins[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begins


@dataclass
class Words:
    """Words of some texts in order: code point range, text number, and each text's first word."""

    codes: np.ndarray
    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's code points."""
        return spans_hash(self.codes, self.starts, self.ends)


def folding() -> np.ndarray:
    """For each code point below 2^16: its lower case if it is a letter or digit, else a space."""
    return np.array([ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else 32 for c in map(chr, range(1 << 16))], np.uint32)


def words(texts: list[str | None], fold: np.ndarray | None = None) -> Words:
    """Words as above; with ``fold``, runs of lower-cased letters and digits instead."""
    codes, begins = code_points(texts)
    if fold is not None:
        codes = np.where(codes < len(fold), fold[np.minimum(codes, len(fold) - 1)], codes)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(codes) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(codes))
    first = np.searchsorted(starts, begins)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(codes, begins, starts, ends, doc, first)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _POWERS[int(base)] = have
    return have[:n]


def spans_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the code points of each span [start, end), by differences of one running sum."""
    return span_of(running(codes), starts, ends)


def running(codes: np.ndarray) -> np.ndarray:
    """The running sum whose differences are the hashes of spans."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + STEP) * powers(STEP, len(codes)), out=total[1:])
    return total


def span_of(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = (total[ends] - total[starts]) * powers(UNSTEP, len(total))[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those k words are of one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    value = np.zeros(n, np.uint64)
    for t in range(k):
        value *= CHAIN
        value += hashes[t : t + n]
    return mix(value), doc[:n] == doc[k - 1 :]

"""Word and shingle hashes of whole Arrow columns, without a Python loop over words.

A word hash is a polynomial over random 64-bit values of its bytes, taken for all words of a batch from one
running sum; a shingle hash is a weighted sum of mixed word hashes, mixed again. Two different shingles
agree with a chance of about 2**-64. Of long words a digest is taken: a polynomial modulo 2**64 tells some words of
a thousand regularly alternating bytes not apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 1 << 20
LONG_WORD = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, 5 modulo 8
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240131)).integers(0, 1 << 64, 256, dtype=np.uint64)
_WEIGHTS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < length:
        for place, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(length, base, dtype=np.uint64)
            steps[0] = 1
            _powers[place] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look independent."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words that begin and end there in a run of bytes, A-Z lower-cased."""
    powers, inverses = _power_tables(len(part) + 1)
    running = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(_LOWER_VALUES[part] * powers[: len(part)], out=running[1:])
    sizes = ends - starts
    hashes = mix((running[ends] - running[starts]) * inverses[starts] + sizes.astype(np.uint64))
    for at in np.flatnonzero(sizes >= LONG_WORD):
        word = _LOWER[part[starts[at] : ends[at]]].tobytes()
        hashes[at] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def distinct(values: np.ndarray) -> np.ndarray:
    """The values without repeats, in order."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, those of its own rows alone if it is a slice, and where each row begins; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
    return (np.frombuffer(data, dtype=np.uint8)[low:high] if data else np.zeros(0, np.uint8)), bounds - low


def _ranges(space: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at row ends, and inside a row longer than a step at white space."""
    low, end = int(bounds[0]), int(bounds[-1])
    while low < end:
        high = min(low + _STEP, end)
        if high < end:
            row = int(np.searchsorted(bounds, high, side="right")) - 1
            if bounds[row] > low:
                high = int(bounds[row])
            else:
                gaps = np.flatnonzero(space[low + 1 : high])
                if gaps.size:
                    high = low + 1 + int(gaps[-1])
                else:
                    rest = space[high : bounds[row + 1]]
                    high += int(rest.argmax()) if rest.any() else len(rest)
        yield low, high
        low = high


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, in order; and where each row's words begin."""
    data, bounds = bytes_of(texts)
    space = _IS_SPACE[data]
    hashes, first = [], []
    for low, high in _ranges(space, bounds):
        ink = ~space[low:high]
        inner = bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low
        begins = ink.copy()
        begins[1:] &= ~ink[:-1]
        begins[inner] |= ink[inner]
        starts = np.flatnonzero(begins)
        stops = ink.copy()
        stops[:-1] &= ~ink[1:]
        inner = inner[inner > 0]
        stops[inner - 1] |= ink[inner - 1]
        ends = np.flatnonzero(stops) + 1
        hashes.append(word_hashes(data[low:high], starts, ends))
        first.append(starts + low)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(first), bounds)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words in order, and where each row's runs begin.

    A row with fewer words has its whole sequence as one, a row without words none.
    """
    word, bounds = words(texts)
    counts = np.diff(bounds)
    runs = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
    for place in range(size):
        runs += word[place : place + len(runs)] * _WEIGHTS[place]
    runs = mix(runs)
    long = counts >= size
    amounts = np.where(long, counts - size + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(amounts)])
    out = np.zeros(int(begins[-1]), dtype=np.uint64)
    source = np.arange(len(out)) - np.repeat(begins[:-1] - bounds[:-1], amounts)
    of_long = np.repeat(long, amounts)
    out[of_long] = runs[source[of_long]]
    for row in np.flatnonzero(~long & (counts > 0)):
        mine = word[bounds[row] : bounds[row + 1]]
        total = (mine * _WEIGHTS[: len(mine)]).sum(dtype=np.uint64) + np.uint64(len(mine))
        out[begins[row]] = mix(np.array([total], dtype=np.uint64))[0]
    return out, begins

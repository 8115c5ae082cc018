"""Texts of an Arrow batch as bytes in numpy, for functions that run inside tasks.

A batch is worked on in slices of bounded size, so the memory of a task follows the longest text
and not the number of rows. White space and ASCII letters are single bytes in UTF-8, so words and
lines of the bytes are those of the text.

Two hashes. ``apart_hashes``, for parts that do not overlap (words, lines), multiplies each byte by a
random 64-bit number of its place in the part: two different strings share a hash only if those numbers
cancel, a chance of at most 2**-56 whatever the strings are. ``part_hashes``, for parts that overlap, is a
polynomial modulo 2**64; some long strings always share one, so it serves to group and to guess, and what
must be equal is compared.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# An odd base has an inverse modulo 2**64, which takes the hash of a part out of running sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of each slice; a null text is an empty one."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of true bytes; runs end with their text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside) + 1, bool)
    before[0] = False
    before[1:] = inside
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    after = before[1:].copy()
    after[:-1] = inside[1:]
    after[-1] = False
    after[edges - 1] = False
    before = before[:-1].copy()
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for base in (BASE, INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        del _powers[:-2]
    return _powers[0], _powers[1]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a finalizer of two multiplications)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


PLACES = mix(np.arange(1, 1 << 16, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def places(n: int) -> np.ndarray:
    """The random number of each of the first n places of a part."""
    global PLACES
    if len(PLACES) < n:
        PLACES = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return PLACES


def apart_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of parts in order that do not overlap; equal strings have equal hashes wherever they are."""
    lengths = ends - starts
    upto = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=upto[1:])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], lengths)
    at = place + np.repeat(starts, lengths)
    sums = np.zeros(upto[-1] + 1, np.uint64)
    np.cumsum(places(int(lengths.max(initial=0)))[place] * (data[at].astype(np.uint64) + np.uint64(1)), out=sums[1:])
    return mix(sums[upto[1:]] - sums[upto[:-1]] + lengths.astype(np.uint64) * np.uint64(BASE))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any part with part_hashes."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def part_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the parts from starts to ends; equal strings have equal hashes wherever they are."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from its concatenated values."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word between white space, and the number of words per text."""
    starts, ends, text = runs(~SPACE[data], offsets)
    return starts, ends, text, np.bincount(text, minlength=len(offsets) - 1)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes (also across texts; the caller cuts)."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(BASE) + mix(hashes[i : i + n] + np.uint64(2 * i + 1))
    return mix(total)

"""Vectorised word splitting and hashing over UTF-8 bytes.

All text operators that leave the JVM share this scanner.  It works on whole
texts, in chunks of about a megabyte that end between words, so memory is
bounded by the longest single word, not by the longest document.
"""

from __future__ import annotations

import hashlib

import numpy as np

CHUNK = 1 << 20
_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


mix = _splitmix

#: White space of the word pattern [^\x20\x09-\x0D]+ .
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters and bytes of non-ASCII characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[0x80:] = False
NOT_LETTER[0x41:0x5B] = NOT_LETTER[0x61:0x7B] = False

_ODD = _U(0x9E6C63D0876A9A35)
#: Words of more bytes are hashed one by one with blake2b.
LONG_WORD = 512


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))


def _lane(lanes: np.ndarray, starts: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Eight bytes from each start, those beyond rest bytes cleared."""
    found = lanes[starts]
    short = rest < 8
    found[short] &= (_U(1) << (rest[short].astype(_U) * _U(8))) - _U(1)
    return found


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each data[start:end].

    Eight bytes at a time go through a mixer that is no linear function of
    them, so no text is built from two letters alone that meets another's hash
    whatever the constants, as it is with sums of powers modulo 2**64.
    """
    size = ends - starts
    if not len(size):
        return np.empty(0, _U)
    lanes = _lanes(data)
    out = _splitmix(_lane(lanes, starts, size) ^ _splitmix(size.astype(_U)))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(more):
        out[more] = _splitmix(out[more] * _ODD + _lane(lanes, starts[more] + at, size[more] - at))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span numbered other[i]."""
    size = ends - starts
    same = size == size[other]
    for i in np.flatnonzero(same & (size > LONG_WORD) & (other != np.arange(len(size)))).tolist():
        j = int(other[i])
        same[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[j] : ends[j]])
    lanes, at = _lanes(data), 0
    more = np.flatnonzero(same & (size <= LONG_WORD) & (other != np.arange(len(size))))
    while len(more):
        rest = size[more] - at
        same[more] &= _lane(lanes, starts[more] + at, rest) == _lane(lanes, starts[other[more]] + at, rest)
        at += 8
        more = more[same[more] & (size[more] > at)]
    return same


def run_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, least: int, lane: int = 0) -> np.ndarray:
    """A hash of each run hashes[first:end] of at least `least` values.

    Runs of 2, 4, 8 .. values are hashed from their halves, so equal values at
    other places do not cancel; a run is a chain of the largest such runs, the
    last of which ends with it.  lane chooses one of two independent hashes.
    """
    odd = _U((0x9E6C63D0876A9A35, 0xC2B2AE3D27D4EB4F)[lane])
    level, width = _splitmix(hashes ^ odd), 1
    while 2 * width <= least:
        level = _splitmix(level[: len(level) - width] * odd + level[width:])
        width *= 2
    out = _splitmix(level[end - width] + _splitmix((end - first).astype(_U)))
    at, more = 0, np.arange(len(first))
    while len(more):
        out[more] = _splitmix(out[more] * odd + level[first[more] + at])
        at += width
        more = more[first[more] + at + width < end[more]]
    return out


def _pieces(texts, sep):
    """(index, bytes) with long texts cut at separators."""
    for i, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while len(text) - at > CHUNK:
            cut = at + CHUNK
            window = np.flatnonzero(sep[np.frombuffer(text, np.uint8, cut - at, at)])
            if len(window):
                cut = at + int(window[-1]) + 1
            else:  # one word longer than the chunk: go on to its end
                rest = np.flatnonzero(sep[np.frombuffer(text, np.uint8, len(text) - cut, cut)])
                cut = cut + int(rest[0]) + 1 if len(rest) else len(text)
            yield i, text[at:cut]
            at = cut
        if at < len(text):
            yield i, text[at:]


def scan(texts, sep: np.ndarray = SPACE):
    """Yield (data, starts, ends, owner, hashes) per chunk.

    texts: bytes or None each.  owner[j] is the index of the text of word j.
    Words come in order; a text may go on in the next chunk.
    """
    held, owners, size = [], [], 0

    def flush():
        data = np.frombuffer(b" ".join([*held, b""]), np.uint8)
        word = ~sep[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]  # the last byte is a separator
        bounds = np.cumsum([len(x) + 1 for x in held])
        owner = np.asarray(owners, np.int64)[np.searchsorted(bounds, starts, side="right")]
        return data, starts, ends, owner, word_hashes(data, starts, ends)

    for i, piece in _pieces(texts, sep):
        held.append(piece)
        owners.append(i)
        size += len(piece) + 1
        if size >= CHUNK:
            yield flush()
            held, owners, size = [], [], 0
    if held:
        yield flush()


def scan_documents(texts, sep: np.ndarray = SPACE):
    """Like scan, but (hashes, owner) hold whole documents each time."""
    left = None
    for _, _, _, owner, hashes in scan(texts, sep):
        if left is not None:
            owner, hashes = np.concatenate([left[1], owner]), np.concatenate([left[0], hashes])
        if not len(owner):
            continue
        cut = int(np.searchsorted(owner, owner[-1]))
        if cut:
            yield hashes[:cut], owner[:cut]
        left = hashes[cut:], owner[cut:]
    if left is not None and len(left[0]):
        yield left


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of each run of equal values."""
    cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    starts = np.concatenate([[0], cut]) if len(owner) else cut
    return owner[starts], starts, np.concatenate([cut, [len(owner)]]) if len(owner) else cut


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by start (len - k + 1 values)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out *= _ODD
        out += hashes[j : j + n]
    return _splitmix(out)

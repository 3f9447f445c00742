"""Vectorised words of Arrow string columns.

A word is a run of bytes outside 0x20 and 0x09-0x0D.  Hashing works on the
column's UTF-8 buffer, so that no Python object is made per word.  Null texts have
no words.

A word's bytes are absorbed eight at a time by a state of 128 bits, both halves of which
feed each other; words of more than LONG bytes go through BLAKE2b.  Each word has two
64-bit hashes made of the whole state.  One of them may pick candidates; what decides
that words, runs of words or texts are equal asks both.  Runs are hashed as a tree of
pairs, and whole texts as sums over places, each step scrambled, so that no pattern of
repeated letters or words cancels out.

Memory: a byte or two a byte of text, and some 8-byte numbers a word; temporary
arrays are of bounded size, however long a text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 2 << 20
PIECE = 1 << 22  #: bytes whose words are found at a time
BLOCK = 1 << 18  #: words that are hashed at a time
LONG = 64

_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_KEYS = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=values.dtype)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """Of each word of the bytes the 64-bit hashes of these keys."""
    out = [np.empty(len(starts), dtype=np.uint64) for _ in keys]
    if not len(starts):
        return out
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    for a in range(0, len(starts), BLOCK):
        start, length = starts[a : a + BLOCK], (ends[a : a + BLOCK] - starts[a : a + BLOCK])
        state = [length.astype(np.uint64) * _ODD[1 - k] + _KEYS[k] for k in (0, 1)]
        left = np.flatnonzero(length > 0)
        for lane in range(LONG // 8):
            value = eights[start[left] + 8 * lane] & _MASKS[np.minimum(length[left] - 8 * lane, 8)]
            h, g = state[0][left], state[1][left]
            state[0][left] = mix((h ^ value) * _ODD[0] + g)
            state[1][left] = mix((g + value) * _ODD[1] ^ h)
            left = left[length[left] > 8 * (lane + 1)]
            if not len(left):
                break
        long = [(k, hashlib.blake2b(data[start[k] : start[k] + length[k]].data, digest_size=16).digest()) for k in np.flatnonzero(length > LONG)]
        for key, found in zip(keys, out, strict=True):
            h = mix(state[key] + mix(state[1 - key] * _ODD[key]))
            for k, digest in long:
                h[k] = int.from_bytes(digest[8 * key : 8 * key + 8], "little")
            found[a : a + BLOCK] = h
    return out


@dataclass
class Chunk:
    """Some consecutive documents of a column."""

    first: int  #: index of the first document in the column
    data: np.ndarray  #: UTF-8 bytes of all of them
    doc_bytes: np.ndarray  #: byte offsets of the documents, one more than there are
    starts: np.ndarray  #: byte offset of each word
    ends: np.ndarray
    doc_words: np.ndarray  #: word offsets of the documents, one more than there are

    def __len__(self) -> int:
        return len(self.doc_bytes) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int64), np.diff(self.doc_words))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """The first hash of each word's bytes; with A-Z as a-z if lower."""
        return hash_words(LOWER[self.data] if lower else self.data, self.starts, self.ends)[0]

    def both_hashes(self, lower: bool = False) -> list[np.ndarray]:
        """Both hashes of each word's bytes; with A-Z as a-z if lower."""
        return hash_words(LOWER[self.data] if lower else self.data, self.starts, self.ends, (0, 1))

    def words(self, i: int) -> list[bytes]:
        return self.data[self.doc_bytes[i] : self.doc_bytes[i + 1]].tobytes().split()

    def joined(self, keep: np.ndarray) -> Iterator[memoryview]:
        """For each document the words to keep, joined by one space."""
        change = np.zeros(len(self.data) + 2, dtype=np.int8)
        change[self.starts[keep]] = 1
        change[self.ends[keep] + 1] -= 1  # with the byte after it, if there is one
        here = np.cumsum(change[: len(self.data)], dtype=np.int8).astype(bool)
        outside = self.doc_bytes[1:-1]
        outside = outside[(outside > 0) & (outside < len(self.data))]
        first = np.zeros(len(self.data) + 1, dtype=bool)
        first[self.starts[keep]] = True
        here[outside] &= first[outside]  # the byte after a document's last word is the next document's
        kept = self.data[here]
        kept[SPACE[kept]] = 0x20
        ends = np.searchsorted(np.flatnonzero(here), self.doc_bytes)
        view = memoryview(kept)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield view[a : b - 1] if b > a and kept[b - 1] == 0x20 else view[a:b]


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of about most bytes; a longer document is a chunk of its own."""
    first = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = pc.fill_null(part, "").cast(pa.large_string())
        n = len(part)
        if not n:
            continue
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + n + 1]
        buffer = part.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
            yield _chunk(first + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            a = b
        first += n


def _chunk(first: int, data: np.ndarray, doc_bytes: np.ndarray) -> Chunk:
    n = len(data)
    inner = doc_bytes[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    starts, ends = [], []
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        space = np.ones(b - a + 2, dtype=bool)  # of the piece, the byte before and the byte after it
        lo, hi = max(0, a - 1), min(n, b + 1)
        space[lo - a + 1 : hi - a + 1] = SPACE[data[lo:hi]]
        own = ~space[1:-1]
        before, after = space[:-2].copy(), space[2:].copy()
        cut = inner[np.searchsorted(inner, a) : np.searchsorted(inner, b + 1)]
        before[cut[cut < b] - a] = True
        after[cut[cut > a] - a - 1] = True
        starts.append(np.flatnonzero(before & own) + a)
        ends.append(np.flatnonzero(after & own) + (a + 1))
    none = np.zeros(0, dtype=np.int64)
    starts, ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    return Chunk(first, data, doc_bytes, starts, ends, np.searchsorted(starts, doc_bytes))


def windows(h: np.ndarray, doc_words: np.ndarray, size: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of size words inside a document, from their hashes, and the index of its first word."""
    left = np.repeat(doc_words[1:], np.diff(doc_words)) - np.arange(len(h))
    at = np.flatnonzero(left >= size)
    run, length, done, out = h, 1, 0, None  # run: hashes of the runs of length words; out: of the first done words
    while True:
        if size & length:
            tail = run[done:]
            out = tail if out is None else mix(out[: len(tail)] * _ODD[key] + tail[: len(out)])
            done += length
        if done == size:
            break
        run = mix(run[:-length] * _ODD[1 - key] + run[length:]) if len(run) > length else run[:0]
        length *= 2
    return out[at] if len(at) else np.zeros(0, np.uint64), at


def text_key(h: np.ndarray, doc_words: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each document's words in order, from their hashes."""
    place = np.arange(len(h)) - np.repeat(doc_words[:-1], np.diff(doc_words))
    sums = prefix(mix(h ^ mix(place.astype(np.uint64) + _KEYS[key])))
    n_words = np.diff(doc_words).astype(np.uint64)
    return mix((sums[doc_words[1:]] - sums[doc_words[:-1]]) ^ n_words * _ODD[key])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs of two hashes, and which of them is at each place."""
    first, at, which = np.unique(a, return_index=True, return_inverse=True)
    if (b[at][which] == b).all():
        return first, b[at], which
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which[order] = np.cumsum(new) - 1
    return a[new], b[new], which

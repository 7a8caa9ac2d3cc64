"""Hashed words of texts, for operators that run NumPy inside Spark tasks."""

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hash a worker keeps; when full, it starts anew.
KNOWN_WORDS = 50_000
#: Bytes of text that are taken apart at a time, so that a batch of long texts needs little memory.
SLICE_BYTES = 4 << 20
#: Bytes of text whose distinct results a task gathers before it passes them on.
GATHERED_BYTES = 8 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER = _LOWER
#: Lower-cases A-Z and turns ASCII punctuation into spaces.
LETTERS = bytes(
    c if c >= 128 or chr(c).isalnum() or chr(c).isspace() else 32 for c in _LOWER[:128]
) + bytes(range(128, 256))

#: An odd number without structure, for polynomial hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_known = _Known()


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts in a row, and each text's number of words."""
    # One text's words at a time, as an object for each word takes several times the text.
    hashes = [np.empty(0, np.uint64)]
    for text in texts:
        own = text.translate(table).split()
        hashes.append(np.fromiter(map(_known.__getitem__, own), np.uint64, len(own)))
    return np.concatenate(hashes), np.array([len(own) for own in hashes[1:]], np.int64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    total = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        total *= STEP
        total += words[i : len(words) - size + 1 + i]
    return mix(total)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def sliced(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with at most about SLICE_BYTES of text, or one row."""
    sizes = batch.column(text).cast(pa.large_binary())
    ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in sizes])
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = batch.slice(first, last - first)
        yield part, texts_of(part.column(text))
        first = last


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[list[list[bytes]]]:
    """Texts in slices, GATHERED_BYTES or a little more at a time."""
    held, size = [], 0
    for batch in batches:
        for _, texts in sliced(batch, text):
            held.append(texts)
            size += sum(map(len, texts))
            if size >= GATHERED_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def frugal(run: Callable) -> Callable:
    """A task's function that at its end gives unused memory back to the system, since workers stay for later stages."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _known.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped

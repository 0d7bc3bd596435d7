"""Words of whole Arrow batches of texts, and their hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


def byte_table(lower: bool, letters_only: bool) -> bytes:
    """What becomes of each byte: separators are spaces, A-Z lower case if asked. With ``letters_only`` all
    of ASCII but letters and digits separates; else only the six white-space characters do."""
    table = bytearray(range(256))
    for c in range(128):
        if c in _SPACES or (letters_only and not chr(c).isalnum()):
            table[c] = 0x20
        elif lower and c in _UPPER:
            table[c] = _UPPER[c]
    return bytes(table)


PLAIN, LOWER, LOWER_ALNUM = byte_table(False, False), byte_table(True, False), byte_table(True, True)


def split_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words of text i are words[offsets[i]:offsets[i + 1]]; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    moved = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(table))
    texts = pa.LargeStringArray.from_buffers(len(texts), offsets, moved, offset=texts.offset)
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        words = words.filter(pa.array(real))
    return ends.astype(np.int64), words


def coded_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, dictionary): as split_words, with each word as its place among the distinct ones."""
    offsets, words = split_words(texts, table)
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_each(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """At each place, the hash of the n words from there on; the last n - 1 places have none. Runs that
    span two texts are for the caller to leave out."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out


def slices(batch: pa.RecordBatch, text: int = 1, most_bytes: int = 4_000_000, texts: pa.Array | None = None):
    """The batch in parts of at most so many bytes of text, or of one row. ``texts`` are its texts if no column has them."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text) if texts is None else texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes
    starts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield batch.slice(a, b - a)

"""Token ids in files of fixed-width bit-packed blocks.

A file is the blocks, then an index, then a trailer of fixed size. Every block but the last holds
``block_ids`` ids, each in the fewest bits that hold the vocabulary, lowest bits first. The index has the
byte offset of each block, the first id of each document (and one more: the end), and the documents'
ids with a byte each that is 1 for a null. So any block or document can be read alone, and a block is
unpacked by numpy at once.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import scratch_path, spread, stored, text_of
from strata.llm.files import opened, whole_file
from strata.llm.tokens import slices

TRAILER = struct.Struct("<8sIIQQQ")  # magic, bits, ids in a block, ids, documents, where the index starts
MAGIC = b"STRTOK01"
BLOCK_IDS = 1 << 16
#: A file is closed after the document that fills it.
FILE_IDS = 1 << 23

#: A byte-level BPE never joins what stands before a single space and a character with these, so texts can be
#: encoded in pieces from one space to the next. Texts in which a space has white space beside it are not cut.
SPACES = r" [\s\x0b\x85\pZ]|[\s\x0b\x85\pZ] "
#: Nor does it join a letter and the ASCII mark or line feed behind it, or a lone line feed and what stands beside it. Texts
#: that have the mark of a cut themselves are not cut.
CUT = "\x00"
TAIL = "([A-Za-z\u00c0-\u024f])([!-/:-@\\[-`{-~\n])"
FEED = r"([^\s\x0b\x85\pZ])\n([^\s\x0b\x85\pZ])"


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class TokenWriter:
    """Writes one file; at any time it holds less than a block, and the index."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.rest, self.n_rest, self.n_ids, self.at = [], 0, 0, 0
        self.blocks, self.starts, self.keys = [], [0], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.rest.append(ids)
        self.n_rest += len(ids)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        if self.n_rest >= self.block_ids:
            have = np.concatenate(self.rest)
            full = len(have) - len(have) % self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(have[k : k + self.block_ids])
            self.rest, self.n_rest = [have[full:].copy()], len(have) - full

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        for part in (np.array(self.blocks, "<u8"), np.array(self.starts, "<u8"), keys, np.array([k is None for k in self.keys], np.uint8)):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.bits, self.block_ids, self.n_ids, len(self.keys), self.at))


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        magic, self.bits, self.block_ids, self.n_ids, self.n_docs, index = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        data = self.file.read_at(size - TRAILER.size - index, index)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.blocks = np.append(np.frombuffer(data, "<u8", n_blocks), np.uint64(index)).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, 8 * n_blocks).astype(np.int64)
        at = 8 * (n_blocks + self.n_docs + 1)
        null = np.frombuffer(data, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.keys = [None if z else int(k) for k, z in zip(np.frombuffer(data, "<i8", self.n_docs, at), null)]
        self.block = lru_cache(2)(self._block)

    def _block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k])), n, self.bits)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from the blocks that hold them."""
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        first, last = a // self.block_ids, max(a, b - 1) // self.block_ids
        if a == b:
            return np.empty(0, "<u4")
        ids = self.block(first) if first == last else np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[a - first * self.block_ids : b - first * self.block_ids]

    def close(self) -> None:
        self.file.close()


def _gathered(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``flat`` that ``codes`` name, one after the other, and where each ends)."""
    counts = lengths[codes]
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    small = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begins[codes] - (ends - counts)).astype(small), counts)
    at += np.arange(n, dtype=small)
    return flat[at], ends


class Encoder:
    """Encodes texts piece by piece, and keeps the ids of the pieces it met last within a bound.

    Only a byte-level BPE with the usual split pattern lets texts be cut; with any other tokenizer texts are encoded whole.
    """

    KEPT = 1_500_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._direct(["\n"])[0]
        spec = json.loads(self.tokenizer.to_str())
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec["normalizer"] is None
            and model["type"] == "BPE" and not model.get("dropout") and len(self.feed) == 1
        )
        # the pieces kept, by age; the ids of piece i are flat[begins[i]:begins[i] + lengths[i]]
        self.names, self.flat = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.begins, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of pieces: many at once with line feeds between, where a line feed is one id that nothing joins."""
        out: list[np.ndarray] = [None] * len(pieces)
        lines = [i for i, p in enumerate(pieces) if not ("\n" in p or not p or p[-1].isspace() or p[:2][-1].isspace())]
        joined = set(lines)
        alone = [i for i in range(len(pieces)) if i not in joined]
        for i, ids in zip(alone, self._direct([pieces[i] for i in alone])):
            out[i] = ids
        for s in range(0, len(lines), 4000):
            part = lines[s : s + 4000]
            ids = self._direct(["\n".join([pieces[i] for i in part])])[0]
            ends = np.append(np.flatnonzero(ids == self.feed[0]), len(ids)).tolist()
            begin = 0
            for i, end in zip(part, ends, strict=True):
                out[i] = ids[begin:end]
                begin = end + 1
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the kept ids of each of the distinct pieces are; those not kept yet are encoded."""
        at = pc.index_in(pieces, self.names)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if len(missing):
            fresh = pieces.take(pa.array(missing))
            ids = self._fresh(fresh.to_pylist())
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            at[missing] = len(self.names) + np.arange(len(missing))
            self.begins = np.append(self.begins, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.concatenate([self.flat, *ids])
            self.names = pa.concat_arrays([self.names, fresh])
        return at

    def _forget(self) -> None:
        """The older pieces go when there are too many."""
        gone = len(self.names) - self.KEPT // 2
        if len(self.names) > self.KEPT:
            first = int(self.begins[gone])
            self.names = pa.concat_arrays([self.names.slice(gone)])
            self.begins, self.lengths, self.flat = self.begins[gone:] - first, self.lengths[gone:].copy(), self.flat[first:].copy()

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's end), each word cut further where it is sure that no id crosses."""
        lists = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring_regex(words, TAIL, CUT.join(("\\1", "\\2"))), FEED, CUT.join(("\\1", "\n", "\\2"))), CUT)
        coded = lists.values.dictionary_encode()
        codes = self._places(coded.dictionary)[coded.indices.to_numpy()]
        ids, ends = _gathered(self.flat, self.begins, self.lengths, codes)
        self._forget()
        return ids, np.append(0, ends)[lists.offsets.to_numpy()[1:]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end)."""
        texts = texts.cast(pa.large_string())
        whole = np.full(len(texts), not self.cuts)
        if self.cuts:
            for odd in (pc.match_substring_regex(texts, SPACES), *(pc.match_substring(texts, t) for t in (CUT, *self.added))):
                whole |= odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(~whole), texts, ""), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # the first word of a text has no space before it
        firsts = words.take(pa.array(codes[offsets[:-1]]))
        flat, ends = self._words(pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type)), firsts]))
        codes[offsets[:-1]] = len(words) + np.arange(len(texts))
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        lengths = ends - begins
        rough = np.flatnonzero(whole)
        if len(rough):
            found = self._direct(texts.take(pa.array(rough)).to_pylist())
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            begins[len(words) + rough], lengths[len(words) + rough] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, *found])
        ids, ends = _gathered(flat, begins, lengths, codes)
        return ids, np.append(0, ends)[offsets[1:]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, with what it has kept."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


MANIFEST = "partition int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, batch_bytes: int = 8_000_000) -> DataFrame:
    """Writes the ids of all documents, each with ``end_id`` behind it, by ascending key, and returns the manifest.

    Documents are dealt to tasks by ranges of the key, so files in the manifest's order (``partition``,
    ``seq``) hold the documents in order; nulls come first, rows of one key in the order of their texts.
    A null text has no ids but the end.
    """

    def documents(batches: Iterator[pa.RecordBatch], end: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in batches:
            for part in slices(b, most_bytes=batch_bytes):
                ids, ends = encoder(tokenizer).encode(pa.concat_arrays([part.column(1)]))
                for key, own in zip(part.column(0).to_pylist(), np.split(ids, ends[:-1])):
                    yield key, np.concatenate([own, end])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seq = TaskContext.get().partitionId(), 0
        bits = width(encoder(tokenizer).tokenizer.get_vocab_size())
        rows = documents(batches, np.array([end_id], "<u4"))
        row = next(rows, None)
        while row is not None:
            uri = f"{folder}/part-{partition:06d}-{seq:05d}.tok"
            with whole_file(uri) as out:
                writer = TokenWriter(out, bits)
                while row is not None and writer.n_ids < file_ids:
                    writer.add(*row)
                    row = next(rows, None)
                writer.close()
                n_bytes = out.tell()
            yield pa.RecordBatch.from_pylist([{"partition": partition, "seq": seq, "path": uri, "n_docs": len(writer.keys), "n_ids": writer.n_ids, "n_bytes": n_bytes}], schema=schema)
            seq += 1
        pa.default_memory_pool().release_unused()

    schema = pa.schema([("partition", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    rows = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    # the manifest is stored, so the files are written once; its rows are a few for each task
    return stored(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document from the files: key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile(path)
                for s in range(0, f.n_docs, 4096):
                    e = min(f.n_docs, s + 4096)
                    crc = [zlib.crc32(f.document(i).tobytes()) for i in range(s, e)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.keys[s:e], pa.int64()), pa.array(base + f.starts[s:e]), pa.array(np.diff(f.starts[s : e + 1])), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])
                f.close()

    # one row a file: the running sum over all of them is over a short table
    before = Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = spread(files, manifest.agg(F.sum("n_bytes")).first()[0])
    return files.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def token_folder(spark) -> str:
    return scratch_path(spark, "tokens")

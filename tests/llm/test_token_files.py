import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import token_files
from tests.llm.common import empty_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(bits=st.integers(1, 32), n=st.integers(0, 300), seed=st.integers(0, 99))
@settings(max_examples=80, deadline=None)
def test_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-n * bits // 8)
    assert (token_files.unpack(data, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_random_access(tmp_path, bits):
    rng, path = np.random.default_rng(1), str(tmp_path / "x.tok")
    docs = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 3, 700, 1, 0, 2500, 40)]
    with open(path, "wb") as out:
        writer = token_files.TokenWriter(out, bits, block_ids=512)
        for k, ids in enumerate(docs):
            writer.add(None if k == 3 else k, ids)
        writer.close()
    f = token_files.TokenFile(f"file://{path}")
    assert f.keys == [0, 1, 2, None, 4, 5, 6]
    for k in (5, 0, 2, 6, 3, 1, 4):
        assert (f.document(k) == docs[k]).all()


PARTS = [*"aB., \n\t'é1-日\x85\r", "<|endoftext|>", "  ", "ab."]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_as_whole_texts(texts):
    encoder = token_files.encoder(PATH)
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    found = [list(x) for x in np.split(ids, ends[:-1])] if texts else []
    assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_hold_all_documents_in_order(spark):
    docs = odd_documents(spark)
    manifest = token_files.write_tokens(docs, token_files.token_folder(spark), PATH, 2, file_ids=3000)
    assert manifest.count() >= 4
    rows = token_files.read_tokens(manifest).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(PATH), 0
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda k: (k is not None, k or 0))
    have = {}
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        have.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in have.items()}


def test_empty_table(spark):
    manifest = token_files.write_tokens(empty_documents(spark), token_files.token_folder(spark), PATH, 2)
    assert token_files.read_tokens(manifest).count() == 0

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm import packing, token_files
from lakewarden.llm.common import shared_folder
from lakewarden.llm.queries import QUERIES, tokenizer_path
from lakewarden.llm.tokens import TokenIds


@pytest.fixture(scope="module")
def encoder():
    return TokenIds(tokenizer_path(), cache_size=50)


def whole(encoder, text):
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB é.,;!'\n\t 0<|> 　\x1c", max_size=30))
def test_cut_texts_give_the_tokenizers_ids(encoder, text):
    assert encoder(text) == whole(encoder, text)


def test_added_tokens_and_long_texts(encoder):
    for text in (None, "", "<|endoftext|> a<|endoftext|>", "word " * 50_000 + "end", "x" * 3000, "a\n\nb  c", " lead and trail "):
        assert encoder(text) == whole(encoder, text)


def test_a_known_word_with_marks_is_not_merged_again():
    encoder = TokenIds(tokenizer_path())
    encoder("so quayside harbour\u00e9 x"), encoder("quayside")

    class Merges:
        def tokenize(self, text):
            raise AssertionError(f"merged again: {text}")

    merging, encoder.model = encoder.model, Merges()
    for text in ("so quayside, harbour\u00e9; x!?", "quayside. x"):
        assert encoder(text) == whole(encoder, text)
    encoder.model = merging
    assert encoder("so newquay, \u00e9t\u00e9.") == whole(encoder, "so newquay, \u00e9t\u00e9.")


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_elias_fano_selects_and_decodes(steps):
    values = np.cumsum(steps)
    ef = token_files.EliasFano.encode(values)
    assert ef.decode().tolist() == values.tolist()
    assert [ef.select(k) for k in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 700))
    assert token_files.EliasFano.encode(values).size() < 10_000 * 13 / 8


def test_files_of_messy_rows(spark, messy, encoder):
    rows = [(5, "b c"), (None, "no id"), (2, None), (2, ""), (7, "same"), (7, "same"), (1, "long " * 5000), (-3, "a\n\nb")]
    path = shared_folder(spark, "test-files")
    token_files.write_token_files(messy(rows), path, tokenizer_path(), block_ids=100, partitions=3)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -3, 1, 2, 2, 5, 7, 7]
    start = 0
    expected = {i: sorted(zlib.crc32(whole(encoder, t) + b"\0\0\0\0") for j, t in rows if j == i) for i, _ in rows}
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        assert r["ids_crc32"] in expected[r["doc_id"]]
    blocks = spark.read.parquet(path)
    assert blocks.count() >= 3 and token_files.read_image(blocks.first()["payload"])[0].n >= 2


def test_files_of_no_rows(spark, messy):
    path = shared_folder(spark, "test-none")
    token_files.write_token_files(messy([]), path, tokenizer_path())
    assert token_files.read_token_files(spark, path).count() == 0


def test_op2_against_the_tokenizer(spark, sf_dir, documents, encoder):
    got = {r["doc_id"]: r for r in QUERIES["op2_token_files"](spark, sf_dir).collect()}
    start = 0
    for doc_id, text in documents.items():
        ids = whole(encoder, text) + b"\0\0\0\0"
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert len(got) == len(documents)


def check_pieces(pieces, texts, encoder, capacity=1024):
    ids = {}
    for doc_id, text in texts:
        ids.setdefault(doc_id, []).append(whole(encoder, text) + b"\0\0\0\0")
    bins = {}
    for p in pieces:
        assert any(zlib.crc32(x[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"] and len(x) // 4 == p["doc_tokens"] for x in ids[p["doc_id"]])
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(x) // 4 for xs in ids.values() for x in xs)
    padding = 0
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_op10_pieces(spark, sf_dir, documents, encoder):
    pieces = QUERIES["op10_packing"](spark, sf_dir).collect()
    padding = check_pieces(pieces, documents.items(), encoder)
    assert padding < 0.01 * sum(p["length"] for p in pieces)


def test_packing_messy_rows(spark, messy, encoder):
    rows = [(5, "b c"), (None, "no id"), (None, None), (2, ""), (7, "same"), (7, "same"), (1, "long " * 5000)]
    packed = packing.pack(messy(rows), tokenizer_path(), capacity=64)
    check_pieces(packed.collect(), rows, encoder, 64)
    lengths = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 256 for r in lengths)
    assert packing.pack(messy([]), tokenizer_path()).count() == 0


@given(st.integers(1, 5000), st.sampled_from([16, 64, 1024]))
@settings(max_examples=100, deadline=None)
def test_cuts_are_whole_and_in_reciprocal_classes(n, capacity):
    cuts = packing.cut_lengths(n, capacity, 16)
    assert sum(cuts) == n
    assert all(capacity % c == 0 for c in cuts[:-1])

"""Token counts, byte-level BPE and packing against the libraries themselves."""

import base64
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import documents, empty_documents, odd_texts, prose
from tokenizers import Tokenizer

from tamarack.llm import byte_bpe, common, packing, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TRICKY = odd_texts() + ["foo <|endoftext|> bar<|endoftext|>", " lead", "trail ", "a \n b\n  c\t d", " ", "  ", "a" * 3000 + " b", "é é", "\x00\x01 \x7f"]
TEXT = st.text(alphabet=st.sampled_from(list("abAB '’\n\t 123.,|<>éÉßΣς́ \x1c日本🎉")), max_size=60)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return {
        "json": Tokenizer.from_file(JSON), "words": Tokenizer.from_file(WORDS),
        "tiktoken": tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}),
    }


def test_token_counts(spark, library):
    docs = documents(spark, TRICKY)
    docs = docs.unionByName(docs.limit(3))
    got = token_counts.count_tokens(docs, JSON, limit=100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library["json"].encode(r.text or "", add_special_tokens=False))) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(empty_documents(spark), JSON).collect() == []


def test_long_texts_are_cut_safely(library, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 50)
    texts = [None, prose(5, 400), "", "  ".join(prose(i, 5) for i in range(40)), "x" * 500, prose(6, 3)]
    assert list(token_counts.token_lengths(texts, JSON)) == [len(library["json"].encode(t or "", add_special_tokens=False)) for t in texts]
    assert "".join(common.segments(texts[1], 50)) == texts[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_token_counts_of_any_text(library, texts):
    assert list(token_counts.token_lengths(texts, JSON)) == [len(library["json"].encode(t, add_special_tokens=False)) for t in texts]


def test_byte_bpe(spark, library):
    docs = documents(spark, TRICKY)
    encoded = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.decode_ids(encoded, RANKS).collect()}
    for r in docs.collect():
        ids = library["tiktoken"].encode_ordinary(r.text or "")
        assert bytes(got[r.doc_id].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[r.doc_id].n_tokens == len(ids)
        assert bytes(got[r.doc_id].decoded) == (r.text or "").encode()
    assert byte_bpe.encode_texts(empty_documents(spark), RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_byte_bpe_of_any_text(library, text):
    encoded = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN).encode(text)
    ids = library["tiktoken"].encode_ordinary(text)
    assert encoded == struct.pack(f"<{len(ids)}I", *ids) and byte_bpe.decode(encoded, RANKS) == text.encode()


def test_rank_files_need_all_ranks(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_words_of_any_text(library, texts):
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library["words"].encode_batch(texts, add_special_tokens=False)]
    assert packing.encode_words(texts, WORDS) == want


def check_packed(rows, limits, tokens_of):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(s) <= limits.segments and sum(max(r.length - 1, 0) for r in s) <= limits.loss_tokens
    for doc, pieces in by_doc.items():
        assert sorted((r.start, r.length, r.ids_crc32) for r in pieces) == sorted(tokens_of(doc))
    return len(sequences)


def test_packing(spark, library):
    docs = documents(spark, TRICKY + [prose(i, 900) for i in range(20)])
    texts = {r.doc_id: r.text for r in docs.collect()}

    def pieces(doc):
        ids = library["words"].encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 512):
            part = ids[at:at + 512]
            yield at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))

    made = packing.encode_pieces(docs, WORDS, 2, max_tokens=512, checksums=True)
    for limits in (packing.Limits(512, 256, 512), packing.Limits(512, 3, 512), packing.Limits(512, 256, 511)):
        rows = packing.pack(made, limits).collect()
        n = check_packed(rows, limits, pieces)
        assert {r.doc_id for r in rows} == set(texts)
        if limits.segments == 256 and limits.loss_tokens == 512:
            assert sum(r.length for r in rows) > 0.9 * 512 * n
    nothing = packing.encode_pieces(empty_documents(spark), WORDS, 2, checksums=True)
    assert packing.pack(nothing).collect() == []


def test_limits_of_the_registered_query(spark, tmp_path):
    """All three limits hold at the production parameters, the one on loss binds, and little is padded."""
    from tamarack.llm.queries import QUERIES

    docs = documents(spark, [prose(i, n) for i, n in enumerate([9000, 20_000, 3, 40, 2500] * 8)] + ["x"] * 3000, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op9_packing"](spark, str(tmp_path)).collect()
    limits = packing.Limits()
    used = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        for i, n in enumerate((r.length, 1, max(r.length - 1, 0))):
            used[r.sequence_id][i] += n
    assert all(t <= limits.tokens and s <= limits.segments and n <= limits.loss_tokens for t, s, n in used.values())
    assert any(n == limits.loss_tokens and t < limits.tokens for t, _, n in used.values())
    assert any(s == limits.segments for _, s, _ in used.values())
    assert sum(t for t, _, _ in used.values()) > 0.9 * limits.tokens * len(used)


def test_packing_keeps_columns_and_null_ids(spark):
    pieces = spark.createDataFrame([(None, 5, "x", 9), (2**60 + 1, None, "y", 8), (2**60 + 1, 7, None, None)], "doc_id long, length int, sequence_id string, own int")
    got = packing.pack(pieces, packing.Limits(8, 2, 8), loss="length")
    assert got.columns == ["doc_id", "length", "own", "sequence_id", "offset"]
    assert sorted((r.doc_id or 0, r.length or 0, r.own or 0) for r in got.collect()) == [(0, 5, 9), (2**60 + 1, 0, 8), (2**60 + 1, 7, 0)]


def test_dot_product_heuristic():
    rng = np.random.default_rng(1)
    items = np.stack([rng.integers(1, 100, 500), np.ones(500, int), rng.integers(0, 50, 500)], axis=1)
    limits = np.array([128, 5, 64])
    sequence, offset = packing.dot_product_packing(items, limits)
    n = sequence.max() + 1
    for s in range(n):
        assert (items[sequence == s].sum(axis=0) <= limits).all()
    assert n <= 1.1 * np.ceil((items.sum(axis=0) / limits).max())
    with pytest.raises(ValueError):
        packing.dot_product_packing(np.array([[200, 1, 0]]), limits)

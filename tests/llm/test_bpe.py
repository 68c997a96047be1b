"""Byte-level BPE against the public library that defines it."""

import base64
import hashlib

import public_tokenizers
import pytest
import regex
import tiktoken

from rubricspark.llm.bpe import Vocabulary, bpe_decode, bpe_encode
from rubricspark.llm.queries import BPE_RANKS, op2_byte_bpe


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    None,
    "",
    " ",
    "\n\n  \t x",
    "a",
    "don't we'll I'M 've",
    "naïve façade Ωμέγα 你好世界 🙂🙂‍🔥   \x85\x1c\x00",
    "x" * 5000,
    "ab" * 700 + "1234567890" * 60 + "!?" * 300,
    "<|endoftext|>",
    "The quick brown fox " * 2000,
    "asdkjhqwe zxcmnbqwpoeiru " * 3,
]


def test_matches_library(spark, library):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(3, ODD[3], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids long")
    out = bpe_decode(bpe_encode(df, BPE_RANKS, public_tokenizers.PATTERN), BPE_RANKS).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.token_ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_heap_and_matrix_agree():
    v = Vocabulary(open(BPE_RANKS, "rb").read())
    for p in ("the there then " * 9).split() + ["aaaaabbbbbab" * 9, "–—" * 20, "internationalisation" * 5]:
        raw = p.encode()
        (a,) = [x.tolist() for x in v.encode_pieces([raw])] if raw not in v.rank else ([v.rank[raw]],)
        if raw not in v.rank:
            assert a == v.merge_long(raw).tolist()


def test_forgetting_changes_nothing(library, monkeypatch):
    from rubricspark.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    v, cut = Vocabulary(open(BPE_RANKS, "rb").read()), regex.compile(public_tokenizers.PATTERN)
    for t in ODD[5:10]:
        assert v.encode_texts([t], cut)[0].tolist() == library.encode_ordinary(t)


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op2_byte_bpe(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_encode(df, BPE_RANKS, public_tokenizers.PATTERN).count() == 0

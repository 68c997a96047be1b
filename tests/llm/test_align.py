"""Cross-tokenizer alignment against plain Python over the two libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rubricspark.llm.align import Pairing, align_texts, align_tokenizers, byte_symbols, cut_groups
from rubricspark.llm.queries import BPE_JSON, PIECES, op12_align_tokenizers

ODD = [None, "", " ", "\n\n  \t x", "a", "don't we'll I'M", "naïve façade Ωμέγα 你好世界 🙂🙂‍🔥 \x85\x1c\x00", "▁ a▁b", "x" * 3000, "<s></s><unk><|endoftext|><0x41>", "The quick brown fox " * 400, "𝒜𝒷𐐀 ²½", "  two  spaces", "é́ ﬁ"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BPE_JSON)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def pairing():
    return Pairing(open(BPE_JSON, "rb").read(), open(PIECES, "rb").read())


def tokens(libraries, text):
    """(id, end) of the tokens of both, or nothing."""
    if not text:
        return [], []
    a, b = libraries
    symbols, want = byte_symbols(), (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return [], []
    out = []
    for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
        at, rows = 0, []
        for i, r in zip(ids, raw, strict=True):
            at += len(r)
            rows.append((i, at))
        out.append(rows)
    return out


def slow(libraries, texts):
    """texts: (key, text) to the contract's columns."""
    both = [(k, *tokens(libraries, t)) for k, t in texts]
    links, count = {}, Counter()
    for n, (_, a, b) in enumerate(both):
        links[n] = [(x, y) for x, i in a for y in [dict((e, y) for y, e in b).get(i)] if y is not None] if len(a) < 2000 else None
        if links[n] is None:
            by = {e: y for y, e in b}
            links[n] = [(x, by[i]) for x, i in a if i in by]
        count.update(links[n])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for n, (k, a, b) in enumerate(both):
        cuts, groups, i, j = sorted({e for _, e in a} & {e for _, e in b}), [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while i < len(a) and a[i][1] <= cut:
                ga.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][1] <= cut:
                gb.append(str(b[j][0]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        text = ";".join(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((k, len(a), len(b), len(cuts), len(links[n]), sum(count[x] == best[x[1]] for x in links[n]), sum(count[x] for x in links[n]), digest))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


def test_odd_texts(spark, libraries):
    data = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "a null id")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in data], "doc_id long, text string, n_a int, links string")
    got = align_tokenizers(df, BPE_JSON, PIECES)
    assert rows(got) == slow(libraries, data)
    assert {r.doc_id for r in got.filter("n_a = 0").collect()} == {0, 1, 7}


def test_groups_are_given(spark):
    (r,) = align_tokenizers(spark.createDataFrame([("k", "Hello tokens")], "name string, body string"), BPE_JSON, PIECES, "name", "body", keep_groups=True).collect()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") == r.n_groups - 1 and r.name == "k"


def test_query(spark, sf_dir, libraries):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows(op12_align_tokenizers(spark, sf_dir)) == slow(libraries, texts)


def test_cuts_are_the_common_ends():
    rng = random.Random(5)
    for n in range(120):
        top = rng.choice([1, 2, 30, 4000])
        chance = rng.choice([0.02, 0.3, 0.9])
        ea, eb = (np.array(sorted({x for x in range(1, top) if rng.random() < chance} | {top})) for _ in range(2))
        if n % 3 == 0:  # long one-to-one stretches, shifted
            eb = np.union1d(ea, [max(1, top // 3)])
        in_a, in_b = cut_groups(ea, eb, lane=rng.choice([1, 7, 256]), widest=rng.choice([1, 4, 64]))
        common = np.intersect1d(ea, eb)
        assert ea[in_a].tolist() == common.tolist() == eb[in_b].tolist()
    assert not cut_groups(ea[:0], eb[:0])[0].size


def test_pair_numbers_are_unique_and_bounded(pairing):
    y = pairing.b_ids()
    seen = {}
    by = {}
    for i, t in enumerate(pairing.b.tokens):
        by.setdefault(t, []).append(i)
    rng = random.Random(1)
    for x in rng.sample(range(len(pairing.a.tokens) - 1), 4000):
        for n in range(1, len(pairing.a.tokens[x]) + 1):
            for b in by.get(pairing.a.tokens[x][-n:], ()):
                k = int(pairing.number(np.array([x]), np.array([b]))[0])
                assert 0 <= k < pairing.size and y[k] == b and seen.setdefault(k, (x, b)) == (x, b)


def test_ranks_and_library_agree_on_the_basic_plane(pairing):
    far = np.zeros(1, bool)
    for before, after in (("a", "a"), ("1", "1"), ("!", "!")):
        for lo in range(0, 0x10000, 1024):
            text = [" ".join(before + chr(c) + after for c in range(lo, lo + 1024) if not 0xD800 <= c <= 0xDFFF)]
            assert pairing.a_coder.encode(text, far)[0] == pairing.a_coder.encode(text, ~far)[0]


def test_parts_of_a_batch_do_not_matter(pairing):
    texts = [t or "" for t in ODD]
    whole, alone = align_texts(pairing, texts), [align_texts(pairing, [t]) for t in texts]
    assert whole["groups_sha256"] == [x["groups_sha256"][0] for x in alone]
    assert whole["links"].tolist() == [k for x in alone for k in x["links"].tolist()]


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), BPE_JSON, PIECES).count() == 0
    assert P.path("byte_bpe_50k.json") == BPE_JSON

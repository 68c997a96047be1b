"""Suffix order, passages and removal against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from rubricspark.llm import induce, suffix
from rubricspark.llm.induce import suffixes_down
from rubricspark.llm.queries import op9_suffix_dedup
from rubricspark.llm.suffix import LENGTH, anchors, first_holders, remove_repeats


def slow_removal(rows):
    """rows: (doc_id, bytes). doc_id to (kept, removed, spans), rows of one id in order."""
    first = {}
    for d, raw in rows:
        for i in range(len(raw) - LENGTH + 1):
            w = raw[i : i + LENGTH]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, raw in rows:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            if first[raw[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out.append((d, len(raw), kept, int(gone.sum()), spans))
    return out


def common_prefix(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def shard(rng):
    base = rng.integers(97, 110, 500).astype(np.uint8)
    run = np.full(300, 97, np.uint8)
    return np.concatenate([base, base[100:300], base, base[50:], run, base, run[:280], base[::-1], base])


@pytest.mark.parametrize("limits", [{}, {"room": 64, "base": 4}, {"room": 2000, "base": 50}])
def test_suffixes_and_prefixes_are_brute_force(limits):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, k, n).astype(np.uint8) for n, k in ((0, 1), (1, 2), (2, 1), (60, 2), (300, 3), (300, 1), (2000, 256), (3000, 2))]
    for text in [*texts, shard(rng)]:
        raw = text.tobytes() + b"\0" * 64
        pos, lcp = (np.concatenate(x) for x in zip(*suffixes_down(text, **limits), strict=True))
        assert sorted(pos.tolist()) == list(range(len(raw)))
        cut = [raw[i : i + LENGTH] for i in pos]
        assert cut == sorted(cut, reverse=True)
        assert lcp[1:].tolist() == [common_prefix(a, b) for a, b in zip(cut, cut[1:], strict=False)]


def test_shard_beyond_its_memory(monkeypatch):
    """Under the limits as they are: queues and spool go to disk, seeds are ordered by their names."""
    spills, named = [], []
    spill, names = induce.TupleQueue._spill, induce._names
    monkeypatch.setattr(induce.TupleQueue, "_spill", lambda self: (spills.append(1), spill(self))[1])
    monkeypatch.setattr(induce, "_names", lambda *a: (named.append(1), names(*a))[1])
    rng = np.random.default_rng(5)
    block = rng.integers(97, 101, 3_500_000).astype(np.uint8)
    text = np.concatenate([block, block[1_000_000:1_500_000]])
    seen = np.zeros(len(text) + 64, bool)
    raw, before, repeats = text.tobytes() + b"\0" * 64, None, 0
    for pos, lcp in suffixes_down(text):
        assert not seen[pos].any()
        seen[pos] = True
        repeats += int((lcp == LENGTH).sum())
        for i in range(0, len(pos), 997):  # each 997th neighbour, and the first ones of each batch
            a, b = (before if i == 0 else pos[i - 1]), pos[i]
            if a is not None:
                x, y = raw[a : a + LENGTH], raw[b : b + LENGTH]
                assert x >= y and common_prefix(x, y) == lcp[i]
        before = pos[-1]
    assert seen.all() and spills and named
    assert repeats == 500_000 - 49 + 14  # the copied stretch, and the padding's own zeros


def test_first_holders():
    a, b = b"x" * 70, bytes(range(60)) + b"x" * 50
    got = first_holders([a, b, b"short"], np.array([7, 3, 1]))
    assert got.tolist() == [3] * 21 + [3] * 61


def test_anchors_agree_on_equal_passages():
    rng = np.random.default_rng(6)
    common = rng.integers(97, 101, 50).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes() + common + rng.integers(97, 101, m).astype(np.uint8).tobytes() for n, m in ((0, 0), (7, 90), (200, 3), (49, 49))]
    row, begin, count, h, digest = anchors(texts)
    for i, t in enumerate(texts):  # each passage has one anchor
        own = row == i
        assert sorted(x for b, n in zip(begin[own], count[own], strict=True) for x in range(b, b + n)) == list(range(len(t) - 49))
    at = [t.find(common) for t in texts]
    inside = [h[(row == i) & (begin <= a) & (a < begin + count)] for i, a in enumerate(at)]
    assert all(len(x) == 1 for x in inside) and len({int(x[0]) for x in inside}) == 1
    runs = [texts[r][b : b + n + 49] for r, b, n in zip(row, begin, count, strict=True)]
    assert len(set(runs)) == len(set(digest.tolist()))
    assert not len(anchors([b"", b"a" * 49])[0])


def test_query_is_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, kept, gone, spans in slow_removal(rows)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_odd_rows(spark, batch, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    request.addfinalizer(lambda before=spark.conf.get(key): spark.conf.set(key, before))
    spark.conf.set(key, batch)
    rng = np.random.default_rng(8)
    base = "".join(map(chr, rng.integers(97, 110, 400)))
    texts = [(5, base), (2, base[100:180]), (9, base[:60] + "ß" * 60 + base[120:]), (11, "é" + base[130:179] + "="), (12, "=" * 300), (13, "-" + "=" * 120), (14, "ß" * 40)]
    texts += [(20, base[:200]), (20, base[:200]), (21, None), (22, ""), (23, base[:49]), (24, base[:50]), (25, "ab" * 20000)]
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, raw int, kept string")
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in remove_repeats(df).collect())
    assert got == sorted(slow_removal([(d, (t or "").encode()) for d, t in texts]))
    assert remove_repeats(df.limit(0)).count() == 0
    # rows of one doc_id are cut each for itself
    other = "".join(map(chr, rng.integers(97, 110, 300)))
    texts = [(1, base), (2, base), (2, base), (2, other), (2, base[:55] + other[:90]), (2, "short"), (3, other[100:260] + base[:80]), (4, None), (4, "")]
    twins = spark.createDataFrame([(*t, 7) for t in texts], "doc_id long, text string, twin int")
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in remove_repeats(twins).collect())
    assert got == sorted(slow_removal([(d, (t or "").encode()) for d, t in texts]))
    none = spark.createDataFrame([(None, base), (1, base)], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_repeats(none).collect()) == [0, 0]


def test_pieces_do_not_show(monkeypatch):
    """Anchors, runs and digests are the same however many bytes are hashed at once."""
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(97, 101, int(n)).astype(np.uint8)) for n in (0, 49, 50, 51, 700, 0, 3000, 84)] + [b"x" * 400, b"ab" * 300]
    monkeypatch.setattr(suffix, "_PIECE", 1 << 22)
    whole = suffix.anchors(texts)
    for piece in (1, 7, 64, 501):
        monkeypatch.setattr(suffix, "_PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(suffix.anchors(texts), whole, strict=True))


def test_settling_needs_the_hash_order_only(monkeypatch):
    """Rows of one hash may come in any order and in batches of any size; the smallest document of each surroundings stays."""
    r = np.random.default_rng(4)
    h, digest, doc = r.integers(0, 40, 600), r.integers(0, 3, 600), r.integers(0, 50, 600)
    k1, k2 = (h << 16) | digest // 2, (digest % 2 << 40) | (1 << 34) | np.arange(600)
    first = {}
    for key, d in zip(zip(h.tolist(), digest.tolist(), strict=True), doc.tolist(), strict=True):
        first[key] = min(d, first.get(key, d))
    lost = sorted(i for i in range(600) if doc[i] > first[h[i], digest[i]])
    for size, together in ((600, 1 << 16), (7, 1), (50, 120)):
        monkeypatch.setattr(suffix, "TOGETHER", together)
        order = np.lexsort((r.permutation(600), k1))
        cells = [pa.array(x[order]) for x in (k1, k2, doc, np.zeros(600, np.int64))]
        whole = pa.RecordBatch.from_arrays(cells, names=["k1", "k2", "doc_id", "twin"])
        out = [b for b in suffix._settle(whole.slice(lo, size) for lo in range(0, 600, size))]
        assert sorted((at & ((1 << 34) - 1)) for b in out for at, of in zip(b.column("at").to_pylist(), b.column("h").to_pylist(), strict=True) if of is None) == lost

"""Fingerprints, links and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from rubricspark.llm import simhash
from rubricspark.llm.components import connected_components
from rubricspark.llm.queries import op5_simhash
from rubricspark.llm.simhash import fingerprint, keep_one, simhash_components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    """rows: (doc_id, fp)."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = np.array([f for _, f in rows], np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = find(rows[i][0]), find(rows[int(j)][0])
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in rows}


def test_fingerprint_by_hand():
    for t in (None, "", " \n", "One", "a b c", "A b C d", "É ß x\x0by\x0cz w a b c d e", "a b c d " * 50, "x\x85y z", "aa bb cc"):
        assert fingerprint((t or "").encode()) == slow_fingerprint(t), t


def test_query_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    component = slow_components(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{f:016x}", component[d]) for d, f in want}


@pytest.mark.parametrize("bucket", [2048, 12])
def test_links_of_dense_and_hot_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    fps = {0, 2**63, 2**64 - 1}
    for centre in rng.integers(0, 2**63, 6):  # balls, some joined by chains
        for _ in range(60):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for _, f in rows], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    as_int = {int(np.uint64(f).view(np.int64)): i for i, f in rows}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    edges = spark.createDataFrame([(as_int[a], as_int[b]) for a, b in links], "a long, b long")
    got = {i: i for i, _ in rows} | {r.node: r.root for r in connected_components(edges).collect()}
    assert got == slow_components(rows)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 70)] + [(200, x) for x in range(201, 260)] + [(300, 300), (400, 401), (401, 400)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 71)} | {i: 200 for i in range(200, 260)} | {400: 400, 401: 400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (None, "zz", 3), (9, "A B c D e F", 4), (7, "q w " * 30000, 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp long, _first int, component_id string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash_components(df).collect())
    assert [x for x in got if x[0]] == [(1, 1), (2, 1), (3, 3), (3, 3), (7, 7), (9, 3)]
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 7]
    assert simhash_components(df.limit(0)).count() == 0
    assert keep_one(df.limit(0)).count() == 0

"""The epsilon grid order join against all pairs."""

import duckdb
import numpy as np
import pytest

from rubricspark.llm import ego
from rubricspark.llm.ego import epsilon_join
from rubricspark.llm.queries import op10_embedding_join


def slow(rows):
    """rows: (id, vector or None) with distinct ids."""

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    use = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if good(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    m = np.stack([v for _, v in use])
    for k, (i, v) in enumerate(use):
        for j in np.flatnonzero(m @ v >= 0.9):
            if j != k:
                links[i] += 1
                a, b = find(i), find(use[j][0])
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i in links}


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert as_dict(op10_embedding_join(spark, sf_dir)) == slow(rows)


@pytest.mark.parametrize("block", [512, 16])
def test_groups_of_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ego, "BLOCK", block)
    monkeypatch.setattr(ego, "MOST_TILE", 2)
    monkeypatch.setattr(ego, "FAN", 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    v = centres[rng.integers(0, 20, 400)] + 0.35 * rng.normal(size=(400, 12))
    rows = [(1000 + i, x.tolist()) for i, x in enumerate(v)] + [(i, v[0].tolist()) for i in range(50)] + [(60 + i, (v[1] * (i + 1)).tolist()) for i in range(30)]
    rows += [(100, None), (101, [0.0] * 12), (102, [float("nan")] + [1.0] * 11), (103, [None] + [1.0] * 11), (104, [float("inf")] + [1.0] * 11), (105, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, v string")
    assert as_dict(epsilon_join(df)) == slow(rows)


def test_sql_says_the_same(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet' UNION ALL SELECT 9001, NULL, 0 UNION ALL SELECT 9002, list_value(0::FLOAT), 0")
    want = {r[0]: r[1:] for r in con.sql(ego.OP10_SQL).fetchall()}
    got = as_dict(op10_embedding_join(spark, sf_dir)) | {9001: (0, 9001, True), 9002: (0, 9002, True)}
    assert got == want


def test_pairs_of_blocks_are_brute_force(spark):
    rng = np.random.default_rng(4)
    low = np.cumsum(rng.uniform(0, 0.2, (150, 2)), axis=0) % 3
    high = low + rng.uniform(0, 0.3, (150, 2))
    boxes = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(low, high, strict=True))], "block long, low array<double>, high array<double>")
    gap = np.maximum(0, np.maximum(low[:, None] - high, low - high[:, None]))
    want = {(i, j) for i, j in zip(*np.nonzero((gap * gap).sum(axis=2) <= 0.25), strict=True) if i <= j}
    got = [(r.x, r.y) for r in ego.block_pairs(boxes, 150, 2, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 150 * 151 / 2


def test_forest_joins_what_is_hit():
    rng = np.random.default_rng(6)
    for _ in range(30):
        forest, up = ego.Forest(24), list(range(24))
        for _ in range(4):
            x, y, hit = rng.permutation(24)[:9], rng.permutation(24)[:7], rng.uniform(size=(9, 7)) < 0.12
            forest.join(x, y, hit)
            for i, j in zip(*np.nonzero(hit), strict=True):
                a, b = up[x[i]], up[y[j]]
                up = [min(a, b) if u in (a, b) else u for u in up]
        assert forest.roots(np.arange(24)).tolist() == up


def test_odd(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(((r.vec_id or 0, r.n_links) for r in epsilon_join(df).collect())) == [(0, 0), (1, 1), (1, 1), (2, 0)]
    assert epsilon_join(df.limit(0)).count() == 0
    assert {r.n_links for r in epsilon_join(df.filter("vec_id = 2")).collect()} == {0}

"""The conversation trie against a plain one, and sums over subtrees against a walk."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from rubricspark.llm import trie
from rubricspark.llm.queries import op11_conversation_trie
from rubricspark.llm.trie import OP11_SQL, centroid_sums, conversation_trie, ordered_sums, rollup

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    child = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            child[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += child[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(built[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), child[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_and_sql(spark, sf_dir):
    path = f"{sf_dir}/conversations.parquet"
    got = rows_of(op11_conversation_trie(spark, sf_dir))
    assert got == slow([tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    want = con.sql(OP11_SQL)
    assert want.columns == COLUMNS and sorted(want.fetchall(), key=repr) == got


ODD = [(0, None, "u", "first"), (0, 1, None, "x"), (0, 1, "a", None), (0, 2, "u", "é"), (0, 2, "u", "é"), (None, 0, "u", "lost"), (3, 5, "u", "only"), (7, 0, "u", "x" * 50000), (12, -1, "", ""), (-4, 0, "u", "neg"), (-4, 1, "u", "neg"), (14, 2, "b", "tie"), (14, 2, "a", "tie")]


def test_odd(spark, monkeypatch):
    monkeypatch.setattr(trie, "LOCAL", 6)
    data = ODD + [(500 + i, t, "u", "same") for i in range(30) for t in range(9)] + [(1000, t, "u", f"turn {t}") for t in range(400)] + [(1001, t, "u", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id long, turn long, role string, text string, depth int, comp string")
    assert rows_of(conversation_trie(df)) == slow(data)
    assert conversation_trie(df.limit(0)).count() == 0


def forest(kind, n, rng):
    if kind == "path":
        return [None] + list(range(n - 1))
    if kind == "star":
        return [None] + [0] * (n - 1)
    if kind == "broom":
        return [None] + [i if i < n // 2 else n // 2 for i in range(n - 1)]
    if kind == "roots":
        return [None if rng.random() < 0.2 or not i else rng.randrange(i) for i in range(n)]
    return [None] + [rng.randrange(max(0, i - 9), i + 1) for i in range(n - 1)]


def walked(parent, weight):
    total = list(weight)
    for i in range(len(parent) - 1, -1, -1):  # parents come first
        if parent[i] is not None:
            total[parent[i]] += total[i]
    return total


@pytest.mark.parametrize("kinds", [["broom"], ["path", "star", "roots", "random", "one"]])
def test_rollup(spark, monkeypatch, kinds):
    """One tree, and several at once that are forests of their own."""
    monkeypatch.setattr(trie, "LOCAL", 12)
    monkeypatch.setattr(trie, "PART", 10)
    monkeypatch.setattr(trie, "BUFFER", 30)
    rng, parent = random.Random(len(kinds)), []
    for kind in kinds:
        tree = forest("path", 1, rng) if kind == "one" else forest(kind, 45, rng)
        parent += [None if p is None else p + len(parent) for p in tree]
    name = [f"n{x}" for x in rng.sample(range(1000), len(parent))]
    weight = [rng.randrange(-5, 100) for _ in parent]
    df = spark.createDataFrame([(name[i], None if p is None else name[p], weight[i], 1) for i, p in enumerate(parent)], "me string, boss string, w long, one int")
    got = {r.me: (r.w, r.one) for r in rollup(df, ["w", "one"], "me", "boss").collect()}
    assert got == dict(zip(name, zip(walked(parent, weight), walked(parent, [1] * len(parent)), strict=True), strict=True))


def test_cycle_and_empty(spark, monkeypatch):
    monkeypatch.setattr(trie, "MOST_JUMPS", 4)
    df = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, parent long, w long")
    with pytest.raises(ValueError):
        rollup(df, ["w"])
    assert rollup(df.limit(0), ["w"]).count() == 0


def test_rounds_are_logarithmic_and_sums_right():
    rng = random.Random(3)
    for kind in ("path", "star", "broom", "random"):
        parent = forest(kind, 700, rng)
        kids = {}
        for i, p in enumerate(parent):
            kids.setdefault(p, []).append(i)
        order, stack = [], [0]
        while stack:
            order.append(stack.pop())
            stack += reversed(kids.get(order[-1], []))
        pre = {v: k + 1 for k, v in enumerate(order)}
        size = walked(parent, [1] * len(parent))
        w = np.array([[rng.randrange(100)] for _ in order])
        up = np.array([pre[parent[v]] if parent[v] is not None else 0 for v in order])
        sizes = np.array([size[v] for v in order])
        rounds = []
        real = np.argsort
        try:
            np.argsort = lambda *a, **k: (rounds.append(1), real(*a, **k))[1]
            got = centroid_sums(np.ones(700, int), np.arange(1, 701), up, sizes, sizes, w)
        finally:
            np.argsort = real
        weight = [0] * 700
        for k, v in enumerate(order):
            weight[v] = int(w[k, 0])
        want = walked(parent, weight)
        assert [int(x) for x in got[:, 0]] == [want[v] for v in order] and len(rounds) <= 11


def test_ordered_sums_cross_partitions(spark):
    data = [(1, i) for i in range(500)] + [(2, 3), (3, 1), (3, 2)]
    df = spark.createDataFrame(data, "k long, i long")
    got = {(r.k, r.i): r.s for r in ordered_sums(df.repartition(7), "k", ["i"], {"s": df.i + 1}, ["k", "i"]).collect()}
    assert got == {(k, i): sum(j + 1 for q, j in data if q == k and j <= i) for k, i in data}

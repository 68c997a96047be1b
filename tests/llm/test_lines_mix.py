"""Line dedup against DuckDB, and the mix against its rules."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rubricspark.llm.common import running_offset
from rubricspark.llm.lines import OP1_SQL, dedup_lines
from rubricspark.llm.mix import block_quota, fill_targets, mix_sources, mixed_documents, permute, taken_words
from rubricspark.llm.queries import op1_line_dedup, op6_mix_sources

# names that the operators use inside
INNER = ["h1", "size", "block", "_text", "_gone", "_digest", "_copy", "_spans", "digest", "copy", "Taken"]
SCHEMA = "doc_id long, text string, source string, n_chars long, n_lines string, " + ", ".join(f"{c} int" for c in INNER)


def odd(spark):
    shared = "all rights reserved\n  shared line \nown"
    rows = [(i, f"{shared} {i}\n\n \t", f"s{i}", 9) for i in range(9)] + [(20, "shared line", None, 1), (21, None, "s1", None), (22, "", None, 0)]
    rows += [(23, "w " * 20000, "s1", 1), (24, "twice", "s2", 1), (24, "twice", "s2", 1), (24, "twice not", "s2", 1)]
    rows += [(None, "own null 7", "s1", 1), (None, "own null 7", "s1", 1)]
    return spark.createDataFrame([(*r, "x", *range(len(INNER))) for r in rows], SCHEMA)


def same_as_sql(df, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(OP1_SQL).fetchall()
    got = [tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_removed").collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_lines_query(spark, sf_dir):
    same_as_sql(op1_line_dedup(spark, sf_dir), duckdb.sql(f"select * from '{sf_dir}/documents.parquet'").to_arrow_table())


def test_lines_odd(spark):
    df = odd(spark)
    same_as_sql(dedup_lines(df), df.toPandas())
    out = dedup_lines(df)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].n_removed == 0 and by[1].text == "own 1\n\n \t" and by[1].n_chars == len(by[1].text)
    assert by[20].text == "" and by[21].text is None
    assert {tuple(r[c] for c in INNER) for r in out.collect()} == {tuple(range(len(INNER)))}
    assert dedup_lines(df.limit(0)).count() == 0


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"shared {i % 50}" if i % 2 else f"own {i}" for i in range(100_000))
    rows = [(i, long if i == 9 else "\n".join(f"shared {j}" for j in range(50)), f"s{i}") for i in range(10)]
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].n_removed == 0 and out[9].n_lines == 100_000
    assert out[9].n_removed == 50_000 and out[9].text == "\n".join(f"own {i}" for i in range(0, 100_000, 2))


def check_mix(out):
    rows = pd.DataFrame([r.asDict() for r in out])
    assert (rows["taken"] <= 3 * rows["size"]).all()
    return rows


def test_mix_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").toPandas()
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    rows = check_mix(op6_mix_sources(spark, sf_dir).collect())
    assert dict(zip(rows["doc_id"], rows["size"], strict=True)) == words
    rows["source"] = rows["doc_id"].map(docs.set_index("doc_id")["source"])
    total = defaultdict(int)
    for d, s in zip(docs["doc_id"], docs["source"], strict=True):
        total[s] += words[d]
    names = sorted(total)
    want = dict(zip(names, fill_targets([total[n] for n in names], [i % 3 + 1 for i in range(len(names))], 3), strict=True))
    for s, part in rows.groupby("source"):
        assert (part["source_size"] == total[s]).all() and np.allclose(part["target"], want[s])
        assert abs(part["taken"].sum() - want[s]) < 0.05 * want[s] + 256
    again = {r.doc_id: r.taken for r in op6_mix_sources(spark, sf_dir).collect()}
    assert again == dict(zip(rows["doc_id"], rows["taken"], strict=True))


def slow_mix(sizes, weights, starts, seed=20, block=64, slots=1024, most=3):
    """Draw, permutation and join in plain loops. sizes, weights: by source; starts: (source, start, size) of documents. Words taken of each."""
    target = fill_targets(sizes, weights, most)
    blocks = [-(-n // block) for n in sizes]
    want = [t * b / n if n else 0.0 for t, b, n in zip(target, blocks, sizes, strict=True)]
    quota = block_quota(np.array(want), np.array(blocks), most).tolist()
    total, drawn, over, held = sum(quota), [0] * len(sizes), [], []
    for shard in range(-(-total // slots)):
        n = np.random.default_rng([seed, shard]).multinomial(min(slots, total - shard * slots), np.array(quota) / total)
        for s, k in enumerate(n.tolist()):
            for j in range(drawn[s], drawn[s] + k):
                (held if j < quota[s] else over).append((s, j))
            drawn[s] += k
    places = [(s, j) for s in range(len(sizes)) for j in range(drawn[s], quota[s])]
    assert len(places) == len(over)
    times = Counter()
    for s, j in held + places:  # which overflow goes where does not matter once all places are taken
        k, at = divmod(j, blocks[s])
        times[s, int(permute(np.array([at]), blocks[s], seed * 1_000_003 + s * most + k)[0])] += 1
    return [sum(times[s, w // block] for w in range(a, a + n)) for s, a, n in starts], quota, over


def test_mix_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = mix_sources(docs)
    held = mix.documents.collect()
    names = sorted({(r.source_no, r.source_size) for r in held})
    ends = defaultdict(int)  # documents of a source are packed without gaps
    for r in sorted(held, key=lambda r: (r.source_no, r.start, r.size)):
        assert r.start == ends[r.source_no]
        ends[r.source_no] += r.size
    want, quota, over = slow_mix([n for _, n in names], [i % 3 + 1 for i in range(len(names))], [(r.source_no, r.start, r.size) for r in held])
    assert over  # draws beyond a target did happen
    got = {(r.doc_id, r.taken) for r in taken_words(mix).collect()}
    assert got == {(r.doc_id, t) for r, t in zip(held, want, strict=True)}
    slots = Counter((r.source_no, r.slot) for r in mix.slots.collect())
    assert slots == Counter((s, j) for s, q in enumerate(quota) for j in range(q))


def test_every_tenth_of_the_shards_has_the_shares_of_the_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slots = mix_sources(docs, block=4, shard_slots=32).slots.groupBy("shard", "source_no").count().collect()
    shards = max(r.shard for r in slots) + 1
    of_source, tenths = Counter(), Counter()
    for r in slots:
        of_source[r.source_no] += r["count"]
        tenths[r.source_no, r.shard * 10 // shards] += r["count"]
    assert shards > 200 and len(of_source) > 5
    for s, n in of_source.items():
        for t in range(10):
            assert abs(tenths[s, t] - n / 10) <= 5 * (n / 10) ** 0.5 + 2, (s, t, n, tenths[s, t])


def test_offsets_of_many_groups(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 7).alias("v"), F.lit(0).alias("_group"))
    out = running_offset(df, ["k"], ["id"], "v", "at", per_group=2)
    rows = sorted((r.k, r.at, r.v) for r in out.collect())
    assert len(rows) == 6000 and out.columns == ["k", "id", "v", "_group", "at"]
    for k in (0, 1):
        spans = sorted((a, a + v) for kk, a, v in rows if kk == k and v)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_targets_and_permutation():
    assert fill_targets([100, 100], [1, 1], 3) == [100.0, 100.0]
    assert fill_targets([10, 90, 0], [3, 1, 2], 3) == [30.0, 70.0, 0.0]
    assert fill_targets([], [], 3) == [] and fill_targets([0, 0], [1, 2], 3) == [0.0, 0.0]
    t = fill_targets([5, 10, 985], [2, 3, 1], 3)
    assert t == [15.0, 30.0, 955.0] and sum(t) == 1000
    for n in (1, 2, 3, 64, 65, 1000):
        assert sorted(permute(np.arange(n), n, 7).tolist()) == list(range(n))


def test_mix_odd(spark):
    df = odd(spark)
    rows = check_mix(taken_words(mix_sources(df)).collect())
    assert len(rows) == df.count()
    assert sorted(rows["source_size"].unique())[-1] >= 20000
    out = mixed_documents(df, mix_sources(df))
    assert out.columns == df.columns
    made = Counter()
    for r in out.collect():
        made[-1 if r.doc_id is None else r.doc_id] += len((r.text or "").split())
        assert r.n_chars == len(r.text)
    want = rows.fillna({"doc_id": -1}).groupby("doc_id")["taken"].sum()
    assert {d: n for d, n in want.items() if n} == {d: n for d, n in made.items() if n}
    assert taken_words(mix_sources(df.limit(0))).count() == 0
    assert mixed_documents(df.limit(0), mix_sources(df.limit(0))).count() == 0

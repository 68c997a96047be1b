"""Stores, streams and ranks under repetition, failure and hot keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rubricspark.operators import brands as B
from rubricspark.operators import extract as P
from rubricspark.operators import usage as L
from rubricspark.operators.chunk import chunk_documents, register_chunker, register_table_chunker
from rubricspark.operators.order import rank_by_ranges
from rubricspark.plans import fixtures as X
from rubricspark.sources import io
from rubricspark.sources.shared import drop_stored, stored
from rubricspark.streaming import stream as T


def plan_of(df):
    return df._jdf.queryExecution().toString()


# --- stores -------------------------------------------------------------------------------------------


def test_store_is_read_by_bucket_and_repeats_change_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    one = docs.filter("doc_id = 7")
    assert io.append_documents(docs.filter("doc_id < 300"), path, "a").count() == 300
    files = sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet"))
    assert io.append_documents(one, path, "b").isEmpty()
    assert sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet")) == files
    held = io.read_store(spark, path, [r.b for r in one.select(io.bucket_of("doc_id").alias("b")).collect()])
    assert "PartitionFilters: [isnotnull(bucket" in plan_of(held) or "PartitionFilters: [(bucket" in plan_of(held)
    held.collect()
    read = held._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numPartitions").value()
    assert read == 1
    for _ in range(2):
        assert io.append_documents(docs, path, "b").count() == 200
    assert Counter(r.batch for r in io.read_store(spark, path).collect()) == {"a": 300, "b": 200}
    changed = io.append_documents(docs.withColumn("text", F.lit("new")).filter("doc_id >= 300"), path, "b")
    assert {r.text for r in changed.collect()} == {"new"} and io.read_store(spark, path).count() == 500


def test_store_takes_odd_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, text string")
    assert io.append_documents(rows, path, "2024-01-01").count() == 2
    assert io.append_documents(rows, path, "2024-01-02").isEmpty()
    assert io.append_documents(rows.limit(0), str(tmp_path / "none"), "x").count() == 0


def test_files_are_pruned_by_name(spark, tmp_path):
    texts = spark.createDataFrame([(f"p{i}.md", f"text {i}") for i in range(9)] + [("q.html", "x"), ("empty.md", None)], "filename string, markdown string")
    folder = f"file://{tmp_path}/files"
    written = io.write_texts(texts, folder)
    assert {(r.path.rsplit("/", 1)[-1], r.length) for r in written.collect()} >= {("p3.md", 6), ("empty.md", 0)}
    io.write_texts(texts, folder)
    some = io.read_markdown(spark, folder, ["p3", "p7", "absent"])
    assert {(r.stem, r.markdown) for r in some.collect()} == {("p3", "text 3"), ("p7", "text 7")}
    read = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert read == 2
    assert io.read_markdown(spark, folder).count() == 9  # an empty file has no row


def client(log, fail_at=None):
    """A client that keeps what it is asked in files, and may fail."""
    log = str(log)

    def ask(contents):
        import os
        import uuid

        if fail_at and any(fail_at in c for c in contents):
            raise OSError("the service is down")
        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(contents))
        return [c.upper() for c in contents]

    return ask


def test_a_job_begun_again_asks_only_what_is_not_stored(spark, tmp_path):
    (tmp_path / "log").mkdir()
    prompts = spark.createDataFrame([(f"prompt {i % 90}", "m", i) for i in range(200)], "content string, model string, max_tokens int")
    store = str(tmp_path / "answers")
    with pytest.raises(Exception, match="down"):
        B.call_client(prompts, client(tmp_path / "log", "prompt 77"), store, 2, 4)
    before = B.read_answers(spark, store).count()
    assert 0 < before < 90
    answers = B.call_client(prompts, client(tmp_path / "log"), store, 3, 4)
    assert {r.response for r in answers.collect()} == {f"PROMPT {i}" for i in range(90)}
    asked = Counter(line for f in (tmp_path / "log").iterdir() for line in f.read_text().split("\n"))
    assert set(asked.values()) == {1} and len(asked) == 90
    more = prompts.unionByName(spark.createDataFrame([("another", "m", 1)], prompts.schema))
    assert B.call_client(more, client(tmp_path / "log"), store).count() == 91
    assert B.read_answers(spark, store).count() == 91
    assert B.call_client(prompts.limit(0), client(tmp_path / "log"), str(tmp_path / "no")).count() == 0


def test_stored_tables_can_be_dropped(spark):
    t = stored(spark.range(3))
    assert t.count() == 3 and drop_stored(spark) >= 1


# --- chunks and answers -------------------------------------------------------------------------------


def test_table_function_gives_the_same_chunks(spark, sf_dir):
    docs = X.docs(spark, sf_dir).unionByName(X.order_markdown(spark, sf_dir)).unionByName(spark.createDataFrame([(-1, "n.pdf", None), (-2, "e.pdf", "")], "doc_id long, filename string, markdown string"))
    docs.createOrReplaceTempView("to_cut")
    register_chunker(spark, "cut_up")
    register_table_chunker(spark, "cut_all")
    got = spark.sql("SELECT c.* FROM to_cut AS t, LATERAL cut_up(t.doc_id, t.filename, t.markdown) AS c")
    whole = spark.sql("SELECT * FROM cut_all(TABLE(SELECT doc_id, filename, markdown FROM to_cut))")
    want = chunk_documents(docs)
    key = lambda df: sorted((r.doc_id, r.chunk_seq, r.chunk_id, r.text, tuple(r.columns), tuple(r.metadata)) for r in df.collect())
    assert key(got) == key(whole) == key(want) and want.count() > 400
    assert "Exchange" not in plan_of(spark.sql("SELECT * FROM cut_all(TABLE(SELECT doc_id, filename, text AS markdown FROM (SELECT 1L AS doc_id, 'f' AS filename, 'x' AS text)))"))


def test_odd_inputs_do_not_stop_a_job(spark):
    docs = spark.createDataFrame([(3, None, "# A\n\ntext"), (4, "x.pdf", None)], "doc_id long, filename string, markdown string")
    assert [(r.chunk_id, r.metadata.pdf) for r in chunk_documents(docs).collect()] == [("3_0000", None)]
    deep = '{"a":' * 200_000 + "1" + "}" * 200_000
    rows = spark.createDataFrame([(1, deep), (2, '{"policy_has_pso": "Yes", "brands_relevant_to_pso": [{"brand": "b"}]}'), (3, None)], "id long, response string")
    got = {r.id: (r.answer.policy_has_pso, r.error) for r in B.parse_brand_json(rows).collect()}
    assert got == {1: ("No", "nested too deeply"), 2: ("Yes", None), 3: ("No", None)}
    assert [r.id for r in P.parse_param_json(rows).collect()] == [2]


# --- ranks and windows --------------------------------------------------------------------------------


def test_rank_of_one_file_is_spread(spark):
    rng = random.Random(4)
    rows = [("one" if rng.random() < 0.8 else f"f{rng.randrange(9)}", rng.choice([None, *range(50)]), i) for i in range(4000)] + [(None, 3, -1), (None, 9, -2)]
    df = spark.createDataFrame(rows, "file string, score int, pos long").repartition(5)
    out = rank_by_ranges(df, ["file"], [F.col("score").desc_nulls_last(), F.col("pos")], "rank")
    want = {}
    for name in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {(r[0], r[2]): k for k, r in enumerate(mine, 1)}
    assert {(r.file, r.pos): r.rank for r in out.collect()} == want
    # the stored ranges of the one file lie in many parts
    parts = df.repartitionByRange(8, "file", F.col("score").desc_nulls_last(), "pos").filter("file = 'one'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 5


def test_rolling_usage_in_a_hot_minute(spark):
    rng = random.Random(8)
    times = [rng.randrange(60_000_000) for _ in range(800)] + [30_000_000] * 400 + [90_000_000, 90_000_001, 150_000_000] + [-5, -60_000_005]
    rows = [(i, "m" if i % 5 else None, t, i % 17) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "i long, model string, us long, tokens long").withColumn("ts", F.timestamp_micros("us"))
    df = df.unionByName(spark.createDataFrame([(9000, "m", None, 1, None), (9001, "m", None, 2, None)], df.schema))
    got = {r.i: (r.requests, r.used) for r in L.rolling_usage(df).collect()}
    for i, m, t, _ in rows:
        mine = [x for _, n, s, x in rows if n == m and t - 60_000_000 <= s <= t]
        assert got[i] == (len(mine), sum(mine))
    assert got[9000] == got[9001] == (2, 3) and len(got) == len(rows) + 2
    assert L.rolling_usage(df.limit(0)).count() == 0


# --- streams ------------------------------------------------------------------------------------------


def test_a_batch_that_failed_between_its_two_writes_is_done_once(spark, tmp_path, monkeypatch):
    schema = "filename string, pos long, error string"
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 1, "bad"), ("b", 2, None), ("c", 1, None)], schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"), lambda batch: batch)
    real = T.split_failures

    def broken(df):
        good, bad = real(df)
        return good, bad.withColumn("error", F.raise_error(F.lit("lost")).cast("string"))

    monkeypatch.setattr(T, "split_failures", broken)
    with pytest.raises(Exception, match="lost"):
        T.stream_scores(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 3  # the first write was done
    monkeypatch.setattr(T, "split_failures", real)
    for _ in range(2):
        T.stream_scores(*args).awaitTermination()
    assert sorted((r.filename, r.pos) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == [("a", 1), ("a", 2), ("c", 1)]
    assert [(r.filename, r.error) for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()] == [("b", "bad")]


def test_stream_keeps_open_windows_and_counts_late_rows(spark, tmp_path):
    def drop(rows):
        df = spark.createDataFrame(rows, "s long, model string, tokens long").select(F.timestamp_seconds("s").alias("ts"), "model", "tokens")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = T.stream_usage(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        return T.late_groups(query)

    assert drop([(1000, "m", 1), (1200, "m", 2)]) == 0
    assert drop([(1195, "m", 4), (1000, "m", 100), (2000, "m", 8)]) == 6  # one row, in six windows
    out = {(r.start.timestamp()): (r.requests, r.used) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for s, t in ((1000, 1), (1200, 2), (1195, 4)):
        for start in range(s // 10 * 10 - 50, s // 10 * 10 + 1, 10):
            n, u = want.get(start, (0, 0))
            want[start] = (n + 1, u + t)
    assert out == want  # the window of the last row is still open

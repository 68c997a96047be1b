"""Cases worked by hand, and properties."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rubricspark.functions.splitting import chunk_text, recursive_split, segment_markdown, split_table
from rubricspark.operators import brands as B
from rubricspark.operators import clean as C
from rubricspark.operators import extract as P
from rubricspark.operators import search as R
from rubricspark.operators import usage as L
from rubricspark.operators.score import access_score, flatten_params
from rubricspark.params import PARAMS
from rubricspark.sources import io


def test_splits():
    assert recursive_split("aa bb cc dd ee", 10, 3) == ["aa bb cc", "cc dd ee"]
    assert recursive_split("abc defghijklm n", 10, 3) == ["abc", "abc defghi", "ghijklm", "n"]
    assert recursive_split("# T\n## A\nxxxx\n## B\nyyyyyyyy", 20, 5) == ["# T##A\nxxxx", "B\nyyyyyyyy"]
    assert recursive_split(" \n ") == [] and recursive_split(" a ") == ["a"]


def test_tables():
    head = "| a | b |\n|---|---|\n"
    rows = [f"| {i} | {'x' * 20} |" for i in range(5)]
    table = head + "\n".join(rows) + "\n"
    chunks = split_table(table, 80)
    assert all(c.startswith(head.strip()) for c in chunks)
    assert [r for c in chunks for r in c.splitlines()[2:]] == rows
    assert split_table(table) == [table.strip()]
    assert split_table("| a |\n|" + "-" * 90 + "|\n", 80) == []
    text = "before\n" + table + "| last | row |"
    assert segment_markdown(text) == [(False, "before\n"), (True, table), (False, "| last | row |")]
    found = list(chunk_text("# One\nprose\n" + table + "## Two\nmore"))
    assert [(c[1], c[3]) for c in found] == [(False, "One"), (True, "One"), (False, "Two")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n#é", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_chunks_are_never_blank_or_long(text, size, overlap):
    out = recursive_split(text, size, overlap)
    assert all(c.strip() and len(c) <= size for c in out)
    assert bool(out) == bool(text.strip()) or not text.strip(". \n#")
    assert "".join(t for _, t in segment_markdown(text)) == text


def test_scores(spark):
    row = dict.fromkeys(PARAMS, "NA")
    other = dict(zip(PARAMS, ["18 years", "text", "1", "2", "No", "Y", "12", "12", "Yes", "text", "dermatologist", "NA"], strict=True))
    t = spark.createDataFrame([("a", row | {"brand": "X"}), ("b", other), ("c", {})], "filename string, params map<string,string>")
    out = {r.filename: r for r in access_score(flatten_params(t)).collect()}
    assert (out["a"].access_score, out["b"].access_score, out["c"].access_score) == (82, 63, 82)
    assert out["a"].brand == "X" and out["c"].brand == "" and out["c"]["Age"] == "NA"


def test_bm25_and_fusion(spark):
    chunks = spark.createDataFrame([(1, "c0", 0, "a b"), (1, "c1", 1, "a c"), (1, "c2", 2, "a a d")], "doc_id long, chunk_id string, chunk_seq long, text string")
    idf = {r.term: round(r.idf, 4) for r in R.bm25_index(chunks).collect()}
    assert idf == {"a": -0.0258, "b": 0.5108, "c": 0.5108, "d": 0.5108}
    corpus = {r.term: round(r.idf, 4) for r in R.bm25_index(chunks, []).collect()}
    assert corpus == idf
    hits = "query_id long, doc_id long, chunk_id string, rank int"
    fused = R.rrf_fuse(spark.createDataFrame([(0, 1, "x", 1), (0, 1, "y", 2)], hits), spark.createDataFrame([(0, 1, "y", 1), (0, 1, "z", 2)], hits))
    assert {r.chunk_id: round(r.rrf_score, 6) for r in fused.collect()} == {"y": 0.032522, "x": 0.016393, "z": 0.016129}


def test_table_rows(spark):
    cells = [["Group", "Drug"], ["A", "x\n y"], ["Group", "Drug"], ["", ""], ["B", ""]]
    t = spark.createDataFrame([(1, 0, 0, i, c) for i, c in enumerate(cells)], "doc_id long, page_no int, table_no int, row_no int, cells array<string>")
    t = t.withColumn("cells", C.normalize_cells(F.col("cells")))
    _, data = C.detect_table_header(t)
    assert C.rows_to_markdown(data).first().markdown == "# Prior Authorization Detail\n\n\n## A\n\n**Drug:** x y\n\n## B\n"


def test_strict_json(spark):
    texts = ["{'a':'x'}", '{"a":"x"} tail', '{"a":"x"} foo {"b":"y"}', 'x {"a": null, "b": true, "c": 1.50} y', "", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, response string")
    assert {r.i: r.params for r in P.parse_param_json(t).collect()} == {1: {"a": "x"}, 3: {"a": "None", "b": "True", "c": "1.5"}}
    brands = ['{"policy_has_pso": "Yes", "brands_relevant_to_pso": [{"brand": "Aa (b)"}, {"brand": 5}]}', "none", '{"brands_relevant_to_pso": [{"brand": " q (z) "}]}']
    t = spark.createDataFrame([(i, x) for i, x in enumerate(brands)], "i int, response string")
    out = {r.i: r for r in B.parse_brand_json(t).collect()}
    assert out[0].error and out[1].answer.policy_has_pso == "No" and not out[1].error
    assert out[2].answer.policy_has_pso is None and out[2].answer.brands_relevant_to_pso[0].brand == "Q"


def test_prompts(spark):
    t = spark.createDataFrame([("{x}", "y")], "a string, b string")
    assert t.select(B.render_prompt("{a} {{b}} {b}{a}", a=F.col("a"), b=F.col("b"))).first()[0] == "{x} {b} y{x}"


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [r.filename for r in io.read_manifest(spark, str(tmp_path)).collect()] == ["a.pdf"]
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "p.q.md").write_text("é\nb")
    assert [tuple(r) for r in io.read_markdown(spark, str(tmp_path / "md")).collect()] == [("p.q", "p.q.pdf", "é\nb", 4)]
    try:
        io.read_manifest(spark, str(tmp_path / "md"))
    except ValueError as e:
        assert "no PDF" in str(e)
    else:
        raise AssertionError
    scores = spark.createDataFrame([("f", 'B "q", r', *["", None, *["x\ny"] * 10], 7)], ", ".join(f"`{c}` string" for c in io.CSV_COLUMNS[:-1]) + ", access_score int")
    io.write_scores_csv(scores, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"')
    assert back.columns == io.CSV_COLUMNS and back.first().brand == 'B "q", r'


def test_blanks_of_a_policy_are_those_of_unicode(spark):
    df = spark.createDataFrame([("keep\nPassword\u00a0:\u00a0abc\nlogin =\u2003me\nend",)], "t string")
    assert df.select(C.redact_credentials(F.col("t"))).first()[0] == "keep\nend"


def test_tabular_route_is_redacted_on_request(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    kind = docs.withColumn("is_tabular", F.lit(True))
    text = docs.withColumn("markdown", F.lit("a\nlogin: me\nb"))
    one = lambda **k: C.route_conversion(docs, kind, text, text, **k).first().markdown
    assert one() == "a\nlogin: me\nb" and one(redact_tabular=True) == "a\nb"


def test_default_encoder(spark):
    """Against a plain count of hashed words."""
    texts = ["One two two", "", None, "x " * 500, "ÄÖ ß"]
    out = R.embed_chunks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in out:
        want = [0.0] * 64
        for w in (texts[r.doc_id] or "").lower().split():
            h = zlib.crc32(w.encode())
            want[h % 64] += 1 if h >> 16 & 1 else -1
        size = sum(x * x for x in want) ** 0.5
        assert all(abs(a - (b / size if size else 0)) < 1e-9 for a, b in zip(r.embedding, want, strict=True))


@pytest.mark.parametrize("scope", [["doc_id"], []])
def test_sparse_search_is_the_ranking_of_all_pairs(spark, scope):
    """Few hits, many hits, hits that score below zero, and queries without any."""
    rows = [(d, i, f"{d}_{i}", " ".join(w for k, w in enumerate("alpha beta gamma delta".split()) if (d * 7 + i) % (k + 2) == 0) + " common") for d, n in ((1, 1), (2, 9), (3, 40)) for i in range(n)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_seq long, chunk_id string, text string").cache()
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "common"), (3, "nothing here"), (4, "delta common alpha"), (5, "")], "query_id long, query string")
    index = R.bm25_index(chunks, scope)
    cols = ["query_id", "doc_id", "chunk_id", "chunk_seq", "score", "rank"]
    for n in (3, 12):
        want = R.sparse_top(R.bm25_scores(chunks, index, queries), n, scope).select(*cols).collect()
        got = R.sparse_search(chunks, index, queries, n, scope).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) >= 15


def test_rolling_usage_over_stretches(spark):
    rows = [(m, s, s % 7) for m in "ab" for s in (0, 1, 59, 60, 60, 61, 119, 120, 121, 179, 181, 400)]
    df = spark.createDataFrame(rows, "model string, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    for r in L.rolling_usage(df).collect():
        mine = [t for m, s, t in rows if m == r.model and r.s - 60 <= s <= r.s]
        assert (r.requests, r.used) == (len(mine), sum(mine))

"""Jobs that must reach every row of their input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubricspark.functions.hooks import hashing_encoder, overlap_scorer
from rubricspark.functions.ranking import hybrid_ranks
from rubricspark.functions.splitting import chunk_text
from rubricspark.operators import search as R
from rubricspark.operators.brands import BRAND_PROMPT
from rubricspark.operators.extract import PARAM_PROMPT
from rubricspark.params import ANCHOR_QUERY, BRAND_QUERIES, BRAND_QUERY, COMMON_QUERIES, CONTEXT_JOIN, KINDS, PARAMS
from rubricspark.plans import fixtures as X
from rubricspark.plans.catalog import QUERIES
from rubricspark.plans.jobs import score_policies


def test_tables_of_answers_reach_every_gated_document(spark, sf_dir):
    docs = X.docs(spark, sf_dir).filter("trim(markdown) <> ''")
    want = {r.filename for r in docs.filter("doc_id % 4 <> 0").collect()}
    cells = [F.concat(F.lit(f', "{p}": "'), F.col(f"`{p}`"), F.lit('"')) for p in PARAMS]
    answers = X.param_rows(spark, sf_dir).groupBy("brand").agg(F.min_by(F.concat(F.lit('{"brand": "'), F.col("brand"), F.lit('"'), *cells, F.lit("}")), "pos").alias("answer_text"))
    out = score_policies(docs, X.policy_answers(spark, sf_dir), answers).select("filename", "brand", "access_score").collect()
    assert {r.filename for r in out} == want
    assert len({(r.filename, r.brand) for r in out}) == len(out)


def slow_policies(docs):
    """(filename, brand, values) of the policy job with the stand-in model, document by document."""
    out = []
    for name, text in docs:
        if not (chunks := [c[0] for c in chunk_text(text or "")]):
            chunks = []
        vectors = hashing_encoder(chunks).astype(np.float32).astype(float)

        def search(query, top, chunks=chunks, vectors=vectors):
            return hybrid_ranks(chunks, np.arange(len(chunks)), vectors, [query], hashing_encoder([query]), [top], overlap_scorer)[0] if chunks else []

        first = list(dict.fromkeys(c for q in BRAND_QUERIES for c in search(q, 3)))
        context = CONTEXT_JOIN.join(chunks[c] for c in first) if first else text or ""
        h = zlib.crc32(BRAND_PROMPT.replace("{{", "{").replace("}}", "}").replace("{policy_text}", context[:4000]).encode())
        digit = lambda k, h=h: h // k % 5 + 1
        if h % 5 == 0:
            continue
        for brand in dict.fromkeys([f"BRAND#{digit(k)}{digit(5 * k)}" for k in (1, 11, 131)][: h % 3 + 1]):
            found = search(ANCHOR_QUERY.replace("{brand}", brand), 3) + search(BRAND_QUERY.replace("{brand}", brand), 4)
            found = list(dict.fromkeys(found + [c for q in COMMON_QUERIES for c in search(q, 2)] * bool(found)))[:4]
            context = CONTEXT_JOIN.join(chunks[c] for c in found)
            if not context.strip():
                continue
            slots = {"brand_name": brand, "preferred_status": "Unspecified", "chunks": context}
            prompt = re.sub(r"\{\{|\}\}|\{(\w+)\}", lambda m, slots=slots: slots[m[1]] if m[1] else m[0][0], PARAM_PROMPT)
            h = zlib.crc32(prompt.encode())
            values = [X.VALUES[KINDS[p]][h // k % len(X.VALUES[KINDS[p]])] for p, k in zip(PARAMS, X.STEPS, strict=True)]
            own = re.search(r"(Brand#\d+|BRAND#\d+)", prompt)[1]
            out.append((name, own, *values))
    return sorted(out)


def test_policy_job_is_its_plain_form_and_follows_the_texts(spark, sf_dir, tmp_path):
    docs = [(r.filename, r.markdown) for r in X.docs(spark, sf_dir).collect()]
    rows = lambda df: sorted((r.filename, r.brand, *(r[p] for p in PARAMS)) for r in df.collect())
    got = rows(QUERIES["workload_policies"](spark, sf_dir))
    assert got == slow_policies(docs) and len(got) > 100
    name = got[0][0]
    told = F.concat(F.lit("policy_"), "doc_id", F.lit(".pdf")) == name
    changed = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.when(told, F.concat(F.lit("Other words first. "), "text")).otherwise(F.col("text")))
    changed.write.parquet(str(tmp_path / "documents.parquet"))
    again = rows(QUERIES["workload_policies"](spark, str(tmp_path)))
    assert [r for r in got if r[0] != name] == [r for r in again if r[0] != name] and again != got


def test_search_job_is_its_plain_form(spark, sf_dir):
    questions = sorted((r.query_id, r.query) for r in X.all_questions(spark, sf_dir).collect())
    scopes = {}
    for r in X.all_chunks(spark, sf_dir).collect():
        scopes.setdefault(r.doc_id, []).append((r.chunk_seq, r.chunk_id, r.text))
    want = []
    for scope, chunks in scopes.items():
        chunks.sort()
        texts, asked = [t for _, _, t in chunks], [q or "" for _, q in questions]
        found = hybrid_ranks(texts, np.array([s for s, _, _ in chunks]), hashing_encoder(texts), asked, hashing_encoder(asked), [10] * len(asked), overlap_scorer)
        want += [(q, scope, chunks[c][1], k) for (q, _), ranks in zip(questions, found, strict=True) for k, c in enumerate(ranks, 1)]
    assert sorted((r.query_id, r.doc_id, r.chunk_id, r.rank) for r in QUERIES["workload_search"](spark, sf_dir).collect()) == sorted(want)


def _asks(spark, folder):
    """Answers that depend on the prompt's text: a brand for each marker that it holds, steps from its context."""
    calls = []

    def ask(prompts):
        mark = F.regexp_extract("content", r"marker(\w+)", 1)
        brands = F.concat(F.lit('{"policy_has_pso": "Yes", "brands_relevant_to_pso": [{"brand": "'), mark, F.lit('"}]}'))
        steps = F.concat(F.lit('{"Number of Steps through Brands": "'), F.length("content").cast("string"), F.lit('", "brand": "'), F.upper(mark), F.lit('"}'))
        calls.append(prompts.count())
        out = f"{folder}/answers{len(calls)}"
        prompts.select("prompt_key", F.when(F.col("model") == "brands", brands).otherwise(steps).alias("response")).write.parquet(out)
        return spark.read.parquet(out)

    return ask, calls


def test_policy_answers_follow_what_was_retrieved(spark, tmp_path):
    def run(texts, folder):
        docs = spark.createDataFrame([(i, f"policy_{i}.pdf", t) for i, t in enumerate(texts)], "doc_id long, filename string, markdown string")
        ask, calls = _asks(spark, str(tmp_path / folder))
        return {r.filename: r.brand for r in score_policies(docs, ask=ask).select("filename", "brand").collect()}, calls

    plain = "# Plaque psoriasis\n\nPreferred products: markeralpha is preferred for plaque psoriasis."
    got, calls = run([plain, plain, "# Plaque psoriasis\n\nPreferred products: markerbeta for plaque psoriasis."], "a")
    assert got == {"policy_0.pdf": "ALPHA", "policy_1.pdf": "ALPHA", "policy_2.pdf": "BETA"}
    assert calls == [2, 2]  # equal prompts are one question
    changed, _ = run([plain, plain.replace("markeralpha", "markergamma"), ""], "b")
    assert changed == {"policy_0.pdf": "ALPHA", "policy_1.pdf": "GAMMA"}
    with pytest.raises(ValueError, match="answers"):
        score_policies(spark.createDataFrame([], "doc_id long, filename string, markdown string"))


def test_search_reaches_documents_without_a_vector(spark, sf_dir, tmp_path):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents").withColumn("doc_id", F.col("doc_id") * 13)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read("embeddings").limit(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    read("benchmark").limit(8).write.parquet(str(tmp_path / "benchmark.parquet"))
    index = R.bm25_index(X.all_chunks(spark, str(tmp_path))).select("chunk_id").distinct().count()
    assert index == docs.filter(r"text rlike '\\S'").count()
    sizes = {r.s: r["count"] for r in docs.groupBy(F.floor(F.col("doc_id") / 1000).alias("s")).count().collect()}
    assert len(sizes) == 3  # scopes grow with the ids
    out = QUERIES["workload_search"](spark, str(tmp_path)).collect()
    got = Counter((r.query_id, r.doc_id) for r in out)
    assert got == {(q, s): min(10, n) for q in range(8) for s, n in sizes.items()}
    vectors = {r.vec_id for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()}
    assert {int(r.chunk_id.split("_")[2]) for r in out} - vectors

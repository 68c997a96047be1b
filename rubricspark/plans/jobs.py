"""Whole jobs: policies to scored rows (A), and the ranked report (C). Job B is operators.search.hybrid_search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hooks import Encoder, PairScorer, hashing_encoder, overlap_scorer
from ..functions.ranking import hybrid_ranks
from ..functions.scoring import access_band
from ..functions.splitting import chunk_text
from ..operators.brands import (
    BRAND_PROMPT,
    complete_prompts,
    dedupe_brands,
    distinct_prompts,
    explode_brands,
    gate_policies,
    parse_brand_json,
    render_prompt,
)
from ..operators.extract import drop_empty_context, parameter_prompt, parse_param_json
from ..operators.report import brands_per_file, rank_in_file
from ..operators.score import access_score, flatten_params
from ..params import ANCHOR_QUERY, BRAND_QUERIES, BRAND_QUERY, COMMON_QUERIES, CONTEXT_CHARS, CONTEXT_CHUNKS, CONTEXT_JOIN
from ..sources.shared import stored


#: Documents that a worker reads at once.
READ_ROWS = 256


def rank_policies(params: DataFrame) -> DataFrame:
    """Parameter rows to the report: score, band, rank in the file, brands of the file. One file may hold all rows."""
    out = rank_in_file(access_score(params)).withColumn("band", access_band(F.col("access_score")))
    counts = brands_per_file(out.select("filename"))
    out = out.alias("l").join(counts.alias("r"), F.col("l.filename").eqNullSafe(F.col("r.filename"))).select("l.*", "r.brands")
    return out.select("filename", "brand", "pos", "access_score", "band", "rank", "brands")


def read_policies(docs: DataFrame, encoder: Encoder = hashing_encoder, scorer: PairScorer = overlap_scorer) -> DataFrame:
    """doc_id, policy_text, common, texts, vectors: each document cut into chunks, encoded and searched for what all are asked.

    A document is one row, and all that it is asked concerns its own chunks: nothing is shuffled. ``policy_text`` is what
    ``collect_context`` and ``assemble_context`` give for the brand queries, ``common`` the best two chunks of each common query in order,
    ``texts`` and ``vectors`` (float32, row by row) the chunks. Ranks are those of operators.search.hybrid_search.
    """
    queries = [*BRAND_QUERIES, *COMMON_QUERIES]
    tops = [3] * len(BRAND_QUERIES) + [2] * len(COMMON_QUERIES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.asarray(encoder(queries), float)
        for batch in (b.slice(lo, READ_ROWS) for b in batches for lo in range(0, b.num_rows, READ_ROWS)):
            ids, markdown = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("markdown").to_pylist()]
            chunks = [[c[0] for c in chunk_text(t)] if t else [] for t in markdown]
            vectors = np.asarray(encoder([c for own in chunks for c in own]), np.float32).reshape(sum(map(len, chunks)), asked.shape[1])
            rows, at = [], 0
            for own, text in zip(chunks, markdown, strict=True):
                mine = vectors[at : at + len(own)]
                at += len(own)
                found = hybrid_ranks(own, np.arange(len(own)), mine.astype(float), queries, asked, tops, scorer)
                first = dict.fromkeys(c for f in found[: len(BRAND_QUERIES)] for c in f)
                context = CONTEXT_JOIN.join(own[c] for c in first) if first else text
                rows.append((context[:CONTEXT_CHARS], list(dict.fromkeys(c for f in found[len(BRAND_QUERIES) :] for c in f)), own, mine.tobytes()))
            cells = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cells], names=["doc_id", "policy_text", "common", "texts", "vectors"])

    return docs.select("doc_id", "markdown").mapInArrow(read, "doc_id long, policy_text string, common array<int>, texts array<string>, vectors binary")


def brand_contexts(read: DataFrame, brands: DataFrame, encoder: Encoder = hashing_encoder, scorer: PairScorer = overlap_scorer) -> DataFrame:
    """doc_id, brand, preferred_status, context: of each brand the first chunks among its anchors, its own hits and the common ones.

    ``read``: doc_id, common, texts, vectors of ``read_policies``; ``brands``: doc_id, pos, brand, preferred_status, each brand once.
    They meet once, one row a document. The order is that of ``brand_context``.
    """
    named = brands.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "brand", "preferred_status"))).alias("brands"))  # a document's brands: one answer's
    fill = lambda template, brand: template.replace("{brand}", brand)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, READ_ROWS) for b in batches for lo in range(0, b.num_rows, READ_ROWS)):
            rows = batch.to_pylist()
            asks = sorted({fill(t, b["brand"]) for r in rows for b in r["brands"] for t in (ANCHOR_QUERY, BRAND_QUERY)})
            place, encoded = {q: i for i, q in enumerate(asks)}, np.asarray(encoder(asks), float)
            out = []
            for r in rows:
                own = [fill(t, b["brand"]) for b in r["brands"] for t in (ANCHOR_QUERY, BRAND_QUERY)]
                vectors = np.frombuffer(r["vectors"], np.float32).reshape(len(r["texts"]), -1) if r["texts"] else np.zeros((0, 1))
                found = hybrid_ranks(r["texts"], np.arange(len(r["texts"])), vectors.astype(float), own, encoded[[place[q] for q in own]], [3, CONTEXT_CHUNKS] * len(r["brands"]), scorer)
                for b, anchors, hits in zip(r["brands"], found[::2], found[1::2], strict=True):
                    chosen = list(dict.fromkeys([*anchors, *hits, *(r["common"] if anchors or hits else ())]))[:CONTEXT_CHUNKS]
                    out.append((r["doc_id"], b["brand"], b["preferred_status"], CONTEXT_JOIN.join(r["texts"][c] for c in chosen)))
            cells = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "brand", "preferred_status", "context"])

    met = read.select("doc_id", "common", "texts", "vectors").join(named, "doc_id")
    return met.mapInArrow(search, "doc_id long, brand string, preferred_status string, context string")


def _answered(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Prompts with answer_text: one question for each distinct prompt, answers looked up by prompt key."""
    return complete_prompts(prompts, ask(distinct_prompts(prompts))).withColumnRenamed("response", "answer_text")


def score_policies(
    docs: DataFrame,
    brand_answers: DataFrame | None = None,
    param_answers: DataFrame | None = None,
    *,
    ask: Callable[[DataFrame], DataFrame] | None = None,
    encoder: Encoder = hashing_encoder,
    scorer: PairScorer = overlap_scorer,
    brand_model: str = "brands",
    param_model: str = "parameters",
    max_tokens: int = 1024,
) -> DataFrame:
    """Job A: policies to scored rows, with hybrid search for all four kinds of queries.

    docs: doc_id, filename, markdown. ``ask`` takes distinct prompts (prompt_key, model, content, max_tokens) and returns a
    written table of prompt_key, response, such as what operators.brands.call_client gives once it is stored: it is read
    more than once. In place of models, tables of answers may be given: brand_answers (doc_id, answer_text) and
    param_answers (brand, answer_text); these do not depend on the prompts.
    """
    if ask is None and (brand_answers is None or param_answers is None):
        raise ValueError("either ask, or both tables of answers")
    read = stored(read_policies(docs, encoder, scorer))

    def prompts_of(rows: DataFrame, model: str, content: Column) -> DataFrame:
        return rows.withColumns({"content": content, "model": F.lit(model), "max_tokens": F.lit(max_tokens)})

    context = read.select("doc_id", "policy_text")
    if brand_answers is None:
        context = _answered(prompts_of(context, brand_model, render_prompt(BRAND_PROMPT, policy_text=F.col("policy_text"))), ask)
    else:
        context = context.join(brand_answers, "doc_id")
    found = parse_brand_json(context, "answer_text").filter("error IS NULL")
    brands = dedupe_brands(explode_brands(gate_policies(found)))
    prompts = drop_empty_context(brand_contexts(read, brands, encoder, scorer))
    prompts = prompts_of(prompts, param_model, parameter_prompt(F.col("brand"), F.col("preferred_status"), F.col("context")))
    if param_answers is None:
        # stored, for it is read twice: for the questions, and to give each row its answer
        answers = _answered(stored(prompts.select("doc_id", "brand", "content", "model", "max_tokens")), ask)
    else:
        answers = prompts.join(param_answers.withColumn("brand", F.upper("brand")), "brand")
    rows = parse_param_json(answers, "answer_text").join(docs.select("doc_id", "filename"), "doc_id")
    return access_score(flatten_params(rows))

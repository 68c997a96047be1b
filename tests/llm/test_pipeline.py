"""Each stage of the corpus pipeline on what its predecessor kept, against brute force."""

import base64
import re
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

from rubricspark.llm.langid import fit_languages, identify_language, learnable
from rubricspark.llm.mix import fill_targets
from rubricspark.llm.queries import BPE_RANKS
from test_simhash import slow_components, slow_fingerprint

pipeline = pytest.importorskip("corpus_pipeline")
BLANK = " \t\n\x0b\x0c\r"


def slow_lines(rows):
    """doc_id to text without lines of eight sources or more, but for the first place."""
    sites, first = defaultdict(set), {}
    for d, text, source in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            if bare := line.strip(BLANK):
                sites[bare].add(source)
                first.setdefault(bare, (d, i))
    out = {}
    for d, text, _ in rows:
        keep = [x for i, x in enumerate(text.split("\n")) if not (b := x.strip(BLANK)) or len(sites[b]) < 8 or first[b] == (d, i)]
        out[d] = "\n".join(keep)
    return out


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stage_rows = docs.columns, {}
    model = fit_languages(learnable(docs))
    rejected = {r.doc_id for r in identify_language(docs, model, ["doc_id"]).collect() if r.rejected}
    stage_rows["documents"] = docs.collect()
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        stage_rows[name] = docs.collect()

    known = stage_rows["language_id"]
    assert {r.doc_id for r in known} == {r.doc_id for r in stage_rows["documents"]} - rejected
    assert len(rejected) < 0.01 * len(known)

    clean = {r.doc_id: r.text for r in stage_rows["line_dedup"]}
    assert clean == slow_lines([(r.doc_id, r.text, r.source) for r in known])

    component = slow_components([(d, slow_fingerprint(t)) for d, t in clean.items()])
    kept = {r.doc_id: r for r in stage_rows["simhash"]}
    assert set(kept) == {d for d, c in component.items() if d == c} and all(r.text == clean[d] for d, r in kept.items())

    words = {d: re.findall(r"[^\x20\x09-\x0D]+", r.text) for d, r in kept.items()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, w in words.items():
        sizes[kept[d].source] += len(w)
    times = defaultdict(int)
    for r in stage_rows["mix_sources"]:
        mine = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        taken[r.source] += len(mine)
        times[r.doc_id] += 1
        rest = iter(words[r.doc_id])
        assert all(w in rest for w in mine) and r.n_chars == len(r.text)  # in order
    assert max(times.values()) <= 3
    names = sorted(sizes)
    for n, t in zip(names, fill_targets([sizes[n] for n in names], [i % 3 + 1 for i in range(len(names))], 3), strict=True):
        assert abs(taken[n] - t) < 0.05 * t + 256

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in stage_rows["mix_sources"])
    got = sorted((r.doc_id, list(r.token_ids)) for r in stage_rows["byte_bpe"])
    assert got == want and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in stage_rows["byte_bpe"])


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "12", "en", None, 2), (None, "one two", None, "a", 7), (4, "x " * 30000, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, "unused")
            assert out.count() <= 3 * len(rows), name
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    docs.collect()

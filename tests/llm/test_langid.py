"""Kneser-Ney against its formula, and accuracy on rows that nothing was learned from."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubricspark.llm import langid
from rubricspark.llm.langid import KneserNey, _grams, _symbols, fit_languages, identify_language, language_filter
from rubricspark.llm.queries import op4_language_id


def slow_model(texts):
    """Interpolated Kneser-Ney straight from the definition: a function of a 4-character string."""
    level = Counter()
    for t in texts:
        s = "\0\0\0" + t
        level.update(s[i : i + 4] for i in range(len(s) - 3))
    levels = [level]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def p(g):
        if not g:
            return 1 / 65536
        counts = levels[4 - len(g)]
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        own = {h: v for h, v in counts.items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        return max(counts[g] - d if g in own else 0, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(g[1:])

    return p


def test_kneser_ney_is_the_formula():
    texts = ["abracadabra", "banana band", "a cab", "dab drab"]
    symbols = [_symbols(t.replace(" ", "x")) for t in texts]
    gram, n = np.unique(np.concatenate([_grams(s) for s in symbols]), return_counts=True)
    model, slow = KneserNey.fit(gram, n), slow_model([t.replace(" ", "x") for t in texts])
    for t in ("banabra", "zzz", "dracab"):
        g = _grams(_symbols(t))
        want = [math.log(slow(("\0\0\0" + t)[i : i + 4])) for i in range(len(t))]
        assert np.allclose(model.log_prob(g), want, atol=1e-4)


def test_symbols():
    assert _symbols("A1b").tolist() == [0, 0, 0, 97, 0, 98]
    assert not _symbols("12 !?").any()
    assert _symbols("").tolist() == [0, 0, 0]
    # a letter beyond U+FFFF is no other letter: its two surrogates
    assert _symbols("a\U00020061").tolist() == [0, 0, 0, 97, 0xD840, 0xDC61]
    assert not _symbols("\U0001F600").any() and _symbols("\U00010400").tolist() == _symbols("\U00010428").tolist()


def test_score_takes_every_character(spark):
    train = spark.createDataFrame([(i, x * 30, x) for i in range(8) for x in ("ab", "ac")], "doc_id long, text string, lang string")
    model = fit_languages(train)
    out = identify_language(spark.createDataFrame([(n, "ab" * n) for n in (2, 200)], "doc_id long, text string"), model).collect()
    short, long = (next(r.score for r in out if r.doc_id == n) for n in (2, 200))
    assert long > short


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = op4_language_id(spark, sf_dir).join(docs, "doc_id").collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in out) <= 0.01 * len(out)


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, "the cat sat on the mat and that was that " * 3, "en") for i in range(20)] + [(50 + i, "der Hund und die Katze ging nach Haus ", "de") for i in range(20)] + [(99, None, "en"), (98, "x", None), (97, "12", "de")], "doc_id long, text string, lang string")
    model = fit_languages(train)
    assert model.languages == ["de", "en"]
    rows = [(1, None, 1), (2, "", 1), (3, "12 34", 1), (4, "the mat that sat", 1), (4, "the mat that sat", 1), (5, "und die Katze", 1), (None, "the cat", 1), (6, "qzxj" * 50, 1), (7, "the cat and " * 100000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = identify_language(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred == "en" and by[5].lang_pred == "de" and by[None].lang_pred == "en" and by[7].lang_pred == "en"
    assert by[6].rejected and not by[4].rejected
    assert identify_language(df.limit(0), model).count() == 0
    nothing = fit_languages(train.limit(0))
    assert {r.lang_pred for r in identify_language(df, nothing).collect()} == {"und"}
    assert language_filter(spark, train).columns == train.columns
    assert language_filter(spark, train.limit(0)).count() == 0


def test_tables_give_what_broadcast_models_give(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    docs = docs.withColumn("_row", F.lit(1)).withColumn("_number", F.lit("x"))
    docs = docs.unionByName(spark.createDataFrame([(900, None, "en"), (901, "12 34", None), (902, "qzxj" * 50, None), (903, "ΩЖ漢", None)], "doc_id long, text string, lang string").withColumn("_row", F.lit(1)).withColumn("_number", F.lit("x"))).cache()
    want = {r.doc_id: r for r in identify_language(docs, fit_languages(docs)).collect()}
    kept = {r.doc_id for r in language_filter(spark, docs).collect()}
    monkeypatch.setattr(langid, "BROADCAST_GRAMS", 10)
    model = fit_languages(docs)
    assert isinstance(model, langid.GramTables)
    # no gram is left out, however many there are
    named = docs.filter("text IS NOT NULL AND lang IS NOT NULL").selectExpr("text", "lang AS label", "0 AS half")
    assert model.grams[-1].count() == langid._count(named).count() > 10
    got = identify_language(docs, model).collect()
    assert len(got) == len(want) == docs.count()
    for r in got:
        w = want[r.doc_id]
        assert (r.lang_pred, r.chars, r.rejected) == (w.lang_pred, w.chars, w.rejected)
        assert r.score == pytest.approx(w.score, abs=1e-3)
        assert (r.entropy is None and w.entropy is None) or r.entropy == pytest.approx(w.entropy, abs=1e-4)
    assert {r.doc_id for r in language_filter(spark, docs).collect()} == kept


def test_limits_are_from_texts_that_were_held_back(spark):
    rng = np.random.default_rng(3)
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    common = [(i, words("abcde", 8), "aa") for i in range(6000)]
    rare = [(10_000 + i, words("nopqrstuvwxyz", 30), "zz") for i in range(8)]
    model = fit_languages(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"))
    unseen = spark.createDataFrame([(i, words("nopqrstuvwxyz", 30)) for i in range(60)], "doc_id long, text string")
    out = identify_language(unseen, model).collect()
    assert {r.lang_pred for r in out} == {"zz"}
    assert not any(r.rejected for r in out)


def test_quantile_counts_every_row():
    assert langid._quantile([(5, 1)]) == 5
    assert langid._quantile([(1, 999), (7, 1)]) == 1
    assert langid._quantile([(1, 998), (7, 2)]) == 7

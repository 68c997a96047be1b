"""Quality statistics against brute force, constraints of the trees, the label model, and held-out accuracy."""

import os
import re
import zlib
from collections import Counter

import numpy as np

from rubricspark.llm.quality import STATISTICS, apply_rules, base_failed, fit_quality, grow, measure
from rubricspark.llm.queries import op3_toxicity, op8_quality_rules
from rubricspark.llm.toxicity import first_guess, fit_labels, fit_toxicity, fit_weights, gradient, maximize, score_toxicity

ODD = [(1, None, 1), (2, "", 1), (3, "a\n\na\n \t\n \t\nb\na", 1), (4, "x y " * 30000, 1), (4, "x y " * 30000, 1), (5, "Zoë #1 $$ <b> | é\x0bq\x85r", 1), (None, "one two", 1)]
SCHEMA = "doc_id long, text string, score int"


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_measures(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op8_quality_rules(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        want = slow_measure(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    for _, t, _ in ODD:
        assert measure(t or "")[0] == slow_measure(t or "")
    assert measure("a b c d e f g h i " * 2 + "z")[0][4] == 18 and measure("")[0] == (0, 0, 0, 0, 0)


def larger(sf_dir, name):
    """The same tables at a larger size, beside the tests' own."""
    return os.path.join(os.path.dirname(sf_dir.rstrip("/")), name)


def test_held_out_verdicts(spark, sf_dir):
    d = larger(sf_dir, "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [r for r in op8_quality_rules(spark, d).collect() if r.doc_id in labels and held(r.doc_id) and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id].quality == 1]
    bad = [r.kept for r in rows if labels[r.doc_id].quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_held_out_toxicity(spark, sf_dir):
    d = larger(sf_dir, "sf0.1")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    out = op3_toxicity(spark, d).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    mine = [(r.predicted, labels[r.doc_id].toxic) for r in out if r.doc_id in labels and r.held_out]
    assert np.mean([p for p, t in mine if t]) > 0.88 and np.mean([p for p, t in mine if not t]) < 0.02


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] < 0.6) ^ (rng.uniform(size=3000) < 0.15) ^ ((x[:, 0] > 0.8) & (x[:, 1] > 0.5))).astype(float)
    trees = grow(x, y, np.array([-1, 0, 1]), 30)
    base = rng.uniform(size=(200, 3))
    for k, sign in ((0, -1), (2, 1)):
        curve = [trees.margin(np.where(np.arange(3) == k, v, base)) for v in np.linspace(0, 1, 25)]
        assert (sign * np.diff(np.stack(curve), axis=0) >= -1e-9).all()
    # x[0] > 0.8 and x[1] > 0.5 speaks against the constraint, so 0.85 * 0.9 + 0.15 * 0.1 is the most that can be right
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.76
    plain = grow(x, (x[:, 0] < 0.6).astype(float), np.array([-1, 0, 1]), 30)
    assert ((plain.score(x) > 0.5) == (x[:, 0] < 0.6)).mean() > 0.97
    assert set(STATISTICS.values()) <= {-1, 0, 1}
    assert base_failed(np.array([19, 20, 100]), np.array([0, 7, 30])).tolist() == [True, True, False]


def made_votes(rng, n=4000):
    y = rng.uniform(size=n) < 0.2
    good = [np.where(y, rng.uniform(size=n) < 0.7, rng.uniform(size=n) < 0.03) for _ in range(4)]
    noise = rng.uniform(size=n) < 0.2
    x = np.stack([*good, noise, noise ^ (rng.uniform(size=n) < 0.02), ~np.any(good, axis=0)], axis=1).astype(np.uint8)
    return y, x, np.where(rng.uniform(size=n) < 0.2, y.astype(int), -1)


SIDES = np.array([1, 1, 1, 1, 1, 1, 0])


def test_label_model_finds_truth_and_dependencies():
    y, x, given = made_votes(np.random.default_rng(2))
    for labels in (given, np.full(len(given), -1)):
        model = fit_labels(SIDES, bool((labels >= 0).any()), lambda m, labels=labels: m.moments(x, labels, np.ones(len(x))))
        assert ((model.posterior(x, labels) > 0.5) == y).mean() > 0.93
        assert 4 in (model.parent[5],) or model.parent[4] == 5  # the copy hangs on what it copies
    above = np.where(model.parent >= 0, 1, 0)
    assert above.sum() == len(SIDES) - 1


def test_label_model_is_brute_force():
    """Posteriors from the product of all tables, moments row by row, and a likelihood that never falls."""
    _, x, given = made_votes(np.random.default_rng(5), 300)
    weight = np.random.default_rng(6).uniform(0.2, 2, 300)

    def joint(m, row, label, c):
        p = m.prior if c else 1 - m.prior
        for j, up in enumerate(m.parent):
            q = m.fires[c, j, row[up] if up >= 0 else 0]
            p *= q if row[j] else 1 - q
        if label >= 0:
            p *= m.right[c] if label == c else 1 - m.right[c]
        return p

    model, last = first_guess(SIDES, True), -np.inf
    for r in range(8):
        slow = np.array([[joint(model, row, g, c) for c in (0, 1)] for row, g in zip(x, given, strict=True)])
        post = slow[:, 1] / slow.sum(axis=1)
        assert np.allclose(model.posterior(x, given), post, atol=1e-6)
        size = len(SIDES) ** 2 + 3
        want = np.zeros((2, size))
        for row, g, p, w in zip(x.astype(float), given, post, weight, strict=True):
            for c, share in enumerate((1 - p, p)):
                want[c] += np.concatenate([(w * share * np.outer(row, row)).ravel(), [w * share, w * share * (g == 1), w * share * (g == 0)]])
        assert np.allclose(model.moments(x, given, weight), want.ravel(), atol=1e-4)
        score = float((weight * np.log(slow.sum(axis=1))).sum())
        assert r < 2 or score > last - 0.5  # but for the small sums that keep every vote possible
        last, model = score, maximize(want.ravel(), len(SIDES), None if r < 1 else model.parent)


def test_weights_are_the_regression():
    rng = np.random.default_rng(7)
    x = (rng.uniform(size=(3000, 6)) < 0.3).astype(float)
    y = 1 / (1 + np.exp(-(x @ np.array([2, -1, 0, 0, 1, 0.5]) - 1)))
    w = fit_weights(lambda w: gradient(x, y, np.ones(3000), w), x[:1000], 3.0, ridge=1e-3, steps=30)
    assert np.allclose(w, [2, -1, 0, 0, 1, 0.5, -1], atol=0.05)


def test_every_unlabelled_row_counts(spark):
    """More rows than any bound: a word that only unlabelled texts join with an insult gets a voice."""
    rng, rows = np.random.default_rng(8), []
    for i in range(6000):
        bad = i % 5 == 0
        rows.append((i, "you idiot moron stupid " * 2 if bad else " ".join(rng.choice(["calm", "blue", "river", "stone"], 12))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    train = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(6000))
    known = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    mass = np.diag(model.labels.seen[0]) + np.diag(model.labels.seen[1])
    assert mass.max() <= 2 * known + 1 and train > 4000  # all unlabelled rows weigh as much as the labelled ones
    out = score_toxicity(docs, model, ["doc_id"]).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in out)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 5, "x") for r in ODD], SCHEMA + ", n_words int, _measured string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rules = apply_rules(df, fit_quality(df, labels), ["doc_id", "n_words", "_measured"])
    assert rules.columns.count("n_words") == 1 and {r._measured for r in rules.collect()} == {"x"}
    assert rules.count() == len(ODD) and not [r for r in rules.collect() if r.doc_id in (1, 2) and r.kept]
    scored = score_toxicity(df.withColumnRenamed("_measured", "_scored"), fit_toxicity(df, labels), ["doc_id", "score", "_scored"]).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    none = labels.limit(0)
    assert apply_rules(df.limit(0), fit_quality(df, none), ["doc_id"]).count() == 0
    assert score_toxicity(df, fit_toxicity(df.limit(0), none), ["doc_id"]).count() == len(ODD)

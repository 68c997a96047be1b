"""Fixed patterns against the plain expressions, gradients against differences, and what the network learns."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from rubricspark.llm import pii
from rubricspark.llm.pii import BASE_KINDS, KINDS, STRIDE, TAGS, WINDOW, Tagger, added_spans, base_spans, best_paths, crf_passes, decode, find_personal_data, fit_tagger, luhn, plant, symbols, training_windows
from rubricspark.llm.queries import op7_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    out = []
    for k, kind in enumerate(BASE_KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ODD = [
    "", "a@b", "a@b.c", "x@@b.c", "a@b.c@d.e", "é.x@y-1.z.. q@r.s-", "@a.b", "1.2.3.4.5.6.7.8", "1.2.3.256 1.02.003.4", "1..2.3.4.5", "4111 1111-1111 1111", "4111111111111112",
    "+1 (017) 555-7713 x +12 +1(2)3-4.5 6789 01-", "+1+1 2345678901", "+" * 50, "1" * 3000, ".1" * 500, "a" * 50000 + "@" + "b.c" * 10, "ß" * 70 + " 10.0.0.1",
]


def test_patterns():
    for t in ODD:
        if len(t) < 10000:
            assert base_spans(t) == slow_spans(t), t
    rng = np.random.default_rng(0)
    for _ in range(3000):
        t = "".join(rng.choice(list("11223@@..+- ()ab\n"), rng.integers(1, 40)))
        assert base_spans(t) == slow_spans(t), t
    assert base_spans(ODD[-2])


def all_paths(e, trans):
    """(steps, tags) scores: every path, and its score."""
    paths = np.stack(np.meshgrid(*[range(TAGS)] * len(e), indexing="ij"), -1).reshape(-1, len(e))
    return paths, e[np.arange(len(e)), paths].sum(axis=1) + trans[paths[:, :-1], paths[:, 1:]].sum(axis=1)


def test_gradient_and_crf():
    rng = np.random.default_rng(1)
    tagger = Tagger.fresh()
    x, y = rng.integers(1, 99, (3, 6)), np.array([[0, 1, 2, 2, 0, 3], [5, 6, 0, 0, 9, 10], [0, 0, 0, 7, 8, 8]])
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, g = tagger.gradient(x, y)
    for k in ("embed", "wf", "ur", "br", "out", "out_b", "trans"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, eps = tagger.p[k][at], 1e-4
        tagger.p[k][at] = old + eps
        up = tagger.gradient(x, y)[0]
        tagger.p[k][at] = old - eps
        down = tagger.gradient(x, y)[0]
        tagger.p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k
    e, trans = rng.normal(size=(4, 2, TAGS)), rng.normal(size=(TAGS, TAGS))
    marginal, z, pair = crf_passes(e, trans)
    expected = np.zeros((TAGS, TAGS))
    for j in range(2):
        paths, total = all_paths(e[:, j], trans)
        p = np.exp(total) / np.exp(total).sum()
        assert np.isclose(z[j], np.log(np.exp(total).sum()))
        assert np.allclose(marginal[1, j], np.bincount(paths[:, 1], p, TAGS))
        for t in range(3):
            np.add.at(expected, (paths[:, t], paths[:, t + 1]), p)
        assert best_paths(e, trans)[:, j].tolist() == paths[total.argmax()].tolist()
    assert np.allclose(pair, expected)


def test_fast_pass_is_the_trained_one():
    rng = np.random.default_rng(2)
    tagger = Tagger.fresh()
    x = rng.integers(1, 99, (4, 20)).astype(np.uint8)
    assert np.allclose(tagger.emissions(x, np.full(4, 20)).reshape(4, 20, TAGS), tagger._forward(x)[0].transpose(1, 0, 2), atol=1e-5)
    # what follows a row's end says nothing about it
    sizes = np.array([20, 3, 1, 11])
    parts = [tagger._forward(x[i : i + 1, :n])[0][:, 0] for i, n in enumerate(sizes)]
    assert np.allclose(tagger.emissions(x, sizes), np.concatenate(parts), atol=1e-5)


@pytest.fixture(scope="module")
def tagger(sf_dir):
    docs = duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' WHERE doc_id % 4 <> 2 ORDER BY doc_id").fetchall()
    parts = [p for i, (t,) in enumerate(docs) if t for p in pii.cut_parts(t, i, 8)]
    out = Tagger.fresh()
    loss = out.train(*training_windows(parts, 5000))
    assert loss[-1] < 0.2 * loss[0]
    out.sure = 0.6
    return out


def slow_added(text, tagger):
    """Window after window, position after position, one decoding of the whole text with a "none" behind it."""
    coded, scores, depth = symbols(text), np.zeros((len(text), TAGS)), np.full(len(text), -1)
    for s in range(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE):
        part = coded[s : s + WINDOW]
        if not len(part):
            continue
        e = tagger._forward(part[None])[0][:, 0]
        for i in range(len(part)):
            # how far from an end at which the text goes on
            own = min(i if s else 10**9, len(part) - 1 - i if s + len(part) < len(text) else 10**9)
            if own > depth[s + i]:
                depth[s + i], scores[s + i] = own, e[i]
    e = np.concatenate([scores, [[0.0] + [-1e4] * (TAGS - 1)]])[:, None]
    path, sure, out, t = best_paths(e, tagger.transitions)[:, 0], crf_passes(e, tagger.transitions)[0][:, 0], [], 0
    while t < len(text):
        end = t + 1
        if path[t] % 2 == 1:
            while path[end] == path[t] + 1:
                end += 1
            if min(sure[q, path[q]] for q in range(t, end)) >= tagger.sure:
                out.append((t, int(path[t] - 1) // 2, end))
        t = end
    return [s for s in out if pii.plausible(text, *s)]


def test_spans_are_brute_force(spark, sf_dir, tagger):
    rng = np.random.default_rng(5)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = [plant(t[:6000], rng)[0] for t in texts] + ["", "a", "x" * 3000, " ".join(plant("and so on", rng)[0] for _ in range(200))]
    want = [slow_added(t, tagger) for t in texts]
    assert sum(map(len, want)) > 60
    assert added_spans(texts, tagger) == want
    # the pruned decoding is the plain one, on any scores
    for seed in range(20):
        scores = np.random.default_rng(seed).normal(size=(40, TAGS)).astype(np.float32) * 3
        scores[:, 0] += 4
        sizes = np.array([11, 0, 1, 28])
        got = {(i, a, k, b) for i, a, k, b, _ in decode(scores, sizes, tagger)}
        for i, (n, lo) in enumerate(zip(sizes, np.cumsum(sizes) - sizes)):
            e = np.concatenate([scores[lo : lo + n], [[0.0] + [-1e4] * (TAGS - 1)]])[:, None].astype(float)
            path = best_paths(e, tagger.transitions)[:, 0]
            starts = {t: int((path[t] - 1) // 2) for t in range(n) if path[t] % 2 == 1}
            assert {(a, k) for j, a, k, _ in got if j == i} == set(starts.items())


def test_network_finds_what_patterns_miss(spark, sf_dir, tagger):
    """Near forms and secrets, planted into texts that nothing was learned from."""
    rng, hit, every, wrong = np.random.default_rng(11), Counter(), Counter(), 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 4 = 2 AND text IS NOT NULL").orderBy("doc_id").collect()
    texts, planted = [], []
    for r in docs * 4:
        t, spans = plant(r.text[:2000], rng)
        texts.append(t)
        planted.append(spans)
    for spans, found in zip(planted, added_spans(texts, tagger), strict=True):
        wrong += len(set(found) - set(spans))
        for s in spans:
            every[KINDS[s[1]]] += 1
            hit[KINDS[s[1]]] += s in found
    assert sum(hit.values()) >= 0.9 * sum(every.values()), (hit, every)
    assert wrong <= 0.06 * sum(every.values())


def parts(spans):
    return set(filter(None, spans.split(",")))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op7_personal_data(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        want = slow_spans(texts[r.doc_id])
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert r.n_added == len(parts(r.spans) - parts(said))
        assert parts(said) <= parts(r.spans)


def test_odd_rows(spark, tagger):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(99, None, "x", 1), (99, None, "x", 1), (None, "1.2.3.4", "x", 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string, n_ip int, _searched string")
    for t in (tagger, None):
        out = find_personal_data(df, t, ["doc_id", "spans", "_searched"]).collect()
        assert len(out) == len(rows)
        assert all(parts(r.base) <= parts(r.spans) for r in out)
    assert find_personal_data(df.limit(0), None, ["doc_id"]).count() == 0
    assert fit_tagger(df.limit(0)) is None


def test_what_is_not_plausible():
    def judged(text, span, kind):
        a = text.index(span)
        return pii.plausible(text, a, pii.KINDS.index(kind), a + len(span))

    run = "osjaque osjaque osjaque osjaque"
    assert not judged(run, "osjaque osjaque", "email") and not judged(run, "osjaque", "secret")
    assert not judged("so QUEASARJARR said", "QUEASARJARR", "secret") and judged("token=QUEASARJARR", "QUEASARJARR", "secret")
    assert judged("key: 'abcdefghijkl'", "abcdefghijkl", "secret") and judged("see aZ09-kk_qwe12 there", "aZ09-kk_qwe12", "secret")
    assert not judged("4111 1111 1111 1111 4222 2222 2222 2222", "4111 1111 1111 1111 4222 2222 2222 2222", "card")
    assert judged("pay 4111 1111 1111 1112 now", "4111 1111 1111 1112", "card") and judged("to ann (at) ex.org", "ann (at) ex.org", "email")
    assert not judged("mail ann at home", "ann at home", "email")


def test_stretches_left_out_hold_no_span():
    """Random scores and transitions, spans that touch among them: each tag of the best path is searched, and "none" paths are known."""
    rng = np.random.default_rng(11)
    sizes = np.array([1, 40, 0, 25, 3] * 12)
    for bias, spread in ((0.0, 2), (1.5, 2), (3.0, 2), (8.0, 0.3)):
        tagger = Tagger.fresh()
        tagger.p["trans"] = rng.normal(size=(TAGS, TAGS)).astype(np.float32) * spread
        scores = rng.normal(size=(sizes.sum(), TAGS)).astype(np.float32) * 2
        scores[:, 0] += bias
        at, lo = set(pii.undecided(scores, sizes, tagger.transitions).tolist()), 0
        for n in sizes.tolist():
            e = np.concatenate([scores[lo : lo + n], [[0.0] + [-1e4] * (TAGS - 1)]])[:, None]
            path = best_paths(e, tagger.transitions)[:n, 0]
            assert {lo + int(i) for i in np.flatnonzero(path)} <= at
            assert pii.best_is_none(e, tagger.transitions)[0] == (not path.any())
            lo += n
    assert len(at) < sizes.sum()


def test_passes_have_about_as_many_windows(monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "PASS_WINDOWS", 8)
    tagger = Tagger.fresh()
    whole = Tagger.emissions
    monkeypatch.setattr(Tagger, "emissions", lambda self, x, n: (seen.append(len(x)), whole(self, x, n))[1])
    pii.text_scores([symbols("ab" * 20)] * 9, tagger)
    assert seen == [5, 4]


@pytest.mark.parametrize("seed", range(4))
def test_stretches_go_on_together(seed):
    """Which stretches hold another tag is known without decoding each, whatever their lengths, and at a text's beginning too."""
    r = np.random.default_rng(seed)
    trans = r.normal(size=(pii.TAGS, pii.TAGS)) + pii._ALLOWED
    length = r.integers(1, 40, 60)
    length[0] = 700
    known = r.uniform(size=60) < 0.7
    scores = r.normal(size=(int(length.sum()), pii.TAGS)).astype(np.float32)
    scores[:, 0] += r.uniform(2, 6, 60).repeat(length)
    lo = np.cumsum(length) - length
    want = []
    for a, n, k in zip(lo, length, known, strict=True):
        e = np.full((n + 1, 1, pii.TAGS), -1e4)
        e[:, :, 0] = 0
        e[:n, 0] = scores[a : a + n]
        if k:
            e[0, 0] = np.where(np.arange(pii.TAGS) > 0, -1e4, 0)
        want.append(bool(pii.best_paths(e, trans)[:, 0].any()))
    got = pii.maybe_other(scores, lo, length, known, trans)
    assert got[want].all() and got.sum() <= sum(want) + 2 and 5 < sum(want) < 55  # a path that falls short by a hair may count


def test_texts_are_decoded_together(monkeypatch):
    """Texts that are read in several goes are decoded in one, with the spans that each has alone."""
    tagger = pii.Tagger.fresh(3)
    tagger.p["out_b"][0], tagger.sure = 0.3, 0.0
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("ab1 .@-"), int(n))) for n in (0, 1, 30, 900, 1500, 0, 60, 300)]
    alone = [pii.added_spans([t], tagger)[0] for t in texts]
    monkeypatch.setattr(pii, "READ_CHARS", 400)
    calls, decode = [], pii.decode_stretches
    monkeypatch.setattr(pii, "decode_stretches", lambda parts, t: (calls.append(len(parts)), decode(parts, t))[1])
    assert pii.added_spans(texts, tagger) == alone and calls == [4] and any(alone)


def test_rows_are_read_together(monkeypatch):
    monkeypatch.setattr(pii, "TOGETHER_CHARS", 10)
    texts = ["abc", None, "", "defg", "x" * 40, "hi", "ä" * 3, "jk", "l"]
    whole = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["id", "text"])
    for step in (1, 4, 9):
        parts = list(pii.rows_together(whole.slice(lo, step) for lo in range(0, 9, step)))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole]))
        assert all(sum(len((t or "").encode()) for t in p.column("text").to_pylist()[:-1]) < 10 for p in parts) and len(parts) == 3

"""Hybrid search within one document or scope in numpy: BM25, cosine, rank fusion and reranking, called for each group by
plans.jobs and by operators.search.

Scores, ties and limits are those of operators.search, which ranks scopes of any size by joins.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from ..params import BM25_B, BM25_EPSILON, BM25_K1, CANDIDATES, RRF_K
from .hooks import PairScorer

#: Unicode white space, as the tokens of operators.search are cut.
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")


#: What str.split takes for white space and Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def words(text: str) -> list[str]:
    low = text.lower()
    return [w for w in _BLANKS.split(low) if w] if _SEPARATORS.search(low) else low.split()


def bm25(chunks: list[Counter], queries: list[Counter]) -> np.ndarray:
    """Scores of every query (rows) in every chunk; idf below 0 becomes epsilon times the mean over the document's terms."""
    n, out = len(chunks), np.zeros((len(queries), len(chunks)))
    seen: Counter = Counter()
    for c in chunks:
        seen.update(c.keys())
    if not seen:
        return out
    idf = lambda d: np.log(n - d + 0.5) - np.log(d + 0.5)
    low = BM25_EPSILON * float(idf(np.fromiter(seen.values(), float, len(seen))).mean())
    size = np.array([c.total() for c in chunks], float)
    damp = BM25_K1 * (1 - BM25_B + BM25_B * size / size.mean())
    for k, query in enumerate(queries):
        for term, times in query.items():
            if d := seen.get(term):
                tf, raw = np.array([c.get(term, 0) for c in chunks], float), idf(d)
                out[k] += times * (low if raw < 0 else raw) * tf * (BM25_K1 + 1) / (tf + damp)
    return np.round(out, 9)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    return np.round(unit(a) @ unit(b).T, 9)


def bm25_table(chunks: list[Counter], queries: list[list[str]]) -> np.ndarray:
    """What ``bm25`` gives for many queries at once: chunks and queries meet as matrices over the queries' words."""
    n, place = len(chunks), {w: k for k, w in enumerate(dict.fromkeys(w for q in queries for w in q))}
    seen: Counter = Counter()
    for c in chunks:
        seen.update(c.keys())
    if not seen or not place:
        return np.zeros((len(queries), n))
    raw = lambda d: np.log(n - d + 0.5) - np.log(d + 0.5)
    low = BM25_EPSILON * float(raw(np.fromiter(seen.values(), float, len(seen))).mean())
    idf = raw(np.array([seen.get(w, 0) for w in place], float))
    size = np.array([c.total() for c in chunks], float)
    damp = BM25_K1 * (1 - BM25_B + BM25_B * size / size.mean())
    hits, weight = np.zeros((n, len(place))), np.zeros((len(place), len(queries)))
    for i, c in enumerate(chunks):
        for w in place.keys() & c.keys():
            tf = c[w]
            hits[i, place[w]] = tf * (BM25_K1 + 1) / (tf + damp[i])
    for k, q in enumerate(queries):
        for w in q:
            weight[place[w], k] += 1
    return np.round(hits @ (np.where(idf < 0, low, idf)[:, None] * weight), 9).T


def fused_candidates(lexical: np.ndarray, near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (rows of both tables) the n chunks that rank first by both lists, best first, and their fused scores.

    Chunks come in order of their place: of equal words the later, of equal vectors the earlier is first.
    """
    asked, chunks = lexical.shape
    n, far, rows = min(n, chunks), chunks + 1, np.arange(asked)[:, None]
    sides = [chunks - 1 - np.argsort(-lexical[:, ::-1], axis=1, kind="stable")[:, :n], np.argsort(-near, axis=1, kind="stable")[:, :n]]
    ranks, total = [], np.zeros(lexical.shape)
    for side in sides:
        rank = np.full(lexical.shape, far)
        rank[rows, side] = np.arange(1, n + 1)
        ranks.append(rank)
        total += np.where(rank < far, 1 / (RRF_K + rank), 0.0)
    total = np.round(total, 9)
    best = np.lexsort((ranks[1], ranks[0], -total), axis=1)[:, :n]
    return best, total[rows, best]


def hybrid_ranks(texts: list[str], seq: np.ndarray, vectors: np.ndarray, queries: list[str], asked: np.ndarray, tops: list[int], scorer: PairScorer) -> list[list[int]]:
    """For each query the chunks that rank first, best first, as many as its entry of ``tops`` says."""
    if not texts:
        return [[] for _ in queries]
    lexical, near = bm25([Counter(words(t)) for t in texts], [Counter(words(q)) for q in queries]), cosines(asked, vectors)
    found: list[list[int]] = []
    for k in range(len(queries)):
        sides = [np.lexsort((-seq, -lexical[k]))[:CANDIDATES].tolist(), np.lexsort((seq, -near[k]))[:CANDIDATES].tolist()]
        ranks = [{c: r for r, c in enumerate(side, 1)} for side in sides]
        fused = {c: round(sum(1 / (RRF_K + side[c]) for side in ranks if c in side), 9) for c in ranks[0] | ranks[1]}
        far = len(texts) + 1
        found.append(sorted(fused, key=lambda c: (-fused[c], ranks[0].get(c, far), ranks[1].get(c, far)))[:CANDIDATES])
    scores = iter(np.round(np.asarray(scorer([q for q, f in zip(queries, found, strict=True) for _ in f], [texts[c] for f in found for c in f]), float), 9).tolist())
    out = []
    for f, top in zip(found, tops, strict=True):
        own = [next(scores) for _ in f]
        out.append([f[i] for i in sorted(range(len(f)), key=lambda i: -own[i])[:top]])
    return out

"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

Trees are grown on histograms in numpy from a bounded sample of labelled texts and flattened into node arrays, which
score a batch of documents level by level. Where a statistic can only speak against a document (symbols, repeats,
repeated lines, shouting) the score may only fall as it grows, in every tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_names, materialize
from .toxicity import training_sample

#: Labelled training texts, by the smallest hashes of their ids.
LABELLED_ROWS = 12_000
TREES, DEPTH, BINS, SHRINK, LEAF, RIDGE = 60, 3, 48, 0.2, 15, 1.0
#: The verdict's limit is such that this share of the good training texts fails it, and at most LIMIT.
GOOD_LOST, LIMIT = 0.001, 0.5
#: Fixed limits: fewest words, and most words in repeated windows of WINDOW words (percent).
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Statistics and their constraint: -1 the score may only fall with it, 0 free.
STATISTICS = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "distinct_share": 0,
    "exclaim_per_word": -1,
    "bars_per_word": -1,
    "stops_per_word": 0,
    "commas_per_word": 0,
    "words_per_line": 0,
    "short_words": 0,
    "commonest_share": 0,
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of two) words found twice or more, the first included. Exact."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    kinds, step = len(number), 1
    while step < window:  # ids of runs of twice the length: pairs of ids of runs
        pair = ids[:-step] * kinds + ids[step:]
        _, ids = np.unique(pair, return_inverse=True)
        kinds, step = int(ids.max()) + 1, step * 2
        if kinds == len(ids):
            return 0
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + window, -1)
    return int((np.cumsum(mark) > 0).sum())


def measure(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the statistics that trees look at."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANK)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    upper, lower, digit = int(kinds[65:91].sum()), int(kinds[97:123].sum()), int(kinds[48:58].sum())
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    per = 1 / max(n, 1)
    values = [
        float(np.log1p(n)),
        chars * per,
        symbols * per,
        dup / max(lines, 1),
        repeat * per,
        upper / max(upper + lower, 1),
        digit / max(chars, 1),
        len(counts) * per,
        int(kinds[33]) * per,
        int(kinds[124]) * per,
        int(kinds[46]) * per,
        int(kinds[44]) * per,
        n / max(lines, 1),
        sum(v for w, v in counts.items() if len(w) <= 3) * per,
        max(counts.values(), default=0) * per,
    ]
    return (n, chars, symbols, dup, repeat), values


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)


@dataclass
class Trees:
    """Node arrays of all trees, each a full binary tree of DEPTH levels: children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # values above it go right
    value: np.ndarray  # (trees, leaves)
    start: float
    limit: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for a 0/1 target; sign[k] = -1 keeps the score from rising with statistic k, +1 from falling."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    f = np.full(len(x), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        low, high = np.full(2 * leaves - 1, -np.inf), np.full(2 * leaves - 1, np.inf)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best, cut = 1e-6, None
            if len(rows) >= 2 * LEAF:
                gs, hs = g[rows].sum(), h[rows].sum()
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    b, size = binned[rows, k], len(e) + 1
                    gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    left = np.clip(gl / (hl + RIDGE), low[i], high[i])
                    right = np.clip((gs - gl) / (hs - hl + RIDGE), low[i], high[i])
                    gain = gl * gl / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs * gs / (hs + RIDGE)
                    gain[(nl < LEAF) | (len(rows) - nl < LEAF) | (sign[k] * (right - left) < 0)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, cut = gain[j], (k, e[j], left[j], right[j])
            a, b = 2 * i + 1, 2 * i + 2
            low[a], low[b], high[a], high[b] = low[i], low[i], high[i], high[i]
            if cut:
                k, at, left, right = cut
                feature[t, i], threshold[t, i] = k, at
                middle = (left + right) / 2
                if sign[k] < 0:  # what lies left may not fall below what lies right
                    low[a], high[b] = max(low[a], middle), min(high[b], middle)
                elif sign[k] > 0:
                    high[a], low[b] = min(high[a], middle), max(low[b], middle)
                node[rows] = np.where(x[rows, k] > at, b, a)
            else:
                node[rows] = a
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[t] = SHRINK * np.clip(gs / (hs + RIDGE), low[inner:], high[inner:])
        f = f + value[t][leaf]
    return Trees(feature, threshold, value, start)


def fit_quality(docs: DataFrame, labels: DataFrame) -> Trees | None:
    """Learns from training rows of ``docs`` and ``labels`` (doc_id, quality); None without both kinds of labels."""
    sample = training_sample(docs, labels, "quality", LABELLED_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [measure(t) for t in batch.column("text").to_pylist()]
            failed = [bool(base_failed(np.array(b[0]), np.array(b[4]))) for b, _ in both]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(failed), pa.array([v for _, v in both], pa.list_(pa.float64()))], names=["doc_id", "label", "failed", "x"])

    table = materialize(sample.mapInArrow(run, "doc_id long, label int, failed boolean, x array<double>")).toPandas()
    if table["label"].nunique() < 2:
        return None
    table = table.sort_values(["doc_id", "label"])
    x, y = np.stack(table["x"].to_list()), (table["label"] == 1).to_numpy(float)
    out = grow(x, y, np.array(list(STATISTICS.values())))
    good = (y == 1) & ~table["failed"].to_numpy()
    if good.any():
        out.limit = float(min(LIMIT, np.quantile(out.score(x[good]), GOOD_LOST)))
    return out


def apply_rules(docs: DataFrame, trees: Trees | None, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and, for each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), quality (double). A null or an empty text has no words and fails; without trees the base
    decides. Long texts are measured whole, a quality of exactly the limit is kept, equal texts are treated alike, an empty
    table gives an empty one. Columns in ``keep`` with one of these names are replaced; all other names are free.
    """
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
    made = T.StructType.fromDDL(added)
    names = [c for c in keep if c not in made.names]
    held = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*docs.select(*names).schema.fields, *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [measure(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
            base = np.array([b for b, _ in both], np.int64)
            failed = base_failed(base[:, 0], base[:, 4])
            quality = trees.score(np.array([v for _, v in both])) if trees else np.where(failed, 0.0, 1.0)
            kept = ~failed & (quality >= trees.limit if trees else True)
            columns = [*(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(quality)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *columns], names=schema.names)

    (own,) = free_names(docs.select(*names), "_measured")
    return docs.select(*names, docs["text"].alias(own)).mapInArrow(run, schema)

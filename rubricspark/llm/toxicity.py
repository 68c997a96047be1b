"""Toxicity by weak supervision.

Lexicon and pattern voters look at a text and vote toxic, vote clean or abstain. A generative label model learns from
the votes of every training text (and the noisy labels of some, one more voter) how often each is right and which depend
on which: given the class, votes form a tree, each with its own table for either vote of its parent. Expectation and
maximization run as Spark aggregations over the distinct patterns of votes. A linear classifier over words and votes
learns the posterior labels of every training text and scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, held_out, materialize

#: Labelled texts, by the smallest hashes of their ids, from which terms are mined and the classifier's curvature is taken.
LABELLED_ROWS = 12_000
#: Terms mined from labelled texts for lexicon voters, and evidence that the classifier may weigh.
MINED_TERMS, CHOSEN = 160, 320
#: Lengths of word beginnings that count as evidence, and words whose stems a worker remembers.
STEM_LENGTHS, REMEMBERED = (4, 5, 6, 7, 8), 300_000
THRESHOLD = 0.3
#: All rows without a label together weigh at most as much as this times all rows with one; rounds of both fits.
UNLABELLED_MASS, ROUNDS, STEPS = 1.0, 15, 12
#: How often a given label is right, at least and at most.
LABEL_RIGHT = (0.9, 0.99)

#: Lexicons by kind.
LEXICONS = {
    "insult": "idiot moron stupid dumb fool imbecile clown loser jerk",
    "contempt": "pathetic worthless disgusting trash scum garbage vermin filth",
    "threat": "kill murder die hurt destroy burn hang",
    "profane": "damn hell crap bastard bitch shit fuck ass",
    "german": "dumm trottel abschaum ekelhaft verlierer idioten wertlos schlampe",
    "french": "imbécile ordure minable dégoûtant crétin connard salope nul",
    "spanish": "estúpido imbécil basura asqueroso patético escoria puta cabrón",
}
_HARSH = frozenset(w for k in ("insult", "contempt", "profane", "german", "french", "spanish") for w in LEXICONS[k].split())
_SECOND_PERSON = frozenset("you your du ihr dich tu vous toi eres usted tú".split())
_TOKEN = re.compile(r"[^\W\d_]+")
#: Pattern voters: name and vote (1 toxic, 0 clean).
PATTERNS = (("repeated", 1), ("addressed", 1), ("shouting", 1), ("exclaiming", 1), ("symbols", 1), ("plain", 0), ("long_plain", 0))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def pattern_votes(text: str, words: list[str]) -> list[bool]:
    """Which pattern voters fire on a text."""
    harsh = [i for i, w in enumerate(words) if w in _HARSH]
    addressed = any(w in _SECOND_PERSON for i in harsh for w in words[max(0, i - 3) : i + 4])
    raw = np.frombuffer(text.encode(), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    symbols = sum(text.count(c) for c in "#$%&*|<>")
    return [
        len(harsh) >= 2,
        addressed,
        upper > lower and upper > 20,
        text.count("!!") >= 3,
        symbols > 0.05 * max(1, len(text)),
        not harsh,
        not harsh and len(words) >= 100,
    ]


def stems(word: str) -> list[str]:
    """A word and its beginnings; ``ab+`` stands for longer words that begin with ab."""
    return [word, *(f"{word[:k]}+" for k in STEM_LENGTHS if len(word) > k)]


def evidence(kinds: set[str]) -> list[tuple[str, int]]:
    """(stem, level): level 1 for stems of any word of a text, level 2 for stems of two words or more."""
    counts = Counter(s for w in kinds for s in stems(w))
    return [(s, 1) for s in counts] + [(s, 2) for s, n in counts.items() if n > 1]


class Featurizer:
    """0/1 features of a text: chosen evidence, then lexicon voters, then pattern voters."""

    def __init__(self, chosen: list[tuple[str, int]], lexicons: list[frozenset[tuple[str, int]]]):
        self.chosen, self.lexicons = chosen, lexicons
        self.at = {e: [i] for i, e in enumerate(chosen)}
        for v, lexicon in enumerate(lexicons, len(chosen)):
            for e in lexicon:
                self.at.setdefault(e, []).append(v)
        self.stems = frozenset(s for s, _ in self.at)
        self.width = len(chosen) + len(lexicons) + len(PATTERNS)
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        found, counts = tokens(text), Counter()
        for w in set(found):
            mine = self.known.get(w)
            if mine is None:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                mine = self.known[w] = tuple(s for s in stems(w) if s in self.stems)
            if mine:
                counts.update(mine)
        out = np.zeros(self.width, bool)
        for s, n in counts.items():
            out[self.at.get((s, 1), [])] = True
            if n > 1:
                out[self.at.get((s, 2), [])] = True
        out[self.width - len(PATTERNS) :] = pattern_votes(text, found)
        return out


@dataclass
class LabelModel:
    """p(class), p(vote | class, parent's vote) and how often given labels are right."""

    prior: float
    parent: np.ndarray  # of each voter; -1 for the root
    fires: np.ndarray  # (class, voter, parent's vote): probability that it fires
    right: np.ndarray  # (class,): probability that a given label is that class
    seen: tuple[np.ndarray, np.ndarray] | None = None  # the moments it was fitted to

    def posterior(self, x: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of votes x (0/1) and labels (1, 0 or -1 for none)."""
        above = np.where(self.parent >= 0, x[:, self.parent], 0).astype(np.int64)
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        voters = np.arange(len(self.parent))
        for y, sign in ((1, 1), (0, -1)):
            p = self.fires[y][voters, above]
            odds += sign * np.where(x > 0, np.log(p), np.log(1 - p)).sum(axis=1)
        odds += np.where(given == 1, np.log(self.right[1] / (1 - self.right[0])), 0)
        odds -= np.where(given == 0, np.log(self.right[0] / (1 - self.right[1])), 0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def moments(self, x: np.ndarray, given: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums over rows, flat: for either class the votes' second moments and the weight; then given labels by class."""
        post, x = self.posterior(x, given), x.astype(np.float64)
        out = []
        for share in (1 - post, post):
            w = share * weight
            out += [((x * w[:, None]).T @ x).ravel(), [w.sum(), (w * (given == 1)).sum(), (w * (given == 0)).sum()]]
        return np.concatenate(out)


def first_guess(sides: np.ndarray, labelled: bool) -> LabelModel:
    """Before anything is counted: voters say what they stand for, more surely so where no label will correct them."""
    strong = 0.3 if labelled else 0.6
    fires = np.where(sides == 1, np.array([[0.05], [strong]]), np.array([[strong], [0.05]]))
    return LabelModel(0.1, np.full(len(sides), -1), np.repeat(fires[:, :, None], 2, axis=2), np.array([0.97, 0.97]))


def maximize(moments: np.ndarray, voters: int, parent: np.ndarray | None = None) -> LabelModel:
    """The model that fits the moments; without a given tree also the tree, of most mutual information given the class."""
    size = voters * voters + 3
    second = [moments[y * size : y * size + size - 3].reshape(voters, voters) for y in (0, 1)]
    mass = np.array([moments[(y + 1) * size - 3] for y in (0, 1)])
    said = np.array([[moments[(y + 1) * size - 1], moments[(y + 1) * size - 2]] for y in (0, 1)])  # (class, label)
    if parent is None:
        parent = dependencies(second, mass)
    above = np.maximum(parent, 0)
    fires = np.empty((2, voters, 2))
    for y in (0, 1):
        one = np.diag(second[y])
        both = np.where(parent >= 0, second[y][np.arange(voters), above], 0)
        times = np.where(parent >= 0, one[above], 0)
        # a little of the voter's own rate, so that no vote is impossible
        rate = (one + 0.5) / (mass[y] + 1)
        fires[y, :, 1] = (both + 2 * rate) / (times + 2)
        fires[y, :, 0] = (one - both + 2 * rate) / (mass[y] - times + 2)
    right = np.array([said[y][y] / max(said[y].sum(), 1e-9) if said[y].sum() else 0.97 for y in (0, 1)])
    prior = np.clip(mass[1] / max(mass.sum(), 1e-9), 0.005, 0.5)
    return LabelModel(float(prior), parent, np.clip(fires, 1e-4, 1 - 1e-4), np.clip(right, *LABEL_RIGHT), tuple(second))


def dependencies(second: list[np.ndarray], mass: np.ndarray) -> np.ndarray:
    """Each voter's parent in the spanning tree of most mutual information given the class; -1 for the root."""
    n = len(second[0])
    info = np.zeros((n, n))
    for m, size in zip(second, mass, strict=True):
        one, size = np.diag(m), size + 4e-3
        for a in (0, 1):
            for b in (0, 1):
                joint = {(1, 1): m, (1, 0): one[:, None] - m, (0, 1): one[None] - m, (0, 0): size - one[:, None] - one[None] + m}[a, b] + 1e-3
                p, q = (one if a else size - one)[:, None] + 2e-3, (one if b else size - one)[None] + 2e-3
                info += np.maximum(joint, 1e-9) * np.log(np.maximum(joint, 1e-9) * size / (p * q))
    np.fill_diagonal(info, -np.inf)
    parent, inside = np.full(n, -1), np.zeros(n, bool)
    if n:
        inside[int(info.max(axis=1).argmax())] = True
    while not inside.all():
        best = np.where(inside[:, None] & ~inside[None], info, -np.inf)
        a, b = np.unravel_index(int(best.argmax()), best.shape)
        parent[b], inside[b] = a, True
    return parent


def fit_labels(sides: np.ndarray, labelled: bool, moments: Callable[[LabelModel], np.ndarray], rounds: int = ROUNDS) -> LabelModel:
    """Expectation (``moments`` sums over all rows) and maximization in turn; the tree settles in the first rounds."""
    model, before = first_guess(sides, labelled), None
    for r in range(rounds):
        now = moments(model)
        model = maximize(now, len(sides), None if r < 3 else model.parent)
        if before is not None and np.abs(now - before).max() < 1e-3 * max(1.0, np.abs(now).max()) and r > 3:
            break
        before = now
    return model


@dataclass
class ToxicityModel:
    """weights: of chosen evidence, lexicon voters, pattern voters, and the bias."""

    chosen: list[tuple[str, int]]
    lexicons: list[frozenset[tuple[str, int]]]
    weights: np.ndarray
    labels: LabelModel | None = None

    def score(self, texts: list[str], featurizer: Featurizer) -> np.ndarray:
        z = np.array([self.weights[:-1][featurizer(t)].sum() for t in texts]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of soft labels y; the last weight is the bias."""
    miss = weight * (y - 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))
    return np.append(x.T @ miss, miss.sum())


def curvature(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w), len(w)))
    for lo in range(0, len(x), 2048):
        part = np.concatenate([x[lo : lo + 2048], np.ones((len(x[lo : lo + 2048]), 1))], axis=1)
        p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
        out += (part * (p * (1 - p))[:, None]).T @ part
    return out


def fit_weights(slope: Callable[[np.ndarray], np.ndarray], sample: np.ndarray, times: float, ridge: float = 1.0, steps: int = STEPS) -> np.ndarray:
    """Weights and bias of a ridge logistic regression. The slope is that of all rows; the curvature is a sample's, so many
    times as large. The bias is not shrunk."""
    w = np.zeros(sample.shape[1] + 1)
    shrink = np.append(np.full(sample.shape[1], ridge), 1e-3)
    for _ in range(steps):
        step = np.linalg.solve(times * curvature(sample, w) + np.diag(shrink), slope(w) - shrink * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-2:
            break
    return w


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of training rows; of several labels of one doc_id the largest."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    return named.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, labelled: int) -> DataFrame:
    """(doc_id, text, label) of a bounded number of labelled training rows, by the smallest hashes of their ids."""
    some = F.broadcast(training_labels(labels, column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(some, "doc_id")


def _bits(column: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.unpackbits(raw.reshape(len(column), -1), axis=1)[:, :width]


def _summed(df: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Vectors of batches, added up over all tasks; ``size`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                total += sums(batch.slice(lo, 4096))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "x"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r.k] = r.x
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from every training row of ``docs`` and ``labels`` (doc_id, toxic).

    A null text counts as an empty one, a label without a document says nothing, of several labels of a doc_id the
    largest is taken, equal rows count as often as they occur. Without labels the lexicons say what is toxic; without
    training rows they alone vote.
    """
    sample = materialize(training_sample(docs, labels, "toxic", LABELLED_ROWS))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [evidence(set(tokens(t))) for t in part.column("text").to_pylist()]
                flat = [e for some in found for e in some]
                label = np.repeat(np.array(part.column("label").to_pylist(), np.int32), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in flat], pa.string()), pa.array([k for _, k in flat], pa.int32()), pa.array(label)], names=["stem", "level", "label"])

    sums = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sums.get(1, 0), sums.get(0, 0)
    seen = sample.mapInArrow(kinds, "stem string, level int, label int").groupBy("stem", "level").agg(F.sum("label").alias("k1"), F.count("*").alias("k"))
    seen = seen.filter(F.col("k") >= 4).withColumn("k0", F.col("k") - F.col("k1"))
    ratio = F.log((F.col("k1") + 0.5) / (n1 + 1.0) / ((F.col("k0") + 0.5) / (n0 + 1.0)))
    # with the square root of the count, so that rare evidence needs a stronger lean
    seen = materialize(seen.withColumn("ratio", ratio).withColumn("lean", ratio * F.sqrt("k")))
    mined = [(r.stem, r.level) for r in seen.filter("ratio > 2").orderBy(F.desc("lean"), "stem", "level").limit(MINED_TERMS).collect()]
    chosen = [(r.stem, r.level) for r in seen.orderBy(F.abs("lean").desc(), "stem", "level").limit(CHOSEN).collect()]
    lexicons = [frozenset((w, 1) for w in x.split()) for x in LEXICONS.values()]
    lexicons += [frozenset(mined[i : i + 8]) for i in range(0, len(mined), 8)]
    # what repeats the same stems in another length is one voter: evidence is dealt in turn as well
    lexicons += [frozenset(mined[i::8]) for i in range(8) if mined[i::8]]
    sides = np.array([1] * len(lexicons) + [v for _, v in PATTERNS])
    many, voters = len(chosen), len(sides)
    width = many + voters

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(chosen, lexicons)
        for batch in batches:
            own = [featurizer(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([np.packbits(x).tobytes() for x in own], pa.binary()), pa.array([np.packbits(x[many:]).tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "bits", "votes"])

    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = usable.mapInArrow(rows, "doc_id long, bits binary, votes binary")
    found = found.join(training_labels(labels, "toxic"), "doc_id", "left").select("bits", "votes", F.coalesce("label", F.lit(-1)).alias("given"))
    found = materialize(found)
    patterns = materialize(found.groupBy("votes", "given").agg(F.count("*").alias("n")))
    sizes = {bool(r.known): r.n for r in patterns.groupBy((F.col("given") >= 0).alias("known")).agg(F.sum("n").alias("n")).collect()}
    known, unknown = sizes.get(True, 0), sizes.get(False, 0)
    if not known and not unknown:
        weights = np.concatenate([np.zeros(many), np.full(len(lexicons), 2.0), np.zeros(len(PATTERNS)), [-4.0]])
        return ToxicityModel(chosen, lexicons, weights)
    trust = min(1.0, UNLABELLED_MASS * known / unknown) if known and unknown else 1.0

    def expect(model: LabelModel) -> np.ndarray:
        def sums(batch: pa.RecordBatch) -> np.ndarray:
            given = batch.column("given").to_numpy()
            weight = batch.column("n").to_numpy() * np.where(given >= 0, 1.0, trust)
            return model.moments(_bits(batch.column("votes"), voters), given, weight)

        return _summed(patterns, sums, 2 * (voters * voters + 3))

    model = fit_labels(sides, bool(known), expect)

    def slope(w: np.ndarray) -> np.ndarray:
        def sums(batch: pa.RecordBatch) -> np.ndarray:
            given = batch.column("given").to_numpy()
            x = _bits(batch.column("bits"), width)
            return gradient(x, model.posterior(x[:, many:], given), np.where(given >= 0, 1.0, trust), w)

        return _summed(found, sums, width + 1)

    # the curvature of a bounded sample; where there are no labels, of any rows
    few = found.filter("given >= 0") if known else found
    few = few.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(LABELLED_ROWS).collect() if (known or unknown) <= LABELLED_ROWS else few.select("bits").sample(min(1.0, LABELLED_ROWS / (known or unknown)), seed=7).collect()
    taken = np.unpackbits(np.frombuffer(b"".join(r.bits for r in few), np.uint8).reshape(len(few), -1), axis=1)[:, :width]
    weights = fit_weights(slope, taken.astype(np.float64), (known + trust * unknown) / max(len(few), 1))
    return ToxicityModel(chosen, lexicons, weights, model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, and score and predicted for each row.

    A null text scores as an empty one, long texts are read whole, equal texts score alike, a score of exactly the limit
    is predicted toxic, an empty table gives an empty one. Columns named score or predicted are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in keep if c not in ("score", "predicted")]
    (own,) = free_names(docs.select(*names), "_scored")
    source = docs.select(*names, F.col("text").alias(own))
    schema = T.StructType([*docs.select(*names).schema.fields, *T.StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        featurizer = Featurizer(model.chosen, model.lexicons)
        for batch in batches:
            score = model.score([x.as_py() or "" for x in batch.column(own)], featurizer)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return source.mapInArrow(run, schema)

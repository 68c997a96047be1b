"""Language identification by interpolated Kneser-Ney character models.

One model of order four for each language, from counts over every labelled training text. Grams are 64-bit hashes in
sorted arrays. The language of a text is the one whose model gives the lowest cross-entropy for each character;
a text that no model predicts about as well as its own training texts is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, held_out, materialize

ORDER = 4
#: Up to so many grams, over all languages, the models are collected and broadcast; larger ones stay tables, with the same scores.
BROADCAST_GRAMS = 2_000_000
#: A text is rejected above this quantile of its language's training texts' cross-entropy, times the slack. Each text is
#: scored by models of the half of the texts that it is not in.
REJECT_QUANTILE, REJECT_SLACK = 0.999, 1.25
#: Cross-entropies are counted in steps of this part of a nat for the quantiles.
STEPS_A_NAT = 10_000
UNKNOWN = "und"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CACHE_BITS = 18
#: Grams that a worker holds while it counts, and that it scores at once.
COUNTED, SCORED = 1 << 20, 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to code point: letters and marks, lower-cased; all others 0."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(1, 0x110000):
        c = chr(i)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _symbols(text: str) -> np.ndarray:
    """16-bit symbols of a text, with one 0 for each run of other characters and three zeros before.

    A letter beyond U+FFFF is two symbols, its surrogates, so no two letters are one.
    """
    s = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    s = s[keep]
    if len(s) and s.max() > 0xFFFF:
        wide = s > 0xFFFF
        out = np.repeat(s, 1 + wide)
        at = np.flatnonzero(wide) + np.arange(int(wide.sum()))
        out[at], out[at + 1] = 0xD800 + ((s[wide] - 0x10000) >> 10), 0xDC00 + (s[wide] & 0x3FF)
        s = out
    return np.concatenate([np.zeros(ORDER - 1, np.uint16), s.astype(np.uint16)])


def _grams(symbols: np.ndarray) -> np.ndarray:
    """The packed gram that ends at each position from the fourth on."""
    x = symbols.astype(np.uint64)
    out = x[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out |= x[ORDER - 1 - k : len(x) - k] << np.uint64(16 * k)
    return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def _find(table: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(table, what), max(len(table) - 1, 0))
    return at, (table[at] == what) if len(table) else np.zeros(len(what), bool)


@dataclass
class KneserNey:
    """For each order: sorted hashes of grams with log-probabilities, sorted hashes of contexts with log-weights."""

    grams: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_back: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From the counts of the grams of the highest order; lower orders count distinct left extensions."""
        levels = [(grams, counts.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            low, n = np.unique(levels[-1][0] & _mask(order), return_counts=True)
            levels.append((low, n.astype(np.float64)))
        out, below, below_p = cls(), np.zeros(1, np.uint64), np.array([1 / 65536])
        for order, (gram, n) in enumerate(reversed(levels), 1):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            context, where = np.unique(gram >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(where, n), np.bincount(where)
            back = discount * kinds / total
            lower = below_p[np.searchsorted(below, gram & _mask(order - 1))] if order > 1 else below_p[0]
            p = np.maximum(n - discount, 0) / total[where] + back[where] * lower
            by, of = np.argsort(gram * _SPREAD), np.argsort(context * _SPREAD)
            out.grams.append((gram * _SPREAD)[by])
            out.log_p.append(np.log(p)[by].astype(np.float32))
            out.contexts.append((context * _SPREAD)[of])
            out.log_back.append(np.log(back)[of].astype(np.float32))
            sort = np.argsort(gram)
            below, below_p = gram[sort], p[sort]
        return out

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(gram), np.float32), np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            part = gram[open_] & _mask(order)
            at, hit = _find(self.grams[order - 1], part * _SPREAD)
            out[open_[hit]] += self.log_p[order - 1][at[hit]]
            open_, part = open_[~hit], part[~hit]
            at, hit = _find(self.contexts[order - 1], (part >> np.uint64(16)) * _SPREAD)
            out[open_[hit]] += self.log_back[order - 1][at[hit]]
        out[open_] += np.float32(np.log(1 / 65536))
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    models: list[KneserNey]
    limits: np.ndarray | None = None
    _keys: np.ndarray | None = None
    _values: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "models": self.models, "limits": self.limits, "_keys": None, "_values": None}

    def _log_probs(self, gram: np.ndarray) -> np.ndarray:
        """(grams, languages); what was looked up before comes from a direct-mapped memory."""
        if self._keys is None:
            self._keys = np.full(1 << _CACHE_BITS, 2**64 - 1, np.uint64)
            self._values = np.zeros((1 << _CACHE_BITS, len(self.models)), np.float32)
        slot = ((gram * _SPREAD) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        out, miss = self._values[slot], np.flatnonzero(self._keys[slot] != gram)
        if len(miss):
            fresh, where = np.unique(gram[miss], return_inverse=True)
            value = np.stack([m.log_prob(fresh) for m in self.models], axis=1)
            out[miss] = value[where]
            slot = ((fresh * _SPREAD) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
            self._keys[slot], self._values[slot] = fresh, value
            again = self._keys[slot] == fresh  # of two for one slot the last stays, with its own values
            self._values[slot[again]] = value[again]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy for each character (texts, languages), and the characters; a text without letters has 0."""
        parts = [_symbols(t) for t in texts]
        total, size = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        for i, s in enumerate(parts):
            if not s.any():
                continue
            size[i] = len(s) - ORDER + 1
        full = np.flatnonzero(size)
        lo = 0
        while lo < len(full):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[full[lo : lo + 2048]]), SCORED)))
            some = full[lo:hi]
            if len(some) == 1 and size[some[0]] > SCORED:  # one very long text, piece after piece
                g = _grams(parts[some[0]])
                total[some[0]] = sum(self._log_probs(g[a : a + SCORED]).sum(axis=0, dtype=np.float64) for a in range(0, len(g), SCORED))
            else:
                g = np.concatenate([_grams(parts[i]) for i in some])
                total[some] = np.add.reduceat(self._log_probs(g), np.cumsum(size[some]) - size[some], axis=0, dtype=np.float64)
            lo = hi
        return -total / np.maximum(size, 1)[:, None], size


def _count(named: DataFrame) -> DataFrame:
    """(half, lang, gram, n): counts over every text of ``named`` (text, label, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[tuple[int, str], list[np.ndarray]] = {}  # grams as they come
        held: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}  # distinct grams and their counts
        size = 0

        def fold() -> None:
            for key, parts in fresh.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                if key in held:
                    both = np.concatenate([held[key][0], gram])
                    gram, where = np.unique(both, return_inverse=True)
                    n = np.bincount(where, np.concatenate([held[key][1], n])).astype(np.int64)
                held[key] = gram, n
            fresh.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (half, lang), (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), half, np.int32)), pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["half", "lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, lang, half in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("half").to_pylist(), strict=True):
                s = _symbols(text.as_py())
                for lo in range(0, len(s) - ORDER + 1 if s.any() else 0, COUNTED):
                    part = _grams(s[lo : lo + COUNTED + ORDER - 1])
                    fresh.setdefault((half, lang), []).append(part)
                    size += len(part)
                    if size >= COUNTED:
                        fold()
                        size = 0
                        if sum(len(g) for g, _ in held.values()) > COUNTED:
                            yield from out()
        fold()
        yield from out()

    rows = named.select("text", "label", "half").mapInArrow(run, "half int, lang string, gram long, n long")
    return rows.groupBy("half", "lang", "gram").agg(F.sum("n").alias("n"))


def _low(gram: Column, order: int) -> Column:
    """The last ``order`` symbols of a gram in a long."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


@dataclass
class GramTables:
    """What KneserNey holds, of all languages, as tables by order: (lang, gram, log_p) and (lang, context, log_back)."""

    languages: list[str]
    grams: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)
    limits: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: DataFrame, languages: list[str]) -> GramTables:
        levels = [counts.select("lang", "gram", F.col("n").cast("double").alias("n"))]
        for order in range(ORDER - 1, 0, -1):
            low = levels[-1].groupBy("lang", _low(F.col("gram"), order).alias("gram"))
            levels.append(materialize(low.agg(F.count("*").cast("double").alias("n"))))
        out, below = cls(languages), None
        for order, level in enumerate(reversed(levels), 1):
            few = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
            share = F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.col("once") / (F.col("once") + 2 * F.col("twice"))))
            few = few.select("lang", F.when(F.col("once") + F.col("twice") > 0, share).otherwise(0.5).alias("discount"))
            context = level.groupBy("lang", _context(F.col("gram")).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            context = context.join(F.broadcast(few), "lang").withColumn("back", F.col("discount") * F.col("kinds") / F.col("total"))
            context = materialize(context)
            p = level.withColumn("context", _context(F.col("gram"))).withColumn("lower_gram", _low(F.col("gram"), order - 1) if order > 1 else F.lit(0))
            p = p.join(context, ["lang", "context"])
            if below is None:
                p = p.withColumn("lower", F.lit(1 / 65536))
            else:
                p = p.join(below.select("lang", F.col("gram").alias("lower_gram"), F.col("p").alias("lower")), ["lang", "lower_gram"])
            below = materialize(p.select("lang", "gram", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("lower")).alias("p")))
            out.grams.append(below.select("lang", "gram", F.log("p").alias("log_p")))
            out.contexts.append(context.select("lang", "context", F.log("back").alias("log_back")))
        return out

    def log_probs(self, asked: DataFrame) -> DataFrame:
        """lang, gram, log_p of each gram of ``asked`` in each language."""
        every = F.explode(F.array(*map(F.lit, self.languages))).alias("lang")  # a row for each language, as it is asked for
        below = None
        for order in range(1, ORDER + 1):
            q = asked.select(_low(F.col("gram"), order).alias("gram")).distinct().select("gram", every)
            q = q.withColumn("context", _context(F.col("gram"))).withColumn("lower_gram", _low(F.col("gram"), order - 1) if order > 1 else F.lit(0))
            q = q.join(self.grams[order - 1], ["lang", "gram"], "left").join(self.contexts[order - 1], ["lang", "context"], "left")
            if below is None:
                q = q.withColumn("lower", F.lit(float(np.log(1 / 65536))))
            else:
                q = q.join(below.select("lang", F.col("gram").alias("lower_gram"), F.col("log_p").alias("lower")), ["lang", "lower_gram"])
            below = q.select("lang", "gram", F.coalesce("log_p", F.coalesce("log_back", F.lit(0.0)) + F.col("lower")).alias("log_p"))
        return below

    def scored(self, docs: DataFrame) -> DataFrame:
        """As _scored: the grams of texts meet the tables by hash, and sums go back to their rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, text in zip(batch.column("_row").to_pylist(), batch.column("text"), strict=True):
                    text = text.as_py() or ""
                    s = _symbols(text) if any(c.isalpha() for c in text) else np.zeros(0, np.uint16)
                    for lo in range(0, len(s) - ORDER + 1 if s.any() else 0, COUNTED):
                        gram, k = np.unique(_grams(s[lo : lo + COUNTED + ORDER - 1]), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), row)), pa.array(gram.view(np.int64)), pa.array(k.astype(np.int64))], names=["_row", "gram", "k"])

        added = ["lang_pred", "score", "entropy", "chars", "rejected"]
        kept = [c for c in docs.columns if c not in ("text", *added)]
        (row,) = free_names(docs.select(*kept, *map(F.lit, added)), "_row")
        rows = materialize(docs.select(*kept, "text", F.monotonically_increasing_id().alias(row)))
        grams = materialize(rows.select(F.col(row).alias("_row"), "text").mapInArrow(run, "_row long, gram long, k long"))
        found = grams.join(materialize(self.log_probs(grams.select("gram").distinct())), "gram").groupBy("_row", "lang")
        found = found.agg((-F.sum(F.col("k") * F.col("log_p")) / F.sum("k")).alias("h"), F.sum("k").alias("chars"))
        found = found.groupBy("_row").agg(F.collect_list("h").alias("hs"), F.min(F.struct("h", "lang")).alias("low"), F.first("chars").alias("chars"))
        odds = F.aggregate("hs", F.lit(0.0), lambda a, h: a + F.exp((F.col("low.h") - h) * F.col("chars")))
        limits = self.limits if self.limits is not None else np.full(len(self.languages), np.inf)
        table = docs.sparkSession.createDataFrame(list(zip(self.languages, map(float, limits), strict=True)), "lang_pred string, limit double")
        found = found.select("_row", F.col("low.lang").alias("lang_pred"), (1 / odds).alias("score"), F.col("low.h").alias("entropy"), "chars")
        found = found.join(F.broadcast(table), "lang_pred").withColumn("rejected", F.col("entropy") > F.col("limit")).drop("limit").alias("f")
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "chars": F.lit(0).cast("long"), "rejected": F.lit(True)}
        out = rows.drop("text").alias("r").join(found, F.col(f"r.{row}") == F.col("f._row"), "left")
        return out.select(*[F.col(f"r.{c}") for c in kept], *(F.coalesce(f"f.{c}", none[c]).alias(c) if c in none else F.col(f"f.{c}") for c in added))


def _fit(counts: DataFrame) -> LanguageModel | GramTables:
    """Models from all counts (lang, gram, n): none is left out."""
    sizes = {r.lang: r["count"] for r in counts.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if sum(sizes.values()) > BROADCAST_GRAMS:
        return GramTables.fit(counts, languages)
    every, models = counts.toPandas(), []
    for lang in languages:
        part = every[every["lang"] == lang]
        gram = part["gram"].to_numpy().view(np.uint64)
        by = np.argsort(gram)
        models.append(KneserNey.fit(gram[by], part["n"].to_numpy()[by]))
    return LanguageModel(languages, models)


def fit_languages(train: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> LanguageModel | GramTables:
    """Learns from every row of ``train`` with a text and a label; without any, every text will be ``und``."""
    named = train.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    half = F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2)).cast("int")
    named = named.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), half.alias("half"))
    counts = materialize(_count(named))
    model = _fit(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if not model.languages:
        return LanguageModel([], [], np.zeros(0))
    steps = None
    for own in (0, 1):
        other = _fit(counts.filter(F.col("half") != own).select("lang", "gram", "n"))
        if not other.languages:
            continue
        rows = _scored(named.filter(F.col("half") == own), other).filter("label = lang_pred AND chars >= 20")
        part = rows.groupBy("label", F.ceil(F.col("entropy") * STEPS_A_NAT).alias("step")).count()
        steps = part if steps is None else steps.unionByName(part)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in steps.groupBy("label", "step").agg(F.sum("count").alias("k")).orderBy("step").collect():
        found.setdefault(r.label, []).append((r.step, r.k))
    limit = {x: _quantile(rows) / STEPS_A_NAT for x, rows in found.items()}
    # a language without a text to judge by is no stricter than any other
    model.limits = np.array([limit.get(x, max(limit.values(), default=np.inf)) * REJECT_SLACK for x in model.languages])
    return model


def _quantile(rows: list[tuple[int, int]]) -> int:
    """The least step that REJECT_QUANTILE of the counted rows do not exceed; rows: (step, count) in order."""
    step, n = np.array(rows, np.int64).T
    return int(step[np.searchsorted(np.cumsum(n), REJECT_QUANTILE * n.sum())])


def _scored(docs: DataFrame, model: LanguageModel | GramTables) -> DataFrame:
    """All columns of ``docs`` but text, and lang_pred, score, entropy, chars, rejected."""
    if isinstance(model, GramTables):
        return model.scored(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = "lang_pred string, score double, entropy double, chars long, rejected boolean"
    names = [x.split()[0] for x in added.split(", ")]
    kept = [f for f in docs.schema.fields if f.name not in ("text", *names)]
    schema = T.StructType([*kept, *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = len(texts)
                lang, score, entropy, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
                chars = np.zeros(n, np.int64)
                if model.languages:
                    h, chars = model.entropies(texts)
                    lettered = np.array([any(c.isalpha() for c in t) for t in texts], bool) & (chars > 0)
                    chars = np.where(lettered, chars, 0)
                    if lettered.any():
                        best = h.argmin(axis=1)
                        low = h[np.arange(n), best]
                        p = 1 / np.exp(-(h - low[:, None]) * chars[:, None]).sum(axis=1)
                        lang = np.where(lettered, np.array(model.languages, object)[best], UNKNOWN)
                        score, entropy = np.where(lettered, p, 0.0), np.where(lettered, low, np.nan)
                        if model.limits is not None:
                            rejected = ~lettered | (low > model.limits[best])
                        else:
                            rejected = ~lettered
                columns = [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(chars), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *names])

    return docs.mapInArrow(run, schema)


def identify_language(docs: DataFrame, model: LanguageModel | GramTables, keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score (0 to 1), entropy, chars and rejected for each row, with the columns in ``keep`` (all but text).

    ``und`` with score 0, rejected, where the text is null, empty or has no letter, or where nothing was learned. The
    score is the chosen model's share of all likelihoods of the whole text; of equal entropies the first language by name
    is taken. Long texts are scored whole, piece after piece. Columns of ``docs`` with these names are replaced, others
    may have any name; equal rows give equal rows, an empty table an empty one.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    return _scored(docs.select(*keep, "text"), model)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from."""
    return docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))


def language_filter(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model, learned from their own labels, rejects."""
    model = fit_languages(learnable(docs))
    if isinstance(model, GramTables):
        (number,) = free_names(docs, "_number")
        rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()))
        good = model.scored(rows.select(number, "text")).filter("NOT rejected")
        return rows.join(good.select(number), number, "left_semi").select(*docs.columns)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                if not model.languages:
                    yield part
                    continue
                texts = [x or "" for x in part.column("text").to_pylist()]
                h, chars = model.entropies(texts)
                lettered = np.array([any(c.isalpha() for c in t) for t in texts], bool) & (chars > 0)
                kept = lettered & (h.min(axis=1) <= model.limits[h.argmin(axis=1)])
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)

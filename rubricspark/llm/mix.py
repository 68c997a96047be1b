"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of fixed length. The mix is a row of
output shards with a fixed number of slots. Every shard draws from one multinomial how many of its slots each source
gets. The slots of a source are numbered over all shards. What is drawn beyond a source's target in blocks is dealt, by
a pseudorandom permutation, to the sources that fell short of theirs. Slot j of a source is the block at the
pseudorandom permutation of j within its pass over the source. Slots and documents meet by an equi-join on
(source, block).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, free_names, materialize, running_offset

#: Words in a block, and slots in an output shard.
BLOCK, SHARD_SLOTS = 64, 1024
#: The mix is a table of weights that somebody states, so its sources are few; more than this is an error.
MOST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[int], most: int) -> list[float]:
    """Shares of the total by weight; what is above ``most`` times a size stops there and is shared anew."""
    left, target = sum(sizes), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > most * sizes[i] * weight]
        for i in full or open_:
            target[i] = float(most * sizes[i]) if full else left * weights[i] / weight
        if not full:
            break
        left -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def block_quota(want: np.ndarray, blocks: np.ndarray, most: int) -> np.ndarray:
    """Whole slots for each source near ``want``, by largest remainders, ``most`` times its blocks at most."""
    quota = np.minimum(np.floor(want + 1e-9).astype(np.int64), most * blocks)
    short = int(np.floor(want.sum() + 0.5)) - int(quota.sum())
    room = np.flatnonzero(quota < most * blocks)
    by = room[np.argsort(-(want - quota)[room], kind="stable")]
    quota[by[: max(short, 0)]] += 1
    return quota


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: a four-round Feistel network, walked into the range."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            mixed = (right + np.uint64((key * 4 + r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Mix:
    """``documents``: doc_id, size, source, source_size, target, start, and the row's key (doc_id, digest, copy).

    ``slots``: one row for each slot of the mix: shard, source_no, slot (of that source), block.
    ``taken``: per document key and block: offset and number of its words there, and how many times the mix has them.
    """

    documents: DataFrame
    slots: DataFrame
    taken: DataFrame


#: A document's key: equal rows differ in ``copy`` only.
KEY = ["doc_id", "digest", "copy"]


def _digest() -> Column:
    return F.xxhash64("text", "source")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 20) -> Mix:
    """Plans a mix of all of ``docs`` (doc_id, text, source).

    A null text or an empty one has no words and is never taken; a null source is a source, ordered last; equal rows and
    rows with a null doc_id are separate documents; long texts span many blocks; an empty table gives an empty mix.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _digest().alias("digest"))
    sized = materialize(sized.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("size"))))

    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: state the weights of groups of sources instead")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.n) for r in found]
    target = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    blocks = np.array([-(-n // block) for n in sizes], np.int64)
    want = np.array([t * b / n if n else 0.0 for t, b, n in zip(target, blocks, sizes, strict=True)])
    table = [(i, r.source, n, t) for i, (r, n, t) in enumerate(zip(found, sizes, target, strict=True))]
    sources = spark.createDataFrame(table, "source_no int, source string, source_size long, target double")
    documents = sized.alias("d").join(F.broadcast(sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    documents = documents.select(*[f"d.{k}" for k in KEY], "d.size", "s.source_no", "s.source_size", "s.target")
    documents = materialize(running_offset(documents, ["source_no"], KEY, "size", "start"))

    quota = block_quota(want, blocks, most)
    total = int(quota.sum())
    shards = -(-total // shard_slots)
    share = quota / quota.sum() if total else want

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                slots = min(shard_slots, total - shard * shard_slots)
                n = np.random.default_rng([seed, int(shard)]).multinomial(slots, share)
                held = np.flatnonzero(n)
                yield pd.DataFrame({"shard": np.int64(shard), "source_no": held.astype(np.int32), "n": n[held].astype(np.int64)})

    counts = spark.range(shards).mapInPandas(draw, "shard long, source_no int, n long")
    counts = materialize(running_offset(counts, ["source_no"], ["shard"], "n", "first"))

    # what was drawn beyond the quotas, and who is short of it: one number a source
    drawn = np.zeros(len(sizes), np.int64)
    for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        drawn[r.source_no] = r.n
    gap, excess = np.maximum(quota - drawn, 0), np.maximum(drawn - quota, 0)
    ends, over = np.cumsum(gap), int(gap.sum())
    beyond = np.cumsum(excess) - excess

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                n = part["n"].to_numpy()
                no = np.repeat(part["source_no"].to_numpy(), n)
                slot = np.repeat(part["first"].to_numpy() - (np.cumsum(n) - n), n) + np.arange(n.sum())
                # which of a source's draws go beyond its quota is a matter of a permutation over all of them, not of their shard
                for key in np.unique(no):
                    here = np.flatnonzero(no == key)
                    slot[here] = permute(slot[here], int(drawn[key]), seed * 1_000_003 - 2 - int(key))
                dealt = np.flatnonzero(slot >= quota[no])
                if len(dealt):
                    at = permute(beyond[no[dealt]] + slot[dealt] - quota[no[dealt]], over, seed * 1_000_003 - 1)
                    no[dealt] = np.searchsorted(ends, at, side="right")
                    slot[dealt] = drawn[no[dealt]] + at - (ends - gap)[no[dealt]]
                passes, at = slot // blocks[no], slot % blocks[no]
                put = np.zeros(len(no), np.int64)
                which = no.astype(np.int64) * most + passes
                for key in np.unique(which):
                    here = np.flatnonzero(which == key)
                    put[here] = permute(at[here], int(blocks[key // most]), seed * 1_000_003 + int(key))
                yield pd.DataFrame({"shard": np.repeat(part["shard"].to_numpy(), n), "source_no": no, "slot": slot, "block": put})

    slots = counts.mapInPandas(place, "shard long, source_no int, slot long, block long")
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    of = F.col("start") + F.col("size")
    parts = documents.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    parts = parts.select(*KEY, "source_no", "block", (begin - F.col("start")).alias("offset"), (F.least(of, (F.col("block") + 1) * block) - begin).alias("words"))
    # never broadcast: the few draws that slots are made of tell the planner nothing of the slots' number
    taken = parts.join(times.hint("merge"), ["source_no", "block"]).select(*KEY, "offset", "words", "times")
    return Mix(documents, slots, taken)


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.digest") == F.col(f"{right}.digest")) & (F.col(f"{left}.copy") == F.col(f"{right}.copy"))


def taken_words(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document, taken or not."""
    sums = mix.taken.groupBy(*KEY).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    joined = mix.documents.alias("d").join(sums.alias("t"), _same("d", "t"), "left")
    return joined.select("d.doc_id", "d.size", "d.source_size", "d.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document's words come as often as its blocks do.

    A row is made for each of a document's passes; its text is what the mix takes of the document in that pass, with
    a line break where blocks are left out. Documents without a word in the mix (null and empty texts among them) go.
    Equal rows are documents of their own, a null doc_id too. ``n_chars`` follows the text; other columns stay under any name.
    """
    digest, copy, spans_ = free_names(docs, "_digest", "_copy", "_spans")
    spans = mix.taken.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("offset", "words", "times"))).alias(spans_))
    keyed = docs.withColumn(digest, _digest())
    twins = materialize(mix.documents.filter("copy > 1").select("doc_id", "digest").distinct())
    if twins.isEmpty():
        keyed = keyed.withColumn(copy, F.lit(1))
    else:  # only rows that occur twice are numbered
        twin = F.col("k.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col(f"k.{digest}") == F.col("w.digest"))
        n = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(digest))
        alone = keyed.alias("k").join(twins.alias("w"), twin, "left_anti").withColumn(copy, F.lit(1))
        keyed = alone.unionByName(keyed.alias("k").join(twins.alias("w"), twin, "left_semi").withColumn(copy, n))
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"d.{digest}") == F.col("t.digest")) & (F.col(f"d.{copy}") == F.col("t.copy"))
    joined = keyed.alias("d").join(spans.alias("t"), same).select("d.*", f"t.{spans_}").drop(digest, copy)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts, row, sizes = [], [], []
                for i, (text, spans) in enumerate(zip(part.column("text").to_pylist(), part.column(spans_).to_pylist(), strict=True)):
                    at = [m.span() for m in word.finditer(text)]
                    for k in range(1, max(s["times"] for s in spans) + 1):
                        runs: list[list[int]] = []
                        for s in spans:
                            if s["times"] >= k:
                                if runs and runs[-1][1] == s["offset"]:
                                    runs[-1][1] += s["words"]
                                else:
                                    runs.append([s["offset"], s["offset"] + s["words"]])
                        whole = len(runs) == 1 and runs[0] == [0, len(at)]
                        texts.append(text if whole else "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs))
                        row.append(i)
                        sizes.append(len(texts[-1]))
                out = part.select(names).take(pa.array(row, pa.int64()))
                columns = {n: out.column(n) for n in names}
                columns["text"] = pa.array(texts, out.schema.field("text").type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array(sizes, pa.int64()).cast(out.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return joined.mapInArrow(cut, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))

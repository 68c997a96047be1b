"""Removal of passages that an earlier document holds too, by suffix sorting of shards.

A passage is a string of LENGTH bytes. Equal passages choose the same anchor inside themselves (the K-byte string of
least hash), so only passages around anchors that two documents share can repeat. The surroundings of shared anchors,
each different one once, are dealt into shards by anchor. A shard's suffixes are sorted by induction (module induce),
which carries common prefixes along. Neighbours in that order with a common prefix of LENGTH bytes are one passage; the
smallest doc_id that holds it keeps it.

The surroundings of an anchor are just the passages that choose it. Where documents agree in all of them, the later
ones lose them without a sort; only the first document with each of several different surroundings sends its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ragged
from .induce import suffixes_down

LENGTH, K = 50, 16
#: Windows of K-byte strings in a passage.
SPAN = LENGTH - K + 1
#: Bytes from which a shard ends, where groups allow; passages of the sorted stream that are settled together.
SHARD, SETTLE = 1 << 21, 1 << 18
#: Rows that are settled together.
TOGETHER = 1 << 16
#: Bytes that are hashed at once: arrays of a piece stay in the cache.
_PIECE, _PLACE_BITS = 1 << 15, 24
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text), "<u8", padded, strides=(1,)).astype(np.uint64)


def _anchors_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors of all passages of a byte array, and their hashes."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _words(text)
    n = len(text) - K + 1
    h = word[:n] * _A
    h ^= h >> np.uint64(29)
    h = (h ^ word[8 : n + 8]) * _B
    h ^= h >> np.uint64(32)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    low = (h & ~place) | np.arange(n, dtype=np.uint64)  # ties go to the left
    step = 1
    while step * 2 <= SPAN:
        low, step = np.minimum(low[:-step], low[step:]), step * 2
    if step < SPAN:
        low = np.minimum(low[: step - SPAN], low[SPAN - step :])
    return (low & place).astype(np.int64), h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, count, hash, digest): for each anchor of each text the run of passages that choose it.

    begin is the place of the first of count passages; digest is of all bytes of the run.
    """
    rows, begins, counts, hashes, places = [], [], [], [], []
    ends = np.cumsum([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    for lo in range(0, len(flat), _PIECE):
        at, h = _anchors_of(flat[lo : lo + _PIECE + LENGTH - 1])
        if not len(at):
            continue
        # runs end where the anchor changes and where a text ends; passages do not go over that end
        last = int(np.searchsorted(ends, lo + len(at)))
        cuts = ends[int(np.searchsorted(ends, lo, side="right")) : last] - lo
        new = np.flatnonzero(at[1:] != at[:-1]) + 1
        new = np.unique(np.concatenate([[0], new, cuts[cuts < len(at)]])) if len(cuts) else np.concatenate([[0], new])
        begin = lo + new
        row = np.searchsorted(ends, begin, side="right")
        count = np.minimum(np.append(begin[1:], lo + len(at)), ends[row] - LENGTH + 1) - begin
        some = count > 0
        rows.append(row[some])
        begins.append(begin[some])
        counts.append(count[some])
        hashes.append(h[at[new[some]]])
        places.append(lo + at[new[some]])
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    row, begin, count, h, place = (np.concatenate(x) for x in (rows, begins, counts, hashes, places))
    if len(rows) > 1 and len(row):  # a run that goes on in the next piece is one
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
        count = np.add.reduceat(count, new)
        row, begin, h = row[new], begin[new], h[new]
    context = _digests(flat, begin, begin + count + LENGTH - 1)
    return row, begin - np.where(row > 0, ends[row - 1], 0), count, h, context


_ROOT = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _digests(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [begin, end), from running sums of a polynomial."""
    out, power, back = np.empty(len(begin), np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
    lo = 0
    while lo < len(begin):
        hi = int(np.searchsorted(begin, begin[lo] + _PIECE))
        base, stop = int(begin[lo]), int(end[lo:hi].max())
        part = flat[base:stop]
        if len(part) >= len(power):
            power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(part), x)])) for x in (_ROOT, _BACK))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        b, e = begin[lo:hi] - base, end[lo:hi] - base
        x = (total[e] - total[b]) * back[b] + (e - b).astype(np.uint64) * _B
        x ^= x >> np.uint64(31)
        x *= _A
        out[lo:hi] = x ^ (x >> np.uint64(29))
        lo = hi
    return out


def first_holders(contexts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each passage of each context, one after the other: the smallest doc of the contexts that hold it."""
    lengths = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    context = np.repeat(np.arange(len(contexts), dtype=np.int32), lengths)
    out = np.empty(len(text), np.int64)
    held, size, group = [], 0, 0  # passages whose group may go on, and their groups

    def close(last: bool) -> None:
        nonlocal held, size
        if not held:
            return
        at, of = (np.concatenate(x) for x in zip(*held, strict=True))
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        end = len(at) if last else int(new[-1])
        held, size = ([] if last else [(at[end:], of[end:])]), 0
        new = new[new < end]
        if len(new):
            owner = docs[context[at[:end]]]
            out[at[:end]] = np.repeat(np.minimum.reduceat(owner, new), np.diff(np.append(new, end)))

    for pos, lcp in suffixes_down(text):
        of = group + np.cumsum(lcp < LENGTH)  # a common prefix of a passage's length is the same passage
        group = int(of[-1])
        real = pos <= len(text) - LENGTH
        pos, of = pos[real], of[real]
        real = pos + LENGTH <= ends[context[pos]]
        if real.any():
            held.append((pos[real], of[real]))
            size += len(held[-1][0])
        if size > SETTLE:
            close(False)
    close(True)
    return out[ragged(ends - lengths, np.maximum(lengths - LENGTH + 1, 0))]


# --- Spark ---------------------------------------------------------------------------------------------


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed, because these are the most rows. k1 has 48 bits of the hash and 16 of the digest; k2 has a 0, 23 more bits
    of the digest, 6 of the count and 34 of the place.

    Of equal surroundings in one batch only those of the smallest doc_id go on: a passage that very many documents
    share is sent once a batch. The others are settled here; they travel as ranges of any length, spread by document,
    with a 1, 29 bits of the count and 34 of the place in k2.
    """
    for batch in batches:
        ids, twins = batch.column("doc_id").to_numpy(), batch.column("twin").to_numpy()
        row, begin, count, h, c = anchors([x.as_py() for x in batch.column("raw")])
        if not len(row):
            continue
        doc, twin = ids[row], twins[row]
        k1 = ((h & np.uint64(0xFFFFFFFFFFFF0000)) | (c >> np.uint64(48))).view(np.int64)
        low = ((c >> np.uint64(25)) & np.uint64(0x7FFFFF)).astype(np.int64)
        order = np.lexsort((doc, low, k1))
        a, b, d = k1[order], low[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        behind = np.empty(len(row), bool)
        behind[order] = d > np.repeat(d[new], np.diff(np.append(new, len(d))))
        go = ~behind
        k2 = (low[go] << 40) | (count[go] << 34) | begin[go]
        first, second, third, fourth = [k1[go]], [k2], [doc[go]], [twin[go]]
        if behind.any():
            r, s, n, d, w = row[behind], begin[behind], count[behind], doc[behind], twin[behind]
            starts = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + n[:-1])]))
            total = np.add.reduceat(n, starts)
            mixed = (d[starts].astype(np.uint64) * _A) ^ (s[starts].astype(np.uint64) * _B)
            first.append((mixed & np.uint64(0xFFFFFFFFFFFF0000)).view(np.int64))
            second.append((total << 34) | s[starts] | np.int64(-(1 << 63)))
            third.append(d[starts])
            fourth.append(w[starts])
        k1, k2, doc, twin = (np.concatenate(x) for x in (first, second, third, fourth))
        for lo in range(0, len(k1), 1 << 17):
            cut = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(k1[cut]), pa.array(k2[cut]), pa.array(doc[cut]), pa.array(twin[cut])], names=["k1", "k2", "doc_id", "twin"])


_RANGE = (1 << 40) - 1


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by k1, which begins with the hash: what is settled, and what must be looked at.

    Rows behind the first document with the same surroundings lose them (h null). Where one hash has several
    surroundings, in more than one document, the first document with each must be looked at (h not null). Of the last
    hash of a batch only those first rows are held over, so a hash that very many documents share holds nothing up.
    """

    def rows(doc: np.ndarray, twin: np.ndarray, at: np.ndarray, h: np.ndarray | None) -> pa.RecordBatch:
        place = pa.array(at)
        of = pa.nulls(len(doc), pa.int64()) if h is None else pa.array(h)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(twin), place, of], names=["doc_id", "twin", "at", "h"])

    held, parts, size = [np.zeros(0, np.int64)] * 4, [], 0
    for batch in batches:
        parts.append([batch.column(n).to_numpy() for n in ("k1", "k2", "doc_id", "twin")])
        size += batch.num_rows
        if size >= TOGETHER:
            yield from _settle_some(held, parts, False, rows)
            parts, size = [], 0
    yield from _settle_some(held, parts, True, rows)


def _settle_some(held: list[np.ndarray], parts: list[list[np.ndarray]], last: bool, rows) -> Iterator[pa.RecordBatch]:
    k1, k2, doc, twin = (np.concatenate(x) for x in zip(held, *parts, strict=True))
    done = k2 < 0
    if done.any():
        yield rows(doc[done], twin[done], k2[done] & ((1 << 63) - 1), None)
        k1, k2, doc, twin = (x[~done] for x in (k1, k2, doc, twin))
    if not len(k1):
        return
    same = k1[1:] == k1[:-1]
    at = np.flatnonzero(np.append(False, same) | np.append(same, False))
    by = at[np.lexsort((doc[at], k2[at] >> 40, k1[at]))]
    k2[at], doc[at], twin[at] = k2[by], doc[by], twin[by]
    h, c = k1 >> 16, ((k1 & 0xFFFF) << 23) | (k2 >> 40)
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    run = np.flatnonzero(new_c)
    behind = doc > np.repeat(doc[run], np.diff(np.append(run, len(doc))))
    if behind.any():
        yield rows(doc[behind], twin[behind], k2[behind] & _RANGE, None)
    keep = ~behind
    k1, k2, doc, twin, h, new_c = k1[keep], k2[keep], doc[keep], twin[keep], h[keep], new_c[keep]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    end = len(h) if last else int(cut[-1])
    held[:] = [k1[end:], k2[end:], doc[end:], twin[end:]]
    k2, doc, twin, h, new_c = k2[:end], doc[:end], twin[:end], h[:end], new_c[:end]
    cut = cut[cut < end]
    if not len(cut):
        return
    size = np.diff(np.append(cut, end))
    several = (np.add.reduceat(new_c.astype(np.int64), cut) > 1) & (np.maximum.reduceat(doc, cut) != np.minimum.reduceat(doc, cut))
    ask = np.repeat(several, size)
    if ask.any():
        yield rows(doc[ask], twin[ask], k2[ask] & _RANGE, h[ask])


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, ctx, doc_id, twin, begin): the bytes of the runs of passages that must be looked at."""
    for batch in batches:
        h, ctx, ids, twins, begins = [], [], [], [], []
        for i, (doc_id, twin, raw) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("doc_id", "twin", "raw")), strict=True)):
            asked = batch.column("asked")[i].values
            at = asked.field("at").to_numpy()
            begin = at & ((1 << 34) - 1)
            end = begin + (at >> 34) + LENGTH - 1
            h.append(asked.field("h").to_numpy())
            ctx += [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            ids.append(np.full(len(at), doc_id))
            twins.append(np.full(len(at), twin))
            begins.append(begin)
        if ctx:
            h, ids, twins, begins = (pa.array(np.concatenate(x).astype(np.int64)) for x in (h, ids, twins, begins))
            yield pa.RecordBatch.from_arrays([h, pa.array(ctx, pa.binary()), ids, twins, begins], names=["h", "ctx", "doc_id", "twin", "begin"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by h: ranges [lo, hi) that a document loses to one with a smaller doc_id."""
    shard: list[tuple] = []  # (contexts, their lengths, doc_id, twin, begin)
    size, last = 0, None

    def sort() -> Iterator[pa.RecordBatch]:
        nonlocal size
        place: dict[bytes, int] = {}
        of = np.array([place.setdefault(c, len(place)) for some in shard for c in some[0]], np.int64)
        length, doc, twin, begin = (np.concatenate(x) for x in list(zip(*shard, strict=True))[1:])
        owner = np.full(len(place), np.iinfo(np.int64).max)
        np.minimum.at(owner, of, doc)
        texts = list(place)
        least = first_holders(texts, owner)
        count = length - LENGTH + 1
        first = np.cumsum([0, *(len(t) - LENGTH + 1 for t in texts)])[of]
        shard.clear()
        size = 0
        for lo in range(0, len(of), 1 << 16):
            n, d = count[lo : lo + (1 << 16)], doc[lo : lo + (1 << 16)]
            ends = np.cumsum(n)
            row, lost = np.repeat(np.arange(len(n)), n), least[ragged(first[lo : lo + (1 << 16)], n)] < np.repeat(d, n)
            before, behind = np.append(False, lost[:-1]), np.append(lost[1:], False)
            before[(ends - n)[n > 0]] = behind[ends[n > 0] - 1] = False
            a, b = np.flatnonzero(lost & ~before), np.flatnonzero(lost & ~behind)
            own = row[a]
            start = begin[lo : lo + (1 << 16)][own] - (ends - n)[own]
            cells = d[own], twin[lo : lo + (1 << 16)][own], start + a, start + b + LENGTH
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cells], names=["doc_id", "twin", "lo", "hi"])

    for batch in batches:
        h, doc, twin, begin = (batch.column(n).to_numpy() for n in ("h", "doc_id", "twin", "begin"))
        ctx, lo = batch.column("ctx").to_pylist(), 0
        length = np.fromiter(map(len, ctx), np.int64, len(ctx))
        new = np.append(last is None or h[:1] != last, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        while lo < len(h):
            held = size + np.cumsum(length[lo:]) - length[lo:]
            cut = np.flatnonzero(new[lo:] & (held > SHARD))
            hi = lo + int(cut[0]) if len(cut) else len(h)
            if hi > lo:
                shard.append((ctx[lo:hi], length[lo:hi], doc[lo:hi], twin[lo:hi], begin[lo:hi]))
                size += int(length[lo:hi].sum())
            if len(cut):
                yield from sort()
            lo = hi
        last = h[-1] if len(h) else last
    if shard:
        yield from sort()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, n_spans, size = [], [], [], []
        for i, raw in enumerate(batch.column("raw").to_pylist()):
            spans = batch.column("spans")[i].values
            size.append(len(raw))
            if spans is None or not len(spans):
                kept.append(raw)
                removed.append(0)
                n_spans.append(0)
                continue
            mark = np.zeros(len(raw) + 1, np.int64)
            np.add.at(mark, np.minimum(spans.field("lo").to_numpy(), len(raw)), 1)
            np.add.at(mark, np.minimum(spans.field("hi").to_numpy(), len(raw)), -1)
            gone = np.cumsum(mark)[:-1] > 0
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            n_spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
        cols = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (binary), n_removed, n_spans for each row: without bytes of passages that a document with a
    smaller doc_id holds too.

    Passages are judged on the input; they never go over the end of a text, and repeats within one document, or
    between rows of one doc_id, stay; such rows may differ and each is cut for itself. A null or an empty text has no
    bytes, a text shorter than a passage keeps all, long texts are read whole. Rows with a null doc_id keep all and
    remove nothing. Ids are whole numbers. An empty table gives an empty one; other columns may have any name.
    """
    plain = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    twins = materialize(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    named = plain.filter("doc_id IS NOT NULL")
    if twins.isEmpty():
        named = named.withColumn("twin", F.lit(0).cast("long"))
    else:  # rows of one doc_id are told apart by their texts
        alone = named.join(twins, "doc_id", "left_anti").withColumn("twin", F.lit(0).cast("long"))
        named = alone.unionByName(named.join(twins, "doc_id", "left_semi").withColumn("twin", F.xxhash64("raw")))
    found = named.filter(F.length("raw") >= LENGTH).mapInArrow(_emit_anchors, "k1 long, k2 long, doc_id long, twin long")
    dealt = found.repartition(F.shiftright("k1", 16)).sortWithinPartitions("k1")  # one number: a radix sort
    settled = materialize(dealt.mapInArrow(_settle, "doc_id long, twin long, at long, h long"))

    begin, count, row = F.col("at").bitwiseAND((1 << 34) - 1), F.shiftright("at", 34), ["doc_id", "twin"]
    lost = settled.filter("h IS NULL").select(*row, begin.alias("lo"), (begin + count + LENGTH - 1).alias("hi"))
    asked = settled.filter("h IS NOT NULL").groupBy(*row).agg(F.collect_list(F.struct("h", "at")).alias("asked"))
    sent = named.dropDuplicates(row) if not twins.isEmpty() else named  # equal rows send their bytes once
    sent = sent.join(asked.hint("merge"), row).mapInArrow(_send_texts, "h long, ctx binary, doc_id long, twin long, begin long")
    judged = sent.repartition("h").sortWithinPartitions("h").mapInArrow(_judge, "doc_id long, twin long, lo long, hi long")
    spans = lost.unionByName(judged).groupBy(*row).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    # both joins read one shuffle of the texts
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")
    all_ = named.join(spans.hint("merge"), row, "left").mapInArrow(_cut, schema)
    none = plain.filter("doc_id IS NULL").select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.col("raw").alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    return all_.unionByName(none)

"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits that differ in 4 bits or fewer agree, up to one bit, in one of three segments. Each segment is
indexed once for each of its bits with that bit deleted: two segments that differ in one bit at most share a variant.
Equal variants meet by a shuffle and every link is verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, materialize
from .components import connected_components, spanning_links

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: First bit and width of the segments: DISTANCE // len(SEGMENTS) bits at most differ in one of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: A variant shared by more fingerprints than this is split by further bits before its members are compared.
BUCKET = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one whole text; zero without words."""
    words = text.lower().split()  # on bytes: A-Z only, and the six blanks of ASCII
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64)
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        octets = hashes[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_ = np.flatnonzero(2 * bits > len(hashes))
    return int(sum(1 << int(i) for i in set_))


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``out_col`` (long, the fingerprint's bits) in place of the text. A null text has no words."""
    kept = [f for f in docs.schema.fields if f.name not in (text_col, out_col)]
    raw = docs.select(*[f.name for f in kept], F.col(text_col).cast("binary").alias("_raw"))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column("_raw")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fps.view(np.int64))], names=[*names, out_col])

    return raw.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.LongType(), False)]))


def _variants(fps: np.ndarray) -> np.ndarray:
    """(len(fps), 64) keys: segment, deleted bit, and the segment's other bits."""
    out, column = np.empty((len(fps), 64), np.int64), 0
    for first, width in SEGMENTS:
        part = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            low = part & np.uint64((1 << bit) - 1)
            high = part >> np.uint64(bit + 1)
            out[:, column] = ((high << np.uint64(bit)) | low).astype(np.int64) | (np.int64(column) << np.int64(22))
            column += 1
    return out


def _pieces(fps: np.ndarray, column: np.ndarray) -> list[np.ndarray]:
    """The bits outside a variant's segment in DISTANCE + 1 pieces: fingerprints within the distance agree in one."""
    first = np.array([s for s, w in SEGMENTS for _ in range(w)], np.uint64)[column]
    width = np.array([w for _, w in SEGMENTS for _ in range(w)], np.uint64)[column]
    # the segment is cut out, the rest moves together
    low = fps & ((np.uint64(1) << first) - np.uint64(1))
    high = np.where(first + width < 64, fps >> np.minimum(first + width, np.uint64(63)), np.uint64(0))
    rest = low | (high << first)
    return [((rest >> np.uint64(9 * k)) & np.uint64(511)).astype(np.int64) | np.int64(k << 9) for k in range(DISTANCE + 1)]


def _near(fps: np.ndarray, distance: int = DISTANCE):
    return lambda i, others: np.bitwise_count(fps[others] ^ fps[i]) <= distance


def _links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links, enough to connect what links, within runs of equal keys (sorted by key, then fingerprint)."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([cut, [len(key)]]))
    group = np.repeat(np.arange(len(cut)), size)
    out_a, out_b = [], []
    small = size <= 16
    inside = np.flatnonzero(small[group])
    for step in range(1, int(size[small].max(initial=0))):
        left = inside[inside + step < len(key)]
        left = left[group[left] == group[left + step]]
        hit = np.bitwise_count(fps[left] ^ fps[left + step]) <= DISTANCE
        out_a.append(fps[left[hit]])
        out_b.append(fps[left[hit] + step])
    for g in np.flatnonzero(~small):
        own = fps[cut[g] : cut[g] + size[g]]
        a, b = spanning_links(len(own), _near(own))
        out_a.append(own[a])
        out_b.append(own[b])
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition that is sorted by (key, fp); a run of equal keys may go over several batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the last key's run, joined only when it ends

    def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _links(key, fp)
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def joined() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
        held.clear()
        return both

    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(key):
            continue
        end = int(np.searchsorted(key, key[-1]))
        if held and (end or held[-1][0][-1] != key[-1]):
            own = int(np.searchsorted(key, held[-1][0][-1], side="right"))
            held.append((key[:own], fp[:own]))
            yield from out(*joined())
            key, fp, end = key[own:], fp[own:], end - own
        if end:
            yield from out(key[:end], fp[:end])
        held.append((key[end:], fp[end:]))
    if held:
        yield from out(*joined())


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): verified links among distinct fingerprints (fp long) that connect all that link within the distance."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 4096):
                part = fps[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(_variants(part).ravel()), pa.array(np.repeat(part, 64).view(np.int64))], names=["key", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, key = batch.column("fp").to_numpy().view(np.uint64), batch.column("key").to_numpy()
            for piece in _pieces(fps, key >> 22):
                yield pa.RecordBatch.from_arrays([pa.array((key << 12) | piece), pa.array(fps.view(np.int64))], names=["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(index, "key long, fp long")
    large = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("key"))
    if large.isEmpty():
        plain, fine = keyed, None
    else:
        plain = keyed.join(large, "key", "left_anti")
        fine = keyed.join(large, "key", "left_semi").select("key", "fp").mapInArrow(split, "key long, fp long")
    links = plain.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches, "a long, b long")
    if fine is not None:
        links = links.unionByName(fine.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches, "a long, b long"))
    return links.distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id reachable over links, its own included.

    Texts with equal fingerprints are one class; classes are linked, not their members, so a group of copies of any
    size is one row of the index. A null or blank text has fingerprint zero, which links like any other. Rows of one
    doc_id are one document and give a row each. A null doc_id is no node: its row takes the component of its class,
    null where the class has no other document. Long texts are read whole, an empty table gives an empty one, and only
    doc_id and text are looked at, so other columns may have any name.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text")))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(classes).select("a", "b")
    named = links.join(classes.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    named = named.join(classes.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    roots = connected_components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    of_class = classes.join(roots, classes["first"] == roots["node"], "left")
    of_class = of_class.select("fp", F.coalesce("root", "first").alias("component_id"))
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the smallest doc_id stays.

    Equal rows of that doc_id are one document and one of them stays; a null doc_id stays. Null and empty texts are near
    each other (fingerprint zero). An empty table gives an empty one; other columns may have any name.
    """
    (first,) = free_names(docs, "_first")
    firsts = simhash_components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(first)).distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(firsts, F.col("doc_id") == F.col(first), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))

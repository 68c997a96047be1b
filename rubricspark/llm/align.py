"""Alignment of the tokens that two tokenizers make of one text.

Tokens are laid over the text's bytes; offsets where tokens of both end cut them into groups. Cuts are found by diagonal
run skipping over the two arrays of ends: at the current shift between the arrays a probe of growing width is compared
entry by entry, so stretches of one-to-one tokens are jumped; where the ends differ, the group is resolved by stepping
the side that is behind, and the shift is what that leaves. Many cursors do so at once, each on a lane of tokens between
two common ends, so that numpy compares whole columns of probes.

An id pair can be linked only if the bytes of one token end those of the other. Such pairs get numbers by arithmetic on the
vocabularies, below a bound that the vocabularies' bytes give, so corpus-wide counts are arrays of known size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _rank_file, _slices
from .common import materialize, ragged

#: Tokens of a lane, and the widest probe.
LANE, WIDEST = 256, 64
#: Bytes of text that are aligned together; a longer text is taken alone.
TOGETHER = 1 << 20


# --- vocabularies -----------------------------------------------------------------------------------


def byte_symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE of the ``tokenizers`` library, from its JSON."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.library = Tokenizer.from_str(raw.decode())
        self.library.encode_special_tokens = True
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            known = all(c in symbols for c in entry)
            self.tokens[i] = bytes(symbols[c] for c in entry) if known else entry.encode()
        self.fast = self._by_ranks(spec, vocab)

    def _by_ranks(self, spec: dict, vocab: dict[str, int]):
        """The same encoding by ranks, where the file's ids are in the order of its merges and it cuts by the usual pattern."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or model.get("dropout") or model.get("ignore_merges") or [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {t: i for i, t in enumerate(self.tokens[: 256 + len(pairs)])}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str], astral: np.ndarray) -> list[list[int]]:
        """Ids of each text with a space before it. Beyond U+FFFF the library's own classes of characters count."""
        texts = [" " + t for t in texts]
        if self.fast is None:
            astral = np.ones(len(texts), bool)
        slow = iter(self.library.encode_batch_fast([t for t, far in zip(texts, astral, strict=True) if far], add_special_tokens=False))
        return [next(slow).ids if far else self.fast.encode_ordinary(t) for t, far in zip(texts, astral, strict=True)]


class Pieces:
    """A model of the ``sentencepiece`` library."""

    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=raw)
        m = self.library
        self.tokens = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str], astral: np.ndarray) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []


class Table:
    """Bytes, lengths and printed forms of a vocabulary's tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        seen: dict[bytes, int] = {}
        self.again = np.zeros(len(tokens), np.int64)  # tokens of the same bytes are told apart by this
        for i, t in enumerate(tokens):
            self.again[i] = seen.get(t, 0)
            seen[t] = self.again[i] + 1
        self.times = int(self.again.max(initial=0)) + 1
        width = len(str(max(1, len(tokens) - 1)))
        self.printed = np.zeros((len(tokens), width + 1), np.uint8)
        for i in range(len(tokens)):
            digits = str(i).encode()
            self.printed[i, width - len(digits) : width] = np.frombuffer(digits, np.uint8)
        self.digits = np.count_nonzero(self.printed, axis=1)


class Pairing:
    """Two vocabularies, and numbers for the pairs of ids that can be linked: below ``size``, whatever the corpus."""

    def __init__(self, a_raw: bytes, b_raw: bytes):
        self.a_coder, self.b_coder = ByteLevel(a_raw), Pieces(b_raw)
        self.a, self.b = Table(self.a_coder.tokens), Table(self.b_coder.tokens)
        # a slot for each length that an ending of the longer token can have, times tokens of the same bytes
        self.a_base = np.cumsum(self.a.length) - self.a.length
        self.b_base = np.cumsum(self.b.length) - self.b.length
        self.b_from = int(self.a.length.sum()) * self.b.times
        self.size = self.b_from + int(self.b.length.sum()) * self.a.times

    def number(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of each pair of an A id and a B id of which one ends the other."""
        la, lb = self.a.length[x], self.b.length[y]
        inner = (self.a_base[x] + lb - 1) * self.b.times + self.b.again[y]
        outer = self.b_from + (self.b_base[y] + la - 1) * self.a.times + self.a.again[x]
        return np.where(lb <= la, inner, outer)

    def b_ids(self) -> np.ndarray:
        """The B id of each number; -1 for numbers that no pair has."""
        out = np.full(self.size, -1, np.int64)
        by_bytes: dict[bytes, list[int]] = {}
        for y, t in enumerate(self.b.tokens):
            by_bytes.setdefault(t, []).append(y)
        for x, t in enumerate(self.a.tokens):
            for n in range(1, len(t) + 1):
                for y in by_bytes.get(t[-n:], ()):
                    out[(self.a_base[x] + n - 1) * self.b.times + self.b.again[y]] = y
        out[self.b_from :] = np.repeat(np.arange(len(self.b.tokens)), self.b.length * self.a.times)
        return out


@lru_cache(maxsize=2)
def _pairing(a_raw: bytes, b_raw: bytes) -> Pairing:
    return Pairing(a_raw, b_raw)


# --- diagonal run skipping ----------------------------------------------------------------------------


def _lane_starts(ea: np.ndarray, eb: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of A and of B where lanes begin: after common ends, about ``lane`` tokens of A apart."""
    last = np.arange(lane, len(ea), lane) - 1
    at = np.searchsorted(eb, ea[last])
    while (apart := np.flatnonzero(eb[at] != ea[last])).size:
        last[apart] += 1  # the last ends are common, so this ends
        at[apart] = np.searchsorted(eb, ea[last[apart]])
    last, first = np.unique(last, return_index=True)
    begin = np.concatenate([[0], last + 1])
    return begin[begin < len(ea)], np.concatenate([[0], at[first] + 1])[begin < len(ea)]


def cut_groups(ea: np.ndarray, eb: np.ndarray, lane: int = LANE, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A, and which of B, end a group. Both arrays of ends rise strictly and end at one offset."""
    in_a, in_b = np.zeros(len(ea), bool), np.zeros(len(eb), bool)
    if not len(ea):
        return in_a, in_b
    i, j = _lane_starts(ea, eb, lane)
    stop = np.append(i[1:], len(ea))
    width = np.ones(len(i), np.int64)
    far_a, far_b = np.append(ea, -1), np.append(eb, -2)  # what lies beyond differs
    while len(i):
        run = np.zeros(len(i), np.int64)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            step = np.arange(w)
            x, y = np.minimum(i[mine, None] + step, len(ea)), np.minimum(j[mine, None] + step, len(eb))
            same = (far_a[x] == far_b[y]) & (x < stop[mine, None])
            run[mine] = np.where(same.all(axis=1), w, same.argmin(axis=1))
        jumped = ragged(i, run)
        in_a[jumped] = True
        in_b[ragged(j, run)] = True
        i, j = i + run, j + run
        width = np.where(run == width, np.minimum(2 * width, widest), np.maximum(width // 2, 1))
        odd = np.flatnonzero((i < stop) & (far_a[i] != far_b[j]))
        p, q, todo = i[odd], j[odd], np.arange(len(odd))
        while len(todo):
            a, b = ea[p[todo]], eb[q[todo]]
            p[todo] += a < b
            q[todo] += b < a
            todo = todo[a != b]
        in_a[p], in_b[q] = True, True
        i[odd], j[odd] = p + 1, q + 1
        on = i < stop
        i, j, stop, width = i[on], j[on], stop[on], width[on]
    return in_a, in_b


# --- documents ----------------------------------------------------------------------------------------


def _spell(pairing: Pairing, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;...``: its bytes, and how many each token of A and of B takes. ``last``: B tokens that end a document."""
    groups_a, groups_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    ends_a, ends_b = np.flatnonzero(in_a) + 1, np.flatnonzero(in_b) + 1
    place_a = np.arange(len(a)) + np.concatenate([[0], ends_b])[groups_a]
    place_b = np.arange(len(b)) + ends_a[groups_b]
    width = max(pairing.a.printed.shape[1], pairing.b.printed.shape[1])
    cells = np.zeros((len(a) + len(b), width), np.uint8)
    for table, ids, place, mark in ((pairing.a, a, place_a, np.where(in_a, ord("|"), ord(","))), (pairing.b, b, place_b, np.where(last, 0, np.where(in_b, ord(";"), ord(","))))):
        own = table.printed.shape[1]
        shown = table.printed[ids]
        shown[:, -1] = mark
        cells[place, width - own :] = shown
    flat = cells.ravel()
    return flat[flat != 0], pairing.a.digits[a] + 1, pairing.b.digits[b] + ~last


def _same_bytes(table: Table, ids: np.ndarray, counts: np.ndarray, want: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document, whether its tokens' bytes are those of ``want`` (documents one after the other)."""
    lengths = table.length[ids]
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
    made = np.diff(ends, prepend=0)
    ok = made == sizes
    # compare where lengths agree, each side at its own offset
    own, theirs = ragged((ends - made)[ok], made[ok]), ragged((np.cumsum(sizes) - sizes)[ok], sizes[ok])
    data = table.bytes[ragged(table.start[ids], lengths)]
    wrong = np.concatenate([[0], np.cumsum(data[own] != want[theirs])])[np.cumsum(sizes[ok])]
    ok[np.flatnonzero(ok)[np.diff(wrong, prepend=0) > 0]] = False
    return ok


def _sums(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[np.cumsum(counts)], prepend=0)


def align_texts(pairing: Pairing, texts: list[str], keep_groups: bool = False) -> dict[str, list | np.ndarray]:
    """Of each text n_a, n_b, n_groups, groups_sha256, the numbers of its links, and its groups if asked for."""
    raw = [(" " + t).encode() if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    want = np.frombuffer(b"".join(raw), np.uint8)
    astral = _sums(want >= 0xF0, sizes) > 0
    use = np.flatnonzero(sizes)
    some = [texts[k] for k in use]
    found = [coder.encode(some, astral[use]) for coder in (pairing.a_coder, pairing.b_coder)]
    counts = [np.zeros(len(texts), np.int64) for _ in found]
    flat = []
    for n, ids in zip(counts, found, strict=True):
        n[use] = [len(x) for x in ids]
        flat.append(np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())))
    ok = sizes > 0
    for table, n, ids in zip((pairing.a, pairing.b), counts, flat, strict=True):
        ok &= _same_bytes(table, ids, n, want, sizes)
    flat = [ids[np.repeat(ok, n)] for n, ids in zip(counts, flat, strict=True)]
    (na, nb), (a, b) = [np.where(ok, n, 0) for n in counts], flat
    in_a, in_b = cut_groups(np.cumsum(pairing.a.length[a]), np.cumsum(pairing.b.length[b]))
    links = pairing.number(a[in_a], b[in_b]).astype(np.int32)
    groups = _sums(in_a, na)
    last = np.zeros(len(b), bool)
    last[np.cumsum(nb)[nb > 0] - 1] = True
    spelled, wide_a, wide_b = _spell(pairing, a, b, in_a, in_b, last)
    ends = np.cumsum(_sums(wide_a, na) + _sums(wide_b, nb))
    raw_spelled = spelled.tobytes()
    parts = [raw_spelled[lo:hi] for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
    cuts = np.concatenate([[0], np.cumsum(groups)])
    out = {"n_a": na, "n_b": nb, "n_groups": groups, "groups_sha256": [hashlib.sha256(p).hexdigest() if p else "" for p in parts], "links": links, "cuts": cuts}
    if keep_groups:
        out["groups"] = [p.decode() for p in parts]
    return out


def _aligned(docs: DataFrame, held, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """A row for each document with its links' numbers; and, with a null ``n_a``, one for each task with the numbers it has met and how often."""
    id_type = docs.schema[id_col].dataType
    extra = ", groups string" if keep_groups else ""
    schema = f"{id_col} {id_type.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, counts binary{extra}"
    docs = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairing = _pairing(*held.value)
        total, id_arrow = np.zeros(pairing.size, np.int64), None
        names = [id_col, "n_a", "n_b", "n_groups", "groups_sha256", "links", "counts"] + ["groups"] * keep_groups
        for batch in batches:
            id_arrow = batch.column(0).type
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _slices(sizes + 1, TOGETHER):
                part = batch.slice(lo, hi - lo)
                got = align_texts(pairing, [t or "" for t in part.column(1).to_pylist()], keep_groups)
                total += np.bincount(got["links"], minlength=pairing.size)
                offsets = pa.py_buffer((4 * got["cuts"]).astype(np.int32))
                links = pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets, pa.py_buffer(got["links"])])
                cells = [part.column(0), *(pa.array(got[n], pa.int64()) for n in names[1:4]), pa.array(got["groups_sha256"], pa.string()), links, pa.nulls(hi - lo, pa.binary())]
                if keep_groups:
                    cells.append(pa.array(got["groups"], pa.string()))
                yield pa.RecordBatch.from_arrays(cells, names=names)
        met = np.flatnonzero(total)
        if len(met):
            cells = [pa.nulls(1, id_arrow), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()), pa.array([met.astype("<i4").tobytes()]), pa.array([total[met].astype("<i8").tobytes()])]
            yield pa.RecordBatch.from_arrays(cells + [pa.nulls(1, pa.string())] * keep_groups, names=names)

    return docs.mapInArrow(run, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for links, counts in zip(batch.column("links"), batch.column("counts"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(links.as_py(), "<i4"), pa.int32()), pa.array(np.frombuffer(counts.as_py(), "<i8"), pa.int64())], names=["pair", "n"])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and its groups if asked for.

    A is a byte-level BPE file of the ``tokenizers`` library, applied to a space and the text; B a ``sentencepiece`` model,
    applied to the text. No special tokens are made. A text that is null, empty, or not spelled byte by byte by its tokens has
    none: zeros and ''. Repeated rows are documents of their own and count as often; a null id is kept. A very long text is
    taken whole, in memory of its size times a constant. Other columns are left out. An empty table gives an empty one.

    Texts are encoded once: links are kept in a table in the shared folder and counted by task, counts are added up by
    pair. The counts come to the driver and back as arrays of ``Pairing.size`` entries, which the two vocabularies bound.
    """
    spark = docs.sparkSession
    raw = (_rank_file(spark, a_path), _rank_file(spark, b_path))
    held = spark.sparkContext.broadcast(raw)
    pairing = _pairing(*raw)
    aligned = materialize(_aligned(docs, held, id_col, text_col, keep_groups))
    met = aligned.filter("n_a IS NULL").select("links", "counts").mapInArrow(_counted, "pair int, n long")
    found = met.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(pairing.size, np.int64)
    count[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    y = pairing.b_ids()
    highest = np.zeros(len(pairing.b.tokens), np.int64)
    np.maximum.at(highest, y[y >= 0], count[y >= 0])
    best = (y >= 0) & (count > 0) & (count == highest[y])
    scores = spark.sparkContext.broadcast((count, best))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep_groups
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields} | {"n_links": "bigint", "n_best": "bigint", "count_sum": "bigint"}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = scores.value
        for batch in batches:
            n = batch.column("n_groups").to_numpy(zero_copy_only=False).astype(np.int64)
            links = np.frombuffer(b"".join(batch.column("links").to_pylist()), "<i4")
            added = {"n_links": n, "n_best": _sums(best[links], n), "count_sum": _sums(count[links], n)}
            cells = [pa.array(added[c], pa.int64()) if c in added else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cells, names=names)

    rows = aligned.filter("n_a IS NOT NULL").drop("counts")
    return rows.mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in names))

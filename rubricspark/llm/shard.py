"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Shards own many points of a ring; a row belongs to the first point at or after its key's place. A shard takes rows up to
its bound, later ones go on clockwise to the next shard with room. Rows arrive in a fixed order: by turn, by arc, by
number within the cell of (turn, arc), where turns are dealt by hash so that all arcs fill alike. Which rows of a cell a
shard takes is then a range of numbers, and all of it follows from the cells' counts: their number is bounded by the
ring and the turns, whatever the table's size, so the driver walks over counts and sees no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, running_offset

#: Places on the ring, points of each shard, and turns. Cells: at most shards * POINTS * TURNS.
PLACES, POINTS, TURNS = 1 << 16, 64, 64
#: Equal rows above this number are numbered in parts of about this size.
COPIES = 256


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(place, shard), clockwise. A shard's points do not depend on how many others there are; on one place the least shard holds."""
    held: dict[int, int] = {}
    for shard in range(shards):
        for k in range(points):
            place = int.from_bytes(hashlib.sha256(f"{shard}:{k}".encode()).digest()[:8], "big") % PLACES
            held.setdefault(place, shard)
    return sorted(held.items())


def deal_cells(cells: dict[tuple[int, int], int], owners: list[int], bounds: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(turn, arc, first, end, shard, slot): the rows of a cell numbered first to end - 1 go to the shard, from that slot on.

    ``cells`` counts rows by (turn, arc), ``owners`` has the shard of each arc, ``bounds`` how many rows a shard takes.
    """
    load, n = [0] * len(bounds), len(owners)
    after = list(range(1, n)) + [0]  # of each arc the next one, past arcs of shards that have been seen full
    for (turn, arc), rows in sorted(cells.items()):
        first, at = 0, arc
        while first < rows:
            passed = []
            while load[owners[at]] >= bounds[owners[at]]:
                passed.append(at)
                at = after[at]
            for x in passed:
                after[x] = at
            shard = owners[at]
            end = min(rows, first + bounds[shard] - load[shard])
            yield turn, arc, first, end, shard, load[shard]
            load[shard] += end - first
            first = end


def even_bounds(rows: int, shards: int) -> list[int]:
    """Bounds that add up to the rows and differ by one at most: every shard fills."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard_rows(rows: DataFrame, shards: int, key: Column, identity: list[str], slack: float = 0.0, points: int = POINTS) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); every row stays and keeps its columns.

    ``key`` decides a row's place on the ring, ``identity`` names the columns that tell rows apart: rows equal in them may
    swap slots between runs over other partitions, all others keep theirs. With ``slack`` 0 the counts of shards differ
    by one at most; a larger one bounds each shard by (1 + slack) of its even share, rounded up, and moves fewer rows when
    the number of shards changes. Nulls are values like others, a hot key overflows clockwise, and a group of
    equal rows of any size is numbered in parts. An empty table gives an empty one. Columns named shard or slot are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    place, arc, turn, salt, uid, number, n = free_names(rows, "_place", "_arc", "_turn", "_salt", "_uid", "_number", "_n")
    told = [c for c in identity if c in rows.columns]
    points_held = ring(shards, points)
    arcs, at = [], 0
    for p in range(PLACES):
        while at < len(points_held) and points_held[at][0] < p:
            at += 1
        arcs.append((p, at % len(points_held)))
    places = spark.createDataFrame(arcs, f"{place} int, {arc} int")
    hashed = F.pmod(F.xxhash64(key), F.lit(PLACES)).cast("int")
    rows = rows.withColumns({place: hashed, turn: F.pmod(F.xxhash64(F.lit("turn"), *told), F.lit(TURNS)).cast("int"), uid: F.monotonically_increasing_id()})
    rows = materialize(rows.join(F.broadcast(places), place).drop(place))
    copies = rows.groupBy(*told).agg(F.count("*").alias(n)).filter(F.col(n) > COPIES)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in told]
    parts = F.coalesce(F.expr(f"r.{n} div {COPIES} + 1"), F.lit(1))
    rows = rows.alias("l").join(copies.alias("r"), same, "left").select("l.*", F.pmod(F.xxhash64(f"l.{uid}"), parts).alias(salt))
    rows = running_offset(rows.withColumn(n, F.lit(1)), [turn, arc], [*told, salt], n, number)
    counted = {(r[turn], r[arc]): r["count"] for r in rows.groupBy(turn, arc).count().collect()}
    total = sum(counted.values())
    bounds = even_bounds(total, shards) if slack <= 0 else [-int(-(1 + slack) * total // shards)] * shards
    dealt = list(deal_cells(counted, [s for _, s in points_held], bounds))
    first, end, base = free_names(rows, "_first", "_end", "_base")
    runs = spark.createDataFrame(dealt, f"{turn} int, {arc} int, {first} long, {end} long, shard int, {base} long")
    inside = (F.col(number) >= F.col(first)) & (F.col(number) < F.col(end))
    out = rows.join(F.broadcast(runs), [turn, arc]).filter(inside)
    return out.withColumn("slot", F.col(base) + F.col(number) - F.col(first)).drop(turn, arc, first, end, base, number, salt, uid, n)


def sized(docs: DataFrame, text_col: str = "text") -> tuple[Column, Column]:
    """Size (UTF-8 bytes of the text and 8 more; a null has none) and unsigned CRC-32 of the text (a null as an empty one)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return (F.octet_length(raw) + 8).cast("long"), F.crc32(raw)


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.0) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard. The law is ``rows``: counts differ by one at most.

    Places come from the id. Nulls in any column, empty and repeated documents are rows like others; a text is read where it lies and moves only if the caller keeps its column. Columns of the new names are replaced.
    """
    docs = docs.drop("size", "text_crc32", "law", "grown_shard")
    size, crc = sized(docs, text_col)
    rows = docs.withColumns({"size": size, "text_crc32": crc})
    out = shard_rows(rows, shards, F.col(id_col), [id_col, "size", "text_crc32"], slack)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})

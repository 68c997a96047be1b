"""The trie of conversation prefixes, and sums over its subtrees by centroid decomposition of the parent edges.

A node is a distinct sequence of first turns; its place is the conversation with the smallest id that begins with it, and the
depth. Prefixes get fingerprints by sums over ordered partitions, so a conversation of any length is spread over tasks.

``rollup`` adds up weights over subtrees of any forest given by parent edges. Sizes and preorder numbers come from jumps of
doubling length. Then every component is split at its centroid: the total of what hangs below the centroid is added to
the nodes on the path from it to the component's top, and what is left is split in turn. So a path as long as the
table takes as many rounds as a bushy tree, the logarithm of the size. Components above ``LOCAL`` nodes are split by Spark, all
of a round at once; the others are finished within a task, many at a time in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_names, materialize, running_offset

#: Nodes of a component that one task finishes, and preorder numbers of one part of a distributed split.
LOCAL, PART = 4096, 1 << 16
#: Nodes that a task holds at a time, and ids in one piece of a list of ends.
BUFFER, PIECE = 1 << 16, 1 << 16
#: Jumps of length 2 ** MOST_JUMPS mean that the parent edges hold a cycle.
MOST_JUMPS = 60


# --- sums over subtrees -----------------------------------------------------------------------------


def centroid_sums(comp: np.ndarray, pre: np.ndarray, up: np.ndarray, size: np.ndarray, cur: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` (a row for each node) over each node's subtree within its component.

    Nodes are sorted by (comp, pre). pre and size are preorder numbers and subtree sizes of the whole forest, up is the
    parent's number, cur the size of the subtree within the component. All components are split at once, round by round.
    """
    out, cur = np.zeros_like(weights), cur.copy()
    at, label = np.arange(len(pre)), comp
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = label[1:] != label[:-1]
        first, g = np.flatnonzero(new), np.cumsum(new) - 1
        count = np.diff(np.append(first, len(at)))
        c, p = cur[at], pre[at]
        heavy = 2 * c >= count[g]  # a path from the top; its last node is the centroid
        least = np.minimum.reduceat(np.where(heavy, c, count[g] + 1), first)
        x = np.flatnonzero(heavy & (c == least[g]))
        low, high = p[x], p[x] + size[at[x]]
        below = (p >= low[g]) & (p < high[g])
        total = np.add.reduceat(np.where(below[:, None], weights[at], 0), first, axis=0)
        path = np.flatnonzero((p <= low[g]) & (low[g] < p + size[at]))
        out[at[path]] += total[g[path]]
        cur[at[path]] -= c[x][g[path]]
        child = np.cumsum(below & (up[at] == low[g]))
        label = np.where(below, len(first) + child, g)
        keep = np.ones(len(at), bool)
        keep[x] = False
        at, label = at[keep], label[keep]
        order = np.argsort(label, kind="stable")
        at, label = at[order], label[order]
    return out


def _finish(weights: list[str], acc: list[str]):
    """Sums of whole components that arrive sorted by (comp, pre), added to what earlier rounds have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sums(table: pa.Table) -> pa.RecordBatch:
            column = lambda c: table.column(c).to_numpy()
            w = np.stack([column(c) for c in weights], axis=1)
            got = centroid_sums(*(column(c) for c in ("comp", "pre", "up", "size", "cur")), w)
            cells = [table.column("id").combine_chunks(), *(pa.array(column(a) + got[:, k]) for k, a in enumerate(acc))]
            return pa.RecordBatch.from_arrays(cells, names=["id", *acc])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUFFER:
                table = pa.Table.from_batches(held)
                comp = table.column("comp").to_numpy()
                begun = int(np.searchsorted(comp == comp[-1], True))  # the last component may go on
                if begun:
                    yield sums(table.slice(0, begun))
                held = table.slice(begun).to_batches()
        if held:
            yield sums(pa.Table.from_batches(held))

    return run


def _sizes(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, parent, size of its subtree), and for each k the table of (id, its ancestor 2**k above) where there is one."""
    jumps, found = [], None
    now = materialize(edges.filter("parent IS NOT NULL").select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("s")))
    while not now.isEmpty():
        if len(jumps) == MOST_JUMPS:
            raise ValueError("the parent edges hold a cycle")
        jumps.append(now)
        # nodes 2**k below count with what lies less than 2**k below them
        add = materialize(now.groupBy("anc").agg(F.sum("s").alias("more")).withColumnRenamed("anc", "id"))
        found = add if found is None else found.unionByName(add)
        longer = now.alias("u").join(now.alias("v"), F.col("u.anc") == F.col("v.id")).select("u.id", "v.anc", "u.s")
        now = materialize(longer.join(add, "id", "left").select("id", "anc", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")))
    size = F.lit(1).cast("long")
    if found is None:
        return edges.select("id", "parent", size.alias("size")), jumps
    total = found.groupBy("id").agg(F.sum("more").alias("more"))
    return edges.join(total, "id", "left").select("id", "parent", (size + F.coalesce("more", F.lit(0))).alias("size")), jumps


def _preorder(sizes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(id, pre, up, size): preorder numbers from 1, a parent's number (0: the virtual root above all roots), sizes."""
    sizes = materialize(sizes)
    offset = running_offset(sizes, ["parent"], ["id"], "size", "off").select("id", "size", (F.col("off") + 1).alias("off"))
    now = materialize(offset.withColumn("pre", F.col("off")))
    for jump in jumps:
        far = jump.join(now.select(F.col("id").alias("anc"), F.col("pre").alias("add")), "anc").select("id", "add")
        before, now = now, materialize(now.join(far, "id", "left").select("id", "size", "off", (F.col("pre") + F.coalesce("add", F.lit(0))).alias("pre")))
        discard(before)
    return now.select("id", "pre", (F.col("pre") - F.col("off")).alias("up"), "size")


def _split(big: DataFrame, weights: list[str], acc: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: the centroids (finished), and the nodes that are left with their new components.

    A component has more than ``LOCAL`` nodes, so the table of centroids has a row for that many nodes at most.
    """
    best = big.filter("2 * cur >= n").groupBy("comp").agg(F.min(F.struct("cur", "pre", "size")).alias("x"))
    centroid = materialize(best.select("comp", F.col("x.pre").alias("x_pre"), F.col("x.size").alias("x_size"), F.col("x.cur").alias("x_cur")))
    below = (F.col("pre") >= F.col("x_pre")) & (F.col("pre") < F.col("x_pre") + F.col("x_size"))
    at = big.join(F.broadcast(centroid), "comp")
    totals = materialize(at.filter(below).groupBy("comp").agg(*[F.sum(w).alias(f"t_{w}") for w in weights]))
    path = (F.col("pre") <= F.col("x_pre")) & (F.col("x_pre") < F.col("pre") + F.col("size"))
    at = at.join(F.broadcast(totals), "comp").withColumns(
        {a: F.col(a) + F.when(path, F.col(f"t_{w}")).otherwise(0) for w, a in zip(weights, acc, strict=True)} | {"below": below, "cur": F.col("cur") - F.when(path, F.col("x_cur")).otherwise(0)}
    )
    kept = ["id", "pre", "up", "size", "cur", *weights, *acc]
    done = at.filter("pre = x_pre").select("id", *acc)
    upper = at.filter("NOT below").select(*kept, "comp", (F.col("n") - F.col("x_cur")).alias("n"))
    # below the centroid a component begins at each child; in preorder a node belongs to the last child before it
    under = at.filter("below AND pre <> x_pre").withColumn("part", F.expr(f"pre div {PART}"))
    is_child = F.col("up") == F.col("x_pre")
    before = Window.partitionBy("comp", "part").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    under = under.withColumn("child", F.max(F.when(is_child, F.struct("pre", "cur"))).over(before))
    reach = F.expr(f"sequence(part + 1, (pre + size - 1) div {PART})")
    across = at.filter(below & is_child).withColumn("part", F.expr(f"pre div {PART}")).filter(f"part < (pre + size - 1) div {PART}")
    across = across.select("comp", F.struct("pre", "cur").alias("earlier"), F.explode(reach).alias("part"))
    under = under.join(across, ["comp", "part"], "left").withColumn("child", F.coalesce("child", "earlier"))
    lower = under.select(*kept, F.col("child.pre").alias("comp"), F.col("child.cur").alias("n"))
    return done, upper.unionByName(lower)


def rollup(nodes: DataFrame, weights: list[str], id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """(id, weights): each weight summed over the node's subtree, itself included.

    Ids are distinct and not null, a null parent marks a root, every parent is a node; a cycle raises ValueError. Null
    weights count as 0. An empty table gives an empty one.
    """
    acc = [f"a_{k}" for k in range(len(weights))]
    own = [f"w_{k}" for k in range(len(weights))]
    given = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), *[F.coalesce(F.col(w).cast("long"), F.lit(0)).alias(o) for w, o in zip(weights, own, strict=True)])
    given = materialize(given)
    sizes, jumps = _sizes(given.select("id", "parent"))
    numbered = _preorder(sizes, jumps)
    total = given.count()
    # the virtual root is there in numbers only: the first round splits at it where there are several roots
    now = given.drop("parent").join(numbered, "id")
    top = F.when(F.col("up") == 0, F.col("pre"))
    roots = given.filter("parent IS NULL").limit(2).count()
    if roots > 1:
        now = _under_roots(now, top)
    else:
        now = now.withColumns({"comp": F.lit(1).cast("long"), "n": F.lit(total).cast("long")})
    now = materialize(now.withColumns({"cur": F.col("size")} | {a: F.lit(0).cast("long") for a in acc}))
    done, whole = [], []
    while True:
        whole.append(now.filter(F.col("n") <= LOCAL))
        big = now.filter(F.col("n") > LOCAL)
        if big.isEmpty():
            break
        finished, rest = _split(big, own, acc)
        done.append(materialize(finished))
        now = materialize(rest)
    columns = ["id", "comp", "pre", "up", "size", "cur", *own, *acc]
    small = whole[0].select(*columns)
    for w in whole[1:]:
        small = small.unionByName(w.select(*columns))
    schema = ", ".join([f"id {given.schema['id'].dataType.simpleString()}", *(f"{a} long" for a in acc)])
    out = small.repartition("comp").sortWithinPartitions("comp", "pre").mapInArrow(_finish(own, acc), schema)
    for d in done:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), *[F.col(a).alias(w) for a, w in zip(acc, weights, strict=True)])


def _under_roots(now: DataFrame, top: Column) -> DataFrame:
    """Each tree of a forest as a component: in preorder a node belongs to the last root before it."""
    now = now.withColumn("part", F.expr(f"pre div {PART}"))
    before = Window.partitionBy("part").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    root = F.max(F.when(top.isNotNull(), F.struct(F.col("pre").alias("pre"), F.col("size").alias("size")))).over(before)
    across = now.filter(top.isNotNull()).filter(f"part < (pre + size - 1) div {PART}")
    across = across.select(F.struct("pre", "size").alias("earlier"), F.explode(F.expr(f"sequence(part + 1, (pre + size - 1) div {PART})")).alias("part"))
    now = now.withColumn("root", root).join(across, "part", "left").withColumn("root", F.coalesce("root", "earlier"))
    return now.withColumns({"comp": F.col("root.pre"), "n": F.col("root.size")}).drop("root", "earlier", "part")


# --- ordered sums -------------------------------------------------------------------------------------


def ordered_sums(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` and for each of ``sums`` its running total over the rows of the key up to this one, in that order.

    Rows are dealt by ranges of (key, order), so one key may fill many partitions. Rows equal in all of these share a task;
    their order among themselves is open.
    """
    part, *local = free_names(df, "_part", *[f"_sum{k}" for k in range(len(sums))])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).withColumn(part, F.spark_partition_id())
    within = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({s: F.sum(c).over(within) for s, c in zip(local, sums.values(), strict=True)} | {"_whole": F.count("*").over(Window.partitionBy(key, part))})
    counted = F.row_number().over(Window.partitionBy(key, part).orderBy(*order)) == F.col("_whole")
    dealt = materialize(dealt.select(*keep, part, *local, counted.alias("_last")))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.filter("_last").select(key, part, *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_base") for s in local])
    out = dealt.join(bases, [key, part])
    return out.select(*keep, *[(F.col(s) + F.col(f"{s}_base")).alias(name) for s, name in zip(local, sums, strict=True)])


# --- the trie -----------------------------------------------------------------------------------------


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, digest of role and text, bytes of the text), in the order of turns.

    A null turn comes first, ties go by role and text, a null role or text is empty; equal rows are turns of their own. Rows without a
    conversation's id belong to none and go. Texts are read once and leave at the digest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role, text).filter("conv IS NOT NULL")
    told = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"digest": told, "bytes": F.octet_length("text").cast("long")})
    return ordered_sums(rows, "conv", ["turn", "role", "text"], {"pos": F.lit(1)}, ["conv", "digest", "bytes"])


def with_shared_start(placed: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``shared`` turns of conversation ``base`` and go on with their own after as many.

    ``base`` and ``shared`` (at most ``most``) are expressions over ``conv``. Returns rebuilt turns (conv, d from 1, digest, bytes, is_end)
    and conversations (conv, length); a shorter base gives what it has, an absent one nothing.
    """
    own = placed.groupBy("conv").agg(F.max("pos").alias("own")).withColumns({"base": base, "h": shared.cast("long")})
    own = materialize(own)
    lengths = own.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    taken = F.least(F.col("h"), F.coalesce("there", F.lit(0)))
    convs = own.join(lengths, "base", "left").select("conv", "base", "h", taken.alias("m"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs)
    after = placed.join(convs, "conv").filter("pos > h").select("conv", (F.col("m") + F.col("pos") - F.col("h")).alias("d"), "digest", "bytes", "length")
    first = placed.filter(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    start = convs.join(first, "base").filter("pos <= m").select("conv", F.col("pos").alias("d"), "digest", "bytes", "length")
    turns = start.unionByName(after).withColumn("is_end", F.col("d") == F.col("length")).drop("length")
    return turns, convs.select("conv", "length")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys, as (key, first id, decimal ids joined by commas), ``PIECE`` ids at most."""
    key, ids = None, []

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids)).encode()])], names=["key", "first", "piece"])

    for batch in batches:
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if k != key or len(ids) == PIECE:
                if ids:
                    yield piece()
                key, ids = k, []
            ids.append(conv)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which arrive in order; one piece is held at a time."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece"), strict=True):
            if k != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["key", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv, d (from 1, gapless), digest, bytes, is_end; ``convs``: conv, length, those without turns too. The root (depth 0)
    is there if any conversation is. Nodes are told apart by 128-bit sums over their prefix; each is then held to one
    last turn and one parent, which by induction makes it one prefix, or RuntimeError is raised.
    """
    word = lambda seed: F.xxhash64(F.lit(seed), "d", "digest").cast("decimal(20,0)")
    turns = turns.withColumns({"x1": word("left"), "x2": word("right")})
    rows = ordered_sums(turns, "conv", ["d"], {"f1": F.col("x1"), "f2": F.col("x2")}, ["conv", "d", "digest", "bytes", "is_end", "x1", "x2"])
    key = lambda depth, one, two: F.concat_ws(":", depth.cast("string"), one.cast("string"), two.cast("string"))
    above = F.when(F.col("d") > 1, key(F.col("d") - 1, F.col("f1") - F.col("x1"), F.col("f2") - F.col("x2")))
    rows = materialize(rows.select("conv", "d", "digest", "bytes", "is_end", key(F.col("d"), F.col("f1"), F.col("f2")).alias("key"), above.alias("above")))

    grouped = rows.groupBy("key").agg(
        F.min("conv").alias("conv"), F.max("d").alias("d"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.max("above").alias("above"),
        (F.max("digest").eqNullSafe(F.min("digest")) & F.max("above").eqNullSafe(F.min("above")) & (F.max("d") == F.min("d"))).alias("one"),
    )
    nodes = materialize(grouped)
    if not nodes.filter("NOT one").isEmpty():
        raise RuntimeError("two prefixes have one fingerprint")
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).first()
    spark = turns.sparkSession
    root = spark.createDataFrame([("", top["conv"], 0, top["n"], 0, None)] if top["n"] else [], "key string, conv long, d long, n long, bytes long, above string")
    parents = nodes.select(F.col("key").alias("above"), F.col("conv").alias("parent_conv"))
    deep = nodes.filter("above IS NOT NULL").join(parents, "above").select("key", "conv", "d", "n", "bytes", "parent_conv")
    flat = nodes.filter("above IS NULL").select("key", "conv", "d", "n", "bytes", F.lit(top["conv"]).cast("long").alias("parent_conv"))
    every = deep.unionByName(flat).unionByName(root.select("key", "conv", "d", "n", "bytes", F.lit(None).cast("long").alias("parent_conv")))
    name = lambda conv, depth: F.concat_ws(":", depth.cast("string"), conv.cast("string"))
    every = every.withColumns({"id": name(F.col("conv"), F.col("d")), "parent": F.when(F.col("d") > 0, name(F.col("parent_conv"), F.col("d") - 1))})
    every = materialize(every)
    children = every.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id")
    every = every.join(children, "id", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0))})
    every = materialize(every.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n") - 1) * F.col("bytes")}))
    summed = rollup(every.select("id", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])

    ends = rows.filter("is_end").select("key", "conv").unionByName(convs.filter("length = 0").select(F.lit("").alias("key"), "conv"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(n, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_pieces, "key string, first long, piece binary")
    digests = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key string, ends_sha256 string")
    out = every.drop("n_leaves", "saved_tokens").join(summed, "id").join(digests, "key", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt on the first of each five: see ``placed_turns``, ``with_shared_start`` and ``prefix_trie``.

    Conversation c takes its first crc32(c) % 9 turns from conversation c - c % 5. An empty table gives an empty one.
    """
    conv = F.col("conv")
    turns, convs = with_shared_start(placed_turns(conversations), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)
    return prefix_trie(turns, convs)


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)), lambda a, b: list_reduce([xor(a::BIGINT, b::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v::BIGINT >> 1, 3988292384 * (v::BIGINT & 1)))), 4294967295)"

OP11_SQL = f"""WITH placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id)),
turns AS (
  SELECT c.conv_id, p.pos AS d, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + p.pos - c.h, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h LEFT JOIN convs b ON b.conv_id = c.base),
prefixes AS (
  SELECT conv_id, d, string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS prefix, strlen(text) AS bytes FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT d, prefix, min(conv_id) AS node, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY d, prefix),
members AS (SELECT p.conv_id, p.d, n.node, n.n_convs, n.bytes, p.d = max(p.d) OVER (PARTITION BY p.conv_id) AS ends FROM prefixes p JOIN nodes n ON p.d = n.d AND p.prefix = n.prefix),
links AS (SELECT DISTINCT u.node, u.d, v.node AS parent FROM members u JOIN members v ON u.conv_id = v.conv_id AND v.d = u.d - 1),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM links GROUP BY ALL),
whole AS (SELECT n.node, n.d, n.n_convs, coalesce(c.n_children, 0) AS n_children, (n.n_convs - 1) * n.bytes AS saved FROM nodes n LEFT JOIN children c ON n.node = c.node AND n.d = c.d),
under AS (SELECT DISTINCT v.node, v.d, u.node AS low, u.d AS low_d FROM members v JOIN members u ON u.conv_id = v.conv_id AND u.d >= v.d),
sums AS (SELECT x.node, x.d, sum((w.n_children = 0)::INT) AS n_leaves, sum(w.saved) AS saved_tokens FROM under x JOIN whole w ON w.node = x.low AND w.d = x.low_d GROUP BY ALL),
ended AS (SELECT node, d, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM members WHERE ends GROUP BY ALL)
SELECT w.node AS conv_id, w.d::BIGINT AS depth, l.parent AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM whole w JOIN sums s ON w.node = s.node AND w.d = s.d LEFT JOIN links l ON w.node = l.node AND w.d = l.d LEFT JOIN ended e ON w.node = e.node AND w.d = e.d"""

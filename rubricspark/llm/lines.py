"""Line dedup: removal of boilerplate lines that spread over many sites.

How many sites hold a line is estimated with a HyperLogLog sketch per line hash; sketches merge by aggregation. Only
lines whose estimate lies near the threshold are counted exactly. Of a line found at too many sites the first
occurrence stays (smallest doc_id, then place in the text), all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize

#: Sites from which on a line is boilerplate; half-width of the band that is counted exactly, as a share of it.
MIN_SITES, BAND = 8, 0.25
#: log2 of the sketch's buckets: a standard error of 1.6 %, an eighth of the band at most.
SKETCH_BITS = 12
BLANK = " \t\n\x0b\f\r"


def _line_key(line: Column) -> list[Column]:
    """128 bits of the trimmed line."""
    bare = F.trim(line, F.lit(BLANK))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("line"), bare).alias("h2")]


def line_table(docs: DataFrame, site_col: str) -> DataFrame:
    """One row for each line that is not blank: doc_id, digest (of the text), site, pos, h1, h2. A null site is a site."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col)), F.lit("")).alias("site")
    cut = docs.select("doc_id", F.xxhash64("text").alias("digest"), site, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cut = cut.filter(F.trim("line", F.lit(BLANK)) != "")
    return cut.select("doc_id", "digest", "site", "pos", *_line_key(F.col("line")))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines held by ``min_sites`` sites or more: h1, h2, and their first place (doc_id, pos)."""
    by = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )
    by = materialize(by.filter(F.col("sites") >= min_sites * (1 - BAND)))
    near = by.filter(F.col("sites") <= min_sites * (1 + BAND))
    pairs = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    sure = by.filter(F.col("sites") > min_sites * (1 + BAND)).select("h1", "h2", "first")
    return sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines, plus n_lines and n_removed (both long; replaced if they exist).

    Every document stays, with the lines that are left joined as they were; one whose lines all go has an empty
    text. Nulls: a null text stays null with 0 lines, a null site is a site of its own, a null doc_id comes first in the
    order of places. Blank lines are never removed and an empty text stays empty. Long texts: the cost is linear in the
    lines of a text. Ties and repeats: the first place is the least (doc_id, place); equal rows are treated alike. An
    empty table gives an empty one. Other columns are kept under any name; ``n_chars``, if there, follows the text.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    digest, gone = free_names(docs, "_digest", "_gone")
    lines = materialize(line_table(docs, site_col))
    spread = materialize(spread_lines(lines, min_sites))
    hits = lines.join(spread, ["h1", "h2"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    lost = hits.filter(~stays).groupBy("doc_id", "digest").agg(F.collect_set("pos").alias(gone)).alias("g")
    keyed = docs.select(*names).withColumn(digest, F.xxhash64("text")).alias("d")
    both = keyed.join(lost, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{digest}") == F.col("g.digest")), "left")
    cut, none = F.split("d.text", "\n"), F.col(f"g.{gone}").isNull()
    # the places that stay by a hash set, then each line by its place; the outer lambda holds the cut text
    places = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(f"g.{gone}"))
    left = F.get(F.transform(F.array(cut), lambda own: F.array_join(F.transform(places, lambda i: F.get(own, i)), "\n")), F.lit(0))
    out = {c: F.col(f"d.{c}") for c in names} | {"text": F.when(none, F.col("d.text")).otherwise(left)}
    if "n_chars" in out:
        out["n_chars"] = F.when(none, F.col("d.n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    n_lines = F.coalesce(F.size(F.filter(cut, lambda x: F.trim(x, F.lit(BLANK)) != "")), F.lit(0))
    n_lines = F.when(F.col("d.text").isNull(), F.lit(0)).otherwise(n_lines)
    removed = F.when(none, F.lit(0)).otherwise(F.size(F.col(f"g.{gone}")))
    return both.select(*[c.alias(n) for n, c in out.items()], n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


#: What dedup_lines gives for ``documents``, for DuckDB.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM {{documents}}),
cut AS (SELECT rid, doc_id, text, source, string_split(text, chr(10)) AS parts FROM docs WHERE text IS NOT NULL),
lines AS (
  SELECT rid, doc_id, text, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut
), keyed AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM lines
), spread AS (
  SELECT bare, arg_min(doc_id, struct_pack(doc_id, pos)) AS first_doc, min(struct_pack(doc_id, pos)).pos AS first_pos
  FROM keyed WHERE bare <> '' GROUP BY bare
  HAVING count(DISTINCT coalesce('=' || source, '')) >= {MIN_SITES}
), judged AS (
  SELECT k.rid, k.line, k.pos, k.bare <> '' AS solid,
         s.bare IS NOT NULL AND NOT (k.doc_id = s.first_doc AND k.pos = s.first_pos) AS gone
  FROM keyed k LEFT JOIN spread s ON k.bare = s.bare AND k.bare <> ''
), done AS (
  SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE solid) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM judged GROUP BY rid
)
"""
OP1_SQL = SQL.format(documents="documents") + """
SELECT d.doc_id, x.text, coalesce(x.n_lines, 0)::BIGINT AS n_lines, coalesce(x.n_removed, 0)::BIGINT AS n_removed
FROM docs d LEFT JOIN done x ON d.rid = x.rid
"""

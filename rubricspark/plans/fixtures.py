"""Policy-shaped tables derived from the test tables by plain arithmetic, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import KINDS, PARAMS

# Values that reach every branch of each scorer, and a step for each parameter.
VALUES = {
    "age": ["NA", "", "FDA labelled age", "FDA labeled age", "adults", "6 years", "12", " 18 years ", "21+"],
    "steps": ["NA", "", "0", "1", "2 steps", "3", "4", "none"],
    "duration": ["NA", "Unspecified", "lifetime", "2", "3", "6 months", "12", "24"],
    "yesno": ["Yes", "y", "No", "N", "NA", "N/A", ""],
    "text": ["NA", "", "N/A", "None", "Trial of two generics"],
}
STEPS = [11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", F.format_string("policy_%d.pdf", "doc_id").alias("filename"), F.col("text").alias("markdown"))


def param_rows(spark: SparkSession, sf_dir: str, file: Column | None = None) -> DataFrame:
    """Parameter rows of every part, forty to a file, or in files numbered by ``file``."""
    cells = []
    for p, k in zip(PARAMS, STEPS, strict=True):
        values = VALUES[KINDS[p]]
        at = (F.col("p_partkey") + 1) * k % 1009 % len(values)
        cells.append(F.get(F.array(*map(F.lit, values)), at.cast("int")).alias(p))
    name = F.format_string("policy_%d.pdf", F.floor(F.col("p_partkey") / 40) if file is None else file)
    return table(spark, sf_dir, "part").select(name.alias("filename"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pos"), *cells)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks of pages of 40; every fifth document gets a references line in its middle."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    t = t.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "line"))
    cut = (F.col("doc_id") % 5 == 0) & (F.col("line_no") == F.floor(F.col("n") / 2))
    row = F.col("line_no") % 40
    return t.select(
        "doc_id",
        F.floor(F.col("line_no") / 40).cast("int").alias("page_no"),
        row.alias("block_no"),
        F.lit(0.0).alias("x0"),
        (row * 792.0 / 40).alias("y0"),
        F.lit(612.0).alias("x1"),
        (row * 792.0 / 40 + 792.0 / 40).alias("y1"),
        F.lit(612.0).alias("page_w"),
        F.lit(792.0).alias("page_h"),
        F.when(cut, "References").otherwise(F.col("line")).alias("text"),
    )


BLOCKS_SQL = """lines AS (
  SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), blocks AS (
  SELECT doc_id, (line_no // 40)::INT AS page_no, (line_no % 40)::INT AS block_no, (line_no % 40) * 792.0 / 40 AS y0,
         (line_no % 40) * 792.0 / 40 + 792.0 / 40 AS y1, 792.0 AS page_h,
         CASE WHEN doc_id % 5 = 0 AND line_no = n // 2 THEN 'References' ELSE line END AS text FROM lines
)"""


def dressed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a link, and some with credentials, at their end."""
    tail = F.concat(
        F.lit("\nsee [more](http://h.example/"), F.col("doc_id"), F.lit(') and <a href="x">this</a>'),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\nLogin: user"), F.col("doc_id"))).otherwise(""),
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("\nPassword = p"), F.col("doc_id"))).otherwise(""),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("markdown"))


DRESSED_SQL = """dressed AS (
  SELECT doc_id, text || chr(10) || 'see [more](http://h.example/' || doc_id || ') and <a href="x">this</a>'
    || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'Login: user' || doc_id ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'Password = p' || doc_id ELSE '' END AS markdown FROM documents
)"""


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    side = F.col("o_totalprice") % 700
    zero = F.col("o_orderkey") % 200 == 3
    return t.select(
        (F.col("o_orderkey") % 200).alias("doc_id"),
        (F.col("o_orderkey") % 7).cast("int").alias("page_no"),
        F.col("o_orderkey").alias("table_no"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), side.alias("x1"), (side / 10).alias("y1"),
        F.when(zero, 0.0).otherwise(612.0).alias("page_w"), F.lit(792.0).alias("page_h"),
    )


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as table rows, forty to a document; a header every 20 rows (none in some documents), an empty and a short row now and then."""
    key = F.col("p_partkey")
    doc = F.floor(key / 40)
    cells = (
        F.when((key % 20 == 1) & (doc % 11 != 3), F.array(F.lit(" Group"), F.lit("Required  Medical\nInformation"), F.lit("Quantity")))
        .when(key % 23 == 0, F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("")))
        .when(key % 29 == 0, F.array("p_name"))
        .otherwise(F.array("p_name", "p_type", F.col("p_size").cast("string")))
    )
    return table(spark, sf_dir, "part").select(
        doc.alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0).alias("table_no"), key.alias("row_no"), cells.alias("cells")
    )


CELLS_SQL = r"""cells AS (
  SELECT p_partkey // 40 AS doc_id, p_partkey AS row_no, CASE
    WHEN p_partkey % 20 = 1 AND p_partkey // 40 % 11 <> 3 THEN [' Group', 'Required  Medical' || chr(10) || 'Information', 'Quantity']
    WHEN p_partkey % 23 = 0 THEN [NULL, ' ', ''] WHEN p_partkey % 29 = 0 THEN [p_name]
    ELSE [p_name, p_type, p_size::VARCHAR] END AS raw FROM part
), clean AS (
  SELECT doc_id, row_no, list_transform(raw, lambda x: trim(regexp_replace(coalesce(x, ''), '\s+', ' ', 'g'))) AS cells FROM cells
)"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", "filename", F.posexplode(F.split("markdown", "\n")).alias("line_no", "text"))
    return t.filter(F.trim("text") != "")


LINES_SQL = """raw_lines AS (
  SELECT doc_id, 'policy_' || doc_id || '.pdf' AS filename, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), line_chunks AS (
  SELECT doc_id, filename, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS chunk_seq
  FROM raw_lines WHERE trim(text) <> ''
), chunks AS (SELECT *, printf('policy_%d_%04d', doc_id, chunk_seq) AS chunk_id FROM line_chunks)"""


def order_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text for each customer: headings, prose, and tables of their orders, the last row unterminated."""
    row = F.concat(F.lit("| "), F.col("o_orderkey"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" | "), F.col("o_totalprice").cast("string"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "\n")
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("rows"))
    head = F.concat(F.lit("# Customer "), F.col("o_custkey"), F.lit("\n\nAll orders. Prices in dollars.\n## Orders\n| Key | Priority | Price |\n|---|---|---|\n"))
    tail = F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("\n### Notes\nNothing else is known.\n"))
    return t.select(F.col("o_custkey").alias("doc_id"), F.format_string("customer_%d.pdf", "o_custkey").alias("filename"), F.concat(head, "rows", tail).alias("markdown"))


#: Documents of one scope of the search tables: scopes grow in number with the table, not in size.
SCOPE = 250


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk of its scope; the vectors are dealt out in turn, since there are fewer of them."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    d = d.crossJoin(F.broadcast(e.agg(F.count("*").alias("m"))))  # one row
    t = d.join(e, F.col("doc_id") % F.col("m") == F.col("vec_id"))
    scope = F.floor(F.col("doc_id") / SCOPE)
    return t.select(
        scope.alias("doc_id"), F.col("doc_id").alias("chunk_seq"),
        F.format_string("policy_%d_%04d", scope, F.col("doc_id")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def scope_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of ``vector_chunks`` without place and vector, those of documents that have no vector too."""
    scope = F.floor(F.col("doc_id") / SCOPE)
    t = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    return t.select(scope.alias("doc_id"), F.format_string("policy_%d_%04d", scope, F.col("doc_id")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def scope_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of ``vector_chunks`` without texts: vectors are dealt out to ids."""
    d, e = table(spark, sf_dir, "documents").select("doc_id").distinct(), table(spark, sf_dir, "embeddings")
    d = d.crossJoin(F.broadcast(e.agg(F.count("*").alias("m"))))  # one row
    scope = F.floor(F.col("doc_id") / SCOPE)
    t = d.join(e, F.col("doc_id") % F.col("m") == F.col("vec_id"))
    return t.select(scope.alias("doc_id"), F.format_string("policy_%d_%04d", scope, F.col("doc_id")).alias("chunk_id"), F.col("doc_id").alias("chunk_seq"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk, without vectors; a scope is 1,000 ids, so scopes grow in number and not in size."""
    scope = F.floor(F.col("doc_id") / 1000)
    t = table(spark, sf_dir, "documents")
    return t.select(scope.alias("doc_id"), F.col("doc_id").alias("chunk_seq"), F.format_string("policy_%d_%04d", scope, F.col("doc_id")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


SEARCH_SQL = rf"""tv AS (
  SELECT d.doc_id // {SCOPE} AS doc_id, d.doc_id AS chunk_seq, printf('policy_%d_%04d', d.doc_id // {SCOPE}, d.doc_id) AS chunk_id,
         coalesce(d.text, '') AS text, e.embedding::DOUBLE[] AS embedding FROM documents d JOIN embeddings e ON d.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id
), q AS (
  SELECT b.item_id AS query_id, b.text AS query, e.embedding::DOUBLE[] AS embedding FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id
), words AS (SELECT doc_id, chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM tv),
tok AS (SELECT doc_id, chunk_id, unnest(w) AS term FROM words),
post AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
sizes AS (SELECT doc_id, chunk_id, len(w) AS dl FROM words),
corpus AS (SELECT doc_id, count(*) AS n, avg(dl) AS avgdl FROM sizes GROUP BY ALL),
dfs AS (SELECT doc_id, term, count(*) AS df FROM post GROUP BY ALL),
raws AS (SELECT d.doc_id, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs d JOIN corpus c ON d.doc_id = c.doc_id),
means AS (SELECT doc_id, avg(raw) AS m FROM raws GROUP BY ALL),
idfs AS (SELECT r.doc_id, term, df, n, avgdl, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raws r JOIN means m ON r.doc_id = m.doc_id),
postings AS (SELECT p.doc_id, p.chunk_id, p.term, tf, dl, df, n, avgdl, idf FROM post p JOIN idfs i ON p.doc_id = i.doc_id AND p.term = i.term
  JOIN sizes s ON p.chunk_id = s.chunk_id),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (
  SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) AS term FROM q) GROUP BY ALL),
hit AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM postings p JOIN qt ON p.term = qt.term GROUP BY ALL),
scores AS (SELECT q.query_id, tv.doc_id, tv.chunk_id, tv.chunk_seq, round(coalesce(s, 0), 9) AS score
  FROM tv CROSS JOIN q LEFT JOIN hit h ON h.query_id = q.query_id AND h.chunk_id = tv.chunk_id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_seq DESC) AS rank FROM scores QUALIFY rank <= 30),
cosines AS (SELECT q.query_id, tv.doc_id, tv.chunk_id, tv.chunk_seq, round(list_cosine_similarity(tv.embedding, q.embedding), 9) AS score FROM tv CROSS JOIN q),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_seq) AS rank FROM cosines QUALIFY rank <= 30),
merged AS (SELECT coalesce(s.query_id, d.query_id) AS query_id, coalesce(s.doc_id, d.doc_id) AS doc_id, coalesce(s.chunk_id, d.chunk_id) AS chunk_id,
  s.rank AS sr, d.rank AS dr, round(coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + d.rank), 0), 9) AS rrf_score
  FROM sparse s FULL JOIN dense d ON s.query_id = d.query_id AND s.chunk_id = d.chunk_id),
fused AS (SELECT query_id, doc_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id, doc_id
  ORDER BY rrf_score DESC, sr NULLS LAST, dr NULLS LAST) AS rank FROM merged QUALIFY rank <= 30),
asked AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) AS w FROM q),
lexical AS (SELECT f.query_id, f.doc_id, f.chunk_id, f.rrf_score, f.rank AS before, tv.text,
  round(len(list_intersect(a.w, w.w)) / greatest(1, len(a.w)), 9) AS rerank_score
  FROM fused f JOIN tv ON tv.chunk_id = f.chunk_id JOIN words w ON w.chunk_id = f.chunk_id JOIN asked a ON a.query_id = f.query_id),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rerank_score DESC, before) AS rank FROM lexical QUALIFY rank <= 10)"""


def brand_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, response: an answer with prose around it for each scope of documents; those divisible by 4 are gated out."""
    key = F.col("p_partkey")
    status = F.when(key % 3 == 0, ', "preferred_status": "Preferred"').when(key % 3 == 1, ', "preferred_status": "Non-preferred"').otherwise("")
    one = F.concat(F.lit('{"brand": "'), F.col("p_brand"), F.lit(" ("), F.col("p_type"), F.lit(')"'), status, F.lit("}"))
    scopes = table(spark, sf_dir, "documents").agg((F.floor(F.max("doc_id") / SCOPE) + 1).alias("scopes"))
    rows = table(spark, sf_dir, "part").crossJoin(F.broadcast(scopes)).groupBy((key % F.col("scopes")).alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), one.alias("t")))), lambda x: x["t"]), ", ").alias("list")
    )
    gate = F.when(F.col("doc_id") % 4 == 0, "No").otherwise("Yes")
    return rows.select("doc_id", F.concat(F.lit('Here it is: {"policy_has_pso": "'), gate, F.lit('", "brands_relevant_to_pso": ['), "list", F.lit("]} Done.")).alias("response"))


BRANDS_SQL = f"""keyed AS (SELECT *, p_partkey % (SELECT max(doc_id) // {SCOPE} + 1 FROM documents) AS doc_id FROM part),
mentions AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey) - 1)::INT AS pos, upper(p_brand) AS brand,
         CASE p_partkey % 3 WHEN 0 THEN 'Preferred' WHEN 1 THEN 'Non-preferred' ELSE 'Unspecified' END AS preferred_status FROM keyed
), brands AS (SELECT * FROM mentions WHERE doc_id % 4 <> 0)"""


def bundles(spark: SparkSession, sf_dir: str, kind: Column) -> DataFrame:
    """filename, markdown: a file for every hundred documents, their texts in a row; ``kind`` gives the ending for each ``bundle``."""
    t = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("bundle"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return t.groupBy("bundle").agg(F.array_join(texts, "\n").alias("markdown")).select(F.concat(F.lit("policy_"), "bundle", F.lit("."), kind).alias("filename"), "markdown")


BUNDLES_SQL = "bundles AS (SELECT doc_id // 100 AS bundle, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, coalesce(text, '')) AS markdown FROM documents GROUP BY ALL)"


def answers_from_prompts(prompts: DataFrame) -> DataFrame:
    """prompt_key, response: what a stand-in model says, by the prompt's text and nothing else.

    A brand prompt gets one to three brands (every fifth is no policy of the kind), a parameter prompt a value for each parameter.
    """
    h = F.crc32(F.col("content").cast("binary"))
    digit = lambda k: (F.pmod(F.floor(h / k), F.lit(5)) + 1).cast("int")
    brand = lambda k: F.format_string('{"brand": "Brand#%d%d (%d)"}', digit(k), digit(5 * k), digit(7 * k))
    named = F.concat_ws(", ", F.slice(F.array(brand(1), brand(11), brand(131)), F.lit(1), (h % 3 + 1).cast("int")))
    gate = F.when(h % 5 == 0, "No").otherwise("Yes")
    brands = F.concat(F.lit('Found {"policy_has_pso": "'), gate, F.lit('", "brands_relevant_to_pso": ['), named, F.lit("]}"))
    cells = []
    for p, k in zip(PARAMS, STEPS, strict=True):
        values = VALUES[KINDS[p]]
        cells.append(F.concat(F.lit(f', "{p}": "'), F.get(F.array(*map(F.lit, values)), (F.floor(h / k) % len(values)).cast("int")), F.lit('"')))
    own = F.regexp_extract("content", r"(Brand#\d+|BRAND#\d+)", 1)
    values = F.concat(F.lit('{"brand": "'), own, F.lit('"'), *cells, F.lit("}"))
    return prompts.select("prompt_key", F.when(F.col("model") == "brands", brands).otherwise(values).alias("response"))


def policy_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, answer_text: an answer for every document, with one to five mentions by arithmetic; documents divisible by 4 are gated out."""
    part = table(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey")).first()[0] or 1
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 5).cast("int"))).alias("j"))
    d = d.withColumn("p_partkey", (F.col("doc_id") * 7 + F.col("j") * 11) % last + 1)
    status = F.when(F.col("p_partkey") % 3 == 0, ', "preferred_status": "Preferred"').when(F.col("p_partkey") % 3 == 1, ', "preferred_status": "Non-preferred"').otherwise("")
    one = F.concat(F.lit('{"brand": "'), F.col("p_brand"), F.lit(" ("), F.col("p_type"), F.lit(')"'), status, F.lit("}"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", one.alias("t")))), lambda x: x["t"]), ", ")
    rows = d.join(part.select("p_partkey", "p_brand", "p_type"), "p_partkey").groupBy("doc_id").agg(named.alias("list"))
    gate = F.when(F.col("doc_id") % 4 == 0, "No").otherwise("Yes")
    return rows.select("doc_id", F.concat(F.lit('Here it is: {"policy_has_pso": "'), gate, F.lit('", "brands_relevant_to_pso": ['), "list", F.lit("]} Done.")).alias("answer_text"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, "8b").otherwise("70b").alias("model"), F.col("text").alias("content"), F.lit(1024).alias("max_tokens"))


PROMPTS_SQL = "prompts AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '8b' ELSE '70b' END AS model, text AS content, 1024 AS max_tokens FROM conversations)"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), (F.col("event_id") % 500).alias("tokens"))


USAGE_SQL = "usage AS (SELECT event_id, ts, event_type AS model, event_id % 500 AS tokens FROM events)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def params_sql(file: str = "p_partkey // 40") -> str:
    cells = []
    for p, k in zip(PARAMS, STEPS, strict=True):
        values = VALUES[KINDS[p]]
        cells.append(f"([{', '.join(map(quoted, values))}])[((p_partkey + 1) * {k} % 1009 % {len(values)} + 1)::INT] AS \"{p}\"")
    return f"params AS (SELECT 'policy_' || ({file}) || '.pdf' AS filename, p_brand AS brand, p_partkey AS pos, " + ", ".join(cells) + " FROM part)"

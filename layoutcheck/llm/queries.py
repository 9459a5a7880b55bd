"""One query for each operator over its whole table, and the same as DuckDB SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS MATERIALIZED (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM component LEFT JOIN size USING (doc_id)
"""


@_query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm import langid

    docs = _table(spark, sf_dir, "documents")
    net = langid.fit(docs)
    done = langid.identify(docs.select("doc_id", "text"), net)
    return done.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@_query
def op5_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.mips import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"))


ORACLES["op5_inner_product_search"] = r"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""


@_query
def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"))


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.substring import remove_repeats

    done = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op7_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT win.doc_id, win.i + t.j AS p
  FROM win JOIN firsts USING (k), range(13) t(j) WHERE firsts.m < win.doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS s
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@_query
def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.html import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


@_query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.nearvec import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLES["op9_embedding_near_dedup"] = r"""
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)
"""


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layoutcheck.llm.chat import format_chats, read_loss, read_turns

    added = spark.sql("SELECT -7L AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    made = format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    turns, loss, line = read_turns(F.col("formatted")), read_loss(F.col("segments")), F.lit("\n")
    return made.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], line, t["text"], line)), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLES["op10_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS prev,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS nth,
             count(*) OVER (PARTITION BY conv_id) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(9 + 8 + 7 + length(replace(replace(r, '\', '\\'), '<|', '<\|')) + length(replace(replace(t, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars,
  bool_and((prev IS NULL AND nth = 1 AND r IN ('system', 'user')) OR coalesce((prev, r) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')), false))
    AND NOT bool_or(nth = n AND r = 'system') AS valid
FROM p GROUP BY conv_id
"""

"""Registered queries over the test tables, each beside its SQL.

The agent platform's tables are stood in for: conversations are messages
(conv_id the session, turn the time), embeddings are vectors of stores
(label), events are tool invocations (user_id the tool, purchase a completion,
error a failure, value the duration) and rate-limited requests, nations,
customers and orders are agents, workflows and executions, and labelled
documents are evaluations (quality expected, 1000 characters predicted).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text, vectors
from ..operators import paging, rate_limits, relations, retention, search_index, stats, vector_index, vector_search, workflows
from ..sources.tables import scratch
from ..streaming import limiters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- predicates, paging ------------------------------------------------------

_ORDER = {"o_totalprice": "desc"}


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def list_page(spark, d):
    """The second page of executions."""
    return paging.page(_t(spark, d, "orders"), paging.Page(2, 20), None, _ORDER, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def list_page_status(spark, d):
    """A page of one status."""
    return paging.page(_t(spark, d, "orders"), paging.Page(1, 50), {"o_orderstatus": "F"}, _ORDER, "o_orderkey").select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(spark, d):
    """membership."""
    return _t(spark, d, "orders").where(P.where({"o_orderstatus": ["F", "P"]})).select("o_orderkey", "o_orderstatus")


@_query("SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'")
def filter_ne(spark, d):
    """history without system messages."""
    return _t(spark, d, "conversations").where(P.where({"role": {"ne": "system"}})).select("conv_id", "turn", "role", "text")


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def filter_date_range(spark, d):
    """both ends are included."""
    bounds = {op: F.lit(x).cast("timestamp_ntz") for op, x in (("gte", "1995-01-01"), ("lte", "1995-12-31"))}
    return _t(spark, d, "orders").where(P.where({"o_orderdate": bounds})).select("o_orderkey", "o_orderdate")


@_query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 'brass')")
def search_two_columns(spark, d):
    """Case-insensitive, over one of several columns."""
    return _t(spark, d, "part").where(P.search("RE", "p_name") | P.search("Brass", "p_type")).select("p_partkey", "p_name", "p_type")


@_query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'standard') OR contains(lower(p_type), 'brass')")
def indexed_search(spark, d):
    """By trigrams, over one of several columns."""
    path = scratch(spark, "search-index")
    search_index.build(_t(spark, d, "part"), path, ["p_name", "p_type"], id_col="p_partkey", blocks=16)
    names, types = (search_index.find(spark, path, text, c, indexed=["p_name", "p_type"]) for text, c in (("Standard", "p_name"), ("BRASS", "p_type")))
    return names.unionByName(types).dropDuplicates(["p_partkey"]).select("p_partkey", "p_name", "p_type")


@_query("SELECT doc_id, md5(text) AS content FROM documents WHERE contains(lower(text), 'pathetic')")
def indexed_document_search(spark, d):
    """Whole texts by trigrams."""
    path = scratch(spark, "search-index")
    search_index.build(_t(spark, d, "documents").select("doc_id", "text"), path, ["text"], id_col="doc_id", blocks=64)
    return search_index.find(spark, path, "Pathetic", "text", indexed=["text"]).select("doc_id", F.md5("text").alias("content"))


@_query("SELECT turn, text FROM conversations WHERE conv_id = 3 AND contains(lower(text), 'th') ORDER BY turn")
def search_messages(spark, d):
    """within one session, in chat order."""
    return _t(spark, d, "conversations").where(P.where({"conv_id": 3, "text": {"contains": "TH"}})).orderBy("turn").select("turn", "text")


@_query("SELECT event_id, props FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def json_path_eq(spark, d):
    """Equality at a JSON path."""
    return _t(spark, d, "events").where(P.json_filter("props", "k", "eq", 7)).select("event_id", "props")


@_query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3) AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 2")
def metadata_filters(spark, d):
    """several metadata operators."""
    return _t(spark, d, "events").where(P.json_filter("props", "k", "in", [1, 2, 3]) & P.json_filter("props", "k", "gte", 2)).select("event_id")


@_query("SELECT event_id FROM events WHERE props IS NOT NULL AND trim(props) <> 'null'")
def not_null_json(spark, d):
    """JSON that is there."""
    return _t(spark, d, "events").where(P.json_present("props")).select("event_id")


@_query("SELECT CAST(2 AS BIGINT) AS page, CAST(20 AS BIGINT) AS size, count(*) AS total, (count(*) + 19) // 20 AS total_pages, 2 < (count(*) + 19) // 20 AS has_next, true AS has_prev FROM orders WHERE o_orderstatus = 'F'")
def page_envelope(spark, d):
    """Totals of a page."""
    return paging.envelope(_t(spark, d, "orders"), paging.Page(2, 20), {"o_orderstatus": "F"})


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 1000")
def deep_page(spark, d):
    """Page 51 of the executions that aren't pending, found by the places of an index."""
    filters, order = {"o_orderstatus": {"ne": "P"}}, {"o_totalprice": "desc"}
    index = paging.page_index(_t(spark, d, "orders"), filters, order, "o_orderkey")
    return paging.deep_page(_t(spark, d, "orders"), index, paging.Page(51, 20), "o_orderkey").select("o_orderkey", "o_totalprice")


@_query("SELECT count(*) > 0 AS exists FROM orders WHERE o_orderkey = 7")
def exists_by_id(spark, d):
    """F29."""
    return paging.exists(_t(spark, d, "orders"), 7, "o_orderkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def get_by_id(spark, d):
    """S6."""
    return paging.by_id(_t(spark, d, "customer"), 42, "c_custkey").select("c_custkey", "c_name")


@_query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 ORDER BY c_custkey LIMIT 1")
def first_by_name(spark, d):
    """The first match of two columns."""
    return paging.first(_t(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3}, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


# --- relations ---------------------------------------------------------------


@_query("SELECT n_nationkey, n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900)")
def agents_with_workflows(spark, d):
    """Semi join."""
    return relations.with_children(_t(spark, d, "nation"), _t(spark, d, "customer").where("c_acctbal > 9900"), "n_nationkey", "c_nationkey").select("n_nationkey", "n_name")


@_query("SELECT c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL")
def orphan_children(spark, d):
    """Anti join."""
    big = _t(spark, d, "orders").where("o_totalprice > 300000")
    return relations.orphans(_t(spark, d, "customer"), big, "c_custkey", "o_custkey").select("c_custkey")


@_query("SELECT c.c_custkey, count(o.o_orderkey) AS n_executions, coalesce(string_agg(CAST(o.o_orderkey AS VARCHAR), ',' ORDER BY o.o_orderkey), '') AS executions FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def workflow_executions_nested(spark, d):
    """Parents with all children."""
    nested = relations.nest(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders"), "c_custkey", "o_custkey", ["o_orderkey"], "executions")
    keys = F.transform("executions", lambda x: x["o_orderkey"].cast("string"))
    return nested.select("c_custkey", F.size("executions").cast("long").alias("n_executions"), F.array_join(keys, ",").alias("executions"))


@_query("SELECT conv_id, turn, rn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5")
def sessions_top5_messages(spark, d):
    """The newest children of each parent."""
    return relations.newest(_t(spark, d, "conversations"), "conv_id", [F.desc("turn")], 5).select("conv_id", "turn", "rn")


@_query("SELECT event_id, ts FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id LIMIT 10")
def recent_topk(spark, d):
    """The most recent rows."""
    return paging.page(_t(spark, d, "events"), paging.Page(1, 10), {"user_id": 5}, {"ts": "desc"}, "event_id").select("event_id", "ts")


@_query("""
WITH running AS (SELECT c_nationkey AS id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 250000 GROUP BY 1),
     active AS (SELECT s_nationkey AS id, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS id, coalesce(r.n, 0) AS running_executions, coalesce(a.n, 0) AS active_sessions, coalesce(r.n, 0) = 0 AND coalesce(a.n, 0) = 0 AS can_delete,
       CASE WHEN r.n > 0 THEN 'Agent has ' || r.n || ' active workflow(s)' WHEN a.n > 0 THEN 'Agent has ' || a.n || ' active conversation(s)' END AS reason
FROM nation LEFT JOIN running r ON r.id = n_nationkey LEFT JOIN active a ON a.id = n_nationkey
""")
def delete_guard(spark, d):
    """Which agents may be deleted, and why not."""
    agents = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    flows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("agent_id"))
    runs = _t(spark, d, "orders").select(F.col("o_custkey").alias("workflow_id"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000), "RUNNING").otherwise("COMPLETED").alias("status"))
    sessions = _t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("agent_id"), F.when(F.col("s_acctbal") > 5000, "ACTIVE").otherwise("INACTIVE").alias("status"))
    return relations.delete_guard(agents, flows, runs, sessions).select("id", "running_executions", "active_sessions", "can_delete", "reason")


@_query("""
SELECT 'agents' AS tbl, count(*) AS n FROM nation WHERE n_nationkey >= 5
UNION ALL SELECT 'workflows', count(*) FROM customer WHERE c_nationkey >= 5
UNION ALL SELECT 'workflow_executions', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 5
""")
def cascade_survivors(spark, d):
    """What stays after deleting agents with all that hangs on them."""
    tables = {
        "agents": _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")),
        "workflows": _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("agent_id")),
        "workflow_executions": _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("workflow_id")),
    }
    left = relations.cascade(tables, "agents", tables["agents"].where("id < 5").select("id"))
    counts = [df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- statistics --------------------------------------------------------------

@_query("""
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS successful, count(*) FILTER (event_type = 'error') AS failed,
       round(coalesce(avg(value), 0), 6) AS avg_duration, round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*), 6) AS success_rate
FROM events GROUP BY user_id
""")
def invocation_stats(spark, d):
    """Totals, success rate and mean duration by tool."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    out = stats.invocation_stats(_t(spark, d, "events").withColumn("status", status), key="user_id", duration="value")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_duration", "success_rate")})


@_query("SELECT label, count(*) AS total_vectors, count(DISTINCT vec_id // 3) AS unique_documents, round(count(*) * 1.0 / count(DISTINCT vec_id // 3), 6) AS avg_chunks_per_document FROM embeddings GROUP BY label")
def store_stats(spark, d):
    """Statistics of the stores."""
    out = stats.store_stats(_t(spark, d, "embeddings").withColumn("document_id", F.expr("vec_id div 3")), store="label")
    return out.select("label", "total_vectors", "unique_documents", F.round("avg_chunks_per_document", 6).alias("avg_chunks_per_document"))


@_query("SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, round(coalesce(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 0), 6) AS mean FROM customer GROUP BY c_nationkey")
def filtered_counts(spark, d):
    """Counts under conditions, a mean that ignores nulls."""
    mean = F.coalesce(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), F.lit(0.0))
    return _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.round(mean, 6).alias("mean"))


@_query("SELECT DISTINCT label FROM embeddings")
def distinct_stores(spark, d):
    """A11."""
    return _t(spark, d, "embeddings").select("label").distinct()


def _evaluations(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return _t(spark, d, "labels").join(docs, "doc_id").select("doc_id", "toxic", "n_chars", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 1000).alias("predicted"))


_EVAL = "WITH e AS (SELECT doc_id, toxic, n_chars, quality = 1 AS expected, n_chars >= 1000 AS predicted FROM labels JOIN documents USING (doc_id))"


@_query(f"{_EVAL} SELECT count(*) AS total, count(*) FILTER (expected = predicted) AS passed, count(*) FILTER (expected <> predicted) AS failed, round(100.0 * count(*) FILTER (expected = predicted) / count(*), 6) AS pass_rate FROM e")
def evaluation_summary(spark, d):
    """A15."""
    out = stats.evaluation_summary(_evaluations(spark, d), F.col("expected") == F.col("predicted"))
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


@_query(f"""{_EVAL}, m AS (SELECT 'accuracy' AS metric, CAST(expected = predicted AS DOUBLE) AS v FROM e UNION ALL SELECT 'kilochars', n_chars / 1000.0 FROM e UNION ALL SELECT 'toxicity', CAST(toxic AS DOUBLE) FROM e)
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(stddev(v), 6) AS stddev FROM m GROUP BY metric""")
def metric_averages(spark, d):
    """Mean and spread by metric."""
    metrics = F.create_map(F.lit("accuracy"), (F.col("expected") == F.col("predicted")).cast("int").cast("double"), F.lit("kilochars"), F.col("n_chars") / 1000.0, F.lit("toxicity"), F.col("toxic").cast("double"))
    out = stats.metric_summary(_evaluations(spark, d), metrics)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@_query(f"""{_EVAL}, c AS (SELECT count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (NOT expected AND predicted) AS fp, count(*) FILTER (expected AND NOT predicted) AS fn, count(*) FILTER (NOT expected AND NOT predicted) AS tn FROM e)
SELECT tp, fp, fn, tn, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) AS accuracy, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_score FROM c""")
def confusion_metrics(spark, d):
    """A20."""
    out = stats.confusion(_evaluations(spark, d), F.col("expected"), F.col("predicted"))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1_score")})


@_query(f"{_EVAL} SELECT CASE WHEN expected THEN 'missed' ELSE 'false alarm' END AS error, count(*) AS n FROM e WHERE expected <> predicted GROUP BY 1")
def error_breakdown(spark, d):
    """A19."""
    wrong = _evaluations(spark, d).where("expected <> predicted")
    return wrong.groupBy(F.when(F.col("expected"), "missed").otherwise("false alarm").alias("error")).agg(F.count("*").alias("n"))


@_query(f"{_EVAL} SELECT doc_id, round((3.0 * CAST(expected = predicted AS INT) + 1.0 * (1 - toxic)) / 4.0, 6) AS score, (3.0 * CAST(expected = predicted AS INT) + 1.0 * (1 - toxic)) / 4.0 >= 0.5 AS passed FROM e")
def weighted_scores(spark, d):
    """Weighted score against a threshold."""
    metrics = F.create_map(F.lit("accuracy"), (F.col("expected") == F.col("predicted")).cast("int").cast("double"), F.lit("safety"), 1.0 - F.col("toxic"))
    score = stats.weighted_score(metrics, {"accuracy": 3.0, "safety": 1.0})
    return _evaluations(spark, d).select("doc_id", F.round(score, 6).alias("score"), (score >= 0.5).alias("passed"))


# --- vectors -----------------------------------------------------------------


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return paging.by_id(_t(spark, d, "embeddings"), vec_id, "vec_id").select("embedding").first()[0]


def _nearest(spark: SparkSession, d: str, **how) -> DataFrame:
    found = vector_search.top_k(_t(spark, d, "embeddings"), _vector(spark, d, 0), id_col="vec_id", vector_col="embedding", **how)
    return found.withColumn("score", F.round("score", 6))


_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS cosine, list_inner_product(embedding::DOUBLE[], q) AS dot, list_distance(embedding::DOUBLE[], q) AS l2 FROM embeddings, q)"


@_query(f"{_Q} SELECT vec_id, round(cosine, 6) AS score FROM s ORDER BY cosine DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    """W16, X2, J10."""
    return _nearest(spark, d)


@_query(f"{_Q} SELECT vec_id, round(cosine, 6) AS score FROM s WHERE cosine > 0.2 ORDER BY cosine DESC, vec_id LIMIT 100")
def vector_threshold(spark, d):
    """a strict threshold."""
    return _nearest(spark, d, k=100, threshold=0.2)


@_query(f"{_Q} SELECT vec_id, round(l2, 6) AS score FROM s ORDER BY l2, vec_id LIMIT 10")
def vector_l2_topk(spark, d):
    """X3."""
    return _nearest(spark, d, metric="euclidean")


@_query(f"{_Q} SELECT vec_id, round(dot, 6) AS score FROM s ORDER BY dot DESC, vec_id LIMIT 10")
def vector_dot_topk(spark, d):
    """X3."""
    return _nearest(spark, d, metric="dot_product")


@_query(f"{_Q} SELECT vec_id, label, round(cosine, 6) AS score FROM s WHERE label = 1 ORDER BY cosine DESC, vec_id LIMIT 10")
def vector_filtered_topk(spark, d):
    """Within one store, with kept columns."""
    return _nearest(spark, d, where=F.col("label") == 1, keep=["label"])


_BATCH_SQL = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, c, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(c, 6) AS score FROM r WHERE rank <= 10
"""


@_query(_BATCH_SQL)
def vector_pruned_topk(spark, d):
    """Many queries with an index that leaves tiles out."""
    v = _t(spark, d, "embeddings")
    index = vector_index.build(v, id_col="vec_id", vector_col="embedding", dim=64)
    found, _ = vector_index.search(index, v.where("vec_id % 20 = 0"), id_col="vec_id", vector_col="embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@_query(_BATCH_SQL)
def vector_batch_topk(spark, d):
    """Many queries at once."""
    v = _t(spark, d, "embeddings")
    found = vector_search.batch_top_k(v, v.where("vec_id % 20 = 0"), id_col="vec_id", vector_col="embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@_query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) = 64 AS fits FROM embeddings")
def vector_norms(spark, d):
    """Norm and dimension check."""
    return _t(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), vectors.has_dimension(F.col("embedding"), 64).alias("fits"))


# --- texts -------------------------------------------------------------------

_CHUNKS = "SELECT doc_id, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) + 1 END)) AS k, text FROM documents WHERE length(text) > 0"


@_query(f"SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, md5(substr(text, k * 800 + 1, 1000)) AS content FROM ({_CHUNKS})")
def chunk_fixed(spark, d):
    """Chunks of 1000 characters, 200 shared."""
    return text.chunk_fixed(_t(spark, d, "documents")).withColumn("content", F.md5("content"))


@_query(f"SELECT doc_id, count(*) AS n_chunks FROM ({_CHUNKS}) GROUP BY doc_id")
def chunk_counts(spark, d):
    """Chunks of each document."""
    return text.chunk_fixed(_t(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@_query("SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_index, md5(parts[k]) AS content FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS parts FROM documents))")
def chunk_sentence(spark, d):
    """Parts between a literal separator."""
    return text.chunk_separated(_t(spark, d, "documents")).withColumn("content", F.md5("content"))


@_query("""
WITH p AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS parts FROM documents),
w AS (SELECT *, list_transform(parts, lambda s: list_distinct(list_filter(string_split(lower(s), ' '), lambda x: x <> ''))) AS words FROM p WHERE len(parts) > 0),
b AS (SELECT *, list_filter(range(0, len(parts)), lambda i: i = 0 OR len(list_intersect(flatten(words[greatest(i - 3, 0) + 1 : i]), flatten(words[i + 1 : i + 3]))) < 0.05 * len(list_distinct(list_concat(flatten(words[greatest(i - 3, 0) + 1 : i]), flatten(words[i + 1 : i + 3]))))) AS starts FROM w),
k AS (SELECT *, unnest(range(1, len(starts) + 1)) AS k FROM b)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_index, md5(array_to_string(parts[starts[k] + 1 : coalesce(starts[k + 1], len(parts))], '. ')) AS content FROM k
""")
def chunk_semantic(spark, d):
    """Runs of sentences that share words."""
    return text.chunk_semantic(_t(spark, d, "documents")).withColumn("content", F.md5("content"))


@_query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS rn, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE rn <= 100 AND chars <= 400")
def memory_window(spark, d):
    """The newest messages that fit a context window."""
    return workflows.memory_window(_t(spark, d, "conversations"), context_window=400, key="conv_id", order="turn", id_col="turn", text_col="text").select("conv_id", "turn")


# --- retention ---------------------------------------------------------------


@_query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' AND o_orderstatus <> 'ARCHIVED' THEN 'ARCHIVED' ELSE o_orderstatus END AS o_orderstatus, o_orderdate < TIMESTAMP '1995-06-01' AS changed FROM orders")
def archive_old(spark, d):
    """S15, F16."""
    cutoff = F.lit("1995-06-01").cast("timestamp_ntz")
    return retention.archive_old(_t(spark, d, "orders"), cutoff, activity="o_orderdate", status="o_orderstatus").select("o_orderkey", "o_orderstatus", "changed")


@_query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn > 3")
def keep_newest_n(spark, d):
    """What retention deletes."""
    return retention.split_newest(_t(spark, d, "conversations"), "conv_id", "turn", "turn", 3)[1].select("conv_id", "turn")


@_query("SELECT conv_id, turn, md5(text) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def newest_kept(spark, d):
    """What stays after the rows that retention lists are deleted."""
    rows = _t(spark, d, "conversations")
    gone = retention.split_newest(rows, "conv_id", "turn", "turn", 3)[1]
    return retention.delete_listed(rows, gone, ["conv_id", "turn"]).select("conv_id", "turn", F.md5("text").alias("content"))


@_query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY ts IS NULL ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 100")
def newest_of_one_parent(spark, d):
    """Retention where one parent has all rows."""
    return retention.split_newest(_t(spark, d, "events").withColumn("parent", F.lit(1)), "parent", "ts", "event_id", 100)[1].select("event_id")


@_query("SELECT l_partkey = 17 AND l_orderkey % 2 = 0 AS deleted, count(*) AS n FROM lineitem GROUP BY 1")
def delete_by_document_counts(spark, d):
    """How many rows a bulk delete takes and leaves."""
    stay, go = retention.delete_where(_t(spark, d, "lineitem"), (F.col("l_partkey") == 17) & (F.col("l_orderkey") % 2 == 0))
    return stay.select(F.lit(False).alias("deleted")).unionByName(go.select(F.lit(True).alias("deleted"))).groupBy("deleted").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def status_transition(spark, d):
    """Changes by id."""
    orders = _t(spark, d, "orders")
    changes = orders.where("o_orderkey % 100 = 1").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return retention.apply_changes(orders, changes, ["o_orderstatus"], "o_orderkey").select("o_orderkey", "o_orderstatus")


@_query("SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'completed' ELSE event_type END AS status, CASE WHEN event_id % 20 = 0 THEN 1.5 ELSE value END AS duration FROM events")
def complete_invocation(spark, d):
    """Completion keeps the old duration if there is no new one."""
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("result"), F.col("event_type").alias("status"), F.col("value").alias("duration"), F.lit(None).cast("timestamp").alias("completed_at"))
    done = rows.where("id % 10 = 0").select("id", F.lit("{}").alias("result"), F.lit(None).cast("string").alias("status"), F.when(F.col("id") % 20 == 0, 1.5).alias("duration"))
    return retention.complete_invocations(rows, done, F.lit("2026-01-01").cast("timestamp")).select("id", "status", "duration")


# --- rate limits -------------------------------------------------------------


@_query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_count(spark, d):
    """Requests in the last day."""
    return rate_limits.sliding_count(_t(spark, d, "events"), 86400, key="user_id").select("event_id", "in_window")


@_query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s FROM events),
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, s ORDER BY us, event_id) = 1 AS BIGINT) AS mark FROM e)
SELECT event_id, CAST(sum(mark) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) - mark AS BIGINT) AS seconds,
       sum(mark) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) - mark < 3 AS allowed FROM m
""")
def limiter_b_distinct_second(spark, d):
    """The limiter that counts distinct seconds."""
    return rate_limits.distinct_second_limit(_t(spark, d, "events"), 3, 86400, key="user_id", id_col="event_id").select("event_id", "seconds", "allowed")


@_query()
def limiter_a_stream(spark, d):
    """The limiter that records accepted requests only, as a stream with state."""
    schema = _t(spark, d, "events").schema
    return limiters.run_once(limiters.sliding_limit(limiters.file_stream(spark, d, "events.parquet", schema), 2, 86400))


@_query("SELECT user_id, max(ts) AS last_activity, count(*) AS n FROM events GROUP BY user_id")
def last_activity_stream(spark, d):
    """Running statistics by key."""
    schema = _t(spark, d, "events").schema
    out = limiters.run_once(limiters.last_activity(limiters.file_stream(spark, d, "events.parquet", schema)), "update", "user_id")
    return out.withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


# --- workflow graphs ---------------------------------------------------------


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """A tree of steps in each region of nations: step n follows step n div 2."""
    n = F.col("n_nationkey").cast("long")
    return _t(spark, d, "nation").select(F.lit(1).cast("long").alias("workflow_id"), n.alias("step_id"), F.when(n > 0, F.array(F.expr("n_nationkey div 2"))).otherwise(F.array().cast("array<bigint>")).alias("dependencies"))


@_query("WITH RECURSIVE t(step_id, level) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT CAST(n_nationkey AS BIGINT), level + 1 FROM nation JOIN t ON n_nationkey // 2 = step_id AND n_nationkey > 0) SELECT CAST(1 AS BIGINT) AS workflow_id, step_id, level FROM t")
def step_levels(spark, d):
    """Execution levels."""
    return workflows.levels(_steps(spark, d))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS step_id FROM nation WHERE NOT n_nationkey < 6 AND (n_nationkey = 0 OR n_nationkey // 2 < 6)")
def ready_steps(spark, d):
    """Steps whose dependencies are completed."""
    steps = _steps(spark, d)
    results = steps.select("workflow_id", "step_id", F.when(F.col("step_id") < 6, "COMPLETED").otherwise("PENDING").alias("status"))
    return workflows.ready_steps(steps, results).select("step_id")

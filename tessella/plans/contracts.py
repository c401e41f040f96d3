"""More registered queries, each beside its SQL: writes, nested reads, validation, progress, state.

Tables stand in for the platform's as in ``catalog``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import paging, rate_limits, relations, retention, stats, workflows
from ..sources import commits, tables
from ..streaming import latency, limiters, refresh
from .catalog import _query, _t

_NOW = "2026-01-01 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


# --- filters -----------------------------------------------------------------


@_query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def filter_by_parent(spark, d):
    """rows of one server or agent."""
    return _t(spark, d, "customer").where(P.where({"c_nationkey": 7})).select("c_custkey", "c_name")


@_query("SELECT p_partkey FROM part WHERE p_size = 7")
def filter_by_type(spark, d):
    """rows of one type."""
    return _t(spark, d, "part").where(P.where({"p_size": 7})).select("p_partkey")


@_query("SELECT 'running' AS view, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'ready', count(*) FROM orders WHERE o_orderstatus = 'F'")
def fixed_status_views(spark, d):
    """Views of one fixed status."""
    orders = _t(spark, d, "orders")
    parts = [orders.where(P.where({"o_orderstatus": s})).agg(F.lit(view).alias("view"), F.count("*").alias("n")) for view, s in (("running", "P"), ("ready", "F"))]
    return parts[0].unionByName(parts[1])


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey % 50 = 1 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey")
def active_sessions(spark, d):
    """two conditions, the newest first."""
    rows = _t(spark, d, "orders").where((F.col("o_custkey") % 50 == 1) & P.where({"o_orderstatus": "O"}))
    return paging.page(rows, None, None, {"o_orderdate": "desc"}, "o_orderkey").select("o_orderkey", "o_orderdate")


@_query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3 AND role = 'user' ORDER BY turn")
def messages_by_role(spark, d):
    """a session's messages of one role, the oldest first."""
    return paging.page(_t(spark, d, "conversations"), None, {"conv_id": 3, "role": "user"}, {"turn": "asc"}, "turn").select("conv_id", "turn", "text")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 17 AND l_suppkey IN (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = 17) ORDER BY l_linenumber, l_orderkey")
def chunks_of_document(spark, d):
    """a store's chunks of one document, in order."""
    items = _t(spark, d, "lineitem")
    store = items.where("l_partkey = 17").agg(F.min("l_suppkey").alias("l_suppkey"))
    return paging.page(items.join(store, "l_suppkey", "left_semi"), None, {"l_partkey": 17}, {"l_linenumber": "asc"}, "l_orderkey").select("l_orderkey", "l_linenumber")


@_query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 're') OR contains(lower(p_type), 'brass')) AND p_size = 7 ORDER BY p_name DESC, p_partkey LIMIT 10")
def search_with_status(spark, d):
    """a search within one status, a page of it."""
    found = _t(spark, d, "part").where(P.search("RE", "p_name") | P.search("Brass", "p_type"))
    return paging.page(found, paging.Page(1, 10), {"p_size": 7}, {"p_name": "desc"}, "p_partkey").select("p_partkey")


@_query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'th') AND conv_id IN (3, 4, 5) ORDER BY conv_id, turn LIMIT 10")
def scoped_search(spark, d):
    """a search within a scope, if one is named, by pages, if they are asked for."""
    found = _t(spark, d, "conversations").where(P.search("TH", "text"))
    return paging.page(found, paging.Page(1, 10), {"conv_id": [3, 4, 5]}, {"conv_id": "asc"}, "turn").select("conv_id", "turn")


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@_query(f"SELECT event_id FROM events WHERE {_K} <> 4 AND {_K} > 2 AND {_K} < 40 AND {_K} <= 30 AND {_K} NOT IN (5, 6)")
def metadata_operators(spark, d):
    """ne, gt, lt, lte and nin on metadata."""
    tests = (("ne", 4), ("gt", 2), ("lt", 40), ("lte", 30), ("nin", [5, 6]))
    rows = _t(spark, d, "events")
    for op, value in tests:
        rows = rows.where(P.json_filter("props", "k", op, value))
    return rows.select("event_id")


@_query("SELECT count(*) AS total FROM conversations WHERE conv_id = 3")
def unpaged_total(spark, d):
    """A3: the total of a read without pages."""
    return paging.page(_t(spark, d, "conversations"), None, {"conv_id": 3}, {"turn": "asc"}, "turn").agg(F.count("*").alias("total"))


# --- nested reads ------------------------------------------------------------

_LIST = "coalesce(string_agg(CAST({0} AS VARCHAR), ',' ORDER BY {0}), '')"


@_query(f"""
SELECT n_nationkey, (SELECT {_LIST.format('c_custkey')} FROM customer WHERE c_nationkey = n_nationkey) AS workflows,
       (SELECT {_LIST.format('s_suppkey')} FROM supplier WHERE s_nationkey = n_nationkey) AS tools,
       (SELECT {_LIST.format('c_custkey')} FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS conversations FROM nation
""")
def agent_with_all_children(spark, d):
    """Three sets of children in one read."""
    customers = _t(spark, d, "customer")
    out = _t(spark, d, "nation").select("n_nationkey")
    for name, rows, fk, column in (("workflows", customers, "c_nationkey", "c_custkey"), ("tools", _t(spark, d, "supplier"), "s_nationkey", "s_suppkey"), ("conversations", customers.where("c_acctbal < 0"), "c_nationkey", "c_custkey")):
        out = relations.nest(out, rows, "n_nationkey", fk, [column], name)
    lists = (F.array_join(F.transform(c, lambda x: x.getField(k).cast("string")), ",").alias(c) for c, k in (("workflows", "c_custkey"), ("tools", "s_suppkey"), ("conversations", "c_custkey")))
    return out.select("n_nationkey", *lists)


def _top(n: int, limit: int) -> str:
    return f"""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
p AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit})
SELECT p.conv_id, last_turn, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY rn) AS turns FROM p JOIN r ON r.conv_id = p.conv_id AND rn <= {n} GROUP BY 1, 2
"""


def _nested(spark, d, n, limit):
    messages = _t(spark, d, "conversations")
    parents = paging.page(messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn")), paging.Page(1, limit), None, {"last_turn": "desc"}, "conv_id")
    out = relations.nest(parents, messages, "conv_id", "conv_id", ["turn"], "turns", order=[F.desc("turn")], limit=n)
    return out.withColumn("turns", F.array_join(F.transform("turns", lambda x: x["turn"].cast("string")), ","))


@_query(_top(5, 10))
def sessions_with_messages(spark, d):
    """Ten sessions, each with its newest five messages inside."""
    return _nested(spark, d, 5, 10)


@_query(_top(10, 20))
def tools_with_invocations(spark, d):
    """Parents with their newest ten children inside."""
    return _nested(spark, d, 10, 20)


@_query("SELECT doc_id, source, 'quality' AS metric, CAST(quality AS BIGINT) AS value FROM labels JOIN documents USING (doc_id) UNION ALL SELECT doc_id, source, 'toxic', toxic FROM labels JOIN documents USING (doc_id)")
def metric_lineage(spark, d):
    """From a test case over its result to each metric."""
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    pairs = F.create_map(F.lit("quality"), F.col("quality").cast("long"), F.lit("toxic"), F.col("toxic").cast("long"))
    return rows.select("doc_id", "source", F.explode(pairs).alias("metric", "value"))


# --- statistics --------------------------------------------------------------


@_query("""
SELECT label AS vector_store_id, count(*) AS total_vectors, count(DISTINCT vec_id // 3) AS total_documents, round(sum(8 * len(embedding)) / 1e6, 6) AS index_size_mb,
       max(vec_id) AS last_updated, coalesce(max(n), 0) AS query_count, round(coalesce(max(t), 0), 6) AS avg_query_time_ms
FROM embeddings LEFT JOIN (SELECT CAST(user_id % 12 AS INTEGER) AS id, count(*) AS n, avg(value) AS t FROM events GROUP BY 1) ON id = label GROUP BY label
""")
def store_contract(spark, d):
    """All six statistics of a store."""
    held = _t(spark, d, "embeddings").select(F.col("label").alias("vector_store_id"), F.expr("vec_id div 3").alias("document_id"), F.col("vec_id").alias("created_at"), "embedding")
    asked = _t(spark, d, "events").select((F.col("user_id") % 12).cast("int").alias("vector_store_id"), F.col("value").alias("duration_ms"))
    out = stats.store_contract(held, asked, size=8 * F.size("embedding"))
    return out.withColumns({c: F.round(c, 6) for c in ("index_size_mb", "avg_query_time_ms")})


_STORES = "SELECT DISTINCT CAST(label AS BIGINT) AS id FROM embeddings"
_JSON = """'{"total_vectors":' || count(*) || ',"total_documents":' || count(DISTINCT vec_id // 3) || '}'"""


def _stores(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("label").cast("long").alias("vector_store_id"), F.expr("vec_id div 3").alias("document_id"), "vec_id")
    return rows, rows.select(F.col("vector_store_id").alias("id")).distinct().withColumn("statistics", F.lit("{}"))


@_query(f"SELECT id, CASE WHEN id % 2 = 0 THEN s ELSE '{{}}' END AS statistics FROM (SELECT CAST(label AS BIGINT) AS id, {_JSON} AS s FROM embeddings GROUP BY label)")
def batch_insert_refresh(spark, d):
    """A batch is inserted and the statistics of each store in it computed once."""
    rows, stores = _stores(spark, d)
    added = rows.where("vector_store_id % 2 = 0 and vec_id % 3 = 0")
    return stats.refreshed(stores, rows.join(added, "vec_id", "left_anti").select(rows.columns), added)


@_query(f"SELECT CAST(label AS BIGINT) AS id, {_JSON} AS statistics FROM embeddings GROUP BY label")
def store_stats_stream(spark, d):
    """Statistics of the stores, kept up as embeddings arrive."""
    _, stores = _stores(spark, d)
    source = limiters.file_stream(spark, d, "embeddings.parquet", _t(spark, d, "embeddings").schema)
    return refresh.keep_statistics(source.select(F.col("label").cast("long").alias("vector_store_id"), F.expr("vec_id div 3").alias("document_id")), stores, tables.scratch(spark, "statistics"), buckets=8)


@_query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 90) AS failures, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
round(100.0 * count(*) FILTER (value > 90) / count(*), 6) AS failure_rate FROM events GROUP BY event_type""")
def latency_rollup(spark, d):
    """Durations and failures by route."""
    out = stats.latency(_t(spark, d, "events"), ["event_type"], F.col("value"), F.col("value") > 90)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99", "failure_rate")})


@_query("""SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, count(*) FILTER (value > 90) AS failures, round(100.0 * count(*) FILTER (value > 90) / count(*), 6) AS failure_rate,
round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1, 2""")
def latency_stream(spark, d):
    """Durations and failures by route and week of event time, as a stream."""
    source = limiters.file_stream(spark, d, "events.parquet", _t(spark, d, "events").schema)
    out = latency.exact_latency(source, ["event_type"], F.col("value"), F.col("value") > 90, width="7 days")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "failure_rate")}).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("""WITH m AS (SELECT 'response_time' AS metric, n_chars / 10.0 AS v FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'quality', quality FROM labels JOIN documents USING (doc_id))
SELECT metric, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM m GROUP BY metric""")
def metric_percentiles(spark, d):
    """Percentiles by metric, response times among them."""
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = stats.metric_percentiles(rows, F.create_map(F.lit("response_time"), F.col("n_chars") / 10.0, F.lit("quality"), F.col("quality").cast("double")))
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p95")})


@_query("""SELECT o_custkey AS workflow_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, CAST(coalesce(sum(o_orderkey % 100) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS duration_ms,
round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS percent FROM orders GROUP BY o_custkey""")
def run_progress(spark, d):
    """Completed steps, their share and their time."""
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("workflow_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 100 / 1000)).alias("end"))
    timed = rows.withColumns({"start_ms": F.lit(0), "end_ms": P.millis_between("start", "end")})
    return workflows.run_progress(timed).withColumn("percent", F.round("percent", 6))


# --- writes ------------------------------------------------------------------


@_query(f"SELECT n_name AS name, 'CREATED' AS status, CASE WHEN n_nationkey = 3 THEN 'ASSISTANT' ELSE 'WORKER' END AS role, TIMESTAMP '{_NOW}' AS created_at, true AS has_id FROM nation")
def insert_with_defaults(spark, d):
    """New rows with ids, times and defaults."""
    rows = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") == 3, "ASSISTANT").alias("role"))
    out = tables.with_defaults(rows, "agents", _now(), status=F.lit("CREATED"), role=F.lit("WORKER"))
    return out.select("name", "status", "role", F.col("created_at").cast("timestamp_ntz").alias("created_at"), P.is_uuid(F.col("id")).alias("has_id"))


@_query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey >= 20")
def insert_missing(spark, d):
    """What isn't in the table yet."""
    rows = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return tables.insert_missing(rows.where("id < 20"), rows, "id")


@_query("SELECT 'nation' AS tbl, count(*) > 0 AS ok FROM nation UNION ALL SELECT 'customer', count(*) > 0 FROM customer UNION ALL SELECT 'orders', count(*) > 0 FROM orders")
def health(spark, d):
    """Which tables can be read and hold rows."""
    found = [_t(spark, d, t).limit(1).agg(F.lit(t).alias("tbl"), (F.count("*") > 0).alias("ok")) for t in ("nation", "customer", "orders")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@_query("SELECT c_custkey, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 10 = 0 GROUP BY 1")
def commit_with_children(spark, d):
    """Parents and children in one commit, read back at the version before and after the parents without children are replaced."""
    root = tables.scratch(spark, "store")
    parents, children = _t(spark, d, "customer").where("c_custkey % 10 = 0"), _t(spark, d, "orders").where("o_custkey % 10 = 0")
    commits.commit(spark, root, append={"customer": parents, "orders": children})
    commits.change(spark, root, lambda held: {"customer": relations.with_children(held["customer"], held["orders"], "c_custkey", "o_custkey")})
    joined = commits.read(spark, root, "customer").join(commits.read(spark, root, "orders", version=1), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_custkey").agg(F.count("*").alias("n"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'B' WHEN o_orderkey % 4 = 3 THEN 'A' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 4 = 1 THEN 'second' WHEN o_orderkey % 4 = 3 THEN 'first' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def merged_changes(spark, d):
    """Several partial changes of one id, merged column by column."""
    orders = _t(spark, d, "orders")
    at = lambda k, where, status, priority: orders.where(where).select("o_orderkey", F.lit(k).alias("at"), F.lit(status).cast("string").alias("o_orderstatus"), F.lit(priority).cast("string").alias("o_orderpriority"))
    changes = at(1, "o_orderkey % 2 = 1", "A", None).unionByName(at(2, "o_orderkey % 2 = 1", None, "first")).unionByName(at(3, "o_orderkey % 4 = 1", None, "second")).unionByName(at(4, "o_orderkey % 4 = 1", "B", None))
    return retention.apply_changes(orders, changes, ["o_orderstatus", "o_orderpriority"], "o_orderkey", order="at").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@_query(f"""SELECT sha256(concat_ws('|', 'update', 'agent', CAST(n_nationkey AS VARCHAR), '{_NOW}')) AS id, 'update' AS action, 'agent' AS entity_type, CAST(n_nationkey AS VARCHAR) AS entity_id,
'{{"n_name":"' || n_name || '"}}' AS old_data, CAST(NULL AS VARCHAR) AS new_data, 'u1' AS user_id, TIMESTAMP '{_NOW}' AS created_at FROM nation""")
def audit_rows(spark, d):
    """A log row for each change."""
    return tables.audit(_t(spark, d, "nation"), "update", "agent", _now(), id_col="n_nationkey", old=F.struct("n_name"), user="u1")


@_query(f"SELECT c.c_custkey AS id, greatest(TIMESTAMP '1995-06-01', coalesce(max(o_orderdate), TIMESTAMP '1995-06-01')) AS last_activity FROM customer c LEFT JOIN orders ON o_custkey = c.c_custkey GROUP BY 1")
def touch_activity(spark, d):
    """The last activity moves up and never back."""
    sessions = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("1995-06-01").cast("timestamp_ntz").alias("last_activity"))
    return retention.touch(sessions, _t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at")))


@_query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 30 DAY")
def older_than_days(spark, d):
    """A cutoff some days back, ISO times."""
    cutoff = retention.days_before(F.lit("1996-01-01").cast("timestamp_ntz"), 30)
    return _t(spark, d, "orders").where(F.col("o_orderdate") < cutoff).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("day"))


@_query("SELECT p_partkey FROM part WHERE NOT (p_name LIKE '%e%' AND p_type LIKE 'S%')")
def delete_by_pattern(spark, d):
    """What stays after deleting by a glob of the key."""
    return retention.delete_where(_t(spark, d, "part"), P.glob(F.col("p_name"), "*e*") & P.glob(F.col("p_type"), "S*"))[0].select("p_partkey")


# --- values ------------------------------------------------------------------


@_query(f"SELECT event_id, {_K} AS k, '{{\"k\":' || {_K} || ',\"type\":\"' || event_type || '\"}}' AS merged FROM events")
def json_round_trip(spark, d):
    """JSON decoded, merged with another map and encoded."""
    rows = _t(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    merged = F.map_concat(F.transform_values("m", lambda k, v: v), F.create_map(F.lit("type"), F.col("event_type")))
    typed = F.struct(merged["k"].cast("long").alias("k"), merged["type"].alias("type"))
    return rows.select("event_id", F.col("m")["k"].cast("long").alias("k"), F.to_json(typed).alias("merged"))


@_query("SELECT p_partkey, starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'SMALL') AS public, contains(lower(p_name), 're') OR contains(lower(p_name), 'bl') AS blocked, upper(p_type) AS kind FROM part")
def prefix_and_list_tests(spark, d):
    """Prefixes, parts of a list, upper case."""
    return _t(spark, d, "part").select("p_partkey", P.has_prefix(F.col("p_type"), ["STANDARD", "SMALL"]).alias("public"), P.contains_any(F.col("p_name"), ["RE", "bl"]).alias("blocked"), F.upper("p_type").alias("kind"))


@_query("""SELECT c_custkey, concat_ws(',', CASE WHEN NOT length(c_name) BETWEEN 1 AND 255 THEN 'name' END, CASE WHEN NOT c_acctbal BETWEEN 0 AND 5000 THEN 'balance' END,
CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END, 'id') AS broken FROM customer""")
def validate_rows(spark, d):
    """Lengths, ranges, domains and ids."""
    rules = {"name": P.length_between("c_name", 1, 255), "balance": F.col("c_acctbal").between(0, 5000), "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "id": P.is_uuid(F.col("c_custkey").cast("string"))}
    return _t(spark, d, "customer").select("c_custkey", F.array_join(P.violations(rules), ",").alias("broken"))


@_query("""
WITH w AS (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS entity FROM conversations), e AS (SELECT DISTINCT conv_id, entity FROM w)
SELECT 'topic' AS kind, role AS name, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY 2
UNION ALL SELECT 'entity', entity, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'language', coalesce(lang, 'en'), count(*) FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN documents ON doc_id = conv_id GROUP BY 2
""")
def context_values(spark, d):
    """Topics, key entities and language of the sessions' contexts, and how many sessions have each."""
    messages = _t(spark, d, "conversations")
    words = F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))))
    said = messages.groupBy(F.col("conv_id").alias("id")).agg(F.collect_set("role").alias("topics"), F.array_distinct(words).alias("key_entities"))
    known = said.join(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language")), "id", "left")
    sessions = known.select("id", F.to_json(F.struct("topics", "key_entities", "language")).alias("context"))
    return relations.context_values(sessions)


# --- workflows, limits -------------------------------------------------------


@_query("SELECT CAST(1 AS BIGINT) AS workflow_id, CAST(n_nationkey AS BIGINT) AS step_id, CASE WHEN n_nationkey % 5 < 3 THEN 'retry' WHEN n_nationkey > 10 THEN CAST(n_nationkey - 1 AS VARCHAR) ELSE 'give up' END AS next FROM nation WHERE n_nationkey % 2 = 0")
def retry_or_fallback(spark, d):
    """What follows a failed step."""
    n = F.col("n_nationkey").cast("long")
    rows = _t(spark, d, "nation").select(F.lit(1).cast("long").alias("workflow_id"), n.alias("step_id"), F.when(n > 10, n - 1).alias("fallback"), F.when(n % 2 == 0, "FAILED").otherwise("COMPLETED").alias("status"), (n % 5).alias("attempts"))
    return workflows.with_fallback(rows.select("workflow_id", "step_id", "fallback"), rows.select("workflow_id", "step_id", "status", "attempts"))


@_query("SELECT n_nationkey AS step_id, CASE WHEN n_regionkey < 3 THEN r_name END AS agent_id FROM nation JOIN region ON r_regionkey = n_regionkey")
def role_mapping(spark, d):
    """The agent that plays a step's role."""
    steps = _t(spark, d, "nation").select(F.col("n_nationkey").alias("step_id"), F.col("n_regionkey").alias("role"))
    agents = _t(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("role"), F.col("r_name").alias("agent_id"))
    return workflows.assign_roles(steps, agents).select("step_id", "agent_id")


@_query("""
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s FROM events),
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type, s ORDER BY us, event_id) = 1 AS BIGINT) AS mark FROM e)
SELECT event_id, sum(mark) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) - mark < 20 AS allowed FROM m
""")
def limit_by_tool(spark, d):
    """T4: a limit for each tool."""
    return rate_limits.distinct_second_limit(_t(spark, d, "events"), 20, 3600, key="event_type", id_col="event_id").select("event_id", "allowed")


#: What an event does to its user's session.
SESSION_OPS = {"signup": "create", "purchase": "update", "view": "get", "click": "extend", "error": "delete"}


@_query()
def session_state_stream(spark, d):
    """Sessions with a time to live, as a stream with state."""
    source = limiters.file_stream(spark, d, "events.parquet", _t(spark, d, "events").schema)
    op = F.create_map(*(F.lit(x) for pair in SESSION_OPS.items() for x in pair))[F.col("event_type")]
    op = F.when((op == "update") & (F.col("event_id") % 2 == 1), "replace").otherwise(op)
    commands = source.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", op.alias("op"), F.col("props").alias("data"), F.lit(None).cast("long").alias("ttl"))
    return limiters.run_once(limiters.session_state(commands, default_ttl=86400))

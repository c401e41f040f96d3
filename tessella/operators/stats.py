"""Statistics, each in one aggregate; exact percentiles in a few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import ratio
from ..sources.tables import checkpointed
from .retention import replace_json

#: Accuracy of the sketches that bracket a percentile, values of a bracket that one task may order, and parts into which a larger one is cut.
ACCURACY, BRACKET, PARTS = 10_000, 1_000_000, 1024


def invocation_stats(invocations: DataFrame, *, key: str = "tool_id", status: str = "status", duration: str = "duration") -> DataFrame:
    """Per tool: total, successful, failed, success_rate (percent) and average duration; 0 where there is nothing to divide by."""
    out = invocations.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(status) == "completed").alias("successful"), F.count_if(F.col(status) == "failed").alias("failed"), F.coalesce(F.avg(duration), F.lit(0.0)).alias("avg_duration"))
    return out.withColumn("success_rate", ratio(F.col("successful") * 100, F.col("total")))


def store_stats(embeddings: DataFrame, *, store: str = "vector_store_id", document: str = "document_id", size: Column | None = None) -> DataFrame:
    """Per store: total_vectors, unique_documents, avg_chunks_per_document, and size_mb if a size in bytes is given; what isn't known is null."""
    mb = (F.sum(size) / 1e6) if size is not None else F.lit(None).cast("double")
    out = embeddings.groupBy(store).agg(F.count("*").alias("total_vectors"), F.countDistinct(document).alias("unique_documents"), mb.alias("size_mb"))
    return out.withColumn("avg_chunks_per_document", ratio(F.col("total_vectors"), F.col("unique_documents")))


def store_contract(embeddings: DataFrame, queries: DataFrame, *, store: str = "vector_store_id", document: str = "document_id", size: Column, updated: str = "created_at", millis: str = "duration_ms") -> DataFrame:
    """Per store: total_vectors, total_documents, index_size_mb, last_updated, query_count, avg_query_time_ms; stores without queries have 0."""
    held = embeddings.groupBy(store).agg(F.count("*").alias("total_vectors"), F.countDistinct(document).alias("total_documents"), (F.sum(size) / 1e6).alias("index_size_mb"), F.max(updated).alias("last_updated"))
    asked = queries.groupBy(store).agg(F.count("*").alias("query_count"), F.avg(millis).alias("avg_query_time_ms"))
    return held.join(asked, store, "left").fillna({"query_count": 0, "avg_query_time_ms": 0.0})


def refreshed(stores: DataFrame, embeddings: DataFrame, added: DataFrame, *, store: str = "vector_store_id") -> DataFrame:
    """Stores whose JSON ``statistics`` is computed anew, once for each store that the added embeddings name; others stay."""
    touched = added.select(store).distinct()
    every = embeddings.unionByName(added).join(touched, store, "left_semi")
    new = every.groupBy(F.col(store).alias("id")).agg(F.count("*").alias("total_vectors"), F.countDistinct("document_id").alias("total_documents"))
    return replace_json(stores, new, "statistics")


def _keyed(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return rows.select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.lit(0).alias("k")).alias("_of"), value.cast("double").alias("_v")).where("_v IS NOT NULL")


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: tuple[float, ...], bracket: int = BRACKET) -> DataFrame:
    """keys and exact percentiles p50, ... (linear between two values) of values that aren't null.

    A mergeable sketch brackets each percentile, a second pass counts the values
    below, and only those inside the bracket, as values with their counts, are
    ordered.  A bracket of more than ``bracket`` values is cut to parts first,
    as often as needed.  So no task holds a group's values.  Where a bracket
    misses its place it becomes all that is left on that side.
    """
    base = _keyed(rows, keys, value)
    lows, highs = ([min(1.0, max(0.0, p + sign * 2 / ACCURACY)) for p in shares] for sign in (-1, 1))
    sketch = base.groupBy("_of").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.percentile_approx("_v", lows, ACCURACY).alias("lows"), F.percentile_approx("_v", highs, ACCURACY).alias("highs"))
    marks = [F.struct(F.lit(i).alias("i"), F.floor(F.lit(p) * (F.col("n") - 1)).alias("k"), (F.lit(p) * (F.col("n") - 1) % 1).alias("rest"), F.col("lows")[i].alias("lo"), F.col("highs")[i].alias("hi")) for i, p in enumerate(shares)]
    state = checkpointed(sketch.select("_of", "n", "least", "most", F.array(*marks).alias("marks")))

    def placed(wanted: DataFrame) -> DataFrame:
        """_of, n, i, k, rest, lo, hi with below and inside counted."""
        size = len(shares)
        mark = lambda i: F.col("marks")[i]
        counts = [c for i in range(size) for c in (F.count_if(F.col("_v") < mark(i)["lo"]).alias(f"b{i}"), F.count_if((F.col("_v") >= mark(i)["lo"]) & (F.col("_v") <= mark(i)["hi"])).alias(f"a{i}"))]
        found = base.join(wanted, "_of").groupBy("_of").agg(F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"), F.first("marks").alias("marks"), *counts)
        each = F.array(*(F.struct(mark(i)["i"].alias("i"), mark(i)["k"].alias("k"), mark(i)["rest"].alias("rest"), mark(i)["lo"].alias("lo"), mark(i)["hi"].alias("hi"), F.col(f"b{i}").alias("below"), F.col(f"a{i}").alias("inside")) for i in range(size)))
        return found.select("_of", "n", "least", "most", F.explode(each).alias("m")).select("_of", "n", "least", "most", "m.*")

    last = F.least(F.col("k") + 1, F.col("n") - 1)
    open_ = checkpointed(placed(state))
    missed = (F.col("below") > F.col("k")) | (F.col("below") + F.col("inside") <= last)
    wide = open_.withColumns({"lo": F.when(missed & (F.col("below") > F.col("k")), F.col("least")).otherwise(F.col("lo")), "hi": F.when(missed & (F.col("below") + F.col("inside") <= last), F.col("most")).otherwise(F.col("hi"))})
    wide = wide.withColumns({"inside": F.when(missed, F.col("n")).otherwise(F.col("inside")), "below": F.when(F.col("below") > F.col("k"), 0).otherwise(F.col("below"))})
    ready, met = [], []
    todo = checkpointed(wide)
    while True:
        ready.append(todo.where((F.col("inside") <= bracket) | (F.col("lo") == F.col("hi"))))
        large = todo.where((F.col("inside") > bracket) & (F.col("lo") < F.col("hi")))
        if large.isEmpty():
            break
        inside = base.join(large, "_of").where("_v >= lo AND _v <= hi")
        # the ends have parts of their own, so every cut leaves values out
        share = F.coalesce(F.nanvl(F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0)), F.lit(0.0))
        part = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), PARTS - 1).otherwise(1 + F.least(F.floor(share * (PARTS - 2)), F.lit(PARTS - 3)))
        parts = inside.groupBy("_of", "i", part.alias("part")).agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        up = Window.partitionBy("_of", "i").orderBy("part")
        parts = parts.withColumn("before", F.sum("c").over(up) - F.col("c")).join(large, ["_of", "i"])
        parts = parts.withColumn("before", F.col("before") + F.col("below")).where((F.col("before") <= last) & (F.col("before") + F.col("c") > F.col("k")))
        cut = parts.groupBy("_of", "i").agg(*(F.first(c).alias(c) for c in ("n", "least", "most", "k", "rest")), F.min("a").alias("lo"), F.max("b").alias("hi"), F.min("before").alias("below"), F.sum("c").alias("inside"), F.count("*").alias("parts"), F.min("b").alias("x"), F.max("a").alias("y"))
        cut = checkpointed(cut)
        # where two parts meet between the two places, those are the first one's greatest and the second one's least value
        met.append(cut.where("parts = 2").select("_of", "i", "rest", "x", "y"))
        todo = cut.where("parts = 1").drop("parts", "x", "y")
    brackets = reduce(DataFrame.unionByName, [r.select("_of", "n", "i", "k", "rest", "lo", "hi", "below") for r in ready])
    counted = base.join(brackets, "_of").where("_v >= lo AND _v <= hi").groupBy("_of", "i", "_v").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("n", "k", "rest", "below")))
    upto = F.sum("c").over(Window.partitionBy("_of", "i").orderBy("_v")) + F.col("below")
    ends = counted.withColumn("upto", upto).groupBy("_of", "i").agg(F.first("rest").alias("rest"), F.min(F.when(F.col("upto") > F.col("k"), F.col("_v"))).alias("x"), F.min(F.when(F.col("upto") > last, F.col("_v"))).alias("y"))
    ends = reduce(DataFrame.unionByName, met, ends)
    value_at = F.col("x") + F.when(F.col("rest") > 0, (F.col("y") - F.col("x")) * F.col("rest")).otherwise(0.0)
    names = [f"p{round(100 * s)}" for s in shares]
    out = ends.groupBy("_of").agg(*(F.max(F.when(F.col("i") == i, value_at)).alias(name) for i, name in enumerate(names)))
    return out.select(*(F.col(f"_of.k{i}").alias(k) for i, k in enumerate(keys)), *names)


def latency(requests: DataFrame, keys: list[str], duration: Column, failed: Column, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per key: n, failures, failure_rate (percent), mean, and exact percentiles p50, p95, ... of the durations."""
    out = requests.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"), F.avg(duration).alias("mean"))
    out = out.withColumn("failure_rate", ratio(F.col("failures") * 100, F.col("n")))
    marks = percentiles(requests, keys, duration, shares)
    key = reduce(lambda a, b: a & b, (out[k].eqNullSafe(marks[k]) for k in keys))
    return out.join(marks, key, "left").select(*(out[c] for c in out.columns), *(marks[c] for c in marks.columns if c not in keys))


def metric_percentiles(results: DataFrame, metrics: Column, shares: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Per metric of a map column: exact percentiles p50, p90, ... (linear between two values)."""
    return percentiles(results.select(F.explode(metrics).alias("metric", "v")), ["metric"], F.col("v"), shares)


def evaluation_summary(results: DataFrame, passed: Column) -> DataFrame:
    """total, passed, failed and pass_rate (percent)."""
    out = results.agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
    return out.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), ratio(F.col("passed") * 100, F.col("total")).alias("pass_rate"))


def metric_summary(results: DataFrame, metrics: Column) -> DataFrame:
    """Per metric of a map column: n, mean, min, max, stddev."""
    rows = results.select(F.explode(metrics).alias("metric", "v"))
    return rows.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev("v").alias("stddev"))


def weighted_score(metrics: Column, weights: dict[str, float]) -> Column:
    """sum(w * v) / sum(w) over the weighted metrics that a map has."""
    pairs = [(F.element_at(metrics, F.lit(k)), float(w)) for k, w in weights.items()]
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    below = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in pairs), F.lit(0.0))
    return F.try_divide(top, below)


def confusion(results: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1_score."""
    counts = results.agg(F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"), F.count_if(expected & ~predicted).alias("fn"), F.count_if(~expected & ~predicted).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))

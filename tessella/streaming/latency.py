"""Durations and failures of requests as an event-time stream."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import ratio
from ..sources.tables import checkpointed, utc
from .limiters import run_once
from .refresh import rocks

#: Values up to which a window's sketch is exact; beyond, its rank error is below 1.7 / this, with 99 % certainty.
SKETCH = 4096


def latency_windows(requests: DataFrame, keys: list[str], duration: Column, failed: Column, *, ts: str = "ts", width: str = "1 day", delay: str = "1 hour", shares: tuple[float, ...] = (0.5, 0.95, 0.99), sketch: int = SKETCH) -> DataFrame:
    """A stream of window_start, keys, n, failures, failure_rate (percent), mean, and p50, p95, ... by tumbling windows of event time.

    A window's state is a few numbers and a quantile sketch, which tasks merge.
    It is dropped when the watermark, ``delay`` behind the latest request,
    passes its end; a request of such a window comes too late and isn't counted.
    A percentile is the least value that reaches its share.
    """
    timed = requests.withColumn("_time", utc(ts)).withWatermark("_time", delay)
    values = duration.cast("double")
    out = timed.groupBy(F.window("_time", width).alias("_window"), *keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"), F.avg(values).alias("mean"), F.kll_sketch_agg_double(values, F.lit(sketch)).alias("_sketch"))
    marks = [F.kll_sketch_get_quantile_double("_sketch", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares]
    return out.select(F.col("_window.start").alias("window_start"), *keys, "n", "failures", ratio(F.col("failures") * 100, F.col("n")).alias("failure_rate"), "mean", *marks)


def exact_latency(requests: DataFrame, keys: list[str], duration: Column, failed: Column, *, ts: str = "ts", width: str = "1 day", delay: str = "1 hour", shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Run a stream of requests over all that is there; the columns of ``latency_windows``, whose percentiles are exact at any size.

    The stream's state is a count for each different duration of a window and
    its keys, so a hot window is spread over the tasks.
    """
    timed = requests.withColumn("_time", utc(ts)).withWatermark("_time", delay)
    counts = timed.groupBy(F.window("_time", width).alias("_window"), *keys, duration.cast("double").alias("_value")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    with rocks(requests.sparkSession):
        held = run_once(counts.select(F.col("_window.start").alias("window_start"), *keys, "_value", "n", "failures"), "update", ["window_start", *keys, "_value"])
    return latency_of_counts(held, keys, shares)


def latency_of_counts(counts: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Figures of windows from the counts (n, failures) of their different durations (_value).

    Durations are dealt to ordered ranges, of which those that hold a percentile are gone through, each for itself.
    """
    names = ["window_start", *keys]
    dealt = checkpointed(counts.repartitionByRange(*names, "_value").select(F.struct(*names).alias("_of"), F.spark_partition_id().alias("_part"), "_value", "n", "failures"))
    known = F.when(F.col("_value").isNotNull(), F.col("n")).otherwise(0)
    parts = checkpointed(dealt.groupBy("_of", "_part").agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.sum(known).alias("held"), F.sum(F.col("_value") * F.col("n")).alias("total")))
    whole = parts.groupBy("_of").agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.try_divide(F.sum("total"), F.sum("held")).alias("mean"))
    group = Window.partitionBy("_of")
    upto, places = F.sum("held").over(group.orderBy("_part")), [F.greatest(F.ceil(F.lit(Decimal(str(s))) * F.sum("held").over(group)), F.lit(1)).cast("long").alias(f"_k{i}") for i, s in enumerate(shares)]
    some = parts.select("_of", "_part", (upto - F.col("held")).alias("_before"), upto.alias("_upto"), *places)
    some = some.where(reduce(lambda a, b: a | b, (F.col(f"_k{i}").between(F.col("_before") + 1, F.col("_upto")) for i in range(len(shares))))).drop("_upto")
    own = dealt.where("_value IS NOT NULL").join(some, ["_of", "_part"]).withColumn("_upto", F.sum("n").over(Window.partitionBy("_of", "_part").orderBy("_value")) + F.col("_before"))
    # the value whose own counts hold the place
    marks = own.groupBy("_of").agg(*(F.max(F.when(F.col(f"_k{i}").between(F.col("_upto") - F.col("n") + 1, F.col("_upto")), F.col("_value"))).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)))
    out = whole.join(marks, "_of", "left").withColumn("failure_rate", ratio(F.col("failures") * 100, F.col("n")))
    return out.select(*(F.col("_of")[k].alias(k) for k in names), "n", "failures", "failure_rate", "mean", *(f"p{round(100 * s)}" for s in shares))

"""Statistics that follow a stream of writes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.retention import replace_json

#: Parts of a store, by the hash of the document: a store of any size has its state in so many places.
BUCKETS = 64
#: The state store that keeps maps, and states larger than memory (fixed value of Spark).
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_TOTALS = T.StructType([T.StructField("vector_store_id", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("vectors", T.LongType()), T.StructField("documents", T.LongType())])


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state outside the heap."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old) if old else spark.conf.unset(_PROVIDER)


class _Counts(StatefulProcessor):
    """Vectors and different documents of a (store, bucket), which it tells after each micro-batch that has rows of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("documents", "document string", "vectors long")
        self._totals = handle.getValueState("totals", "vectors long, documents long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        vectors, documents = self._totals.get() if self._totals.exists() else (0, 0)
        for pdf in rows:
            vectors += int(pdf["n"].sum())
            for document, n in pdf.dropna(subset="document").groupby("document")["n"].sum().items():
                known = self._seen.containsKey((document,))
                before = self._seen.getValue((document,))[0] if known else 0
                self._seen.updateValue((document,), (before + int(n),))
                documents += not known
        self._totals.update((vectors, documents))
        yield pd.DataFrame({"vector_store_id": [key[0]], "bucket": [key[1]], "vectors": [vectors], "documents": [documents]})

    def close(self) -> None:
        pass


def follow_statistics(embeddings: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Run a stream of embeddings (vector_store_id, document_id) over all that is there, from where the last run on the folder ended.

    State is a map of a store's documents in each of its buckets, kept in the
    folder's checkpoint, so a micro-batch reads its own rows only.  It writes
    the totals of the buckets that it touched as a folder of its own, so one
    that is repeated replaces itself.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vector_store_id").cast("string").alias("vector_store_id"), F.col("document_id").cast("string").alias("document"), F.lit(1).cast("long").alias("n"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("document"), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy("vector_store_id", "bucket").transformWithStateInPandas(statefulProcessor=_Counts(), outputStructType=_TOTALS, outputMode="Update", timeMode="None")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")

    write(spark.createDataFrame([], _TOTALS), -1)  # a stream without rows runs no batch
    with rocks(spark):
        query = totals.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """vector_store_id (text), total_vectors and total_documents as of the last micro-batch: the newest totals of each bucket, added."""
    schema = T.StructType([*_TOTALS, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{folder}/totals").parquet(f"{folder}/totals")
    newest = rows.groupBy("vector_store_id", "bucket").agg(F.max_by(F.struct("vectors", "documents"), "batch").alias("t"))
    return newest.groupBy("vector_store_id").agg(F.sum("t.vectors").alias("total_vectors"), F.sum("t.documents").alias("total_documents"))


def keep_statistics(embeddings: DataFrame, stores: DataFrame, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """The stores with the statistics of all embeddings that a stream has brought, in this run or one before it on the same folder."""
    follow_statistics(embeddings, folder, buckets)
    new = statistics(embeddings.sparkSession, folder).withColumn("id", F.col("vector_store_id").cast(stores.schema["id"].dataType)).drop("vector_store_id")
    return replace_json(stores, new, "statistics")

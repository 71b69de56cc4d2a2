"""Pair counts kept up to date from a stream of rows (entity, kind, value), kind being feature or term.

A pair counts the entities that have both. Of a micro-batch only rows not seen before matter; their pairs are new features
with new terms, new features with old terms, and old features with new terms of the same entity, so a batch joins what it
brings with the old rows of its own entities and never counts old pairs again. The cells of all tables follow from
the pairs, the marginals and the number of entities, which are sums over batches too.

Every batch writes its rows and counts under its number, the number of its new entities last; a batch that is run again after a
failure replaces what it wrote, and readers take the batches that are whole. Rows seen before lie in buckets of
their entities, of which a batch reads those that it has entities in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 16
_TABLES = {"seen": "entity string, kind string, value string, bucket int", "pairs": "feature string, term string, a long", "marginals": "kind string, value string, n long", "entities": "n long"}


class PairCounts:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        if buckets < 1:
            raise ValueError("buckets must be positive")
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # ---------------------------------------------------------------- tables by batch

    def _path(self, table: str, batch_id: int | None = None) -> str:
        return f"{self.folder}/{table}" + ("" if batch_id is None else f"/batch={batch_id}")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self, table: str) -> DataFrame:
        """All batches of a table, with the column batch."""
        schema = f"{_TABLES[table]}, batch int"
        if not self._exists(self._path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table))

    def _whole(self, table: str) -> DataFrame:
        """The rows of batches that were written to their end."""
        done = self._table("entities").select("batch").distinct()
        return self._table(table).join(F.broadcast(done), "batch", "left_semi")  # a row for each batch

    # ---------------------------------------------------------------- writing

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Count a batch. Rows with a null, or of another kind, do not count; nor do rows that repeat, in it or before."""
        rows = batch.select(*[F.col(c).cast("string").alias(c) for c in ("entity", "kind", "value")])
        rows = rows.where(F.col("kind").isin("feature", "term") & F.col("entity").isNotNull() & F.col("value").isNotNull()).distinct()
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(self.buckets)).cast("int"))
        met = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets
        before = self._table("seen").where((F.col("batch") < batch_id) & F.col("bucket").isin(met))
        new = rows.join(before, ["bucket", "entity", "kind", "value"], "left_anti").select("entity", "kind", "value", "bucket")
        new.write.mode("overwrite").partitionBy("bucket").parquet(self._path("seen", batch_id))
        new = self.spark.read.schema(_TABLES["seen"]).parquet(self._path("seen", batch_id))
        old = before.join(new.select("bucket", "entity").distinct(), ["bucket", "entity"], "left_semi")

        def of(df: DataFrame, kind: str) -> DataFrame:
            return df.where(F.col("kind") == kind).select("bucket", "entity", F.col("value").alias(kind))

        # new features meet all terms, old features only new terms: no pair twice
        pairs = of(new, "feature").join(of(new, "term").unionByName(of(old, "term")), ["bucket", "entity"])
        pairs = pairs.unionByName(of(old, "feature").join(of(new, "term"), ["bucket", "entity"]))
        pairs.groupBy("feature", "term").agg(F.count("*").alias("a")).write.mode("overwrite").parquet(self._path("pairs", batch_id))
        new.groupBy("kind", "value").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(self._path("marginals", batch_id))
        first = new.select("bucket", "entity").distinct().join(old.select("bucket", "entity").distinct(), ["bucket", "entity"], "left_anti")
        first.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(self._path("entities", batch_id))

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    # ---------------------------------------------------------------- reading

    def cooccurrence(self) -> DataFrame:
        """(feature, term, a)."""
        return self._whole("pairs").groupBy("feature", "term").agg(F.sum("a").alias("a"))

    def marginals(self, kind: str, name: str) -> DataFrame:
        """Entities of each feature or term."""
        return self._whole("marginals").where(F.col("kind") == kind).groupBy(F.col("value").alias(kind)).agg(F.sum("n").alias(name))

    def contingency(self) -> DataFrame:
        """(feature, term, a, b, c, d, k, m, n) as associations.contingency() has it for all rows so far."""
        n = self._table("entities").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        rows = self.cooccurrence().join(self.marginals("feature", "k"), "feature").join(self.marginals("term", "m"), "term").crossJoin(F.broadcast(n))
        a, k, m = F.col("a"), F.col("k"), F.col("m")
        return rows.select("feature", "term", "a", (k - a).alias("b"), (m - a).alias("c"), (F.col("n") - k - m + a).alias("d"), "k", "m", "n")

"""A store of results: annotations, association statistics and metadata as Parquet tables in a folder.

A version of the store is one manifest, a file that names the data of every table. A writer puts new data beside the old, checks the
constraints on what it wrote, and publishes all tables at once by renaming a manifest to the next version's name, which fails
where another writer has taken it meanwhile. Readers take the manifest with the highest number, or the one they ask for, so they
see all tables of one version and never part of one, whenever a writer ends; data without a manifest is nobody's
and vacuum() removes it. The last KEPT versions stay, for those who read them still.

Annotations are laid out twice: by feature and by term, each in ranges of its key and sorted, in small row groups with Bloom filters,
so a lookup by either key reads the row groups that can hold it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = {
    "annotations": "feature string, term string, q_value double, association_score double, annotation_type string, direct_source_term string",
    "annotations_by_term": "feature string, term string, q_value double, association_score double, annotation_type string, direct_source_term string",
    "statistics": "feature string, term string, a long, b long, c long, d long, odds_ratio double, p_value double, hyper_score double",
    "metadata": "key string, value string, data_type string, updated_at timestamp",
}


class ConstraintError(ValueError):
    """Rows that the store does not take."""


class SchemaError(ValueError):
    """A folder whose tables are not those of this store."""


def violations(annotations: DataFrame, prefix: str | None = "GO:") -> DataFrame:
    """Rows that break a constraint, with `reason`. Scores from 0 to 100 are taken."""
    n = F.count("*").over(Window.partitionBy("feature", "term", "annotation_type"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = F.when(no(F.col("term").startswith(prefix)), "term id") if prefix else F.when(F.col("term").isNull(), "term id")
    reason = (
        reason.when(no(F.col("q_value").between(0, 1)), "q value")
        .when(no(F.col("association_score").between(0, 100)), "score")
        .when(no(F.col("annotation_type").isin("direct", "propagated")), "type")
        .when(F.col("_n") > 1, "duplicate")
    )
    return annotations.withColumn("_n", n).withColumn("reason", reason).where("reason is not null").drop("_n")


def statistics_violations(rows: DataFrame) -> DataFrame:
    bad = F.lit(False)
    for c in "abcd":
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(True))
    n = F.count("*").over(Window.partitionBy("feature", "term"))
    bad = bad | F.coalesce(F.col("odds_ratio") < 0, F.lit(False))
    return rows.withColumn("_n", n).where(bad | (F.col("_n") > 1)).drop("_n")


def orphans(annotations: DataFrame, statistics: DataFrame) -> DataFrame:
    """Direct annotations whose (feature, term) has no row of statistics."""
    return annotations.where("annotation_type = 'direct'").join(statistics.select("feature", "term"), ["feature", "term"], "left_anti")


class ConflictError(OSError):
    """Another writer has published a version since this one began."""


#: Versions that stay readable; bytes of a row group; key columns of the two layouts of annotations.
KEPT, ROW_GROUP, LAYOUTS = 2, 1 << 20, {"annotations": "feature", "annotations_by_term": "term"}


class ResultStore:
    """The store in a folder; with `version`, a snapshot of it as it then was, which cannot be written."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str | None = "GO:", version: int | None = None):
        self.spark, self.folder, self.prefix, self.version = spark, folder.rstrip("/"), prefix, version
        if faults := self.check_schema():
            raise SchemaError("; ".join(faults))

    def at(self, version: int) -> ResultStore:
        return ResultStore(self.spark, self.folder, self.prefix, version)

    # ---------------------------------------------------------------- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds) of what a folder holds."""
        p, fs = self._fs(path)
        return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """Numbers of the readable versions, the current one last."""
        found = [re.fullmatch(r"v([0-9]{12})\.json", n) for n, _ in self._listed(f"{self.folder}/versions")]
        return sorted(int(m[1]) for m in found if m)

    def _manifest_path(self, version: int) -> str:
        return f"{self.folder}/versions/v{version:012d}.json"

    def _read_manifest(self, version: int) -> dict:
        p, fs = self._fs(self._manifest_path(version))
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """version, parent, and for each table the name of its data, its schema and its number of rows."""
        known = self.versions()
        if self.version is not None and self.version not in known:
            raise FileNotFoundError(f"{self.folder} has the versions {known}, not {self.version}")
        return self._read_manifest(self.version or known[-1]) if known else {"version": 0, "parent": None, "tables": {}}

    def _publish(self, base: int, tables: dict) -> int:
        """Put a manifest in the place of the version after base, or fail where there is one already."""
        made = {"version": base + 1, "parent": base or None, "tables": tables}
        temporary, fs = self._fs(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(made, sort_keys=True).encode()))
        stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, self._fs(self._manifest_path(base + 1))[0], never_over)
        except Exception as e:
            fs.delete(temporary, False)
            raise ConflictError(f"version {base + 1} of {self.folder} was published by another writer") from e
        return base + 1

    def _write(self, table: str, rows: DataFrame) -> tuple[str, dict]:
        """Data that no manifest names yet, and what a manifest says of it."""
        name = f"{table}-{uuid.uuid4().hex}"
        writer = rows.write
        if key := LAYOUTS.get(table):
            rows = rows.repartitionByRange(key).sortWithinPartitions(key, "feature", "term")
            writer = rows.write.option("parquet.block.size", ROW_GROUP)
            for column in ("feature", "term"):
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.folder}/data/{name}")
        data = self.spark.read.parquet(f"{self.folder}/data/{name}")
        return name, {"data": name, "schema": _described(data), "rows": data.count()}

    def vacuum(self, older_than_s: float = 24 * 3600) -> list[str]:
        """Delete data that no version names and that did not change for so long, and say which. Writers need less time than that."""
        named = {t["data"] for v in self.versions() for t in self._read_manifest(v)["tables"].values()}
        before = 1000 * (time.time() - older_than_s)
        gone = [n for n, changed in self._listed(f"{self.folder}/data") if n not in named and changed <= before]
        for name in gone:
            p, fs = self._fs(f"{self.folder}/data/{name}")
            fs.delete(p, True)
        return sorted(gone)

    def _forget(self) -> None:
        """Versions before the last KEPT ones, their manifests first, and the data that only they name."""
        known = self.versions()
        named = {t["data"] for v in known[-KEPT:] for t in self._read_manifest(v)["tables"].values()}
        for v in known[:-KEPT]:
            old = {t["data"] for t in self._read_manifest(v)["tables"].values()} - named
            p, fs = self._fs(self._manifest_path(v))
            fs.delete(p, False)
            for name in old:
                fs.delete(self._fs(f"{self.folder}/data/{name}")[0], True)

    def table(self, name: str) -> DataFrame:
        tables = self.manifest()["tables"]
        if name not in tables:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/data/{tables[name]['data']}")

    # ---------------------------------------------------------------- writing

    def store(self, annotations: DataFrame, metadata: dict | None = None, statistics: DataFrame | None = None) -> int | None:
        """Replace the annotations (an empty set changes nothing), and statistics and metadata where given, in one
        version, whose number is returned. What is given is computed once; constraints are checked on what was written."""
        if self.version is not None:
            raise ValueError(f"version {self.version} is a snapshot")
        base = self.manifest()
        made, mine = dict(base["tables"]), []

        def write(table: str, rows: DataFrame) -> DataFrame:
            name, made[table] = self._write(table, rows)
            mine.append(name)
            return self.spark.read.parquet(f"{self.folder}/data/{name}")

        try:
            rows = write("annotations", annotations.select(*_names("annotations")))
            if not made["annotations"]["rows"]:
                self._drop(mine)
                return None
            if bad := violations(rows, self.prefix).take(5):
                raise ConstraintError(f"annotations break constraints, such as {bad}")
            if statistics is not None:
                stats = write("statistics", statistics.select(*_names("statistics")))
                if bad := statistics_violations(stats).take(5):
                    raise ConstraintError(f"statistics break constraints, such as {bad}")
                if bad := orphans(rows, stats).take(5):
                    raise ConstraintError(f"annotations have no statistics, such as {bad}")
            write("annotations_by_term", rows)
            if metadata is not None:
                write("metadata", metadata_rows(self.spark, metadata))
            version = self._publish(base["version"], made)
        except (ConstraintError, ConflictError):
            self._drop(mine)
            raise
        self._forget()
        return version

    def _drop(self, names: list[str]) -> None:
        for name in names:
            p, fs = self._fs(f"{self.folder}/data/{name}")
            fs.delete(p, True)

    def backup(self, folder: str) -> int | None:
        """A copy of this version as the next one of another store, whole or not at all."""
        copy = ResultStore(self.spark, folder, self.prefix)
        base, made = copy.manifest(), {}
        for name in self.manifest()["tables"]:
            _, made[name] = copy._write(name, self.table(name))
        return copy._publish(base["version"], made) if made else None

    # ---------------------------------------------------------------- reading

    def query(self, feature: str | None = None, term: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """Through the layout whose key is asked for; by feature, where both are."""
        layout = "annotations_by_term" if term and not feature else "annotations"
        return query(self.table(layout), feature, term, kind, limit)

    def export_tsv(self, path: str, **filters) -> None:
        """Write filtered annotations; nothing is written where none are left."""
        rows = export(self.table("annotations"), **filters)
        if not rows.isEmpty():
            rows.write.mode("overwrite").csv(path, sep="\t", header=True)

    def metadata(self) -> dict:
        read = {"numeric": lambda v: json.loads(v), "boolean": lambda v: v == "true", "json": json.loads, "string": str}
        return {r["key"]: read[r["data_type"]](r["value"]) for r in self.table("metadata").collect()}

    def check_schema(self) -> list[str]:
        """What differs between the tables of the version and TABLES, by the manifest."""
        tables = self.manifest()["tables"]
        out = [f"unknown table {name}" for name in sorted(tables.keys() - TABLES.keys())]
        return out + [f"{n}: {tables[n]['schema']} instead of {wanted}" for n, wanted in TABLES.items() if n in tables and tables[n]["schema"] != wanted]

    def info(self) -> DataFrame:
        """(table_name, n_rows) of the tables, layouts apart."""
        tables = self.manifest()["tables"]
        rows = [(name, tables.get(name, {}).get("rows", 0)) for name in TABLES if name != "annotations_by_term"]
        return self.spark.createDataFrame(rows, "table_name string, n_rows long")

    def files(self) -> DataFrame:
        """(table_name, n_files, n_bytes, key): how each table of the version lies in the folder."""
        out = []
        for name, t in sorted(self.manifest()["tables"].items()):
            p, fs = self._fs(f"{self.folder}/data/{t['data']}")
            found = [f.getLen() for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet")]
            out.append((name, len(found), sum(found), LAYOUTS.get(name)))
        return self.spark.createDataFrame(out, "table_name string, n_files long, n_bytes long, key string")


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


def _described(rows: DataFrame) -> str:
    return ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in rows.dtypes)


def metadata_rows(spark: SparkSession, values: dict) -> DataFrame:
    def tagged(v) -> tuple[str, str]:
        if isinstance(v, bool):
            return str(v).lower(), "boolean"
        if isinstance(v, (int, float)):
            return json.dumps(v), "numeric"
        return (v, "string") if isinstance(v, str) else (json.dumps(v), "json")

    rows = spark.createDataFrame([(k, *tagged(v)) for k, v in values.items()], "key string, value string, data_type string")
    return rows.withColumn("updated_at", F.current_timestamp())


def query(rows: DataFrame, feature: str | None = None, term: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    for column, value in (("feature", feature), ("term", term), ("annotation_type", kind)):
        if value:
            rows = rows.where(F.col(column) == value)
    rows = rows.orderBy(F.desc("association_score"), "feature", "term")
    return rows.limit(limit) if limit else rows


def export(rows: DataFrame, kind: str | None = None, min_score: float | None = None, max_q: float | None = None, features: Collection[str] | None = None) -> DataFrame:
    if kind:
        rows = rows.where(F.col("annotation_type") == kind)
    if min_score is not None:
        rows = rows.where(F.col("association_score") >= min_score)
    if max_q is not None:
        rows = rows.where(F.col("q_value") <= max_q)
    if features:
        rows = rows.where(F.col("feature").isin(*features))
    return rows.orderBy("feature", "annotation_type", F.desc("association_score"), "term")


def summary_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("annotation_type").agg(
        F.count("*").alias("n"), F.count_distinct("feature").alias("n_features"), F.count_distinct("term").alias("n_terms"),
        F.avg("association_score").alias("avg_score"), F.min("q_value").alias("min_q"), F.max("q_value").alias("max_q"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row on all annotations; with none, only the total has a value."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("annotation_type") == "direct").alias("n_direct"), F.count_if(F.col("annotation_type") == "propagated").alias("n_propagated"),
        F.count_distinct("feature").alias("n_features"), F.count_distinct("term").alias("n_terms"), F.count_distinct("direct_source_term").alias("n_sources"),
        F.min("association_score").alias("min_score"), F.max("association_score").alias("max_score"), F.avg("association_score").alias("avg_score"),
        F.min("q_value").alias("min_q"), F.max("q_value").alias("max_q"), F.avg("q_value").alias("avg_q"),
    )


def top_direct(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.where("annotation_type = 'direct'").orderBy(F.desc("association_score"), "q_value", "feature", "term").limit(n)


def top_by(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n features or terms with the most annotations."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.avg("association_score").alias("avg_score")).orderBy(F.desc("n"), column).limit(n)


# ------------------------------------------------------------------ TSV sinks


def significant_lines(rows: DataFrame) -> DataFrame:
    """The columns of the significant table, formatted."""
    return rows.select(
        "feature", "term", F.format_string("%.6e", "p_value").alias("p_value"), F.format_string("%.6e", "q_value").alias("q_value"),
        F.format_string("%.4f", "odds_ratio").alias("odds_ratio"), F.format_string("%.2f", "hyper_score").alias("hyper_score"),
        "feature_type", F.when(F.size("constituents") > 0, F.array_join("constituents", ",")).otherwise("-").alias("constituents"), "n_observations",
    )


def write_tsv(rows: DataFrame, path: str, only_if_any: bool = False) -> None:
    if only_if_any and rows.isEmpty():
        return
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)

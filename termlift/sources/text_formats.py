"""Readers of annotation, occurrence, ontology and gold-standard files as typed DataFrames.

Text sources push nothing down, but what a filter asks for is searched in the whole line first, so that lines without it are
neither split nor dealt out; convert once to Parquet where a file is read often. gzip files are read
whole by one task each, so readers deal their rows out where asked to (`partitions`) and the files are read by fewer tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlift.operators import filters


def _lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    return _trimmed(_at_least(spark.read.text(path), partitions))


def _at_least(rows: DataFrame, partitions: int | None) -> DataFrame:
    """rows in so many partitions or more: where as many tasks read them already, fewer would only have more to hold."""
    return rows.repartition(partitions) if partitions and rows.rdd.getNumPartitions() < partitions else rows


def _trimmed(rows: DataFrame) -> DataFrame:
    # trim() takes blanks only; trailing tabs and carriage returns go too
    return rows.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))


def _may_hold(line: Column, values: Collection[str] | None) -> Column:
    """Whether any of the values may be a field inside the line: a search for bytes, before the line is split."""
    found = [line.contains(f"\t{v}\t") for v in values or ()]
    return functools.reduce(lambda x, y: x | y, found) if found else F.lit(True)


def read_annotation_lines(spark: SparkSession, path: str, partitions: int | None = None, wanted: Collection[Collection[str] | None] = ()) -> DataFrame:
    """All lines of a GAF file but comments, with `malformed` for fewer than 15 fields.

    wanted: sets of values for inner fields; lines that cannot hold one of each set are left out before they are split."""
    rows = spark.read.text(path).where(~F.ltrim("value").startswith("!"))
    for values in wanted:
        rows = rows.where(_may_hold(F.col("value"), values))
    rows = _trimmed(_at_least(rows, partitions)).where(~F.col("line").startswith("!"))
    f = F.split("line", "\t")
    named = {"entity": 1, "qualifier": 3, "term": 4, "reference": 5, "evidence": 6, "aspect": 8, "taxon": 12}
    return rows.select((F.size(f) < 15).alias("malformed"), *[F.get(f, i).alias(n) for n, i in named.items()])


def read_annotations(spark: SparkSession, path: str, evidence: Collection[str] | None = None, aspects: Collection[str] | None = None, exclude_negated: bool = True, partitions: int | None = None) -> DataFrame:
    """Accepted rows of a GAF file."""
    rows = read_annotation_lines(spark, path, partitions, (evidence, aspects)).where(~F.col("malformed")).drop("malformed")
    return filters.accepted(rows, evidence, aspects, exclude_negated=exclude_negated)


def annotation_counters(spark: SparkSession, path: str, evidence: Collection[str] | None = None, aspects: Collection[str] | None = None, exclude_negated: bool = True) -> DataFrame:
    """(disposition, n): what became of the lines."""
    rows = read_annotation_lines(spark, path)
    return filters.disposition_counts(rows, F.when(F.col("malformed"), "malformed").otherwise(filters.disposition(evidence, aspects, exclude_negated)))


def read_preset(spark: SparkSession, path: str, evidence: str = "manual", aspects: Collection[str] | None = None) -> DataFrame:
    return read_annotations(spark, path, filters.evidence_preset(evidence), aspects)


def species_paths(folder: str, species: str) -> dict[str, str]:
    """The files of a species by the naming convention."""
    return {"annotations": f"{folder}/goa_{species}.gaf.gz", "occurrences": f"{folder}/protein2ipr_{species}.dat.gz"}


def read_occurrences(spark: SparkSession, path: str, least: int = 10, allowed: DataFrame | None = None, prefixes: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Feature occurrences: entity, feature, name, signature, start, end, ordinal (order in the file)."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    f = F.split("line", "\t")
    rows = rows.where(F.size(f) >= 6).select("ordinal", *[F.get(f, i).alias(n) for i, n in enumerate(("entity", "feature", "name", "signature"))], F.expr("try_cast(split(line, '\t')[4] AS INT)").alias("start"), F.expr("try_cast(split(line, '\t')[5] AS INT)").alias("end"))
    rows = filters.allow_entities(rows, allowed).where("start is not null and end is not null")
    rows = filters.min_length(filters.with_prefix(rows, "entity", prefixes), least)
    return filters.max_entities(rows, most)


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) of an OBO file without obsolete terms: a stanza is a row, its lines are tags.

    A file's rows end where a line "[Term]" begins, whatever its line ends are; stanzas of other kinds are cut off."""
    rows = spark.read.option("lineSep", "\n[Term]").text(path).select(F.regexp_replace("value", "\r", "").alias("s")).where("s rlike '^(\\\\[Term\\\\])?[ \\\\t]*\\n'")
    stanzas = rows.select(F.regexp_replace("s", r"(?s)\n\[(?!Term\]).*", "").alias("s"))
    one = lambda tag: F.nullif(F.regexp_extract("s", rf"(?m)^{tag}:\s*(.*?)\s*$", 1), F.lit(""))
    terms = stanzas.select(one("id").alias("term"), one("name").alias("name"), one("namespace").alias("namespace"), F.nullif(F.regexp_extract("s", r'(?m)^def:\s*"(.*?)"', 1), F.lit("")).alias("definition"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"), "s")
    terms = terms.where("term is not null and not is_obsolete")
    is_a = terms.select(F.col("term").alias("child"), F.explode(F.regexp_extract_all("s", F.lit(r"(?m)^is_a:\s*(\S+)"), 1)).alias("parent"), F.lit("is_a").alias("relation"))
    links = terms.select(F.col("term").alias("child"), F.explode(F.regexp_extract_all("s", F.lit(r"(?m)^relationship:\s*(\S+\s+\S+)"), 1)).alias("x"))
    links = links.select("child", F.element_at(F.split("x", r"\s+"), 2).alias("parent"), F.element_at(F.split("x", r"\s+"), 1).alias("relation"))
    edges = is_a.unionByName(links).join(terms.select(F.col("term").alias("parent")), "parent", "left_semi").select("child", "parent", "relation")
    return terms.drop("s"), edges


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(feature, term, term_name), the last line of a pair counting."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("o"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    rows = rows.where(~F.col("line").startswith("!") & (F.col("line") != "")).where(F.size(F.split("line", ">")) == 2)
    rows = rows.select("o", F.split("line", ">")[0].alias("a"), F.split("line", ">")[1].alias("b")).where(F.size(F.split("b", ";")) == 2)
    rows = rows.select("o", F.regexp_replace(F.split(F.trim("a"), r"\s+")[0], "InterPro:", "").alias("feature"), F.trim(F.split("b", ";")[1]).alias("term"), F.regexp_replace(F.trim(F.split("b", ";")[0]), "^GO:", "").alias("term_name"))
    return rows.groupBy("feature", "term").agg(F.max_by("term_name", "o").alias("term_name"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of associations with a header."""
    schema = "feature string, term string, p_value double, q_value double, odds_ratio double, hyper_score double, feature_type string, constituents string, n_observations long"
    return spark.read.option("enforceSchema", True).csv(path, sep="\t", header=True, schema=schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (entity) of a file with an id on each line."""
    return spark.read.text(path).select(F.trim("value").alias("entity")).where("entity <> ''").distinct()


def write_ids(terms: DataFrame, path: str) -> None:
    """The sorted distinct entities, one on each line."""
    terms.select("entity").distinct().orderBy("entity").select(F.col("entity").cast("string")).write.mode("overwrite").text(path)


def extract_lines(spark: SparkSession, ids: DataFrame, source: str, target: str) -> None:
    """Copy the raw lines whose first tab-separated field is one of ids(entity)."""
    rows = spark.read.text(source).where(F.col("value").contains("\t")).withColumn("entity", F.split("value", "\t", 2)[0])
    rows.join(ids.select("entity").distinct(), "entity", "left_semi").select("value").write.mode("overwrite").text(target, compression="gzip")


def preflight(spark: SparkSession, path: str, first: str | None = None) -> bool:
    """Whether the file has a line that can be read (and begins so)."""
    head = spark.read.text(path).head(1)
    return bool(head) and (first is None or head[0]["value"].startswith(first))


def read_scan_hits(spark: SparkSession, path: str, analysis: str = "Pfam") -> DataFrame:
    """Occurrences of one analysis in a domain scanner's TSV: entity, feature, name, start, end."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 8)
    number = lambda i: F.expr(f"try_cast(split(value, '\t')[{i}] AS INT)")
    rows = rows.select(F.get(f, 0).alias("entity"), F.get(f, 3).alias("analysis"), F.get(f, 4).alias("feature"), F.get(f, 5).alias("name"), number(6).alias("start"), number(7).alias("end"))
    return rows.where((F.col("analysis") == analysis) & F.col("start").isNotNull() & F.col("end").isNotNull()).drop("analysis")


def md5(spark: SparkSession, path: str) -> str:
    """The MD5 of a file, for a check against a published one; read as a stream, so a file of any size takes no more memory."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream)
    finally:
        stream.close()

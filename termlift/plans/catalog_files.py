"""Registered queries on files and the store, and on variants of the tests: each writes the driver's tables in a file
format (or into a store) in the shared folder and reads them back through the reader that it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlift.functions.lineage import shared_path
from termlift.operators import associations, evaluation, features, filters, ontology
from termlift.plans import catalog as C
from termlift.plans.catalog_sql import _logp, _with
from termlift.sources import store, text_formats
from termlift.streaming.pairs import PairCounts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def take(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return take


def _text(rows: DataFrame, line: Column, **options) -> str:
    path = shared_path(rows.sparkSession, "text")
    rows.select(line.alias("value")).write.options(**options).text(path)
    return path


# ------------------------------------------------------------------ annotation files


def _annotation_file(spark: SparkSession, d: str) -> str:
    """A GAF file of the annotations: R, A and N stand for EXP, ISS and IEA, O and F for the aspects P and F;
    each line of an urgent order is followed by one that is cut short."""
    evidence = F.when(F.col("evidence") == "R", "EXP").when(F.col("evidence") == "A", "ISS").otherwise("IEA")
    aspect = F.when(F.col("aspect") == "O", "P").otherwise("F")
    term = F.concat(F.lit("GO:"), "term")
    fields = [F.lit("db"), F.col("entity"), F.lit("s"), F.coalesce("qualifier", F.lit("")), term, F.lit("r"), evidence, F.lit(""), aspect, *[F.lit(x) for x in ("n", "y", "protein", "taxon:1", "20240101", "by")]]
    short = F.when(F.col("qualifier") == "1-URGENT", F.concat_ws("\t", F.lit("db"), "entity"))
    lines = C.annotations(spark, d).select(F.explode(F.array_compact(F.array(F.concat_ws("\t", *fields), short))).alias("line"))
    return _text(lines.union(spark.range(1).select(F.lit("!gaf-version: 2.2"))), F.col("line"), compression="gzip")


_GAF = "SELECT entity, term, coalesce(qualifier, '') AS qualifier, CASE evidence WHEN 'R' THEN 'EXP' WHEN 'A' THEN 'ISS' ELSE 'IEA' END AS evidence, CASE aspect WHEN 'O' THEN 'P' ELSE 'F' END AS aspect FROM ann"
_GAF_ROWS = "SELECT 'GO:' || term AS term, count(*) AS n, count(DISTINCT entity) AS n_entities FROM gaf WHERE {} AND NOT contains(upper(qualifier), 'NOT') GROUP BY term"


def _per_term(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Rows are dealt by entity before they are counted, so that a task holds the pairs of a term and an entity of a share that does not grow."""
    rows = C._dealt(rows.select("term", "entity"), "entity", C._read(spark, d, "lineitem").count())
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("n_entities"))


@_query(_with("ann", _GAF_ROWS.format("evidence <> 'IEA' AND aspect = 'P'"), gaf=_GAF))
def scan_annotations(spark, d):
    return _per_term(spark, d, text_formats.read_annotations(spark, _annotation_file(spark, d), filters.MANUAL, ["P"], partitions=4))


@_query(_with("ann", _GAF_ROWS.format("evidence = 'EXP'"), gaf=_GAF))
def scan_preset(spark, d):
    return _per_term(spark, d, text_formats.read_preset(spark, _annotation_file(spark, d), "experimental"))


@_query(_with("ann", """SELECT CASE WHEN contains(upper(qualifier), 'NOT') THEN 'excluded_qualifier' WHEN evidence = 'IEA' THEN 'filtered_evidence' WHEN aspect <> 'P' THEN 'filtered_aspect' ELSE 'accepted' END AS disposition, count(*) AS n FROM gaf GROUP BY 1
    UNION ALL SELECT 'malformed', count(*) FROM gaf WHERE qualifier = '1-URGENT' HAVING count(*) > 0""", gaf=_GAF))
def scan_counters(spark, d):
    return text_formats.annotation_counters(spark, _annotation_file(spark, d), filters.MANUAL, ["P"])


# ------------------------------------------------------------------ occurrence, scanner, id and line files


def _occurrence_file(spark: SparkSession, d: str) -> str:
    begin, end = F.col("position") * 10, F.col("position") * 10 + F.col("part") % 30
    return _text(C.occurrences(spark, d), F.concat_ws("\t", "entity", "feature", F.lit("name"), F.lit("sig"), begin, end))


@_query(_with("occ", "SELECT feature, count(*) AS n, CAST(sum(position * 10) AS BIGINT) AS starts FROM occ WHERE part % 30 + 1 >= 10 AND starts_with(CAST(entity AS VARCHAR), '1') GROUP BY feature"))
def scan_occurrences(spark, d):
    rows = text_formats.read_occurrences(spark, _occurrence_file(spark, d), 10, prefixes=["1"])
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@_query(_with("occ", "SELECT feature, count(*) AS n, CAST(sum(part % 30) AS BIGINT) AS lengths FROM occ WHERE part % 2 = 0 GROUP BY feature"))
def scan_hits(spark, d):
    analysis = F.when(F.col("part") % 2 == 0, "Pfam").otherwise("Other")
    path = _text(C.occurrences(spark, d), F.concat_ws("\t", "entity", F.lit("md5"), F.lit("9"), analysis, "feature", F.lit("name"), "position", F.col("position") + F.col("part") % 30, F.lit("1e-5")))
    return text_formats.read_scan_hits(spark, path).groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("lengths"))


@_query(_with("et", "SELECT CAST(length(CAST(entity AS VARCHAR)) AS INT) AS digits, count(*) AS n, CAST(sum(entity) AS BIGINT) AS total FROM (SELECT DISTINCT entity FROM et) GROUP BY 1"))
def scan_ids(spark, d):
    path = shared_path(spark, "ids")
    text_formats.write_ids(C.entity_terms(spark, d), path)
    return text_formats.read_ids(spark, path).groupBy(F.length("entity").alias("digits")).agg(F.count("*").alias("n"), F.sum(F.col("entity").cast("long")).alias("total"))


@_query(_with("occ", "SELECT feature, count(*) AS n FROM occ WHERE entity IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY feature"))
def extract_lines(spark, d):
    target = shared_path(spark, "extract")
    urgent = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("entity"))
    text_formats.extract_lines(spark, urgent, _occurrence_file(spark, d), target)
    return text_formats.read_occurrences(spark, target, 0).groupBy("feature").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ ontology, gold and prediction files


def _ontology_file(spark: SparkSession, d: str) -> str:
    """An OBO file whose lines end in CRLF, in which terms that begin with b are obsolete."""
    ident = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    link = F.when(F.col("relation") == "is_a", F.concat(F.lit("is_a: "), ident("parent"), F.lit(" ! x"))).otherwise(F.concat(F.lit("relationship: "), "relation", F.lit(" "), ident("parent")))
    links = C.edges(spark, d).groupBy(F.col("child").alias("term")).agg(F.array_join(F.collect_list(link), "\r\n").alias("links"))
    rows = C.terms(spark, d).join(links, "term", "left").coalesce(1)
    gone = F.when(F.col("term").startswith("b"), "is_obsolete: true")
    stanza = F.concat_ws("\r\n", F.lit("[Term]"), F.concat(F.lit("id: "), ident("term")), F.concat(F.lit("name: "), "term"), F.concat(F.lit("namespace: "), "namespace"), gone, "links")
    return _text(rows, stanza, lineSep="\r\n\r\n")


@_query(_with("terms", """SELECT replace(child, ' ', '_') AS child, replace(parent, ' ', '_') AS parent, CASE parent WHEN 'ROOT' THEN 'part_of' ELSE 'is_a' END AS relation
    FROM edges WHERE NOT starts_with(child, 'b') AND NOT starts_with(parent, 'b')"""))
def scan_ontology(spark, d):
    return text_formats.read_ontology(spark, _ontology_file(spark, d))[1]


@_query(_with("terms", "SELECT replace(term, ' ', '_') AS term, term AS name, namespace FROM terms WHERE NOT starts_with(term, 'b')"))
def scan_ontology_terms(spark, d):
    return text_formats.read_ontology(spark, _ontology_file(spark, d))[0].select("term", "name", "namespace")


@_query(_with("gold", "SELECT feature, replace(term, ' ', '_') AS term, term AS term_name FROM gold"))
def scan_gold(spark, d):
    ident = F.replace("term", F.lit(" "), F.lit("_"))
    path = _text(C.gold(spark, d), F.concat(F.lit("InterPro:"), "feature", F.lit(" some name > GO:"), "term", F.lit(" ; "), ident))
    return text_formats.read_gold(spark, path)


@_query(_with("adj", "SELECT feature, term, a, round(score, 2) AS hyper_score FROM adj WHERE q <= 0.2"))
def predictions_file(spark, d):
    """The table of significant associations, written as a TSV and read back as predictions."""
    hits = associations.significant(C._adjusted(spark, d), 0.2)
    meta = features.metadata(C.singles(spark, d))
    path = shared_path(spark, "predictions")
    store.write_tsv(store.significant_lines(hits.join(meta.withColumnRenamed("n_obs", "n_observations"), "feature")), path)
    back = text_formats.read_predictions(spark, path).select("feature", "term", "hyper_score")
    return back.join(hits.select("feature", "term", "a"), ["feature", "term"]).select("feature", "term", "a", (F.round("hyper_score", 2) + 0.0).alias("hyper_score"))


@_query(C.SQL["top_k"])
def top_table_file(spark, d):
    """The table of the strongest associations, written as a TSV and read back."""
    path = shared_path(spark, "top")
    store.write_tsv(associations.top_k(C._tested(spark, d), 100).select("rank", "feature", "term", "p_value"), path)
    back = spark.read.csv(path, sep="\t", header=True, schema="rank int, feature string, term string, p_value double")
    return back.select("rank", "feature", "term", C._logp("p_value", "neg_log10_p"))


# ------------------------------------------------------------------ store


def _filled(spark: SparkSession, d: str) -> store.ResultStore:
    """A store that was filled with the direct annotations and then with all of them."""
    held = store.ResultStore(spark, shared_path(spark, "store"), prefix=None)
    stats = C.cut(associations.significant(C._adjusted(spark, d), 0.2))
    rows = C._stored(spark, d, stats)
    held.store(rows.where("annotation_type = 'direct'"))
    held.store(rows, {"alpha": 0.2, "ontology": True, "by": "catalog", "levels": [1, 2]}, stats.withColumn("odds_ratio", F.when(F.col("odds_ratio") < float("inf"), F.col("odds_ratio"))))
    return held


@_query(_with("store adj", """SELECT CAST(1 AS BIGINT) AS version, kind AS annotation_type, count(*) AS n, CAST(0 AS BIGINT) AS n_statistics FROM store WHERE kind = 'direct' GROUP BY kind
    UNION ALL SELECT 2, kind, count(*), (SELECT count(*) FROM adj WHERE q <= 0.2) FROM store GROUP BY kind"""))
def store_snapshots(spark, d):
    """Both versions of the store, read after the second was published; statistics came with the second."""
    held, out = _filled(spark, d), None
    for v in held.versions():
        one = held.at(v).table("annotations").groupBy("annotation_type").agg(F.count("*").alias("n"))
        one = one.crossJoin(held.at(v).table("statistics").agg(F.count("*").alias("n_statistics"))).select(F.lit(v).cast("long").alias("version"), "annotation_type", "n", "n_statistics")
        out = one if out is None else out.unionByName(one)
    return out


@_query(_with("store", "SELECT feature, term, kind AS annotation_type, source AS direct_source_term FROM store WHERE term = 'ROOT'"))
def term_index(spark, d):
    """All annotations of one term, through the layout by term."""
    return _filled(spark, d).query(term="ROOT").select("feature", "term", "annotation_type", "direct_source_term")


@_query(_with("store", "SELECT kind AS annotation_type, count(*) AS n, count(DISTINCT feature) AS n_features, count(DISTINCT source) AS n_sources FROM store GROUP BY kind"))
def stored_annotations(spark, d):
    rows = _filled(spark, d).table("annotations")
    return rows.groupBy("annotation_type").agg(F.count("*").alias("n"), F.count_distinct("feature").alias("n_features"), F.count_distinct("direct_source_term").alias("n_sources"))


@_query(_with("store adj", "SELECT 'annotations' AS table_name, count(*) AS n_rows FROM store UNION ALL SELECT 'statistics', count(*) FROM adj WHERE q <= 0.2 UNION ALL SELECT 'metadata', 4"))
def store_backup_info(spark, d):
    held = _filled(spark, d)
    copy = store.ResultStore(spark, shared_path(spark, "backup"), prefix=None)
    held.backup(copy.folder)
    return copy.info()


@_query("SELECT * FROM (VALUES ('alpha', '0.2', 'numeric'), ('ontology', 'true', 'boolean'), ('by', 'catalog', 'string'), ('levels', '[1, 2]', 'json')) AS v(key, value, data_type)")
def store_metadata(spark, d):
    return _filled(spark, d).table("metadata").select("key", "value", "data_type")


@_query(_with("store", "SELECT feature, term, source AS direct_source_term FROM store WHERE kind = 'propagated' AND score >= 20"))
def export_tsv_file(spark, d):
    path = shared_path(spark, "export")
    _filled(spark, d).export_tsv(path, kind="propagated", min_score=20.0)
    return spark.read.csv(path, sep="\t", header=True).select("feature", "term", "direct_source_term")


@_query(_with("store adj", "SELECT feature, term FROM store WHERE kind = 'direct' AND (feature, term) NOT IN (SELECT (feature, term) FROM adj WHERE q <= 0.05)"))
def statistics_orphans(spark, d):
    """Direct annotations without statistics, where those are of a stricter cut."""
    return store.orphans(C._stored(spark, d), associations.significant(C._adjusted(spark, d), 0.05)).select("feature", "term")


# ------------------------------------------------------------------ streams


@_query(C.SQL["contingency"])
def stream_contingency(spark, d):
    """The tables from a stream of four micro-batches, in which an entity's rows come at different times, some of them twice."""
    path, checkpoint = shared_path(spark, "stream"), shared_path(spark, "checkpoint")
    rows = C.singles(spark, d).select("entity", F.lit("feature").alias("kind"), F.col("feature").alias("value"))
    rows = C.cut(rows.unionByName(C.entity_terms(spark, d).select("entity", F.lit("term").alias("kind"), F.col("term").alias("value"))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("value", "entity"), F.lit(4)))
    counts = PairCounts(spark, shared_path(spark, "counts"))
    for i in range(4):  # what has come since the stream was last followed is one micro-batch, whatever its number of files
        now = rows.where((F.col("part") == i) | ((F.col("part") == 0) & (F.col("kind") == "term")))
        now.select(F.col("entity").cast("string").alias("entity"), "kind", "value").write.mode("append").parquet(path)
        stream = spark.readStream.schema("entity string, kind string, value string").parquet(path)
        counts.follow(stream, checkpoint).awaitTermination()
    return counts.contingency().select("feature", "term", "a", "b", "c", "d")


# ------------------------------------------------------------------ variants of the tests


@_query(_with("t", f"SELECT feature, term, a, {_logp('q')} AS neg_log10_q FROM few JOIN fq USING (p) WHERE q < 0.2",
    few="SELECT * FROM t WHERE a >= 2", fr="SELECT p, sum(count(*)) OVER (ORDER BY p) AS r FROM few GROUP BY p",
    fq="SELECT p, least(1.0, min(p * (SELECT count(*) FROM few) / r) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM fr"))
def bh_tested_pairs(spark, d):
    """Adjustment among the pairs with at least two co-occurrences only, and a strict cut."""
    rows = associations.adjusted_among_tested(C.cut(C._tested(spark, d)), 2)
    return associations.significant(rows, 0.2, strict=True).select("feature", "term", "a", C._logp("q_value", "neg_log10_q"))


@_query(_with("ef ann", "SELECT count(*) AS n FROM (SELECT entity FROM ef INTERSECT SELECT entity FROM ann WHERE evidence = 'R')"))
def universe_both(spark, d):
    return associations.universe(C.singles(spark, d), C.annotations(spark, d).where("evidence = 'R'"), "intersection")


@_query(C.SQL["optimal_level_kept"].replace("background < 3 OR NOT p < 0.05", "background >= 1000 AND NOT p < 0.05"))
def optimal_level_small_kept(spark, d):
    """Neighbours with a background below 1,000 are passed over."""
    *inputs, weights = C._level_inputs(spark, d)
    return ontology.optimal_level(*inputs, 1000, 0.05, small_rejects=False, weights=weights).select("feature", "term")


@_query(_with("spread", "SELECT feature, term, source AS direct_source_term, CASE WHEN term = source THEN 'direct' ELSE 'propagated' END AS annotation_type FROM spread"))
def propagate_all_sources(spark, d):
    hits = associations.significant(C._adjusted(spark, d), 0.2).withColumnRenamed("hyper_score", "association_score")
    return ontology.propagate_all(hits, ontology.closure(C.edges(spark, d))).select("feature", "term", "direct_source_term", "annotation_type")


# ------------------------------------------------------------------ reports


@_query(_with("adj", """SELECT 'feature' AS name, count(*) AS n, count(DISTINCT feature) AS n_distinct, NULL AS least, NULL AS most, NULL AS mean FROM adj
    UNION ALL SELECT 'term', count(*), count(DISTINCT term), NULL, NULL, NULL FROM adj
    UNION ALL SELECT 'a', count(*), NULL, CAST(min(a) AS DOUBLE), CAST(max(a) AS DOUBLE), round(avg(a), 6) FROM adj
    UNION ALL SELECT 'hyper_score', count(*), NULL, round(min(score), 3), round(max(score), 3), round(avg(score), 3) FROM adj"""))
def describe_associations(spark, d):
    out = evaluation.describe(C._adjusted(spark, d), ["a", "hyper_score"])
    digits = lambda c: F.when(F.col("name") == "a", F.round(c, 6)).otherwise(F.round(c, 3)).alias(c)
    return out.select("name", "n", "n_distinct", digits("least"), digits("most"), digits("mean"))


@_query(_with("store", "SELECT kind AS annotation_type, count(*) AS n, count(*) FILTER (WHERE q > 0.1) AS n_over, count(*) FILTER (WHERE q > 0.1) = 0 AS compliant FROM store GROUP BY kind"))
def annotation_quality(spark, d):
    return evaluation.quality(C._stored(spark, d), 0.1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

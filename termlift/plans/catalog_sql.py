"""The catalog's results as DuckDB statements, put together from common table expressions."""

from __future__ import annotations

_PART = {
    "occ": "SELECT l_orderkey AS entity, l_linenumber AS position, l_partkey AS part, p_brand AS feature FROM lineitem JOIN part ON l_partkey = p_partkey",
    "ann": "SELECT l_orderkey AS entity, p_name AS term, l_returnflag AS evidence, l_linestatus AS aspect, o_orderpriority AS qualifier FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON o_orderkey = l_orderkey",
    "ef": "SELECT DISTINCT entity, feature FROM occ",
    "et": "SELECT DISTINCT l_orderkey AS entity, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey",
    "arch": "SELECT entity, list(feature ORDER BY position, part) AS singles FROM occ GROUP BY entity",
    "comp": "SELECT entity, array_to_string(list_slice(singles, i, i + n - 1), ',') AS feature FROM (SELECT entity, singles, n, unnest(range(1, len(singles) - n + 2)) AS i FROM arch, (VALUES (2), (3)) AS v(n))",
    "feats": "SELECT DISTINCT entity, feature FROM (SELECT entity, feature FROM occ UNION ALL SELECT entity, feature FROM comp)",
    "meta": "SELECT feature, len(string_split(feature, ',')) AS parts, count(*) AS n_obs FROM feats GROUP BY feature",
    "pairs": "SELECT feature, term, count(*) AS a FROM ef JOIN et USING (entity) GROUP BY ALL",
    "kf": "SELECT feature, count(*) AS k FROM ef GROUP BY feature",
    "mt": "SELECT term, count(*) AS m FROM et GROUP BY term",
    "un": "SELECT count(DISTINCT entity) AS n FROM (SELECT entity FROM ef UNION ALL SELECT entity FROM et)",
    "cells": "SELECT feature, term, a, k - a AS b, m - a AS c, n - k - m + a AS d, k, m, n FROM pairs JOIN kf USING (feature) JOIN mt USING (term) CROSS JOIN un",
    "edges": "SELECT DISTINCT p_name AS child, unnest(string_split(p_name, ' ')) AS parent FROM part UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) AS child, 'ROOT' AS parent FROM part",
    "walk": "SELECT child AS term, parent AS ancestor, 1 AS depth FROM edges UNION SELECT walk.term, edges.parent, walk.depth + 1 FROM walk JOIN edges ON walk.ancestor = edges.child",
    "paths": "SELECT term, ancestor, min(depth) AS depth FROM walk GROUP BY term, ancestor",
    "terms": "SELECT term, CASE WHEN term = 'ROOT' THEN 'root' WHEN contains(term, ' ') THEN 'name' ELSE 'word' END AS namespace FROM (SELECT child AS term FROM edges UNION SELECT parent FROM edges)",
    "own": "SELECT entity, term FROM et UNION SELECT entity, ancestor FROM et JOIN paths USING (term)",
    "gold": "SELECT p_brand AS feature, p_name AS term FROM part GROUP BY ALL HAVING count(*) >= 2",
}


def _choose(n: str, x: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({x} + 1.0) - lgamma({n} - {x} + 1.0))"


def _point(x: str, k: str = "k", m: str = "m", n: str = "n") -> str:
    return f"exp({_choose(k, x)} + {_choose(f'({n} - {k})', f'({m} - {x})')} - {_choose(n, m)})"


def _tail(lo: str, hi: str, k: str = "k", m: str = "m", n: str = "n") -> str:
    return f"least(1.0, list_sum(list_transform(range({lo}, {hi} + 1), lambda x: {_point('x', k, m, n)})))"


_PART |= {
    "t": f"SELECT *, {_tail('a', 'least(k, m)')} AS p FROM cells",
    "s": "SELECT *, CASE WHEN a = 0 THEN 0.0 WHEN p <= 0 THEN 100.0 ELSE greatest(1.0, least(100.0, -10 * log10(p))) END AS score FROM t",
    "dense": "SELECT (SELECT count(DISTINCT feature) FROM ef) * (SELECT count(DISTINCT term) FROM et) AS n_tests",
    "levels": "SELECT p, sum(count(*)) OVER (ORDER BY p) AS r FROM t GROUP BY p",
    "ql": "SELECT p, least(1.0, min(p * n_tests / r) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM levels CROSS JOIN dense",
    "adj": "SELECT s.*, ql.q FROM s JOIN ql ON s.p = ql.p",
    "pred": "SELECT * FROM adj WHERE q <= 0.5",
    "hits": "SELECT * FROM adj WHERE q <= 0.2 AND score BETWEEN 1 AND 100",
    "spread": "SELECT feature, term, term AS source, q, score FROM hits UNION ALL SELECT feature, ancestor, hits.term, q, score FROM hits JOIN paths USING (term)",
    "store": "SELECT feature, term, source, q, score, CASE WHEN term = source THEN 'direct' ELSE 'propagated' END AS kind FROM spread QUALIFY row_number() OVER (PARTITION BY feature, term ORDER BY source) = 1",
    "astat": "SELECT feature, count(*) AS n_total, count(*) FILTER (WHERE alone) AS n_single, count(*) FILTER (WHERE NOT alone) AS n_multi FROM (SELECT len(singles) = 1 AS alone, unnest(list_distinct(singles)) AS feature FROM arch) GROUP BY feature",
    "contrib": "SELECT feature, term, n_total, n_single, n_single / n_total AS fraction FROM (SELECT DISTINCT feature, term FROM pred) SEMI JOIN gold USING (feature, term) JOIN astat USING (feature)",
}
_NEEDS = {
    "ef": ["occ"], "arch": ["occ"], "comp": ["arch"], "feats": ["occ", "comp"], "meta": ["feats"], "pairs": ["ef", "et"], "kf": ["ef"], "mt": ["et"], "un": ["ef", "et"],
    "cells": ["pairs", "kf", "mt", "un"], "walk": ["edges"], "paths": ["walk"], "terms": ["edges"], "own": ["et", "paths"], "t": ["cells"], "s": ["t"], "dense": ["ef", "et"],
    "levels": ["t"], "ql": ["levels", "dense"], "adj": ["s", "ql"], "pred": ["adj"], "hits": ["adj"], "spread": ["hits", "paths"], "store": ["spread"], "astat": ["arch"], "contrib": ["pred", "gold", "astat"],
}


def _with(roots: str, select: str, **extra: str) -> str:
    """A statement that holds the named expressions and all that they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for name in roots.split():
        visit(name)
    ctes = [f"{n} AS ({_PART[n]})" for n in order] + [f"{n} AS ({x})" for n, x in extra.items()]
    return f"WITH RECURSIVE {', '.join(ctes)} {select}" if ctes else select


def _logp(x: str, digits: int = 4) -> str:
    return f"round(-log10(greatest({x}, 1e-300)), {digits}) + 0.0"


_SCORE = "round(score, 3) + 0.0"
_CASE = "CASE WHEN contains(upper(qualifier), 'NOT') THEN 'excluded_qualifier' WHEN evidence NOT IN ('R', 'A') THEN 'filtered_evidence' WHEN aspect NOT IN ('O') THEN 'filtered_aspect' WHEN NOT starts_with(term, 'b') THEN 'parse_error' ELSE 'accepted' END"
_PRF = "CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS precision, CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS recall"
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"
_CUTS = ", ".join(
    [f"({i}, 'p_value', {c})" for i, c in enumerate(("1e-2", "1e-3", "1e-4", "1e-6", "1e-8", "1e-10"))]
    + [f"({i + 6}, 'q_value', {c})" for i, c in enumerate(("1e-2", "1e-3", "1e-4", "1e-6", "1e-8", "1e-10"))]
    + [f"({i + 12}, 'hyper_score', {c})" for i, c in enumerate(("10e0", "20e0", "30e0", "40e0", "50e0", "60e0", "70e0", "80e0"))]
)
_SWEEP = {
    "hit": "SELECT adj.*, gold.feature IS NOT NULL AS good FROM adj LEFT JOIN gold USING (feature, term)",
    "one": f"""SELECT ordinal, criterion, threshold, count(*) FILTER (WHERE ok) AS np, count(*) FILTER (WHERE ok AND good) AS tp
        FROM (SELECT v.*, good, CASE criterion WHEN 'p_value' THEN p <= threshold WHEN 'q_value' THEN q <= threshold ELSE score >= threshold END AS ok
              FROM hit CROSS JOIN (VALUES {_CUTS}) AS v(ordinal, criterion, threshold)) GROUP BY ALL""",
    "sweep": f"SELECT *, {_F1} AS f1 FROM (SELECT *, {_PRF} FROM one CROSS JOIN (SELECT count(*) AS ng FROM gold))",
}
_LEVEL = {
    "big": "SELECT feature, term FROM adj WHERE q <= 0.5",
    "wanted": "SELECT feature, term, parent AS next FROM big JOIN edges ON child = term",
    "bg": "SELECT term AS next, count(*) AS background FROM own GROUP BY term",
    "ac": "SELECT w.term, w.next, count(*) AS ac FROM (SELECT DISTINCT term, next FROM wanted) w JOIN own x ON x.term = w.next JOIN own y ON y.term = w.term AND y.entity = x.entity GROUP BY ALL",
    "af": "SELECT w.feature, w.next, count(*) AS af FROM (SELECT DISTINCT feature, next FROM wanted) w JOIN own x ON x.term = w.next JOIN ef ON ef.feature = w.feature AND ef.entity = x.entity GROUP BY ALL",
    "afc": "SELECT w.feature, w.term, w.next, count(*) AS afc FROM wanted w JOIN own x ON x.term = w.next JOIN own y ON y.term = w.term AND y.entity = x.entity JOIN ef ON ef.feature = w.feature AND ef.entity = x.entity GROUP BY ALL",
    "counted": "SELECT feature, term, next, coalesce(background, 0) AS background, coalesce(af, 0) AS af, coalesce(ac, 0) AS ac, coalesce(afc, 0) AS afc FROM wanted LEFT JOIN bg USING (next) LEFT JOIN ac USING (term, next) LEFT JOIN af USING (feature, next) LEFT JOIN afc USING (feature, term, next)",
    "lev": f"SELECT *, CASE WHEN afc = 0 THEN 1.0 ELSE {_tail('afc', 'least(af, ac)', 'af', 'ac', 'background')} END AS p FROM counted",
}


def _shrunk(alpha: float | None = None) -> dict[str, str]:
    """Composites of two and three features, shrunk towards their parts."""
    return {
        "k2": "SELECT feature, count(*) AS k FROM feats GROUP BY feature",
        "pairs2": "SELECT feature, term, count(*) AS a FROM feats JOIN et USING (entity) GROUP BY ALL",
        "shape": "SELECT feature, k AS n_obs, string_split(feature, ',') AS parts FROM k2",
        "long_": "SELECT feature, n_obs, unnest(parts) AS part FROM shape WHERE len(parts) > 1",
        "ext": "SELECT feature, term, max(a) AS a FROM (SELECT * FROM pairs2 UNION ALL SELECT DISTINCT long_.feature, pairs2.term, 0 FROM long_ JOIN pairs2 ON pairs2.feature = long_.part) GROUP BY ALL",
        "raw": f"SELECT *, CASE WHEN a = 0 THEN 1.0 ELSE {_tail('a', 'least(k, m)')} END AS p FROM ext JOIN k2 USING (feature) JOIN mt USING (term) CROSS JOIN un",
        "prior": "SELECT r.feature, r.term, exp(avg(ln(greatest(coalesce(x.p, 1.0), 1e-323)))) AS prior FROM raw r JOIN long_ ON long_.feature = r.feature LEFT JOIN raw x ON x.feature = long_.part AND x.term = r.term GROUP BY ALL",
        "mix": "SELECT raw.*, prior, least(1.0, 0.5 * exp(-k / 3.0)) AS w FROM raw LEFT JOIN prior USING (feature, term)",
        "sh": "SELECT feature, term, a, p AS p_raw, prior, CASE WHEN prior IS NULL THEN p ELSE exp((1 - w) * ln(greatest(p, 1e-323)) + w * ln(greatest(prior, 1e-323))) END AS p FROM mix",
    }


#: Ranks, significant pairs, the level filter on them and what is propagated of the rest.
_WHOLE = {
    "ls": "SELECT p, sum(count(*)) OVER (ORDER BY p) AS r FROM sh GROUP BY p",
    "qs": "SELECT p, least(1.0, min(p * ((SELECT count(*) FROM k2) * (SELECT count(*) FROM mt)) / r) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM ls",
    "hit": "SELECT sh.*, q, CASE WHEN a = 0 THEN 0.0 WHEN p_raw <= 0 THEN 100.0 ELSE greatest(1.0, least(100.0, -10 * log10(p_raw))) END AS score FROM sh JOIN qs ON sh.p = qs.p WHERE q <= 0.2",
    "wish": "SELECT feature, term, parent AS next FROM hit JOIN edges ON child = term",
    "bg2": "SELECT term AS next, count(*) AS background FROM own GROUP BY term",
    "ac2": "SELECT y.term, x.term AS next, count(*) AS ac FROM own x JOIN own y USING (entity) GROUP BY ALL",
    "af2": "SELECT feature, term AS next, count(*) AS af FROM feats JOIN own USING (entity) GROUP BY ALL",
    "afc2": "SELECT f.feature, y.term, w.next, count(*) AS afc FROM feats f JOIN own y USING (entity) JOIN wish w ON w.feature = f.feature AND w.term = y.term JOIN own x ON x.entity = f.entity AND x.term = w.next GROUP BY ALL",
    "lev2": "SELECT feature, term, coalesce(background, 0) AS background, coalesce(af, 0) AS af, coalesce(ac, 0) AS ac, coalesce(afc, 0) AS afc FROM wish LEFT JOIN bg2 USING (next) LEFT JOIN ac2 USING (term, next) LEFT JOIN af2 USING (feature, next) LEFT JOIN afc2 USING (feature, term, next)",
    "fails": f"SELECT DISTINCT feature, term FROM lev2 WHERE background < 3 OR NOT CASE WHEN afc = 0 THEN 1.0 ELSE {_tail('afc', 'least(af, ac)', 'af', 'ac', 'background')} END < 0.05",
    "good": "SELECT * FROM hit ANTI JOIN fails USING (feature, term) WHERE score BETWEEN 1 AND 100",
    "wide": "SELECT feature, term, term AS source, score FROM good UNION ALL SELECT feature, ancestor, good.term, score FROM good JOIN paths USING (term)",
    "noted": "SELECT feature, term, source AS direct_source_term, score, CASE WHEN term = source THEN 'direct' ELSE 'propagated' END AS annotation_type FROM wide QUALIFY row_number() OVER (PARTITION BY feature, term ORDER BY source) = 1",
}

#: Runs of one to four parts, level by level: a run is counted where both runs one part shorter are kept.
_SUPPORT = {
    "places": "SELECT entity, singles, unnest(range(1, len(singles) + 1)) AS i FROM arch",
    "run1": "SELECT entity, i, singles[i] AS feature FROM places",
    "keep1": "SELECT feature, count(DISTINCT entity) AS n FROM run1 GROUP BY feature",
} | {
    name: text
    for n in (2, 3, 4)
    for name, text in (
        (f"run{n}", f"SELECT p.entity, p.i, array_to_string(p.singles[p.i : p.i + {n - 1}], ',') AS feature FROM places p JOIN run{n - 1} x ON x.entity = p.entity AND x.i = p.i JOIN run{n - 1} y ON y.entity = p.entity AND y.i = p.i + 1 WHERE x.feature IN (SELECT feature FROM keep{n - 1} WHERE n >= 3) AND y.feature IN (SELECT feature FROM keep{n - 1} WHERE n >= 3)"),
        (f"keep{n}", f"SELECT feature, count(DISTINCT entity) AS n FROM run{n} GROUP BY feature"),
    )
}


def _step_down(alpha: float) -> tuple[str, dict[str, str]]:
    """Levels of runs, each with its opened pairs, their tests and the step-up procedure."""
    out = {"mt1": "SELECT term, count(*) AS m FROM et GROUP BY term"}
    for n in (1, 2, 3):
        out[f"f{n}"] = f"SELECT entity, feature, string_split(feature, ',') AS parts FROM feats WHERE len(string_split(feature, ',')) = {n}"
        out[f"k{n}"] = f"SELECT feature, any_value(parts) AS parts, count(*) AS k FROM f{n} GROUP BY feature"
        out[f"c{n}"] = f"SELECT feature, term, count(*) AS a FROM f{n} JOIN et USING (entity) GROUP BY ALL"
        if n == 1:
            out["o1"] = "SELECT feature, term, a FROM c1"
            total = "(SELECT count(*) FROM k1) * (SELECT count(*) FROM mt1)"
        else:
            ends = [f"array_to_string(k{n}.parts[{a}:{b}], ',')" for a, b in ((1, n - 1), (2, n))]
            out[f"o{n}"] = f"SELECT k{n}.feature, x.term, coalesce(c.a, 0) AS a FROM k{n} JOIN r{n - 1} x ON x.feature = {ends[0]} JOIN r{n - 1} y ON y.feature = {ends[1]} AND y.term = x.term LEFT JOIN c{n} c ON c.feature = k{n}.feature AND c.term = x.term"
            total = f"(SELECT count(*) FROM o{n})"
        out[f"p{n}"] = f"SELECT *, CASE WHEN a = 0 THEN 1.0 ELSE {_tail('a', 'least(k, m)')} END AS p FROM o{n} JOIN k{n} USING (feature) JOIN mt1 USING (term) CROSS JOIN un"
        out[f"l{n}"] = f"SELECT p, sum(count(*)) OVER (ORDER BY p) AS r FROM p{n} GROUP BY p"
        out[f"q{n}"] = f"SELECT p, least(1.0, min(p * {total} / r) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM l{n}"
        out[f"all{n}"] = f"SELECT feature, term, CAST({n} AS BIGINT) AS level, a, p{n}.p, q FROM p{n} JOIN q{n} ON p{n}.p = q{n}.p"
        out[f"r{n}"] = f"SELECT feature, term FROM all{n} WHERE q <= {alpha}"
    every = " UNION ALL ".join(f"SELECT * FROM all{n}" for n in (1, 2, 3))
    return f"SELECT feature, term, level, a, {_logp('p')} AS neg_log10_p, {_logp('q')} AS neg_log10_q, q <= {alpha} AS rejected FROM ({every})", out


SQL: dict[str, str] = {
    "cooccurrence": _with("pairs", "SELECT * FROM pairs"),
    "feature_marginals": _with("kf", "SELECT * FROM kf"),
    "term_marginals": _with("mt", "SELECT * FROM mt"),
    "universe": _with("un", "SELECT * FROM un"),
    "contingency": _with("cells", "SELECT feature, term, a, b, c, d FROM cells"),
    "contingency_composites": _with("feats et", "SELECT feature, term, a, k - a AS b, m - a AS c, n - k - m + a AS d FROM p3 JOIN k3 USING (feature) JOIN m3 USING (term) CROSS JOIN u3",
        p3="SELECT feature, term, count(*) AS a FROM feats JOIN et USING (entity) GROUP BY ALL", k3="SELECT feature, count(*) AS k FROM feats GROUP BY feature",
        m3="SELECT term, count(*) AS m FROM et GROUP BY term", u3="SELECT count(DISTINCT entity) AS n FROM (SELECT entity FROM feats UNION ALL SELECT entity FROM et)"),
    "fisher_greater": _with("t", f"SELECT feature, term, {_logp('p')} AS neg_log10_p FROM t"),
    "fisher_less": _with("cells", f"SELECT feature, term, {_logp(_tail('greatest(0, k + m - n)', 'a'))} AS neg_log10_p FROM cells"),
    "fisher_two_sided": _with("cells", f"""SELECT feature, term, {_logp("least(1.0, list_sum(list_filter(list_transform(range(greatest(0, k + m - n), least(k, m) + 1), lambda x: " + _point('x') + "), lambda y: y <= here * (1 + 1e-7))))")} AS neg_log10_p
        FROM (SELECT *, {_point('a')} AS here FROM cells)"""),
    "odds_ratios": _with("cells", "SELECT feature, term, CASE WHEN b * c <> 0 THEN round(CAST(a * d AS DOUBLE) / (b * c), 8) END AS odds_ratio, b * c = 0 AS unbounded FROM cells"),
    "hyper_score": _with("s", f"SELECT feature, term, {_SCORE} AS hyper_score FROM s"),
    "bh_adjust": _with("adj", f"SELECT feature, term, {_logp('q')} AS neg_log10_q FROM adj"),
    "bh_threshold": _with("adj", f"SELECT {_logp('coalesce(max(p) FILTER (WHERE q <= 0.2), 0.0)')} AS neg_log10_threshold FROM adj"),
    "significant": _with("adj", f"SELECT feature, term, a, b, c, d, {_logp('p')} AS neg_log10_p, {_logp('q')} AS neg_log10_q FROM adj WHERE q <= 0.2"),
    "top_k": _with("t", f"SELECT CAST(row_number() OVER (ORDER BY p, feature, term) AS INT) AS rank, feature, term, {_logp('p')} AS neg_log10_p FROM t QUALIFY rank <= 100"),
    "architectures": _with("arch comp", "SELECT arch.entity, array_to_string(singles, ',') AS singles, (SELECT count(*) FROM comp WHERE comp.entity = arch.entity) AS n_composites FROM arch"),
    "supra_generation": _with("comp", "SELECT feature, count(*) AS n_occurrences, count(DISTINCT entity) AS n_entities FROM comp GROUP BY feature"),
    "feature_meta": _with("meta", "SELECT feature, CASE parts WHEN 1 THEN 'single' WHEN 2 THEN 'supra_pair' ELSE 'supra_triple' END AS feature_type, CAST(CASE WHEN parts > 1 THEN parts ELSE 0 END AS BIGINT) AS n_parts, n_obs FROM meta"),
    "type_counts": _with("meta", "SELECT CASE parts WHEN 1 THEN 'single' WHEN 2 THEN 'supra_pair' ELSE 'supra_triple' END AS feature_type, count(*) AS n_features, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM meta GROUP BY 1"),
    "top_features": _with("occ", "SELECT feature, count(*) AS n_occurrences FROM occ GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 10"),
    "feature_coverage": _with("arch comp", "SELECT count(*) AS n_entities, count(*) FILTER (WHERE len(singles) >= 2) AS n_multi, round(100.0 * count(*) FILTER (WHERE len(singles) >= 2) / count(*), 8) AS pct_multi, CAST(sum(len(singles)) AS BIGINT) AS n_singles, (SELECT count(*) FROM comp) AS n_composites FROM arch"),
    "evidence_filter": _with("ann", "SELECT term, count(DISTINCT entity) AS n FROM ann WHERE evidence IN ('R', 'A') AND aspect IN ('O', 'F') GROUP BY term"),
    "aspect_filter": _with("ann", "SELECT term, count(DISTINCT entity) AS n FROM ann WHERE aspect = 'O' GROUP BY term"),
    "qualifier_filter": _with("ann", "SELECT term, count(DISTINCT entity) AS n FROM ann WHERE NOT coalesce(contains(upper(qualifier), 'NOT'), false) AND aspect IN ('O', 'F') GROUP BY term"),
    "disposition_counts": _with("ann", f"SELECT {_CASE} AS disposition, count(*) AS n FROM ann GROUP BY 1"),
    "evidence_distribution": _with("ann", "SELECT evidence, count(*) AS n FROM ann GROUP BY evidence ORDER BY n DESC, evidence LIMIT 10"),
    "entity_allowlist": _with("occ", "SELECT feature, count(*) AS n, count(DISTINCT entity) AS n_entities FROM occ WHERE entity IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY feature"),
    "min_length": _with("occ", "SELECT feature, count(*) AS n FROM occ WHERE part - position + 1 >= 100 GROUP BY feature"),
    "prefix_filter": _with("occ", "SELECT feature, count(*) AS n FROM occ WHERE starts_with(feature, 'Brand#2') OR starts_with(feature, 'Brand#11') GROUP BY feature"),
    "max_entities": _with("occ", "SELECT entity, position, part, feature FROM numbered WHERE o < coalesce((SELECT f FROM firsts QUALIFY row_number() OVER (ORDER BY f) = 51), 1 << 60)",
        numbered="SELECT *, rank() OVER (ORDER BY part, position, entity) AS o FROM occ", firsts="SELECT entity, min(o) AS f FROM numbered GROUP BY entity"),
    "term_lookup": _with("et", "SELECT entity FROM et WHERE term = 'blue anvil'"),
    "both_annotated": _with("ef ann", "SELECT feature, count(*) AS k FROM ef WHERE entity IN (SELECT entity FROM ann WHERE evidence IN ('R', 'A') AND aspect = 'O') GROUP BY feature"),
    "shrink_pvalues": _with("feats et mt un", f"SELECT feature, term, a, {_logp('p_raw')} AS neg_log10_raw, {_logp('prior')} AS neg_log10_prior, {_logp('p')} AS neg_log10_p FROM sh WHERE contains(feature, ',')", **_shrunk()),
    "shrink_stats": _with("feats et mt un", """SELECT CAST(count(*) AS BIGINT) AS n_composite_tests, count(*) FILTER (WHERE p > p_raw) AS n_increased, round(100.0 * count(*) FILTER (WHERE p > p_raw) / count(*), 4) AS pct_increased,
        round(median(p / p_raw), 4) AS median_ratio, count(*) FILTER (WHERE p_raw < 0.01 AND p >= 0.01) AS lost, count(*) FILTER (WHERE p_raw >= 0.01 AND p < 0.01) AS gained
        FROM (SELECT greatest(round(p_raw, 7), 1e-323) AS p_raw, greatest(round(p, 7), 1e-323) AS p FROM sh WHERE contains(feature, ','))""", **_shrunk()),
    "closure": _with("paths", "SELECT term, ancestor, CAST(depth AS BIGINT) AS depth FROM paths"),
    "closure_to_leaf": _with("paths", "SELECT ancestor AS term, count(*) AS n_descendants FROM paths GROUP BY ancestor"),
    "ancestor_counts": _with("terms paths", "SELECT term, namespace, (SELECT count(*) FROM edges WHERE child = term) AS n_parents, (SELECT count(*) FROM edges WHERE parent = term) AS n_children, (SELECT count(*) FROM paths p WHERE p.term = terms.term) AS n_ancestors, (SELECT count(*) FROM paths p WHERE p.ancestor = terms.term) AS n_descendants FROM terms"),
    "ontology_stats": _with("terms paths", """SELECT (SELECT count(*) FROM terms) AS n_terms, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM terms WHERE term NOT IN (SELECT child FROM edges)) AS n_roots,
        (SELECT count(*) FROM leaf) AS n_leaves, CAST(max(depth) AS BIGINT) AS max_depth, round(avg(depth), 8) AS avg_depth FROM (SELECT depth FROM paths WHERE term IN (SELECT term FROM leaf) UNION ALL SELECT 0 FROM leaf)""",
        leaf="SELECT term FROM terms WHERE term NOT IN (SELECT parent FROM edges)"),
    "namespace_counts": _with("terms", "SELECT namespace, count(*) AS n_terms FROM terms GROUP BY namespace"),
    "optimal_level": _with("adj own ef", f"SELECT feature, term, next, background, af, ac, afc, {_logp('p')} AS neg_log10_p FROM lev", **_LEVEL),
    "optimal_level_kept": _with("adj own ef", "SELECT feature, term FROM big EXCEPT SELECT feature, term FROM lev WHERE background < 3 OR NOT p < 0.05", **_LEVEL),
    "propagate": _with("store", f"SELECT feature, term, kind AS annotation_type, source AS direct_source_term, {_SCORE} AS association_score FROM store"),
    "validate_annotations": _with("store terms", """SELECT count(*) AS total, count(*) FILTER (WHERE term <> 'ROOT') AS valid, count(*) FILTER (WHERE term = 'ROOT') AS invalid_terms, CAST(0 AS BIGINT) AS invalid_scores, CAST(0 AS BIGINT) AS invalid_q_values, CAST(0 AS BIGINT) AS duplicate_pairs,
        (SELECT count(DISTINCT source) FROM store WHERE kind = 'propagated' AND source NOT IN (SELECT term FROM store WHERE kind = 'direct')) AS consistency_errors FROM store"""),
    "annotation_summary": _with("store", f"SELECT kind AS annotation_type, count(*) AS n, count(DISTINCT feature) AS n_features, count(DISTINCT term) AS n_terms, round(avg(score), 3) + 0.0 AS avg_score, {_logp('min(q)')} AS neg_log10_min_q, {_logp('max(q)')} AS neg_log10_max_q FROM store GROUP BY kind"),
    "store_summary": _with("store", "SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'direct') AS n_direct, count(*) FILTER (WHERE kind = 'propagated') AS n_propagated, count(DISTINCT feature) AS n_features, count(DISTINCT term) AS n_terms, count(DISTINCT source) AS n_sources, round(min(score), 3) + 0.0 AS min_score, round(max(score), 3) + 0.0 AS max_score, round(avg(score), 3) + 0.0 AS avg_score FROM store"),
    "query_annotations": _with("store", f"SELECT feature, source AS direct_source_term, {_SCORE} AS association_score FROM store WHERE term = 'ROOT' AND kind = 'propagated'"),
    "export_filter": _with("store", f"SELECT feature, term, {_SCORE} AS association_score FROM store WHERE kind = 'direct' AND score >= 20 AND q <= 0.1"),
    "top_direct": _with("store", f"SELECT feature, term, {_SCORE} AS association_score FROM store WHERE kind = 'direct' ORDER BY score DESC, q, feature, term LIMIT 10"),
    "top_annotated_terms": _with("store", "SELECT term, count(*) AS n FROM store GROUP BY term ORDER BY n DESC, term LIMIT 10"),
    "top_annotated_features": _with("store", "SELECT feature, count(*) AS n FROM store GROUP BY feature ORDER BY n DESC, feature LIMIT 10"),
    "constraint_violations": _with("store", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT starts_with(term, 'b') THEN 'term id' WHEN term = 'ROOT' THEN 'score' END AS reason FROM store) WHERE reason IS NOT NULL GROUP BY reason"),
    "precision_recall": _with("pred gold", f"""SELECT np AS n_predicted, tp AS true_positives, ng AS n_gold, np - tp AS false_positives, ng - tp AS false_negatives, round(precision, 8) AS precision, round(recall, 8) AS recall, round({_F1}, 8) AS f1
        FROM (SELECT *, {_PRF} FROM (SELECT (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM pred SEMI JOIN gold USING (feature, term)) AS tp, (SELECT count(*) FROM gold) AS ng))"""),
    "threshold_sweep": _with("adj gold", "SELECT ordinal, criterion, threshold, np AS n_predicted, tp AS true_positives, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM sweep", **_SWEEP),
    "best_threshold": _with("adj gold", "SELECT ordinal, criterion, threshold, round(f1, 8) AS f1 FROM sweep ORDER BY f1 DESC, ordinal LIMIT 1", **_SWEEP),
    "novel_topk": _with("adj gold", f"SELECT feature, term, {_SCORE} AS hyper_score FROM adj ANTI JOIN gold USING (feature, term) ORDER BY score DESC, p, feature, term LIMIT 50"),
    "gold_overlap": _with("pred gold", "SELECT 'common' AS part, count(*) AS n FROM pred SEMI JOIN gold USING (feature, term) UNION ALL SELECT 'novel', count(*) FROM pred ANTI JOIN gold USING (feature, term) UNION ALL SELECT 'missed', count(*) FROM gold ANTI JOIN pred USING (feature, term)"),
    "architecture_statistics": _with("astat", "SELECT feature, n_total, n_single, n_multi, round(n_single / n_total, 8) AS fraction_single FROM astat"),
    "architecture_contribution": _with("contrib", "SELECT feature, term, n_total, n_single, round(fraction, 8) AS fraction_single FROM contrib"),
    "contribution_summary": _with("contrib", "SELECT count(*) AS n, round(coalesce(avg(fraction), 0.0), 8) AS mean_fraction, coalesce(median(n_total), 0.0) AS median_entities FROM contrib"),
    "composition_report": _with("meta", "SELECT CASE parts WHEN 1 THEN 'single' WHEN 2 THEN 'supra_pair' ELSE 'supra_triple' END AS feature_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM meta), 8) AS pct FROM meta GROUP BY 1"),
    "full_pipeline": _with("feats et mt un own paths", f"""SELECT coalesce(h.feature, x.feature) AS feature, coalesce(h.term, x.term) AS term, a, CASE WHEN h.p IS NOT NULL THEN {_logp('p')} END AS neg_log10_p, CASE WHEN h.p IS NOT NULL THEN {_logp('q')} END AS neg_log10_q,
        x.annotation_type, x.direct_source_term, {_SCORE.replace('score', 'x.score')} AS association_score FROM hit h FULL JOIN noted x ON h.feature = x.feature AND h.term = x.term""", **_shrunk(), **_WHOLE),
}
_select, _parts = _step_down(0.6)
SQL["step_down"] = _with("feats et un", _select, **_parts)
SQL["supported_composites"] = _with("arch comp", "SELECT feature, count(DISTINCT entity) AS n_entities FROM (SELECT entity, array_to_string(list_slice(singles, i, i + n - 1), ',') AS feature FROM (SELECT entity, singles, n, unnest(range(1, len(singles) - n + 2)) AS i FROM arch, (VALUES (2), (3), (4)) AS v(n))) GROUP BY feature HAVING n_entities >= 3")
SQL["support_levels"] = _with("arch", " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS n_parts, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS n_candidates, count(*) FILTER (WHERE n >= 3) AS n_kept FROM keep{n}" for n in (1, 2, 3, 4)), **_SUPPORT)
SQL["score_quartiles"] = _with("s", " UNION ALL ".join(f"SELECT '{name}' AS name, " + ", ".join(f"round(quantile_cont({x}, {q}), 4) + 0.0 AS {c}" for c, q in (("least", 0), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("most", 1))) + " FROM s" for name, x in (("neg_log10_p", "-log10(greatest(p, 1e-300))"), ("cooccurrences", "CAST(a AS DOUBLE)"), ("hyper_score", "score"))))
_CYCLES = {
    "ring": "SELECT child, parent FROM edges WHERE parent <> 'ROOT' UNION SELECT string_split(p_name, ' ')[2], p_name FROM part WHERE substr(p_name, 1, 1) IN ('a', 'b', 'c', 'd', 'e', 'f')",
    "reach": "SELECT child AS term, parent AS ancestor FROM ring UNION SELECT reach.term, ring.parent FROM reach JOIN ring ON reach.ancestor = ring.child",
    "mutual": "SELECT x.term, x.ancestor FROM reach x JOIN reach y ON y.term = x.ancestor AND y.ancestor = x.term",
    "cyc": "SELECT term, min(ancestor) AS cycle, count(*) AS n_terms FROM mutual GROUP BY term",
}
SQL["ontology_cycles"] = _with("edges", "SELECT * FROM cyc", **_CYCLES)
SQL["acyclic_check"] = _with("edges", """SELECT 'ontology' AS edges, true AS is_acyclic, (SELECT count(*) FROM (SELECT child FROM edges UNION SELECT parent FROM edges)) AS n_terms, (SELECT count(*) FROM edges) AS n_edges, CAST(0 AS BIGINT) AS n_cyclic, CAST(0 AS BIGINT) AS n_cycles
    UNION ALL SELECT 'names', (SELECT count(*) FROM cyc) = 0, (SELECT count(*) FROM (SELECT child FROM edges WHERE parent <> 'ROOT' UNION SELECT parent FROM edges WHERE parent <> 'ROOT')),
        (SELECT count(*) FROM edges WHERE parent <> 'ROOT') + (SELECT count(DISTINCT p_name) FROM part WHERE substr(p_name, 1, 1) IN ('a', 'b', 'c', 'd', 'e', 'f')), (SELECT count(*) FROM cyc), (SELECT count(DISTINCT cycle) FROM cyc)""", **_CYCLES)
#: The names of round one for the queries on runs of up to three features.
SQL |= {f"{name}_whole": SQL[name] for name in ("shrink_pvalues", "shrink_stats", "full_pipeline")}

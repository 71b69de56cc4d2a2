"""The results of the queries that SQL can express, as DuckDB statements over the same tables."""

from .quality_rules import BOILERPLATE, BRIEF, CLOSING, ENDLESS, MENU, SENTENCE, SEPARATORS

_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORD = r"[^\x20\x09-\x0D]+"
_MARKS = ", ".join(f"'{x}'" for x in SEPARATORS)
_PHRASES = "|".join(BOILERPLATE).replace("'", "''")
_LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ENDS = (SENTENCE + CLOSING).replace("'", "''")

SQL: dict[str, str] = {
    "op2_line_dedup": f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
frequent AS (
    SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.owner AS gone
    FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, hex,
             array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST(list_reduce(list_prepend(0, list_transform(range(0, 5), lambda k:
                     (instr('0123456789abcdef', substr(hex, CAST((i * 5 + k) // 4 + 1 AS INT), 1)) - 1) // CAST(pow(2, 3 - (i * 5 + k) % 4) AS INT) % 2)),
                     lambda a, x: a * 2 + x) AS INT) + 1, 1)), '') AS payload_digest
      FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f""",
    "op9_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (
    SELECT doc_id, pos, line, regexp_extract_all(line, '{_WORD}') AS w,
           length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
           length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
           len(regexp_extract_all(line, '!!')) AS bangs,
           length(regexp_replace(line, '[^A-Z]', '', 'g')) AS ups, length(regexp_replace(line, '[^a-z]', '', 'g')) AS lows,
           length(translate(line, '{SENTENCE}', '')) < length(line) AS sentence
    FROM lines),
h AS (SELECT *, len(w) < {BRIEF} AND instr('{_ENDS}', right(w[-1], 1)) = 0 AS brief FROM l WHERE len(w) > 0),
k AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, brief ORDER BY pos) AS island
    FROM h),
f AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
           10 * symbols > chars OR 3 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > len(w) OR 3 * bangs > len(w) OR (len(w) >= 5 AND 10 * ups > 7 * (ups + lows))
           OR 4 * len(list_filter(w, lambda x: x IN ({_MARKS}))) >= len(w) OR regexp_matches({_LOWER}, '{_PHRASES}')
           OR (len(w) >= {ENDLESS} AND NOT sentence) OR (brief AND count(*) OVER (PARTITION BY doc_id, brief, island) >= {MENU}) AS bad
    FROM k),
g AS (
    SELECT doc_id, sum(chars) AS word_chars, sum(symbols) AS n_symbols, sum(CAST(dup AS INT)) AS n_dup_lines,
           sum(CAST(bad OR dup AS INT)) AS n_failed_lines, sum(CASE WHEN bad OR dup THEN chars ELSE 0 END) AS lost_chars
    FROM f GROUP BY doc_id),
m AS (
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
           CAST(coalesce(n_symbols, 0) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
           CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
    FROM d LEFT JOIN g USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM b""",
}

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(n_chars: str) -> str:
    """H of a row of documents, with that expression for n_chars."""
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(f'''coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')''' for v in values)})"


#: crc32 of a decimal: each character is combined, then eight shifts follow it (-1).
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda k: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""


def _climb(name: str, start: str) -> str:
    return f"""{name} AS (
    SELECT lang, 0 AS l, i, h, n FROM {start}
    UNION ALL SELECT lang, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY lang, l, i // 2, n)"""


def _fold(name: str, start: str, nodes: str) -> str:
    return f"""{name} AS (
    SELECT r, lang, 0 AS l, i, n, cur, proof FROM {start}
    UNION ALL SELECT f.r, f.lang, f.l + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.cur ELSE f.cur || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
    FROM {name} f LEFT JOIN {nodes} s ON s.lang IS NOT DISTINCT FROM f.lang AND s.l = f.l AND s.i = xor(f.i, 1) WHERE f.n > 1)"""


SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS h, {_leaf('n_chars + 1')} AS changed, {_CRC} % 7 = 0 AS tampered FROM documents),
leaf AS (
    SELECT doc_id, lang, h, CASE WHEN tampered THEN changed ELSE h END AS cur, '' AS proof, row_number() OVER () AS r,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
    FROM d),
{_climb('node', 'leaf')},
sub AS (SELECT lang AS of, NULL AS lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
{_climb('top', 'sub')},
{_fold('up', 'leaf', 'node')},
met AS (SELECT r, NULL AS lang, sub.i, sub.n, cur, proof FROM up JOIN sub ON sub.of IS NOT DISTINCT FROM up.lang WHERE up.n = 1),
{_fold('on_', 'met', 'top')},
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, root, sha256(on_.proof) AS proof_sha256, on_.cur AS folded_root, on_.cur = root AS verified
FROM leaf JOIN on_ ON on_.r = leaf.r AND on_.n = 1 JOIN sub ON sub.of IS NOT DISTINCT FROM leaf.lang CROSS JOIN root"""

SQL["op13_ranked_search"] = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format('text')}, '{_TERM}')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM len),
post AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post CROSS JOIN total GROUP BY term, docs),
q AS (SELECT item_id, unnest(regexp_extract_all({_ASCII_LOWER.format('text')}, '{_TERM}')) AS term FROM benchmark),
s AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score
    FROM q JOIN post USING (term) JOIN weight USING (term) JOIN len USING (doc_id) CROSS JOIN total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""

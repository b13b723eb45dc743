"""SQL twins of the operators that SQL can express, for DuckDB over the test tables."""

from lanelytics.llm import licenses

NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LINES = r"list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"


def _half(histogram: str, by: str) -> str:
    """Least value of each group up to which half of the rows lie."""
    return f"""SELECT {by}, min(value) AS half FROM (
    SELECT *, sum(rows) OVER (PARTITION BY {by} ORDER BY value) AS running, sum(rows) OVER (PARTITION BY {by}) AS total
    FROM ({histogram})
  ) WHERE 2 * running >= total GROUP BY ALL"""


#: Factors of a covariance c by square roots left out, each variance held at the square of its least deviation or above.
_DECOMPOSED = """greatest(c11, 10000::DOUBLE) AS d1, c12 / d1 AS l21, c13 / d1 AS l31, c14 / d1 AS l41,
    greatest(c22 - l21 * l21 * d1, 1600::DOUBLE) AS d2, (c23 - l31 * l21 * d1) / d2 AS l32, (c24 - l41 * l21 * d1) / d2 AS l42,
    greatest(c33 - l31 * l31 * d1 - l32 * l32 * d2, 16900::DOUBLE) AS d3,
    (c34 - l41 * l31 * d1 - l42 * l32 * d2) / d3 AS l43,
    greatest(c44 - l41 * l41 * d1 - l42 * l42 * d2 - l43 * l43 * d3, 16900::DOUBLE) AS d4"""
_SQUARE = """z1 - m1 AS y1, z2 - m2 - l21 * y1 AS y2, z3 - m3 - l31 * y1 - l32 * y2 AS y3,
    z4 - m4 - l41 * y1 - l42 * y2 - l43 * y3 AS y4, y1 * y1 / d1 + y2 * y2 / d2 + y3 * y3 / d3 + y4 * y4 / d4 AS square"""


def _moments(source: str, by: str, scale: str) -> str:
    """Means and scaled covariances of z1 to z4 and their factors, for each group of the source."""
    pairs = [(i, j) for i in range(1, 5) for j in range(i, 5)]
    sums = ", ".join(f"CAST(sum(z{i}) AS DOUBLE) AS s{i}" for i in range(1, 5))
    products = ", ".join(f"CAST(sum(z{i} * z{j}) AS DOUBLE) AS s{i}{j}" for i, j in pairs)
    means = ", ".join(f"s{i} / n AS m{i}" for i in range(1, 5))
    terms = ", ".join(f"{scale}::DOUBLE * (s{i}{j} / n - m{i} * m{j}) AS c{i}{j}" for i, j in pairs)
    return f"SELECT *, {means}, {terms}, {_DECOMPOSED} FROM (SELECT {by}, count(*) AS n, {sums}, {products} FROM {source} GROUP BY ALL)"


def _quality() -> str:
    kept = "grp, start, m1, m2, m3, m4, d1, d2, d3, d4, l21, l31, l41, l32, l42, l43"
    zeros = "0::DOUBLE AS c12, 0::DOUBLE AS c13, 0::DOUBLE AS c14, 0::DOUBLE AS c23, 0::DOUBLE AS c24, 0::DOUBLE AS c34"
    least = "10000::DOUBLE AS c11, 1600::DOUBLE AS c22, 16900::DOUBLE AS c33, 16900::DOUBLE AS c44"
    robust = ", ".join(f"pow(1.4826::DOUBLE * s{i}, 2) AS c{i}{i}" for i in range(1, 5))
    middles = lambda values, prefix: (
        "SELECT grp, " + ", ".join(f"max(half) FILTER (place = {i}) AS {prefix}{i}" for i in range(1, 5))
        + " FROM ("
        + _half(f"SELECT grp, place, value, count(*) AS rows FROM ({values}) GROUP BY ALL", "grp, place")
        + ") GROUP BY grp"
    )
    values = " UNION ALL ".join(f"SELECT grp, {i} AS place, z{i} AS value FROM vec" for i in range(1, 5))
    apart = " UNION ALL ".join(f"SELECT grp, {i} AS place, abs(z{i} - m{i}) AS value FROM vec JOIN med USING (grp)" for i in range(1, 5))
    steps = [
        f"med AS MATERIALIZED ({middles(values, 'm')})",
        f"mad AS MATERIALIZED ({middles(apart, 's')})",
        f"""p0 AS MATERIALIZED (
  SELECT {kept} FROM (SELECT *, 1 AS start, {least}, {zeros}, {_DECOMPOSED} FROM med)
  UNION ALL SELECT {kept} FROM (SELECT *, 2 AS start, {robust}, {zeros}, {_DECOMPOSED} FROM med JOIN mad USING (grp))
  UNION ALL SELECT {kept} FROM (SELECT *, 3 AS start FROM ({_moments("vec", "grp", "1")})))""",
    ]
    for i in range(8):  # more steps than any group of the tables takes until its half stays the same
        steps += [
            f"d{i} AS MATERIALIZED (SELECT *, least(CAST(floor(100 * sqrt(square)) AS BIGINT), 5000) AS value FROM ("
            f"SELECT vec.*, p.* EXCLUDE (grp), {_SQUARE} FROM vec JOIN p{i} p USING (grp)))",
            f"h{i} AS MATERIALIZED ({_half(f'SELECT grp, start, value, count(*) AS rows FROM d{i} GROUP BY ALL', 'grp, start')})",
            f"n{i} AS (SELECT grp, start, z1, z2, z3, z4 FROM d{i} JOIN h{i} USING (grp, start) WHERE value <= half)",
            f"p{i + 1} AS MATERIALIZED (SELECT {kept} FROM ({_moments(f'n{i}', 'grp, start', '2.109')}))",
        ]
    steps.append(
        "best AS (SELECT * FROM p8 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY d1 * d2 * d3 * d4, start) = 1)"
    )
    vectors = """CAST(round(1000 * ln(word_chars / n_words)) AS BIGINT) AS z1,
    CAST(round(1000 * sqrt(n_symbols / word_chars)) AS BIGINT) AS z2,
    CAST(round(1000 * sqrt(n_dup_lines / n_lines)) AS BIGINT) AS z3,
    CAST(round(1000 * sqrt(n_repeat_words / n_words)) AS BIGINT) AS z4"""
    counts = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    return f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS} AS words, {_LINES} AS lines FROM raw),
tri AS (
  SELECT r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS t
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
twice AS (SELECT r, t FROM tri GROUP BY r, t HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM tri JOIN twice USING (r, t), (VALUES (0), (1), (2)) o(k) GROUP BY r),
base AS (
  SELECT w.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
),
judged AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
vec AS MATERIALIZED (
  SELECT doc_id, {counts}, {vectors},
    CASE WHEN count(*) OVER (PARTITION BY lang, source) < 30 THEN {{'l': lang, 's': '', 'pool': true}}
      ELSE {{'l': lang, 's': source, 'pool': false}} END AS grp
  FROM judged WHERE NOT base_failed
),
{", ".join(steps)}
SELECT doc_id, {counts}, FALSE AS base_failed, square <= 28.47::DOUBLE AS kept FROM (
  SELECT vec.*, {_SQUARE} FROM vec JOIN best USING (grp))
UNION ALL SELECT doc_id, {counts}, TRUE, FALSE FROM judged WHERE base_failed
"""


def _licenses() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    notices = ", ".join(f"({quoted(name)}, {n}, {quoted(text)})" for name, n, text in licenses.wordings())
    ends = ", ".join(f"({n}, '{end}')" for n, end in enumerate(licenses.TAG_ENDS))
    like = lambda text, pattern: f"regexp_matches({text}, '{pattern.replace('(?i)', '')}', 'i')"
    states = lambda text: like(text, licenses.STATEMENT)
    words = lambda text: f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"
    passage = lambda text: f"array_to_string(regexp_extract_all(lower({text}), '{licenses.TERM}'), ' ')"
    return f"""
WITH files AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(CAST(doc_id // 1000 AS VARCHAR), ''),
    CAST(doc_id AS VARCHAR)) AS path
  FROM documents
), placed AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS directory FROM files),
base AS (
  SELECT path, text, {words("text")} AS of_words, string_split(text, chr(10)) AS lines,
    {like("path", licenses.CODE)} AS code, {like("path", licenses.NAMED)} AS named FROM files WHERE {states("text")}
), blocks AS (
  SELECT *, list_concat(
      string_split(array_to_string(list_transform(lines, lambda l: CASE WHEN regexp_matches(l, '{licenses.COMMENT}') THEN l ELSE chr(2) END), chr(10)), chr(2)),
      list_transform(list_filter(string_split(text, '/*')[2:], lambda p: contains(p, '*/')), lambda p: split_part(p, '*/', 1))) AS comments,
    CASE WHEN (named OR {like("text", licenses.WORDING)}) AND NOT code THEN [text] ELSE [] END AS whole FROM base
), stated AS (
  SELECT path, named, code, of_words, 'line' AS kind, l AS t, NULL AS tag,
    CASE WHEN regexp_matches(l, '{licenses.COMMENT}') THEN 0 ELSE {words("l")} END AS n_words
  FROM (SELECT *, unnest(lines) AS l FROM base) WHERE {states("l")} AND NOT contains(lower(l), 'spdx-license-identifier')
  UNION ALL
  SELECT path, named, code, of_words, 'part', t, NULL, 0 FROM (SELECT *, unnest(comments) AS t FROM blocks) WHERE {states("t")}
  UNION ALL
  SELECT path, named, code, of_words, 'part', t, NULL, 0
  FROM (SELECT *, unnest(regexp_split_to_array(b, '{licenses.BETWEEN}')) AS t
    FROM (SELECT *, unnest(list_concat(comments, whole)) AS b FROM blocks) WHERE {states("b")}) WHERE {states("t")}
  UNION ALL
  SELECT path, named, code, of_words, 'whole', unnest(whole), NULL, 0 FROM blocks
  UNION ALL
  SELECT path, named, code, of_words, 'tag', NULL, unnest(regexp_extract_all(lower(text), '{licenses.TAG}', 1)), 0 FROM base
), units AS (SELECT *, coalesce('spdx:' || tag, {passage("t")}) AS line FROM stated WHERE line <> ''),
lines AS (SELECT DISTINCT line FROM units),
notices(license, number, t) AS (VALUES {notices}), ends(number, e) AS (VALUES {ends}),
templates AS (
  SELECT license, number, {passage("t")} AS line FROM notices
  UNION ALL SELECT license, -1 - number, 'spdx:' || lower(license) || e FROM (SELECT DISTINCT license FROM notices) CROSS JOIN ends
),
lt AS (SELECT line, t AS term, 1 + ln(count(*)) AS times FROM (SELECT line, unnest(string_split(line, ' ')) AS t FROM lines) GROUP BY ALL),
tt AS (SELECT license, number, t AS term, 1 + ln(count(*)) AS times
  FROM (SELECT license, number, unnest(string_split(line, ' ')) AS t FROM templates) GROUP BY ALL),
idf AS (
  SELECT term, ln((1 + (SELECT count(*) FROM lines) + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf
  FROM (SELECT term FROM lt UNION ALL SELECT term FROM tt) GROUP BY term
),
lw AS (SELECT line, term, times * idf / sqrt(sum(times * idf * times * idf) OVER (PARTITION BY line)) AS w FROM lt JOIN idf USING (term)),
tw AS (SELECT license, number, term, times * idf / sqrt(sum(times * idf * times * idf) OVER (PARTITION BY license, number)) AS w
  FROM tt JOIN idf USING (term)),
near AS (SELECT line, license, number, round(sum(lw.w * tw.w), 6) AS score FROM lw JOIN tw USING (term)
  GROUP BY ALL HAVING score >= {licenses.LEAST}),
found AS (SELECT line, license, score FROM near QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
own AS (
  SELECT path, first(license ORDER BY score DESC, license) AS own_license, max(score) AS own_score,
    NOT any_value(code) AND (any_value(named) OR bool_or(kind = 'whole') OR sum(n_words) / max(of_words) >= {licenses.LICENSE_SHARE}) AS is_license_file
  FROM units JOIN found USING (line) GROUP BY path
),
speaking AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS above, first(own_license ORDER BY own_score DESC, path) AS inherited
  FROM own WHERE is_license_file GROUP BY ALL
),
up AS (
  SELECT directory, inherited, above FROM (SELECT DISTINCT directory FROM placed) d
  JOIN speaking ON above = '' OR directory = above OR starts_with(directory, above || '/')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(above) DESC) = 1
)
SELECT doc_id, path, own_license, own_score, coalesce(is_license_file, FALSE) AS is_license_file,
  coalesce(own_license, inherited) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from
FROM placed LEFT JOIN own USING (path) LEFT JOIN up USING (directory)
"""


LINES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS line FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN shared USING (key) GROUP BY r, doc_id
"""

FILL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), g AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS e1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS e2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d
), c AS (
  SELECT *, substring(text, 1, least(e1, e2)) AS p, substring(text, least(e1, e2) + 1, abs(e1 - e2)) AS m,
    substring(text, greatest(e1, e2) + 1) AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(e1, e2) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN abs(e1 - e2) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM c
"""

ORACLE: dict[str, str] = {"op3_vantage_point_trees": NEAREST, "op5_quality_rules": _quality(), "op9_licenses": _licenses(), "op12_line_dedup": LINES, "op13_fill_in_middle": FILL}

"""DuckDB SQL that must give the rows of the queries."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = rf"""
WITH d AS (
  SELECT doc_id, {WORDS} AS words FROM documents
), w AS (
  SELECT doc_id, p, array_to_string(words[p + 1 : p + 50], ' ') AS line
  FROM (SELECT doc_id, words, unnest(range(len(words) - 49)) AS p FROM d)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY line) AS first FROM w) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM twice, range(50) t(k)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS p FROM d
), g AS (
  SELECT doc_id, p, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), twice AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals
  FROM d LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 34 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
    + 32 * (word_chars > 14 * n_words)::BIGINT + 64 * (2 * n_letters < word_chars)::BIGINT + 128 * (2 * n_capitals > n_letters)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM f
"""

#: Rounds of resharing end when no further source is above; as many as there are sources suffice.
MIXING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), fill(i, level) AS (
  SELECT 0::BIGINT, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE - 2.0::DOUBLE * coalesce(sum(CASE WHEN level * weight > 2.0::DOUBLE * source_size THEN source_size END), 0)::DOUBLE)
                        / sum(CASE WHEN level * weight > 2.0::DOUBLE * source_size THEN 0 ELSE weight END)::DOUBLE FROM s)
  FROM fill WHERE i <= (SELECT count(*) FROM s)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT max_by(level, i) FROM fill) * weight) AS target FROM s
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM r
"""

#: Runs as islands of six-word windows that are equal at one distance; of equal stretches the least distance is the period.
PERIODIC_RUNS = rf"""
WITH h AS (
  SELECT DISTINCT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
         lambda x, c: list_reduce(list_prepend(xor(x, c), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS h
  FROM documents
), d AS (
  SELECT row_number() OVER () AS row, d.doc_id, {WORDS} AS words, len(words) AS n, h, h // 10 AS g
  FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, 1 + (n - a) // (3 + g % 8) AS p FROM d
), e AS (
  SELECT row, doc_id, n, CASE WHEN a IS NULL THEN words
         ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words
  FROM a
), w AS (
  SELECT row, unnest(range(n)) AS i, unnest(words) AS word FROM e
), six AS (
  SELECT row, i, array_to_string(words[i + 1 : i + 6], ' ') AS line FROM (SELECT row, words, unnest(range(n - 5)) AS i FROM e)
), pairs AS (
  SELECT x.row, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.row = y.row AND x.line = y.line AND x.i < y.i
), islands AS (
  SELECT row, q, min(i) AS start, max(i) + 6 + q - min(i) AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) GROUP BY row, q, island
), runs AS (
  SELECT row, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY row, start, length
), gone AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS line FROM w ANTI JOIN gone USING (row, i) GROUP BY row
), best AS (
  SELECT row, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS b,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start AS start, b.length AS length, b.period AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM e LEFT JOIN best USING (row) LEFT JOIN kept USING (row)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {TERMS} AS terms, len(terms)::BIGINT AS n FROM documents
), c AS (
  SELECT count(*) FILTER (n > 0)::BIGINT AS total, coalesce(sum(n), 0)::BIGINT AS length FROM d
), q AS (
  SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark
), tf AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term
), w AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, total
), s AS (
  SELECT item_id, doc_id, row, sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * total // length))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (row), c GROUP BY item_id, doc_id, row
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

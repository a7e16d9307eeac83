"""DuckDB twins of the queries that SQL can express."""

#: Phrase collocations, counted in full: the same definitions without activation.
_PHRASES = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents WHERE text IS NOT NULL))),
placed AS (SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM pieces),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM placed
  WINDOW p AS (PARTITION BY piece ORDER BY pos)),
one AS (SELECT lang, w1, count(*) AS c FROM runs GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS c FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS c FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM one GROUP BY lang),
around AS (
  SELECT lang, w1, w2, max(c) AS longer FROM (
    SELECT lang, w1, w2, c FROM three UNION ALL SELECT lang, w2, w3, c FROM three) GROUP BY ALL),
pairs AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, two.c AS a, x.c AS l, y.c AS r,
         (1000000::HUGEINT * two.c * two.c) // (x.c::HUGEINT * y.c) AS score
  FROM two JOIN one AS x ON x.lang = two.lang AND x.w1 = two.w1
  JOIN one AS y ON y.lang = two.lang AND y.w1 = two.w2
  LEFT JOIN around ON around.lang = two.lang AND around.w1 = two.w1 AND around.w2 = two.w2
  WHERE two.c >= 10 AND coalesce(longer, 0) * 100 < two.c * 50),
cuts AS (
  SELECT three.lang, three.w1 || ' ' || three.w2 || ' ' || three.w3 AS phrase, three.c AS a,
         p.c AS l1, q.c AS r1, s.c AS l2, t.c AS r2,
         (1000000::HUGEINT * three.c * three.c) // (p.c::HUGEINT * q.c) AS s1,
         (1000000::HUGEINT * three.c * three.c) // (s.c::HUGEINT * t.c) AS s2
  FROM three JOIN one AS p ON p.lang = three.lang AND p.w1 = three.w1
  JOIN two AS q ON q.lang = three.lang AND q.w1 = three.w2 AND q.w2 = three.w3
  JOIN two AS s ON s.lang = three.lang AND s.w1 = three.w1 AND s.w2 = three.w2
  JOIN one AS t ON t.lang = three.lang AND t.w1 = three.w3),
kept AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END,
         least(s1, s2) FROM cuts)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""

_SHINGLES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n} + 2),
                                      lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' ')))) END AS shingles
  FROM worded),
classes AS (SELECT min(doc_id) AS cid, shingles, len(shingles) AS n FROM sets
            WHERE len(shingles) > 0 GROUP BY shingles),
elements AS (SELECT cid, n, unnest(shingles) AS x FROM classes),
shared AS (
  SELECT p.cid AS a, q.cid AS b, p.n AS na, q.n AS nb, count(*) AS c
  FROM elements AS p JOIN elements AS q ON p.x = q.x AND p.cid < q.cid
    AND 100 * least(p.n, q.n) >= {least} * greatest(p.n, q.n)
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared WHERE 100 * c >= {least} * (na + nb - c)
  UNION SELECT b, a FROM shared WHERE 100 * c >= {least} * (na + nb - c)),
reached AS (SELECT cid, cid AS vertex FROM classes
  UNION SELECT reached.cid, links.b FROM reached JOIN links ON links.a = reached.vertex),
lowest AS (SELECT cid, min(vertex) AS component_id FROM reached GROUP BY cid)
SELECT sets.doc_id, len(sets.shingles)::BIGINT AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id{more}
FROM sets LEFT JOIN classes ON classes.shingles = sets.shingles LEFT JOIN lowest USING (cid)
"""

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": _SHINGLES.format(
        n=5, least=75, more=", coalesce(cid, sets.doc_id) AS class_id"),
    "op11_minhash_near_dedup": _SHINGLES.format(
        n=2, least=80, more=", coalesce(component_id, sets.doc_id) = sets.doc_id AS kept"),
    "op13_phrase_collocations": _PHRASES,
}

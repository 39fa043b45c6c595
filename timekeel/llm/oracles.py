"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

CONVERSATIONS = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations),
marked AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(place) + 1), lambda i: ascii(substr(place, i, 1))::UBIGINT)),
    lambda c, x: list_reduce(list_concat([xor(c, x)], list_transform(range(8), lambda z: z::UBIGINT)),
      lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1::UBIGINT)))), 4294967295::UBIGINT) % 20 AS hit
  FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(CASE WHEN hit = 3 THEN 2 WHEN hit = 0 THEN 0 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
  FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN seen = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
              WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
shift(top, symbol, after) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 't'), ('t', 'u', 'u')),
added(top, after, n, lines) AS (VALUES
  ('0', '0', 0, []), ('s', 's', 0, []), ('u', 'u', 0, []), ('t', 't', 0, []),
  ('0', 'u', 1, ['user:']), ('s', 'u', 1, ['user:']), ('t', 'u', 1, ['user:']), ('u', 't', 1, ['assistant:']),
  ('0', 't', 2, ['user:', 'assistant:']), ('s', 't', 2, ['user:', 'assistant:']), ('t', 't', 2, ['user:', 'assistant:']), ('u', 'u', 2, ['assistant:', 'user:'])),
edit(letter, price) AS (VALUES ('D', 2), ('K', 0), ('R', 1)),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, '0' AS top, repeat('0', 12) AS best, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT conv_id, rn, top, min(best), arg_min(lines, best) FROM (
    SELECT w.conv_id, j.rn, coalesce(s.after, i.after) AS top,
           printf('%012d', CAST(substr(w.best, 1, 12) AS BIGINT) + 5 * i.n + e.price + CASE WHEN e.letter <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END)
             || substr(w.best, 13) || repeat('I', i.n) || e.letter AS best,
           list_concat(list_concat(w.lines, i.lines), CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text]
             ELSE [CASE s.symbol WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] END) AS lines
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.rn = w.rn + 1
    JOIN added i ON i.top = w.top
    CROSS JOIN edit e
    LEFT JOIN shift s ON s.top = i.after AND (e.letter = 'K' AND s.symbol = j.initial OR e.letter = 'R' AND s.symbol IN ('u', 'a'))
    WHERE e.letter = 'D' OR (s.after IS NOT NULL AND j.fault NOT IN ('blank', 'duplicate')))
  GROUP BY conv_id, rn, top),
lengths AS (SELECT c.conv_id, count(j.rn) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
ended AS (
  SELECT w.conv_id, printf('%012d', CAST(substr(w.best, 1, 12) AS BIGINT) + 5 * i.n) || substr(w.best, 13) || repeat('I', i.n) AS best, list_concat(w.lines, i.lines) AS lines
  FROM walk w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND w.rn = l.n JOIN added i ON i.top = w.top WHERE i.after IN ('0', 't')),
chosen AS (SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM ended GROUP BY conv_id),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id)
SELECT c.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated,
       coalesce(k.illegal, 0) AS illegal, CAST(substr(c.best, 1, 12) AS BIGINT) AS cost, substr(c.best, 13) AS audit,
       sha256(array_to_string(c.lines, chr(10))) AS repaired_sha256
FROM chosen c LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists),
runs AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
phrases AS (
  SELECT lang, 1 AS size, w AS phrase FROM runs
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counted WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size >= 2 AND f >= 10),
cuts AS (
  SELECT o.lang, o.size, o.phrase, o.a, k, x.f AS l, y.f AS r,
         (CAST(o.a AS HUGEINT) * o.a * 1000000) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM often o CROSS JOIN (VALUES (1), (2)) v(k)
  JOIN counted x ON x.lang = o.lang AND x.phrase = array_to_string(list_slice(o.w, 1, k), ' ')
  JOIN counted y ON y.lang = o.lang AND y.phrase = array_to_string(list_slice(o.w, k + 1, o.size), ' ')
  WHERE k < o.size),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(list_slice(w, 1, 2), ' ') AS phrase, a FROM often WHERE size = 3
    UNION ALL SELECT lang, array_to_string(list_slice(w, 2, 3), ' '), a FROM often WHERE size = 3)
  GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.a IS NULL OR 100 * i.a < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= 2000)
SELECT r.lang, r.rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN total t ON t.lang = r.lang
"""

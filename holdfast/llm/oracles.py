"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op6_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op5_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
cut AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos FROM item WHERE len(w) > 0
),
windows AS (
  SELECT item_id, list_aggregate(w[pos:pos + 12], 'string_agg', ' ') AS words,
         least(len(w), 13) AS n
  FROM cut
),
doc AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
seen AS (
  SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM doc, lengths WHERE len(w) >= n
),
hits AS (
  SELECT s.r, s.pos, s.n, b.item_id
  FROM (SELECT r, n, pos, list_aggregate(w[pos:pos + n - 1], 'string_agg', ' ') AS words FROM seen) s
  JOIN windows b ON s.n = b.n AND s.words = b.words
),
hit_words AS (
  SELECT r, count(DISTINCT at_word) AS n_hit
  FROM (SELECT r, unnest(range(pos, pos + n)) AS at_word FROM hits) GROUP BY r
),
items AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN hit_words h USING (r) LEFT JOIN items i USING (r)
"""

_TOKENS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SQL["op9_substring_dedup"] = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS w FROM documents),
cut AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM doc WHERE len(w) >= 13),
windows AS (
  SELECT r, doc_id, pos, hash(list_aggregate(w[pos:pos + 12], 'string_agg', ' ')) AS h FROM cut
),
firsts AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h HAVING count(*) > 1),
late AS (SELECT r, pos FROM windows JOIN firsts USING (h) WHERE doc_id > owner),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + 13)) AS pos FROM late),
lost AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r),
kept AS (
  SELECT c.r, string_agg(c.word, ' ' ORDER BY c.pos) AS words
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM doc) c
  ANTI JOIN gone g ON c.r = g.r AND c.pos = g.pos
  GROUP BY c.r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(l.n_removed, 0) AS n_removed,
       sha256(coalesce(k.words, '')) AS kept_sha256
FROM doc d LEFT JOIN lost l USING (r) LEFT JOIN kept k USING (r)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SQL["op10_warc"] = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
marked AS (
  SELECT *, page_id > min(page_id) OVER (PARTITION BY body) AS again,
         min(page_id) OVER (PARTITION BY body) AS first
  FROM page
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('{_BASE32}',
         1 + (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM marked
"""

SQL["op8_chat_formatting"] = r"""
WITH talk AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
clean AS (SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM talk)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
              ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)
              FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + len(regexp_extract_all(role, '[\\\n]'))
           + len(regexp_extract_all(role, '<\\*\|')) + 1
           + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11)::BIGINT AS formatted_chars
FROM clean GROUP BY conv_id
"""

# The bits of the reversed CRC-32 polynomial, as a number.
_CRC = 0xEDB88320

SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {_CRC}) ELSE c // 2 END, b)) AS step
),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                        lambda ch: ascii(ch)::BIGINT),
               lambda c, b: xor(c // 256, step[1 + xor(c % 256, b)]), 4294967295), 4294967295) % 20 AS fault
  FROM conversations, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed
),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS ini,
         row_number() OVER talk AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
         left(lag(role) OVER talk, 1) AS ini_before,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged
  WINDOW talk AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
judged AS (
  SELECT *, body = '' AS blank, body <> '' AND said > 1 AS dup,
         body <> '' AND said = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut
  FROM placed
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated,
         count(*) FILTER (i > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, state, min(best) AS best
  FROM (
    SELECT conv_id, i, e.state AS state,
           {{'c': best.c + e.cost, 'a': best.a || e.letters, 'o': best.o || e.more}} AS best
    FROM (
      SELECT p.conv_id, r.i, p.best, unnest(list_filter([
        {{'ok': true, 'state': p.state, 'cost': 4::BIGINT, 'letters': 'D', 'more': ''}},
        {{'ok': NOT (r.blank OR r.dup), 'state': 2,
          'cost': (CASE WHEN r.cut THEN 3 ELSE 0 END + CASE WHEN p.state = 2 THEN 3 ELSE 0 END
                   + CASE WHEN r.ini = 'u' THEN 0 ELSE 3 END)::BIGINT,
          'letters': CASE WHEN p.state = 2 THEN 'I' ELSE '' END || CASE WHEN r.ini = 'u' THEN 'K' ELSE 'R' END,
          'more': CASE p.state WHEN 2 THEN chr(10) || 'assistant:' || chr(10) WHEN 0 THEN '' ELSE chr(10) END
                  || CASE WHEN r.ini = 'u' THEN r.role ELSE 'user' END || ':' || r.text}},
        {{'ok': NOT (r.blank OR r.dup), 'state': 3,
          'cost': (CASE WHEN r.cut THEN 3 ELSE 0 END + CASE WHEN p.state = 2 THEN 0 ELSE 3 END
                   + CASE WHEN r.ini = 'a' THEN 0 ELSE 3 END)::BIGINT,
          'letters': CASE WHEN p.state = 2 THEN '' ELSE 'I' END || CASE WHEN r.ini = 'a' THEN 'K' ELSE 'R' END,
          'more': CASE p.state WHEN 2 THEN chr(10) WHEN 0 THEN 'user:' || chr(10)
                       ELSE chr(10) || 'user:' || chr(10) END
                  || CASE WHEN r.ini = 'a' THEN r.role ELSE 'assistant' END || ':' || r.text}},
        {{'ok': NOT (r.blank OR r.dup) AND p.state = 0 AND r.ini = 's', 'state': 1,
          'cost': CASE WHEN r.cut THEN 3 ELSE 0 END::BIGINT, 'letters': 'K', 'more': r.role || ':' || r.text}}
      ], lambda x: x.ok)) AS e
      FROM path p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    )
  )
  GROUP BY conv_id, i, state
),
done AS (
  SELECT p.conv_id, min({{
    'c': best.c + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
    'a': best.a || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'o': best.o || CASE state WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:'
                              WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS best
  FROM path p JOIN counts n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i
  GROUP BY p.conv_id
)
SELECT t.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank,
       coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
       coalesce(n.illegal, 0) AS illegal, coalesce(d.best.c, 0) AS cost, coalesce(d.best.a, '') AS audit,
       sha256(coalesce(d.best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM t.conv_id
"""

_PIECES = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"

SQL["op11_collocations"] = f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
cut AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS pos FROM split WHERE len(w) > 0),
gram AS (
  SELECT lang, k, array_to_string(w[pos:pos + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM cut) WHERE pos + k - 1 <= len(w)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
inner_part AS (
  SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s
        FROM (SELECT *, unnest(range(2, k)) AS m FROM cand))
),
longest AS (SELECT lang, phrase, max(a) AS a FROM inner_part GROUP BY ALL),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN longest x USING (lang, phrase) WHERE x.a IS NULL OR 100 * x.a < 80 * c.a
),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
),
scored AS (
  SELECT t.lang, t.phrase, t.a,
         min({{'score': (2000000::HUGEINT * t.a // (x.f + y.f))::BIGINT, 'c': t.c, 'l': x.f, 'r': y.f}}) AS best
  FROM cuts t JOIN often x ON x.lang = t.lang AND x.phrase = t.p JOIN often y ON y.lang = t.lang AND y.phrase = t.q
  GROUP BY t.lang, t.phrase, t.a
),
placed AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank,
         phrase, a, best.l AS l, best.r AS r, best.score AS score
  FROM scored
)
SELECT p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n, p.score
FROM placed p JOIN total t USING (lang) WHERE p.rank <= 2000
"""

"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

ORACLES: dict[str, str] = {}

# Words after A-Z are lowered, then every window of 13 item words, looked up in all windows of the
# documents of the same width. Near matches: each item's five rarest words, and stretches as long as the
# item that begin with one of them and hold all but one.
ORACLES["op9_decontaminate"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_windows AS (
  SELECT item_id, least(13, len(w)) AS width, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i:i + 12])) AS win
  FROM item_words WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM item_windows),
doc_windows AS (
  SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS pos, w FROM doc_words, widths WHERE len(w) >= width),
hits AS (
  SELECT d.doc_id, d.pos, d.width, i.item_id FROM (SELECT doc_id, width, pos, w[pos:pos + width - 1] AS win FROM doc_windows) d
  JOIN item_windows i ON d.width = i.width AND d.win = i.win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id),
item_terms AS (SELECT DISTINCT item_id, len(w) AS reach, unnest(w) AS word FROM item_words),
places AS (
  SELECT doc_id, word, place FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM doc_words)
  SEMI JOIN item_terms USING (word)),
rarest AS (
  SELECT item_id, reach, word FROM item_terms JOIN (SELECT word, count(DISTINCT doc_id) AS n FROM places GROUP BY word) USING (word)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n, word) <= 5),
chosen AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS k FROM rarest),
met AS (SELECT item_id, doc_id, place, word, reach, k FROM chosen JOIN places USING (word) WHERE k > 1),
stretches AS (
  SELECT a.item_id, a.doc_id, a.place, any_value(a.k) AS k, count(DISTINCT b.word) AS held
  FROM met a JOIN met b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.place BETWEEN a.place AND a.place + a.reach - 1
  GROUP BY ALL),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM stretches ANTI JOIN hits USING (doc_id, item_id)
  WHERE held >= CASE WHEN k > 2 THEN k - 1 ELSE k END GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(d.w) AS contaminated,
  coalesce(n_near, 0) AS n_near
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

# Every window of 20 words numbered by its first start; words inside a later one go.
ORACLES["op6_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, pos, md5_number(array_to_string(w[pos:pos + 19], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM words WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS p FROM later),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

# Damage by a checksum worked out bit by bit, then the cheapest edits from the last row to the first: for
# each state the least (cost, audit, lines), without and then with rows inserted before.
ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
faulty AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)), 4294967295)) % 20 AS fault
  FROM keyed),
left_over AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM faulty),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM left_over),
marked AS (
  SELECT *, role[1] AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM numbered),
rows_ AS (
  SELECT *, role || ':' || text AS line, CASE WHEN cut THEN 3 ELSE 0 END AS open, CASE WHEN blank OR again THEN 1000000 ELSE 0 END AS must
  FROM marked),
solved AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS e, {'c': 6::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']} AS s,
    {'c': 3::BIGINT, 'a': 'I', 'r': ['assistant:']} AS u, {'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]} AS a FROM rows_
  UNION ALL
  SELECT conv_id, i,
    least(pe, {'c': cu.c + 3, 'a': 'I' || cu.a, 'r': list_prepend('user:', cu.r)}),
    least(ps, {'c': cu.c + 3, 'a': 'I' || cu.a, 'r': list_prepend('user:', cu.r)}), cu, ca
  FROM (
    SELECT *, least(pu, {'c': pa.c + 3, 'a': 'I' || pa.a, 'r': list_prepend('assistant:', pa.r)}) AS cu,
      least(pa, {'c': pu.c + 3, 'a': 'I' || pu.a, 'r': list_prepend('user:', pu.r)}) AS ca
    FROM (
      SELECT conv_id, i,
        least({'c': e.c + 4, 'a': 'D' || e.a, 'r': e.r}, to_user,
          {'c': CASE ini WHEN 's' THEN s.c WHEN 'u' THEN u.c ELSE 1000000 END + must + open, 'a': 'K' || CASE ini WHEN 's' THEN s.a ELSE u.a END,
           'r': list_prepend(line, CASE ini WHEN 's' THEN s.r ELSE u.r END)}) AS pe,
        least({'c': s.c + 4, 'a': 'D' || s.a, 'r': s.r}, to_user, keep_user) AS ps,
        least({'c': u.c + 4, 'a': 'D' || u.a, 'r': u.r}, {'c': a.c + must + open + 3, 'a': 'R' || a.a, 'r': list_prepend('assistant:' || text, a.r)},
          {'c': CASE ini WHEN 'a' THEN a.c ELSE 1000000 END + must + open, 'a': 'K' || a.a, 'r': list_prepend(line, a.r)}) AS pu,
        least({'c': a.c + 4, 'a': 'D' || a.a, 'r': a.r}, to_user, keep_user) AS pa
      FROM (
        SELECT x.conv_id, x.i, x.ini, x.line, x.text, x.must, x.open, y.e, y.s, y.u, y.a,
          {'c': y.u.c + x.must + x.open + 3, 'a': 'R' || y.u.a, 'r': list_prepend('user:' || x.text, y.u.r)} AS to_user,
          {'c': CASE x.ini WHEN 'u' THEN y.u.c ELSE 1000000 END + x.must + x.open, 'a': 'K' || y.u.a, 'r': list_prepend(x.line, y.u.r)} AS keep_user
        FROM solved y JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i - 1)))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT again AND cut) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
known AS (SELECT DISTINCT conv_id FROM conversations)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(d.e.c, 0) AS cost, coalesce(d.e.a, '') AS audit,
  sha256(coalesce(array_to_string(d.e.r, chr(10)), '')) AS repaired_sha256
FROM known k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN solved d ON d.conv_id IS NOT DISTINCT FROM k.conv_id AND d.i = 1
"""

ORACLES["op12_ranked_search"] = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM doc_terms WHERE len(w) > 0),
postings AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS term FROM doc_terms) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, total GROUP BY term, docs),
normed AS (SELECT d, doc_id, 10 + (90 * len(w) * docs) // terms AS m FROM doc_terms, total),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, d, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN postings USING (term) JOIN normed USING (d) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, d)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

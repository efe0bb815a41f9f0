"""The queries of ``bindings`` once more, as SQL that DuckDB runs on the same tables.

Written from the meaning of each operator; nothing here is taken from the Spark side.
"""

from __future__ import annotations

import math

# The 29 white space code points, as a SQL expression.
_WS = (
    "(SELECT string_agg(chr(c::INTEGER), '' ORDER BY c) FROM ("
    "SELECT unnest(range(9, 14)) AS c UNION ALL SELECT unnest(range(28, 33)) UNION ALL "
    "SELECT unnest(range(8192, 8203)) UNION ALL "
    "SELECT unnest([133, 160, 5760, 8232, 8233, 8239, 8287, 12288])))"
)

_PAGES = """pages_ AS (
  SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS page_num,
         text AS content, doc_id
  FROM documents)"""

_CHUNKS = f"""{_PAGES},
ws AS MATERIALIZED (SELECT {_WS} AS ws),
windows AS (
  SELECT source, page_num, doc_id, content AS page,
         unnest(range(0, length(content), 800)) AS start
  FROM pages_),
chunks AS (
  SELECT source, page_num, doc_id, start::INTEGER AS start,
         trim(substring(page, start + 1, 1000), ws) AS content,
         sha256(concat_ws('|', coalesce('=' || source, '~'), coalesce('=' || doc_id, '~'), '=' || start,
                          '=' || sha256(trim(substring(page, start + 1, 1000), ws)))) AS id
  FROM windows, ws
  WHERE length(trim(substring(page, start + 1, 1000), ws)) > 0)"""

_STORED = f"""WITH {_CHUNKS}
SELECT source, count(DISTINCT id) AS n_ids, sum(length(content))::BIGINT AS n_characters,
       (384 * count(*))::BIGINT AS n_components
FROM chunks GROUP BY source"""


def _buckets(name: str, key: str, table: str, text: str, dim: int = 384) -> str:
    """CTEs ending in ``name(key, bucket, value)``: the components of hashed token vectors."""
    return f"""
{name}_tokens AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {table}),
{name}_counts AS (
  SELECT {key}, (('0x' || substr(md5(token), 1, 8))::BIGINT % {dim})::INTEGER AS bucket, count(*) AS n
  FROM {name}_tokens GROUP BY ALL),
{name} AS (
  SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT AS value
  FROM {name}_counts)"""


def _dense(name: str, key: str, table: str, sparse: str, dim: int = 384) -> str:
    """CTE ``name(key, embedding)``: the same vectors with all their components."""
    return f"""
{name} AS (
  SELECT k.{key}, list(coalesce(s.value, 0)::DOUBLE ORDER BY r.bucket) AS embedding
  FROM (SELECT DISTINCT {key} FROM {table}) k
  CROSS JOIN (SELECT unnest(range({dim}))::INTEGER AS bucket) r
  LEFT JOIN {sparse} s ON s.{key} = k.{key} AND s.bucket = r.bucket
  GROUP BY k.{key})"""


def _round(expression: str) -> str:
    return f"floor(({expression}) * 1e4 + 0.5) / 1e4"


_RAW = """CASE WHEN isnan(list_cosine_similarity({0}, {1})) THEN NULL
  ELSE list_cosine_similarity({0}, {1}) END"""

_ALL_HITS = f"""scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         {_RAW.format('c.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')} AS raw
  FROM embeddings q, embeddings c),
hits AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY raw DESC NULLS LAST, vec_id))::INTEGER AS rank,
         vec_id, {_round('raw')} AS score
  FROM scored QUALIFY rank <= 5)"""

_BATCH = f"WITH {_ALL_HITS} SELECT query_id, rank, vec_id, score FROM hits"

_PAIR_NAMES = """('km','miles'),('miles','km'),('celsius','fahrenheit'),('fahrenheit','celsius'),
('kg','lbs'),('lbs','kg'),('meters','feet'),('feet','meters'),('gallons','liters'),('KM','Miles')"""

_REQUESTS = f"""asked(place, from_unit, to_unit) AS (
  SELECT row_number() OVER () - 1, col0, col1 FROM (VALUES {_PAIR_NAMES})),
conversions(f, t, pre, mul, div, post) AS (VALUES
  ('km','miles',0::DOUBLE,0.621371::DOUBLE,1::DOUBLE,0::DOUBLE), ('miles','km',0,1.60934,1,0),
  ('celsius','fahrenheit',0,9,5,32), ('fahrenheit','celsius',-32,5,9,0),
  ('kg','lbs',0,2.20462,1,0), ('lbs','kg',0,1,2.20462,0),
  ('meters','feet',0,3.28084,1,0), ('feet','meters',0,1,3.28084,0)),
requests AS (
  SELECT p_partkey, p_retailprice AS value, from_unit, to_unit
  FROM part JOIN asked ON place = p_size % 10)"""

_NAMES = """names AS (
  SELECT p_partkey AS query_id,
         array_to_string([upper(substr(w, 1, 1)) || lower(substr(w, 2)) for w in string_split(p_name, ' ')], ' ') AS query
  FROM part)"""

_ENTRIES = f"""{_NAMES},
entries(priority, key, answer, results) AS (VALUES
  (1, 'ring', 'Rings are round.',
   [{{'title': 'On rings', 'url': 'https://example.org/ring', 'content': 'All about rings.'}}]),
  (2, 'red', 'Red parts are painted.',
   [{{'title': 'On red', 'url': 'https://example.org/red', 'content': 'All about red.'}},
    {{'title': 'On paint', 'url': 'https://example.org/paint', 'content': 'All about paint.'}}]),
  (3, 'widget', 'Widgets do everything.',
   [{{'title': 'On widgets', 'url': 'https://example.org/widget', 'content': 'All about widgets.'}}]),
  (4, 'old', 'Old and cold parts are kept apart.', [])),
found AS (
  SELECT query_id, query, key, answer, results
  FROM names LEFT JOIN entries ON contains(lower(query), key)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority) = 1),
replies AS (
  SELECT query_id, query,
         coalesce(answer, 'No stored answer for: ''' || query || '''.') AS answer,
         CASE WHEN key IS NULL THEN
           [{{'title': 'What a search finds on ''' || query || '''',
             'url': 'https://www.google.com/search?q=' || replace(query, ' ', '+'),
             'content': 'No stored result about ''' || query || '''.'}}]
         ELSE results[1:3] END AS results,
         CASE WHEN key IS NULL THEN 'generated' ELSE 'stored' END AS source
  FROM found)"""

_STORED_REPLIES = """stored AS (
  SELECT event_id AS query_id, event_type, json_extract_string(props, '$.k') AS k FROM events)"""

_TIDIED = f"""{_STORED_REPLIES},
tidied AS (
  SELECT query_id, event_type,
    CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE 'about ' || k END AS answer,
    CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE 'first; second; ' END AS titles,
    CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN ''
      ELSE 'https://example.org/' || k || '; ; https://example.org/third' END AS urls,
    CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 0 ELSE least(500, 10 * k::INTEGER) END::INTEGER AS n_content,
    event_type <> 'error' AS valid
  FROM stored)"""

_ROUTED = f"""{_NAMES},
terms(term, label) AS (VALUES ('ring','RAG'), ('gear','RAG'), ('hot','RAG'),
  ('red','GENERAL'), ('widget','GENERAL'), ('small','GENERAL')),
counted AS (
  SELECT query_id, query, count(*) FILTER (label = 'RAG') AS rag_hits,
         count(*) FILTER (label = 'GENERAL') AS general_hits
  FROM names LEFT JOIN terms ON contains(lower(query), term) GROUP BY query_id, query),
routed AS (
  SELECT *, CASE WHEN rag_hits > general_hits THEN 'RAG' ELSE 'GENERAL' END AS label,
    CASE WHEN rag_hits > 0 AND general_hits > 0 THEN 'MEDIUM'
         WHEN rag_hits + general_hits > 0 THEN 'HIGH' ELSE 'LOW' END AS confidence,
    rag_hits || ' retrieval terms, ' || general_hits || ' general terms' AS reason
  FROM counted)"""

_OUTCOMES = """outcomes AS (
  SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS category,
         CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'error' END AS status,
         CASE WHEN o_orderstatus = 'O' THEN 'still open: ' || o_custkey END AS error
  FROM orders)"""

_ACCURACY = """chosen AS (
  SELECT CASE WHEN l.quality = 1 THEN 'Retriever Agent' ELSE 'General Agent' END AS expected_agent,
         CASE WHEN l.quality = 1 THEN 'knowledge_search' END AS expected_tool,
         CASE WHEN d.lang = 'en' THEN 'Retriever Agent' WHEN d.doc_id IS NOT NULL THEN 'General Agent' END AS agent,
         CASE WHEN d.lang = 'en' AND d.n_chars > 500 THEN 'knowledge_search' END AS tool,
         d.doc_id IS NOT NULL AS answered
  FROM labels l LEFT JOIN documents d USING (doc_id)),
accuracy AS (
  SELECT expected_agent, agent, count(*) AS n_cases,
         count(*) FILTER (answered AND expected_tool IS NOT DISTINCT FROM tool) AS n_tool_right,
         expected_agent IS NOT DISTINCT FROM agent AS "right"
  FROM chosen GROUP BY expected_agent, agent)"""

_HITS = f"""
WITH {_CHUNKS},
{_buckets('chunk_parts', 'id', 'chunks', 'content')},
{_dense('chunk_vectors', 'id', 'chunks', 'chunk_parts')},
{_buckets('item_parts', 'item_id', 'benchmark', 'text')},
{_dense('item_vectors', 'item_id', 'benchmark', 'item_parts')},
scored AS (
  SELECT q.item_id AS query_id, c.id, {_RAW.format('c.embedding', 'q.embedding')} AS raw
  FROM item_vectors q, chunk_vectors c),
hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC NULLS LAST, id) AS rank,
         id, {_round('raw')} AS score
  FROM scored QUALIFY rank <= 5)"""

_CONTEXTS = """
WITH RECURSIVE runs AS (
  SELECT DISTINCT conv_id, -1::BIGINT AS turn, []::BIGINT[] AS way FROM conversations
  UNION ALL
  SELECT c.conv_id, c.turn, list_concat(r.way, [2, c.turn])
  FROM conversations c JOIN runs r ON r.conv_id = c.conv_id
   AND ((c.turn < 2 AND r.turn = -1) OR (c.turn >= 2 AND r.turn = c.turn - 2))),
found AS (
  SELECT r.conv_id, list_concat(r.way, [1, 0]) AS way, c.text AS content
  FROM runs r JOIN conversations c USING (conv_id, turn)
  WHERE c.role = 'assistant' AND c.turn > 2 AND length(c.text) > 0
  UNION ALL
  SELECT r.conv_id, list_concat(r.way, [3, c.turn]), c.text
  FROM runs r JOIN conversations c USING (conv_id, turn) WHERE c.turn % 3 = 2 AND length(c.text) > 0),
first AS (SELECT conv_id, arg_min(content, way) AS context FROM found GROUP BY conv_id)
SELECT conv_id AS response_id, context
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN first USING (conv_id)"""

ORACLES: dict[str, str] = {
    "read_pages": f"WITH {_PAGES} SELECT source, page_num, content FROM pages_",
    "source_name": "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages",
    "chunk_pages": f"WITH {_CHUNKS} SELECT source, page_num, start, content FROM chunks",
    "chunk_ids": f"WITH {_CHUNKS} SELECT id, source, page_num, start FROM chunks",
    "index_write": _STORED,
    "ensure_index": _STORED,
    "index_count": f"WITH {_CHUNKS} SELECT count(*) AS n_chunks FROM chunks",
    "stream_index": f"WITH {_CHUNKS} SELECT source, page_num, start, content FROM chunks",
    "duplicate_ids": """
SELECT sha256(text) AS id, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "bad_dimension": """
SELECT vec_id AS id, CASE label WHEN 1 THEN 63 END::INTEGER AS width FROM embeddings WHERE label IN (1, 2)""",
    "reindex": f"WITH {_CHUNKS} SELECT id, source, page_num, start, content FROM chunks",
    "index_compacted": f"WITH {_CHUNKS} SELECT id, source, page_num, start, content FROM chunks",
    "index_append": f"""WITH {_CHUNKS}
SELECT source, count(*) AS n_chunks, count(DISTINCT id) AS n_ids FROM chunks GROUP BY source""",
    "reindex_inserted": f"""WITH {_CHUNKS}
SELECT source, count(*) AS n_chunks, count(DISTINCT page_num) AS n_pages, sum(page_num)::BIGINT AS page_numbers,
       count(*) FILTER (page_num = 1) AS n_written, 0::BIGINT AS n_dead
FROM chunks GROUP BY source""",
    "new_chunks": f"""WITH {_CHUNKS}
SELECT id, source, page_num, start FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "index_stats": f"""WITH {_CHUNKS}
SELECT source, count(*) AS n_chunks, count(DISTINCT page_num) AS n_pages,
       min(length(content))::INTEGER AS min_length, max(length(content))::INTEGER AS max_length,
       avg(length(content)) AS avg_length
FROM chunks GROUP BY source""",
    "embed_batch": "SELECT doc_id, "
    + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::BIGINT AS n_{c}" for c in "aeinrst")
    + " FROM documents",
    "hash_embed": f"""WITH {_buckets('sparse', 'doc_id', 'documents', 'text')}
SELECT doc_id, bucket, {_round('value::DOUBLE')} AS weight FROM sparse""",
    "cosine_pairs": f"""
SELECT a.vec_id, {_round(_RAW.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]'))} AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "search_one": f"""
WITH parts AS (
  SELECT generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS value FROM embeddings),
mean AS (SELECT list(value ORDER BY place) AS m FROM (SELECT place, avg(value) AS value FROM parts GROUP BY place)),
scored AS (SELECT vec_id, {_RAW.format('embedding::DOUBLE[]', 'm')} AS raw FROM embeddings, mean)
SELECT vec_id, {_round('raw')} AS score FROM scored ORDER BY raw DESC NULLS LAST, vec_id LIMIT 10""",
    "search_batch": _BATCH,
    "search_split": _BATCH,
    "search_stats": f"""WITH {_ALL_HITS}
SELECT query_id, count(*) AS n_hits, max(score) AS top_score, min(score) AS lowest_score
FROM hits GROUP BY query_id""",
    "search_labels": f"""
WITH fit AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings WHERE label <> 1),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.label, {_RAW.format('c.embedding', 'q.embedding')} AS raw FROM fit q, fit c)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY raw DESC NULLS LAST, vec_id))::INTEGER AS rank,
       vec_id, label, {_round('raw')} AS score
FROM scored QUALIFY rank <= 5""",
    "search_approx": f"""
WITH centres AS (
  SELECT row_number() OVER (ORDER BY hash, vec_id) AS cell, embedding::DOUBLE[] AS centre
  FROM (SELECT vec_id, embedding, md5(vec_id::VARCHAR) AS hash FROM embeddings
        QUALIFY row_number() OVER (PARTITION BY embedding ORDER BY hash, vec_id) = 1)
  QUALIFY cell <= 16),
near AS (
  SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_RAW.format('embedding::DOUBLE[]', 'centre')} DESC, cell) AS place
  FROM embeddings, centres),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_RAW.format('b.embedding::DOUBLE[]', 'a.embedding::DOUBLE[]')} AS raw
  FROM near q JOIN near c ON q.cell = c.cell AND q.place <= 12 AND c.place = 1
  JOIN embeddings a ON a.vec_id = q.vec_id JOIN embeddings b ON b.vec_id = c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY raw DESC NULLS LAST, vec_id))::INTEGER AS rank,
       vec_id, {_round('raw')} AS score
FROM scored QUALIFY rank <= 5""",
    "format_context": f"""{_HITS}
SELECT query_id,
       string_agg(printf('[Chunk %d] (Page %d, Score: %.4f)', rank, page_num, score) || chr(10) || content,
                  chr(10) || chr(10) ORDER BY rank) AS context
FROM hits JOIN chunks USING (id) GROUP BY query_id""",
    "format_context_some": f"""
WITH {_CHUNKS},
{_buckets('chunk_parts', 'id', 'chunks', 'content')},
{_dense('chunk_vectors', 'id', 'chunks', 'chunk_parts')},
asked AS (SELECT item_id, CASE WHEN length(text) < 150 THEN '' ELSE text END AS text FROM benchmark),
{_buckets('item_parts', 'item_id', 'asked', 'text')},
{_dense('item_vectors', 'item_id', 'asked', 'item_parts')},
scored AS (
  SELECT q.item_id AS query_id, c.id, {_RAW.format('c.embedding', 'q.embedding')} AS raw FROM item_vectors q, chunk_vectors c),
hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC NULLS LAST, id) AS rank, id, {_round('raw')} AS score
  FROM scored QUALIFY rank <= 5),
blocks AS (
  SELECT query_id, string_agg(printf('[Chunk %d] (Page %d, Score: %.4f)', rank, page_num, score) || chr(10) || content,
                              chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN chunks USING (id) WHERE score > 0.6 GROUP BY query_id)
SELECT item_id AS query_id, coalesce(context, 'No relevant context found in the knowledge base.') AS context
FROM benchmark LEFT JOIN blocks ON query_id = item_id""",
    "search_texts": f"""{_HITS}
SELECT query_id, rank, content, page_num, source, score FROM hits JOIN chunks USING (id)""",
    "formula_columns": f"""
WITH computed AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS price,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
    CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS per_unit,
    CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS per_off,
    -l_quantity - 7.0::DOUBLE * floor(-l_quantity / 7.0::DOUBLE) AS rest,
    sqrt(l_extendedprice) AS root, sin(l_quantity * pi() / 50) AS wave, cos(l_quantity * pi() / 50) AS swing,
    power(1 + l_discount, 10) AS grown, ln(l_extendedprice) / ln(10) AS scale,
    CASE WHEN l_quantity > 25 THEN ln(l_quantity - 25) END AS above,
    CASE WHEN l_quantity <= 25 THEN sqrt(25 - l_quantity) END AS below,
    ([{', '.join(repr(float(math.factorial(n))) + '::DOUBLE' for n in range(171))}])[l_quantity::INTEGER + 1] AS orderings
  FROM lineitem)
SELECT l_orderkey, l_linenumber, {_round('charge')} AS charge, {_round('per_unit')} AS per_unit,
  {_round('per_off')} AS per_off, {_round('rest')} AS rest, {_round('root')} AS root, {_round('wave')} AS wave,
  {_round('swing')} AS swing, {_round('grown')} AS grown, {_round('scale')} AS scale, {_round('above')} AS above,
  orderings, rest = floor(rest) AS rest_integral, orderings IS NOT NULL AS orderings_integral,
  CASE WHEN per_off IS NULL THEN 'error' ELSE 'success' END AS per_off_status,
  CASE WHEN above IS NULL THEN 'error' ELSE 'success' END AS above_status,
  CASE WHEN orderings IS NULL THEN 'error' ELSE 'success' END AS orderings_status,
  CASE WHEN q * 20 > 709 THEN 'error' ELSE 'success' END AS explosion_status,
  {_round('below')} AS below, TRUE AS huge_integral, price AS huge,
  CASE WHEN per_off IS NULL THEN 'no result' END AS per_off_error,
  CASE WHEN per_off IS NULL THEN 'look for missing inputs, divisors of zero and arguments outside a function''s domain' END AS per_off_hint,
  CASE WHEN below IS NULL THEN 'result is not a number' END AS below_error,
  CASE WHEN below IS NULL THEN 'look for roots and logarithms of negative values' END AS below_hint,
  CASE WHEN q * 20 > 709 THEN 'result is infinite' END AS explosion_error,
  CASE WHEN q * 20 > 709 THEN 'use smaller values or exponents' END AS explosion_hint
FROM computed""",
    "convert_units": f"""WITH {_REQUESTS}
SELECT p_partkey, value, from_unit, to_unit, {_round('(value + pre) * mul / div + post')} AS result,
       CASE WHEN f IS NULL THEN 'error' ELSE 'success' END AS status
FROM requests LEFT JOIN conversions ON f = lower(from_unit) AND t = lower(to_unit)""",
    "convert_unknown": f"""WITH {_REQUESTS}
SELECT p_partkey, 'Unsupported conversion: ' || from_unit || ' -> ' || to_unit AS error,
       (SELECT string_agg(DISTINCT u, ',' ORDER BY u) FROM (SELECT f AS u FROM conversions UNION SELECT t FROM conversions))
         AS supported_units
FROM requests WHERE NOT EXISTS (SELECT 1 FROM conversions WHERE f = lower(from_unit) AND t = lower(to_unit))""",
    "supported_units": f"""WITH {_REQUESTS},
named AS (
  SELECT lower(from_unit) AS unit, 1 AS asked FROM requests UNION ALL SELECT lower(to_unit), 1 FROM requests
  UNION ALL SELECT f, 0 FROM conversions UNION ALL SELECT t, 0 FROM conversions)
SELECT unit, sum(asked)::BIGINT AS n_requests,
       unit IN (SELECT f FROM conversions UNION SELECT t FROM conversions) AS supported
FROM named GROUP BY unit""",
    "keyword_lookup": f"""WITH {_ENTRIES}
SELECT query_id, query, key, answer,
       array_to_string([r.title for r in results[1:1]], '; ') AS titles FROM found""",
    "keyword_lookup_table": f"""WITH {_NAMES},
words AS (SELECT DISTINCT unnest(string_split(lower(query), ' ')) AS key FROM names),
entries AS (SELECT key, row_number() OVER (ORDER BY -length(key), key) AS priority FROM words)
SELECT query_id, key, 'about ' || key AS answer
FROM names LEFT JOIN entries ON contains(lower(query), key)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority) = 1""",
    "keyword_lookup_documents": """
SELECT doc_id AS query_id, lower(b.text) AS key, 'item ' || item_id AS answer
FROM documents d LEFT JOIN benchmark b ON contains(lower(d.text), lower(b.text))
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY item_id) = 1""",
    "route_documents": """
WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part),
counted AS (
  SELECT doc_id AS query_id, count(*) FILTER (length(term) % 2 = 0) AS rag_hits, count(*) FILTER (length(term) % 2 = 1) AS general_hits
  FROM documents LEFT JOIN words ON contains(lower(text), term) GROUP BY doc_id)
SELECT query_id, rag_hits, general_hits, CASE WHEN rag_hits > general_hits THEN 'RAG' ELSE 'GENERAL' END AS label,
  CASE WHEN rag_hits > 0 AND general_hits > 0 THEN 'MEDIUM' WHEN rag_hits + general_hits > 0 THEN 'HIGH' ELSE 'LOW' END AS confidence
FROM counted""",
    "lookup_fallback": f"""WITH {_ENTRIES}
SELECT query_id, answer, array_to_string([r.title for r in results], '; ') AS titles,
       array_to_string([r.url for r in results], '; ') AS urls, source, 'success' AS status
FROM replies""",
    "reply_json": f"""WITH {_ENTRIES}
SELECT query_id, to_json({{'query': query, 'answer': answer, 'results': results, 'source': source,
                          'status': 'success'}})::VARCHAR AS reply
FROM replies""",
    "normalise_responses": f"""WITH {_TIDIED}
SELECT query_id, answer, titles, urls, n_content, valid FROM tidied""",
    "prefer_primary": f"""WITH {_TIDIED},
own AS (SELECT *, valid AND event_type <> 'purchase' AS kept FROM tidied)
SELECT query_id, CASE WHEN kept THEN answer ELSE 'nothing on ' || event_type END AS answer,
       CASE WHEN kept THEN titles ELSE 'own' END AS titles, CASE WHEN kept THEN urls ELSE '' END AS urls,
       CASE WHEN kept THEN n_content ELSE length(event_type) END::INTEGER AS n_content,
       CASE WHEN kept THEN 'primary' WHEN event_type = 'purchase' THEN 'fallback'
            ELSE 'fallback_after_error' END AS source
FROM own""",
    "route_queries": f"""WITH {_ROUTED}
SELECT query_id, query, rag_hits, general_hits, label, confidence, reason FROM routed""",
    "route_learned": r"""
WITH tokens AS (
  SELECT doc_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) AS bucket
  FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM documents)),
taught AS (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL),
seen AS (
  SELECT bucket, count(*) FILTER (quality = 1) AS rag, count(*) FILTER (quality <> 1) AS general
  FROM tokens JOIN taught USING (doc_id) GROUP BY bucket),
scale AS (SELECT (coalesce(sum(general), 0) + 65536.0::DOUBLE) / (coalesce(sum(rag), 0) + 65536.0::DOUBLE) AS ratio FROM seen),
weights AS (
  SELECT bucket, CAST(floor(ln((rag + 1)::DOUBLE / (general + 1) * ratio) * 1000000 + 0.5) AS BIGINT) AS weight
  FROM (SELECT range AS bucket, coalesce(rag, 0) AS rag, coalesce(general, 0) AS general
        FROM range(65536) LEFT JOIN seen ON bucket = range), scale),
prior AS (
  SELECT CAST(floor(ln((count(*) FILTER (quality = 1) + 1)::DOUBLE / (count(*) FILTER (quality <> 1) + 1)) * 1000000 + 0.5)
              AS BIGINT) AS prior
  FROM documents JOIN taught USING (doc_id)),
odds AS (
  SELECT doc_id, coalesce(total, 0) + prior AS odds
  FROM documents LEFT JOIN (SELECT doc_id, sum(weight) AS total FROM tokens JOIN weights USING (bucket) GROUP BY doc_id)
       USING (doc_id), prior)
SELECT doc_id, CASE WHEN odds > 0 THEN 'RAG' ELSE 'GENERAL' END AS label,
       CASE WHEN abs(odds) >= 1386295 THEN 'HIGH' WHEN abs(odds) >= 405466 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM odds""",
    "parse_verdicts": """
WITH told AS (
  SELECT conv_id, turn, role, nullif(trim(replace(text, chr(10), ' ')), '') AS reason
  FROM conversations)
SELECT conv_id, turn,
       CASE role WHEN 'assistant' THEN 'RAG' WHEN 'user' THEN 'GENERAL' END AS label,
       CASE WHEN role <> 'system' THEN reason END AS reason,
       CASE WHEN role = 'assistant' THEN 'HIGH' END AS confidence
FROM told""",
    "dispatch": f"""WITH {_ROUTED},
{_ENTRIES.replace(_NAMES + ',', '', 1)}
SELECT r.query_id, f.key, f.answer, r.label, NULL::VARCHAR AS source
FROM routed r JOIN found f USING (query_id) WHERE r.label = 'RAG'
UNION ALL
SELECT r.query_id, NULL, p.answer, r.label, p.source
FROM routed r JOIN replies p USING (query_id) WHERE r.label = 'GENERAL'""",
    "session_history": """
WITH newest AS (
  SELECT * FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id, count(*) AS n_turns,
       string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
FROM newest GROUP BY conv_id""",
    "turn_pairs": """
WITH spoken AS (
  SELECT conv_id, 10 * turn AS turn, role, text FROM conversations
  WHERE (instr(text, ',') = 0 OR instr(text, ',') > instr(text, '.')) AND role IN ('user', 'assistant')),
following AS (
  SELECT *, lead(role) OVER following AS next_role, lead(text) OVER following AS next_text
  FROM spoken WINDOW following AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS reply
FROM following WHERE role = 'user'""",
    "eval_outcomes": """
SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS category,
       CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN 'error' ELSE 'completed' END AS status,
       CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
            THEN substring(repeat('order of customer ' || o_custkey || '; ', 12), 1, 200) END AS response_preview,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'no response stored' WHEN o_orderstatus = 'P' THEN 'partly shipped' END AS error
FROM orders""",
    "category_summary": f"""WITH {_OUTCOMES}
SELECT category, count(*) FILTER (status = 'completed') AS completed, count(*) AS total,
       count(*) FILTER (status = 'completed') || '/' || count(*) AS passed,
       CASE WHEN bool_and(status = 'completed') THEN 'PASS' ELSE 'FAIL' END AS status
FROM outcomes GROUP BY category ORDER BY category""",
    "overall_summary": """
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed,
       count(*) FILTER (o_orderstatus = 'O') AS errors
FROM orders""",
    "distinct_categories": "SELECT DISTINCT o_orderpriority AS category FROM orders ORDER BY 1",
    "failed_cases": f"""WITH {_OUTCOMES}
SELECT id, coalesce(error, 'Unknown error') AS error FROM outcomes WHERE status = 'error'""",
    "route_accuracy": f"""WITH {_ACCURACY}
SELECT expected_agent, agent, n_cases, n_tool_right, "right" FROM accuracy""",
    "route_confusion": f"""WITH {_ACCURACY}
SELECT expected_agent, coalesce(sum(n_cases) FILTER (agent = 'Retriever Agent'), 0)::BIGINT AS to_retriever,
       coalesce(sum(n_cases) FILTER (agent = 'General Agent'), 0)::BIGINT AS to_general
FROM accuracy GROUP BY expected_agent""",
    "retrieved_context": _CONTEXTS,
    "evaluate": f"""
WITH contexts AS ({_CONTEXTS}),
cases AS (SELECT conv_id, count(*) || ' turns' AS category FROM conversations GROUP BY conv_id),
outcomes AS (
  SELECT c.conv_id, category,
         CASE WHEN r.conv_id IS NULL THEN 'no response stored' WHEN r.role = 'user' THEN 'asked back' END AS error, r.text
  FROM cases c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = 3),
categories AS (
  SELECT category, count(*) FILTER (error IS NULL) || '/' || count(*) AS passed,
         CASE WHEN count(error) = 0 THEN 'PASS' ELSE 'FAIL' END AS category_status
  FROM outcomes GROUP BY category)
SELECT conv_id::VARCHAR AS id, category, CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS status,
       CASE WHEN error IS NULL THEN substring(coalesce(text, 'No response'), 1, 200) END AS response_preview,
       error, context, passed, category_status
FROM outcomes JOIN categories USING (category) JOIN contexts ON response_id = conv_id""",
}

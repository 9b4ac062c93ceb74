"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL = {
    "op1_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(22 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
                   + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op5_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / ((rank - 1) % 3 + 1) AS ratio,
         sum(source_size) OVER () AS total
  FROM sources
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         CASE WHEN level <= ratio THEN weight * (SELECT first(level ORDER BY ratio, rank) FROM levels WHERE level <= ratio) ELSE cap::DOUBLE END AS target
  FROM levels
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets
), hashes AS (
  SELECT source, hash, sum(size) AS held, count(*) AS n FROM sized GROUP BY source, hash
), running AS (
  SELECT h.source, h.hash, h.held, h.n, r.target - r.copies * r.source_size AS rest,
         sum(held) OVER (PARTITION BY h.source ORDER BY h.hash) AS up_to
  FROM hashes h JOIN rests r ON h.source IS NOT DISTINCT FROM r.source
), cuts AS (
  SELECT source, min(hash) AS cut, min_by(least(greatest(ceil((rest - (up_to - held)) / (held::DOUBLE / n) - 0.5), 0), n), hash) AS extra
  FROM running WHERE up_to > rest GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, hash) AS number FROM sized
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       (s.size * (r.copies + CASE WHEN r.copies < 3 AND (c.known IS NULL OR s.hash < c.cut OR s.hash = c.cut AND s.number <= c.extra) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM numbered s
JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
LEFT JOIN (SELECT *, 1 AS known FROM cuts) c ON s.source IS NOT DISTINCT FROM c.source
""",
    "op13_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || digest[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || digest[9:16])::BIGINT % (len(units) + 1) AS two,
         ('0x' || digest[17:24])::BIGINT AS third, ('0x' || digest[25:32])::BIGINT AS fourth
  FROM cut
), formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR third % 100 >= 100 THEN 'plain'
                 WHEN fourth % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
""",
}

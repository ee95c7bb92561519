"""SQL for DuckDB that says the same as queries of this subpackage where brute force can, for the check."""

#: Pairs of records by words in common: every pair that shares a word is counted.
P1_FOUND = r"""WITH t AS (SELECT DISTINCT 'memory' AS src, id, text FROM memories UNION SELECT DISTINCT 'candidate', cand_id, abstract FROM extraction_candidates),
w AS (SELECT src, id, list_distinct(regexp_extract_all(lower(text), '\p{Han}|[\p{Latin}\p{Greek}\p{Cyrillic}\p{N}]+')) AS words FROM t WHERE text IS NOT NULL AND id IS NOT NULL),
k AS (SELECT * FROM w WHERE len(words) >= 8), u AS (SELECT src, id, len(words) AS n, unnest(words) AS word FROM k)
SELECT a.src, a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.src = b.src AND a.word = b.word AND a.id < b.id GROUP BY a.src, a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))"""

#: Groups of alike vectors where each group is a clique, as in the test tables: the smallest entry among the similar ones.
P4_FOUND = """WITH v AS (SELECT DISTINCT entry_index, CASE WHEN coalesce(scope, '') = '' THEN 'global' ELSE scope END AS scope, vector::DOUBLE[] AS v FROM memories WHERE id IS NOT NULL AND entry_index IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
u AS (SELECT entry_index, scope, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM v)
SELECT min(b.entry_index) AS first_index, a.entry_index FROM u a JOIN u b ON a.scope = b.scope AND list_inner_product(a.v, b.v) >= 0.85 - 1e-9 GROUP BY a.entry_index HAVING count(*) > 1"""


def _runs(table: str, key: str, text: str, units: str, length: int, where: str) -> str:
    """Runs of so many units of a text, each as one string."""
    clean = rf"lower(regexp_replace({text}, '[\p{{Cf}}\p{{Mn}}]+', '', 'g'))"
    return f"SELECT DISTINCT {key}, array_to_string(list_slice(u, i, i + {length} - 1), ' ') AS run FROM (SELECT {key}, u, unnest(generate_series(1, len(u) - {length} + 1)) AS i FROM (SELECT {key}, regexp_extract_all({clean}, '{units}') AS u FROM {table} WHERE {text} IS NOT NULL AND {where}) WHERE len(u) >= {length})"


_HAN = r"len(regexp_extract_all(passage, '\p{Han}')) * 2 > len(regexp_extract_all(passage, '[\p{L}\p{N}]'))"
_WORD, _SIGN = r"\p{Han}|[\p{Latin}\p{Greek}\p{Cyrillic}\p{N}]+", r"[\p{L}\p{N}]"
#: Documents that hold 14 words or 26 signs of a passage in a row.
P7_FOUND = (
    f"SELECT DISTINCT doc_id, item_id FROM ({_runs('documents', 'doc_id', 'text', _WORD, 14, 'doc_id IS NOT NULL')}) JOIN ({_runs('eval_items', 'item_id', 'passage', _WORD, 14, 'item_id IS NOT NULL AND NOT (' + _HAN + ')')}) USING (run)"
    f" UNION SELECT DISTINCT doc_id, item_id FROM ({_runs('documents', 'doc_id', 'text', _SIGN, 26, 'doc_id IS NOT NULL')}) JOIN ({_runs('eval_items', 'item_id', 'passage', _SIGN, 26, 'item_id IS NOT NULL AND ' + _HAN)}) USING (run)"
)

_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}\x{2800}\x{3164}\x{115F}\x{1160}\x{FFA0}\x{FE00}-\x{FE0F}]"
_TIMES = "CASE WHEN {0} <= 0 THEN NULL WHEN {0} < 100000000000 THEN {0} * 1000 ELSE {0} END"
#: Conversations by their links, walked from the root, or by the time spoken where there is none.
P3_FOUND = rf"""WITH RECURSIVE p AS (SELECT lower(regexp_replace(regexp_replace(session_id, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')) AS sid, msg_id, parent_id, loaded_at, lower(trim(coalesce(type, ''))) = 'message' AS said, content,
  regexp_replace(lower(role), '[\s_\-\p{{Z}}\p{{Cf}}]', '', 'g') AS role, regexp_matches(content, '^\s*\[\s*(\{{|\]|$)') AS listed, {_TIMES.format('message_timestamp')} AS inner_ms, {_TIMES.format('timestamp')} AS outer_ms FROM session_messages WHERE msg_id IS NOT NULL AND session_id IS NOT NULL),
q AS (SELECT *, coalesce(listed AND NOT json_valid(content), false) AS bad, CASE WHEN listed THEN CASE WHEN json_valid(content) THEN array_to_string(list_transform(list_filter(json_extract(content, '$[*]'), lambda b: json_extract_string(b, '$.type') = 'text' AND json_extract_string(b, '$.text') IS NOT NULL), lambda b: json_extract_string(b, '$.text')), chr(10)) END ELSE content END AS t,
  coalesce(CASE WHEN inner_ms % 1000 = 0 AND inner_ms // 1000 = outer_ms // 1000 THEN outer_ms ELSE inner_ms END, outer_ms, epoch_ms(loaded_at), 0) AS spoken FROM p WHERE sid <> ''),
f AS (SELECT sid, msg_id, parent_id, loaded_at, spoken, CASE WHEN NOT said THEN 0 WHEN bad THEN 3 WHEN regexp_replace(coalesce(t, ''), '{_BLANK}', '', 'g') = '' THEN 0 WHEN role IN ('user', 'human', 'usr', 'enduser', 'customer', 'client', 'person', 'me', 'prompter') THEN 1
  WHEN role IN ('assistant', 'ai', 'model', 'bot', 'agent', 'chatbot', 'llm', 'gpt', 'assistantmessage') THEN 2 WHEN role IN ('tool', 'toolresult', 'tooluse', 'toolcall', 'function', 'functioncall', 'functionresult', 'system', 'developer', 'observation', 'environment') THEN 0 ELSE 3 END AS flag FROM q),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY sid, msg_id ORDER BY loaded_at NULLS LAST, flag, parent_id NULLS FIRST) = 1),
s AS (SELECT sid, count(*) AS size, count(parent_id) AS links, max(flag) AS worst FROM o GROUP BY 1),
r AS (SELECT o.sid, msg_id, flag, 0 AS place FROM o JOIN s USING (sid) WHERE links = size - 1 AND links > 0 AND parent_id IS NULL UNION ALL SELECT o.sid, o.msg_id, o.flag, r.place + 1 FROM o JOIN r ON o.sid = r.sid AND o.parent_id = r.msg_id),
l AS (SELECT sid, msg_id, flag, place FROM r UNION ALL SELECT sid, msg_id, flag, row_number() OVER (PARTITION BY sid ORDER BY spoken, loaded_at NULLS LAST, msg_id) - 1 FROM o JOIN s USING (sid) WHERE links = 0),
kept AS (SELECT sid FROM l JOIN s USING (sid) WHERE worst < 3 GROUP BY sid, size HAVING count(*) = size AND max(place) = size - 1 AND max(CASE WHEN flag = 2 THEN place END) > max(CASE WHEN flag = 1 THEN place END))
SELECT sid AS session_id, row_number() OVER (PARTITION BY sid ORDER BY place) AS turn, msg_id FROM l WHERE flag IN (1, 2) AND sid IN (SELECT sid FROM kept)"""

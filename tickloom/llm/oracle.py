"""SQL twins of the corpus queries that SQL can express; constants are written out, not shared with the operators."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {PLAIN} AS ws FROM documents),
s AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
n AS (SELECT doc_id, p, w AS a, lead(w, 1) OVER t AS b, lead(w, 2) OVER t AS c, lead(w, 3) OVER t AS e FROM w
      WINDOW t AS (PARTITION BY doc_id ORDER BY p)),
base AS (
  SELECT doc_id, p, 'gpl' AS label FROM n WHERE a = 'gnu' AND b = 'general' AND c = 'public' AND e = 'license'
  UNION ALL SELECT doc_id, p, 'apache' FROM n WHERE a = 'apache' AND b = 'license'
  UNION ALL SELECT doc_id, p, 'cc-by' FROM n WHERE a = 'cc' AND b = 'by'
  UNION ALL SELECT doc_id, p, 'mit' FROM n WHERE a = 'mit' AND b = 'license'),
made AS (
  SELECT * FROM (SELECT doc_id, unnest([
    CASE WHEN regexp_matches(line, ' licensed under the (terms of the )?apache license (version )?2 0 ') THEN 'apache-2.0' END,
    CASE WHEN regexp_matches(line, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ([^ ]+ )?([^ ]+ )?([^ ]+ )?([^ ]+ )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer ([^ ]+ )?([^ ]+ )?([^ ]+ )?([^ ]+ )?redistributions in binary form must reproduce the above copyright notice ') THEN 'bsd-3-clause' END,
    CASE WHEN regexp_matches(line, ' licensed under (a creative commons )?(the )?cc by 4 0 ') THEN 'cc-by-4.0' END,
    CASE WHEN regexp_matches(line, ' licensed under (a creative commons )?(the )?cc by nc 4 0 ') THEN 'cc-by-nc-4.0' END,
    CASE WHEN regexp_matches(line, ' licensed under (a creative commons )?(the )?cc by sa 4 0 ') THEN 'cc-by-sa-4.0' END,
    CASE WHEN regexp_matches(line, ' licensed under the (terms of the )?gnu general public license (as published by the free software foundation )?version 2 ') THEN 'gpl-2.0' END,
    CASE WHEN regexp_matches(line, ' licensed under the (terms of the )?gnu general public license (as published by the free software foundation )?version 3 ') THEN 'gpl-3.0' END,
    CASE WHEN regexp_matches(line, ' permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies ') THEN 'isc' END,
    CASE WHEN regexp_matches(line, ' released under the (terms of the )?mit license ') THEN 'mit-notice' END,
    CASE WHEN regexp_matches(line, ' permission is hereby granted free of charge to any person obtaining a copy of ([^ ]+ ){{1,6}}and associated documentation files (the software )?to deal in ([^ ]+ ){{1,4}}without restriction ') THEN 'mit-text' END,
    CASE WHEN regexp_matches(line, ' subject to the terms of the mozilla public license (v )?(version )?2 0 ') THEN 'mpl-2.0' END
  ]) AS label FROM s) WHERE label IS NOT NULL),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM made) GROUP BY doc_id),
m AS (SELECT DISTINCT doc_id FROM made)
SELECT s.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN m.doc_id IS NOT NULL THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM s LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP3 = rf"""
WITH dw AS (SELECT doc_id, {PLAIN} AS ws FROM documents),
d AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM dw),
iw AS (SELECT item_id, {PLAIN} AS ws FROM benchmark),
i AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM iw),
ds AS (SELECT doc_id, concat_ws(' ', w, lead(w, 1) OVER t, lead(w, 2) OVER t, lead(w, 3) OVER t, lead(w, 4) OVER t) AS s,
         lead(w, 4) OVER t IS NOT NULL OR (p = 1 AND count(*) OVER (PARTITION BY doc_id) < 5) AS whole
       FROM d WINDOW t AS (PARTITION BY doc_id ORDER BY p)),
its AS (SELECT item_id, concat_ws(' ', w, lead(w, 1) OVER t, lead(w, 2) OVER t, lead(w, 3) OVER t, lead(w, 4) OVER t) AS s,
         lead(w, 4) OVER t IS NOT NULL OR (p = 1 AND count(*) OVER (PARTITION BY item_id) < 5) AS whole
       FROM i WINDOW t AS (PARTITION BY item_id ORDER BY p)),
q AS (SELECT DISTINCT item_id, s FROM its WHERE whole),
size AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(DISTINCT q.s) AS n_shared FROM ds JOIN q ON ds.s = q.s WHERE ds.whole GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(n_shared AS BIGINT) AS n_shared, n_shared / n_shingles AS containment
FROM hit JOIN size USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""

ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"

OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
        sum(length('<s>[ROLE]') + length({ESCAPED.format('role')}) + length('[/ROLE]') + 1 + length({ESCAPED.format('text')}) + length('</s>')) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(spoken) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM a
"""

OP6 = rf"""
WITH p AS (SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.-])(casino|pills|spam)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT doc_id, p, concat_ws(' ', w, lead(w, 1) OVER t, lead(w, 2) OVER t, lead(w, 3) OVER t, lead(w, 4) OVER t, lead(w, 5) OVER t, lead(w, 6) OVER t, lead(w, 7) OVER t) AS s,
        lead(w, 7) OVER t IS NOT NULL AS whole FROM w WINDOW t AS (PARTITION BY doc_id ORDER BY p)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g WHERE whole) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_letters >= 40 AND 10 * n_upper > 8 * n_letters) OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b
"""

def _checksum(text: str) -> str:
    """CRC-32 of a text of ASCII characters: each byte takes two steps through the table of the reflected polynomial's nibbles."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    step = f"xor({{0}} >> 4, {[*table]}[(({{0}}) & 15) + 1])"
    once = step.format("xor(acc, x)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda acc, x: {step.format(once)}), 4294967295)"


def _framed(column: str) -> str:
    own = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({own}) || ':' || {own}, '-')"


OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS leaf,
    CASE WHEN {_checksum('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', 'n_chars', LOWER.format('text'))))}) END AS claimed
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv AS (
  SELECT CAST(0 AS BIGINT) AS level, tree, pos, n, leaf AS digest FROM n
  UNION ALL
  SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY level, tree, pos // 16, n),
r AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
top AS (
  SELECT CAST(0 AS BIGINT) AS level, pos, n, subroot AS digest FROM r
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16, n),
s AS (
  SELECT level, tree, pos, coalesce(string_agg(digest, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(digest, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM (SELECT level, tree, pos, n, digest FROM lv UNION ALL SELECT level, NULL, pos, n, digest FROM top) q
  WHERE n > 1 WINDOW b AS (PARTITION BY level, tree, pos // 16 ORDER BY pos)),
p AS (
  SELECT n.doc_id, n.leaf, n.claimed, n.tree, n.pos, list(lft || '|' || rgt ORDER BY s.level) AS steps, string_agg(lft || rgt, '' ORDER BY s.level) AS sibs
  FROM n LEFT JOIN s ON s.tree = n.tree AND s.pos = n.pos // CAST(16 ** s.level AS BIGINT) GROUP BY ALL),
u AS (
  SELECT r.tree, r.subroot, list(lft || '|' || rgt ORDER BY s.level) AS steps, string_agg(lft || rgt, '' ORDER BY s.level) AS sibs
  FROM r LEFT JOIN s ON s.tree IS NULL AND s.pos = r.pos // CAST(16 ** s.level AS BIGINT) GROUP BY ALL),
f AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(p.sibs, '') || coalesce(u.sibs, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(claimed, leaf), list_filter(list_concat(p.steps, u.steps), lambda x: x IS NOT NULL)),
      lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
  FROM p JOIN u USING (tree))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": OP1,
    "op3_benchmark_leaks": OP3,
    "op5_chat_format": OP5,
    "op6_url_filter": OP6,
    "op8_quality_ledger": OP8,
    "op13_merkle_manifest": OP13,
}

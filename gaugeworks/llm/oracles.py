"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import decontaminate, lexical, licenses, prefix_trie

WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def license_scan() -> str:
    v = licenses
    values = ", ".join(f"({i}, '{label}', {base}, {size}, {must}, {t}, '{gram}')" for i, label, base, size, must, t, gram in v.template_rows())
    return f"""
WITH docs AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
places AS (SELECT * FROM (VALUES {values}) AS t(template, label, base, size, must, t, gram)),
starts AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 0))) AS p FROM docs),
grams AS (
  SELECT doc_id, p, array_to_string(w[p + 1 : p + n], ' ') AS gram
  FROM starts, (VALUES ({v.BASE_GRAM}), ({v.GRAM})) AS k(n) WHERE p + n <= len(w)),
votes AS (
  SELECT doc_id, template, label, base, size, must, p - t AS diagonal, list(DISTINCT t) AS places
  FROM grams JOIN places USING (gram) GROUP BY ALL),
apart AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {v.NEAR} THEN 0 ELSE 1 END AS apart
  FROM votes WHERE NOT base WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM apart),
pairs AS (
  SELECT doc_id, template, label, base, size, must, span, t, min(diagonal) + t AS p
  FROM (SELECT * EXCLUDE places, unnest(places) AS t FROM numbered) GROUP BY doc_id, template, label, base, size, must, span, t),
ordered AS (
  SELECT *, max(p) OVER (PARTITION BY doc_id, template, span ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS behind FROM pairs),
kept AS (
  SELECT *, least({v.GRAM}, coalesce(t - lag(t) OVER (PARTITION BY doc_id, template, span ORDER BY t), {v.GRAM})) AS new
  FROM ordered WHERE behind IS NULL OR p > behind),
merged AS (
  SELECT doc_id, label, base, size, must, min(p) AS start, max(p) + {v.GRAM} AS stop, sum(new) / size AS share, count(*) FILTER (list_contains(must, t)) AS told
  FROM kept GROUP BY doc_id, template, label, base, size, must, span),
spans AS (
  SELECT doc_id, label, base, diagonal AS start, 1.0::DOUBLE AS share FROM votes WHERE base AND len(places) = size - {v.BASE_GRAM - 1}
  UNION ALL
  SELECT doc_id, label, base, start, share FROM merged WHERE share >= {v.VERIFIED} AND told = len(must) AND stop - start <= {v.STRETCH} * size + {v.NEAR}),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM spans GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (doc_id)"""


def decontamination() -> str:
    d = decontaminate
    return f"""
WITH docs AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, {WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i + 1 : i + {d.WINDOW}] AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {d.WINDOW - 1}, 1))) AS i FROM items WHERE len(w) > 0)),
phrases AS (SELECT DISTINCT phrase FROM windows),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM phrases),
starts AS (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS s FROM docs, sizes),
hits AS (SELECT doc_id, s, n, phrase FROM starts JOIN phrases ON w[s + 1 : s + n] = phrase),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hits) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
  FROM hits JOIN windows USING (phrase) GROUP BY doc_id),
placed AS (SELECT phrase, len(phrase) AS n, unnest(phrase) AS term, unnest(range(len(phrase))) AS o FROM phrases),
posts AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM docs),
freq AS (SELECT term, count(*) AS freq FROM posts WHERE term IN (SELECT term FROM placed) GROUP BY term),
whole AS (SELECT phrase, n, term, min(o) AS o, freq FROM placed JOIN freq USING (term) WHERE phrase IN (SELECT phrase FROM placed JOIN freq USING (term) GROUP BY phrase, n HAVING count(*) = n) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY freq, encode(term)) AS rank, least(count(*) OVER (PARTITION BY phrase), {d.ANCHORS}) AS parts FROM whole),
lists AS (SELECT doc_id, phrase, rank, parts, pos - o AS start FROM posts JOIN ranked USING (term) WHERE rank <= {d.ANCHORS}),
near AS (
  SELECT DISTINCT a.doc_id, a.phrase FROM lists a LEFT JOIN lists b ON a.doc_id = b.doc_id AND a.phrase = b.phrase AND b.rank > 1 AND b.start BETWEEN a.start - {d.SLOP} AND a.start + {d.SLOP}
  WHERE a.rank = 1 GROUP BY a.doc_id, a.phrase, a.start, a.parts HAVING count(DISTINCT b.rank) = a.parts - 1),
close AS (SELECT doc_id, count(*) AS n_near FROM near ANTI JOIN hits USING (doc_id, phrase) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN close USING (doc_id)"""


def prefix_trie_sql() -> str:
    v = prefix_trie
    step = "list_reduce(range(8), lambda x, _: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte))"
    crc = f"xor(list_reduce([ord(b)::BIGINT FOR b IN regexp_extract_all(conv_id::VARCHAR, '.')], lambda crc, byte: {step}, 4294967295::BIGINT), 4294967295)"
    return f"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
parts AS (SELECT *, {crc} % {v.SHARED} AS h, conv_id - conv_id % {v.FAMILY} AS first FROM turns),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1 : a.h], []), a.turns[a.h + 1 : len(a.turns)]) AS turns
  FROM parts a LEFT JOIN turns b ON b.conv_id = a.first),
places AS (SELECT conv_id, d, turns[1 : d] AS prefix, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS c, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids,
    CASE WHEN d > 0 THEN (count(*) - 1) * strlen(prefix[d].t) ELSE 0 END AS saved
  FROM places GROUP BY prefix, d),
steps AS (SELECT conv_id, d, c FROM places JOIN nodes USING (prefix, d)),
linked AS (SELECT n.*, s.c AS up FROM nodes n LEFT JOIN steps s ON s.conv_id = n.c AND s.d = n.d - 1),
kids AS (SELECT up AS c, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
sums AS (
  SELECT s.c, s.d, sum(n.saved) AS saved, count(*) FILTER (k.c IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k USING (c, d) JOIN steps s ON s.conv_id = n.c AND s.d <= n.d GROUP BY s.c, s.d)
SELECT c::BIGINT AS conv_id, d::BIGINT AS depth, up::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(ids) AS ends_sha256
FROM linked LEFT JOIN kids USING (c, d) JOIN sums USING (c, d)"""


def lexical_search() -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {WORDS.format("text")} AS w FROM documents),
total AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
posts AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS item, item_id, unnest({WORDS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM df, total),
scored AS (
  SELECT item, item_id, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN posts USING (term) JOIN weights USING (term), total GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scored WHERE score > 0)
WHERE rank <= {lexical.TOP}"""

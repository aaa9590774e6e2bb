"""DuckDB SQL of the operator queries that SQL can express on whole tables."""

from __future__ import annotations

NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"

OP3 = f"""
WITH t AS (SELECT doc_id, {NORM} AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

ORACLE_SQL = {"op3_exact_dedup": OP3}


def _license_sql() -> str:
    from . import licenses as L

    words = "regexp_extract_all(translate({}, '" + L.UPPER + "', '" + L.LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    lists = []
    for phrase, label in L.PHRASES.items():
        ws = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws))
        lists.append(f"list_transform(list_filter(range(len(w)), lambda i: {test}), lambda i: {{'start': i, 'label': '{label}'}})")
    places = lists[0]
    for x in lists[1:]:
        places = f"list_concat({places}, {x})"
    # Words of notices with what their notice needs: (notice, label, distinct words, needed, stretch, word).
    notices = ", ".join(f"({k}, '{label}', {len(set(t.split()))}, {L.need_of(t, L.CONTAINMENT)}, {L.stretch_of(t)}, '{w}')"
                        for k, (t, label) in enumerate(L.NOTICES) for w in sorted(set(t.split())))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, {words.format('text')} AS w FROM d),
p AS (SELECT doc_id, len(w) AS n_words, {places} AS places FROM b),
notices(notice, label, size, need, stretch, word) AS (VALUES {notices}),
spots AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM b),
near AS (SELECT doc_id, label, size, need,
                count(DISTINCT word) OVER (PARTITION BY doc_id, notice ORDER BY pos RANGE BETWEEN CURRENT ROW AND stretch - 1 FOLLOWING) AS overlap
         FROM spots JOIN notices USING (word)),
found AS (SELECT doc_id, list(DISTINCT label) AS found, max(overlap / size) AS best FROM near WHERE overlap >= need GROUP BY doc_id)
SELECT p.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(list_transform(places, lambda x: x.start)) AS BIGINT) AS first_word,
       CAST(list_max(list_transform(places, lambda x: x.start)) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), coalesce(found, [])))), ',') AS labels,
       CAST(CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM p LEFT JOIN found USING (doc_id)
"""


ORACLE_SQL["op10_licenses"] = _license_sql()


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes: every byte is a term, followed by
    eight shifts (-1)."""
    terms = (f"flatten(list_transform(range(0, octet_length(encode({text}))), "
             f"lambda k: [CAST('0x' || substr(hex({text}), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))")
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {terms}), lambda c, x: {step}), 4294967295::BIGINT)"


ORACLE_SQL["op11_substring_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
wins AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS least FROM wins GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM wins JOIN firsts USING (s)
         WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
flagged AS (SELECT words.*, gone.k IS NOT NULL AS gone FROM words LEFT JOIN gone ON gone.r = words.r AND gone.k = words.k),
result AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept
           FROM flagged GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN result USING (r)
"""

# Words one edit apart share a word, or a word without one of its code points.
ORACLE_SQL["op12_spelling"] = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
pairs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32('name')} AS h FROM pairs),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER))
                 ELSE run END AS word, c FROM hashed),
vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocab),
less AS (SELECT word, n, p, substr(word, 1, CAST(p - 1 AS INTEGER)) || substr(word, CAST(p + 1 AS INTEGER)) AS v FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.v = b.v AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
named AS (SELECT best.word, best.n_near, best.m, min(near.other) AS other FROM best JOIN near ON near.word = best.word AND near.m = best.m
          GROUP BY ALL),
forms AS (SELECT vocab.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form,
                 CASE WHEN m >= 10 * n THEN m END AS form_n FROM vocab LEFT JOIN named ON named.word = vocab.word),
walk AS (SELECT word, word AS place, 0 AS steps FROM forms
         UNION ALL SELECT walk.word, forms.form, steps + 1 FROM walk JOIN forms ON forms.word = walk.place WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(place, steps) AS root FROM walk GROUP BY word)
SELECT forms.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN roots ON roots.word = forms.word
"""

ORACLE_SQL["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t),
rebuilt AS (SELECT c.conv_id, 0 AS kind, t.pos, role, text FROM convs c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
            UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY kind, pos) AS depth, length(text) AS chars,
                    sha256(length(role) || ':' || role || text) AS digest FROM rebuilt),
paths AS (SELECT conv_id, depth, chars, string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM numbered
          UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own FROM paths GROUP BY node),
tops AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
         FROM paths p JOIN tops USING (conv_id, depth) GROUP BY node),
up AS (SELECT n.node, n.depth, n.conv_id, p.node AS parent FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent),
subtree AS (SELECT above.node, sum(n.own) AS saved_tokens, count(*) FILTER (WHERE kids.parent IS NULL) AS n_leaves
            FROM nodes n JOIN paths above ON above.conv_id = n.conv_id AND above.depth <= n.depth LEFT JOIN kids ON kids.parent = n.node
            GROUP BY above.node)
SELECT n.conv_id, n.depth, pn.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN up USING (node) LEFT JOIN nodes pn ON pn.node = up.parent LEFT JOIN kids ON kids.parent = n.node
JOIN subtree s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""

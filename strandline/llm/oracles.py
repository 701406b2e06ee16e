"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .pii import IBAN_LENGTH

OP1 = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

_VALUE = "[0-9A-Za-z./_+-]{16,}={0,2}"
_NAMES = ("token", "secret", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey", "password", "passwd", "pwd")
_FIRST_LINES = "|".join("-----BEGIN " + "[A-Z]+ " * k + "PRIVATE KEY-----" for k in (3, 2, 1, 0))
_PREFIXED = "|".join([rf"\bgh{x}_[0-9A-Za-z]{{36}}\b" for x in "oprsu"] + [r"\bAKIA[A-Z0-9]{16}\b"])
#: Written apart from the operator's own pattern.
SECRETS = (
    f"""(?i:{'|'.join(_NAMES)})["'']?(?: | {{2}})?[:=](?: | {{2}})?["'']?{_VALUE}|[Bb][Ee][Aa][Rr][Ee][Rr] {_VALUE}|{_FIRST_LINES}|{_PREFIXED}"""
    r"|\beyJ[0-9A-Za-z_-]{10,}(?:\.[0-9A-Za-z_-]{10,}){2}"
)

# Account numbers are sought as runs of letters and digits and cut at their country's length.
OP2 = r"""
WITH iban_length(country, n) AS (VALUES LENGTHS),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
  SELECT doc_id, t, kind, k, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS i, g, m AS ms
  FROM (
    SELECT doc_id, t, 'email' AS kind, 1 AS k, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m,
           string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM d
    UNION ALL
    SELECT doc_id, t, 'ip', 2, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
    UNION ALL
    SELECT doc_id, t, 'card', 3, regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), string_split_regex(t, '[0-9](?:[ -]?[0-9])+') FROM d
    UNION ALL
    SELECT doc_id, t, 'phone', 4, regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][ ().0-9-]+[0-9]') FROM d
    UNION ALL
    SELECT doc_id, t, 'iban', 5, regexp_extract_all(t, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+'), string_split_regex(t, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+') FROM d
    UNION ALL
    SELECT doc_id, t, 'secret', 7, regexp_extract_all(t, 'SECRETS'), string_split_regex(t, 'SECRETS') FROM d
    UNION ALL
    SELECT doc_id, t, 'ssn', 6, regexp_extract_all(t, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'), string_split_regex(t, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') FROM d)
),
placed AS (
  SELECT doc_id, t, kind, k, m,
         list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS s,
         regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS plain, n,
         list_filter(range(1, length(m) + 1), lambda j: m[j] <> ' ')[n] AS e,
         CASE WHEN kind = 'secret' THEN regexp_extract(m, '([A-Za-z0-9_+/.-]{16,}={0,2}|-----BEGIN[A-Z ]+-----)$', 1) ELSE m END AS own
  FROM hits LEFT JOIN iban_length ON kind = 'iban' AND country = m[1:2]),
checked AS (
  SELECT *, lower(t[greatest(s + length(m) - length(own) - 39, 1)::BIGINT:(s + length(m) - length(own))::BIGINT]) AS near FROM placed
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])')))
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
        lambda j: (digits[length(digits) - j + 1]::INT * (2 - j % 2)) // 10 + (digits[length(digits) - j + 1]::INT * (2 - j % 2)) % 10)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'iban' THEN n <= length(plain) AND (n = length(plain) OR m[e + 1] = ' ') AND list_reduce(list_prepend(0,
        list_transform(string_split(plain[5:n] || plain[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
        lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
    WHEN 'secret' THEN m LIKE '-----%' OR regexp_matches(own, '[0-9][^=:]*$')
    ELSE NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') END),
scored AS (
  SELECT *, round(least(1.0,
           CASE kind WHEN 'email' THEN 0.9 WHEN 'card' THEN 0.9 WHEN 'iban' THEN 0.9 WHEN 'ssn' THEN 0.3 ELSE 0.6 END
           + CASE WHEN regexp_matches(near, CASE kind
               WHEN 'email' THEN 'e-?mail|contact|write to|reach' WHEN 'ip' THEN '(^|[^a-z0-9_])ip($|[^a-z0-9_])|address|host|server|login'
               WHEN 'card' THEN 'card|visa|credit|payment|debit' WHEN 'phone' THEN 'phone|call|tel|mobile|fax' WHEN 'iban' THEN 'iban|account|bank|transfer'
               WHEN 'ssn' THEN '(^|[^a-z0-9_])ssn($|[^a-z0-9_])|social security|taxpayer' ELSE 'token|secret|key|passw|bearer' END) THEN 0.3 ELSE 0 END
           - CASE WHEN regexp_matches(near, 'example|sample|dummy|order no|part no|serial') THEN 0.3 ELSE 0 END), 2)::DOUBLE AS score FROM checked),
kept AS (
  SELECT doc_id, kind, k, s::BIGINT AS s, kind || ':' || (s + length(m) - length(own))::BIGINT || ':' || (s + CASE WHEN kind = 'iban' THEN e ELSE length(m) END)::BIGINT AS span, score
  FROM scored WHERE k <= 4 OR score >= 0.5),
per AS (
  SELECT doc_id, count(*) FILTER (k = 1) AS e, count(*) FILTER (k = 2) AS i, count(*) FILTER (k = 3) AS c, count(*) FILTER (k = 4) AS p,
         count(*) FILTER (k = 5) AS n5, count(*) FILTER (k = 6) AS n6, count(*) FILTER (k = 7) AS n7, count(*) AS n, max(score) AS top,
         string_agg(span, ',' ORDER BY k, s) FILTER (k <= 4) AS b, string_agg(span, ',' ORDER BY k, s) AS a
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans,
       coalesce(n5, 0) AS n_iban, coalesce(n6, 0) AS n_ssn, coalesce(n7, 0) AS n_secret, coalesce(n, 0) AS n_spans, coalesce(top, 0) AS top_score
FROM d LEFT JOIN per USING (doc_id)
""".replace("LENGTHS", ", ".join(f"('{c}', {n})" for c, n in IBAN_LENGTH.items())).replace("SECRETS", SECRETS)

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
tok AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS term FROM d),
occ AS (
  SELECT doc_id, item_id, pos, len(win) AS n FROM tok JOIN wins ON term = win[1]
  WHERE list_slice(w, pos, pos + len(win) - 1) = win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, hash(array_to_string(list_slice(w, s, s + 19), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
gone AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
cov AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM gone) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM cov)),
left_over AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY p) AS kept
  FROM word LEFT JOIN (SELECT doc_id, unnest(ps) AS p, 1 AS g FROM cov) USING (doc_id, p) WHERE g IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT min(doc_id) AS c, w FROM d WHERE len(w) > 0 GROUP BY w),
sh AS (SELECT DISTINCT c, list_slice(w, s, s + least(5, len(w)) - 1) AS g
       FROM (SELECT c, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM c)),
n AS (SELECT c, count(*) AS n FROM sh GROUP BY c),
links AS (
  SELECT a.c AS a, b.c AS b FROM sh AS a JOIN sh AS b ON a.g = b.g AND a.c < b.c JOIN n AS x ON x.c = a.c JOIN n AS y ON y.c = b.c
  GROUP BY a.c, b.c, x.n, y.n HAVING 9 * count(*) >= 4 * (x.n + y.n)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM c UNION SELECT reach.c, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
cluster AS (SELECT c, min(r) AS class_id FROM reach GROUP BY c),
deg AS (SELECT a AS c, count(*) AS n_links FROM pairs GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(c.c, d.doc_id) AS copy_of, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN c ON c.w = d.w LEFT JOIN cluster ON cluster.c = c.c LEFT JOIN deg ON deg.c = c.c
"""

_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"
_CRC = "xor(list_reduce(list_transform(range(octet_length({0}::BLOB)), lambda k: ('0x' || substr(hex({0}::BLOB), 2 * k + 1, 2))::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295)"

# Two words are near if the same place deleted leaves the same, or one's deletion is the other.
OP11 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {_CRC.format("encode(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM c, crc),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run) + 2)::BIGINT:] ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING sum(n) >= 5),
v AS (SELECT word, n FROM w WHERE length(word) >= 6),
del AS (SELECT word, i, word[1:i] || word[i + 2:] AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM del a JOIN del b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT del.word, v.word FROM del JOIN v ON v.word = del.cut
  UNION SELECT v.word, del.word FROM del JOIN v ON v.word = del.cut),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS form FROM near JOIN v ON v.word = near.b GROUP BY a),
formed AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN form END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, last) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.last WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, walk.last AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN walk USING (word) JOIN formed AS e ON e.word = walk.last WHERE e.form IS NULL
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

# Each level's pairs are hashed until one node a tree is left; null languages sort before all by the empty key.
OP12 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS more,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295) % 7 = 0 AS touched
  FROM documents, crc),
p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
tree(g, lvl, i, h, n) AS (
  SELECT g, 0, i, leaf, n FROM p
  UNION ALL
  SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, i // 2, n),
sub AS (SELECT g, h, lvl AS top, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m FROM tree WHERE n = 1),
crown(lvl, i, h, n) AS (
  SELECT 0, j, h, m FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY lvl, i // 2, n),
steps AS (
  SELECT p.g, p.i, t.lvl, CASE WHEN (p.i >> t.lvl) % 2 = 1 THEN coalesce(s.h, '') || '|' ELSE '|' || coalesce(s.h, '') END AS x
  FROM p JOIN (SELECT DISTINCT g, lvl FROM tree WHERE n > 1) t ON t.g = p.g LEFT JOIN tree s ON s.g = p.g AND s.lvl = t.lvl AND s.i = xor(p.i >> t.lvl, 1)),
low AS (SELECT g, i, list(x ORDER BY lvl) AS xs FROM steps GROUP BY g, i),
over AS (
  SELECT sub.g, list(CASE WHEN (sub.j >> t.lvl) % 2 = 1 THEN coalesce(s.h, '') || '|' ELSE '|' || coalesce(s.h, '') END ORDER BY t.lvl) AS xs
  FROM sub JOIN (SELECT DISTINCT lvl FROM crown WHERE n > 1) t ON true LEFT JOIN crown s ON s.lvl = t.lvl AND s.i = xor(sub.j >> t.lvl, 1) GROUP BY sub.g),
proved AS (
  SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, CASE WHEN touched THEN coalesce(more, leaf) ELSE leaf END AS shown,
         list_concat(coalesce(low.xs, []), coalesce(over.xs, [])) AS xs
  FROM p JOIN sub ON sub.g = p.g LEFT JOIN low ON low.g = p.g AND low.i = p.i LEFT JOIN over ON over.g = p.g)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(xs, ''), '|', '')) AS proof_sha256,
       list_reduce(xs, lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), shown) AS folded_root,
       list_reduce(xs, lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), shown) = root AS verified
FROM proved
"""

OP13 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""

ORACLES = {"op1_exact_dedup": OP1, "op2_pii": OP2, "op3_decontaminate": OP3, "op6_substring_dedup": OP6, "op9_ngram_join": OP9, "op11_spelling": OP11, "op12_merkle_manifest": OP12, "op13_line_dedup": OP13}

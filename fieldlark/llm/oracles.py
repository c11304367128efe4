"""SQL with the results of the queries that SQL can express on whole tables: brute force, without candidates or filters."""

from __future__ import annotations

from fieldlark.llm import divergence, license_scan, spelling

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPONENTS = """r AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b), comp AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""


def license_sql(o: license_scan.Scan) -> str:
    rows, words = [], []
    items = [(v, True, k, 1.0) for k, v in license_scan.BASE.items()] + [(v, False, k, o.threshold) for v, k in o.notices]
    for n, (label, base, text, share) in enumerate(items):
        own = [w.decode() for w in license_scan.words_of(text)]
        rows.append(f"({n}, '{label}', {base}, {len(set(own))}, {share}::DOUBLE)")
        words += [f"({n}, {i}, '{w}')" for i, w in enumerate(own)]
    half = o.block // 2
    return f"""WITH t(k, label, base, size, share) AS (VALUES {", ".join(rows)}), tw(k, i, w) AS (VALUES {", ".join(words)}),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d), v AS (SELECT DISTINCT w FROM tw),
q AS (SELECT doc_id, p.w, pos FROM p JOIN v USING (w)), b AS (SELECT doc_id, w, pos // {half} AS block FROM q UNION SELECT doc_id, w, pos // {half} - 1 FROM q WHERE pos >= {half}),
c AS (SELECT doc_id, block, k, count(*) AS n FROM b JOIN (SELECT DISTINCT k, w FROM tw) USING (w) GROUP BY ALL),
h AS (SELECT DISTINCT doc_id, label, n / CAST(size AS DOUBLE) AS s FROM c JOIN t USING (k) WHERE NOT base AND n >= ceil(share * size)),
s0 AS (SELECT q.doc_id, tw.k, q.pos - tw.i AS start, count(*) AS n FROM q JOIN tw USING (w) JOIN t ON t.k = tw.k AND t.base GROUP BY ALL),
places AS (SELECT doc_id, start, label FROM s0 JOIN t USING (k) JOIN (SELECT k, count(*) AS m FROM tw GROUP BY k) USING (k) WHERE n = m),
pb AS (SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM places GROUP BY doc_id),
al AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(s) AS s FROM (SELECT doc_id, label, s FROM h UNION ALL SELECT doc_id, label, 1.0::DOUBLE FROM places) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(pb.n, 0) AS n_base, pb.lo AS first_word, pb.hi AS last_word, coalesce(pb.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, coalesce(al.s, 0.0::DOUBLE) AS score
FROM d LEFT JOIN pb USING (doc_id) LEFT JOIN al USING (doc_id)"""


EMBEDDINGS = f"""WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98), {_COMPONENTS},
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN comp ON comp.id = vec_id"""

_CONTROL = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_COUNT = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"
_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', ''))" + "".join(f" + {_COUNT.format('{0}', s, len(s))}" for s in _CONTROL)
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
 sum(8 + {_ESCAPED.format("role")} + {_COUNT.format("role", "' || chr(10) || '", 1)} + 1 + {_ESCAPED.format("text")} + 7) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS ss FROM w),
x AS MATERIALIZED (SELECT doc_id, len(ss) AS n, unnest(ss) AS sh FROM s), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * n >= 85 * (na + nb - n)), {_COMPONENTS}
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM s LEFT JOIN comp ON comp.id = doc_id"""


def spelling_sql(rule: spelling.Spelling) -> str:
    """Runs, the crc32 of document and run by its polynomial, and near words by their texts with one code point left out."""
    return rf"""
with recursive bits(byte, k, v) as (
  select range::bigint, 0, range::bigint from range(256)
  union all select byte, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8
), steps as (select list(v order by byte) t from bits where k = 8),
runs as (
  select coalesce(doc_id::varchar, '') || ':' || translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as keyed,
    translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) run from documents)
), counted as (select keyed, run, count(*) c from runs where length(run) >= {rule.length} group by all),
hexed as (select *, hex(encode(keyed)) x from counted),
hashed as (
  select run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i+1])::bigint)),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) h
  from hexed, steps
), slipped as (
  select case when h % {rule.slip} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, c from hashed
), w as (select word, sum(c)::bigint n from slipped where length(word) >= {rule.length} group by word having sum(c) >= {rule.count}),
cuts as (select word, n, unnest(range(1, length(word) + 1)) i from w),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from cuts),
near as (
  select a.word, b.word other, b.n from less a join less b on a.i = b.i and a.rest = b.rest and length(a.word) = length(b.word) and a.word <> b.word
  union select a.word, w.word, w.n from less a join w on a.rest = w.word
  union select w.word, a.word, a.n from less a join w on a.rest = w.word
), best as (select word, count(*) n_near, max(n) most, min(other) filter (n = top) form from (select *, max(n) over (partition by word) top from near) group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) n_near, case when most >= {rule.lead} * w.n then form end form, case when most >= {rule.lead} * w.n then most end form_n from w left join best using (word)),
walk as (select word, word spot, form as next, 0 k from formed union all select walk.word, f.word, f.form, k + 1 from walk join formed f on f.word = walk.next)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join (select word, arg_max(spot, k) root from walk group by word) r using (word)
"""


#: Holds for tables whose article is an ``article`` element without anything to leave out, as that of the test tables.
MAIN_TEXT = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) t from pages),
b as (select page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br|div|li|ul)( [^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g') t from a),
c as (select page_id, url, replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"') t from b),
d as (select page_id, url, regexp_replace(replace(replace(t, '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g') t from c),
e as (select page_id, url, trim(regexp_replace(t, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]+', ' ', 'g')) t from d)
select page_id, url, t as text, length(t) n_chars, case when t <> '' then '/html/body/article' end path from e
"""


def divergence_sql(rule: divergence.Audit) -> str:
    """Shares of all kept terms in every group and language, and sums over pairs of groups."""
    return rf"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
v as (select lang, term, count(*)::hugeint c from t group by all having count(distinct id) >= {rule.docs}),
sizes as (select lang, count(*)::hugeint v, sum(c)::hugeint n from v group by lang),
groups as (select distinct lang, source from d),
own as (select lang, source, term, count(*)::hugeint c from t group by all),
counts as (select g.lang, g.source, v.term, coalesce(o.c, 0) c, sum(coalesce(o.c, 0)) over (partition by g.lang, g.source) n, sizes.v, v.c lang_c, sizes.n lang_n
  from groups g join v using (lang) join sizes using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = v.term),
p as (select *, 1 + 1000000000::hugeint * (c + 2) // (n::hugeint + 2 * v) p, 1 + 1000000000::hugeint * (lang_c + 2) // (lang_n + 2 * v) q from counts),
pairs as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source item, coalesce(x.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
ranked as (select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item) rank from every
  union all select * from (select lang, source, 'term' part, term item, ((p - q) * (p - q) // (p + q))::bigint as value, row_number() over (partition by lang, source order by (p - q) * (p - q) // (p + q) desc, term) rank from p where c > 0 and p > q) where rank <= {rule.terms})
select lang, source, part, item, value, rank::int as rank from ranked
"""

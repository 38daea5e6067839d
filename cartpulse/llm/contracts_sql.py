"""DuckDB SQL for the queries of this folder that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACED_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({ALNUM_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (
  SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS pat
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT rid, i, dwin.size, pat FROM dwin SEMI JOIN win USING (size, pat)),
cov AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS items FROM hit JOIN win USING (pat) WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({SPACED_WORDS}, []) AS w FROM documents),
g AS (
  SELECT rid, doc_id, i, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
o AS (SELECT win, min(doc_id) AS owner FROM g GROUP BY win),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS pos FROM g JOIN o USING (win) WHERE owner < doc_id),
gl AS (SELECT rid, list(pos) AS gone, count(*) AS n FROM gone GROUP BY rid),
x AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.pos) AS t FROM x ANTI JOIN gone ON x.rid = gone.rid AND x.pos = gone.pos GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gl USING (rid) LEFT JOIN k USING (rid)
"""

MIXTURE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({SPACED_WORDS}), 0) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS key FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS total_weight,
    coalesce(sum(3 * source_size) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap <= CAST(total - cap_before AS DOUBLE) / CAST(total_weight - weight_before AS DOUBLE) * weight AS capped FROM r),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    (SELECT CAST(any_value(total) - min(cap_before) AS DOUBLE) / CAST(any_value(total_weight) - min(weight_before) AS DOUBLE) FROM c WHERE NOT capped) * weight END AS target
  FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // CAST(source_size AS BIGINT) ELSE 0 END AS epochs FROM t),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - epochs * CAST(source_size AS BIGINT) AS rest FROM g),
u AS (SELECT source, key, sum(size) AS unit, count(*) AS n FROM d WHERE size > 0 GROUP BY source, key),
v AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY key) - unit AS before FROM u)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(b.source_size AS BIGINT) AS source_size, b.target,
  CAST(b.epochs * d.size + CASE WHEN v.key IS NULL THEN 0 ELSE least(d.size, greatest(CAST(b.rest - v.before AS BIGINT), 0) // v.n) END AS BIGINT) AS taken, d.source
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source AND d.key = v.key
"""


def hilbert_shards(bits: int = 5, count: int = 16) -> str:
    """The curve's steps as one common table expression each."""
    ctes, last = [], "q"
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(3):
            swap = f"CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {q - 1} END"
            new = {0: f"xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {q - 1} ELSE {swap} END)"}
            new[i] = f"xor(x{i}, {swap})" if i else f"xor(x0, CASE WHEN x0 & {q} <> 0 THEN {q - 1} ELSE 0 END)"
            cols = ", ".join(f"{new.get(j, f'x{j}')} AS x{j}" for j in range(3))
            ctes.append(f"h{level}_{i} AS (SELECT c0, c1, c2, {cols} FROM {last})")
            last = f"h{level}_{i}"
    ctes.append(f"g1 AS (SELECT c0, c1, c2, x0, xor(x1, x0) AS x1, x2 FROM {last})")
    ctes.append("g2 AS (SELECT c0, c1, c2, x0, x1, xor(x2, x1) AS x2 FROM g1)")
    turn = "0"
    for level in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN x2 & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    ctes.append(f"g3 AS (SELECT c0, c1, c2, x0, x1, x2, {turn} AS t FROM g2)")
    place = " + ".join(f"((xor(x{i}, t) >> {level}) & 1) * {1 << (3 * level + 2 - i)}" for level in range(bits - 1, -1, -1) for i in range(3))
    ctes.append(f"curve AS (SELECT c0, c1, c2, CAST({place} AS BIGINT) AS place FROM g3)")
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc_rows = "crc0 AS (SELECT i, i AS c FROM (SELECT unnest(range(256)) AS i))"
    for k in range(8):
        crc_rows += f", crc{k + 1} AS (SELECT i, {step} AS c FROM crc{k})"
    top = (1 << bits) - 1
    return f"""
WITH {crc_rows},
lut AS (SELECT list(c ORDER BY i) AS lut FROM crc8),
hexed AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents),
bytes AS (SELECT rid, doc_id, source, lang, size, list_transform(range(1, size), lambda i: CAST(('0x' || hx[2 * i - 1 : 2 * i]) AS BIGINT)) AS b FROM hexed),
d AS (
  SELECT doc_id, source, lang, CAST(size AS BIGINT) AS size,
    xor(list_reduce(b, lambda c, x: xor(c >> 8, lut[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM bytes, lut),
bs AS (SELECT source, (coalesce(sum(count(*)) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {top + 1}) // (SELECT count(*) FROM d) AS q FROM d GROUP BY source),
bl AS (SELECT lang, (coalesce(sum(count(*)) OVER (ORDER BY lang NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {top + 1}) // (SELECT count(*) FROM d) AS q FROM d GROUP BY lang),
p AS (
  SELECT d.*, CAST(least(length(ltrim(bin(size), '0')) - 1, {top}) AS INT) AS c0, CAST(bs.q AS INT) AS c1, CAST(bl.q AS INT) AS c2,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', size, '|', text_crc32)) AS tie
  FROM d JOIN bs ON d.source IS NOT DISTINCT FROM bs.source JOIN bl ON d.lang IS NOT DISTINCT FROM bl.lang),
q AS (SELECT DISTINCT c0, c1, c2, c0 AS x0, c1 AS x1, c2 AS x2 FROM p),
{", ".join(ctes)},
o AS (SELECT p.*, place, row_number() OVER (ORDER BY place, tie, size, text_crc32) - 1 AS r, count(*) OVER () AS n FROM p JOIN curve USING (c0, c1, c2)),
z AS (SELECT *, (r * {count}) // n AS shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
  CAST(r - (shard * n + {count - 1}) // {count} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source, lang, place
FROM z
"""

PHRASES = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT *, unnest(range(1, k)) AS pos FROM kept),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, l.f AS l, r.f AS r, n.n, pos,
    CAST((1000::HUGEINT * cut.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN n ON n.lang = cut.lang
  JOIN f AS l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1 : pos], ' ')
  JOIN f AS r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[pos + 1 : cut.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({ALNUM_WORDS}, []) AS w FROM documents),
st AS (SELECT count(*) FILTER (len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({ALNUM_WORDS}) AS t FROM benchmark) GROUP BY item_id, t),
tf AS (
  SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), st),
x AS (
  SELECT rid, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * nd) // nl))) AS part
  FROM tf JOIN d USING (rid) JOIN wt USING (t), st),
s AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(q * part) AS BIGINT) AS score FROM x JOIN q USING (t) GROUP BY item_id, rid)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20
"""


def url_filter() -> str:
    """Rules, Viterbi as a recursion over the letters of distinct runs, and naive Bayes."""
    from .urls import LONGEST, RULES, SEEDS

    fits = [(v, h, p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for _, h, p, f in fits) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for v, _, _, f in fits) + " END"
    seeds = ", ".join(f"'{s}'" for s in SEEDS)
    token = "'[a-z]+|[0-9]+|[^\\x00-\\x7F]+'"
    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM u),
r AS (
  SELECT row_number() OVER () AS rid, page_id, html, translate(raw, '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest[length(raw) + 1 :], '^[^?#]*') AS path FROM h),
j AS (
  SELECT rid, page_id, host, path, {rule} AS rule, {says} AS verdict,
    regexp_replace(translate(path, '{UPPER}', '{LOWER}'), '[0-9]+', '0', 'g') AS shape FROM r),
seen AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM r)
  WHERE regexp_full_match(word, '[a-z]{{1,{LONGEST}}}') GROUP BY word),
tot AS (SELECT CAST(coalesce(sum(n), 0) + 1 AS BIGINT) AS total FROM seen),
uni AS (
  SELECT word, max(n) AS n FROM (SELECT word, n FROM seen UNION ALL SELECT unnest([{seeds}]) AS word, total // 10000 + 1 AS n FROM tot) GROUP BY word),
hr AS (SELECT host, unnest(regexp_extract_all(host, {token})) AS run FROM (SELECT DISTINCT host FROM j)),
runs AS (SELECT DISTINCT run FROM hr WHERE regexp_matches(run, '^[a-z]')),
sub AS (
  SELECT run, b, e, run[b + 1 : e] AS word
  FROM (SELECT run, b, unnest(range(b + 1, least(length(run), b + {LONGEST}) + 1)) AS e FROM (SELECT run, unnest(range(0, length(run))) AS b FROM runs))),
cost AS (
  SELECT run, e, list({{'b': b, 'c': CASE WHEN n IS NOT NULL THEN CAST(floor(1000 * (ln(total) - ln(n))) AS BIGINT)
    ELSE CAST(floor(1000 * ln(total)) AS BIGINT) + 2303 * (e - b - 1) END}}) AS ways
  FROM sub LEFT JOIN uni USING (word), tot GROUP BY run, e),
v(run, e, best, back) AS (
  SELECT run, CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], [CAST(0 AS BIGINT)] FROM runs
  UNION ALL
  SELECT run, e, list_append(best, choice.c), list_append(back, choice.b) FROM (
    SELECT v.run, v.e + 1 AS e, v.best, v.back, list_sort(list_transform(ways, lambda x: {{'c': v.best[x.b + 1] + x.c, 'b': x.b}}))[1] AS choice
    FROM v JOIN cost ON cost.run = v.run AND cost.e = v.e + 1)),
tail(run, e, back, word) AS (
  SELECT run, back[e + 1], back, run[back[e + 1] + 1 : e] FROM v WHERE e = length(run)
  UNION ALL
  SELECT run, back[e + 1], back, run[back[e + 1] + 1 : e] FROM tail WHERE e > 0),
ht AS (
  SELECT host, 'h:' || word AS token FROM hr JOIN tail USING (run)
  UNION ALL
  SELECT host, 'h:' || CASE WHEN regexp_matches(run, '^[0-9]') THEN '0' ELSE run END FROM hr WHERE NOT regexp_matches(run, '^[a-z]')),
st AS (SELECT shape, 'p:' || unnest(regexp_extract_all(shape, {token})) AS token FROM (SELECT DISTINCT shape FROM j)),
jt AS (SELECT rid, verdict, token FROM j JOIN ht USING (host) UNION ALL SELECT rid, verdict, token FROM j JOIN st USING (shape)),
cnt AS (SELECT token, count(*) FILTER (verdict = 'block') AS b, count(*) FILTER (verdict = 'allow') AS a FROM jt WHERE verdict IS NOT NULL GROUP BY token),
ful AS (
  SELECT token, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a FROM (
    SELECT * FROM cnt UNION ALL SELECT 'h:' || unnest([{seeds}]), (SELECT CAST(coalesce(sum(b), 0) AS BIGINT) // 100 + 1 FROM cnt), 0) GROUP BY token),
sms AS (SELECT sum(b) AS all_b, sum(a) AS all_a, count(*) AS v FROM ful),
model AS (
  SELECT token, CAST(floor(1000 * ln((b + 1)::DOUBLE / (all_b + v))) - floor(1000 * ln((a + 1)::DOUBLE / (all_a + v))) AS BIGINT) AS weight FROM ful, sms),
prior AS (
  SELECT CAST(floor(1000 * ln((count(*) FILTER (verdict = 'block') + 1)::DOUBLE / (count(*) FILTER (verdict = 'allow') + 1))) AS BIGINT) AS prior FROM j),
sc AS (SELECT rid, sum(weight) AS s FROM jt JOIN model USING (token) WHERE verdict IS NULL GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(s, 0) + prior > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN verdict IS NULL THEN CAST(coalesce(s, 0) + prior AS BIGINT) END AS score
FROM j LEFT JOIN sc USING (rid), prior
"""

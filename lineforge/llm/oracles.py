"""DuckDB SQL for the queries of the text operators that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

BENCHMARK_NGRAMS = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_extract_all({_LOWER.format("coalesce(text, '')")},
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_extract_all({_LOWER.format("coalesce(text, '')")},
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS size
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.k, dw.i, dw.size, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (
    SELECT k, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT k, i, size FROM hits)) GROUP BY k),
items AS (SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
    coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (k) LEFT JOIN items i USING (k)
"""

_WORDS = f"""list_filter(regexp_extract_all({_LOWER.format("coalesce(text, '')")},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

# CRC-32 bit by bit for the table of 256 steps, then byte by byte for each distinct word.
CRC_IMPORTANCE = f"""
WITH steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT k, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM (SELECT {_WORDS} AS w FROM benchmark)),
distinct_words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
coded AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1),
        lambda i: CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM distinct_words, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN coded USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN coded USING (w) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)
        / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), total),
weights AS (SELECT k, sum(g) AS weight FROM dw JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY k),
scored AS (SELECT k, doc_id, CAST(len(d.w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')),
        1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (k)),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS "rank"
FROM scored LEFT JOIN ranked USING (k)
"""

# All subsets of each token set are counted, with and without the verdict; no mining.
URL_RULES = f"""
WITH split AS (SELECT page_id, url, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    regexp_extract(url, '(?s)^.*?://[^?#]*(.*)', 1) AS rest FROM pages),
given AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, rule_host, rule_path)),
p AS (SELECT row_number() OVER () AS k, s.*,
    (SELECT max_by(struct_pack(r := rule_host || rule_path, v := verdict), length(rule_host) * 1000 + length(rule_path)) FROM given
        WHERE (s.host = rule_host OR ends_with(s.host, '.' || rule_host)) AND starts_with(s.path, rule_path)) AS given,
    string_split(s.host, '.') AS l FROM split s),
tokens AS (SELECT k, page_id, host, path, given, CASE WHEN url IS NULL THEN [] WHEN instr(url, '://') = 0 THEN ['bare']
    ELSE list_sort(list_filter([
        'scheme=' || {_LOWER.format("regexp_extract(url, '(?s)^(.*?)://', 1)")},
        CASE WHEN host <> '' THEN 'tld=' || l[-1] END,
        CASE WHEN len(l) >= 2 THEN 'site=' || l[-2] || '.' || l[-1] END,
        CASE WHEN len(l) >= 3 THEN 'name=' || l[-3] END,
        CASE WHEN len(l) >= 4 THEN 'sub=' || l[1] END,
        'dir=' || nullif(regexp_extract(path, '(?s)^/([^/]+)/', 1), ''),
        'end=' || nullif(regexp_extract(path, '(?s)(/|\\.[A-Za-z0-9]+)$', 1), ''),
        'key=' || nullif(regexp_extract(rest, '(?s)^\\?([^=&#]+)', 1), ''),
        CASE WHEN contains(rest, '#') THEN 'fragment' END], lambda x: x IS NOT NULL)) END AS tokens FROM p),
subsets AS (SELECT k, given.v AS v, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS tokens
    FROM (SELECT *, unnest(range(1, 1 << len(tokens))) AS m FROM tokens WHERE given IS NOT NULL AND len(tokens) > 0)),
least AS (SELECT ceil(0.01::DOUBLE * count(*)) AS n FROM tokens WHERE given IS NOT NULL AND len(tokens) > 0),
having_ AS (SELECT tokens, count(*) AS having_n FROM subsets GROUP BY tokens),
joint AS (SELECT tokens, v, count(*) AS joint_n FROM subsets GROUP BY tokens, v),
strong AS (SELECT tokens, v, joint_n, CAST(joint_n AS DOUBLE) / having_n AS confidence FROM joint JOIN having_ USING (tokens), least
    WHERE joint_n >= n AND CAST(joint_n AS DOUBLE) / having_n >= 0.9::DOUBLE),
rules AS (SELECT *, array_to_string(tokens, ' ') || ' => ' || v AS rule FROM strong a WHERE NOT EXISTS (SELECT 1 FROM strong b
    WHERE a.v = b.v AND len(b.tokens) < len(a.tokens) AND list_has_all(a.tokens, b.tokens) AND b.confidence >= a.confidence)),
best AS (SELECT t.tokens, r.rule AS mined_rule, r.v AS mined_verdict, r.confidence, row_number() OVER (PARTITION BY t.tokens
    ORDER BY r.confidence DESC, joint_n DESC, len(r.tokens) DESC, rule) AS i
    FROM (SELECT DISTINCT tokens FROM tokens) t JOIN rules r ON list_has_all(t.tokens, r.tokens))
SELECT page_id, host, path, given.r AS rule, coalesce(given.v, mined_verdict, 'allow') AS verdict, mined_rule, confidence,
    coalesce(mined_verdict, 'allow') AS method_verdict
FROM tokens LEFT JOIN (SELECT * FROM best WHERE i = 1) b USING (tokens)
"""

SETM_PHRASES = f"""
WITH pieces AS (SELECT row_number() OVER () AS k, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
words AS (SELECT k, lang, list_filter(regexp_extract_all(piece, '[^\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (SELECT lang, w[i:i + size - 1] AS run FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM words, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, run, count(*) AS a FROM runs GROUP BY lang, run),
total AS (SELECT lang, sum(a) AS n FROM f WHERE len(run) = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE len(run) > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.run, c.a, k, x.a AS l, y.a AS r,
        CAST(c.a AS HUGEINT) * c.a * 1000000 // (CAST(x.a AS HUGEINT) * y.a) AS score
    FROM (SELECT *, unnest(range(1, len(run))) AS k FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.run = c.run[1:c.k] JOIN f y ON y.lang = c.lang AND y.run = c.run[c.k + 1:]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, run ORDER BY score, k) AS i FROM cuts) WHERE i = 1),
inside AS (SELECT lang, inner_run, max(a) AS longer FROM (SELECT lang, a, unnest([run[1:2], run[2:3]]) AS inner_run
    FROM candidates WHERE len(run) = 3) GROUP BY lang, inner_run),
own AS (SELECT b.lang, array_to_string(b.run, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM best b
    LEFT JOIN inside i ON i.lang = b.lang AND i.inner_run = b.run WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank" FROM own)
SELECT lang, "rank", phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE "rank" <= 2000
"""

# All pairs that share a shingle, and all that is reachable over the links.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON a = d.doc_id
"""

ORACLES: dict[str, str] = {
    "op8_minhash_odd_sketch": NEAR_DUPLICATES,
    "op7_benchmark_ngrams": BENCHMARK_NGRAMS,
    "op11_crc_importance": CRC_IMPORTANCE,
    "op12_url_rules": URL_RULES,
    "op13_setm_phrases": SETM_PHRASES,
}

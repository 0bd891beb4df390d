"""DuckDB SQL for the queries that SQL can express."""

from fieldglass.llm.url_filters import HOST_WORDS

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URLS = rf"""
WITH rules(host, path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
           ('net', '/fr/', 'block')),
parts AS (
    SELECT page_id, row_number() OVER () AS n,
           {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages),
found AS (
    SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY n)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN len(list_intersect(string_split_regex(host, '[.\-]'), {list(HOST_WORDS)})) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN found USING (n)
"""

QUALITY = rf"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
listed AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, string_split(text, chr(10)) AS lines FROM texts),
placed AS (SELECT n, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM listed),
windows AS (
    SELECT n, place, count(*) OVER w AS width, string_agg(word, ' ') OVER w AS gram
    FROM placed WINDOW w AS (PARTITION BY n ORDER BY place ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
grams AS (SELECT n, place, count(*) OVER (PARTITION BY n, gram) AS times FROM windows WHERE width = 8),
covered AS (
    SELECT n, count(DISTINCT place + step) AS n_repeat_words
    FROM grams, range(0, 8) steps(step) WHERE times > 1 GROUP BY n),
full_lines AS (SELECT n, unnest(lines) AS line FROM listed),
dups AS (
    SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines WHERE regexp_matches(line, '{WORD}') GROUP BY n),
counts AS (
    SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM listed LEFT JOIN dups USING (n) LEFT JOIN covered USING (n)),
judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           10 * n_symbols > word_chars OR 100 * n_dup_lines > 30 * n_lines AS rule_failed
    FROM counts),
hosts AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE base_failed OR rule_failed) AS failures FROM judged GROUP BY source),
sums AS (SELECT sum(docs) AS n, sum(failures) / sum(docs) AS mean, count(*) AS hosts, sum(failures * failures / docs) AS squares FROM hosts),
spreads AS (SELECT *, greatest(squares / n - mean * mean - mean * (1 - mean) * hosts / n, 0.0) AS spread FROM sums),
priors AS (SELECT *, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM spreads),
rejected AS (SELECT source, (failures + mean * weight) / (docs + weight) > 0.5 AS bad FROM hosts, priors)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rule_failed AND NOT bad AS kept
FROM judged JOIN rejected ON judged.source IS NOT DISTINCT FROM rejected.source
"""

LINES = rf"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT n, doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place, unnest(string_split(text, chr(10))) AS line FROM texts),
keyed AS (
    SELECT *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k FROM lines),
owned AS (
    SELECT *, length(k) >= 10 AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY k) AS lost FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM owned GROUP BY n
"""

# CRC-32 of the digits of a number, bit by bit
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")

TRIE = rf"""
WITH own AS (
    SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, turns, c - c % 20 AS base, {_CRC.format('c')} % 4 AS h FROM own),
rebuilt AS (
    SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
    FROM heads a LEFT JOIN own b ON b.c = a.base),
prefixes AS (SELECT c, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
    SELECT depth, turns[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY 1, 2),
linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id,
           (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '{WORD}')) END AS w
    FROM nodes n LEFT JOIN (SELECT depth AS d, path AS above, conv_id FROM nodes) p ON p.d = n.depth - 1 AND p.above = n.path[1:n.depth - 1]),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.depth = l.depth AND k.path = l.path),
above AS (SELECT unnest(range(0, depth + 1)) AS depth, path, w, n_children = 0 AS leaf FROM counted),
sums AS (
    SELECT depth, path[1:depth] AS path, sum(w)::BIGINT AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM above GROUP BY 1, 2)
SELECT conv_id, c.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted c JOIN sums s ON s.depth = c.depth AND s.path = c.path
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another, each a search of every entry and a mean of the parts assigned."""
    distance = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        "kept AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v "
        "FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS MATERIALIZED (SELECT n, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM cells JOIN kept USING (n) "
        f"QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"near{r} AS MATERIALIZED (SELECT n, c.p, min(({distance.format('x', 'y')}, e)) AS best FROM cells c JOIN book{r} b ON b.p = c.p GROUP BY n, c.p)")
        if r < rounds:
            ctes.append(
                f"mean{r} AS (SELECT p, e, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS y FROM (SELECT c.p, best[2] AS e, i, sum(x[i])::BIGINT AS s, "
                f"count(*) AS k FROM cells c JOIN near{r} USING (n, p), range(1, len(x) + 1) g(i) GROUP BY ALL) GROUP BY p, e)")
            ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)")
    ctes.append(f"coded AS (SELECT n, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{rounds} GROUP BY n)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return ("WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 "
            "FROM coded JOIN kept USING (n), digest")


ORACLES = {"op1_url_filters": URLS, "op3_quality_rules": QUALITY, "op9_line_dedup": LINES, "op11_conversation_trie": TRIE,
           "op13_vector_codes": vector_codes_sql()}

"""DuckDB SQL of the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from ridelens.llm import mixing

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: component of every node of a symmetric edge table ``e(a, b)``: the least node reachable
COMPONENTS = """
reach AS (SELECT a AS n, b AS m FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.m),
least AS (SELECT n, min(m) AS c FROM reach GROUP BY n)"""

ROTATION = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), e AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98
), {COMPONENTS}, links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(links.n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN links ON a = vec_id LEFT JOIN least ON least.n = vec_id"""

WARC = """WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t=LOWER.format(t="coalesce(text, '')"))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT i.a, i.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) i
  JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 90 * (x.n + y.n - k)
), {COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.n = d.doc_id"""


def _weight(level: str) -> str:
    named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mixing.WEIGHTS[level].items())
    return f"(CASE {level} {named} ELSE 1 END)" if named else "1"


def _mixing() -> str:
    """Per level, each parent's children in order of capacity by weight: full ones first, the others share the rest."""
    steps, path = [], []
    steps.append(f"""d AS (SELECT doc_id, 'dom_' || substr(md5(coalesce(source, '')), 1, 1) AS domain, coalesce(lang, '(null)') AS lang,
  coalesce(source, '(null)') AS source, coalesce(len({WORDS.format(t="text")}), 0) AS n_tokens FROM documents)""")
    steps.append(f"leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {mixing.MAX_EPOCHS} AS cap FROM d GROUP BY ALL)")
    steps.append(f"b0 AS (SELECT least(sum(tokens) * {mixing.PERCENT} // 100, sum(cap)) AS budget FROM leaf)")
    for k, level in enumerate(mixing.LEVELS):
        parent = ", ".join(path)
        keys = ", ".join([*path, level])
        source = f"JOIN b{k} USING ({parent})" if path else f", b{k}"
        part = f"PARTITION BY {parent} " if path else ""
        steps.append(f"c{k} AS (SELECT n.*, budget FROM (SELECT {keys}, sum(cap) AS cap, {_weight(level)} AS weight FROM leaf GROUP BY {keys}) n {source} WHERE cap > 0)")
        order = f"{part}ORDER BY cap / weight, {level}"
        steps.append(f"""o{k} AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * weight
    + cap * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget * weight AS is_full FROM c{k})""")
        steps.append(f"""b{k + 1} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE
    (budget - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({part}), 0)) * weight // sum(weight) FILTER (WHERE NOT is_full) OVER ({part}) END AS budget FROM o{k})""")
        path.append(level)
    steps.append("""q AS (SELECT d.*, coalesce(budget, 0) // tokens AS whole, coalesce(budget, 0) % tokens AS rest
  FROM d JOIN leaf USING (domain, lang, source) LEFT JOIN b3 USING (domain, lang, source) WHERE tokens > 0)""")
    order = f"md5('{mixing.SEED}:' || CAST(whole AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, n_tokens"
    steps.append(f"r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY {order} ROWS UNBOUNDED PRECEDING) <= rest AS is_in FROM q)")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(unnest(range(CAST(whole AS BIGINT) + CAST(is_in AS BIGINT))) AS INTEGER) AS epoch FROM r"""


RANKED = rf"""WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER.format(t="text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format(t="text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), size AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS all_terms FROM d),
len AS (SELECT doc_id, 50 + (50 * count(*) * any_value(n_docs)) // any_value(all_terms) AS m FROM d, size GROUP BY doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, size GROUP BY term),
hits AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM hits WHERE score > 0 QUALIFY rank <= 50"""

COLLOCATIONS = rf"""WITH p AS (
  SELECT lang, unnest(range(len(ps))) AS pno, doc_id, unnest(ps) AS piece
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array({LOWER.format(t="coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents)
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i : i + k - 1])) AS g
  FROM w, (SELECT unnest(range(1, 6)) AS k)
), f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
sub AS (
  SELECT lang, unnest([g[1 : k - 1], g[2 : k]]) AS g, f FROM f WHERE k > 2
), most AS (SELECT lang, g, max(f) AS most FROM sub GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN most USING (lang, g) WHERE k > 1 AND (most IS NULL OR 100 * most < 100 * f)),
cut AS (SELECT lang, g, k, f AS a, unnest(range(1, k)) AS pos FROM c),
s AS (
  SELECT cut.lang, cut.g, a, pos, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cut JOIN n USING (lang) JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1 : pos] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[pos + 1 : cut.k]
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, pos) AS first FROM s)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
       array_to_string(g, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best WHERE first = 1 QUALIFY rank <= 2000"""

REPETITION = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(t="coalesce(text, '')")} AS ws FROM documents),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), g AS (SELECT doc_id, unnest(range(len(ws) - 7)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda j: ws[j : j + 7])) AS g FROM d WHERE len(ws) >= 8),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(8)) AS o) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
) SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s"""

SECRETS = r"""SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24)) AS BIGINT) AS n_hex FROM documents"""

URLS = f"""WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
p AS (SELECT page_id, {LOWER.format(t="raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (
  SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)example\\.net$') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN regexp_matches(host, '(^|\\.)example\\.com$') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN regexp_matches(host, '(^|\\.)org$') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN regexp_matches(host, '(^|\\.)net$') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
) SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
                                         WHEN 'org/fr/' THEN 'allow' END AS rule_verdict FROM r"""

ORACLE = {"op1_rotation_codes": ROTATION, "op3_warc_bundles": WARC, "op4_jaccard_join": JACCARD, "op10_source_mixing": _mixing(),
          "op12_ranked_search": RANKED, "op13_collocations": COLLOCATIONS, "base_of_op5": REPETITION, "base_of_op6": SECRETS, "base_of_op7": URLS}

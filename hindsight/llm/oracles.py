"""DuckDB SQL for the corpus queries that SQL can express."""

from .url_filters import DIFFERENT, FAN_OUT, MIN_PURITY, RARE, SMOOTHING

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
             max(page_id) OVER (PARTITION BY payload) AS keeper, count(*) OVER (PARTITION BY payload) AS n FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)
         FOR i IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d"""


def _url_filter(rules) -> str:
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = [f"(h.host = '{r.host}' OR h.host LIKE '%.{r.host}') AND starts_with(h.path, '{r.path}')" for r in ordered]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    extension = r"'\.[A-Za-z]{1,5}$'"
    share = "((all_bad + 0.5) / (all_labelled + 1.0))"
    differs = f"labelled_b > 0 AND abs(bad_b - labelled_b * {share}) > {DIFFERENT} * sqrt(labelled_b * {share} * (1 - {share}))"
    own = f"""segment = '' OR branches = 1 OR ({differs}
          AND (NOT (branches > {FAN_OUT} AND all_pages < {RARE} * branches) OR pages_b >= {RARE}))"""
    return rf"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
g AS (SELECT *, [s FOR s IN string_split(path, '/') IF s <> ''] AS segments FROM u),
h AS (SELECT page_id, host, path, [CASE
        WHEN regexp_matches(regexp_replace(s, {extension}, ''), '^[0-9_.-]*[0-9][0-9_.-]*$')
          OR regexp_matches(regexp_replace(s, {extension}, ''), '^[0-9a-fA-F-]{{16,}}$')
          OR length(regexp_replace(s, {extension}, '')) > 64 THEN '*' || regexp_extract(s, {extension}) ELSE s END
        FOR s IN segments] AS shape FROM g),
l AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
t AS (
  SELECT 0 AS level, host, shape, count(*) AS pages, count(l.bad) AS labelled, CAST(coalesce(sum(l.bad), 0) AS BIGINT) AS bad,
         '' AS template, false AS done
  FROM h LEFT JOIN l USING (page_id) GROUP BY host, shape
  UNION ALL
  SELECT level + 1, host, shape, pages, labelled, bad,
         template || CASE WHEN shapes = 1 THEN array_to_string([('/' || s) FOR s IN shape[level + 1 :]], '')
                          WHEN NOT own THEN '/*' WHEN segment = '' THEN '' ELSE '/' || segment END,
         shapes = 1 OR len(shape) <= level + 1
  FROM (SELECT *, {own} AS own FROM (
    SELECT *, count(*) OVER node AS shapes, CAST(sum(first) OVER node AS BIGINT) AS branches,
           sum(pages) OVER node AS all_pages, sum(labelled) OVER node AS all_labelled, sum(bad) OVER node AS all_bad,
           sum(pages) OVER branch AS pages_b, sum(labelled) OVER branch AS labelled_b, sum(bad) OVER branch AS bad_b
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY host, template, segment) = 1 AS INT) AS first
          FROM (SELECT *, coalesce(shape[level + 1], '') AS segment FROM t WHERE NOT done))
    WINDOW node AS (PARTITION BY host, template), branch AS (PARTITION BY host, template, segment)))),
tree AS (SELECT * FROM t WHERE done),
overall AS (SELECT (count(*) - sum(bad) + 1.0) / (count(*) + 1.0) AS purity FROM l),
by_host AS (SELECT host, (sum(labelled) - sum(bad) + {SMOOTHING} * (SELECT purity FROM overall)) / (sum(labelled) + {SMOOTHING}) AS purity
            FROM tree GROUP BY host),
by_template AS (SELECT t.host, template, (sum(labelled) - sum(bad) + {SMOOTHING} * any_value(b.purity)) / (sum(labelled) + {SMOOTHING}) AS purity
                FROM tree t JOIN by_host b ON t.host = b.host GROUP BY t.host, template)
SELECT h.page_id, h.host, h.path, {case([r.name for r in ordered])} AS rule,
       coalesce({case([r.verdict for r in ordered])}, CASE WHEN p.purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       t.template
FROM h JOIN tree t ON h.host = t.host AND h.shape = t.shape
       JOIN by_template p ON t.host = p.host AND t.template = p.template"""


_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM lists, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase
        FROM candidates WHERE size = 3) GROUP BY ALL)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT w.*, t.n, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, encode(w.phrase)) AS rank
      FROM weakest w JOIN totals t USING (lang) LEFT JOIN longer o USING (lang, phrase)
      WHERE o.most IS NULL OR 100 * o.most < 50 * w.a)
WHERE rank <= 2000"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE octet_length(encode(CAST({name} AS VARCHAR))) || ':' || {name} END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(name) for name in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


_MANIFEST = f"""
WITH RECURSIVE crc(i, c, step) AS (
  SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM crc WHERE step < 8),
codes AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE step = 8),
marked AS (
  SELECT documents.*, xor(4294967295, list_reduce(
           list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 7 = 0 AS tampered
  FROM documents, codes),
leaves AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN tampered THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS changed
  FROM marked),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS size
  FROM leaves),
trees(tree, level, place, size, node) AS (
  SELECT tree, 0, place, size, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
  FROM trees WHERE size > 1 GROUP BY tree, level, place // 2, size),
subroots AS (SELECT tree, node FROM trees WHERE size = 1),
forest(level, place, size, node) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), node FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
  FROM forest WHERE size > 1 GROUP BY level, place // 2, size),
steps AS (
  SELECT tree, place, level AS step, size, node FROM trees WHERE size > 1
  UNION ALL
  SELECT -1, place, 1000 + level, size, node FROM forest WHERE size > 1),
wanted AS (
  SELECT p.tree, p.place AS leaf_place, s.step, s.place % 2 AS own, o.node AS sibling
  FROM placed p JOIN steps s ON (s.tree = p.tree AND s.place = p.place >> s.step) OR (s.tree = -1 AND s.place = p.tree >> (s.step - 1000))
  LEFT JOIN steps o ON o.tree = s.tree AND o.step = s.step AND o.place = xor(s.place, 1)),
paths AS (
  SELECT p.tree, p.place, p.doc_id, p.leaf, p.changed,
         list({{'own': w.own, 'sibling': coalesce(w.sibling, '')}} ORDER BY w.step) FILTER (w.step IS NOT NULL) AS path
  FROM placed p LEFT JOIN wanted w ON w.tree = p.tree AND w.leaf_place = p.place GROUP BY ALL),
folded(tree, place, i, node, path) AS (
  SELECT tree, place, 1, changed, path FROM paths
  UNION ALL
  SELECT tree, place, i + 1, sha256(CASE WHEN path[i].own = 1 THEN path[i].sibling || node ELSE node || path[i].sibling END), path
  FROM folded WHERE i <= len(path))
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root,
       sha256(coalesce(list_aggregate([x.sibling FOR x IN p.path], 'string_agg', ''), '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.node AS verified
FROM paths p JOIN subroots s USING (tree) JOIN folded f ON f.tree = p.tree AND f.place = p.place AND f.i = coalesce(len(p.path), 0) + 1,
     (SELECT node FROM forest WHERE size = 1) r"""

# The article element of pages that are built like the given ones; that and the operator know nothing of each other.
_PAGES = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[a-z/][^>]*>', ' ', 'g'),
        '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages)"""


def sql(rules) -> dict[str, str]:
    return {
        "op7_seekable_warc": _WARC,
        "op10_url_template_filter": _url_filter(rules),
        "op11_phrase_collocations": _COLLOCATIONS,
        "op12_merkle_manifest": _MANIFEST,
        "op13_html_extraction": _PAGES,
    }

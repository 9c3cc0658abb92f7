"""DuckDB SQL of the registered queries that SQL can express.

Written apart from the DataFrame code: contamination by comparing all
shingles, the mix by windows over whole sources, shards by a recursive walk.
"""

from __future__ import annotations

from tallyline.llm import urls
from tallyline.llm.common import LOWER, UPPER

SPACES = r"[^\x20\x09-\x0D]+"

CONTAINED = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
qs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM q WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM qs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM qs) WHERE len(w) >= k))
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, count(*) AS n_found, count(*) / n AS containment
FROM ds JOIN qs USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""

MIX = rf"""
WITH base AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACES}')) AS size,
                     md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
v AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM w),
l AS (SELECT *, row_number() OVER o AS turn, sum(cap) OVER () / 2 * 1.5 AS budget,
             (sum(cap) OVER () / 2 * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM v WINDOW o AS (ORDER BY cap / weight, place)),
f AS (SELECT min(turn) AS turn FROM l WHERE cap > weight * level),
t AS (SELECT l.source, l.source_size, l.place,
             CASE WHEN f.turn IS NULL OR l.turn < f.turn THEN l.cap
                  ELSE l.weight * (SELECT level FROM l AS x WHERE x.turn = f.turn) END AS target
      FROM l, f),
p AS (SELECT b.*, t.source_size, t.target, t.place,
             sum(size) OVER (PARTITION BY b.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop
      FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, place, CAST(stop + e * source_size AS DOUBLE) / target AS finish
      FROM p, (VALUES (0), (1)) AS x(e) WHERE size > 0 AND target > 0),
k AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) AS total FROM c),
g AS (SELECT doc_id, sum(size) AS taken FROM k WHERE total <= (SELECT sum(source_size) * 1.5 FROM s) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM p LEFT JOIN g USING (doc_id)
"""


def crc_table() -> list[int]:
    """The CRC-32 of each byte, by the reversed polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


SHARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
walk(doc_id, k, here, nxt) AS (
    SELECT doc_id, CAST(CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616 ELSE coalesce(doc_id, 0) END AS UHUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d
    UNION ALL
    SELECT doc_id, k2, nxt, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT doc_id, nxt, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE nxt < 16)
),
placed AS (SELECT doc_id, CAST(here AS INTEGER) AS shard, CAST(CASE WHEN nxt = 16 THEN 16 ELSE here END AS INTEGER) AS grown_shard FROM walk WHERE nxt >= 16),
crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'),
               lambda b: CAST('0x' || b AS BIGINT))),
               lambda c, b: xor(c // 256, {crc_table()}[CAST(xor(c % 256, b) AS INTEGER) + 1]))) AS text_crc32,
               octet_length(encode(t)) + 1 AS size FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', doc_id, size, CAST(text_crc32 AS BIGINT)))[1:3], doc_id, size, text_crc32) - 1 AS slot
FROM placed JOIN crc USING (doc_id)
"""

def _rule_rows() -> str:
    rows = [(r, v, *r.partition("/")) for r, v in urls.RULES]
    return ", ".join(f"('{r}', '{v}', '{site}', '{slash + rest}')" for r, v, site, slash, rest in rows)


JUDGED = rf"""
WITH RECURSIVE hp AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, rule_verdict, site, prefix) AS (VALUES {_rule_rows()}),
m AS (SELECT page_id, host, path, rule, rule_verdict
      FROM hp LEFT JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule DESC) = 1),
mf AS (SELECT *, '/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
              lambda x: CASE WHEN regexp_matches(x, '{urls._VARIABLE}') THEN '*' ELSE x END), '/') AS form FROM m),
forms AS (SELECT host, form, count(*) AS pages, count(rule_verdict) AS n, count(*) FILTER (WHERE rule_verdict = 'block') AS b,
                 list_filter(string_split(form, '/'), lambda x: x <> '') AS parts FROM mf GROUP BY host, form),
walk AS (
    SELECT host, form, n, b, pages, parts, 0 AS depth FROM forms
    UNION ALL
    SELECT host, form, n, b, pages,
           CASE WHEN children >= {urls.MANY} AND largest <= total * {urls.RARE} THEN list_concat(list_append(parts[1:depth], '*'), parts[depth + 2:]) ELSE parts END,
           depth + 1
    FROM (SELECT *, count(DISTINCT segment) OVER node AS children, sum(pages) OVER node AS total, max(segment_pages) OVER node AS largest
          FROM (SELECT *, sum(pages) OVER (PARTITION BY host, above, segment) AS segment_pages
                FROM (SELECT *, parts[depth + 1] AS segment, array_to_string(parts[1:depth], '/') AS above FROM walk WHERE len(parts) > depth))
          WINDOW node AS (PARTITION BY host, above))),
kept AS (SELECT host, form, n, b, parts AS segs, list_max(list_filter(range(1, len(parts) + 1), lambda i: parts[i] <> '*')) AS fixed
         FROM walk WHERE depth = len(parts)),
tpl AS (SELECT host, form, n, b, '/' || array_to_string(segs, '/') AS own,
               '/' || array_to_string(list_transform(segs, lambda x, i: CASE WHEN i = fixed THEN '*' ELSE x END), '/') AS parent FROM kept),
own AS (SELECT host, own, parent, sum(n) AS n, sum(b) AS b FROM tpl GROUP BY ALL),
both_ AS (SELECT *, sum(n) OVER f AS an, sum(b) OVER f AS ab FROM own WINDOW f AS (PARTITION BY host, parent)),
merged AS (SELECT host, own, parent, n, b, CASE WHEN n = 0 OR an = n THEN own WHEN ab = 0 OR ab = an THEN parent
                  WHEN power(b / n - (ab - b) / (an - n), 2) / (ab / an * (1 - ab / an) * (1 / n + 1 / (an - n))) < {urls.ALIKE} THEN parent
                  ELSE own END AS template FROM both_),
labels AS (SELECT host, template, sum(n) AS n, sum(b) AS b, list_filter(string_split(template, '/'), lambda x: x <> '') AS parts FROM merged GROUP BY host, template),
chain AS (SELECT *, array_to_string(parts[1:depth], '/') AS branch FROM (SELECT *, unnest(range(len(parts) + 1)) AS depth FROM labels)),
held AS (SELECT *, sum(n) OVER (PARTITION BY host, depth, branch) AS held_n, sum(b) OVER (PARTITION BY host, depth, branch) AS held_b FROM chain),
apart AS (SELECT host, template, depth, held_n - coalesce(lead(held_n) OVER below, n) AS n, held_b - coalesce(lead(held_b) OVER below, b) AS b
          FROM held WINDOW below AS (PARTITION BY host, template ORDER BY depth)
          UNION ALL SELECT host, template, len(parts) + 1, n, b FROM labels),
shares AS (
    SELECT host, template, -1 AS depth, CAST({urls.PRIOR_BLOCK} AS DOUBLE) AS share FROM labels
    UNION ALL
    SELECT s.host, s.template, s.depth + 1, (a.b + {urls.PRIOR_ROWS}::DOUBLE * share) / (a.n + {urls.PRIOR_ROWS}::DOUBLE)
    FROM shares s JOIN apart a ON a.host = s.host AND a.template = s.template AND a.depth = s.depth + 1),
final AS (SELECT host, template, CASE WHEN arg_max(share, depth) >= {urls.REJECT} THEN 'block' ELSE 'allow' END AS verdict FROM shares GROUP BY host, template)
SELECT page_id, mf.host, path, rule, coalesce(rule_verdict, verdict) AS verdict
FROM mf JOIN tpl ON tpl.host = mf.host AND tpl.form = mf.form
JOIN merged ON merged.host = tpl.host AND merged.own = tpl.own AND merged.parent = tpl.parent
JOIN final ON final.host = merged.host AND final.template = merged.template
"""

def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


def _document_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb(name: str, start: str, leaves: str, levels: int) -> str:
    """CTEs that climb the trees of ``start`` (g, i, d) level by level, taking
    along the rows of ``leaves`` (g, pos, proof, node and more)."""
    out, nodes, rows = [], start, leaves
    for k in range(levels):
        out.append(f"""
{name}r{k} AS (SELECT g, i // 16 AS up, string_agg(d, '' ORDER BY i) AS run, any_value(n) AS n
        FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {nodes}) GROUP BY g, i // 16),
{name}n{k} AS (SELECT g, up AS i, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS d FROM {name}r{k}),
{name}p{k} AS (SELECT * REPLACE (pos // 16 AS pos,
            CASE WHEN n > 1 THEN proof || run[1:64 * (pos % 16)] || run[64 * (pos % 16) + 65:] ELSE proof END AS proof,
            CASE WHEN n > 1 THEN sha256(run[1:64 * (pos % 16)] || node || run[64 * (pos % 16) + 65:]) ELSE node END AS node)
        FROM (SELECT l.*, r.run, r.n FROM (SELECT * EXCLUDE (run, n) FROM {rows}) l JOIN {name}r{k} r ON l.g = r.g AND l.pos // 16 = r.up))""")
        nodes, rows = f"{name}n{k}", f"{name}p{k}"
    return ",".join(out)


MERKLE = f"""
WITH crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'),
               lambda b: CAST('0x' || b AS BIGINT))),
               lambda c, b: xor(c // 256, {crc_table()}[CAST(xor(c % 256, b) AS INTEGER) + 1]))) AS crc FROM documents),
leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_document_leaf("text")} AS leaf,
             CASE WHEN crc % 5 = 0 THEN {_document_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
n AS (SELECT g, pos AS i, leaf AS d FROM placed),
p AS (SELECT *, '' AS proof, coalesce(tampered, leaf) AS node, '' AS run, 0 AS n FROM placed),
{_climb("s", "n", "p", 7)},
hn AS (SELECT 0 AS g, g AS i, d FROM sn6),
hp AS (SELECT * REPLACE (0 AS g, sp6.g AS pos), sn6.d AS subroot FROM sp6 JOIN sn6 ON sn6.g = sp6.g),
{_climb("h", "hn", "hp", 5)}
SELECT doc_id, leaf, subroot, hn4.d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = hn4.d AS verified
FROM hp4, hn4
"""

NEGATIVES = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

SQL: dict[str, str] = {"op1_decontaminate": CONTAINED, "op2_mix": MIX, "op9_url_filter": JUDGED,
                       "op10_shard": SHARD, "op11_hard_negatives": NEGATIVES, "op13_merkle": MERKLE}

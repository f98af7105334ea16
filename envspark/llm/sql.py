"""DuckDB SQL of the training-data queries that SQL can express."""

_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
          ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _url_filter_sql(order: int = 4, alphabet: int = 257) -> str:
    rules = sorted(_RULES, key=lambda r: -len(r[1] + r[2]))

    def case(out):
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{out(v, h, p)}'" for v, h, p in rules) + " END"

    def mix(kind, k):
        if k == 0:
            return f"(1.0::DOUBLE / {alphabet})"
        m = f"m{k}"
        below = mix(kind, k - 1)
        return (f"(CASE WHEN {m}.{kind}_all + {m}.{kind}_kinds = 0 THEN {below} "
                f"ELSE ({m}.{kind} + {m}.{kind}_kinds * {below}) / ({m}.{kind}_all + {m}.{kind}_kinds)::DOUBLE END)")
    joins = " ".join(f"JOIN model m{k} ON m{k}.k = {k} AND m{k}.tail = right(g.gram, {k})" for k in range(1, order + 2))
    return f"""
WITH part AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
hp AS (SELECT r, page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
              coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM part),
ruled AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS rv FROM hp),
u AS (SELECT DISTINCT url, rv FROM ruled WHERE url IS NOT NULL),
padded AS (SELECT url, rv, repeat(chr(2), {order}) || translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(3) AS s FROM u),
gram AS (SELECT url, rv, substr(s, i, {order + 1}) AS gram FROM (SELECT url, rv, s, unnest(range(1, len(s) - {order} + 1)) AS i FROM padded)),
counts AS (SELECT gram, count(*) FILTER (WHERE rv = 'allow') AS yes, count(*) FILTER (WHERE rv = 'block') AS no FROM gram GROUP BY gram),
tails AS (SELECT k, right(gram, k) AS tail, left(right(gram, k), k - 1) AS head, sum(yes) AS yes, sum(no) AS no
          FROM counts, range(1, {order + 2}) t(k) GROUP BY ALL),
model AS (SELECT *, sum(yes) OVER w AS yes_all, count(*) FILTER (WHERE yes > 0) OVER w AS yes_kinds,
                 sum(no) OVER w AS no_all, count(*) FILTER (WHERE no > 0) OVER w AS no_kinds
          FROM tails WINDOW w AS (PARTITION BY k, head)),
ratio AS (SELECT g.gram, ln({mix('yes', order + 1)}) - ln({mix('no', order + 1)}) AS lr FROM counts g {joins}),
score AS (SELECT url, rv, avg(lr) AS score FROM gram JOIN ratio USING (gram) GROUP BY url, rv),
stat AS (SELECT avg(score) FILTER (WHERE rv = 'allow') AS ym, stddev_pop(score) FILTER (WHERE rv = 'allow') AS ys,
                avg(score) FILTER (WHERE rv = 'block') AS nm, stddev_pop(score) FILTER (WHERE rv = 'block') AS ns FROM score),
cut AS (SELECT CASE WHEN ys + ns > 0 THEN (ym * ns + nm * ys) / (ys + ns) ELSE (ym + nm) / 2 END AS t FROM stat)
SELECT page_id, host, path, rule,
       coalesce(ruled.rv, CASE WHEN score IS NULL THEN 'block' WHEN t IS NULL OR score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN score ON ruled.url = score.url CROSS JOIN cut
"""


SQL: dict[str, str] = {
    "op10_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT r, doc_id, i, hash(w[i:i + 12]) AS h, md5(array_to_string(w[i:i + 12], ' ')) AS m
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
least_doc AS (SELECT m, min(doc_id) AS first_doc FROM win GROUP BY m),
hit AS (SELECT DISTINCT r, i + k AS pos
        FROM win JOIN least_doc USING (m), range(13) t(k) WHERE first_doc < doc_id),
gone AS (SELECT r, list(pos) AS cut, count(*) AS n FROM hit GROUP BY r),
word AS (SELECT d.r, string_agg(x, ' ' ORDER BY p) AS kept
         FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) d
         LEFT JOIN hit ON hit.r = d.r AND hit.pos = d.p WHERE hit.r IS NULL GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN word USING (r)
""",
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                             AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS (SELECT a.r AS x, b.r AS y, b.vec_id AS y_id
         FROM sound a JOIN sound b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x),
comp AS (SELECT x AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY x),
links AS (SELECT x AS r, count(*) AS n FROM pair GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN links USING (r)
""",
    "op6_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS m
        FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS s FROM d)),
again AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 400, true) AS new FROM win JOIN again USING (m)),
span AS (SELECT r, min(s) AS lo, max(s) + 400 AS hi
         FROM (SELECT r, s, sum(new::INT) OVER (PARTITION BY r ORDER BY s) AS k FROM hit) GROUP BY r, k),
piece AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM span),
cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last_hi,
               string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS front
        FROM piece JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE front || substr(h, 2 * last_hi + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
                  min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first_id FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p
""",
    "op8_url_filter": _url_filter_sql(),
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)),
pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) <= 5),
neg AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
               row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other) AS rank
        FROM pos p JOIN s n ON n.r = p.r AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
""",
}

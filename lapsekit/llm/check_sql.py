"""Plain SQL with the results of the registered queries, for the operators that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

# Water-filling in closed form: sources in the order in which they reach their cap.
MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(3 * source_size) OVER c AS caps, sum(w) OVER r AS weights, sum(source_size) OVER () AS total FROM s
  WINDOW c AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT arg_min(part, place) FILTER (WHERE w * part <= 3 * source_size) AS share FROM (
    SELECT *, CAST(total - coalesce(caps, 0) AS DOUBLE) / CAST(weights AS DOUBLE) AS part,
      row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS place FROM o)
), t AS (
  SELECT source, source_size, least(CAST(w * share AS DOUBLE), CAST(3 * source_size AS DOUBLE)) AS target FROM s, l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS upto,
    CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS tied
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN upto <= budget OR (upto - tied <= budget AND 2 * (budget - upto + tied) >= tied) THEN 1 ELSE 0 END) AS taken
FROM c
"""

_BARE = r"regexp_replace(regexp_replace({url}, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_URLS = rf"""
page AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest,
    1704067200000000 + page_id * 7919 % 43200 * 60000000 AS "at",
    {_BARE.format(url="url")} AS bare
  FROM pages
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^(?:[^/?]*@)?([^/?]*)', 1)), '(?::(?:80|443))?\.*$', '') AS host,
    regexp_extract(bare, '(?s)^[^/?]*([^?]*)', 1) AS path,
    regexp_extract(bare, '(?s)^[^?]*\?(.*)$', 1) AS query
  FROM page
), named AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_full_match(p,
    '(?s)(?:utm_[^=]*|ref|gclid|fbclid|sessionid)(?:=.*)?'))), '&') AS kept
  FROM parts
), p AS (
  SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canon,
    host || regexp_replace(path, '[^/]*$', '') AS dir
  FROM named
), e AS (
  SELECT event_id, event_type, epoch_us(ts) AS seen, p.* FROM events JOIN p ON events.user_id = p.page_id
)
"""

WARC = rf"""
WITH {_URLS}, records AS (
  SELECT 'p' || page_id AS record_id, 'response' AS kind, canon, "at", 200 AS status, '"' || digest || '"' AS tag,
    digest, 'max-age=60' AS cache, 'text/html' AS type, CAST("at" AS VARCHAR) AS date, NULL AS expires FROM p
  UNION ALL
  SELECT 'r' || page_id, 'revisit', canon, "at" + 864000000000, 304, '"' || digest || '"', NULL, 'max-age=3600', 'none',
    CAST("at" + 864000000000 AS VARCHAR), NULL FROM p
  UNION ALL
  SELECT 'e' || event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'response' ELSE 'revisit' END, canon, seen,
    CASE event_type WHEN 'purchase' THEN 200 WHEN 'error' THEN 500 ELSE 304 END,
    CASE event_type WHEN 'purchase' THEN '"' || md5(digest || event_id) || '"' WHEN 'signup' THEN NULL ELSE 'W/"' || digest || '"' END,
    CASE event_type WHEN 'purchase' THEN md5(digest || event_id) WHEN 'signup' THEN digest END,
    NULL, NULL, CAST(seen AS VARCHAR), '0'
  FROM e
), responses AS (
  SELECT * FROM records WHERE kind = 'response' AND status = 200
  QUALIFY row_number() OVER (PARTITION BY canon, "at" ORDER BY record_id DESC) = 1
), joined AS (
  SELECT v.record_id, v.canon, v."at", v.tag, v.digest, v.cache, v.date, v.expires,
    r.record_id AS rid, r."at" AS rat, r.tag AS rtag, r.digest AS rdigest, r.cache AS rcache, r.type AS rtype, r.date AS rdate, r.expires AS rexpires
  FROM (SELECT * FROM records WHERE kind = 'revisit') v ASOF LEFT JOIN responses r ON v.canon = r.canon AND v."at" > r."at"
), judged AS (
  SELECT *, coalesce(regexp_replace(tag, '^W/', '') = regexp_replace(rtag, '^W/', ''), digest = rdigest) AS same FROM joined
), outcomes AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN same THEN 'resolved' WHEN NOT same THEN 'changed' ELSE 'unverified' END AS outcome
  FROM judged
)
SELECT record_id, canon AS canonical_url, "at" AS revisit_at, outcome, rid AS response_id, rat AS response_at,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control: ' || coalesce(cache, rcache), 'content-type: ' || rtype,
    'date: ' || coalesce(date, rdate), 'etag: ' || coalesce(tag, rtag), 'expires: ' || coalesce(expires, rexpires)) END AS headers,
  CASE WHEN outcome = 'resolved' THEN rdigest END AS payload_digest
FROM outcomes
"""

URL_FILTER = rf"""
WITH {_URLS}, edits AS (
  SELECT level, key, "at", max(action) AS action, min(expires) AS expires FROM (
    SELECT CASE event_type WHEN 'signup' THEN 'url' WHEN 'view' THEN 'prefix' ELSE 'domain' END AS level,
      CASE event_type WHEN 'signup' THEN canon WHEN 'view' THEN dir ELSE host END AS key, seen AS "at",
      CASE event_type WHEN 'error' THEN 'allow' WHEN 'purchase' THEN 'remove' ELSE 'block' END AS action,
      CASE WHEN event_type IN ('click', 'view') THEN seen + 172800000000 END AS expires
    FROM e
  ) GROUP BY level, key, "at"
), intervals AS (
  SELECT level, key, "at" AS since, action, least(lead("at") OVER (PARTITION BY level, key ORDER BY "at"), expires) AS until FROM edits
), split AS (
  SELECT page_id, url, "at", canon, host, string_split(host, '.') AS labels,
    string_split(regexp_replace(path, '[^/]*$', ''), '/') AS dirs FROM p WHERE host <> ''
), keys AS (
  SELECT page_id, "at", 'domain' AS level, array_to_string(labels[i + 1:], '.') AS key
  FROM split, unnest(range(0, greatest(len(labels) - 2, 0) + 1)) r(i)
  UNION
  SELECT page_id, "at", 'prefix', host || array_to_string(dirs[1:i], '/') || '/'
  FROM split, unnest(range(1, greatest(len(dirs) - 1, 1) + 1)) r(i)
  UNION
  SELECT page_id, "at", 'url', canon FROM split
), found AS (
  SELECT k.*, i.since, i.until, i.action FROM keys k ASOF JOIN intervals i ON k.level = i.level AND k.key = i.key AND k."at" >= i.since
), best AS (
  SELECT * FROM found WHERE (until IS NULL OR "at" < until) AND action <> 'remove'
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY list_position(['domain', 'prefix', 'url'], level) DESC, length(key) DESC, key DESC) = 1
)
SELECT page.page_id, page.url, page."at" AS fetched_at, coalesce(action, 'none') AS verdict, level, key, since, until
FROM page LEFT JOIN best ON page.page_id = best.page_id
"""

FILL_IN_MIDDLE = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), h AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
  FROM u
), f AS (
  SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM h
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM f
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

# CRC-32 byte by byte, its table made by the polynomial's rule.
RESAMPLING = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, byte) ORDER BY byte) AS step
  FROM range(256) r(byte)
), w AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), v AS (
  SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), own AS (SELECT line, unnest(words) AS word FROM w), words AS (SELECT word FROM own UNION SELECT word FROM v
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, step[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM words, crc
), s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM v JOIN hashed USING (word) GROUP BY bucket
), sums AS (SELECT (SELECT CAST(sum(s) AS DOUBLE) FROM s) AS s_all, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) AS t_all
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), sums
), weights AS (SELECT line, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY line
), scored AS (
  SELECT line, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (line)
), ranked AS (
  SELECT line, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) OVER () // 100 AS drawn
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN ranked USING (line)
"""


def statements() -> dict[str, str]:
    return {
        "op2_warc_revisits": WARC,
        "op5_exact_dedup": EXACT_DEDUP,
        "op7_mixing": MIXING,
        "op10_url_filter": URL_FILTER,
        "op11_fill_in_middle": FILL_IN_MIDDLE,
        "op13_resampling": RESAMPLING,
    }

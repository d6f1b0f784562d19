"""SQL that checks the training-data queries."""

_ID = r"nullif(regexp_extract({c}, '(?:^|/)\s*([0-9]{{9}})(?:\.[A-Za-z0-9]+)?\s*$', 1), '')"
_LINKS = f"""
WITH RECURSIVE known AS (SELECT DISTINCT image_id FROM source_image),
e AS (
  SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b
  FROM (SELECT {_ID.format(c="left_image")} AS a, {_ID.format(c="right_image")} AS b FROM match_pair WHERE accepted)
  WHERE a <> b AND a IN (FROM known) AND b IN (FROM known)),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT a AS image_id, a AS g FROM ways
  UNION SELECT ways.b, reach.g FROM reach JOIN ways ON ways.a = reach.image_id AND reach.g < ways.b),
grouped AS (SELECT image_id, min(g) AS group_id FROM reach GROUP BY image_id)
"""

_PLACE = """
WITH w AS (
  SELECT *, image_id::BIGINT // 1024 AS block, image_id::BIGINT % 1024 AS x0,
    ('0x' || substr(sha256('sample-1:0:' || (image_id::BIGINT // 1024)::VARCHAR), 1, 12))::BIGINT AS word
  FROM manifest_group WHERE image_id IS NOT NULL),
a AS (SELECT *, (x0 * ((word & 1023) | 1) + ((word >> 5) & 1023)) & 1023 AS y FROM w),
b AS (SELECT *, xor(y, y >> 5) AS x1 FROM a),
c AS (SELECT *, (x1 * (((word >> 12) & 1023) | 1) + ((word >> 17) & 1023)) & 1023 AS y2 FROM b),
d AS (SELECT *, xor(y2, y2 >> 5) AS x2 FROM c),
f AS (SELECT *, (x2 * (((word >> 24) & 1023) | 1) + ((word >> 29) & 1023)) & 1023 AS y3 FROM d),
g AS (SELECT *, xor(y3, y3 >> 5) AS x3 FROM f)
"""

_SIGNED = """
signed AS (
  SELECT DISTINCT archive, image_id, coalesce(signature, CASE WHEN octet_length(small) = 72 THEN
    (CASE WHEN b >= 9223372036854775808::HUGEINT THEN b - 18446744073709551616::HUGEINT ELSE b END)::BIGINT END) AS s
  FROM (SELECT archive, image_id, signature, small, CASE WHEN small IS NOT NULL THEN list_reduce(list_transform(range(64), lambda i:
    CASE WHEN substr(hex(small), 2 * (i // 8 * 9 + i % 8 + 1) + 1, 2) > substr(hex(small), 2 * (i // 8 * 9 + i % 8) + 1, 2)
      THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda x, y: x * 2 + y) END AS b FROM source_image)
  WHERE archive IS NOT NULL AND image_id IS NOT NULL),
ok AS (SELECT * FROM signed WHERE s IS NOT NULL)
"""

ORACLE = {
    "p1_found": _LINKS + "SELECT image_id, group_id FROM grouped",
    "p1_group_sizes": _LINKS
    + "SELECT images, count(*) AS near_duplicate_groups FROM (SELECT group_id, count(*) AS images FROM grouped GROUP BY group_id) GROUP BY images",
    "p1_stale": _LINKS
    + """SELECT m.image_id, m.group_id, g.group_id AS found_group
         FROM (SELECT DISTINCT image_id, group_id FROM manifest_group WHERE group_id IS NOT NULL) m JOIN grouped g USING (image_id)
         WHERE m.group_id <> g.group_id""",
    "p2_found": """
SELECT group_id FROM (SELECT DISTINCT image_id, group_id FROM manifest_group WHERE group_id IS NOT NULL) g
JOIN manifest_split s USING (image_id) JOIN split_part p ON s.part = p.spelling
GROUP BY group_id HAVING count(DISTINCT p.part) >= 2""",
    "p3_found": f"""
WITH d AS (SELECT DISTINCT {_ID.format(c="image_id")} AS image_id, draw_no, rerun FROM drawn_sample WHERE draw_no IS NOT NULL AND rerun IS NOT NULL),
f AS (SELECT image_id, min(draw_no) AS first FROM d WHERE image_id IS NOT NULL GROUP BY image_id),
need AS (SELECT image_id, x::INT AS draw_no, r::INT AS rerun FROM f, range(1, 5) t(x), range(1, 3) u(r) WHERE x >= first)
SELECT image_id, draw_no, rerun FROM need WHERE NOT EXISTS (
  SELECT 1 FROM d WHERE d.image_id = need.image_id AND d.draw_no = need.draw_no AND d.rerun = need.rerun)""",
    "p3_sample": _PLACE
    + """, parts AS (SELECT image_id, min(p.part) AS part FROM manifest_split s JOIN split_part p ON s.part = p.spelling GROUP BY image_id)
      SELECT image_id, min(snapshot) AS snapshot, min(group_id) AS group_id, any_value(part) AS part FROM g LEFT JOIN parts USING (image_id) WHERE x3 < 128 GROUP BY image_id""",
    # every tokenizer that neither joins words nor makes more tokens than bytes gives the same answer, so bytes stand for tokens
    "p6_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 4096",
    "p7_found": """
WITH size AS (SELECT lower(trim(source)) AS source, sum(octet_length(encode(text))) AS n FROM documents GROUP BY 1),
goal AS (SELECT t.source, target_share, max_repeats, coalesce(n, 0) AS n FROM mix_target t LEFT JOIN size USING (source))
SELECT source FROM goal WHERE n * max_repeats < target_share * (SELECT sum(n) FROM goal)""",
    "p5_found": "WITH "
    + _SIGNED
    + """SELECT DISTINCT x.image_id AS image_a, y.image_id AS image_b FROM ok x JOIN ok y USING (archive)
         WHERE x.image_id < y.image_id AND bit_count(xor(x.s, y.s)) <= 4""",
    "p5_groups": "WITH RECURSIVE "
    + _SIGNED
    + """, near AS (SELECT DISTINCT archive, x.s AS a, y.s AS b FROM ok x JOIN ok y USING (archive) WHERE bit_count(xor(x.s, y.s)) <= 4),
    low AS (SELECT archive, s, min(image_id) AS g, count(*) AS copies FROM ok GROUP BY archive, s),
    reach AS (SELECT archive, s, g FROM low UNION SELECT n.archive, n.b, r.g FROM reach r JOIN near n ON n.archive = r.archive AND n.a = r.s),
    named AS (SELECT archive, s, min(g) AS group_id FROM reach GROUP BY archive, s),
    degree AS (SELECT archive, a AS s, count(*) - 1 AS links FROM near GROUP BY archive, a)
    SELECT archive, image_id, group_id, copies, links FROM ok JOIN named USING (archive, s) JOIN low USING (archive, s) JOIN degree USING (archive, s)""",
}

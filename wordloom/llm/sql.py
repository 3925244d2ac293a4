"""The results of the queries in DuckDB's dialect, by comparing everything with everything."""

P1_FOUND = r"""
WITH w AS (
  SELECT workflow_id AS id,
         list_distinct(list_filter(any_value(prompt_shingles), lambda x: x IS NOT NULL)) AS p,
         list_distinct(list_filter(any_value(tool_shingles), lambda x: x IS NOT NULL)) AS t
  FROM workflows WHERE workflow_id IS NOT NULL GROUP BY workflow_id
), s AS (SELECT * FROM w WHERE len(p) > 0 AND len(t) > 0),
c AS (
  SELECT a.id AS ida, b.id AS idb,
         len(list_intersect(a.p, b.p)) AS ip, len(a.p) + len(b.p) AS np,
         len(list_intersect(a.t, b.t)) AS it, len(a.t) + len(b.t) AS nt
  FROM s a JOIN s b ON a.id < b.id
)
SELECT ida AS workflow_id_a, idb AS workflow_id_b FROM c
WHERE 5 * (ip * (nt - it) + it * (np - ip)) >= 6 * (np - ip) * (nt - it)
"""

P1_MEMBERS = P1_FOUND.replace("SELECT ida AS workflow_id_a, idb AS workflow_id_b FROM c", ", pairs AS (SELECT ida, idb FROM c").rstrip() + """),
l AS (SELECT id, count(*) AS links FROM (SELECT ida AS id FROM pairs UNION ALL SELECT idb FROM pairs) GROUP BY id)
SELECT s.id AS workflow_id, min(s.id) OVER (PARTITION BY list_sort(p), list_sort(t)) AS class_id, coalesce(links, 0) AS links FROM s LEFT JOIN l ON l.id = s.id
"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

P2_FOUND = rf"""
WITH RECURSIVE w AS (
  SELECT DISTINCT id, {_WORDS.format("coalesce(title, '') || chr(10) || content")} AS w
  FROM wiki_entries WHERE id IS NOT NULL AND regexp_matches(content, '[\p{{L}}\p{{N}}]')
), g AS (
  SELECT DISTINCT id, unnest([w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)]) AS g FROM w
), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.id = x JOIN n ny ON ny.id = y WHERE c / (nx.n + ny.n - c) >= 0.6),
r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS id, min(y) AS group_id FROM r GROUP BY x
"""

P3_FOUND = rf"""
WITH d AS (
  SELECT DISTINCT id, content, tags, regexp_split_to_array(content, '\r\n|\r|\n') AS l
  FROM wiki_entries WHERE id IS NOT NULL AND regexp_matches(content, '[\p{{L}}\p{{N}}]')
), m AS (
  SELECT *, CASE WHEN trim(l[1], e' \t\v\f') = '---'
                 THEN list_position([trim(x, e' \t\v\f') for x in l[2:]], '---') END AS k FROM d
), f AS (
  SELECT id,
    {_WORDS.format("array_to_string(CASE WHEN k > 0 THEN l[k+2:] ELSE l END, chr(10))")} AS body,
    list_sort(list_filter([array_to_string({_WORDS.format("x")}, ' ') for x in (CASE WHEN k > 0 THEN l[2:k] ELSE [] END)],
              lambda x: x <> '')) AS block,
    list_sort(list_distinct(list_filter([array_to_string({_WORDS.format("x")}, ' ') for x in coalesce(tags, [])],
              lambda x: x <> ''))) AS tags
  FROM m
)
SELECT min(id) AS id, count(DISTINCT id) AS n_copies FROM f GROUP BY body, block, tags HAVING count(DISTINCT id) > 1
"""

P6_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def _levels(kind: str, steps: str) -> str:
    """Patterns of 1 to 5 steps, each level from the frequent ones of the last, at their first place in each row."""
    head = f"""{kind}_rows AS (SELECT row_number() OVER () AS rid, session_id AS sid, {steps} AS steps FROM transcript_digests WHERE session_id IS NOT NULL),
{kind}_s AS (SELECT rid, sid, pos, item FROM (SELECT rid, sid, unnest(range(1, len(steps) + 1)) AS pos, unnest(steps) AS item FROM {kind}_rows)
  WHERE item IS NOT NULL AND regexp_matches(item, '[^\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]')),
{kind}_1 AS (SELECT rid, sid, item AS p, min(pos) AS pos FROM {kind}_s GROUP BY rid, sid, item)"""
    parts = [head]
    for n in range(1, 6):
        parts.append(f"{kind}_f{n} AS (SELECT p, count(DISTINCT sid) AS support FROM {kind}_{n} GROUP BY p HAVING count(DISTINCT sid) * 10 >= (SELECT n FROM total))")
        if n < 5:
            parts.append(f"""{kind}_{n + 1} AS (SELECT l.rid, l.sid, l.p || ' > ' || s.item AS p, min(s.pos) AS pos
  FROM {kind}_{n} l JOIN {kind}_f{n} f ON f.p = l.p JOIN {kind}_s s ON s.rid = l.rid AND s.pos > l.pos GROUP BY l.rid, l.sid, l.p, s.item)""")
    return ",\n".join(parts)


P5_FOUND = (
    "WITH total AS (SELECT count(DISTINCT session_id) AS n FROM transcript_digests),\n"
    + _levels("tool", "tool_sequence") + ",\n" + _levels("skill", "[u.skill for u in skill_uses]") + "\n"
    + "\nUNION ALL ".join(f"SELECT '{k}' AS kind, p AS pattern, support FROM {k}_f{n}" for k in ("tool", "skill") for n in range(2, 6))
)

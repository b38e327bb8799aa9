"""The graph of project.py in SQL, as common table expressions that the queries' SQL builds on."""

FILES = """WITH RECURSIVE files AS (
  SELECT p_partkey AS k, 'src/' || CASE WHEN p_partkey % 50 = 1 THEN '' ELSE lower(p_type) || '/' END
    || CASE WHEN p_partkey % 20 = 0 THEN '__tests__/p' || p_partkey || '.test.ts' ELSE 'p' || p_partkey || '.ts' END AS path FROM part)"""

GRAPH = (
    FILES
    + """, li AS (
  SELECT *, l_orderkey * 10 + l_linenumber AS seq, lag(l_partkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS prev FROM lineitem),
imp AS (
  SELECT l_partkey AS fk, prev AS tk, CASE l_returnflag WHEN 'N' THEN 'IMPORTS' WHEN 'A' THEN 'RE_EXPORTS' ELSE 'DYNAMIC_IMPORTS' END AS type,
    CASE WHEN l_returnflag NOT IN ('N', 'A') THEN NULL WHEN l_linestatus = 'O' THEN 'value' ELSE 'type-only' END AS kind, min(seq) AS seq
  FROM li WHERE l_quantity >= 45 AND prev <> l_partkey GROUP BY 1, 2, 3, 4),
fe AS (SELECT a.path AS src, b.path AS dst, imp.type, kind, seq FROM imp JOIN files a ON a.k = fk JOIN files b ON b.k = tk),
ext AS (SELECT path AS src, 's' || l_suppkey AS dst, min(seq) AS seq FROM li JOIN files ON k = l_partkey WHERE l_quantity >= 49 GROUP BY 1, 2),
mods AS (
  SELECT path, 'f' || l_suppkey AS name, ['function', 'class', 'variable', 'interface', 'type', 'component'][l_suppkey % 6 + 1] AS kind,
    CASE WHEN l_suppkey % 6 IN (0, 5) THEN max(l_linenumber) * 3 END AS complexity, bool_or(l_returnflag = 'R') AS deprecated,
    CASE WHEN l_suppkey % 97 = 5 THEN 'tests/f' || l_suppkey || '.ts' END AS test_file, CASE WHEN l_suppkey % 4 = 0 THEN 'c' || max(l_orderkey) END AS last_commit,
    CASE WHEN l_suppkey % 3 = 0 THEN count(*) END AS freq, k * 1000000 + l_suppkey AS seq
  FROM li JOIN files ON k = l_partkey WHERE l_quantity <= 3 GROUP BY path, k, l_suppkey),
dirs AS (
  SELECT DISTINCT CASE WHEN n = 0 THEN '.' ELSE array_to_string(string_split(path, '/')[1:n], '/') END AS path
  FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS n FROM files)),
contains AS (
  SELECT 'DIRECTORY:' || CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS "from", kind || ':' || path AS "to"
  FROM (SELECT path, 'DIRECTORY' AS kind FROM dirs WHERE path <> '.' UNION ALL SELECT path, 'FILE' FROM files)),
edges AS (
  SELECT "from", "to", 'CONTAINS' AS type, NULL AS kind, 0 AS seq FROM contains
  UNION ALL SELECT 'FILE:' || src, 'FILE:' || dst, type, kind, seq FROM fe
  UNION ALL SELECT 'FILE:' || src, 'EXTERNAL:' || dst, 'IMPORTS', 'value', seq FROM ext
  UNION ALL SELECT 'FILE:' || path, 'MODULE:' || path || '#' || name, 'EXPORTS', NULL, seq FROM mods),
nodes AS (
  SELECT 'DIRECTORY:' || path AS id, 'DIRECTORY' AS type, path, regexp_extract(path, '[^/]*$') AS name FROM dirs
  UNION ALL SELECT 'FILE:' || path, 'FILE', path, regexp_extract(path, '[^/]*$') FROM files
  UNION ALL SELECT 'MODULE:' || path || '#' || name, 'MODULE', path, name FROM mods
  UNION ALL SELECT 'EXTERNAL:s' || s_suppkey, 'EXTERNAL', 's' || s_suppkey, 's' || s_suppkey FROM supplier)"""
)

#: First folder of a path below src.
GROUP = "CASE WHEN substr({0}, 5) LIKE '%/%' THEN split_part(substr({0}, 5), '/', 1) ELSE '__root__' END"

MATRIX = (
    GRAPH
    + f""", grouped AS (SELECT path, {GROUP.format("path")} AS g FROM files),
between AS (SELECT src, dst, type, kind, {GROUP.format("src")} AS fg, {GROUP.format("dst")} AS tg FROM fe),
matrix AS (SELECT fg, tg, count(*) AS n FROM between WHERE type <> 'DYNAMIC_IMPORTS' AND fg <> tg GROUP BY 1, 2),
net AS (
  SELECT g, files, coalesce(i, 0)::BIGINT AS imported_by, coalesce(o, 0)::BIGINT AS imports_from, (coalesce(i, 0) - coalesce(o, 0))::BIGINT AS net_score
  FROM (SELECT g, count(*) AS files FROM grouped GROUP BY g) LEFT JOIN (SELECT tg AS g, sum(n) AS i FROM matrix GROUP BY 1) USING (g)
  LEFT JOIN (SELECT fg AS g, sum(n) AS o FROM matrix GROUP BY 1) USING (g)),
lagged AS (SELECT *, lag(net_score) OVER (ORDER BY net_score DESC, g) - net_score AS gap FROM net),
lay AS (SELECT *, (sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (ORDER BY net_score DESC, g ROWS UNBOUNDED PRECEDING) + 1)::INTEGER AS layer FROM lagged)"""
)

#: Reverse reachability over static edges: roots(t) must be defined before it.
REACH = """, dep AS (SELECT DISTINCT src AS a, dst AS b FROM fe WHERE type <> 'DYNAMIC_IMPORTS' {tests}),
indeg AS (SELECT dst, count(*) AS n FROM fe WHERE type <> 'DYNAMIC_IMPORTS' GROUP BY dst),
roots AS ({roots}),
walk AS (SELECT t, t AS p, 0 AS d FROM roots UNION SELECT walk.t, dep.a, walk.d + 1 FROM walk JOIN dep ON dep.b = walk.p WHERE walk.d < {depth}),
reached AS (SELECT t, p, min(d) AS d FROM walk WHERE d > 0 GROUP BY t, p)"""
NO_TESTS = r"AND NOT regexp_matches('FILE:' || src, '/(__tests__|tests)/|\.(test|spec)\.tsx?$')"


def top_roots(k: int) -> str:
    return f"SELECT dst AS t FROM indeg ORDER BY n DESC, 'FILE:' || dst LIMIT {k}"


def reach(roots: str, depth: int = 10, tests: str = NO_TESTS) -> str:
    return GRAPH + REACH.format(roots=roots, depth=depth, tests=tests)


def reach_by_levels(roots: str, depth: int = 10, tests: str = NO_TESTS) -> str:
    """The same rows level by level, each without the pairs of all levels before it: for many roots."""
    parts = [GRAPH + REACH.format(roots=roots, depth=0, tests=tests).split(",\nwalk AS")[0], "level0 AS (SELECT t, t AS p FROM roots)", "seen0 AS (SELECT t, p FROM level0 WHERE false)"]
    for d in range(1, depth + 1):
        parts.append(f"level{d} AS MATERIALIZED (SELECT DISTINCT l.t, dep.a AS p FROM level{d - 1} l JOIN dep ON dep.b = l.p ANTI JOIN seen{d - 1} s ON s.t = l.t AND s.p = dep.a)")
        parts.append(f"seen{d} AS MATERIALIZED (SELECT t, p FROM seen{d - 1} UNION ALL SELECT t, p FROM level{d})")
    parts.append("reached AS (" + " UNION ALL ".join(f"SELECT t, p, {d} AS d FROM level{d}" for d in range(1, depth + 1)) + ")")
    return ",\n".join(parts)

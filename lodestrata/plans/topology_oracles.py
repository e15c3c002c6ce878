"""DuckDB SQL of the measures in operators/topology.py and operators/accounts.py."""

from __future__ import annotations

from ..functions import rules as R
from ..operators.accounts import BLOCK_MEMBERS
from ..operators.gates import SHALLOW
from .graph_oracles import GRAPH, RESOLVED
from .oracles import CHANGES, COMMITS, HISTORY, PATHS, dependency, gated, ratio

EDGES = "edges AS (SELECT sha, parent FROM g WHERE parent IS NOT NULL UNION SELECT sha, second FROM g WHERE second IS NOT NULL)"

ORACLES = {
    "src07_topological": f"""WITH RECURSIVE {GRAPH}, {EDGES},
late AS (
  SELECT sha, author_sec AS c FROM g
  UNION SELECT e.sha, c + 1 FROM late JOIN edges e ON e.parent = late.sha JOIN g ON g.sha = e.sha WHERE c + 1 > g.author_sec),
m AS (SELECT sha, max(c) AS corrected FROM late GROUP BY 1)
SELECT repo, sha, corrected, row_number() OVER (PARTITION BY repo ORDER BY corrected, sha) - 1 AS sequence FROM m JOIN g USING (sha)""",
    "src10_sizes": f"""WITH RECURSIVE {GRAPH}, {CHANGES.removeprefix(PATHS + ',')}, {EDGES},
up AS (SELECT sha AS target, sha FROM g WHERE sha % 97 = 0 UNION SELECT target, parent FROM up JOIN edges USING (sha)),
n AS (SELECT target AS sha, count(*) AS commits FROM up GROUP BY 1),
d AS (SELECT sha AS place, sum(CASE status WHEN 'A' THEN 1 WHEN 'D' THEN -1 ELSE 0 END) AS files, sum(added - deleted) AS lines FROM changes GROUP BY 1),
s AS (SELECT anc.sha, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines FROM anc LEFT JOIN d ON d.place = anc.at WHERE anc.sha % 97 = 0 GROUP BY 1)
SELECT * FROM n JOIN s USING (sha)""",
    "jn25_account_blocks": f"""WITH {COMMITS},
e AS (
  SELECT 'forge|code.test|' || s_suppkey AS account, sha FROM human JOIN supplier ON s_nationkey = repo AND customer % 5 = s_suppkey % 5 WHERE s_suppkey % 13 <> 0
  UNION SELECT 'ci|bots.test|0', sha FROM commits WHERE is_bot
  UNION SELECT 'forge|code.test|c' || (customer // 18), sha FROM commits WHERE customer % 9 = 0),
o AS (SELECT account, sha256(CAST(sha AS VARCHAR)) AS oid FROM e),
b AS (SELECT *, (row_number() OVER (PARTITION BY account ORDER BY oid) - 1) // {BLOCK_MEMBERS} AS block FROM o)
SELECT account, block, count(*) AS n, min(oid) AS first_oid, max(oid) AS last_oid, sha256(string_agg(oid, chr(10) ORDER BY oid)) AS digest FROM b GROUP BY 1, 2""",
    "jn16_introductions": f"""WITH {HISTORY}, man AS (SELECT DISTINCT sha FROM changes WHERE {dependency('path')}),
names AS (SELECT repo, sha, local_day, ord, regexp_extract(path, '([^/.]+)\\.[^/]*$', 1) AS name FROM changes SEMI JOIN man USING (sha) JOIN commits USING (sha)),
f AS (SELECT arg_min(sha, (local_day, ord)) AS sha, name FROM names WHERE name <> '' GROUP BY repo, name),
n AS (SELECT sha, count(*) AS names FROM f GROUP BY 1),
o AS (SELECT repo, actor, count(*) AS denominator, count(man.sha) AS manifest_commits, CAST(coalesce(sum(names), 0) AS BIGINT) AS n FROM scoped s LEFT JOIN n ON n.sha = s.sha LEFT JOIN man ON man.sha = s.sha GROUP BY 1, 2)
SELECT repo, actor, denominator, manifest_commits, {gated('n', 'denominator')} AS introduced, CASE WHEN denominator < {R.FLOOR} THEN 'insufficient_population' END AS reason FROM o""",
    "agg51_scopes": f"""WITH {RESOLVED},
t AS (SELECT repo, actor, local_day, state IN ('verified', 'claimed', 'inferred') AS tenant FROM res WHERE NOT is_merge),
s AS (
  SELECT repo, 'repo' AS scope, 'human_nonmerge' AS population, NULL AS subject, local_day FROM t
  UNION ALL SELECT repo, 'actor_cluster', 'repo_local_git_primary_author_cluster', actor, local_day FROM t
  UNION ALL SELECT repo, 'tenant', 'explicit_identity_nonmerge', NULL, local_day FROM t WHERE tenant),
d AS (SELECT repo, scope, population, subject, local_day, count(*) AS n FROM s GROUP BY ALL),
a AS (
  SELECT repo, scope, population, subject, CAST(sum(n) AS BIGINT) AS commits, count(*) AS active_days, {ratio('sum(n)', 'count(*)')} AS per_day, CAST(median(n) AS DOUBLE) AS per_day_median,
    count(*) FILTER (local_day >= head_day - INTERVAL {R.SHORT_WINDOW_DAYS} DAY) AS active_days_13w, scope = 'repo' AND repo % {SHALLOW} = 0 AS cut FROM d JOIN heads USING (repo) GROUP BY ALL)
SELECT repo, scope, population, subject, {', '.join(f'CASE WHEN NOT cut THEN {c} END AS {c}' for c in ('commits', 'active_days', 'per_day', 'per_day_median', 'active_days_13w'))}, CASE WHEN cut THEN 'history_incomplete' END AS reason FROM a""",
}

"""DuckDB SQL of the measures in operators/gates.py."""

from __future__ import annotations

from ..operators import gates
from .oracles import COCHANGE, COMMITS, EVENTS, FLAGS, HISTORY, LIFECYCLE, SURFACE, TOUCHED, ratio

_CONSENT = ", ".join(f"'{a}'" for a in gates.CONSENTING)
_DECLARED = ", ".join(f"('{s}', {'NULL' if floor is None else floor})" for s, floor in gates.DECLARED_SURFACES)
_BELOW = " + ".join(f"CAST(rate > {b} AS INT)" for b in gates.DECILE_BOUNDS)
_SEEN = "CASE WHEN commits > 0 THEN 'present' ELSE 'observed_zero' END"

ORACLES = {
    "flt02_as_of": f"WITH {COMMITS} SELECT repo, count(*) AS commits, count(DISTINCT actor) AS actors, CAST(max(local_day) AS VARCHAR) AS last_day FROM scoped WHERE local_day <= DATE '{gates.AS_OF}' GROUP BY 1",
    "flt10_consent": f"WITH {COMMITS} SELECT repo, actor, CASE WHEN actor IN ({_CONSENT}) THEN count(*) END AS commits, CASE WHEN actor NOT IN ({_CONSENT}) THEN 'no_consent' END AS reason FROM scoped GROUP BY repo, actor",
    "flt11_history": f"WITH {COMMITS} SELECT repo, count(*) AS commits, CASE WHEN repo % {gates.SHALLOW} <> 0 THEN CAST(datediff('day', min(local_day), max(local_day)) AS BIGINT) END AS span_days, CASE WHEN repo % {gates.SHALLOW} = 0 THEN 'history_incomplete' END AS reason FROM scoped GROUP BY repo",
    "flt13_cadence": f"""WITH {EVENTS}, h AS (SELECT repository, day, micros // 3600000000 AS hour, count(*) AS n FROM ev GROUP BY ALL), d AS (SELECT repository, day, count(*) AS hours, sum(n) AS n FROM h GROUP BY ALL),
r AS (SELECT repository, CAST(sum(n) AS BIGINT) AS events, count(*) AS days, min(hours) AS least FROM d GROUP BY 1)
SELECT repository, events, days, CASE WHEN least = 24 THEN {ratio('events', 'days')} END AS events_per_day, CASE WHEN least <> 24 THEN 'partial_coverage' END AS reason FROM r""",
    "cmp03_presence": f"""WITH {HISTORY}, {TOUCHED}, {SURFACE}, d AS (SELECT surface, CAST(floor AS DOUBLE) AS floor FROM (VALUES {_DECLARED}) AS t(surface, floor))
SELECT repo, surface, commits, share, {_SEEN} AS presence, CASE WHEN floor IS NULL THEN {_SEEN} WHEN share IS NULL THEN 'not_observed' WHEN share = 0 THEN 'observed_zero' WHEN share >= floor THEN 'overlap' ELSE 'outside_declared_range' END AS comparison FROM surface_profile JOIN d USING (surface)""",
    "win06_founder": f"WITH {COMMITS}, n AS (SELECT repo, actor, row_number() OVER (PARTITION BY repo ORDER BY local_day, ord) - 1 AS position FROM scoped) SELECT repo, actor, min(position) AS position FROM n GROUP BY 1, 2",
    "q_decile_bounds": f"WITH {HISTORY}, {FLAGS}, {COCHANGE} SELECT repo, rate, CAST(1 + {_BELOW} AS BIGINT) AS decile FROM cochange_rates WHERE narrate_rate",
    "agg48_measurements": f"""WITH {COMMITS}, r AS (SELECT repo, sha256('actor:' || actor) AS mask, count(*) AS commits, count(*) FILTER (is_merge) AS merges, count(*) FILTER (NOT is_merge) AS nonmerges FROM human GROUP BY 1, 2),
p AS (SELECT repo, count(*) AS population FROM human GROUP BY 1)
SELECT repo, mask, commits, merges, nonmerges, count(*) OVER (PARTITION BY repo) AS actors, merges + nonmerges = commits AS adds_up, sum(commits) OVER (PARTITION BY repo) = population AS complete FROM r JOIN p USING (repo)""",
    "jn24_pages": """WITH s AS (SELECT l_orderkey AS oid, l_suppkey AS account, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
c AS (SELECT l_orderkey AS oid, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY 1)
SELECT account, count(*) AS oids, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (conflict) AS conflicts FROM s JOIN c USING (oid) WHERE pos = 1 GROUP BY 1""",
    "jn26_evidence": f"""WITH {COMMITS}, e AS (SELECT DISTINCT l_suppkey AS account, l_orderkey AS sha FROM lineitem)
SELECT account, count(*) AS evidence, count(*) FILTER (repo = s_nationkey) AS kept, count(*) FILTER (repo <> s_nationkey) AS "foreign", min(sha) FILTER (repo = s_nationkey) AS first_kept FROM e JOIN supplier ON s_suppkey = account JOIN commits USING (sha) GROUP BY 1""",
    "val16_isolation": f"""WITH {COMMITS}, b AS (SELECT customer, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN commits ON l_orderkey = sha GROUP BY 1)
SELECT customer % 100 AS bucket, count(*) AS actors, count(*) FILTER (n = 1) AS may_be_named FROM b GROUP BY 1""",
    "val07b_windows": f"WITH {LIFECYCLE} SELECT project, record_type, count(*) AS windows, count(*) FILTER (created > coalesce(merged, closed, released)) AS violations FROM lifecycle WHERE coalesce(merged, closed, released) IS NOT NULL GROUP BY 1, 2",
    "val10_vocabulary": f"WITH {EVENTS} SELECT event_type, count(*) AS n FROM ev WHERE event_type NOT IN ({', '.join(repr(x) for x in gates.EVENT_VOCABULARY)}) GROUP BY 1",
    "fn42_bindings": "SELECT CAST(n_nationkey AS BIGINT) AS repo, sha256('repository' || chr(0) || lower(n_name)) AS binding FROM nation",
}

"""DuckDB SQL of the measures in operators/claims.py, operators/chains.py, operators/registers.py, operators/roles.py and of the coverage gate."""

from __future__ import annotations

from ..functions import rules as R
from .oracles import COMMITS, LIFECYCLE, ORACLES as BASE
from .oracles import TAGS, ratio


def _from(name: str) -> str:
    return f"({BASE[name]})"


_STATUS = "CASE WHEN accounts = 0 THEN 'unresolved' WHEN accounts = 1 {more}THEN 'resolved' ELSE 'ambiguous' END"
CLAIMS = f"""WITH {LIFECYCLE},
cards0 AS (SELECT repo, actor, count(*) AS commits, count(*) FILTER (is_merge) AS merges, min(author_sec) AS first_sec, max(author_sec) AS last_sec, repo % 5 = 3 AND actor = 'building' AS changed FROM human GROUP BY 1, 2),
cards AS (SELECT *, commits - merges + CAST(changed AS INT) AS nonmerges, CASE WHEN changed THEN first_sec - 1 ELSE last_sec END AS until FROM cards0),
idx AS (SELECT repo, human_merges + human_nonmerge + CAST(repo % 7 = 2 AS INT) AS population FROM {_from('agg40_population')}),
blocks AS (
  SELECT repo, c.population AS prod_commits, cochanged, CASE WHEN repo % 6 = 1 THEN coalesce(rate, 0) + 0.5 ELSE rate END AS rate, retouch, CASE WHEN repo % 8 = 4 THEN retouch + 1 ELSE corrective END AS corrective, w.population AS rework_population,
    a.commits AS scope_commits, active_days, per_day
  FROM {_from('agg04_test_cochange')} c JOIN {_from('agg05_rework')} w USING (repo) JOIN {_from('agg02_activity')} a USING (repo)),
years AS (SELECT repo, actor, year(local_day) AS year, count(*) AS n FROM human GROUP BY ALL HAVING repo <> 9 OR year(local_day) <> 1995),
acc AS (SELECT repo, count(s_suppkey) AS accounts FROM heads LEFT JOIN supplier ON s_nationkey = repo GROUP BY 1),
hours AS (SELECT repository, observed, expected, missing + CAST(repository = 'org/r3' AS INT) AS missing, rate, CASE WHEN repository = 'org/r5' THEN CASE status WHEN 'complete' THEN 'partial' ELSE 'complete' END ELSE status END AS status FROM {_from('agg20_coverage')}),
rec0 AS (SELECT project, record_id, created, coalesce(merged, closed, released) AS done FROM lifecycle),
records AS (SELECT * FROM rec0 UNION ALL SELECT * FROM rec0 WHERE record_id % 307 = 0),
selected AS (SELECT repo, CASE WHEN repo % 9 = 8 THEN 'nobody' ELSE min(actor) END AS actor FROM scoped GROUP BY repo),
roles AS (SELECT repo, denominator, share, n + CAST(repo = 6 AND category = 'recent' AS INT) AS n FROM {_from('agg28_role_profile')} WHERE dimension = 'phase')
"""
_CHECKS = {
    "actors_sum_to_population": ("index", "idx LEFT JOIN (SELECT repo, sum(commits) AS s FROM cards GROUP BY 1) USING (repo)", "population IS DISTINCT FROM coalesce(s, 0)"),
    "selected_are_actors": ("selected", "selected s", "NOT EXISTS (SELECT 1 FROM cards c WHERE c.repo = s.repo AND c.actor = s.actor)"),
    "cards_are_unique": ("cards", "cards", "false"),
    "card_parts_add_up": ("cards", "cards", "merges + nonmerges <> commits"),
    "card_window_in_order": ("cards", "cards", "first_sec > until"),
    "years_sum_to_card": ("cards", "cards LEFT JOIN (SELECT repo, actor, sum(n) AS s FROM years GROUP BY 1, 2) USING (repo, actor)", "commits IS DISTINCT FROM coalesce(s, 0)"),
    "account_status_fits": ("accounts", "acc", f"{_STATUS.format(more='OR repo % 4 = 1 ')} <> {_STATUS.format(more='')}"),
    "hours_add_up": ("hours", "hours", "observed + missing <> expected"),
    "hours_status_fits": ("hours", "hours", "(missing = 0) <> (status = 'complete')"),
    "hours_rate_fits": ("hours", "hours", f"abs(rate - {ratio('observed', 'expected', 12)}) > 1e-12"),
    "record_ids_are_unique": ("records", "records", "record_id % 307 = 0 AND created IS NOT NULL"),
    "oid_has_forty_digits": ("records", "records", "record_id % 211 = 0"),
    "record_in_window": ("records", "records", "created NOT BETWEEN epoch(DATE '1992-01-01') AND epoch(DATE '2030-01-01')"),
    "record_ends_after_start": ("records", "records", "done < created"),
    "cochange_parts_fit": ("blocks", "blocks", "cochanged > prod_commits OR prod_commits > scope_commits"),
    "cochange_rate_fits": ("blocks", "blocks", f"rate IS DISTINCT FROM {ratio('cochanged', 'prod_commits')} AND coalesce(abs(rate - {ratio('cochanged', 'prod_commits')}) > 1e-12, true)"),
    "rework_parts_fit": ("blocks", "blocks", "corrective > retouch OR retouch > rework_population"),
    "per_day_fits": ("blocks", "blocks", f"abs(per_day - {ratio('scope_commits', 'active_days')}) > 1e-12"),
    "role_share_fits": ("roles", "roles", f"denominator >= {R.FLOOR} AND abs(share - {ratio('n', 'denominator')}) > 1e-12"),
    "role_share_withheld": ("roles", "roles", f"denominator < {R.FLOOR} AND share IS NOT NULL"),
}
TRACKED = f"""{LIFECYCLE},
k0 AS (SELECT project, record_id AS r, kind, state, sec, CASE kind WHEN 'issue_opened' THEN 0 WHEN 'issue_triaged' THEN 1 WHEN 'issue_closed' THEN 2 ELSE 3 END AS k FROM tracker),
k1 AS (SELECT *, max(sec) FILTER (k = 0) OVER (PARTITION BY r) AS sec0, max(sec) FILTER (k = 1) OVER (PARTITION BY r) AS sec1 FROM k0),
k2 AS (SELECT *, CASE WHEN k = 2 AND sec1 IS NOT NULL AND r % 127 <> 0 THEN 1 WHEN k > 0 THEN 0 END AS goal FROM k1),
ev AS (
  SELECT project, r * 4 + k AS id, sec * 10 + k AS position, 'issue' AS record_type, r, kind, state,
    CASE WHEN k = 0 AND r % 107 = 0 THEN r * 4 + 1 WHEN k > 0 AND r % 109 = 0 THEN (r - 3) * 4 WHEN k = 2 AND r % 113 = 0 THEN -1 WHEN goal IS NOT NULL THEN r * 4 + goal END AS previous,
    CASE goal WHEN 1 THEN 'triaged' WHEN 0 THEN 'open' END AS previous_state, CASE WHEN k = 3 THEN (r + 2) * 4 END AS linked, sec,
    CASE WHEN k > 0 THEN sec - CASE WHEN goal = 1 THEN sec1 ELSE sec0 END + CASE WHEN r % 101 = 5 THEN 1 ELSE 0 END END AS duration
  FROM k2
  UNION ALL SELECT project, record_id * 4, created * 10, 'milestone', record_id, 'milestone_set', CASE WHEN record_id % 10 = 0 THEN 'done' ELSE 'active' END, NULL, NULL, NULL, created, NULL FROM lifecycle WHERE record_type = 'release'),
way AS (SELECT id, id AS place, 0 AS depth FROM ev UNION ALL SELECT way.id, p.id, depth + 1 FROM way JOIN ev e ON e.id = way.place JOIN ev p ON p.id = e.previous WHERE depth < 12),
deep AS (SELECT id, max(depth) AS steps, arg_max(place, depth) AS root FROM way GROUP BY 1),
rooted AS (SELECT id, steps >= 12 AS cyclic, CASE WHEN steps < 12 THEN steps END AS depth, CASE WHEN steps < 12 THEN root END AS root FROM deep),
forks AS (SELECT previous, count(*) AS after FROM ev WHERE kind <> 'issue_linked' GROUP BY 1)"""
#: A repeated record counts once more than it should.
_HALF = {"record_ids_are_unique": " // 2"}



def _tree(rows: str) -> str:
    """CTEs m (repo, members, digest) over a query of distinct (repo, x)."""
    fold = "SELECT repo, {p} AS place, sha256(string_agg(d, ',' ORDER BY {o}place, d)) AS d, CAST(sum(n) AS BIGINT) AS n FROM {t} GROUP BY 1, 2"
    return f"""l0 AS (SELECT repo, sha256(x) AS d, sha256(x) AS place, 1 AS n FROM ({rows})), l1 AS ({fold.format(p='substr(l0.place, 1, 6)', o='l0.', t='l0')}),
l2 AS ({fold.format(p='substr(l1.place, 1, 3)', o='l1.', t='l1')}), m AS (SELECT repo, CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(d, ',' ORDER BY place, d)) AS digest FROM l2 GROUP BY 1)"""


ROLES = """
s AS (
  SELECT c_custkey, c_mktsegment AS seg, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS p1, count(*) FILTER (o_orderpriority = '2-HIGH') AS p2, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS p3, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS p4,
    count(*) FILTER (o_orderpriority = '5-LOW') AS p5, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
t AS (
  SELECT CASE seg WHEN 'AUTOMOBILE' THEN 'Backend' WHEN 'BUILDING' THEN 'Frontend' WHEN 'FURNITURE' THEN 'Mobile' WHEN 'HOUSEHOLD' THEN 'DevOps' ELSE 'DataScientist' END AS truth,
    [100 * (p1 + p5 + f), 100 * (p2 + o) + 7 * n, 18 * n + 7 * n, 100 * p3, 100 * (p4 + p)] AS scores FROM s),
pr AS (SELECT truth, ['Backend', 'Frontend', 'Mobile', 'DevOps', 'DataScientist'][list_position(scores, list_max(scores))] AS pred FROM t),
l AS (SELECT unnest(['Backend', 'Frontend', 'Mobile', 'DevOps', 'DataScientist']) AS label),
cells AS (SELECT a.label AS truth, b.label AS pred, (SELECT count(*) FROM pr WHERE pr.truth = a.label AND pr.pred = b.label) AS n FROM l a, l b)"""

ORACLES = {
    "agg37_confusion": f"WITH {ROLES} SELECT * FROM cells",
    "agg37_averages": f"""WITH {ROLES},
k AS (SELECT label, sum(n) FILTER (truth = label) AS support, sum(n) FILTER (pred = label) AS given, sum(n) FILTER (truth = label AND pred = label) AS tp FROM l, cells GROUP BY 1),
e AS (SELECT support, tp, coalesce(tp / nullif(given, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM k),
z AS (SELECT support, tp, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM e)
SELECT CAST(sum(support) AS BIGINT) AS sample_size, {ratio('sum(tp)', 'sum(support)')} AS accuracy, {', '.join(f"round(avg({x}), 4) AS macro_{x}, round(sum({x} * support) / sum(support), 4) AS weighted_{x}" for x in ('precision', 'recall', 'f1'))} FROM z""",
    "src09_tag_digests": f"WITH {COMMITS}, {TAGS}, {_tree("SELECT DISTINCT repo, 'v:' || tag_sec || ':' || sha AS x FROM tags")} SELECT repo, members, digest FROM m",
    "fn41_scope_digests": f"WITH {COMMITS}, n AS (SELECT repo, sha, row_number() OVER (PARTITION BY repo ORDER BY local_day, sha) AS k FROM commits), {_tree('SELECT repo, CAST(sha AS VARCHAR) AS x FROM n WHERE k = 1')} SELECT repo, members AS roots, sha256('scope:' || repo || ':' || digest) AS digest FROM m",
    "src30_register": """WITH d AS (
  SELECT CASE page_id % 20 WHEN 3 THEN 'missing' WHEN 4 THEN 'changed' ELSE 'extra' END AS kind, url || CASE WHEN page_id % 20 = 5 THEN '.bak' ELSE '' END AS path FROM pages WHERE page_id % 20 IN (3, 4, 5))
SELECT kind, count(*) AS n, min(path) AS first_path FROM d GROUP BY 1""",
    "val07_constraints": CLAIMS + " UNION ALL ".join(f"""SELECT '{name}' AS "constraint", '{table}' AS "table", count(*){_HALF.get(name, '')} AS violations FROM {rows} WHERE {broken}""" for name, (table, rows, broken) in _CHECKS.items()),
    "jn13_chain_faults": f"""WITH RECURSIVE {TRACKED},
x AS (
  SELECT e.project, e.kind, unnest(list_filter([
    CASE WHEN e.kind IN ('issue_opened', 'milestone_set') AND e.previous IS NOT NULL THEN 'first_has_previous' END,
    CASE WHEN e.kind NOT IN ('issue_opened', 'milestone_set') AND p.id IS NULL THEN 'broken_previous' END,
    CASE WHEN p.position >= e.position THEN 'previous_not_earlier' END,
    CASE WHEN p.record_type <> e.record_type OR p.r <> e.r THEN 'crosses_records' END,
    CASE WHEN p.id IS NOT NULL AND e.previous_state IS DISTINCT FROM p.state THEN 'previous_state_differs' END,
    CASE WHEN e.kind NOT IN ('issue_opened', 'milestone_set') AND e.duration IS NULL THEN 'duration_missing' END,
    CASE WHEN e.sec < p.sec THEN 'negative_duration' END,
    CASE WHEN e.sec >= p.sec AND e.duration <> e.sec - p.sec THEN 'duration_differs' END,
    CASE WHEN e.kind <> 'issue_linked' AND p.id IS NOT NULL AND after > 1 THEN 'branching' END,
    CASE WHEN cyclic THEN 'cyclic' END,
    CASE WHEN e.kind = 'issue_linked' AND t.id IS NULL THEN 'broken_link' END,
    CASE WHEN e.kind = 'issue_linked' AND t.position >= e.position THEN 'link_not_earlier' END,
    CASE WHEN e.kind = 'issue_linked' AND NOT (t.record_type = 'milestone' AND t.state = 'active') THEN 'link_target_unfit' END,
    CASE WHEN e.kind = 'issue_linked' AND e.state NOT IN ('open', 'triaged') THEN 'linked_when_closed' END], lambda z: z IS NOT NULL)) AS fault
  FROM ev e LEFT JOIN ev p ON p.id = e.previous LEFT JOIN ev t ON t.id = e.linked LEFT JOIN forks ON forks.previous = e.previous JOIN rooted ON rooted.id = e.id)
SELECT kind, fault, count(*) AS n, count(DISTINCT project) AS projects FROM x GROUP BY 1, 2""",
    "val04_chain_lengths": f"WITH RECURSIVE {TRACKED} SELECT depth, cyclic, count(*) AS events, count(DISTINCT root) AS chains FROM rooted GROUP BY 1, 2",
    "str_coverage_gate": f"""WITH e AS (SELECT 'org/r' || (user_id % 8) AS source, event_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, ts + to_hours(CAST(event_id % 40 AS BIGINT)) >= CAST(ts AS DATE) + INTERVAL 26 HOUR AS late FROM events),
d AS (SELECT source, day, count(DISTINCT event_id) FILTER (NOT late) AS n, count(DISTINCT hour) FILTER (NOT late) AS hours, count(*) FILTER (late) AS late FROM e GROUP BY 1, 2),
g AS (SELECT source, CAST(sum(n) AS BIGINT) AS events, count(*) FILTER (n > 0) AS days, count(*) FILTER (n > 0 AND hours < 24) AS partial_days, CAST(sum(late) AS BIGINT) AS late FROM d GROUP BY 1)
SELECT *, CASE WHEN partial_days = 0 AND days > 0 THEN {ratio('events', 'days')} END AS events_per_day, CASE WHEN partial_days > 0 OR days = 0 THEN 'partial_coverage' END AS reason FROM g""",
}

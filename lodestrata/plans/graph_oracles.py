"""DuckDB SQL of the measures in operators/lineage.py, operators/identity.py and operators/evidence.py, and of the strata."""

from __future__ import annotations

from ..functions import rules as R
from ..operators import compare
from ..sources import evidence
from .oracles import COMMITS, PATHS, ratio

GRAPH = f"""{COMMITS},{PATHS},
lined AS (SELECT *, lag(sha) OVER (PARTITION BY customer ORDER BY local_day, sha) AS own, lag(sha) OVER (PARTITION BY repo ORDER BY local_day, sha) AS before FROM commits),
g AS (SELECT repo, sha, actor, author_sec, local_day, is_merge, is_bot, coalesce(own, before) AS parent, CASE WHEN is_merge AND before <> coalesce(own, before) THEN before END AS second FROM lined),
folded AS (SELECT l_orderkey AS sha, 1 + l_partkey % 50 AS partkey, min(l_returnflag) AS flag, min(1 + l_suppkey % 50) AS other FROM lineitem GROUP BY 1, 2),
gc AS (
  SELECT sha, f.partkey AS pos, sha * 200 + f.partkey * 2 AS id, p.path, o.path AS old,
    CASE WHEN flag = 'N' AND other <> f.partkey AND other % 4 = 0 THEN 'R' WHEN flag = 'N' AND other <> f.partkey AND other % 4 = 1 THEN 'C' WHEN flag = 'A' THEN 'A' WHEN flag = 'N' THEN 'M' ELSE 'D' END AS status
  FROM folded f JOIN paths p USING (partkey) JOIN paths o ON o.partkey = other),
ch AS (SELECT gc.*, repo, actor, author_sec, local_day, is_merge, is_bot, second FROM gc JOIN g USING (sha)),
anc AS (SELECT sha, sha AS at, 0 AS dist FROM g UNION ALL SELECT anc.sha, g.parent, dist + 1 FROM anc JOIN g ON anc.at = g.sha WHERE g.parent IS NOT NULL),
writes AS (SELECT id, sha, path, pos FROM ch UNION ALL SELECT id + 1, sha, old, pos FROM ch WHERE status = 'R'),
reads AS (
  SELECT id, sha AS start, CASE status WHEN 'R' THEN old ELSE path END AS path, pos FROM ch WHERE status IN ('M', 'R', 'D')
  UNION ALL SELECT id, second, path, 1000000 FROM ch WHERE status = 'A' AND is_merge AND second IS NOT NULL),
found AS (
  SELECT r.id, arg_max(w.id, (-a.dist, w.pos)) AS write
  FROM reads r JOIN anc a ON a.sha = r.start JOIN writes w ON w.sha = a.at AND w.path = r.path WHERE a.dist > 0 OR w.pos < r.pos GROUP BY 1),
nodes AS (
  SELECT ch.id, CASE WHEN status <> 'D' THEN write END AS next, status = 'A' AND is_merge AS mark, status IN ('A', 'C') AS new FROM ch LEFT JOIN found USING (id)
  UNION ALL SELECT id + 1, NULL, false, false FROM ch WHERE status = 'R'),
way AS (
  SELECT id, id AS at, CASE WHEN mark THEN id END AS last FROM nodes
  UNION ALL SELECT way.id, n.next, CASE WHEN t.mark THEN t.id ELSE last END FROM way JOIN nodes n ON way.at = n.id JOIN nodes t ON t.id = n.next),
made AS (SELECT way.id, CASE WHEN new THEN way.at ELSE last END AS creation FROM way JOIN nodes n ON way.at = n.id WHERE n.next IS NULL),
t0 AS (
  SELECT ch.*, write AS touches, CASE WHEN status = 'D' THEN w.creation ELSE m.creation END AS creation
  FROM ch LEFT JOIN found USING (id) LEFT JOIN made m ON m.id = ch.id LEFT JOIN made w ON w.id = write),
t AS (
  SELECT t0.*, CASE WHEN NOT c.is_merge THEN c.actor END AS made_by, c.is_bot AND NOT c.is_merge AS made_by_bot, c.author_sec AS made_sec
  FROM t0 LEFT JOIN t0 c ON c.id = t0.creation AND c.id = c.creation)"""


#: Bot addresses that share one spelling belong to several customers, so declarations and entries go by address.
RESOLVED = f"""{COMMITS},
decl AS (SELECT DISTINCT customer, lower(trim(author_email)) AS email FROM commits WHERE trim(author_email) <> '' AND customer % 4 = 0),
claims AS (
  SELECT email, 'person-' || (customer // 8) AS canonical_id, CASE WHEN customer % 3 = 0 THEN 'verified' ELSE 'external' END AS state, CASE WHEN customer % 8 = 0 THEN 'person-' || (customer // 8) END AS login FROM decl
  UNION ALL SELECT email, 'someone-else', 'claimed', CASE WHEN customer % 8 = 0 THEN 'someone-else' END FROM decl WHERE customer % 44 = 0),
owner AS (SELECT email, list_sort(list_distinct(list(canonical_id))) AS candidates, max(state) AS state, max(login) AS login FROM claims GROUP BY 1),
adr AS (SELECT DISTINCT customer, lower(trim(author_email)) AS email FROM commits WHERE trim(author_email) <> ''),
mm AS (SELECT a.email AS alias, arg_max(b.email, (a.customer, b.email)) AS canonical FROM adr a JOIN adr b ON b.customer = a.customer - 1 WHERE a.customer % 6 = 1 GROUP BY 1),
who AS (
  SELECT h.*, nullif(lower(trim(author_email)), '') AS raw, coalesce(canonical, nullif(lower(trim(author_email)), '')) AS mapped FROM human h LEFT JOIN mm ON alias = lower(trim(author_email))),
hit AS (
  SELECT w.*, coalesce(r.candidates, m.candidates) AS candidates, CASE WHEN r.email IS NOT NULL THEN r.state ELSE m.state END AS st, CASE WHEN r.email IS NOT NULL THEN r.login ELSE m.login END AS lg
  FROM who w LEFT JOIN owner r ON r.email = w.raw LEFT JOIN owner m ON m.email = w.mapped),
res AS (
  SELECT *, CASE WHEN len(candidates) > 1 THEN 'conflicting_identity' WHEN candidates IS NOT NULL THEN 'explicit_identity' WHEN mapped IS NOT NULL THEN CASE WHEN mapped = raw THEN 'email' ELSE 'mailmap' END WHEN trim(author_name) <> '' THEN 'missing_email_name' ELSE 'unresolved' END AS basis,
    CASE WHEN len(candidates) > 1 THEN NULL WHEN candidates IS NOT NULL THEN 'identity:' || candidates[1] WHEN mapped IS NOT NULL THEN 'email:' || mapped ELSE 'name:' || lower(trim(author_name)) END AS partition_key,
    CASE WHEN len(candidates) = 1 THEN st WHEN candidates IS NULL AND regexp_matches(raw, '@household\\.test$') THEN 'inferred' ELSE 'unresolved' END AS state,
    CASE WHEN len(candidates) = 1 THEN lg END AS login
  FROM hit)"""


_REASONS = ", ".join(f"'{r}'" for r in evidence.REASONS)
REPLAY = f"""
p0 AS (
  SELECT page_id AS k, page_id % 7 = 6 AS whole, 's' || (page_id % 7) AS source, page_id // 7 + 1 AS number, url AS request, lead(url) OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS next, html,
    regexp_extract_all(html, 'href="/?([^"]*)"', 1) AS targets FROM pages),
p1 AS (
  SELECT *, CASE WHEN whole OR k % 60 <> 17 THEN next END AS next_request, CASE WHEN NOT whole AND k % 60 = 23 THEN 500 ELSE 200 END AS status, whole OR k % 50 <> 13 AS held,
    len(targets) AS n_items, len(list_filter(targets, lambda x: NOT coalesce(lower(x[1:1]) BETWEEN 'a' AND 'm', false))) AS n_unlinked FROM p0),
p2 AS (SELECT *, lag(next_request) OVER (PARTITION BY source ORDER BY number) AS led, max(number) OVER (PARTITION BY source) AS last FROM p1),
f AS (
  SELECT source, number, unnest(list_filter([
    CASE WHEN number > 1 AND led IS DISTINCT FROM request THEN 'request_chain_mismatch' END, CASE WHEN NOT held THEN 'body_missing' END,
    CASE WHEN held AND NOT whole AND k % 50 = 11 THEN 'body_digest_mismatch' END, CASE WHEN held AND NOT whole AND (k % 50 = 7 OR k % 50 = 11) THEN 'body_bytes_mismatch' END,
    CASE WHEN status <> 200 AND (n_items <> 0 OR next_request IS DISTINCT FROM request) THEN 'http_retry_semantics_mismatch' END,
    CASE WHEN status = 200 AND next_request IS DISTINCT FROM next THEN 'page_next_request_mismatch' END, CASE WHEN next_request IS NULL AND number < last THEN 'request_chain_terminated_early' END], lambda x: x IS NOT NULL)) AS reason FROM p2),
s AS (
  SELECT source, count(*) AS pages, CAST(sum(n_items) FILTER (status = 200) AS BIGINT) AS claimed, CAST(coalesce(sum(n_items) FILTER (status = 200 AND held), 0) AS BIGINT) AS items,
    sum(n_unlinked) FILTER (status = 200) AS unlinked, coalesce(sum(n_unlinked) FILTER (status = 200 AND held), 0) AS unlinked_seen, count(*) FILTER (status = 200) AS good, arg_max(coalesce(next_request, ''), number) AS cursor FROM p2 GROUP BY 1),
d AS (SELECT *, CASE WHEN cursor = '' THEN 'complete' WHEN good > 0 THEN 'partial' ELSE 'unavailable' END AS coverage FROM s),
af AS (
  SELECT source, number, reason FROM f UNION ALL SELECT source, NULL, 'unlinked_mismatch' FROM d WHERE unlinked <> unlinked_seen
  UNION ALL SELECT source, NULL, 'pagination_mismatch' FROM d WHERE claimed <> items OR coverage <> 'complete'),
fs AS (SELECT source, arg_min(reason, list_position([{_REASONS}], reason)) AS reason, count(*) AS faults FROM af GROUP BY 1)"""


def _exclusive(p: float) -> str:
    low = f"greatest(1, least(CAST(floor((n + 1) * {p}) AS BIGINT), n - 1))"
    return f"(v[{low}] + (v[least({low} + 1, n)] - v[{low}]) * ((n + 1) * {p} - {low}))"


def _shown(x: str) -> str:
    return f"CASE WHEN n >= 4 AND (n >= {compare.STRATUM_FLOOR} OR dimension = 'all') THEN round({x}, 4) END"


ORACLES = {
    "src26_replay_faults": f"WITH {REPLAY} SELECT source, reason, count(*) AS n, min(number) AS first_page FROM af GROUP BY 1, 2",
    "val13_replay": f"""WITH {REPLAY} SELECT source, CASE WHEN reason IS NULL THEN 'VERIFIED' WHEN reason = 'body_missing' THEN 'CANNOT_VERIFY' ELSE 'MISMATCH' END AS status, reason, coalesce(faults, 0) AS faults, coverage, pages, items, items AS oids FROM d LEFT JOIN fs USING (source)""",
    "fn40_identity_tiers": f"WITH {RESOLVED} SELECT repo, basis, count(*) AS commits, count(DISTINCT (author_name, author_email)) AS authors, count(DISTINCT partition_key) AS actors, count(*) FILTER (state IN ('verified', 'claimed', 'inferred')) AS tenant_commits, count(login) AS public_handles FROM res GROUP BY 1, 2",
    "jn03_conflicts": f"WITH {RESOLVED} SELECT array_to_string(candidates, ',') AS candidates, count(*) AS commits, count(DISTINCT mapped) AS addresses FROM res WHERE basis = 'conflicting_identity' GROUP BY 1",
    "fn40_partition": f"WITH {RESOLVED} SELECT repo, partition_key, count(*) AS commits, count(DISTINCT raw) AS addresses, min(basis) AS basis FROM res WHERE partition_key IS NOT NULL GROUP BY 1, 2",
    "agg34_strata": f"""WITH s AS (SELECT unnest([{{'dimension': 'all', 'stratum': 'all'}}, {{'dimension': 'segment', 'stratum': c_mktsegment}}, {{'dimension': 'nation', 'stratum': CAST(c_nationkey AS VARCHAR)}}], recursive := true), c_acctbal AS x FROM customer),
g AS (SELECT dimension, stratum, count(*) AS n, list_sort(list(x)) AS v, {', '.join(f'quantile_cont(x, {k} / 9.0::DOUBLE) AS r{k}' for k in range(10))}, quantile_cont(x, 0.5) AS m FROM s GROUP BY 1, 2)
SELECT dimension, stratum, n, {_shown(_exclusive(0.25))} AS q1, {_shown('m')} AS median, {_shown(_exclusive(0.75))} AS q3, {', '.join(f"{_shown(f'r{k}')} AS p{k}" for k in range(10))},
  CASE WHEN n < {compare.STRATUM_FLOOR} AND dimension <> 'all' THEN 'context_stratum_too_small' END AS reason FROM g""",
    "jn23_graph_lineage": f"""WITH RECURSIVE {GRAPH},
e AS (SELECT * FROM t WHERE NOT is_merge AND NOT is_bot AND status IN ('M', 'R') AND made_by IS NOT NULL),
x AS (SELECT repo, actor, count(*) AS edit_commits, count(*) FILTER (other) AS cross_author FROM (SELECT repo, actor, sha, bool_or(made_by <> actor) AS other FROM e WHERE NOT made_by_bot GROUP BY ALL) GROUP BY 1, 2),
deaths AS (SELECT creation, arg_min(author_sec, (local_day, sha, pos)) AS ended FROM t WHERE status = 'D' AND creation IS NOT NULL GROUP BY 1),
ends AS (SELECT repo, max(author_sec) AS end_sec FROM commits GROUP BY 1),
b AS (
  SELECT repo, actor, count(*) AS creations, count(*) FILTER (t.creation IN (SELECT creation FROM e WHERE actor <> made_by AND author_sec - made_sec >= {R.ADOPTION_DAYS} * 86400)) AS adopted
  FROM t JOIN ends USING (repo) LEFT JOIN deaths USING (creation)
  WHERE NOT is_merge AND NOT is_bot AND t.id = t.creation AND least(end_sec, coalesce(ended, end_sec)) - author_sec >= {R.ADOPTION_DAYS} * 86400 GROUP BY 1, 2),
flagged AS (SELECT id, touches, author_sec, coalesce(actor = made_by AND NOT is_merge AND (id = creation OR (status IN ('M', 'R') AND NOT is_bot)), false) AS flag FROM t),
back AS (
  SELECT id, touches AS at FROM flagged WHERE flag AND touches IS NOT NULL
  UNION ALL SELECT back.id, f.touches FROM back JOIN flagged f ON f.id = back.at WHERE NOT f.flag AND f.touches IS NOT NULL),
prior AS (SELECT back.id, f.author_sec AS sec_before FROM back JOIN flagged f ON f.id = back.at WHERE f.flag),
r AS (SELECT repo, actor, count(*) AS own_touches, count(*) FILTER (author_sec - sec_before >= {R.RETURN_DAYS} * 86400) AS returns FROM e LEFT JOIN prior USING (id) WHERE actor = made_by GROUP BY 1, 2),
o AS (
  SELECT repo, actor, coalesce(edit_commits, 0) AS edit_commits, coalesce(cross_author, 0) AS cross_author, coalesce(creations, 0) AS creations, coalesce(adopted, 0) AS adopted, coalesce(own_touches, 0) AS own_touches, coalesce(returns, 0) AS returns
  FROM (SELECT DISTINCT repo, actor FROM scoped) LEFT JOIN x USING (repo, actor) LEFT JOIN b USING (repo, actor) LEFT JOIN r USING (repo, actor))
SELECT *, {ratio('cross_author', 'edit_commits')} AS cross_author_share, {ratio('adopted', 'creations')} AS adopted_share, {ratio('returns', 'own_touches')} AS return_share FROM o""",
}

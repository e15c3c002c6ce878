"""The registered queries in DuckDB SQL, over the same views of the driver's tables."""

from __future__ import annotations

from ..functions import rules as R
from ..operators import compare, portfolio


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _match(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}', 'i')"


def normal(p: str) -> str:
    return rf"regexp_replace(replace({p}, '\', '/'), '^[./]+', '')"


def rooted(p: str) -> str:
    return rf"regexp_replace(replace({p}, '\', '/'), '^/+', '')"


def is_test(p: str) -> str:
    return _match(normal(p), R.TEST_PATH)


def role(p: str) -> str:
    return f"CASE WHEN {is_test(p)} THEN 'test' WHEN {_match(normal(p), R.DOC_OR_CONFIG_PATH)} THEN 'docs' ELSE 'prod' END"


def vendor(p: str) -> str:
    own = normal(p)
    return "(" + " OR ".join([*(f"starts_with({own}, '{x}')" for x in R.VENDOR_PREFIXES), *(f"ends_with({own}, '{x}')" for x in R.VENDOR_SUFFIXES)]) + ")"


def hits(p: str) -> str:
    own = rooted(p)
    parts = [f"CASE WHEN {_match(own, x)} THEN '{name}' END" for name, x in R.SURFACE_PATTERNS.items()]
    return f"list_filter([{', '.join(parts)}, CASE WHEN {vendor(own)} THEN 'generated_vendor' END], lambda x: x IS NOT NULL)"


def surface(p: str) -> str:
    return f"coalesce({hits(p)}[1], 'other')"


def test_type(p: str) -> str:
    cases = " ".join(f"WHEN {_match(p, x)} THEN '{name}'" for name, x in R.TEST_TYPE_PATTERNS.items())
    return f"CASE WHEN NOT {is_test(p)} THEN 'unspecified' {cases} ELSE 'unspecified' END"


def language(p: str) -> str:
    ext = rf"regexp_extract(lower({p}), '\.([a-z]+)$', 1)"
    return f"CASE WHEN {ext} IN ({_quoted(R.LANGUAGE_EXTENSIONS)}) THEN {ext} END"


def base(p: str) -> str:
    return f"lower(regexp_extract({p}, '([^/]*)$', 1))"


def suffix(b: str) -> str:
    return rf"regexp_extract({b}, '^.+(\.[^.]+)$', 1)"


def dirs(p: str) -> str:
    parts = f"string_split(trim(lower({p}), '/'), '/')"
    return f"{parts}[1:len({parts}) - 1]"


def dependency(p: str) -> str:
    return f"({base(p)} IN ({_quoted(R.DEPENDENCY_FILES)}) OR regexp_matches({base(p)}, '{R.DEPENDENCY_PATTERN}'))"


def _within(p: str, names) -> str:
    return f"list_has_any({dirs(p)}, [{_quoted(names)}])"


def any_test(p: str) -> str:
    b = base(p)
    stem = rf"regexp_replace({b}, '\.[^.]*$', '')"
    return f"({_within(p, R.TEST_DIRS)} OR starts_with({stem}, 'test_') OR ends_with({stem}, '_test') OR contains({b}, '.test.') OR contains({b}, '.spec.'))"


def domain(p: str) -> str:
    b = base(p)
    return (
        f"CASE WHEN {dependency(p)} THEN 'deps' WHEN {any_test(p)} THEN 'test' "
        f"WHEN {_within(p, ('docs',))} OR split_part({b}, '.', 1) IN ({_quoted(R.DOC_NAMES)}) OR {suffix(b)} IN ({_quoted(R.DOC_SUFFIXES)}) THEN 'docs' "
        f"WHEN {_within(p, R.INFRA_DIRS)} OR {b} IN ({_quoted(R.INFRA_FILES)}) OR {suffix(b)} = '.tf' THEN 'infra' "
        f"WHEN {_within(p, R.CORE_DIRS)} OR {suffix(b)} IN ({_quoted(R.CORE_SUFFIXES)}) THEN 'core' ELSE 'unclassified' END"
    )


def family(p: str) -> str:
    cases = " ".join(f"WHEN {suffix(base(p))} IN ({_quoted(s)}) THEN '{name}'" for name, s in R.LANGUAGE_FAMILIES.items())
    return f"CASE {cases} ELSE 'other' END"


def module(p: str) -> str:
    parts = f"string_split({normal(p)}, '/')"
    return f"CASE WHEN len({parts}) > 1 AND {parts}[1] <> '' THEN {parts}[1] END"


def corrective(s: str) -> str:
    return f"({_match(s, R.CORRECTIVE_SUBJECT)} OR contains({s}, '{R.REVERT_SENTENCE}'))"


def revert(s: str) -> str:
    return f"({corrective(s)} AND (starts_with(lower({s}), 'revert') OR contains({s}, '{R.REVERT_SENTENCE}')))"


def bot(e: str) -> str:
    return f"(lower(trim({e})) IN ({_quoted(R.LEGACY_BOT_EMAILS)}) OR regexp_matches(lower(trim({e})), '{R.BOT_EMAIL}'))"


def ratio(n: str, d: str, digits: int = 4) -> str:
    return f"round(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), {digits})"


def gated(value: str, population: str, floor: int = R.FLOOR) -> str:
    return f"CASE WHEN {population} >= {floor} THEN {value} END"


def slug(name: str) -> str:
    own = f"regexp_replace(regexp_replace(lower(trim({name})), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')"
    return f"CASE WHEN {own} <> '' THEN substr({own}, 1, 64) END"


def bucket(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} < {below} THEN '{name}'" for below, name in R.COUNT_BUCKETS) + f" ELSE '{R.LARGEST_BUCKET}' END"


COMMITS = f"""
all_commits AS (
  SELECT CAST(c_nationkey AS BIGINT) AS repo, o_orderkey AS sha, o_orderkey AS ord, lower(c_mktsegment) AS actor, o_custkey AS customer, c_name AS author_name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bot' || (o_custkey % 10) || '[bot]@ci.test' WHEN c_mktsegment = 'FURNITURE' AND o_custkey % 5 = 0 THEN '  '
         ELSE lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.test' END AS author_email,
    CAST(o_orderdate AS DATE) AS local_day, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 + o_orderkey * 7919 % 86400 AS author_sec,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: repair ' || o_orderkey WHEN '2-HIGH' THEN 'Revert "change ' || o_orderkey || '"'
      WHEN '3-MEDIUM' THEN 'feat(core): add #' || o_orderkey WHEN '4-NOT SPECIFIED' THEN 'closes #' || o_orderkey ELSE 'tidy up ' || o_orderkey END AS subject,
    o_orderstatus = 'P' AS is_merge
  FROM orders JOIN customer ON o_custkey = c_custkey),
commits AS (SELECT *, {bot('author_email')} AS is_bot FROM all_commits),
scoped AS (SELECT * FROM commits WHERE NOT is_bot AND NOT is_merge),
human AS (SELECT * FROM commits WHERE NOT is_bot),
heads AS (SELECT repo, max(local_day) AS head_day FROM commits GROUP BY repo)"""

_EXT = "['.py', '.go', '.md', '.sql', '.tsx', '.min.js'][1 + CAST(substr(p_brand, 7) AS INT) % 6]"
PATHS = f"""
paths AS (
  SELECT p_partkey AS partkey,
    CASE p_type WHEN 'ECONOMY' THEN 'tests/' WHEN 'SMALL' THEN 'docs/' WHEN 'MEDIUM' THEN 'src/' WHEN 'PROMO' THEN '.github/workflows/' WHEN 'STANDARD' THEN 'api/' ELSE 'vendor/' END
    || CASE WHEN p_size % 11 = 0 THEN 'integration/' WHEN p_size % 13 = 0 THEN 'e2e/' WHEN p_size % 17 = 0 THEN 'contract/' ELSE '' END
    || CASE WHEN p_size % 19 = 0 THEN 'package.json' WHEN p_size % 7 = 0 THEN 'test_' || replace(p_name, ' ', '_') || {_EXT} ELSE replace(p_name, ' ', '_') || {_EXT} END AS path
  FROM part)"""
CHANGES = (
    PATHS
    + """,
changes AS (
  SELECT l_orderkey AS sha, path, min(CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END) AS status, CAST(sum(l_quantity) AS BIGINT) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted
  FROM lineitem JOIN paths ON l_partkey = partkey GROUP BY 1, 2)"""
)
FLAGS = f"""
roles AS (SELECT sha, {role('path')} AS role, {vendor('path')} AS vendor FROM changes),
flags AS (SELECT sha, count(*) AS n_paths, count(*) FILTER (role = 'prod') AS prod_n, count(*) FILTER (role = 'test') AS test_n, count(*) FILTER (role = 'docs') AS docs_n, bool_and(vendor) AS vendor_only FROM roles GROUP BY sha)"""
TOUCHED = f"""
hit AS (SELECT *, {hits('path')} AS h FROM changes),
touched AS (SELECT s.repo, s.sha, s.actor, s.subject, h.path, added, deleted, coalesce(h.h[1], 'other') AS surface, len(h.h) AS hits FROM scoped s JOIN hit h USING (sha))"""
HISTORY = COMMITS + "," + CHANGES
EVENTS = """
ev AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'PushEvent' WHEN 'view' THEN 'IssuesEvent' WHEN 'purchase' THEN 'PullRequestEvent' WHEN 'signup' THEN 'ReleaseEvent' WHEN 'error' THEN 'IssueCommentEvent' END AS event_type,
    'org/r' || (user_id % 8) AS repository, CAST(ts AS DATE) AS day, epoch_us(ts) AS micros FROM events)"""
LIFECYCLE = (
    COMMITS
    + """,
ship AS (SELECT l_orderkey AS sha, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1),
base AS (
  SELECT c.*, o_orderstatus AS state, ['issue', 'pull_request', 'release'][1 + sha % 3] AS record_type,
    greatest(author_sec, datediff('day', DATE '1970-01-01', first) * 86400) AS at_first, greatest(author_sec, datediff('day', DATE '1970-01-01', last) * 86400) AS at_last
  FROM commits c LEFT JOIN ship USING (sha) JOIN orders ON o_orderkey = sha),
lifecycle AS (
  SELECT repo AS project, sha AS record_id, record_type, author_sec AS created,
    CASE WHEN record_type = 'issue' THEN at_first END AS in_progress, CASE WHEN record_type = 'pull_request' THEN at_first END AS first_review,
    CASE WHEN record_type = 'pull_request' AND state = 'F' THEN at_last END AS merged, CASE WHEN record_type = 'issue' AND state = 'F' THEN at_last END AS closed,
    CASE WHEN record_type = 'release' THEN author_sec + 86400 END AS released, CASE WHEN record_type = 'issue' AND sha % 2 = 0 THEN sha + 1 END AS linked, state
  FROM base),
tracker AS (
  SELECT project, record_id, 'issue_opened' AS kind, 'open' AS state, created AS sec, 0 AS pos FROM lifecycle WHERE record_type = 'issue'
  UNION ALL SELECT project, record_id, 'issue_triaged', 'triaged', in_progress, 1 FROM lifecycle WHERE record_type = 'issue' AND in_progress IS NOT NULL
  UNION ALL SELECT project, record_id, 'issue_closed', 'closed', closed, 2 FROM lifecycle WHERE record_type = 'issue' AND closed IS NOT NULL
  UNION ALL SELECT project, record_id, 'issue_linked', 'open', created, 3 FROM lifecycle WHERE record_type = 'issue' AND linked IS NOT NULL)"""
)
TAGS = "tags AS (SELECT repo, sha, author_sec AS tag_sec, actor FROM commits WHERE sha % 97 = 0)"

_SHORT = f"local_day >= head_day - INTERVAL {R.SHORT_WINDOW_DAYS} DAY"
COCHANGE = f"""
cochange AS (
  SELECT repo, count(*) FILTER (prod_n > 0) AS population, count(*) FILTER (prod_n > 0 AND test_n > 0) AS cochanged,
    count(*) FILTER (coalesce(prod_n, 0) = 0 AND test_n > 0) AS test_only, count(*) FILTER (coalesce(prod_n, 0) = 0 AND coalesce(test_n, 0) = 0 AND docs_n > 0) AS docs_only,
    count(*) FILTER (prod_n > 0 AND {_SHORT}) AS population_13w, count(*) FILTER (prod_n > 0 AND test_n > 0 AND {_SHORT}) AS cochanged_13w
  FROM scoped LEFT JOIN flags USING (sha) JOIN heads USING (repo) GROUP BY repo),
cochange_rates AS (
  SELECT *, {ratio('cochanged', 'population')} AS rate, {ratio('cochanged_13w', 'population_13w')} AS rate_13w, population >= {R.FLOOR} AS narrate_rate, CASE WHEN population = 0 THEN 'no_production_commits' END AS reason FROM cochange)"""
ACTIVITY = f"""
day_counts AS (SELECT repo, local_day, count(*) AS n FROM scoped GROUP BY 1, 2),
activity AS (
  SELECT repo, CAST(sum(n) AS BIGINT) AS commits, count(*) AS active_days, {ratio('sum(n)', 'count(*)')} AS per_day, CAST(median(n) AS DOUBLE) AS per_day_median, count(*) FILTER ({_SHORT}) AS active_days_13w
  FROM day_counts JOIN heads USING (repo) GROUP BY repo)"""
REWORK = f"""
prod AS (SELECT repo, sha, path, local_day, ord, subject, lag(local_day) OVER (PARTITION BY repo, path ORDER BY local_day, ord) AS before FROM scoped JOIN changes USING (sha) WHERE {role('path')} = 'prod'),
recent AS (SELECT repo, sha, any_value(subject) AS subject, bool_or(coalesce(datediff('day', before, local_day) <= {R.REWORK_DAYS}, false)) AS recent FROM prod GROUP BY 1, 2),
again AS (SELECT repo, count(*) AS population, count(*) FILTER (recent) AS retouch, count(*) FILTER (recent AND {corrective('subject')}) AS corrective FROM recent GROUP BY 1),
whole AS (SELECT repo, count(*) AS scope_commits, count(*) FILTER ({revert('subject')}) AS reverts FROM scoped GROUP BY 1),
rework AS (
  SELECT repo, population, retouch, corrective, reverts, scope_commits, {ratio('corrective', 'population')} AS corrective_rate, {ratio('retouch', 'population')} AS retouch_rate, {ratio('reverts', 'scope_commits')} AS revert_rate, population >= {R.FLOOR} AS narrate_rate
  FROM whole LEFT JOIN again USING (repo))"""


def rhythm(keys: str, name: str = "rhythm") -> str:
    return f"""
{name}_rows AS (SELECT s.*, local_day BETWEEN head_day - INTERVAL {R.RHYTHM_DAYS} DAY AND head_day AS inside FROM scoped s JOIN heads USING (repo)),
{name}_counts AS (SELECT {keys}, count(*) FILTER (inside) AS sample, count(*) FILTER (NOT inside) AS outside, count(DISTINCT local_day) FILTER (inside) AS active_days FROM {name}_rows GROUP BY ALL),
{name}_gaps AS (SELECT {keys}, (author_sec - lag(author_sec) OVER (PARTITION BY {keys} ORDER BY author_sec, sha)) / 86400.0::DOUBLE AS gap FROM {name}_rows WHERE inside),
{name}_stats AS (SELECT {keys}, count(*) AS gaps, quantile_cont(gap, 0.5) AS median, quantile_cont(gap, 0.9) AS p90, avg(CAST(gap <= 2 AS INT)) AS burst, avg(CAST(gap >= 30 AS INT)) AS long FROM {name}_gaps WHERE gap IS NOT NULL GROUP BY ALL),
{name} AS (
  SELECT {keys}, sample, outside, active_days, coalesce(gaps, 0) AS gaps, {gated('round(median, 4)', 'sample')} AS median_gap_days, {gated('round(p90, 4)', 'sample')} AS p90_gap_days, {gated('round(burst, 4)', 'sample')} AS burst_share_le_2d, {gated('round(long, 4)', 'sample')} AS long_gap_share_ge_30d,
    CASE WHEN sample = 0 THEN 'no_commits_in_window' WHEN sample < {R.FLOOR} THEN 'insufficient_population' END AS reason
  FROM {name}_counts LEFT JOIN {name}_stats USING ({keys}))"""


SURFACE = f"""
by_surface AS (SELECT repo, surface, count(DISTINCT sha) AS commits, count(*) AS file_changes, count(DISTINCT path) AS unique_files, CAST(sum(added + deleted) AS BIGINT) AS lines FROM touched GROUP BY 1, 2),
totals AS (SELECT repo, count(DISTINCT sha) AS population FROM touched GROUP BY 1),
grid AS (SELECT repo, population, unnest([{_quoted(R.SURFACES)}]) AS surface FROM totals),
filled AS (SELECT repo, surface, population, coalesce(commits, 0) AS commits, coalesce(file_changes, 0) AS file_changes, coalesce(unique_files, 0) AS unique_files, coalesce(lines, 0) AS lines FROM grid LEFT JOIN by_surface USING (repo, surface)),
surface_profile AS (
  SELECT *, {gated(ratio('commits', 'population'), 'population')} AS share, {gated(ratio('unique_files', 'sum(unique_files) OVER (PARTITION BY repo)'), 'sum(unique_files) OVER (PARTITION BY repo)')} AS file_share FROM filled)"""
REPO_METRICS = (
    HISTORY
    + ","
    + FLAGS
    + ","
    + COCHANGE
    + ","
    + ACTIVITY
    + ","
    + REWORK
    + ","
    + rhythm("repo")
    + """,
repo_metrics AS (
  SELECT repo, 'active_days' AS metric, CAST(active_days AS DOUBLE) AS value FROM activity
  UNION ALL SELECT repo, 'rate', CASE WHEN narrate_rate THEN rate END FROM cochange_rates
  UNION ALL SELECT repo, 'corrective_rate', corrective_rate FROM rework
  UNION ALL SELECT repo, 'reverts', CAST(reverts AS DOUBLE) FROM rework
  UNION ALL SELECT repo, 'median_gap_days', median_gap_days FROM rhythm)"""
)


def compared(value: str, target: str, bound: str) -> str:
    return f"CASE WHEN {target} IS NULL THEN 'not_declared' WHEN {value} IS NULL THEN 'not_observed' WHEN {bound} = 'min' AND {value} = 0 THEN 'observed_zero' WHEN ({bound} = 'min' AND {value} >= {target}) OR ({bound} = 'max' AND ({value} <= {target} OR {value} = 0)) THEN 'overlap' ELSE 'outside_declared_range' END"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def event_rhythm(exact: bool) -> str:
    middle = "median(n)" if exact else "list_sort(list(n))[1 + len(list(n)) // 2]"
    iqr = "round(q[2] - q[1], 4)" if exact else "round(round(q[2], 4) - round(q[1], 4), 4)"
    upper = "quantile_cont(gap, 0.5)" if exact else "list_sort(list(gap))[1 + len(list(gap)) // 2]"
    return f"""
WITH {EVENTS},
span AS (SELECT datediff('day', min(day), max(day)) + 1 AS window_days FROM ev),
days AS (SELECT repository, day, count(*) AS n FROM ev GROUP BY 1, 2),
per AS (SELECT repository, count(*) AS active_days, CAST(sum(n) AS BIGINT) AS events, CAST({middle} AS DOUBLE) AS median_day, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS same_day FROM days GROUP BY 1),
bursts AS (SELECT repository, count(*) FILTER (n >= greatest(2.0, 2 * median_day)) AS burst_days FROM days JOIN per USING (repository) GROUP BY 1),
g AS (SELECT repository, (micros - lag(micros) OVER (PARTITION BY repository ORDER BY micros, event_id)) / 3600000000.0::DOUBLE AS gap FROM ev),
gs AS (SELECT repository, count(*) AS gaps, quantile_cont(gap, 0.5) AS gap_median, quantile_cont(gap, [0.25, 0.75]) AS q FROM g WHERE gap IS NOT NULL GROUP BY 1),
rg AS (SELECT repository, (micros - lag(micros) OVER (PARTITION BY repository ORDER BY micros, event_id)) / 86400000000.0::DOUBLE AS gap FROM ev WHERE event_type = 'ReleaseEvent'),
rs AS (SELECT repository, {upper} AS release FROM rg WHERE gap IS NOT NULL GROUP BY 1)
SELECT repository, events, window_days, {ratio('active_days', 'window_days')} AS active_day_share, round(gap_median, 4) AS gap_median_hours, CASE WHEN gaps >= 4 THEN {iqr} END AS gap_iqr_hours,
  {ratio('same_day', 'events')} AS same_day_share, {ratio('burst_days', 'active_days')} AS burst_day_share, round(release, 4) AS release_interval_days,
  CASE WHEN events < {R.SHAPE_EVENTS} OR active_days < {R.SHAPE_DAYS} THEN 'not_proven:insufficient_population' WHEN window_days < {R.SHAPE_WINDOW} THEN 'not_proven:window_too_short_for_shape' WHEN burst_days > 0 AND burst_days / active_days >= 0.5 THEN 'burst' ELSE 'constant' END AS shape
FROM per JOIN bursts USING (repository) LEFT JOIN gs USING (repository) LEFT JOIN rs USING (repository), span"""


_CLASSES = "[('inherited_upstream', NULL), ('upstream_sync', 'no_upstream_lineage'), ('tenant_unique', NULL), ('tenant_merge_or_sync', NULL), ('tenant_derivative', 'parent_repo_not_provided'), ('external_upstream_contribution', 'parent_repo_not_provided'), ('template_inherited', 'template_not_provided'), ('generated_or_vendor', NULL), ('ambiguous_origin', NULL), ('unresolved', NULL), ('bot', NULL)]"
_A, _B = compare.SEGMENTS
_MARK = " ".join(f"UNION ALL SELECT repo, 'marker:{m.rstrip('/')}' FROM p WHERE contains(lower(path), '{m}')" for m in R.MONOREPO_MARKERS)

ORACLES = {
    "fn_paths": f"""WITH {PATHS}, p AS (SELECT DISTINCT path FROM paths)
SELECT path, {normal('path')} AS normal, {role('path')} AS role, {surface('path')} AS surface, len({hits('path')}) > 1 AS ambiguous, len({hits('path')}) = 0 AS unclassified, {vendor('path')} AS vendor, {test_type('path')} AS test_type,
  {language('path')} AS language, {family('path')} AS family, {domain('path')} AS domain, {any_test('path')} AS any_test, {dependency('path')} AS dependency, {module('path')} AS module FROM p""",
    "fn_commits": rf"""WITH {COMMITS}
SELECT sha, {corrective('subject')} AS corrective, CASE WHEN {revert('subject')} THEN 'revert' WHEN {corrective('subject')} THEN 'fix' ELSE 'other' END AS subject_class, regexp_matches(subject, '{R.CONVENTIONAL_SUBJECT}') AS conventional, {_match('subject', R.ISSUE_LINK)} AS issue_link,
  is_bot AS bot, trim(author_email) = '' AS undecidable, sha256(CAST('email\x00' AS BLOB) || encode(lower(trim(author_email)))) AS email_sha256, {slug('author_name')} AS slug FROM commits""",
    "agg01_origin": f"""WITH {HISTORY}, {FLAGS},
k AS (SELECT repo, CASE WHEN is_bot THEN 'bot' WHEN coalesce(vendor_only, false) THEN 'generated_or_vendor' WHEN regexp_matches(lower(trim(author_email)), '@household\\.test$') THEN CASE WHEN is_merge THEN 'tenant_merge_or_sync' ELSE 'tenant_unique' END WHEN trim(author_email) = '' THEN 'ambiguous_origin' ELSE 'unresolved' END AS class FROM commits LEFT JOIN flags USING (sha)),
n AS (SELECT repo, class, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT * FROM (VALUES {_CLASSES[1:-1]}) AS t(class, reason))
SELECT repo, class, CASE WHEN reason IS NULL THEN coalesce(n, 0) END AS n, reason FROM (SELECT repo, class, reason FROM heads, c) LEFT JOIN n USING (repo, class)""".replace("\\\\", "\\"),
    "agg02_activity": f"WITH {COMMITS}, {ACTIVITY} SELECT * FROM activity",
    "agg03_core_period": f"""WITH {COMMITS},
m AS (SELECT repo, year(local_day) * 12 + month(local_day) - 1 AS m, count(*) AS n FROM scoped GROUP BY 1, 2),
e AS (SELECT repo, min(m) AS a, max(m) AS b, sum(n) AS total FROM m GROUP BY 1),
s AS (SELECT repo, total, unnest(range(a, b + 1)) AS m FROM e),
u AS (SELECT repo, m, total, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY repo ORDER BY m) AS upto FROM s LEFT JOIN m USING (repo, m)),
r AS (SELECT x.repo, x.m AS first, y.m AS last, (y.upto - x.upto + x.n) / x.total AS share FROM u x JOIN u y ON x.repo = y.repo AND y.m >= x.m WHERE (y.upto - x.upto + x.n) / x.total >= {R.CORE_SHARE}),
b AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY last - first, first) AS rn FROM r)
SELECT repo, printf('%04d-%02d', first // 12, first % 12 + 1) AS start, printf('%04d-%02d', last // 12, last % 12 + 1) AS end, round(share, 4) AS share FROM b WHERE rn = 1""",
    "agg04_test_cochange": f"WITH {HISTORY}, {FLAGS}, {COCHANGE} SELECT * FROM cochange_rates",
    "agg05_rework": f"WITH {HISTORY}, {REWORK} SELECT * FROM rework",
    "agg06_survival": f"""WITH {HISTORY},
l AS (SELECT repo, path, author_sec FROM changes JOIN scoped USING (sha) WHERE regexp_matches(path, '\\.(py|ts|tsx|js|jsx|go|rs|vue|svelte|astro|swift)$') AND NOT regexp_matches(path, 'node_modules/|vendor/|dist/|build/|\\.min\\.|generated')),
f AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn, count(*) OVER (PARTITION BY repo) AS source_files FROM (SELECT DISTINCT repo, path FROM l)),
s AS (SELECT *, greatest(1, source_files // 40) AS step FROM f), k AS (SELECT * FROM s WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 40),
h AS (SELECT repo, max(author_sec) AS head_sec FROM commits GROUP BY 1)
SELECT repo, count(DISTINCT path) AS files_sampled, max(source_files) AS source_files, count(*) AS lines_sampled, round(avg(exp(-greatest(0, head_sec - author_sec) / CAST(180 * 86400 AS DOUBLE))), 4) AS survival_index FROM l JOIN k USING (repo, path) JOIN h USING (repo) GROUP BY 1""".replace("\\\\", "\\"),
    "agg07_rhythm": f"WITH {COMMITS}, {rhythm('repo')} SELECT * FROM rhythm",
    "agg08_surface_profile": f"WITH {HISTORY}, {TOUCHED}, {SURFACE} SELECT * FROM surface_profile",
    "agg08_surface_totals": f"""WITH {HISTORY}, {TOUCHED},
w AS (SELECT repo, count(DISTINCT sha) AS population, count(*) FILTER (hits = 0) AS unclassified, count(*) FILTER (hits > 1) AS ambiguous FROM touched GROUP BY 1),
m AS (SELECT repo, {module('path')} AS module, count(*) AS n FROM touched GROUP BY 1, 2), t AS (SELECT repo, count(*) AS modules, max(n) AS top, sum(n) AS al FROM m WHERE module IS NOT NULL GROUP BY 1)
SELECT repo, population, unclassified, ambiguous, coalesce(modules, 0) AS module_breadth, {gated(ratio('top', 'al'), 'population')} AS top_module_share FROM w LEFT JOIN t USING (repo)""",
    "agg09_surface_pairs": f"""WITH {HISTORY}, {TOUCHED}, d AS (SELECT DISTINCT repo, sha, surface FROM touched)
SELECT a.repo, a.surface || '+' || b.surface AS pair, count(*) AS commits FROM d a JOIN d b ON a.sha = b.sha AND a.surface < b.surface GROUP BY 1, 2""",
    "agg10_verification": f"""WITH {HISTORY}, t AS (SELECT sha, {role('path')} AS role, {test_type('path')} AS type, {surface('path')} AS surface FROM changes),
v AS (SELECT sha, bool_or(role = 'test') AS tests, bool_or(role = 'prod') AS prod, {', '.join(f"bool_or(role = 'test' AND type = '{x}') AS {x}" for x in R.VERIFICATION_TYPES)}, {', '.join(f"bool_or(surface = '{x}') AS on_{x}" for x in ('frontend', 'backend', 'data', 'platform'))} FROM t GROUP BY 1),
o AS (SELECT repo, count(*) AS sample, count(*) FILTER (tests) AS test_touch, count(*) FILTER (tests AND NOT prod) AS test_only, {', '.join(f'count(*) FILTER ({x}) AS {x}' for x in R.VERIFICATION_TYPES)}, {', '.join(f'count(*) FILTER (tests AND on_{x}) AS with_{x}' for x in ('frontend', 'backend', 'data', 'platform'))},
  count(*) FILTER ({corrective('subject')} OR starts_with(lower(subject), 'revert')) AS fixes, count(*) FILTER (({corrective('subject')} OR starts_with(lower(subject), 'revert')) AND tests) AS fixes_with_test FROM scoped LEFT JOIN v USING (sha) GROUP BY 1)
SELECT *, {gated(ratio('test_touch', 'sample'), 'sample')} AS touch_share, {gated(ratio('unit', 'test_touch'), 'test_touch')} AS unit_share, {gated(ratio('fixes_with_test', 'fixes'), 'fixes')} AS pairing, CASE WHEN fixes = 0 THEN 'no_fix_or_revert_commits' WHEN fixes < {R.FLOOR} THEN 'insufficient_population' END AS pairing_reason FROM o""",
    "agg11_coordination": f"""WITH {COMMITS}, o AS (SELECT repo, count(*) AS commits, count(*) FILTER (is_merge) AS merges, count(*) FILTER (NOT is_merge) AS humans, count(*) FILTER (NOT is_merge AND {_match('subject', R.ISSUE_LINK)}) AS linked FROM human GROUP BY 1)
SELECT *, {gated(ratio('merges', 'commits'), 'commits')} AS merge_share, {gated(ratio('linked', 'humans'), 'humans')} AS linked_share FROM o""",
    "agg13_context": f"""WITH {HISTORY}, {FLAGS},
p AS (SELECT repo, count(*) AS actors, max(n) AS top FROM (SELECT repo, lower(trim(author_email)) AS who, count(*) AS n FROM human GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT repo, count(*) AS human_commits, count(*) FILTER (is_merge) AS merges, min(local_day) AS a, max(local_day) AS b, any_value(head_day) AS h, count(DISTINCT local_day) FILTER (local_day >= head_day - INTERVAL {R.RHYTHM_DAYS} DAY) AS active_days_180d,
  count(*) FILTER (NOT is_merge) AS plain, count(*) FILTER (NOT is_merge AND regexp_matches(subject, '{R.CONVENTIONAL_SUBJECT}')) AS conv, count(*) FILTER (NOT is_merge AND {_match('subject', R.ISSUE_LINK)}) AS linked,
  count(*) FILTER (NOT is_merge AND n_paths > 0) AS wp, count(*) FILTER (NOT is_merge AND test_n > 0) AS wt, count(*) FILTER (NOT is_merge AND docs_n > 0) AS wd FROM human JOIN heads USING (repo) LEFT JOIN flags USING (sha) GROUP BY 1),
t AS (SELECT *, {ratio('top', 'human_commits')} AS top_actor_share FROM o JOIN p USING (repo))
SELECT repo, human_commits, actors AS resolved_human_actors, top_actor_share, CASE WHEN top_actor_share >= {R.SOLO_SHARE} THEN 'solo' WHEN actors <= {R.SMALL_TEAM} THEN 'small_team' ELSE 'community' END AS collaboration_class, {ratio('merges', 'human_commits')} AS pr_flow_share,
  CAST(a AS VARCHAR) AS first_commit, CAST(b AS VARCHAR) AS last_commit, datediff('day', a, b) AS active_span_days, datediff('day', a, h) AS repo_age_days, datediff('day', b, h) AS days_since_last, active_days_180d,
  CASE WHEN active_days_180d >= {R.ACTIVE_DAYS_ACTIVE} THEN 'active' WHEN active_days_180d >= {R.ACTIVE_DAYS_MAINTAINED} THEN 'maintained' ELSE 'dormant' END AS lifecycle_stage, {ratio('conv', 'plain')} AS conventional_share, {ratio('linked', 'plain')} AS issue_link_density, {ratio('wt', 'wp')} AS test_file_ratio, {ratio('wd', 'wp')} AS docs_share FROM t""",
    "agg14_turnover": f"""WITH {COMMITS}, s AS (SELECT repo, lower(trim(author_email)) AS who, min(year(local_day)) AS a, max(year(local_day)) AS b FROM human GROUP BY 1, 2),
j AS (SELECT repo, a AS year, count(*) AS joined FROM s GROUP BY 1, 2), l AS (SELECT repo, b AS year, count(*) AS last_active FROM s GROUP BY 1, 2)
SELECT repo, year, coalesce(joined, 0) AS joined, coalesce(last_active, 0) AS last_active FROM j FULL JOIN l USING (repo, year)""",
    "agg15_languages": f"""WITH {HISTORY}, l AS (SELECT repo, {language('path')} AS language, count(*) AS n FROM human JOIN changes USING (sha) GROUP BY 1, 2), s AS (SELECT repo, language, n, n / sum(n) OVER (PARTITION BY repo) AS s FROM l WHERE language IS NOT NULL)
SELECT repo, language, n, round(s, 4) AS share FROM s WHERE s >= 0.01""",
    "agg17_cadence": f"""WITH {COMMITS}, {TAGS}, t AS (SELECT repo, count(*) AS n FROM tags GROUP BY 1), s AS (SELECT repo, datediff('day', min(local_day), max(local_day)) AS span_days FROM human GROUP BY 1)
SELECT repo, coalesce(n, 0) AS tags, span_days, CASE WHEN span_days > 0 THEN round(coalesce(n, 0) / (span_days / 365.25::DOUBLE), 2) END AS per_year FROM s LEFT JOIN t USING (repo)""",
    "agg18_manifests": f"""WITH {HISTORY}, p AS (SELECT repo, path FROM human JOIN changes USING (sha)),
f AS (SELECT repo, 'manifest:' || {base('path')} AS found FROM p WHERE {base('path')} IN ({_quoted(R.MANIFESTS)}) {_MARK})
SELECT repo, found, count(*) AS changes FROM f GROUP BY 1, 2""",
    "agg19_archive": f"""WITH {EVENTS} SELECT 'repository' AS level, repository AS key, count(*) AS events FROM ev GROUP BY 2 UNION ALL SELECT 'day', CAST(day AS VARCHAR), count(*) FROM ev GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM ev GROUP BY 2""",
    "agg20_coverage": f"""WITH {EVENTS}, w AS (SELECT (datediff('day', min(day), max(day)) + 1) * 24 AS expected FROM ev), s AS (SELECT repository, count(DISTINCT micros // 3600000000) AS observed FROM ev GROUP BY 1)
SELECT repository, observed, expected, expected - observed AS missing, {ratio('observed', 'expected', 12)} AS rate, CASE WHEN observed = expected THEN 'complete' ELSE 'partial' END AS status FROM s, w""",
    "agg21_event_rhythm": event_rhythm(False),
    "agg22_bound_rhythm": event_rhythm(True),
    "agg23_tracker": f"""WITH {LIFECYCLE}, o AS (SELECT project, record_id, sec AS start FROM tracker WHERE kind = 'issue_opened'),
h AS (SELECT *, (sec - start) / 3600.0::DOUBLE AS hours FROM tracker LEFT JOIN o USING (project, record_id))
SELECT project, count(*) AS events, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('issue_opened', 'issue_triaged', 'issue_closed', 'issue_linked'))}, CAST(round(CAST(quantile_cont(hours, 0.5) FILTER (kind = 'issue_triaged') AS DECIMAL(20, 6)), 4) AS DOUBLE) AS triage_median_hours, CAST(round(CAST(quantile_cont(hours, 0.5) FILTER (kind = 'issue_closed') AS DECIMAL(20, 6)), 4) AS DOUBLE) AS close_median_hours,
  {ratio("count(*) FILTER (kind = 'issue_linked')", "count(*) FILTER (kind = 'issue_opened')")} AS linked_issue_share FROM h GROUP BY 1""",
    "agg24_lifecycle": f"""WITH {LIFECYCLE},
d AS (SELECT project, count(DISTINCT sec // 86400) AS active_days FROM (SELECT project, unnest([created, in_progress, first_review, merged, closed, released]) AS sec FROM lifecycle) WHERE sec IS NOT NULL GROUP BY 1),
g AS (SELECT project, (released - lag(released) OVER (PARTITION BY project ORDER BY released, record_id)) / 86400.0::DOUBLE AS gap FROM lifecycle WHERE record_type = 'release' AND released IS NOT NULL),
i AS (SELECT project, CAST(round(CAST(quantile_cont(gap, 0.5) AS DECIMAL(20, 6)), 4) AS DOUBLE) AS release_interval_days FROM g WHERE gap IS NOT NULL GROUP BY 1),
o AS (SELECT project, CAST(round(CAST(quantile_cont((in_progress - created) / 3600.0::DOUBLE, 0.5) FILTER (record_type = 'issue' AND in_progress IS NOT NULL) AS DECIMAL(20, 6)), 4) AS DOUBLE) AS issue_to_progress_hours, CAST(round(CAST(quantile_cont((closed - created) / 3600.0::DOUBLE, 0.5) FILTER (record_type = 'issue' AND closed IS NOT NULL) AS DECIMAL(20, 6)), 4) AS DOUBLE) AS issue_to_closed_hours,
  CAST(round(CAST(quantile_cont((first_review - created) / 3600.0::DOUBLE, 0.5) FILTER (record_type = 'pull_request' AND first_review IS NOT NULL) AS DECIMAL(20, 6)), 4) AS DOUBLE) AS pr_to_review_hours, CAST(round(CAST(quantile_cont((merged - created) / 3600.0::DOUBLE, 0.5) FILTER (record_type = 'pull_request' AND merged IS NOT NULL) AS DECIMAL(20, 6)), 4) AS DOUBLE) AS pr_to_merged_hours,
  count(*) FILTER (record_type = 'release') AS releases, count(*) FILTER (record_type = 'issue') AS issues, count(*) FILTER (record_type = 'issue' AND linked IS NOT NULL) AS li FROM lifecycle GROUP BY 1)
SELECT project, issue_to_progress_hours, issue_to_closed_hours, pr_to_review_hours, pr_to_merged_hours, releases, issues, active_days, release_interval_days, {ratio('li', 'issues')} AS linked_issue_share FROM o JOIN d USING (project) LEFT JOIN i USING (project)""",
    "agg25_experience": f"""WITH {HISTORY}, dp AS (SELECT sha, bool_or({dependency('path')}) AS dep, count(*) FILTER (status = 'A') AS added FROM changes GROUP BY 1),
st AS (SELECT repo, min(author_sec) AS repo_start FROM scoped GROUP BY 1),
r AS (SELECT s.*, dep, added, repo_start, (author_sec - lag(author_sec) OVER (PARTITION BY repo, actor ORDER BY author_sec, sha)) / 86400.0::DOUBLE AS gap FROM scoped s LEFT JOIN dp USING (sha) JOIN st USING (repo)),
o AS (SELECT repo, actor, count(*) AS commits, quantile_cont(gap, 0.5) AS median, max(gap) AS longest, count(*) FILTER (dep) AS deps, min(author_sec) AS fs, any_value(repo_start) AS rs, sum(CASE WHEN author_sec < repo_start + {R.ADOPTION_DAYS * 86400} THEN coalesce(added, 0) ELSE 0 END) AS sc FROM r GROUP BY 1, 2)
SELECT repo, actor, commits, {gated('round(median, 4)', 'commits')} AS median_gap_days, {gated('round(longest, 4)', 'commits')} AS longest_gap_days, {gated(ratio('deps', 'commits'), 'commits')} AS dependency_update_share, {gated('round((fs - rs) / 86400.0::DOUBLE, 4)', 'commits')} AS days_after_start,
  {gated(ratio('sc', 'sum(sc) OVER (PARTITION BY repo)'), 'sum(sc) OVER (PARTITION BY repo)')} AS scaffold_share FROM o""",
    "agg25_self_returns": f"""WITH {HISTORY}, b AS (SELECT repo, actor, author_sec, lag(author_sec) OVER (PARTITION BY repo, actor, path ORDER BY author_sec, sha) AS before FROM scoped JOIN changes USING (sha))
SELECT repo, actor, count(*) AS touches, count(*) FILTER (author_sec - before >= {R.RETURN_DAYS * 86400}) AS returns FROM b WHERE before IS NOT NULL GROUP BY 1, 2""",
    "agg26_timeline": f"""WITH {HISTORY}, r AS (SELECT repo, actor, year(local_day) AS year, path FROM scoped JOIN changes USING (sha)),
n AS (SELECT repo, actor, year, 'domain' AS dimension, {domain('path')} AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT repo, actor, year, 'language', {family('path')}, count(*) FROM r GROUP BY ALL)
SELECT *, {ratio('n', 'sum(n) OVER (PARTITION BY repo, actor, year, dimension)')} AS share FROM n""",
    "agg27_size_points": f"""WITH {COMMITS}, r AS (SELECT repo, actor, sha, author_sec, row_number() OVER (PARTITION BY repo, actor ORDER BY author_sec, sha) AS rn, count(*) OVER (PARTITION BY repo, actor) AS n, count(*) OVER (PARTITION BY repo ORDER BY author_sec) AS c FROM scoped),
p AS (SELECT *, 'first' AS point FROM r WHERE rn = 1 UNION ALL SELECT *, 'median' FROM r WHERE rn = (n - 1) // 2 + 1 UNION ALL SELECT *, 'last' FROM r WHERE rn = n)
SELECT repo, actor, point, sha, n AS contributions, c AS repository_commits FROM p WHERE n >= {R.FLOOR}""",
    "agg28_role_profile": f"""WITH {HISTORY}, m AS (SELECT repo, actor, sha, author_sec, subject, CAST(year(local_day) AS VARCHAR) AS year FROM scoped), sp AS (SELECT repo, actor, count(*) AS denominator, min(author_sec) AS a, max(author_sec) AS b FROM m GROUP BY 1, 2),
x AS (SELECT *, (author_sec - a) AS e, (b - a) AS w FROM m JOIN sp USING (repo, actor)), c AS (SELECT x.*, path, status FROM x JOIN changes USING (sha)),
l AS (SELECT DISTINCT repo, actor, denominator, sha, 'domain' AS dimension, {domain('path')} AS category FROM c
  UNION ALL SELECT repo, actor, denominator, sha, 'domain', 'unclassified' FROM x WHERE sha NOT IN (SELECT sha FROM changes)
  UNION ALL SELECT DISTINCT repo, actor, denominator, sha, 'work_type', CASE WHEN status IN ('A', 'C') THEN 'create' ELSE 'modify' END FROM c
  UNION ALL SELECT DISTINCT repo, actor, denominator, sha, 'work_type', 'test' FROM c WHERE {any_test('path')}
  UNION ALL SELECT DISTINCT repo, actor, denominator, sha, 'work_type', 'dependency' FROM c WHERE {dependency('path')}
  UNION ALL SELECT repo, actor, denominator, sha, 'work_type', 'corrective' FROM x WHERE {corrective('subject')}
  UNION ALL SELECT repo, actor, denominator, sha, 'phase', CASE WHEN w <= 0 THEN 'recent' WHEN e < w / 3 THEN 'early' WHEN e < w * 2 / 3 THEN 'middle' ELSE 'recent' END FROM x
  UNION ALL SELECT repo, actor, denominator, sha, 'calendar_year', year FROM x),
o AS (SELECT repo, actor, dimension, category, denominator, count(*) AS n FROM l GROUP BY ALL)
SELECT *, {gated(ratio('n', 'denominator'), 'denominator')} AS share, CASE WHEN denominator = 0 THEN 'no_population' WHEN denominator < {R.FLOOR} THEN 'insufficient_population' END AS reason FROM o""",
    "agg29_partition": f"""WITH {COMMITS}, k AS (SELECT *, CASE WHEN trim(author_email) <> '' THEN 'email:' || lower(trim(author_email)) WHEN trim(author_name) <> '' THEN 'name:' || lower(trim(author_name)) END AS key FROM human),
c AS (SELECT repo, key, count(*) AS commits, count(*) FILTER (is_merge) AS merges FROM k WHERE key IS NOT NULL GROUP BY 1, 2),
n AS (SELECT repo, key, author_name AS display_name, row_number() OVER (PARTITION BY repo, key ORDER BY count(*) DESC, lower(author_name), author_name) AS rn FROM k GROUP BY 1, 2, 3),
j AS (SELECT c.*, display_name, {slug('display_name')} AS slug FROM c JOIN n USING (repo, key) WHERE rn = 1)
SELECT repo, key, commits, merges, commits - merges AS nonmerge, display_name, CASE WHEN slug IS NOT NULL AND count(*) OVER (PARTITION BY repo, slug) = 1 THEN slug ELSE 'actor_' || substr(sha256(CAST('actor\\x00' AS BLOB) || encode(repo || '|' || key)), 1, 32) END AS actor_id FROM j""".replace("\\\\", "\\"),
    "agg30_buckets": f"""WITH {COMMITS}, o AS (SELECT repo, count(*) AS commits, count(*) FILTER (is_bot) AS bots, count(*) FILTER (NOT is_bot AND is_merge) AS human_merges, count(*) FILTER (NOT is_bot AND NOT is_merge) AS human_nonmerge FROM commits GROUP BY 1), s AS (SELECT *, {ratio('human_nonmerge', 'commits')} AS x FROM o), b AS (SELECT *, CAST(least(90, floor(least(1.0, greatest(0.0, x)) * 10) * 10) AS INT) AS low FROM s)
SELECT repo, {', '.join(f'{bucket(c)} AS {c}' for c in ('commits', 'bots', 'human_merges', 'human_nonmerge'))}, printf('%02d-%02d%%', low, low + 10) AS human_nonmerge_share FROM b""",
    "agg31_coverage": f"""WITH {COMMITS} SELECT repo, count(DISTINCT lower(trim(author_email))) FILTER (trim(author_email) <> '') AS actors, count(*) FILTER (trim(author_email) <> '') AS attributed, count(*) FILTER (trim(author_email) = '') AS unresolved, {ratio("count(*) FILTER (trim(author_email) <> '')", 'count(*)')} AS coverage FROM human GROUP BY 1""",
    "agg32_complementarity": f"""WITH {HISTORY}, {TOUCHED}, n AS (SELECT repo, actor, count(DISTINCT sha) AS n FROM touched GROUP BY 1, 2), c AS (SELECT repo, actor, surface, count(DISTINCT sha) AS commits FROM touched GROUP BY 1, 2, 3), d AS (SELECT * FROM (VALUES {_rows(compare.TEAM_REQUIREMENTS)}) AS t(surface, floor)),
g AS (SELECT n.repo, n.actor, d.surface, CAST(d.floor AS DOUBLE) AS floor, coalesce(commits, 0) AS commits, {gated(ratio('commits', 'n'), 'n')} AS share FROM n CROSS JOIN d LEFT JOIN c ON n.repo = c.repo AND n.actor = c.actor AND d.surface = c.surface),
v AS (SELECT repo, surface, CASE WHEN commits = 0 THEN 'observed_zero' ELSE {compared('share', 'floor', "'min'")} END AS v FROM g),
o AS (SELECT repo, surface, count(*) AS team_size, count(*) FILTER (v <> 'not_observed') AS actors_observed, count(*) FILTER (v = 'overlap') AS meeting_declared, count(*) FILTER (v IN ('overlap', 'outside_declared_range')) AS with_any FROM v GROUP BY 1, 2)
SELECT *, CASE WHEN team_size < 3 THEN 'insufficient_team_size' WHEN actors_observed = 0 THEN 'not_observed' WHEN meeting_declared > 0 THEN 'covered' ELSE 'below_declared' END AS state FROM o""",
    "agg33_prevalence": f"""WITH r AS (SELECT DISTINCT p_type AS ecosystem, p_brand AS library, s_nationkey AS repo FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), w AS (SELECT ecosystem, count(DISTINCT repo) AS repositories FROM r GROUP BY 1)
SELECT ecosystem, library, count(*) AS declaring, any_value(repositories) AS repositories, {ratio('count(*)', 'any_value(repositories)')} AS share FROM r JOIN w USING (ecosystem) GROUP BY 1, 2""",
    "agg34_distribution": f"""WITH {HISTORY}, {FLAGS}, {COCHANGE}, q AS (SELECT count(*) AS n, [{', '.join(f'quantile_cont(rate, {k} / 9.0::DOUBLE)' for k in range(10))}] AS p FROM cochange_rates WHERE narrate_rate)
SELECT n, CAST(k AS BIGINT) AS point, round(p[k + 1], 4) AS bound FROM q, range(10) AS t(k)""",
    "agg35_groups": f"""WITH v AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('{_A}', '{_B}')),
p AS (SELECT count(*) FILTER (a.v > b.v) AS gt, count(*) FILTER (a.v < b.v) AS lt, count(*) AS n FROM v a JOIN v b ON a.g = '{_A}' AND b.g = '{_B}'),
s AS (SELECT count(*) FILTER (g = '{_A}') AS n_a, count(*) FILTER (g = '{_B}') AS n_b, quantile_cont(v, 0.5) FILTER (g = '{_A}') AS ma, quantile_cont(v, 0.5) FILTER (g = '{_B}') AS mb, min(v) FILTER (g = '{_A}') AS la, max(v) FILTER (g = '{_A}') AS ha, min(v) FILTER (g = '{_B}') AS lb, max(v) FILTER (g = '{_B}') AS hb FROM v),
t AS (SELECT *, (gt - lt) / n AS delta, ma - mb AS gap, (la >= lb AND ha <= hb) OR (lb >= la AND hb <= ha) AS contained FROM s, p)
SELECT n_a, n_b, round(ma, 4) AS median_a, round(mb, 4) AS median_b, round(gap, 4) AS gap, contained, round(delta, 4) AS cliffs_delta, CASE WHEN n_a < 2 OR n_b < 2 THEN 'inconclusive_small_n' WHEN gap <= -0.1 THEN 'kill_reverse_direction' WHEN gap >= 0.1 AND NOT contained AND abs(delta) >= 0.33 THEN 'separated' ELSE 'fail_tier2' END AS verdict FROM t""",
    "agg37_role_validation": f"""WITH r AS (SELECT CAST(quality AS VARCHAR) AS truth, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS pred FROM documents JOIN labels USING (doc_id)), l AS (SELECT unnest([{_quoted(compare.ROLE_LABELS)}]) AS label),
c AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn FROM l, r GROUP BY 1),
x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, tp + fn AS support FROM x""",
    "agg38_periods": f"""WITH r AS (SELECT o_custkey % 50 AS subject, CAST(o_orderdate AS DATE) AS day, sha256(o_orderpriority || '|' || o_orderstatus || '|' || year(o_orderdate)) AS digest FROM orders), d AS (SELECT subject, digest, count(*) AS n, min(day) AS a, max(day) AS b FROM r GROUP BY 1, 2)
SELECT subject, count(*) AS reports, count(*) FILTER (n > 1) AS duplicated, CAST(min(a) AS VARCHAR) AS first_day, CAST(max(b) AS VARCHAR) AS last_day, {ratio('count(*) FILTER (n = 1)', 'count(*)', 12)} AS unique_share FROM d GROUP BY 1""",
    "agg39_engagement": f"WITH {COMMITS} SELECT repo, actor, count(*) AS commits, count(DISTINCT local_day) AS active_days, CAST(min(local_day) AS VARCHAR) AS first_day, CAST(max(local_day) AS VARCHAR) AS last_day FROM scoped GROUP BY 1, 2",
    "agg40_population": f"""WITH {COMMITS}, o AS (SELECT repo, count(*) AS commits, count(*) FILTER (is_bot) AS bots, count(*) FILTER (NOT is_bot AND is_merge) AS human_merges, count(*) FILTER (NOT is_bot AND NOT is_merge) AS human_nonmerge FROM commits GROUP BY 1) SELECT *, {ratio('human_nonmerge', 'commits')} AS human_nonmerge_share FROM o""",
    "agg41_commit_rows": f"""WITH {HISTORY}, {FLAGS} SELECT repo, sha, CAST(local_day AS VARCHAR) AS day, coalesce(prod_n, 0) AS prod_n, coalesce(test_n, 0) AS test_n, coalesce(docs_n, 0) AS docs_n, coalesce(prod_n, 0) > 0 AND coalesce(test_n, 0) > 0 AS cochange, CASE WHEN {revert('subject')} THEN 'revert' WHEN {corrective('subject')} THEN 'fix' ELSE 'other' END AS subject_class FROM scoped LEFT JOIN flags USING (sha)""",
    "agg42_actor_cards": f"WITH {COMMITS}, {rhythm('repo, actor')} SELECT * FROM rhythm",
    "agg43_admission": f"""WITH {HISTORY}, {FLAGS}, {COCHANGE} SELECT CAST(n_regionkey AS BIGINT) AS "group", count(*) AS repositories, count(population) AS ok, count(*) FILTER (narrate_rate) AS narratable FROM nation LEFT JOIN cochange_rates ON n_nationkey = repo GROUP BY 1""",
    "agg47_coverage_matrix": f"""WITH {REPO_METRICS} SELECT metric, repo, max(CAST(value IS NOT NULL AS BIGINT)) AS observed FROM repo_metrics GROUP BY 1, 2""",
    "agg50_record_window": f"WITH {LIFECYCLE} SELECT project, min(coalesce(created, released, closed)) AS first_sec, max(coalesce(created, released, closed)) AS last_sec FROM lifecycle GROUP BY 1",
    "jn07_accounts": f"""WITH {COMMITS}, e AS (SELECT repo, sha, customer AS actor, s_suppkey AS account FROM human JOIN supplier ON s_nationkey = repo AND customer % 5 = s_suppkey % 5), n AS (SELECT sha, count(*) AS n FROM e GROUP BY 1),
o AS (SELECT repo, count(*) FILTER (n IS NULL) AS unmatched, count(*) FILTER (n = 1) AS matched, count(*) FILTER (n > 1) AS ambiguous FROM human LEFT JOIN n USING (sha) GROUP BY 1), c AS (SELECT repo, count(*) AS conflicts FROM (SELECT repo, account FROM e GROUP BY 1, 2 HAVING count(DISTINCT actor) > 1) GROUP BY 1)
SELECT repo, unmatched, matched, ambiguous, coalesce(conflicts, 0) AS conflicts FROM o LEFT JOIN c USING (repo)""",
    "jn08_oid_difference": """WITH o AS (SELECT l_orderkey AS sha FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 50 <> 0)
SELECT 'missing' AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT sha FROM o) UNION ALL SELECT 'extra', count(DISTINCT sha) FROM o WHERE sha NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 40 <> 0) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT sha FROM o GROUP BY 1 HAVING count(*) > 1)""",
    "jn10_post_release_fixes": f"""WITH {COMMITS}, {TAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY local_day, sha) AS pos FROM commits),
h AS (SELECT DISTINCT f.repo, f.sha FROM r f JOIN r t ON f.customer = t.customer AND f.pos >= t.pos AND t.sha % 97 = 0 WHERE NOT f.is_bot AND NOT f.is_merge AND {corrective('f.subject')} AND f.author_sec BETWEEN t.author_sec AND t.author_sec + {R.RELEASE_DAYS * 86400})
SELECT repo, count(h.sha) AS fixes FROM heads LEFT JOIN h USING (repo) GROUP BY 1""",
    "jn11_reachability": f"""WITH {COMMITS}, r AS (SELECT customer, sha, row_number() OVER (PARTITION BY customer ORDER BY local_day, sha) AS pos, count(*) OVER (PARTITION BY customer) AS n FROM commits) SELECT sha, n - pos + 1 AS descendants FROM r WHERE sha % 97 = 0""",
    "jn12_links": f"""WITH {LIFECYCLE}, j AS (SELECT a.project, a.record_type, b.record_type AS other FROM lifecycle a LEFT JOIN lifecycle b ON a.project = b.project AND a.linked = b.record_id WHERE a.linked IS NOT NULL)
SELECT project, count(*) AS links, count(*) FILTER (other IS NULL) AS broken, count(*) FILTER (other IS NOT NULL AND NOT ((record_type = 'issue' AND other = 'pull_request') OR (record_type = 'pull_request' AND other = 'issue'))) AS wrong_kind FROM j GROUP BY 1""",
    "jn15_manifest_changes": f"""WITH {HISTORY}, n AS (SELECT sha, list_distinct(list(regexp_extract(path, '([^/.]+)\\.[^/]*$', 1))) AS names FROM changes GROUP BY 1), r AS (SELECT repo, sha, lag(sha) OVER (PARTITION BY customer ORDER BY local_day, sha) AS parent FROM commits),
b AS (SELECT repo, a.names AS names, p.names AS old FROM r JOIN n a USING (sha) JOIN n p ON p.sha = r.parent)
SELECT repo, CAST(sum(len(list_filter(names, lambda x: NOT list_contains(old, x)))) AS BIGINT) AS gained, CAST(sum(len(list_filter(old, lambda x: NOT list_contains(names, x)))) AS BIGINT) AS lost, count(*) AS commits FROM b GROUP BY 1""".replace("\\\\", "\\"),
    "jn17_library_lookup": """SELECT p_brand AS library, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS ecosystem, CASE WHEN count(DISTINCT p_type) > 1 THEN 'ambiguous_ecosystem' END AS reason FROM part GROUP BY 1""",
    "jn23_lineage": f"""WITH {HISTORY}, b AS (SELECT repo, path, actor, status, local_day, ord, CAST(sum(CAST(status = 'A' AS INT)) OVER (PARTITION BY repo, path ORDER BY local_day, ord) AS BIGINT) AS inc FROM scoped JOIN changes USING (sha)),
c AS (SELECT repo, path, inc, actor AS creator FROM b WHERE status = 'A'), e AS (SELECT repo, path, inc, min((local_day, ord)) AS ended FROM b WHERE status = 'D' GROUP BY 1, 2, 3),
l AS (SELECT b.*, creator FROM b JOIN c USING (repo, path, inc) LEFT JOIN e USING (repo, path, inc) WHERE status <> 'A' AND (ended IS NULL OR (local_day, ord) <= ended)),
t AS (SELECT repo, count(*) FILTER (status = 'M') AS modifications, count(*) FILTER (status = 'M' AND actor <> creator) AS cross_author, count(*) FILTER (status <> 'M') AS deletions FROM l GROUP BY 1)
SELECT repo, creations, modifications, cross_author, deletions, {ratio('cross_author', 'modifications')} AS cross_author_share FROM (SELECT repo, count(*) AS creations FROM c GROUP BY 1) LEFT JOIN t USING (repo)""",
    "top01_most_commits": f"""WITH {COMMITS}, c AS (SELECT repo, actor, count(*) AS commits, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, actor) AS n FROM scoped GROUP BY 1, 2) SELECT repo, actor, commits FROM c WHERE n <= 3 ORDER BY 1, 2""",
    "top03_directories": f"""WITH {HISTORY}, d AS (SELECT repo, string_split(path, '/')[1] AS dir, ord, path FROM human JOIN changes USING (sha) WHERE contains(path, '/')), c AS (SELECT repo, dir, count(*) AS n, min((ord, path)) AS seen FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, seen) AS rank FROM c)
SELECT repo, rank, dir, n FROM r WHERE rank <= 5""",
    "cmp01_alignment": f"""WITH {REPO_METRICS}, d AS (SELECT metric, bound, CAST(target AS DOUBLE) AS target FROM (VALUES {_rows(compare.REQUIREMENTS)}) AS t(metric, bound, target))
SELECT repo, metric, bound, target, value, {compared('value', 'target', 'bound')} AS comparison FROM (SELECT repo, metric, bound, target FROM heads, d) LEFT JOIN repo_metrics USING (repo, metric)""",
    "cmp05_tendency": f"""WITH {HISTORY}, {TOUCHED}, {SURFACE}, r AS (SELECT repo, surface, share, max(share) OVER (PARTITION BY repo) AS top FROM surface_profile WHERE share > 0), t AS (SELECT repo, any_value(share) AS share, count(*) AS n, min(surface) AS s FROM r WHERE share = top GROUP BY 1)
SELECT repo, share, CASE WHEN n = 1 THEN s ELSE 'tied_top_share' END AS surface, CASE WHEN share >= {R.SHARE_STRONG} THEN 'strong' WHEN share >= {R.SHARE_MODERATE} THEN 'moderate' ELSE 'weak' END AS strength FROM t""",
    "cmp06_relationship": f"""WITH {COMMITS}, {rhythm('repo', 'project')}, {rhythm('repo, actor', 'person')}, b AS (SELECT a.repo, a.actor, least(a.gaps, p.gaps) AS n, a.median_gap_days AS x, p.median_gap_days AS y FROM person a JOIN project p ON a.repo = p.repo)
SELECT repo, actor, n, CASE WHEN x IS NULL OR y IS NULL THEN 'not_comparable' WHEN n < {R.FLOOR} THEN 'not_proven' WHEN x = 0 AND y = 0 THEN 'similar_direction' WHEN x = 0 OR y = 0 THEN 'different_direction' WHEN x / y BETWEEN {R.SIMILAR_LOW} AND {R.SIMILAR_HIGH} THEN 'similar_direction' ELSE 'different_direction' END AS kind,
  CASE WHEN x IS NULL OR y IS NULL THEN 'not_proven' WHEN n < 5 THEN 'insufficient_data' WHEN n < {R.FLOOR} THEN 'weak_signal' ELSE 'directional_candidate' END AS confidence FROM b""",
    "cmp09_reference": f"""WITH {HISTORY}, {FLAGS}, {COCHANGE}, r AS (SELECT repo, rate, count(*) OVER (ORDER BY rate) AS below, count(*) OVER () AS n FROM cochange_rates WHERE narrate_rate)
SELECT repo, rate, CASE WHEN n >= 20 THEN CAST(greatest(1, least(10, floor(below / n * 10))) AS BIGINT) END AS decile, CASE WHEN n < 20 THEN 'reference_too_small' END AS reason FROM r""",
    "cmp13_difference": f"""WITH {REPO_METRICS}, r AS (SELECT repo, metric, CASE WHEN metric <> 'reverts' THEN value END AS value FROM repo_metrics WHERE repo % 2 = 0),
b AS (SELECT metric, CASE WHEN r.repo IS NULL THEN 'removed' WHEN l.repo IS NULL THEN 'added' WHEN l.value IS DISTINCT FROM r.value THEN 'changed' END AS kind FROM repo_metrics l FULL JOIN r USING (repo, metric))
SELECT metric, kind, count(*) AS n FROM b WHERE kind IS NOT NULL GROUP BY 1, 2""",
    "val01_lifecycle": f"""WITH {LIFECYCLE}, c AS (SELECT count(*) FILTER (created IS NULL) AS created_missing, count(*) FILTER (record_type = 'issue' AND (first_review IS NOT NULL OR merged IS NOT NULL OR released IS NOT NULL)) AS issue_with_review,
  count(*) FILTER (record_type = 'issue' AND state = 'O' AND in_progress IS NOT NULL) AS open_issue_in_progress, count(*) FILTER (record_type = 'issue' AND state = 'F' AND closed IS NULL) AS closed_issue_without_close, count(*) FILTER (record_type = 'pull_request' AND (in_progress IS NOT NULL OR released IS NOT NULL)) AS pr_with_progress,
  count(*) FILTER (record_type = 'pull_request' AND state = 'F' AND merged IS NULL) AS merged_pr_without_merge, count(*) FILTER (record_type = 'pull_request' AND state = 'O' AND first_review IS NOT NULL) AS open_pr_with_review, count(*) FILTER (record_type = 'release' AND released IS NULL) AS release_without_release,
  count(*) FILTER (record_type = 'issue' AND (in_progress < created OR closed < in_progress)) AS issue_out_of_order, count(*) FILTER (record_type = 'pull_request' AND (first_review < created OR merged < first_review)) AS pr_out_of_order FROM lifecycle)
UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE violations""",
    "val03_sequence": f"""WITH {LIFECYCLE}, b AS (SELECT kind, lag(state) OVER (PARTITION BY project, record_id ORDER BY sec, pos) AS before FROM tracker WHERE kind <> 'issue_linked')
SELECT kind, count(*) AS events, count(*) FILTER (CASE kind WHEN 'issue_opened' THEN before IS NOT NULL WHEN 'issue_triaged' THEN before IS DISTINCT FROM 'open' ELSE NOT coalesce(before IN ('open', 'triaged'), false) END) AS violations FROM b GROUP BY 1""",
    "val07_bounds": f"""WITH {HISTORY}, {FLAGS}, {COCHANGE} SELECT count(*) AS rows, count(*) FILTER (cochanged > population) AS over, count(*) FILTER (abs(rate - round(cochanged / population, 4)) > 1e-12) AS off FROM cochange_rates""",
    "val09_leak_guard": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS shape FROM documents WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in portfolio.CREDENTIALS.items()),
    "fn26_remotes": r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[^:]+://', ''), '^[^/@]*@', '') AS r FROM pages), s AS (SELECT page_id, regexp_replace(lower(split_part(r, '/', 1)), '\.$', '') AS host, regexp_replace(trim(regexp_replace(r, '^[^/]*', ''), '/'), '\.git$', '') AS path FROM t)
SELECT page_id, CASE WHEN contains(path, '//') OR regexp_matches(path, '(^|/)\.{1,2}(/|$)') OR NOT contains(host, '.') THEN NULL WHEN path = '' THEN host ELSE host || '/' || path END AS remote FROM s""",
    "fn38_robots": r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM pages), r AS (SELECT * FROM (VALUES ('/en', true), ('/fr', false), ('/fr/8', true), ('/de/2', false), ('/de/2', true), ('/es', false)) AS t(prefix, allow)),
b AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, allow DESC) AS n FROM p JOIN r ON starts_with(path, prefix))
SELECT page_id, coalesce(allow, true) AS allowed FROM p LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (page_id)""",
}

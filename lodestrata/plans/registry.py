"""The registered queries: name to a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import accounts, chains, claims, commits, compare, events, evidence, gates, graph, identity, lineage, paths, people, portfolio, registers, roles, topology
from . import claim_oracles, gate_oracles, graph_oracles, oracles, topology_oracles
from .surrogate import Frames

_MEASURES: dict[str, Callable[[Frames], DataFrame]] = {
    "fn_paths": paths.path_rules,
    "fn_commits": people.commit_rule_rows,
    "fn26_remotes": portfolio.remotes,
    "fn38_robots": portfolio.robots,
    "agg01_origin": commits.origin,
    "agg02_activity": commits.activity,
    "agg03_core_period": commits.core_period,
    "agg04_test_cochange": commits.test_cochange,
    "agg05_rework": commits.rework,
    "agg06_survival": commits.survival,
    "agg07_rhythm": commits.rhythm,
    "agg08_surface_profile": paths.surface_profile,
    "agg08_surface_totals": paths.surface_totals,
    "agg09_surface_pairs": paths.surface_pairs,
    "agg10_verification": paths.verification,
    "agg11_coordination": commits.coordination,
    "agg13_context": commits.context,
    "agg14_turnover": commits.turnover,
    "agg15_languages": paths.languages,
    "agg17_cadence": commits.release_cadence,
    "agg18_manifests": paths.manifests,
    "agg19_archive": events.archive_summary,
    "agg20_coverage": events.source_coverage,
    "agg21_event_rhythm": events.event_rhythm,
    "agg22_bound_rhythm": lambda f: events.event_rhythm(f, exact=True),
    "agg23_tracker": events.tracker_summary,
    "agg24_lifecycle": events.lifecycle_summary,
    "agg25_experience": people.experience,
    "agg25_self_returns": people.self_returns,
    "agg26_timeline": paths.timeline,
    "agg27_size_points": people.size_points,
    "agg28_role_profile": people.role_profile,
    "agg29_partition": people.partition,
    "agg30_buckets": portfolio.buckets,
    "agg31_coverage": people.coverage,
    "agg32_complementarity": compare.complementarity,
    "agg33_prevalence": portfolio.prevalence,
    "agg34_distribution": compare.distribution,
    "agg34_strata": compare.strata,
    "agg35_groups": compare.group_comparison,
    "agg37_role_validation": compare.role_validation,
    "agg38_periods": portfolio.periods,
    "agg39_engagement": commits.engagement,
    "agg40_population": commits.population,
    "agg41_commit_rows": commits.commit_rows,
    "agg42_actor_cards": lambda f: commits.rhythm(f, ("repo", "actor")),
    "agg43_admission": portfolio.admission,
    "agg47_coverage_matrix": portfolio.coverage_matrix,
    "agg50_record_window": events.record_window,
    "jn07_accounts": people.account_joins,
    "jn08_oid_difference": graph.oid_difference,
    "jn10_post_release_fixes": graph.post_release_fixes,
    "jn11_reachability": graph.reachability,
    "jn12_links": events.lifecycle_links,
    "jn15_manifest_changes": paths.manifest_changes,
    "jn17_library_lookup": portfolio.library_lookup,
    "jn23_lineage": commits.lineage_counts,
    "top01_most_commits": commits.most_commits,
    "top03_directories": paths.top_directories,
    "cmp01_alignment": compare.alignment,
    "cmp05_tendency": compare.tendency,
    "cmp06_relationship": compare.relationship,
    "cmp09_reference": compare.reference_deciles,
    "cmp13_difference": compare.report_difference,
    "val01_lifecycle": events.lifecycle_violations,
    "val03_sequence": events.sequence_violations,
    "val07_bounds": portfolio.value_bounds,
    "val09_leak_guard": portfolio.leak_guard,
    **gates.MEASURES,
    **accounts.MEASURES,
    **chains.MEASURES,
    **claims.MEASURES,
    **evidence.MEASURES,
    **identity.MEASURES,
    **lineage.MEASURES,
    **registers.MEASURES,
    **roles.MEASURES,
    **topology.MEASURES,
}


def _over(measure: Callable[[Frames], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: measure(Frames(spark, sf_dir))


ORACLES = oracles.ORACLES | gate_oracles.ORACLES | graph_oracles.ORACLES | claim_oracles.ORACLES | topology_oracles.ORACLES

QUERIES = {name: _over(m) for name, m in _MEASURES.items()}

__all__ = ["ORACLES", "QUERIES"]

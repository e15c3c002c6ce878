"""Chains of tracker events on literal exports."""

import pytest

from lodestrata.operators import chains


def event(n, kind="issue_triaged", state="triaged", previous=None, previous_state="open", linked=None, sec=None, duration=None, record=1, record_type="issue", position=None):
    sec = float(n * 10) if sec is None else sec
    return (1, n, n if position is None else position, record_type, record, kind, state, previous, previous_state if previous is not None else None, linked, sec, duration)


def opened(n, **more):
    return event(n, "issue_opened", "open", **more)


def faults(spark, rows):
    return {(r.event_id, r.fault) for r in chains.chain_faults(spark.createDataFrame(rows, chains.SCHEMA)).collect()}


MILESTONE = event(2, "milestone_set", "active", record=9, record_type="milestone")
CASES = {
    "first_has_previous": [opened(1), opened(3, previous=1, duration=20.0)],
    "broken_previous": [opened(1), event(3, previous=7, duration=20.0)],
    "previous_not_earlier": [opened(1, position=5), event(3, previous=1, duration=20.0, position=5)],
    "crosses_records": [opened(1), event(3, previous=1, duration=20.0, record=2)],
    "previous_state_differs": [opened(1), event(3, previous=1, duration=20.0, previous_state="triaged")],
    "duration_missing": [opened(1), event(3, previous=1)],
    "negative_duration": [opened(1, sec=50.0), event(3, previous=1, duration=0.0)],
    "duration_differs": [opened(1), event(3, previous=1, duration=20.00001)],
    "branching": [opened(1), event(3, previous=1, duration=20.0), event(4, "issue_closed", "closed", previous=1, duration=30.0)],
    "broken_link": [opened(1), event(3, "issue_linked", "open", previous=1, duration=20.0, linked=8)],
    "link_not_earlier": [opened(1), event(2, "milestone_set", "active", record=9, record_type="milestone", position=4), event(3, "issue_linked", "open", previous=1, duration=20.0, linked=2)],
    "link_target_unfit": [opened(1), event(3, "issue_linked", "open", previous=1, duration=20.0, linked=1)],
    "linked_when_closed": [opened(1), MILESTONE, event(3, "issue_closed", "closed", previous=1, duration=20.0), event(4, "issue_linked", "closed", previous=3, previous_state="closed", duration=10.0, linked=2)],
}


def test_sound_chains(spark):
    rows = [opened(1), MILESTONE, event(3, previous=1, duration=20.0000005), event(4, "issue_linked", "triaged", previous=3, previous_state="triaged", duration=10.0, linked=2), event(5, "issue_closed", "closed", previous=3, previous_state="triaged", duration=20.0)]
    assert faults(spark, [*rows, rows[0]]) == set()


@pytest.mark.parametrize("name", CASES)
def test_one_fault(spark, name):
    found = faults(spark, CASES[name])
    assert {f for _, f in found} == {name}


def test_long_chains_and_circles(spark):
    rows = [opened(0)] + [event(n, previous=n - 1, previous_state="open" if n == 1 else "triaged", duration=10.0) for n in range(1, 300)]
    rows += [event(1000 + n, previous=1000 + (n + 1) % 7, previous_state="triaged", duration=10.0) for n in range(7)]  # a circle of seven
    rows += [event(2000, previous=1003, previous_state="triaged", duration=10.0), event(3000, previous=3000, previous_state="triaged", duration=0.0), opened(4000)]
    got = {r.event_id: (r.root, r.depth, r.cyclic) for r in chains.roots(spark.createDataFrame(rows, chains.SCHEMA)).collect()}
    assert all(got[n] == (0, n, False) for n in range(300)) and got[4000] == (4000, 0, False)
    assert all(got[n] == (None, None, True) for n in [*range(1000, 1007), 2000, 3000])


def test_only_open_events_go_on(spark, monkeypatch):
    # a circle keeps two events open; the thousand sound chains are told once and not written again
    rows = [opened(10 * n, record=n) for n in range(1000)] + [event(10 * n + 1, previous=10 * n, duration=10.0, record=n) for n in range(1000)]
    rows += [event(90_001, previous=90_002, duration=1.0), event(90_002, previous=90_001, duration=1.0)]
    written, plain = [], chains.staged_count
    monkeypatch.setattr(chains, "staged_count", lambda df, *a: written.append(df.count()) or plain(df, *a))
    got = chains.roots(spark.createDataFrame(rows, chains.SCHEMA)).groupBy("depth", "cyclic").count().collect()
    assert {(r.depth, r.cyclic): r["count"] for r in got} == {(0, False): 1000, (1, False): 1000, (None, True): 2}
    assert written[:2] == [2002, 1002] and all(n == 2 for n in written[2:])

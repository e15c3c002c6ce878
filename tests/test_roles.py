"""The role predictor on a labelled sample."""

import random

import pytest

from lodestrata.operators import roles


def written(path, rows, columns=("source_row", "role_label", *roles.FEATURES)):
    path.write_text("\n".join(",".join(map(str, r)) for r in [columns, *rows]) + "\n")
    return str(path)


def drawn(n=60, seed=5):
    rng = random.Random(seed)
    return [[i, roles.LABELS[i % 5], *(rng.choice([0, 0, 1, 2, 50]) for _ in roles.FEATURES)] for i in range(n)]


def plain(row):
    value = dict(zip(roles.FEATURES, row[2:]))
    scores = {label: sum(value[c] * w for c, w in weights.items()) for label, weights in roles.SCORES.items()}
    return max(roles.LABELS, key=lambda label: scores[label])


def test_confusion_and_averages(spark, tmp_path):
    rows = drawn()
    cells = roles.confusion(roles.read_sample(spark, written(tmp_path / "s.csv", rows)))
    got = {(r.truth, r.pred): r.n for r in cells.collect()}
    assert len(got) == 25 and got == {(a, b): sum(r[1] == a and plain(r) == b for r in rows) for a in roles.LABELS for b in roles.LABELS}
    one = roles.averages(cells).first()
    hits = {x: got[x, x] for x in roles.LABELS}
    given = {x: sum(got[a, x] for a in roles.LABELS) for x in roles.LABELS}
    assert one.sample_size == 60 and one.accuracy == pytest.approx(sum(hits.values()) / 60, abs=1e-4)
    assert one.macro_precision == pytest.approx(sum(hits[x] / given[x] if given[x] else 0 for x in roles.LABELS) / 5, abs=1e-4)
    assert one.weighted_recall == pytest.approx(sum(hits.values()) / 60, abs=1e-3)


def test_ties_go_to_the_first_label(spark, tmp_path):
    rows = [[i, label, *(0 for _ in roles.FEATURES)] for i, label in enumerate(roles.LABELS)]
    assert {r.pred for r in roles.confusion(roles.read_sample(spark, written(tmp_path / "s.csv", rows))).where("n > 0").collect()} == {"Backend"}


@pytest.mark.parametrize("fault", ["label", "negative", "text", "empty", "repeated", "missing", "column", "none"])
def test_invalid_samples(spark, tmp_path, fault):
    rows, columns = drawn(10), ("source_row", "role_label", *roles.FEATURES)
    if fault == "label":
        rows[0][1] = "Wizard"
    elif fault in ("negative", "text", "empty"):
        rows[0][4] = {"negative": -1, "text": "many", "empty": ""}[fault]
    elif fault == "repeated":
        rows[1][0] = rows[0][0]
    elif fault == "missing":
        rows = [r for r in rows if r[1] != "Mobile"]
    elif fault == "column":
        columns, rows = (*columns, "email"), [[*r, "x@x.test"] for r in rows]
    else:
        rows = []
    with pytest.raises(roles.SampleError):
        roles.read_sample(spark, written(tmp_path / "s.csv", rows, columns))

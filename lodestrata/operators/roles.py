"""Validation of the role predictor: labelled samples, the label with the largest of five scores, and how well it does."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.observe import ratio, rounded
from ..plans.surrogate import Frames

# The labels in the order in which ties are decided, and the features and weights of each one's score.
SCORES = {
    "Backend": {"bio_backend": 1.0, "bio_java": 1.0, "rate_java": 1.0},
    "Frontend": {"bio_frontend": 1.0, "rate_typescript": 1.0, "author_javascript": 0.01},
    "Mobile": {"author_typescript": 0.02, "author_javascript": 0.01},
    "DevOps": {"bio_devops": 1.0},
    "DataScientist": {"bio_data": 1.0, "rate_python": 1.0},
}
LABELS = tuple(SCORES)
FEATURES = tuple(sorted({c for weights in SCORES.values() for c in weights} | {"bio_javascript", "bio_python"}))


class SampleError(ValueError):
    """A sample that breaks its rules."""


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """source_row, role_label and the features of a labelled CSV sample with exactly these columns.

    Every label must be there and no other, rows told apart by source_row, and features finite and not negative; nothing in it
    may tell who a row is, so that other columns are an error.
    """
    raw = spark.read.option("header", True).csv(path)
    if set(raw.columns) != {"source_row", "role_label", *FEATURES}:
        raise SampleError(f"columns differ: {sorted(set(raw.columns) ^ {'source_row', 'role_label', *FEATURES})}")
    number = {c: F.expr(f"try_cast({c} AS double)") for c in FEATURES}
    finite = reduce(lambda a, b: a & b, (x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x != float("inf")) for x in number.values()))
    row = F.nullif(F.trim("source_row"), F.lit(""))
    seen = raw.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("role_label").isin(*LABELS), F.lit(False))).alias("label"), F.count_if(~finite).alias("feature"), (F.count("*") - F.countDistinct(row)).alias("source_row"), (F.lit(len(LABELS)) - F.countDistinct("role_label")).alias("missing_classes")).first()
    if not seen.n or seen.label or seen.feature or seen.source_row or seen.missing_classes:
        raise SampleError(f"empty, or rows with a wrong label, feature or source_row: {seen.asDict()}")
    return raw.select(F.trim("source_row").alias("source_row"), "role_label", *(x.alias(c) for c, x in number.items()))


def predicted() -> Column:
    """The label with the largest score, the first of equals."""
    scores = {label: reduce(add, (F.col(c) * F.lit(w) for c, w in weights.items())) for label, weights in SCORES.items()}
    best = F.greatest(*scores.values())
    return F.coalesce(*(F.when(score == best, label) for label, score in scores.items()))


def confusion(sample: DataFrame) -> DataFrame:
    """truth, pred and n for every pair of labels, zeros included."""
    cells = sample.select(F.col("role_label").alias("truth"), predicted().alias("pred")).groupBy("truth", "pred").agg(F.count("*").alias("n"))
    grid = sample.sparkSession.createDataFrame([(a, b) for a in LABELS for b in LABELS], "truth string, pred string")
    return grid.join(F.broadcast(cells), ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))  # 25 cells at most


def averages(cells: DataFrame) -> DataFrame:
    """Accuracy, and macro and weighted averages of the labels' rounded precision, recall and F1, in one row."""
    c = F.col
    hits = F.sum(F.when(c("truth") == c("pred"), c("n")).otherwise(0))
    by_truth = cells.groupBy(c("truth").alias("label")).agg(F.sum("n").alias("support"), hits.alias("tp"))
    by_pred = cells.groupBy(c("pred").alias("label")).agg(F.sum("n").alias("given"))
    p, r = (F.coalesce(c("tp") / F.nullif(c(d), F.lit(0)), F.lit(0.0)) for d in ("given", "support"))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    each = by_truth.join(by_pred, "label").select("support", "tp", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(f1).alias("f1"))
    names = ("precision", "recall", "f1")
    return each.agg(
        F.sum("support").alias("sample_size"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *(rounded(F.avg(x)).alias(f"macro_{x}") for x in names),
        *(rounded(F.sum(c(x) * c("support")) / F.sum("support")).alias(f"weighted_{x}") for x in names),
    )


def model_sample(f: Frames) -> DataFrame:
    """A labelled sample of the model: a customer's segment is the label, the orders by priority and state are the features."""

    def n(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value).cast("double")

    rows = f.table("orders").join(f.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    priorities = {"bio_backend": "1-URGENT", "bio_frontend": "2-HIGH", "bio_devops": "3-MEDIUM", "bio_data": "4-NOT SPECIFIED", "bio_java": "5-LOW"}
    states = {"rate_java": "F", "rate_typescript": "O", "rate_python": "P"}
    label = F.create_map(*(F.lit(x) for kv in zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), LABELS) for x in kv))
    counts = rows.groupBy("c_custkey", "c_mktsegment").agg(*(n("o_orderpriority", v).alias(k) for k, v in priorities.items()), *(n("o_orderstatus", v).alias(k) for k, v in states.items()), (F.count("*") * 7.0).alias("author_javascript"), (F.count("*") * 9.0).alias("author_typescript"))
    return counts.withColumn("role_label", label[F.col("c_mktsegment")])


MEASURES = {"agg37_confusion": lambda f: confusion(model_sample(f)), "agg37_averages": lambda f: averages(confusion(model_sample(f)))}

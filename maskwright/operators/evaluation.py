"""Span evaluation: exact matches, error taxonomy, scores, confusion and gates, as joins within a record.

True and predicted spans are rows (rec, start, end, type); ``end`` is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least precision and recall by type.
GATES = (("SECRET", 0.85, 0.90), ("PII", 0.85, 0.85), ("HOSTINFO", 0.80, 0.80), ("NETWORK", 0.80, 0.80))


def classify_predictions(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Each prediction with ``kind``: Exact, WrongType, Truncated, OverExtended, Boundary or Spurious, and the true span it hit.

    A prediction that matches no true span exactly is compared with the first one, by place, that it overlaps.
    """
    t = true.select("rec", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("type").alias("t_type"))
    same = (F.col("start") == F.col("t_start")) & (F.col("end") == F.col("t_end")) & (F.col("type") == F.col("t_type"))
    over = F.col("t_start").isNotNull() & (F.greatest("start", "t_start") < F.least("end", "t_end"))
    pairs = pred.join(t, "rec", "left").withColumn("_over", F.coalesce(over, F.lit(False))).withColumn("_same", F.coalesce(same, F.lit(False)))
    by = ["rec", "start", "end", "type"]
    hit = pairs.groupBy(*by).agg(F.max("_same").alias("exact"), F.min(F.when(F.col("_over"), F.struct("t_start", "t_end", "t_type"))).alias("first"))
    f = F.col("first")
    kind = (
        F.when(F.col("exact"), "Exact").when(f.isNull(), "Spurious").when(f["t_type"] != F.col("type"), "WrongType")
        .when((F.col("start") >= f["t_start"]) & (F.col("end") <= f["t_end"]), "Truncated").when((F.col("start") <= f["t_start"]) & (F.col("end") >= f["t_end"]), "OverExtended").otherwise("Boundary")
    )
    exact = F.struct(F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("type").alias("t_type"))
    return hit.select(*by, kind.alias("kind"), F.when(F.col("exact"), exact).otherwise(f).alias("hit"))


def missed(judged: DataFrame, true: DataFrame) -> DataFrame:
    """True spans that no prediction hit; one that a wrong prediction overlaps first is not missed."""
    hit = judged.filter("hit is not null").select("rec", F.col("hit.t_start").alias("start"), F.col("hit.t_end").alias("end"), F.col("hit.t_type").alias("type"))
    return true.join(hit, ["rec", "start", "end", "type"], "left_anti")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(judged: DataFrame, lost: DataFrame) -> DataFrame:
    """Per type and over all (``ALL``): tp, fp, fn, precision, recall, f1; 0 where undefined."""
    rows = judged.select("type", F.when(F.col("kind") == "Exact", "tp").otherwise("fp").alias("k")).unionByName(lost.select("type", F.lit("fn").alias("k")))
    rows = rows.unionByName(rows.withColumn("type", F.lit("ALL")))
    n = rows.groupBy("type").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")))
    n = n.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(judged: DataFrame) -> DataFrame:
    return judged.filter("kind = 'WrongType'").groupBy(F.col("hit.t_type").alias("true_type"), F.col("type").alias("pred_type")).agg(F.count(F.lit(1)).alias("n"))


def gates(scored: DataFrame) -> DataFrame:
    """Per gated type whether precision and recall reach their least values; a type without scores fails."""
    rows = scored.sparkSession.createDataFrame(list(GATES), "type string, least_precision double, least_recall double")
    got = rows.join(scored.select("type", "precision", "recall"), "type", "left")
    return got.select("type", (F.coalesce("precision", F.lit(0.0)) >= F.col("least_precision")).alias("precision_ok"), (F.coalesce("recall", F.lit(0.0)) >= F.col("least_recall")).alias("recall_ok"))


def boundary_audit(judged: DataFrame, lost: DataFrame) -> DataFrame:
    """Pairs of a wrong prediction and a missed span of the same record and type."""
    fp = judged.filter("kind <> 'Exact'").select("rec", "type", F.col("start").alias("fp_start"), F.col("end").alias("fp_end"))
    return fp.join(lost.select("rec", "type", F.col("start").alias("fn_start"), F.col("end").alias("fn_end")), ["rec", "type"])


def examples(judged: DataFrame, per_kind: int = 10) -> DataFrame:
    """The first examples of every kind and type; the number is the feature."""
    by = Window.partitionBy("kind", "type").orderBy("rec", "start", "end")
    return judged.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= per_kind)


def truncated_records(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.size("pred_tags") < F.size("tokens")).alias("truncated"))


def recall_gate(scored: DataFrame, least: float = 0.85) -> DataFrame:
    """One row: recall over all spans and whether a model may be released; without a score it may not."""
    return scored.filter("type = 'ALL'").agg(F.max("recall").alias("recall")).select("recall", F.coalesce(F.col("recall") >= least, F.lit(False)).alias("released"))

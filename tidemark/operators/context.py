"""Context features of plays and a baseline that predicts skips from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.listening import with_sessions


def context_features(plays: DataFrame, by: list[str], tie: str = "seq") -> DataFrame:
    """Hour on a circle, place in the session, skips and length so far, what came before, completion of the last five."""
    s = with_sessions(plays, by, tie=tie)
    w, inside = Window.partitionBy(*by).orderBy("ts", tie), Window.partitionBy(*by, "session").orderBy("ts", tie)
    skipped = F.coalesce(F.col("skipped").cast("int"), F.lit(0))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    angle = F.col("hour") * (2 * math.pi / 24)
    return s.withColumns({
        "hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "weekday": F.weekday("local_ts"),
        "session_position": F.row_number().over(inside).cast("long"),
        "session_ms_so_far": F.coalesce(F.sum("ms_played").over(before), F.lit(0)),
        "skips_this_session": F.coalesce(F.sum(skipped).over(before), F.lit(0)).cast("long"),
        "prev_skipped": F.coalesce(F.lag(skipped).over(w), F.lit(0)),
        "prev_ms": F.coalesce(F.lag("ms_played").over(w), F.lit(0)),
        "completion_last_5": F.avg(1.0 - skipped).over(w.rowsBetween(-5, -1)),
    })


def skip_baseline(features: DataFrame, seed: int = 7) -> DataFrame:
    """(accuracy, auc, base_rate, rows) of a logistic regression on held-out rows; split by a hash, so reruns agree."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    names = ["hour_sin", "hour_cos", "weekday", "prev_skipped", "session_position"]
    rows = features.select(*[F.col(c).cast("double") for c in names], F.col("skipped").cast("double").alias("label"), F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(5)).alias("fold")).filter("label is not null")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    scored = LogisticRegression(maxIter=20).fit(rows.filter("fold <> 0")).transform(rows.filter("fold = 0"))
    auc = BinaryClassificationEvaluator().evaluate(scored)
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.lit(auc).alias("auc"), F.avg("label").alias("base_rate"), F.count("*").alias("rows"))

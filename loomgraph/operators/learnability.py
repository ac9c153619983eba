"""How well types can be told from words: one linear model for each type over hashed words, measured on the examples kept back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import metrics
from loomgraph.operators.sequences import ordered_split


def report(examples: DataFrame, key: str, tokens: str, label: str, types: list[str], share: float = 0.8, hashed: int = 1 << 14) -> DataFrame:
    """(type, auc, average_precision, correct, positive, negative) of each of the types, a list by design; examples (key a long, tokens array, label).

    The first share of the examples by key trains, the rest measures. A type without positive and negative examples in both parts has no row. Rare
    types weigh as much as their complement. A stand-in for a neural classifier: same inputs and measures, other model.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = HashingTF(inputCol="words", outputCol="features", numFeatures=hashed, binary=True).transform(examples.select(F.col(key).alias("k"), F.col(tokens).alias("words"), F.col(label).alias("label_name")))
    parts = storage.cut(ordered_split(rows.select("k", "features", "label_name").withColumn("g", F.lit(0)), "g", "k", share).drop("g"), "learn")
    out = None
    for t in types:
        own = parts.withColumn("y", F.coalesce((F.col("label_name") == t).cast("double"), F.lit(0.0)))
        n = {(r["part"], r["y"]): r["count"] for r in own.groupBy("part", "y").count().collect()}
        if any(not n.get((p, y)) for p in ("train", "dev") for y in (0.0, 1.0)):
            continue
        weight = F.when(F.col("y") == 1, n["train", 0.0] / n["train", 1.0]).otherwise(1.0)
        fitted = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=20, regParam=0.01).fit(own.where("part = 'train'").withColumn("w", weight))
        scored = fitted.transform(own.where("part = 'dev'")).select(F.lit(t).alias("annotator"), F.col("y").cast("int").alias("y"), F.round(F.element_at(_array("rawPrediction"), 2), 9).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return examples.sparkSession.createDataFrame([], "type string, auc double, average_precision double, correct double, positive long, negative long")
    out = storage.cut(out, "scored")
    plain = out.groupBy("annotator").agg(F.avg(((F.col("score") >= 0) == (F.col("y") == 1)).cast("int")).alias("correct"), F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"))
    joined = plain.join(metrics.auc(out, "annotator"), "annotator").join(metrics.average_precision(out, "annotator"), "annotator")
    return joined.select(F.col("annotator").alias("type"), "auc", "average_precision", F.round("correct", 6).alias("correct"), "positive", "negative")


def _array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))

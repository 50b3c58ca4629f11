"""Learners of approval: frequencies, chains, logistic regression and boosted trees on proposals, their blend and a cascade.

decisions: (doc_id, approved, and categorical columns). Fitted on rows that the caller chooses, applied to others;
`backtest` refits them block by block, so that each decision is scored by what was decided before its block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prediction import frequency_scores, markov_scores


def encoder(columns: list[str]) -> list:
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_i" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_h" for c in columns])
    return [index, hot, VectorAssembler(inputCols=hot.getOutputCols(), outputCol="features")]


def _scored(model, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).select("doc_id", vector_to_array("probability")[1].alias(name))


def logistic(train: DataFrame, rows: DataFrame, columns: list[str], name: str = "p") -> DataFrame:
    """(doc_id, p)."""
    data = train.withColumn("label", F.col("approved").cast("double"))
    return _scored(Pipeline(stages=[*encoder(columns), LogisticRegression(regParam=0.01, maxIter=50)]).fit(data), rows, name)


def boosted(train: DataFrame, rows: DataFrame, columns: list[str], name: str = "p", trees: int = 20, depth: int = 3) -> DataFrame:
    """(doc_id, p)."""
    data = train.withColumn("label", F.col("approved").cast("double"))
    return _scored(Pipeline(stages=[*encoder(columns), GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7)]).fit(data), rows, name)


def blend(parts: list[tuple[DataFrame, float]], margin: float | None = None) -> DataFrame:
    """(doc_id, p): the weighted mean; with a margin, the first learner that is at least so far from one half instead."""
    df = parts[0][0].select("doc_id", F.col("p").alias("p0"))
    for i, (part, _) in enumerate(parts[1:], 1):
        df = df.join(part.select("doc_id", F.col("p").alias(f"p{i}")), "doc_id")
    mean = sum((F.col(f"p{i}") * w for i, (_, w) in enumerate(parts)), F.lit(0.0)) / sum(w for _, w in parts)
    if margin is not None:
        mean = F.coalesce(*(F.when(F.abs(F.col(f"p{i}") - 0.5) >= margin, F.col(f"p{i}")) for i in range(len(parts))), mean)
    return df.select("doc_id", mean.alias("p"))


#: A learner gives (doc_id, p) of rows after learning from decisions.
Learner = Callable[[DataFrame, DataFrame], DataFrame]
#: Weights of a blend.
BLEND = {"frequency": 0.5, "logistic": 1.0, "boosted": 1.0, "markov": 0.8}


def learners(columns: list[str]) -> dict[str, Learner]:
    """The learners by name, for decisions with key, tags, steps and the categorical columns."""
    return {
        "frequency": frequency_scores, "markov": lambda known, rows: markov_scores(known, "steps", rows=rows),
        "logistic": lambda known, rows: logistic(known, rows, columns), "boosted": lambda known, rows: boosted(known, rows, columns),
    }


def backtest(decisions: DataFrame, chosen: dict[str, Learner], blocks: int) -> DataFrame:
    """(learner, block, doc_id, approved, p) of all decisions but those of block 0; decisions has a column block from 0 to blocks - 1, in order of time.

    Each block is scored by learners that saw all blocks before it and no other; a block of one class so far, or none,
    leaves them at the share of approvals. `blend` is the weighted mean of those that have a weight.
    """
    out = None
    for b in range(1, blocks):
        known, rows = decisions.where(F.col("block") < b), decisions.where(F.col("block") == b)
        share = known.agg(F.coalesce(F.avg("approved"), F.lit(0.5)).alias("share"), F.countDistinct("approved").alias("classes")).first()
        scored = {name: f(known, rows).select("doc_id", "p") if share.classes == 2 else rows.select("doc_id", F.lit(share.share).alias("p")) for name, f in chosen.items()}
        weights = [(scored[n], w) for n, w in BLEND.items() if n in scored]
        if len(weights) > 1:
            scored["blend"] = blend(weights)
        for name, part in scored.items():
            one = part.join(rows.select("doc_id", "approved"), "doc_id").select(F.lit(name).alias("learner"), F.lit(b).alias("block"), "doc_id", "approved", "p")
            out = one if out is None else out.unionByName(one)
    return out


def tested(scored: DataFrame) -> DataFrame:
    """(learner, block, n, correct, log_loss) of the rows of `backtest`."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    hit = F.when(F.col("approved") == 1, p).otherwise(1 - p)
    return scored.groupBy("learner", "block").agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) == (F.col("approved") == 1)).alias("correct"), F.round(F.avg(-F.log(hit)), 6).alias("log_loss"))

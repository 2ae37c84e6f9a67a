"""Entry 3 (Python twin): claim classifier with a profit loss and typicality weights.

Cleaning (yes/no, bonus codes, -1 markers, drop incomplete), exact
stratified 80/20 split, market price over the TRAIN median, typicality
weights from train statistics, then boosted trees under the profit-weighted
logistic objective (F2) next to a plain logistic GBT baseline (pyspark.ml),
both evaluated on the test split by log loss and AUC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TreeConfig
from ..functions.objectives import logistic, profit_logistic_grad
from ..functions.scalar import fill_marker, require_all_except
from ..operators import metrics as MT
from ..operators import sampling as SP
from ..operators import trees as TR
from ..session import cut_lineage
from ..sources import standin as SI

FEATURES = ["kw", "clientage", "zip"]


def classifier_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    pol = SI.policy_view(spark, sf_dir).select(
        "polref", F.col("claim").isNotNull().cast("int").alias("label"), *FEATURES, "nm")
    pol = fill_marker(pol, ["kw"])
    # the split, the median, the statistics, the fits and the scores each read these rows: joined and split once
    pol = cut_lineage(require_all_except(pol, [*FEATURES, "nm"], exempt=["kw"]))
    st = cut_lineage(SP.stratified_split(pol, "polref", "label", 0.8, seed=42))
    train = st.filter(F.col("split") == "train")
    med = MT.exact_quantiles(train, "nm", [0.5], "polref").select("q_0").scalar()
    st = st.withColumn("market", F.col("nm") / med)
    return cut_lineage(MT.typicality(st, cut_lineage(MT.scaler_stats(train, FEATURES)), FEATURES, alpha=0.5))


def custom_trees(train: DataFrame, trees: TreeConfig) -> TR.TreeModel:
    """Boosted trees under the profit objective (F2)."""
    return TR.fit_trees(train, FEATURES, lambda p: profit_logistic_grad(p, "label", "market", "typicality"),
                        ["label", "market", "typicality"], trees)


def compare_models(spark: SparkSession, sf_dir: str, trees: TreeConfig = TreeConfig(),
                   baseline_iter: int = 100) -> DataFrame:
    """Test-split log loss and AUC of the custom-loss trees and the baseline."""
    df = classifier_frame(spark, sf_dir)
    train, test = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    model = custom_trees(train, trees)
    custom = model.predict(test, "margin").withColumn("prob", logistic(F.col("margin")))
    va, gbt = TR.gbt_baseline(train, FEATURES, "label", max_depth=trees.max_depth, step=trees.eta,
                              max_iter=baseline_iter, classifier=True)
    from pyspark.ml.functions import vector_to_array
    base = gbt.transform(va.transform(test)).withColumn("prob", vector_to_array("probability")[1])
    out = []
    for name, pred in (("custom_loss", custom), ("baseline", base)):
        pred = cut_lineage(pred.select("label", "prob"))  # both metrics read the scores: the trees are walked once
        ll = pred.agg(MT.log_loss(pred, "label", "prob").alias("log_loss"))
        out.append(ll.select(F.lit(name).alias("model"), "log_loss",
                             MT.auc(pred, "label", "prob").select("auc").scalar().alias("auc")))
    return out[0].unionByName(out[1])

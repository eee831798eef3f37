"""Queries over models that stay on Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import dataset, indicators, ml
from tidemark.plans.registry import query
from tidemark.plans.sql import pct, r, sql
from tidemark.sources import bars

H = bars.candles
ID = ["symbol", "interval", "ts"]
FEATURES = ["williams_r", "roc_12", "bb_pct", "pct_change_1"]


def rows(spark, d):
    return dataset.row_split(dataset.labelled(indicators.bands(indicators.momentum(H(spark, d))), 1, 0.5))


@query()
def boosted_scores(spark, d):
    """Direction and magnitude of each symbol's later rows, from models fitted on its earlier ones."""
    x = rows(spark, d)
    models = ml.fit_boosting(x.where("part = 'train'"), FEATURES)
    return ml.score(models, x.where("part = 'val'"), FEATURES).select(*ID, "prob_up", "prob_flat", "prob_down", "magnitude", "direction")


@query()
def permutation_importance(spark, d):
    x = rows(spark, d)
    models = ml.fit_boosting(x.where("part = 'train'"), FEATURES)
    return ml.permutation_importance(models, x.where("part = 'val'"), FEATURES)


@query(sql(f"""SELECT symbol, "interval", ts, {r('avg(prob_up)', 'prob_up')}, {r('avg(prob_down)', 'prob_down')}, {r('avg(magnitude)', 'magnitude')}, count(*)
    AS folds FROM model_predictions GROUP BY 1, 2, 3"""))
def fold_means(spark, d):
    return ml.fold_means(bars.model_predictions(spark, d), ID).select(*ID, "prob_up", "prob_down", "magnitude", "folds")


@query(
    sql(f"""WITH x AS (SELECT symbol, ts, {pct('close')} AS ret FROM candles_60), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b
        FROM x WHERE ret IS NOT NULL), l AS (SELECT symbol, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS lg FROM k WHERE b <= 500)
    SELECT symbol, count(*) AS n, {r('avg(ret)', 'mean')}, {r('stddev_pop(ret)', 'std')},
    {r('avg(ret * ret * ret) / (pow(stddev_pop(ret), 3) + 1e-10)', 'skew', 4)},
    {r('avg(ret * ret * ret * ret) / (pow(stddev_pop(ret), 4) + 1e-10)', 'kurtosis', 4)}, {r('corr(ret, lg)', 'autocorrelation')} FROM l GROUP BY 1
    HAVING count(*) >= 50""")
)
def symbol_statistics(spark, d):
    x = ml.symbol_statistics(H(spark, d).withColumn("ret", C.pct("close")))
    return x.withColumns({"skew": F.round("skew", 4), "kurtosis": F.round("kurtosis", 4)})


@query()
def symbol_clusters(spark, d):
    x = bars.user_candles(spark, d).withColumn("ret", C.pct("close"))
    return ml.clusters(ml.symbol_statistics(x, least=8), 3).select("symbol", "n", "mean", "std", "cluster")


@query(
    sql(f"""WITH c AS (SELECT *, close * 2 + 1 AS twin, -close AS mirror FROM candles_60) SELECT a, b, round(r, 4) AS r FROM (SELECT 'close' AS a, 'twin' AS b,
        corr(close, twin) AS r FROM c UNION ALL SELECT 'close', 'mirror', corr(close, mirror) FROM c UNION ALL SELECT 'twin', 'mirror', corr(twin, mirror)
        FROM c
    UNION ALL SELECT 'open', 'close', corr(open, close) FROM c UNION ALL SELECT 'open', 'twin', corr(open, twin) FROM c UNION ALL SELECT 'open', 'mirror',
    corr(open, mirror) FROM c) WHERE abs(r) > 0.95""")
)
def feature_correlations(spark, d):
    x = H(spark, d).withColumns({"twin": F.col("close") * 2 + 1, "mirror": -F.col("close")})
    return ml.feature_correlations(x, ["open", "close", "twin", "mirror"])

"""Tree models: training by group-wise folds, and evaluation of a forest given as flat arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_folder


def completed(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with its features as doubles; where one is null or not a number it has the feature's median (0 where none has a value)."""
    real = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    middle = df.agg(*(F.percentile_approx(c, 0.5).alias(f) for f, c in real.items())).first()
    return df.withColumns({f: F.coalesce(c, F.lit(float(middle[f] or 0.0))) for f, c in real.items()})


def complete(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with a vector ``_x`` of its :func:`completed` features."""
    named = {f"_x{k}": f for k, f in enumerate(features)}
    filled = completed(df.withColumns({x: F.col(f) for x, f in named.items()}), list(named))
    return VectorAssembler(inputCols=list(named), outputCol="_x").transform(filled).drop(*named)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with weights ``_w`` that give both labels half of the whole."""
    share = df.agg(F.avg(label)).first()[0] or 0.5
    return df.withColumn("_w", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))


def ready_rows(df: DataFrame, features: list[str], label: str, most: int = 50_000) -> DataFrame:
    """:func:`complete` and :func:`balanced` rows, computed once and dealt by their values to tasks of some ``most`` rows at most.

    Every pass of a training reads all of them, so they are neither computed again nor left in the few parts that a small shuffle is put together to.
    """
    if {"_x", "_w"} <= set(df.columns):
        return df  # ready already
    known = settle(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // most))
    return settle(balanced(complete(known, features), label).repartition(parts, *df.columns).sortWithinPartitions(*df.columns))


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, *, forest: bool = False, trees: int = 10, depth: int = 4, least_rows: int = 1) -> DataFrame:
    """Each row's probability of label 1 by a model that has not seen its fold; classes are weighted to balance. No row is left out."""
    ready = ready_rows(df, features, label)
    out = None
    for k in range(folds):
        kind = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=least_rows) if forest else GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, minInstancesPerNode=least_rows)
        model = kind.setFeaturesCol("_x").setLabelCol(label).setWeightCol("_w").fit(ready.where(F.col(fold) != k))
        part = model.transform(ready.where(F.col(fold) == k)).withColumn("p", vector_to_array("probability")[1])
        part = part.select(*df.columns, "p")
        out = part if out is None else out.unionByName(part)
    return out


def trained_forest(df: DataFrame, features: list[str], label: str, *, trees: int = 25, depth: int = 8, least_rows: int = 1) -> RandomForestClassificationModel:
    """A random forest over balanced classes."""
    kind = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=least_rows, featuresCol="_x", labelCol=label, weightCol="_w")
    return kind.fit(ready_rows(df, features, label))


def forest_arrays(model: RandomForestClassificationModel) -> dict[str, list]:
    """A fitted forest as the flat arrays that :func:`flat_forest` reads; a leaf's value is its share of label 1.

    The model's own stored form is read back from the shared folder. It has trees x 2 ** (depth + 1) nodes at most, a bound of the model, not of data.
    """
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "roots")}
    base = 0
    for k, n in enumerate(nodes):
        if not k or n.treeID != nodes[k - 1].treeID:
            base = k
            out["roots"].append(k)
        inner = n.leftChild >= 0
        out["feature"].append(n.split.featureIndex if inner else 0)
        out["threshold"].append(n.split.leftCategoriesOrThreshold[0] if inner else 0.0)
        out["left"].append(base + n.leftChild if inner else -1)
        out["right"].append(base + n.rightChild if inner else -1)
        out["value"].append(n.impurityStats[1] / sum(n.impurityStats))
    return out


def shape_features(points: DataFrame, key: str, *, cell: float = 0.5, slice_: float = 0.4) -> DataFrame:
    """Features of each object of points (x, y, h, it): size on its own axes, height profile, roof and strength of return.

    The long axis is that of the largest spread. ``bump`` is how far the middle of the roofline, the highest points of slices
    along the long axis, stands over its ends; null where either lacks a slice. Everything is aggregates over the object's key.
    """
    c = points.groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"), F.percentile("h", F.array(*map(F.lit, (0.05, 0.5, 0.7, 0.95)))).alias("q"))
    turned = points.join(c.select(key, "cx", "cy", "q", (F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2).alias("turn")), key)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    p = turned.select(key, "cx", "cy", "q", "h", "it", (dx * F.cos("turn") + dy * F.sin("turn")).alias("u"), (dy * F.cos("turn") - dx * F.sin("turn")).alias("v"))
    top = F.col("h") >= F.col("q")[2]
    whole = p.groupBy(key).agg(
        F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("q").alias("q"), F.count("*").alias("n"), F.min("u").alias("u0"), (F.max("u") - F.min("u")).alias("length"), (F.max("v") - F.min("v")).alias("width"),
        F.stddev_pop("h").alias("hstd"), F.when(F.count(F.when(top, 1)) > 2, F.stddev_pop(F.when(top, F.col("h")))).otherwise(0.0).alias("roof_std"), F.avg((F.col("h") >= F.col("q")[3] - 0.3).cast("int")).alias("roof_frac"),
        F.avg("it").alias("i_mean"), F.stddev_pop("it").alias("i_std"), F.percentile("it", 0.9).alias("i_p90"),
    )
    cells = p.select(key, F.floor(F.col("u") / cell).alias("i"), F.floor(F.col("v") / cell).alias("j")).distinct().groupBy(key).agg((F.count("*") * cell * cell).alias("area"))
    long = F.greatest("length", F.lit(0.1))
    roof = p.join(whole.select(key, "u0", "length"), key).groupBy(key, "length", F.least(F.floor((F.col("u") - F.col("u0")) / slice_), F.lit(999)).alias("s")).agg(F.max("h").alias("roof"))
    at = (F.col("s") * slice_ + slice_ / 2) / long
    part = lambda where: F.median(F.when(where, F.col("roof")))
    line = roof.groupBy(key).agg((part((at > 0.3) & (at < 0.7)) - F.greatest(part(at <= 0.2), part(at >= 0.8))).alias("bump"))
    all_ = whole.join(cells, key).join(line, key)
    return all_.select(
        key, "bump", "roof_frac", "n", "length", "width", (F.col("length") / F.greatest("width", F.lit(0.1))).alias("ratio"), "area", (F.col("area") / F.greatest(F.col("length") * F.col("width"), F.lit(0.25))).alias("fill"),
        F.col("q")[3].alias("h95"), F.col("q")[1].alias("h50"), F.col("q")[0].alias("h05"), "hstd", "roof_std", (F.col("n") / F.greatest("area", F.lit(0.25))).alias("dens"), "i_mean", "i_std", "i_p90", "cx", "cy",
    )


def flat_forest(df: DataFrame, features: list[str], arrays: dict[str, list], out: str) -> DataFrame:
    """Evaluates a forest of flat arrays (feature, threshold, left, right, value, roots): the mean of its leaves' values.

    A node without a left child is a leaf; values at a threshold go left. All rows of a batch step down at once.
    """
    held = df.sparkSession.sparkContext.broadcast({k: np.asarray(v) for k, v in arrays.items()})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = held.value
        for f in frames:
            x = f[features].to_numpy(float)
            total = np.zeros(len(f))
            for root in a["roots"]:
                node = np.full(len(f), root)
                while (inner := a["left"][node] >= 0).any():
                    at = node[inner]
                    right = x[inner, a["feature"][at]] > a["threshold"][at]
                    node[inner] = np.where(right, a["right"][at], a["left"][at])
                total += a["value"][node]
            yield f.assign(**{out: total / max(1, len(a["roots"]))})

    return df.mapInPandas(work, df.withColumn(out, F.lit(0.0)).schema)

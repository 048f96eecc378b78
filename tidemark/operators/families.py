"""Families of risk detectors, their grids, nested out-of-fold scores, and frozen models.

Families that are linear in a basis (logistic models of features, products and B-splines, a Gaussian process and a
support vector machine by landmarks) are fitted for all folds and settings at once, see ``newton``; the machine's loss is the squared
hinge.  The others are Spark ML's: a random forest stands in for extra trees, gradient-boosted trees for both boosters.
Classes are balanced by weights (the perceptron and the Gaussian process take none).
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import detector as dt
from tidemark.operators import newton as nt
from tidemark.operators.newton import BasisFamily

#: The grids that are searched.
_C = (0.01, 0.1, 1.0, 10.0, 100.0)


@dataclass(frozen=True)
class Family:
    """A detector: the stages for some settings of it, and the settings to choose from."""

    stages: Callable[..., list]
    grid: dict[str, tuple] = field(default_factory=dict)
    margin: bool = False

    def settings(self) -> list[dict]:
        return [dict(zip(self.grid, v)) for v in itertools.product(*self.grid.values())]


def _linear(c: float = 1.0, mix: float = 0.0, col: str = "scaled", n: int = 1000):
    return LogisticRegression(featuresCol=col, labelCol="label", weightCol="weight", regParam=1 / (c * n), elasticNetParam=mix, standardization=False, maxIter=50)


def _scaled(of: str = "raw") -> StandardScaler:
    return StandardScaler(inputCol=of, outputCol="scaled", withMean=True)


def families(features: list[str], n: int) -> dict[str, Family]:
    """The families over feature columns, for about n training rows."""
    raw = VectorAssembler(inputCols=features, outputCol="raw")
    d, f = len(features), tuple(features)
    tree = dict(featuresCol="raw", labelCol="label", weightCol="weight", seed=11)
    return {
        "l2_logistic": BasisFamily(f, "linear", {"c": _C}),
        "elastic_net": Family(lambda c=1.0, mix=0.5: [raw, _scaled(), _linear(c, mix, n=n)], {"c": (0.3, 1.0, 3.0), "mix": (0.25, 0.75)}),
        "quadratic_logistic": BasisFamily(f, "quadratic", {"c": _C}),
        "additive_gam": BasisFamily(f, "spline", {"knots": (3, 4), "c": (0.1, 1.0, 10.0)}),
        "gaussian_process": BasisFamily(f, "kernel", {"width": (0.3, 0.7, 1.5)}, gaussian=True),
        "rbf_svm": BasisFamily(f, "kernel", {"c": (0.1, 1.0, 10.0, 100.0), "gamma": ("scale", 0.1, 0.5, 1.0, 2.0)}, loss="hinge"),
        "extra_trees": Family(lambda depth=4, leaf=2: [raw, RandomForestClassifier(numTrees=40, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", **tree)], {"depth": (2, 4), "leaf": (2, 5)}),
        "hist_gradient_boosting": Family(lambda rate=0.1, depth=3: [raw, GBTClassifier(maxIter=20, stepSize=rate, maxDepth=depth, **tree)], {"rate": (0.04, 0.1), "depth": (2, 3)}),
        "xgboost": Family(lambda: [raw, GBTClassifier(maxIter=30, stepSize=0.1, maxDepth=2, minInstancesPerNode=3, subsamplingRate=0.8, **tree)]),
        "mlp": Family(lambda: [raw, _scaled(), MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[d, 16, 8, 2], seed=11, maxIter=50)]),
    }


def balanced(rows: DataFrame) -> DataFrame:
    """rows with label and the weight that makes both classes count alike."""
    n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    p = max(int(n["p"] or 0), 1)
    return rows.withColumn("label", F.col("y").cast("double")).withColumn("weight", F.when(F.col("y") == 1, n["n"] / (2 * p)).otherwise(n["n"] / (2 * max(n["n"] - p, 1))))


def fit(family: Family | BasisFamily, rows: DataFrame, **settings) -> PipelineModel | nt.Model:
    if isinstance(family, BasisFamily):
        return nt.fit_parts(rows, [(family, settings, (-1, -1))])[0]
    return Pipeline(stages=family.stages(**settings)).fit(balanced(rows))


def predict(family: Family | BasisFamily, model: PipelineModel | nt.Model, rows: DataFrame) -> DataFrame:
    """rows with score: the probability of class 1, or the logistic of a margin."""
    if isinstance(model, nt.Model):
        return nt.score_parts(rows, [model], [(-1, -1)]).drop("option")
    out = model.transform(rows)
    score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])) if family.margin else vector_to_array("probability")[1]
    return out.select(*rows.columns, score.alias("score"))


def safe_splits(rows: DataFrame, wanted: int) -> int:
    """As many folds as the smaller class can fill, 2 at least."""
    n = rows.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p = int(n["p"] or 0)
    return max(2, min(wanted, p, int(n["n"]) - p))


def _dealt(rows: DataFrame, k: int, folds: int, salt: str) -> DataFrame:
    """rows with their outer fold, and their inner fold in the training part of each outer fold (-1 where they are held out)."""
    dealt = dt.stratified_folds(rows, k, f"outer{salt}").persist()
    out = dealt
    for o in range(k):
        train = dealt.filter(F.col("fold") != o).drop("fold")
        inner = dt.stratified_folds(train, safe_splits(train, folds), f"inner{salt}-{o}").select("doc_id", F.col("fold").alias(f"_i{o}"))
        out = out.join(inner, "doc_id", "left")
    return out.select(*dealt.columns, F.array(*(F.coalesce(f"_i{o}", F.lit(-1)) for o in range(k))).alias("inner"))


def _best(scored: DataFrame, by: list[tuple[int, int]], of: int) -> dict[int, int]:
    """For each outer fold the setting of the best mean average precision over its inner folds, the first of equal ones; by: (outer, setting) of each option."""
    aps = dt.metrics_by(scored.select("y", "score", "option"), ["option"]).select("option", F.coalesce("auprc", F.lit(0.0)).alias("ap")).collect()
    sums: dict[tuple, list] = {key: [] for key in by}
    for r in aps:
        sums[by[r["option"]]].append(r["ap"])
    mean = {key: round(sum(v) / max(len(v), 1), 12) for key, v in sums.items()}
    return {o: max(range(of), key=lambda s: (mean[o, s], -s)) for o in {o for o, _ in by}}


def nested_oof(family: Family | BasisFamily, rows: DataFrame, folds: int = 5, repeats: int = 1, inner: int = 4) -> tuple[DataFrame, list[dict]]:
    """(rows with the mean score of the models that did not see them, the settings chosen in each outer fold); rows have a unique doc_id.

    A family with a basis is fitted for all inner folds and settings of all outer folds in the same passes, and judged in one plan.
    """
    k, options, parts, chosen = safe_splits(rows, folds), family.settings(), None, []
    for r in range(repeats):
        dealt = _dealt(rows, k, inner, str(r)).persist()
        splits = [safe_splits(dealt.filter(F.col("fold") != o), inner) for o in range(k)]
        tries = [(o, i, s) for o in range(k) for i in range(splits[o]) for s in range(len(options))] if len(options) > 1 else []
        by = [(o, s) for o, _, s in tries]
        pick = dict.fromkeys(range(k), 0)
        if tries and isinstance(family, BasisFamily):
            models = nt.fit_parts(dealt, [(family, options[s], (o, i)) for o, i, s in tries])
            pick = _best(nt.score_parts(dealt, models, [(o, i) for o, i, _ in tries]), by, len(options))
        elif tries:
            scored = None
            for n, (o, i, s) in enumerate(tries):
                train, test = (dealt.filter((F.col("fold") != o) & same(F.col("inner")[o], i)) for same in (lambda c, v: c != v, lambda c, v: c == v))
                part = predict(family, fit(family, train, **options[s]), test).select("y", "score", F.lit(n).alias("option"))
                scored = part if scored is None else scored.unionByName(part)
            pick = _best(scored, by, len(options))
        chosen += [options[pick[o]] for o in range(k)]
        if isinstance(family, BasisFamily):
            models = nt.fit_parts(dealt, [(family, options[pick[o]], (o, -1)) for o in range(k)])
            found = [nt.score_parts(dealt, models, [(o, -1) for o in range(k)]).drop("option", "fold", "inner")]
        else:
            found = [predict(family, fit(family, dealt.filter(F.col("fold") != o), **options[pick[o]]), dealt.filter(F.col("fold") == o)).drop("fold", "inner") for o in range(k)]
        for part in found:
            parts = part if parts is None else parts.unionByName(part)
    keys = [c for c in rows.columns if c != "score"]
    return parts.groupBy(*keys).agg(F.avg("score").alias("score")), chosen


class Folder:
    """Files of a folder in any file system that Spark can write to."""

    def __init__(self, spark, folder: str):
        self.jvm, self.root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.setVerifyChecksum(False)
        self.fs.setWriteChecksum(False)

    def put(self, name: str, data: bytes) -> None:
        out = self.fs.create(self.jvm.org.apache.hadoop.fs.Path(self.root, name), True)
        out.write(bytearray(data))
        out.close()

    def get(self, name: str) -> bytes:
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.root, name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self) -> list[str]:
        top, found, files = self.fs.makeQualified(self.root).toUri().getPath(), [], self.fs.listFiles(self.root, True)
        while files.hasNext():
            found.append(files.next().getPath().toUri().getPath()[len(top) :].lstrip("/"))
        return sorted(n for n in found if not n.endswith(".crc") and n != "lock.json")


def freeze(spark, model: PipelineModel | nt.Model, threshold: float, references: dict, folder: str) -> dict:
    """Write a model with its threshold and references, and a lock with the digest of every file."""
    at = Folder(spark, folder)
    if isinstance(model, nt.Model):
        at.put("basis.json", nt.dumped(model).encode())
    else:
        model.write().overwrite().save(f"{folder}/model")
    at.put("detector.json", json.dumps({"threshold": threshold, "references": references}, sort_keys=True).encode())
    lock = {name: hashlib.sha256(at.get(name)).hexdigest() for name in at.names()}
    at.put("lock.json", json.dumps(lock, indent=1, sort_keys=True).encode())
    return lock


def thaw(spark, folder: str) -> tuple[PipelineModel | nt.Model, float, dict]:
    """(model, threshold, references) of a frozen detector; fails if a file is not the one that was locked."""
    at = Folder(spark, folder)
    lock = json.loads(at.get("lock.json"))
    for name, digest in lock.items():
        if hashlib.sha256(at.get(name)).hexdigest() != digest:
            raise ValueError(f"{name} is not what was frozen")
    kept = json.loads(at.get("detector.json"))
    model = nt.loaded(at.get("basis.json").decode()) if "basis.json" in lock else PipelineModel.load(f"{folder}/model")
    return model, kept["threshold"], kept["references"]

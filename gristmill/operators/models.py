"""Model families as Spark ML pipelines, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as G
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_words
from ..sources.shared import persisted
from .neighbours import nearest
from .ranks import ranked

#: The most training rows a family is tried on in a search; none where it takes any.
ROW_LIMITS = {"knn": 100_000}
#: Different rows up to which features are fitted on folded rows: their medians are exact, and one task sorts so many values.
FEW_ROWS = 1_000_000


def estimator(family: str, task: str, params: dict | None = None, valid: str | None = None, label: str = "label"):
    """An unfitted estimator over ``features``."""
    own = {"featuresCol": "features", "labelCol": label} | (params or {})
    regression = task == "regression"
    if family == "boosted":
        make = G.GBTRegressor if regression else C.GBTClassifier
        own = {"maxIter": 30, "maxDepth": 4, "seed": 42} | own | ({"validationIndicatorCol": valid} if valid else {})
        return C.OneVsRest(classifier=make(**own), labelCol=label) if task == "multiclass" else make(**own)
    if family == "forest":
        make = G.RandomForestRegressor if regression else C.RandomForestClassifier
        return make(**({"numTrees": 50, "maxDepth": 8, "seed": 42} | own))
    if family == "linear":
        return G.LinearRegression(**({"elasticNetParam": 0.0, "regParam": 0.01} | own)) if regression else C.LogisticRegression(**({"maxIter": 50, "regParam": 0.001} | own))
    if family == "lasso" and regression:
        return G.LinearRegression(**({"elasticNetParam": 1.0, "regParam": 0.01} | own))
    if family == "quick_linear":
        return G.LinearRegression(**({"maxIter": 5, "regParam": 0.01} | own)) if regression else C.LogisticRegression(**({"maxIter": 5} | own))
    if family == "svm" and task == "binary":
        return C.LinearSVC(**({"maxIter": 30, "regParam": 0.01} | own))
    if family == "naive_bayes" and not regression:
        return C.NaiveBayes(**({"modelType": "complement"} | own))
    raise ValueError(f"no family {family} for {task}")


def features(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Imputed, standardised numbers and one-hot levels (unknown ones kept apart), as ``features``."""
    stages = []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"_n_{c}" for c in numeric]), VectorAssembler(inputCols=[f"_n_{c}" for c in numeric], outputCol="_numeric"), StandardScaler(withMean=True, inputCol="_numeric", outputCol="_scaled")]
    if categorical:  # one pass counts the levels of all columns
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], handleInvalid="keep"))
    inputs = (["_scaled"] if numeric else []) + [f"_o_{c}" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")])


def pipeline(numeric: Sequence[str], categorical: Sequence[str], family: str, task: str, params: dict | None = None, valid: str | None = None, label: str = "label") -> Pipeline:
    """The features, then the family."""
    return Pipeline(stages=[*features(numeric, categorical).getStages(), estimator(family, task, params, valid, label)])


def folded(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows that agree in ``columns`` as one, with how many they are as ``weight``: what learns from weighted rows learns the same, and its passes
    cost what different rows cost. Where hardly any are equal it is one shuffle in vain. ``weight`` names how many a row stands for already."""
    return rows.groupBy(*columns).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("weight"))


def folded_features(few: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PipelineModel:
    """The fitted :func:`features` of rows that ``few`` holds folded, with ``weight``: medians, means, deviations and frequencies are worked out from
    weights, and the stages are fitted on rows that have just these. Medians are exact, where those of all rows are to a thousandth of the ranks."""
    spark, stages, w = few.sparkSession, [], F.col("weight")
    own = features(numeric, categorical).getStages()
    if numeric:
        imputer, together, scaler = own[:3]
        known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in numeric]
        medians = few.select("weight", *known).agg(*(F.percentile(F.col(c), F.lit(0.5), w.cast("long")).alias(c) for c in numeric))
        stages += [imputer.fit(spark.createDataFrame([tuple(medians.first())], ", ".join(f"`{c}` double" for c in numeric))), together]
        filled = stages[0].transform(few.select("weight", *(F.col(c).cast("double").alias(c) for c in numeric)))
        values = [F.col(f"_n_{c}") for c in numeric]
        total, *sums = filled.agg(F.sum(w), *(F.sum(v * w) for v in values)).first()
        means = [s / total for s in sums]
        squares = filled.agg(*(F.sum(w * (v - m) * (v - m)) for v, m in zip(values, means, strict=True))).first()
        half = [(s / max(1.0, total - 1) / 2) ** 0.5 for s in squares]  # two values so far from their mean deviate as all do
        pair = [(Vectors.dense([m + sign * h for m, h in zip(means, half, strict=True)]),) for sign in (-1, 1)]
        stages.append(scaler.fit(spark.createDataFrame(pair, ["_numeric"])))
    if categorical:
        counts = [few.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.sum(w).alias("n")).collect() for c in categorical]  # as many levels as the stage holds
        shaped = few
        for c, found in zip(categorical, counts, strict=True):  # one model a column: made of lists of two lengths, a common one has null levels
            labels = [r.level for r in sorted(found, key=lambda r: (-r.n, r.level))]
            stages.append(StringIndexerModel.from_labels(labels, c, f"_i_{c}", "keep"))
            shaped = stages[-1].transform(shaped)
        stages.append(own[-2].fit(shaped))
    return PipelineModel([*stages, own[-1]])


def fit_folded(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], family: str, task: str, params: dict | None = None, valid: str | None = None, label: str = "label", weight: str | None = None) -> PipelineModel:
    """The fitted :func:`pipeline`, on equal rows folded into weighted ones: one pass over the rows. Where more than FEW_ROWS are different, features
    are fitted on all rows, a row of ``weight`` n being n of them.

    Bootstraps, subsamples and the least instances of a node then go by different rows, not by copies.
    """
    few = persisted(folded(rows, [*numeric, *categorical, label, *([valid] if valid else [])], weight), "folded")
    if 0 < few.count() <= FEW_ROWS:
        made = folded_features(few, numeric, categorical)
    else:
        made = features(numeric, categorical).fit(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("long")))) if weight else rows)
    return PipelineModel([*made.stages, estimator(family, task, {"weightCol": "weight"} | (params or {}), valid, label).fit(made.transform(few))])


def predictions(model: PipelineModel, df: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """The rows with ``prediction`` and, where the model has them, ``prob_<label>``; a narrow map that streams take too."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumns({f"prob_{name}": p[i] for i, name in enumerate(labels)})
    return out.select(*df.columns, "prediction", *(f"prob_{name}" for name in labels if f"prob_{name}" in out.columns))


def staged(make: Callable[[int], Pipeline], rounds: int, train: DataFrame, valid: DataFrame, loss: str) -> tuple[PipelineModel, list[float]]:
    """A boosted pipeline cut at the round with the smallest loss on ``valid``, and the loss after each round.

    Rounds do not depend on how many follow, so the cut model is the one that is fitted with so many rounds.
    """
    model = make(rounds).fit(train)
    before = valid
    for stage in model.stages[:-1]:
        before = stage.transform(before)
    errors = list(model.stages[-1].evaluateEachIteration(before, loss))
    best = 1 + min(range(len(errors)), key=errors.__getitem__)
    return (model if best == rounds else make(best).fit(train)), errors


def knn(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, label, votes): the most frequent label of the k nearest; ``train`` has (id, vec, label), ``queries`` (query, vec).

    Of labels with equal votes the smallest is taken. Tables of any size do: see :func:`.neighbours.nearest`.
    """
    near = nearest(queries, train, k, carry="label")
    votes = near.groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))


def importances(model: PipelineModel, transformed: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances by source column of :func:`pipeline`, normalised, largest first; columns that are never split on have 0."""
    attributes = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", "") for group in attributes.values() for a in group}
    sources = {f"_scaled_{i}": c for i, c in enumerate(numeric)}
    totals = dict.fromkeys([*numeric, *categorical], 0.0)
    for i, v in enumerate(model.stages[-1].featureImportances.toArray()):
        found = sources.get(names[i]) or max((c for c in categorical if names[i].startswith(f"_o_{c}_")), key=len)
        totals[found] += float(v)
    total = sum(totals.values()) or 1.0
    return sorted(((k, v / total) for k, v in totals.items()), key=lambda x: -x[1])


def dealt_anew(df: DataFrame, columns: Sequence[str], key: str, draw: int) -> DataFrame:
    """The rows with ``_new``: the columns' values of the row that has their place in another order. Both orders are ranks by hashes of the
    key, so rows meet by a join, and no task holds them all."""
    place = lambda salt, name: ranked(df.withColumn("_h", F.pmod(F.xxhash64(F.lit(salt), F.lit(draw), key), F.lit(1 << 40)) / F.lit(float(1 << 40))), F.col("_h"), [F.col(key)], name=name).drop("_h")
    values = place(1, "_to").select("_to", F.struct(*columns).alias("_new"))
    return place(0, "_from").join(values, F.col("_from") == F.col("_to")).select(*df.columns, "_new")


def shuffled(df: DataFrame, column: str, key: str, draw: int) -> DataFrame:
    """The rows with one column's values dealt out anew, see :func:`dealt_anew`."""
    return dealt_anew(df, [column], key, draw).withColumn(column, F.col("_new")[column]).select(*df.columns)


def permutation_importance(model: PipelineModel, rows: DataFrame, columns: Sequence[str], key: str, score, repeats: int = 3) -> list[tuple[str, float]]:
    """Mean loss of ``score(predictions)`` when a column is shuffled over all ``rows``, not below 0; ``key`` tells rows apart, and ``columns`` are
    all that the model reads. ``score`` gets equal rows as one, with ``weight``. Orders do not depend on the column: each is worked out once."""
    label = "label"
    rows = persisted(rows.select(*columns, label, key), "to-shuffle")
    own = [*columns, label]
    base = score(model.transform(folded(rows, own)))
    lost = dict.fromkeys(columns, 0.0)
    for i in range(repeats):
        dealt = persisted(dealt_anew(rows, columns, key, i), "dealt")
        for c in columns:
            lost[c] += base - score(model.transform(folded(dealt.withColumn(c, F.col("_new")[c]), own)))
    return sorted(((c, max(0.0, v / repeats)) for c, v in lost.items()), key=lambda x: -x[1])


def presence_weights(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(term, weight): how much a word's presence speaks for label 1, as the logarithm of its smoothed shares of the texts of either label."""
    sizes = docs.agg(F.count_if(F.col(label) == 1).alias("_one"), F.count_if(F.col(label) != 1).alias("_zero"))
    terms = docs.select(F.col(label).alias("_label"), F.explode(F.array_distinct(unicode_words(F.col(text)))).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(F.col("_label") == 1).alias("_in_one"), F.count_if(F.col("_label") != 1).alias("_in_zero"))
    share = lambda n, of: F.log((F.col(n) + 1) / (F.col(of) + 2))
    return counts.crossJoin(F.broadcast(sizes)).select("term", (share("_in_one", "_one") - share("_in_zero", "_zero")).alias("weight"))  # sizes are one row


def token_weights(weights: DataFrame, k: int = 20) -> DataFrame:
    """The k terms of the largest absolute weight, of (term, weight)."""
    return weights.orderBy(F.desc(F.abs("weight")), "term").limit(k)

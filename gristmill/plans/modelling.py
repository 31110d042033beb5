"""Queries that fit models, and of streams.

Fitted numbers differ between engines, so these queries report what does not: which rows were learned from and scored, how
the truth spreads, and whether the fit stays within a stated bound. SQL works out the first two from the same tables.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_sql
from ..operators import extra_trees as E
from ..operators import features as X
from ..operators import halving as H
from ..operators import models as O
from ..operators import runlog as L
from ..operators import search as K
from ..operators import sgd as D
from ..operators import split as S
from ..sources.shared import new_path, persisted
from ..streaming import follow as W
from .registry import query, table

NUMERIC, CATEGORICAL = ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]
_KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
#: A line's price in units of quantity, its block by draw, and a second draw.
_LINES = f"l AS (SELECT *, l_quantity * (1 - l_discount) * (1 + l_tax) AS label, {uniform_sql(_KEY, 'lines')} AS d, {uniform_sql(_KEY, 'r')} AS r FROM lineitem), b AS (SELECT *, CASE WHEN d < 0.7::DOUBLE THEN 0 WHEN d < 0.85::DOUBLE THEN 1 ELSE 2 END AS split FROM l)"
#: Leaves of quantity of the plain tree that families of trees are held against.
_LEAVES = "floor((l_quantity - 1) / 12.5)"


def _lines(spark, sf_dir):
    """lineitem with a draw, a block and a label."""
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    label = F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select(*NUMERIC, *CATEGORICAL, label.alias("label"), uniform(key, "lines").alias("d"), uniform(key, "r").alias("r"))
    block = F.when(F.col("d") < 0.7, S.TRAIN).when(F.col("d") < 0.85, S.VALID).otherwise(S.TEST)
    return rows.select(*NUMERIC, *CATEGORICAL, "label", "r", block.alias("split"), (block == S.VALID).alias("valid"))


def _stored_lines(spark, sf_dir):
    """The lines written once, where several steps read each of them."""
    return persisted(_lines(spark, sf_dir), "lines")


def _rmse(model, rows, weight=None):
    return RegressionEvaluator(metricName="rmse", **({"weightCol": weight} if weight else {})).evaluate(model.transform(rows))


LINEAR = ("linear", "lasso", "quick_linear")


def _yardstick(train, test, family):
    """(yardstick): what a plain model misses by on the test block. For linear families it is the line through the quantity alone, for trees
    the mean of each of four leaves of quantity."""
    if family in LINEAR:
        line = train.agg(F.regr_slope("label", "l_quantity").alias("a"), F.regr_intercept("label", "l_quantity").alias("b"))
        rows = test.crossJoin(F.broadcast(line)).select("label", (F.col("a") * F.col("l_quantity") + F.col("b")).alias("p"))  # one row
    else:
        leaf = F.expr(_LEAVES).cast("long")
        means = train.groupBy(leaf.alias("leaf")).agg(F.avg("label").alias("p"))  # four rows
        rows = test.withColumn("leaf", leaf).join(F.broadcast(means), "leaf")
    error = F.col("p") - F.col("label")
    return rows.agg(F.sqrt(F.avg(error * error)).alias("yardstick"))


def _fitted(spark, sf_dir, family, params=None, valid=None):
    """Which rows were learned from and scored, what a plain model misses by, and whether the family does better."""
    rows = _stored_lines(spark, sf_dir)
    train, test = rows.where(F.col("split") <= (S.VALID if valid else S.TRAIN)), rows.where(F.col("split") == S.TEST)
    model = O.fit_folded(train, NUMERIC, CATEGORICAL, family, "regression", params, valid)
    error = F.col("prediction") - F.col("label")
    found = O.predictions(model, test).agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(error * error)).alias("error"))
    out = found.crossJoin(train.agg(F.count(F.lit(1)).alias("n_train"))).crossJoin(_yardstick(train, test, family))
    return out.select(F.lit(family).alias("family"), "n_train", "n_test", F.round("yardstick", 6).alias("yardstick"), (F.col("error") < F.col("yardstick")).alias("beats_it"))


def _fitted_sql(family: str, last: int = 0) -> str:
    plain = f"(SELECT regr_slope(label, l_quantity) AS a, regr_intercept(label, l_quantity) AS b FROM b WHERE split <= {last})" if family in LINEAR else f"(SELECT {_LEAVES} AS leaf, avg(label) AS m FROM b WHERE split <= {last} GROUP BY 1)"
    p = f"SELECT label, a * l_quantity + p.b AS p FROM b, {plain} p WHERE split = 2" if family in LINEAR else f"SELECT label, m AS p FROM b JOIN {plain} p ON {_LEAVES} = leaf WHERE split = 2"
    return f"WITH {_LINES}, p AS ({p}) SELECT '{family}' AS family, (SELECT count(*) FROM b WHERE split <= {last}) AS n_train, count(*) AS n_test, round(sqrt(avg((p - label) * (p - label))), 6) AS yardstick, true AS beats_it FROM p"


@query(_fitted_sql("boosted", 1))
def mod1_boosted_trees(spark, sf_dir):
    return _fitted(spark, sf_dir, "boosted", {"maxIter": 20, "maxDepth": 4, "stepSize": 0.3}, "valid")


@query(_fitted_sql("forest"))
def mod2_forest(spark, sf_dir):
    return _fitted(spark, sf_dir, "forest", {"numTrees": 20})


@query(_fitted_sql("extra_trees"))
def mod2_extra_trees(spark, sf_dir):
    """Thresholds are drawn, not taken from quantiles."""
    rows = _stored_lines(spark, sf_dir)
    train, test = rows.where(F.col("split") <= S.TRAIN), rows.where(F.col("split") == S.TEST)
    made = O.features(NUMERIC, CATEGORICAL).fit(train)
    shaped = lambda df, *more: made.transform(df).select("label", vector_to_array("features").alias("x"), F.array("label").alias("y"), *more)
    few = O.folded(train, [*NUMERIC, *CATEGORICAL, "label"])  # equal lines give the trees that one with their number does
    model = E.fit(persisted(shaped(few, F.col("weight").alias("n")), "shaped"), trees=10, depth=8)
    error = F.col("prediction") - F.col("label")
    found = E.predict(model, shaped(test)).agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(error * error)).alias("error"))
    out = found.crossJoin(train.agg(F.count(F.lit(1)).alias("n_train"))).crossJoin(_yardstick(train, test, "extra_trees"))
    return out.select(F.lit("extra_trees").alias("family"), "n_train", "n_test", F.round("yardstick", 6).alias("yardstick"), (F.col("error") < F.col("yardstick")).alias("beats_it"))


@query(_fitted_sql("linear"))
def mod3_linear(spark, sf_dir):
    return _fitted(spark, sf_dir, "linear")


@query(_fitted_sql("lasso"))
def mod3_lasso(spark, sf_dir):
    return _fitted(spark, sf_dir, "lasso")


@query(_fitted_sql("quick_linear"))
def mod4_quick_linear(spark, sf_dir):
    return _fitted(spark, sf_dir, "quick_linear")


def _flagged(spark, sf_dir):
    """The lines with a label of two classes."""
    return _as_flags(_stored_lines(spark, sf_dir))


def _as_flags(lines):
    return lines.withColumn("label", (F.col("label") > 25).cast("double"))


def _flag_model(spark, sf_dir, family="forest", params=None):
    rows = _flagged(spark, sf_dir)
    return rows, O.fit_folded(rows.where(F.col("split") == S.TRAIN), NUMERIC, CATEGORICAL, family, "binary", params or {"numTrees": 10, "maxDepth": 4})


def _folded_flag_model(spark, sf_dir, family="forest", params=None):
    """The model of :func:`_flag_model`, and the flagged lines folded by what it reads, label, block and ``unseen``, with ``weight``: lines are drawn
    and folded in one pass, and only the different ones are written."""
    rows = _as_flags(_lines(spark, sf_dir)).withColumn("unseen", F.col("r") < 0.1)
    few = persisted(O.folded(rows, [*NUMERIC, *CATEGORICAL, "label", "split", "unseen"]), "flags")
    return few, O.fit_folded(few.where(F.col("split") == S.TRAIN), NUMERIC, CATEGORICAL, family, "binary", params or {"numTrees": 10, "maxDepth": 4}, weight="weight")


def _times(condition):
    """How many lines of folded ones meet a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("weight"))), F.lit(0.0)).cast("long")


def _share_right():
    return F.sum((F.col("label") == F.col("prediction")).cast("double") * F.col("weight")) / F.sum("weight")


_FLAGGED = f"WITH {_LINES}, f AS (SELECT *, label > 25 AS flag FROM b)"


@query(f"{_FLAGGED} SELECT count(*) AS n_test, count(*) FILTER (flag) AS n_positive, true AS within_bound FROM f WHERE split = 2")
def mod3_logistic(spark, sf_dir):
    """Within bound: at least nine of ten classes are right."""
    rows, model = _folded_flag_model(spark, sf_dir, "linear", {"maxIter": 30})
    out = O.predictions(model, rows.where(F.col("split") == S.TEST))
    return out.agg(_times(F.lit(True)).alias("n_test"), _times(F.col("label") == 1).alias("n_positive"), (_share_right() >= 0.9).alias("within_bound"))


def _written(spark, sf_dir):
    """Texts with a language, and whether it is English: what a text model has to tell from words."""
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    return X.spread(docs.select("doc_id", "text", (F.col("lang") == "en").cast("double").alias("label")), "doc_id", "text")


_WRITTEN = "t AS (SELECT doc_id, lang = 'en' AS english, doc_id % 5 = 0 AS test FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)"
#: The share of the commonest answer among the texts that are scored: what a model without words would get.
_MAJORITY = "greatest(avg(english::INT) FILTER (test), 1 - avg(english::INT) FILTER (test))"


def _text_report(scored, family):
    """How many texts are scored and English, the majority's share, and whether the model halves the majority's error."""
    right, english = F.avg((F.col("label") == F.col("prediction")).cast("double")), F.avg("label")
    majority = F.greatest(english, 1 - english)
    return scored.agg(F.lit(family).alias("family"), F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == 1).alias("n_english"), F.round(majority, 9).alias("majority"), (1 - right < 0.5 * (1 - majority)).alias("halves_error"))


_TEXT_REPORT = f"count(*) FILTER (test) AS n_test, count(*) FILTER (test AND english) AS n_english, round({_MAJORITY}, 9) AS majority, true AS halves_error FROM t"


@query(f"WITH {_WRITTEN} SELECT family, {_TEXT_REPORT}, (VALUES ('linear'), ('naive_bayes'), ('sgd'), ('svm')) f(family) GROUP BY family")
def mod6_text_models(spark, sf_dir):
    """Linear families on TF-IDF vectors of texts that were held out; each halves the error of always giving the commonest answer."""
    rows = persisted(_written(spark, sf_dir), "written")
    train, test = rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")
    vectors = X.tf_idf_vectors("text").fit(train)
    paths = {name: new_path(spark, name) for name in ("train", "test")}
    for part, path in zip((train, test), paths.values()):
        vectors.transform(part).select("label", "features").write.parquet(path)
    train, test = (spark.read.parquet(path) for path in paths.values())
    out = None
    for family in ("linear", "naive_bayes", "sgd", "svm"):
        if family == "sgd":
            learned, asked = (X.entries(paths[name], "features", df) for name, df in (("train", train), ("test", test)))
            scored = D.predict(D.fit(learned, len(X.vocabulary(vectors)), "hinge"), asked)
        else:
            params = {"linear": {"maxIter": 20}, "svm": {"maxIter": 20}}.get(family)
            scored = O.estimator(family, "binary", params).fit(train).transform(test)
        part = _text_report(scored, family)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_WRITTEN} SELECT 'sgd' AS family, {_TEXT_REPORT}")
def mod7_hashed_text_model(spark, sf_dir):
    """Two epochs of mini-batches over 2**20 hashed words and pairs, which need no pass over the texts to be made."""
    rows = persisted(X.hashed_text(_written(spark, sf_dir), "text", 20).select("doc_id", "label", "indices", "values"), "hashed")
    model = D.fit(rows.where("doc_id % 5 <> 0"), 1 << 20)
    return _text_report(D.predict(model, rows.where("doc_id % 5 = 0")), "sgd")


_SEARCHED = _fitted_sql("searched", 1)


@query(_SEARCHED.replace("'searched' AS family", "'searched' AS family, 20 AS n_draws, true AS best_first").replace("AS n_train", "AS n_refitted"))
def mod8_random_search(spark, sf_dir):
    """Twenty draws, four fits at a time; the best parameters are fitted once more, on training and validation rows, and beat a plain tree."""
    rows = _stored_lines(spark, sf_dir)
    train, valid, test = (rows.where(F.col("split") == k) for k in (S.TRAIN, S.VALID, S.TEST))
    made = O.features(NUMERIC, CATEGORICAL).fit(train)
    # Equal lines are one weighted row: every draw's fit and score costs what different lines cost.
    shaped = lambda df, name: persisted(made.transform(O.folded(df, [*NUMERIC, *CATEGORICAL, "label"])).select("label", "features", "weight"), name)
    fit = lambda params, to: O.estimator("boosted", "regression", params | {"weightCol": "weight"}).fit(to)
    both, few, held = train.unionByName(valid), shaped(train, "train"), shaped(valid, "valid")
    space = {"maxDepth": (2, 5), "maxIter": (3, 8), "stepSize": (0.1, 0.6), "subsamplingRate": (0.5, 1.0), "minInstancesPerNode": (1, 20)}
    found = K.search(lambda params: -_rmse(fit(params, few), held, "weight"), float("inf"), 20, 4, space=space)
    error = F.col("prediction") - F.col("label")
    scored = fit(found[0].params, shaped(both, "both")).transform(made.transform(test)).agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(error * error)).alias("error"))
    out = scored.crossJoin(both.agg(F.count(F.lit(1)).alias("n_refitted"))).crossJoin(_yardstick(both, test, "searched"))
    best = F.lit(found[0].score == max(d.score for d in found))
    return out.select(F.lit("searched").alias("family"), F.lit(len(found)).alias("n_draws"), best.alias("best_first"), "n_refitted", "n_test", F.round("yardstick", 6).alias("yardstick"), (F.col("error") < F.col("yardstick")).alias("beats_it"))


def _halved(spark, sf_dir):
    rows = _stored_lines(spark, sf_dir)
    train, valid = rows.where(F.col("split") == S.TRAIN), rows.where(F.col("split") == S.VALID)
    n, held = train.count(), persisted(O.folded(valid, [*NUMERIC, *CATEGORICAL, "label"]), "valid")
    settings = {"linear": {}, "quick_linear": {}, "forest": {"numTrees": 5, "maxDepth": 4}}

    def fit_score(plan, size):
        sample = train if size >= n else train.where(F.col("r") < size / n)
        return _rmse(O.fit_folded(sample, NUMERIC, CATEGORICAL, plan, "regression", settings[plan]), held, "weight"), sample.count()

    return H.successive_halving(spark, [(p, p) for p in settings], n, fit_score, higher=False, min_rows=max(200, n // 16))


_RUNGS = f"WITH {_LINES}, n AS (SELECT count(*) AS n, greatest(200, count(*) // 16) AS m FROM b WHERE split = 0), g AS (SELECT 0 AS rung, least(m, n) AS fidelity_rows, 3 AS plans, false AS final FROM n UNION ALL SELECT 1, least(4 * m, n), 2, false FROM n UNION ALL SELECT 2, n, 1, true FROM n)"


@query(f"{_RUNGS} SELECT rung::BIGINT AS rung, fidelity_rows, plans::BIGINT AS plans, final, true AS chosen_last FROM g")
def halv1_successive_halving(spark, sf_dir):
    """Three plans, then two, then the better of them on all rows."""
    chosen, observed = _halved(spark, sf_dir)
    out = observed.groupBy(F.col("rung").cast("long").alias("rung"), "fidelity_rows", "final")
    return out.agg(F.count(F.lit(1)).alias("plans"), (F.count_if(F.col("final") & (F.col("plan") != chosen)) == 0).alias("chosen_last"))


@query(f"{_RUNGS} SELECT sum(plans)::BIGINT AS n_rows, sum(plans)::BIGINT AS n_scored, 3 AS n_plans, max(fidelity_rows) AS most_rows FROM g")
def halv6_observation_rows(spark, sf_dir):
    path = new_path(spark, "observations")
    _halved(spark, sf_dir)[1].write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.count("score").alias("n_scored"), F.countDistinct("plan").alias("n_plans"), F.max("fidelity_rows").alias("most_rows"))


@query("SELECT l_quantity, l_discount, l_tax FROM lineitem")
def score1_input_validation(spark, sf_dir):
    from ..operators.scoring import checked_columns, numeric

    df = table(spark, sf_dir, "lineitem").select(F.col("l_tax").cast("string").alias("l_tax"), "l_quantity", "l_discount", "l_orderkey")
    return numeric(checked_columns(df, NUMERIC, ["l_orderkey"]), NUMERIC).select("l_quantity", "l_discount", "l_tax")


@query(f"{_FLAGGED} SELECT count(*) AS n, count(*) FILTER (r < 0.1::DOUBLE) AS n_unseen, true AS as_before FROM f WHERE split = 2")
def score2_feature_replay(spark, sf_dir):
    """A stored model answers rows with levels that it has not seen, and all others as before it was stored."""
    from pyspark.ml import PipelineModel

    rows, model = _folded_flag_model(spark, sf_dir)
    path = new_path(spark, "model")
    model.save(path)
    # Equal rows are scored once: an answer hangs on what the model reads, and on whether its level is replaced.
    test = O.folded(rows.where(F.col("split") == S.TEST), [*NUMERIC, *CATEGORICAL, "unseen"], "weight")
    before = O.predictions(model, test, ["no", "yes"]).withColumnRenamed("prob_yes", "was").drop("prediction", "prob_no")
    odd = before.withColumn("l_returnflag", F.when(F.col("unseen"), "?").otherwise(F.col("l_returnflag")))
    out = O.predictions(PipelineModel.load(path), odd, ["no", "yes"])
    return out.agg(_times(F.col("prediction").isNotNull()).alias("n"), _times(F.col("unseen") & (F.col("l_returnflag") == "?")).alias("n_unseen"), F.every(F.col("unseen") | (F.abs(F.col("was") - F.col("prob_yes")) < 1e-9)).alias("as_before"))


@query(f"{_FLAGGED} SELECT count(*) AS n, count(*) FILTER (flag) AS n_positive, true AS shares, true AS within_bound FROM f WHERE split = 2")
def score3_batch_score(spark, sf_dir):
    """Probabilities are shares of one, the prediction has the larger one, and nine of ten are right."""
    rows, model = _folded_flag_model(spark, sf_dir)
    out = O.predictions(model, rows.where(F.col("split") == S.TEST), ["no", "yes"])
    shares = (F.abs(F.col("prob_no") + F.col("prob_yes") - 1) < 1e-9) & ((F.col("prob_yes") > F.col("prob_no")) == (F.col("prediction") == 1))
    return out.agg(_times(F.lit(True)).alias("n"), _times(F.col("label") == 1).alias("n_positive"), F.every(shares).alias("shares"), (_share_right() > 0.9).alias("within_bound"))


@query(f"{_FLAGGED} SELECT count(*) AS n, true AS equal FROM f WHERE split = 2")
def score4_parity(spark, sf_dir):
    """The area under the curve is the same when it is measured on the model's output and on the stored table."""
    rows, model = _flag_model(spark, sf_dir)
    test = rows.where(F.col("split") == S.TEST)
    trained = BinaryClassificationEvaluator(numBins=0).evaluate(model.transform(test))
    served = persisted(O.predictions(model, test, ["no", "yes"]), "served")
    from ..operators.metrics import auc

    found = auc(served, F.col("label") == 1, F.col("prob_yes")).select((F.abs(F.col("auc") - trained) < 1e-6).alias("equal"))
    return served.agg(F.count(F.lit(1)).alias("n")).crossJoin(found)


#: The number that the flag goes with most.
_TOP = f"{_FLAGGED}, c AS (SELECT 'l_quantity' AS name, abs(corr(l_quantity, flag::INT)) AS c FROM f UNION ALL SELECT 'l_discount', abs(corr(l_discount, flag::INT)) FROM f UNION ALL SELECT 'l_tax', abs(corr(l_tax, flag::INT)) FROM f)"
_NAMES = "SELECT name, c = (SELECT max(c) FROM c) AS is_top FROM c UNION ALL SELECT unnest(['l_returnflag', 'l_linestatus']), false"


@query(f"{_TOP} {_NAMES}")
def card1_importances(spark, sf_dir):
    rows, model = _folded_flag_model(spark, sf_dir)
    found = O.importances(model, model.transform(rows.limit(1)), NUMERIC, CATEGORICAL)
    if abs(sum(v for _, v in found) - 1) > 1e-9:
        raise ValueError("importances do not add up to one")
    return spark.createDataFrame([(name, i == 0) for i, (name, _) in enumerate(found)], "name string, is_top boolean")


#: How well a number alone ranks the flag on the test block, from mean ranks; its shuffling cannot cost much more or less than that.
_ALONE = "u AS (SELECT name, flag, rank() OVER (PARTITION BY name ORDER BY x) + (count(*) OVER (PARTITION BY name, x) - 1) / 2.0 AS rank FROM (SELECT flag, unnest(['l_quantity', 'l_discount', 'l_tax']) AS name, unnest([l_quantity, l_discount, l_tax]) AS x FROM f WHERE split = 2)), a AS (SELECT name, abs((sum(rank) FILTER (flag) - count(*) FILTER (flag) * (count(*) FILTER (flag) + 1) / 2.0) / (count(*) FILTER (flag) * count(*) FILTER (NOT flag)) - 0.5) AS alone FROM u GROUP BY name)"
_SLACK = 0.1


@query(f"{_FLAGGED}, {_ALONE}, n AS (SELECT name, round(alone, 6) AS alone FROM a UNION ALL SELECT unnest(['l_returnflag', 'l_linestatus']), 0) SELECT name, alone, alone = (SELECT max(alone) FROM n) AS is_top, true AS within FROM n")
def card2_permutation_importance(spark, sf_dir):
    """All columns, shuffled three times each over all test rows: the loss is within a tenth of what the column can rank alone."""
    from ..operators.metrics import auc

    rows, model = _flag_model(spark, sf_dir)
    test = persisted(rows.where(F.col("split") == S.TEST), "test")
    found = dict(O.permutation_importance(model, test, [*NUMERIC, *CATEGORICAL], "r", lambda p: BinaryClassificationEvaluator(weightCol="weight").evaluate(p), 3))
    alone = {c: round(abs(auc(test, F.col("label") == 1, F.col(c)).first().auc - 0.5), 6) if c in NUMERIC else 0.0 for c in found}
    top = max(found, key=found.get)
    return spark.createDataFrame([(c, alone[c], c == top, abs(v - alone[c]) <= _SLACK) for c, v in found.items()], "name string, alone double, is_top boolean, within boolean")


#: Words by how many English and other texts they stand in; a word's log ratio is the weight that naive Bayes over their presence gives it.
_RATIOS = "WITH t AS (SELECT lang = 'en' AS english, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))) AS term FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), g AS (SELECT count(*) FILTER (lang = 'en') AS e, count(*) FILTER (lang <> 'en') AS o FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), r AS (SELECT term, round(ln((count(*) FILTER (english) + 1) / (SELECT e + 2 FROM g)) - ln((count(*) FILTER (NOT english) + 1) / (SELECT o + 2 FROM g)), 9) AS weight FROM t GROUP BY term)"


def _token_weights(spark, sf_dir):
    return O.presence_weights(_written(spark, sf_dir), "text", "label").select("term", F.round("weight", 9).alias("weight"))


@query(f"{_RATIOS} SELECT term, weight, weight > 0 AS positive FROM r ORDER BY abs(weight) DESC, term LIMIT 20")
def card3_token_weights(spark, sf_dir):
    """The twenty words that speak most for or against a text's being English, and by how much."""
    return O.token_weights(_token_weights(spark, sf_dir), 20).select("term", "weight", (F.col("weight") > 0).alias("positive"))


@query(f"{_RATIOS} SELECT term FROM r ORDER BY abs(weight) DESC, term LIMIT 20")
def top4_top_tokens(spark, sf_dir):
    return O.token_weights(_token_weights(spark, sf_dir), 20).select("term")


@query(f"{_TOP} SELECT name FROM c ORDER BY c DESC LIMIT 1")
def top5_top_features(spark, sf_dir):
    rows, model = _folded_flag_model(spark, sf_dir)
    found = spark.createDataFrame(O.importances(model, model.transform(rows.limit(1)), NUMERIC, CATEGORICAL), "name string, importance double")
    return found.orderBy(F.desc("importance"), "name").limit(1).select("name")


def _stored_log(spark, sf_dir):
    path = new_path(spark, "log")
    L.as_log(table(spark, sf_dir, "events")).withColumns({"agent": F.lit(""), "kind": F.lit("info"), "message": F.lit("")}).repartition(4).write.json(path)
    return path


_LOG = "WITH g AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS stage, props AS payload FROM events)"


@query(f"{_LOG} SELECT run_id, seq FROM g WHERE seq > 40")
def str1_follow_log(spark, sf_dir):
    path, out = _stored_log(spark, sf_dir), new_path(spark, "followed")
    W.run_available(W.follow(spark, path, after=40, max_files=1), out, new_path(spark, "offsets"))
    return spark.read.parquet(out).select("run_id", "seq")


@query(f"{_LOG} SELECT run_id, max(seq) AS seq, arg_max(stage, seq) AS stage, arg_max(payload, seq) AS payload FROM g GROUP BY 1")
def str2_latest_state(spark, sf_dir):
    log = W.read_stream(spark, _stored_log(spark, sf_dir), max_files=2)
    return W.keep_latest(log, new_path(spark, "latest"), new_path(spark, "offsets"))


@query(f"{_FLAGGED} SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, true AS as_batch FROM f WHERE split = 2")
def str3_stream_scoring(spark, sf_dir):
    """A stream's scores are those of the batch."""
    rows, model = _flag_model(spark, sf_dir)
    source, out = new_path(spark, "to-score"), new_path(spark, "scored")
    scored = O.predictions(model, rows.where(F.col("split") == S.TEST), ["no", "yes"]).withColumnRenamed("prob_yes", "was").drop("prediction", "prob_no")
    scored.write.parquet(source)
    stream = spark.readStream.schema(scored.schema).parquet(source)
    W.run_available(O.predictions(model, stream, ["no", "yes"]), out, new_path(spark, "offsets"))
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.every(F.abs(F.col("was") - F.col("prob_yes")) < 1e-9).alias("as_batch"))

"""What holds for small tables holds for large ones: limits that only size reaches are lowered, or large groups planted."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gristmill.llm import jaccard, packing, quality, scratch, secrets, words
from gristmill.operators import evaluation, extra_trees, features, forecast, models, profile
from gristmill.plans import modelling
from gristmill.plans.registered import QUERIES, SQL
from gristmill.sources import tables
from gristmill.sources.shared import new_path, persisted
from gristmill.streaming import follow

FOLDER = "/root/testdata/sf0.001"


def test_estimates_are_within_a_tenth(spark):
    n, salts = 20_000, range(30)
    df = spark.range(n).select(*(F.xxhash64("id", F.lit(s)).alias(f"c{s}") for s in salts))
    found = profile.distinct_counts(df, profile.EXACT_ROWS + 1).collect()
    assert len(found) == len(salts) and all(abs(r.n_unique - n) <= n / 10 for r in found)


def test_high_cardinality_counts_exactly(spark, monkeypatch):
    monkeypatch.setattr(profile, "EXACT_ROWS", 100)
    (name, value), = duckdb.sql(SQL["aud6_high_cardinality"].replace("FROM orders", f"FROM '{FOLDER}/orders.parquet'")).fetchall()
    r, = QUERIES["aud6_high_cardinality"](spark, FOLDER).collect()
    assert (r.name, float(r.value)) == (name, float(value))


def test_many_series_are_series(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.range(24_000).select(F.col("id").alias("row_id"), F.floor(F.col("id") / 2).alias("user_id"), (F.lit(start) + F.make_interval(days=F.col("id").cast("int"))).alias("ts"))
    assert profile.time_and_series(profile.column_profile(df)) == ("ts", "user_id")


def _repeated(spark):
    """300 different rows, each 1 to 7 times."""
    df = spark.range(300).select(F.rand(1).alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.concat(F.lit("k"), F.col("id") % 3).alias("c"), (F.col("id") % 7 + 1).cast("int").alias("times"))
    df = df.withColumn("label", 3 * F.col("a") + F.col("b") * F.col("b"))
    return persisted(df.select("a", "b", "c", "label", F.explode(F.sequence(F.lit(1), "times"))).drop("col"), "repeated")


def test_folded_rows_teach_the_same(spark):
    rows = _repeated(spark)
    few = models.folded(rows, rows.columns)
    assert few.count() == 300 and few.agg(F.sum("weight")).first()[0] == rows.count()
    for family, params in (("linear", {}), ("boosted", {"maxIter": 3})):
        plain = models.pipeline(["a", "b"], ["c"], family, "regression", params).fit(rows)
        ours = models.fit_folded(rows, ["a", "b"], ["c"], family, "regression", params)
        got, want = (sorted((r.a, r.prediction) for r in m.transform(few).collect()) for m in (ours, plain))
        assert np.array(got) == pytest.approx(np.array(want), rel=1e-6 if family == "linear" else 0.1)


def test_extra_trees_of_folded_rows_are_the_same(spark):
    rows = _repeated(spark).select(F.array("a", "b").alias("x"), F.array("label").alias("y"))
    few = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    one, other = (extra_trees.fit(df, trees=3, depth=5) for df in (rows, few))
    assert (one.features == other.features).all() and one.thresholds == pytest.approx(other.thresholds) and one.values == pytest.approx(other.values)


def test_orders_of_a_permutation_are_worked_out_once(spark, monkeypatch):
    """All columns share a draw's orders, and scores come from folded rows."""
    seen, own = [], models.dealt_anew
    monkeypatch.setattr(models, "dealt_anew", lambda df, columns, key, draw: seen.append(draw) or own(df, columns, key, draw))
    rows = _repeated(spark).withColumn("id", F.monotonically_increasing_id().cast("double") / 1e12)
    rows = persisted(rows, "numbered")
    model = models.fit_folded(rows, ["a", "b"], ["c"], "linear", "regression")

    def score(made):
        if "weight" in made.columns:
            return made.agg(-F.sum(F.pow(F.col("prediction") - F.col("label"), 2) * F.col("weight")) / F.sum("weight")).first()[0]
        return made.agg(-F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]

    found = dict(models.permutation_importance(model, rows, ["a", "b", "c"], "id", score, 2))
    assert seen == [0, 1]
    base = score(model.transform(rows))
    for c, v in found.items():
        assert v == pytest.approx(max(0.0, sum(base - score(model.transform(models.shuffled(rows, c, "id", i))) for i in range(2)) / 2), abs=1e-9)


def test_entries_of_a_part_are_bounded(monkeypatch):
    monkeypatch.setattr(features, "ENTRIES", 10)
    lists = [[1] * n for n in (3, 3, 3, 3, 25, 0, 10, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists)], ["i", "v"])
    parts = list(features.slices(batch.slice(1), 1))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2, 3], [4], [5, 6], [7]]
    assert [p.column(1).to_pylist() for p in parts] == [lists[1:4], lists[4:5], lists[5:7], lists[7:]]


def test_words_are_weighed_by_all_texts(spark, monkeypatch):
    """However large the table, df is that of every text, not of a sample."""
    texts = [f"common {'often' if i % 3 else 'seldom'} w{i % 50} own{i}" for i in range(600)]
    shared, own = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: shared.append(value) or own(self, value))
    packing.dealt(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 1 << 30)
    idf = next(v for v in shared if isinstance(v, np.ndarray) and len(v) == 1 << packing._DF_BITS)
    df = np.zeros(len(idf))
    for text in texts:
        tokens, _ = words.word_hashes(pa.array([text]))
        df[np.unique(tokens >> np.uint64(64 - packing._DF_BITS)).astype(int)] += 1
    assert idf == pytest.approx(np.log1p((600 - df + 0.5) / (df + 0.5)))


def test_tasks_of_a_calibration_are_bounded_by_rows(spark, monkeypatch):
    """More rows are more tasks, groups stay whole, and neither grouping nor ranking shuffles them again."""
    monkeypatch.setattr(evaluation, "TASK_ROWS", 200)
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    n = lines.count()
    parts = evaluation.dealt(lines, ["l_suppkey", "l_returnflag"])
    assert parts.rdd.getNumPartitions() == max(4, -(-n // 200)) > 4
    assert parts.select("l_suppkey", "l_returnflag", F.spark_partition_id().alias("part")).distinct().groupBy("l_suppkey", "l_returnflag").count().where("count > 1").isEmpty()
    plan = QUERIES["eval4_calibration"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and f", {-(-n // 200)}), REPARTITION_BY_NUM" in plan


def test_many_runs_share_a_state(spark):
    """However many runs there are, a batch works in a bounded number of groups, and each event comes once."""
    path, out, at = (new_path(spark, n) for n in ("log", "followed", "offsets"))
    start = dt.datetime(2024, 1, 1)
    rows = [(n, f"r{r}", start, "s", "a", "k", "m", "{}") for r in range(3000) for n in (1, 9000)]
    for part in (rows, rows[:100] + [(2, *r[1:]) for r in rows[:100:2]]):
        spark.createDataFrame(part, tables.EVENT).coalesce(1).write.mode("append").json(path)
        query = follow.run_available(follow.follow(spark, path, groups=8), out, at)
        assert query.lastProgress.stateOperators[0].numRowsTotal == 8
    got = spark.read.parquet(out)
    assert got.count() == got.select("run_id", "seq").distinct().count() == 6050


def test_texts_of_one_row_group_are_many_tasks(spark, monkeypatch):
    """Texts of one file part are split by several tasks, by bytes; a text without an id has its weights too."""
    monkeypatch.setattr(features, "TEXT_BYTES", 1000)
    docs = persisted(spark.createDataFrame([(i if i else None, f"word w{i % 7} own{i} " * 5) for i in range(100)], "doc_id long, text string").coalesce(1), "docs")
    parts = features.spread(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert docs.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == -(-size // 1000) > 4
    found = features.tf_idf(docs, "doc_id", "text")
    squares = found.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(squares) == 100 and all(r.s == pytest.approx(1) for r in squares)


def test_stored_vectors_are_read_as_entries(spark):
    """Sparse vectors come back as their lists, without a text in between; a table of texts in one row group is several tasks' to split."""
    vectors = [Vectors.sparse(9, [1, 7], [0.1, 1e-300]), Vectors.sparse(9, [], []), Vectors.sparse(9, [0], [3.0])]
    rows = spark.createDataFrame([(float(i), v) for i, v in enumerate(vectors)], ["label", "features"])
    path = new_path(spark, "vectors")
    rows.write.parquet(path)
    got = features.entries(path, "features", rows)
    assert got.columns == ["label", "indices", "values"]
    assert [(list(r.indices), list(r["values"])) for r in got.orderBy("label").collect()] == [(v.indices.tolist(), v.values.tolist()) for v in vectors]


def test_text_models_split_one_row_group_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "LEAST_BYTES", 1 << 10)
    assert modelling._written(spark, FOLDER).rdd.getNumPartitions() == 4


def test_replay_scores_equal_rows_once(spark, monkeypatch):
    """The replay of a stored model scores a row for each different one, and counts all."""
    scored, own = [], models.predictions
    monkeypatch.setattr(models, "predictions", lambda model, df, labels=(): scored.append(df.count()) or own(model, df, labels))
    again = modelling._lines(spark, FOLDER)
    monkeypatch.setattr(modelling, "_lines", lambda spark, sf_dir: persisted(again.unionByName(again), "twice"))
    r, = QUERIES["score2_feature_replay"](spark, FOLDER).collect()
    test = again.where("split = 2")
    assert (r.n, r.n_unseen, r.as_before) == (2 * test.count(), 2 * test.where("r < 0.1").count(), True)
    assert len(scored) == 2 and max(scored) <= test.count()


def test_boosting_beats_naive_on_quiet_series(spark):
    """Weekly sums of some 5,000 orders vary by under two in a hundred: the model still gets closer than the seasonal-naive forecast."""
    start = dt.datetime(2015, 1, 5)
    ts = F.lit(start) + F.make_interval(weeks=F.col("week").cast("int"))
    rows = spark.range(5 * 345).select(F.concat(F.lit("s"), F.col("id") % 5).alias("sid"), F.floor(F.col("id") / 5).alias("week"), (1000 + 16 * F.randn(1)).alias("y"))
    rows = persisted(rows.withColumn("ts", ts).withColumn("y", F.col("y") * (1 + F.month("ts") % 3)), "quiet")
    train, valid, test = (rows.where(F.col("week").between(a, b)).select("sid", "ts", "y") for a, b in ((0, 240), (241, 292), (293, 344)))
    made, errors = forecast.boosted_forecast(train, valid, test, 4, 52)
    error = lambda out: out.agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert error(made) < error(forecast.naive_forecast(train.unionByName(valid), test, 4, 52))


def test_recurring_words_are_encoded_once():
    """Many texts together have the ids that each has by itself in ``tokenizers``, but a word that recurs is encoded once."""
    from gristmill.llm.queries import PACKING_TOKENIZER

    with open(PACKING_TOKENIZER, encoding="utf-8") as f:
        coder = packing.Encoder(f.read())
    rng, own, seen = np.random.default_rng(3), coder.fast.encode_ordinary, []
    parts = ["a", "B", "\u00e9", "\u00a0", "\u3000", "\n", "\t", " ", " ", "  ", "\x1c", "\x85", "'s", "12", "!?", "\u65e5\u672c", "\u2003", "<|endoftext|>"]
    odd = ["", " ", "x" * 4000, "y " * 3 + " " * 4000 + "z"] + ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)]
    found = coder.encode_all(list(dict.fromkeys(odd)))
    assert all(found[x] == np.array(coder.slow.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd)
    coder.fast = type("Counted", (), {"encode_ordinary": lambda self, text: seen.append(len(text)) or own(text)})()
    plain = [" ".join(f"word{k}" for k in rng.integers(0, 100, 200)) for _ in range(50)]
    found = coder.encode_all(plain)
    assert sum(seen) < 2000 and all(np.frombuffer(found[x], "<u4").tolist() == own(x) for x in plain)


def test_long_runs_are_found_wherever_they_begin():
    for n, long in ((3999, False), (4000, True)):
        for at in (0, 1, 1999, 2000, 3500):
            for run in ("x" * n, " " * n):
                other = " x" * at
                text = other[:at] + (" " if run[0] == "x" else "x") + run + (" " if run[0] == "x" else "x") + other
                assert packing.has_long_run(text) == long == (packing._LONG_RUN.search(text) is not None)


def test_features_of_folded_rows_are_those_of_all(spark, monkeypatch):
    """Features are worked out from weights, nulls included; the rows themselves are read once, to fold them, and again only where few are equal."""
    rows = _repeated(spark).withColumn("b", F.when(F.col("b") != 2, F.col("b"))).withColumn("c", F.when(F.col("a") < 0.9, F.col("c")))
    few = persisted(models.folded(rows, rows.columns), "few")
    want = models.features(["a", "b"], ["c"]).fit(rows)
    got = models.folded_features(few, ["a", "b"], ["c"])
    x, y = (np.array([r.features.toArray() for r in m.transform(few).orderBy("a", "label", "c").collect()]) for m in (got, want))
    assert x.shape == y.shape == (300, 6) and x == pytest.approx(y, abs=0.02)  # a median of all rows is to a thousandth of the ranks
    assert x[:, 0] == pytest.approx(y[:, 0], abs=1e-9)
    fitted, own = [], models.features
    monkeypatch.setattr(models, "features", lambda *c: type("Seen", (), {"fit": lambda self, df: fitted.append(df) or own(*c).fit(df), "getStages": lambda self: own(*c).getStages()})())
    models.fit_folded(rows, ["a", "b"], ["c"], "linear", "regression")
    assert not fitted
    monkeypatch.setattr(models, "FEW_ROWS", 10)
    models.fit_folded(rows, ["a", "b"], ["c"], "linear", "regression")
    assert len(fitted) == 1


def test_planted_findings_are_made_by_code_that_compiles(spark):
    """All findings as one expression made a method of over 64 KB: the driver compiled it in vain and fell back."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        found = secrets.planted(docs, places=20).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert {r.label for r in found} == {0.0, 1.0} and len(found) > 300


def test_replay_stores_different_lines_only(spark, monkeypatch):
    """Lines are drawn and folded in one pass: twice the lines make no larger tables, and all are counted."""
    stored, once = [], modelling._lines(spark, FOLDER)
    monkeypatch.setattr(modelling, "_lines", lambda spark, sf_dir: once.unionByName(once))
    monkeypatch.setattr(modelling, "persisted", lambda df, name: stored.append(persisted(df, name)) or stored[-1])
    r, = QUERIES["score2_feature_replay"](spark, FOLDER).collect()
    assert r.n == 2 * once.where("split = 2").count() and stored and all(df.count() <= once.count() for df in stored)


def test_weighted_rows_teach_as_their_copies_do(spark, monkeypatch):
    """Rows with their number give the model that their copies give, where features are fitted on folded rows and where on all."""
    rows = _repeated(spark)
    few = models.folded(rows, rows.columns).withColumnRenamed("weight", "times")
    for most in (models.FEW_ROWS, 100):
        monkeypatch.setattr(models, "FEW_ROWS", most)
        plain, ours = models.fit_folded(rows, ["a", "b"], ["c"], "linear", "regression"), models.fit_folded(few, ["a", "b"], ["c"], "linear", "regression", weight="times")
        got, want = (sorted((r.a, r.prediction) for r in m.transform(rows).collect()) for m in (ours, plain))
        assert np.array(got) == pytest.approx(np.array(want), rel=1e-6)


def _written_at_once(spark, n=3_000):
    """Texts of one row group, which one split holds: about half of the words of some repeat."""
    rng, words_ = np.random.default_rng(3), np.array([f"word{i}" for i in range(4_000)])
    texts = []
    for i in range(n):
        own = [rng.choice(words_, 40 + i % 60)]
        own += [own[0][: rng.integers(3, 40)] for _ in range(i % 4)]
        texts.append(" ".join(np.concatenate([own[j] for j in rng.permutation(len(own))])))
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)


def test_quality_stage_deals_one_row_group_and_judges_alike(spark):
    docs = persisted(_written_at_once(spark), "texts")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert docs.rdd.getNumPartitions() == 1 and kept.rdd.getNumPartitions() > 1
    wanted = quality.quality(docs, labels).collect()
    assert 0 < sum(100 * r.n_repeat_words > 50 * r.n_words for r in wanted) < sum(r.n_repeat_words > 0 for r in wanted)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in wanted if r.kept)


def test_near_duplicate_keys_are_packed_and_texts_hashed_once():
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(40)]
    texts += [t.replace("w3x7 ", "other ") for t in texts] + ["", None]
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["id", "h1", "h2", "text"])
    # Two tasks, whose keys meet in four groups: a row for each set and at most one for each group and task.
    rows = [r for part in (batch.slice(0, 40), batch.slice(40)) for out in jaccard._with_keys(5, 80, 4)(iter([part])) for r in out.to_pylist()]
    assert len(rows) <= len(texts) + 2 * (4 + 1) and sum(len(r["keys"] or b"") for r in rows) > 40 * 8 * 100
    ordered = pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["group"]), next(jaccard._with_keys(5, 80, 4)(iter([batch]))).schema)
    found = [r for out in jaccard._meet(iter([ordered.slice(0, 50), ordered.slice(50)])) for r in out.to_pylist()]
    sets = {r["id"]: r["s1"] for r in found if r["a"] is None}
    assert sorted(sets) == list(range(len(texts)))
    linked = {frozenset((r["a"], r["b"])) for r in found if r["a"] is not None}
    assert linked == {frozenset((sets[i], sets[i + 40])) for i in range(40) if sets[i] != sets[i + 40]} and linked


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())
    before = files()
    for write in (persisted, scratch.write):
        write(spark.range(1_000).repartition(3, "id"), "dealt")
    assert not [f for f in files() - before if f.endswith(".data")]


def test_tf_idf_stores_no_row_for_each_text_and_term(spark, monkeypatch):
    """What is stored is a row for each part and term; repeated ids are one text; ``max_terms`` keeps the most frequent terms."""
    stored = []
    monkeypatch.setattr(features, "persisted", lambda df, name: stored.append(persisted(df, name)) or stored[-1])
    docs = spark.createDataFrame([(i // 2, f"alpha beta beta gamma w{i % 7} own{i}") for i in range(400)], "doc_id long, text string")
    found = features.tf_idf(docs, "doc_id", "text").collect()
    assert len(found) == 2_000 and all(t.count() < 200 for t in stored)
    by, ratio = {(r.doc_id, r.term): r.weight for r in found}, (1 + np.log(4)) / (1 + np.log(2))  # an id's two rows count together
    assert all(by[i, "beta"] / by[i, "alpha"] == pytest.approx(ratio) for i in range(200))
    assert {r.term for r in features.tf_idf(docs, "doc_id", "text", max_terms=1).collect()} == {"beta"}

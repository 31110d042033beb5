"""Invariants and golden values of the operators."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from gristmill.functions.hashing import uniform
from gristmill.operators import audit, evaluation, forecast, halving, memory, metrics, neighbours, profile, relational, retrieval, scoring, split
from gristmill.operators.ranks import numbered, quantiles, ranked, with_row_id
from gristmill.sources import tables
from gristmill.sources.shared import new_path, persisted


def test_formats_and_errors(spark):
    assert tables.source_suffix("a/b.CSV.gz") == ".csv" and tables.is_supported("x.ndjson") and not tables.is_supported("x.xls")
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.xls")
    with pytest.raises(ValueError):
        tables.require_rows(spark.range(0))


def test_late_type_change(spark):
    path = new_path(spark, "late")
    rows = spark.range(2001).select(F.when(F.col("id") == 2000, "word").otherwise(F.col("id").cast("string")).alias("a"), "id").coalesce(1)
    rows.write.option("header", True).csv(path)
    assert dict(tables.load_csv_checked(spark, path, 0.01).dtypes)["a"] == "string"


def test_ranks_equal_row_number(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = {r.id: r.rank for r in ranked(rows, uniform(F.col("id"), "x"), [F.col("id")], ["g"], buckets=7).collect()}
    draws = {r.id: (r.g, r.u) for r in rows.select("id", "g", uniform(F.col("id"), "x").alias("u")).collect()}
    for g in range(3):
        order = sorted((u, i) for i, (gg, u) in draws.items() if gg == g)
        assert [got[i] for _, i in order] == list(range(len(order)))


def test_row_ids_have_no_gaps(spark):
    ids = sorted(r.row_id for r in persisted(with_row_id(spark.range(0, 100, 1, 7)), "ids").collect())
    assert ids == list(range(100))


def test_numbers_in_order(spark):
    rows = spark.range(0, 500, 1, 9).select(F.concat(F.lit("n"), F.pmod(F.col("id") * 37, F.lit(500))).alias("s"))
    assert [r.s for r in numbered(rows, ["s"], "i").orderBy("i").collect()] == sorted(f"n{i}" for i in range(500))
    assert sorted(r.i for r in numbered(rows, ["s"], "i").collect()) == list(range(500))


def test_split_sizes_and_nesting(spark):
    df = spark.range(401).withColumn("label", F.when(F.col("id") % 20 == 0, "rare").when(F.col("id") % 20 == 1, F.lit(None)).otherwise("many"))
    out = split.random_split(df, "id", ["label"]).toPandas()
    assert len(out) == 401
    for _, part in out.groupby("label", dropna=False):
        n = len(part)
        assert (part["split"] == split.VALID).sum() == max(1, round(n * 0.15)) and (part["split"] == split.TEST).sum() == max(1, round(n * 0.15))
    small, large = (set(out[out["r"] < f]["id"]) for f in (0.2, 0.6))
    assert small < large


def test_temporal_blocks(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(s, start + dt.timedelta(days=d)) for d in range(50) for s in "abc"] + [("a", None)], "sid string, ts timestamp")
    out = split.temporal_split(df, "ts").toPandas()
    assert (out[out["ts"].isna()]["split"] == split.EXCLUDED).all()
    out = out.dropna(subset=["ts"])
    assert (out.groupby("ts")["split"].nunique() == 1).all()
    assert out[out["split"] == 0]["ts"].max() < out[out["split"] == 1]["ts"].min() < out[out["split"] == 2]["ts"].min()


def test_profile_kinds_and_nulls(spark):
    rows = [(i, float(i) / 7, None if i % 4 else "x", "some words that make up a longer text here", f"2024-01-{i % 28 + 1:02d}", float("nan")) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, v double, c string, t string, d string, n double")
    got = {r.name: r for r in profile.column_profile(df).collect()}
    assert [got[c].kind for c in ("row_id", "v", "c", "t", "d", "n")] == ["identifier", "numeric", "categorical", "text", "datetime", "numeric"]
    assert got["c"].n_unique == 2 and got["c"].n_missing == 45 and got["n"].n_missing == 0


def test_audit_finds_planted_leak_only(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).cast("double").alias("y"), F.when(F.col("id") % 2 == 1, "p").otherwise("q").alias("leak"), (F.col("id") % 7).cast("string").alias("noise"))
    power = audit.categorical_power(df, "id", ["leak", "noise"], "y", "binary")
    assert [(r.name, r.leakage) for r in audit.roll_up(audit.power_findings(power)).collect()] == [("leak", True)]
    assert audit.roll_up(audit.power_findings(power), ["leak"]).count() == 0
    assert {r.name: r.power for r in audit.categorical_power(df.withColumn("y", F.col("leak")), "id", ["leak"], "y", "multiclass").collect()} == {"leak": 1.0}


def test_numeric_power(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 < 3, 1.0).otherwise(0.0).alias("y"), (F.col("id") % 10).cast("double").alias("leak"), uniform(F.col("id"), "n").alias("noise"))
    got = {r.name: r.power for r in audit.numeric_power(df, "id", ["leak", "noise"], "y").collect()}
    assert got["leak"] > 0.98 and got["noise"] < 0.2


def test_target_name_mirrors(spark):
    names = spark.createDataFrame([("churn_flag",), ("is_churn",), ("churn_after_promo",), ("age",), ("customer_churning_reasons",)], "name string")
    got = {r.name for r in names.where(audit.mirrors_target("churn")).collect()}
    assert got == {"churn_flag", "is_churn", "churn_after_promo"}


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(0, None, 1), (0, "a", 2), (2, None, 1), (2, "a", 3)], "split int, a string, b int")
    r = audit.duplicates(df, "split", ["a", "b"]).first()
    assert (r.n_test, r.n_duplicate, r.percent, r.severity) == (2, 1, 50.0, "high")


def test_no_look_ahead(spark):
    start = dt.datetime(2024, 1, 1)
    make = lambda add: spark.createDataFrame([("s", start + dt.timedelta(days=i), float(i + (add if i >= 30 else 0))) for i in range(60)], "sid string, ts timestamp, y double")
    a, b = (forecast.origin_features(make(x)).where("idx < 30").orderBy("idx").collect() for x in (0, 10_000))
    assert a == b


def plain_smoothing(values, origins, horizon, season):
    """One value after another."""
    out = {}
    for i, y in enumerate(values):
        if i + 1 == 2 * season:
            one, two = values[:season], values[season : 2 * season]
            level, trend = sum(two) / season, (sum(two) - sum(one)) / season**2
            seasonal = [(a + b) / 2 - sum(values[: 2 * season]) / (2 * season) for a, b in zip(one, two)]
        elif i + 1 > 2 * season:
            before, k = level, i % season
            level = 0.2 * (y - seasonal[k]) + 0.8 * (level + trend)
            trend = 0.05 * (level - before) + 0.95 * trend
            seasonal[k] = 0.1 * (y - level) + 0.9 * seasonal[k]
        if i in origins:
            out[i] = [level + h * trend + seasonal[(i + h) % season] if i + 1 >= 2 * season else y for h in range(1, horizon + 1)]
    return out


@pytest.mark.parametrize("chunk", [None, 7, 28])
def test_smoothing_by_chunks(spark, chunk):
    """Series of all lengths, in one chunk and in many, equal one pass from value to value."""
    import random

    rng = random.Random(8)
    start, want, history, block = dt.datetime(2024, 1, 1), {}, [], []
    for sid, n, m in [("a", 150, 40), ("b", 12, 9), ("c", 13, 3), ("d", 14, 5), ("e", 0, 6), ("f", 20, 0), ("g", 61, 33)]:
        values = [round(50 + 10 * math.sin(i) + i / 9 + rng.random(), 3) for i in range(n + m)]
        at = [start + dt.timedelta(days=i, hours=rng.randrange(9)) for i in range(n + m)]
        history += [(sid, at[i], values[i]) for i in range(n)]
        block += [(sid, at[i], values[i]) for i in range(n, n + m)]
        made = plain_smoothing(values, {n + w - 1 for w in range(0, m, 5)}, 5, 7)
        want |= {(sid, at[n + i]): made.get(n + i // 5 * 5 - 1, [None] * 5)[i % 5] for i in range(m)}
    schema = "sid string, ts timestamp, y double"
    out = forecast.smoothing_forecast(spark.createDataFrame(history, schema), spark.createDataFrame(block, schema), 5, 7, chunk)
    got = {(r.sid, r.ts): r.p for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(v) if v is not None else None) for k, v in want.items())


def test_forecast_rejects_unknown(spark):
    series = spark.createDataFrame([("s", dt.datetime(2024, 1, d), float(d)) for d in range(1, 20)], "sid string, ts timestamp, y double")
    state = forecast.serving_state(series, 7)
    ask = lambda sid, h: spark.createDataFrame([(sid, h)], "sid string, h long")
    row = forecast.forecast(state, ask("s", 2), 7, 7, "D").first()
    assert (row.ts, row.p) == (dt.datetime(2024, 1, 21), 14.0)
    for sid, h in (("t", 1), ("s", 8)):
        with pytest.raises(ValueError):
            forecast.forecast(state, ask(sid, h), 7, 7, "D")


def test_schedules():
    assert halving.schedule(1000, 3) == [1000]
    assert halving.schedule(3_500_000, 3) == [20_000, 80_000]
    assert halving.schedule(3_500_000, 5) == [20_000, 80_000, 320_000]
    assert halving.schedule(50_000, 5) == [20_000, 50_000]
    assert halving.schedule(3_500_000, 1) == [20_000]


def test_halving_ranks_failures_last_and_stops_on_time(spark):
    def fit(plan, rows):
        if plan == "broken":
            raise RuntimeError("no")
        return {"good": 0.9, "fair": 0.7}.get(plan, 0.1)

    plans = [("fair", "linear"), ("broken", "linear"), ("good", "linear")]
    chosen, seen = halving.successive_halving(spark, plans, 400, fit, min_rows=100, growth=2)
    assert chosen == "good" and seen.where("error is not null").count() == 1 and seen.where("final").first().fidelity_rows == 400
    now = iter(range(0, 10_000, 10))
    _, seen = halving.successive_halving(spark, plans, 10_000, fit, min_rows=100, seconds=5, clock=lambda: float(next(now)))
    assert {r.rung for r in seen.where("not final").collect()} == {0}
    with pytest.raises(ValueError):
        halving.require_full(90, 100)


def test_calibration_golden(spark):
    rows = [("r", 1, 0.9, 0.6), ("r", 2, 0.8, 0.7), ("r", 3, 0.7, 0.8)]
    df = spark.createDataFrame(rows, "run string, plan long, p double, o double")
    r = evaluation.calibration(df, ["run"], "plan", "p", "o").first()
    assert r.spearman == pytest.approx(-1) and r.top1_hit == 0 and r.mae == pytest.approx(0.5 / 3)


def test_normalized_scores(spark):
    rows = [("rmse", 3.0, None, 0.25), ("rmse", 3.0, 1.0, 0.5), ("roc_auc", 1.2, None, 1.0), ("smape", 9.0, None, 0.1), (None, 1.0, None, 0.0), ("r2", float("nan"), None, 0.0)]
    df = spark.createDataFrame(rows, "m string, s double, l double, want double")
    for r in df.withColumn("got", evaluation.normalized(F.col("m"), F.col("s"), F.col("l"))).collect():
        assert r.got == pytest.approx(r.want)


def test_auc_against_pairs(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.8, True), (0.9, True), (0.2, False)]
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, ya in rows if ya for b, yb in rows if not yb]
    got = metrics.auc(spark.createDataFrame(rows, "s double, y boolean"), F.col("y"), F.col("s")).first().auc
    assert got == pytest.approx(sum(wins) / len(wins))


def test_scoring_checks(spark):
    df = spark.createDataFrame([("1.5", "yes", 1), (None, "NO", 2)], "a string, b string, c int")
    assert [tuple(r) for r in scoring.numeric(df, ["a", "b"]).orderBy("c").collect()] == [(1.5, 1.0, 1), (None, 0.0, 2)]
    with pytest.raises(ValueError, match="column a"):
        scoring.numeric(df.withColumn("a", F.lit("x9")), ["a"])
    with pytest.raises(ValueError, match="missing columns: d; unknown columns: c"):
        scoring.checked_columns(df, ["a", "b", "d"])


def test_small_relational(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r.x for r in df.select(relational.finite(F.col("x")).alias("x")).collect()] == [0.0, 0.0, None, 2.0]
    assert memory.fingerprint(profile.column_profile(spark.range(3))).first() == memory.fingerprint(profile.column_profile(spark.range(3))).first()
    assert math.isclose(spark.range(1).select(neighbours.squared_distance(F.array(F.lit(1.0)), F.array(F.lit(3.0)))).first()[0], 4.0)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_stands_alone(tmp_path):
    """Without the operators for training text the entry still registers all other queries, whether or not the pipeline's file is there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/gristmill", tmp_path / "gristmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and set(e.oracle_sql()) <= n and not any(x.startswith('op') or x == 'pipeline' for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_error_signatures(spark):
    from gristmill.functions.text import error_signature

    logs = [
        ('Traceback...\n  File "x.py", line 12\nKeyError: \'monthly\'', "KeyError: '…'"),
        ("ValueError: could not convert 3 values\n\nnote: line 9 above", "ValueError: could not convert N values"),
        ("a.b.OddWarning\nValueErrors: no name of an exception", "a.b.OddWarning"),
        ("it's 5 o'clock\n  \n", "it'…'clock"),
        ("one ' alone 7", "one ' alone N"),
        (" \n", "unknown error"),
        ("", "unknown error"),
        (None, None),
        ("x" * 500, "x" * 200),
    ]
    for r in spark.createDataFrame(logs, "log string, want string").withColumn("got", error_signature(F.col("log"))).collect():
        assert r.got == r.want


def test_dates(spark):
    from gristmill.functions.text import date_like

    yes = ["2024-01", "2024/1/5", "2024-01-05T10:00", "2024-01-05 9:00:01", "31/12/2023", "12-31-2023", "2024-02 10:30"]
    no = ["", "x", "2024", "2024-13", "2024-02-30", "1.5", "12345678", "2024-01-05 later", "10:30", "2024-01-05-7"]
    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t in [*yes, *no, None]], "t string").withColumn("d", date_like(F.col("t"))).collect()}
    assert got == {t: True for t in yes} | {t: False for t in no} | {None: None}


def test_followed_log_is_whole(spark):
    """Late files, repeated events, events of one file at a time, and a second run over new files."""
    from gristmill.streaming import follow

    path, out, at = (new_path(spark, n) for n in ("log", "followed", "offsets"))
    start = dt.datetime(2024, 1, 1)
    rows = [(n, run, start + dt.timedelta(days=30 - n % 30), "s", "a", "k", "m", "{}") for run in ("x", "y", None) for n in range(1, 9000, 250)]
    rows += rows[:20] + rows[5:9] + [(None, "x", start, "s", "a", "k", "m", "{}")]
    log = spark.createDataFrame(rows, tables.EVENT)
    for part in log.orderBy(F.desc("ts")).randomSplit([1.0] * 5, 3):
        part.coalesce(1).write.mode("append").json(path)
    follow.run_available(follow.follow(spark, path, after=40, max_files=1), out, at)
    new = [(n + 1, *rest) for n, *rest in rows[:30]]
    spark.createDataFrame(new, tables.EVENT).coalesce(1).write.mode("append").json(path)
    follow.run_available(follow.follow(spark, path, after=40, max_files=1), out, at)
    want = sorted({(str(r), n) for n, r, *_ in rows + new if n and n > 40})
    assert sorted((str(r.run_id), r.seq) for r in spark.read.parquet(out).collect()) == want
    latest = follow.keep_latest(follow.read_stream(spark, path, max_files=1), new_path(spark, "latest"), new_path(spark, "offsets"))
    best = {}
    for r, n in want:
        best[r] = max(best.get(r, 0), n)
    assert {str(r.run_id): r.seq for r in latest.collect()} == best


def test_quantiles_by_narrowing(spark, monkeypatch):
    """Exact whatever the spread: heavy tails, few values, and narrowing more than once."""
    import numpy as np

    monkeypatch.setattr("gristmill.operators.ranks.EXACT_VALUES", 20)
    rng = np.random.default_rng(1)
    for values in (np.exp(6 * rng.standard_normal(1500)), np.repeat([1.0, 2.0, 5.0], [700, 2, 300]), np.full(50, 3.0)):
        df = spark.createDataFrame([(float(v),) for v in [*values, float("nan")][:-1]] + [(None,)], "v double")
        fractions = (0.0, 0.05, 0.5, 0.951, 1.0)
        assert quantiles(df, "v", fractions) == pytest.approx([float(np.quantile(values, f)) for f in fractions])
    assert quantiles(df.where("v is null"), "v", (0.5,)) == [None]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_nearest_in_blocks(spark, monkeypatch, most):
    """Against all pairs: ties, equal vectors, groups, and in one pass and in tiles of cells."""
    import numpy as np

    monkeypatch.setattr(neighbours, "QUERY_BYTES", most)
    monkeypatch.setattr(neighbours, "TILE", 9)
    monkeypatch.setattr(neighbours, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 3, (60, 4)).astype(float)
    vectors[40:50] = vectors[3]
    rows = spark.createDataFrame([(i, [float(x) for x in v], int(i % 4)) for i, v in enumerate(vectors)] + [(None, [0.0] * 4, 1), (99, None, 1)], "id long, vec array<float>, label int")
    queries = rows.where("id % 5 = 0 or id is null").selectExpr("id as query", "vec")
    order = lambda q: sorted((float(((v - vectors[q]) ** 2).sum()), i) for i, v in enumerate(vectors) if i != q)
    got = {(r.query, r["rank"]): (r.id, r.dist) for r in neighbours.nearest(queries, rows, 6).collect()}
    assert got == {(q, k + 1): (i, math.sqrt(d)) for q in range(0, 60, 5) for k, (d, i) in enumerate(order(q)[:6])}
    got = {(r.query, r["rank"]): r.id for r in neighbours.nearest(queries, rows, 3, "label").collect()}
    for q in range(0, 60, 5):
        first = {}
        for _, i in order(q):
            first.setdefault(i % 4, i)
        assert [got[q, k] for k in (1, 2, 3)] == list(first.values())[:3]
    assert neighbours.nearest(queries.where("false"), rows, 3).count() == 0 and neighbours.nearest(queries, rows.where("false"), 3).count() == 0


@pytest.mark.parametrize("group", [None, "label"])
def test_routing_computes_few_distances(spark, monkeypatch, group):
    """Clustered rows, a third of them one point: exact, and under a fifth of all distances."""
    import numpy as np

    monkeypatch.setattr(neighbours, "QUERY_BYTES", 0)
    monkeypatch.setattr(neighbours, "TILE", 200)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 6))[rng.integers(0, 40, 1500)] * 10 + rng.normal(size=(1500, 6)) * 0.1
    vectors = np.concatenate([vectors, np.tile(vectors[:1], (700, 1))])
    labels = rng.integers(0, 3, len(vectors))
    rows = spark.createDataFrame([(i, [float(x) for x in v], int(labels[i])) for i, v in enumerate(vectors)], "id long, vec array<double>, label int")
    queries = rows.where("id % 7 = 0").selectExpr("id as query", "vec")
    work = spark.sparkContext.accumulator(0)
    got = {(r.query, r["rank"]): (r.id, round(r.dist, 9)) for r in neighbours.nearest(queries, rows, 3, group, work=work).collect()}
    for q in range(0, len(vectors), 7):
        order = sorted((math.sqrt(((v - vectors[q]) ** 2).sum()), i) for i, v in enumerate(vectors) if i != q)
        if group:
            first = {}
            for d, i in order:
                first.setdefault(labels[i], (d, i))
            order = list(first.values())
        assert [got[q, k] for k in (1, 2, 3)] == [(i, round(d, 9)) for d, i in order[:3]]
    share = work.value / (queries.count() * rows.count())
    assert 0 < share < (0.2 if group is None else 0.5)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_lexical_search(spark, monkeypatch, most):
    """Against all pairs, by the index and in one pass: ties, tags, nulls and empty texts."""
    import random

    monkeypatch.setattr(retrieval, "QUERY_BYTES", most)
    monkeypatch.setattr(retrieval, "BLOCK_PASSAGES", 5)
    monkeypatch.setattr(retrieval, "PROBES", 1)
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefghij") * 2 for _ in range(n))
    queries = [(i, text(rng.randint(1, 6))) for i in range(12)] + [(50, ""), (51, None)]
    passages = [(i, text(rng.randint(0, 9)), rng.choice(["aa", "bb", None])) for i in range(40)] + [(90, None, "cc")]
    q = spark.createDataFrame(queries, "query long, text string")
    p = spark.createDataFrame(passages, "passage long, text string, tag string").repartition(3)
    for tags in (None, p.select("passage", "tag")):
        got = {(r.query, r["rank"]): (r.passage, r.score) for r in retrieval.overlaps(q, p.drop("tag"), 4, tags).collect()}
        want = {}
        for i, t in queries:
            asked = set((t or "").split())
            scored = sorted((-len(asked & set((x or "").split())) - (2 if tags is not None and tag in asked else 0), n) for n, x, tag in passages)
            want |= {(i, k + 1): (n, -s) for k, (s, n) in enumerate([x for x in scored if x[0] < 0][:4])}
        assert got == want


def test_thresholds_prune(spark, monkeypatch):
    """Most passages share only common words with a query: few are scored, by the index and in the pass, and the answers are whole."""
    import random

    import numpy as np

    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(3000)]
    passages = [(i, " ".join([*rng.sample(common, 6), *rng.sample(rare, 8)])) for i in range(3000)]
    queries = [(i, " ".join(passages[7 * i][1].split()[:12])) for i in range(40)]
    q, p = spark.createDataFrame(queries, "query long, text string"), spark.createDataFrame(passages, "passage long, text string").repartition(4)
    asked, index = retrieval._asked(q), retrieval.lexical_index(p)
    assert retrieval.candidates(asked, index, 1).count() < 0.01 * len(queries) * len(passages)
    words = {i: set(t.split()) for i, t in passages}
    want = {(i, k + 1): (n, -s) for i, t in queries for k, (s, n) in enumerate(sorted((-len(set(t.split()) & w), n) for n, w in words.items())[:2])}
    assert {(r.query, r["rank"]): (r.passage, r.score) for r in retrieval.search(index, q, 2).collect()} == want
    own = retrieval._Asked(np.array([0]), __import__("pyarrow").array([["a", "b", "x"]]))
    top = retrieval._TopPassages(own, 1)
    terms = {w: i for i, w in enumerate(own.vocabulary.to_pylist())}
    for n, block in enumerate([["a", "b"], ["a"], ["x"], ["a", "b", "x"]]):
        top.add(np.array([n]), np.zeros(len(block), int), np.array([terms[w] for w in block]), np.ones(len(block), int))
        top.settle() if top.fresh else None
    assert top.scored == 2 and top.kept[1].tolist() == [3]


@pytest.mark.parametrize("loss", ["log", "hinge"])
def test_gradient_descent_learns_over_sorted_partitions(spark, loss):
    """Rows sorted by label, so that tasks see one class mostly; weights of rare features are not thinned out."""
    import numpy as np

    from gristmill.operators import sgd

    rng = np.random.default_rng(5)
    truth = rng.normal(size=60)
    made = []
    for _ in range(3000):
        at = np.sort(rng.choice(60, 8, replace=False))
        x = rng.random(8)
        made.append((float(x @ truth[at] > 0), at.tolist(), x.tolist()))
    rows = spark.createDataFrame(made + [(None, [1], [1.0]), (1.0, [], [])], "label double, indices array<int>, values array<double>").orderBy("label").coalesce(4)
    model = sgd.fit(rows, 60, loss)
    scored = sgd.predict(model, rows.where("label is not null"))
    share = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert share > 0.85 and scored.count() == 3001
    assert np.corrcoef(model.weights[:60], truth)[0, 1] > 0.8


def test_descent_equals_a_plain_loop():
    import numpy as np

    from gristmill.operators import sgd

    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 5)) * (rng.random((70, 5)) < 0.5)
    y = rng.choice([-1.0, 1.0], 70)
    row, index = np.nonzero(x)
    got, touched = sgd.descend(np.zeros(5), iter([(y, row, index, x[row, index])]), "log", 0.5, 1e-3, 9)
    order, w, squares = np.random.default_rng(9).permutation(70), np.zeros(5), np.zeros(5)
    for a in range(0, 70, sgd.BATCH):
        part = order[a : a + sgd.BATCH]
        g = -y[part] / (1 + np.exp(y[part] * (x[part] @ w))) / len(part)
        used = (x[part] != 0).any(axis=0)
        gradient = (g @ x[part] + 1e-3 * w)[used]
        squares[used] += gradient**2
        w[used] -= 0.5 * gradient / (np.sqrt(squares[used]) + 1e-8)
    assert got == pytest.approx(w) and touched.tolist() == (x != 0).sum(0).tolist()


def test_time_and_series_are_inferred(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"s{i % 4}", i % 3, start + dt.timedelta(days=i // 4), str((start + dt.timedelta(days=i // 4)).date()), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, store_id string, kind int, ts timestamp, date string, y double")
    assert profile.time_and_series(profile.column_profile(df)) == ("date", "store_id")
    assert profile.time_and_series(profile.column_profile(df.drop("store_id", "date"))) == ("ts", None)
    assert profile.time_and_series(profile.column_profile(df.select("row_id", "y"))) == (None, None)
    r = profile.series_profile(df).first()
    assert (r.n_series, r.shortest, r.longest, r.n_gaps, r.median_step, r.frequency) == (4, 20, 20, 0, 86400.0, "D")
    r = profile.series_profile(df.where("ts <> timestamp'2024-01-05'").select("ts", "y")).first()
    assert (r.series_column, r.n_series, r.longest, r.n_gaps, r.median_step) == (None, 1, 76, 1, 86400.0)
    assert profile.series_profile(df.select("row_id", "y")).count() == 0


def test_default_time_and_file_order(spark):
    """Without a time a table is split in file order, alike however its files are cut, Parquet or not."""
    start = dt.datetime(2024, 1, 1)
    df = spark.range(0, 900, 1, 3).select("id", F.concat(F.lit("r"), "id").alias("s"))
    for kind in ("parquet", "csv", "json"):
        path = new_path(spark, "ordered")
        df.write.format(kind).save(path)
        read = lambda: spark.read.schema("id long, s string").format(kind).load(path)  # noqa: B023, E731
        first = split.file_order(read()).orderBy("row").collect()
        assert [r.row for r in first] == list(range(900))
        by_file = {}
        for r in read().select("id", "_metadata.file_path").collect():
            by_file.setdefault(r.file_path, []).append(r.id)
        assert [r.id for r in first] == [i for f in sorted(by_file) for i in sorted(by_file[f])]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            again = split.file_order(read()).orderBy("row").collect()
            blocks = {r.id: (r.split, r.r) for r in split.temporal_split(read()).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.id for r in again] == [r.id for r in first]
        want = split.temporal_split(spark.createDataFrame([(r.id, start + dt.timedelta(minutes=r.row)) for r in first], "id long, ts timestamp"), "ts").collect()
        assert {k: v[0] for k, v in blocks.items()} == {r.id: r.split for r in want}
        assert all(abs(blocks[r.id][1] - r.r) < 1e-12 for r in want)
    dated = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 21)], "id long, sale_date string")
    assert split.default_time(dated) == "sale_date" and split.split_sizes(split.temporal_split(dated)).count() == 3


def test_calendar_frequencies(spark):
    import pandas as pd

    from gristmill.functions import calendar

    made = {"B": pd.bdate_range("2024-01-01", periods=40), "D": pd.date_range("2024-01-01", periods=40), "Q": pd.date_range("2020-03-31", periods=9, freq="QE"), "M": pd.date_range("2020-01-01", periods=12, freq="MS"), "W": pd.date_range("2024-01-03", periods=9, freq="7D"), "H": pd.date_range("2024-01-01", periods=50, freq="h"), None: pd.date_range("2020-01-15", periods=9, freq="30D")}
    rows = spark.createDataFrame([(str(k), t.to_pydatetime()) for k, ts in made.items() for t in ts], "k string, t timestamp")
    steps = profile.time_steps(rows, "t", "k").groupBy(F.col("series").alias("k")).agg(F.percentile("d", F.lit(0.5)).alias("m"))
    assert {r.k: r.frequency for r in calendar.calendar_frequency(rows, ["k"], "t", steps).collect()} == {str(k): k for k in made}


def test_shuffling_deals_all_values_anew(spark):
    from gristmill.operators.models import shuffled

    df = spark.range(0, 400, 1, 5).select("id", (F.col("id") * 2).alias("x"), F.lit("same").alias("y"))
    got = {r.id: r.x for r in shuffled(df, "x", "id", 0).collect()}
    assert sorted(got) == list(range(400)) and sorted(got.values()) == [2 * i for i in range(400)]
    assert sum(v == 2 * k for k, v in got.items()) < 10 and got != {r.id: r.x for r in shuffled(df, "x", "id", 1).collect()}


def test_final_fit_must_use_all_rows(spark):
    plans = [("a", "linear"), ("b", "linear")]
    _, seen = halving.successive_halving(spark, plans, 400, lambda plan, rows: (0.5, rows), min_rows=100)
    assert seen.where("final").first().fidelity_rows == 400
    with pytest.raises(ValueError, match="100 of 400"):
        halving.successive_halving(spark, plans, 400, lambda plan, rows: (0.5, min(rows, 100)), min_rows=100)


def test_boosting_is_cut_by_the_backtest(spark):
    """A weekly pattern with a late jump in the validation block: the cut round is the best of all on it, and no feature looks past its origin."""
    import random

    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=i), 10.0 + 5 * (i % 7 == 3) + rng.random() + (ord(s) - 97)) for s in "ab" for i in range(140)]
    series = spark.createDataFrame(rows, "sid string, ts timestamp, y double")
    block = lambda a, b: series.where(F.datediff("ts", F.lit(start)).between(a, b - 1))
    out, errors = forecast.boosted_forecast(block(0, 90), block(90, 112), block(112, 140), 7, 7, {"maxIter": 12, "subsamplingRate": 1.0})
    assert len(errors) == 12
    scored = out.agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("e"), F.count("p").alias("n")).first()
    mean = block(112, 140).withColumn("p", F.lit(block(0, 112).agg(F.avg("y")).first()[0])).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert scored.n == 56 and scored.e < 0.6 * mean
    late = series.withColumn("y", F.when(F.datediff("ts", F.lit(start)) >= 126, 1000.0).otherwise(F.col("y")))
    part = late.where(F.datediff("ts", F.lit(start)).between(112, 139))
    a, b = ({(r.sid, r.target_ts): (r.lag1, r.mean7, r.seasonal) for r in forecast.backtest_rows(block(0, 112), x, 7, 7).collect()} for x in (block(112, 140), part))
    assert all(a[k] == b[k] for k in a if (k[1] - start).days < 133)


@pytest.mark.parametrize("classes", [1, 3])
def test_extra_trees_equal_plain_ones(spark, classes):
    """Grown one node after another from the same draws, every tree is the same; thresholds are no values or quantiles of the data."""
    import numpy as np

    from gristmill.operators import extra_trees as E

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random(300), rng.integers(0, 4, 300), rng.normal(size=300), np.ones(300)])
    y = (3 * x[:, :1] + x[:, 1:2] ** 2) if classes == 1 else np.eye(3)[np.digitize(x[:, 0] + 0.2 * x[:, 1], [0.4, 0.9])]
    rows = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(5)
    model = E.fit(rows, classes, trees=3, depth=5, least_leaf=4, k=2, seed=9)

    def grow(tree, number, at):
        assert model.values[tree, number] == pytest.approx(y[at].mean(axis=0))
        splits = E.draws(9, tree, number, x[at].min(axis=0), x[at].max(axis=0), 2) if number.bit_length() <= 5 and len(at) >= 8 else []
        spread = []
        for f, cut in splits:
            left, right = at[x[at, f] <= cut], at[x[at, f] > cut]
            spread.append(sum(((y[s] - y[s].mean(axis=0)) ** 2).sum() for s in (left, right)) if min(len(left), len(right)) >= 4 else np.inf)
        if not splits or not np.isfinite(min(spread)):
            assert model.features[tree, number] == -1
            return
        f, cut = splits[int(np.argmin(spread))]
        assert (model.features[tree, number], model.thresholds[tree, number]) == (f, cut)
        grow(tree, 2 * number, at[x[at, f] <= cut])
        grow(tree, 2 * number + 1, at[x[at, f] > cut])

    for tree in range(3):
        grow(tree, 1, np.arange(300))
    got = E.predict(model, rows).toPandas()
    if classes == 1:
        assert ((got["prediction"] - got["y"].str[0]) ** 2).mean() < 0.5 * y.var()
    else:
        assert (got["prediction"] == got["y"].map(lambda v: int(np.argmax(v)))).mean() > 0.7
    with pytest.raises(ValueError):
        E.fit(rows.where("false"))


def test_search_is_reproducible_and_learns():
    """The same draws under the same clock whatever order fits end in, a deadline, failures last, and better draws than even ones."""
    import random
    import time

    from gristmill.operators import search as K

    space = {"a": (0.0, 1.0), "b": (1, 40), "c": (-5.0, 5.0)}
    score = lambda p: -((p["a"] - 0.3) ** 2) - ((p["b"] - 30) / 40) ** 2 - (p["c"] / 10) ** 2

    def slow(p):
        time.sleep(random.random() / 50)
        return score(p)

    one, two = K.search(slow, math.inf, 20, 4, 1, space, clock=lambda: 0.0), K.search(score, math.inf, 20, 4, 1, space, clock=lambda: 0.0)
    assert one == two and len(one) == 20 and sorted(d.number for d in one) == list(range(20))
    assert all(0 <= d.params["a"] <= 1 and d.params["b"] in range(1, 41) for d in one) and [d.score for d in one] == sorted((d.score for d in one), reverse=True)
    late, early = [], []
    for seed in range(12):
        for d in K.search(score, math.inf, 40, 4, seed, space):
            (early if d.number < K.EVEN_DRAWS else late if d.number >= 24 else []).append(d.score)
    assert sum(late) / len(late) > 0.4 * sum(early) / len(early)

    ticks = iter(range(0, 10_000, 10))
    few = K.search(lambda p: 1.0, 100, 20, 1, 1, space, clock=lambda: float(next(ticks)))
    assert 1 <= len(few) < 5

    def broken(p):
        if p["a"] > 0.5:
            raise RuntimeError("no")
        return p["a"]

    mixed = K.search(broken, math.inf, 20, 3, 1, space)
    assert mixed[0].score == max(d.score for d in mixed if d.score is not None) and any(d.error == "RuntimeError: no" for d in mixed)
    assert [d.score is None for d in mixed] == sorted(d.score is None for d in mixed)


def test_closed_runs_leave_no_state(spark):
    """Every event once; once all runs are closed no state row is left, over several blocks of a run."""
    from gristmill.streaming import follow

    path, out, at = (new_path(spark, n) for n in ("log", "followed", "offsets"))
    start = dt.datetime(2024, 1, 1)
    rows = [(n, run, start, "s", "a", "info", "m", "{}") for run in ("x", "y") for n in range(1, 30_000, 500)]
    spark.createDataFrame(rows + rows[:7], tables.EVENT).repartition(3).write.json(path)
    stream = lambda: follow.follow(spark, path, max_files=1, closes=F.col("kind") == "closed")
    first = follow.run_available(stream(), out, at)
    assert first.lastProgress.stateOperators[0].numRowsTotal == 8
    last = [(30_000, run, start, "s", "a", "closed", "m", "{}") for run in ("x", "y")]
    spark.createDataFrame(last, tables.EVENT).coalesce(1).write.mode("append").json(path)
    query = follow.run_available(stream(), out, at)
    assert query.lastProgress.stateOperators[0].numRowsTotal == 0
    assert sorted((r.run_id, r.seq) for r in spark.read.parquet(out).collect()) == sorted((r, n) for n, r, *_ in rows + last)


def test_latest_states_are_compacted(spark, monkeypatch):
    from gristmill.sources import shared
    from gristmill.streaming import follow

    monkeypatch.setattr(follow, "COMPACT", 3)
    path, out, at = (new_path(spark, n) for n in ("log", "latest", "offsets"))
    start, best = dt.datetime(2024, 1, 1), {}
    for i in range(8):
        rows = [(10 * i + j, f"r{(i + j) % 5}", start, f"s{i}", "a", "k", "m", "{}") for j in range(1, 4)]
        spark.createDataFrame(rows, tables.EVENT).coalesce(1).write.mode("append").json(path)
        for n, run, _, stage, *_ in rows:
            best[run] = max(best.get(run, (0, "")), (n, stage))
        if i in (4, 7):  # two runs of one stream
            latest = follow.keep_latest(follow.read_stream(spark, path, max_files=1), out, at)
            assert {r.run_id: (r.seq, r.stage) for r in latest.collect()} == best
            assert len([f for f in shared.children(spark, out) if "batch=" in f]) <= 3

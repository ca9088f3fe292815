"""Statistics against NumPy restatements and published tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonewake.functions import tails
from tonewake.operators import features, ranks, reports, scoring, stats, validate


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    x, z = rng.normal(size=n).round(1), rng.normal(size=n)
    frame = pd.DataFrame({"x": x, "z": z, "y": 0.5 * x - 0.2 * z + rng.normal(size=n), "sector": rng.choice(["a", "b", "c"], n), "year": rng.choice([2020, 2021, 2022], n)})
    frame["ticker"], frame["date"] = [f"t{i}" for i in range(n)], pd.Timestamp("2020-01-01").date()
    return frame, spark.createDataFrame(frame).withColumn("x", F.when(F.col("ticker") != "t5", F.col("x")))


def test_tails():
    for t, df, p in ((2.228139, 10, 0.05), (1.0, 1, 0.5), (2.749996, 30, 0.01), (1.959964, 1e7, 0.05)):
        assert tails.t_two_sided(t, df) == pytest.approx(p, rel=1e-5)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, rel=1e-5)
    assert tails.correlation_p(1.0, 10) == 0.0 and tails.correlation_p(None, 10) is None


def test_correlations(data):
    frame, df = data
    got = stats.correlations(df, ["x", "z"], ["y"]).collect()
    whole = frame[frame.ticker != "t5"]
    for r in got:
        f = whole if r["feature"] == "x" else frame
        assert r["n"] == len(f)
        assert r["pearson_r"] == pytest.approx(f[r["feature"]].corr(f.y), abs=1e-6)
        assert r["spearman_r"] == pytest.approx(f[r["feature"]].rank().corr(f.y.rank()), abs=1e-6)
        assert r["gap_flag"] == (r["gap"] > 0.02)
    assert [r["feature"] for r in got] == ["x", "z"]
    assert stats.correlations(df.limit(10), ["x"], ["y"]).count() == 0


def test_regression(data):
    frame, df = data
    f = frame[frame.ticker != "t5"]
    r = stats.regression(df, "y", ["x"], ["z"])
    x = np.column_stack([np.ones(len(f)), f.x, f.z, f.sector == "b", f.sector == "c"]).astype(float)
    y = f.y.to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inverse, x)
    cov = inverse @ (x.T * (e / (1 - h)) ** 2) @ x @ inverse
    table = {t["variable"]: t for t in r["table"].collect()}
    assert list(table) == ["const", "x", "z", "sector_b", "sector_c"]
    for i, t in enumerate(table.values()):
        assert t["coef"] == pytest.approx(beta[i]) and t["std_err"] == pytest.approx(np.sqrt(cov[i, i]))
    rest = np.delete(x[:, 1:], 0, 1)
    fit = rest @ np.linalg.lstsq(rest, x[:, 1], rcond=None)[0]
    assert table["x"]["vif"] == pytest.approx(1 / (1 - fit @ fit / (x[:, 1] @ x[:, 1])))
    assert r["r_squared"] == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean()))) and r["n"] == len(f)


def test_regression_with_an_absent_level(data):
    _, df = data
    one = df.withColumn("y", F.when(F.col("sector") != "c", F.col("y")))
    r = stats.regression(one, "y", ["z"])
    assert r["n"] == one.where("y is not null").count() and {t["variable"] for t in r["table"].collect()} == {"const", "z", "sector_b", "sector_c"}


def test_quantiles(data):
    frame, df = data
    got = stats.quantile_summary(df, "z", "y").orderBy("quantile").collect()
    bins = pd.qcut(frame.z, 4, labels=False)
    for q, r in enumerate(got):
        v = frame.y[bins == q]
        assert (r["n"], r["mean"], r["std"], r["median"]) == (len(v), pytest.approx(v.mean()), pytest.approx(v.std()), pytest.approx(v.median()))
    s = stats.with_p(stats.spread(stats.binned(df, "z", "y"), "y")).first()
    top, low = frame.y[bins == 3], frame.y[bins == 0]
    a, b = top.var() / len(top), low.var() / len(low)
    assert s["t_stat"] == pytest.approx((top.mean() - low.mean()) / np.sqrt(a + b))
    assert s["df"] == pytest.approx((a + b) ** 2 / (a**2 / (len(top) - 1) + b**2 / (len(low) - 1)))
    with pytest.raises(ValueError):
        stats.quantile_summary(df.withColumn("z", F.lit(1.0)), "z", "y")
    assert stats.binned(df.withColumn("z", F.lit(1.0)), "z", "y").count() == 0


def test_groups_and_samples(data):
    frame, df = data
    by = {r["period"]: r for r in stats.spread_by_period(df, "z", "y", F.col("year")).collect()}
    for year, f in frame.groupby("year"):
        bins = pd.qcut(f.z, 4, labels=False)
        assert by[year]["spread"] == pytest.approx(f.y[bins == 3].mean() - f.y[bins == 0].mean())
        assert by[year]["n_events"] == (bins == 3).sum() + (bins == 0).sum()
    assert {r["n_events"] for r in stats.spread_by_sector(df, "z", "y").collect()} == set(frame.sector.value_counts())
    with pytest.raises(ValueError):
        stats.spread_by_sector(df.drop("sector"), "z", "y")
    with pytest.raises(ValueError):
        stats.out_of_sample(df.limit(60), "z", "y", F.col("year") <= 2020)
    out = stats.out_of_sample(df, "z", "y", F.col("year") <= 2021).groupBy("quantile").count().collect()
    edges = np.quantile(frame.z[frame.year <= 2021], [0.25, 0.5, 0.75])
    assert {r["quantile"]: r["count"] for r in out} == dict(zip(*np.unique(1 + np.searchsorted(edges, frame.z[frame.year > 2021]), return_counts=True), strict=True))


def test_bonferroni(spark):
    got = stats.bonferroni(spark.createDataFrame([(0.01,), (0.0125,), (0.2,), (None,)], "p_value double")).orderBy("p_value").collect()
    assert [r["significant"] for r in got] == [None, True, False, False] and got[0]["threshold"] == 0.0125


def test_robustness(spark):
    rng = np.random.default_rng(5)
    n = 200
    f = pd.DataFrame({c: rng.normal(size=n) for c in [*stats.SENTIMENT_FEATURES, "CAR_3d", "beta_CAR_3d"]})
    f["ceo_sentiment"] = np.nan
    f["ticker"], f["date"], f["sector"] = [f"t{i}" for i in range(n)], pd.Timestamp("2020-01-01").date(), rng.choice(["a", "b"], n)
    df = spark.createDataFrame(f).withColumn("ceo_sentiment", F.lit(None).cast("double"))
    r = stats.robustness(df, df.select("ticker", "date", *stats.SENTIMENT_FEATURES))
    rows = r["strategies"].collect()
    assert len(rows) == 6 and all(x["difference"] == pytest.approx(0) for x in rows)
    assert r["market"]["n"] == n


def test_features(spark):
    rows = [("A", "2020-01-01", "prepared_remarks", "ceo", "a b", 0.6, 0.2, 0.2), ("A", "2020-01-01", "qa_session", "analyst", "c", 0.2, 0.6, 0.2), ("A", "2020-04-01", "prepared_remarks", "cfo", "", 0.5, 0.1, 0.4), (None, "2020-04-01", "qa_session", "ceo", "x", 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "ticker string, date string, source_section string, role string, chunk_text string, positive_prob double, negative_prob double, neutral_prob double")
    a, b = features.feature_matrix(df).orderBy("date").collect()
    assert a["net_sentiment"] == pytest.approx(0) and a["qa_divergence"] == pytest.approx(-0.8) and a["sentiment_delta"] is None
    assert a["negative_chunk_pct"] == 0.5 and a["chunk_count"] == 2 and a["sentiment_variance"] == pytest.approx(np.std([0.6, 0.2], ddof=1))
    assert b["sentiment_delta"] == pytest.approx(0.4) and b["qa_divergence"] is None and b["sentiment_variance"] is None and b["cfo_sentiment"] == pytest.approx(0.4)
    assert features.transcript_aggregates(df).where("date = '2020-01-01'").first()["word_count"] == 3


def test_scorers(spark):
    df = spark.createDataFrame([("Strong growth, weak demand.",), ("",), (None,)], "chunk_text string")
    for r in scoring.score_chunks(df).collect():
        assert r["positive_prob"] + r["negative_prob"] + r["neutral_prob"] == pytest.approx(1)
    loaded = scoring.model(lambda: lambda texts: pd.DataFrame({"positive_prob": [0.5] * len(texts), "negative_prob": [0.25] * len(texts), "neutral_prob": [0.25] * len(texts)}))
    assert {tuple(r)[1:] for r in scoring.score_chunks(df, loaded).collect()} == {(0.5, 0.25, 0.25)}


def test_validation_and_reports(spark):
    df = spark.createDataFrame([("A", "d", "x" * 600), ("A", "d", " "), ("B", None, "y"), ("B", None, "z")], "ticker string, date string, transcript_text string")
    assert tuple(validate.validate(df).first()) == (4, 1, 2, 4, 1, 3)
    assert reports.sampled(df, "transcript_text", 2).count() == 2
    table = spark.createDataFrame([("a", 0.1), ("b", -0.5)], "feature string, r double").withColumn("target", F.lit("t"))
    assert reports.strongest(table, "r").first()["feature"] == "b"
    assert reports.heatmap(table, "r", ["t", "u"]).columns == ["feature", "t", "u"]


def test_order_statistics_with_hot_values(spark):
    rng = np.random.default_rng(8)
    f = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 4000, p=[0.8, 0.19, 0.01]), "v": np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000) * 10.0 ** rng.integers(-3, 6, 4000))})
    df = spark.createDataFrame(f).repartition(5).unionByName(spark.createDataFrame([("d", None), (None, 1.0)], "g string, v double"))
    points = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    got = {r["g"]: r for r in ranks.quantiles(df, "v", points, ["g"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, part in f.groupby("g"):
        assert got[g]["n"] == len(part) and got[g]["edges"] == pytest.approx(np.quantile(part.v, points).tolist(), rel=1e-12)
    whole = ranks.quantiles(df.where("g is not null"), "v", points).collect()
    assert len(whole) == 1 and whole[0]["edges"] == pytest.approx(np.quantile(f.v, points).tolist(), rel=1e-12)
    assert ranks.quantiles(df.where("1 = 0"), "v", points).count() == 0
    ranked = ranks.average_ranks(df.dropna(), ["g"], "v", "r").toPandas()
    want = f.assign(r=f.groupby("g").v.rank())
    key = ["g", "v", "r"]
    assert ranked[key].sort_values(key, ignore_index=True).equals(want[key].sort_values(key, ignore_index=True))


def test_scoring_helpers(spark):
    rows = spark.createDataFrame([([0.2, 0.5, 0.3], 600), ([0.1, 0.1, 0.8], 5)], "values array<double>, chunk_token_count int")
    named = scoring.labelled(rows, {0: "neutral", 1: "Positive", 2: "negative"}).collect()
    assert [named[0][c] for c in scoring.PROBABILITIES] == [0.5, 0.3, 0.2]
    assert tuple(scoring.over_limit(rows).first()) == (1, 2)
    assert scoring.seconds_per_chunk(spark.createDataFrame([("good",)], "chunk_text string")) > 0


def test_models_and_pools(data):
    _, df = data
    made = stats.regression_table(df, ["y"], ["x"], ["z"])
    assert sorted((r["model"], r["variable"]) for r in made.collect()) == [("A", "x"), ("B", "x")]
    pools = stats.significance_pools(stats.correlations(df, ["x", "z"], ["y"]), made).collect()
    assert {(r["pool"], r["n_tests"]) for r in pools} == {("correlation", 2), ("regression", 2)}


def test_analysis_table_is_made_once(spark, sf, tmp_path, monkeypatch):
    from tonewake.plans import analysis, catalog, tables

    made = []
    ready = analysis.ready
    monkeypatch.setattr(analysis, "ready", lambda *a: made.append(ready(*a)) or made[-1])
    catalog.QUERIES["bonferroni_pools"](spark, sf.replace("sf0.001", "sf0.01"))
    assert len(made) == 1
    # an event that comes twice is two chunks, not four
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.unionByName(events).write.parquet(f"{tmp_path}/events.parquet")
    assert tables.analysis_scores(spark, str(tmp_path)).count() == 2 * events.count()

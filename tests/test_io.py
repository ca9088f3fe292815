"""Sources, sinks, resumable batches and the stream."""

import pytest

from tonewake.operators import scoring
from tonewake.operators import transcripts as T
from tonewake.sources import io, scratch
from tonewake.streaming.scoring import TRANSCRIPTS, score_available

RAW = [(["Jan. 31, 2019 11:00 a.m. ET"], "NYSE: GFF", " 2019-Q1 ", " gff ", "a\nQuestions and Answers:\nb"), (None, None, None, None, None)]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame(RAW, io.RAW)
    df.write.parquet(f"{tmp_path}/r.parquet")
    df.write.json(f"{tmp_path}/r.json")
    df.selectExpr("date[0] as date", "exchange", "q", "ticker", "transcript").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{tmp_path}/r.csv")
    for ending in ("parquet", "json", "csv"):
        row = io.load_transcripts(spark, f"{tmp_path}/r.{ending}").where("ticker is not null").first()
        assert (row["ticker"], str(row["date"]), row["fiscal_quarter"], row["exchange"], row["has_qa_section"]) == ("GFF", "2019-01-31", "2019-Q1", "NYSE", True)
    with pytest.raises(ValueError):
        io.read_raw(spark, "x.pkl")


def test_scores(spark, tmp_path):
    df = spark.createDataFrame([("A", 0.5, 0.3, float("nan"))], "ticker string, positive_prob double, negative_prob double, neutral_prob double")
    io.write_scores(df, f"{tmp_path}/s", "lexicon", False)
    assert io.read_scores(spark, f"{tmp_path}/s").first()["neutral_prob"] is None
    assert io.read_scores(spark, f"{tmp_path}/s", ["ticker"]).columns == ["ticker"]
    about = spark.read.json(f"{tmp_path}/s.meta.json").first()
    assert (about["chunk_count"], about["batch_size"]) == (1, 32) and about["avg_batch_time_s"] > 0
    io.write_table(df.drop("neutral_prob"), f"{tmp_path}/t")
    with pytest.raises(ValueError):
        io.read_scores(spark, f"{tmp_path}/t")


def test_batches(spark, tmp_path):
    path = f"{tmp_path}/b"
    df = spark.range(5)
    io.write_batch(df, path, 0, 5)
    io.write_batch(df, path, 5, 10)
    io.write_batch(df, path, 5, 10)
    assert io.merge_batches(spark, path).count() == 10
    assert tuple(io.progress(io.batches(spark.read.parquet(path)), 12).first()) == (10, 2, pytest.approx(12.2))
    io.write_batch(df, path, 12, 17)
    with pytest.raises(ValueError):
        io.merge_batches(spark, path)


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i}", None, "2020-Q1", "NYSE", f"Jo -- Treasurer\nStrong growth {i}.", False) for i in range(25)], TRANSCRIPTS).repartition(3)
    ran = []

    def score(part):
        ran.append(part.count())
        return scoring.score_chunks(T.chunk_transcripts(part))

    path = f"{tmp_path}/batches"
    assert tuple(io.score_batches(df.repartition(4), path, score, 10).first())[:2] == (25, 0) and ran == [10, 10, 5]
    assert len({r["ticker"] for r in io.merge_batches(spark, path).select("ticker").collect()}) == 25
    spark._jvm.java.io.File(f"{path}/start=10").renameTo(spark._jvm.java.io.File(f"{tmp_path}/away"))
    io.score_batches(df, path, score, 10)
    assert ran[3:] == [10] and io.merge_batches(spark, path).select("ticker").distinct().count() == 25
    io.score_batches(df, path, score, 10, force=True)
    assert ran[4:] == [10, 10, 5]
    numbers = io.numbered(df, ["ticker"], per_part=4)
    assert sorted(r["position"] for r in numbers.collect()) == list(range(25))


def test_scratch(spark, monkeypatch):
    kept = scratch.cut(spark.range(3), "a")
    path = kept.scratch_path
    assert kept.count() == 3 and scratch.exists(spark, path)
    scratch.drop(kept)
    assert not scratch.exists(spark, path)

    class Unset:
        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def isLocal(self):
            return False

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: Session.conf)
            _jsc = type("J", (), {"sc": staticmethod(Unset)})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.shared_dir(Session)


def test_prices(spark, tmp_path):
    spark.createDataFrame([("A", "2020-01-01", 1.0), ("A", "2020-01-01", 1.0), ("B", "2020-01-01", float("nan"))], "ticker string, day string, close double").write.parquet(f"{tmp_path}/p")
    assert {tuple(r) for r in io.read_prices(spark, f"{tmp_path}/p").select("ticker", "close").collect()} == {("A", 1.0), ("B", None)}


def test_stream_scores_each_file_once(spark, tmp_path):
    def arrive(ticker):
        spark.createDataFrame([(ticker, None, "2020-Q1", "NYSE", "Jo -- Treasurer\nStrong growth. Weak demand.", False)], TRANSCRIPTS).write.mode("append").parquet(f"{tmp_path}/in")

    arrive("A")
    for n in (1, 2):
        score_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").select("ticker").distinct().count() == n
        arrive("B")


def test_stream_scores_a_call_once(spark, tmp_path):
    for n, texts in enumerate((["Jo -- Treasurer\nShort.", "Jo -- Treasurer\nA longer one."], ["Jo -- Treasurer\nThe longest of them, but late."])):
        rows = [("A", None, "2020-Q1", "NYSE", t, False) for t in texts] + [(f"B{n}", None, "2020-Q1", "NYSE", "Jo -- Treasurer\nOwn.", False)]
        spark.createDataFrame(rows, TRANSCRIPTS).write.mode("append").parquet(f"{tmp_path}/in")
        score_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r["ticker"], r["chunk_text"]) for r in spark.read.parquet(f"{tmp_path}/out").where("not overlap").collect()}
    assert got == {("A", "A longer one."), ("B0", "Own."), ("B1", "Own.")}

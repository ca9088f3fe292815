"""Dates, call times, sections, cleaning, speakers and chunks."""

import re

import pytest
from pyspark.sql import functions as F

from tonewake.functions import patterns as P
from tonewake.functions import text as X
from tonewake.operators import transcripts as T


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("parts", "minutes"),
    [(["Aug 5, 2020, 8:30 a.m. ET"], 510), (["Aug 27, 2020, 9:00 p.m. ET"], 1260), (["Aug 5, 2020, 4:00 p.m. ET"], 960), (["Aug 5, 2020, 3:59 p.m. ET"], 959), (["Some Co Q2", "Jul 30, 2020, 4:30 p.m. ET"], 990), (["x 12:00 p.m. ET"], 720), (["x 12:00 a.m. ET"], 0), (["Aug 5, 2020"], None), (None, None), (["9:00 pm"], None), (["13:75 a.m."], None)],
)
def test_call_minutes(spark, parts, minutes):
    assert one(spark, parts, X.call_minutes, "array<string>") == minutes


@pytest.mark.parametrize(
    ("parts", "day"),
    [(["Aug 27, 2020, 9:00 p.m. ET"], "2020-08-27"), (["Brunswick (BC 0.66%) Q4 2018 ", "Jan. 31, 2019 11:00 a.m. ET"], "2019-01-31"), (["August 5 2020"], "2020-08-05"), (["may 3, 2021"], "2021-05-03"), (["Sept. 3, 2020"], None), (["Feb 30, 2020"], None), (["none"], None), (None, None)],
)
def test_dates(spark, parts, day):
    got = one(spark, parts, lambda x: X.parsed_date(X.date_string(x)), "array<string>")
    assert (got and str(got)) == day


def test_timing(spark):
    raw = [(" ab ", ["Aug 5, 2020, 4:00 p.m. ET"], 1), ("AB", ["Aug 5, 2020, 8:00 a.m. ET"], 2), ("c", ["Aug 6, 2020"], 3), ("d", None, 4)]
    got = {tuple(r) for r in T.call_timing(spark.createDataFrame(raw, "ticker string, date array<string>, ordinal long")).select("ticker", F.col("call_date").cast("string"), "after_close").collect()}
    assert got == {("AB", "2020-08-05", True), ("C", "2020-08-06", True)}


def sections(spark, text):
    return tuple(T.with_sections(spark.createDataFrame([(text,)], "transcript_text string")).select("prepared_remarks", "qa_session").first())


def test_sections(spark):
    assert sections(spark, "Prepared Remarks:\na\nQUESTIONS & ANSWERS:\nb\nDuration: 12 minutes\nc") == ("a", "b")
    for header in ("Questions and Answers:", "Question-and-Answer Session", "questions and answers"):
        assert sections(spark, f"a\n{header}\nb") == ("a", "b")
    analyst = "Jo -- Bank -- Analyst"
    assert sections(spark, "\n".join([*"abcdefghij", analyst, "q"])) == ("\n".join("abcdefghij"), f"{analyst}\nq")
    assert sections(spark, "\n".join([*"abcdefghi", analyst, "q"])) == ("\n".join([*"abcdefghi", analyst, "q"]), "")
    assert sections(spark, "\n".join([*"abcdefghij", "Jo -- A -- B -- Analyst"]))[1] == ""
    assert sections(spark, "") == sections(spark, None) == ("", "")


def test_cleaning(spark):
    text = " a  b \n\n\n[operator instructions] Please go ahead. x\nThis call may contain forward-looking statements and\nmore. End.  "
    assert one(spark, text, T.cleaned) == "a b\n\n. x\nEnd."
    assert one(spark, "", T.cleaned) == ""


def said(spark, text):
    return [tuple(t) for t in one(spark, text, T.turns)]


def test_speakers(spark):
    text = "hello\noperator\nNext.\nJo Doe -- Chief Executive Officer\nHi.\nthere\nEmpty -- Title\nMax -- Bank -- Analyst\nQ?"
    assert said(spark, text) == [("Unknown", "unknown", "hello"), ("Operator", "operator", "Next."), ("Jo Doe", "ceo", "Hi.\nthere"), ("Max", "analyst", "Q?")]
    for n, expected in ((119, [("N", "executive", "x")]), (120, None)):
        line = "N -- " + "t" * (n - 5)
        got = said(spark, f"{line}\nx")
        assert got == (expected or [("Unknown", "unknown", f"{line}\nx")])


@pytest.mark.parametrize(("title", "expected"), [("CEO", "executive"), ("Chief Executive Officer", "ceo"), ("EVP and CFO", "cfo"), ("Head of Investor Relations", "ir"), ("Senior Analyst", "analyst"), ("Treasurer", "executive")])
def test_roles(spark, title, expected):
    assert one(spark, title, lambda x: T.role(x, F.lit(None).cast("string"))) == expected


def plain_pack(text, limit=512):
    tokens = lambda s: max(1, round(len(s) / 4.5))
    out, now, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if now and n + tokens(s) > limit:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += tokens(s)
    return [*out, " ".join(now)] if now else out


def test_chunks(spark):
    assert one(spark, "x" * 2304, X.token_estimate) == 512
    assert one(spark, "x" * 2307, X.token_estimate) == 513
    long = " ".join("word " * (5 + i % 40) + "end." for i in range(60))
    assert one(spark, long, lambda x: T.packed_sentences(x, 100)) == plain_pack(long, 100)
    assert one(spark, "z" * 4000 + ".", lambda x: T.packed_sentences(x, 100)) == ["z" * 4000 + "."]


def test_overlap_runs_to_the_end():
    text = " ".join(f"{i}." for i in range(10))
    assert [c.split()[0] for c, _ in T.overlapping(text)] == ["0.", "5.", "7.", "8.", "9."]
    assert T.overlapping(text)[0][1] == 10
    assert T.overlapping("a" * 5000 + ". b.", 100)[0][0] == "a" * 5000 + "."
    assert T.overlapping("") == [] and T.overlapping(None) == []


def test_transcript_chunks(spark):
    rows = [("A", "short"), ("A", "Jo -- Chief Executive Officer\nHi. There.\nQuestions and Answers:\nMax -- Bank -- Analyst\nWhy?"), ("B", None)]
    df = spark.createDataFrame([(t, None, "2020-Q1", "NYSE", x) for t, x in rows], "ticker string, date date, fiscal_quarter string, exchange string, transcript_text string")
    got = [tuple(r) for r in T.chunk_transcripts(df).select("source_section", "role", "chunk_text", "chunk_index", "overlap").collect()]
    assert sorted(got) == sorted([("prepared_remarks", "ceo", "Hi. There.", 0, False), ("qa_session", "analyst", "Why?", 0, False), ("prepared_remarks", "mixed", "Hi. There.", 0, True), ("prepared_remarks", "mixed", "There.", 1, True), ("qa_session", "mixed", "Why?", 0, True)])
    assert P.MAX_TOKENS == 512


def test_timing_takes_no_sort_and_reads_patterns_once(spark):
    raw = [("a", ["Aug 5, 2020, 8:00 a.m. ET"], 2), ("a", ["Aug 5, 2020, 8:00 p.m. ET"], 1), ("b", ["Aug 5, 2020"], 1), ("b", ["Aug 5, 2020, 8:00 a.m."], 1), ("c", ["Aug 5, 2020, 8:00 a.m."], 1), ("c", ["Aug 5, 2020, 8:00 p.m."], None), ("d", ["8:00 a.m."], 1)]
    got = T.call_timing(spark.createDataFrame(raw, "ticker string, date array<string>, ordinal long"))
    assert sorted((r["ticker"], r["after_close"]) for r in got.collect()) == [("A", True), ("B", False), ("C", True)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("regexp_extract(") == 2 and tree.count("regexp_extract_all(") == 1


def test_overlapping_chunks_stay_in_the_jvm(spark):
    texts = [None, "", " \x1c", ". . !", " a. b.\x1cc!  d?e. ", "a" * 5000 + ". b.", " ".join("w" * (1 + i * 37 % 300) + ".!?"[i % 3] for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit, given in ((512, ()), (40, (40,))):
        out = df.select("i", T.overlapping_chunks(F.col("t"), *given).alias("c"))
        assert {r["i"]: [tuple(c) for c in r["c"]] for r in out.collect()} == {i: T.overlapping(t, limit) for i, t in enumerate(texts)}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan

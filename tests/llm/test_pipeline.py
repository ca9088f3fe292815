"""The pipeline's stages, each against a plain restatement on its own input, and the SQL of this package's queries."""

import glob
import os
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
from test_operators import check_mix, key, rows

import corpus_pipeline
from tonewake.llm import mixing, quality, queries, state


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = state.cut(stage(spark, docs, sf), "test-stage")
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    first = stages[""].columns
    assert all(df.columns == first for name, df in stages.items() if name != "training order")


def test_quality_stage(stages):
    judged = {d: quality.judge(t) for d, t in texts(stages[""])}
    assert dict(texts(stages["quality rules"])) == {d: clean for d, (values, clean) in judged.items() if values[6]}


def test_near_duplicates_stage(stages):
    before = texts(stages["quality rules"])
    assert sorted(d for d, _ in texts(stages["near duplicates"])) == sorted(d for d, _, c in brute.components(before) if c == d)


def test_decontamination_stage(spark, sf, stages):
    items = rows(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))
    before = texts(stages["near duplicates"])
    assert sorted(texts(stages["decontamination"])) == sorted(x for x, r in zip(before, brute.decontamination(before, items), strict=True) if not r[3])


def test_mix_stage(stages):
    docs = stages["decontamination"]
    mixed = mixing.mix(docs).collect()
    check_mix(mixed, docs.collect())
    assert Counter(d for d, _ in texts(stages["source mix"])) == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})


def test_order_stage(stages):
    tokens = defaultdict(int)
    for r in stages["training order"].collect():
        tokens[r["doc_id"]] += r["n_tokens"]
    from tonewake.llm.ordering import tokenizer

    want = defaultdict(int)
    for d, t in texts(stages["source mix"]):
        want[d] += len(tokenizer(queries.TOKENIZER)(t))
    assert tokens == want


def test_stages_take_edge_rows(spark, edge):
    docs = edge.select("doc_id", "text", "lang", "source").withColumn("n_chars", edge["doc_id"])
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"],) for r in kept), key=key) == sorted([(1,), (2,), (3,), (4,), (None,), (6,), (7,), (8,), (9,), (10,), (11,)], key=key)
    assert corpus_pipeline.quality_rules(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.source_mix(spark, docs, "").columns == docs.columns


def test_near_duplicates_of_reused_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(1, text), (5, text + " end"), (5, "another text of quite other words that links with nothing"), (None, text + " more"), (7, ""), (7, ""), (8, "alone here"), (8, "alone here"), (5, text)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(texts(corpus_pipeline.near_duplicates(spark, docs, ""))) == sorted([(1, text), (5, data[2][1]), (7, ""), (7, ""), (8, "alone here")])


def test_edge_rows_and_nothing_go_through_all_stages(spark, sf, edge, documents):
    rows_ = edge.select("doc_id", "text", "lang", "source").withColumn("n_chars", edge["doc_id"])
    clean = [(5000 + i, " ".join(f"Line{j} says word{i}x{j} while thing{i}y{j} goes over{j} well{i}z{j}." for j in range(20)), "en", None if i % 2 else "s", 1) for i in range(6)]
    docs = rows_.unionByName(spark.createDataFrame(clean, rows_.schema))
    for first in (docs, documents.where("1 = 0")):
        now = first
        for name, stage in corpus_pipeline.STAGES:
            now = state.cut(stage(spark, now, sf), "edge-stage")
            if name != "training order":
                assert now.columns == first.columns
            if name == "decontamination" and first is docs:
                assert {d for d, _ in texts(now)} >= {5000 + i for i in range(6)}
        tokens = now.count()
        assert (tokens > 0) == (first is docs)


def test_decontamination_stage_keeps_rows_without_words(spark, sf, edge):
    docs = edge.select("doc_id", "text", "lang", "source").withColumn("n_chars", edge["doc_id"])
    kept = texts(corpus_pipeline.decontamination(spark, docs, sf))
    assert len(kept) == docs.count() and corpus_pipeline.training_order(spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    made = c.sql(queries.ORACLES[name])
    at = [made.columns.index(x) for x in columns]
    assert sorted(made.columns) == columns
    assert sorted(map(str, (tuple(r[x] for x in columns) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in made.fetchall())))

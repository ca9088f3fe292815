"""Each operator against a plain restatement, on a small table and on edge rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGE
from pyspark.sql import functions as F

from tonewake.llm import decontaminate, hmm, kernels, langid, linededup, mixing, ordering, quality, queries, sharding, simjoin, state, surrogates


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


def pairs(df):
    return rows(df.select("doc_id", "text"))


# --- decontamination


def test_decontamination(spark, sf, documents):
    items = rows(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))
    got = rows(queries.op1_decontamination(spark, sf))
    same(got, brute.decontamination(pairs(documents), items))
    assert any(r[5] for r in got) or any(r[3] for r in got)


def test_decontamination_edges_and_blocks(spark, edge, empty):
    items = [(1, "two three"), (2, "one two three four"), (2, "row without an id but with a text of some"), (3, None), (None, "x"), (4, "..."), (5, "привет мир это текст без номера ПРИВЕТ мир"), (5, "x"), (6, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontamination([(r[0], r[1]) for r in EDGE], items)
    same(rows(decontaminate.digest(decontaminate.decontaminate(edge, bench, ["doc_id", "n_words", "lang"]))), want)
    same(rows(decontaminate.digest(decontaminate.decontaminate(edge, bench, ["doc_id"], block_bytes=20))), want)
    assert rows(decontaminate.decontaminate(empty, bench, ["doc_id"])) == []
    assert all(r[2] == 0 for r in rows(decontaminate.digest(decontaminate.decontaminate(edge, bench.where("1 = 0"), ["doc_id"]))))


def test_wu_manber_skips_nothing():
    rng = np.random.default_rng(0)
    for m in range(1, 9):
        words = [b"w%d" % x for x in rng.integers(0, 4, 3000)]
        patterns = {tuple(b"w%d" % x for x in rng.integers(0, 4, m)): {str(k)} for k in range(6)}
        found = Counter((end, min(n)) for end, n in decontaminate.WuManber(m, patterns).find(words))
        assert found == Counter((i + m, min(patterns[tuple(words[i : i + m])])) for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in patterns)


# --- mixing


def check_mix(got, docs):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(brute.SPACES.findall(r["text"] or ""))
    want, taken, largest = brute.targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * largest[s] + 3


def test_mixing(documents):
    got = mixing.mix(documents).collect()
    assert len(got) == documents.count()
    check_mix(got, documents.collect())
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_mixing_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE)
    check_mix(got, [dict(zip(("doc_id", "text", "source"), r[:3], strict=True)) for r in EDGE])
    assert mixing.mix(empty).count() == 0
    assert mixing.take(mixing.mix(edge)).columns == [c for c in edge.columns if c != "size"]
    assert all(r["copies"] == 0 and r["target"] == 0 for r in mixing.mix(edge.where("doc_id in (1, 2)")).collect())


def test_mixing_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 50)
    data = [(7 if i % 2 else None, f"w{i} " * 20, "s") for i in range(600)] + [(i, "a b c", "t") for i in range(50)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    taken = [sorted((r["text"], r["copies"]) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 4)]
    assert taken[0] == taken[1]
    check_mix(mixing.mix(docs).collect(), docs.collect())


def test_mixing_of_one_source_that_holds_a_third(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 100)
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id < 1000 then 'hot' else concat('s', id % 9) end as source", "repeat('w ', cast(5 + id % 40 as int)) as text")
    check_mix(mixing.mix(docs).collect(), docs.collect())


def test_mixing_reads_texts_once_and_holds_no_words(spark, sf, edge, documents):
    plan = queries.op2_mixing(spark, sf)._jdf.queryExecution().toString()
    assert "text" not in plan and "regexp" not in plan
    for docs in (edge, documents):
        want = [(r["doc_id"], r["source"], *r[-4:]) for r in mixing.mix(docs).collect()]
        same(rows(mixing.mix(docs, columns=["doc_id", "source"])), want)
        assert "regexp_extract_all" not in mixing.mix(docs)._jdf.queryExecution().toString()


def test_words_of_a_text(spark):
    texts = [None, "", " ", " \t\n\x0b\x0c\r", " a ", "a", "a  b\t\tc\n\n\n d", "a\x0bb\x0cc\rd", "\n\ta\t\nb", "é\u00a0ü 漢字 \x1c x", "\x00 $1 \\", "a " * 50_000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [(r[0] or 0) for r in rows(docs.select(mixing.n_words("text")))] == [len(brute.SPACES.findall(t or "")) for t in texts]


# --- quality


def test_quality_base(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, sf).collect()}
    for d, t in pairs(documents):
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.quality_base(t)
        assert not (got[d]["base_failed"] and got[d]["kept"])


def test_quality_edges(edge, empty):
    got = quality.quality(edge, ["doc_id", "n_words", "source"], cleaned=True).collect()
    want = [(r[0], *brute.quality_base(r[1])) for r in EDGE]
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got], want)
    assert quality.quality(empty, ["doc_id"]).count() == 0


def test_quality_verdicts(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.quality(documents, ["doc_id"]).join(labels, "doc_id").where("n_words >= 50 and not base_failed").collect()
    assert all(r["kept"] for r in judged if r["quality"] == 1)
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(bad) <= 0.1 * len(bad)


@pytest.mark.parametrize(("line", "rule"), [("Home | News | Contact | About", "navigation"), ("All rights reserved by us.", "boilerplate"), ("A title without an end", "punctuation"), ("A sentence.", None), ("WOW!! SUCH!! TEXT!!", "punctuation"), ("word### other%%% third&&&.", "punctuation"), ("He said: yes!", None)])
def test_line_rules(line, rule):
    assert quality.failed_rule(line) == rule


@pytest.mark.parametrize("line", ["Alle Rechte vorbehalten, und das gilt.", "Politique de confidentialité du site.", "Haga clic aquí, por favor."])
def test_line_rules_of_other_languages(line):
    assert quality.failed_rule(line) is None and quality.failed_rule(line, quality.OTHER_LANGUAGES) == "boilerplate"


# --- line dedup


def plain_lines(html):
    t = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ", html or "")
    t = re.sub(linededup.BREAKS, "\n", t)
    t = re.sub(linededup.TAGS, "", t)
    for a, b in linededup.ENTITIES:
        t = t.replace(a, b)
    return [x.strip(" \t\r") for x in t.split("\n") if x.strip(" \t\r")]


def plain_dedup(pages, ratio=0.1, least=10):
    total, count = Counter(), Counter()
    split = []
    for page, url, html in pages:
        m = re.match(linededup.HOST, url or "")
        host, lines = m[1].lower() if m else None, plain_lines(html)
        split.append((page, host, lines))
        total[host] += 1
        count.update((host, x) for x in set(lines))
    out = []
    for page, host, lines in split:
        common = host is not None and total[host] >= least
        kept = [x for x in lines if not (common and count[host, x] > ratio * total[host])]
        out.append((page, host, len(lines), kept, len(lines) - len(kept)))
    return out


def test_line_dedup(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    got = rows(linededup.dedup_lines(pages, ["page_id"]))
    same([(a, b, c, tuple(d), e) for a, b, c, d, e in got], [(a, b, c, tuple(d), e) for a, b, c, d, e in plain_dedup(rows(pages.select("page_id", "url", "html")))])
    assert sum(r[4] for r in got) > 0


def test_small_hosts_are_judged_and_lines_at_the_ratio_stay(spark):
    def kept(n, on, ratio):
        rows_ = [(i, f"http://h{n}.example/{i}", f"<p>own {i}</p>" + ("<p>Menu</p>" if i < on else "")) for i in range(n)]
        got = linededup.dedup_lines(spark.createDataFrame(rows_, "page_id long, url string, html string"), ["page_id"], ratio, 1, repeats=2).collect()
        return sum("Menu" in r["kept_lines"] for r in got), sum(r["n_dropped"] for r in got)

    assert kept(8, 8, 0.1) == (0, 8) and kept(3, 2, 0.1) == (0, 2) and kept(9, 1, 0.1) == (1, 0)
    assert kept(10, 5, 0.5) == (5, 0) and kept(10, 6, 0.5) == (0, 6)
    long = [(i, "http://long.example/x", "<p>all</p>" + "".join(f"<p>line {k} of {i}</p>" for k in range(4000))) for i in range(3)]
    got = linededup.dedup_lines(spark.createDataFrame(long, "page_id long, url string, html string"), ["page_id"], 0.1, 1, repeats=2).collect()
    assert all(r["n_lines"] == 4001 and r["n_dropped"] == 1 for r in got)


def test_line_dedup_edges(spark):
    same_line = "<p>Menu</p>"
    data = [(1, "http://h.example/1", same_line + "<p>a</p>"), (1, "http://h.example/1", same_line + "<p>a</p>"), (2, "http://u@H.example:80/2", same_line + same_line + "b"), (3, "http://h.example", None), (4, None, same_line), (5, "no url", ""), (None, "http://h.example/x", "&lt;c&gt;<script>x</script>")]
    pages = spark.createDataFrame([(*r, "old") for r in data], "page_id long, url string, html string, n_lines string")
    same([(a, b, c, tuple(d), e) for a, b, c, d, e in rows(linededup.dedup_lines(pages, ["page_id", "n_lines"], 0.5, 3))], [(a, b, c, tuple(d), e) for a, b, c, d, e in plain_dedup(data, 0.5, 3)])
    assert linededup.dedup_lines(pages.where("1 = 0"), ["page_id"]).count() == 0
    salted = rows(linededup.dedup_lines(pages, ["page_id"], 0.5, 3, broadcast_marks=0))
    same([(a, b, c, tuple(d), e) for a, b, c, d, e in salted], [(a, b, c, tuple(d), e) for a, b, c, d, e in plain_dedup(data, 0.5, 3)])


# --- HMM


def plain_base(docs):
    out, count = [], Counter()
    tokens = [(d, [w for w in brute.SPACES.findall(brute.lower(t))] + [None]) for d, t in docs]
    held = [zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, _ in tokens]
    for (_, w), h in zip(tokens, held, strict=True):
        if not h:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for (d, w), h in zip(tokens, held, strict=True):
        out.append((d, h, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    return out


def check_scores(got, docs):
    want = sorted(plain_base(docs), key=lambda r: key((r[0], r[5])))
    for g, w in zip(sorted(got, key=lambda r: key((r[0], r[5]))), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-6)


def test_hmm(documents, monkeypatch):
    monkeypatch.setattr(hmm, "HOT", 500)  # so that most words take the way of the rare
    got = rows(hmm.score(documents))
    check_scores(got, pairs(documents))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def plain_score(docs, words, model):
    """The model's score of each text, word by word, with counts of its own; P(word | class) from the classes' own sizes."""
    start, move, emit = model[:3]
    seqs = [(d, brute.SPACES.findall(brute.lower(t))) for d, t in docs]
    count = Counter(w for d, ws in seqs if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2 for w in ws)

    def hashed(w):
        (_, _, h, e), *_ = hmm.tokens(pa.array([w]))
        return int(h[0]), int(e[0])

    keys = {w: hashed(w) for _, ws in seqs for w in ws}
    place = {int(h): i for i, h in enumerate(words.h)}
    sizes, kinds = Counter(), Counter()
    for w, c in count.items():
        if keys[w][0] not in place:
            sizes[keys[w][1]] += c
            kinds[keys[w][1]] += 1
    out = []
    for d, ws in seqs:
        total, a = 0.0, start
        for k, w in enumerate([*ws, None]):
            if w is None:
                cls, given = 0, 1.0
            elif keys[w][0] in place:
                cls, given = 1 + place[keys[w][0]], 1.0
            else:
                e = keys[w][1]
                cls, given = 1 + len(place) + e, (count[w] + 1) / (sizes[e] + kinds[e] + 1)
            a = (a @ move if k else a) * emit[:, cls].astype(float)
            total += math.log10(a.sum()) + math.log10(given)
            a = a / a.sum()
        out.append((d, total))
    return out


@pytest.mark.parametrize("least", [2, 30])
def test_hmm_scores_are_those_of_a_plain_version(documents, monkeypatch, least):
    monkeypatch.setattr(hmm, "LEAST", least)
    docs = documents.limit(60).select("doc_id", "text").cache()
    trained = hmm.train(docs)
    got = {r["doc_id"]: r["score"] for r in hmm.score(docs, trained=trained).collect()}
    for d, want in plain_score(pairs(docs), *trained[:2]):
        assert got[d] == pytest.approx(want, rel=1e-9)


def test_hmm_does_not_hang_on_partitions(spark, documents):
    one = documents.where("doc_id % 3 = 0").select("doc_id", "text").limit(80).cache()
    hot = one.unionByName(spark.createDataFrame([(5, "all of these words are in a third of the rows of this table")] * 40, "doc_id bigint, text string"))
    for docs in (one, hot):
        made = [sorted((r["doc_id"], r["score"], r["base_score"]) for r in hmm.score(docs.repartition(n)).collect()) for n in (1, 5, 17)]
        for other in made[1:]:
            for x, y in zip(made[0], other, strict=True):
                assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], rel=1e-9)


def test_hmm_edges(edge, empty):
    check_scores(rows(hmm.score(edge)), [(r[0], r[1]) for r in EDGE])
    assert hmm.score(empty).count() == 0


def test_forward_is_the_sum_over_paths_and_training_climbs(documents):
    rng = np.random.default_rng(0)
    model = tuple(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, hmm.CLASSES))))
    seq = rng.integers(0, hmm.CLASSES, 5)
    total = 0.0
    for path in np.ndindex(*[3] * 5):
        p = model[0][path[0]] * model[2][path[0], seq[0]]
        for t in range(1, 5):
            p *= model[1][path[t - 1], path[t]] * model[2][path[t], seq[t]]
        total += p
    assert hmm.forward(model, seq, np.array([0, 5]))[0] == pytest.approx(math.log10(total))
    words = hmm.vocabulary(documents.select("doc_id", "text"), 4)
    _, history = hmm.baum_welch(documents.select("doc_id", "text"), words, passes=4)
    assert all(b > a for a, b in zip(history, history[1:], strict=False))


def test_states_gain_on_held_out_texts(documents):
    per = {}
    for states in (1, hmm.STATES):
        held = [r for r in hmm.score(documents, states=states).collect() if r["held_out"]]
        per[states] = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert per[hmm.STATES] > per[1] + 0.05


# --- training order


def test_permutation():
    for n in (1, 2, 3, 100, 4097):
        assert sorted(ordering.permuted(np.arange(n), n, 5)) == list(range(n))
    assert list(ordering.permuted(np.arange(50), 50, 5)) != list(ordering.permuted(np.arange(50), 50, 6))


@pytest.mark.parametrize("data", ["documents", "edge"])
def test_training_order_round_trip(spark, request, data):
    docs = request.getfixturevalue(data).select("doc_id", "text")
    folder = state.new_path(spark, "order-test")
    manifest = rows(ordering.write_training_order(docs, queries.TOKENIZER, folder, length=64, rows_per_shard=16))
    tok = ordering.tokenizer(queries.TOKENIZER)
    stored = list(ordering.read_sequences(folder, queries.TOKENIZER, 0, 64, 16))
    assert len(stored) == len({r[0] for r in manifest}) == max(r[0] for r in manifest) + 1
    assert np.array_equal(next(ordering.read_sequences(folder, queries.TOKENIZER, 17, 64, 16)), stored[17])
    got = defaultdict(dict)
    for slot, shard, row, doc, offset, at, n, crc in manifest:
        assert (shard, row) == divmod(slot, 16)
        piece = stored[slot][at : at + n]
        assert zlib.crc32(piece.tobytes()) == crc
        got[doc].setdefault(offset, []).append(piece.tolist())
    want = defaultdict(list)
    for d, t in pairs(docs):
        want[d].append(tok(t).tolist())
    for d, copies in want.items():
        assert sum(len(x) for v in got[d].values() for x in v) == sum(map(len, copies))
        if len(copies) == 1:
            assert [x for o in sorted(got[d]) for x in got[d][o][0]] == copies[0]


def test_training_order_does_not_hang_on_splits(spark, sf, tmp_path, documents):
    """Some files of several row groups, read in one split or many: the same shards."""
    path = f"{tmp_path}/docs"
    documents.limit(150).repartition(3).write.option("parquet.block.size", 20000).option("parquet.page.size", 4000).parquet(path)
    made, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1g", "9000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1" if size == "9000" else "4m")
            docs = spark.read.parquet(path)
            folder = state.new_path(spark, "order-test")
            made.append((docs.rdd.getNumPartitions(), sorted(rows(ordering.write_training_order(docs, queries.TOKENIZER, folder, length=32, rows_per_shard=64).groupBy("doc_id").agg(F.sum("n_tokens")))), [x.tobytes() for x in ordering.read_sequences(folder, queries.TOKENIZER, 0, 32, 64)]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert made[0][0] < made[1][0] and made[0][1:] == made[1][1:]


ODD = ["", " ", "a", "  a", "a  b", "a \n b", "\n\n\nx", "x \n", "we'll don't 'tis it's' 12 ٣4 é漢字!!", "a\u00a0\u00a0b\x85 c", "<|endoftext|> x<|endoftext|>", "\x00 🙂🙂 \u200b", " \t" * 50 + "y"]


def test_tokens_are_those_of_the_plain_pattern_without_lists(monkeypatch):
    import base64

    import tiktoken

    plain = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(queries.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = [*ODD, *[r[1] for r in EDGE if r[1]], *[x + y for x in ODD for y in ODD]]
    made = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})
    want = [made.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", None)
    tok = ordering.Tokenizer(queries.TOKENIZER)
    for t, ids in zip(texts, want, strict=True):
        assert tok(t).tolist() == [*ids, tok.end] and tok(t).dtype == tok.dtype and tok.count(t) == len(ids) + 1
    assert tok(None).tolist() == [tok.end] and tok.count(None) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens_of_other_files(name):
    tok = ordering.Tokenizer(f"/opt/tokenizers/{name}")
    for t in [None, *ODD]:
        assert tok(t).tolist() == [*(tok._encode(t) if t else []), tok.end] and tok(t).dtype == tok.dtype and tok.count(t) == len(tok(t))


def test_training_order_removes_what_an_earlier_run_left(spark, documents):
    folder = state.new_path(spark, "order-test")
    docs = documents.select("doc_id", "text")
    ordering.write_training_order(docs, queries.TOKENIZER, folder, length=64, rows_per_shard=16)
    import shutil

    shutil.rmtree(ordering.local(f"{folder}/manifest-0"))
    few = docs.where("doc_id < 20")
    manifest = ordering.write_training_order(few, queries.TOKENIZER, folder, length=64, rows_per_shard=16)
    assert len(list(ordering.read_sequences(folder, queries.TOKENIZER, 0, 64, 16))) == manifest.select("slot").distinct().count()


def test_training_order_of_nothing(spark, empty):
    assert ordering.write_training_order(empty, queries.TOKENIZER, state.new_path(spark, "order-test")).count() == 0


# --- similarity join


@pytest.mark.parametrize("hot", [2, 16])
def test_similarity_join(documents, monkeypatch, hot):
    monkeypatch.setattr(simjoin, "HOT", hot)
    got = simjoin.link(documents).cache()
    same(rows(got.select("doc_id", "n_shingles", "component_id")), brute.components(pairs(documents)))
    copies = Counter(brute.shingles(t) for _, t in pairs(documents))
    same(rows(got.select("doc_id", "n_copies")), [(d, copies[brute.shingles(t)] if brute.shingles(t) else 1) for d, t in pairs(documents)])


def test_similarity_join_edges(edge, empty):
    same(rows(simjoin.link(edge).select("doc_id", "n_shingles", "component_id")), brute.components([(r[0], r[1]) for r in EDGE]))
    assert simjoin.link(empty).count() == 0


@pytest.mark.parametrize("hot", [3, 16])
def test_similarity_join_of_many_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(simjoin, "HOT", hot)
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 50, 90)]
    docs = []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 5)):
            words[k] = f"x{rng.integers(0, 4)}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, " ".join(base[:60] + [f"y{i}{j}" for j in range(int(rng.integers(5, 40)))])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(rows(simjoin.link(df).select("doc_id", "n_shingles", "component_id")), brute.components(docs))


def test_similarity_join_expands_groups(spark):
    """Texts of one size and prefix that don't link: a near copy of one of them is found, whichever stands for the group."""
    tails = [[f"t{k}x{i}" for i in range(20)] for k in range(2)]
    docs = [(1000 + i, " ".join([f"f{i}y{j}" for j in range(8)] + tails[i % 2])) for i in range(60)]
    for r in range(100):
        head = [f"r{r}z{j}" for j in range(24)]
        docs += [(3 * r, " ".join(head + tails[0])), (3 * r + 1, " ".join(head + tails[1])), (3 * r + 2, " ".join([*head, *tails[r % 2][:-1], "last"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    sent = spark.sparkContext.broadcast(simjoin.levels(df, simjoin.WIDTH, 8))
    signed = df.mapInArrow(simjoin._sign(sent, simjoin.WIDTH), f"doc_id long, {simjoin.SIGNATURES}")
    assert signed.groupBy("gid").agg(F.countDistinct("cid").alias("n")).where("n > 1").count() > 5
    same(rows(simjoin.link(df).select("doc_id", "n_shingles", "component_id")), brute.components(docs))


def test_similarity_join_of_many_texts_of_one_boilerplate(spark):
    """Ten thousand texts that share most shingles and don't link, and a near copy of some: the work stays near their number."""
    shared = [f"b{i}" for i in range(100)]
    docs = [(i, " ".join([*(f"u{i}x{j}" for j in range(26)), *shared])) for i in range(10000)]
    near = [(20000 + i, docs[i][1] + " more") for i in range(0, 10000, 100)]
    df = spark.createDataFrame(docs + near, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in simjoin.link(df).select("doc_id", "component_id").collect()}
    assert len(got) == 10100 and all(got[d] == (d if d < 20000 else d - 20000) for d in got)


def plain_links(docs):
    sets = [brute.shingles(t) for _, t in docs]
    near = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    return [(d, sum(i != j and bool(near(x, y)) for j, y in enumerate(sets))) for i, ((d, _), x) in enumerate(zip(docs, sets, strict=True))]


@pytest.mark.parametrize("block", [1 << 18, 2000])
def test_similarity_join_counts_links(spark, monkeypatch, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 50, 90)]
    docs = [(900, ""), (901, None), (902, "alone with its words"), (None, " ".join(base)), (903, " ".join(base))]
    for i in range(120):
        words = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 5)):
            words[k] = f"x{rng.integers(0, 4)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_links(docs)
    assert max(n for _, n in want) > 20 and len({n for _, n in want}) > 5
    same(rows(simjoin.link(df, count_links=True).select("doc_id", "n_links")), want)


def test_link_counts_query(spark, sf, documents):
    same([(r["doc_id"], r["n_links"]) for r in queries.op7_link_counts(spark, sf).collect()], plain_links(pairs(documents)))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 30), (3, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(rows(simjoin.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(5, 10), 5), 20: 20, 30: 20, **dict.fromkeys(range(100, 141), 100)}


# --- language


def test_language(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, sf).collect()}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in documents.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(right) >= 0.9 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(edge, empty):
    model = langid.train(edge)
    got = langid.predict(edge, model, ["doc_id", "score"]).collect()
    assert len(got) == len(EDGE)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] in {"en", "ru", "ja", "fr"} for r in got if r["doc_id"] not in (1, 2, 3))
    assert langid.predict(empty, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge, langid.train(empty), ["doc_id"]).collect()} == {"und"}
    one = langid.train(edge.where("lang = 'ru'"))
    assert {r["lang_pred"] for r in langid.predict(edge, one, ["doc_id"]).collect()} == {"und", "ru"}


def test_training_sample(spark):
    data = [(i, f"text number {i} of many words", "en") for i in range(3000)] + [(9000 + i, "der eine text", "de") for i in range(2000)] + [(None, f"le texte {i}", "fr") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    picked = [sorted(rows(langid.sample(docs.repartition(n), 100))) for n in (1, 6)]
    assert picked[0] == picked[1]
    n = Counter(lang for lang, _ in picked[0])
    assert n["en"] == 100 and n["de"] == 100 and n["fr"] == 40
    few = Counter(lang for lang, _ in rows(langid.sample(docs, 100, total=30)))
    assert few == {"en": 10, "de": 10, "fr": 10}


def test_predictions_are_those_of_a_plain_version(documents):
    model = langid.train(documents)
    got = {r["doc_id"]: r for r in langid.predict(documents, model, ["doc_id"]).collect()}
    for d, t in pairs(documents.limit(80)):
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
            continue
        counts = Counter()
        raw = [int(langid.FOLD[b]) for b in t.encode()]
        raw += [32] * (3 - len(raw))
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            counts[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        size = math.sqrt(sum(counts.values()))
        margins = [sum(math.sqrt(n) / size * float(model["weights"][k, j]) for k, n in counts.items()) + float(model["bias"][j]) for j in range(len(model["bias"]))]
        losses = [sum(float(w) * math.log1p(math.exp(-2 * m * float(bit))) for w, m, bit in zip(model["trust"], margins, word, strict=True)) for word in model["book"]]
        p = [math.exp(-langid.SHARPNESS * (x - min(losses))) for x in losses]
        assert got[d]["lang_pred"] == model["languages"][losses.index(min(losses))] and got[d]["score"] == pytest.approx(max(p) / sum(p), rel=1e-3)


def test_codewords_correct_errors():
    for n in (2, 3, 4, 9, 30):
        book = langid.codebook(n)
        apart = [(a != b).sum() for i, a in enumerate(book) for b in book[:i]]
        assert min(apart) >= (1 if n == 2 else 2 if n == 3 else 3)


# --- sharding


def check_shards(got, n, shards):
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert len(got) == n and all(sorted(v) == list(range(len(v))) for v in per.values())
    counts = [len(per.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_sharding(spark, sf, documents):
    got = queries.op9_sharding(spark, sf).collect()
    check_shards(got, documents.count(), 40)
    want = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    assert all(r["size"] == len(want[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(want[r["doc_id"]]) for r in got)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op9_sharding(spark, sf).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_sharding_edges(spark, edge, empty):
    check_shards(sharding.shard(edge, 4, ["doc_id"]).collect(), len(EDGE), 4)
    assert sharding.shard(empty, 4, ["doc_id"]).count() == 0
    hot = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id end as doc_id", "'t' as text")
    made = sharding.shard(hot, 7, ["doc_id"], bucket_bytes=2000, row_bytes=64)
    check_shards(made.collect(), 3000, 7)
    assert not any("Python" in line or "Arrow" in line for line in made._jdf.queryExecution().toString().splitlines())


def test_sharding_writes_whole_documents(spark, sf, documents, monkeypatch):
    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda rows, path: (paths.append(path), write(rows, path)))
    got = queries.op9_sharding(spark, sf).collect()
    stored = spark.read.parquet(*paths)
    same(rows(stored.select("doc_id", "text")), pairs(documents))
    same(rows(stored.select("doc_id", "shard", "slot")), [(r["doc_id"], r["shard"], r["slot"]) for r in got])


def test_shards_are_in_slot_order_and_buckets_follow_lengths(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', if(id % 100 = 0, 4000, 20)) as text")
    made, path = sharding.shard(docs, 3, ["doc_id"], bucket_bytes=4000), state.new_path(spark, "shards-test")
    assert made.rdd.getNumPartitions() >= 400 * 100 // 4000 // sharding.BUCKETS_PER_TASK
    sharding.write_shards(made, path)
    got = sharding.read_shards(spark, path, made).selectExpr("*", "_metadata.file_name as file").collect()
    check_shards(got, 400, 3)
    assert all(len(r["text"]) == (20000 if r["doc_id"] % 100 == 0 else 100) for r in got)
    for s in range(3):
        slots = [r["slot"] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: (r["file"], r["slot"]))]
        assert slots == list(range(len(slots))) and len({r["file"] for r in got if r["shard"] == s}) > 1
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order)


# --- surrogates


def test_surrogates_hold_no_original(spark, documents):
    got = surrogates.anonymise(documents, "k", ["doc_id"], with_entities=True)
    found = [r for r in got.collect() if r["n_entities"]]
    assert found
    for r in found:
        for e in r["entities"]:
            assert e["original"] not in r["safe_text"]
            assert len(e["original"]) == len(e["surrogate"]) or e["kind"] in ("ip", "name")
            assert [x[2] for x in surrogates.entities(e["surrogate"])] == [e["kind"]] or e["kind"] == "name"
    assert surrogates.collisions(got).count() == 0
    untouched = {r["doc_id"]: r["safe_text"] for r in got.where("n_entities = 0").collect()}
    assert all(untouched[d] == t for d, t in pairs(documents) if d in untouched)


def test_surrogates_edges(edge, empty):
    got = {r["doc_id"]: r for r in surrogates.anonymise(edge, "k", ["doc_id", "score"], with_entities=True).collect()}
    assert got[1]["safe_text"] is None and got[1]["n_entities"] == 0 and got[2]["safe_text"] == ""
    a, b = ({e["original"]: e["surrogate"] for e in got[i]["entities"]} for i in (9, 10))
    assert a["anna.lee@mail.example.com"] == b["anna.lee@mail.example.com"]
    assert [got[9][f"n_{k}"] for k in ("email", "phone", "name")] == [1, 1, 1]
    assert [got[10][f"n_{k}"] for k in ("email", "card", "ip", "name")] == [1, 1, 1, 1]
    assert a["Anna Smith"].split()[0] in surrogates.FEMALE and a["Anna Smith"].split()[1] in surrogates.FAMILY
    digits = [int(c) for c in b["4111 1111 1111 1111"] if c.isdigit()]
    assert surrogates._luhn(digits) == 0 and b["4111 1111 1111 1111"][4] == " "
    assert surrogates.anonymise(empty, "k", ["doc_id"]).count() == 0


def test_surrogates_are_bijections():
    secret = b"k" * 32
    assert len({surrogates.surrogate(secret, "ssn", f"{i:03d}-12-3456") for i in range(1000)}) == 1000
    assert len({surrogates.name(secret, n) for n in surrogates.FEMALE}) == len(surrogates.FEMALE)
    assert not {surrogates.name(secret, n) for n in surrogates.FEMALE} - set(surrogates.FEMALE)
    assert all(surrogates.name(secret, n) != n for n in surrogates.MALE)
    assert len({surrogates.email(secret, f"{a}{b}@ex.org") for a in "abcdefghij" for b in "0123456789"}) == 100
    assert re.fullmatch(r"[\u0400-\u042F][\u0430-\u045F]+", surrogates.name(secret, "Иванова"))


def test_no_surrogate_is_the_value_itself():
    key = b"k" * 32
    for one in ("Fu", "Ou", "Xy"):
        assert surrogates.name(key, one) != one
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = {a + b: surrogates.reformat(key, "local", a + b, True) for a in letters for b in letters}
    assert all(x != y for x, y in made.items()) and len(set(made.values())) == len(made)
    for n in (2, 3, 10):
        moved = [surrogates.permute(key, "t", [i], [n]) for i in range(n)]
        assert sorted(moved) == [[i] for i in range(n)] and all(m != [i] for i, m in enumerate(moved))


@pytest.mark.parametrize(
    ("text", "gone"),
    [("My name is Priya Natarajan. Later Natarajan went.", "Natarajan"), ("Frau Yılmaz kam.", "Yılmaz"), ("Wei Zhang <wei@mail.example.com> wrote.", "Zhang"), ("張偉先生来了。他叫張偉吗", "張偉"), ("Dear Natalia Petrova, hello.", "Petrova"), ("Mrs. Priya Natarajan spoke; then Priya Natarajan left.", "Priya"), ("at 2001:db8::8a2e:370:7334 now", "2001:db8"), ("host 010.001.002.003 up", "010.001")],
)
def test_more_entities_are_found(text, gone):
    assert gone not in surrogates.replaced(b"k" * 32, text, {})[0]


def test_times_are_no_addresses_and_versions_agree():
    key = b"k" * 32
    assert surrogates.replaced(key, "at 12:30:45 and 1:2:3", {})[1] == []
    assert surrogates.canonical("ip", surrogates.ip(key, "10.1.2.3")) == surrogates.canonical("ip", surrogates.ip(key, "010.001.002.003"))
    assert surrogates.canonical("ip", surrogates.ip(key, "2001:db8::1")) == surrogates.canonical("ip", surrogates.ip(key, "2001:0DB8:0:0:0:0:0:1"))


def test_valid_account_numbers_stay_valid():
    key = b"k" * 32
    for text in ("DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"):
        new = surrogates.iban(key, text)
        assert new != text and new[:2] == text[:2] and len(new) == len(text)
        assert surrogates._remainder(new[:2], new[4:].replace(" ", ""), new[2:4]) == 1
    bad = surrogates.iban(key, "DE88370400440532013000")
    assert surrogates._remainder(bad[:2], bad[4:], bad[2:4]) != 1


def test_surrogates_follow_case():
    secret, token = b"k" * 32, "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f"Token {token}.", "Mail anna.lee@mail.example.com now"):
        (a, old, new), = surrogates.replaced(secret, text, {})[1]
        (b, upper, big), = surrogates.replaced(secret, text.upper(), {})[1]
        assert (a, old.upper(), new.upper()) == (b, upper, big) and new != old
    assert surrogates.email(secret, "Anna.Lee@Mail.Example.com").lower() == surrogates.email(secret, "anna.lee@mail.example.com")


@pytest.mark.parametrize("phone", ["+1 (826) 555-4081", "+1 826-555-4081", "+18265554081", "+44 20 7946 0958", "+33 1 42 34 56 78", "+33 1.42.34.56.78", "+33 1 42.34.56.78", "(826) 555-4081", "826-555-4081"])
def test_phones_end_where_others_start(phone):
    assert [x[:2] for x in surrogates.entities(f"{phone}.")] == [(0, len(phone))]
    if phone != "+33 1 42.34.56.78":
        for kind, other in [("ip", "190.137.223.204"), ("ip", "10.1.2.3"), ("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("phone", "415-555-1234"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e"), ("email", "77anna@ex.org")]:
            text = f"Call {phone} {other} now"
            assert [(text[a:b], k) for a, b, k in surrogates.entities(text)] == [(phone, "phone"), (other, kind)]


@pytest.mark.parametrize(("kind", "one", "two"), [("card", "4111 1111 1111 1111", "4111111111111111"), ("phone", "+1 (826) 555-4081", "+1 826-555-4081"), ("phone", "+1 (826) 555-4081", "+18265554081"), ("phone", "+1 826-555-4081", "(826) 555-4081"), ("phone", "+442079460958", "+44 20 7946 0958"), ("iban", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000")])
def test_surrogates_of_one_value_in_two_formats(kind, one, two):
    secret = b"k" * 32
    a, b = (surrogates.surrogate(secret, kind, x) for x in (one, two))
    assert surrogates.canonical(kind, one) == surrogates.canonical(kind, two)
    assert surrogates.canonical(kind, a) == surrogates.canonical(kind, b) != surrogates.canonical(kind, one)
    assert re.sub(r"\w", "x", a) == re.sub(r"\w", "x", one) and re.sub(r"\w", "x", b) == re.sub(r"\w", "x", two)


def test_surrogates_of_later_mentions():
    text = "Smith & Co: Mr Smith met Anna Weber. Smith's view: Anna and Weber agree; Smithson, Smith-Jones don't."
    new, done = surrogates.replaced(b"k" * 32, text, {})
    made = {old: x for _, old, x in done}
    assert [old for _, old, _ in done] == ["Smith", "Anna Weber", "Smith", "Anna", "Weber"]
    assert made["Anna Weber"] == f"{made['Anna']} {made['Weber']}" and "Smithson, Smith-Jones" in new and new.startswith("Smith & Co")


def test_collisions_see_through_formats(spark, sf, monkeypatch):
    e = "array<struct<kind string, original string, surrogate string>>"
    split = [([("card", "4111 1111 1111 1111", "4000 0000 0000 0002"), ("card", "4111111111111111", "5000000000000009")],)]
    shared = [([("card", "4111 1111 1111 1111", "4000 0000 0000 0002"), ("card", "4222222222222222", "4000000000000002")],)]
    for data, fault in ((split, "split"), (shared, "shared")):
        assert [r["fault"] for r in surrogates.collisions(spark.createDataFrame(data, f"entities {e}")).collect()] == [fault]
    monkeypatch.setattr(surrogates, "collisions", lambda df: df.limit(1))
    with pytest.raises(ValueError, match="share a surrogate"):
        queries.op10_surrogates(spark, sf)


# --- kernels


def test_word_hashes_tell_words_apart(documents):
    import pyarrow as pa

    texts = [t for _, t in pairs(documents)] + ["", None, "a", " a", "a\x85b"]
    data, offsets = kernels.flat(pa.array(texts))
    starts, ends, at = kernels.word_bounds(data, offsets)
    want = [w.encode() for t in texts for w in brute.SPACES.findall(t or "")]
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == want
    assert len(set(kernels.word_hashes(data, starts, ends).tolist())) == len(set(want))


def test_columns_that_clash_with_outputs(spark, edge):
    clash = ["class_id", "n_copies", "root", "salt", "shard", "slot", "seg_doc", "split", "safe_text", "n_name", "entities", "kept_lines", "host", "component_id"]
    docs = edge.select("doc_id", "text", *[F.lit("old").alias(c) for c in clash])
    plain = edge.select("doc_id", "text")
    same(rows(simjoin.link(docs)), rows(simjoin.link(plain)))
    got = sharding.shard(docs, 4, ["doc_id", "text"], row_bytes=64)
    assert dict(got.dtypes)["shard"] == "int" and dict(got.dtypes)["slot"] == "bigint" and got.count() == len(EDGE)
    assert set(got.columns) == set(docs.columns)
    made = surrogates.anonymise(docs, "key", ["doc_id", "safe_text", "host"])
    assert "host" in made.columns and not any(r["safe_text"] == "old" for r in made.collect())
    folder = state.new_path(spark, "order-test")
    assert ordering.write_training_order(docs, queries.TOKENIZER, folder, length=64, rows_per_shard=16).count() > 0

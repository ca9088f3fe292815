"""Similarity join on word shingles: grouped prefix join, exact for Jaccard >= 80 %.

Documents with one shingle set are one class.  Shingles are ordered globally, those of many documents last (a fixed-size
table of levels, from counts over all documents, broadcast), so that a document's prefix holds what is rare in it.  Two sets
that link share a token of their prefixes.

* Classes with one size and one prefix are a group, and only groups have postings.  Group pairs come from shared prefix
  tokens, filtered by size and by the tokens' places.
* A rare token is in fewer than HOT documents, so all its group pairs are made, from packed arrays.  A frequent one pairs
  its groups with one of them, that most of whose shingles are frequent.
* First a member of each group is verified for the group pairs, and met with the other members of its own group.  Then
  group pairs are expanded to all members that aren't in one component yet; and of a frequent token or a group, members
  outside its largest component meet the others.  So copies by the thousand cost a pair each, and every link between
  components is still found.
* Links lie within components, so where they are to be counted, all classes of a component are compared, block by block.

Sets are of 64-bit hashes of the shingles (see kernels.py); class and group ids are 64-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewake.sources.shipping import ship

from .kernels import LOWER, flat, groups, joined, shingle_sets, split
from .state import cut, drop, pieces_of, text_bytes

WIDTH = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: From so many documents on, a shingle's level counts for the order.
HOT = 16
#: Bits of the table of levels, a byte each: they follow the texts' size, a bucket for LEVEL_BYTES of them, within these bounds.
MIN_LEVEL_BITS, MAX_LEVEL_BITS, LEVEL_BYTES = 22, 26, 1 << 10
FILTER_BITS = 22
#: Parts that a frequent token's list is dealt over, when it meets its hub or its largest component.
SALTS = 8
#: Text of a range of shingles, and the most ranges there are.
RANGE_BYTES, MAX_RANGES = 2 << 20, 1 << 16
#: Text for each file of a table between jobs.
FILE_BYTES = 16 << 20
#: Shingles of a block, when the classes of a component are compared to count links.
BLOCK = 1 << 18


def sets_of(column: pa.Array, width: int):
    data, offsets = flat(column)
    data = LOWER[data]
    for i, j in groups(offsets):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


def class_id(hashes: np.ndarray, size: int = 0) -> int:
    """A digest of a set; with its size, of a prefix."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8, salt=size.to_bytes(8, "little")).digest(), "little", signed=True)


def _count(width: int, n: int):
    """Shingles of all documents, each document's once: by low bits, sorted top halves."""

    def run(batches):
        def packed():
            h = np.concatenate(held)
            for k, (x,) in split((h % np.uint64(n)).astype(np.int64), n, h):
                yield {"range": k, "h": (x >> np.uint64(32)).astype(np.uint32).tobytes()}

        schema = pa.schema([("range", pa.int32()), ("h", pa.binary())])
        held, size = [], 0
        for batch in batches:
            for s in sets_of(batch.column(0), width):
                held.append(s)
                size += len(s)
                if size > 1 << 21:
                    yield pa.RecordBatch.from_pylist(list(packed()), schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(packed()), schema=schema)

    return run


def _levels(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(joined(pdf["h"], np.uint32))
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        counts = np.diff(edges)
        many = counts >= HOT
        bucket = (h[edges[:-1][many]] >> np.uint32(32 - bits)).astype(np.int32)
        return pd.DataFrame({"bucket": bucket, "level": np.log2(counts[many]).astype(np.int32)})

    return run


def levels(texts: DataFrame, width: int, n_ranges: int, bits: int = MIN_LEVEL_BITS) -> np.ndarray:
    """For each bucket of shingles a level, 0 for what fewer than HOT documents hold; 2 ** bits bytes."""
    found = texts.select("text").mapInArrow(_count(width, n_ranges), "range int, h binary").groupBy("range").applyInPandas(_levels(bits), "bucket int, level int")

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"b": [batch.column(0).to_numpy().astype(np.int32).tobytes()], "l": [batch.column(1).to_numpy().astype(np.uint8).tobytes()]})

    out = np.zeros(1 << bits, np.uint8)
    rows = found.groupBy("bucket").agg(F.max("level").alias("level")).mapInArrow(packed, "b binary, l binary").collect()  # 5 bytes for each bucket above 0
    for r in rows:
        out[np.frombuffer(bytes(r["b"]), np.int32)] = np.frombuffer(bytes(r["l"]), np.uint8)
    return out


SIGNATURES = "cid bigint, gid bigint, n bigint, general int, cold binary, hot array<bigint>"


def _sign(sent, width: int, carry: tuple[str, ...] = ()):
    def run(batches):
        table = sent.value
        bits = len(table).bit_length() - 1
        for batch in batches:
            cids, gids, sizes, general, cold, hot = [], [], [], [], [], []
            group_of: dict[int, int] = {}
            posted: set[int] = set()
            for s in sets_of(batch.column(1), width):
                n = len(s)
                cid = class_id(s) if n else None
                cids.append(cid)
                sizes.append(n)
                if not n or cid in group_of:  # a copy brings no postings of its own
                    gids.append(group_of.get(cid))
                    general.append(None)
                    cold.append(None)
                    hot.append(None)
                    continue
                prefix = n - (PERCENT * n + 99) // 100 + 1
                level = table[(s >> np.uint64(64 - bits)).astype(np.int64)]
                if level.any():
                    order = np.argsort(level, kind="stable")
                    s, level = s[order], level[order]
                gid = group_of[cid] = class_id(s[:prefix], n)
                gids.append(gid)
                if gid in posted:  # nor does a further member of a group
                    general.append(None)
                    cold.append(None)
                    hot.append(None)
                    continue
                posted.add(gid)
                rare = int((level == 0).sum())
                general.append(rare)
                cold.append(s[: min(prefix, rare)].tobytes())
                hot.append(s[rare:prefix].view(np.int64))
            columns = [batch.column(0), pa.array(cids, pa.int64()), pa.array(gids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(general, pa.int32()), pa.array(cold, pa.binary()), pa.array(hot, pa.list_(pa.int64()))]
            columns += [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "cid", "gid", "n", "general", "cold", "hot", *carry])

    return run


def _post(n: int):
    def run(batches):
        schema = pa.schema([("range", pa.int32()), ("x", pa.binary())])
        kind = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<u4"), ("at", "<u4")])
        for batch in batches:
            gids, sizes, cold = (batch.column(k).to_pylist() for k in range(3))
            lengths = np.array([len(x) // 8 for x in cold])
            rows = np.empty(int(lengths.sum()), kind)
            rows["token"] = np.frombuffer(b"".join(cold), np.uint64)
            rows["gid"], rows["n"] = np.repeat(np.array(gids, np.int64), lengths), np.repeat(np.array(sizes, np.uint32), lengths)
            rows["at"] = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_pylist([{"range": k, "x": x.tobytes()} for k, (x,) in split((rows["token"] % np.uint64(n)).astype(np.int64), n, rows)], schema=schema)

    return run


def _pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of groups with a common rare token that pass the filters."""
    kind = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<u4"), ("at", "<u4")])
    rows = joined(pdf["x"], kind)
    order = np.argsort(rows["token"], kind="stable")
    token = rows["token"][order]
    shared = np.zeros(len(order), bool)
    same = token[1:] == token[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    rows = rows[order[shared]]
    rows = rows[np.lexsort((rows["gid"], rows["token"]))]
    if len(rows):
        rows = rows[np.concatenate([[True], (rows["token"][1:] != rows["token"][:-1]) | (rows["gid"][1:] != rows["gid"][:-1])])]
    found, step = [np.zeros((0, 2), np.int64)], 1
    while step < len(rows):
        a, b = rows[:-step], rows[step:]
        together = a["token"] == b["token"]
        if not together.any():
            break
        a, b = a[together], b[together]
        na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
        most = np.minimum(na - a["at"], nb - b["at"])
        keep = (100 + PERCENT) * most >= PERCENT * (na + nb)
        found.append(np.stack([a["gid"][keep], b["gid"][keep]], 1))
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _fits(left: str, right: str):
    """The size and place filters, for columns of two postings."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    most = F.least(n - F.col(f"{left}.at"), m - F.col(f"{right}.at"))
    return (100 + PERCENT) * most >= PERCENT * (n + m)


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _ordered(left: str, right: str):
    x, y = F.col(left), F.col(right)
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _wanted(sent, width: int):
    def run(batches):
        table, seen = np.unpackbits(sent.value, bitorder="little").astype(bool), set()
        for batch in batches:
            rows = np.flatnonzero(table[batch.column(0).to_numpy(zero_copy_only=False)])
            if not len(rows):
                continue
            cids, sets = [], []
            for s in sets_of(batch.column(1).take(pa.array(rows)), width):
                if len(s) and (cid := class_id(s)) not in seen:
                    if len(seen) < 100_000:
                        seen.add(cid)
                    cids.append(cid)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "set"])

    return run


def _verify(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, root (the least node reachable) for all nodes of edges (a, b): large-star and small-star rounds until nothing moves."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    state = cut(edges.where("a <> b").distinct(), "edges", files)
    before = None
    while True:
        around = both(state)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        state, old = cut(small.where("a <> b").distinct(), "edges", files), state
        drop(old)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows linked to each class, for the pairs within one block or between two blocks of a component."""
    pdf = pdf.sort_values(["n", "cid"], ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
    n, copies, block = (pdf[c].to_numpy(np.int64) for c in ("n", "copies", "block"))
    rows = np.arange(len(n))
    alone = block.min() == block.max()
    ones, others = (rows, rows) if alone else (rows[block == block.min()], rows[block == block.max()])
    words, flat_ids = np.unique(np.concatenate([sets[i] for i in others]), return_inverse=True)
    ends = np.cumsum(n[others])
    starts, links, there = ends - n[others], np.zeros(len(n), np.int64), np.zeros(len(words), bool)
    for k, i in enumerate(ones):
        low = k + 1 if alone else np.searchsorted(n[others], -(-PERCENT * n[i] // 100))
        high = np.searchsorted(n[others], 100 * n[i] // PERCENT, "right")
        if low >= high:
            continue
        at = np.minimum(np.searchsorted(words, sets[i]), len(words) - 1)
        at = at[words[at] == sets[i]]
        there[at] = True
        common = np.add.reduceat(there[flat_ids[starts[low] : ends[high - 1]]].astype(np.int64), starts[low:high] - starts[low])
        there[at] = False
        found = others[low:high][100 * common >= PERCENT * (n[i] + n[others[low:high]] - common)]
        links[i] += copies[found].sum()
        links[found] += copies[i]
    return pd.DataFrame({"cid": pdf["cid"], "links": links})[links > 0]


def _compare_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    if key[1] != key[2] and pdf["block"].nunique() < 2:  # the other block is empty
        return pd.DataFrame({"cid": pdf["cid"][:0], "links": pdf["n"][:0]})
    return _compare(pdf)


def counted(placed: DataFrame) -> DataFrame:
    """cid, links: rows of other classes linked to each of placed (cid, n, copies, root, set)."""
    blocks = placed.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("classes")).where("classes > 1")
    dealt = placed.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "n", "copies", "block", "set")
    return pair.groupBy("root", "i", "j").applyInPandas(_compare_blocks, "cid bigint, links bigint").groupBy("cid").agg(F.sum("links").alias("links"))


def link(docs: DataFrame, width: int = WIDTH, count_links: bool = False, mark: str | None = None) -> DataFrame:
    """For every row of docs: doc_id, n_shingles, class_id (the least doc_id with the same set), n_copies (rows of its class), component_id.

    component_id is the smallest doc_id that links reach, itself included.  A null text or one without words has no shingles
    and links with nothing.  Rows with equal sets are one class, whatever their ids; a null doc_id is never the smallest.
    count_links adds n_links, the other rows that a row links with, its copies among them.  mark: a long column of docs that
    tells rows of one id apart; it is passed on, with root, a number for each component (null without shingles).
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    extra = [F.col(mark).cast("long").alias("__mark")] if mark else []
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), *extra)
    kind = texts.schema["doc_id"].dataType.simpleString()
    size = text_bytes(texts)
    files = pieces_of(size, FILE_BYTES, 8)
    store = lambda df, name: cut(df, name, files)  # noqa: E731  many small files cost more than they spread
    n_ranges = min(MAX_RANGES, pieces_of(size, RANGE_BYTES, 64))
    bits = min(MAX_LEVEL_BITS, max(MIN_LEVEL_BITS, (size // LEVEL_BYTES).bit_length()))
    table = spark.sparkContext.broadcast(levels(texts, width, n_ranges, bits))
    signed = store(texts.mapInArrow(_sign(table, width, ("__mark",) if mark else ()), f"doc_id {kind}, {SIGNATURES}{', __mark bigint' if mark else ''}"), "signatures")
    classes = store(signed.where("n > 0").groupBy("cid").agg(F.first("gid").alias("gid"), F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "members")
    members = classes.select("gid", "cid")
    every = classes.groupBy("gid").agg(F.first("n").alias("n"), F.min("cid").alias("head"), F.count("*").alias("members"))
    several = store(every.where("members > 1"), "groups")

    packed = signed.where("octet_length(cold) > 0").select("gid", "n", "cold").mapInArrow(_post(n_ranges), "range int, x binary")
    cold = store(packed.groupBy("range").applyInPandas(_pair, "a bigint, b bigint").distinct(), "pairs")

    rare = F.floor(F.octet_length("cold") / 8)
    posted = signed.where("size(hot) > 0").select("gid", "n", "general", rare.alias("rare"), F.posexplode("hot").alias("k", "token"))
    hot = posted.groupBy("token", "gid").agg(F.first("n").alias("n"), F.min("general").alias("general"), F.first(F.col("rare") + F.col("k")).alias("at"))
    shared = hot.groupBy("token").agg(F.count("*").alias("list"), F.min(F.struct("general", "gid", "n", "at")).alias("hub")).where("list > 1")
    hot = store(_salted(hot, "gid").join(_copied(shared.select("token", "hub")), ["token", "salt"]).select("token", F.struct("gid", "n", "at").alias("p"), "hub"), "hot")
    hubs = hot.where((F.col("p.gid") != F.col("hub.gid")) & _fits("p", "hub")).select(*_ordered("p.gid", "hub.gid"))
    group_pairs = cold.unionByName(hubs).distinct()
    one = group_pairs.join(every.select(F.col("gid").alias("a"), F.col("head").alias("x")), "a")
    heads = one.join(every.select(F.col("gid").alias("b"), F.col("head").alias("y")), "b").select(*_ordered("x", "y"))
    own = members.join(several, "gid").where("cid <> head").select(*_ordered("cid", "head"))
    first = store(heads.unionByName(own).distinct(), "pairs")

    # whole sets of the classes that any pair may need, from the documents whose hashed ids are marked
    used = hot.select("p.gid").unionByName(group_pairs.select(F.explode(F.array("a", "b")).alias("gid"))).unionByName(several.select("gid")).distinct()
    needed = classes.join(used, "gid", "left_semi").select("cid", "least")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << FILTER_BITS)).cast("int")
    marks = needed.select(F.col("least").alias("doc_id")).select((slot + 1).alias("slot"))
    blocks = marks.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()  # 2^FILTER_BITS bits in all
    marked = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in blocks:  # numbered from 1
        at = (r["block"] - 1) * len(r["bits"])
        marked[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = spark.sparkContext.broadcast(marked)
    found = texts.select(slot.alias("slot"), "text").mapInArrow(_wanted(sent, width), "cid bigint, set binary")
    sets = store(found.join(needed, "cid", "left_semi").groupBy("cid").agg(F.first("set").alias("set")), "sets")
    roots = store(components(verified(first, sets), files), "roots")
    placed_members = store(members.join(roots, F.col("cid") == F.col("node"), "left").select("gid", "cid", F.coalesce("root", "cid").alias("root")), "placed")
    # what is left: members of paired groups, or of one frequent token's or group's list, in different components.  Lists hold a
    # row for each group and component, so that neither copies nor what has been joined by now multiplies
    sides = store(placed_members.groupBy("gid", "root").agg(F.count("*").alias("rows")), "sides")
    wide = cold.join(several.select(F.col("gid").alias("a"), F.lit(1).alias("i")), "a", "left").join(several.select(F.col("gid").alias("b"), F.lit(1).alias("j")), "b", "left").where("i = 1 or j = 1").select("a", "b")
    left = wide.join(sides.select(F.col("gid").alias("a"), F.col("root").alias("root_a")), "a")
    across = left.join(sides.select(F.col("gid").alias("b"), F.col("root").alias("root_b")), "b").where("root_a <> root_b").select("a", "root_a", "b", "root_b")
    lists = hot.select("token", "p").unionByName(several.select(F.col("gid").alias("token"), F.struct("gid", "n", F.lit(0).cast(hot.schema["p"].dataType["at"].dataType).alias("at")).alias("p")))
    listed = lists.join(sides, F.col("p.gid") == F.col("gid")).select("token", "p", "root", "rows")
    per = listed.groupBy("token", "root").agg(F.sum("rows").alias("rows"))
    main = per.groupBy("token").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("token", "main")
    listed = store(_salted(listed, "root").join(_copied(main), ["token", "salt"]), "listed")
    apart = _copied(listed.where("root <> main").drop("salt", "main", "rows").withColumnsRenamed({"p": "q", "root": "other"}))
    met = listed.join(apart, ["token", "salt"]).where((F.col("root") != F.col("other")) & _fits("p", "q")).select(F.col("p.gid").alias("a"), F.col("root").alias("root_a"), F.col("q.gid").alias("b"), F.col("other").alias("root_b"))
    one, two = F.struct("a", "root_a"), F.struct(F.col("b").alias("a"), F.col("root_b").alias("root_a"))
    met = across.unionByName(met).select(F.least(one, two).alias("s"), F.greatest(one, two).alias("t")).distinct()
    met = store(met.select("s.a", "s.root_a", F.col("t.a").alias("b"), F.col("t.root_a").alias("root_b")), "sides")
    xs, ys = (placed_members.select(F.col("gid").alias(g), F.col("root").alias(f"root_{g}"), F.col("cid").alias(c)) for g, c in (("a", "x"), ("b", "y")))
    second = met.join(xs, ["a", "root_a"]).join(ys, ["b", "root_b"]).select(*_ordered("x", "y")).distinct()
    second = store(second.join(first, ["a", "b"], "left_anti"), "pairs")
    drop(met, listed, hot, cold)
    if not second.isEmpty():
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = store(components(known.unionByName(verified(second, sets)), files), "roots")
    drop(first, second)

    joint = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "least", "copies", F.coalesce("root", "cid").alias("root"))
    lowest = joint.groupBy("root").agg(F.min("least").alias("component"))
    of_class = store(joint.join(lowest, "root").select("cid", F.col("least").alias("class_id"), "copies", "component", "root"), "classes")
    links = []
    if count_links:
        placed = sets.join(roots, F.col("cid") == F.col("node")).join(classes.select("cid", "n", "copies"), "cid").select("cid", "n", "copies", "root", "set")
        of_class = of_class.join(store(counted(placed), "links"), "cid", "left")
        links = [(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")]
    drop(sets)
    # rows without shingles have no class: they don't meet the join, where all would have one key
    joined_rows = signed.where("cid is not null").join(of_class, "cid").unionByName(signed.where("cid is null"), allowMissingColumns=True)
    kept = [F.col("__mark").alias(mark), "root"] if mark else []
    return joined_rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("component", "doc_id").alias("component_id"), *links, *kept)

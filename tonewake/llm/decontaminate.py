"""Benchmark decontamination by Wu-Manber search over words.

The benchmark's windows are the patterns.  Windows of one length share a matcher: its shift table, keyed by a block of two
words, tells how far the search may jump; blocks that end a pattern select a bucket, whose second key is the pattern's first
two words; what is left is compared word by word.

Words are numbered, and all tables are packed arrays: a block costs 12 bytes and a pattern 4 in each, and patterns are read
from the items' own numbers.  A worker builds the tables of a benchmark once and keeps them for its next tasks.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewake.sources.shipping import ship

from .state import cut

#: Bytes outside a word become spaces, A-Z lower case: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 8
#: Fixed value: the odd multiplier of the tables' hash; and 64 bits.
MULTIPLIER, WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Text of benchmark items that one pass may hold: it bounds what is sent to each worker.
BLOCK_BYTES = 16 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class Packed:
    """Numbers by keys of two numbers: open addressing in flat arrays, as a dict of so many entries would cost ten times as much."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(3, (2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        slots = np.full(1 << self.bits, -1, np.int64)
        found = np.zeros(1 << self.bits, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):  # all that find a free place take it, the others go on to the next
            free = todo[slots[at[todo]] < 0]
            slots[at[free][::-1]] = keys[free][::-1]
            won = free[slots[at[free]] == keys[free]]
            found[at[won]] = values[won]
            todo = todo[slots[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask
        self.slots, self.found = array("q", slots.tobytes()), array("i", found.tobytes())

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: int, default: int) -> int:
        at = ((key * MULTIPLIER) & WORD) >> (64 - self.bits)
        slots = self.slots
        while (k := slots[at]) != key:
            if k < 0:
                return default
            at = (at + 1) & self.mask
        return self.found[at]


class WuManber:
    """All patterns of m words each; find() yields (end position, items) of every occurrence.

    patterns: windows of words and the items that have them."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[str]]):
        words = sorted({w for p in patterns for w in p})
        numbers = {w: i for i, w in enumerate(words)}
        table = np.array([[numbers[w] for w in p] for p in patterns], np.uint32).reshape(-1, m)
        names = sorted({x for v in patterns.values() for x in v})
        where = {x: i for i, x in enumerate(names)}
        owners = [sorted(where[x] for x in v) for v in patterns.values()]
        lists = np.cumsum([0, *map(len, owners)])
        self._build(m, numbers, names, table.ravel(), np.arange(len(table)) * m, lists, np.array([x for v in owners for x in v], np.int64))

    @classmethod
    def of_stream(cls, m: int, numbers: dict, names: list[str], stream: np.ndarray, starts: np.ndarray, items: np.ndarray) -> WuManber:
        """Patterns are m numbers of stream from each of starts; equal ones are one, with the items of all."""
        made = cls.__new__(cls)
        mark = np.zeros(len(starts), np.uint64)
        for k in range(m):
            mark = mark * np.uint64(MULTIPLIER) + stream[starts + k]
        order = np.lexsort((items, mark))  # brings equal windows together; unequal ones of one mark just don't become one
        placed = starts[order]
        new = np.ones(len(order), bool)
        new[1:] = False
        for k in range(m):
            new[1:] |= stream[placed[1:] + k] != stream[placed[:-1] + k]
        del mark, placed
        again = np.zeros(len(order), bool)
        again[1:] = ~new[1:] & (items[order][1:] == items[order][:-1])
        group = np.cumsum(new) - 1
        made._build(m, numbers, names, stream, starts[order[new]], np.concatenate([[0], np.cumsum(np.bincount(group[~again], minlength=int(new.sum())))]), items[order][~again])
        return made

    def _build(self, m: int, numbers: dict, names: list[str], stream: np.ndarray, starts: np.ndarray, lists: np.ndarray, owners: np.ndarray) -> None:
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        self.numbers, self.names, self.stream = numbers, names, array("I", stream.astype(np.uint32).tobytes())
        pair = lambda at: (stream[at].astype(np.int64) << 32 | stream[at + self.block - 1]) if self.block == 2 else stream[at].astype(np.int64)
        ends = pair(starts + m - self.block)
        # a block's shift is its least distance from a pattern's end; end blocks have numbers of buckets instead, below 0
        own, bucket = np.unique(ends, return_inverse=True)
        keys, shifts = [own], [np.full(len(own), 0, np.int32)]
        for back in range(1, m - self.block + 1):
            more = np.setdiff1d(pair(starts + m - self.block - back), np.concatenate(keys))
            keys.append(more)
            shifts.append(np.full(len(more), back, np.int32))
        values = np.concatenate(shifts)
        values[: len(own)] = -1 - np.arange(len(own))
        self.shift = Packed(np.concatenate(keys), values)
        order = np.lexsort((pair(starts), bucket))
        small = lambda x: array("i", x.astype(np.int32).tobytes())
        self.heads, self.starts = array("q", pair(starts)[order].tobytes()), small(starts[order])
        self.edges = small(np.searchsorted(bucket[order], np.arange(len(own) + 1)))
        sizes = np.diff(lists)[order]
        ends = np.cumsum(sizes)
        self.lists = small(np.concatenate([[0], ends]))
        self.owners = small(owners[np.repeat(lists[:-1][order] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))])

    def find(self, words: list[bytes]):
        get, m, back = self.numbers.get, self.m, self.block - 1
        ids = [get(w, -1) for w in words]
        jump, shift, text, shifted = self.jump, self.shift.get, None, 32 * back
        i, n = m - 1, len(ids)
        while i < n:
            last, before = ids[i], ids[i - back]
            if last < 0:
                i += jump
                continue
            skip = shift(before << 32 | last if shifted else last, jump) if before >= 0 else jump
            if skip > 0:
                i += skip
                continue
            first = i - m + 1
            if min(ids[first : i + 1]) >= 0:
                head = ids[first] << 32 | ids[first + back] if shifted else ids[first]
                low, high = self.edges[-1 - skip], self.edges[-skip]
                at = bisect_left(self.heads, head, low, high)
                text = array("I", ids[first : i + 1])
                while at < high and self.heads[at] == head:
                    start = self.starts[at]
                    if self.stream[start : start + m] == text:
                        yield i + 1, {self.names[x] for x in self.owners[self.lists[at] : self.lists[at + 1]]}
                    at += 1
            i += 1


def matchers(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A matcher for each length of window: window words, or all of a shorter item's."""
    numbers: dict[bytes, int] = {}
    names: dict[str, int] = {}
    stream, by_length = array("I"), defaultdict(lambda: (array("q"), array("q")))
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        if not m:
            continue
        at, own = len(stream), names.setdefault(item, len(names))
        stream.extend([numbers.setdefault(w, len(numbers)) for w in words])
        starts, owners = by_length[m]
        starts.extend(range(at, at + len(words) - m + 1))
        owners.extend([own] * (len(words) - m + 1))
    flat, listed = np.frombuffer(stream, np.uint32) if len(stream) else np.zeros(0, np.uint32), list(names)
    return [WuManber.of_stream(m, numbers, listed, flat, np.frombuffer(by_length[m][0], np.int64), np.frombuffer(by_length[m][1], np.int64)) for m in sorted(by_length)]


#: The tables that this worker built last, by the name of the benchmark's block.
_built: dict[tuple, list[WuManber]] = {}


def built(name: str, sent, window: int) -> list[WuManber]:
    key = (name, window)
    if key not in _built:
        _built.clear()
        _built[key] = matchers(sent.value, window)
    return _built[key]


def search(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """The merged spans of words that occurrences cover, and the items that occur."""
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for table in tables:
        for end, names in table.find(words):
            items |= names
            start = end - table.m
            if found and found[-1][0] <= start <= found[-1][1]:
                found[-1] = (found[-1][0], max(end, found[-1][1]))
            else:
                found.append((start, end))
    return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns carry of docs, with n_words, hit_spans (word positions, merged) and hit_items (sorted as strings).

    One row for each row of docs, repeated ones too.  A null or empty text has no words and no hits.  Items with a null id
    or without words are left out; rows of one id count once.  Columns of docs named like an output are replaced.
    A benchmark above block_bytes is searched in as many passes, each written to the shared folder.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // block_bytes))
    outputs = ("n_words", "hit_spans", "hit_items")
    kept = [f for f in docs.schema.fields if f.name in carry and f.name not in outputs]
    state = docs.select(*[F.col(f.name) for f in kept], F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).collect() if passes > 1 else items.collect()  # block_bytes at most, about
        sent = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in block])
        last = k == passes - 1
        out = schema if last else T.StructType([*schema.fields, T.StructField("__text", T.StringType())])
        state = state.mapInArrow(_pass(uuid.uuid4().hex, sent, window, len(kept), k > 0, last), out)
        if not last:
            state = cut(state, "decontaminate")
    return state


def _pass(name: str, sent, window: int, n_kept: int, again: bool, last: bool):
    def run(batches):
        tables = built(name, sent, window)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            before = [(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())] if again else []
            counts, spans, items = [], [], []
            for i, text in enumerate(texts):
                words = words_of(text.as_py())
                found, names = search(words, tables)
                for old_spans, old_items in before:
                    found, names = merged(found + [(x["start"], x["end"]) for x in old_spans[i]]), names | set(old_items[i])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in found])
                items.append(sorted(names))
            columns = [batch.column(c) for c in range(n_kept)]
            columns += [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            names_out = [batch.schema.field(c).name for c in range(n_kept)] + ["n_words", "hit_spans", "hit_items"]
            if not last:
                columns, names_out = [*columns, texts], [*names_out, "__text"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return run


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what decontaminate() gives."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") >= 2).alias("contaminated"),
    )

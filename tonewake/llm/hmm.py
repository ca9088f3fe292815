"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Tokens are words and an end.  A word of LEAST occurrences and of N / HOT or more is a class of its own; all others share
classes by their endings, which are known for unseen words too.  So the emission table follows the corpus's vocabulary (HOT
words at most, as no more can have N / HOT occurrences).  The states emit classes and the classes emit words: log P(text) is
the scaled forward recursion over the classes, exact over the whole text, plus the sum of log P(word | class), where an
ending's class gives (c + 1) / (N_class + V_class + 1) to its words and to one unseen word.  The same formula over all words
is the base score.

Counts of words cover all training tokens.  Words with a class are sent to every worker; the others' occurrences meet their
counts in one shuffle of packed arrays, dealt by word, and return to their documents in a second one, dealt by the input's
partition.  Expected counts of each Baum-Welch pass are added up in the cluster, by ranges of classes.  Passes over the whole
corpus go on until one gains less than TOLERANCE a token, PASSES at most.  For them texts are cut into pieces of PIECE tokens;
each piece but a text's first repeats the token before it, so that no transition is lost, and has a start distribution of its
own.  The first guess is fitted to the START_SEGMENTS pieces of least keyed hash, whatever the input's partitions.

Words are told apart by 64-bit hashes.  A null text is the end alone.  Each row is a document; repeated rows count as often.
Without training documents both scores are 0.  Scores don't hang on partitions but for the last digits of sums.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewake.sources.shipping import ship

from .kernels import LOWER, flat, groups, joined, mix, ranges, split, word_bounds, word_hashes
from .state import cut, drop, pieces_of, text_bytes

STATES = 8
ENDINGS = 4096
#: Classes of every model: the end and the endings.
CLASSES = 1 + ENDINGS
HOT = 1 << 21
LEAST = 5
PIECE = 128
PASSES = 4
TOLERANCE = 0.002
START_SEGMENTS = 4096
START_PASSES = 12
#: Tokens that a state is thought to have seen beforehand, spread like all tokens.
PRIOR = 2000.0
#: Text of a range of words, and the most ranges there are.
RANGE_BYTES, MAX_RANGES = 48 << 20, 1 << 16
#: Text for each file of a table between jobs.
FILE_BYTES = 16 << 20
#: Classes of a range, when expected counts are added up.
CLASS_RANGE = 1 << 10
#: Partitions whose counts are added up first.
PARTS_AT_ONCE = 256
#: Pieces that one step of the recursions takes.
PIECES_AT_ONCE = 2048
RARE_AT_ONCE = 1 << 20
END = int(mix(np.array([0xE2D], np.uint64))[0])
TABLE_BITS = 22


def held_out_ids(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % 7 == 2 for x in ids], bool)


def tokens(column: pa.Array):
    """For groups of texts: first text, offsets of its words, the words' hashes, the hashes of their endings."""
    data, offsets = flat(column)
    data = LOWER[data]
    for i, j in groups(offsets):
        some = data[offsets[i] : offsets[j]]
        starts, ends, at = word_bounds(some, offsets[i : j + 1] - offsets[i])
        long = some.astype(np.uint64)
        tail = long[ends - 1] if len(ends) else np.zeros(0, np.uint64)
        for back in (2, 3):
            there = ends - back >= starts
            tail = tail * np.uint64(257) + np.where(there, long[np.maximum(ends - back, 0)] + np.uint64(1), np.uint64(0))
        yield i, at, word_hashes(some, starts, ends), (mix(tail) % np.uint64(ENDINGS)).astype(np.uint16)


def summed(h: np.ndarray, c: np.ndarray, e: np.ndarray):
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(c[order], first) if len(first) else c[:0], e[order][first]


def _count(n_ranges: int):
    def run(batches):
        held, size, ends = [], 0, 0

        def packed():
            h, c, e = (np.concatenate(x) for x in zip(*held, strict=True))
            for k, (a, b, d) in split(ranges(*(h, n_ranges)), n_ranges, h, c, e):
                yield {"range": k, "h": a.tobytes(), "c": b.tobytes(), "e": d.tobytes()}

        for batch in batches:
            train = ~held_out_ids(batch.column(0).to_pylist())
            ends += int(train.sum())
            for i, at, h, e in tokens(batch.column(1)):
                use = np.repeat(train[i : i + len(at) - 1], np.diff(at))
                held.append(summed(h[use], np.ones(int(use.sum()), np.int64), e[use]))
                size += len(held[-1][0])
            if size > 1 << 21:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > 1 << 20:
                    yield pa.RecordBatch.from_pylist(list(packed()), schema=VOCABULARY)
                    held = []
                size = sum(len(x[0]) for x in held)
        held.append((np.array([END], np.uint64), np.array([ends], np.int64), np.zeros(1, np.uint16)))
        held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        yield pa.RecordBatch.from_pylist(list(packed()), schema=VOCABULARY)

    return run


VOCABULARY = pa.schema([("range", pa.int32()), ("h", pa.binary()), ("c", pa.binary()), ("e", pa.binary())])
VOCABULARY_SQL = "range int, h binary, c binary, e binary"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    h, c, e = summed(joined(pdf["h"], np.uint64), joined(pdf["c"], np.int64), joined(pdf["e"], np.uint16))
    known = c > 0
    return pd.DataFrame([{"range": pdf["range"].iloc[0], "h": h[known].tobytes(), "c": c[known].tobytes(), "e": e[known].tobytes()}])


class Vocabulary:
    """Words with a class of their own: counts by hash; class sizes of the rest by ending; totals.

    Class 0 is the end, then come the words in order of hash, then the endings."""

    def __init__(self, h, c, e, n, v, n_class, v_class):
        self.ends = n - int(n_class.sum())
        own = h != np.uint64(END)
        self.h, self.c, self.n, self.v = h[own], c[own], n, v
        e = e[own]
        self.n_ending = n_class - np.bincount(e, self.c, ENDINGS)
        self.v_ending = v_class - np.bincount(e, minlength=ENDINGS)
        #: log10 of what a class's word is divided by; words that are classes have probability 1.
        self.ending_norm = np.log10(self.n_ending + self.v_ending + 1)
        self.classes = CLASSES + len(self.h)
        self.table = None

    def overall(self) -> np.ndarray:
        """Each class's share of all tokens; an ending's also counts a half for what was never seen."""
        counts = np.concatenate([[self.ends + 0.5], self.c, self.n_ending + 0.5])
        return counts / counts.sum()

    def index(self) -> np.ndarray:
        """A direct table by a hash's top bits: a place, -1 for none, -2 for several.  It is made where it is used, not sent."""
        slot = (self.h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        table = np.full(1 << TABLE_BITS, -1, np.int32)
        table[slot] = np.arange(len(slot))
        table[slot[1:][slot[1:] == slot[:-1]]] = -2
        return table

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place among the words with a class, or -1."""
        if self.table is None:
            self.table = self.index()
        at = self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        many = np.flatnonzero(at == -2)
        if len(many):
            at[many] = np.minimum(np.searchsorted(self.h, h[many]), len(self.h) - 1)
        if len(self.h):
            at[(at >= 0) & (self.h[np.maximum(at, 0)] != h)] = -1
        return at

    def of(self, at: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Classes, from places and endings."""
        return np.where(at >= 0, 1 + at, 1 + len(self.h) + e.astype(np.int32)).astype(np.int32)


def vocabulary(docs: DataFrame, n_ranges: int, files: int | None = None) -> Vocabulary:
    table = cut(docs.mapInArrow(_count(n_ranges), VOCABULARY_SQL).groupBy("range").applyInPandas(_merge, VOCABULARY_SQL), "vocabulary", files)

    def totals(batches):
        out = np.zeros((2, ENDINGS + 1), np.int64)  # the last column: all words and the end
        for batch in batches:
            for h, c, e in zip(*[batch.column(k).to_pylist() for k in range(1, 4)], strict=True):
                h, c, e = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(e, np.uint16)
                word = h != np.uint64(END)
                out[0, :-1] += np.bincount(e[word], c[word], ENDINGS).astype(np.int64)
                out[1, :-1] += np.bincount(e[word], minlength=ENDINGS)
                out[:, -1] += int(c.sum()), len(c)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(ENDINGS + 1), pa.int32()), "n": out[0], "v": out[1]})

    sums = {r[0]: r[1:] for r in table.mapInArrow(totals, "k int, n bigint, v bigint").groupBy("k").agg(F.sum("n"), F.sum("v")).collect()}
    per = np.array([sums.get(k, (0, 0)) for k in range(ENDINGS)], np.int64).T
    n, v = sums.get(ENDINGS, (0, 0))
    least = max(LEAST, -(-n // HOT))

    def frequent(batches):
        for batch in batches:
            for h, c, e in zip(*[batch.column(k).to_pylist() for k in range(1, 4)], strict=True):
                c = np.frombuffer(c, np.int64)
                keep = c >= least
                yield pa.RecordBatch.from_pydict({"h": [np.frombuffer(h, np.uint64)[keep].tobytes()], "c": [c[keep].tobytes()], "e": [np.frombuffer(e, np.uint16)[keep].tobytes()]})

    rows = table.mapInArrow(frequent, "h binary, c binary, e binary").collect()  # HOT words at most
    drop(table)
    h, c, e = (np.frombuffer(b"".join(bytes(r[k]) for r in rows), t) for k, t in enumerate((np.uint64, np.int64, np.uint16)))
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], e[order], n, v, *per)


def pieces(ids: list, column: pa.Array, train: np.ndarray, words: Vocabulary):
    """Training texts in pieces: their classes one after another, their lengths (negative where a text goes on), their keys."""
    for i, at, h, e in tokens(column):
        cls = words.of(words.find(h), e)
        out, sizes, keys = [], [], []
        for k in np.flatnonzero(train[i : i + len(at) - 1]).tolist():
            whole = np.append(cls[at[k] : at[k + 1]], np.int32(0))
            name = np.uint64(zlib.crc32(b"" if ids[i + k] is None else str(ids[i + k]).encode())) << np.uint64(32)
            for number, start in enumerate(range(0, len(whole), PIECE)):
                part = whole[max(0, start - 1) : start + PIECE]
                out.append(part)
                sizes.append(len(part) if not number else -len(part))
                keys.append(name | np.uint64(number & 0xFFFFFFFF))
        if out:
            yield np.concatenate(out), np.array(sizes, np.int32), mix(np.array(keys, np.uint64))


def as_grid(classes: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as rows, filled up with the end class."""
    sizes = np.frombuffer(sizes, np.int32)
    grid = np.zeros((len(sizes), PIECE + 1), np.int32)
    grid[np.arange(PIECE + 1)[None] < np.abs(sizes)[:, None]] = np.frombuffer(classes, np.int32)
    return grid, sizes


def expected(model, grid: np.ndarray, sizes: np.ndarray):
    """Baum-Welch counts of the pieces: starts of texts and of later pieces, transitions, log10 likelihood and tokens in one array; emissions by class."""
    start, move, emit, later = model
    by_class, k = np.ascontiguousarray(emit.T), len(start)
    goes_on, sizes = sizes < 0, np.abs(sizes)
    order = np.argsort(-sizes, kind="stable")
    grid, sizes, goes_on = grid[order], sizes[order], goes_on[order]
    steps = int(sizes[0])
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]
    first = np.where(goes_on[:, None], later, start)
    alpha, scale = [], []
    for t in range(steps):
        a = (alpha[-1][: live[t]] @ move if t else first) * by_class[grid[: live[t], t]]
        s = a.sum(1, keepdims=True)
        alpha.append(a / s)
        scale.append(s)
    moves, weights = np.zeros((k, k)), [None] * steps
    beta = np.ones((live[-1], k))
    weights[-1] = alpha[-1]
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        ahead = by_class[grid[:n, t + 1]] * beta / scale[t + 1]
        moves += alpha[t][:n].T @ ahead
        beta = np.concatenate([ahead @ move.T, np.ones((live[t] - n, k))])
        weights[t] = alpha[t] * beta
    moves *= move
    opening = weights[0]
    weights[0] = np.where(goes_on[:, None], 0.0, opening)  # a repeated token has been counted in the piece before
    met = np.concatenate([grid[: live[t], t] for t in range(steps)])
    flat_weights = np.concatenate(weights)
    emits = np.stack([np.bincount(met, flat_weights[:, j], len(by_class)) for j in range(k)], 1)
    logs = [np.log10(s[:, 0]) for s in scale]
    logs[0] = np.where(goes_on, 0.0, logs[0])
    head = np.concatenate([opening[~goes_on].sum(0), opening[goes_on].sum(0), moves.ravel(), [float(sum(x.sum() for x in logs)), float(sizes.sum() - goes_on.sum())]])
    return head, emits


def estimated(words: Vocabulary, k: int, head: np.ndarray, emits: np.ndarray):
    """The model of the counts: start, transitions, emissions (float32, stored by class), start of later pieces.

    Emissions lean on the overall shares by PRIOR tokens, so no class has probability 0."""
    start, later, moves = head[:k] + 0.1, head[k : 2 * k] + 0.1, head[2 * k : 2 * k + k * k].reshape(k, k) + 0.1
    by_class = PRIOR * words.overall()[:, None] + emits
    return start / start.sum(), moves / moves.sum(1, keepdims=True), (by_class / by_class.sum(0)).astype(np.float32).T, later / later.sum()


def first_guess(words: Vocabulary, states: int, grid: np.ndarray, sizes: np.ndarray):
    """A model of the sampled pieces; a state begins near what one of them holds."""
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    overall = words.overall()
    by_class = np.repeat(overall[:, None], states, 1)
    for j in range(min(states, len(grid)) if states > 1 else 0):
        piece = grid[j * len(grid) // states][: abs(int(sizes[j * len(grid) // states]))]
        by_class[:, j] *= 0.7
        np.add.at(by_class[:, j], piece, 0.3 / len(piece))
    even = np.full(states, 1 / states)
    model = (even, move, by_class.astype(np.float32).T, even)
    for _ in range(START_PASSES if len(grid) and states > 1 else 0):
        model = estimated(words, states, *expected(model, grid, sizes))
    return model


def baum_welch(docs: DataFrame, words: Vocabulary, passes: int = PASSES, states: int = STATES, files: int | None = None):
    """The model, and the log10 likelihood of all training tokens, each a token, before each pass."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(words)
    share = min(1.0, 4 * START_SEGMENTS * PIECE / max(words.n, 1))
    schema = pa.schema([("c", pa.binary()), ("s", pa.binary()), ("k", pa.binary())])

    def classed(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for classes, sizes, keys in pieces(ids, batch.column(1), ~held_out_ids(ids), sent.value):
                yield pa.RecordBatch.from_pydict({"c": [classes.tobytes()], "s": [sizes.tobytes()], "k": [keys.tobytes()]}, schema=schema)

    stored = cut(docs.mapInArrow(classed, "c binary, s binary, k binary"), "classes", files)  # four bytes a token

    def grids(batches, at_once=1):
        """The stored pieces as grids of at_once or more."""
        held, n = ([], [], []), 0
        for batch in batches:
            for row in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                for part, x in zip(held, row, strict=True):
                    part.append(x.as_py())
                n += len(held[1][-1]) // 4
                if n >= at_once:
                    yield *as_grid(b"".join(held[0]), b"".join(held[1])), np.frombuffer(b"".join(held[2]), np.uint64)
                    held, n = ([], [], []), 0
        if n:
            yield *as_grid(b"".join(held[0]), b"".join(held[1])), np.frombuffer(b"".join(held[2]), np.uint64)

    def sampled(batches):
        for grid, sizes, keys in grids(batches):
            marks = mix(keys ^ np.array([zlib.crc32(g.tobytes()) for g in grid], np.uint64))
            some = np.flatnonzero(marks < np.uint64(min(int(share * 2.0**64), (1 << 64) - 1)))
            if len(some):
                yield pa.RecordBatch.from_pydict({"m": marks[some].view(np.int64), "g": [grid[i].tobytes() for i in some], "s": sizes[some]})

    # equal pieces of equal ids are one; the rest are 4 * START_SEGMENTS on average
    got = stored.mapInArrow(sampled, "m bigint, g binary, s int").distinct().orderBy("m", "s", "g").limit(START_SEGMENTS).collect()
    sizes = np.array([r["s"] for r in got], np.int32)
    grid = np.frombuffer(b"".join(bytes(r["g"]) for r in got), np.int32).reshape(-1, PIECE + 1)
    model, history = first_guess(words, states, grid, sizes), []
    for _ in range(passes):
        now = context.broadcast(model)

        def counted(batches, now=now):
            head, emits = None, None
            for grid, sizes, _ in grids(batches, PIECES_AT_ONCE):
                one, two = expected(now.value, grid, sizes)
                head, emits = (one, two) if head is None else (head + one, emits + two)
            if head is not None:
                block = TaskContext.get().partitionId() // PARTS_AT_ONCE
                ids = np.flatnonzero(emits.any(1)).astype(np.int32)
                rows = [{"b": block, "k": -1, "i": b"", "x": head.tobytes()}]
                edges = np.searchsorted(ids, np.arange(0, len(emits) + CLASS_RANGE, CLASS_RANGE))
                rows += [{"b": block, "k": r, "i": ids[a:b].tobytes(), "x": emits[ids[a:b]].tobytes()} for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("b", pa.int32()), ("k", pa.int32()), ("i", pa.binary()), ("x", pa.binary())]))

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            block, k = int(pdf["b"].iloc[0]), int(pdf["k"].iloc[0])
            if k < 0:
                return pd.DataFrame([{"b": block, "k": k, "i": b"", "x": sum(np.frombuffer(x) for x in pdf["x"]).tobytes()}])
            total = np.zeros((CLASS_RANGE, states))
            for i, x in zip(pdf["i"], pdf["x"], strict=True):
                total[np.frombuffer(i, np.int32) - k * CLASS_RANGE] += np.frombuffer(x).reshape(-1, states)
            some = np.flatnonzero(total.any(1)).astype(np.int32)
            return pd.DataFrame([{"b": block, "k": k, "i": (some + k * CLASS_RANGE).astype(np.int32).tobytes(), "x": total[some].tobytes()}])

        # blocks of partitions first, then all: no group grows with the number of tasks but by a part of it
        kinds = "b int, k int, i binary, x binary"
        once = stored.mapInArrow(counted, kinds).groupBy("k", "b").applyInPandas(added, kinds)
        rows = once.groupBy("k").applyInPandas(added, kinds).collect()  # a row for each CLASS_RANGE classes; 64 bytes a class
        now.unpersist()
        heads = [np.frombuffer(bytes(r["x"])) for r in rows if r["k"] < 0]
        if not heads:
            break
        head = sum(heads)
        ids = np.concatenate([np.frombuffer(bytes(r["i"]), np.int32) for r in rows if r["k"] >= 0])
        emits = np.zeros((words.classes, states))
        emits[ids] = np.concatenate([np.frombuffer(bytes(r["x"])).reshape(-1, states) for r in rows if r["k"] >= 0])
        model = estimated(words, states, head, emits)
        history.append(float(head[-2] / head[-1]))
        if len(history) > 1 and history[-1] - history[-2] < TOLERANCE:
            break
    sent.unpersist()
    drop(stored)
    return model, history


def forward(model, cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence, whole and scaled; cls holds them one after another."""
    start, move, emit = model[:3]
    by_class = np.ascontiguousarray(emit.T)  # no copy of our own models, which are stored by class
    sizes = np.diff(at)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = at[:-1][order], sizes[order]
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
    score, a = np.zeros(len(sizes)), None
    for t, n in enumerate(live.tolist()):
        a = (a[:n] @ move if t else np.broadcast_to(start, (n, len(start)))) * by_class[cls[at[:n] + t]]
        s = a.sum(1)
        a = a / s[:, None]
        score[:n] += np.log10(s)
    out[order] = score
    return out


PACKED = "range int, part int, h binary, d binary, x binary"


def _score(sent, n_ranges: int, id_type: pa.DataType):
    """Documents' own parts (their scores but for the rare words) and the rare words, packed by range."""

    def run(batches):
        words, model = sent.value
        part, number = TaskContext.get().partitionId(), 0
        schema = pa.schema([("range", pa.int32()), ("part", pa.int32()), ("h", pa.binary()), ("d", pa.binary()), ("x", pa.binary())])
        rare, held = [], 0

        def packed():
            h, code = (np.concatenate(x) for x in zip(*rare, strict=True))
            return [{"range": k, "part": part, "h": a.tobytes(), "d": b.tobytes(), "x": b""} for k, (a, b) in split(ranges(h, n_ranges), n_ranges, h, code)]

        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = held_out_ids(ids)
            n = len(ids)
            logs, known, norm, sizes = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
            classes = []
            for i, at, h, e in tokens(batch.column(1)):
                place = words.find(h)
                cls = words.of(place, e)
                doc = np.repeat(np.arange(i, i + len(at) - 1), np.diff(at))
                hot = place >= 0
                logs += np.bincount(doc[hot], np.log10(words.c[place[hot]] + 1.0), n)
                known += np.bincount(doc[hot], minlength=n)
                norm += np.bincount(doc[~hot], words.ending_norm[e[~hot]], n)
                sizes[i : i + len(at) - 1] = np.diff(at) + 1
                with_end = np.zeros(len(cls) + len(at) - 1, np.int32)
                with_end[np.arange(len(cls)) + doc - i] = cls
                classes.append(with_end)
                rare.append((h[~hot], (((doc[~hot] + number).astype(np.uint32) << np.uint32(1)) | (~out[doc[~hot]]).astype(np.uint32))))
                held += len(rare[-1][0])
            scores = forward(model, np.concatenate(classes) if classes else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)]))
            own = logs + np.log10(words.ends + 1.0)  # words with a class, and the end: in the base score, but 1 given their class
            known += words.ends > 0
            sink = io.BytesIO()
            table = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(out), pa.array(sizes), pa.array(known), pa.array(own), pa.array(scores - norm - own), pa.array(np.arange(number, number + n))], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "rest", "number"])
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_batch(table)
            yield pa.RecordBatch.from_pylist([{"range": n_ranges + part % n_ranges, "part": part, "h": b"", "d": b"", "x": sink.getvalue()}], schema=schema)
            number += n
            if held > RARE_AT_ONCE:
                yield pa.RecordBatch.from_pylist(packed(), schema=schema)
                rare, held = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(packed(), schema=schema)

    return run


def _meet(n_ranges: int):
    """Rare words of a range meet: their counts are those of their training occurrences; sums by document go back to its part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["range"].iloc[0] >= n_ranges:
            return pdf[["part", "h", "d", "x"]]
        h, d = joined(pdf["h"], np.uint64), joined(pdf["d"], np.uint32)
        part = np.repeat(pdf["part"].to_numpy(np.uint64), [len(x) // 4 for x in pdf["d"]])
        order = np.argsort(h, kind="stable")
        h, d, part = h[order], d[order], part[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(first) - 1
        count = np.bincount(group, (d & np.uint32(1)).astype(float))
        logs, known = np.log10(count + 1)[group], (count > 0)[group]
        key = (part << np.uint64(32)) | (d >> np.uint32(1)).astype(np.uint64)
        own, back = np.unique(key, return_inverse=True)
        logs, known = np.bincount(back, logs), np.bincount(back, known).astype(np.uint32)
        parts = (own >> np.uint64(32)).astype(np.int64)
        rows, edges = [], np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows.append({"part": int(parts[a]), "h": logs[a:b].tobytes(), "d": (own[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + known[a:b].tobytes(), "x": b""})
        return pd.DataFrame(rows, columns=["part", "h", "d", "x"])

    return run


def _finish(n: int, v: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = pd.concat([pa.ipc.open_stream(x).read_all().to_pandas(integer_object_nulls=True) for x in pdf["x"] if len(x)]).sort_values("number", ignore_index=True)
        logs, known = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        for h, d, x in zip(pdf["h"], pdf["d"], pdf["x"], strict=True):
            if not len(x):
                d = np.frombuffer(d, np.uint32).reshape(2, -1)
                logs[d[0]] += np.frombuffer(h)
                known[d[0]] += d[1]
        logs += docs["logs"].to_numpy()
        base = logs - docs["n_tokens"].to_numpy() * np.log10(n + v + 1)
        score = docs["rest"].to_numpy() + logs if n else base
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": docs["n_known"].to_numpy() + known, "train_tokens": n, "base_score": base, "score": score})

    return run


def _texts(docs: DataFrame) -> tuple[DataFrame, bool]:
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    as_text = isinstance(text.schema["doc_id"].dataType, T.StringType)
    return (text if as_text else text.withColumn("doc_id", F.col("doc_id").cast("long"))), as_text


def train(docs: DataFrame, passes: int = PASSES, states: int = STATES, n_ranges: int | None = None):
    """Vocabulary and model of the training documents, and the history of baum_welch()."""
    ship(docs.sparkSession)
    text, _ = _texts(docs)
    size = text_bytes(text)
    files = pieces_of(size, FILE_BYTES, 8)
    words = vocabulary(text, n_ranges or min(MAX_RANGES, pieces_of(size, RANGE_BYTES, 8)), files)
    return (words, *baum_welch(text, words, passes, states, files))


def score(docs: DataFrame, passes: int = PASSES, states: int = STATES, trained=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; trained: what train() gave."""
    ship(docs.sparkSession)
    text, as_text = _texts(docs)
    n_ranges = min(MAX_RANGES, pieces_of(text_bytes(text), RANGE_BYTES, 8))
    words, model, _ = trained or train(docs, passes, states, n_ranges)
    sent = docs.sparkSession.sparkContext.broadcast((words, model))
    packed = text.mapInArrow(_score(sent, n_ranges, pa.string() if as_text else pa.int64()), PACKED)
    met = packed.groupBy("range").applyInPandas(_meet(n_ranges), "part int, h binary, d binary, x binary")
    schema = f"doc_id {'string' if as_text else 'bigint'}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return met.groupBy("part").applyInPandas(_finish(words.n, words.v), schema)

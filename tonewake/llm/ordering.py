"""Training-order materialisation of token ids.

Documents are tokenised, each closed by an end token, and stand one after another in one stream of tokens: by file, and within
a file as they are stored.  The stream is cut into sequences of one length (the last one is filled up with end tokens).  A
keyed Feistel permutation with cycle-walking gives every sequence a global slot; ranges of slots go to writers, which write
shards of fixed-stride records.  Slot s is record s % rows_per_shard of shard s // rows_per_shard, so a reader can resume
anywhere by arithmetic.  The same files give the same shards, however Spark splits and deals them.

Two narrow passes tokenise: the first counts the tokens of each split of a file, which gives every split its place in the
stream; the second cuts and ships them.  A sequence that spans splits is put together by its writer.  Nothing but the shuffle
and the shards is stored.  Should the second pass meet other splits than the first, it fails and both are redone.  Shards are
written under a temporary name and renamed, so a task may run again; what an earlier attempt wrote is removed first.

Defined results: a null or empty text is a document of its end token only; repeated rows are documents of their own; an
empty table writes no shard.  Rows that don't come straight from files stand by input partition, as nothing else orders them.
"""

from __future__ import annotations

import base64
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewake.sources.shipping import ship

LENGTH = 1024
ROWS_PER_SHARD = 4096
#: Fixed value: the split of text before the merges of byte-level rank files.  The group changes no match; it keeps what needs
#: no look-ahead together, so that one automaton tries it at once.
PATTERN = r"(?:'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s+"
CHANGED = "the input's partitions changed between the passes"


class Tokenizer:
    """A public tokenizer's file, by its ending; ids of a list of texts, the number of ids with the end token, the end token."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.end = max(ranks.values()) + 1
            self.size = self.end + 1
            made = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": self.end})
            self._encode = lambda text: made.encode_to_numpy(text, disallowed_special=())  # no text is a special token; no list of numbers is made
        elif path.endswith(".json"):
            from tokenizers import Tokenizer as Made

            made = Made.from_file(path)
            made.encode_special_tokens = True
            self.size = made.get_vocab_size()
            self.end = made.token_to_id("<|endoftext|>")
            self._encode = lambda text: made.encode(text, add_special_tokens=False).ids
        else:
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.end = made.vocab_size(), made.eos_id()
            self._encode = lambda text: made.encode(text, num_threads=1)
        self._code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self._code == "H" else "<u4")

    def count(self, text: str | None) -> int:
        return len(self._encode(text)) + 1 if text else 1

    def __call__(self, text: str | None) -> np.ndarray:
        found = self._encode(text) if text else []
        ids = np.empty(len(found) + 1, self.dtype)
        ids[:-1] = found if isinstance(found, np.ndarray) else array(self._code, found)
        ids[-1] = self.end
        return ids


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network over the next even number of bits, walked until inside."""
    if n <= 1:
        return numbers.astype(np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    keys = [np.uint64(zlib.crc32(b"%d|%d" % (key, r)) << 32 | zlib.crc32(b"%d|%d|" % (r, key))) for r in range(rounds)]
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _mark(mark: int, column: pa.Array) -> int:
    return zlib.crc32("\n".join(map(str, column.to_pylist())).encode(), mark)


def _runs(batch: pa.RecordBatch, partition: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows by the number of their split, in order; without files by partition."""
    keys = batch.column("split")
    if keys.null_count:
        yield partition, batch
        return
    edges = np.flatnonzero(np.diff(keys.to_numpy(), prepend=0, append=0)) if batch.num_rows else []
    edges = sorted({0, batch.num_rows, *map(int, edges)})
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield keys[a].as_py(), batch.slice(a, b - a)


COUNTED = pa.schema([("split", pa.int64()), ("tokens", pa.int64()), ("mark", pa.int64())])


def _counting(path: str):
    def run(batches):
        encode, found, partition = tokenizer(path), {}, TaskContext.get().partitionId()
        for batch in batches:
            for key, rows in _runs(batch, partition):
                tokens, mark = found.get(key, (0, 0))
                found[key] = tokens + sum(encode.count(x.as_py()) for x in rows.column("text")), _mark(mark, rows.column("doc_id"))
        yield pa.RecordBatch.from_pylist([{"split": s, "tokens": n, "mark": m} for s, (n, m) in found.items()], schema=COUNTED)

    return run


SEGMENTS = [("seg_offset", pa.int64()), ("seg_at", pa.int32()), ("seg_tokens", pa.int32())]
#: Sequences that are shipped as one batch.
AT_ONCE = 512


def _sequencing(path: str, length: int, places, total: int, key: int, rows_per_shard: int, id_type: pa.DataType):
    """Yields what each split has of each sequence: slot, shard, place in the sequence, bytes, and the documents' pieces in them."""

    def run(batches):
        encode = tokenizer(path)
        group, held, pieces, begun, now, at, mark, partition = [], [], [], 0, None, 0, 0, TaskContext.get().partitionId()

        def close():
            nonlocal held, pieces, begun
            if held:
                group.append((begun // length, begun % length, np.concatenate(held), pieces))
            held, pieces, begun = [], [], at

        def check():
            if now is not None and (at, mark) != (places.value[now][1], places.value[now][2]):
                raise RuntimeError(CHANGED)

        for batch in batches:
            for name, rows in _runs(batch, partition):
                if name != now:
                    close()
                    check()
                    if name not in places.value:
                        raise RuntimeError(CHANGED)
                    now, at, mark = name, places.value[name][0], 0
                    begun = at
                mark = _mark(mark, rows.column("doc_id"))
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
                    ids, done = encode(text.as_py()), 0
                    while done < len(ids):
                        n = min(length - at % length, len(ids) - done)
                        held.append(ids[done : done + n])
                        pieces.append((doc, done, at % length, n))
                        done, at = done + n, at + n
                        if at % length == 0:
                            close()
                    if len(group) >= AT_ONCE:
                        yield shipped(group)
                        group.clear()
        close()
        check()
        if group:
            yield shipped(group)

    def shipped(group):
        slots = permuted(np.array([g[0] for g in group]), total, key)
        lists = [[[p[k] for p in g[3]] for g in group] for k in range(4)]
        return pa.RecordBatch.from_arrays(
            [pa.array(slots, pa.int64()), pa.array(slots // rows_per_shard, pa.int32()), pa.array([g[1] for g in group], pa.int32()), pa.array([g[2].tobytes() for g in group], pa.binary()), pa.array(lists[0], pa.list_(id_type)), *[pa.array(v, pa.list_(t)) for v, (_, t) in zip(lists[1:], SEGMENTS, strict=True)]],
            names=["slot", "shard", "at", "tokens", "seg_doc", *[c for c, _ in SEGMENTS]],
        )

    return run


def _open(path: str, mode: str):
    """A file in the shared folder: a mounted one as such, others by Arrow's file systems.  Writers get paths with a scheme."""
    if path.startswith("file:") or "://" not in path:
        return open(local(path), mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _rename(old: str, new: str) -> None:
    if old.startswith("file:") or "://" not in old:
        os.replace(local(old), local(new))
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(old)
    system.move(inner, fs.FileSystem.from_uri(new)[1])


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _writing(folder: str, itemsize: int, length: int, end: bytes, last_slot: int):
    """Puts sequences together, writes each shard when its rows are in, and passes on all but the tokens, with a checksum for each piece."""

    def flush(shard: int, records: list[bytes]) -> None:
        path = shard_path(folder, shard)
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with _open(own, "wb") as f:
            for r in records:
                f.write(r)
        _rename(own, path)

    def whole(slot: int, parts: list[bytes]) -> bytes:
        record = b"".join(parts)
        if len(record) < length * itemsize and slot == last_slot:
            record += end * (length - len(record) // itemsize)
        if len(record) != length * itemsize:
            raise RuntimeError(f"sequence {slot} isn't whole")
        return record

    def run(batches):
        shard, slot, parts, records = None, None, [], []
        for batch in batches:
            crcs = []
            columns = [batch.column(c).to_pylist() for c in ("shard", "slot", "at", "seg_at", "seg_tokens")]
            for s, n, at, ats, counts, tokens in zip(*columns, batch.column("tokens"), strict=True):
                if n != slot:
                    if parts:
                        records.append(whole(slot, parts))
                    slot, parts = n, []
                if s != shard:
                    if records:
                        flush(shard, records)
                    shard, records = s, []
                raw = tokens.as_py()
                parts.append(raw)
                crcs.append([zlib.crc32(raw[(a - at) * itemsize : (a - at + k) * itemsize]) for a, k in zip(ats, counts, strict=True)])
            keep = ["slot", "shard", "seg_doc", *[c for c, _ in SEGMENTS]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(crcs, pa.list_(pa.int64()))], names=[*keep, "seg_crc"])
        if parts:
            records.append(whole(slot, parts))
        if records:
            flush(shard, records)

    return run


def _placed(docs: DataFrame) -> tuple[DataFrame, dict[int, int] | None]:
    """doc_id, text and split (a number for each split of a file), and the splits' order by file and place.

    Where rows don't come straight from files, split is null and there is no such order."""
    light = ["doc_id", F.col("text").cast("string").alias("text")]
    if not _of_files(docs):
        return docs.select(*light, F.lit(None).cast("long").alias("split")), None
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    splits = docs.select(file.alias("file"), start.alias("start")).distinct().withColumn("split", F.xxhash64("file", "start")).collect()  # a row for each split
    order = {r["split"]: k for k, r in enumerate(sorted(splits, key=lambda r: (r["file"], r["start"])))}
    if len(order) < len(splits):
        raise RuntimeError("two splits have one number")
    return docs.select(*light, F.xxhash64(file, start).alias("split")), order


def _of_files(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.file_path", "_metadata.file_block_start").schema
    except AnalysisException:
        return False
    return "_metadata" not in docs.columns


def _emptied(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, without shards of an earlier attempt."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    for status in system.listStatus(where):
        if status.getPath().getName().startswith(("shard-", "sequences")):
            system.delete(status.getPath(), True)
    return system.makeQualified(where).toString()


def write_training_order(docs: DataFrame, tokenizer_path: str, folder: str, key: int = 2024, length: int = LENGTH, rows_per_shard: int = ROWS_PER_SHARD, attempts: int = 3) -> DataFrame:
    """Writes shards and a manifest into folder, which all executors share; returns the manifest.

    One row for each piece of a document in a sequence: slot, shard, row_in_shard, doc_id, doc_offset (of the piece in the
    document's tokens), seq_offset, n_tokens, crc32 (of the piece's bytes)."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    light, order = _placed(docs)
    id_type = pa.string() if isinstance(light.schema["doc_id"].dataType, T.StringType) else pa.int64()
    if id_type == pa.int64():
        light = light.withColumn("doc_id", F.col("doc_id").cast("long"))
    made_by = tokenizer(tokenizer_path)
    itemsize, end = made_by.dtype.itemsize, np.array([made_by.end], made_by.dtype).tobytes()
    kind = "string" if id_type == pa.string() else "bigint"
    segments = f"seg_doc array<{kind}>, seg_offset array<bigint>, seg_at array<int>, seg_tokens array<int>"
    for attempt in range(attempts):
        folder = _emptied(spark, folder)
        counts = light.mapInArrow(_counting(tokenizer_path), "split bigint, tokens bigint, mark bigint").collect()  # a row for each split
        places, tokens = {}, 0
        for r in sorted(counts, key=lambda r: r["split"] if order is None else order[r["split"]]):
            places[r["split"]] = (tokens, tokens + r["tokens"], r["mark"])
            tokens += r["tokens"]
        sent = spark.sparkContext.broadcast(places)
        total = -(-tokens // length)
        shards = -(-total // rows_per_shard)
        tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        made = light.mapInArrow(_sequencing(tokenizer_path, length, sent, total, key, rows_per_shard, id_type), f"slot bigint, shard int, at int, tokens binary, {segments}")
        if shards:
            made = made.repartitionById(tasks, F.floor(F.col("shard") * F.lit(tasks) / F.lit(shards)).cast("int")).sortWithinPartitions("slot", "at")
        last_slot = int(permuted(np.array([total - 1]), total, key)[0]) if total else -1
        written = made.mapInArrow(_writing(folder, itemsize, length, end, last_slot), f"slot bigint, shard int, {segments}, seg_crc array<bigint>")
        pieces = written.select("slot", "shard", F.explode(F.arrays_zip("seg_doc", *[c for c, _ in SEGMENTS], "seg_crc")).alias("p"))
        manifest = f"{folder}/manifest-{attempt}"
        try:
            pieces.select("slot", "shard", (F.col("slot") % rows_per_shard).cast("int").alias("row_in_shard"), F.col("p.seg_doc").alias("doc_id"), F.col("p.seg_offset").alias("doc_offset"), F.col("p.seg_at").alias("seq_offset"), F.col("p.seg_tokens").alias("n_tokens"), F.col("p.seg_crc").alias("crc32")).write.parquet(manifest)
        except PySparkException as e:
            if CHANGED not in str(e) or attempt == attempts - 1:
                raise
            continue
        with _open(f"{folder}/sequences", "wb") as f:
            f.write(b"%d" % total)
        return spark.read.parquet(manifest)
    raise RuntimeError(CHANGED)


def read_sequences(folder: str, tokenizer_path: str, start: int = 0, length: int = LENGTH, rows_per_shard: int = ROWS_PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences from slot start on, in training order."""
    dtype = tokenizer(tokenizer_path).dtype
    stride = length * dtype.itemsize
    with _open(f"{folder}/sequences", "rb") as f:
        total = int(f.read())
    while start < total:
        with _open(shard_path(folder, start // rows_per_shard), "rb") as f:
            f.seek(start % rows_per_shard * stride)
            while raw := f.read(stride):
                yield np.frombuffer(raw, dtype)
                start += 1
                if start % rows_per_shard == 0:
                    break

"""Training-order materialisation of token ids as binary shards.

Documents are tokenised and dealt by a hash of doc_id and text into buckets, whose number follows from the bytes of all texts; in a bucket they are ordered by doc_id and text hash and packed,
each followed by an end mark, into sequences of ``LENGTH`` tokens; only the last sequence of a bucket is padded. The packed sequences are a table, from which each bucket's are counted; that numbers
all sequences 0 .. n - 1 by a prefix sum over buckets. A keyed Feistel network over the next even number of bits, walked until it falls below n,
permutes these numbers: sequence i has the global slot permute(i). Slots are dealt to shards by ranges of ``PER_SHARD``, sorted, and written with a fixed stride, so slot s stands in shard s // PER_SHARD at byte
(s % PER_SHARD) * stride: a reader goes through the slots in order and resumes at any of them by arithmetic. Neither sequences nor slots depend on how the input is cut into files or partitions.

Each text is tokenised once. Its tokens cross the network once, compressed, and sequences once. What the driver holds is a number for each bucket (``BUCKET`` bytes of text) and a name for each
shard. A task writes a shard under a name of its own, which the manifest records when the task is committed; a task that runs again, or twice, leaves a file that no manifest names, and such files are deleted at the end.

Defined results: a null text gives no tokens and no end mark, an empty one its end mark. Rows of equal doc_id follow each other by text hash if they meet in a bucket. Extra columns are ignored. An empty table
gives no shard.
"""

from __future__ import annotations

import base64
import gc
import json
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, claim, shared_dir

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
PAD = 65_535
LENGTH = 1_024
#: sequences of a shard
PER_SHARD = 4_096
#: sequences that a task packs before it sends them on
LOT = 4_096
#: sequences in a row of the table of packed ones
PACK = 512
#: bytes of text in a bucket, about
BUCKET = 32_000_000
KEY = 20240917
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}/{r}")) for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (_mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), back)
        out = np.flatnonzero(x >= np.uint64(self.n))
        while len(out):
            x[out] = self._once(x[out], back)
            out = out[x[out] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


class Tokens:
    """Token ids of texts as bytes of 16-bit numbers."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        return array("H", self.bpe.encode_ordinary(text)).tobytes()

    def count(self, text: str) -> int:
        """How many tokens ``encode`` gives, without the bytes."""
        return len(self.bpe.encode_ordinary(text))

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode(ids.tolist())


_made: dict[int, Tokens] = {}


def tokens_of(ranks: bytes) -> Tokens:
    """The worker's tokenizer for these ranks; it serves all tasks of the worker."""
    claim("shards", _made.clear)
    k = xxhash.xxh64_intdigest(ranks)
    if k not in _made:
        _made.clear()
        _made[k] = Tokens(ranks)
    return _made[k]


def _packed(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, list[int], bytes]]:
    """(bucket, number in it, doc_ids, bytes) of each sequence; ``rows``: bucket, doc_id, bytes of tokens, by bucket. The documents with a token in it, in order."""
    stride = 2 * LENGTH
    held, docs, own, n = bytearray(), [], None, 0
    for bucket, i, tokens in rows:
        if bucket != own:
            if held:
                yield own, n, docs, bytes(held)
            held, docs, own, n = bytearray(), [], bucket, 0
        held += tokens
        docs.append(i)
        at = 0
        while len(held) - at >= stride:
            yield own, n, docs, bytes(held[at : at + stride])
            n, at = n + 1, at + stride
            docs = [i] if len(held) > at else []
        if at:
            del held[:at]
    if held:
        yield own, n, docs, bytes(held)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, in its order: bucket, doc_id, k, z (compressed tokens). Its sequences, some ``PACK`` in a row: bucket, first (number), n, doc_ids, n_tokens, z (tokens of all, compressed)."""
    opened, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=5)
    rows = ((bucket, i, opened.decompress(x)) for b in batches for bucket, i, x in zip(*(b.column(c).to_pylist() for c in (0, 1, 3))))
    held: list[tuple[int, int, list[int], bytes]] = []

    def flush() -> pa.RecordBatch:
        columns = [
            pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([[x[2] for x in held]], pa.list_(pa.list_(pa.int64()))),
            pa.array([[len(x[3]) // 2 for x in held]], pa.list_(pa.int32())), pa.array([z.compress(b"".join(x[3] for x in held))], pa.binary()),
        ]
        held.clear()
        return pa.record_batch(columns, ["bucket", "first", "n", "doc_ids", "n_tokens", "z"])

    for x in _packed(rows):
        if held and (x[0] != held[0][0] or len(held) == PACK):
            yield flush()
        held.append(x)
    if held:
        yield flush()


def sequences(docs: DataFrame, tables: Tables, ranks: str = RANKS, key: int = KEY, per_shard: int = PER_SHARD) -> tuple[DataFrame, int]:
    """All sequences, in lots of one shard each (shard, slots, doc_ids, n_tokens, tokens: all of the lot, compressed), and their number. They are read from one of ``tables``, not made from the texts again."""
    with open(ranks, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.uint16(END).tobytes()
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("k"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    buckets = -(-size // BUCKET)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k"), F.lit(max(buckets, 1))).cast("int"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, z = tokens_of(shared.value), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.record_batch([*b.columns[:3], pa.array([z.compress(t.encode(x) + end) for x in b.column(3).to_pylist()], pa.binary())], ["bucket", "doc_id", "k", "z"])

    dealt = rows.select("bucket", "doc_id", "k", "text").mapInArrow(encode, "bucket int, doc_id long, k long, z binary").repartitionById(max(buckets, 1), "bucket").sortWithinPartitions("bucket", "doc_id", "k")
    packed = tables.keep(dealt.mapInArrow(_pack, "bucket int, first long, n int, doc_ids array<array<long>>, n_tokens array<int>, z binary"))
    del dealt
    base, total = np.zeros(buckets, np.int64), 0
    for r in sorted(packed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        base[r["bucket"]] = total
        total += r["n"]
    gc.collect()  # so that Spark deletes the shuffle of the tokens before it makes that of the sequences; Spark holds on to a job's until another has run
    docs.sparkSession.sparkContext._jvm.System.gc()
    starts = docs.sparkSession.sparkContext.broadcast(base)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, z, squeeze = Permutation(total, key), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=5)
        held: list[tuple[int, int, list[int], bytes]] = []

        def opened() -> Iterator[tuple[int, int, list[int], bytes]]:
            for b in batches:
                for i in range(b.num_rows):
                    bucket, first, _, ids, n, tokens = (c[i].as_py() for c in b.columns)
                    tokens, ends = z.decompress(tokens), 2 * np.cumsum([0, *n])
                    yield from ((bucket, first + j, own, tokens[x:y]) for j, (own, x, y) in enumerate(zip(ids, ends[:-1].tolist(), ends[1:].tolist())))

        def flush() -> pa.RecordBatch:
            slot = order.slot(starts.value[[x[0] for x in held]] + [x[1] for x in held])
            shard = slot // per_shard
            at = np.argsort(shard, kind="stable")
            lots = np.split(at, np.flatnonzero(np.diff(shard[at])) + 1)
            columns = [
                pa.array([int(shard[x[0]]) for x in lots], pa.int32()), pa.array([slot[x].tolist() for x in lots], pa.list_(pa.int64())), pa.array([[held[i][2] for i in x] for x in lots], pa.list_(pa.list_(pa.int64()))),
                pa.array([[len(held[i][3]) // 2 for i in x] for x in lots], pa.list_(pa.int32())), pa.array([squeeze.compress(b"".join(held[i][3] for i in x)) for x in lots], pa.binary()),
            ]
            return pa.record_batch(columns, ["shard", "slots", "doc_ids", "n_tokens", "tokens"])

        for x in opened():
            held.append(x)
            if len(held) == LOT:
                yield flush()
                held = []
        if held:
            yield flush()

    return packed.mapInArrow(make, "shard int, slots array<long>, doc_ids array<array<long>>, n_tokens array<int>, tokens binary"), total


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_shards(docs: DataFrame, out: str, manifest: str, ranks: str = RANKS, key: int = KEY, per_shard: int = PER_SHARD) -> DataFrame:
    """Write all sequences of ``docs`` into ``out`` as shard-NNNNNNNN-*.bin, and meta.json; gives slot, doc_ids, n_tokens, file of what was written, kept as Parquet in ``manifest``."""
    with Tables(docs.sparkSession) as tables:
        return _write(docs, tables, out, manifest, ranks, key, per_shard)


def _write(docs: DataFrame, tables: Tables, out: str, manifest: str, ranks: str, key: int, per_shard: int) -> DataFrame:
    spark = docs.sparkSession
    got, total = sequences(docs, tables, ranks, key, per_shard)
    shards = max(1, -(-total // per_shard))
    fs, top = _open(out)
    fs.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard: one shard's sequences, ``per_shard`` at most, are held at a time."""
        fs, top = _open(out)
        z = zstandard.ZstdDecompressor()

        def one(shard: int, rows: list[tuple[int, list[int], bytes]]) -> pa.RecordBatch:
            name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
            rows.sort(key=lambda x: x[0])
            with fs.open_output_stream(f"{top}/{name}") as f:
                for _, _, x in rows:
                    f.write(x if len(x) == 2 * LENGTH else x + np.uint16(PAD).tobytes() * (LENGTH - len(x) // 2))
            columns = [pa.array([shard] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.list_(pa.int64())), pa.array([len(x[2]) // 2 for x in rows], pa.int32()), pa.array([name] * len(rows), pa.string())]
            return pa.record_batch(columns, ["shard", "slot", "doc_ids", "n_tokens", "file"])

        own, rows = None, []
        for b in batches:
            for shard, slots, docs, n, tokens in zip(*(b.column(c).to_pylist() for c in range(5))):
                if shard != own:
                    if rows:
                        yield one(own, rows)
                    own, rows = shard, []
                ends = 2 * np.cumsum([0, *n])
                tokens = z.decompress(tokens)
                rows += [(s, d, tokens[a:e]) for s, d, a, e in zip(slots, docs, ends[:-1].tolist(), ends[1:].tolist())]
        if rows:
            yield one(own, rows)

    dealt = got.repartitionById(shards, "shard").sortWithinPartitions("shard")
    schema = "shard int, slot long, doc_ids array<long>, n_tokens int, file string"
    dealt.mapInArrow(write, schema).write.parquet(manifest)
    wrote = spark.read.schema(schema).parquet(manifest)
    files = {r["shard"]: r["file"] for r in wrote.groupBy("shard").agg(F.max("file").alias("file")).collect()}
    keep = set(files.values())
    for x in fs.get_file_info(pafs.FileSelector(top)):
        if x.base_name.startswith("shard-") and x.base_name not in keep:
            fs.delete_file(x.path)
    with fs.open_output_stream(f"{top}/meta.json") as f:
        f.write(json.dumps({"sequences": total, "length": LENGTH, "stride": 2 * LENGTH, "per_shard": per_shard, "files": [files[k] for k in sorted(files)], "end": END, "pad": PAD, "key": key}).encode())
    return wrote.select("slot", "doc_ids", "n_tokens", "file")


def read_from(out: str, slot: int, count: int) -> Iterator[np.ndarray]:
    """The sequences of slots ``slot`` .. ``slot + count - 1`` in training order, padding cut off; each shard is opened once."""
    fs, top = _open(out)
    with fs.open_input_stream(f"{top}/meta.json") as f:
        meta = json.loads(f.read())
    stride, per_shard, stop = meta["stride"], meta["per_shard"], min(slot + count, meta["sequences"])
    while slot < stop:
        with fs.open_input_file(f"{top}/{meta['files'][slot // per_shard]}") as f:
            f.seek(slot % per_shard * stride)
            for _ in range(min(stop, (slot // per_shard + 1) * per_shard) - slot):
                x = np.frombuffer(f.read(stride), np.uint16)
                yield x[x != PAD]
                slot += 1


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """slot, shard, n_tokens, token_hash of every record of the shards in a folder, a task for each shard."""
    fs, top = _open(out)
    with fs.open_input_stream(f"{top}/meta.json") as f:
        meta = json.loads(f.read())
    per_shard = meta["per_shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                at = shard * per_shard
                got = [(len(x), xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63)) for x in read_from(out, at, per_shard)]
                yield pa.record_batch([pa.array(range(at, at + len(got)), pa.int64()), pa.array([shard] * len(got), pa.int32()), pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int64())], ["slot", "shard", "n_tokens", "token_hash"])

    n = len(meta["files"])
    return spark.range(0, n, 1, max(1, min(n, 100_000))).mapInArrow(run, "slot long, shard int, n_tokens int, token_hash long")


def materialise(docs: DataFrame) -> DataFrame:
    """slot, shard, n_tokens, token_hash, doc_ids of each record: written to the shared folder, and read back from the shards."""
    spark = docs.sparkSession
    home = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    wrote = write_shards(docs, f"{home}/shards", f"{home}/manifest")
    return read_shards(spark, f"{home}/shards").join(wrote.select("slot", "doc_ids"), "slot", "left")

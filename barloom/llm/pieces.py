"""SentencePiece encoding by sampled segmentations, and decoding.

A text becomes one lattice of the vocabulary's pieces. Forward filtering sums, for each place, the weights of all
segmentations up to it; backward sampling walks from the end and picks each piece with its share of that sum. The draws are a hash of
the row's key and the place, so a row always gets the same segmentation, whatever batch or task it is in.

A space is written as U+2581 and one is put before the text, as the vocabulary has it. No piece of the vocabulary goes on past a
space, so the lattice falls apart into chunks (spaces and the word after them) and the sums of a chunk serve all its occurrences.
A piece weighs (1 + its rank) ** -ALPHA. What no piece spells, a source U+2581 among it, is written in byte pieces, so decoding gives back every text.

Defined results: a null text has null tokens and an empty one none. Rows with equal keys draw alike; a null key is a key of its own.
Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, own_prefix, with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 20240917
#: chunks whose lattices a worker keeps
CACHE = 150_000
_SPACE = 0x2581
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key_hash(key: object) -> int:
    """A null key differs from any text."""
    return xxhash.xxh64_intdigest(b"", 1) if key is None else xxhash.xxh64_intdigest(str(key))


class Sampler:
    """Pieces of a model file's bytes; ``encode`` and ``decode`` lists of texts."""

    def __init__(self, model: bytes, alpha: float = ALPHA, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.seed = np.uint64(seed)
        self.bytes_of: list[bytes] = []
        byte_id, words = [0] * 256, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(p.replace("▁", " ").encode())
                words.append((i, p, sp.get_score(i)))
        self.byte_id = byte_id
        self.longest = max(len(p) for _, p, _ in words)
        rank = {i: r for r, (i, _, _) in enumerate(sorted(words, key=lambda x: (-x[2], x[0])))}
        ids = np.array([i for i, _, _ in words])
        self.log_w = np.zeros(len(self.bytes_of), np.float64)
        self.log_w[ids] = -alpha * np.log(1.0 + np.array([rank[i] for i in ids.tolist()]))
        self.log_byte = -alpha * np.log(1.0 + len(words))
        keys = np.array([self._hash_one(p) for _, p, _ in words], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
        self._forget()

    @staticmethod
    def _hash_one(p: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in reversed(p):
            h = _mix(h + np.uint64(ord(c) + 1))
        return int(h[0])

    def _forget(self) -> None:
        """A chunk's places are start .. start + length - 1, each the end of one character; ``row`` gives a place its number among ``first``,
        and first[row] .. first[row + 1] - 1 are the pieces that end there, the longest first."""
        self.at: dict[str, int] = {}
        self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.row, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.cum, self.piece, self.size = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Forward filtering of new chunks, place by place for all of them at once. A chunk is written without its first space."""
        lens = np.array([len(c) + 1 for c in chunks])
        ends = np.cumsum(lens)
        starts = ends - lens
        n = int(ends[-1])
        flat = np.full(n, _SPACE, np.int64)
        text = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        inner = np.ones(n, bool)
        inner[starts] = False
        flat[inner] = np.where(text == 32, _SPACE, np.where(text == _SPACE, 0x7FFFFFFF, text))
        place = np.arange(n) - np.repeat(starts, lens)
        # the pieces that end at each place
        h, live, found = np.zeros(n, np.uint64), np.arange(n), []
        plus = (flat + 1).astype(np.uint64)
        for size in range(1, self.longest + 1):
            if size > 1:
                stay = place[live] >= size - 1
                live, h = live[stay], h[stay]
                if not len(live):
                    break
            h = _mix(h + plus[live - size + 1])
            may = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
            hit = self.keys[k] == h[may]
            ids = self.ids[k[hit]]
            found.append((live[may[hit]], np.full(len(ids), size), ids, self.log_w[ids]))
        none = np.ones(n, bool)
        none[found[0][0]] = False
        none = np.flatnonzero(none)
        raw = np.where(flat[none] == 0x7FFFFFFF, _SPACE, flat[none])
        spelled = np.where(raw < 0x80, np.array(self.byte_id)[np.minimum(raw, 0x7F)], -2 - raw)
        found.insert(0, (none, np.ones(len(none), np.int64), spelled, self.log_byte * (1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF))))
        end, size, piece, weight = (np.concatenate(x) for x in zip(*found[::-1]))
        # rows: the places by their number in the chunk, then by chunk
        by_place = np.argsort(place, kind="stable")
        row = np.empty(n, np.int64)
        row[by_place] = np.arange(n)
        order = np.argsort(row[end], kind="stable")
        end, size, piece, weight = end[order], size[order], piece[order], weight[order]
        counts = np.bincount(row[end], minlength=n)
        first = np.concatenate(([0], np.cumsum(counts)))
        steps = np.concatenate(([0], np.cumsum(np.bincount(place))))
        total, share = np.zeros(n + 1), np.empty(len(end))
        for t in range(len(steps) - 1):
            lo, hi = steps[t], steps[t + 1]
            a, b = first[lo], first[hi]
            sums = np.where(size[a:b] == t + 1, 0.0, total[end[a:b] + 1 - size[a:b]]) + weight[a:b]
            at = first[lo:hi] - a
            top = np.maximum.reduceat(sums, at)
            x = np.exp(sums - np.repeat(top, counts[lo:hi]))
            whole = np.add.reduceat(x, at)
            total[by_place[lo:hi] + 1] = top + np.log(whole)
            share[a:b] = x / np.repeat(whole, counts[lo:hi])
        cum, so_far = np.empty(len(share)), np.zeros(n)  # summed within each place alone, so a chunk's sums do not depend on what else is in the batch
        for j in range(int(counts.max())):
            has = np.flatnonzero(counts > j)
            so_far[has] += share[first[has] + j]
            cum[first[has] + j] = so_far[has]
        cum[first[1:] - 1] = 2.0
        entries, rows, n0 = len(self.cum), len(self.first), len(self.start)
        self.start = np.concatenate((self.start, (starts + len(self.row)).astype(np.int32)))
        self.length = np.concatenate((self.length, lens.astype(np.int32)))
        self.row = np.concatenate((self.row, (row + rows).astype(np.int32)))
        self.first = np.concatenate((self.first, (first[:-1] + entries).astype(np.int32)))
        self.cum = np.concatenate((self.cum, cum.astype(np.float32)))
        self.piece = np.concatenate((self.piece, piece.astype(np.int32)))
        self.size = np.concatenate((self.size, size.astype(np.int32)))
        self.at.update(zip(chunks, range(n0, n0 + len(chunks))))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The words of a text, each after one space that isn't written; further spaces stand before the word."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, more = [], -1
        for p in parts:
            more += 1
            if p:
                out.append(" " * more + p)
                more = -1
        if more >= 0:
            out.append(" " * more)
        return out

    def encode(self, texts: list[str | None], keys: list) -> list[np.ndarray | None]:
        """Piece ids of each text."""
        out: list[np.ndarray | None] = [None if t is None else np.empty(0, np.int32) for t in texts]
        rows, lists, size = [], [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            c = self.chunks(t)
            rows.append(i)
            lists.append(c)
            size += len(c)
            if size >= 150_000:
                self._encode_rows(rows, lists, keys, out)
                rows, lists, size = [], [], 0
        if rows:
            self._encode_rows(rows, lists, keys, out)
        return out

    def _encode_rows(self, rows: list[int], lists: list[list[str]], keys: list, out: list) -> None:
        new = set().union(*lists).difference(self.at)
        if new:
            if len(self.at) + len(new) > CACHE and self.at:
                self._forget()
                new = set().union(*lists)
            todo, size = [], 0
            for c in sorted(new):
                todo.append(c)
                size += len(c) + 1
                if size > 250_000:
                    self._learn(todo)
                    todo, size = [], 0
            if todo:
                self._learn(todo)
        at = self.at
        ids = np.fromiter((at[c] for x in lists for c in x), np.int64)
        per = np.array([len(x) for x in lists])
        seeds = np.array([_key_hash(keys[i]) for i in rows], np.uint64)
        nth = np.arange(len(ids)) - np.repeat(np.cumsum(per) - per, per)
        seed = _mix(np.repeat(_mix(seeds ^ self.seed), per) + nth.astype(np.uint64) * _ODD)
        place, start = self.length[ids], self.start[ids]
        live, steps = np.arange(len(ids)), []
        count = np.zeros(len(ids), np.int64)
        while len(live):
            spot = place[live]
            k = self.first[self.row[start[live] + spot - 1]]
            u = (_mix(seed[live] + spot.astype(np.uint64)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            on = np.flatnonzero(self.cum[k] <= u)
            while len(on):
                k[on] += 1
                on = on[self.cum[k[on]] <= u[on]]
            steps.append((live, self.piece[k]))
            count[live] += 1
            spot = spot - self.size[k]
            place[live] = spot
            live = live[spot > 0]
        end = np.cumsum(count)
        tokens = np.empty(int(end[-1]), np.int64)
        for s, (who, what) in enumerate(steps):
            tokens[end[who] - 1 - s] = what
        last = end[np.cumsum(per) - 1]
        if (tokens < 0).any():
            for i, part in zip(rows, np.split(tokens, last[:-1])):
                out[i] = self._bytes(part) if (part < 0).any() else part.astype(np.int32)
        else:
            for i, part in zip(rows, np.split(tokens.astype(np.int32), last[:-1])):
                out[i] = part

    def _bytes(self, part: np.ndarray) -> np.ndarray:
        got: list[int] = []
        for x in part.tolist():
            got += [x] if x >= 0 else [self.byte_id[b] for b in chr(-2 - x).encode("utf-8", "surrogatepass")]
        return np.array(got, np.int32)

    def decode(self, ids: np.ndarray | list[int] | None) -> str | None:
        """The text that the pieces spell."""
        if ids is None:
            return None
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "surrogatepass")[1:]


_made: dict[tuple[int, float, int], Sampler] = {}


def _workers(docs: DataFrame, model: str, alpha: float, seed: int):
    """A function that gives a worker its sampler; the model file's bytes (some MB at most) are read on the driver and broadcast."""
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def sampler() -> Sampler:
        claim("pieces", _made.clear)
        k = (xxhash.xxh64_intdigest(shared.value), alpha, seed)
        if k not in _made:  # it and the chunks it keeps serve all tasks of the worker
            _made.clear()
            _made[k] = Sampler(shared.value, alpha, seed)
        return _made[k]

    return sampler


def encode(docs: DataFrame, key: str = "doc_id", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, check: bool = False) -> DataFrame:
    """``docs`` without ``text``, and ``tokens``, ``n_tokens``; with ``check`` also ``lossless``, whether decoding the tokens gave the text back."""
    sampler = _workers(docs, model, alpha, seed)
    names = [c for c in docs.columns if c not in ("text", "tokens", "n_tokens", "lossless")]
    rows = docs.select(*names, F.col("text"), F.col(key).cast("string").alias(f"{own_prefix(docs)}key"))
    schema = with_fields(docs.select(*names).schema, tokens="array<int>", n_tokens="int", **({"lossless": "boolean"} if check else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(len(names)).to_pylist()
                got = s.encode(texts, b.column(len(names) + 1).to_pylist())
                sizes = np.array([0 if x is None else len(x) for x in got], np.int32)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *[x for x in got if x is not None]])
                none = np.array([x is None for x in got])
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array(none))
                more = [pa.array([None if t is None else s.decode(x) == t for t, x in zip(texts, got)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], tokens, pa.array(sizes, pa.int32(), mask=none), *more], schema.names)

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``tokens`` and ``text``, spelled by the column ``tokens``."""
    sampler = _workers(tokens, model, ALPHA, SEED)
    names = [c for c in tokens.columns if c != "text"]
    rows = tokens.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s.decode(x) for x in b.column(names.index("tokens")).to_pylist()], pa.string())], [*names, "text"])

    return rows.mapInArrow(run, with_fields(rows.schema, text="string"))

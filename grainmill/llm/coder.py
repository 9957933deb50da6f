"""Token-id files coded by an adaptive context-mixing range coder.

Ids are cut into blocks of equal length that share nothing, so all blocks of a segment are coded side by side,
one array operation for all of them per step. In each block an order-2 and an order-1 table predict the next
id, with a confidence; what both miss is coded by an adaptive order-0 distribution over ranges of ranks: a
segment lists its frequent ids, most frequent first, and ids are coded as their place in that list. How much of
the code space each prediction gets is learnt for every combination of confidences, step by step; the order-0
distribution learns after every `PERIOD` steps. All numbers are integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf
from grainmill.llm.tokens import encoded, encoder

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Ids of a block, and of a segment (one row of the file) at least, unless it is the last of its partition.
BLOCK = 4096
SEGMENT = 1 << 23
MAGIC = b"MIXD"
#: Sizes of the order-1 and order-2 tables of a block, in bits.
BITS1, BITS2 = 11, 12
#: Code space of a step; the least of it that the order-0 model keeps.
SPACE, LEAST = 1 << 16, 2048
#: Learning speeds, as shifts: of the mixing weights and of the order-0 distribution.
RATE, RATE0 = 4, 5
#: Order-0 distribution: ranges of ranks, each a power of two wide, and the total of its weights.
RANGES, TOTAL_BITS = 19, 11
#: Steps after which the order-0 distribution learns what it coded in them.
PERIOD = 16
#: An id found so often in a segment has a rank; others are coded as themselves, after the ranks.
RANKED = 4

u32, u64 = np.uint32, np.uint64
#: Of the types of the arrays they meet, so that those stay as narrow.
_FULL, _ONE, _TWO, _THREE = np.int32(SPACE - 1), u32(1), u32(2), u32(3)
#: A coder whose width falls below this gives off, or takes in, a word of 16 bits.
_LEAST_WIDTH = u64(1 << 48)


#: Number of the range a rank is in: the bit length of what follows it, less one.
RANGE_OF = np.repeat(np.arange(RANGES), 1 << np.arange(RANGES))[: 1 << (RANGES - 1)].astype(np.intp)
#: First rank and bits of each range.
FIRST = ((1 << np.arange(RANGES)) - 1).astype(u32)
WIDE = np.arange(RANGES).astype(u64)
#: Next confidence by the one before, and by it plus 4 if the prediction was right.
NEXT = np.array([1, 1, 1, 2, 1, 2, 3, 3], u32)


class Model:
    """State of many blocks at one step."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.t1 = np.zeros(lanes << BITS1, u32)
        self.t2 = np.zeros(lanes << BITS2, u32)
        self.at = np.arange(lanes)
        self.w2 = np.full(lanes * 16, SPACE // 4, np.int32)
        self.w1 = np.full(lanes * 16, SPACE // 4, np.int32)
        self.states, self.rows1, self.rows2 = self.at << 4, self.at << BITS1, self.at << BITS2
        even = np.arange(RANGES + 1) * (1 << TOTAL_BITS) // RANGES
        self.cdf = np.repeat(even.astype(np.int32)[:, None], lanes, 1)
        self.seen, self.step = np.full((PERIOD, lanes), RANGES, np.int8), 0
        self.c1 = np.zeros(lanes, u32)
        self.c2 = np.zeros(lanes, u32)
        self.steps = np.arange(RANGES + 1, dtype=np.int32)[:, None]
        self.settle()

    def settle(self) -> None:
        """Starts of ranges in a space of 1 << TOTAL_BITS, where every range keeps at least 1."""
        self.starts = (((self.cdf * ((1 << TOTAL_BITS) - RANGES)) >> TOTAL_BITS) + self.steps).astype(np.int16)
        self.flat = self.starts.reshape(-1)

    def shrink(self, lanes: int) -> None:
        """From now on only the first `lanes` blocks go on."""
        self.lanes = lanes
        self.at, self.cdf = self.at[:lanes], np.ascontiguousarray(self.cdf[:, :lanes])
        self.seen = np.ascontiguousarray(self.seen[:, :lanes])
        self.settle()
        self.c1, self.c2 = self.c1[:lanes], self.c2[:lanes]
        self.states, self.rows1, self.rows2 = self.states[:lanes], self.rows1[:lanes], self.rows2[:lanes]

    def predict(self) -> None:
        """Sets p2, p1 (predicted ids) and f2, f1, f0 (their code space; 0 where there is no prediction)."""
        h1 = (self.c1 * u32(2654435761)) >> u32(32 - BITS1)
        h2 = ((self.c1 * u32(2246822519)) ^ (self.c2 * u32(3266489917))) * u32(668265263) >> u32(32 - BITS2)
        self.i1 = self.rows1 + h1
        self.i2 = self.rows2 + h2
        e1, e2 = self.t1[self.i1], self.t2[self.i2]
        self.k1, self.k2 = e1 & _THREE, e2 & _THREE
        self.p1, self.p2 = e1 >> _TWO, e2 >> _TWO
        told2 = self.k2 > 0
        told1 = (self.k1 > 0) & ~((self.p1 == self.p2) & told2)
        self.state = self.states + ((self.k2 << _TWO) + self.k1 * told1)
        self.a, self.b = self.w2[self.state], self.w1[self.state]
        room = SPACE - LEAST
        self.f2 = ((self.a * (room >> 4)) >> 12) * told2
        self.f1 = ((self.b * ((room - self.f2) >> 4)) >> 12) * told1
        self.f0 = SPACE - self.f2 - self.f1

    def bounds(self, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the given ranges start and end in the order-0 space, which is at least 1 << TOTAL_BITS."""
        at = ranges * self.lanes + self.at
        return (self.f0 * self.flat[at]) >> TOTAL_BITS, (self.f0 * self.flat[at + self.lanes]) >> TOTAL_BITS

    def ranges_at(self, places: np.ndarray) -> np.ndarray:
        """Ranges that hold places of the order-0 space."""
        last = ((((places + 1) << TOTAL_BITS) - 1) / self.f0).astype(np.int16)
        return (self.starts[1:-1] <= last).view(np.int8).sum(0, dtype=np.int8).astype(np.intp)

    def learn(self, ids: np.ndarray, ranges: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        # a weight of a state without that prediction is never read
        self.w2[self.state] = self.a + ((hit2 * _FULL - self.a) >> RATE)
        self.w1[self.state] = self.b + (((hit1 * _FULL - self.b) >> RATE) * ~hit2)
        for table, i, k, p in ((self.t1, self.i1, self.k1, self.p1), (self.t2, self.i2, self.k2, self.p2)):
            table[i] = (np.where(k > _ONE, p, ids) << _TWO) | NEXT[k + (p == ids) * u32(4)]
        self.seen[self.step] = np.where(hit2 | hit1, RANGES, ranges)
        self.step += 1
        if self.step == PERIOD:
            counts = np.array([(self.seen == r).view(np.int8).sum(0, dtype=np.int8) for r in range(RANGES)])
            sums = np.cumsum(counts, 0, dtype=np.int32)
            self.cdf[1:-1] += ((sums[:-1] << TOTAL_BITS) - sums[-1] * self.cdf[1:-1]) >> RATE0
            self.step = 0
            self.settle()
        self.c2, self.c1 = self.c1, ids


def compress(blocks: np.ndarray, last: int) -> list[bytes]:
    """`blocks`: one row of ids per block; the last row holds `last` ids. Returns the code of each."""
    lanes, length = blocks.shape
    model = Model(lanes)
    low, width = np.zeros(lanes, u64), np.full(lanes, (1 << 64) - 1, u64)
    stride = 2 * length + 8
    # words of 16 bits, and what is carried over into them
    out = np.zeros(lanes * stride, u32)
    at = np.arange(lanes) * stride
    columns = np.ascontiguousarray(blocks.T.astype(u32))

    for t in range(length):
        if t == last and last < length:
            if lanes == 1:
                break
            model.shrink(lanes - 1)
            low_last, at_last = low[-1], at[-1]
            low, width, at = low[:-1].copy(), width[:-1].copy(), at[:-1].copy()
        ids = columns[t, : model.lanes]
        ranges = RANGE_OF[ids]
        model.predict()
        hit2 = (ids == model.p2) & (model.f2 > 0)
        hit1 = (ids == model.p1) & (model.f1 > 0) & ~hit2
        base, place = model.f2 + model.f1, model.bounds(ranges)
        start = np.where(hit2, 0, np.where(hit1, model.f2, base + place[0])).astype(u64)
        end = np.where(hit2, model.f2, np.where(hit1, base, base + place[1])).astype(u64)
        miss = ~(hit2 | hit1)
        bits = WIDE[ranges * miss]
        offset = ((ids - FIRST[ranges]) * miss).astype(u64)
        part = width >> u64(16)
        width = (part * (end - start)) >> bits
        low += (added := part * start + width * offset)
        over = np.flatnonzero(low < added)
        out[at[over] - 1] += u32(1)
        move = np.flatnonzero(width < _LEAST_WIDTH)
        while len(move):
            l, w, to = low[move], width[move] << u64(16), at[move]
            out[to] = l >> u64(48)
            low[move], width[move], at[move] = l << u64(16), w, to + 1
            move = move[w < _LEAST_WIDTH]
        model.learn(ids, ranges, hit2, hit1)
    if last < length and lanes > 1:
        low, at = np.append(low, low_last), np.append(at, at_last)
    for shift in (48, 32, 16, 0):
        out[at] = (low >> u64(shift)) & u64(0xFFFF)
        at += 1
    while len(over := np.flatnonzero(out >> u32(16))):
        out[over] &= u32(0xFFFF)
        out[over - 1] += u32(1)
    return [out[i * stride : end].astype("<u2").tobytes() for i, end in enumerate(at.tolist())]


def expand(codes: list[bytes], length: int, last: int) -> np.ndarray:
    """Ids of blocks of `length` coded by `compress`, the last of `last`, one after the other."""
    lanes = len(codes)
    model = Model(lanes)
    longest = max(map(len, codes)) // 2
    words = np.zeros((lanes, longest + 8), "<u2")
    for i, code in enumerate(codes):
        words[i, : len(code) // 2] = np.frombuffer(code, "<u2")
    # `code` counts from the low end of the coder's width
    width, code = np.full(lanes, (1 << 64) - 1, u64), np.zeros(lanes, u64)
    for i in range(4):
        code = (code << u64(16)) | words[:, i]
    at = np.arange(lanes) * words.shape[1] + 4
    words = words.reshape(-1)
    out = np.zeros((length, lanes), u32)
    for t in range(length):
        if t == last and last < length:
            if lanes == 1:
                break
            model.shrink(lanes - 1)
            width, code, at = width[:-1].copy(), code[:-1].copy(), at[:-1].copy()
        model.predict()
        part = width >> u64(16)
        value = np.minimum(code // part, u64(SPACE - 1)).astype(np.int32)
        hit2 = value < model.f2
        base = model.f2 + model.f1
        hit1 = ~hit2 & (value < base)
        ranges = model.ranges_at(value - base)
        place = model.bounds(ranges)
        start = np.where(hit2, 0, np.where(hit1, model.f2, base + place[0])).astype(u64)
        end = np.where(hit2, model.f2, np.where(hit1, base, base + place[1])).astype(u64)
        hit = hit2 | hit1
        bits = WIDE[ranges * ~hit]
        code -= part * start
        width = (part * (end - start)) >> bits
        offset = np.minimum(code // width, (u64(1) << bits) - u64(1))
        offset[hit] = 0
        code -= width * offset
        ids = np.where(hit2, model.p2, np.where(hit1, model.p1, FIRST[ranges] + offset.astype(u32)))
        out[t, : model.lanes] = ids
        move = np.flatnonzero(width < _LEAST_WIDTH)
        while len(move):
            w, to = width[move] << u64(16), at[move]
            code[move] = (code[move] << u64(16)) | words[to]
            width[move], at[move] = w, to + 1
            move = move[w < _LEAST_WIDTH]
        model.learn(ids, ranges, hit2, hit1)
    flat = np.ascontiguousarray(out.T).reshape(-1)
    return flat[: (lanes - 1) * length + last]


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids that have a rank, in its order; the ids as ranks)."""
    counts = np.bincount(ids)
    listed = np.flatnonzero(counts >= RANKED)
    listed = listed[np.argsort(-counts[listed], kind="stable")]
    rank = np.arange(len(counts)) + len(listed)
    rank[listed] = np.arange(len(listed))
    return listed.astype("<u4"), rank[ids].astype(u32)


def to_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Header (magic; numbers of documents, blocks and ids; block length; number of ranked ids; ids and lengths
    of documents; size and checksum of every block; ranked ids), its checksum, and the blocks."""
    n = len(ids)
    listed, ids = _ranks(ids)
    lanes = max(1, -(-n // block))
    grid = np.zeros(lanes * block, u32)
    grid[:n] = ids
    codes = compress(grid.reshape(lanes, block), n - (lanes - 1) * block)
    head = MAGIC + struct.pack("<IIQII", len(doc_ids), lanes, n, block, len(listed))
    head += np.array([x is None for x in doc_ids], bool).tobytes()
    head += np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(counts, "<u4").tobytes()
    head += np.array([(len(x), zlib.crc32(x)) for x in codes], "<u4").tobytes() + listed.tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(codes)


def from_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a segment; ValueError if a checksum does not hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, lanes, n, block, ranked = struct.unpack_from("<IIQII", data, 4)
    at = 28
    none = np.frombuffer(data, bool, docs, at)
    doc_ids = np.frombuffer(data, "<i8", docs, at + docs)
    counts = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    blocks = np.frombuffer(data, "<u4", 2 * lanes, at + 13 * docs).reshape(-1, 2)
    at += 13 * docs + 8 * lanes
    listed = np.frombuffer(data, "<u4", ranked, at)
    at += 4 * ranked
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("damaged header of a token segment")
    at += 4
    codes = []
    for i, (size, check) in enumerate(blocks.tolist()):
        code = data[at : at + size]
        if zlib.crc32(code) != check:
            raise ValueError(f"damaged block {i} of a token segment")
        codes.append(code)
        at += size
    ranks = expand(codes, block, n - (lanes - 1) * block).astype(np.int64)
    ids = ranks - ranked
    common = ranks < ranked
    ids[common] = listed[ranks[common]]
    return [None if x else int(y) for x, y in zip(none, doc_ids)], counts, ids


FILE = "part int, segment int, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, spaced: bool = True, end: int = END) -> None:
    """Writes the token ids of all documents, each closed by the id `end`, in ascending order of doc_id.

    The file at `path` is a parquet table whose rows are segments (`to_segment`) in order of (part, segment); a
    document lies in one segment. Null or empty text: the end id alone. Null doc_ids come first. Rows that share
    a doc_id are ordered by their texts. Other columns are not read. Ids must be below 2 ** 17.
    """
    tokenizer = tokenizer or public_tokenizers.path(VOCABULARY)
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, segment = encoder(tokenizer, spaced), TaskContext.get().partitionId(), 0
        doc_ids, counts, held, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal segment, total
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [segment], [total], [to_segment(doc_ids, counts, ids)]]
            segment, total = segment + 1, 0
            for x in (doc_ids, counts, held):
                x.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["part", "segment", "n_tokens", "payload"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, found in encoded(batch.column(1), coder):
                for key, ids in zip(keys[at:], found):
                    doc_ids.append(key)
                    held.append(ids + tail)
                    counts.append(len(held[-1]) // 4)
                    total += counts[-1]
                    if total >= SEGMENT:
                        yield close()
        if total:
            yield close()

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit numbers)
    of every document of a file of `write_tokens`."""
    stored = spark.read.schema(FILE).parquet(path)
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored.select("part", "segment", "n_tokens")
    # One row per written partition, so their number is that of the writer's tasks, whatever the number of ids.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    inside = before(Window.partitionBy("part").orderBy("segment")).alias("inside")
    bases = sizes.select("part", "segment", inside).join(F.broadcast(parts), "part").selectExpr("part", "segment", "base + inside as base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, counts, ids = from_segment(row["payload"])
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4")
                starts = ends - counts
                for i in range(0, len(doc_ids), 256):
                    own = slice(i, i + 256)
                    m = len(doc_ids[own])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * m, pa.int32()),
                            pa.array([row["segment"]] * m, pa.int32()),
                            pa.array(doc_ids[own], pa.int64()),
                            pa.array(starts[own], pa.int64()),
                            pa.array(counts[own].astype(np.int64)),
                            pa.array([raw[a:b].tobytes() for a, b in zip(starts[own], ends[own])], pa.binary()),
                        ],
                        names=["part", "segment", "doc_id", "inside", "n_tokens", "ids"],
                    )

    kinds = "part int, segment int, doc_id long, inside long, n_tokens long, ids binary"
    found = stored.select("part", "segment", "payload").mapInArrow(run, kinds)
    # One row per segment: the decoded ids stay where they are.
    return found.join(F.broadcast(bases), ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids"
    )

"""Best-fit packing of tokenized documents into sequences of fixed length.

Each task packs the documents of its own partition as they come: no shuffle, no order to wait for. A fixed
number of bins is open. A bitset holds which amounts of free space occur among them, so the smallest bin that
is large enough is one shift and one lowest-bit search away. Where none is and all bins are taken, the fullest closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from grainmill.llm.tokens import encoded, encoder

SIZE = 2048
OPEN = 1024
END = 0
VOCABULARY = "word_bpe_49k.json"
#: Bits of a sequence number that count sequences inside a partition.
SEQUENCE_BITS = 40
ROW = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class Bins:
    """Open bins of one task."""

    def __init__(self, size: int, most: int, first: int = 0):
        self.size, self.most, self.next = size, most, first
        self.open = 0
        self.spaces = 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        found = bins.pop()
        if not bins:
            self.spaces ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to `size` tokens."""
        wide = self.spaces >> length
        if wide:
            space = length + (wide & -wide).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            bin_, space = self.next, self.size
            self.next += 1
        left = space - length
        if left:
            self.bins[left].append(bin_)
            self.spaces |= 1 << left
            self.open += 1
        return bin_, self.size - space


def pack(
    docs: DataFrame,
    path: str | None = None,
    spaced: bool = False,
    size: int = SIZE,
    most_open: int = OPEN,
    end: int = END,
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids (little-endian unsigned 32-bit
    numbers), sequence_id, offset. A document is its ids and the id `end`; only one of more than `size` ids is
    cut, into pieces of `size`, the last perhaps shorter. Pieces fill their sequence from offset 0 without gaps.

    `path` names the tokenizer file, at the same place on every machine. Null or empty text: the end id alone.
    Null or repeated doc_id: every row is a document. Other columns are not read. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, spaced)
        bins = Bins(size, most_open, TaskContext.get().partitionId() << SEQUENCE_BITS)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, found in encoded(batch.column(1), coder):
                rows: list[tuple] = []
                for key, ids in zip(keys[at:], found):
                    ids += tail
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, size)):
                        length = min(size, total - start)
                        rows.append((key, piece, start, length, ids[4 * start : 4 * (start + length)], *bins.place(length)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), types)],
                    names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, ROW)

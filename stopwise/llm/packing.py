"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Each piece goes where the squared counts of open bins per residual gap become smallest (Csirik et al., 2006). Packing
is per input partition and nothing is shuffled, so the number of sequences depends a little on how the input is cut. The
state is one count per gap and a number for each open bin (eight bytes), of which a partition has as many as it has
sequences that are not full. Pieces of a window are placed longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import encoder

#: Pieces placed together, longest first.
WINDOW = 50_000


class SumOfSquares:
    """Open bins by residual gap. ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        c, n = self.capacity, self.count
        if size < c:
            change = 2 * (n[: c - size] - n[size:c]) + 2
            change[0] = 1 - 2 * n[size]
            change[n[size:c] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] <= 2 * n[c - size] + 1:
                gap = size + best
                chosen = self.open[gap].pop()
                n[gap] -= 1
                if gap > size:
                    self.open[gap - size].append(chosen)
                    n[gap - size] += 1
                return chosen, c - gap
            self.open[c - size].append(self.bins)
            n[c - size] += 1
        self.bins += 1
        return self.bins - 1, 0


def pieces(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but perhaps the first."""
    first = n_tokens % capacity
    return ([(0, first)] if first else []) + [(k, capacity) for k in range(first, n_tokens, capacity)]


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Packs every row's whole text; one row per piece.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, ``with_ids``, the piece's ``ids`` and
    ``row_id``, which tells rows with one identifier apart.
    Only ``id_col`` and ``text_col`` are read, so other columns cannot clash. A null text counts as empty and gives one
    piece that holds the end id; a null or repeated id is carried as it is, each row being a document of its own. Ties
    between gaps go to the smallest gap. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encode = TaskContext.get().partitionId() << 40, encoder(tokenizer_path).encode
        bins, end = SumOfSquares(capacity), np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        row_id = own

        def placed() -> pa.RecordBatch:
            at: list[tuple[int, int]] = [(0, 0)] * len(rows)
            for k in sorted(range(len(rows)), key=lambda k: -rows[k][3]):
                at[k] = bins.place(rows[k][3])
            cols = [list(c) for c in zip(*rows, strict=True)]
            found = dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), cols, strict=False))
            found |= {"sequence_id": [own + b for b, _ in at], "offset": [o for _, o in at]}
            if with_ids:
                found |= {"ids": cols[5], "row_id": cols[6]}
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for key, raw in zip(ids, encode([t or "" for t in texts]), strict=True):
                    raw += end
                    row_id += 1
                    for k, (start, length) in enumerate(pieces(len(raw) // 4, capacity)):
                        own_ids = raw[4 * start : 4 * (start + length)]
                        row = (key, k, start, length, zlib.crc32(own_ids))
                        rows.append((*row, np.frombuffer(own_ids, "<i4"), row_id) if with_ids else row)
                if len(rows) >= WINDOW:
                    yield placed()
        if rows:
            yield placed()

    kinds = [("doc_id", docs.schema[id_col].dataType, pa.int64()), ("piece", T.IntegerType(), pa.int32())]
    kinds += [(c, T.LongType(), pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    if with_ids:
        kinds += [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("row_id", T.LongType(), pa.int64())]
    arrow = pa.schema([pa.field(name, kind) for name, _, kind in kinds])
    schema = T.StructType([T.StructField(name, kind) for name, kind, _ in kinds])
    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, schema)

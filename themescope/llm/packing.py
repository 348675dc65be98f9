"""Token ids packed into rows of fixed length, best fit decreasing.

Texts are encoded by the tiktoken library with a public rank file. A document longer than a
row is cut into pieces that fill whole rows and a last shorter one; no token is lost or
added. Pieces go, longest first, to the row whose free space fits most tightly. Rows by free
space are found in a segment tree over capacities: which of the capacities from n up is the
least that some row has.

Packing works on buffers of ``BUFFER`` tokens in each task: memory is bounded, texts and ids
are never shuffled, and the loss against one global packing is at most one loosely filled
set of rows a buffer. Each packed row has its ids as little-endian uint16 (uint32 where the
vocabulary has more than 65,535 tokens), ``ROW`` long and padded with the first id that is no
token, the cumulative segment lengths, and where positions go back to 0.

Defined results: null and empty texts have no tokens and stand in no row; repeated rows are
packed again; null ids stay null in ``doc_ids``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themescope.llm.bpe import read_ranks
from themescope.llm.common import raw_texts, slices

ROW = 2048
BUFFER = 4_000_000


class Capacities:
    """Rows by free space, and a segment tree that tells which capacities are there."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = capacity + self.size
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the tightest row with ``least`` free places."""
        tree, node = self.tree, least + self.size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        while node:
            tree[node] -= 1
            node >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit(sizes: list[int], row: int) -> list[list[int]]:
    """Piece numbers of each row."""
    out: list[list[int]] = []
    free = Capacities(row)
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[piece]
        found = free.take(n)
        if found is None:
            found = (row, len(out))
            out.append([])
        out[found[1]].append(piece)
        free.add(found[0] - n, found[1])
    return out


SCHEMA = (
    "row_sha256 string, n_tokens int, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, "
    "resets array<int>, ids binary"
)


def _rows(pieces: list[tuple], row: int, pad: int, kind: str):
    """Columns of packed rows; a piece is (doc_id, start, ids)."""
    columns: list[list] = [[] for _ in range(7)]
    for members in best_fit([len(p[2]) for p in pieces], row):
        matrix = np.full(row, pad, kind)
        edges = np.cumsum([0] + [len(pieces[i][2]) for i in members])
        for i, a in zip(members, edges.tolist(), strict=False):
            matrix[a : a + len(pieces[i][2])] = pieces[i][2]
        ids = matrix.tobytes()
        resets = edges[:-1].tolist() + ([int(edges[-1])] if edges[-1] < row else [])
        values = (
            hashlib.sha256(ids).hexdigest(), int(edges[-1]), [pieces[i][0] for i in members],
            [pieces[i][1] for i in members], edges.tolist(), resets, ids,
        )
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    return columns


def pack(docs: DataFrame, path: str, pattern: str, row: int = ROW, buffer: int = BUFFER) -> DataFrame:
    """Packed rows of ``(doc_id, text)``, see SCHEMA.

    starts: where in its document's ids a piece begins; cu_seqlens: 0 and the end of each
    piece; resets: places where positions start again at 0 (pieces, and the padding).
    """
    ranks = read_ranks(path)
    kept, pad = docs.sparkSession.sparkContext.broadcast(ranks), len(ranks)
    width = "<u2" if pad < 1 << 16 else "<u4"

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(kept.value)}, special_tokens={}
        )
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.binary()]

        def packed(pieces):
            columns = _rows(pieces, row, pad, width)
            for a in range(0, len(columns[0]), 512):
                arrays = [pa.array(c[a : a + 512], k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        pieces, held = [], 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), raw_texts(part.column(1)), strict=True):
                    ids = encoding.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=()).astype(width)
                    pieces += [(doc_id, a, ids[a : a + row]) for a in range(0, len(ids), row)]
                    held += len(ids)
                    if held >= buffer:
                        yield from packed(pieces)
                        pieces, held = [], 0
        yield from packed(pieces)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices and their lengths as Parquet in a folder that all executors share."""
    packed.write.parquet(path)

"""Packing documents into sequences by the sum-of-squares rule.

Documents are encoded and cut where their text is read; only the pieces' numbers move. Pieces are
dealt by the numbers of their written rows, so also equal ones, to groups of bounded size, and each group is packed alone, longest piece first:
a piece goes where the squared numbers of open sequences per remaining gap sum to least. Groups
of ``GROUP_TOKENS`` ids leave about 0.2 % of the room empty, whatever the number of groups.

Edge cases: a null text is empty and gives one piece that holds the end id; rows that share an id
are packed each for itself; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import ROW, byte_slices, byte_strings, numbered, pieces_for, texts
from flipside.llm.word_encoder import little_endian, word_encoder

CAPACITY = 2048
GROUP_TOKENS = 1 << 25
GROUP_PIECES = 1 << 17

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id bigint, offset bigint"


def piece_cutter(tokenizer: str, end_id: int, capacity: int):
    end = little_endian([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in (piece for batch in batches for piece in byte_slices(batch, "text")):
            doc_ids, numbers, starts, lengths, checks = [], [], [], [], []
            encoded = encoder.encode_all(byte_strings(batch.column("text")))
            for doc_id, text_ids in zip(batch.column("id").to_pylist(), encoded, strict=True):
                ids = memoryview(text_ids + end)
                for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[start : start + 4 * capacity]
                    doc_ids.append(doc_id)
                    numbers.append(number)
                    starts.append(start // 4)
                    lengths.append(len(piece) // 4)
                    checks.append(zlib.crc32(piece))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(checks, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece, placed in the order given.

    ``open_at[g]`` is the number of open sequences with gap ``g``. Filling a gap ``g`` by a piece
    of length ``s`` changes the sum of squares by ``2 (open_at[g - s] - open_at[g]) + 2``, closing
    it (``g = s``) by ``1 - 2 open_at[g]``, and a new sequence by ``2 open_at[capacity - s] + 1``.
    Ties go to the smallest gap that remains, and to open sequences.
    """
    open_at = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.int64(1) << 60
    sequences, offsets, used = [], [], 0
    for length in lengths:
        best = never
        if length < capacity:
            gaps = open_at[length:capacity]
            change = 2 * (open_at[: capacity - length] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = never
            left = int(change.argmin())
            best = change[left]
        fresh = 2 * open_at[capacity - length] + 1 if length < capacity else 0
        if best < never and best <= fresh:
            gap = length + left
            sequence = stacks[gap].pop()
            open_at[gap] -= 1
        else:
            sequence, gap, used = used, capacity, used + 1
        sequences.append(sequence)
        offsets.append(capacity - gap)
        rest = gap - length
        if rest:
            stacks[rest].append(sequence)
            open_at[rest] += 1
    return sequences, offsets


def group_packer(capacity: int):
    def pack(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        pieces = pieces.select(["doc_id", "piece", "start", "length", "ids_crc32"]).sort_by(order)
        sequences, offsets = sum_of_squares(pieces.column("length").to_pylist(), capacity)
        first = key[0].as_py() << 32
        return pieces.append_column("sequence_id", pa.array([first + number for number in sequences], pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64())
        )

    return pack


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and where in which sequence."""
    rows = texts(documents, id_column, text_column)
    pieces = numbered(rows.mapInArrow(piece_cutter(tokenizer, end_id, capacity), PIECE_SCHEMA), "pieces")
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(pieces_for(tokens, GROUP_TOKENS), pieces_for(n, GROUP_PIECES))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(ROW), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(group_packer(capacity), PACKED_SCHEMA)

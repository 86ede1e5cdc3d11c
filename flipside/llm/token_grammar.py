"""Token ids in grammar-compressed shards (Re-Pair) with random-access decoding.

Documents are dealt to tasks by ranges of their id; each task encodes its documents in ascending
order and closes a shard whenever it holds ``shard_tokens`` ids. A shard is one self-contained
binary file image: rules, their expansion lengths, the compressed sequence and a document index.
Shards are written by Spark as rows ``(part, shard, first_id, last_id, n_docs, n_tokens, payload)``,
so that a lost executor leaves no half-written file and a reader finds the shards of an id range
by the columns.

Edge cases: a null text is empty and holds only the end id; null ids come first and stay null;
rows that share an id are ordered by the first 64 characters of their text, then in any order, and
lie in as many ranges as they need; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flipside.llm.common import byte_slices, byte_strings, pieces_for, texts, total_bytes
from flipside.llm.word_encoder import little_endian, word_encoder

MAGIC = b"FRP1"
HEADER = struct.Struct("<4s5Q")
SHARD_TOKENS = 1 << 20
# A rule takes the room of three symbols, and each use of it saves one: three uses break even.
MIN_COUNT = 3
# Down to this count pairs are counted in tables, over the whole sequence.
TABLE_COUNT = 256
RANGE_BYTES = 32 << 20
# Text encoded at once: the more, the more of its words are the same.
ENCODED_BYTES = 8 << 20
# Pairs looked at per pass, most frequent first.
PASS_PAIRS = 4096

SHARD_SCHEMA = (
    "part int, shard int, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, payload binary"
)


class Pairs:
    """The adjacent pairs of a sequence, coded by the ranks of its frequent symbols.

    There are few frequent symbols, so that their pairs are usually counted and looked up in a
    table; all rare symbols share the last rank.
    """

    def __init__(self, symbols: np.ndarray, size: int, min_count: int):
        self.names = np.flatnonzero(np.bincount(symbols, minlength=size) >= min_count)
        self.width = len(self.names) + 1
        rank = np.full(size, len(self.names))
        rank[self.names] = np.arange(len(self.names))
        ranks = rank[symbols]
        self.codes = ranks[:-1] * self.width + ranks[1:]
        self.dense = self.width**2 <= 4 * len(symbols)

    def frequent(self, min_count: int) -> list[int]:
        """The most frequent pairs of symbols, at most ``PASS_PAIRS``, ties by symbol numbers."""
        if self.dense:
            counts = np.bincount(self.codes, minlength=self.width**2)
            found = np.flatnonzero(counts >= min_count)
            counts = counts[found]
        else:
            found, counts = np.unique(self.codes, return_counts=True)
        first, second = found // self.width, found % self.width
        kept = (counts >= min_count) & (first < len(self.names)) & (second < len(self.names))
        pairs = (self.names[first[kept]] << 32) | self.names[second[kept]]
        return pairs[np.lexsort((pairs, -counts[kept]))[:PASS_PAIRS]].tolist()

    def numbers(self, chosen: np.ndarray) -> np.ndarray:
        """For each place the number of the chosen pair that begins there, or -1."""
        first, second = (np.searchsorted(self.names, part) for part in (chosen >> 32, chosen & 0xFFFFFFFF))
        codes = first * self.width + second
        if self.dense:
            table = np.full(self.width**2, -1, np.int32)
            table[codes] = np.arange(len(codes))
            return table[self.codes]
        order = np.argsort(codes)
        place = np.minimum(np.searchsorted(codes[order], self.codes), len(codes) - 1)
        return np.where(codes[order][place] == self.codes, order[place], -1)


def compatible(ranked: list[int]) -> list[int]:
    """Pairs that can be replaced in one pass: no symbol ends one and begins another.

    Occurrences of such pairs cannot overlap, but for those of one pair of equal symbols.
    """
    left: set[int] = set()
    right: set[int] = set()
    chosen = []
    for pair in ranked:
        first, second = pair >> 32, pair & 0xFFFFFFFF
        if first not in right and second not in left and (first != second or first not in left and first not in right):
            left.add(first)
            right.add(second)
            chosen.append(pair)
    return chosen


def disjoint(where: np.ndarray) -> np.ndarray:
    """Of the places of a pair of equal symbols, every other one of each run."""
    new_run = np.concatenate(([True], np.diff(where) > 1))
    run_start = where[np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))]
    return where[(where - run_start) % 2 == 0]


def replaceable(chosen: np.ndarray, where: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The places ``where`` pairs numbered ``numbers`` begin, without overlaps."""
    equal = ((chosen >> 32) == (chosen & 0xFFFFFFFF))[numbers]
    return np.sort(np.concatenate((where[~equal], disjoint(where[equal])))) if equal.any() else where


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the number of each place's value among them, and their counts.

    A value and its place are sorted as one number wherever both fit into it, which is much faster
    than sorting places by their values.
    """
    bits = len(values).bit_length()
    if not len(values) or int(values.max()) >> (63 - bits):
        return np.unique(values, return_inverse=True, return_counts=True)
    ordered = (values << bits) | np.arange(len(values))
    ordered.sort()
    places = ordered & ((1 << bits) - 1)
    ordered >>= bits
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    starts = np.flatnonzero(fresh)
    numbers = np.empty(len(values), np.int64)
    numbers[places] = np.cumsum(fresh) - 1
    return ordered[starts], numbers, np.diff(np.append(starts, len(values)))


def replace_rare(symbols: np.ndarray, size: int, min_count: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Replace pairs until none occurs ``min_count`` times, looking only at what can still change.

    A border between two symbols whose pair is rarer is never replaced, nor is any pair that later
    comes to lie there, since it occurs at most as often. Symbols between two such borders are done.
    """
    symbols, kept, rules = symbols.copy(), np.ones(len(symbols), bool), []
    at = np.arange(len(symbols))
    # Whether the symbol and the next one may still become a pair.
    joined = np.arange(len(symbols)) < len(symbols) - 1
    while True:
        where = np.flatnonzero(joined)
        held = symbols[at]
        width = size.bit_length()
        pairs, codes, counts = counted((held[where] << width) | held[where + 1])
        pairs = ((pairs >> width) << 32) | (pairs & ((1 << width) - 1))
        live = counts >= min_count
        if not live.any():
            return rules, symbols[kept]
        ranked = np.flatnonzero(live)
        ranked = ranked[np.lexsort((pairs[ranked], -counts[ranked]))]
        chosen = np.array(compatible(pairs[ranked].tolist()), np.int64)
        table = np.full(len(pairs), -1)
        table[np.searchsorted(pairs, chosen)] = np.arange(len(chosen))
        numbers = np.full(len(at), -1)
        numbers[where] = table[codes]
        joined[where] = live[codes]
        places = np.flatnonzero(numbers >= 0)
        places = replaceable(chosen, places, numbers[places])
        symbols[at[places]] = size + numbers[places]
        kept[at[places + 1]] = False
        joined[places] = joined[places + 1]
        stays = joined.copy()
        stays[1:] |= joined[:-1]
        stays[places + 1] = False
        at, joined = at[stays], joined[stays]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1).astype(np.uint32))
        size += len(chosen)


def build_grammar(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray]:
    """Replace frequent pairs until none occurs ``min_count`` times.

    Returns the first nonterminal, the rules as an array of symbol pairs (rule ``i`` makes symbol
    ``base + i`` and uses only smaller symbols), and the sequence left over.
    """
    symbols = ids.astype(np.int64)
    base = int(symbols.max()) + 1 if len(symbols) else 0
    size, rules = base, []
    first_count = max(min_count, TABLE_COUNT)
    while len(symbols) > 1:
        pairs = Pairs(symbols, size, first_count)
        ranked = pairs.frequent(first_count)
        if not ranked:
            break
        chosen = np.array(compatible(ranked), np.int64)
        numbers = pairs.numbers(chosen)
        where = np.flatnonzero(numbers >= 0)
        where = replaceable(chosen, where, numbers[where])
        symbols[where] = size + numbers[where]
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        symbols = symbols[keep]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1).astype(np.uint32))
        size += len(chosen)
    if min_count < first_count and len(symbols) > 1:
        more, symbols = replace_rare(symbols, size, min_count)
        rules += more
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), symbols.astype(np.uint32)


def passes(base: int, rules: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive slices of the rules that use no symbol made in their own slice."""
    newest = rules.max(1).astype(np.int64) - base if len(rules) else np.zeros(0, np.int64)
    start = 0
    while start < len(newest):
        later = newest[start:] >= start
        stop = start + int(later.argmax()) if later.any() else len(newest)
        yield start, stop
        start = stop


def rule_spans(base: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule expands to."""
    spans = np.ones(base + len(rules), np.uint32)
    for start, stop in passes(base, rules):
        spans[base + start : base + stop] = spans[rules[start:stop]].sum(1, dtype=np.uint32)
    return spans[base:]


def pack_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], min_count: int) -> bytes:
    base, rules, symbols = build_grammar(ids, min_count)
    missing = np.array([doc_id is None for doc_id in doc_ids], np.uint8)
    return b"".join(
        [
            HEADER.pack(MAGIC, base, len(rules), len(symbols), len(doc_ids), len(ids)),
            rules.astype("<u4").tobytes(),
            rule_spans(base, rules).astype("<u4").tobytes(),
            symbols.astype("<u4").tobytes(),
            np.array([doc_id or 0 for doc_id in doc_ids], "<i8").tobytes(),
            missing.tobytes(),
            lengths.astype("<i8").tobytes(),
        ]
    )


class Shard:
    """An index over one shard file; ``ids`` expands any range of it, and of the rules only what
    lies in that range. ``expanded`` counts the rules followed so far."""

    def __init__(self, payload: bytes):
        magic, self.base, n_rules, n_symbols, n_docs, self.n_tokens = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(payload, kind, count, at)
            at += values.nbytes
            return values

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        spans = take("<u4", n_rules)
        self.symbols = take("<u4", n_symbols)
        numbers = take("<i8", n_docs)
        missing = take("u1", n_docs)
        self.doc_ids = [None if gone else number for number, gone in zip(numbers.tolist(), missing.tolist(), strict=True)]
        self.doc_starts = np.concatenate(([0], np.cumsum(take("<i8", n_docs))))
        self.lengths = np.concatenate((np.ones(self.base, np.int64), spans.astype(np.int64)))
        self.firsts, self.seconds = self.rules.T.copy()
        self.ends = np.cumsum(self.lengths[self.symbols])
        self.expanded = 0

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of the shard."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, stop, "left")) + 1
        symbols = self.symbols[first:last]
        places = self.ends[first:last] - self.lengths[symbols]
        found = np.empty(stop - start, np.uint32)
        # Whether a symbol reaches over an end of the range.
        cut = bool(((places < start) | (places + self.lengths[symbols] > stop)).any())
        while len(symbols):
            if cut:
                inside = (places < stop) & (places + self.lengths[symbols] > start)
                if not inside.all():
                    symbols, places = symbols[inside], places[inside]
            ready = symbols < self.base
            found[places[ready] - start] = symbols[ready]
            rest = np.flatnonzero(~ready)
            rules, places = symbols[rest] - self.base, places[rest]
            self.expanded += len(rules)
            symbols = np.concatenate((self.firsts[rules], self.seconds[rules]))
            places = np.concatenate((places, places + self.lengths[symbols[: len(rules)]]))
        return found


def shard_writer(tokenizer: str, end_id: int, shard_tokens: int, min_count: int):
    end = little_endian([end_id])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        n_tokens = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.array([len(encoded) // 4 for encoded in held], np.int64)
            known = [doc_id for doc_id in doc_ids if doc_id is not None]
            row = {
                "part": part,
                "shard": shard,
                "first_id": min(known, default=None),
                "last_id": max(known, default=None),
                "n_docs": len(doc_ids),
                "n_tokens": len(ids),
                "payload": pack_shard(ids, lengths, doc_ids, min_count),
            }
            return pa.RecordBatch.from_pylist([row], SHARD_ARROW)

        for piece in (piece for batch in batches for piece in byte_slices(batch, "text", ENCODED_BYTES)):
            encoded = encoder.encode_all(byte_strings(piece.column("text")))
            for doc_id, ids in zip(piece.column("id").to_pylist(), encoded, strict=True):
                held.append(ids + end)
                doc_ids.append(doc_id)
                n_tokens += len(held[-1]) // 4
                if n_tokens >= shard_tokens:
                    yield close()
                    held, doc_ids, n_tokens, shard = [], [], 0, shard + 1
        if doc_ids:
            yield close()

    return write


SHARD_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("first_id", pa.int64()),
        ("last_id", pa.int64()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def write_token_shards(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_tokens: int = SHARD_TOKENS,
    min_count: int = MIN_COUNT,
) -> None:
    """Encode all documents and write them in ascending order of their id below ``path``.

    Ranges are cut by the id, the head of the text and a hash of the row, so that rows of one id,
    copies among them, need not lie in one range.
    """
    rows = texts(documents, id_column, text_column)
    ranges = pieces_for(total_bytes(rows), RANGE_BYTES)
    (
        rows.withColumn("head", F.substring("text", 1, 64))
        .withColumn("tie", F.xxhash64("text", F.monotonically_increasing_id()))
        .repartitionByRange(ranges, "id", "head", "tie")
        .sortWithinPartitions("id", "head", "tie")
        .mapInArrow(shard_writer(tokenizer, end_id, shard_tokens, min_count), SHARD_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode each shard and give every document's place, length and checksum."""
    for batch in batches:
        for part, shard, payload in zip(*(batch.column(name).to_pylist() for name in ("part", "shard", "payload")), strict=True):
            reader = Shard(payload)
            ids = memoryview(reader.ids(0, reader.n_tokens).astype("<u4").tobytes())
            starts = reader.doc_starts
            n_docs = len(reader.doc_ids)
            spans = zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n_docs, pa.int32()),
                    pa.array([shard] * n_docs, pa.int32()),
                    pa.array(reader.doc_ids, pa.int64()),
                    pa.array(starts[:-1], pa.int64()),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([zlib.crc32(ids[4 * start : 4 * stop]) for start, stop in spans], pa.int64()),
                ],
                names=["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"],
            )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before: those of earlier parts, of earlier shards of
    the part, and of earlier documents of the shard.
    """
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    before_shard = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = (
        files.select("part", "shard", "n_tokens")
        .withColumn("before_shard", before_shard)
        .join(parts.select("part", before_part.alias("before_part")), "part")
        .select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("before"))
    )
    decoded = files.select("part", "shard", "payload").mapInArrow(
        read_documents, "part int, shard int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return decoded.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )

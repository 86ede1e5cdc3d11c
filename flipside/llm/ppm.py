"""Language-model scoring by prediction by partial matching over bytes.

Texts are lower-cased (A-Z) and split into words; the byte stream of a text is its words joined by
single spaces and one end byte, preceded by ``ORDER`` end bytes. The trie holds, for every context
of ``ORDER`` bytes of the training texts, how often each byte follows, and for every shorter context
in how many contexts one byte longer it does (update exclusion). A byte is predicted in
the longest known context; if it never followed there, the model escapes to the next shorter one,
where all bytes of the longer context are excluded. Escapes are estimated by method D: with ``n``
occurrences of the byte, ``t`` of all and ``q`` distinct bytes left, a byte has probability
``(2 n - 1) / 2 t`` and the escape ``q / 2 t``. Below order 0 the bytes never seen are equally likely.
The probabilities of all bytes in a context add up to 1.

What a text needs of the model depends only on its distinct sequences of ``ORDER + 1`` bytes (grams).
Documents are taken in blocks of bounded size: the pieces that files are read in, cut further by a
hash of the id. Each block lists its grams and words with training counts as it is read. Grams are
dealt to buckets by the last two bytes of their context, and a block's grams of one bucket are one row,
sorted and packed. The trie is built in partitions of whole buckets, which add the lists up and answer
each with the code lengths of its grams; so a block's texts meet those of the block's own grams. Only
the contexts of one byte and none, at most 65,792 counts, go through the driver.

Edge cases: a null or empty text is its end alone; a null id is the empty text to the fold; rows that
share an id are scored each for itself and all learned from; without training rows every byte
has probability 1/256; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import byte_slices, byte_strings, lean, lean_group, pieces_for, texts
from flipside.session import materialize

ORDER = 5
END = 10
BLOCK_BYTES = 32 << 20
# Bytes of text whose words, and positions whose grams, are in memory at once.
SLICE_BYTES = 1 << 20
WINDOW = 1 << 20
# Windows whose distinct grams are kept apart before they are added up.
WINDOWS_APART = 16
# Bytes of text per trie partition, and buckets per partition, as long as they are no more than MOST_BUCKETS.
TRIE_BYTES = 32 << 20
BUCKETS, MOST_BUCKETS = 16, 4096
# Listed grams that wait in a trie partition until they are added up.
MERGE_GRAMS = 2 << 20

BYTE = np.uint64(8)
COUNTS_SCHEMA = "kind string, block bigint, bucket int, size int, grams binary, counts binary, triple bigint, word binary, n bigint"
ANSWERS_SCHEMA = "block bigint, size int, grams binary, lengths binary"
SCORES_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; ``split`` and ``lower`` of bytes know ASCII only."""
    return text.lower().split()


class Stream:
    """The byte streams of several texts, each behind its padding, and their grams."""

    def __init__(self, word_lists: list[list[bytes]]):
        padding, end = bytes([END]) * ORDER, bytes([END])
        streams = [b" ".join(words) + end for words in word_lists]
        self.bytes = np.frombuffer(b"".join([part for stream in streams for part in (padding, stream)]), np.uint8)
        self.sizes = np.array([len(stream) for stream in streams], np.int64)
        self.ends = np.cumsum(self.sizes + ORDER)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Grams of up to ``WINDOW`` positions and the number of the text each belongs to."""
        for start in range(ORDER, len(self.bytes), WINDOW):
            stop = min(start + WINDOW, len(self.bytes))
            grams = np.zeros(stop - start, np.uint64)
            for back in range(ORDER, -1, -1):
                grams <<= BYTE
                grams |= self.bytes[start - back : stop - back]
            first = int(np.searchsorted(self.ends, start, "right"))
            last = int(np.searchsorted(self.ends, stop - 1, "right"))
            bounds = np.clip(self.ends[first : last + 1], start, stop) - start
            owner = np.repeat(np.arange(first, last + 1), np.diff(np.concatenate(([0], bounds))))
            places = np.arange(start, stop) - (self.ends - self.sizes)[owner]
            inside = places >= 0
            yield grams[inside].astype(np.int64), owner[inside]


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def turned(grams: np.ndarray) -> np.ndarray:
    """Grams with the last two bytes of the context in front, so that those of a bucket sort together."""
    return ((grams >> 8 & 0xFFFF) << 32) | (grams >> 24 << 8) | (grams & 0xFF)


def turned_back(keys: np.ndarray) -> np.ndarray:
    return ((keys >> 8 & 0xFFFFFF) << 24) | (keys >> 32 << 8) | (keys & 0xFF)


def bucket_numbers(buckets: int) -> np.ndarray:
    """The bucket of each pair of last context bytes."""
    pairs = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((pairs >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the bytes of equal weight next to each other."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd"), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpacked(data, np.int64, size))


class BlockCounts:
    """Distinct grams and words of a block with their counts in its training rows; the word of no
    bytes stands for the end. Grams are held turned."""

    def __init__(self):
        self.grams, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.apart: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter[bytes] = Counter()

    def add(self, lists: list[list[bytes]], training: np.ndarray) -> None:
        for own, learned in zip(lists, training.tolist(), strict=True):
            if learned:
                self.words.update(own)
                self.words[b""] += 1
            else:
                self.words.update(dict.fromkeys([*own, b""], 0))
        for grams, owner in Stream(lists).windows():
            learned = training[owner]
            for chosen, weight in ((grams[learned], 1), (grams[~learned], 0)):
                found, n = np.unique(turned(chosen), return_counts=True)
                self.apart.append((found, n * weight))
            if len(self.apart) >= 2 * WINDOWS_APART:
                self.merge()

    def merge(self) -> None:
        keys, counts = zip((self.grams, self.counts), *self.apart, strict=True)
        self.grams, self.counts = add_up(np.concatenate(keys), np.concatenate(counts))
        self.apart = []

    def rows(self, block: int, bucket_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.merge()
        buckets = bucket_of[self.grams >> 32]
        order = np.argsort(buckets, kind="stable")
        numbers, starts = np.unique(buckets[order], return_index=True)
        slices = [order[start:stop] for start, stop in zip(starts, np.append(starts[1:], len(order)), strict=True)]
        learned = turned_back(self.grams[self.counts > 0])
        triples, n_words = add_up(learned & 0xFFFFFF, learned)[0], len(self.words)
        for kind, size, columns in (
            (
                "gram",
                len(slices),
                {
                    "bucket": numbers.astype(np.int32),
                    "size": [len(own) for own in slices],
                    "grams": [packed_keys(self.grams[own]) for own in slices],
                    "counts": [packed(self.counts[own]) for own in slices],
                },
            ),
            ("triple", len(triples), {"triple": triples}),
            ("word", n_words, {"word": list(self.words), "n": list(self.words.values())}),
        ):
            columns |= {"kind": pa.DictionaryArray.from_arrays(np.zeros(size, np.int8), [kind]).cast(pa.string()), "block": np.full(size, block)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[field.name], field.type) if field.name in columns else pa.nulls(size, field.type) for field in COUNTS_ARROW],
                schema=COUNTS_ARROW,
            )


COUNTS_ARROW = pa.schema(
    [
        ("kind", pa.string()),
        ("block", pa.int64()),
        ("bucket", pa.int32()),
        ("size", pa.int32()),
        ("grams", pa.binary()),
        ("counts", pa.binary()),
        ("triple", pa.int64()),
        ("word", pa.binary()),
        ("n", pa.int64()),
    ]
)


def count_blocks(buckets: int):
    """Lists the counts of each block as it is read; a block read in parts is listed in parts."""
    bucket_of = bucket_numbers(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, BlockCounts] = {}
        piece_of: int | None = None
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                pieces, blocks = (part.column(name).to_numpy() for name in ("piece", "block"))
                training = part.column("training").to_numpy(zero_copy_only=False)
                lists = [words_of(text) for text in byte_strings(part.column("text"))]
                for piece in dict.fromkeys(pieces.tolist()):
                    if piece != piece_of:  # the blocks of the piece before are complete
                        for block, counts in open_blocks.items():
                            yield from counts.rows(block, bucket_of)
                        open_blocks, piece_of = {}, piece
                    for block in np.unique(blocks[pieces == piece]).tolist():
                        own = np.flatnonzero((pieces == piece) & (blocks == block))
                        open_blocks.setdefault(block, BlockCounts()).add([lists[place] for place in own], training[own])
        for block, counts in open_blocks.items():
            yield from counts.rows(block, bucket_of)

    return count


class Level:
    """Symbol counts of the contexts of one order: entries by gram, statistics by context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        contexts = grams >> 8
        starts = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(grams) else np.zeros(0, np.int64)
        self.starts, self.contexts = starts, contexts[starts]
        self.totals = np.add.reduceat(counts, starts) if len(grams) else counts
        self.distinct = np.diff(np.append(starts, len(grams)))
        self.excluded = np.zeros(len(starts), np.int64)

    def exclude_from(self, lower: Level, order: int) -> None:
        """How many occurrences the next lower context loses to the bytes seen here."""
        shorter = lower.count(self.grams & ((1 << (8 * order)) - 1))
        if len(self.grams):
            self.excluded = np.add.reduceat(shorter, self.starts)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(wanted), np.int64) for _ in values]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[place] == wanted
        return [np.where(known, own[place], 0) for own in values]

    def count(self, grams: np.ndarray) -> np.ndarray:
        return self.find(self.grams, grams, self.counts)[0]

    def statistics(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, distinct bytes and exclusions of each context, 0 where it is unknown."""
        return tuple(self.find(self.contexts, contexts, self.totals, self.distinct, self.excluded))


def code_lengths(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each gram behind the others."""
    result = np.zeros(len(grams))
    done = np.zeros(len(grams), bool)
    seen, lost = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for order in range(len(levels) - 1, -1, -1):
        level, shorter = levels[order], grams & ((1 << (8 * (order + 1))) - 1)
        n = level.count(shorter)
        total, distinct, excluded = level.statistics(shorter >> 8)
        left, new = total - lost, distinct - seen
        open_here = ~done & (new > 0)
        hit, missed = open_here & (n > 0), open_here & (n == 0)
        result[hit] += np.log10((2 * n[hit] - 1) / (2 * left[hit]))
        result[missed] += np.log10(new[missed] / (2 * left[missed]))
        done |= hit
        seen, lost = distinct, excluded
    result[~done] -= np.log10(256 - seen[~done])
    return result


def low_levels(triples: DataFrame) -> list[Level]:
    """Orders 0 and 1, of at most 256 and 65,536 entries."""
    last_two = F.col("triple").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    pairs = triples.select("triple").distinct().groupBy(last_two).agg(F.count("*").alias("n")).toPandas()
    grams, n = add_up(pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64))
    singles = Level(*add_up(grams & 0xFF, np.ones(len(grams), np.int64)))
    doubles = Level(grams, n)
    doubles.exclude_from(singles, 1)
    return [singles, doubles]


def trie_partition(low: list[Level]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[tuple[int, int, bytes]] = []
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        apart, waiting = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = [(keys, n), *apart]
            return add_up(np.concatenate([part[0] for part in every]), np.concatenate([part[1] for part in every]))

        for batch in batches:
            for block, size, grams, counts in zip(*(batch.column(name).to_pylist() for name in ("block", "size", "grams", "counts")), strict=True):
                lists.append((block, size, grams))
                apart.append((unpacked_keys(grams, size), unpacked(counts, np.int64, size)))
                waiting += size
                if waiting >= MERGE_GRAMS + len(keys):
                    keys, n = merged()
                    apart, waiting = [], 0
        if not lists:
            return
        keys, n = merged()
        del apart
        grams = turned_back(keys)
        levels: list[Level] = []
        entries = (grams[n > 0], n[n > 0])
        for order in range(ORDER, 1, -1):
            levels.insert(0, Level(*add_up(entries[0] & ((1 << (8 * (order + 1))) - 1), entries[1])))
            entries = levels[0].grams, np.ones(len(levels[0].grams), np.int64)
        levels = low + levels
        for order in range(2, ORDER + 1):
            levels[order].exclude_from(levels[order - 1], order)
        step = 1 << 18
        parts = [code_lengths(grams[start : start + step], levels).astype(np.float32) for start in range(0, len(grams), step)]
        lengths = np.concatenate(parts)
        del entries, levels, parts, grams
        for block, size, listed in lists:
            own = lengths[np.searchsorted(keys, unpacked_keys(listed, size))]
            row = {"block": block, "size": size, "grams": listed, "lengths": packed(own)}
            yield pa.RecordBatch.from_arrays([pa.array([row[field.name]], field.type) for field in ANSWERS_ARROW], schema=ANSWERS_ARROW)

    return build


ANSWERS_ARROW = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("grams", pa.binary()), ("lengths", pa.binary())])


def block_scorer(train_tokens: int, vocabulary: int):
    denominator = train_tokens + 0.1 * (vocabulary + 1)

    def score(documents: pa.Table, known: pa.Table) -> pa.Table:
        is_list = pa.compute.is_valid(known.column("grams"))
        answers, words = known.filter(is_list), known.filter(pa.compute.invert(is_list))
        sizes, lists, values = (answers.column(name).to_pylist() for name in ("size", "grams", "lengths"))
        own_keys = np.concatenate([unpacked_keys(data, size) for data, size in zip(lists, sizes, strict=True)])
        lengths = np.concatenate([unpacked(data, np.float32, size) for data, size in zip(values, sizes, strict=True)])
        own_keys, first = np.unique(own_keys, return_index=True)
        index = pd.Index(turned_back(own_keys))
        lengths = lengths[first].astype(np.float64)
        counts = dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist(), strict=True))
        columns: dict[str, list] = {name: [] for name in ("n_tokens", "n_known", "base_score", "score")}
        for batch in documents.to_batches():
            for piece in byte_slices(batch, "text", SLICE_BYTES):
                lists = [words_of(text) for text in byte_strings(piece.column("text"))]
                for own in lists:
                    seen = np.fromiter(map(counts.__getitem__, own), np.float64, len(own))
                    seen = np.append(seen, counts[b""])
                    columns["n_tokens"].append(len(seen))
                    columns["n_known"].append(int((seen > 0).sum()))
                    columns["base_score"].append(float(np.log10((seen + 0.1) / denominator).sum()))
                totals = np.zeros(len(lists))
                for found, owner in Stream(lists).windows():
                    totals += np.bincount(owner, lengths[index.get_indexer(found)], minlength=len(lists))
                columns["score"].extend(totals.tolist())
        size = len(columns["score"])
        return pa.table(
            {
                "doc_id": documents.column("id"),
                "held_out": pa.compute.invert(documents.column("training")),
                "n_tokens": pa.array(columns["n_tokens"], pa.int64()),
                "n_known": pa.array(columns["n_known"], pa.int64()),
                "train_tokens": pa.array([train_tokens] * size, pa.int64()),
                "base_score": pa.array(columns["base_score"], pa.float64()),
                "score": pa.array(columns["score"], pa.float64()),
            }
        )

    return score


def score_documents(
    documents: DataFrame,
    is_training: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Code length of every document under a model of the rows that meet ``is_training``, a condition
    on the column ``id``, beside that of a smoothed word-frequency model.

    Code lengths per byte are kept in single precision and added up in double.
    """
    piece = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    rows = texts(documents, id_column, text_column, piece.alias("piece"))
    pieces = rows.groupBy("piece").agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    largest, total = pieces.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = pieces_for(largest, block_bytes)
    parts = max(pieces_for(total, TRIE_BYTES), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.select(
        "piece",
        F.xxhash64("piece", F.pmod(F.xxhash64("id", F.length("text")), F.lit(cuts))).alias("block"),
        "id",
        "text",
        is_training.alias("training"),
    )
    buckets = min(BUCKETS * parts, MOST_BUCKETS)
    listed = materialize(dealt.mapInArrow(lean(count_blocks(buckets)), COUNTS_SCHEMA), "ppm-counts", ("kind",))
    grams = listed.filter("kind = 'gram'").select("bucket", "block", "size", "grams", "counts")
    words, low = listed.filter("kind = 'word'"), low_levels(listed.filter("kind = 'triple'"))
    answers = grams.repartition(parts, "bucket").mapInArrow(lean(trie_partition(low)), ANSWERS_SCHEMA)
    frequencies = materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    train_tokens, vocabulary = frequencies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    known_words = words.select("block", "word").join(frequencies, "word")
    needed = answers.unionByName(known_words, allowMissingColumns=True)
    return (
        dealt.select("block", "id", "text", "training")
        .groupBy("block")
        .cogroup(needed.groupBy("block"))
        .applyInArrow(block_scorer(train_tokens, vocabulary), SCORES_SCHEMA)
    )

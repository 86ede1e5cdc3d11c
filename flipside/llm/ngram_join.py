"""N-gram Jaccard join in size-banded tiles with bitmap signatures, exact for every pair.

A document is the set of its distinct five-word shingles. Documents with equal sets form a class
(by a 128-bit digest of the sorted set), and only classes are compared. Two linked sets share a shingle
among the first ``n - ceil(0.75 n) + 1`` of each in any common order; the order used here puts
shingles that many documents share last, so that a common passage seldom brings documents
together. Of what two linked sets share, the first shingle must also leave enough of both behind it.
Classes that share such a shingle are compared in tiles:

1. Within a shingle and a band of sizes, all classes meet the smallest one. The classes that meet the same
   one are cut into tiles of bounded size; a tile is searched for all links inside, and a class that
   is already reached is not tested again, so a group of thousands of copies costs about as many tests.
2. Classes that still lie in different components but share a shingle are compared between components:
   the members of the larger one, in tiles, against the members of all smaller ones. Every such
   pair of components is tested whole, until a link between the two is found.

Each set has a bitmap, about a quarter of a byte per shingle, of the parities of its hashed shingles. The
bits in which two bitmaps differ bound the sets' difference from below and so their overlap from above.
Tiles are first compared by bitmaps alone; sets are read only for classes that pass with some
other one, and only pairs that pass are intersected as sorted arrays. Components of the links are found by star contraction. The order of shingles affects
cost only, never the result.

Edge cases: a text of fewer words than a shingle is one shingle of all its words; texts without
words, null and empty ones have no shingle, link with nothing and are their own component; a null id
gets its set's size and a null component and takes no part; rows that share an id are one node; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flipside.llm.common import ROW, byte_slices, byte_strings, lean, lean_group, numbered, surplus_rows, texts, unnumbered, without_rows
from flipside.operators.joins import fits_broadcast, salted_join
from flipside.session import materialize

WORDS = 5
# Links: 100 * intersection >= 75 * union.
PERCENT = 75
# Classes of one side of a tile.
TILE = 256
LEAST_BITS, MOST_BITS = 256, 1 << 16
# Shingles that some batches of documents hold this often each, and all of them together this often,
# are common. The list of the most frequent ones shapes the order of shingles and nothing else.
COMMON_IN_BATCH = 2
COMMON_LEAST = 16
COMMON_LIST = 1 << 18

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
MIXERS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


PREFIX_SCHEMA = "shingle bigint, k1 bigint, k2 bigint, n int, rest int"
DIGEST_SCHEMA = "kind int, id bigint, n bigint, k1 bigint, k2 bigint, bits binary"


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, mixed for all texts at once."""
    lists = [text.lower().split() for text in texts]
    ends = np.cumsum([len(words) for words in lists], dtype=np.int64).tolist()
    # Hashing a word takes less time than looking its hash up. Digests are big-endian.
    digests = b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(lists)))
    del lists
    hashes = np.frombuffer(digests, ">u8").astype(np.uint64)
    every = mixed(hashes, max(len(hashes) - WORDS + 1, 0), WORDS)
    for start, end in zip([0, *ends], ends, strict=False):
        if end - start >= WORDS:
            own = np.sort(every[start : end - WORDS + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        elif end > start:
            yield mixed(hashes[start:end], 1, end - start, np.uint64(end - start))
        else:
            yield np.zeros(0, np.uint64)


def batch_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The set of each text of a batch, some at a time."""
    for piece in byte_slices(batch, "text"):
        yield from shingle_sets(byte_strings(piece.column("text")))


def mixed(hashes: np.ndarray, size: int, words: int, start: np.uint64 = np.uint64(0)) -> np.ndarray:
    """The hash of each of the first ``size`` sequences of so many words."""
    found = np.full(size, start)
    for place in range(words):
        found += hashes[place : place + size] * MULTIPLIERS[place]
    for mixer in MIXERS:
        found ^= found >> np.uint64(33)
        found *= mixer
    found ^= found >> np.uint64(33)
    return found


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the size, digest and bitmap of its set, and the shingles many of the batch share."""
    for batch in batches:
        sets, digests, bits = [], [], []
        for own in batch_sets(batch):
            sets.append(own)
            digests.append(xxhash.xxh3_128_digest(own))
            bits.append(bitmap(own))
        sizes = [len(own) for own in sets]
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        del sets
        # Sorted in place: the sets of a batch are large.
        every.sort()
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]]))
        counts = np.diff(np.append(starts, len(every)))
        common = counts >= COMMON_IN_BATCH
        shared, times = every[starts[common]], counts[common]
        del every, starts, counts
        n, m = batch.num_rows, len(shared)
        keys = np.frombuffer(b"".join(digests), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.ones(m, np.int32))]),
                pa.concat_arrays([batch.column("id"), signed(shared)]),
                pa.array(np.concatenate([sizes, times]).astype(np.int64)),
                pa.concat_arrays([pa.array(keys[::2]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(keys[1::2]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(bits, pa.binary()), pa.nulls(m, pa.binary())]),
            ],
            names=["kind", "id", "n", "k1", "k2", "bits"],
        )


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def prefix_batches(common: np.ndarray):
    """Emits the prefix of each class once per task; ``common`` lists frequent shingles, rarest first."""
    ranked = np.argsort(common)
    keys = common[ranked]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            prefixes, classes, sizes = [], [], []
            for own in batch_sets(batch):
                digest = xxhash.xxh3_128_digest(own)
                if not len(own) or digest in done:
                    continue
                done.add(digest)
                wanted = prefix_size(len(own))
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    often = keys[place] == own
                    later = own[often][np.argsort(ranked[place[often]])]
                    own_order = np.concatenate([own[~often][:wanted], later])
                else:
                    own_order = own
                prefixes.append(own_order[:wanted])
                classes.append(digest)
                sizes.append(len(own))
            lengths = [len(prefix) for prefix in prefixes]
            # How much of the set is left from each prefix shingle on, in this order.
            rests = [size - np.arange(length, dtype=np.int32) for size, length in zip(sizes, lengths, strict=True)]
            keys_of = np.repeat(np.frombuffer(b"".join(classes), np.int64).reshape(-1, 2), lengths, axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    signed(np.concatenate([np.zeros(0, np.uint64), *prefixes])),
                    pa.array(np.ascontiguousarray(keys_of[:, 0])),
                    pa.array(np.ascontiguousarray(keys_of[:, 1])),
                    pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    pa.array(np.concatenate([np.zeros(0, np.int32), *rests]).astype(np.int32)),
                ],
                names=["shingle", "k1", "k2", "n", "rest"],
            )

    return emit


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that several classes hold; the input is sorted by shingle and class.

    A row is passed on when its neighbour above or below has the same shingle and another class.
    The last row of a batch waits for the next.
    """
    names = ("shingle", "k1", "k2", "n", "rest")
    held: list[np.ndarray] | None = None
    before: tuple | None = None  # the last row passed over: its shingle and class
    for batch in batches:
        rows = [batch.column(name).to_numpy() for name in names]
        if held is not None:
            rows = [np.concatenate([old, new]) for old, new in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        shingle, first, second, *_ = rows
        fresh = np.ones(len(shingle), bool)
        fresh[1:] = (shingle[1:] != shingle[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        if before is not None:
            fresh[0] = before != (shingle[0], first[0], second[0])
        rows = [column[fresh] for column in rows]
        if not len(rows[0]):
            held = None
            continue
        shingle = rows[0]
        same = shingle[1:] == shingle[:-1]
        above = np.concatenate([[before is not None and before[0] == shingle[0]], same])
        below = np.concatenate([same, [False]])
        # The last row is decided when the next batch shows what follows, unless it is decided already.
        keep = above | below
        waits = not keep[-1]
        last = len(shingle) - 1
        if waits:
            held = [column[last:] for column in rows]
            keep[last] = False
            if last:
                before = (shingle[last - 1], rows[1][last - 1], rows[2][last - 1])
        else:
            held = None
            before = (shingle[last], rows[1][last], rows[2][last])
        yield pa.RecordBatch.from_arrays([pa.array(column[keep]) for column in rows], names=list(names))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles per hashed bit; a power of two of bits, two or more a shingle."""
    size = min(max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length() if len(shingles) else 0), MOST_BITS)
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


class Signatures:
    """Sizes and bitmaps of sets; ``near`` tells which ones of another group may be linked with one.

    Bitmaps of unequal size are compared at the smaller one, to which the larger folds by parity.
    """

    def __init__(self, sizes: list[int], bits: list[bytes]):
        self.sizes = np.array(sizes, np.int64)
        self.levels = np.array([len(found) for found in bits], np.int64)
        self.place = np.zeros(len(bits), np.int64)
        self.bitmaps: dict[tuple[int, int], np.ndarray] = {}
        for level in np.unique(self.levels).tolist():
            rows = np.flatnonzero(self.levels == level)
            self.place[rows] = np.arange(len(rows))
            joined = np.frombuffer(b"".join([bits[row] for row in rows]), np.uint8)
            self.bitmaps[level, level] = joined.reshape(-1, level).view(np.uint64)

    def folded(self, level: int, to: int) -> np.ndarray:
        if (level, to) not in self.bitmaps:
            wider = self.folded(level, 2 * to)
            half = wider.shape[1] // 2
            self.bitmaps[level, to] = wider[:, :half] ^ wider[:, half:]
        return self.bitmaps[level, to]

    def near(self, row: int, others: Signatures, columns: np.ndarray) -> np.ndarray:
        size, sizes = self.sizes[row], others.sizes[columns]
        columns = columns[(100 * np.minimum(size, sizes) >= PERCENT * np.maximum(size, sizes)) & (sizes > 0)]
        own_level, found = int(self.levels[row]), []
        for level in np.unique(others.levels[columns]).tolist():
            inside = columns[others.levels[columns] == level]
            to = min(level, own_level)
            own = self.folded(own_level, to)[self.place[row]]
            differ = np.bitwise_count(others.folded(level, to)[others.place[inside]] ^ own).sum(1, dtype=np.int64)
            both = size + others.sizes[inside]
            at_most = (both - differ) // 2
            found.append(inside[100 * at_most >= PERCENT * (both - at_most)])
        return np.concatenate(found) if found else columns


def passing_inside(members: pa.Table) -> pa.Table:
    """Members whose bitmap passes with another member's."""
    bitmaps = Signatures(members.column("n").to_pylist(), members.column("bits").to_pylist())
    every = np.arange(members.num_rows)
    passed = np.zeros(members.num_rows, bool)
    for row in range(members.num_rows):
        near = bitmaps.near(row, bitmaps, every[row + 1 :])
        passed[near] = True
        passed[row] |= bool(len(near))
    return members.select(["lead", "tile", "id"]).filter(pa.array(passed))


def passing_between(members: pa.Table) -> pa.Table:
    """Hosts and visitors whose bitmap passes with one of the other side."""
    visitor = members.column("visitor").to_numpy()
    bitmaps = Signatures(members.column("n").to_pylist(), members.column("bits").to_pylist())
    hosts = np.flatnonzero(visitor < 0)
    passed = np.zeros(members.num_rows, bool)
    for row in np.flatnonzero(visitor >= 0).tolist():
        near = bitmaps.near(row, bitmaps, hosts)
        passed[near] = True
        passed[row] = bool(len(near))
    return members.select(["host", "host_tile", "visitor_tile", "visitor", "id"]).filter(pa.array(passed))


class Tile:
    """Sets as sorted arrays; ``linked`` tests one against many."""

    def __init__(self, sets: list[bytes]):
        self.sets = [np.frombuffer(found, np.uint64) for found in sets]
        self.bitmaps = Signatures([len(found) for found in self.sets], [bitmap(found) for found in self.sets])

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        others = self.bitmaps.near(one, self.bitmaps, others)
        if not len(others):
            return others
        own, sizes = self.sets[one], self.bitmaps.sizes[others]
        elements = np.concatenate([self.sets[other] for other in others])
        place = np.minimum(np.searchsorted(own, elements), len(own) - 1)
        owner = np.repeat(np.arange(len(others)), sizes)
        overlap = np.bincount(owner, own[place] == elements, minlength=len(others)).astype(np.int64)
        return others[100 * overlap >= PERCENT * (len(own) + sizes - overlap)]


def links_table(pairs: list[tuple[int, int]]) -> pa.Table:
    left, right = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def links_inside(members: pa.Table) -> pa.Table:
    """Links that connect a tile's classes as all its links do: each component as a star."""
    members = members.sort_by("id")
    ids = members.column("id").to_pylist()
    tile = Tile(members.column("shingles").to_pylist())
    left, waits = np.arange(len(ids)), np.ones(len(ids), bool)
    pairs = []
    while len(left):
        star, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            reached = tile.linked(queue.pop(), left)
            pairs.extend((ids[star], ids[other]) for other in reached.tolist())
            queue.extend(reached.tolist())
            waits[reached] = False
            left = left[waits[left]]
    return links_table(pairs)


def links_between(members: pa.Table) -> pa.Table:
    """One link, if there is any, from the host's members to each visiting component."""
    visitor = members.column("visitor").to_numpy()
    ids = members.column("id").to_pylist()
    tile = Tile(members.column("shingles").to_pylist())
    hosts = np.flatnonzero(visitor < 0)
    found: dict[int, tuple[int, int]] = {}
    for place in np.flatnonzero(visitor >= 0).tolist():
        component = int(visitor[place])
        if component not in found:
            reached = tile.linked(place, hosts)
            if len(reached):
                found[component] = (ids[reached[0]], ids[place])
    return links_table(list(found.values()))


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``links (a, b)``; the component is its smallest node.

    Alternates two steps until nothing changes: link every larger neighbour of a node to the smallest
    neighbour, then every smaller neighbour and the node itself to the smallest.
    """
    ordered = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialize(links.filter("a <> b").select(*ordered).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large.filter("a <> b"), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = small.unionByName(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        edges = materialize(edges, "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state = seen


def read_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets of the documents ``wanted``, as little-endian 64-bit hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for own in batch_sets(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    wanted = wanted.distinct()
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "id", "left_semi").mapInArrow(lean(emit), "id bigint, shingles binary")


def tile_of(total: Column) -> Column:
    """The tile of the row ``id`` among ``total`` that are cut into tiles of about ``TILE``."""
    return F.pmod(F.xxhash64("id"), F.ceil(total / TILE)).cast("int")


def candidates(rows: DataFrame, classes: DataFrame, common: DataFrame) -> DataFrame:
    """``(shingle, id, n, rest)``: classes, named by their smallest document, that share a prefix
    shingle, with the size of the set and of what is left of it from this shingle on."""
    listed = common.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_LEAST)
    listed = listed.orderBy(F.desc("n"), "id").limit(COMMON_LIST).collect()
    rarest_first = np.array([row["id"] for row in reversed(listed)], np.int64).view(np.uint64)
    prefixes = rows.filter("id IS NOT NULL").mapInArrow(lean(prefix_batches(rarest_first)), PREFIX_SCHEMA)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = (
        prefixes.repartition(partitions, "shingle")
        .sortWithinPartitions("shingle", "n", "k1", "k2")
        .mapInArrow(lean(shared_rows), PREFIX_SCHEMA)
    )
    shared = materialize(shared, "shared-shingles")
    return materialize(shared.join(classes.select("k1", "k2", "id"), ["k1", "k2"]).select("shingle", "id", "n", "rest"), "candidates")


def links_in_bands(rows: DataFrame, shared: DataFrame, signatures: DataFrame) -> DataFrame:
    """Step 1: links among classes that meet the same smallest class."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    banded = shared.withColumn("band", band)
    smallest = banded.groupBy("shingle", "band").agg(F.min(F.struct("n", "id")).alias("low"))
    meet = banded.join(smallest, ["shingle", "band"]).select(F.col("low.id").alias("lead"), "id")
    meet = materialize(meet.filter("lead <> id").distinct(), "meetings")
    sizes = meet.groupBy("lead").agg(F.count("*").alias("n"))
    tiled = salted_join(meet, sizes, ["lead"], sizes, F.col("id")).withColumn("tile", tile_of(F.col("n")))
    leads = sizes.withColumn("tile", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / TILE).cast("int") - 1)))
    tiled = tiled.select("lead", "tile", "id").unionByName(leads.select("lead", "tile", F.col("lead").alias("id")))
    passed = tiled.join(signatures, "id").groupBy("lead", "tile").applyInArrow(lean_group(passing_inside), "lead bigint, tile int, id bigint")
    passed = materialize(passed, "passed")
    sets = read_sets(rows, passed.select("id"))
    found = passed.join(sets, "id").groupBy("lead", "tile").applyInArrow(lean_group(links_inside), "a bigint, b bigint")
    return materialize(found, "links")


def links_across(rows: DataFrame, shared: DataFrame, signatures: DataFrame, reached: DataFrame) -> DataFrame:
    """Step 2: links between components that share a shingle."""
    labelled = shared.join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = materialize(labelled, "labelled")
    members = labelled.select("component", "id").distinct()
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    held = labelled.groupBy("shingle", "component").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest")
    )
    held = held.withColumn("others", F.count("*").over(Window.partitionBy("shingle"))).filter("others > 1").drop("others")
    left = held.select("shingle", *(F.col(name).alias(f"{name}_a") for name in ("component", "low", "high", "rest")))
    right = held.select("shingle", *(F.col(name).alias(f"{name}_b") for name in ("component", "low", "high", "rest")))
    close = (100 * F.col("low_a") <= 10000 / PERCENT * F.col("high_b")) & (100 * F.col("low_b") <= 10000 / PERCENT * F.col("high_a"))
    # The first shingle that two linked sets share leaves enough of both for their overlap.
    enough = (100 + PERCENT) * F.least("rest_a", "rest_b") >= PERCENT * (F.col("low_a") + F.col("low_b"))
    pairs = left.join(right, "shingle").filter((F.col("component_a") < F.col("component_b")) & close & enough)
    pairs = materialize(pairs.select("component_a", "component_b").distinct(), "component-pairs")
    pairs = pairs.join(sizes.select(F.col("component").alias("component_a"), F.col("size").alias("size_a")), "component_a")
    pairs = pairs.join(sizes.select(F.col("component").alias("component_b"), F.col("size").alias("size_b")), "component_b")
    larger = F.col("size_a") >= F.col("size_b")
    pairs = pairs.select(
        F.when(larger, F.col("component_a")).otherwise(F.col("component_b")).alias("host"),
        F.when(larger, F.col("component_b")).otherwise(F.col("component_a")).alias("visitor"),
        F.greatest("size_a", "size_b").alias("host_size"),
        F.least("size_a", "size_b").alias("visitor_size"),
    )
    grid = pairs.groupBy("host").agg(F.first("host_size").alias("hosts"), F.sum("visitor_size").alias("visitors"))
    grid = materialize(grid, "grid")
    to_all = lambda total: F.explode(F.sequence(F.lit(0), F.ceil(F.col(total) / TILE).cast("int") - 1))
    hosts = (
        grid.join(members.withColumnRenamed("component", "host"), "host")
        .withColumn("host_tile", tile_of(F.col("hosts")))
        .withColumn("visitor_tile", to_all("visitors"))
        .select("host", "host_tile", "visitor_tile", F.lit(-1).cast("bigint").alias("visitor"), "id")
    )
    visitors = (
        pairs.join(grid, "host")
        .join(members.withColumnRenamed("component", "visitor"), "visitor")
        .withColumn("visitor_tile", tile_of(F.col("visitors")))
        .withColumn("host_tile", to_all("hosts"))
        .select("host", "host_tile", "visitor_tile", "visitor", "id")
    )
    tile = ["host", "host_tile", "visitor_tile"]
    passed = hosts.unionByName(visitors).join(signatures, "id").groupBy(*tile).applyInArrow(
        lean_group(passing_between), "host bigint, host_tile int, visitor_tile int, visitor bigint, id bigint"
    )
    passed = materialize(passed, "passed")
    sets = read_sets(rows, passed.select("id"))
    found = passed.join(sets, "id").groupBy(*tile).applyInArrow(lean_group(links_between), "a bigint, b bigint")
    return materialize(found, "links")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    rows = texts(documents, id_column, text_column)
    listed = materialize(rows.mapInArrow(lean(digest_batches), DIGEST_SCHEMA), "digests", ("kind",))
    digests = listed.filter("kind = 0").select("id", "n", "k1", "k2")
    common = listed.filter("kind = 1").select("id", "n")
    classes = digests.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    shared = candidates(rows, classes, common)
    found = listed.filter("kind = 0").select("id", "n", "bits").join(shared.select("id").distinct(), "id", "left_semi")
    signatures = materialize(found, "signatures")
    links = links_in_bands(rows, shared, signatures)
    # Rows that share an id are one node, whatever their sets.
    same_id = digests.filter("n > 0 AND id IS NOT NULL").select("id", "k1", "k2").distinct()
    twins = same_id.join(same_id.groupBy("id").agg(F.count("*").alias("sets")).filter("sets > 1"), "id")
    twins = twins.join(classes.select("k1", "k2", F.col("id").alias("a")), ["k1", "k2"]).select("a", F.col("id").alias("b"))
    links = links.unionByName(twins)
    reached = connected_components(links)
    across = links_across(rows, shared, signatures, reached)
    if not across.isEmpty():
        reached = connected_components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(across))
    named = classes.join(reached, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    keyed = salted_join(digests, named, ["k1", "k2"], classes.select("k1", "k2", "n"), F.col("id"), "left")
    return keyed.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id"),
    )


def drop_near_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each component one row, that of the smallest id, with all its columns.

    Here every row is a node of its own, also one that shares its id or has none; of rows with the
    smallest id (or without any) the one written first stays.
    """
    written = numbered(documents, "near-rows")
    found = near_duplicates(written, ROW, text_column).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    found = found.join(written.select(ROW, F.col(id_column).cast("bigint").alias("id")), ROW)
    found = materialize(found, "near-components")
    groups = found.groupBy("group").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups, "near-groups")
    members = salted_join(found, groups.drop("n"), ["group"], groups.select("group", "n"), F.col(ROW))
    members = materialize(members, "near-copies")
    gone = materialize(surplus_rows(members), "near-surplus")
    return unnumbered(without_rows(written, gone), documents.columns)

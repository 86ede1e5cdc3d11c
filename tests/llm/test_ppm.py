import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flipside.llm import ppm, queries
from flipside.llm.common import fold
from tests.llm.conftest import document_rows


class PlainModel:
    """The same model written with dictionaries, one byte at a time."""

    def __init__(self, streams, order=ppm.ORDER):
        self.order = order
        self.counts = defaultdict(Counter)
        grams = Counter()
        for stream in streams:
            padded = bytes([ppm.END]) * order + stream
            grams.update(padded[place - order : place + 1] for place in range(order, len(padded)))
        while grams and len(next(iter(grams))):
            for gram, n in grams.items():
                self.counts[gram[:-1]][gram[-1]] = n
            grams = Counter(gram[1:] for gram in grams)

    def probability(self, context, byte):
        excluded, result = set(), 1.0
        for size in range(self.order, -1, -1):
            seen = {b: n for b, n in self.counts.get(context[len(context) - size :], {}).items() if b not in excluded}
            if not seen:
                continue
            total = sum(seen.values())
            if byte in seen:
                return result * (2 * seen[byte] - 1) / (2 * total)
            result *= len(seen) / (2 * total)
            excluded |= set(seen)
        return result / (256 - len(excluded))

    def score(self, stream):
        padded = bytes([ppm.END]) * self.order + stream
        return sum(
            math.log10(self.probability(padded[place - self.order : place], padded[place]))
            for place in range(self.order, len(padded))
        )


def stream_of(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def learned_from(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def expected_scores(rows):
    training = [text for doc_id, text in rows if learned_from(doc_id)]
    model = PlainModel(map(stream_of, training))
    counts = Counter(word for text in training for word in [*stream_of(text)[:-1].split(), b"\n"])
    total, vocabulary = sum(counts.values()), len(counts)
    for doc_id, text in rows:
        tokens = [*stream_of(text)[:-1].split(), b"\n"]
        base = sum(math.log10((counts[token] + 0.1) / (total + 0.1 * (vocabulary + 1))) for token in tokens)
        known = sum(counts[token] > 0 for token in tokens)
        yield doc_id, not learned_from(doc_id), len(tokens), known, total, base, model.score(stream_of(text))


def same(found, expected):
    key = lambda row: (row[0] if row[0] is not None else -1, round(row[5], 6), round(row[6], 6))
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [row[:5] for row in found] == [row[:5] for row in expected]
    for got, wanted in zip(found, expected, strict=True):
        assert got[5:] == pytest.approx(wanted[5:], rel=1e-6, abs=1e-6)


def test_scores_equal_the_plain_model(spark, awkward, no_documents):
    small = [row for row in document_rows() if not row[1] or len(row[1]) < 3000]
    frame = spark.createDataFrame(small, "doc_id bigint, text string")
    found = ppm.score_documents(frame, fold(F.col("id"), 10) != 0, block_bytes=8000)
    same(found.collect(), list(expected_scores(small)))
    assert ppm.score_documents(no_documents, fold(F.col("id"), 10) != 0).count() == 0
    whole = ppm.score_documents(awkward, fold(F.col("id"), 10) != 0).collect()
    assert len(whole) == len(document_rows()) and all(math.isfinite(row.score) for row in whole)


def test_without_training_rows_bytes_are_uniform(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")
    found = {row.doc_id: row for row in ppm.score_documents(frame, F.lit(False)).collect()}
    assert found[1].score == pytest.approx(-3 * math.log10(256), rel=1e-6) and found[2].score == pytest.approx(-math.log10(256), rel=1e-6)
    assert found[1].train_tokens == 0 and found[1].n_known == 0


def test_probabilities_add_up_to_one():
    streams = [b"abracadabra\n", b"abrasive cadence\n", b"\n"]
    model = PlainModel(streams)
    for context in (b"\n\n\n\n\n", b"abrac", b"zzzzz", b"zzabr"):
        assert sum(model.probability(context, byte) for byte in range(256)) == pytest.approx(1)


def test_long_streams_are_read_in_windows(monkeypatch):
    lists = [[b"ab", b"c"], [], [b"x" * 50]]
    whole = [np.concatenate(part) for part in zip(*ppm.Stream(lists).windows(), strict=True)]
    monkeypatch.setattr(ppm, "WINDOW", 7)
    pieces = [np.concatenate(part) for part in zip(*ppm.Stream(lists).windows(), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert np.bincount(whole[1]).tolist() == [5, 1, 51]


def test_held_out_texts_beat_word_frequencies(spark):
    rows = queries.QUERIES["op2_partial_matching"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(row.score for row in rows) > sum(row.base_score for row in rows)


def test_a_block_lists_its_grams_by_bucket_and_reads_them_back():
    """Rows grow with the buckets, not with the grams, and hold every gram with its count."""
    lists = [document[1].encode().lower().split() for document in document_rows()[11:60]]
    learned = np.arange(len(lists)) % 3 > 0
    block = ppm.BlockCounts()
    block.add(lists, learned)
    listed, triples, words = block.rows(7, ppm.bucket_numbers(16))
    assert listed.num_rows <= 16 and set(listed.column("bucket").to_pylist()) <= set(range(16))
    found = Counter()
    for row in listed.to_pylist():
        keys = ppm.unpacked_keys(row["grams"], row["size"])
        assert (np.diff(keys) > 0).all()
        found.update(dict(zip(ppm.turned_back(keys).tolist(), ppm.unpacked(row["counts"], np.int64, row["size"]).tolist(), strict=True)))
    expected = Counter()
    for own, counts in zip(lists, learned.tolist(), strict=True):
        padded = bytes([ppm.END]) * ppm.ORDER + b" ".join(own) + bytes([ppm.END])
        for place in range(ppm.ORDER, len(padded)):
            expected[int.from_bytes(padded[place - ppm.ORDER : place + 1], "big")] += int(counts)
    assert dict(found) == dict(expected) and len(found) > 500
    assert set(triples.column("triple").to_pylist()) == {gram & 0xFFFFFF for gram, n in expected.items() if n}
    assert words.num_rows == len({word for own in lists for word in own}) + 1


def test_turned_grams_and_packed_numbers_come_back():
    grams = np.array([0, 0x010203040506, 0xFFFFFFFFFFFF, 0x0A0A0A0A0A61], np.int64)
    assert ppm.turned_back(ppm.turned(grams)).tolist() == grams.tolist()
    assert (ppm.turned(grams) >> 32).tolist() == [0, 0x0405, 0xFFFF, 0x0A0A]
    lengths = np.array([-0.25, -3.5, 0.0], np.float32)
    assert ppm.unpacked(ppm.packed(lengths), np.float32, 3).tolist() == lengths.tolist()
    assert ppm.unpacked_keys(ppm.packed_keys(np.zeros(0, np.int64)), 0).tolist() == []

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flipside.llm import packing, prefix_table, queries, token_grammar
from flipside.llm.word_encoder import WordEncoder, word_encoder
from flipside.session import scratch_path
from tests.llm.conftest import document_rows

ODD = [
    "", "  ", "a<|endoftext|>b", "It's we'll don't, O'Neil's I'LL 'RE 's't", "é é ́x  y", "\x1c\x1da b", "ΣΑΣ ΟΔΟΣ. Σ",
    "x\xa0y　z", "1234 a1b2 12.5,", "...", "a.,b", "Å ANGSTROM", "İstanbul ﬁ ẞ", "日本語。中文", "😀😀!!", "a\u0085b c", "ab%%% c***",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.WORD_BPE)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_word_encoder_equals_the_library(tokenizer):
    encoder = word_encoder(queries.WORD_BPE)
    for text in ODD + [text or "" for _, text in document_rows() if not text or len(text) < 5000]:
        assert encoder.encode(text.encode()) == packed(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_texts_encoded_together_equal_the_library(tokenizer):
    """Apostrophes, digits, signs and letters in any order; letters whose lower case lies far from them."""
    random = np.random.default_rng(6)
    letters = [chr(code) for code in [*range(0xC0, 0x130), *range(0x131, 0x240)]]
    signs = [*"   \t\n", *"'" * 5, *"sStTrReEvVmMlLdDaz09.,-\"", "\x1c", "\0", "日"]
    texts = ["", " ", *(f"a{letter}b" for letter in letters)]
    texts += ["".join(random.choice(signs + letters[:8], random.integers(0, 40))) for _ in range(3000)]
    expected = [packed(tokenizer.encode(text, add_special_tokens=False).ids) for text in texts]
    assert word_encoder(queries.WORD_BPE).encode_all([text.encode() for text in texts]) == expected


def test_words_of_many_texts_are_looked_up_once():
    """Words that texts share are looked up once for all of them, and the model is asked once."""
    encoder = WordEncoder(queries.WORD_BPE)
    looked_up, asked, words, ids = [], [], encoder._words, encoder._ids
    encoder._words = lambda found: looked_up.extend(found) or words(found)
    encoder._ids = lambda found: asked.extend(found) or ids(found)
    first = encoder.encode_all([b"one two, two\n", b"TWO one!", b"two, one"] * 50)
    assert sorted(looked_up) == [b"!", b",", b"one", b"two"] and sorted(asked) == ["!", ",", "one", "two"]
    assert encoder.encode_all([b"one two, two\n"]) == first[:1] and len(asked) == 4


@pytest.mark.parametrize("ids", [[], [5], [3] * 9, [3] * 10, [1, 2] * 40, [1, 2, 3, 1, 2, 3, 3, 3, 3] * 30])
def test_grammar_round_trip_and_ranges(ids):
    ids = np.array(ids, np.uint32)
    lengths = np.array([len(ids)], np.int64)
    shard = token_grammar.Shard(token_grammar.pack_shard(ids, lengths, [7], min_count=2))
    assert shard.doc_ids == [7] and shard.n_tokens == len(ids)
    for start in range(0, len(ids) + 1, 3):
        for stop in (start, start + 1, len(ids)):
            assert shard.ids(start, min(stop, len(ids))).tolist() == ids[start:stop].tolist()
    if len(ids) > 20:
        assert len(shard.symbols) < len(ids) and len(shard.rules)


def test_grammar_leaves_no_frequent_pair():
    ids = np.random.default_rng(1).integers(0, 12, 5000).astype(np.uint32)
    _, rules, symbols = token_grammar.build_grammar(ids, min_count=20)
    pairs, counts = np.unique(np.stack([symbols[:-1], symbols[1:]]), axis=1, return_counts=True)
    different = pairs[0] != pairs[1]
    assert counts[different].max() < 20
    assert len(rules) == len({tuple(rule) for rule in rules.tolist()})


@pytest.mark.parametrize("top", [1, 50, 1 << 34, 1 << 62])
def test_places_sort_with_their_values(top):
    """Values are counted as ``np.unique`` does, also where value and place do not fit into one number."""
    values = np.random.default_rng(4).integers(0, top, 3000)
    for own in (values, values[:1], values[:0], np.full(9, top)):
        for found, expected in zip(token_grammar.counted(own), np.unique(own, return_inverse=True, return_counts=True), strict=True):
            assert found.tolist() == expected.tolist()


def test_production_grammar_replaces_pairs_that_occur_three_times():
    """A passage of rare ids, copied a few times, becomes a few rules; what is left has no pair three times."""
    random = np.random.default_rng(2)
    passage = random.choice(40_000, 3000, replace=False)
    pieces = [part for _ in range(6) for part in (random.integers(0, 40_000, 2000), passage)]
    runs = np.repeat(random.integers(0, 9, 400), random.integers(1, 9, 400))
    ids = np.concatenate([*pieces, runs]).astype(np.uint32)
    _, rules, symbols = token_grammar.build_grammar(ids)
    pairs, counts = np.unique(np.stack([symbols[:-1], symbols[1:]]), axis=1, return_counts=True)
    assert counts[pairs[0] != pairs[1]].max() < 3
    assert len(symbols) < len(ids) - 5 * 2900
    assert len(rules) == len({tuple(rule) for rule in rules.tolist()})
    shard = token_grammar.Shard(token_grammar.pack_shard(ids, np.array([len(ids)]), [7], token_grammar.MIN_COUNT))
    assert (shard.ids(0, len(ids)) == ids).all() and (shard.ids(1234, 30_000) == ids[1234:30_000]).all()


def test_a_range_expands_only_its_own_rules():
    """Random access: a short range of a shard follows few of the rules that the whole shard needs."""
    rng = np.random.default_rng(8)
    phrases = [rng.integers(0, 500, 40) for _ in range(60)]
    ids = np.concatenate([phrases[number] for number in rng.integers(0, 60, 2000)]).astype(np.uint32)
    payload = token_grammar.pack_shard(ids, np.array([len(ids)]), [7], token_grammar.MIN_COUNT)
    whole, piece = token_grammar.Shard(payload), token_grammar.Shard(payload)
    assert whole.expanded == 0
    assert (whole.ids(0, len(ids)) == ids).all()
    for start in (0, 12_345, len(ids) - 50):
        before = piece.expanded
        assert (piece.ids(start, start + 50) == ids[start : start + 50]).all()
        assert piece.expanded - before < 50 + 2 * 64 < whole.expanded / 100


def test_spans_of_rules_equal_their_expansions():
    ids = np.random.default_rng(3).integers(0, 12, 5000).astype(np.uint32)
    base, rules, _ = token_grammar.build_grammar(ids, 3)
    sizes = [1] * base
    for first, second in rules.tolist():
        sizes.append(sizes[first] + sizes[second])
    assert token_grammar.rule_spans(base, rules).tolist() == sizes[base:]
    assert [rule for start, stop in token_grammar.passes(base, rules) for rule in range(start, stop)] == list(range(len(rules)))


def test_rows_of_one_id_fill_several_ranges(spark, tmp_path, monkeypatch):
    """A third of all rows without an id, half of them copies: no range holds them all, none is lost."""
    monkeypatch.setattr(token_grammar, "RANGE_BYTES", 4096)
    rows = [(None if number % 3 == 0 else number, "copied words" if number % 2 else f"own words {number}") for number in range(3000)]
    token_grammar.write_token_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "shards"), queries.WORD_BPE, 2)
    nulls = {}
    for row in spark.read.parquet(str(tmp_path / "shards")).collect():
        nulls[row.part] = nulls.get(row.part, 0) + token_grammar.Shard(bytes(row.payload)).doc_ids.count(None)
    assert sum(nulls.values()) == 1000 and max(nulls.values()) < 500
    found = token_grammar.read_token_shards(spark, str(tmp_path / "shards")).orderBy("start").collect()
    assert [row.doc_id for row in found] == [None] * 1000 + sorted(doc_id for doc_id, _ in rows if doc_id is not None)
    assert [row.start for row in found[1:]] == np.cumsum([row.n_tokens for row in found])[:-1].tolist()


def test_token_shards(spark, awkward, no_documents, tokenizer):
    path = scratch_path(spark, "test-shards")
    token_grammar.write_token_shards(awkward, path, queries.WORD_BPE, 2, shard_tokens=4000, min_count=8)
    found = token_grammar.read_token_shards(spark, path).collect()
    expected, start = [], 0
    for doc_id, text in sorted(document_rows(), key=lambda row: (row[0] is not None, row[0] or 0, row[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(found, key=lambda row: row.start) == expected
    empty = scratch_path(spark, "test-shards")
    token_grammar.write_token_shards(no_documents, empty, queries.WORD_BPE, 2)
    assert token_grammar.read_token_shards(spark, empty).count() == 0


def test_prefix_table_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    encoder = prefix_table.piece_encoder(queries.PIECE_BPE)
    spaces = ["  a   b    ", " " * 50 + "x", "\n\n a\t b", "▁a ▁▁ b", "<s> <0x0A> </s>", "　x", " \n"]
    for text in ODD + spaces + [text or "" for _, text in document_rows() if not text or len(text) < 5000]:
        assert encoder.ids(text) == packed(library.encode(text)), text


def test_prefix_table_is_unique():
    """Exactly one token that ends a prefix is compatible with what comes before it."""
    encoder = prefix_table.piece_encoder(queries.PIECE_BPE)
    for chunk in ("▁international", "▁unthinkable", "▁▁▁▁▁aa", "▁Überraschung", "▁aaaaaaaaaa"):
        last = encoder.last_tokens(chunk)
        for stop in range(1, len(chunk) + 1):
            fitting = [
                piece
                for start in range(stop)
                if (piece := chunk[start:stop]) in encoder.numbers
                and encoder.merge(piece) == [piece]
                and (start == 0 or encoder.merge(last[start] + piece) == [last[start], piece])
            ]
            assert fitting == [last[stop]]


def test_encode_and_decode(awkward, no_documents):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    found = prefix_table.encode_and_decode(awkward, queries.PIECE_BPE).collect()
    expected = []
    for doc_id, text in document_rows():
        ids = [1, *library.encode(text or ""), 2]
        expected.append((doc_id, packed(ids), library.decode(ids)))
    key = lambda row: (row[0] or -1, bytes(row[1]))
    assert sorted(((a, bytes(b), c) for a, b, c in found), key=key) == sorted(expected, key=key)
    assert prefix_table.encode_and_decode(no_documents, queries.PIECE_BPE).count() == 0


def test_query_digests(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    rows = {row.doc_id: row for row in queries.QUERIES["op3_prefix_table"](spark, folder).collect()}
    for doc_id, text in queries.read_table(spark, folder, "documents").select("doc_id", "text").collect():
        ids = [1, *library.encode(text or ""), 2]
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def check_packing(rows, capacity):
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing(awkward, no_documents, tokenizer):
    rows = packing.pack_documents(awkward, queries.WORD_BPE, end_id=0).collect()
    used = check_packing(rows, packing.CAPACITY)
    expected = []
    for doc_id, text in document_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected.append((doc_id or -1, piece, start, len(part), zlib.crc32(packed(part))))
    assert sorted((row.doc_id or -1, row.piece, row.start, row.length, row.ids_crc32) for row in rows) == sorted(expected)
    assert used <= 1.05 * sum(row[3] for row in expected) / 2048 + 1
    assert packing.pack_documents(no_documents, queries.WORD_BPE, end_id=0).count() == 0


def test_sum_of_squares_rule():
    """Each placement has the least sum of squares among all that are possible."""
    capacity, lengths = 12, np.random.default_rng(3).integers(1, 13, 300).tolist()
    sequences, offsets = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}

    def squares(levels):
        counts = np.bincount([gap for gap in levels.values() if 0 < gap < capacity], minlength=capacity)
        return int((counts**2).sum())

    for length, sequence, offset in zip(lengths, sequences, offsets, strict=True):
        options = {name: {**gaps, name: gap - length} for name, gap in gaps.items() if gap >= length}
        options[len(gaps)] = {**gaps, len(gaps): capacity - length}
        assert capacity - gaps.get(sequence, capacity) == offset
        assert squares(options[sequence]) == min(map(squares, options.values()))
        gaps = options[sequence]


def test_packing_is_tight_on_whole_tables(spark, folder):
    rows = packing.pack_documents(queries.read_table(spark, folder, "documents"), queries.WORD_BPE, end_id=0)
    used, tokens = rows.agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert used <= 1.03 * tokens / 2048 + 1


def test_equal_pieces_are_dealt_to_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rows = [(None, None)] * 400 + [(7, "same text")] * 400 + [(number, f"text {number}") for number in range(200)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), queries.WORD_BPE, 0).collect()
    sizes = Counter(row.sequence_id >> 32 for row in found)
    assert len(found) == 1000 and len(sizes) == 20 and max(sizes.values()) < 100

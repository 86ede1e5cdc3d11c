"""Ids of a lower-casing word BPE, computed by the tokenizers library once per distinct word."""

from __future__ import annotations

import codecs
import os
import re
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa

from flipside.llm.common import Memo

# Letters U+00C0-U+023F without the two signs among them and without U+0130, which becomes two
# characters in lower case. None of them changes or combines under NFC, and all stay letters in lower case.
LATIN = "\xc0-\xd6\xd8-\xf6\xf8-įı-ȿ"
OTHER_SCRIPTS = re.compile(f"[^\x00-\x7f{LATIN}]").search
# What the bytes of such texts in lower case are in the tokenizer's pattern; all above ASCII belong to letters.
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(b"\t\n\v\f\r ")] = SPACE
KINDS[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = LETTER
KINDS[list(b"0123456789")] = DIGIT


token_id = attrgetter("id")


def little_endian(numbers: Iterable[int]) -> bytes:
    packed = array("I", numbers)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def slices(packed: bytes, cuts: np.ndarray) -> list[bytes]:
    """The bytes between each cut and the next."""
    return [packed[start:stop] for start, stop in pairwise(cuts.tolist())]


def binary_slices(values: pa.LargeBinaryArray, cuts: np.ndarray) -> list[bytes]:
    """The joined values between each cut and the next."""
    _, offsets, packed = values.buffers()
    return slices(packed.to_pybytes() if packed else b"", np.frombuffer(offsets, np.int64, len(values) + 1)[cuts])


def pretoken_starts(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a pretoken of the tokenizer's pattern begins at each byte of texts that end in two spaces.

    Pretokens are runs of letters, single digits, runs of other signs, and, where no such run holds
    the apostrophe already, 's, 't, 're, 've, 'm, 'll and 'd.
    """
    starts = np.empty(len(data), bool)
    starts[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    quotes = np.flatnonzero((data == ord("'")) & starts)
    starts |= kinds == DIGIT
    first, second = data[quotes + 1], data[quotes + 2]
    short = np.isin(first, list(b"stmd"))
    long = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    starts[quotes[short | long] + 1] = False
    starts[np.concatenate((quotes[short] + 2, quotes[long] + 3))] = True
    return starts & (kinds != SPACE)


class WordEncoder:
    """``encode`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives.

    The tokenizer drops white space, and no merge reaches over the pretokens of its pattern, so a
    text's ids are those of its pretokens, and the library's model is asked once for each distinct
    one. Texts of ASCII and Latin characters are lower-cased and taken apart here by the same
    pattern, many at once; others by the library's own normalizer and pattern, chunk by chunk, as
    neither reaches over white space; texts that may contain a special token of the tokenizer are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [token.content for token in added]
        # The character that stands for each byte of lower-cased ASCII and Latin texts.
        characters = "".join(map(chr, [*range(0x80), *range(0xC0, 0x130), *range(0x131, 0x240)])).lower()
        mapped = "".join(piece for piece, _ in self.tokenizer.pre_tokenizer[1].pre_tokenize_str(characters))
        by_byte = dict(zip(characters.encode(), mapped, strict=True))
        self.byte_level = "".join(by_byte.get(byte, "\ufffe") for byte in range(256))
        self.words = Memo(lambda word: self._words([word])[0], 300_000)
        self.chunks = Memo(self._chunk, 100_000)

    def _ids(self, pretokens: list[str]) -> list[bytes]:
        """Ids of byte-level pretokens, by the library's model."""
        ids, cuts = array("I"), [0]
        for pretoken in pretokens:
            ids.extend(map(token_id, self.model.tokenize(pretoken)))
            cuts.append(len(ids))
        return slices(little_endian(ids), np.array(cuts) * 4)

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pretokens in lower case, each asked for once."""
        new = [word for word in words if word not in self.words]
        if new:
            mapped, _ = codecs.charmap_decode(b"\n".join(new), "strict", self.byte_level)
            self.words.update(zip(new, self._ids(mapped.split(self.byte_level[ord("\n")])), strict=True))
        ids = [self.words[word] for word in words]
        self.words.trim()
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        normal = self.tokenizer.normalizer.normalize_str(chunk.decode("utf-8", "replace"))
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return b"".join(self._ids([piece for piece, _ in pieces]))

    def _plain(self, lowered: list[bytes]) -> list[bytes]:
        """Ids of lower-cased texts of ASCII and Latin characters."""
        data = np.frombuffer(b"\n".join([*lowered, b"\n"]), np.uint8)
        kinds = KINDS[data]
        starts = pretoken_starts(data, kinds)
        inked = kinds != SPACE
        data = data[inked]
        offsets = np.append(np.flatnonzero(starts[inked]), len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        distinct = binary_slices(coded.dictionary, np.arange(len(coded.dictionary) + 1))
        ids = pa.array(self._words(distinct), pa.large_binary()).take(coded.indices)
        text_starts = np.cumsum([0, *(len(text) + 1 for text in lowered)])
        return binary_slices(ids, np.searchsorted(np.flatnonzero(starts), text_starts))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        encoded: list[bytes] = [b""] * len(texts)
        places, lowered = [], []
        for place, text in enumerate(texts):
            decoded = text.decode("utf-8", "replace")
            if any(token in decoded for token in self.special):
                encoded[place] = little_endian(self.tokenizer.encode(decoded, add_special_tokens=False).ids)
            elif decoded.isascii() or not OTHER_SCRIPTS(decoded):
                places.append(place)
                lowered.append(decoded.lower().encode())
            else:
                encoded[place] = b"".join(map(self.chunks.__getitem__, text.split()))
                self.chunks.trim()
        if places:
            for place, ids in zip(places, self._plain(lowered), strict=True):
                encoded[place] = ids
        return encoded

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary file."""
    return WordEncoder(path)

"""SentencePiece merge encoding by a table of last tokens, and decoding.

The encoding of a text's every prefix ends in exactly one token. Going through the text once, an
automaton over the vocabulary names the tokens that end at each place; of these, the one that is
compatible with the last token of what comes before it is stored. Read backwards from the end,
the table gives the ids. Two neighbouring tokens are compatible if the merges, applied to the two
alone, give these two again.

No piece of such a vocabulary reaches over a space that is not at its beginning, nor over a line
feed, so texts are taken apart there and every distinct chunk is encoded once per worker.

Edge cases: a null or empty text has the begin and end ids only; a character without a piece
becomes the ids of its bytes; raw U+2581 counts as a space; rows that share an id are encoded each
for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flipside.llm.common import Memo, byte_strings, texts
from flipside.llm.word_encoder import little_endian

SPACE = "▁"
CHUNKS = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall


class PieceEncoder:
    """``ids`` gives what the library's ``encode`` gives, without begin and end ids."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        library = self.processor
        numbers = range(library.get_piece_size())
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in numbers]
        self.numbers = {library.id_to_piece(i): i for i in numbers if not special[i]}
        self.scores = {piece: library.get_score(i) for piece, i in self.numbers.items()}
        if any(library.is_unused(i) for i in numbers) or any(
            "\n" in piece or SPACE in piece.lstrip(SPACE) for piece in self.numbers
        ):
            raise ValueError("only vocabularies whose pieces begin with their spaces are supported")
        self.byte_ids = [library.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.numbers:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.reached = Memo(lambda piece: self.merge(piece) == [piece])
        self.compatible = Memo(lambda pair: self.merge(pair[0] + pair[1]) == [*pair], 1_000_000)
        self.chunks = Memo(self._chunk)

    def merge(self, text: str) -> list[str]:
        """Merge the neighbours whose piece scores best, leftmost first, until none is a piece."""
        symbols = list(text)
        while True:
            best, place = None, 0
            for here in range(len(symbols) - 1):
                score = self.scores.get(symbols[here] + symbols[here + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, here
            if best is None:
                return symbols
            symbols[place : place + 2] = [symbols[place] + symbols[place + 1]]

    def last_tokens(self, chunk: str) -> list[str]:
        """For each prefix the last token of its encoding; a character alone where no piece ends."""
        last: list[str | None] = [None] * (len(chunk) + 1)
        reached, compatible = self.reached, self.compatible
        for end, piece in self.automaton.iter(chunk):
            stop = end + 1
            if last[stop] is None and reached[piece]:
                start = stop - len(piece)
                if not start or compatible[last[start] or chunk[start - 1], piece]:
                    last[stop] = piece
        return [token or chunk[place - 1 : place] for place, token in enumerate(last)]

    def tokens(self, chunk: str) -> list[str]:
        last, stop, found = self.last_tokens(chunk), len(chunk), []
        while stop:
            found.append(last[stop])
            stop -= len(last[stop])
        return found[::-1]

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for token in self.tokens(chunk):
            number = self.numbers.get(token)
            ids.extend([self.byte_ids[byte] for byte in token.encode()] if number is None else [number])
        return little_endian(ids)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        spaced = SPACE + text.replace(" ", SPACE)
        encoded = b"".join(map(self.chunks.__getitem__, CHUNKS(spaced)))
        for memo in (self.chunks, self.compatible):
            memo.trim()
        return encoded


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and model file."""
    return PieceEncoder(path)


def piece_batches(model: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        library = encoder.processor
        begin, end = little_endian([library.bos_id()]), little_endian([library.eos_id()])
        for batch in batches:
            encoded, decoded = [], []
            for text in byte_strings(batch.column("text")):
                ids = begin + encoder.ids(text.decode("utf-8", "replace")) + end
                encoded.append(ids)
                decoded.append(library.decode(np.frombuffer(ids, "<u4").tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(encoded, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return encode


def encode_and_decode(
    documents: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, ids, decoded)``: all ids with begin and end, as little-endian unsigned 32-bit
    integers, and the text that the library decodes from them."""
    return texts(documents, id_column, text_column).mapInArrow(
        piece_batches(model), "doc_id bigint, ids binary, decoded string"
    )

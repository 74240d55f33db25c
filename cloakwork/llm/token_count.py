"""Token counts of a unigram tokenizer by a Viterbi pass that carries counts only.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character. For each end the best score and
the piece count of the path that reaches it are kept, and nothing else: no lattice, no back pointers.

Tie rule of the tokenizer: starts are tried from left to right and only a strictly better score replaces a path, so of
equal scores the path whose last piece is longest stays. A character that no piece covers costs the smallest score less
10 and, with byte fallback, counts one token for each of its UTF-8 bytes.

Texts are normalised as the model files ask: each space is U+2581, and one is put before the text. Where two neighbouring
bytes stand side by side in no piece, every path has a bound, so the best paths of the chunks between such places add up
to the best path of the text; each distinct chunk is solved once while it is remembered.

Defined results: null and empty texts have 0 tokens; rows of equal ids or texts each get a row, an empty table none; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import ChunkStore, blocks, summed
from .common import released, spread

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CHUNKS = 1_390_000


class CountViterbi:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, score in pieces:
            if p:
                self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown, self.byte_fallback = min(s for _, s in pieces) - UNKNOWN_PENALTY, byte_fallback
        self.store = ChunkStore(lambda chunks: [[self.count_chunk(c.decode())] for c in chunks], np.int64, CHUNKS)
        self.bound = np.ones((256, 256), bool)  # whether a piece always ends between these two bytes
        self.bound[:, 0x80:0xC0] = False  # inside a character
        self.bound[:, 0xE2] = self.bound[0x81] = False  # U+2581 itself, in a text
        for p, _ in pieces:
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            self.bound[raw[:-1], raw[1:]] = False

    def count_chunk(self, chunk: str) -> int:
        chunk = chunk.replace(" ", SPACE)
        n, unknown = len(chunk), self.unknown
        # Ends rise along the automaton's matches, and at one end they come from long to short: by start from the left.
        score, count, done = [0.0] + [None] * n, [0] * (n + 1), 0
        for end, (size, value) in self.automaton.iter(chunk):
            while done <= end - 1:  # ends without a piece, and unknown characters
                done += 1
                self._unknown(chunk, score, count, done, unknown)
            start = end + 1 - size
            if (now := score[end + 1]) is None or score[start] + value > now:
                score[end + 1], count[end + 1] = score[start] + value, count[start] + 1
        while done < n:
            done += 1
            self._unknown(chunk, score, count, done, unknown)
        return count[n]

    def _unknown(self, chunk, score, count, end, unknown) -> None:
        """Closes an end: a character that is no piece of its own may be unknown."""
        if chunk[end - 1] in self.automaton:
            return
        if (now := score[end]) is None or score[end - 1] + unknown > now:
            score[end], count[end] = score[end - 1] + unknown, count[end - 1] + (len(chunk[end - 1].encode()) if self.byte_fallback else 1)

    def count_column(self, column: pa.Array) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for _, n, data, offsets in blocks(pc.binary_join_element_wise(pa.scalar(""), column.fill_null(""), pa.scalar(" "))):
            cut = np.ones(len(data), bool)
            cut[1:] = self.bound[data[:-1], data[1:]]
            cut[offsets[:-1]] = True
            starts = np.flatnonzero(cut)
            counts, _ = self.store.gather(self.store.codes(data, starts, np.append(starts[1:], len(data))))
            each = summed(counts, np.searchsorted(starts, offsets))
            found.append(np.where(np.diff(offsets) > 1, each, 0))
        return np.concatenate(found)

    def count(self, text: str | None) -> int:
        return int(self.count_column(pa.array([text], pa.string()))[0])


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


@lru_cache(4)
def counter(model_path: str, byte_fallback: bool) -> CountViterbi:
    return CountViterbi(pieces_of(model_path), byte_fallback)


def count_tokens(docs: DataFrame, model_path: str, *, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id and n_tokens. No shuffle; a worker holds the automaton and a bounded memo."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path, byte_fallback).count_column
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1)), pa.int64())], ["id", "n_tokens"])

    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("id", id_col)

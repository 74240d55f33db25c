"""Byte-level BPE encoding and decoding in linear time.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds every token
at every place of a piece. The piece is then covered from the left by longest matches. A step is kept when the new
token is *compatible* with the one before it, that is when the merges turn the two tokens' bytes into exactly
these two tokens; adjacent compatibility everywhere is necessary and sufficient for the merges' own result. Where no
match fits, the place is closed and the step before is taken back, so no place is tried twice with the same token.
Compatibility is memoised by pair.

Defined results: null and empty texts have no ids; ids of a text depend on nothing else; every text decodes to its
own UTF-8 bytes; lone surrogates cannot occur in Spark strings; rows of equal ids or texts each get a row, an empty table none; other columns are
left out. A rank file must hold all 256 single bytes. Texts are cut into chunks only for patterns that the cuts are known to be right for; with
another pattern a chunk is a whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import CUT_PATTERNS, ChunkStore, blocks, pretoken_cuts, whole_texts
from .common import Memo, released, spread

#: Entries of the memos that one Python worker holds.
CHUNKS, PAIRS, PIECES = 600_000, 400_000, 20_000


class ByteBPE:
    def __init__(self, ranks_path: str, pattern: str):
        import ahocorasick
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.token[r] = t
        self.size = [len(t) for t in self.token]
        self.compatible = _Pairs(self._fits, PAIRS)
        # tokens that merges never make cover whole pieces only
        made = {t: r for t, r in self.ranks.items() if len(t) == 1 or self.merged(t) == [r]}
        self.shorter = [-1] * len(self.token)  # the longest token that begins this one
        self.automaton = ahocorasick.Automaton()
        for t, r in made.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, r))
            self.shorter[r] = next((made[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made), -1)
        self.automaton.make_automaton()
        self.findall = regex.compile(pattern).findall
        self.cuts = pretoken_cuts if pattern in CUT_PATTERNS else whole_texts
        self.piece = Memo(self._piece, PIECES)
        self.store = ChunkStore(self._solve, np.uint32, CHUNKS)

    def merged(self, data: bytes) -> list[int]:
        """The merges by definition, quadratic: the pair of lowest rank first, the leftmost of equals."""
        parts, get, none = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 60
        joint = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while joint and (best := min(joint)) < none:
            i = joint.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(joint):
                joint[i] = get(parts[i] + parts[i + 1], none)
        ranks = self.ranks
        return [ranks[p] for p in parts]

    def _fits(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.merged(self.token[a] + self.token[b]) == [a, b]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, size, shorter, compatible = len(data), self.size, self.shorter, self.compatible
        longest = [0] * n
        for end, (less, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - less] = rank  # ends rise, so the longest match at a place comes last
        closed = bytearray(n + 1)
        path: list[int] = []
        place, last, rank = 0, -1, longest[0]
        while True:
            while rank >= 0 and (closed[place + size[rank]] or last >= 0 and not compatible[last << 32 | rank]):
                rank = shorter[rank]
            if rank >= 0:
                path.append(rank)
                place += size[rank]
                if place == n:
                    return path
                last, rank = rank, longest[place]
            else:
                closed[place] = 1
                rank = path.pop()
                place -= size[rank]
                last = path[-1] if path else -1

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def _solve(self, chunks: list[bytes]) -> list[np.ndarray]:
        piece, findall = self.piece, self.findall
        return [np.frombuffer(b"".join([piece[p] for p in findall(c.decode())]), "<u4") for c in chunks]

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts are cut where a match of the pattern always begins; each distinct chunk is encoded once while it is remembered.
        """
        for _, _, data, offsets in blocks(column):
            starts, ends = self.cuts(data, offsets)
            ids, sizes = self.store.gather(self.store.codes(data, starts, ends))
            raw, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)] * 4
            for i, j in zip(at.tolist(), at.tolist()[1:], strict=False):
                yield raw[i:j]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_column(pa.array([text], pa.string())))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pairs(dict):
    def __init__(self, function, limit):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, pair):
        if len(self) >= self.limit:
            self.clear()
        value = self[pair] = self.function(pair)
        return value


@lru_cache(4)
def encoder(ranks_path: str, pattern: str) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ids as binary (unsigned 32-bit, little-endian) and n_tokens. No shuffle."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for b in batches:
            ids = list(bpe.encode_column(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["id", "ids", "n_tokens"])

    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, ids binary, n_tokens long").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """The inverse of encode_documents: id and the bytes that the ids stand for."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x) for x in b.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    d = encoded.select(encoded[id_col].alias("id"), "ids")
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass over it and keeps n_tokens and digests of the ids and of the decoded bytes."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_column(b.column(1)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

"""Token ids in grammar-compressed binary shards with random access.

Encoding. Texts go through the tokenizers library, with its defaults; an end id follows each document. Texts are cut where the vocabulary's
pre-tokenizer always begins a piece, each distinct chunk is encoded once while the worker remembers it, and the ids are gathered. New
chunks go to the library a few at a time, with a word between them whose one id no chunk can give, as a call for each costs more than its pieces. A text that holds the
string of an added token, which the library takes out first, goes to it whole, and so does every text where the file's pre-tokenizer isn't one
that the cuts are known to be right for. With `special_as_text` the strings of special tokens are ordinary text.

Shards. Documents are range-partitioned by id, so shards in (partition, number) order hold ascending ids. Each shard of
about `shard_tokens` ids is compressed by Re-Pair: in each round the id pairs that occur most often are replaced by new
symbols (nonterminals), from left to right without overlap, and the next round works on the shorter sequence, until no
pair occurs `least` times, the symbols of 16 bits are used up, or `rounds` rounds are over. A round replaces all pairs of at least a
sixteenth of the top count at once. Ids are 16 bits wide; a tokenizer with more is refused.

Format of a shard (little-endian): magic `RPT1`; u32 documents, u64 ids, u32 rules, u32 symbols, u32 first nonterminal;
i64 doc ids; u8 flags (1: the id is null); u64 offsets of the documents (documents + 1); u16 pairs of the rules; u32 expansion
lengths of the rules; u16 symbols; u32 CRC-32 of all before. Expansion lengths give each symbol's place in the expanded ids, so a range
is decoded by expanding only the symbols that cover it. Shards lie as rows of a Parquet table (partition, shard, start
within the partition, least and greatest doc id, blob) in the shared folder, written by Spark's own committer: a lost executor
costs a retry, never half a file.

Defined results: null and empty texts hold the end id alone; rows with equal or null doc ids all stay (null first; ties by the text's
hash, equal rows in any order); other columns are left out. An empty table gives no shard.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import DROPS_WHITE_SPACE, ChunkStore, blocks, gathered, pretoken_cuts
from .common import released, small_batches

MAGIC, HEAD = b"RPT1", struct.Struct("<4sIQIII")
SYMBOLS, CHUNKS = 1 << 16, 1_390_000
#: A word between chunks, a control character, and how many chunks are encoded together.
MARK, TOGETHER = b"\x01", 16
SHARD_SCHEMA = "part int, shard int, start_in_part long, n_docs int, n_tokens long, first_id long, last_id long, blob binary"


class ChunkEncoder:
    """Encodes by the library, each distinct chunk once while it is remembered."""

    def __init__(self, tokenizer_path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would take those of others
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = special_as_text
        #: Strings that the library takes out of a text before anything else; a text that holds one goes to it whole.
        self.taken_out = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.highest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.cuts = pretoken_cuts if _pattern_of(tokenizer_path) in DROPS_WHITE_SPACE else None
        between = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        #: The id of the mark, if it is a single one.
        self.mark = between[0] if len(between) == 1 else None
        self.store = ChunkStore(self._solve, np.uint32, CHUNKS)

    def _solve(self, chunks: list[bytes]) -> list | tuple[np.ndarray, np.ndarray]:
        if self.mark is None or any(MARK in c for c in chunks):
            return [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        joined = [((b" " + MARK + b" ").join(chunks[i : i + TOGETHER]) + b" " + MARK).decode() for i in range(0, len(chunks), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        at = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(at, prepend=-1) - 1  # a mark closes each chunk

    def encode_column(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, ids, number of ids of each text) of consecutive slices; an end id closes each text. Null is empty."""
        column = column.fill_null("")
        whole = np.full(len(column), self.cuts is None)
        for t in self.taken_out:
            whole |= np.asarray(pc.match_substring(column, t))
        edge = np.flatnonzero(np.concatenate([[True], whole[1:] | whole[:-1], [True]])) if len(column) else np.zeros(1, np.int64)
        for at, to in zip(edge.tolist(), edge.tolist()[1:], strict=False):
            if whole[at]:
                ids = [*self.tokenizer.encode(column[at].as_py(), add_special_tokens=False).ids, end_id]
                yield at, 1, np.array(ids, np.uint32), np.array([len(ids)])
            else:
                for lo, n, data, offsets in blocks(column.slice(at, to - at)):
                    yield at + lo, n, *self.encode(data, offsets, end_id)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text with its end id, of texts without a string that is taken out."""
        starts, ends = self.cuts(data, offsets)
        blank = ends - starts == 1
        blank[blank] = np.isin(data[starts[blank]], _BLANK)
        spaced = data[starts] == 32  # white space is dropped: a chunk is the same with and without the space before it
        starts, ends = (starts + (spaced & ~blank))[~blank], ends[~blank]
        ids, sizes = self.store.gather(self.store.codes(data, starts, ends))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets[1:])]
        return np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1


def _pattern_of(tokenizer_path: str) -> str | None:
    """The one pattern that a tokenizer file cuts texts by, None if it cuts in another way."""
    with open(tokenizer_path, encoding="utf-8") as f:
        how = json.load(f).get("pre_tokenizer") or {}
    steps = how.get("pretokenizers", [how])
    patterns = [s["pattern"].get("Regex") for s in steps if s.get("type") == "Split"]
    plain = all(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" or s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps)
    return patterns[0] if plain and len(patterns) == 1 else None


_BLANK = np.array([9, 10, 11, 12, 13, 32], np.uint8)


def compress(ids: np.ndarray, base: int, least: int = 8, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: rules as pairs of symbols, and the sequence that is left. `rounds` bounds the effort, as a level does; it changes the size, never the ids."""
    if not 0 < base < SYMBOLS or len(ids) and int(ids.max()) >= base:
        raise ValueError("ids must lie below base, and base below 65536")
    seq, rules, n_rules = ids.astype(np.uint16), [], 0
    multiplier, bits = np.uint32(2654435769), np.uint32(14)
    for _ in range(rounds):
        room = SYMBOLS - base - n_rules
        if len(seq) < 2 or room <= 0:
            break
        keys = seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:]
        in_order = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        counts = np.diff(np.append(edge, len(in_order)))
        if (top := int(counts.max())) < least:
            break
        frequent = np.flatnonzero(counts >= max(least, top // 16))
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")][:room]
        pairs = in_order[edge[frequent]]
        slot = (pairs * multiplier) >> bits  # pairs that share a slot wait for a later round
        _, kept = np.unique(slot, return_index=True)
        pairs, slot = pairs[np.sort(kept)], slot[np.sort(kept)]
        of_slot = np.zeros(1 << 18, np.uint32)
        number = np.zeros(1 << 18, np.uint16)
        of_slot[slot], number[slot] = pairs, np.arange(len(pairs), dtype=np.uint16)
        of_slot[slot[pairs == 0]] = 0
        at = (keys * multiplier) >> bits
        hit = of_slot[at] == keys
        if not (pairs == 0).any():
            hit &= keys != 0
        where = np.flatnonzero(hit)
        run = np.concatenate([[True], where[1:] != where[:-1] + 1])
        run_start = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))]
        where = where[(where - run_start) % 2 == 0]  # of overlapping places every second, from the left
        used = number[at[where]]
        tally = np.bincount(used, minlength=len(pairs))
        good = tally >= 2
        new = np.cumsum(good) - 1
        where, used = where[good[used]], used[good[used]]
        if not len(where):
            break
        rules.append(pairs[good])
        seq[where] = (base + n_rules + new[used]).astype(np.uint16)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        n_rules += int(good.sum())
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    return np.stack([flat >> np.uint32(16), flat & np.uint32(0xFFFF)], 1).astype(np.uint16), seq


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule only uses rules before it."""
    size = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist(), base):
        size[i] = size[a] + size[b]
    return size[base:]


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    rules, seq = compress(ids, base)
    body = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(rules), len(seq), base) + b"".join(
        x.tobytes() for x in (
            np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8"),
            rules.astype("<u2"), expansions(rules, base).astype("<u4"), seq.astype("<u2"),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard that was read: document ids and random access to ids."""

    def __init__(self, blob: bytes):
        magic, n_docs, self.n_tokens, n_rules, n_seq, self.base = HEAD.unpack_from(blob)
        if magic != MAGIC or zlib.crc32(memoryview(blob)[:-4]) != struct.unpack("<I", blob[-4:])[0]:
            raise ValueError("not a whole token shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, n, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.offsets = take("<u8", n_docs + 1).astype(np.int64)
        self.rules = take("<u2", 2 * n_rules).reshape(-1, 2)
        self.rule_size = take("<u4", n_rules).astype(np.int64)
        self.seq = take("<u2", n_seq)
        self.size = np.concatenate([np.ones(self.base, np.int64), self.rule_size])
        self.ends = np.cumsum(self.size[self.seq])
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of all symbols, flat, and where each begins."""
        if self.table is None:
            begin = np.cumsum(self.size) - self.size
            flat = np.empty(int(self.size.sum()), np.uint16)
            flat[: self.base] = np.arange(self.base)
            starts, sizes = begin.tolist(), self.size.tolist()
            for i, (a, b) in enumerate(self.rules.tolist(), self.base):
                s, m = starts[i], sizes[a]
                flat[s : s + m] = flat[starts[a] : starts[a] + m]
                flat[s + m : s + sizes[i]] = flat[starts[b] : starts[b] + sizes[b]]
            self.table = flat, begin
        return self.table

    def range(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop]; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint16)
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop - 1, "right") + 1
        flat, begin = self._expansions()
        seq = self.seq[i:j]
        skip = start - (int(self.ends[i - 1]) if i else 0)
        return gathered(flat, begin[seq], self.size[seq])[skip : skip + stop - start]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.offsets[k]), int(self.offsets[k + 1]))


@lru_cache(2)
def chunk_encoder(tokenizer_path: str, special_as_text: bool = False) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_path, special_as_text)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 1, base: int | None = None, special_as_text: bool = False, shard_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes their shards to path. base: the first nonterminal, above all ids (the next one, if not given) and below 65536."""
    highest = max(end_id, chunk_encoder(tokenizer_path, special_as_text).highest)
    base = highest + 1 if base is None else base
    if not highest < base < SYMBOLS:
        raise ValueError(f"ids up to {highest} don't fit below the first nonterminal {base} in 16 bits")
    small_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard, start = chunk_encoder(tokenizer_path, special_as_text), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, start
            doc_ids = [i for x in held for i in x[0]]
            sizes, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held.clear()
            known = [i for i in doc_ids if i is not None]
            row = [part, shard, start, len(doc_ids), len(ids), min(known, default=None), max(known, default=None), pack(doc_ids, sizes, ids, base)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            shard, start = shard + 1, start + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        for b in batches:
            for lo, n, ids, sizes in encoder.encode_column(b.column(1), end_id):
                held.append((b.column(0).slice(lo, n).to_pylist(), sizes, ids))
                if sum(len(x[2]) for x in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str, *, ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """A row per stored document: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, its ids.

    The driver adds up one number per partition of the writing job; everything else stays in the executors.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    base, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r["part"]], total = total, total + r["n"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, blob in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                s = Shard(blob)
                all_ids = s.range(0, s.n_tokens).astype("<u4")
                at = s.offsets.tolist()
                each = [all_ids[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
                out = [pa.array(s.doc_ids, pa.int64()), pa.array(base[part] + start + s.offsets[:-1], pa.int64()), pa.array(np.diff(s.offsets), pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(each, pa.binary())] if ids else out, [*names, "ids"] if ids else names)

    return shards.select("part", "start_in_part", "blob").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids).withColumnRenamed("id", id_col)


def read_some(spark: SparkSession, path: str, doc_ids: list[int], *, id_col: str = "doc_id") -> DataFrame:
    """Random access: the ids of the documents asked for. Only shards whose id range can hold one are read, and only the symbols that cover it are expanded."""
    wanted = sorted(set(doc_ids))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                s, ask = Shard(blob), set(wanted)
                found = [(i, s.document(k).astype("<u4").tobytes()) for k, i in enumerate(s.doc_ids) if i in ask]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["id", "ids"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    near = F.lit(False)
    for lo in range(0, len(wanted), 64):  # a few ranges, so that the filter stays small; Parquet prunes by it
        some = wanted[lo : lo + 64]
        near = near | ((F.col("first_id") <= some[-1]) & (F.col("last_id") >= some[0]))
    return shards.filter(near).select("blob").mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)

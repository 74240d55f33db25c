"""Operators 1, 2 and 6 against the tokenizer libraries."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm import byte_bpe, chunks, token_count, token_shards
from cloakwork.llm.chunks import gathered, hashes, runs
from cloakwork.llm.common import fresh_path
from cloakwork.llm.queries import BYTE_BPE, PIECES, WORD_BPE, pattern, vocabulary

ODD = [None, "", " ", "  ", "x", " x", "x ", "a  b", "\n", "a\n\nb", "'s it's", "<|endoftext|>", "hello <|endoftext|> world <|startoftext|>", "x<|ENDOFTEXT|>y", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "a ́b", "日本語テキスト", "😀😀 x", "\x00\x01", "▁▁a ▁", "aaaa" * 2000, "é à ñ", "x y", "1234567 89"]
TEXT = st.lists(st.sampled_from([*" \n\t\r  aAbBé中😀1'st!~<|>ΣÅ　\x1c\x85▁.", "<|endoftext|>", "<|startoftext|>"]), max_size=24).map("".join)


@pytest.fixture(scope="session")
def library():
    import tiktoken

    with open(vocabulary(BYTE_BPE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="session")
def words_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORD_BPE))


@pytest.fixture(scope="session")
def unigram():
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram([("<unk>", 0.0), *token_count.pieces_of(vocabulary(PIECES))], unk_id=0, byte_fallback=False))
    t.normalizer = normalizers.Sequence([normalizers.Replace(" ", token_count.SPACE), normalizers.Prepend(token_count.SPACE)])

    def count(text):
        e = t.encode(text or "")
        return sum(len(tok.encode()) if i == 0 else 1 for i, tok in zip(e.ids, e.tokens, strict=True))

    return count


def bpe():
    return byte_bpe.encoder(vocabulary(BYTE_BPE), pattern())


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=6))
def test_byte_bpe_equals_library(library, texts):
    """Texts of a batch stand side by side in one array: none may leak into another."""
    for t, ids in zip(texts, bpe().encode_column(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert bpe().decode(ids).decode() == t


def test_byte_bpe_by_definition():
    e, r = bpe(), random.Random(3)
    for _ in range(300):
        piece = bytes(r.choice(b"abtheringion \xc3\xa9") for _ in range(r.randint(1, 24)))
        assert e.encode_piece(piece) == ([e.ranks[piece]] if piece in e.ranks else e.merged(piece))


def test_op6_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, "x", "y"), (None, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = byte_bpe.digests(docs, vocabulary(BYTE_BPE), pattern()).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert byte_bpe.digests(docs.limit(0), vocabulary(BYTE_BPE), pattern()).collect() == []
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, vocabulary(BYTE_BPE), pattern()), vocabulary(BYTE_BPE), pattern())
    assert sorted(bytes(r.decoded).decode() for r in both.collect()) == sorted(t or "" for _, t, _ in rows)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=6))
def test_counts_equal_unigram_tokenizer(unigram, texts):
    c = token_count.counter(vocabulary(PIECES), True)
    assert c.count_column(pa.array(texts)).tolist() == [unigram(t) for t in texts]


def test_ties_and_unknowns():
    c = token_count.CountViterbi([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -9.0), ("▁", 0.0)])
    assert c.count("ab") == 2  # of equal scores the path whose last piece is longest: ▁ and ab
    assert c.count("é") == 3 and c.count("") == c.count(None) == 0
    by_char = token_count.CountViterbi([("a", -1.0), ("▁", 0.0)], byte_fallback=False)
    assert by_char.count("aé") == 3


def brute_viterbi(pieces, text):
    """All segmentations by recursion over prefixes, the rule stated plainly."""
    s, low = "▁" + text.replace(" ", "▁"), min(pieces.values()) - token_count.UNKNOWN_PENALTY
    best = [(0.0, 0)] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(end):
            p = s[start:end]
            score = pieces.get(p, low if end - start == 1 else None)
            if score is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                best[end] = best[start][0] + score, best[start][1] + (1 if p in pieces else len(p.encode()))
    return best[-1][1]


def test_counts_by_definition():
    r = random.Random(5)
    pieces = {"▁": -3.0, **{"".join(r.choice("abc▁" if k == 0 else "abc") for k in range(r.randint(1, 4))): -float(r.randint(1, 6)) for _ in range(40)}}
    c = token_count.CountViterbi(list(pieces.items()))
    for _ in range(400):
        t = "".join(r.choice("abcd  ") for _ in range(r.randint(1, 20)))
        assert c.count(t) == brute_viterbi(pieces, t), t


def test_op1_query(spark, unigram):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, vocabulary(PIECES)).collect()}
    assert got == {i: unigram(t) for i, t in enumerate(ODD)}


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=6))
def test_chunk_encoder_equals_library(words_tokenizer, texts):
    e = token_shards.chunk_encoder(vocabulary(WORD_BPE))
    found = list(e.encode_column(pa.array(texts), 1))
    ids, sizes = (np.concatenate([x[k] for x in found]) for k in (2, 3))
    want = [x.ids + [1] for x in words_tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(6, 9))
def test_repair_round_trip(ids, base):
    a = np.array(ids, np.uint32)
    s = token_shards.Shard(token_shards.pack([1], np.array([len(a)]), a, base))
    assert s.range(0, s.n_tokens).tolist() == ids
    for lo, hi in ((0, 1), (3, 17), (len(ids) - 2, len(ids))):
        if 0 <= lo < hi <= len(ids):
            assert s.range(lo, hi).tolist() == ids[lo:hi]
    assert token_shards.expansions(s.rules, base).tolist() == s.rule_size.tolist()


def test_repair_compresses():
    a = np.tile(np.arange(50, dtype=np.uint32), 400)
    rules, seq = token_shards.compress(a, 50)
    assert len(seq) < len(a) / 20 and len(rules)


def test_damaged_shard():
    blob = bytearray(token_shards.pack([1], np.array([3]), np.array([1, 2, 3], np.uint32), 50))
    blob[40] ^= 1
    with pytest.raises(ValueError, match="whole"):
        token_shards.Shard(bytes(blob))


def test_op2_files(spark, words_tokenizer):
    rows = [(i * 3, t, 1) for i, t in enumerate(ODD)] + [(6, "again", 2), (None, "none", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = fresh_path(spark, "t")
    token_shards.write_shards(docs, path, vocabulary(WORD_BPE), shard_tokens=40)
    got = sorted(token_shards.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    place = 0
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(words_tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids in texts[r.doc_id] and r.start == place and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        place += len(ids)
    some = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_shards.read_some(spark, path, [9, 27, 10**9]).collect()}
    assert some == {9: texts[9][0], 27: texts[27][0]}
    empty = fresh_path(spark, "t")
    token_shards.write_shards(docs.limit(0), empty, vocabulary(WORD_BPE))
    assert token_shards.read_documents(spark, empty).count() == 0


def test_chunk_helpers():
    data = np.frombuffer("añb  cd".encode(), np.uint8)
    s, e = runs(data != 32, np.array([0, 2, len(data)]))
    assert [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [b"a\xc3", b"\xb1b", b"cd"]
    h = hashes(data, np.array([0, 0, 1]), np.array([1, 2, 2]))
    assert len(set(h.tolist())) == 3 and (h == hashes(np.concatenate([data[:2], data]), np.array([2, 2, 3]), np.array([3, 4, 4]))).all()
    assert gathered(np.arange(10), np.array([7, 0, 3]), np.array([2, 0, 3])).tolist() == [7, 8, 3, 4, 5]


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


#: Two words that a polynomial hash modulo 2**64 can't tell apart, whatever its base.
ALIKE = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048)]


@pytest.fixture(params=["hashes", "one hash for all"])
def hashing(request, monkeypatch):
    """Results must not depend on hashes: they are the same if all chunks of more than SHORT bytes collide."""
    if request.param != "hashes":
        monkeypatch.setattr(chunks, "long_hashes", lambda data, starts, ends, words: np.full(len(starts), 7 << 9, np.uint64))
    return request.param


COLLIDING = [f"{a} {b} {a[:9]} {b[:9]} antidisestablishment antidisestablishmenu" for a, b in ALIKE] + [b for _, b in ALIKE] + [a for a, _ in ALIKE]


def test_keys_of_short_chunks_are_their_own():
    every = [bytes(x) for n in (1, 2) for x in itertools.product(range(0, 256, 5), repeat=n)] + [b"a" * n for n in range(1, 12)] + [b"\0" * n for n in range(1, 8)]
    data, ends = np.frombuffer(b"".join(every), np.uint8), np.cumsum([len(x) for x in every])
    keys = hashes(data, ends - [len(x) for x in every], ends)
    assert len(set(keys.tolist())) == len(set(every)) and (keys != 0).all()


def test_distinct_and_store(hashing):
    words = [w for t in COLLIDING for w in t.split()] * 3 + ["x"]
    data, ends = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    number, first = chunks.distinct(data, starts, ends)
    assert [words[first[k]] for k in number] == words and len(first) == len(set(words))
    solved = []
    store = chunks.ChunkStore(lambda c: solved.extend(c) or [[len(x), x[0]] for x in c], np.int64, 40)
    for _ in range(2):
        values, sizes = store.gather(store.codes(data, starts, ends))
        assert values.reshape(-1, 2).tolist() == [[len(w), ord(w[0])] for w in words]
    assert sorted(solved) == sorted({w.encode() for w in words})  # each is solved once
    text = np.repeat([0, 1], [5, len(words) - 5])
    keys, eights = hashes(data, starts, ends), chunks.words_at(data)
    assert chunks.distinct_per_text(data, starts, ends, keys, eights, text, 2).tolist() == [len(set(words[:5])), len(set(words[5:]))]


def test_colliding_words_in_tokenizers(hashing, library, words_tokenizer, unigram):
    column = pa.array(COLLIDING)
    e = byte_bpe.ByteBPE(vocabulary(BYTE_BPE), pattern())
    for _ in range(2):
        ids = list(e.encode_column(column))
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in COLLIDING]
        assert [e.decode(x).decode() for x in ids] == COLLIDING
    found = list(token_shards.ChunkEncoder(vocabulary(WORD_BPE)).encode_column(column, 1))
    assert np.concatenate([x[2] for x in found]).tolist() == [i for t in COLLIDING for i in [*words_tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    assert token_count.CountViterbi(token_count.pieces_of(vocabulary(PIECES))).count_column(column).tolist() == [unigram(t) for t in COLLIDING]


def test_other_patterns_are_not_cut(library):
    import tiktoken

    other = r"\S+\s*|\s+"  # pre-tokens that hold the space after them
    e = byte_bpe.ByteBPE(vocabulary(BYTE_BPE), other)
    want = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    texts = ["a bc  d.e f", "x", "", "It's so; is it?\n\n no"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_column(pa.array(texts))] == [want.encode_ordinary(t) for t in texts]


def test_ids_must_fit(spark):
    with pytest.raises(ValueError, match="below"):
        token_shards.compress(np.array([1, 70_000], np.uint32), 50_000)
    with pytest.raises(ValueError, match="fit"):
        token_shards.write_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), fresh_path(spark, "t"), vocabulary(WORD_BPE), base=40_000)


def test_chunks_that_hold_the_mark(words_tokenizer):
    """New chunks are encoded together with a mark between them; texts with that mark, and marks that accents follow, come out as from the library."""
    texts = ["x\x01y \x01 z", "\x01", "q \x01", "e \u0301a \x01 \u0301", "\x01\x01 \x01", "plain words, then 12.5 of \u03a3\u0391\u03a3 ", *(f"w{i} v{i}" for i in range(40))]
    for some in (texts, texts[5:], texts[::-1]):
        e = token_shards.ChunkEncoder(vocabulary(WORD_BPE))
        assert e.mark is not None
        found = np.concatenate([x[2] for x in e.encode_column(pa.array(some), 1)]).tolist()
        assert found == [i for t in some for i in [*words_tokenizer.encode(t, add_special_tokens=False).ids, 1]]


def test_special_strings_as_text(words_tokenizer):
    """Asked for, the strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(WORD_BPE))
    t.encode_special_tokens = True
    texts = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>", "x"]
    found = list(token_shards.ChunkEncoder(vocabulary(WORD_BPE), special_as_text=True).encode_column(pa.array(texts), 1))
    assert np.concatenate([x[2] for x in found]).tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 1]]


def test_op1_edges(spark, unigram):
    """Repeated rows, equal and null ids, columns named like the result's, a very long word and text, an empty table."""
    rows = [(1, "a b", 9), (1, "a b", 9), (None, "c", 0), (2, None, 1), (3, "word " * 40_000, 2), (4, thue_morse(100_000), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_count.count_tokens(docs, vocabulary(PIECES))
    assert got.columns == ["doc_id", "n_tokens"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, unigram(t))) for i, t, _ in rows)
    assert token_count.count_tokens(docs.limit(0), vocabulary(PIECES)).count() == 0

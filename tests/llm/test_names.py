"""Words and pieces that simple hashes confuse: strings of Thue and Morse and their complements."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import brute
from vicinal.llm import dac, line_dedup, ngram_join, prefix_bpe, pretokens, suffix_arrays, textcore

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def morse(n: int, letters: str = "ab") -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


SIZES = (1024, 2048, 4096)
PAIRS = [(morse(n, a + b), morse(n, b + a)) for n in SIZES for a, b in ("ab", "0z", "éß")]


def test_words_have_names_of_their_own():
    words = [w for pair in PAIRS for w in pair] + [w[:k] for w in PAIRS[0] for k in (1, 7, 8, 9, 15, 16, 17, 31, 64)]
    words = sorted(set(words))
    assert len({int(textcore.word_hash(w)) for w in words}) == len(words)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    together = textcore.Words(data, np.array([0, len(data)])).hash
    assert together.tolist() == [int(textcore.word_hash(w)) for w in words]
    assert textcore.word_hash("ABC") == textcore.word_hash("abc")


def test_beginnings():
    found = textcore.Words(np.frombuffer(b"abcdef abcdx abcd", np.uint8), np.array([0, 17]))
    which, name = found.beginnings(4)
    assert which.tolist() == [0, 1] and name[0] == name[1] and name[0] != found.hash[2]


def test_join_and_lines(spark):
    rows = [(2 * k + j, " ".join([w] * 6)) for k, pair in enumerate(PAIRS) for j, w in enumerate(pair)]
    rows += [(100 + i, t.replace(" ", " x ")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()} == brute.classes(rows)
    assert {r.doc_id: r.n_removed for r in line_dedup.remove(df).collect()} == {i: 0 for i, _ in rows}


def test_contamination(spark):
    docs = [(k, " ".join([b] * 12)) for k, (_, b) in enumerate(PAIRS)] + [(50, "x " + PAIRS[0][0])]
    items = [(k, " ".join([a] * 10)) for k, (a, _) in enumerate(PAIRS)] + [(60, PAIRS[0][0])]
    found = suffix_arrays.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()} == brute.contamination(docs, items)


def test_pieces_of_one_name_are_told_apart(monkeypatch):
    monkeypatch.setattr(pretokens, "named", lambda a, b, size: np.zeros(len(a), np.uint64))  # all in one place
    memo = pretokens.Memo(lambda pieces: (np.arange(len(pieces)), np.ones(len(pieces), np.int64), np.array([sum(map(ord, p)) * 7 + len(p) for p in pieces], np.uint32)))
    texts = ["ab cd ab", "cd  ab", None, " ".join(PAIRS[0]), " ".join(PAIRS[0][::-1])]
    for _ in range(2):
        pieces = pretokens.Pieces(pa.array(texts, pa.string()))
        ids, first = memo.batch(pieces)
        want = [sum(map(ord, p)) * 7 + len(p) for p in pieces.strings(np.arange(len(pieces.at)))]
        assert ids.tolist() == want and first.tolist() == pieces.first.tolist()


def test_another_pattern_is_refused():
    with pytest.raises(ValueError, match="PATTERN"):
        pretokens.Pieces(pa.array(["a"]), r"\w+")
    assert pretokens.PATTERN == public_tokenizers.PATTERN


def test_ids(spark):
    rows = [(k, t) for k, t in enumerate([x for pair in PAIRS for x in pair] + [" ".join(pair) for pair in PAIRS])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one worker, one table of pieces
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.load_ranks(RANKS), special_tokens={})
    for r in prefix_bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN).collect():
        text = dict(rows)[r.doc_id]
        assert r.decoded_sha256 == sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
    t = Tokenizer.from_file(JSON)
    for r in dac.stored_ids(df, JSON).collect():
        assert r.ids_crc32 == crc32(np.array([*t.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids, 0], "<u4").tobytes())

"""Stored ids and byte-level BPE, against the libraries themselves."""

from __future__ import annotations

import io
import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from vicinal.llm import dac, prefix_bpe
from vicinal.llm.pretokens import Pieces

ODD = [None, "", "   ", "don't  stop 'tis it's''s\n\n x\t y  \n", "a'll've'street 'd", "日本 it's ok  x 😀", "x" * 3000, "é'm ñ ª º ½ ²", " " * 500 + "a", "<|endoftext|>", "12'3's 's!'s", "\u00a0a\u2003b"]
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))


def test_pieces_follow_the_pattern():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "é", " ", "  ", "'", "s", "ll", "\n", "1", "!", "\u00a0", "日"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    p = Pieces(pa.array(texts, pa.string()), public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        assert p.strings(np.arange(p.first[i], p.first[i + 1])) == regex.findall(public_tokenizers.PATTERN, t or "")


def test_stored_ids(spark, sf_dir):
    docs = tables(spark, sf_dir)
    t = Tokenizer.from_file(JSON)
    found = {r.doc_id: r for r in dac.stored_ids(docs, JSON).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = found.pop(r.doc_id)
        assert (own.start, own.n_tokens, own.ids_crc32) == (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not found


def test_stored_ids_of_added_tokens(spark, tmp_path):
    from vicinal.llm.queries import QUERIES

    texts = [*ODD, "end<|endoftext|>start", "<|endoftext|><|endoftext|> é", "<|endoftext|", "日本<|endoftext|>  x", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(JSON)
    found = {r.doc_id: r for r in QUERIES["op4_token_ids"](spark, f"file://{tmp_path}").collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stored_ids_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "b"), (2, "b"), (1, None)], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS part")
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(dac.stored_ids(rows, JSON).collect(), key=lambda r: r.start)] == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]
    assert dac.stored_ids(rows.limit(0), JSON).count() == 0
    least = spark.createDataFrame([(-(1 << 63), "a b"), (None, "c")], "key long, text string")
    assert sorted((r.start, r.key) for r in dac.stored_ids(least, JSON, id_col="key").collect()) == [(0, None), (2, -(1 << 63))]
    with pytest.raises(TypeError, match="integer"):
        dac.stored_ids(rows.selectExpr("cast(doc_id AS string) AS doc_id", "text"), JSON)


def test_stored_ids_of_one_id_and_of_a_long_text(spark):
    texts = [f"t{k}" for k in range(60)] + ["x y " * 200_000, "z" * 300_000]
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    t = Tokenizer.from_file(JSON)
    want = sorted(crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for x in texts)
    found = sorted(dac.stored_ids(rows, JSON).collect(), key=lambda r: r.start)
    assert sorted(r.ids_crc32 for r in found) == want
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])[:-1]]).tolist()


def test_any_token_of_a_file():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 1 << b, 700, dtype=np.uint64) for b in (7, 9, 16, 17, 25, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    file = dac.DacFile(io.BytesIO(dac.to_bytes(np.array([5, 6]), np.array([0, 10, len(ids)]), ids, 0)))
    assert [file.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in ((0, len(ids)), (3, 9), (511, 1030), (len(ids) - 1, len(ids)), (5, 5), (4000, 9999)):
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file.token(len(ids))
    with pytest.raises(ValueError, match="not a file"):
        dac.DacFile(io.BytesIO(bytes(400)))


def test_encode_decode(spark, sf_dir):
    docs = tables(spark, sf_dir)
    v = prefix_bpe.vocabulary_at(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    found = {r.doc_id: r for r in prefix_bpe.encode_decode(docs.selectExpr("*", "1 AS n_tokens", "2 AS ids"), RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for r in docs.collect():
        ids, own = library.encode_ordinary(r.text or ""), found[r.doc_id]
        assert own.ids == ids and own.n_tokens == len(ids)
        assert own.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == sha256((r.text or "").encode()).hexdigest()
    assert prefix_bpe.encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_appends_and_edits():
    v = prefix_bpe.vocabulary_at(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice(["a", "b", "the", " ing", "é", "日", "1", "'s"]) for _ in range(60))
        table, raw = prefix_bpe.PrefixTable(v, s.encode()), s.encode()
        a = rng.randrange(len(raw))
        b = min(len(raw), a + rng.randrange(4))
        table.replace(a, b, b"xyz")
        table.append(b"ing")
        assert table.ids() == v.encode(raw[:a] + b"xyz" + raw[b:] + b"ing")
        text = prefix_bpe.EditableText(v, public_tokenizers.PATTERN, s)
        a = rng.randrange(len(s))
        b, new = min(len(s), a + rng.randrange(5)), rng.choice(["", " ", "'s", "zz  y", "\n"])
        text.replace(a, b, new)
        text.append(" more's")
        assert text.ids() == library.encode_ordinary(s[:a] + new + s[b:] + " more's")


def test_an_edit_is_made_near_it():
    v = prefix_bpe.vocabulary_at(RANKS)
    table = prefix_bpe.PrefixTable(v, b"abcdefgh" * 500)
    before = table.computed
    table.replace(2000, 2001, b"Q")
    assert table.ids() == v.encode(table.data) and table.computed - before < 200

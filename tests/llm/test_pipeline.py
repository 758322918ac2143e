"""The pipeline, stage by stage, against brute force on what each stage gets."""

from __future__ import annotations

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm import brute
from vicinal.llm import prefix_bpe, shared


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == columns or stage is corpus_pipeline.to_token_ids
    start, calm, lines, single, clean, tokens = kept
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic & set(start) - set(calm)) <= 0.05 * len(toxic)
    gone = brute.repeated_lines([(i, r.text) for i, r in calm.items()])
    for i, r in calm.items():
        parts = [x for k, x in enumerate(r.text.split("\n")) if (i, k) not in gone]
        text = "\n".join(parts)
        changed = len(parts) < len(r.text.split("\n"))
        assert (i in lines) == (not changed or bool(brute.words(text)))
        if i in lines:
            assert lines[i].text == text and lines[i].n_chars == (len(text) if changed else r.n_chars)
    assert set(single) == {c for c, _ in brute.classes([(i, r.text) for i, r in lines.items()]).values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, v in brute.contamination([(i, r.text) for i, r in single.items()], items).items() if not v[-1]}
    v = prefix_bpe.vocabulary_at(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert {i: r.ids for i, r in tokens.items()} == {i: library.encode_ordinary(r.text) for i, r in clean.items()}


def test_odd_documents(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeated ids and rows, columns of clashing and dotted names; and no rows at all."""
    real = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").select("doc_id", "text").collect()]
    t = "one two three four five six seven eight nine"
    odd = [(None, None), (None, t), (None, t), (500, None), (501, ""), (502, "!!"), (503, t), (503, t), (503, "ten eleven twelve thirteen"), (504, "word " * 3000)]
    names = ["n_lines", "n_removed", "predicted", "score", "held_out", "n_words", "n_hit", "items", "contaminated", "`a.b`", "c0", "k0", "doc", "row", "id", "lines", "scanned", "class_id", "ids"]
    df = spark.createDataFrame([*real, *odd], "doc_id long, text string").selectExpr("doc_id", "text", "length(text) AS n_chars", "'en' AS lang", *(f"{k} AS {c}" for k, c in enumerate(names)))
    for number, docs in enumerate((df, df.limit(0))):
        top = f"file://{tmp_path}/{number}"
        docs.write.parquet(f"{top}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(f"{top}/{table}.parquet")
        now = spark.read.parquet(f"{top}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            now = shared.cut(stage(spark, now, top), "odd")
            if stage is not corpus_pipeline.to_token_ids:
                assert now.columns == df.columns
                rows = now.collect()
                assert all(tuple(r)[4:] == tuple(range(len(names))) and r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        left = {(r.doc_id, r.n_tokens > 0) for r in now.collect()}
        want = {(None, False), (500, False), (501, False), (502, True)}
        assert want <= left if number == 0 else left == set()
        if number == 0:
            assert sum(r.doc_id == 503 for r in now.collect()) >= 1 and (504, True) in left


def test_run_leaves_only_its_result(spark, sf_dir):
    import os

    top = shared.folder(spark).removeprefix("file://")
    before = set(os.listdir(top))
    rows = corpus_pipeline.run(spark, sf_dir).count()
    made = set(os.listdir(top)) - before
    assert rows > 0 and {x.rsplit("-", 1)[0] for x in made} == {"byte-level-BPE"}


def test_a_broken_import_is_not_hidden(monkeypatch):
    import sys

    import pytest

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "vicinal.llm.queries", None)
    monkeypatch.delitem(sys.modules, "vicinal.llm", raising=False)
    assert "op1_pii" not in __spark_entry__.queries()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "vicinal.llm.queries")
    monkeypatch.setitem(sys.modules, "vicinal.llm.sql", None)
    with pytest.raises(ImportError):
        __spark_entry__.queries()


def test_queries_are_registered():
    import re

    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names


def test_few_partitions_of_stage_results(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(60)
    for stage in (corpus_pipeline.drop_contaminated, corpus_pipeline.to_token_ids):
        assert stage(spark, docs, sf_dir).rdd.getNumPartitions() == 16

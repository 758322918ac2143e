"""Similarity join, line dedup, components."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from vicinal.llm import line_dedup, ngram_join, similar
from vicinal.llm.components import components


def varied(n: int, seed: int = 5, size: int = 70) -> list[tuple[int, str]]:
    """Near copies of three texts, all in one heap, with equal ones among them."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(9999)}" for _ in range(size)] for _ in range(3)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(size)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    return rows


EDGES = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b!"), (1004, "a b c d e"), (1005, "!!"), (1006, "a b c d f")]


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    rows = varied(150) + EDGES
    df = spark.createDataFrame([*rows, (None, "a b"), (3, rows[3][1])], "doc_id long, text string")
    # Columns that the operator uses inside don't disturb it.
    found = ngram_join.join(df.selectExpr("*", "'x' AS id", "1 AS print", "2 AS root", "3 AS size")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found if r.doc_id is not None} == brute.classes(rows)
    assert [(r.class_id, r.n_links) for r in found if r.doc_id is None] == [(None, 0)]
    assert len(found) == len(rows) + 1


def test_join_on_tables_and_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute.classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()} == want
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {c for c, _ in want.values()}
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-5)
    assert least == sorted(least) and least[-1] < 0.8 * ngram_join.HASHES
    # With all values looked at, a pair at 0.8 falls below the last bound once in ten thousand at most.
    from math import comb

    below = sum(comb(128, j) * 0.8**j * 0.2 ** (128 - j) for j in range(least[-1]))
    assert below < 1e-3


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(3)
    lines = [t for _, t in varied(200, 9, 40)] + ["", "a b c", "a b c d e", "A b, c d e!"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(4)))) for i in range(120)] + [(500, None), (501, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {(r.doc, r.line) for r in line_dedup.repeats(df).collect()} == brute.repeated_lines(rows)


def test_lines_of_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gone = brute.repeated_lines(rows)
    for r in line_dedup.remove(docs).collect():
        text = dict(rows)[r.doc_id]
        parts = text.split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(parts) if (r.doc_id, k) not in gone)
        assert (r.n_lines, r.n_removed) == (len(parts), sum(d == r.doc_id for d, _ in gone))


def test_lines_of_rows_with_one_id_or_none(spark):
    rows = [(1, "a b c d e f"), (3, "a b c d e f\nk1"), (3, "totally different unique line of words here\nzz"), (None, "p q r s t u\nfirst"), (None, "second\np q r s t u"), (None, "third\nother")]
    left = sorted(((r.doc_id, r.text) for r in line_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=repr)
    kept = [t for i, t in left if i is None]
    assert [x for x in left if x[0] is not None] == [(1, "a b c d e f"), (3, "k1"), (3, "totally different unique line of words here\nzz")]
    assert sorted(kept) in (["first", "second\np q r s t u", "third\nother"], ["p q r s t u\nfirst", "second", "third\nother"])
    with pytest.raises(TypeError, match="integer"):
        line_dedup.remove(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_heaps_of_lines(spark, monkeypatch):
    """One run of many blocks: near copies of its first line, lines that are like others only, and equal ones."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(45)]
    far = base[:28] + [f"v{k}" for k in range(17)]  # shares tokens with the base, but is not like it

    def near(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        return " ".join(w)

    rows = [(i, near(base if i % 3 else far, rng.randrange(3))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute.repeated_lines(rows)
    assert {(r.doc, r.line) for r in line_dedup.repeats(df).collect()} == want
    monkeypatch.setattr(line_dedup, "HOT", 0)  # all tokens as if they were too frequent for a bin
    assert {(r.doc, r.line) for r in line_dedup.repeats(df).collect()} == want
    monkeypatch.setattr(line_dedup, "HOT", 36)  # some of them
    assert {(r.doc, r.line) for r in line_dedup.repeats(df).collect()} == want


@pytest.mark.parametrize("changes", [{"SMALL": 1, "RECENT": 1, "BIN": 1}, {"SMALL": 1000, "RARITY": 1 << 20, "MOST_RARITY": 1 << 20}])
def test_sizes_inside_change_no_result(spark, sf_dir, monkeypatch, changes):
    from vicinal.llm import bloom

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 > 0")
    want = brute.repeated_lines([(r.doc_id, r.text) for r in docs.collect()])
    for name, value in changes.items():
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(bloom, "MOST_KEYS", 1)
    assert {(r.doc, r.line) for r in line_dedup.repeats(docs).collect()} == want


def test_join_of_rows_with_one_id(spark):
    t, u = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, t), (2, t), (2, None), (2, ""), (3, u), (2, u + " x"), (None, t), (2, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.class_id, r.n_links, r.copy_id) for r in ngram_join.join(df).collect()), key=repr)
    assert found == sorted([(1, 1, 1, 1), (2, 1, 1, 1), (2, 2, 0, 2), (2, 2, 1, 2), (3, 2, 1, 3), (None, None, 0, None)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect()), key=repr)
    assert kept == sorted([(1, t), (2, None), (2, ""), (2, u + " x"), (None, t)], key=repr)
    with pytest.raises(TypeError, match="integer"):
        ngram_join.join(df.selectExpr("string(doc_id) AS doc_id", "text"))


def test_join_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS row", "3 AS `a.b`", "4 AS print", "5 AS k0")
    left = ngram_join.one_of_each(df)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(1, "a b c d e f", 1, 2, 3, 4, 5)]


def test_join_without_the_filter(spark, sf_dir, monkeypatch):
    from vicinal.llm import bloom

    monkeypatch.setattr(bloom, "MOST_KEYS", 1)
    monkeypatch.setattr(similar, "BLOCK", 4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute.classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()} == want


def test_units_that_span_batches():
    import pyarrow as pa

    rng = random.Random(2)
    keys = sorted(rng.choice(range(12)) for _ in range(100))
    for cuts in ([0, 100], [0, 1, 2, 3, 50, 50, 99, 100], list(range(101))):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(range(a, b))], ["k", "v"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out = [rows.slice(a, b - a) for rows, begin in similar.whole_units(batches, 1) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), rows.num_rows], strict=True)]
        assert [set(x.column(0).to_pylist()) for x in out] == [{k} for k in sorted(set(keys))] and [v for x in out for v in x.column(1).to_pylist()] == list(range(100))


def test_lines_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f\nzz"), (3, "a b c d e f\nzz"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_lines", "'y' AS doc", "'z' AS lines")
    found = sorted(((r.doc_id, r.text, r.n_removed, r.doc, r.lines) for r in line_dedup.remove(df).collect()), key=repr)
    assert found == sorted([(None, "a b c d e f", 0, "y", "z"), (3, "zz", 1, "y", "z"), (3, "zz", 1, "y", "z"), (4, None, 0, "y", "z")], key=repr)
    assert line_dedup.remove(df.limit(0)).count() == 0


def test_short_lines(spark):
    rows = [(1, "Les.\na b c d e\n"), (2, "les\na b\n\n!!"), (3, "A b.\na b c\na b c d"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {(r.doc, r.line) for r in line_dedup.repeats(df).collect()} == {(2, 0), (3, 0)}
    assert line_dedup.repeats(df, whole=False).count() == 0


def test_lines_that_share_a_short_print_differ(spark, monkeypatch):
    # 32 bits of the prints of each pair were equal, and so are size and first token with this order of tokens.
    monkeypatch.setattr(line_dedup, "rarity", lambda *_: np.zeros(line_dedup.RARITY, np.uint8))
    pairs = [(183401, 391528), (341231, 358205), (128467, 187416), (720494, 724654)]
    rows = [(k, f"t1419 b c d e x{n}") for k, n in enumerate(n for p in pairs for n in p)]
    assert line_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id")).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 500_000)], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert {(r.doc_id, r.n_removed) for r in line_dedup.remove(df).collect()} == {(1, 0), (2, 1), (3, 0)}


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path(spark, n):
    edges = [(k + 1, k) for k in range(n)] + [(100, 101), (101, 100), (7777, 7777), (200, 201), (202, 201)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, n + 1)}, 101: 100, 201: 200, 202: 200}


def test_sample_is_the_same_at_every_run(spark):
    from vicinal.llm import shared

    rows = spark.range(5000).repartition(7)
    a, b = (sorted(r[0] for r in shared.sample(x, ["id"], 100).collect()) for x in (rows, rows.repartition(3)))
    assert a == b and len(a) == 100
    assert shared.sample(rows.limit(20), ["id"], 100).count() == 20 and shared.sample(rows.limit(0), ["id"], 100).count() == 0


def test_only_wanted_lines_are_cut_into_words(monkeypatch):
    from vicinal.llm.textcore import text_bytes

    texts = ["a b c d e f\nx y\n\nlast line of one", "", "no end\n", "\n\n", "é b c d e f g\nto the end"]
    data, offsets = text_bytes(pa.array(texts))
    every = line_dedup.Lines(data, offsets, 3, True)
    seen, old = [], line_dedup.Words
    monkeypatch.setattr(line_dedup, "Words", lambda data, cuts: seen.append(len(data)) or old(data, cuts))
    for wanted in (lambda doc, number: (doc + number) % 2 == 0, lambda doc, number: number > 9, lambda doc, number: number == 1):
        some = line_dedup.Lines(data, offsets, 3, True, wanted)
        keep = wanted(every.doc, every.number)[every.line]
        assert (some.doc.tolist(), some.number.tolist()) == (every.doc.tolist(), every.number.tolist())
        assert some.token.tolist() == every.token[keep].tolist() and some.line.tolist() == every.line[keep].tolist()
    assert len(seen) == 2 and max(seen) < len(data)

"""Toxicity by non-negative positive-unlabelled learning.

What is known is that some documents are toxic; all others are unlabelled, not
clean.  With the share of toxic documents (the class prior), the risk on clean
documents is the risk of calling unlabelled ones toxic less the part that the
toxic ones among them have; held at zero or above, as a flexible model would
otherwise drive it below.  The model is linear in how often words and word
beginnings occur (at all, twice, four times), with weights of either sign for all
features whose rate differs between positives and unlabelled documents at a
false discovery rate of one in a thousand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import shared
from vicinal.llm.textcore import U, Words, arrow_batches, blocks, word_hash

#: Features are words and their first bytes, as many as these.
BEGINNINGS = (4, 5, 6)
BITS = 22
#: Numbers of occurrences that tell a feature's levels apart.
LEVELS = (1, 2, 4)
#: Share of false ones among the features that get a weight, and the least documents that a feature is tested with.
DISCOVERY, LEAST_SEEN = 1e-3, 5


@dataclass
class Model:
    features: np.ndarray  # sorted numbers
    weights: np.ndarray  # what a feature adds by its level, 0 to len(LEVELS)
    bias: float

    def __post_init__(self) -> None:
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.features] = np.arange(len(self.features))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of texts with repeats, and the index of the text of each."""
    words = Words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    shift = U(64 - BITS)
    found, owner = [(words.hash >> shift).astype(np.int64)], [text]
    for size in BEGINNINGS:
        which, name = words.beginnings(size)
        found.append((name >> shift).astype(np.int64))
        owner.append(text[which])
    return np.concatenate(found), np.concatenate(owner)


def word_number(word: str) -> int:
    """The feature number of a word."""
    return int(word_hash(word) >> U(64 - BITS))


def counted(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its different features in order, each with its level in the lowest two bits."""
    found, owner = features(data, offsets)
    both, times = np.unique(owner << BITS | found, return_counts=True)
    cut = np.searchsorted(both >> BITS, np.arange(len(offsets)))
    own = ((both & ((1 << BITS) - 1)) << 2 | np.searchsorted(LEVELS, times, "right")).astype("<u4")
    return [own[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows from which no label is learned: crc32 of the id as text is a multiple of ``folds``; not null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _consistent(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id and y (0 or 1) of the ids that may be learned from and whose labels agree; other label values are left out."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~is_held_out(F.col("id")))
    return known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 10000, sample_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", steps: int = 600) -> Model:
    """Fits a model on bounded samples: ``positives`` toxic and ``unlabelled`` rows at most, the first by a hash of id and text, and ``sample_bytes`` of text at most.

    Labels and texts of held-out ids are not used, nor are null ids and texts,
    labels other than 0 and 1, and ids whose labels contradict each other; repeated
    labels and rows count once.  The class prior is the share of toxic ids among
    the labels that may be used.  Without any positive the model scores every text
    by the prior.  The same rows give the same model at every run.
    """
    arrow_batches(docs.sparkSession)
    known = _consistent(labels, id_col, label_col)
    counts = known.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    prior = min(0.5, max(0.005, (counts["p"] or 0) / counts["n"])) if counts["n"] else 0.05
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).where("id is not null and text is not null").where(~is_held_out(F.col("id")))
    slim = rows.select("id", "hash", F.octet_length("text").alias("size"))  # no text goes through the join
    toxic = slim.join(known.where("y = 1").select("id"), "id")
    taken = [(*k, kind) for kind, few, n in ((1, toxic, positives), (0, slim, unlabelled)) for k in shared.chosen(few, n, sample_bytes // 2)]
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(taken, f"id {kind_of_id}, hash long, kind int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in counted(data, offsets)], pa.binary())], ["kind", "own"])

    found = rows.join(F.broadcast(chosen), ["id", "hash"]).dropDuplicates(["id", "hash", "kind"]).select("kind", "text")
    table = found.mapInArrow(run, "kind int, own binary").toArrow()
    y, own = table.column(0).to_numpy(), [np.frombuffer(x.as_buffer(), "<u4") for x in table.column(1)]
    return fit(own, y.astype(np.float64), prior, steps)


def _significant(seen_p: np.ndarray, seen_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features whose rates differ between n_p and n_u documents, by Benjamini and Hochberg's rule."""
    tested = np.flatnonzero(seen_p + seen_u >= LEAST_SEEN)
    n = len(tested)
    a, b = seen_p[tested] / n_p, seen_u[tested] / n_u
    share = (a * n_p + b * n_u) / (n_p + n_u)
    z = np.abs(a - b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    tested, z = tested[z > 2], z[z > 2]  # others can't pass
    order = np.argsort(-z, kind="stable")
    ok = np.flatnonzero([erfc(x / 2**0.5) <= DISCOVERY * (k + 1) / n for k, x in enumerate(z[order].tolist())])
    return np.sort(tested[order[: ok[-1] + 1]]) if len(ok) else tested[:0]


def gradient(f: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores f, and its derivative, or, where the risk on clean documents fell below zero, that of taking this part back."""
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    n_p, n_u = int(pos.sum()), int(unl.sum())
    on_positives = prior * np.logaddexp(0, -f[pos]).mean()
    on_clean = np.logaddexp(0, f[unl]).mean() - prior * np.logaddexp(0, f[pos]).mean()
    d = np.zeros(len(f))
    if on_clean >= 0:
        d[pos] = prior * (p[pos] - 1) / n_p - prior * p[pos] / n_p
        d[unl] = p[unl] / n_u
    else:
        d[pos] = prior * p[pos] / n_p
        d[unl] = -p[unl] / n_u
    return on_positives + max(0.0, on_clean), d


def fit(own: list[np.ndarray], y: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """own: the features of each document with their levels (see ``counted``); y: 1 for known toxic ones, 0 for unlabelled ones."""
    base = float(np.log(prior / (1 - prior)))
    # Copies of a text say nothing more than the text; in the order of digests sums are the same at every run.
    first = {blake2b(x.tobytes(), digest_size=16, person=bytes([int(k)])).digest(): i for i, (x, k) in enumerate(zip(own, y.tolist(), strict=True))}
    order = [first[k] for k in sorted(first)]
    own, y = [own[i] for i in order], y[order]
    pos, unl = y == 1, y == 0
    n_p, n_u = int(pos.sum()), int(unl.sum())
    if not n_p or not n_u:
        return Model(np.zeros(0, np.int64), np.zeros((0, len(LEVELS) + 1)), base)
    # The driver holds these counts: two bytes each where the documents allow it.
    seen = np.zeros((2, len(LEVELS), 1 << BITS), np.uint16 if len(own) < 1 << 16 else np.uint32)
    for x, k in zip(own, y.astype(int).tolist(), strict=True):
        for level in range(len(LEVELS)):
            seen[k, level, x[x & 3 > level] >> 2] += 1  # a document has each feature once
    chosen = _significant(seen[1].ravel(), seen[0].ravel(), n_p, n_u)
    del seen
    if not len(chosen):
        return Model(np.zeros(0, np.int64), np.zeros((0, len(LEVELS) + 1)), base)
    column = []
    for x in own:
        codes = np.concatenate([(x[x & 3 > level] >> 2).astype(np.int64) + (level << BITS) for level in range(len(LEVELS))])
        place = np.minimum(np.searchsorted(chosen, codes), len(chosen) - 1)
        column.append(place[chosen[place] == codes])
    row = np.repeat(np.arange(len(own)), [len(c) for c in column])
    column = np.concatenate(column)
    w, bias = np.zeros(len(chosen)), base
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        d = gradient(bias + np.bincount(row, weights=w[column], minlength=len(own)), pos, unl, prior)[1]
        g = np.bincount(column, weights=d[row], minlength=len(w)) + decay * w
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        now = rate / (1 - 0.9**step)
        w = w - now * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # A text without any feature is never likelier toxic than the prior has it: on few
        # documents, taking risk back would else call all of them toxic.
        bias = min(base, bias - now * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8))
    names = np.unique(chosen & ((1 << BITS) - 1))
    weights = np.zeros((len(names), len(LEVELS) + 1))
    for level in range(len(LEVELS)):
        own_level = chosen >> BITS == level
        weights[np.searchsorted(names, chosen[own_level] & ((1 << BITS) - 1)), level + 1] = w[own_level]
    return Model(names, np.cumsum(weights, axis=1), float(bias))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in ``keep``, held_out, score (0 to 1) and predicted (1 if score >= 0.5) of every row.

    A null or empty text has no features: its score is that of the bias.  Null and
    repeated ids stay; equal texts have equal scores; a very long text is worked on
    alone; an empty table gives no rows; other columns are not read, whatever their
    names.  Kept columns named like the added ones stand beside them, so rename them
    then.
    """
    arrow_batches(docs.sparkSession)
    # At most 4 million features with a weight for each level; there are some hundred.
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        n = max(1, len(own.features))
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                found, owner = features(data, offsets)
                place = own.place[found]
                hit = place >= 0
                both, times = np.unique(owner[hit] * n + place[hit], return_counts=True)
                added = own.weights[both % n, np.searchsorted(LEVELS, times, "right")] if len(both) else np.zeros(0)
                total = np.bincount(both // n, weights=added, minlength=b - a)
                out[a:b] = 1 / (1 + np.exp(-np.clip(total + own.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(out)], names)

    kept = list(dict.fromkeys([id_col, *keep]))
    inner = [f"k{k}" for k in range(len(kept))]
    names = [*inner, "score"]
    schema = ", ".join(f"k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)) + ", score double"
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(kept, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("scored")).mapInArrow(run, schema)
    return rows.select(*(F.col(k).alias(c) for c, k in zip(kept, inner, strict=True)), is_held_out(F.col("k0")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def calm(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the model calls toxic; the columns stay as they are, whatever their names."""
    columns = docs.columns
    inner = [f"c{k}" for k in range(len(columns))]
    own = docs.toDF(*inner)
    found = score(own, model, inner[columns.index(id_col)], inner[columns.index(text_col)], tuple(inner))
    return found.where("predicted = 0").select(*inner).toDF(*columns)

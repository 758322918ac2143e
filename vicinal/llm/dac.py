"""Directly addressable codes for token ids, and their files.

An id is cut into chunks of 8 bits, low chunk first.  Level k holds chunk k of
every id that has one; a bit for each says whether the id goes on in level k+1,
and where it stands there is the number of such bits before it.  That number is
read from a directory (one count for 512 bits) and the bits of one block, so any
token is reached without decoding another.

A file holds documents in a row: magic, a header of fixed size, document ids (of
null ones, which come first, only their number counts), the places where documents
begin, and for each level its chunks, bits and directory.  ``DacFile`` reads single
tokens, documents or ranges by seeking.

Texts are encoded where they are read, and only their ids are dealt out, by ranges
of document ids whose borders a sample of these gives.
"""

from __future__ import annotations

import contextlib
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import shared
from vicinal.llm.library_bpe import LibraryEncoder
from vicinal.llm.pretokens import Memo, Pieces
from vicinal.llm.textcore import arrow_batches, blocks

MAGIC = b"DACIDS02"
BLOCK = 512
LEVELS = 4
_HEAD = struct.Struct("<8sqqqqi" + "q" * LEVELS + "q" * (2 + 3 * LEVELS))
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def build(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of 32-bit ids: chunks, packed continuation bits and directory of each."""
    levels = []
    rest = np.ascontiguousarray(ids, np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = _ONES[bits].reshape(-1, BLOCK // 8).sum(1)
        levels.append(((rest & 0xFF).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def to_bytes(doc_ids: np.ndarray, first: np.ndarray, ids: np.ndarray, base: int, n_null: int = 0) -> bytes:
    """A file of documents; first: where each begins and the last ends; base: ids in files before it of the same part; n_null: documents without an id, the first ones."""
    levels = build(ids)
    parts = [np.ascontiguousarray(doc_ids, "<i8").tobytes(), np.ascontiguousarray(first, "<i8").tobytes()]
    for chunks, bits, ranks in levels:
        parts += [chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    sizes = [len(levels[k][0]) if k < len(levels) else 0 for k in range(LEVELS)]
    at, places = _HEAD.size, []
    for p in parts:
        places.append(at)
        at += len(p)
    places += [at] * (2 + 3 * LEVELS - len(places))
    return _HEAD.pack(MAGIC, len(doc_ids), n_null, len(ids), base, len(levels), *sizes, *places) + b"".join(parts)


class DacFile:
    """Reads a file by seeking; ``handle`` has ``seek`` and ``read``."""

    def __init__(self, handle) -> None:
        self.handle = handle
        magic, self.n_docs, self.n_null, self.n_ids, self.base, self.n_levels, *more = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable ids")
        self.sizes, self.places = more[:LEVELS], more[LEVELS:]

    def _read(self, at: int, size: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(size)

    def _array(self, at: int, kind: str, count: int) -> np.ndarray:
        return np.frombuffer(self._read(at, count * np.dtype(kind).itemsize), kind)

    def doc_ids(self) -> np.ndarray:
        return self._array(self.places[0], "<i8", self.n_docs)

    def first(self) -> np.ndarray:
        return self._array(self.places[1], "<i8", self.n_docs + 1)

    def _rank(self, level: int, i: int) -> tuple[int, bool]:
        """The number of continuation bits before place i, and that of place i."""
        _, bits, ranks = self.places[2 + 3 * level : 5 + 3 * level]
        count = int(self._array(ranks + 8 * (i // BLOCK), "<i8", 1)[0])
        block = self._array(bits + i // BLOCK * (BLOCK // 8), "u1", BLOCK // 8)
        inside = i % BLOCK
        count += int(_ONES[block[: inside // 8]].sum()) + int(_ONES[block[inside // 8] & ((1 << inside % 8) - 1)])
        return count, bool(block[inside // 8] >> inside % 8 & 1)

    def token(self, i: int) -> int:
        """Id i alone: one chunk, one block of bits and one count for each level that it has."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level in range(self.n_levels):
            value |= self._read(self.places[2 + 3 * level] + i, 1)[0] << 8 * level
            i, more = self._rank(level, i)
            if not more:
                break
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (not b), from the chunks and bits of these alone."""
        a, b = max(0, a), min(b, self.n_ids)
        out = np.zeros(max(0, b - a), np.uint32)
        where = np.arange(len(out))
        for level in range(self.n_levels):
            if a >= b:
                break
            chunks, bits, _ = self.places[2 + 3 * level : 5 + 3 * level]
            out[where] |= self._array(chunks + a, "u1", b - a).astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(self._array(bits + a // 8, "u1", (b + 7) // 8 - a // 8), bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            a = self._rank(level, a)[0]
            b = a + int(more.sum())
            where = where[more]
        return out


def _system(uri: str):
    """File system and path; the names that Hadoop gives to object stores are understood too."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


def _ids(texts: pa.Array, memo: Memo, encoder: LibraryEncoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and the number of ids before each; texts that hold an added token go whole to the library."""
    whole = np.zeros(len(texts), bool)
    for content in encoder.added:
        whole |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
    if not whole.any():
        return memo.batch(Pieces(texts))
    ids, first = memo.batch(Pieces(pc.if_else(pa.array(whole), pa.scalar(None, texts.type), texts)))
    at = np.flatnonzero(whole)
    found = [np.array(encoder.ids(texts[i].as_py()), ids.dtype) for i in at.tolist()]
    size = np.zeros(len(texts), np.int64)
    size[at] = [len(f) for f in found]
    return np.insert(ids, np.repeat(first[:-1], size), np.concatenate(found)), first + np.concatenate([[0], np.cumsum(size)])


#: Sampled rows for each part, from which its borders are taken.
SAMPLED = 64


def _borders(rows: DataFrame, parts: int) -> list[tuple[bool, int, int]]:
    """(has an id, id, print) of the first row of each part but the first, by a sample of a bounded number of rows a part."""
    found = shared.sample(rows.select("id", "print"), ["id", "print"], SAMPLED * parts).collect()
    keys = sorted((r["id"] is not None, r["id"] or 0, r["print"]) for r in found)
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def encoded(rows: DataFrame, tokenizer: str, borders: list[tuple[bool, int, int]]) -> DataFrame:
    """part, id, print and ids (little-endian, of 16 bits if the vocabulary allows it) of rows of id, print and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder(tokenizer)
        memo = Memo(encoder)
        kind = _kind(encoder.most)
        for batch in batches:
            for a, b, _, _ in blocks(batch.column(2)):
                ids, first = _ids(batch.column(2).slice(a, b - a), memo, encoder)
                raw, cut = ids.astype(kind).tobytes(), (first * np.dtype(kind).itemsize).tolist()
                own = pa.array([raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                names, prints = (batch.column(k).slice(a, b - a) for k in (0, 1))
                part = [bisect_right(borders, (i is not None, i or 0, p)) for i, p in zip(names.to_pylist(), prints.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), names, prints, own], ["part", "id", "print", "ids"])

    return rows.select("id", "print", "text").mapInArrow(run, "part int, id long, print long, ids binary")


def _kind(most: int) -> str:
    return "<u2" if most < 1 << 16 else "<u4"


def write(docs: DataFrame, tokenizer: str, uri: str, end_id: int = 0, ids_per_file: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, adds ``end_id`` to each and writes files of ids under ``uri`` in ascending order of id_col.

    Returns the list of files (part, seq, path, base, n_docs, n_ids), kept as a
    table beside them.  A part is one range of ids; ``base`` counts ids before
    the file in its part.  A file has the name of its task attempt, and the list
    has only files of attempts that ended well: one that fails takes its files
    with it, and what a lost executor leaves behind isn't in the list.  A null text
    is empty; null ids come first; rows with equal ids are ordered by a hash of
    their texts, and so are dealt out where one id, or null, has very many; other
    columns are not read; id_col has to be of an integer type.  An empty table
    gives no files.  A very long text is encoded alone, and its ids lie in one
    file.  Added tokens of the tokenizer in a text get their own ids, as by the
    library's defaults.
    """
    arrow_batches(docs.sparkSession)
    most = LibraryEncoder(tokenizer).most
    kind = _kind(most)
    wide = np.dtype(kind).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(uri)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        names: list[pa.Array] = []
        found: list[bytes] = []
        sizes: list[int] = []
        written: list[str] = []
        state = {"n": 0, "base": 0}

        def flush() -> pa.RecordBatch:
            own = pa.chunked_array(names).combine_chunks()
            size = np.array(sizes, np.int64)
            ids = np.insert(np.frombuffer(b"".join(found), kind).astype(np.uint32), np.cumsum(size), end_id)
            path = f"{root}/part-{part:06d}-{len(written):05d}-{attempt}.dac"
            written.append(path)
            with system.open_output_stream(path) as out:
                out.write(to_bytes(own.fill_null(0).to_numpy(), np.concatenate([[0], np.cumsum(size + 1)]), ids, state["base"], own.null_count))
            row = {"part": [part], "seq": [len(written) - 1], "path": [path], "base": [state["base"]], "n_docs": [len(size)], "n_ids": [len(ids)]}
            state.update(n=0, base=state["base"] + len(ids))
            for x in (names, found, sizes):
                x.clear()
            return pa.RecordBatch.from_pydict(row, LIST)

        try:
            for batch in batches:
                names.append(batch.column(0))
                for raw in batch.column(1).to_pylist():
                    found.append(raw)
                    sizes.append(len(raw) // wide)
                    state["n"] += sizes[-1] + 1
                if state["n"] >= ids_per_file:
                    yield flush()
            if names:
                yield flush()
        except BaseException:
            for path in written:
                with contextlib.suppress(OSError):
                    system.delete_file(path)
            raise

    LIST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    table = f"{uri}/files.parquet"
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(shared.integer_id(docs, id_col).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Encoding comes once, before the shuffle: a range partitioning by Spark would run it for its own sample too.
    dealt = encoded(rows, tokenizer, _borders(rows, parts)).repartitionById(parts, F.col("part")).sortWithinPartitions("id", "print").select("id", "ids")
    dealt.mapInArrow(run, "part long, seq long, path string, base long, n_docs long, n_ids long").write.parquet(table)
    return docs.sparkSession.read.parquet(table)


def read(files: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that ``write`` listed."""
    spark = files.sparkSession
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).orderBy("part").collect()  # a row for each task of the writer
    before, bases = 0, []
    for p in parts:
        bases.append((p["part"], before))
        before += p["n"]
    many = min(1 << 16, max(1, sum(p["files"] for p in parts)))
    placed = files.join(spark.createDataFrame(bases or [(0, 0)], "part long, before long"), "part").select("path", "before").repartition(many)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(uri)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as handle:
                    file = DacFile(handle)
                    names, first = file.doc_ids(), file.first()
                    for a in range(0, len(names), 1024):
                        b = min(a + 1024, len(names))
                        ids = file.tokens(int(first[a]), int(first[b])).astype("<u4")
                        at = first[a : b + 1] - first[a]
                        sums = [crc32(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        own = pa.array(names[a:b], mask=np.arange(a, b) < file.n_null)
                        yield pa.RecordBatch.from_arrays([own, pa.array(first[a:b] + file.base + before), pa.array(np.diff(at)), pa.array(sums, pa.int64())], schema=schema)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_ids(docs: DataFrame, tokenizer: str, uri: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every document and reads them back; see ``write`` and ``read``."""
    uri = uri or shared.place(docs.sparkSession, "ids")
    return read(write(docs, tokenizer, uri, end_id, id_col=id_col, text_col=text_col), uri).withColumnRenamed("doc_id", id_col)

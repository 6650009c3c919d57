"""Token files of directly addressable codes.

A file holds a shard of documents in ascending doc_id order. Ids are split
into chunks of eight bits; level 0 holds the lowest chunk of every token, and
level k + 1 the next chunk of those tokens whose continuation bit at level k is
set. Each level has a bitmap of those bits and a directory of the bits set
before every block of 512, so that token i is reached by one byte and one rank
per level, without decoding what stands before it.

Layout, little-endian: magic, number of documents, tokens and levels (u64);
then doc_ids (i64) with a null mask (u8), first token of each document and of
the end (u64); then for each level its length (u64), chunks (u8, padded to 8),
bitmap (u64 words), directory (u64 per block).

Edge cases: a null text is empty and has the end id alone; null doc_ids come
first; rows that repeat a doc_id stand side by side in an order that their text
alone decides; an empty table writes no file and gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, table
from .tokens import worker_encoder

MAGIC = b"VAAKDAC1"
END_ID = 2
BLOCK = 512
#: Tokens at which a shard ends: a worker holds one at a time, about 400 MB with what is made of it.
SHARD_TOKENS = 1 << 25


def file_system(path: str):
    """(file system, path within it) of a URI that pyarrow can open, or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, directory) of each level."""
    out, v = [], ids.astype(np.uint32)
    while True:
        rest = v >> 8
        more = rest > 0
        words = -(-len(v) // BLOCK) * (BLOCK // 64)
        bits = np.zeros(words * 64, np.uint8)
        bits[: len(v)] = more
        bitmap = np.packbits(bits, bitorder="little").view("<u8")
        blocks = bits.reshape(-1, BLOCK).sum(1, dtype=np.uint64) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        out.append((v.astype(np.uint8), bitmap, ranks))
        if not more.any():
            return out
        v = rest[more]


def dump(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard as the bytes of its file."""
    levels = encode_levels(ids)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes()]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), bytes(-len(null) % 8), starts.tobytes()]
    for chunks, bitmap, ranks in levels:
        parts += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), bytes(-len(chunks) % 8), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Shard:
    """Reads a file's bytes; ``token(i)`` and ``tokens(a, b)`` decode only what they return."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n, self.n_tokens, depth = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, count, at)
            at += -(-a.nbytes // 8) * 8
            return a

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.starts = take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for _ in range(depth):
            size = int(take("<u8", 1)[0])
            chunks, blocks = take("u1", size), -(-size // BLOCK)
            self.levels.append((chunks, take("<u8", blocks * BLOCK // 64), take("<u8", blocks + 1)))

    def rank(self, level: int, i: int) -> int:
        """Bits set before place i of a level."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        first = block * (BLOCK // 64)
        whole = bitmap[first : i // 64]
        count = int(ranks[block]) + int(np.bitwise_count(whole).sum())
        if i % 64:
            count += (int(bitmap[i // 64]) & ((1 << i % 64) - 1)).bit_count()
        return count

    def token(self, i: int) -> int:
        """The id at place i of the shard."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not int(bitmap[i // 64]) >> i % 64 & 1:
                break
            i = self.rank(level, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b - 1."""
        out = np.zeros(max(0, b - a), np.uint32)
        at = np.arange(len(out))
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[a // 64 : -(-b // 64)].view(np.uint8), bitorder="little")[a % 64 :][: b - a].astype(bool)
            a = self.rank(level, a) if bits.any() else 0
            b = a + int(bits.sum())
            at = at[bits]
        return out


def write(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> list[tuple]:
    """Writes shards under ``path``; returns (name, documents, tokens) in order, a row per file.

    A shard ends with the document that brings it to ``shard_tokens``. Files
    bear the number of their attempt and only those of the attempt that
    counted are returned, so a task that runs again overwrites nothing.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, task = worker_encoder(), TaskContext.get()
        fs, root = file_system(path)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size, number = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            lengths = np.array([len(x) // 4 for x in ids])
            name = f"shard-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.dac"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(dump(doc_ids, lengths, np.frombuffer(b"".join(ids), "<u4")))
            out = pa.RecordBatch.from_pydict({"part": [task.partitionId()], "number": [number], "name": [name], "docs": [len(ids)], "tokens": [int(lengths.sum())]})
            doc_ids.clear()
            ids.clear()
            size, number = 0, number + 1
            return out

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                doc_ids.append(doc)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    # Rows that repeat an id are dealt by their text, so that no id is a task of its own.
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    sort = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    files = sort.mapInArrow(run, "part long, number long, name string, docs long, tokens long").collect()  # a row per file
    return [tuple(r)[2:] for r in sorted(files)]


def read(spark: SparkSession, path: str, shards: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    base, rows = 0, []
    for name, _, tokens in shards:
        rows.append((name, base))
        base += tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, root = file_system(path)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                at = shard.starts
                crc = [zlib.crc32(shard.tokens(int(x), int(y)).astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                cols = [pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "name string, base long").repartition(len(rows))
    return files.mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back."""
    arrow_rows(spark)
    path = scratch(spark, "tokens")
    return read(spark, path, write(table(spark, sf_dir, "documents"), path))

"""WARC files and a Merkle audit of their replicas.

Pages are written in ascending page_id order to shards, each record a gzip
member of its own, and the same bytes to every replica. A shard's leaves are
the hashes of its records' offset ranges in order, and of whatever stands
behind the last; parents hash their children. The audit compares the roots of
two replicas and descends only where they differ, down to the damaged ranges.

Edge cases: a null html is an empty payload, a null url leaves its header out;
null page_ids come first; rows that repeat a page_id are records of their own
in an order that their content decides;
an empty table writes nothing and gives an empty result; a missing or cut file
has the ranges that it lacks reported; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, scratch, table
from .token_files import file_system

REPLICAS = ("first", "second")
#: Bytes at which a shard ends; the audit holds one at a time.
SHARD_BYTES = 1 << 28
#: The registered query spoils the records whose page_id this divides, so that its audit has damage to find.
DRILL = 50
_EMPTY = hashlib.sha256(b"").digest()


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a WARC record, compressed."""
    body = (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _flipped(member: bytes) -> bytes:
    """A record with the bits of its middle byte turned, as a decayed replica has it."""
    at = len(member) // 2
    return member[:at] + bytes([member[at] ^ 0xFF]) + member[at + 1 :]


def write(pages: DataFrame, path: str, replicas: tuple[str, ...] = REPLICAS, shard_bytes: int = SHARD_BYTES, spoil: int | None = None) -> DataFrame:
    """Writes the shards of each replica; returns the stored index, a row per shard.

    (shard, page_ids, urls, offsets): offsets has one more entry, the file's end.
    A shard ends with the record that brings it to ``shard_bytes``. Files bear
    the number of their attempt, and the index names those that counted. For
    drills, ``spoil`` damages in every replica but the first the records whose
    page_id it divides.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(path)
        number, name, ids, urls, offsets, outs = 0, "", [], [], [0], []

        def end() -> pa.RecordBatch:
            for out in outs:
                out.close()
            row = pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([urls], pa.list_(pa.string())), pa.array([offsets], pa.list_(pa.int64()))],
                names=["shard", "page_ids", "urls", "offsets"],
            )
            for x in (ids, urls, offsets, outs):
                x.clear()
            offsets.append(0)
            return row

        for b in batches:
            for page, url, html in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if not outs:
                    name = f"shard-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                    number += 1
                    for r in replicas:
                        fs.create_dir(f"{root}/{r}", recursive=True)
                        outs.append(fs.open_output_stream(f"{root}/{r}/{name}", compression=None))
                member = record(page, url, html)
                for i, out in enumerate(outs):
                    out.write(_flipped(member) if i and spoil is not None and page is not None and page % spoil == 0 else member)
                ids.append(page)
                urls.append(url)
                offsets.append(offsets[-1] + len(member))
                if offsets[-1] >= shard_bytes:
                    yield end()
        if ids:
            yield end()

    # Rows that repeat an id are dealt by their content, so that no id is a task of its own.
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64("url", "html").alias("h"))
    rows = rows.repartitionByRange("page_id", "h").sortWithinPartitions("page_id", "h", "url", "html").select("page_id", "url", "html")
    return materialize(rows.mapInArrow(run, "shard string, page_ids array<bigint>, urls array<string>, offsets array<bigint>"), "index")


def tree(leaves: list[bytes]) -> list[list[bytes]]:
    """Levels from the leaves to the root; an odd node moves up alone."""
    levels = [leaves or [_EMPTY]]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([hashlib.sha256(b"\1" + low[i] + low[i + 1]).digest() if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    return levels


def descend(a: list[list[bytes]], b: list[list[bytes]]) -> list[int]:
    """Leaves at which two trees of one shape differ, by mismatching branches only."""
    if [len(x) for x in a] != [len(x) for x in b]:
        raise ValueError("trees of different shapes")
    nodes = [0] if a[-1][0] != b[-1][0] else []
    for low_a, low_b in zip(a[-2::-1], b[-2::-1], strict=True):
        nodes = [j for i in nodes for j in (2 * i, 2 * i + 1) if j < len(low_a) and low_a[j] != low_b[j]]
    return nodes


def leaf_hashes(data: bytes, offsets: list[int]) -> list[bytes]:
    """Hashes of the offset ranges in order, and of what stands behind the last."""
    ends = [*offsets[1:], max(len(data), offsets[-1])]
    return [hashlib.sha256(b"\0" + data[x:y]).digest() for x, y in zip(offsets, ends, strict=True)]


def audit(index: DataFrame, path: str, replicas: tuple[str, str] = REPLICAS) -> DataFrame:
    """A row per record, and one for each shard's tail if the replicas differ there.

    (page_id, url, shard, record, offset, length, record_sha256, intact);
    record_sha256 is of the stored bytes in the first replica. A tail has
    record -1, null page_id and url, and the bytes behind the last record.
    """

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, root = file_system(path)
        for b in batches:
            for shard, replica, offsets in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                name, data = f"{root}/{replica}/{shard}", b""
                if fs.get_file_info(name).type == pafs.FileType.File:
                    with fs.open_input_stream(name, compression=None) as f:
                        data = f.read()
                leaves = leaf_hashes(data, offsets)
                plain = b"".join(hashlib.sha256(data[x:y]).digest() for x, y in zip(offsets[:-1], offsets[1:], strict=True))
                yield pa.RecordBatch.from_pydict({"shard": [shard], "replica": [replica], "root": [tree(leaves)[-1][0]], "leaves": [b"".join(leaves)], "plain": [plain], "size": [len(data)]})

    files = index.select("shard", F.explode(F.array(*map(F.lit, replicas))).alias("replica"), "offsets").repartition("shard", "replica")
    trees = materialize(files.mapInArrow(hashed, "shard string, replica string, root binary, leaves binary, plain binary, size long"), "trees")
    one, two = (trees.where(F.col("replica") == r).select("shard", *[F.col(c).alias(f"{c}{i}") for c in ("root", "leaves", "plain", "size")]) for i, r in enumerate(replicas))
    # Equal roots settle a shard; only the others carry their leaves on.
    differ = F.col("root0") != F.col("root1")
    both = one.join(two, "shard").select("shard", "plain0", "size0", "size1", F.when(differ, F.col("leaves0")).alias("leaves0"), F.when(differ, F.col("leaves1")).alias("leaves1"))

    def located(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cut = lambda x: [x[i : i + 32] for i in range(0, len(x), 32)]
        for b in batches:
            for r in b.to_pylist():
                offsets, n = r["offsets"], len(r["page_ids"])
                bad = set(descend(tree(cut(r["leaves0"])), tree(cut(r["leaves1"])))) if r["leaves0"] is not None else set()
                at = np.array(offsets)
                cols = [r["page_ids"], r["urls"], [r["shard"]] * n, list(range(n)), at[:-1].tolist(), np.diff(at).tolist(), [x.hex() for x in cut(r["plain0"])], [i not in bad for i in range(n)]]
                if n in bad:
                    tail = max(r["size0"], r["size1"], offsets[-1]) - offsets[-1]
                    for c, v in zip(cols, (None, None, r["shard"], -1, offsets[-1], tail, None, False), strict=True):
                        c.append(v)
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "shard", "record", "offset", "length", "record_sha256", "intact"])

    return both.join(index, "shard").mapInArrow(located, "page_id long, url string, shard string, record long, offset long, length long, record_sha256 string, intact boolean")


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to two replicas and audited; every page_id that DRILL divides is damaged in the second."""
    arrow_rows(spark, 500)
    path = scratch(spark, "warc")
    return audit(write(table(spark, sf_dir, "pages"), path, spoil=DRILL), path)

"""Best-fit packing: pattern packing by non-negative least squares.

Texts become token ids with an end id; a document longer than a sequence is
cut so that only its first piece is short. The histogram of piece lengths (at
most ``seq_len`` numbers) goes to the driver. There all patterns of up to
three lengths that fill a sequence exactly are enumerated, repeat counts are
fitted to the histogram by non-negative least squares, rounded down, and what
is left is packed best-fit, longest first, still as counts. Pieces get their
places by their rank within their length: a rank is the place in the piece's
partition plus the offset of that partition and length, so no group of equal
lengths meets in one task.

Edge cases: a null text is empty and has the end id alone; rows that repeat a
doc_id (or have none) are packed as documents of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, materialize, table
from .tokens import worker_encoder

SEQ_LEN = 2048
END_ID = 0
#: Steps of the least-squares fit.
FIT_STEPS = 200


def patterns(seq_len: int, present: np.ndarray) -> np.ndarray:
    """All a >= b >= c with a + b + c = seq_len, made of present lengths; 0 stands for none."""
    have = np.zeros(seq_len + 1, bool)
    have[present] = True
    have[0] = True
    a = np.arange(1, seq_len + 1)[have[1:]]
    out = []
    for x in a:
        rest = seq_len - x
        c = np.arange(0, rest // 2 + 1)
        b = rest - c
        ok = (b <= x) & have[b] & have[c]
        if ok.any():
            out.append(np.stack([np.full(int(ok.sum()), x), b[ok], c[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(hist: np.ndarray, pats: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 minimising |A x - hist|, by accelerated projected gradient."""

    def times(x: np.ndarray) -> np.ndarray:
        y = np.bincount(pats.ravel(), np.repeat(x, 3), len(hist))
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        return r[pats[:, 0]] + r[pats[:, 1]] + r[pats[:, 2]]

    if not len(pats):
        return np.zeros(0)
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = np.zeros(len(pats))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - hist))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(hist: np.ndarray, seq_len: int = SEQ_LEN, steps: int = FIT_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) covering the histogram exactly."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[seq_len]:
        out.append(((seq_len,), int(left[seq_len])))
        left[seq_len] = 0
    pats = patterns(seq_len, np.flatnonzero(left))
    if len(pats):
        x = fit(left.astype(float), pats, steps)
        for i in np.argsort(-x, kind="stable"):
            want = int(x[i] + 1e-6)
            if want < 1:
                break
            pat = tuple(int(v) for v in pats[i] if v)
            n = min([want, *[int(left[v]) // pat.count(v) for v in set(pat)]])
            if n:
                out.append((pat, n))
                for v in pat:
                    left[v] -= n
    # Best fit of what is left: bins with equal contents stand together.
    room: dict[int, list[list]] = {}
    for length in range(seq_len - 1, 0, -1):
        todo = int(left[length])
        while todo:
            free = next((f for f in range(length, seq_len) if room.get(f)), None)
            if free is None:
                # As many new sequences as hold the rest, each filled alike.
                per = seq_len // length
                for k, n in ((per, todo // per), (todo % per, 1)):
                    if k and n:
                        room.setdefault(seq_len - k * length, []).append([(length,) * k, n])
                break
            held, n = room[free].pop()
            k = min(free // length, todo)
            take = min(n, todo // k)
            if n > take:
                room[free].append([held, n - take])
            room.setdefault(free - k * length, []).append([held + (length,) * k, take])
            todo -= k * take
    for bins in room.values():
        out += [(held, n) for held, n in bins]
    return out


def runs(groups: list[tuple[tuple[int, ...], int]], seq_len: int) -> dict[str, np.ndarray]:
    """Runs of ranks of each length: where they begin, and the sequence and offset of the first."""
    at = [0] * (seq_len + 1)
    rows, seq = [], 0
    for pat, n in groups:
        offset = 0
        for length in pat:
            rows.append((length, at[length], seq, offset))
            at[length] += n
            offset += length
        seq += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": a[:, 0] << 48 | a[:, 1], "rank": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def pieces(docs: DataFrame, seq_len: int = SEQ_LEN, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> a row per piece, with its place among its partition's pieces of that length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * keep_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part = worker_encoder(), TaskContext.get().partitionId()
        seen = np.zeros(seq_len + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7 + keep_ids)]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % seq_len or min(n, seq_len)
                start, k = 0, 0
                while start < n:
                    length = first if k == 0 else seq_len
                    own = ids[4 * start : 4 * (start + length)]
                    row = [doc, k, start, length, zlib.crc32(own), part, int(seen[length]), *[own] * keep_ids]
                    seen[length] += 1
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    start, k = start + length, k + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types[: len(cols)], strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, keep_ids: bool = False) -> DataFrame:
    """Packs whole documents; with ``keep_ids`` each piece carries its ids for a writer of sequences."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = materialize(pieces(docs, seq_len, keep_ids), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    per = materialize(counts, "counts")
    hist = np.zeros(seq_len + 1, np.int64)
    for length, n in per.groupBy("length").agg(F.sum("n")).collect():  # at most seq_len rows
        hist[length] = n
    where = spark.sparkContext.broadcast(runs(plan(hist, seq_len), seq_len))
    from pyspark.sql import Window

    before = per.select(
        F.col("part").alias("p"),
        F.col("length").alias("l"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    ranked = rows.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).drop("p", "l", "part")
    schema = T.StructType([f for f in ranked.schema if f.name not in ("place", "before")]).add("sequence_id", "long").add("offset", "long")

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = where.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("place").to_numpy() + b.column("before").to_numpy()
            i = np.searchsorted(w["key"], length << 48 | rank, "right") - 1
            keep = [n for n in b.schema.names if n not in ("place", "before")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in keep], pa.array(w["seq"][i] + rank - w["rank"][i]), pa.array(w["offset"][i])],
                names=[*keep, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(put, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, packed; a row per piece."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))

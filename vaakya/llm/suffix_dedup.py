"""Exact removal of repeated byte strings, by interval expansion on a BWT.

Every 200-byte window of a document has an anchor that its own bytes choose,
so equal windows have equal anchors. Windows of one document with the same
anchor are a segment. Equal segments are counted and then stand as one, and
segments whose anchor occurs once in the corpus are done with. The others meet
by anchor in blocks; for each block the Burrows-Wheeler transform of its
segments is taken and common prefixes are derived by increasing value,
breadth-first: a boundary of value l, extended backward by each character,
sets value l + 1 where none is set yet. The search stops at the minimum length,
and boundaries left without a value join suffixes that agree on that length.
A window repeats if its group of suffixes stands for two places or more.

Crowded anchors: grams are first counted into a fixed number of counters, and
a window takes a gram of one of the fullest as its anchor only if it has no
other. Such segments end where the frequent passage ends, so their copies are
equal and are counted before they are shuffled. An anchor that still has many
unequal segments is split by the bytes beside it: a window reaches 84 bytes
beyond its anchor on one side at least, and equal windows do so alike.

Documents are scanned several times, and what is found is handed back by file
and row within it, so texts are never shuffled and scans may be split in any
way. A table that does not lie in files is stored first. The bytes of what is
handed back are checked by their hash, and a mismatch is an error.

Edge cases: a null text is empty; documents shorter than the minimum length
keep every byte; rows that repeat a doc_id are documents of their own; an
empty table gives an empty result; other columns are not read by ``removals``
and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, remove, scratch, table
from .token_files import file_system

MIN_LEN = 200
#: Bytes of the gram that anchors a window.
GRAM = 32
#: Bytes worked on at once by the rolling hash; a longer text is cut with overlaps.
SLICE = 1 << 20
#: Bytes of a block whose BWT is taken; a block holds whole anchors.
BLOCK = 1 << 20
#: Counters of grams: 2 ** COUNTERS, of which one in FULLEST is crowded if it counts more than FEW.
COUNTERS, FULLEST, FEW = 20, 64, 500
#: Unequal segments of an anchor from which it is split by its neighbourhood.
SPLIT = 1_000
#: Bytes beyond the anchor that every window has on one side.
_SIDE = (MIN_LEN - GRAM) // 2
#: Rows of a file that are handed back in one folder.
FOLDER_ROWS = 4_096
_C = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 24) - 1)
_TOP = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _C
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """The hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64)
    for step in (1, 2, 4):
        h = h[:-step] | h[step:] << np.uint64(8 * step)
    h = _mix(h)
    for step in (8, 16):
        h = _mix(h[:-step] * np.uint64(31) + h[step:])
    return h


def anchors(data: bytes, crowded: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first window, last window) of each segment of a text."""
    out: list[tuple] = []
    start, last = 0, len(data) - MIN_LEN
    while start <= last:
        part = data[start : start + SLICE + MIN_LEN - 1]
        h = gram_hashes(part)
        at = np.arange(len(h), dtype=np.uint64)
        key = ((h >> np.uint64(1)) & ~_POS) | at | (crowded[(h >> np.uint64(shift)).astype(np.int64)].astype(np.uint64) << np.uint64(63))
        width, m = MIN_LEN - GRAM + 1, key
        have = 1
        while 2 * have <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: len(key) - width + 1], m[width - have : width - have + len(key) - width + 1])
        pos = (m & _POS).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        hi = np.concatenate([lo[1:], [len(pos)]]) - 1
        out.append((h[pos[lo]], pos[lo] + start, lo + start, hi + start))
        start += len(pos)
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` (small symbols) ordered by their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    bits = max(int(text.max()).bit_length(), 1)
    have = 1
    pair = text.astype(np.int64)
    while 2 * have * bits <= 63:
        pair[: n - have] = pair[: n - have] << have * bits | pair[have:]
        pair[n - have :] <<= have * bits
        have *= 2
    rank = np.empty(n, np.int64)
    while True:
        order = np.argsort(pair)
        s = pair[order]
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        pair = rank * (n + 1)
        pair[: n - have] += rank[have:] + 1
        have *= 2


def common_prefixes(bwt: np.ndarray, separators: int, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, where that is below ``depth``; else -1.

    ``bwt`` holds symbols; those below ``separators`` are ends, each unlike
    any other. A boundary of value l - 1 in front of row j, extended backward
    by symbol c, is the boundary in front of the image of the first c at or
    behind j, of value l unless it has a lower one. For the symbol of row j
    that is j itself; for others it is the head of the next run of c, the same
    for all rows of j's run, so each run is looked up once.
    """
    n = len(bwt)
    lcp = np.full(n, -1, np.int32)
    counts = np.bincount(bwt, minlength=separators)
    first = np.concatenate([[0], np.cumsum(counts)])
    lcp[: first[separators]] = 0
    lcp[first[separators:-1][counts[separators:] > 0]] = 0
    fresh = np.flatnonzero(lcp == 0)
    image = np.empty(n, np.int64)
    image[np.argsort(bwt, kind="stable")] = np.arange(n)
    inner = bwt >= separators
    heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    run = np.cumsum(np.concatenate([[0], bwt[1:] != bwt[:-1]]))
    symbols = np.flatnonzero(counts[separators:]) + separators
    number = np.full(len(counts), -1, np.int64)
    number[symbols] = np.arange(len(symbols))
    code = number[bwt[heads]]
    mine = np.flatnonzero(code >= 0)
    keys = code[mine] * len(heads) + mine
    by = np.argsort(keys)
    keys, key_head = keys[by], heads[mine[by]]
    # The row behind the run of the same symbol before; a first run's image is set already.
    ends = np.concatenate([heads[1:], [n]])
    since = np.where(np.concatenate([[False], code[mine[by]][1:] == code[mine[by]][:-1]]), ends[mine[by]][np.arange(len(by)) - 1], key_head)
    asked = np.zeros(len(heads), bool)
    for value in range(1, depth):
        if not len(fresh):
            break
        own = image[fresh[inner[fresh]]]
        own = own[lcp[own] < 0]
        runs = run[fresh]
        runs = np.unique(runs[~asked[runs]])
        asked[runs] = True
        if len(runs) * len(symbols) > n // 4:
            # Many runs: count the fresh boundaries behind each head's last equal symbol.
            upto = np.zeros(n + 1, np.int32)
            upto[fresh + 1] = 1
            np.cumsum(upto, out=upto)
            other = image[key_head[upto[key_head + 1] > upto[since]]]
        else:
            at = (np.arange(len(symbols))[:, None] * len(heads) + runs[None, :] + 1)[np.arange(len(symbols))[:, None] != code[runs][None, :]]
            i = np.searchsorted(keys, at)
            ok = i < len(keys)
            i, at = i[ok], at[ok]
            other = np.unique(image[key_head[i[keys[i] // len(heads) == (at - 1) // len(heads)]]])
        lcp[own] = value
        other = other[lcp[other] < 0]
        lcp[other] = value
        fresh = np.concatenate([own, other])
    return lcp


def repeated(segments: list[bytes], weights: list[int], min_len: int = MIN_LEN) -> list[np.ndarray]:
    """For each segment the places where a string of ``min_len`` starts that stands for two places or more."""
    k = len(segments)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"".join(segments), np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    small = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    small[used] = np.arange(1, len(used) + 1)
    # Symbol 0 is an end; the transform tells ends apart only by never extending them.
    text = np.zeros(int(ends[-1]), small.dtype)
    owner = np.repeat(np.arange(k), sizes + 1)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    text[inner] = small[data]
    order = suffix_order(text, min_len)
    lcp = common_prefixes(text[order - 1], 1, min_len)
    group = np.cumsum(lcp >= 0) - 1
    begins = np.concatenate([[0], ends[:-1]])
    place = order - begins[owner[order]]
    whole = place + min_len <= sizes[owner[order]]
    weight = np.bincount(group[whole], np.asarray(weights, float)[owner[order]][whole], int(group[-1]) + 1)
    hit = whole & (weight[group] >= 2)
    seg, at = owner[order][hit], place[hit]
    by = np.lexsort((at, seg))
    return np.split(at[by], np.searchsorted(seg[by], np.arange(1, k)))


def _runs(at: np.ndarray) -> np.ndarray:
    """Sorted places as (first, last) pairs of runs."""
    cut = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]], 1)


def _texts(batch) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if x else b"" for x in batch.column(1).to_pylist()]


def located(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns and (part, row): a hash of the file and of a range of its rows, and the row's place in the file."""
    try:
        at = docs.metadataColumn("_metadata")
        found = docs.select(*columns, at["file_path"].alias("_file"), at["row_index"].alias("row"))
        found.schema
    except AnalysisException:  # not read from files
        docs = materialize(docs, "documents")
        at = docs.metadataColumn("_metadata")
        found = docs.select(*columns, at["file_path"].alias("_file"), at["row_index"].alias("row"))
    return found.select(*columns, F.xxhash64("_file", F.expr(f"row div {FOLDER_ROWS}")).alias("part"), "row")


def _count(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Which counters of the gram hashes are crowded, and the shift that gives a hash's counter."""
    shift, pieces = 64 - COUNTERS, 16

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(1 << COUNTERS, np.uint32)
        held, size = [], 0
        for b in batches:
            for data in _texts(b):
                for i in range(0, len(data), SLICE):
                    held.append((gram_hashes(data[i : i + SLICE + GRAM - 1]) >> np.uint64(shift)).astype(np.uint32))
                    size += len(held[-1])
                    if size > 4 * SLICE:
                        total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total.astype("<u4"), pieces)])})

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(c, "<u4").astype(np.uint64)
        ps = list(sums)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(ps, pa.int32()), "counts": pa.array([sums[p].astype("<u8").tobytes() for p in ps], pa.binary())})

    rows = docs.mapInArrow(run, "piece int, counts binary").repartition(pieces, "piece").mapInArrow(merge, "piece int, counts binary").collect()  # 2 ** COUNTERS counts
    counts = np.zeros((pieces, (1 << COUNTERS) // pieces), np.uint64)
    for r in rows:
        counts[r["piece"]] = np.frombuffer(r["counts"], "<u8")
    counts = counts.ravel()
    return counts > max(FEW, np.partition(counts, -(len(counts) // FULLEST))[-(len(counts) // FULLEST)]), shift


def _segments(docs: DataFrame, crowded: np.ndarray, shift: int) -> DataFrame:
    """(anchor, seg, part, row, lo, len, z): every segment of every document; z is its anchor's place in it."""
    share = docs.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            segs: list[int] = []
            for i, data in enumerate(_texts(b)):
                h, pos, lo, hi = anchors(data, share.value, shift)
                if len(h):
                    size = hi - lo + MIN_LEN
                    segs += [digest(data[x : x + y], z) for x, y, z in zip(lo.tolist(), size.tolist(), (pos - lo).tolist(), strict=True)]
                    for c, v in zip(cols, (h.view(np.int64), np.full(len(h), i), lo, size, pos - lo), strict=True):
                        c.append(v)
            if segs:
                h, at, lo, size, z = (np.concatenate(c) for c in cols)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.array(segs, np.uint64).view(np.int64)), b.column(2).take(at), b.column(3).take(at), pa.array(lo), pa.array(size.astype(np.int32)), pa.array(z.astype(np.int32))],
                    names=["anchor", "seg", "part", "row", "lo", "len", "z"],
                )

    return docs.mapInArrow(run, "anchor long, seg long, part long, row long, lo long, len int, z int")


def _hand_back(df: DataFrame, name: str) -> str:
    """Writes rows in a folder for each part."""
    path = scratch(df.sparkSession, name)
    df.repartition("part").write.partitionBy("part").parquet(path)
    return path


def _own(path: str, part: int, columns: list[str]) -> dict[int, list[tuple]]:
    """The rows handed back to a part, by row."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = file_system(path)
    out: dict[int, list[tuple]] = {}
    folder = f"{root}/part={part}"
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return out
    for info in files.get_file_info(fs.FileSelector(folder)):
        if not info.base_name.endswith(".parquet") or info.base_name[0] in "._":
            continue
        with files.open_input_file(info.path) as f:
            t = pq.read_table(f, columns=["row", *columns])
        for row, *rest in zip(*[t.column(c).to_pylist() for c in ("row", *columns)], strict=True):
            out.setdefault(row, []).append(rest)
    return out


def _checked(data: bytes, lo: int, size: int, z: int, seg: int) -> bytes:
    """A segment's bytes, if they are what was hashed."""
    import xxhash

    own = data[lo : lo + size]
    if xxhash.xxh3_64_intdigest(own, z) != seg & (1 << 64) - 1:
        raise RuntimeError("the documents changed between two scans")
    return own


def neighbourhoods(anchor: int, data: bytes, z: int) -> list[tuple[int, int, bytes]]:
    """(key, offset, bytes) of a segment's windows by the bytes that they share beside the anchor, right or left."""
    import xxhash

    out, last = [], len(data) - MIN_LEN
    key = lambda side, a, b: xxhash.xxh3_64_intdigest(anchor.to_bytes(8, "little", signed=True) + side + data[a:b]) - (1 << 63)
    first = max(0, z - _SIDE)
    if first <= last:
        out.append((key(b"r", z, z + GRAM + _SIDE), first, data[first:]))
    if first > 0:
        end = min(last, first - 1)
        out.append((key(b"l", z - _SIDE, z + GRAM), 0, data[: end + MIN_LEN]))
    return out


def _fetch(docs: DataFrame, path: str) -> DataFrame:
    """(key, anchor, seg, n, off, data): the bytes of the wanted segments, split where their anchor is crowded."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, want = None, {}
        for b in batches:
            out: list[tuple] = []
            for data, part, row in zip(_texts(b), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if part != at:
                    at, want = part, _own(path, part, ["anchor", "seg", "n", "lo", "len", "z", "crowd"])
                for anchor, seg, n, lo, size, z, crowd in want.get(row, ()):
                    own = _checked(data, lo, size, z, seg)
                    for key, off, x in neighbourhoods(anchor, own, z) if crowd else [(anchor, 0, own)]:
                        out.append((key, anchor, seg, n, off, x))
            if out:
                cols, names = list(zip(*out, strict=True)), ["key", "anchor", "seg", "n", "off", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "data" else pa.int64()) for c, x in zip(cols, names, strict=True)], names=names)

    return docs.mapInArrow(run, "key long, anchor long, seg long, n long, off long, data binary")


def _search(segments: DataFrame) -> DataFrame:
    """(anchor, seg, runs): for each segment with repeated windows, the (first, last) of their runs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(block: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (_, anchor, seg, _, off, _), at in zip(block, repeated([x[5] for x in block], [x[3] for x in block]), strict=True):
                if len(at):
                    out.append((anchor, seg, (_runs(at) + off).astype("<i8").tobytes()))
            anchors, segs, runs = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(segs, pa.int64()), pa.array(runs, pa.binary())], names=["anchor", "seg", "runs"])

        block, size = [], 0
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size >= BLOCK and r[0] != block[-1][0]:
                    yield rows(block)
                    block, size = [], 0
                block.append(r)
                size += len(r[5])
        if block:
            yield rows(block)

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, "anchor long, seg long, runs binary")


def _spans(docs: DataFrame) -> str:
    """Finds all repeated windows; returns the folder of (row, lo, len, z, seg, runs) by part, runs null for a whole segment."""
    spark = docs.sparkSession
    crowded, shift = _count(docs)
    segs = materialize(_segments(docs, crowded, shift), "segments")
    each = segs.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("part", "row", "lo", "len", "z")).alias("at"))
    by = Window.partitionBy("anchor")
    known = each.withColumn("all", F.sum("n").over(by)).withColumn("kinds", F.count("*").over(by)).where("all > 1")
    known = materialize(known.select("anchor", "seg", "n", "kinds", "at.*"), "known")
    want = _hand_back(known.where("kinds > 1").withColumn("crowd", F.col("kinds") > SPLIT).drop("kinds"), "wanted")
    # A segment that is alone with its anchor and stands in several places repeats as a whole.
    alone = known.where("kinds = 1").select("anchor", "seg", F.lit(None).cast("binary").alias("runs"))
    found = materialize(_search(_fetch(docs, want)).union(alone), "repeats")
    remove(spark, want)
    remove(spark, known.scratch_path)
    path = _hand_back(segs.join(found, ["anchor", "seg"]).select("part", "row", "lo", "len", "z", "seg", "runs"), "spans")
    remove(spark, segs.scratch_path)
    remove(spark, found.scratch_path)
    return path


def _cut(data: bytes, own: list[tuple]) -> tuple[int, int, list[bytes]]:
    """(bytes removed, removed runs, parts kept) of a text; ``own`` has (lo, len, z, seg, runs)."""
    if not own:
        return 0, 0, [data]
    for lo, size, z, seg in {x[:4] for x in map(tuple, own)}:
        _checked(data, lo, size, z, seg)
    whole = np.array([(lo, lo + size - MIN_LEN) for lo, size, _, _, r in own if r is None], np.int64).reshape(-1, 2)
    runs = np.concatenate([whole, *[np.frombuffer(r, "<i8").reshape(-1, 2) + lo for lo, _, _, _, r in own if r is not None]])
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    a, b = runs[:, 0], np.maximum.accumulate(runs[:, 1] + MIN_LEN)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    a, b = a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]
    kept = [data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True)]
    return int((b - a).sum()), len(a), kept


def _apply(docs: DataFrame, path: str, text: bool) -> DataFrame:
    """A row per document of (doc_id, text, part, row, ...): its digest, or its remaining text."""
    last = "text string" if text else "kept_sha256 string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, own = None, {}
        for b in batches:
            out: list[list] = [[], [], [], []]
            for data, part, row in zip(_texts(b), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if part != at:
                    at, own = part, _own(path, part, ["lo", "len", "z", "seg", "runs"])
                gone, spans, kept = _cut(data, own.get(row, []))
                for c, v in zip(out, (len(data), gone, spans, kept), strict=True):
                    c.append(v)
            if text:
                # Each part by itself, so that halves of two characters never make a third.
                tail = ["".join([x.decode("utf-8", "ignore") for x in parts]) for parts in out[3]]
            else:
                tail = [hashlib.sha256(b"".join(parts)).hexdigest() for parts in out[3]]
            cols = [b.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(tail, pa.string()), *[b.column(i) for i in range(4, b.num_columns)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0], *b.schema.names[4:]])

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[4:])
    return docs.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}{extra}")


def _base(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "part", "row")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    arrow_rows(docs.sparkSession, 500)
    docs = _base(located(docs, "doc_id", "text"))
    return _apply(docs, _spans(docs), False)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated strings; a character cut in two goes whole.

    Where there is an ``n_chars``, it counts the remaining text.
    """
    arrow_rows(docs.sparkSession, 500)
    names = docs.columns
    rest = {c: f"_x{i}" for i, c in enumerate(x for x in names if x not in ("doc_id", "text"))}
    at = located(docs.select("doc_id", "text", *[F.col(c).alias(a) for c, a in rest.items()]), "doc_id", "text", *rest.values())
    base = _base(at)
    wide = at.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "part", "row", *rest.values())
    out = _apply(wide, _spans(base), True)
    cols = []
    for c in names:
        if c == "n_chars":
            cols.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        elif c == "text":
            cols.append(F.when(F.col("n_bytes") >= 0, F.col("text")).alias("text"))
        else:
            cols.append(F.col(rest.get(c, c)).alias(c))
    return out.select(*cols)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table."""
    return removals(table(spark, sf_dir, "documents"))

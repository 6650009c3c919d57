"""MinHash near-duplicates by an LSH forest.

Documents become sets of word shingles (64-bit hashes) and signatures of
``SIG`` minima. Equal sets are one class from then on. Each class stands once
in every one of ``TREES`` sorted orders of its signature; in an order, the
nearest classes by longest common prefix are candidates when they share
``MIN_DEPTH`` values, so that a crowded region is searched as deep as its
neighbours agree and a sparse one no deeper than needed. Orders are
range-partitioned, so a crowded region spreads over tasks. Candidates are
confirmed on the full sets: first the closest one of each class, then all
others that still lie in different components.

Where more classes share ``MIN_DEPTH`` values than the reach covers, a link
need not be a neighbour in any order. Such crowds are dealt in blocks; the
classes outside a crowd's largest component pass each block, by signatures
first and then, for those with a likely partner, by full sets. A block writes
links that join its components to a forest, and never pairs.

Edge cases: texts without words (null, empty) have an empty set and link with
nothing; a text of fewer words than a shingle is one shingle; rows that repeat
a doc_id are one vertex; a row without doc_id links with nothing, has a null
component and is kept; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, arrow_rows, connected_components, drop, materialize, numbered, table

SIG = 64
TREES = 16
#: Values of a signature that an order compares.
DEPTH = 8
MIN_DEPTH = SIG // TREES
#: Neighbours looked at on each side in an order.
REACH = 2
#: Shingles and classes of a block of a crowd: some 100 MB of a worker at most.
BLOCK_SHINGLES, BLOCK_CLASSES = 4_000_000, 8_192
#: Standard deviations by which a signature may fall short of the similarity.
SPREAD = 5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MAX_WORDS = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C1
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Turns texts into sorted arrays of distinct shingle hashes."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array for each text."""
        import xxhash

        cut = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() if t else [] for t in texts]
        if len(self.known) > _MAX_WORDS:
            self.known.clear()
        for w in set().union(*cut).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        out = []
        for words in cut:
            h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            k = min(self.k, len(h))
            if not k:
                out.append(h)
                continue
            s = np.full(len(h) - k + 1, np.uint64(k))
            for i in range(k):
                s = _mix(s * _C2 + h[i : i + len(s)])
            out.append(np.unique(s))
        return out


@lru_cache(2)
def worker_shingler(k: int) -> Shingler:
    """The shingler of this Python worker, kept from task to task."""
    return Shingler(k)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SIG 32-bit minima for each set; sets must not be empty."""
    rng = np.random.default_rng(20)
    mul, add = rng.integers(1, 2**63, SIG, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, SIG, np.uint64)
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), SIG), np.uint32)
    for i in range(SIG):
        h = flat * mul[i] + add[i]
        h ^= h >> np.uint64(31)
        h *= _C3
        out[:, i] = np.minimum.reduceat(h, at) >> np.uint64(32)
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig); key and signature are null for an empty set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        sh = worker_shingler(k)
        for b in batches:
            sets = sh.sets(b.column(1).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            if full:
                rows = signatures([sets[i] for i in full]).astype(">u4")
                for i, r in zip(full, rows, strict=True):
                    sig[i] = r.tobytes()
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _orders(reps: DataFrame) -> DataFrame:
    """(tree, ord, rep, size): each class in every order; ord holds DEPTH values, big-endian."""
    width, step = 4 * DEPTH, 4 * SIG // TREES
    ring = F.concat("sig", F.substring("sig", 1, width))
    parts = F.array(*[F.substring(ring, 1 + t * step, width) for t in range(TREES)])
    return reps.select("rep", F.col("size").cast("int").alias("size"), F.posexplode(parts).alias("tree", "ord"))


def candidates(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, lcp, fit): classes that are neighbours in an order, a before b there.

    ``fit`` tells whether the sizes of their sets allow the similarity at all.
    """

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(a, b, lcp, fit, tree, order, size) -> pa.RecordBatch:
            types = {"a": pa.int64(), "b": pa.int64(), "lcp": pa.int32(), "fit": pa.bool_(), "tree": pa.int32(), "ord": pa.binary(), "size": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, b, lcp, fit, tree, order, size), types.values(), strict=True)], names=list(types))

        def edge(tree, rep, order, size) -> pa.RecordBatch:
            none = [None] * len(rep)
            return rows(rep, none, none, none, tree, [o.tobytes() for o in order], size)

        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, rep, size = (batch.column(c).to_numpy() for c in ("tree", "rep", "size"))
            order = np.frombuffer(b"".join(batch.column("ord").to_pylist()), ">u4").reshape(-1, DEPTH)
            fresh = tail is None
            if not fresh:
                tree, rep, order, size = (np.concatenate(x) for x in zip(tail, (tree, rep, order, size), strict=True))
            old = 0 if fresh else len(tail[0])
            for d in range(1, REACH + 1):
                if len(rep) <= d:
                    break
                same = np.cumprod(order[:-d] == order[d:], axis=1).sum(1)
                ok = (same >= MIN_DEPTH) & (tree[:-d] == tree[d:]) & (rep[:-d] != rep[d:]) & (np.arange(d, len(rep)) >= old)
                if ok.any():
                    none = [None] * int(ok.sum())
                    x, y = size[:-d][ok].astype(np.int64), size[d:][ok].astype(np.int64)
                    yield rows(rep[:-d][ok], rep[d:][ok], same[ok], den * np.minimum(x, y) >= num * np.maximum(x, y), none, none, none)
            if fresh:
                yield edge(tree[:REACH], rep[:REACH], order[:REACH], size[:REACH])
            tail = (tree[-REACH:], rep[-REACH:], order[-REACH:], size[-REACH:])
        if tail is not None:
            yield edge(*tail)

    placed = _orders(reps).repartitionByRange("tree", "ord", "rep").sortWithinPartitions("tree", "ord", "rep")
    found = materialize(placed.mapInArrow(near, "a long, b long, lcp int, fit boolean, tree int, ord binary, size int"), "neighbours")
    # Neighbours on both sides of a border between partitions: a few rows of each partition.
    w = Window.partitionBy("tree").orderBy("ord", "a")
    border = found.where("b is null").select("tree", "ord", "a", "size").distinct()
    fit = F.lit(den) * F.least("size", "s2").cast("long") >= F.lit(num) * F.greatest("size", "s2").cast("long")
    same = lambda other: sum((F.substring("ord", 1, 4 * (i + 1)) == F.substring(other, 1, 4 * (i + 1))).cast("int") for i in range(DEPTH))
    across = [
        border.select("a", "ord", "size", *[F.lead(c, d).over(w).alias(n) for c, n in (("a", "b"), ("ord", "o2"), ("size", "s2"))]).select("a", "b", same("o2").alias("lcp"), fit.alias("fit"))
        for d in range(1, REACH + 1)
    ]
    out = found.where("b is not null").select("a", "b", "lcp", "fit")
    for x in across:
        out = out.union(x.where(f"b is not null and a <> b and lcp >= {MIN_DEPTH}"))
    return out.groupBy("a", "b").agg(F.max("lcp").alias("lcp"), F.max("fit").alias("fit"))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (u, v) of ``pairs`` (a, b) whose full sets have den * intersection >= num * union.

    Texts meet at their pair's first member; a task holds that member's set
    and streams the others past it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sh, at, first = worker_shingler(k), None, []
        for b in batches:
            u, v = [], []
            for blk, doc, side, s in zip(b.column("blk").to_pylist(), b.column("doc").to_pylist(), b.column("side").to_pylist(), sh.sets(b.column("text").to_pylist()), strict=True):
                if blk != at:
                    at, first = blk, []
                if side == 0:
                    first.append(s)
                    continue
                for f in first:
                    both = len(np.intersect1d(f, s, True))
                    if both and den * both >= num * (len(f) + len(s) - both):
                        u.append(blk)
                        v.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    need = pairs.select(F.col("a").alias("blk"), F.col("a").alias("doc"), F.lit(0).alias("side")).distinct().union(
        pairs.select(F.col("a").alias("blk"), F.col("b").alias("doc"), F.lit(1).alias("side"))
    )
    rows = need.hint("merge").join(texts, "doc").repartition("blk").sortWithinPartitions("blk", "side", "doc")
    return rows.select("blk", "doc", "side", "text").mapInArrow(run, "u long, v long")


def crowds(reps: DataFrame, comp: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(blk, tree, side, rep, comp, size, sig): blocks of the crowds that hold several components; and the tables it reads.

    Side 0 has each class of a crowd once; side 1 has those outside its largest component, once a block.
    """
    width, step = 4 * MIN_DEPTH, 4 * SIG // TREES
    known = reps.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp"), "size", "sig")
    known = materialize(known, "known")
    starts = F.array(*[F.substring("sig", 1 + t * step, width) for t in range(TREES)])
    placed = known.select("rep", "comp", "size", F.posexplode(starts).alias("tree", "start"))
    parts = placed.groupBy("tree", "start", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("tree", "start").agg(F.sum("n").alias("n"), F.sum("size").alias("all"), F.count("*").alias("parts"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    blocks = F.ceil(F.greatest(F.col("all") / BLOCK_SHINGLES, F.col("n") / BLOCK_CLASSES)).cast("int")
    whole = materialize(whole.where(f"n > {REACH + 1} and parts > 1").select("tree", "start", "main", blocks.alias("blocks")), "crowds")
    rows = placed.join(whole, ["tree", "start"])
    own = F.struct(F.lit(0).alias("side"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("at"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("at")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("comp") == F.col("main"), F.array(own)).otherwise(F.concat(F.array(own), each))))
    rows = rows.select(F.xxhash64("tree", "start", "to.at").alias("blk"), "tree", F.col("to.side").alias("side"), "rep")
    return rows.join(known, "rep").select("blk", "tree", "side", "rep", "comp", "size", "sig"), [known, whole]


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Beginning and end of each run of equal keys."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(keys) else []


def likely(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(blk, side, rep, comp) of the rows of ``crowds`` that may have a link between components.

    Signatures may fall short of the similarity by SPREAD deviations; a pair
    that meets in an earlier order is left to that one.
    """
    p, per = num / den, SIG // TREES
    least = int(SIG * p - SPREAD * (SIG * p * (1 - p)) ** 0.5)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(blk, side, reps, comps) -> pa.RecordBatch:
            n = len(reps)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, blk), pa.int64()), pa.array(np.full(n, side), pa.int32()), pa.array(reps, pa.int64()), pa.array(comps, pa.int64())], names=["blk", "side", "rep", "comp"])

        at, held, need = None, [], None
        for b in batches:
            blks, side, tree, reps, comps, size = (b.column(c).to_numpy() for c in ("blk", "side", "tree", "rep", "comp", "size"))
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), ">u4").astype(np.uint32).reshape(-1, SIG)
            for lo, hi in _runs(blks * 2 + side):
                rows = (reps[lo:hi], comps[lo:hi], size[lo:hi], sig[lo:hi])
                if blks[lo] != at:
                    if need is not None and need.any():
                        yield out(at, 0, held[0][need], held[1][need])
                    at, held, need = blks[lo], None, None
                if side[lo] == 0:
                    held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
                    need = np.zeros(len(held[0]), bool)
                if side[lo] == 0 or held is None:
                    continue
                _, tc, ts, tg = held
                _, qc, qs, qg = rows
                same, met = np.zeros((hi - lo, len(tc)), np.uint8), np.zeros((hi - lo, len(tc)), bool)
                for g in range(TREES):
                    every = np.ones(same.shape, bool)
                    for i in range(g * per, (g + 1) * per):
                        eq = qg[:, i : i + 1] == tg[:, i]
                        same += eq
                        every &= eq
                    if g < tree[lo]:
                        met |= every
                fit = den * np.minimum(qs[:, None], ts) >= num * np.maximum(qs[:, None], ts)
                ok = (same >= least) & ~met & fit & (qc[:, None] != tc)
                need |= ok.any(0)
                q = ok.any(1)
                if q.any():
                    yield out(at, 1, rows[0][q], rows[1][q])
        if need is not None and need.any():
            yield out(at, 0, held[0][need], held[1][need])

    dealt = rows.repartition("blk").sortWithinPartitions("blk", "side")
    return dealt.mapInArrow(run, "blk long, side int, rep long, comp long")


def confirm_crowds(rows: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(u, v): components that links between full sets join, a spanning forest of each block."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sh, at, held, index, up = worker_shingler(k), None, [], None, {}

        def root(c: int) -> int:
            while (to := up.get(c, c)) != c:
                up[c] = c = up.get(to, to)
            return c

        for b in batches:
            blks, side, comps = (b.column(c).to_numpy() for c in ("blk", "side", "comp"))
            us, vs = [], []
            for i, s in enumerate(sh.sets(b.column("text").to_pylist())):
                if blks[i] != at:
                    at, held, index, up = blks[i], [], None, {}
                if side[i] == 0:
                    held.append((comps[i], s))
                    continue
                if not held:
                    continue
                if index is None:
                    sizes = np.array([len(x[1]) for x in held])
                    flat, owner = np.concatenate([x[1] for x in held]), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(flat, kind="stable")
                    index = (flat[order], owner[order], sizes, np.array([x[0] for x in held]))
                flat, owner, sizes, theirs = index
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                both = np.zeros(len(sizes), np.int64)
                for c in range(0, len(s), 2_000):
                    n = hi[c : c + 2_000] - lo[c : c + 2_000]
                    first = np.repeat(lo[c : c + 2_000] - np.cumsum(n) + n, n)
                    both += np.bincount(owner[first + np.arange(len(first))], minlength=len(sizes))
                own = int(comps[i])
                for c in np.unique(theirs[(both > 0) & (den * both >= num * (sizes + len(s) - both))]).tolist():
                    x, y = root(own), root(c)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        us.append(own)
                        vs.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    dealt = rows.hint("merge").join(texts.withColumnRenamed("doc", "rep"), "rep").repartition("blk").sortWithinPartitions("blk", "side")
    return dealt.select("blk", "side", "comp", "text").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of (doc_id, text)."""
    arrow_rows(docs.sparkSession, 500)
    rows = materialize(sketch(docs, k), "sketches")
    some = rows.where("set_key is not null and doc_id is not null")
    reps = materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size")), "classes")
    pairs = every = materialize(candidates(reps, num, den), "pairs")
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null")
    # The same join at every size: the classes wanted grow with the documents.
    texts = materialize(texts.join(wanted.hint("merge"), "doc", "left_semi"), "texts")
    # Crowds are sought among all neighbours; sets of unfit sizes need no confirmation.
    pairs = pairs.where("fit").drop("fit")
    closest = pairs.groupBy("b").agg(F.max_by("a", F.struct("lcp", "a")).alias("a"))
    links = materialize(confirm(closest, texts, k, num, den), "links")
    comp = materialize(connected_components(links), "components")
    left = (
        pairs.join(closest.withColumn("done", F.lit(True)), ["a", "b"], "left").where("done is null")
        .join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .where("coalesce(ca, a) <> coalesce(cb, b)")
        .select("a", "b")
    )
    left = materialize(left, "left")
    more = materialize(confirm(left, texts, k, num, den), "links")
    blocks, read = crowds(reps.select("rep", "sig", "size"), comp)
    near = materialize(likely(blocks, num, den), "likely")
    joined = materialize(confirm_crowds(near, texts, k, num, den).distinct(), "links")
    drop(every, texts, left, near, *read)
    # A doc_id that stands in several classes joins them.
    member = some.select("doc_id", "set_key").join(reps.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    named = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("hi")).where("u <> hi")
    both = member.join(named, "doc_id").select("u", F.col("rep").alias("v")).where("u <> v")
    stars = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
    first, comp = comp, connected_components(stars.union(more).union(joined).union(both))
    drop(links, first, more, joined)
    last = rows.drop("sig").join(reps.select("set_key", "rep"), "set_key", "left")
    last = last.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    own = F.coalesce("component", "rep", "doc_id")
    return last.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id.

    Every row is a document here, also where it repeats a doc_id or has none;
    a row with a doc_id is kept before one without.
    """
    rows = numbered(docs)
    near = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), k, num, den).select(F.col("doc_id").alias("at"), "component_id")
    near = materialize(near.join(rows.select(F.col(ROW).alias("at"), F.col("doc_id").cast("long").alias("id")), "at"), "groups")
    first = near.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first")).where("n > 1")
    gone = near.join(first, "component_id").where("at <> first.at").select(F.col("at").alias(f"{ROW}_gone"))
    return rows.join(gone.hint("merge"), rows[ROW] == gone[f"{ROW}_gone"], "left_anti").drop(ROW)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by three-word shingles and a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85, 100)

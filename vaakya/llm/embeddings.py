"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest of ``pivots`` reference
points, which come from a bounded sample and lie apart, so that no group of
near copies holds several. Inverted lists are kept for sets of ``SHARED``
pivots: a vector stands in the list of every such subset of its nearest
pivots, so two vectors meet exactly if they share that many. Lists hold
numbers; a vector joins the lists that have more than one. A pair is verified
in the smallest list that both stand in, in double precision, in blocks; a
long list is cut into blocks of ``BLOCK`` vectors and every pair of blocks is
a task's work of bounded size. Equal vectors of a label are one beforehand,
with their number as weight. Only counts and one edge per vector and block
leave a block.

Edge cases: a null label or a vector that is null, empty, zero or holds null
or non-finite parts links with nothing; vectors of different lengths do not
link; rows that repeat a vec_id are one vertex and each counts as a vector; a
row without vec_id is neither linked nor counted, has a null component and is
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, connected_components, materialize, table

THRESHOLD = 0.98
NEAREST = 6
SHARED = 3
#: The index is fitted on a sample of at most this many vectors.
SAMPLE = 1024
PIVOTS = 64
#: Pivots end where the farthest vector of the sample is this near to one.
APART = 0.9
BLOCK = 2048
_SUBSETS = list(combinations(range(NEAREST), SHARED))


def _unit(rows: list[list[float]] | np.ndarray) -> np.ndarray:
    x = np.array(rows, np.float64)
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-point pivots of a sample of unit vectors; fewer than n once all of it is near to one."""
    if not len(sample):
        return sample
    best, near = [0], sample @ sample[0]
    while len(best) < min(n, len(sample)):
        i = int(np.argmin(near))
        if near[i] > APART:
            break
        best.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[best]


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The sorted numbers of each vector's nearest pivots; -1 where there are fewer."""
    k = min(NEAREST, len(pivots))
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]
    out = np.full((len(x), NEAREST), -1, np.int64)
    out[:, NEAREST - k :] = np.sort(order, axis=1)
    return out


def list_keys(near: np.ndarray) -> np.ndarray:
    """A row of list keys for each vector: one for each subset of SHARED of its pivots."""
    keys = np.zeros((len(near), len(_SUBSETS)), np.int64)
    for j, s in enumerate(_SUBSETS):
        for i in s:
            keys[:, j] = keys[:, j] << 12 | (near[:, i] + 1)
    return keys


def smallest_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of sorted pivots a and b, the key of their SHARED smallest common pivots; -1 if fewer are shared."""
    key, found = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for i in range(NEAREST):
        both = (a[:, i : i + 1] == b).any(1) & (found < SHARED)
        key[both] = key[both] << 12 | (a[both, i] + 1)
        found += both
    return np.where(found >= SHARED, key, -1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each place's component under the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rep, n) counts of linked vectors and (u, v) edges of (label, embedding, rep, weight).

    ``single`` tells that all parts are single-precision numbers, and so may travel as such.
    """
    spark, kind = vectors.sparkSession, "<f4" if single else "<f8"
    vectors = vectors.withColumn("d", F.size("embedding"))
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").collect()  # at most SAMPLE rows
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    share = spark.sparkContext.broadcast({d: choose_pivots(_unit(x), pivots) for d, x in by_dim.items()})

    def post(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            size = b.column("d").to_numpy()
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                raw = np.array(part.column("embedding").to_pylist(), np.float64)
                # Where the sample has no vector of this length, all meet in one list.
                own = share.value.get(d, np.zeros((0, d)))
                near = nearest(_unit(raw), own)
                keys = [np.unique(k) for k in list_keys(near)]
                packed, x = pa.array([r.tobytes() for r in near.astype("<i2")], pa.binary()), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("d"), pa.array(keys, pa.list_(pa.int64())), part.column("rep"), part.column("weight"), packed, x],
                    names=["label", "d", "keys", "rep", "weight", "near", "x"],
                )

    placed = materialize(
        vectors.select("label", "d", "rep", "weight", "embedding").mapInArrow(post, "label long, d int, keys array<bigint>, rep long, weight long, near binary, x binary"),
        "placed",
    )
    lists = placed.select("label", "d", F.explode("keys").alias("key"), "rep")
    sizes = lists.groupBy("label", "d", "key").agg(F.count("*").alias("m")).where("m > 1")
    # A list of b blocks becomes b (b + 1) / 2 tiles; a vector stands in b of them.
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("b")).cast("int")
    tiles = (
        lists.join(sizes.withColumn("b", blocks), ["label", "d", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        .select("label", "d", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")
        .join(placed.select("rep", "weight", "near", "x"), "rep")
    )

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solve(rows: list[dict]) -> pa.RecordBatch | None:
            x = _unit(np.frombuffer(b"".join(r["x"] for r in rows), kind).reshape(len(rows), -1))
            near = np.frombuffer(b"".join(r["near"] for r in rows), "<i2").reshape(-1, NEAREST).astype(np.int64)
            rep, weight = np.array([r["rep"] for r in rows]), np.array([r["weight"] for r in rows])
            own = np.array([r["own"] for r in rows])
            cross = rows[0]["i"] != rows[0]["j"]
            n, us, vs = np.zeros(len(rows), np.int64), [], []
            for at in range(0, len(rows), 512):
                close = x[at : at + 512] @ x.T >= threshold - 1e-9
                u, v = np.nonzero(close)
                u = u + at
                ok = (u < v) & ((own[u] != own[v]) if cross else True)
                u, v = u[ok], v[ok]
                for s in range(0, len(u), 200_000):
                    a, b = u[s : s + 200_000], v[s : s + 200_000]
                    good = (np.einsum("ij,ij->i", x[a], x[b]) >= threshold) & (smallest_shared(near[a], near[b]) == rows[0]["key"])
                    a, b = a[good], b[good]
                    n += np.bincount(a, weight[b], len(rows)).astype(np.int64) + np.bincount(b, weight[a], len(rows)).astype(np.int64)
                    us.append(a)
                    vs.append(b)
            if not n.any():
                return None
            root = _roots(len(rows), np.concatenate(us), np.concatenate(vs))
            hit = n > 0
            return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(rep[root[hit]]), pa.array(n[hit])], names=["rep", "root", "n"])

        at, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                tile = (r["label"], r["d"], r["key"], r["i"], r["j"])
                if tile != at:
                    if len(rows) > 1 and (out := solve(rows)) is not None:
                        yield out
                    at, rows = tile, []
                rows.append(r)
        if len(rows) > 1 and (out := solve(rows)) is not None:
            yield out

    tile = ["label", "d", "key", "i", "j"]
    done = materialize(tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(verify, "rep long, root long, n long"), "links")
    return done.groupBy("rep").agg(F.sum("n").alias("n")), done.select(F.col("rep").alias("u"), F.col("root").alias("v"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    arrow_rows(vectors.sparkSession, 2000)
    e = F.col("embedding")
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = materialize(
        vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), e.cast("array<double>").alias("embedding"))
        .withColumn("ok", sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
        .withColumn("same", F.when(F.col("ok"), F.sha2(F.array_join(F.transform("embedding", lambda v: (v + 0.0).cast("string")), ",").cast("binary"), 256))),
        "vectors",
    )
    good = rows.where("ok").drop("ok")
    classes = good.groupBy("label", "same").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    counts, edges = links(classes.select("label", "embedding", "rep", "weight"), threshold, pivots, vectors.schema["embedding"].dataType.simpleString() == "array<float>")
    # A vec_id that stands in several classes joins them.
    member = good.join(classes.select("label", "same", "rep"), ["label", "same"]).select("vec_id", "rep")
    several = member.groupBy("vec_id").agg(F.min("rep").alias("u"), F.max("rep").alias("hi")).where("u <> hi")
    comp = connected_components(edges.union(member.join(several, "vec_id").select("u", F.col("rep").alias("v")).where("u <> v")))
    info = classes.drop("embedding").join(counts, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    info = info.select("label", "same", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("group"))
    smallest = info.groupBy("group").agg(F.min("first").alias("comp"))
    info = info.join(smallest, "group").select("label", "same", "links", "comp")
    out = rows.drop("embedding").join(info, ["label", "same"], "left")
    comp_id = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), comp_id).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the embeddings table."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))

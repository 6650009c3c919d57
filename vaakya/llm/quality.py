"""Quality grades by ordinal cumulative-link regression on hashed text.

Ratings are grades 0 (toxic), 1 (poor) and 2 (good). A document is the set of
its words and of a few binned shape features, hashed to ``BITS`` bits; one
weight vector w is shared by ordered thresholds t1 < t2, and
P(grade >= j) = sigmoid(w . x - t_j). That gives the expected grade and the
tail probability of the best grade, by which documents are selected.

The fit takes at most ``MAX_LABELLED`` labelled rows, those whose doc_id
hashes lowest; features seen in fewer than ``MIN_DOCS`` of them have no
weight. Everything else reads all rows.

Edge cases: null and empty texts have the shape features of an empty text;
labels that are null, or whose doc_id is null or absent, are not used; with no
label at all every document gets the best grade and is kept; rows that repeat
a doc_id are graded alone; an empty table gives an empty result; other columns
are not read by ``grade`` and kept by ``select``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table, trim

BITS = 20
GRADES = 3
MAX_LABELLED = 20_000
MIN_DOCS = 3
#: Standard deviations that a word's share of bad ratings must be off.
APART = 3.5
#: Places at the end kept for shape features.
SHAPES = 4096
#: Sets that the fit looks at together.
FIT_ROWS = 1_000
STEPS = 150
#: Penalty on squared weights, per labelled row.
RIDGE = 5e-5
KEEP = 0.5
_STRIP = ".,;:!?\"'()[]{}<>*%$#&|"
_MAX_WORDS = 400_000


class Features:
    """Hashed features of texts; words already seen are looked up."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hash(self, name: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(name)
        size = 1 << BITS
        return size - SHAPES + h % SHAPES if name[:1] == "\0" else h % (size - SHAPES)

    def _shape(self, text: str, words: list[str], distinct: int) -> list[str]:
        n = max(len(text), 1)
        letters = len(re.findall(r"[^\W\d_]", text))
        upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
        marks = len(re.findall(r"[!|*%$#&]", text))
        digits = len(re.findall(r"\d", text))
        level = lambda part, whole: (1000 * part // max(whole, 1)).bit_length()
        bins = {
            "upper": level(upper, letters),
            "marks": level(marks, n),
            "digits": level(digits, n),
            "other": level(n - letters, n),
            "distinct": 10 * distinct // max(len(words), 1),
            "words": len(words).bit_length(),
        }
        return [f"\0{k}={int(v)}" for k, v in bins.items()]

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Distinct feature places of each text."""
        if len(self.known) > _MAX_WORDS:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            text = text or ""
            words = text.lower().split()
            own = set(words)
            for w in own:
                if w not in known:
                    known[w] = self._hash(w.strip(_STRIP) or w)
            ids = {known[w] for w in own}
            ids.update(self._hash(x) for x in self._shape(text, words, len(own)))
            out.append(np.fromiter(ids, np.int64, len(ids)))
        return out


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, sets: list[np.ndarray]) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        flat = np.concatenate([*sets, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        score = np.bincount(owner, self.weights[flat], len(sets))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(sets: list[np.ndarray], grades: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by Adam on whole gradients.

    Sets are read ``FIT_ROWS`` at a time, so that only the features with a weight stand in memory together.
    """
    size = 1 << BITS
    if not sets:
        return Model(np.zeros(size, np.float32), np.full(GRADES - 1, -40.0))
    n, y = len(sets), np.asarray(grades)
    bad = y < GRADES - 1
    seen, with_bad = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for lo in range(0, n, FIT_ROWS):
        part = sets[lo : lo + FIT_ROWS]
        seen += np.bincount(np.concatenate(part), minlength=size)
        part = [s for s, b in zip(part, bad[lo : lo + FIT_ROWS], strict=True) if b]
        if part:
            with_bad += np.bincount(np.concatenate(part), minlength=size)
    # Words are kept if they go with bad or good ratings more than chance allows; shapes always.
    used, p0 = np.flatnonzero(seen), np.clip(bad.mean(), 1e-6, 1 - 1e-6)
    seen, with_bad = seen[used], with_bad[used]
    away = np.abs(with_bad - seen * p0) / np.sqrt(np.maximum(seen * p0 * (1 - p0), 1e-9))
    used = used[((seen >= min(MIN_DOCS, n)) & (away >= APART)) | (used >= size - SHAPES)]
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    flats, sizes = [], []
    for lo in range(0, n, FIT_ROWS):
        part = sets[lo : lo + FIT_ROWS]
        at = place[np.concatenate(part)]
        sizes.append(np.bincount(np.repeat(np.arange(len(part)), [len(s) for s in part]), at >= 0, len(part)).astype(np.int64))
        flats.append(at[at >= 0])
    flat, owner = np.concatenate(flats).astype(np.int64), np.repeat(np.arange(n), np.concatenate(sizes))
    del flats, place
    share = np.array([(np.sum(y < j) + 0.5) / (n + 1) for j in range(1, GRADES)])
    t0 = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), [t0[0]], np.log(np.maximum(np.diff(t0), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[: len(used)], np.exp(p[len(used) + 1 :])
        t = p[len(used)] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(owner, w[flat], n)
        edges = np.concatenate([np.full((n, 1), np.inf), s[:, None] - t[None, :], np.full((n, 1), -np.inf)], 1)
        tail = np.concatenate([np.ones((n, 1)), _sigmoid(edges[:, 1:-1]), np.zeros((n, 1))], 1)
        slope = tail * (1 - tail)
        at = np.arange(n)
        like = np.maximum(tail[at, y] - tail[at, y + 1], 1e-12)
        g_up, g_down = slope[at, y] / like, slope[at, y + 1] / like
        g_s = -(g_up - g_down) / n
        g_t = np.array([(np.sum(g_up[y == j]) - np.sum(g_down[y == j - 1])) / n for j in range(1, GRADES)])
        grad = np.concatenate([np.bincount(flat, g_s[owner], len(used)) + RIDGE * w, [g_t.sum()], [gaps[i] * g_t[i + 1 :].sum() for i in range(GRADES - 2)]])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = p[: len(used)]
    return Model(weights, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Fits the model to at most ``limit`` labelled rows."""
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(GRADES - 1)
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null")
    some = usable.select(F.col("doc_id").cast("long").alias("_id"), grade.alias("_grade")).orderBy(F.xxhash64("_id"), "_id", "_grade").limit(limit)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = Features()
        for b in batches:
            sets = [s.astype("<i4").tobytes() for s in f.of(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), b.column(2)], names=["grade", "ids", "id"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    # Texts are hashed where they lie; only their features are sorted.
    sets = texts.join(F.broadcast(some), "_id").select("_grade", "text", "_id").mapInArrow(run, "grade int, ids binary, id long")
    # At most limit rows; as an Arrow table they take their bytes and no objects of the driver.
    rows = sets.orderBy("id", "grade", "ids").limit(limit).select("grade", "ids").toArrow()
    model = fit([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("ids")], rows.column("grade").to_numpy().astype(int))
    del rows
    trim()
    return model


def grade(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) of each document; tail is P(best grade)."""
    return _graded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, keep)


def _graded(docs: DataFrame, model: Model, keep: float) -> DataFrame:
    """``grade`` of (doc_id, text, ...), with the columns behind the text."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f, model = Features(), share.value
        for b in batches:
            tails = model.tails(f.of(b.column(1).to_pylist()))
            cols = [b.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep), *[b.column(i) for i in range(2, b.num_columns)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", "tail", "kept", *b.schema.names[2:]])

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(run, f"doc_id long, expected_grade double, tail double, kept boolean{extra}")


def select(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """``docs`` whose best grade has a probability of ``keep`` or more."""
    names = docs.columns
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_t"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(names)])
    return _graded(wide, model, keep).where("kept").select(*[F.col(f"_x{i}").alias(c) for i, c in enumerate(names)])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, graded by a model of the table's labels."""
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, train(docs, table(spark, sf_dir, "labels")))

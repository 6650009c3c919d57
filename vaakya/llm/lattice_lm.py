"""Document log probability by a subword lattice.

The pieces of an existing public vocabulary, with weights learned here, span a
lattice over each word; its log-space forward recursion adds up all
segmentations. Weights start from the vocabulary's own order of pieces and
take one step of expectation and maximisation over the training words, with
their counts. The end of a text is a symbol beside the pieces, as frequent as
ends are among pieces and ends in training. ``score`` is the probability that
the lattice gives to the text, over all its segmentations.

``mixed_score`` blends in a model of whole words: a word's share in training,
weighted by one minus the share of training tokens that are words seen once.

Each distinct word of the corpus is counted and scored once, in a table by its
hash. The ``FREQUENT`` most frequent words go to the tasks as hashes, counts
and probabilities; words below are looked up by a join, so the corpus's
vocabulary is nowhere in one place.

Edge cases: null and empty texts are the end token alone; rows that repeat a
doc_id are documents of their own; a null doc_id is hashed as the text
"null"; with no training documents all counts are 0; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import exp, log, log1p, prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, drop, materialize, table

VOCAB = "piece_bpe_32k.model"
#: Words whose counts and probabilities are broadcast: 24 bytes each.
FREQUENT = 500_000
SPACE = "▁"
END = 0
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Distinct words that a task counts before it hands them on.
_COUNT_WORDS = 200_000


def cut(text: str | None) -> list[bytes]:
    """A text's words as bytes, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def held_out(doc_id: int | None) -> bool:
    """Whether a document is not learned from."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def word_hash(word: bytes) -> int:
    """A word's signed 64-bit hash; never that of the end token."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return (h - (1 << 64) if h >> 63 else h) or 1


class Lattice:
    """Piece probabilities, and forward and backward recursions over a word."""

    def __init__(self, pieces: list[str], probs: np.ndarray, end: float = 0.0):
        """``probs`` are weights of the pieces; ``end`` is the probability of the end, which the pieces leave."""
        self.pieces, self.index = pieces, {p: i for i, p in enumerate(pieces)}
        # Every beginning of a piece, with the piece's number or -1: where none goes on, neither do longer ones.
        self.starts = {p[:i]: -1 for p in pieces for i in range(1, len(p))} | self.index
        self.prob = probs / probs.sum() * (1 - end)
        self.logs, self.plain = np.log(self.prob).tolist(), self.prob.tolist()
        # The same beginnings with the log probability of the piece; 1 where there is none.
        self.arc = {p: self.logs[k] if k >= 0 else 1.0 for p, k in self.starts.items()}
        self.byte = [self.index.get(f"<0x{b:02X}>") for b in range(256)]

    @classmethod
    def load(cls, path: str) -> Lattice:
        """Pieces of a vocabulary file; a piece's first weight falls with its place in the file's order."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        keep = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
        score = np.array([0.0 if sp.is_byte(i) else sp.get_score(i) for i in keep])
        rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        byte = np.array([sp.is_byte(i) for i in keep])
        return cls([sp.id_to_piece(i) for i in keep], np.where(byte, 1e-7, 1.0 / (rank + 10)))

    def arcs(self, s: str) -> list[list[tuple[int, float, tuple]]]:
        """For each place, the arcs that end there: (start, log probability, pieces)."""
        out: list[list] = [[] for _ in range(len(s) + 1)]
        get, logs, n = self.starts.get, self.logs, len(s)
        for i in range(n):
            for j in range(i + 1, n + 1):
                k = get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    out[j].append((i, logs[k], (k,)))
            if s[i] not in self.index:
                ks = tuple(self.byte[b] for b in s[i].encode("utf-8", "surrogatepass"))
                out[i + 1].append((i, sum(logs[k] for k in ks), ks))
        return out

    def forward(self, s: str, arcs: list | None = None) -> list[float]:
        """Log probability of all segmentations of each prefix."""
        arcs = arcs or self.arcs(s)
        f = [0.0] + [-1e300] * len(s)
        for j in range(1, len(s) + 1):
            terms = [f[i] + p for i, p, _ in arcs[j]]
            top = max(terms, default=-1e300)
            f[j] = top if len(terms) < 2 else top + log(sum([exp(x - top) for x in terms]))
        return f

    def marginal(self, word: str) -> float:
        """Natural log of the probability of a word, over all its segmentations."""
        s = SPACE + word
        get, logs, n = self.arc.get, self.logs, len(s)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        f = 0.0
        for i in range(n):
            if i:
                terms = into[i]
                if not terms:
                    continue
                f = terms[0]
                if len(terms) == 2:
                    d = terms[1] - f
                    f += log1p(exp(d)) if d < 0 else d + log1p(exp(-d))
                elif len(terms) > 2:
                    f = max(terms)
                    f += log(sum([exp(x - f) for x in terms]))
            k = get(s[i])
            if k is None or k > 0:
                into[i + 1].append(f + sum([logs[self.byte[b]] for b in s[i].encode("utf-8", "surrogatepass")]))
                if k is None:
                    continue
            else:
                into[i + 1].append(f + k)
            for j in range(i + 2, n + 1):
                k = get(s[i:j])
                if k is None:
                    break
                if k <= 0:
                    into[j].append(f + k)
        top = max(into[n])
        return top + log(sum([exp(x - top) for x in into[n]]))

    def expect(self, word: str, count: float, into: np.ndarray) -> None:
        """Adds the expected number of each piece in ``count`` such words; in log space where plain products vanish."""
        s = SPACE + word
        get, plain, n = self.starts.get, self.plain, len(s)
        f, b, seen = [1.0] + [0.0] * n, [0.0] * n + [1.0], []
        for i in range(n):
            here = f[i]
            k = get(s[i])
            if k is None or k < 0:
                ks = tuple([self.byte[x] for x in s[i].encode("utf-8", "surrogatepass")])
                p = prod([plain[x] for x in ks])
                f[i + 1] += here * p
                seen.append((i, i + 1, p, ks))
                if k is None:
                    continue
            else:
                p = plain[k]
                f[i + 1] += here * p
                seen.append((i, i + 1, p, k))
            for j in range(i + 2, n + 1):
                k = get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    p = plain[k]
                    f[j] += here * p
                    seen.append((i, j, p, k))
        if f[n] > 1e-200:
            scale = count / f[n]
            for i, j, p, ks in reversed(seen):
                x = p * b[j]
                b[i] += x
                x *= f[i] * scale
                if type(ks) is int:
                    into[ks] += x
                else:
                    for k in ks:
                        into[k] += x
            return
        arcs = self.arcs(s)
        f = self.forward(s, arcs)
        b = [-1e300] * len(s) + [0.0]
        total = f[-1]
        for j in range(len(s), 0, -1):
            if b[j] < -1e299:
                continue
            for i, p, ks in arcs[j]:
                x = p + b[j]
                share = exp(f[i] + x - total) * count
                for k in ks:
                    into[k] += share
                top, low = (b[i], x) if b[i] > x else (x, b[i])
                b[i] = top + log(1 + exp(low - top)) if top - low < 40 else top


def _count(docs: DataFrame) -> DataFrame:
    """(h, word, c): training counts, 0 for words of held-out documents alone; the end token has h = END."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from collections import Counter

        def rows(counts: Counter, ends: int) -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([END] * bool(ends) + [word_hash(w) for w in words], pa.int64()), pa.array([b""] * bool(ends) + words, pa.binary()), pa.array([ends] * bool(ends) + list(counts.values()), pa.int64())],
                names=["h", "word", "c"],
            )

        counts, ends = Counter(), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held_out(doc):
                    counts.update(dict.fromkeys(cut(text), 0))
                else:
                    counts.update(cut(text))
                    ends += 1
            if len(counts) > _COUNT_WORDS:
                yield rows(counts, ends)
                counts, ends = Counter(), 0
        if counts or ends:
            yield rows(counts, ends)

    return docs.mapInArrow(run, "h long, word binary, c long").groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def train(docs: DataFrame, path: str, frequent: int = FREQUENT) -> tuple[DataFrame, dict]:
    """The stored (h, c, inner) of each distinct word, inner its log probability, and what every task needs of the model."""
    spark = docs.sparkSession
    counts = materialize(_count(docs), "counts")
    n, v, once, ends = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum((F.col("c") == 1).cast("long")), F.sum(F.when(F.col("h") == END, F.col("c")))).first()
    n, v, once, ends = n or 0, v or 0, once or 0, ends or 0
    first = Lattice.load(path)
    share = spark.sparkContext.broadcast(first)

    def step(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice, into = share.value, [0.0] * len(share.value.pieces)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lattice.expect(w.decode("utf-8", "surrogatepass"), c, into)
        into = np.array(into)
        hit = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(into[hit])], names=["piece", "e"])

    soft = np.full(len(first.pieces), 0.01)
    for r in counts.where(f"h <> {END} and c > 0").select("word", "c").mapInArrow(step, "piece int, e double").groupBy("piece").agg(F.sum("e")).collect():  # a row per piece
        soft[r[0]] += r[1]
    end = (ends + 0.1) / (ends + float(soft.sum()) + 0.2)
    fitted = spark.sparkContext.broadcast(Lattice(first.pieces, soft, end))

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice = fitted.value
        for b in batches:
            inner = [lattice.marginal(w.decode("utf-8", "surrogatepass")) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(inner, pa.float64())], names=["h", "c", "inner"])

    words = materialize(counts.where(f"h <> {END}").select("h", "word", "c").mapInArrow(sums, "h long, c long, inner double"), "words")
    drop(counts)
    # The lowest count of which all words fit; the histogram of counts is short.
    least, held = 1 << 62, 0
    levels = words.where("c > 1").groupBy(F.when(F.col("c") < 64, F.col("c")).otherwise(F.pow(2.0, F.floor(F.log2(F.col("c") + 0.0))).cast("long")).alias("c")).count()
    for r in sorted(levels.collect(), reverse=True):
        if held + r["count"] > frequent:
            break
        least, held = r["c"], held + r["count"]
    top = words.where(F.col("c") >= least).toArrow().sort_by("h")  # frequent rows at most
    model = {"n": n, "v": v, "beta": min(0.5, max(once / max(n, 1), 1e-4)), "ends": ends, "end": end, "least": least, "pieces": first.pieces, "soft": soft}
    return words, model | {k: top[k].to_numpy() for k in ("h", "c", "inner")}


def score(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score) of each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    words, model = train(docs, path, frequent)
    n, v, beta, ends = model["n"], model["v"], model["beta"], model["ends"]
    known = np.maximum(model["c"], 1)
    share = spark.sparkContext.broadcast(
        {
            "h": model["h"],
            "base": np.log((known + 0.1) / (n + 0.1 * (v + 1))),
            "full": np.logaddexp(np.log((1 - beta) * known / max(n, 1)), log(beta) + model["inner"]),
            "pure": model["inner"],
        }
    )
    end = {"base": log((ends + 0.1) / (n + 0.1 * (v + 1))), "full": log((1 - beta) * ends / n) if ends else log(beta), "pure": log(model["end"])}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from itertools import chain
        from pyspark import TaskContext

        m = share.value
        size = len(m["h"])
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, cutd = b.column(0).to_pylist(), [cut(t) for t in b.column(1).to_pylist()]
            docs_here = len(ids)
            number = {w: i for i, w in enumerate(set().union(*cutd))}
            hs = np.array([word_hash(w) for w in number], np.int64)
            at = np.minimum(np.searchsorted(m["h"], hs), max(size - 1, 0))
            held = m["h"][at] == hs if size else np.zeros(len(hs), bool)
            lengths = np.array([len(ws) for ws in cutd], np.int64)
            word = np.fromiter(map(number.__getitem__, chain.from_iterable(cutd)), np.int64, int(lengths.sum()))
            doc = np.repeat(np.arange(docs_here), lengths)
            is_held = held[word]
            where, place = doc[is_held], at[word[is_held]]
            total = {k: np.bincount(where, m[k][place], docs_here) + end[k] for k in end}
            hits = np.bincount(where, minlength=docs_here) + int(ends > 0)
            # The other words of each document with their numbers of times, a list a document.
            pairs, times = np.unique(doc[~is_held] * max(len(hs), 1) + word[~is_held], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(docs_here + 1) * max(len(hs), 1))
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(docs_here), pa.int64()),
                    b.column(0),
                    pa.array([held_out(i) for i in ids], pa.bool_()),
                    pa.array(lengths + 1, pa.int64()),
                    pa.array(hits, pa.int64()),
                    *(pa.array(total[k], pa.float64()) for k in ("base", "full", "pure")),
                    pa.ListArray.from_arrays(offsets, pa.array(hs[pairs % max(len(hs), 1)] if len(pairs) else [], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "full", "pure", "h", "times"],
            )
            row += docs_here

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, full double, pure double, h array<long>, times array<long>"
    parts = materialize(docs.mapInArrow(run, schema), "parts")
    others = parts.select("row", F.explode(F.arrays_zip("h", "times")).alias("o")).select("row", F.col("o.h").alias("h"), F.col("o.times").alias("times"))
    c = F.col("c")
    inner = F.lit(log(beta)) + F.col("inner")
    seen = F.log(F.lit(1 - beta) * c / F.lit(float(max(n, 1))))
    both = F.greatest(seen, inner) + F.log(1 + F.exp(-F.abs(seen - inner)))
    rare = others.join(words.where(c < model["least"]), "h", "left").select(
        "row",
        F.when(c > 0, F.col("times")).otherwise(0).alias("k"),
        (F.col("times") * F.log((c + 0.1) / F.lit(n + 0.1 * (v + 1)))).alias("b"),
        (F.col("times") * F.when(c > 0, both).otherwise(inner)).alias("f"),
        (F.col("times") * F.col("inner")).alias("p"),
    )
    rest = rare.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("k", "b", "f", "p")))
    whole = parts.drop("h", "times").join(rest, "row", "left")
    tens = F.lit(1 / log(10))

    def added(first: str, more: str) -> Column:
        return (F.col(first) + F.coalesce(more, F.lit(0.0))) * tens

    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        added("base", "b").alias("base_score"),
        added("pure", "p").alias("score"),
        added("full", "f").alias("mixed_score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table."""
    from .tokens import vocab_path

    arrow_rows(spark, 500)
    return score(table(spark, sf_dir, "documents"), vocab_path(VOCAB))

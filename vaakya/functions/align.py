"""Word alignment and error rates, as Column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .tokens import let, literal_map

#: Words that chr() can number for the built-in distance.
_CODES = 223
#: Cells of the tables that are worked on at once.
_CELLS = 1 << 24


def edit_path(ref: Column, hyp: Column) -> Column:
    """(cost, path) of the cheapest alignment; path of M, S, D, I, ties in the order S, D, I.

    Each cell of the table carries its path, so none is traced back.
    """
    return let(hyp, lambda h: _path(ref, h))


def _path(ref: Column, hyp: Column) -> Column:
    cell = lambda c, p: F.struct(c.cast("int").alias("cost"), p.alias("path"))
    zero = F.array(cell(F.lit(0), F.lit("")))
    row0 = F.aggregate(hyp, zero, lambda acc, _: F.concat(acc, F.array(cell(F.size(acc), F.concat(F.element_at(acc, -1)["path"], F.lit("I"))))))

    def row(prev: Column, a: Column) -> Column:
        head = F.array(cell(prev[0]["cost"] + 1, F.concat(prev[0]["path"], F.lit("D"))))

        def one(acc: Column, b: Column) -> Column:
            j = F.size(acc)
            diag, up, left = F.get(prev, j - 1), F.get(prev, j), F.element_at(acc, -1)
            best = F.least(diag["cost"], up["cost"], left["cost"])
            new = (
                F.when(a == b, cell(diag["cost"], F.concat(diag["path"], F.lit("M"))))
                .when(diag["cost"] == best, cell(best + 1, F.concat(diag["path"], F.lit("S"))))
                .when(up["cost"] == best, cell(best + 1, F.concat(up["path"], F.lit("D"))))
                .otherwise(cell(best + 1, F.concat(left["path"], F.lit("I"))))
            )
            return F.concat(acc, F.array(new))

        return F.aggregate(hyp, head, one)

    return F.element_at(F.aggregate(ref, row0, row), -1)


def paths(refs: list, hyps: list) -> list[str]:
    """The path of ``edit_path`` for each pair of word lists; a row of all tables at a time."""
    sizes = [(len(r), len(h)) for r, h in zip(refs, hyps, strict=True)]
    out = [""] * len(sizes)
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    while order:
        n, m = sizes[order[-1]][0], max(sizes[i][1] for i in order[-4096:])
        k = max(1, min(4096, _CELLS // ((n + 1) * (m + 1))))
        order, own = order[:-k], order[-k:]
        for i, p in zip(own, _tables([refs[i] for i in own], [hyps[i] for i in own]), strict=True):
            out[i] = p
    return out


def _tables(refs: list, hyps: list) -> list[str]:
    k, n, m = len(refs), max(map(len, refs)), max(map(len, hyps))
    code: dict = {}
    a, b = np.full((k, n), -1, np.int32), np.full((k, m), -2, np.int32)
    for side, rows in ((a, refs), (b, hyps)):
        for i, words in enumerate(rows):
            side[i, : len(words)] = [code.setdefault(w, len(code)) for w in words]
    steps = np.arange(m + 1, dtype=np.int32)
    above = np.broadcast_to(steps, (k, m + 1))
    # 0 M, 1 S, 2 D, 3 I
    moves = np.empty((k, n + 1, m + 1), np.uint8)
    moves[:, 0], moves[:, :, 0] = 3, 2
    for i in range(1, n + 1):
        same = a[:, i - 1 : i] == b
        row = np.empty((k, m + 1), np.int32)
        row[:, 0] = i
        row[:, 1:] = np.minimum(above[:, :-1] + ~same, above[:, 1:] + 1)
        row = np.minimum.accumulate(row - steps, axis=1) + steps
        less = row[:, 1:] - 1
        moves[:, i, 1:] = np.where(same, 0, np.where(above[:, :-1] == less, 1, np.where(above[:, 1:] == less, 2, 3)))
        above = row
    i, j = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    each, done = np.arange(k), np.full((k, n + m), 4, np.uint8)
    for step in range(n + m):
        on = (i > 0) | (j > 0)
        if not on.any():
            break
        move = np.where(on, moves[each, i, j], 4)
        done[:, n + m - 1 - step] = move
        i, j = i - (move < 3), j - ((move < 2) | (move == 3))
    letters = np.frombuffer(b"MSDI ", np.uint8)[done]
    return [x.tobytes().decode().strip() for x in letters]


def edit_paths(ref: Column | str, hyp: Column | str) -> Column:
    """``edit_path``'s path, for whole batches; for rows, not within higher-order functions."""

    @F.pandas_udf("string")
    def found(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(paths(r.tolist(), h.tolist()), dtype=object)

    return found(ref, hyp)


def word_distance(a: Column, b: Column) -> Column:
    """Word edit distance: words numbered as characters for the built-in distance, else by the table."""

    def counted(x: Column, y: Column, vocab: Column) -> Column:
        code = lambda ws: F.array_join(F.transform(ws, lambda w: F.char(F.array_position(vocab, w) + 32)), "")
        return F.when(F.size(vocab) <= _CODES, F.levenshtein(code(x), code(y))).otherwise(edit_path(x, y)["cost"])

    return let(a, lambda x: let(b, lambda y: let(F.array_distinct(F.concat(x, y)), lambda v: counted(x, y, v))))


def wer(ref: Column, hyp: Column) -> Column:
    """Errors for each reference word; 0 for an empty reference."""
    return F.when(F.size(ref) > 0, word_distance(ref, hyp) / F.size(ref)).otherwise(F.lit(0.0))


def path_ops(path: Column) -> Column:
    """(op, i, j) of a path; i and j are places in reference and hypothesis, null where there is none."""

    def ops(p: Column) -> Column:
        count = lambda upto, kinds: F.length(F.regexp_replace(F.substr(p, F.lit(1), upto), f"[^{kinds}]", ""))
        return F.transform(
            F.filter(F.split(p, ""), lambda o: o != ""),
            lambda o, k: F.struct(o.alias("op"), F.when(o != "I", count(k, "MSD")).alias("i"), F.when(o != "D", count(k, "MSI")).alias("j")),
        )

    return let(path, ops)


def phonetic_similarity(a: Column, b: Column) -> Column:
    """One minus the relative edit distance, and 0.1 for each place where like-sounding letters stand."""
    pairs = [x + y for p in L.ALIKE for x, y in (p, p[::-1])]
    ca, cb = F.split(a, ""), F.split(b, "")
    bonus = F.aggregate(F.zip_with(ca, cb, lambda x, y: F.concat(x, y)), F.lit(0.0), lambda s, p: s + F.when(F.coalesce(p.isin(*pairs), F.lit(False)), 0.1).otherwise(0.0))
    base = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.least(F.lit(1.0), base + bonus))


def same_meaning(a: Column, b: Column) -> Column:
    """Whether two words are a number and its digits, or a pair of variants."""
    digits = literal_map(L.DIGITS)
    both = [x + "=" + y for p in L.SAME_WORDS for x, y in (p, p[::-1])]
    pair = F.concat(a, F.lit("="), b).isin(*both)
    return F.coalesce(F.try_element_at(digits, a) == b, F.lit(False)) | F.coalesce(F.try_element_at(digits, b) == a, F.lit(False)) | pair

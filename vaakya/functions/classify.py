"""Rule cascades over errors and words, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .tokens import DANDA, let, strip, tokens, within

_DIGIT = r"[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
_HALANT = "्"


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def error_labels(ref: Column, pred: Column) -> Column:
    """The labels of an error, in order."""
    return let(tokens(ref), lambda rw: let(tokens(pred), lambda pw: _labels(ref, pred, rw, pw)))


def _labels(ref: Column, pred: Column, rw: Column, pw: Column) -> Column:
    numbers = F.array(*map(F.lit, L.ERROR_NUMBERS))
    has = lambda ws, t: F.arrays_overlap(ws, numbers) | t.rlike(_DIGIT)
    bag = lambda ws: F.array_sort(F.array_distinct(ws))
    number = let(has(rw, ref), lambda rn: let(has(pw, pred), lambda pn: (rn | pn) & ((rn != pn) | (bag(rw) != bag(pw)))))
    filler = lambda a, b: _any([F.contains(a, F.lit(f)) & ~F.contains(b, F.lit(f)) for f in L.FILLERS])
    close = F.exists(F.zip_with(rw, pw, lambda a, b: (a != b) & (F.levenshtein(a, b, 2) >= 0)), lambda x: F.coalesce(x, F.lit(False)))
    n = F.size(rw)

    def again(w: Column, i: Column) -> Column:
        follows = w == F.get(pw, i + 1)
        free = (i >= n - 1) | (F.get(rw, i) != F.get(rw, F.least(i + 1, n - 1)))
        return F.coalesce(follows & free, F.lit(False))

    repeated = F.exists(F.transform(pw, again), lambda x: x)
    marks = rf"[{DANDA},.!?\-]"
    bare = lambda t, ws: F.when(t.rlike(marks), tokens(F.regexp_replace(t, marks, ""))).otherwise(ws)
    labels = [
        (F.concat_ws(" ", ref, pred).rlike("[a-zA-Z]"), "code_mixing"),
        (number, "number_error"),
        (filler(pred, ref), "disfluency_insertion"),
        (filler(ref, pred), "disfluency_deletion"),
        ((n == F.size(pw)) & close, "phonetic_confusion"),
        (repeated, "repetition_error"),
        (F.size(pw) > n * F.lit(1.3), "insertion_error"),
        (F.size(pw) < n * F.lit(0.7), "deletion_error"),
        ((ref != pred) & (bare(ref, rw) == bare(pred, pw)), "punctuation_only"),
        (_any([F.contains(ref, F.lit(c)) != F.contains(pred, F.lit(c)) for c in L.CONJUNCTS]), "conjunct_consonant_error"),
    ]
    every = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in labels]))
    return let(every, lambda found: F.when((F.size(found) == 0) & (ref != pred), F.array(F.lit("general_substitution"))).otherwise(found))


def severity(rate: Column) -> Column:
    """low up to 0.33, medium up to 0.66, high beyond."""
    return F.when(rate <= 0.33, "low").when(rate <= 0.66, "medium").otherwise("high")


def classify_word(word: Column, freq: Column | None = None, total: Column | None = None, known_correct: tuple[str, ...] = ()) -> Column:
    """(classification, confidence, reason) of a word; ``freq`` and ``total`` are its count and all counts, ``known_correct`` more words that are right."""
    clean = strip(word, DANDA + ",.!?()[]{}\"' ")
    bad = F.regexp_extract(clean, r"([^\x{0900}-\x{097F}\p{Nd}\-])", 1)
    much = F.get(F.filter(F.split(clean, ""), lambda c: c.rlike(r"[\x{0900}-\x{097F}]") & (F.length(clean) - F.length(F.replace(clean, c, F.lit(""))) > 4)), F.lit(0))
    out = lambda c, f, r: F.struct(F.lit(c).alias("classification"), F.lit(f).alias("confidence"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    hexed = F.lpad(F.hex(F.encode(bad, "utf-16be")), 4, "0")
    n = F.coalesce(freq, F.lit(0)) if freq is not None else F.lit(0)
    share = n / (total if total is not None else F.lit(1))
    counted = lambda text: F.concat(F.lit(text + " (freq="), n.cast("string"), F.lit(")"))
    return (
        F.when(clean == "", out("incorrect", "high", "empty or punctuation-only"))
        .when(within(clean, [*L.STOPWORDS, *known_correct]), out("correct", "high", "in known Hindi dictionary/stopwords"))
        .when(within(clean, L.VALID_LOANS), out("correct", "high", "valid English word in Devanagari (per transcription guidelines)"))
        .when(bad != "", out("incorrect", "high", F.concat(F.lit("invalid characters: non-Devanagari character: '"), bad, F.lit("' (U+"), hexed, F.lit(")"))))
        .when(clean.rlike(r"[\x{093E}-\x{094D}]{3,}"), out("incorrect", "high", "multiple consecutive matras/halants"))
        .when(clean.rlike(r"^[\x{093E}-\x{094D}]"), out("incorrect", "high", "starts with matra/halant"))
        .when((F.length(clean) > 1) & (F.length(clean) <= 15) & much.isNotNull(), out("incorrect", "medium", F.concat(F.lit("character '"), much, F.lit("' repeated excessively"))))
        .when((n > 0) & (share > 0.0001), out("correct", "high", counted("high frequency word")))
        .when((n > 0) & (share > 0.00001), out("correct", "medium", counted("moderate frequency word")))
        .when(n > 0, out("correct", "low", counted("rare word - may be valid but uncommon")))
        .when(_any([F.endswith(clean, F.lit(s)) for s in L.VALID_SUFFIXES]) & (F.length(clean) > 3), out("correct", "medium", "has valid Hindi suffix pattern"))
        .when(~F.endswith(clean, F.lit(_HALANT)), out("correct", "low", "valid characters but not in dictionary - may be proper noun, dialectal, or uncommon word"))
        .otherwise(out("incorrect", "low", "not in dictionary and has suspicious patterns"))
    )


def categorize_word(word: Column) -> Column:
    """compound, abbreviation, english_transliteration, onomatopoeia or standard_hindi."""
    n = F.length(word)
    half = F.floor(n / 2).cast("int")
    return (
        F.when(F.contains(word, F.lit("-")), "compound")
        .when(n <= 2, "abbreviation")
        .when(_any([F.endswith(word, F.lit(s)) for s in L.CATEGORY_SUFFIXES]) & (n > 4), "english_transliteration")
        .when(within(word, L.INTERJECTIONS) | ((n >= 4) & (F.substr(word, F.lit(1), half) == F.substr(word, half + 1))), "onomatopoeia")
        .otherwise("standard_hindi")
    )


def analysis_notes(word: Column, category: Column) -> Column:
    """Notes for the review of a word, joined by semicolons."""
    parts = F.split(word, "-")
    listed = F.concat(F.lit("['"), F.array_join(parts, "', '"), F.lit("']"))
    pairs = F.size(F.filter(F.split(word, ""), lambda c: c == _HALANT)) - F.size(F.filter(F.split(F.regexp_replace(word, f"{_HALANT}+", _HALANT), ""), lambda c: c == _HALANT))
    double = F.array_join(F.array_repeat(F.lit(L.DOUBLE_HALANT), pairs), "; ")
    out = F.when(category == "compound", F.concat(F.lit("Compound word with "), F.size(parts).cast("string"), F.lit(" parts: "), listed, F.lit("; Check if both parts are valid Hindi words")))
    for name, text in L.NOTES.items():
        out = out.when(category == name, text)
    return out.otherwise(F.when(pairs > 0, double).otherwise(L.STANDARD_NOTE))

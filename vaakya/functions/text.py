"""Clean-up of transcripts: numbers, loan words, spelling, repetitions. Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from .tokens import DANDA, SPACE, WORD, join, let, literal_map, nfc, strip, tokens, within

_WIDE = "decimal(38,0)"
_VALUES = {**L.UNITS, **L.TENS, **L.COMPOUNDS}
_NUMBERS = {**_VALUES, **L.MULTIPLIERS}
_IDIOM = "|".join(p.replace(r"\s", SPACE).replace(r"\w", WORD) for p in L.IDIOMS)
_LOAN = f"^{WORD}+({'|'.join(L.LOAN_SUFFIXES)})$"
_PUNCT = DANDA + ",.\"'!?()[]{}"


def parse_number(words: Column) -> Column:
    """The value of a run of number words; null if it is 0, has another word or is too large."""
    value, factor = literal_map(_VALUES, "bigint"), literal_map(L.MULTIPLIERS, "bigint")
    zero = F.lit(0).cast(_WIDE)

    def step(acc: Column, w: Column) -> Column:
        v, m = F.try_element_at(value, w).cast(_WIDE), F.try_element_at(factor, w).cast(_WIDE)
        raised = F.try_multiply(F.when(acc["cur"] == 0, F.lit(1).cast("decimal(28,0)")).otherwise(acc["cur"].try_cast("decimal(28,0)")), m.cast("decimal(10,0)")).try_cast(_WIDE)
        flush = m >= 1000
        total = F.when(v.isNotNull() | ~flush, acc["total"]).otherwise(F.try_add(acc["total"], raised).try_cast(_WIDE))
        cur = F.when(v.isNotNull(), F.try_add(acc["cur"], v).try_cast(_WIDE)).when(flush, zero).otherwise(raised)
        return F.struct(F.when(v.isNotNull() | m.isNotNull(), total).alias("total"), cur.alias("cur"))

    out = F.aggregate(words, F.struct(zero.alias("total"), zero.alias("cur")), step, lambda a: F.try_add(a["total"], a["cur"]).try_cast(_WIDE))
    return F.when(out > 0, out)


def number_runs(words: Column) -> Column:
    """(s, e, value) of the maximal runs of number words that have a value; e is behind the last."""
    clean = F.transform(words, lambda w: strip(w, DANDA + ",."))
    return let(clean, lambda c: let(F.transform(c, lambda w: within(w, list(_NUMBERS))), lambda k: _runs(c, k)))


def _runs(clean: Column, known: Column) -> Column:
    size = F.size(known)
    starts = F.filter(
        F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.get(known, i) & ((i == 0) | ~F.coalesce(F.get(known, F.greatest(i - 1, F.lit(0))), F.lit(False))),
    )

    def run(s: Column) -> Column:
        length = F.array_position(F.slice(known, s + 1, F.greatest(size - s, F.lit(0))), False).cast("int")
        e = F.when(length > 0, s + length - 1).otherwise(size)
        return F.struct(s.alias("s"), e.alias("e"), parse_number(F.slice(clean, s + 1, e - s)).alias("value"))

    return F.filter(F.transform(starts, run), lambda r: r["value"].isNotNull())


def normalize_numbers(text: Column, preserve_idioms: bool = True) -> Column:
    """Runs of number words as digits, but for those near an idiom."""
    return let(tokens(text), lambda words: let(number_runs(words), lambda runs: _replace_runs(text, words, runs, preserve_idioms)))


def _replace_runs(text: Column, words: Column, runs: Column, preserve_idioms: bool) -> Column:
    def plain(r: Column) -> Column:
        span = join(F.slice(words, r["s"] + 1, r["e"] - r["s"]))
        at = F.position(span, text) - 1
        first = F.greatest(at - 20, F.lit(0))
        context = F.substr(text, first + 1, at + F.length(span) + 30 - first)
        return (at < 0) | ~F.coalesce(context.rlike(_IDIOM), F.lit(False))

    def replaced(done: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            own = F.get(F.filter(done, lambda r: (r["s"] <= i) & (i < r["e"])), F.lit(0))
            return let(own, lambda o: F.when(o.isNull(), w).when(o["s"] == i, o["value"].cast("string")))

        return join(F.array_compact(F.transform(words, one)))

    done = F.filter(runs, plain) if preserve_idioms else runs
    return F.when(F.size(runs) == 0, text).otherwise(let(done, replaced))


def loan_suffix(word: Column) -> Column:
    """Whether a word ends like a loan word, and is no exception."""
    return word.rlike(_LOAN) & ~within(word, L.SUFFIX_EXCEPTIONS)


def roman(word: Column) -> Column:
    """Whether a word begins with two Roman letters or more, and nothing that goes on as a word."""
    return word.rlike(rf"^[a-zA-Z]{{2,}}([^\p{{L}}\p{{N}}_]|$)")


def detect_english(text: Column, method: str = "all") -> Column:
    """(word, original, english_equivalent, method, position) of loan and Roman words.

    ``method`` is ``all``, or one of ``dictionary``, ``suffix`` and ``roman``.
    """
    return F.filter(F.transform(tokens(text), lambda w, i: _detect(w, i, method)), lambda d: d["method"].isNotNull())


def _detect(w: Column, i: Column, method: str) -> Column:
    english = literal_map(L.LOANS)
    on = lambda m: F.lit(method in ("all", m))

    def one(clean: Column) -> Column:
        known = F.try_element_at(english, clean)
        how = F.when(clean == "", None).when(on("dictionary") & known.isNotNull(), "dictionary").when(on("suffix") & loan_suffix(clean), "suffix_pattern").when(on("roman") & roman(clean), "roman_script")
        return let(
            how,
            lambda h: F.struct(
                clean.alias("word"),
                w.alias("original"),
                F.when(h == "dictionary", known).when(h == "roman_script", clean).alias("english_equivalent"),
                h.alias("method"),
                i.cast("bigint").alias("position"),
            ),
        )

    return let(strip(w, _PUNCT), one)


def tag_english(text: Column, method: str = "all") -> Column:
    """Wraps each detected word's core in [EN] and [/EN]."""

    def tagged(d: Column) -> Column:
        w, core = d["original"], d["word"]
        at = F.position(core, w)
        return F.when(d["method"].isNull(), w).otherwise(F.concat(F.substr(w, F.lit(1), at - 1), F.lit("[EN]"), core, F.lit("[/EN]"), F.substr(w, at + F.length(core))))

    every = F.transform(tokens(text), lambda w, i: _detect(w, i, method))
    return let(every, lambda ds: F.when(F.exists(ds, lambda d: d["method"].isNotNull()), join(F.transform(ds, tagged))).otherwise(text))


def strip_tags(text: Column) -> Column:
    """Without the tags."""
    return F.replace(F.replace(text, F.lit("[EN]"), F.lit("")), F.lit("[/EN]"), F.lit(""))


def cleanup(text: Column, numbers: bool = True, english: bool = True) -> Column:
    """(original, steps, cleaned, num_changes): numbers, then tags; the tagging step is always logged."""
    kind = "array<struct<step:string,before:string,after:string,english_words:array<string>>>"

    def logged(after: Column, final: Column) -> Column:
        steps = []
        if numbers:
            steps.append(F.when(after != text, F.struct(F.lit("number_normalization").alias("step"), text.alias("before"), after.alias("after"), F.lit(None).cast("array<string>").alias("english_words"))))
        if english:
            words = F.transform(detect_english(after), lambda d: d["word"])
            steps.append(F.struct(F.lit("english_detection").alias("step"), after.alias("before"), final.alias("after"), words.alias("english_words")))
        log = (F.array_compact(F.array(*steps)) if steps else F.array()).cast(kind)
        return let(log, lambda x: F.struct(text.alias("original"), x.alias("steps"), final.alias("cleaned"), F.size(x).alias("num_changes")))

    return let(normalize_numbers(text) if numbers else text, lambda after: let(tag_english(after) if english else after, lambda final: logged(after, final)))


def clean_text(text: Column) -> Column:
    """Composed, without zero-width characters, single spaces."""
    return join(tokens(F.translate(nfc(text), "\u200b\u200c\u200d", "")))


def normalize(text: Column, variants: bool = True, nukta: bool = False, compose: bool = True) -> Column:
    """Punctuation, white space and spelling variants made uniform; ``compose=False`` for texts in composed form."""
    t = F.translate(nfc(text) if compose else text, "\u200b\u200c\u200d", "")
    t = F.regexp_replace(F.replace(t, F.lit("|"), F.lit(DANDA)), r"\.{2,}", DANDA)
    t = strip(join(tokens(t)), " " + DANDA + ",.")
    for on, table in ((variants, L.VARIANTS), (nukta, L.NUKTA)):
        if on:
            t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table.items(), t)
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def drop_repeated_ngrams(text: Column, n: int) -> Column:
    """Drops an n-gram that repeats the one before it, of tokens with one space between.

    Of two copies the first is matched and the search goes on at the second, which leaves what a stack of words
    leaves that pops an n-gram that repeats, in one pass over the text.
    """
    gram = " ".join(["[^ ]++"] * n)
    return F.regexp_replace(text, rf"(?<![^ ])({gram}) (?=\1(?![^ ]))", "")


def suppress_repetitions(text: Column, ngrams: tuple[int, ...] = (2, 3)) -> Column:
    """Drops repeated words and n-grams unless an intended repetition is in the text."""

    def dropped(words: Column) -> Column:
        once = F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, F.greatest(i - 1, F.lit(0)))))
        fixed = reduce(drop_repeated_ngrams, ngrams, join(once))
        return F.when(F.size(words) <= 1, text).otherwise(fixed)

    meant = reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in L.INTENDED])
    return F.when(meant, text).otherwise(let(tokens(text), dropped))


def resolve_confusions(text: Column, freq: Column) -> Column:
    """Unknown words by their most frequent one-letter variant; ``freq`` is a map of counts.

    For a vocabulary too large for a map in every row, see ``resolve_by_join``.
    """

    def one(w: Column) -> Column:
        tries = [
            F.when(F.contains(w, F.lit(s)), F.concat(F.substring_index(w, s, 1), F.lit(t), F.substr(w, F.position(F.lit(s), w) + len(s)))) for s, t in L.CONFUSABLE
        ]
        count = lambda c: F.coalesce(F.try_element_at(freq, c), F.lit(0).cast("bigint"))
        best = F.aggregate(
            F.array_compact(F.array(*tries)),
            F.struct(w.alias("w"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, c: F.when(count(c) > acc["n"], F.struct(c.alias("w"), count(c).alias("n"))).otherwise(acc),
        )["w"]
        return F.when(F.try_element_at(freq, w).isNotNull(), w).otherwise(best)

    return join(F.transform(tokens(text), one))


def variants(word: Column) -> Column:
    """A word's one-letter variants in order; none where it has no confusable letter."""
    tries = [F.when(F.contains(word, F.lit(s)), F.concat(F.substring_index(word, s, 1), F.lit(t), F.substr(word, F.position(F.lit(s), word) + len(s)))) for s, t in L.CONFUSABLE]
    return F.array_compact(F.array(*tries))


def resolve_by_join(rows: DataFrame, freq: DataFrame, key: str) -> DataFrame:
    """(key, resolved) of (key, text): ``resolve_confusions`` with a table (word, freq) that is joined.

    Distinct words meet the table, once as they stand and once by variant, so
    neither vocabulary is broadcast or gathered.
    """
    each = rows.select(key, F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    words = each.select("word").distinct()
    unknown = words.join(freq, "word", "left_anti")
    tried = unknown.select("word", F.posexplode(variants(F.col("word"))).alias("i", "variant")).join(freq.select(F.col("word").alias("variant"), "freq"), "variant").where("freq > 0")
    best = tried.groupBy("word").agg(F.max_by("variant", F.struct("freq", -F.col("i"))).alias("best"))
    out = each.join(best, "word", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("best", "word").alias("w")))).alias("l"))
    return rows.select(key).join(out, key, "left").select(key, F.coalesce(join(F.transform("l", lambda x: x["w"])), F.lit("")).alias("resolved"))


def fix(text: Column, freq: Column, compose: bool = True) -> Column:
    """Normalised, without repetitions, confusions resolved.

    Composing is a UDF, which higher-order functions cannot hold: store
    ``nfc(text)`` first and pass ``compose=False`` where texts need it.
    """
    return let(normalize(text, compose=compose), lambda t: resolve_confusions(suppress_repetitions(t), freq))

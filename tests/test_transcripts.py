"""Golden cases derived by hand, and every query with SQL against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vaakya.operators import transcripts
from vaakya.functions import align, classify, text
from vaakya.plans import catalog

SF = "/root/testdata/sf0.001"


def each(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_numbers(spark):
    cases = {
        "तीन सौ चौवन लोग आए": "354 लोग आए",
        "दो लाख तीन हज़ार पाँच सौ": "203500",
        "मेरी उम्र अठारह साल है": "मेरी उम्र 18 साल है",
        "एक दूसरे से बात करो": "एक दूसरे से बात करो",
        "दो चार बातें": "दो चार बातें",
        "दो तीन लोग": "5 लोग",
        "सौ, लोग": "100 लोग",
        "शून्य अंक": "शून्य अंक",
        "": "",
        "सौ " * 12: "1" + "0" * 24,
    }
    assert each(spark, text.normalize_numbers, *cases) == list(cases.values())
    assert each(spark, text.normalize_numbers, None) == [None]


def test_loans_and_cleanup(spark):
    assert each(spark, text.loan_suffix, "पहली", "गली", "मैनेजमेंट") == [True, False, False]
    assert each(spark, text.roman, "hello-x", "abc1", "a") == [True, False, False]
    assert each(spark, lambda t: text.cleanup(t)["cleaned"], "तीन सौ चौवन लोग आए थे और मेरा इंटरव्यू अच्छा गया") == ["354 लोग आए थे और मेरा [EN]इंटरव्यू[/EN] अच्छा गया"]


def test_repairs(spark):
    assert each(spark, text.normalize, "मेरा नाम..") == ["मेंरा नाम"]
    assert each(spark, text.suppress_repetitions, "a b a b c b c", "बार बार आया आया") == ["a b c", "बार बार आया आया"]


def test_alignment(spark):
    rows = [(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["x"]), (["x"], []), ([], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>").orderBy("i")
    got = df.select(align.edit_path(F.col("a"), F.col("b")).alias("p"), align.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.p.cost, r.p.path, r.d) for r in got] == [(2, "MSMI", 2), (1, "I", 1), (1, "D", 1), (0, "", 0)]
    many = spark.createDataFrame([([str(i) for i in range(300)], [str(i) for i in range(1, 301)])], "a array<string>, b array<string>")
    assert many.select(align.word_distance(F.col("a"), F.col("b"))).first()[0] == 2


def test_batched_paths_are_the_same(spark):
    """Paths by whole tables against paths by folds, in several batches, with empty sides."""
    import random

    rng = random.Random(7)
    rows = [(i, rng.choices("abcd", k=rng.randint(0, 9)), rng.choices("abcd", k=rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = df.select(align.edit_path(F.col("a"), F.col("b"))["path"].alias("p"), align.edit_paths("a", "b").alias("q")).collect()
    assert all(r.p == r.q for r in got)
    align._CELLS, kept = 50, align._CELLS
    try:
        assert align.paths([r[1] for r in rows], [r[2] for r in rows]) == [r.p for r in df.orderBy("i").select(align.edit_path(F.col("a"), F.col("b"))["path"].alias("p")).collect()]
    finally:
        align._CELLS = kept


def test_classes(spark):
    got = each(spark, lambda w: classify.classify_word(w), "और", "कंप्यूटर", "hello", "।।", "्क")
    assert [(r.classification, r.confidence) for r in got] == [("correct", "high"), ("correct", "high"), ("incorrect", "high"), ("incorrect", "high"), ("incorrect", "high")]
    assert got[2].reason == "invalid characters: non-Devanagari character: 'h' (U+0068)"
    assert each(spark, classify.categorize_word, "दो-चार", "वह", "हम्म", "टनटन") == ["compound", "abbreviation", "onomatopoeia", "onomatopoeia"]


def test_lattice_demo_shape(spark):
    from vaakya.operators import lattice

    u = spark.createDataFrame([(1, "a b c", "x a b c", "a b c", "a b c", "a b", "")], "utt_id long, reference string, model_1 string, model_2 string, model_3 string, model_4 string, model_5 string")
    rows = {(r["row"], r.pos): r.word for r in lattice.align_matrix(u).collect()}
    assert [rows[1, p] for p in range(3)] == ["x", "a", "b"]  # insertions shift, the tail is lost
    assert [rows[5, p] for p in range(3)] == [None] * 3


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    as_rows = lambda df: sorted(map(repr, df[cols].astype(str).values.tolist()))
    assert as_rows(got) == as_rows(want)


def test_unreliable_categories(spark):
    """Over 30 % of at least two words; the first five words as examples."""
    rows = [(i, f"w{i}", "loan", "valid" if i < 4 else "typo", "correct") for i in range(6)]
    rows += [(i, f"x{i}", "name", "valid", "correct" if i else "incorrect") for i in range(4)] + [(0, "y", "rare", "typo", "correct")]
    got = transcripts.unreliable_categories(spark.createDataFrame(rows, "pos int, word string, word_category string, analysis string, system_classification string")).collect()
    assert [tuple(r) for r in got] == [("loan", 6, 2, "33.3%", [f"w{i}" for i in range(5)], "The system has limited coverage for loan words.")]


def test_wer_comparison(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "edits long, ref_words long")
    assert tuple(transcripts.wer_comparison(of((3, 4), (1, 4)), of((1, 8))).first()) == (0.5, 0.125, 0.375, 75.0)
    assert transcripts.wer_comparison(of((0, 4)), of((1, 4))).first().improvement_pct == 0


def test_repetition_ngrams_documents(spark):
    """Every document in full against a loop."""
    import re

    from vaakya.functions import lexicon

    def fixed(t):
        w = [x for x in re.split("[ \\t\\n\\r\\x0b\\x0c]+", t) if x]
        if len(w) <= 1 or any(p in t for p in lexicon.INTENDED):
            return t
        w = [x for i, x in enumerate(w) if i == 0 or x != w[i - 1]]
        for n in (2, 3):
            out = []
            for x in w:
                out.append(x)
                if len(out) >= 2 * n and out[-n:] == out[-2 * n : -n]:
                    del out[-n:]
            w = out
        return " ".join(w)

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.fixed for r in catalog._QUERIES["repetition_ngrams_documents"](spark, SF).collect()}
    assert got == {i: t if t is None else fixed(t) for i, t in docs.items()}


def test_repetition_ngrams_at_length(spark):
    """Repetitions that touch and overlap, against a loop; a long text takes no longer than its length asks."""
    import random
    import time

    def fixed(w):
        w = [x for i, x in enumerate(w) if i == 0 or x != w[i - 1]]
        for n in (2, 3):
            out = []
            for x in w:
                out.append(x)
                if len(out) >= 2 * n and out[-n:] == out[-2 * n : -n]:
                    del out[-n:]
            w = out
        return " ".join(w)

    rng = random.Random(3)
    rows = [rng.choices(["a", "b", "aa", "é", "b.", "𝒳"][: rng.randint(2, 6)], k=rng.randint(2, 40)) for _ in range(5000)]
    assert each(spark, text.suppress_repetitions, *[" ".join(w) for w in rows]) == [fixed(w) for w in rows]
    long = [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(100_000)]
    began = time.time()
    assert each(spark, text.suppress_repetitions, " ".join(long)) == [fixed(long)]
    assert time.time() - began < 60


def test_repairs_are_computed_once(spark):
    """Outputs that recur count each, an empty reference is unchanged, and no step is repeated where another names it."""
    rows = [("m1", "में बन", "मे मे बन"), ("m1", "में बन", "मे मे बन"), ("m1", "में बन", "में बन"), ("m1", "", "बन"), ("m2", "में में बन", "में में बन"), ("m2", "में बन", "में वन बन वन बन"), ("m2", "में बन", ""), ("m2", None, "बन")]
    freq = F.create_map(*[x for w, n in (("में", 1), ("बन", 2)) for x in (F.lit(w), F.lit(n).cast("bigint"))])
    got = transcripts.repair_effects(spark.createDataFrame(rows, "model_id string, reference string, prediction string"), freq)
    assert sorted(map(tuple, got.collect())) == [("m1", 2, 2, 0), ("m2", 1, 2, 1)]
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\\.{2,}")
    docs = spark.range(3).select(F.concat(F.lit("में बन "), F.col("id").cast("string")).alias("t"))
    assert steps(docs.select(text.fix(F.col("t"), freq, compose=False).alias("f"))) == 1
    assert steps(catalog.queries()["fix_eval"](spark, SF)) == 2


def test_taxonomy_labels_each_error_once(spark):
    """Counts and first examples over many batches, out of order; the query labels in one place and needs no distance."""
    rows = [((i * 7919) % 30_011 - 5, f"model_{i % 3}", "a b c", f"{'x' if i % 2 else 'a'} b c {i % 11}" if i % 5 else "a b c") for i in range(30_011)]
    rows.append((None, "model_9", "a b c", "a b"))
    df = spark.createDataFrame(rows, "utt_id long, model_id string, reference string, prediction string").repartition(3)
    got = {r.category: (r.errors, r.examples) for r in transcripts.error_taxonomy(transcripts.errors(df)).collect()}
    wrong = sorted((r for r in rows if r[2] != r[3]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    number = [r for r in wrong if r[0] is not None]
    assert got["code_mixing"] == (len(wrong), [r[3] for r in wrong[:5]])
    assert got["number_error"] == (len(number), [r[3] for r in number[:5]])
    assert got["deletion_error"] == (1, ["a b"])
    rates = transcripts.wer_pairs(df)
    assert {r.category: (r.errors, r.examples) for r in transcripts.taxonomy(rates).collect()} == got
    none = [(1, "m", "", "a"), (2, "m", None, "a"), (3, "m", "a", " a ")]
    assert transcripts.error_taxonomy(transcripts.errors(spark.createDataFrame(none, df.schema))).count() == 0
    for name in ("taxonomy_topk", "fix_proposals"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("levenshtein(") == 1

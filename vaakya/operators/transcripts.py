"""Relations and aggregates over transcripts: rates, samples, taxonomies, reviews. DataFrame to DataFrame."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import align, classify, text
from ..functions import lexicon as L
from ..functions.tokens import SPACE, literal_map, tokens


def unpivot_models(utterances: DataFrame, models: int = 5) -> DataFrame:
    """(utt_id, model_id, reference, prediction): a row for each model; a missing output is empty."""
    each = F.array(*[F.struct(F.lit(f"model_{k}").alias("model_id"), F.coalesce(F.col(f"model_{k}"), F.lit("")).alias("prediction")) for k in range(1, models + 1)])
    return utterances.select("utt_id", "reference", F.explode(each).alias("m")).select("utt_id", "m.model_id", "reference", "m.prediction")


def wer_pairs(pairs: DataFrame) -> DataFrame:
    """Adds edits, ref_words and wer to (reference, prediction)."""
    r, h = tokens(F.col("reference")), tokens(F.col("prediction"))
    out = pairs.withColumn("edits", align.word_distance(r, h).cast("bigint")).withColumn("ref_words", F.size(r).cast("bigint"))
    return out.withColumn("wer", F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).otherwise(0.0))


def corpus_wer(rows: DataFrame, *by: str) -> DataFrame:
    """Edits over reference words, pooled."""
    edits, words = F.sum("edits"), F.sum("ref_words")
    return rows.groupBy(*by).agg(F.count("*").alias("utterances"), edits.alias("edits"), words.alias("ref_words"), F.round(F.when(words > 0, edits / words), 9).alias("corpus_wer"))


def wer_comparison(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(raw_wer, cleaned_wer, improvement, improvement_pct) of two corpora, rounded at the end."""
    rate = lambda df, name: df.agg(F.coalesce(F.sum("edits") / F.nullif(F.sum("ref_words"), F.lit(0)), F.lit(0.0)).alias(name))
    both = rate(raw, "raw_wer").join(rate(cleaned, "cleaned_wer"), F.lit(True))
    gain = F.col("raw_wer") - F.col("cleaned_wer")
    pct = F.when(F.col("raw_wer") > 0, gain / F.col("raw_wer") * 100).otherwise(0.0)
    return both.select(*[F.round(c, 9).alias(n) for c, n in ((F.col("raw_wer"), "raw_wer"), (F.col("cleaned_wer"), "cleaned_wer"), (gain, "improvement"), (pct, "improvement_pct"))])


def sample_errors(rows: DataFrame, n: int = 25, order: tuple[str, ...] = ("wer", "utt_id", "model_id")) -> DataFrame:
    """Every n-th error of each severity, low first, n + 5 in all; then refilled from all errors as medium; ``place`` numbers them.

    Ranks within a severity and the running place are counted by window; the
    sample itself is a bounded number of rows.
    """
    errors = rows.where("wer > 0").withColumn("severity", classify.severity(F.col("wer")))
    rank = F.row_number().over(Window.partitionBy("severity").orderBy(*order)) - 1
    size = F.count("*").over(Window.partitionBy("severity"))
    step = F.greatest(F.lit(1), F.floor(size / max(n // 3, 3)).cast("bigint"))
    first = errors.withColumn("i", rank).withColumn("step", step).where("i % step = 0")
    level = F.when(F.col("severity") == "low", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    first = first.orderBy(level, *order).limit(n + 5)
    first = first.withColumn("place", F.row_number().over(Window.orderBy(level, *order)).cast("bigint"))
    taken = first.agg(F.count("*").alias("taken"))
    every = errors.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("all", F.count("*").over(Window.partitionBy()))
    refill = every.join(F.broadcast(taken), F.lit(True)).where(f"taken < {n}").withColumn("step", F.greatest(F.lit(1), F.floor(F.col("all") / (n - F.col("taken"))).cast("bigint")))
    refill = refill.where("i % step = 0").withColumn("place", F.col("taken") + F.floor(F.col("i") / F.col("step")) + 1).withColumn("severity", F.lit("medium"))
    names = [*rows.columns, "severity", "place"]
    both = first.select(*names).union(refill.where(f"place <= {n}").select(*names))
    return both.where(f"place <= {max(n, 25)}")


def errors(pairs: DataFrame) -> DataFrame:
    """The (reference, prediction) of a rate above 0: other words, and a reference that has some. Needs no distance."""
    r, h = tokens(F.col("reference")), tokens(F.col("prediction"))
    return pairs.where((F.size(r) > 0) & (r != h))


def taxonomy(rows: DataFrame, examples: int = 5) -> DataFrame:
    """(category, errors, examples): labels of all errors, with the first examples by id."""
    return error_taxonomy(rows.where("wer > 0"), examples)


def error_taxonomy(rows: DataFrame, examples: int = 5) -> DataFrame:
    """``taxonomy`` of rows that are errors all.

    Each row is labelled once: a task counts its labels and keeps the first examples of each, so that what is
    gathered for a category is a few rows from each task.
    """
    each = rows.select("utt_id", "model_id", "prediction", F.explode(classify.error_labels(F.col("reference"), F.col("prediction"))).alias("category"))
    schema = StructType([*each.schema.fields, StructField("n", LongType())])

    def by_id(t: pa.Table) -> pa.Array:
        return pc.sort_indices(t, sort_keys=[("utt_id", "ascending"), ("model_id", "ascending")], null_placement="at_start")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        first: dict[str, pa.Table] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.take(by_id(t))
            category = t["category"].combine_chunks().dictionary_encode()
            code = category.indices.to_numpy()
            for k, c in enumerate(category.dictionary.to_pylist()):
                own = np.flatnonzero(code == k)
                counts[c] += len(own)
                both = pa.concat_tables([*([first[c]] if c in first else []), t.take(pa.array(own[:examples]))])
                first[c] = both.take(by_id(both)[:examples])
        for c, t in first.items():
            n = pa.array([counts[c]] + [0] * (t.num_rows - 1), pa.int64())
            yield from t.append_column("n", n).combine_chunks().to_batches()

    found = F.slice(F.array_sort(F.collect_list(F.struct("utt_id", "model_id", "prediction"))), 1, examples)
    out = each.mapInArrow(fold, schema).groupBy("category").agg(F.sum("n").alias("errors"), found.alias("e"))
    return out.select("category", "errors", F.transform("e", lambda x: x["prediction"]).alias("examples"))


def repair_effects(rows: DataFrame, freq: Column) -> DataFrame:
    """(model_id, improved, unchanged, degraded): outputs by what the repairs do to their rates, in composed texts.

    Each distinct output of a model for a reference is repaired once, and each step stands in a column of its own:
    within one expression it would be computed wherever a later step names it.
    """
    each = rows.groupBy("model_id", "reference", "prediction").agg(F.count("*").alias("n"))
    norm = each.select("model_id", "n", tokens(text.normalize(F.col("reference"), compose=False)).alias("r"), text.normalize(F.col("prediction"), compose=False).alias("o"))
    fixed = norm.select("model_id", "n", "r", tokens(F.col("o")).alias("h"), tokens(text.resolve_confusions(text.suppress_repetitions(F.col("o")), freq)).alias("f"))
    rate = lambda c: align.wer(F.col("r"), F.col(c))
    w = fixed.select("model_id", "n", rate("h").alias("a"), F.when(F.col("h") != F.col("f"), rate("f")).alias("b"))
    b = F.coalesce("b", "a")
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return w.groupBy("model_id").agg(number(b < F.col("a")).alias("improved"), number(b == F.col("a")).alias("unchanged"), number(b > F.col("a")).alias("degraded"))


def propose_fixes(errors: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent categories of ``taxonomy`` with what is proposed for each: a top-k report."""
    titles, ways = (literal_map({k: v[i] for k, v in L.PROPOSALS.items()}) for i in (0, 1))
    best = errors.orderBy(F.desc("errors"), "category").limit(top)
    title = F.coalesce(F.try_element_at(titles, "category"), F.concat(F.lit("Fix for "), F.col("category")))
    return best.select("category", "errors", title.alias("fix_title"), F.coalesce(F.try_element_at(ways, "category"), F.lit("Custom fix needed")).alias("implementation"), "examples")


def by_position(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of the same place side by side; the longer side is cut to the shorter one."""
    return left.join(right, pos)


def low_confidence_accuracy(reviewed: DataFrame) -> DataFrame:
    """(reviewed, correct, accuracy) of the system's verdicts on reviewed words, by their notes."""
    a, right = F.lower("analysis"), F.col("system_classification") == "correct"
    good = F.contains(a, F.lit("valid")) | F.contains(a, F.lit("correct"))
    hit = F.count_if((right & good) | (~right & ~good))
    return reviewed.agg(F.count("*").alias("reviewed"), hit.alias("correct"), F.round(F.when(F.count("*") > 0, hit / F.count("*")).otherwise(0.0), 9).alias("accuracy"))


def number_segments(rows: DataFrame, *order: str) -> DataFrame:
    """Adds segment_id, seg_000000 on, in the given order: counts of range partitions first, so that no task holds all rows."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "before")
    out = placed.join(F.broadcast(before), "_p")
    return out.withColumn("segment_id", F.format_string("seg_%06d", F.col("before") + F.col("_i"))).drop("_p", "_i", "before")


def review_low_confidence(words: DataFrame, n: int = 50) -> DataFrame:
    """Every n-th word of low confidence by ``pos``, with its category and notes."""
    low = words.where("confidence = 'low'")
    low = low.withColumn("i", F.row_number().over(Window.orderBy("pos")) - 1).withColumn("all", F.count("*").over(Window.partitionBy()))
    step = F.greatest(F.lit(1), F.floor(F.col("all") / F.least(F.lit(n), F.col("all"))).cast("bigint"))
    kept = low.withColumn("step", step).where(f"i % step = 0 and i / step < {n}")
    category = classify.categorize_word(F.col("word"))
    return kept.select("pos", "word", F.col("classification").alias("system_classification"), F.col("reason").alias("system_reason"), category.alias("word_category")).withColumn(
        "analysis", classify.analysis_notes(F.col("word"), F.col("word_category"))
    )


def unreliable_categories(reviewed: DataFrame) -> DataFrame:
    """Categories of two words or more where over 30 % of the system's verdicts do not fit the notes, with a reason.

    Examples are the first five by ``pos``: ranked, so that no category is gathered whole.
    """
    a, right = F.lower("analysis"), F.col("system_classification") == "correct"
    good, bad = F.contains(a, F.lit("valid")) | F.contains(a, F.lit("correct")), F.contains(a, F.lit("typo")) | F.contains(a, F.lit("incorrect"))
    fits = (right & good) | (~right & bad)
    ranked = reviewed.withColumn("i", F.row_number().over(Window.partitionBy("word_category").orderBy("pos")))
    first = F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.struct("pos", "word"))))
    out = ranked.groupBy("word_category").agg(F.count("*").alias("total_words"), F.count_if(~fits).alias("system_errors"), first.alias("e"))
    rate = F.col("system_errors") / F.col("total_words")
    return out.where((F.col("total_words") >= 2) & (rate > 0.3)).select(
        F.col("word_category").alias("category"), "total_words", "system_errors", F.format_string("%.1f%%", rate * 100).alias("error_rate"), F.transform("e", lambda x: x["word"]).alias("examples"),
        F.coalesce(F.try_element_at(literal_map(L.REASONS), "word_category"), F.concat(F.lit("The system has limited coverage for "), F.col("word_category"), F.lit(" words."))).alias("reason"),
    )


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, freq) of all tokens."""
    return texts.select(F.explode(tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def valid_segments(segments: DataFrame, rate: int = 16_000, least: float = 0.5, most: float = 30.0) -> DataFrame:
    """Segments with text that, clipped to the recording's n_samples, last between the limits."""
    first = F.greatest(F.lit(0), (F.col("start") * rate).cast("bigint"))
    last = F.least(F.col("n_samples"), (F.col("end") * rate).cast("bigint"))
    out = segments.withColumn("text", F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", ""))
    out = out.withColumn("start", F.coalesce("start", F.lit(0.0))).withColumn("end", F.coalesce("end", F.lit(0.0))).where("text <> '' and end > start")
    out = out.withColumn("first_sample", first).withColumn("last_sample", last).withColumn("duration", (F.col("last_sample") - F.col("first_sample")) / rate)
    return out.where((F.col("last_sample") > F.col("first_sample")) & F.col("duration").between(least, most))


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Segments, hours, mean duration, speakers and recordings of (duration, user_id, recording_id)."""
    return rows.agg(
        F.count("*").alias("segments"),
        F.round(F.sum("duration") / 3600, 6).alias("hours"),
        F.round(F.avg("duration"), 6).alias("mean_duration"),
        F.count_distinct("user_id").alias("speakers"),
        F.count_distinct("recording_id").alias("recordings"),
    )


def with_both_files(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all the given columns."""
    return rows.dropna(subset=list(columns))


def spelling_label(classified: DataFrame) -> DataFrame:
    """(word, label): correct spelling or incorrect spelling."""
    return classified.select("word", F.when(F.col("classification") == "correct", "correct spelling").otherwise("incorrect spelling").alias("label"))


def excerpt(text: Column, n: int = 50) -> Column:
    """The first ``n`` characters, with dots where more follow."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def changed_examples(cleaned: DataFrame, step: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``pos`` of (pos, c) whose clean-up has the step, and words where the step finds some."""
    own = lambda s: (s["step"] == step) & (s["english_words"].isNull() | (F.size(s["english_words"]) > 0))
    return cleaned.where(F.exists("c.steps", own)).orderBy("pos").limit(n)


def methods(detected: DataFrame) -> DataFrame:
    """The distinct ways by which words were detected."""
    return detected.agg(F.array_sort(F.collect_set("method")).alias("methods"))


def metrics(rows: DataFrame) -> DataFrame:
    """(wer) of all rows, pooled, in per cent."""
    return rows.agg(F.round(F.coalesce(F.sum("edits") / F.nullif(F.sum("ref_words"), F.lit(0)), F.lit(0.0)) * 100, 9).alias("wer"))


def with_errors(files: DataFrame, texts: DataFrame, key: str = "name") -> DataFrame:
    """A row per file with its text, or the reason why there is none."""
    return files.join(texts, key, "left").withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("no transcript for "), F.col(key))))


def synthetic_corpus(sentences: DataFrame) -> DataFrame:
    """(pos, text) as a corpus: a recording per sentence, a twelfth of a second a character, one to five seconds; five speakers."""
    return sentences.select(
        F.format_string("synthetic_%04d", "pos").alias("recording_id"), (F.col("pos") % 5).alias("user_id"), "text", F.least(F.greatest(F.length("text") / 12, F.lit(1.0)), F.lit(5.0)).alias("duration")
    )

"""Command line: python -m vaakya COMMAND INPUT OUTPUT; each command reads and writes files of the formats in sources."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import align, classify, text
from .functions.tokens import tokens
from .operators import lattice, reports, transcripts
from .sources import files


def _write(out: str, name: str, body: str) -> None:
    os.makedirs(out, exist_ok=True)
    with open(f"{out}/{name}", "w", encoding="utf-8") as f:
        f.write(body)


def preprocess(spark: SparkSession, path: str, out: str) -> None:
    """Segments of JSON files as a dataset with running ids, and its totals."""
    rows = files.segments(spark, path).withColumn("user_id", F.lit(None).cast("string")).withColumn("n_samples", F.ceil(F.col("end") * 16_000).cast("bigint"))
    found = transcripts.number_segments(transcripts.valid_segments(rows), "recording_id", "start", "end")
    files.write_json(found, f"{out}/segments")
    files.write_json(transcripts.dataset_stats(found), f"{out}/stats")


def create_synthetic(spark: SparkSession, path: str, out: str) -> None:
    """A corpus made of a JSON array of sentences."""
    files.write_json(transcripts.synthetic_corpus(files.transcripts(spark, path, ("text", "transcript"))), f"{out}/corpus")


def _rates(rows: DataFrame) -> DataFrame:
    return transcripts.wer_pairs(rows.withColumnRenamed("pos", "utt_id").withColumn("model_id", F.lit("model")))


def evaluate(spark: SparkSession, path: str, out: str) -> None:
    """The error rates of both models of an evaluation."""
    _write(out, "wer.md", reports.wer_table(*[_rates(files.evaluation_results(spark, path, m)) for m in ("baseline", "finetuned")]))


def error_analysis(spark: SparkSession, path: str, out: str) -> None:
    """Errors of the second model: the sample and the report."""
    rates = _rates(files.evaluation_results(spark, path))
    files.write_json(transcripts.sample_errors(rates), f"{out}/sampled_errors")
    _write(out, "errors.md", reports.error_report(rates))


def fix_implementation(spark: SparkSession, path: str, out: str) -> None:
    """Sampled errors before and after repairs."""
    rows = files.sampled_errors(spark, path)
    freq = F.create_map(F.lit(""), F.lit(0).cast("bigint"))
    r = tokens(text.normalize(F.col("reference")))
    cut = rows.select("severity", "wer", r.alias("r"), tokens(text.normalize(F.col("prediction"))).alias("o"), text.normalize(F.col("prediction")).alias("n"))
    fixed = cut.withColumn("f", tokens(text.resolve_confusions(text.suppress_repetitions(F.col("n")), freq)))
    # An empty reference keeps the rate that is stored with it.
    rate = lambda h: F.when(F.size("r") > 0, align.wer(F.col("r"), F.col(h))).otherwise(F.coalesce("wer", F.lit(0.0)))
    w = fixed.select("severity", rate("o").alias("a"), rate("f").alias("b"))
    done = w.groupBy("severity").agg(F.count_if(F.col("b") < F.col("a")).alias("improved"), F.count_if(F.col("b") == F.col("a")).alias("unchanged"), F.count_if(F.col("b") > F.col("a")).alias("degraded"))
    _write(out, "fixes.md", reports.before_after_report(done))


def number_normalization(spark: SparkSession, path: str, out: str) -> None:
    """Transcripts with numbers as digits."""
    files.write_json(files.transcripts(spark, path).withColumn("normalized", text.normalize_numbers(F.col("text"))), f"{out}/numbers")


def english_detection(spark: SparkSession, path: str, out: str) -> None:
    """Transcripts with loan words tagged, and the vocabulary of those words."""
    rows = files.transcripts(spark, path, ("text", "transcription"))
    files.write_json(rows.withColumn("tagged", text.tag_english(F.col("text"))), f"{out}/tagged")
    words = rows.select(F.explode(text.detect_english(F.col("text"))).alias("d"))
    files.write_json(words.groupBy("d.word").agg(F.count("*").alias("freq")), f"{out}/vocabulary")


def pipeline(spark: SparkSession, path: str, out: str) -> None:
    """Transcripts cleaned, with the report."""
    rows = files.transcripts(spark, path).select("pos", text.cleanup(F.col("text")).alias("c"))
    files.write_json(rows.select("pos", "c.*"), f"{out}/cleaned")
    summary = rows.agg(F.count("*").alias("transcripts"), F.count_if(F.col("c.original") != F.col("c.cleaned")).alias("changed"))
    _write(out, "cleanup.md", reports.cleanup_report(summary, *[transcripts.changed_examples(rows, s) for s in ("number_normalization", "english_detection")]))


def spell_checker(spark: SparkSession, path: str, out: str) -> None:
    """A word list classified and labelled."""
    words = files.word_list(spark, path, path.endswith(".csv"))
    found = words.distinct().select("word", classify.classify_word(F.col("word")).alias("c")).select("word", "c.*")
    files.write_json(found, f"{out}/classified")
    files.write_csv(transcripts.spelling_label(found), f"{out}/labels")


def analysis(spark: SparkSession, path: str, out: str) -> None:
    """Classified words reviewed, with the report."""
    rows = files.classification_results(spark, path)
    reviewed = transcripts.review_low_confidence(rows)
    files.write_json(reviewed, f"{out}/review")
    _write(out, "spelling.md", reports.spelling_report(rows, reviewed))


def lattice_command(spark: SparkSession, path: str, out: str) -> None:
    """Outputs of five models: bins, rates and the report."""
    u = files.model_outputs(spark, path)
    u = u.withColumn("utt_id", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("bigint") - 1)
    bins = lattice.lattice_bins(lattice.align_matrix(u))
    rates = lattice.lattice_wer(transcripts.unpivot_models(u), bins)
    files.write_json(lattice.as_documents(bins), f"{out}/lattice")
    _write(out, "lattice.md", reports.lattice_report(lattice.model_summary(rates), rates))


COMMANDS = {
    "preprocess": preprocess,
    "create-synthetic": create_synthetic,
    "evaluate": evaluate,
    "error-analysis": error_analysis,
    "fix": fix_implementation,
    "numbers": number_normalization,
    "english": english_detection,
    "cleanup": pipeline,
    "spelling": spell_checker,
    "analysis": analysis,
    "lattice": lattice_command,
}


def main(args: list[str] | None = None) -> None:
    """Runs one command."""
    p = argparse.ArgumentParser(prog="vaakya", description="Transcript analytics on Spark")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("input")
    p.add_argument("output")
    a = p.parse_args(args)
    COMMANDS[a.command](SparkSession.builder.getOrCreate(), a.input, a.output)


if __name__ == "__main__":
    main()

"""Markdown reports, rendered from aggregates and top-k lists, which are small by their nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import transcripts

#: Rows that a table of a report may have.
MOST = 1_000


def table(rows: DataFrame) -> str:
    """A Markdown table of at most MOST rows; more are an error."""
    found = rows.limit(MOST + 1).collect()  # MOST + 1 rows at most
    if len(found) > MOST:
        raise ValueError(f"a report's table has over {MOST} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    for r in found:
        cells = [", ".join(map(str, x)) if isinstance(x, list) else "" if x is None else str(x) for x in r]
        lines.append("| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |")
    return "\n".join(lines)


def _report(title: str, *parts: tuple[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{table(rows)}" for name, rows in parts]]) + "\n"


def error_report(rates: DataFrame, examples: int = 5) -> str:
    """Errors by severity and category, with proposals, of (utt_id, model_id, reference, prediction, wer)."""
    labels = transcripts.taxonomy(rates, examples)
    severity = rates.where("wer > 0").groupBy(F.when(F.col("wer") <= 0.33, "low").when(F.col("wer") <= 0.66, "medium").otherwise("high").alias("severity")).agg(F.count("*").alias("errors")).orderBy("severity")
    short = labels.withColumn("examples", F.transform("examples", transcripts.excerpt)).orderBy(F.desc("errors"), "category")
    return _report("Error analysis", ("Severity", severity), ("Categories", short), ("Proposals", transcripts.propose_fixes(labels).drop("examples")))


def cleanup_report(summary: DataFrame, numbers: DataFrame, english: DataFrame) -> str:
    """Counts of a clean-up, and examples of its two steps as (pos, c)."""
    cut = lambda df: df.select(transcripts.excerpt(F.col("c.original")).alias("original"), transcripts.excerpt(F.col("c.cleaned")).alias("cleaned"))
    return _report("Clean-up", ("Summary", summary), ("Numbers", cut(numbers)), ("English words", cut(english)))


def spelling_report(classified: DataFrame, reviewed: DataFrame) -> str:
    """Words by class, the review's accuracy, and the categories that cannot be relied on."""
    by = classified.groupBy("classification", "confidence").agg(F.count("*").alias("words")).orderBy("classification", "confidence")
    share = by.join(by.agg(F.sum("words").alias("all")), F.lit(True)).select("classification", "confidence", "words", F.round(100 * F.col("words") / F.col("all"), 1).alias("percent"))
    return _report("Spelling", ("Classes", share), ("Review", transcripts.low_confidence_accuracy(reviewed)), ("Unreliable categories", transcripts.unreliable_categories(reviewed)))


def lattice_report(summary: DataFrame, rates: DataFrame, n: int = 5) -> str:
    """Rates by model, and the outputs that the lattice helps most."""
    best = rates.withColumn("gain", F.round(F.col("standard_wer") - F.col("lattice_wer"), 4)).orderBy(F.desc("gain"), "utt_id", "model_id").limit(n)
    return _report("Lattice", ("Models", summary.orderBy("model_id")), ("Largest gains", best))


def before_after_report(evaluated: DataFrame) -> str:
    """Outputs improved, unchanged and degraded by repairs, by model."""
    return _report("Repairs", ("Outcome", evaluated.orderBy(evaluated.columns[0])))


def wer_table(baseline: DataFrame, finetuned: DataFrame) -> str:
    """The pooled rates of two sets of (edits, ref_words)."""
    both = transcripts.metrics(baseline).select(F.lit("baseline").alias("model"), "wer").union(transcripts.metrics(finetuned).select(F.lit("finetuned"), "wer"))
    return _report("Word error rate", ("Models", both))

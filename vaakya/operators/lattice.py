"""A voting lattice of several recognisers' outputs, and error rates against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align
from ..functions.tokens import tokens


def aligned_row(ref: Column, hyp: Column, path: Column) -> Column:
    """The words of an output by column of the reference; insertions take columns, and the row ends with the reference."""
    words = F.transform(align.path_ops(path), lambda o: F.when(o["op"] != "D", F.get(hyp, o["j"])))
    return F.slice(words, F.lit(1), F.size(ref))


def align_matrix(utterances: DataFrame, models: int = 5) -> DataFrame:
    """(utt_id, row, pos, word): row 0 is the reference, gaps are null."""
    split = [tokens(F.col("reference")).alias("ref")] + [tokens(F.coalesce(F.col(f"model_{k}"), F.lit(""))).alias(f"h{k}") for k in range(1, models + 1)]
    cut = utterances.select("utt_id", *split)
    cut = cut.select("*", *[align.edit_paths("ref", f"h{k}").alias(f"p{k}") for k in range(1, models + 1)])
    rows = [F.struct(F.lit(0).alias("row"), F.col("ref").alias("words"))]
    rows += [F.struct(F.lit(k).alias("row"), aligned_row(F.col("ref"), F.col(f"h{k}"), F.col(f"p{k}")).alias("words")) for k in range(1, models + 1)]
    each = cut.select("utt_id", F.explode(F.array(*rows)).alias("r"))
    return each.select("utt_id", F.col("r.row").alias("row"), F.posexplode("r.words").alias("pos", "word"))


def lattice_bins(matrix: DataFrame, models: int = 5, threshold: int = 3, weights: list[float] | None = None) -> DataFrame:
    """(utt_id, pos, word, votes, confidence, is_best) of every word of a column.

    ``weights`` has one number for the reference and one for each model. Equal
    meanings share the higher confidence, in one step. A word that ``threshold``
    models agree on, against the reference, rises to its share of the models and
    halves the reference. The best word is the most confident; ties go to the
    reference, then to the first row.
    """
    weights = weights or [1.0] * (models + 1)
    if len(weights) != models + 1:
        raise ValueError("a weight for the reference and for each model is needed")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("row") + 1)
    words = matrix.where("word is not null")
    votes = words.groupBy("utt_id", "pos", "word").agg(
        F.sum(weight).alias("votes"), F.min("row").alias("first"), F.count_if(F.col("row") > 0).alias("agree"), F.min(F.when(F.col("row") > 0, F.col("row"))).alias("first_model"), F.max((F.col("row") == 0).cast("int")).alias("is_ref")
    )
    bins = votes.groupBy("utt_id", "pos").agg(F.collect_list(F.struct("word", "votes", "first", "agree", "first_model", "is_ref")).alias("b"))
    total = float(sum(weights))
    base = F.transform("b", lambda x: x.withField("conf", x["votes"] / total))
    bins = bins.select("utt_id", "pos", base.alias("b"))
    shared = F.transform("b", lambda x: x.withField("conf", F.greatest(x["conf"], F.array_max(F.transform("b", lambda y: F.when(align.same_meaning(x["word"], y["word"]), y["conf"]).otherwise(0.0))))))
    ranked = F.array_sort(F.filter("b", lambda x: x["agree"] > 0), lambda p, q: F.when(p["agree"] != q["agree"], q["agree"] - p["agree"]).otherwise(p["first_model"] - q["first_model"]).cast("int"))
    bins = bins.select("utt_id", "pos", shared.alias("b"), F.get(ranked, F.lit(0)).alias("top"), F.exists("b", lambda x: x["is_ref"] == 1).alias("has_ref"))
    over = F.col("has_ref") & (F.col("top.agree") >= threshold) & (F.col("top.is_ref") == 0)

    def settle(x: Column) -> Column:
        raised = F.when(x["word"] == F.col("top.word"), F.greatest(x["conf"], F.col("top.agree") / models)).when(x["is_ref"] == 1, x["conf"] * 0.5).otherwise(x["conf"])
        return x.withField("conf", F.when(F.coalesce(over, F.lit(False)), raised).otherwise(x["conf"]))

    bins = bins.select("utt_id", "pos", F.transform("b", settle).alias("b"))
    best = F.array_max(F.transform("b", lambda x: F.struct(x["conf"].alias("c"), x["is_ref"].alias("r"), (-x["first"]).alias("f"), x["word"])))["word"]
    return bins.select("utt_id", "pos", best.alias("best"), F.explode("b").alias("x")).select("utt_id", "pos", "x.word", "x.votes", F.col("x.conf").alias("confidence"), (F.col("x.word") == F.col("best")).alias("is_best"))


def lattice_wer(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """Adds standard_wer and lattice_wer to (utt_id, model_id, reference, prediction): a substitution is forgiven if the column has the word."""
    cols = bins.groupBy("utt_id", "pos").agg(F.max(F.when(F.col("is_best"), F.col("word"))).alias("best"), F.collect_set("word").alias("words"))
    flat = cols.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "best", "words"))).alias("l"))
    joined = pairs.join(flat, "utt_id", "left")
    hyp, ref = tokens(F.col("prediction")), tokens(F.col("reference"))
    cells = F.coalesce(F.col("l"), F.array().cast("array<struct<pos:int,best:string,words:array<string>>>"))
    joined = joined.withColumn("path", align.edit_paths(F.transform(cells, lambda c: c["best"]), hyp)).withColumn("ops", align.path_ops(F.col("path")))
    wrong = F.filter("ops", lambda o: (o["op"] != "M") & ~F.coalesce((o["op"] == "S") & F.array_contains(F.get(cells, o["i"])["words"], F.get(hyp, o["j"])), F.lit(False)))
    n = F.size(cells)
    return joined.select("utt_id", "model_id", align.wer(ref, hyp).alias("standard_wer"), F.when(n > 0, F.size(wrong) / n).otherwise(0.0).alias("lattice_wer"))


def model_summary(rates: DataFrame) -> DataFrame:
    """Means and the number of better, equal and worse utterances of each model."""
    s, t = F.col("standard_wer"), F.col("lattice_wer")
    return rates.groupBy("model_id").agg(
        F.round(F.avg(s), 9).alias("mean_standard"), F.round(F.avg(t), 9).alias("mean_lattice"), F.count_if(t < s).alias("improved"), F.count_if(t == s).alias("unchanged"), F.count_if(t > s).alias("worsened")
    )


def as_documents(bins: DataFrame) -> DataFrame:
    """(utt_id, bins): the lattice of each utterance, its columns in order and their words by confidence."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "word", "votes", "confidence", "is_best")))
    cols = bins.groupBy("utt_id", "pos").agg(F.transform(own, lambda x: x.dropFields("c")).alias("words"))
    return cols.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("bins"))

"""Utterances with five outputs each, derived from document numbers by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "एक दो तीन सौ हज़ार लाख इंटरव्यू ऑफिस कंप्यूटर मतलब हम्म और में है किताबें किताबे बार बार चौदह 14 पहली क्षमा वन बन hello नहीं।".split()
MODELS = 5


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, reference, model_1 ... model_5): a row for each document."""
    n, lex, d = len(WORDS), F.array(*map(F.lit, WORDS)), F.col("doc_id")
    places = F.sequence(F.lit(0).cast("bigint"), 5 + d % 7)
    word = lambda i: F.get(lex, (i % n).cast("int"))
    ref = F.array_join(F.transform(places, lambda p: word(31 * d + 17 * p)), " ")

    def model(k: int) -> Column:
        def one(p: Column) -> Column:
            own = F.when((d + 3 * p + k) % 7 == 0, word(31 * d + 17 * p + k)).otherwise(word(31 * d + 17 * p))
            return F.array(F.when((d + p + 5 * k) % 11 != 0, own), F.when((d + 2 * p + k) % 13 == 0, word(d + p + k)))

        return F.array_join(F.array_compact(F.flatten(F.transform(places, one))), " ")

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").where("doc_id is not null")
    return docs.select(d.alias("utt_id"), ref.alias("reference"), *[model(k).alias(f"model_{k}") for k in range(1, MODELS + 1)])


def sql() -> str:
    """The same relation as a DuckDB common table expression named utterances."""
    lex = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    n = len(WORDS)
    w = lambda e: f"lex[1 + ({e}) % {n}]"
    cols = [f"array_to_string(list_transform(range(0, 6 + doc_id % 7), lambda p: {w('31 * doc_id + 17 * p')}), ' ') as reference"]
    for k in range(1, MODELS + 1):
        own = f"case when (doc_id + 3 * p + {k}) % 7 = 0 then {w(f'31 * doc_id + 17 * p + {k}')} else {w('31 * doc_id + 17 * p')} end"
        both = f"[case when (doc_id + p + {5 * k}) % 11 <> 0 then {own} end, case when (doc_id + 2 * p + {k}) % 13 = 0 then {w(f'doc_id + p + {k}')} end]"
        cols.append(f"array_to_string(list_filter(flatten(list_transform(range(0, 6 + doc_id % 7), lambda p: {both})), lambda x: x is not null), ' ') as model_{k}")
    return f"lexicon as (select {lex} as lex), utterances as (select doc_id as utt_id, {', '.join(cols)} from documents, lexicon where doc_id is not null)"

"""Readers and writers of transcript files, by Spark's own formats."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import SPACE

MANIFEST = "user_id string, recording_id string, duration double, rec_url_gcp string, transcription_url string, metadata_url string"
SEGMENTS = "start double, end double, text string"
TRANSCRIPTS = "transcript string, text string, transcription string"
PAIR = "reference string, prediction string, wer double"
SAMPLED = PAIR + ", severity string"
CLASSES = "words array<struct<word:string,classification:string,confidence:string,reason:string>>"
MODELS = "reference string, model_1 string, model_2 string, model_3 string, model_4 string, model_5 string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with a header."""
    return spark.read.schema(MANIFEST).csv(path, header=True)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of segments for each file; recording_id is the file's leading number, a missing start or end is 0."""
    rows = spark.read.schema(SEGMENTS).json(path, multiLine=True)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("start", "end")})
    return rows.withColumn("recording_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^_.]+)", 1))


def transcripts(spark: SparkSession, path: str, order: tuple[str, ...] = ("transcript", "text")) -> DataFrame:
    """(pos, text) of a JSON array of transcripts: the first key of ``order`` that is there, null if it is so there; else empty."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("pos", "m"))
    out = F.lit("")
    for key in reversed(order):
        out = F.when(F.map_contains_key("m", key), F.try_element_at("m", F.lit(key))).otherwise(out)
    return rows.select("pos", out.alias("text"))


def _trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def word_list(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """Words of a text file without blanks, or the first column of a CSV, whose first row is a word as well."""
    if csv:
        return spark.read.csv(path, header=False).select(_trim(F.coalesce("_c0", F.lit(""))).alias("word"))
    return spark.read.text(path).select(_trim(F.col("value")).alias("word")).where("word <> ''")


def ordered_distinct(words: DataFrame, pos: str = "pos") -> DataFrame:
    """Each word once, at its first place."""
    return words.groupBy("word").agg(F.min(pos).alias(pos))


def word_freq(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of counts as (word, freq); no rows if there is no such file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "word string, freq bigint")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "freq"))


def model_outputs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of a reference and five outputs; a missing one is empty."""
    rows = spark.read.schema(MODELS).json(path, multiLine=True)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def evaluation_results(spark: SparkSession, path: str, model: str = "finetuned") -> DataFrame:
    """(pos, reference, prediction, wer) of one model of an evaluation."""
    rows = spark.read.schema(f"{model} struct<overall_wer:double,per_utterance:array<struct<reference:string,prediction:string,wer:double>>>").json(path, multiLine=True)
    return rows.select(F.posexplode(F.col(f"{model}.per_utterance")).alias("pos", "u")).select("pos", "u.*")


def sampled_errors(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of errors; a missing severity is unknown."""
    return spark.read.schema(SAMPLED).json(path, multiLine=True).withColumn("severity", F.coalesce("severity", F.lit("unknown")))


def classification_results(spark: SparkSession, path: str) -> DataFrame:
    """(pos, word, classification, confidence, reason) of a document of classified words."""
    rows = spark.read.schema(CLASSES).json(path, multiLine=True)
    return rows.select(F.posexplode("words").alias("pos", "w")).select("pos", "w.*")


def dataset_or(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> DataFrame:
    """A stored dataset, or the given rows where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if found else spark.createDataFrame(rows, schema)


def not_yet_there(wanted: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """Rows of a manifest whose file is not listed: what is left to fetch."""
    return wanted.join(listed.select(key).distinct(), key, "left_anti")


def fetch_status(wanted: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """A manifest with the path of each file that is listed, null for others."""
    return wanted.join(listed.select(key, F.col("path").alias("local_path")).dropDuplicates([key]), key, "left")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of audio files, by their case-sensitive ending."""
    return spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"\.(wav|mp3|flac|ogg)$")).select("path", "length").orderBy("path")


def repair_url(url: Column, base: str) -> Column:
    """A recording's URL rebuilt under ``base`` from its numbers; others and null as they are."""
    pattern = r"(\d+)/(\d+)_(transcription|recording|metadata)"
    kind = F.regexp_extract(url, pattern, 3)
    ending = F.when(kind == "recording", ".wav").otherwise(".json")
    built = F.concat(F.lit(base + "/"), F.regexp_extract(url, pattern, 1), F.lit("/"), F.regexp_extract(url, pattern, 2), F.lit("_"), kind, ending)
    return F.when(url.startswith(base), url).when(url.rlike(pattern), built).otherwise(url)


def recording_url(user: Column, recording: Column, kind: str, base: str) -> Column:
    """The URL of a recording's file; always .json."""
    return F.concat(F.lit(base + "/"), user, F.lit("/"), recording, F.lit(f"_{kind}.json"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_document(rows: DataFrame, path: str, limit: int = 100_000) -> None:
    """A report's rows as one indented JSON array; more than ``limit`` rows are an error, for those belong in a table."""
    found = [r.asDict(recursive=True) for r in rows.limit(limit + 1).collect()]  # limit + 1 rows at most
    if len(found) > limit:
        raise ValueError(f"over {limit} rows; use write_json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False, indent=2)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def write_dataset(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet, a folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)

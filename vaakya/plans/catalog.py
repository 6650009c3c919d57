"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import align, classify, text
from ..functions.tokens import let, strip, tokens
from ..operators import lattice, transcripts
from ..sources import files
from . import oracles
from .utterances import WORDS, utterances
from .utterances import sql as utterances_sql

TOP = 50
_PUNCT = text._PUNCT
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_P = _PUNCT.replace("'", "''")
_TOK = f"list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda t: t <> '')"
_CORE = f"trim(t, '{_P}')"
_ROMAN = "^[a-zA-Z]{2,}([^\\pL\\pN_]|$)"


def _roman_words(df: DataFrame, *keep: str) -> DataFrame:
    each = df.select(*keep, F.explode(tokens(F.col("text"))).alias("t")).withColumn("word", strip(F.col("t"), _PUNCT))
    return each.where(text.roman(F.col("word")))


@_query(f"""select word, count(*) as freq from (select {_CORE} as word from (select unnest({_TOK}) as t from documents)) where regexp_matches(word, '{_ROMAN}')
group by word order by freq desc, word limit {TOP}""")
def roman_vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent Roman words: a top-k report."""
    return _roman_words(_read(spark, sf_dir, "documents")).groupBy("word").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "word").limit(TOP)


@_query(f"""select lang, count(*) as transcripts, cast(sum(n) as bigint) as total_words, cast(sum(e) as bigint) as english_count, round(100.0 * sum(e) / greatest(sum(n), 1), 6) as english_pct,
round(avg(e / greatest(n, 1)), 9) as mean_ratio from (select lang, len(w) as n, len(list_filter(w, lambda t: regexp_matches({_CORE}, '{_ROMAN}'))) as e from (select lang, {_TOK} as w from documents)) group by lang""")
def roman_ratio_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and shares of Roman words by language."""
    w = tokens(F.col("text"))
    rows = _read(spark, sf_dir, "documents").select("lang", F.size(w).cast("bigint").alias("n"), F.size(F.filter(w, lambda t: text.roman(strip(t, _PUNCT)))).cast("bigint").alias("e"))
    return rows.groupBy("lang").agg(
        F.count("*").alias("transcripts"), F.sum("n").alias("total_words"), F.sum("e").alias("english_count"), F.round(100.0 * F.sum("e") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("english_pct"), F.round(F.avg(F.col("e") / F.greatest(F.col("n"), F.lit(1))), 9).alias("mean_ratio")
    )


@_query(f"""select conv_id, turn, array_to_string(list_transform({_TOK}, lambda t: case when regexp_matches({_CORE}, '{_ROMAN}')
then substr(t, 1, instr(t, {_CORE}) - 1) || '[EN]' || {_CORE} || '[/EN]' || substr(t, instr(t, {_CORE}) + length({_CORE})) else t end), ' ') as tagged from conversations""")
def tag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its Roman words tagged; white space is made uniform."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rows.select("conv_id", "turn", text.tag_english(F.array_join(tokens(F.col("text")), " "), "roman").alias("tagged"))


@_query("""select doc_id, trim(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(replace(translate(nfc_normalize(text), chr(8203) || chr(8204) || chr(8205), ''), '|', '।'), '\\.{2,}', '।', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'), ' ।,.'),
'मैने', 'मैंने'), 'हुऐ', 'हुए'), 'गयी', 'गई'), 'गया', 'गया'), 'मे', 'में')) as normalized from documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, normalised."""
    return _read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@_query(f"""select doc_id, len(w) as n_words, len(list_filter(w, lambda t, i: i = 1 or t <> w[i - 1])) as n_kept,
md5(case when len(w) <= 1 then text else array_to_string(list_filter(w, lambda t, i: i = 1 or t <> w[i - 1]), ' ') end) as kept_md5 from (select doc_id, text, {_TOK} as w from documents)""")
def repetition_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without adjacent repetitions."""
    w = tokens(F.col("text"))
    kept = let(w, lambda x: F.filter(x, lambda t, i: (i == 0) | (t != F.get(x, F.greatest(i - 1, F.lit(0))))))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.size(kept).cast("bigint").alias("n_kept"), F.md5(text.suppress_repetitions(F.col("text"), ()).cast("binary")).alias("kept_md5"))


@_query()
def repetition_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns and utterances without repeated words, pairs and triples."""
    turns = _read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    outputs = transcripts.unpivot_models(utterances(spark, sf_dir)).select(F.concat_ws("-", "utt_id", "model_id").alias("id"), F.col("prediction").alias("text"))
    return turns.union(outputs).select("id", text.suppress_repetitions(F.col("text")).alias("fixed"))


@_query()
def repetition_ngrams_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated words, pairs and triples; ``repetition_suppress`` drops words only."""
    return _read(spark, sf_dir, "documents").select("doc_id", text.suppress_repetitions(F.col("text")).alias("fixed"))


_LEX = "'" + "', '".join(dict.fromkeys(WORDS)) + "'"
_CODE = lambda t: f"array_to_string(list_transform(string_split({t}, ' '), lambda w: chr(cast(48 + list_position([{_LEX}], w) as int))), '')"
_PAIRS = f"with {utterances_sql()}, pairs as (" + " union all ".join(f"select utt_id, 'model_{k}' as model_id, reference, model_{k} as prediction from utterances" for k in range(1, 6)) + (
    f"), wp as (select utt_id, model_id, reference, prediction, cast(case when prediction = '' then len(string_split(reference, ' ')) else levenshtein({_CODE('reference')}, {_CODE('prediction')}) end as bigint) as edits, len(string_split(reference, ' ')) as ref_words from pairs), "
    "rates as (select *, edits / ref_words as wer from wp) "
)


@_query(f"with {utterances_sql()} select * from utterances")
def utterance_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived utterances."""
    return utterances(spark, sf_dir)


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.wer_pairs(transcripts.unpivot_models(utterances(spark, sf_dir)))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.errors(transcripts.unpivot_models(utterances(spark, sf_dir)))


@_query(_PAIRS + "select utt_id, model_id, edits, ref_words, round(wer, 9) as wer from rates")
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of each output."""
    return _rates(spark, sf_dir).select("utt_id", "model_id", "edits", "ref_words", F.round("wer", 9).alias("wer"))


@_query(_PAIRS + "select model_id, count(*) as utterances, cast(sum(edits) as bigint) as edits, cast(sum(ref_words) as bigint) as ref_words, round(sum(edits) / sum(ref_words), 9) as corpus_wer from rates group by model_id")
def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled error rate of each model."""
    return transcripts.corpus_wer(_rates(spark, sf_dir), "model_id")


@_query(_PAIRS + "select case when wer <= 0.33 then 'low' when wer <= 0.66 then 'medium' else 'high' end as severity, count(*) as errors from rates where wer > 0 group by 1")
def severity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by severity."""
    return _rates(spark, sf_dir).where("wer > 0").groupBy(classify.severity(F.col("wer")).alias("severity")).agg(F.count("*").alias("errors"))


@_query(_PAIRS + """, e as (select *, case when wer <= 0.33 then 'low' when wer <= 0.66 then 'medium' else 'high' end as severity from rates where wer > 0),
r as (select *, row_number() over (partition by severity order by wer, utt_id, model_id) - 1 as i, greatest(1, count(*) over (partition by severity) // 8) as step from e),
f as (select *, row_number() over (order by case severity when 'low' then 0 when 'medium' then 1 else 2 end, wer, utt_id, model_id) as place from r where i % step = 0),
taken as (select count(*) as t from f where place <= 30),
every as (select *, row_number() over (order by wer, utt_id, model_id) - 1 as i, count(*) over () as n from rates where wer > 0),
more as (select *, greatest(1, n // (25 - t)) as step from every, taken where t < 25),
refill as (select utt_id, model_id, wer, 'medium' as severity, t + i // step + 1 as place from more where i % step = 0)
select utt_id, model_id, round(wer, 9) as wer, severity, place from (select utt_id, model_id, wer, severity, place from f where place <= 30 union all select * from refill) where place <= 25""")
def severity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified sample of errors."""
    return transcripts.sample_errors(_rates(spark, sf_dir)).select("utt_id", "model_id", F.round("wer", 9).alias("wer"), "severity", "place")


@_query()
def edit_ops_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, substitutions, deletions and insertions of each output."""
    rows = transcripts.unpivot_models(utterances(spark, sf_dir))
    path = align.edit_paths(tokens(F.col("reference")), tokens(F.col("prediction")))
    count = lambda c: F.length(F.regexp_replace("path", f"[^{c}]", "")).cast("bigint")
    return rows.select("utt_id", "model_id", path.alias("path")).select("utt_id", "model_id", "path", *[count(c).alias(f"n_{c.lower()}") for c in "MSDI"])


@_query()
def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each output's errors."""
    rows = transcripts.unpivot_models(utterances(spark, sf_dir))
    return rows.select("utt_id", "model_id", F.array_join(classify.error_labels(F.col("reference"), F.col("prediction")), "|").alias("labels"))


@_query()
def taxonomy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent labels with examples: a top-k report."""
    top = transcripts.error_taxonomy(_errors(spark, sf_dir)).orderBy(F.desc("errors"), "category").limit(3)
    return top.withColumn("examples", F.array_join("examples", "|"))


@_query()
def fix_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is proposed for the three most frequent labels: a top-k report."""
    return transcripts.propose_fixes(transcripts.error_taxonomy(_errors(spark, sf_dir))).withColumn("examples", F.array_join("examples", "|"))


@_query()
def confusion_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with unknown words replaced by their most frequent variant."""
    freq = F.create_map(*[x for i, w in enumerate(dict.fromkeys(WORDS)) for x in (F.lit(w), F.lit(i + 1).cast("bigint"))])
    rows = transcripts.unpivot_models(utterances(spark, sf_dir))
    return rows.select(F.concat_ws("-", "utt_id", "model_id").alias("id"), text.resolve_confusions(F.col("prediction"), freq).alias("resolved"))


@_query()
def number_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with numbers as digits."""
    return utterances(spark, sf_dir).select("utt_id", text.normalize_numbers(F.col("reference")).alias("normalized"))


@_query()
def loan_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan and Roman words of the references."""
    rows = utterances(spark, sf_dir).select("utt_id", F.explode(text.detect_english(F.col("reference"))).alias("d"))
    return rows.select("utt_id", "d.word", "d.english_equivalent", "d.method", "d.position")


@_query()
def cleanup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the cleaned references."""
    rows = utterances(spark, sf_dir).select("utt_id", text.cleanup(F.col("reference")).alias("c"))
    words = F.flatten(F.transform("c.steps", lambda s: F.coalesce(s["english_words"], F.array().cast("array<string>"))))
    rows = rows.select("utt_id", (F.col("c.original") != F.col("c.cleaned")).alias("is_changed"), F.col("c.num_changes").alias("n"), words.alias("w"))
    per = rows.agg(F.count("*").alias("transcripts"), F.count_if(F.col("n") > 0).alias("logged"), F.count_if("is_changed").alias("changed"), F.sum(F.size("w")).alias("english_words"))
    unique = rows.select(F.explode("w").alias("x")).agg(F.count_distinct("x").alias("unique_english"))
    return per.join(F.broadcast(unique), F.lit(True))


@_query()
def fix_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs improved, unchanged and degraded by the repairs, by model."""
    rows = transcripts.unpivot_models(utterances(spark, sf_dir))
    freq = F.create_map(*[x for i, w in enumerate(dict.fromkeys(WORDS)) for x in (F.lit(w), F.lit(i + 1).cast("bigint"))])
    return transcripts.repair_effects(rows, freq)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transcripts.word_counts(_read(spark, sf_dir, "conversations"))
    counts = counts.unionByName(transcripts.word_counts(utterances(spark, sf_dir), "reference")).groupBy("word").agg(F.sum("freq").alias("freq"))
    both = counts.join(F.broadcast(counts.agg(F.sum("freq").alias("total"))), F.lit(True))
    c = classify.classify_word(F.col("word"), F.col("freq"), F.col("total"))
    return both.select("word", F.xxhash64("word").alias("pos"), c.alias("c")).select("word", "pos", "c.*")


@_query()
def spell_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of turns and references, classified."""
    return _classified(spark, sf_dir).drop("pos")


@_query()
def spell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by class and confidence."""
    return _classified(spark, sf_dir).groupBy("classification", "confidence").agg(F.count("*").alias("words"))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "conversations").select(F.explode(tokens(F.col("text"))).alias("t")).select(F.regexp_replace("t", "[A-Za-z]+", "कख").alias("word"))
    c = classify.classify_word(F.col("word"))
    rows = words.distinct().select("word", F.md5(F.col("word").cast("binary")).alias("pos"), c.alias("c")).select("word", "pos", "c.*")
    return transcripts.review_low_confidence(rows)


@_query()
def low_conf_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A systematic sample of words that nothing decides, reviewed."""
    return _reviewed(spark, sf_dir).drop("pos")


@_query()
def unreliable_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the review on which verdicts cannot be relied."""
    return transcripts.unreliable_categories(_reviewed(spark, sf_dir)).withColumn("examples", F.array_join("examples", "|"))


@_query()
def align_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs by column of the reference."""
    return lattice.align_matrix(utterances(spark, sf_dir))


@_query()
def lattice_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voting lattice of every utterance."""
    return lattice.lattice_bins(lattice.align_matrix(utterances(spark, sf_dir)))


@_query()
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard and lattice error rates by model."""
    u = utterances(spark, sf_dir)
    return lattice.model_summary(lattice.lattice_wer(transcripts.unpivot_models(u), lattice.lattice_bins(lattice.align_matrix(u))))


@_query()
def lattice_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard and lattice error rate of each output."""
    u = utterances(spark, sf_dir)
    rates = lattice.lattice_wer(transcripts.unpivot_models(u), lattice.lattice_bins(lattice.align_matrix(u)))
    return rates.select("utt_id", "model_id", F.round("standard_wer", 9).alias("standard_wer"), F.round("lattice_wer", 9).alias("lattice_wer"))


@_query()
def phonetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that share a column, with how alike they sound and whether they mean the same."""
    m = lattice.align_matrix(utterances(spark, sf_dir)).where("word is not null").select("utt_id", "pos", "word").distinct()
    pairs = m.alias("a").join(m.alias("b"), ["utt_id", "pos"]).where("a.word < b.word")
    pairs = pairs.groupBy(F.col("a.word").alias("word_a"), F.col("b.word").alias("word_b")).agg(F.count("*").alias("columns"))
    return pairs.withColumn("similarity", F.round(align.phonetic_similarity(F.col("word_a"), F.col("word_b")), 6)).withColumn("same_meaning", align.same_meaning(F.col("word_a"), F.col("word_b")))


_BASE = "https://store.example.org"


@_query(f"""select page_id, case when starts_with(u, '{_BASE}') then u when regexp_matches(u, '(\\d+)/(\\d+)_(transcription|recording|metadata)') then '{_BASE}/' || regexp_extract(u, '(\\d+)/(\\d+)_(transcription|recording|metadata)', 1) || '/' ||
regexp_extract(u, '(\\d+)/(\\d+)_(transcription|recording|metadata)', 2) || '_' || regexp_extract(u, '(\\d+)/(\\d+)_(transcription|recording|metadata)', 3) || case when regexp_extract(u, '(\\d+)/(\\d+)_(transcription|recording|metadata)', 3) = 'recording' then '.wav' else '.json' end else u end as url
from (select page_id, case when page_id % 2 = 0 then 'http://old/' || page_id || '/' || page_id || '_recording.x' else url end as u from pages)""")
def url_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, half of them made into recordings', repaired."""
    old = F.concat(F.lit("http://old/"), F.col("page_id"), F.lit("/"), F.col("page_id"), F.lit("_recording.x"))
    return _read(spark, sf_dir, "pages").select("page_id", files.repair_url(F.when(F.col("page_id") % 2 == 0, old).otherwise(F.col("url")), _BASE).alias("url"))


_SEG = """with s as (select doc_id as recording_id, doc_id % 5 as user_id, text, (doc_id % 10) / 4.0 as a, (doc_id % 10) / 4.0 + least(greatest(1, length(text) / 12.0), 40) - 0.75 as b, 16000 * 30 as n from documents),
v as (select *, greatest(0, cast(trunc(a * 16000) as bigint)) as f, least(n, cast(trunc(b * 16000) as bigint)) as l from s where trim(text) <> '' and b > a),
ok as (select *, (l - f) / 16000 as duration from v where l > f and (l - f) / 16000 between 0.5 and 30) """


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, start = F.col("doc_id"), (F.col("doc_id") % 10) / 4.0
    rows = _read(spark, sf_dir, "documents").select(
        d.alias("recording_id"), (d % 5).alias("user_id"), "text", start.alias("start"), (start + F.least(F.greatest(F.lit(1.0), F.length("text") / 12.0), F.lit(40.0)) - 0.75).alias("end"), F.lit(16000 * 30).cast("bigint").alias("n_samples")
    )
    return transcripts.valid_segments(rows)


@_query(_SEG + "select recording_id, f as first_sample, l as last_sample, round(duration, 6) as duration from ok")
def segments_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid segments of the documents read as recordings."""
    return _segments(spark, sf_dir).select("recording_id", "first_sample", "last_sample", F.round("duration", 6).alias("duration"))


@_query(_SEG + "select count(*) as segments, round(sum(duration) / 3600, 6) as hours, round(avg(duration), 6) as mean_duration, count(distinct user_id) as speakers, count(distinct recording_id) as recordings from ok")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the valid segments."""
    return transcripts.dataset_stats(_segments(spark, sf_dir))


@_query("select doc_id, case when (doc_id * 2654435761) % 1000 < 100 then 'test' else 'train' end as split from documents")
def split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents for test, by an integer rule."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.when((F.col("doc_id") * 2654435761) % 1000 < 100, "test").otherwise("train").alias("split"))


def queries() -> dict[str, Callable]:
    """Name -> f(spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows."""
    return _SQL | oracles.SQL

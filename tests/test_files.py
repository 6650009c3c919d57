"""Readers, writers, reports and commands on small files; demos whose results are known by hand."""

import json

import pytest
from pyspark.sql import functions as F

from vaakya.__main__ import COMMANDS, main
from vaakya.functions import text
from vaakya.operators import lattice, reports, transcripts
from vaakya.sources import files
from vaakya.streaming import cleanup as stream


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    m = put(tmp_path / "m.csv", "user_id,recording_id,duration,rec_url_gcp,transcription_url,metadata_url\nu,r,1.5,a,b,c\n")
    assert files.manifest(spark, m).first().duration == 1.5
    s = put(tmp_path / "77_transcription.json", [{"end": 2.0, "text": "\t\n"}, {"start": 1.0, "end": 3.0, "text": "\tक \u00a0"}, {"text": "x"}])
    rows = files.segments(spark, s).collect()
    assert [(r.start, r.end, r.recording_id) for r in rows] == [(0.0, 2.0, "77"), (1.0, 3.0, "77"), (0.0, 0.0, "77")]
    valid = transcripts.valid_segments(files.segments(spark, s).withColumn("n_samples", F.lit(16000 * 9).cast("long")))
    assert [(r.text, r.duration) for r in valid.collect()] == [("क", 2.0)]
    t = put(tmp_path / "t.json", [{"transcript": "a", "text": "b"}, {"text": "b"}, {"transcript": None, "text": "b"}, {}])
    assert [r.text for r in files.transcripts(spark, t).orderBy("pos").collect()] == ["a", "b", None, ""]
    w = put(tmp_path / "w.txt", "\tएक \n\n \u2003\nदो\u00a0\n")
    assert [r.word for r in files.word_list(spark, w).collect()] == ["एक", "दो"]
    c = put(tmp_path / "w.csv", "word,n\n एक\t,1\n")
    assert [r.word for r in files.word_list(spark, c, True).collect()] == ["word", "एक"]
    assert {tuple(r) for r in files.word_freq(spark, put(tmp_path / "f.json", {"a": 3, "b": 1})).collect()} == {("a", 3), ("b", 1)}
    assert files.word_freq(spark, str(tmp_path / "none.json")).count() == 0
    o = put(tmp_path / "o.json", [{"reference": "a", "model_1": "b"}])
    assert tuple(files.model_outputs(spark, o).first()) == ("a", "b", "", "", "", "")
    e = put(tmp_path / "e.json", {"baseline": {"overall_wer": 1.0, "per_utterance": [{"reference": "a b", "prediction": "a", "wer": 0.5}]}, "finetuned": {"overall_wer": 0.0, "per_utterance": []}})
    assert [tuple(r) for r in files.evaluation_results(spark, e, "baseline").collect()] == [(0, "a b", "a", 0.5)] and files.evaluation_results(spark, e).count() == 0
    assert files.sampled_errors(spark, put(tmp_path / "s.json", [{"reference": "a", "prediction": "b", "wer": 1.0}])).first().severity == "unknown"
    k = put(tmp_path / "k.json", {"stats": {}, "words": [{"word": "a", "classification": "correct", "confidence": "low", "reason": "r"}]})
    assert tuple(files.classification_results(spark, k).first()) == (0, "a", "correct", "low", "r")
    (tmp_path / "a").mkdir()
    for n in ("x.wav", "y.WAV", "z.txt", "q.mp3"):
        put(tmp_path / "a" / n, "abc")
    assert [r.path.rsplit("/", 1)[1] for r in files.audio_files(spark, str(tmp_path / "a")).collect()] == ["q.mp3", "x.wav"]
    assert files.dataset_or(spark, str(tmp_path / "no"), [("a",)], "text string").first().text == "a"


def test_listing_and_positions(spark):
    want = spark.createDataFrame([("a",), ("b",)], "name string")
    have = spark.createDataFrame([("a", "/p/a"), ("a", "/p/a")], "name string, path string")
    assert [r.name for r in files.not_yet_there(want, have).collect()] == ["b"]
    assert {tuple(r) for r in files.fetch_status(want, have).collect()} == {("a", "/p/a"), ("b", None)}
    left, right = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pos int, t string"), spark.createDataFrame([(0, "X"), (1, "Y")], "pos int, r string")
    assert transcripts.by_position(left, right).count() == 2
    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "recording_id int, start int").repartition(5)
    got = transcripts.number_segments(rows, "recording_id", "start").orderBy("segment_id").collect()
    assert [r.segment_id for r in got] == [f"seg_{i:06d}" for i in range(100)] and [(r.recording_id, r.start) for r in got] == sorted((r.recording_id, r.start) for r in got)
    assert files.ordered_distinct(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "word string, pos int")).orderBy("pos").first().pos == 1


def test_small_operators(spark):
    t = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t"))).first()[0]
    assert t(transcripts.excerpt, "x" * 51) == "x" * 50 + "..." and t(transcripts.excerpt, "x" * 50) == "x" * 50
    assert t(text.strip_tags, "a [EN]b[/EN]") == "a b" and t(text.clean_text, "क\u200d  ख\n") == "क ख"
    assert transcripts.spelling_label(spark.createDataFrame([("a", "correct"), ("b", "incorrect")], "word string, classification string")).orderBy("word").first().label == "correct spelling"
    assert transcripts.metrics(spark.createDataFrame([(1, 4), (1, 4)], "edits long, ref_words long")).first().wer == 25.0
    errors = transcripts.with_errors(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", "x")], "name string, text string"))
    assert [r.error for r in errors.orderBy("name").collect()] == [None, "no transcript for b"]
    assert transcripts.with_both_files(spark.createDataFrame([("a", None), ("a", "b")], "x string, y string"), "x", "y").count() == 1
    made = transcripts.synthetic_corpus(spark.createDataFrame([(6, "x" * 30), (7, "x"), (8, "x" * 99)], "pos int, text string")).collect()
    assert [(r.recording_id, r.user_id, r.duration) for r in made] == [("synthetic_0006", 1, 2.5), ("synthetic_0007", 2, 1.0), ("synthetic_0008", 3, 5.0)]


def test_resolve_by_join_is_the_same(spark):
    words = {"वन": 5, "बस": 2, "शाम": 9}
    rows = spark.createDataFrame([(1, "बन वस साम xyz"), (2, ""), (3, None), (4, "वन वन")], "id int, text string")
    freq = F.create_map(*[x for w, n in words.items() for x in (F.lit(w), F.lit(n).cast("bigint"))])
    want = {r.id: r.t or "" for r in rows.select("id", text.resolve_confusions(F.col("text"), freq).alias("t")).collect()}
    got = {r.id: r.resolved for r in text.resolve_by_join(rows, spark.createDataFrame(list(words.items()), "word string, freq long"), "id").collect()}
    assert got == want and got[1].startswith("वन बस शाम")


def test_english_demo_methods(spark):
    rows = spark.createDataFrame([("मेरा इंटरव्यू पहली hello",)], "t string").select(F.explode(text.detect_english(F.col("t"))).alias("d")).select("d.*")
    assert transcripts.methods(rows).first().methods == ["dictionary", "roman_script", "suffix_pattern"]


def test_lattice_demo_rates(spark):
    """The published rates of five outputs: 0, 0.5, 0.25, 0.25, 0.25 as they stand, none against the lattice."""
    u = spark.createDataFrame([(1, "उसने चौदह किताबें खरीदीं", "उसने चौदह किताबें खरीदीं", "उसने 14 किताबे खरीदीं", "उसने 14 किताबें खरीदीं", "उसने चौदह किताबे खरीदीं", "उसने चौदह किताबें खरीदी")], "utt_id long, reference string, model_1 string, model_2 string, model_3 string, model_4 string, model_5 string")
    rates = lattice.lattice_wer(transcripts.unpivot_models(u), lattice.lattice_bins(lattice.align_matrix(u))).orderBy("model_id").collect()
    assert [r.standard_wer for r in rates] == [0, 0.5, 0.25, 0.25, 0.25] and [r.lattice_wer for r in rates] == [0] * 5


def test_commands(spark, tmp_path):
    pairs = [{"reference": "एक दो hello", "prediction": p, "wer": 0.5} for p in ("एक दो", "एक दो दो hello", "एक दो hello")]
    given = {
        "preprocess": put(tmp_path / "5_transcription.json", [{"start": 0.0, "end": 2.0, "text": "क"}]),
        "create-synthetic": put(tmp_path / "a.json", [{"text": "एक"}]),
        "evaluate": put(tmp_path / "b.json", {m: {"overall_wer": 0.1, "per_utterance": pairs} for m in ("baseline", "finetuned")}),
        "fix": put(tmp_path / "c.json", pairs),
        "numbers": put(tmp_path / "d.json", [{"transcript": "तीन सौ लोग इंटरव्यू"}]),
        "spelling": put(tmp_path / "e.txt", "और\nकमलदल\n"),
        "analysis": put(tmp_path / "f.json", {"words": [{"word": f"w{i}-x", "classification": "incorrect", "confidence": "low", "reason": "r"} for i in range(5)]}),
        "lattice": put(tmp_path / "g.json", [{"reference": "a b", **{f"model_{k}": "a b" for k in range(1, 6)}}]),
    }
    given |= {"error-analysis": given["evaluate"], "english": given["numbers"], "cleanup": given["numbers"]}
    assert set(given) == set(COMMANDS)
    for name, path in given.items():
        main([name, path, str(tmp_path / "out" / name)])
    read = lambda *p: (tmp_path / "out").joinpath(*p).read_text(encoding="utf-8")
    assert "| baseline | 22.2" in read("evaluate", "wer.md") and "repetition_error" in read("error-analysis", "errors.md")
    assert "300 लोग" in read("cleanup", "cleanup.md") and "Unreliable categories" in read("analysis", "spelling.md") and "model_5" in read("lattice", "lattice.md")
    assert spark.read.json(str(tmp_path / "out" / "preprocess" / "segments")).first().segment_id == "seg_000000"


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "क", "train"), (2, "ख", "test")], "id int, t string, split string")
    files.write_document(rows.orderBy("id"), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text(encoding="utf-8"))[1] == {"id": 2, "t": "ख", "split": "test"}
    with pytest.raises(ValueError):
        files.write_document(rows, str(tmp_path / "d.json"), 1)
    files.write_csv(rows, str(tmp_path / "c"))
    files.write_dataset(rows, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2 and spark.read.parquet(str(tmp_path / "p")).where("split = 'test'").first().t == "ख"
    assert "| id |" in reports.table(rows)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("तीन सौ लोग",), ("x",)], "text string").write.parquet(str(tmp_path / "in"))
    q = stream.cleanup_stream(stream.read_stream(spark, str(tmp_path / "in"), "text string")).writeStream.format("memory").queryName("cleaned_stream").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert {r.cleaned for r in spark.sql("select * from cleaned_stream").collect()} == {"300 लोग", "x"}

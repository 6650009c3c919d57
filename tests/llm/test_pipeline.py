"""Each stage of the pipeline against brute force on its own input, and edge rows through all of them."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from vaakya.llm import quality, tokens

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """The input of each stage and the result of the last, as the driver stores them."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{base}/{i}")
        docs = spark.read.parquet(f"file://{base}/{i}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay(chain):
    assert all(df.columns == chain[0].columns for df in chain[:-1])
    for df in chain[1:-1]:
        assert df.where("n_chars <> length(text)").count() == 0


def test_quality_stage(spark, chain):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(chain[0], labels)
    kept = set(texts(chain[1]))
    for doc, text in texts(chain[0]).items():
        places = quality.Features().of([text])[0]
        score = sum(float(model.weights[p]) for p in places)
        assert (doc in kept) == (1 / (1 + np.exp(model.thresholds[-1] - score)) >= quality.KEEP)
    known = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    right = [(doc in kept) == good for doc, good in known.items() if doc in texts(chain[0])]
    assert np.mean(right) > 0.9


def test_near_dedup_stage(chain):
    def shingles(text):
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
        k = min(5, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()

    sets = {doc: shingles(t) for doc, t in texts(chain[1]).items()}
    root = {doc: doc for doc in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(texts(chain[2])) == {i for i in ids if find(i) == i}


def test_suffix_stage(chain):
    data = {doc: (t or "").encode() for doc, t in texts(chain[2]).items()}
    first, many = {}, set()
    for doc, b in data.items():
        for i in range(len(b) - 199):
            w = b[i : i + 200]
            if first.setdefault(w, (doc, i)) != (doc, i):
                many.add(w)
    got = texts(chain[3])
    assert got.keys() == data.keys()
    for doc, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        gone[-1] = True
        for i in range(len(b) - 199):
            if b[i : i + 200] in many:
                gone[i : i + 200] = True
        parts, start = [], 0
        for i in np.flatnonzero(gone).tolist():
            parts.append(b[start:i])
            start = i + 1
        assert got[doc] == "".join(p.decode("utf-8", "ignore") for p in parts)


def test_decontamination_stage(spark, chain):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))

    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(10, len(w))
        grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    sizes = {len(g) for g in grams}
    clean = set()
    for doc, t in texts(chain[3]).items():
        w = words(t)
        if not any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1)):
            clean.add(doc)
    assert set(texts(chain[4])) == clean


def test_packing_stage(chain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocab_path())
    rows = chain[5].toPandas()
    want = {doc: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for doc, t in texts(chain[4]).items()}
    assert set(rows.doc_id) == set(want)
    for doc, own in rows.groupby("doc_id"):
        ids, own = np.array(want[doc], "<u4"), own.sort_values("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_one_copy_of_repeated_rows_keeps_its_text(spark, tmp_path):
    """Rows that repeat a doc_id or have none, through near-dedup and suffix dedup."""
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in ("ab", "cd", "ef", "gh")]
    rows = [(7, long[0]), (7, long[0]), (None, long[1]), (None, long[1]), (None, long[2]), (9, long[2]), (8, long[2]), (5, long[3]), (5, "a text of its own"), (6, ""), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/in")
    near = STAGE["minhash near-dedup"](spark, spark.read.parquet(f"file://{tmp_path}/in"), SF)
    near.write.parquet(f"file://{tmp_path}/near")
    cut = STAGE["suffix-array dedup"](spark, spark.read.parquet(f"file://{tmp_path}/near"), SF)
    want = [(7, long[0]), (None, long[1]), (8, long[2]), (5, long[3]), (5, "a text of its own"), (6, "")]
    have = sorted((str(r.doc_id), r.text or "") for r in cut.collect())
    assert have == sorted([(str(i), t) for i, t in want] + [("None", "")])


def test_edge_rows_pass_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, an empty table, and names that the operators use themselves."""
    extra = "_id long, _grade int, _gone long, _t string, n_bytes long, kept boolean, component_id long, rep long, part int, row long, item_id long, n_chars long, sig binary"
    names = [x.split()[0] for x in extra.split(", ")]
    base = [(1, None), (2, ""), (None, "some plain words here"), (3, "one two three"), (3, "one two three"), (4, "long text here " * 4000), (5, " ")]
    rows = spark.createDataFrame([(*r, *[None] * len(names)) for r in base], f"doc_id long, text string, {extra}")
    for name, stage in corpus_pipeline.STAGES:
        for kind, df in (("rows", rows), ("none", rows.where("doc_id < 0"))):
            path = f"file://{tmp_path}/{name.replace(' ', '-')}-{kind}"
            df.coalesce(1).write.parquet(path)
            out = stage(spark, spark.read.parquet(path), SF)
            got = out.collect()
            if stage is not STAGE["best-fit packing"]:
                assert out.columns == rows.columns
            assert kind == "rows" or not got

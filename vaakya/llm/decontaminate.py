"""Benchmark decontamination with DataFrame functions only.

The distinct windows of the benchmark items are a hash set that is broadcast
while their number is within ``BROADCAST_WINDOWS``, and joined by shuffle
beyond it. Documents are scanned once: each of their windows is hashed, looked
up, and a hit is verified word by word.

Edge cases: null or empty texts and items without words have no words and hit
nothing; items with a null id mark words but are not counted as items; rows
that repeat a doc_id are judged as documents of their own; an empty benchmark
leaves every document clean; other columns are not read, and kept unchanged
by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, materialize, numbered, table

N = 10
#: Words are runs of ASCII letters and digits and of all other non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Columns added for a while, unlike any of a table's.
DOC, HITS = f"{ROW}_doc", f"{ROW}_hits"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Windows that may be broadcast: at about 200 bytes each, 100 MB at most.
BROADCAST_WINDOWS = 500_000


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(ws: Column, n: int) -> Column:
    """pos, w, h of each window of n words; an array."""
    last = F.size(ws) - n
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(i.cast("int").alias("pos"), F.lit(n).alias("w"), F.xxhash64(F.slice(ws, i + 1, F.lit(n))).alias("h")),
        ),
    ).otherwise(F.array().cast("array<struct<pos:int,w:int,h:bigint>>"))


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, w, h, gram): the distinct windows of each item."""
    ws = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    w = F.least(F.size("ws"), F.lit(n))
    return (
        ws.select("item_id", w.alias("w"), F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - w + 1), lambda i: F.slice("ws", i, w))).alias("gram"))
        .select("item_id", "w", F.xxhash64("gram").alias("h"), "gram")
        .distinct()
    )


def hits(docs: DataFrame, grams: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """(doc_id, text) -> a row for each verified hit, and one of w = 0 for each document with its number of words."""
    scan = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), words(F.col("text")).alias("ws"))
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("w"), F.lit(None).cast("long").alias("h")))
    each = scan.select("row", "doc_id", "ws", F.inline(F.concat(mark, *[_windows(F.col("ws"), n) for n in lengths])))
    known = grams.select("h", "gram").distinct().select(F.col("h").alias("gh"), "gram")
    if broadcast:
        known = F.broadcast(known)
    # One long key finds candidates; the words themselves are compared above the join.
    found = each.join(known, F.col("h") == F.col("gh"), "left")
    kept = found.where((F.col("w") == 0) | (F.col("gram") == F.slice("ws", F.greatest(F.col("pos") + 1, F.lit(1)), F.col("w"))))
    return kept.select("row", "doc_id", F.when(F.col("w") == 0, F.size("ws")).cast("long").alias("n_words"), "pos", "w", "h", "gram")


def audit(docs: DataFrame, items: DataFrame, n: int = N, hit_positions: bool = False) -> DataFrame:
    """A row per document: its words, hit words and the items found in it.

    With ``hit_positions`` also ``hits``, the (pos, w) of hit windows in order.
    """
    grams = materialize(item_windows(items, n), "windows")
    sizes = grams.select("w", "h", "gram").distinct().groupBy("w").count().collect()  # at most n rows
    lengths = sorted((r["w"] for r in sizes), reverse=True)
    small = sum(r["count"] for r in sizes) <= BROADCAST_WINDOWS
    found = materialize(hits(docs, grams, lengths, small), "hits")
    step = F.aggregate(
        F.array_sort(F.collect_set(F.when(F.col("w") > 0, F.struct("pos", "w")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["pos"] + x["w"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["pos"] + x["w"] - F.greatest(acc["end"], x["pos"]))).alias("n"),
        ),
    )["n"]
    extra = [F.array_sort(F.collect_set(F.when(F.col("w") > 0, F.struct("pos", "w")))).alias("hits")] if hit_positions else []
    cover = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), step.cast("long").alias("n_hit"), *extra)
    names = grams.where("item_id is not null").select(F.col("item_id"), F.col("w").alias("iw"), F.col("h").alias("ih"), F.col("gram").alias("igram"))
    if small:
        names = F.broadcast(names)
    inside = (
        found.where("w > 0").select("row", "w", "h", "gram").distinct()
        .join(names, (F.col("h") == F.col("ih")) & (F.col("w") == F.col("iw")) & (F.col("gram") == F.col("igram")))
        .groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    )
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return cover.join(inside, "row", "left").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        *["hits"] * hit_positions,
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, action: str = "document") -> DataFrame:
    """``docs`` without contaminated documents, or with their hit words cut out.

    ``action="span"`` removes hit words with what follows each up to the next
    word, and keeps the document. Each row is judged by itself, also where it
    repeats a doc_id or has none.
    """
    if action not in ("document", "span"):
        raise ValueError(action)
    rows = numbered(docs)
    found = audit(rows.select(F.col(ROW).alias("doc_id"), "text"), items, n, hit_positions=action == "span").where("contaminated")
    if action == "document":
        # Stored first, so that Spark knows its true size and shuffles the documents only where it is large.
        bad = materialize(found.select(F.col("doc_id").alias(DOC)), "bad")
        return rows.join(bad, rows[ROW] == bad[DOC], "left_anti").drop(ROW)
    spans = found.select(F.col("doc_id").alias(DOC), F.col("hits").alias(HITS))
    text = F.col("text")
    sep, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    units = F.regexp_extract_all(text, F.lit(f"{word}+{sep}*"), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform(HITS, lambda x: F.sequence(x["pos"], x["pos"] + x["w"] - 1))))
    flags = F.map_from_arrays(hit, F.transform(hit, lambda _: F.lit(True)))
    left = F.filter(units, lambda _, i: F.try_element_at(flags, i.cast("int")).isNull())
    cut = F.concat(F.regexp_extract(text, f"^{sep}*", 0), F.array_join(left, ""))
    new = F.when(F.col(HITS).isNull(), text).otherwise(cut)
    out = rows.join(spans, rows[ROW] == spans[DOC], "left").withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(HITS).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP5_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws
  from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark),
bw as (select item_id, ws, least(len(ws), 10) as w, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as p from b where len(ws) > 0),
grams as (select distinct item_id, w, array_to_string(ws[p:p + w - 1], ' ') as g from bw),
sizes as (select distinct w from grams),
dw as (select r, s.w, unnest(range(1, len(ws) - s.w + 2)) as p, ws from d, sizes s where len(ws) >= s.w),
hit as (select r, dw.w, p, g, item_id from dw join grams on grams.w = dw.w and grams.g = array_to_string(ws[p:p + dw.w - 1], ' ')),
cov as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + w)) as q from hit) group by r),
its as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by r)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov on cov.r = d.r left join its on its.r = d.r
"""

"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

An item's windows are its runs of ten words (the whole item, if it has fewer). The index holds, for each term that
the items use, where in the documents it stands: a table of postings (term, document, position) in the shared
folder. For each window the two rarest terms are looked up; their posting lists, shifted by the terms' places in
the item, are intersected, so an alignment of item and document survives only if both agree. Surviving windows are
then compared word by word with the document. Windows with a term that no document has are never looked up.

Tables that depend on the benchmark alone or on survivors are written to the shared folder first, so that their
sizes are known. Candidates are joined to the documents by shuffling, but only documents whose key shares a slot with a
candidate's move with their texts; the slots are of a bounded number and broadcast.

Defined results: null and empty texts have no words; repeated rows each get a row; null item_ids count for hits but
not as items; an empty benchmark finds nothing; an empty table gives no rows; very long texts are searched whole; other
columns are ignored by the query and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, parted, table, unused

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Names a row by its id and text. Rows that share a name share candidates, which are compared row by row."""
    return F.xxhash64(doc_id, text)


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index ``(term, doc, pos)`` of ``terms (term)``; terms are XXH64 hashes of words."""
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    return docs.select(row_key().alias("doc"), F.posexplode(hashed).alias("pos", "term")).join(terms, "term").select("term", "doc", "pos")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, start, words``: the windows of each distinct word sequence ``(item, words)``."""
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    return items.select("item", "words", F.explode(starts).alias("start"), length.alias("length")).select("item", "start", F.expr("slice(words, start + 1, length)").alias("words"))


def _lookup(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with their windows' text, and the alignments that both rarest terms of a window agree on."""
    named = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    named = keep(named.withColumn("item", F.xxhash64(F.array_join("words", " "))), "items")
    made = keep(item_windows(named.select("item", "words").dropDuplicates(["item"]), window), "windows")
    terms = keep(made.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("term")).distinct(), "terms")
    index = keep(postings(docs, terms), "postings")
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    placed = made.select("item", "start", F.size("words").alias("length"), F.posexplode("words").alias("off", "w"))
    placed = placed.select("item", "start", "length", "off", F.xxhash64("w").alias("term")).join(frequency, "term")
    by_window = Window.partitionBy("item", "start")
    placed = placed.withColumn("found", F.count("*").over(by_window)).where("found = length")
    ranked = placed.withColumn("rank", F.row_number().over(by_window.orderBy("n", "off"))).where("rank <= 2")
    seeds = keep(ranked.select("item", "start", "term", (F.col("start") + F.col("off")).alias("at")), "seeds")
    wanted = seeds.groupBy("item", "start").agg(F.collect_set("at").alias("at")).select("item", F.struct("start", "at").alias("w"))
    wanted = keep(wanted.groupBy("item").agg(F.collect_list("w").alias("wanted")), "wanted")
    places = keep(seeds.select("term", "item", "at").distinct(), "places")
    aligned = index.join(places, "term").select("doc", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    aligned = aligned.groupBy("doc", "item", "shift").agg(F.collect_set("at").alias("seen")).join(wanted, "item")
    starts = F.transform(F.filter("wanted", lambda w: F.size(F.array_except(w["at"], F.col("seen"))) == 0), lambda w: w["start"])
    aligned = aligned.select("doc", "item", "shift", F.explode(starts).alias("start"))
    return named, made, aligned


def _candidates(made: DataFrame, aligned: DataFrame) -> DataFrame:
    """``doc, found``: for each document the windows (place, words, text's hash) to be compared."""
    text = made.select("item", "start", F.array_join("words", " ").alias("said"), F.size("words").alias("length"))
    rows = aligned.join(text, ["item", "start"]).where(F.col("shift") + F.col("start") >= 0)
    return rows.groupBy("doc").agg(F.collect_set(F.struct((F.col("shift") + F.col("start")).alias("place"), "length", "said")).alias("found"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, doc, n_words, found)`` with their exact windows (place, length, said), and ``(said, item_id)``."""
    named, made, aligned = _lookup(docs, benchmark, window)
    candidates = keep(_candidates(made, aligned), "candidates")
    may, cannot = parted(docs.select("doc_id", "text", row_key().alias("doc")), candidates, "doc")
    rows = may.join(candidates, "doc", "left").unionByName(cannot.withColumn("found", F.lit(None).cast(candidates.schema["found"].dataType)))
    rows = rows.select("doc_id", "doc", "found", words(F.col("text")).alias("words"))
    same = lambda c: F.array_join(F.slice("words", c["place"] + 1, c["length"]), " ") == c["said"]
    exact = F.when(F.col("found").isNotNull(), F.filter("found", same))
    rows = rows.select("doc_id", "doc", F.size("words").cast("long").alias("n_words"), exact.alias("found"))
    of = made.select("item", F.array_join("words", " ").alias("said")).join(named.select("item", "item_id"), "item").select("said", "item_id").distinct()
    return rows, of


def covered(found: Column) -> Column:
    """Words that lie in any of the spans (place, length)."""
    spans = F.array_sort(F.transform(found, lambda c: F.struct(c["place"].alias("a"), (c["place"] + c["length"]).alias("b"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    return F.coalesce(F.aggregate(spans, start, step, lambda s: s["n"]), F.lit(0)).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items``: hit words and the ids of the items found, sorted as strings."""
    rows, of = matches(docs, benchmark, window)
    rows = keep(rows, "matches")
    said = rows.select("doc", F.explode("found.said").alias("said")).distinct().join(keep(of, "said"), "said")
    items = said.where("item_id is not null").groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return rows.select("doc", "doc_id", "n_words", covered(F.col("found")).alias("n_hit")).join(items, "doc", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns."""
    rows, _ = matches(docs, benchmark, window)
    doc = unused(docs, "doc")
    hit = keep(rows.where(F.size("found") > 0).select(F.col("doc").alias(doc)).distinct(), "hit")
    may, cannot = parted(docs.withColumn(doc, row_key()), hit, doc)
    return may.join(hit, doc, "left_anti").unionByName(cannot).select(docs.columns)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 5) -> DataFrame:
    """``doc_id, item_id, place``: where all words of a window of an item stand within its length plus ``slop`` words.

    place is that of the window's rarest term, from 0. Every posting of that term is followed; the words around
    it are compared in the document.
    """
    named = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    named = named.withColumn("item", F.xxhash64(F.array_join("words", " ")))
    made = keep(item_windows(named.select("item", "words").dropDuplicates(["item"]), window).withColumn("said", F.array_sort("words")).drop("words").dropDuplicates(["item", "said"]), "windows")
    terms = keep(made.select(F.explode("said").alias("w")).select(F.xxhash64("w").alias("term")).distinct(), "terms")
    index = keep(postings(docs, terms), "postings")
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    placed = made.select("item", "start", "said", F.explode("said").alias("w")).withColumn("term", F.xxhash64("w")).join(frequency, "term", "left")
    by_window = Window.partitionBy("item", "start")
    rarest = placed.withColumn("rank", F.row_number().over(by_window.orderBy(F.col("n").asc_nulls_first(), "w"))).where("rank = 1 and n is not null")
    seeds = keep(rarest.select("term", "item", "start", "said"), "seeds")
    cands = index.join(seeds, "term").groupBy("doc").agg(F.collect_set(F.struct("pos", "item", "said")).alias("found"))
    rows = docs.select("doc_id", row_key().alias("doc"), words(F.col("text")).alias("words")).join(keep(cands, "candidates"), "doc")

    def near(c: Column) -> Column:
        span = F.size(c["said"]) + slop
        first = F.greatest(F.lit(0), c["pos"] - span + 1)
        count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
        return F.exists(
            F.sequence(first, c["pos"]),
            lambda s: F.forall(c["said"], lambda w: count(F.slice("words", s + 1, span), w) >= count(c["said"], w)),
        )

    rows = rows.select("doc_id", F.explode(F.filter("found", near)).alias("c")).select("doc_id", "c.item", F.col("c.pos").alias("place"))
    return rows.join(named.select("item", "item_id"), "item").select("doc_id", "item_id", "place").distinct()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

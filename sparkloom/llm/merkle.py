"""Document fingerprints: Merkle trees over sections and paragraphs, with DataFrame functions only.

A text's sections are its blocks between newlines; a section's paragraphs are its runs of at most
``PARAGRAPH_WORDS`` words, with the white space after them. A leaf is the XXH64 of a paragraph, a section's node
the SHA-256 of its leaves, and the root the SHA-256 of the sections' nodes in order. Roots test equality; where two
roots differ, ``edits`` descends to the sections and paragraphs that do.

The fingerprint is the root and, after a colon, the tree's leaves (32 bits of each in hexadecimal, paragraphs
separated by points and sections by slashes). ``likeness`` compares two trees by Dice's measure: of the leaves
that agree in their place, or of the sets of leaves, whichever is more. The first sees edits that leave
the rest in place, even in texts that repeat themselves, the second also insertions.

``with_next`` finds each row's successor without one task sorting all: ids are dealt into buckets of equal
width, each bucket is sorted by itself, and the first row of each bucket is copied to the end of the one before.

Defined results: null text is empty and has no leaves; two trees without leaves are alike (1), one of them gives
0; repeated ids are in order of their texts, and each is followed by the next row; a null id comes first; a single
row is followed by itself; an empty table gives no rows; very long texts are hashed whole; ids are whole numbers; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, small_enough, table

PARAGRAPH_WORDS = 8
#: Rows that a bucket is to hold, and bucket rows that one task may sort.
BUCKET, ALONE = 256, 50_000


def paragraphs(section: Column, words: int = PARAGRAPH_WORDS) -> Column:
    return F.regexp_extract_all(section, F.lit(rf"\s*+(?:\S++\s*+){{1,{words}}}|\s++"), F.lit(0))


def leaves(text: Column, words: int = PARAGRAPH_WORDS) -> Column:
    """Array of sections, each an array of 64-bit leaves."""
    return F.transform(F.split(text, "\n"), lambda s: F.transform(paragraphs(s, words), lambda p: F.xxhash64(p)))


def root(tree: Column) -> Column:
    node = lambda ls: F.sha2(F.array_join(ls.cast("array<string>"), ","), 256)
    return F.sha2(F.array_join(F.transform(tree, node), ""), 256)


def short(tree: Column) -> Column:
    """The tree with 32 bits of each leaf."""
    return F.transform(tree, lambda s: F.transform(s, lambda x: F.shiftright(x, 32).cast("int")))


def fingerprint(root: Column, tree: Column) -> Column:
    """The string form of a root and a short tree."""
    section = lambda s: F.array_join(F.transform(s, lambda x: F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), ".")
    return F.concat(root, F.lit(":"), F.array_join(F.transform(tree, section), "/"))


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two short trees."""
    a, b = F.flatten(a), F.flatten(b)
    placed = 2 * F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / (F.size(a) + F.size(b))
    shared = 2 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(F.greatest(placed, shared))


def edits(a: Column, b: Column) -> Column:
    """Where two trees differ: an array of (section, paragraph), both from 0; paragraph is null if only one has the section."""
    count = lambda x: F.greatest(F.size(x), F.lit(0))

    def within(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        places = F.filter(F.sequence(F.lit(0), F.greatest(count(x), count(y))), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
        one = F.array(F.struct(i.alias("section"), F.lit(None).cast("int").alias("paragraph")))
        both = F.transform(places, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        return F.when(x.isNull() | y.isNull(), one).otherwise(both)

    branches = F.filter(F.sequence(F.lit(0), F.greatest(count(a), count(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.flatten(F.transform(branches, within))


def _following(firsts: DataFrame) -> DataFrame:
    """``(first, follower)``: each bucket's first id with the bucket before it; the first follows the last."""
    n = firsts.count()
    if n <= ALONE:
        before = F.lag("bucket").over(Window.orderBy("bucket"))
        return firsts.select("first", before.alias("into"))
    wide = firsts.withColumn("wide", F.floor(F.col("bucket") / 1024))
    inner = wide.select("first", "wide", F.lag("bucket").over(Window.partitionBy("wide").orderBy("bucket")).alias("into"))
    ends = wide.groupBy("wide").agg(F.max("bucket").alias("end"), F.min("first").alias("first"))
    outer = ends.select("first", F.lag("end").over(Window.orderBy("wide")).alias("outer"))
    return inner.join(outer, "first", "left").select("first", F.coalesce("into", "outer").alias("into"))


def with_next(rows: DataFrame, id: str, payload: list[str]) -> DataFrame:
    """``rows`` with columns ``next_<c>`` of the next row in ascending ``id`` (then ``payload``) for each payload column."""
    n, low, high = rows.agg(F.count("*"), F.min(id), F.max(id)).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(1, -(-(high - low + 2) // max(1, n // BUCKET)))
    key = F.coalesce(F.col(id).cast("long"), F.lit(low - 1))
    bucket = F.expr(f"(coalesce(cast(`{id}` as bigint), {low - 1}L) - ({low - 1}L)) div {width}L")
    ids = rows.select(key.alias("key"), bucket.alias("bucket"))
    firsts = ids.groupBy("bucket").agg(F.min("key").alias("first"))
    top = F.lit((high - low + 1) // width).cast("long")
    heads = keep(_following(firsts).select("first", F.coalesce("into", top).alias("into")), "heads")
    dealt = rows.withColumns({"__key": key, "__bucket": bucket}).join(small_enough(heads), F.col("__key") == F.col("first"), "left")
    own = F.struct(F.col("__bucket").alias("at"), F.lit(0).alias("late"))
    both = F.when(F.col("into").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("into").alias("at"), F.lit(1).alias("late"))))
    dealt = dealt.select(*rows.columns, "__key", F.inline(both))
    order = Window.partitionBy("at").orderBy("late", "__key", *payload)
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload})
    return dealt.where("late = 0").select(*rows.columns, *[f"next_{c}" for c in payload])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, tree, root)``: texts (null: empty) with their short trees and roots."""
    text = F.coalesce("text", F.lit(""))
    trees = docs.select("doc_id", text.alias("text"), leaves(text).alias("long"))
    return trees.select("doc_id", "text", short(F.col("long")).alias("tree"), root(F.col("long")).alias("root"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document against its edited text, whose last quarter is the start of the next document, and the next document."""
    rows = with_next(fingerprints(docs), "doc_id", ["text", "tree"])
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    rows = rows.withColumn("edited_long", leaves(F.col("edited"))).withColumns({"edited_tree": short(F.col("edited_long")), "edited_root": root(F.col("edited_long"))})
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("root"), F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_root"), F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))

"""Near-duplicate documents by SimHash, compared exactly in tiles.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the hashes of the word shingles. Two
fingerprints link if they differ in at most ``radius`` bits, and linked documents form components.

Search. Distinct fingerprints are cut into ``radius + 1`` blocks of bits. Two that are within the radius agree
on a block at least (pigeonhole), so comparing those which share a block's value loses nothing. The fingerprints
of one block value are a tile. A value held by many is dealt by population count and a salt into several tiles;
of these, only tile pairs whose population counts are within the radius are ever made. Tiles are compared with
numpy: exclusive-or, bit counts, and again a skip over runs whose population counts differ too much. A task
reports a spanning forest of what it has linked, never all pairs.

Defined results: null or empty text has no words and fingerprint zero, which links like any other; repeated rows
each get a row; a null doc_id is kept and is never a component's name unless all its ids are null; very long texts
count whole; an empty table gives no rows; other columns are ignored by the query and kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import as_bytes, forget, keep, pieces, released, small_enough, table, unused
from sparkloom.llm.components import Forest, components

SEED = 42
#: Fingerprints in a tile.
TILE = 2048
#: Groups of up to this many are compared together, all of a batch at once.
SMALL = 48


def fingerprint(data: bytes, size: int = 3) -> int:
    """SimHash of UTF-8 text: lower-cased A-Z, words between ASCII white space, shingles of ``size`` words."""
    words = data.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 15):
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each document; fp is the fingerprint as a signed long."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                fps = np.array([fingerprint(x, size) for x in as_bytes(part.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _compare(fp: np.ndarray, rows: np.ndarray, others: np.ndarray | None, radius: int, forest: Forest) -> None:
    """Links rows of one tile with each other, or with those of another tile."""
    pop = np.bitwise_count(fp)
    rows = rows[np.argsort(pop[rows], kind="stable")]
    against = rows if others is None else others[np.argsort(pop[others], kind="stable")]
    theirs, counts = fp[against], pop[against].astype(np.int16)
    for at in range(0, len(rows), 256):
        mine = rows[at : at + 256]
        low = np.searchsorted(counts, int(pop[mine[0]]) - radius, "left") if others is not None else at
        high = np.searchsorted(counts, int(pop[mine[-1]]) + radius, "right")
        if low < high:
            i, j = np.nonzero(np.bitwise_count(fp[mine][:, None] ^ theirs[None, low:high]) <= radius)
            forest.link(mine[i], against[low + j])


def _links(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over rows sorted by group."""
    forest = Forest(len(fp))
    cuts = np.concatenate(([0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)]))
    small = np.repeat(np.diff(cuts) <= SMALL, np.diff(cuts))
    few = np.nonzero(small)[0]
    for d in range(1, SMALL):
        i, j = few[:-d], few[d:]
        same = group[i] == group[j]
        if not same.any():
            break
        near = np.bitwise_count(fp[i[same]] ^ fp[j[same]]) <= radius
        forest.link(i[same][near], j[same][near])
    for a, b in pairwise(cuts.tolist()):
        if b - a > SMALL:
            rows, second = np.arange(a, b), side[a:b] == 1
            if second.any() and not second.all():
                _compare(fp, rows[~second], rows[second], radius, forest)
            else:
                _compare(fp, rows, None, radius, forest)
    out = np.nonzero(forest.root != np.arange(len(fp)))[0]
    return fp[out], fp[forest.root[out]]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that span every pair within ``radius`` bits."""
    blocks = radius + 1
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    at = [sum(width[:i]) for i in range(blocks)]
    key = lambda i: F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << width[i]) - 1)) + F.lit(i << 60 if i < 8 else 0)
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*[F.xxhash64(F.lit(i), key(i)) for i in range(blocks)])).alias("key"))
    sizes = rows.groupBy("key", "pop").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    hot = sizes.where(F.col("n") > tile).select("key", F.ceil(F.col("most") / tile).cast("int").alias("salts"))
    rows = rows.join(hot, "key", "left").withColumn("salt", F.expr("pmod(xxhash64(fp, 7), salts)").cast("int"))
    own = F.col("pop") * 65536 + F.col("salt")
    near = F.sequence(F.col("pop") - radius, F.col("pop") + radius)
    partners = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: p * 65536 + s)))
    dealt = F.when(F.col("salts").isNull(), F.array(F.struct(F.col("key").alias("group"), F.lit(0).alias("side")))).otherwise(
        F.transform(partners, lambda t: F.struct(F.xxhash64("key", F.least(t, own), F.greatest(t, own)).alias("group"), (own > t).cast("int").alias("side")))
    )
    rows = rows.select("fp", F.inline(dealt)).select("group", "fp", "side").repartition("group").sortWithinPartitions("group")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def done(part: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links(part[0], part[1].view(np.uint64), part[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            part = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            cut = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
            if cut:
                yield done([np.ascontiguousarray(x[:cut]) for x in part])
            held = [x[cut:].copy() for x in part]
        if held is not None and len(held[0]):
            yield done(held)

    return rows.mapInArrow(run, "a long, b long")


def _placed(docs: DataFrame, size: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` for each document; root is a fingerprint that tells components apart."""
    marked = keep(fingerprints(docs, size), "fingerprints")
    first = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "first")
    roots = components(links(first.select("fp"), radius, tile))
    joined = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    names = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = keep(joined.select("fp", "root").join(names, "root").select("fp", "root", "component_id"), "names")
    forget(first, roots)
    out = marked.join(names, "fp").select("doc_id", "fp", "root", "component_id")
    out._reads = (marked, names)
    return out


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each document; component_id is the least doc_id reachable."""
    return _placed(docs, size, radius, tile).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _marked(docs: DataFrame, size: int, fp: str) -> DataFrame:
    """``docs`` with the fingerprint of each row in a new column ``fp``."""
    cols, at = docs.columns, docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                fps = np.array([fingerprint(x, size) for x in as_bytes(part.column(at))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps)], [*cols, fp])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))


def one_of_each(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component: of those with its least doc_id, that with the least other columns.

    Documents without a doc_id stay, as do all columns; columns of maps, which have no order, don't decide. Only rows
    whose doc_id repeats are compared by their columns; texts don't move for the others while the list of those that
    go is small.
    """
    found = _placed(docs.where("doc_id is not null"), size, radius)
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("named"))
    # Rows that stay for their doc_id alone are in neither list.
    out = keep(ids.where("n > 1 or not named"), "out")
    several = keep(out.where("n > 1 and named").select("doc_id"), "several")
    kept = docs.join(small_enough(keep(out.select("doc_id"), "out-ids")), "doc_id", "left_anti").select(docs.columns)
    if not several.isEmpty():
        # Rows that share a doc_id are told apart by their fingerprints: one of each component that they name.
        fp, root, place = (unused(docs, x) for x in ("fp", "root", "place"))
        named = keep(found.where("doc_id = component_id").join(several, "doc_id", "left_semi").select("doc_id", F.col("fp").alias(fp), F.col("root").alias(root)).distinct(), "named")
        rows = _marked(docs.join(small_enough(several), "doc_id", "left_semi").select(docs.columns), size, fp).join(named, ["doc_id", fp])
        rest = [F.col(f.name).asc_nulls_first() for f in docs.schema.fields if f.name != "doc_id" and "map<" not in f.dataType.simpleString()]
        rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(root).orderBy("doc_id", *rest))).where(F.col(place) == 1)
        kept = kept.unionByName(rows.select(docs.columns))
    forget(*found._reads)
    return kept


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

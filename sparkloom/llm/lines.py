"""Fuzzy deduplication of lines by MinHash.

A line is compared by the set of its shingles of ``SHINGLE`` characters, after lower-casing A-Z and dropping white
space around it. One-permutation MinHash with densification gives each line ``BANDS`` bands of ``ROWS`` values;
lines that share a band are candidates (at a Jaccard likeness of 0.8, over 99.8 % are), and every link is verified by
exact Jaccard likeness. Components of linked lines keep one line: the first by document and place.

Equal lines are told by their hash (64 bits) before anything is compared. Tasks send their bands as arrays of
numbers, gathered by ranges of the band's value; lines of a band that meet in a task already send one of them, so a
band that many lines share doesn't gather in one place. The lines of a band form a star, or a star of stars where
there are many, and its links are verified first. Where a band's lines are then in more than one component, all of
them are compared with each other, exactly, in tiles inside a task that reports a spanning forest. So copies,
however many, cost a star of links, no link between different lines of a band is lost, and no pairs are spread out
but those of bands of ``PAIRED`` lines at most.
A band that holds more than ``SPLIT`` tiles of lines is split by further, independent bands first.

Defined results: null and empty texts have no lines; blank lines are neither compared nor removed; lines shorter
than a shingle are their own only shingle; very long lines are compared whole; rows that share doc_id and text count
as one document, so each keeps what one would; a null doc_id comes first; an empty table gives no rows; other columns are
ignored by the query and kept by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import as_bytes, forget, hub_join, hub_limit, keep, pieces, released, table, unused
from sparkloom.llm.components import Forest, components

#: 21 bands of 6 values miss as few links of 0.8 as 16 of 5 (0.17 %), and half as many pairs of 0.4 share one.
SHINGLE, BANDS, ROWS, LIKENESS = 5, 21, 6, 0.8
#: Bits of a code point in a packed shingle: five fit in 64.
PACKED = 64 // SHINGLE
#: Lines whose bands are made at once, so that numpy's arrays stay in the cache.
AT_ONCE = 128
#: Lines whose bands a task gathers before it sends them, and bands that a gathering task holds before it compacts them.
SENT, HELD = 1 << 16, 1 << 22
#: Lines of a band that are all paired, lines that a task sends though they share a band (so bands of which it has
#: sent a star are larger than that), and members of a star before it becomes a star of stars.
PAIRED, ALONE, STAR = 5, 16, 512
#: Lines of a tile in which those of a band are compared with each other, and tiles of a band before it is split.
TILE, SPLIT = 2048, 16
SPACE = " \t\r\x0b\f"
_BINS = BANDS * ROWS
_NONE = np.uint32(0xFFFFFFFF)


class Hashes:
    """Random numbers of one family of bands."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.weights = rng.integers(1 << 31, size=SHINGLE, dtype=np.uint32) * 2 + 1
        self.mix = rng.integers(1 << 62, size=2, dtype=np.uint64) * 2 + 1
        self.band_weights = rng.integers(1 << 62, size=(BANDS, ROWS), dtype=np.uint64) * 2 + 1
        self.band_seeds = rng.integers(1 << 62, size=BANDS, dtype=np.uint64)
        self.donors = [*(rng.permutation(_BINS) for _ in range(24)), *(np.roll(np.arange(_BINS), i) for i in range(1, _BINS))]

    def mixed(self, h: np.ndarray) -> np.ndarray:
        h = h * self.mix[0]
        h ^= h >> np.uint64(32)
        h *= self.mix[1]
        return h ^ (h >> np.uint64(29))


FIRST = Hashes(2024)


def normal(line: str) -> str:
    return line.strip(SPACE).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only


def shingles(line: str) -> set[str]:
    """The shingles of a normalised line."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def likeness(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def grams(line: str) -> np.ndarray | None:
    """The shingles of a normalised line as sorted distinct numbers, or None where one doesn't fit in 64 bits."""
    if line.isascii():
        codes = np.frombuffer(line.encode(), np.uint8).astype(np.uint64)
    else:
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if codes.max() >= 1 << PACKED:
            return None
    if (n := len(codes) - SHINGLE + 1) < 1:
        return None
    out = codes[:n].copy()
    for i in range(1, SHINGLE):
        out |= codes[i : i + n] << np.uint64(PACKED * i)
    out.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


class Said:
    """A normalised line to be verified: its shingles as numbers where they fit, else as a set."""

    def __init__(self, line: str) -> None:
        self.line = line
        self.grams = grams(self.line)
        self.set: set[str] | None = None

    def strings(self) -> set[str]:
        if self.set is None:
            self.set = shingles(self.line)
        return self.set

    def like(self, other: Said) -> bool:
        if self.grams is None or other.grams is None:
            return likeness(self.strings(), other.strings()) >= LIKENESS
        x, y = len(self.grams), len(other.grams)
        if min(x, y) < LIKENESS * max(x, y):
            return False
        both = np.concatenate((self.grams, other.grams))
        both.sort()
        n = int(np.count_nonzero(both[1:] == both[:-1]))
        return n / (x + y - n) >= LIKENESS


def bands(lines: list[str], by: Hashes = FIRST) -> np.ndarray:
    """The band keys (lines x BANDS) of normalised lines."""
    lines = [x.ljust(SHINGLE, "\0") for x in lines]
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) for x in lines])
    n = len(codes) - SHINGLE + 1
    h = codes[:n] * by.weights[0]
    for i in range(1, SHINGLE):
        h += codes[i : i + n] * by.weights[i]
    # The shifts and factors of a well-known finaliser of 32-bit hashes.
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    # Shingles across the end of a line are none.
    ends = np.cumsum(lengths)[:-1]
    h[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = _NONE
    slot = (h.astype(np.uint64) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    slot += np.repeat(np.arange(len(lines)) * _BINS, lengths)[:n]
    first = np.full(len(lines) * _BINS, _NONE)
    np.minimum.at(first, slot, h)
    full = first.copy()
    # Empty slots take the value of a donor slot; only slots that are still empty are looked at again.
    empty = np.nonzero(full == _NONE)[0]
    base, bin_of = empty - empty % _BINS, empty % _BINS
    for donor in by.donors:
        if not len(empty):
            break
        taken = first[base + donor[bin_of]]
        full[empty] = taken
        left = taken == _NONE
        empty, base, bin_of = empty[left], base[left], bin_of[left]
    values = full.astype(np.uint64).reshape(-1, BANDS, ROWS)
    return by.mixed((values * by.band_weights).sum(axis=2, dtype=np.uint64) + by.band_seeds)


def _lines(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The place and the normalised bytes of each line of a text that isn't blank."""
    for i, line in enumerate(data.lower().split(b"\n")):  # of bytes, lower() changes A-Z only
        if line := line.strip(SPACE.encode()):
            yield i, line


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line, h`` for each line that isn't blank."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t) for n, t in (("text_hash", T.LongType()), ("line", T.IntegerType()), ("h", T.LongType())))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh64_intdigest
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                row, text_hash, place, hashes = [], [], [], []
                for i, data in enumerate(as_bytes(part.column(1))):
                    of = hashed(data, 42)
                    for j, line in _lines(data):
                        row.append(i)
                        text_hash.append(of)
                        place.append(j)
                        hashes.append(hashed(line, 42))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), _longs(text_hash), pa.array(place, pa.int32()), _longs(hashes)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _stars(key: np.ndarray, h: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Lines by key: of keys of over ``least`` lines the first; of others all (keys, lines); and the others' links (keys, lines, lines)."""
    order = np.argsort(key)
    key, h = key[order], h[order]
    again = np.concatenate(([False], key[1:] == key[:-1]))[: len(key)]
    some = again | np.concatenate((again[1:], [False]))[: len(key)]
    # Only keys of several lines need an order of the lines, which also tells equal ones.
    k, x = key[some], h[some]
    order = np.lexsort((x, k))
    k, x = k[order], x[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])))[: len(k)]
    k, x = k[new], x[new]
    begins = np.concatenate(([True], k[1:] != k[:-1]))[: len(k)]
    start = np.maximum.accumulate(np.where(begins, np.arange(len(k)), 0))
    size = np.diff(np.concatenate((np.nonzero(begins)[0], [len(k)])))
    many = np.repeat(size > least, size)
    place = np.arange(len(k)) - start
    lead = x[np.where(place % STAR, start + place // STAR * STAR, start)]
    stay, out = begins | ~many, many & ~begins
    return np.concatenate((key[~some], k[stay])), np.concatenate((h[~some], x[stay])), k[out], lead[out], x[out]


def _pairs(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (keys, lines, lines) of lines that share a key."""
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    found = [(key[d:][same], h[:-d][same], h[d:][same]) for d in range(1, PAIRED) if len(key) > d and (same := key[d:] == key[:-d]).any()]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (key[:0], key[:0], key[:0])


def _buckets(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``key, a, b``: links that join the lines of each band; of bands of up to ``PAIRED`` lines, all pairs."""
    spark = docs.sparkSession
    parts = parts or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Band keys are dealt by ranges of their value: the key's part is its place among ``parts`` equal ranges.
    bounds = np.array([-(-(i << 64) // parts) for i in range(parts)], np.uint64)

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        fresh: list[int] = []
        made: list[np.ndarray] = []
        hashed = xxhash.xxh64_intdigest

        def flush() -> pa.RecordBatch:
            key, h, k, lead, x = _stars(np.concatenate(made).ravel(), np.repeat(np.array(fresh, np.uint64), BANDS), ALONE)
            order = np.argsort(key)
            key, h = key[order], h[order]
            at = [*np.searchsorted(key, bounds).tolist(), len(key)]
            rows = [(i, True, key[a:b].tobytes() + h[a:b].tobytes()) for i, (a, b) in enumerate(pairwise(at)) if a < b]
            for a in range(0, len(k), SENT):
                b = a + SENT
                rows.append((int(x[a] % np.uint64(parts)), False, k[a:b].tobytes() + lead[a:b].tobytes() + x[a:b].tobytes()))
            made.clear()
            fresh.clear()
            part, alone, said = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(alone), pa.array(said, pa.binary())], ["part", "alone", "said"])

        for batch in batches:
            for part in pieces(batch, 0, 2 << 20):
                new: list[str] = []
                for data in as_bytes(part.column(0)):
                    for _, line in _lines(data):
                        if (h := hashed(line, 42)) not in met:
                            met.add(h)
                            fresh.append(h)
                            new.append(line.decode("utf-8", "surrogatepass"))
                made += [bands(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)]
                if len(met) > 1_000_000:
                    met.clear()
                if len(fresh) >= SENT:
                    yield flush()
        if fresh:
            yield flush()

    @released
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        lines: list[np.ndarray] = []

        def out(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(columns[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)].view(np.int64)) for c in columns], ["key", "a", "b"])

        def compact(least: int) -> Iterator[pa.RecordBatch]:
            key, h, *rest = _stars(np.concatenate(keys), np.concatenate(lines), least)
            keys[:], lines[:] = [key], [h]
            yield from out(*rest)

        held = 0
        for batch in batches:
            for alone, said in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(said.as_buffer(), np.uint64)
                if not alone:
                    yield from out(*data.reshape(3, -1))
                    continue
                keys.append(data[: len(data) // 2].copy())
                lines.append(data[len(data) // 2 :].copy())
                held += len(data) // 2
                if held >= HELD + 2 * len(keys[0]):
                    yield from compact(ALONE)
                    held = len(keys[0])
        if keys:
            yield from compact(PAIRED)
            yield from out(*_pairs(keys[0], lines[0]))

    sent = docs.select("text").mapInArrow(send, "part int, alone boolean, said binary")
    return sent.repartition("part").mapInArrow(gather, "key long, a long, b long")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``h, said``: the normalised text of the lines ``(h, doc_id, text_hash, line)``, a row for each or a few."""
    places = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("h", "line")).alias("at"))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    rows = rows.join(places.hint("merge"), rows["id"].eqNullSafe(places["doc_id"]) & (rows["hash"] == places["text_hash"]))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in pieces(batch, 4, 2 << 20):
                h, said = [], []
                for *key, hs, places, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    # The join has brought repeated rows together; one of them will do.
                    if key != last:
                        lines = text.split("\n")
                        h += hs
                        said += [normal(lines[i]) for i in places]
                        last = key
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(said, pa.string())], ["h", "said"])

    return rows.select("id", "hash", "at.h", "at.line", "text").mapInArrow(run, "h long, said string")


def _verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges ``(a, b)`` whose lines are alike enough."""
    # A line's text goes to the stars that it is in; of each star the first line comes first.
    roles = edges.select(F.col("b").alias("h"), F.col("a").alias("star"), F.lit(1).alias("side")).union(edges.select("a", "a", F.lit(0)).distinct())
    rows = texts.hint("merge").join(roles.hint("merge"), "h").select("star", "side", "h", "said")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x = None, Said("")
        for batch in batches:
            good = []
            for star, side, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if side == 0:
                    known, x = star, Said(said)
                good.append(side == 1 and star == known and x.like(Said(said)))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2)], ["a", "b"])

    return rows.repartition("star").sortWithinPartitions("star", "side").mapInArrow(run, "a long, b long")


def _grouped(rows: DataFrame, work, columns: list[str], schema: str) -> DataFrame:
    """``work(columns)`` over whole groups: several at once, as they come, sorted by ``group``."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            group = now.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = now.slice(cut)
            if cut:
                yield work(now.slice(0, cut))
        if held is not None and len(held):
            yield work(held)

    return rows.repartition("group").sortWithinPartitions("group").select("group", *columns).mapInArrow(run, schema)


def _cuts(group: np.ndarray) -> list[int]:
    return np.concatenate(([0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)])).tolist()


def _alike(said: list[str], roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of lines with different roots that are alike enough, by exact counts of shared shingles."""
    lines = [Said(x) for x in said]
    sets = [x.grams for x in lines]
    if any(x is None for x in sets):
        number: dict[str, int] = {}
        sets = [np.array([number.setdefault(g, len(number)) for g in x.strings()], np.uint64) for x in lines]
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(lines)), sizes)
    _, which, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one line only are shared by no pair. The others are bits, a thousand words at a time.
    shared = many > 1
    name = np.cumsum(shared) - 1
    of, which = of[shared[which]], name[which[shared[which]]]
    bits = np.zeros((len(lines), -(-(int(shared.sum()) or 1) // 64)), np.uint64)
    np.bitwise_or.at(bits, (of, which >> 6), np.uint64(1) << (which & 63).astype(np.uint64))
    found_i, found_j = [], []
    step = max(1, (1 << 21) // (len(lines) * min(bits.shape[1], 1024)))
    for a in range(0, len(lines), step):
        both = np.zeros((min(step, len(lines) - a), len(lines)), np.int64)
        for w in range(0, bits.shape[1], 1024):
            both += np.bitwise_count(bits[a : a + step, None, w : w + 1024] & bits[None, :, w : w + 1024]).sum(axis=2, dtype=np.int64)
        near = both >= LIKENESS * (sizes[a : a + step, None] + sizes[None] - both)
        i, j = np.nonzero(near & (roots[a : a + step, None] != roots[None]))
        found_i.append(i + a)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def _compare(part: pa.Table) -> pa.RecordBatch:
    """Edges between roots that span the links among the lines of each group (group, root, said)."""
    group, root, said = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
    ends: list[list[int]] = [[], []]
    for a, b in pairwise(_cuts(group)):
        names, at = np.unique(root[a:b], return_inverse=True)
        if len(names) > 1:
            i, j = _alike(said[a:b], at)
            forest = Forest(len(names))
            forest.link(at[i], at[j])
            moved = np.nonzero(forest.root != np.arange(len(names)))[0]
            ends[0] += names[moved].tolist()
            ends[1] += names[forest.root[moved]].tolist()
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])


def _mixed(rows: DataFrame) -> DataFrame:
    """``key, n, x``: the keys of ``rows (key, h, root)`` with several roots, whose lines aren't all paired; and their least root."""
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
    return sums.where(f"x <> y and n > {PAIRED}").select("key", "n", "x")


def _further(rows: DataFrame, texts: DataFrame, depth: int) -> DataFrame:
    """``rows (key, h, root)`` dealt anew: keys are those of further bands within the key."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Hashes(2024 + depth)
        for batch in batches:
            for part in pieces(batch, 3, 2 << 20):
                key, h, root = (part.column(i).to_numpy() for i in range(3))
                made = [bands(part.column(3).slice(i, AT_ONCE).to_pylist(), by) for i in range(0, part.num_rows, AT_ONCE)]
                if made:
                    new = (np.concatenate(made) ^ FIRST.mixed(key.view(np.uint64))[:, None]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (new, np.repeat(h, BANDS), np.repeat(root, BANDS))], ["key", "h", "root"])

    return rows.join(texts.hint("merge"), "h").select("key", "h", "root", "said").mapInArrow(run, "key long, h long, root long").distinct()


def _rest(buckets: DataFrame, roots: DataFrame, texts: DataFrame, tile: int = TILE, split: int = SPLIT) -> DataFrame:
    """Edges between roots that span the links among lines of bands which aren't one component yet.

    Bands whose lines' least root is the same are compared together: they are mostly bands of the same lines.
    """
    members = buckets.select("key", F.col("b").alias("h")).union(buckets.select("key", "a")).distinct()
    placed = members.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    placed = keep(placed, "placed")
    mixed = keep(_mixed(placed), "mixed")
    limit = hub_limit(mixed.agg(F.sum("n")).first()[0] or 0)
    rows = keep(hub_join(placed, mixed, "key", "n", limit).select(F.col("x").alias("key"), "h", "root").distinct(), "groups")
    forget(placed, mixed)
    found, depth, used = None, 0, []
    while True:
        sizes = keep(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "n"), "sizes")
        used += [rows, sizes]
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if not total:
            break
        limit = hub_limit(total)
        last = depth == 3 or most <= tile * split
        tiles = F.ceil(F.col("n") / tile).cast("int").alias("tiles")
        few = hub_join(rows, (sizes if last else sizes.where(F.col("n") <= tile * split)).select("key", "n", tiles), "key", "n", limit)
        few = few.withColumn("tile", F.expr("pmod(xxhash64(h, 11), tiles)").cast("int"))
        few = few.select("key", "h", "root", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        few = few.select(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("group"), "h", "root").distinct()
        compared = _grouped(few.join(texts.hint("merge"), "h"), _compare, ["root", "said"], "a long, b long")
        found = keep(compared if found is None else found.union(compared), "rest")
        if last:
            break
        depth += 1
        large = sizes.where(F.col("n") > tile * split)
        rows = keep(_further(hub_join(rows, large, "key", "n", limit), texts, depth), "further")
    forget(*used)
    return keep(buckets.select("a", "b").limit(0), "rest") if found is None else found


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``(node, root)`` after ``edges`` between roots (or lines that had none) are added."""
    new = components(edges)
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return moved.select("node", F.coalesce("to", "root").alias("root")).union(new.join(roots, "node", "left_anti").select("node", "root"))


def linked(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``node, root`` for the hashes of the lines of ``docs`` that are linked to others; ``firsts`` has a place of each line."""
    buckets = keep(_buckets(docs), "buckets")
    edges = keep(buckets.select("a", "b").distinct(), "candidates")
    nodes = edges.select(F.col("a").alias("h")).union(edges.select("b")).distinct()
    places = firsts.join(nodes.hint("merge"), "h")
    texts = keep(_texts(docs, places), "texts")
    good = keep(_verified(edges, texts), "verified")
    forget(edges)
    roots = components(good)
    rest = _rest(buckets, roots, texts)
    if not rest.isEmpty():
        roots = keep(_joined(roots, rest), "roots")
    forget(buckets, texts, good, rest)
    return roots


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, gone``: the places (from 0) of the lines of each document that repeat an earlier one."""
    lines = keep(line_table(docs), "lines")
    firsts = keep(lines.groupBy("h").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "text_hash", "line")]), "firsts")
    roots = linked(docs, firsts)
    named = firsts.join(roots.withColumnRenamed("node", "h"), "h", "left").where("root is not null or n > 1")
    named = keep(named.select("h", "n", F.coalesce("root", "h").alias("root")), "named")
    found = keep(hub_join(lines, named, "h", "n", hub_limit(lines.count())).select("doc_id", "text_hash", "line", "root"), "found")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "line")).alias("first"))
    # A document's places less those that stay, so that no root gathers its lines.
    marked = found.select("doc_id", "text_hash", "line", F.lit(False).alias("stays")).union(first.select("first.*", F.lit(True)))
    gone = marked.groupBy("doc_id", "text_hash").agg(*[F.collect_set(F.when(F.col("stays") == x, F.col("line"))).alias(n) for n, x in (("all", False), ("some", True))])
    gone = keep(gone.select("doc_id", "text_hash", F.array_except("all", "some").alias("gone")).where("size(gone) > 0"), "gone")
    forget(lines, firsts, named, found)
    return gone


def without_repeats(docs: DataFrame, gone: str = "gone", n_lines: str = "n_lines") -> DataFrame:
    """``docs`` with the repeated lines removed from ``text``; adds the places of those (null: none) and how many lines there were.

    The new columns' names must not be among those of ``docs``.
    """
    cut = repeats(docs)
    cols, at = docs.columns, docs.columns.index("text")
    id_, hash_ = unused(docs, "id"), unused(docs, "hash")
    side = cut.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.array_sort("gone").alias(gone))
    joined = docs.join(side.hint("merge"), docs["doc_id"].eqNullSafe(side[id_]) & (F.xxhash64(docs["text"]) == side[hash_]), "left").select(*[docs[c] for c in cols], gone)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, out in zip(batch.column(at).to_pylist(), batch.column(len(cols)).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                counts.append(sum(1 for x in lines if x.strip(SPACE)))
                if out:
                    out = set(out)
                    text = "\n".join([x for i, x in enumerate(lines) if i not in out])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*cols, gone, n_lines])

    schema = T.StructType([*docs.schema.fields, T.StructField(gone, T.ArrayType(T.IntegerType())), T.StructField(n_lines, T.IntegerType())])
    return joined.mapInArrow(run, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"),
        "text",
    )

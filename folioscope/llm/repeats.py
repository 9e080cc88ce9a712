"""Removal of repeated byte strings, after suffix-array deduplication.

Every string of ``length`` bytes (a window) that starts at two places or more is removed wherever it stands.
Sorting all suffixes, or merging full Burrows-Wheeler transforms byte by byte, takes one pass over the
corpus for each of the 200 symbols; here only the suffixes at anchors are ordered, and only where they can
matter. A window's anchor is its ``gram``-byte string of least hash, the leftmost of equals, so equal windows
have equal anchors at equal places, and each anchor stands for the run of window starts that share it.

1. Anchors are counted by hash; one that occurs once rules its windows out.
2. Anchors with their whole context (all bytes of their windows) equal are repeated in all windows.
3. For the contexts that are left, suffixes from all shards that begin at the same anchor are interleaved by
   iterative refinement: order and intervals are refined by eight further symbols in each pass, over the
   intervals that still hold several suffixes; where neighbours part, the pass tells their common prefix.
   The same is done leftwards from the anchor. A window at distance d from its anchor is repeated where an
   interval of common prefix >= length - d and one of common suffix >= d share several contexts.

Anchors with more than ``MOST`` contexts are not gathered: their windows are counted by hash across tasks.

Defined results: null and empty texts keep nothing and lose nothing; texts shorter than the window lose
nothing; equal texts of at least that length lose all; repeated rows are equal texts; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.near_duplicates import whole_units
from folioscope.llm.sieve import marked, sieve
from folioscope.llm.tasks import released
from folioscope.llm.words import RangeHash, slices
from folioscope.session import fresh_folder

LENGTH, GRAM = 200, 80
#: Contexts of one anchor that a task compares; beyond it windows are counted by hash.
MOST = 20_000
#: Bytes of text that are taken apart at once; fits a processor's cache.
SLICE = 1 << 18


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, hash, context hash, place in the row, least and greatest distance of its windows' starts) of
    each anchor in a slice of texts."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n, width = len(data), length - gram + 1
    if n < length:
        return none
    ranges = RangeHash(data)
    grams = np.arange(n - gram + 1)
    hashes = ranges(grams, grams + gram)
    bits = np.uint64(max(n.bit_length(), 1))
    packed = hashes >> bits << bits | grams.astype(np.uint64)
    padded = np.full(-(-len(packed) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(packed)] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(back[:starts], ahead[width - 1:width - 1 + starts])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(starts), side="right") - 1
    valid = np.arange(starts) + length <= offsets[row + 1]
    place = np.where(valid, place, -1)
    turn = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    first, last = turn, np.append(turn[1:], starts) - 1
    keep = place[first] >= 0
    first, last = first[keep], last[keep]
    at = place[first]
    row = row[first]
    context = ranges(first, last + length)
    return row, hashes[at].view(np.int64), context.view(np.int64), at - offsets[row], at - last, at - first


def anchored(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(r, id, digest, n_bytes, anchors) of each row of (id, digest, text); r numbers the rows."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("context", pa.int64()), ("place", pa.int64())]))

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2), SLICE):
                row, h, context, at, least, most = anchors(data, offsets, length, gram)
                values = pa.StructArray.from_arrays(
                    [pa.array(h), pa.array(context), pa.array(at << 24 | least << 12 | most)],
                    ["h", "context", "place"])
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(number, number + hi - lo)), batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo), pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(cut), values).cast(kind)],
                    ["r", "id", "digest", "n_bytes", "anchors"])
                number += hi - lo

    return keyed.select("id", "digest", "text").mapInArrow(
        work, f"r long, id {keyed.schema['id'].dataType.simpleString()}, digest string, n_bytes long,"
              " anchors array<struct<h:long,context:long,place:long>>")


def _words(rows: list[bytes], size: int) -> np.ndarray:
    """Byte strings as rows of big-endian 64-bit symbols, filled up with zeros."""
    width = -(-size // 8) * 8
    joined = b"".join(x.ljust(width, b"\0") for x in rows)
    return np.frombuffer(joined, ">u8").reshape(len(rows), width // 8).astype(np.uint64)


def interleave(unit: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes of each unit in order, and the bytes that each has in common with the one
    before it, -1 at the first of a unit. Each pass refines the intervals of several suffixes by one
    64-bit symbol; suffixes that stand alone are not touched again."""
    n = len(unit)
    order = np.arange(n)
    common = np.full(n, symbols.shape[1] * 8)
    if not n:
        return order, common
    common[np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))] = -1
    for j in range(symbols.shape[1]):
        part = common < symbols.shape[1] * 8  # where an interval begins
        interval = np.cumsum(part)
        several = np.flatnonzero(np.bincount(interval, minlength=n + 2)[interval] > 1)
        if not len(several):
            break
        word = symbols[order[several], j]
        moved = np.lexsort((word, interval[several]))
        order[several] = order[several][moved]
        word = word[moved]
        same = np.append(False, (interval[several][1:] == interval[several][:-1]))
        parted = same & np.append(False, word[1:] != word[:-1])
        at = np.flatnonzero(parted)
        differ = word[at] ^ word[at - 1]
        equal = 7 - np.floor(np.log2(np.maximum(differ.astype(float), 1))).clip(0, 63).astype(np.int64) // 8
        # rounding to floats may lift a value to the next power of two
        equal += (equal < 7) & ((differ >> (np.uint64(56) - np.minimum(equal, 7).astype(np.uint64) * np.uint64(8))) == 0)
        common[several[at]] = 8 * j + equal
    return order, common


def repeated_windows(unit: np.ndarray, left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray,
                     length: int) -> np.ndarray:
    """Boolean matrix (context, distance d): the window that starts d bytes before the anchor stands in
    another context of its unit as well."""
    n = len(unit)
    sides = []
    for strings, size in ((right, length), (left, length - 1)):
        order, common = interleave(unit, _words(strings, size))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sides.append((rank, common))
    (rank_r, common_r), (rank_l, common_l) = sides
    out = np.zeros((n, length), bool)
    for d in range(int(most.max()) + 1 if n else 0):
        inside = np.flatnonzero((least <= d) & (d <= most))
        if len(inside) < 2:
            continue
        ahead = np.cumsum(common_r < length - d)[rank_r[inside]]
        behind = np.cumsum(common_l < d)[rank_l[inside]]
        key = ahead * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[inside[order], d] = np.append(same, False) | np.append(False, same)
    return out


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.diff(np.concatenate(([0], row.astype(np.int8), [0])))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1


def sliced(texts: DataFrame, length: int) -> DataFrame:
    """(h, context, n, members, r, place, left, right): the bytes before and from each wanted anchor on, from
    (text, wanted)."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                for w in wanted:
                    at, least, most = w["place"] >> 24, w["place"] >> 12 & 4095, w["place"] & 4095
                    rows.append((w["h"], w["context"], w["n"], w["members"], w["r"], w["place"],
                                 data[at - most:at][::-1], data[at:at + length - least]))
                if len(rows) > 20_000:
                    yield _slices(rows)
                    rows = []
            if rows:
                yield _slices(rows)

    return texts.mapInArrow(work, "h long, context long, n long, members long, r long, place long, left binary,"
                                  " right binary")


def _slices(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
        ["h", "context", "n", "members", "r", "place", "left", "right"])


def compared(contexts: DataFrame, length: int) -> DataFrame:
    """(r, first, last): runs of repeated window starts of contexts that occur once."""
    dealt = contexts.select("h", "context", "n", "r", "place", "left", "right").repartition("h") \
        .sortWithinPartitions("h", "context")

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, unit in whole_units(batches, 1):
            context = table.column(1).to_numpy()
            new = np.append(True, (context[1:] != context[:-1]) | (unit[1:] != unit[:-1]))
            at = np.flatnonzero(new)  # repeated rows bring a context twice
            table, unit = table.take(pa.array(at)), unit[at]
            place = table.column(4).to_numpy()
            found = repeated_windows(
                unit, table.column(5).to_pylist(), table.column(6).to_pylist(), place >> 12 & 4095, place & 4095, length)
            found[table.column(2).to_numpy() > 1] = False
            rows = []
            for i in np.flatnonzero(found.any(axis=1)):
                for a, b in zip(*_runs(found[i]), strict=True):
                    rows.append((i, (place[i] >> 24) - b, (place[i] >> 24) - a))
            values = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [table.column(3).combine_chunks().take(pa.array(values[:, 0])), pa.array(values[:, 1]),
                 pa.array(values[:, 2])], ["r", "first", "last"])

    return dealt.mapInArrow(work, "r long, first long, last long")


def counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(r, first, last) for anchors of very many contexts: each window as (anchor, distance, hash), counted
    map-side and across tasks."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                place = batch.column(3)[i].as_py()
                at, least, most = place >> 24, place >> 12 & 4095, place & 4095
                text = batch.column(4)[i].as_py()[::-1] + batch.column(5)[i].as_py()
                ranges = RangeHash(np.frombuffer(text, np.uint8))
                d = np.arange(least, most + 1)
                hashes = ranges(most - d, most - d + length)
                ones = np.ones(len(d), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ones * batch.column(0)[i].as_py()), pa.array(d), pa.array(hashes.view(np.int64)),
                     pa.array(ones * batch.column(1)[i].as_py()), pa.array(ones * batch.column(2)[i].as_py()),
                     pa.array(at - d)], ["h", "d", "hash", "context", "r", "start"])

    windows = contexts.dropDuplicates(["h", "context"]).select("h", "context", "r", "place", "left", "right").mapInArrow(
        work, "h long, d long, hash long, context long, r long, start long")
    repeated = windows.groupBy("h", "d", "hash").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") > 1)
    once = contexts.where(F.col("n") == 1).select("r").distinct()
    return windows.join(repeated, ["h", "d", "hash"]).join(once, "r", "left_semi").select(
        "r", F.col("start").alias("first"), F.col("start").alias("last"))


def repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text, the columns of ``keep``, n_bytes, n_removed, n_spans, kept_sha256
    (of the remaining bytes), rest (the remaining runs of text as lines, without parts of characters; null
    where nothing was removed)."""
    spark = documents.sparkSession
    folder = fresh_folder(spark, "repeats")

    def store(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    keyed = documents.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5(
        F.coalesce("text", F.lit(""))).alias("digest"), "text", *(F.col(k).alias(f"_{k}") for k in keep)).withColumn(
        "hash", F.xxhash64("digest"))
    rows = store(anchored(keyed, length, gram), "anchored")
    copies = store(rows.groupBy(F.col("digest").alias("of")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("r").alias("first_r")).where(F.col("copies") > 1), "copies")
    one = F.coalesce("copies", F.lit(1)).alias("copies")
    told = marked(rows.withColumn("hash", F.xxhash64("digest")), "hash", copies.select(
        F.xxhash64("of").alias("of_hash")), "of_hash")
    copied = told.where("maybe").join(copies, F.col("digest") == F.col("of"), "left").where(
        F.col("of").isNull() | (F.col("r") == F.col("first_r"))).select("r", one, "anchors")
    pool = copied.unionAll(told.where("not maybe").select("r", F.lit(1).cast("long").alias("copies"), "anchors")).select(
        "r", "copies", F.inline("anchors"))
    often = store(pool.groupBy("h").agg(F.sum("copies").alias("n")).where(F.col("n") > 1).select("h"), "often")
    candidates = store(sieve(pool, "h", often, "h").join(often, "h"), "candidates")
    contexts = store(candidates.groupBy("h", "context").agg(
        F.sum("copies").alias("n"), F.min("r").alias("r"), F.min_by("place", "r").alias("place")), "contexts")
    mixed = store(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.sum(
        (F.col("n") == 1).cast("long")).alias("single")).where((F.col("members") > 1) & (F.col("single") > 0))
        .select("h", "members"), "mixed")
    wanted = contexts.join(mixed, "h").groupBy("r").agg(F.collect_list(F.struct(
        "h", "context", "n", "members", "r", "place")).alias("wanted"))
    named = store(rows.select("r", F.col("id").alias("of_id"), F.col("digest").alias("of"), F.xxhash64("digest").alias(
        "of_hash")).join(wanted, "r").drop("r"), "named")
    texts = sieve(keyed, "hash", named, "of_hash").join(named, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("of_id"))).select("text", "wanted")
    cut = store(sliced(texts, length), "contexts_cut")
    partly = compared(cut.where(F.col("members") <= most), length).unionAll(
        counted_windows(cut.where(F.col("members") > most), length))
    wholly = candidates.join(contexts.where(F.col("n") > 1).select("h", "context"), ["h", "context"]).where(
        F.col("copies") == 1).select("r", (F.shiftright("place", 24) - F.col("place").bitwiseAND(F.lit(4095))).alias("first"),
                                     (F.shiftright("place", 24) - F.shiftright("place", 12).bitwiseAND(F.lit(4095))).alias("last"))
    spans = partly.unionAll(wholly).groupBy("r").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    by_text = rows.select("r", F.col("digest").alias("of")).join(spans, "r").select("of", F.lit(1).cast("long").alias("copies"), "spans")
    decided = store(by_text.join(copies.select("of"), "of", "left_anti").unionAll(copies.select(
        "of", "copies", F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"))), "decided")
    split = marked(keyed, "hash", decided.select(F.xxhash64("of").alias("of_hash")), "of_hash")
    columns = ["doc_id", "text", "copies", "spans", *(f"_{k}" for k in keep)]
    # texts that lose nothing stay where they are
    whole = split.where("not maybe").select("*", *(F.lit(None).cast(decided.schema[c].dataType).alias(c) for c in ("copies", "spans")))
    joined = split.where("maybe").join(decided, F.col("digest") == F.col("of"), "left")
    return removed(joined.select(columns).unionAll(whole.select(columns)), length, keep)


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Merged byte ranges of runs of window starts."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def removed(decided: DataFrame, length: int, keep: tuple[str, ...]) -> DataFrame:
    """Takes the spans out of each text."""
    names = ["doc_id", "text", *keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"]

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, rests = [], [], []
            for text, copies, spans in zip(
                    batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                if (copies or 1) > 1:
                    gone = [(0, len(data))] if len(data) >= length else []
                else:
                    gone = covered(spans or [], length)
                parts, at = [], 0
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                rest = b"".join([*parts, data[at:]])
                numbers.append((len(data), len(data) - len(rest), len(gone)))
                digests.append(hashlib.sha256(rest).hexdigest())
                left = (x.decode("utf-8", "ignore") for x in [*parts, data[at:]])
                rests.append("\n".join(filter(None, left)) if gone else None)
            values = np.array(numbers, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(batch.column(4 + i) for i in range(len(keep))),
                 *(pa.array(values[:, i]) for i in range(3)), pa.array(digests, pa.string()),
                 pa.array(rests, pa.string())], names)

    kinds = [("doc_id", "doc_id"), ("text", "text"), *((k, f"_{k}") for k in keep)]
    return decided.mapInArrow(
        work, ", ".join(f"{n} {decided.schema[c].dataType.simpleString()}" for n, c in kinds)
        + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest string")

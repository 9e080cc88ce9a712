"""N-gram Jaccard join with a MinHash LSH forest.

Texts with the same words in the same order are one class. A class has ``trees`` tries of minimum hashes;
matched prefixes are shortened from ``depth`` hashes until a pair at the threshold is met in some trie with
the target recall. Classes that share a prefix are compared: first by the agreement of their
signatures, which splits them into small connected sets, then exactly on their shingle sets. Pairs are
compared in blocks inside tasks and never become rows; what leaves a task is one row per class with its
number of links, and a forest of its links.

Defined results: null and empty texts, and texts without words, are one class without other links; a text
of fewer words than a shingle is one shingle; repeated rows are members of a class each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected
from folioscope.llm.sieve import sieve
from folioscope.llm.tasks import released
from folioscope.llm.words import Words, mix, shingles, slices, words_of
from folioscope.session import fresh_folder

SIZE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: Classes of one block; a task compares two blocks at most at once.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Agreement of signatures below the threshold by so many standard deviations still counts.
SLACK = 5.0


def shortened(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that meets a pair at the threshold in some trie with the target recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return seeds[:n], seeds[n:] | np.uint64(1)


def _names(words: Words) -> np.ndarray:
    """16 bytes for each row: a hash of its words in order."""
    rows = len(words.first) - 1
    out = np.zeros((rows, 2), np.uint64)
    place = words.place().astype(np.uint64)
    has = np.flatnonzero(words.counts)
    for i, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        values = mix(words.hash + place * np.uint64(salt))
        if len(has):
            out[has, i] = np.add.reduceat(values, words.first[has])
    out[has, 1] = mix(out[has, 1] + words.counts[has].astype(np.uint64))
    return out


def _id() -> Column:
    """Ids that joins can compare: a null one is the least."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def signatures(documents: DataFrame, size: int = SIZE, hashes: int = TREES * DEPTH) -> DataFrame:
    """(doc_id, digest, bytes, node, signature): node names the class; signature holds 32-bit minimum
    hashes and is null without words."""
    xor, times = _constants(hashes)

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(3)):
                words = words_of(data, offsets)
                names = _names(words)
                values, rows = shingles(words, size)
                signature = np.zeros((hi - lo, hashes), np.uint32)
                if len(rows):
                    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    for k in range(hashes):
                        least = np.minimum.reduceat((values ^ xor[k]) * times[k], starts)
                        signature[rows[starts], k] = least >> np.uint64(32)
                none = words.counts == 0
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(lo, hi - lo) for i in range(3)),
                    pa.array([x.tobytes() for x in names], pa.binary()),
                    pa.array([None if n else x.tobytes() for x, n in zip(signature, none, strict=True)],
                             pa.binary())],
                    ["doc_id", "digest", "bytes", "node", "signature"])

    return documents.select(
        "doc_id", F.xxhash64("text").alias("digest"), F.coalesce(
            F.octet_length("text").cast("long"), F.lit(0)).alias("bytes"), "text").mapInArrow(
        work, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, digest long, bytes long,"
              " node binary, signature binary")


def prefix_keys(classes: DataFrame, trees: int, depth: int, stride: int) -> DataFrame:
    """(key, node) for each trie: a hash of the trie's number and the first hashes of its signature."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]).astype(np.uint64)
            keys = np.zeros((batch.num_rows, trees), np.uint64)
            for t in range(trees):
                key = np.full(batch.num_rows, t + 1, np.uint64)
                for d in range(depth):
                    key = mix(key * np.uint64(31) + values[:, t * stride + d])
                keys[:, t] = key
            nodes = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), nodes], ["key", "node"])

    return classes.select("node", "signature").where(F.col("signature").isNotNull()).mapInArrow(
        work, "key long, node binary")


def blocked(rows: DataFrame, unit: str, blocks: Column) -> DataFrame:
    """Deals the members of a unit into blocks and repeats each for every pair of blocks that it is in:
    adds block, i and j. A unit of one block is the pair (0, 0)."""
    dealt = rows.withColumn("_n", F.greatest(F.lit(1), blocks.cast("int"))).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    return dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumns({
        "i": F.least("block", "_x"), "j": F.greatest("block", "_x")}).drop("_n", "_x")


def whole_units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by their first ``keys`` columns: tables that hold whole units, and a number per
    row that tells its unit."""
    held: list[pa.RecordBatch] = []
    last = None

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).combine_chunks()
            if pa.types.is_binary(column.type):
                column = column.dictionary_encode().indices
            values = column.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(keys))
        begins = tuple(batch.column(k)[0].as_py() for k in range(keys))
        if held and begins == ends == last:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        unit = numbers(table)
        cut = int(np.searchsorted(unit, unit[-1]))
        if cut:
            yield table.slice(0, cut), unit[:cut]
        held, last = table.slice(cut).to_batches(), ends
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbers(table)


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _join(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after the given rows are joined; the smaller row is the root."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if len(left):
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            label = _roots(label)
    return label


def agreeing_forest(unit: np.ndarray, signature: np.ndarray, least: float) -> np.ndarray:
    """For each row the first row of its set: rows of a unit whose signatures agree, directly or through
    others. Pairs already joined are not compared."""
    label = np.arange(len(unit))
    left, shift = label, 0
    while True:
        shift += 1
        left = left[left + shift < len(unit)]
        left = left[unit[left] == unit[left + shift]]
        if not len(left):
            return label
        apart = left[label[left] != label[left + shift]]
        for at in range(0, len(apart), 20_000):
            part = apart[at:at + 20_000]
            same = part[(signature[part] == signature[part + shift]).mean(axis=1) >= least]
            label = _join(label, same, same + shift)


def candidate_edges(keys: DataFrame, shared: DataFrame, classes: DataFrame, least: float,
                    block: int = BLOCK) -> DataFrame:
    """(a, b): a forest over the classes that share a prefix and agree in their signatures. shared has the
    prefixes of several classes with their numbers."""
    rows = sieve(keys, "key", shared, "key").join(shared, "key").join(classes.select("node", "signature"), "node")
    units = blocked(rows, "key", F.ceil(F.col("members") / (2 * block)))
    dealt = units.select("key", "i", "j", "node", "signature").repartition("key", "i", "j") \
        .sortWithinPartitions("key", "i", "j", "node")

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, unit in whole_units(batches, 3):
            # the lowest byte of each hash will do for an estimate
            signature = np.stack([np.frombuffer(x, np.uint8)[::4] for x in table.column(4).to_pylist()])
            label = agreeing_forest(unit, signature, least)
            at = np.flatnonzero(label != np.arange(len(label)))
            nodes = table.column(3).combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(at)), nodes.take(pa.array(label[at]))], ["a", "b"])

    return dealt.mapInArrow(work, "a binary, b binary")


def exact_links(sizes: np.ndarray, rows: np.ndarray, values: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the rows whose shingle sets (pairs row, value, each once) reach the threshold."""
    n = len(sizes)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[shared]]
    rows = rows[shared]
    order = np.argsort(column, kind="stable")
    column, rows = column[order], rows[order]
    common = np.zeros((n, n), np.float32)
    width = max(64, (8 << 20) // max(n, 1) // 4)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, int(column[hi - 1]) - at + 1), np.float32)
        part[rows[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    union = np.add.outer(sizes, sizes).astype(np.float32)
    union -= common
    union *= np.float32(threshold)
    union -= np.float32(0.05)  # less than a shingle, more than rounding
    linked = common >= union
    linked &= common > 0
    np.fill_diagonal(linked, False)
    return linked


def verified(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, links, root) from (root, i, j, block, node, n, text) in units: links counts the documents of
    linked classes, root is the first class of its linked set in the unit."""
    dealt = texts.select("root", "i", "j", "node", "block", "n", "text").repartition("root", "i", "j") \
        .sortWithinPartitions("root", "i", "j", "node")

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, unit in whole_units(batches, 3):
            nodes = np.array(table.column(3).to_pylist(), object)
            weight, block = table.column(5).to_numpy(), table.column(4).to_numpy()
            pair = table.column(1).to_numpy() != table.column(2).to_numpy()
            links, root, right = np.zeros(len(unit), np.int64), np.arange(len(unit)), np.zeros(len(unit), bool)
            found_rows, found_values = [], []
            for lo, hi, data, offsets in slices(table.column(6).combine_chunks()):
                words = words_of(data, offsets)
                right[lo:hi] = [a.tobytes() == b for a, b in zip(_names(words), nodes[lo:hi], strict=True)]
                values, rows = shingles(words, size)
                order = np.lexsort((values, rows))
                values, rows = values[order], rows[order] + lo
                once = np.append(True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])) if len(values) else []
                found_rows.append(rows[once])
                found_values.append(values[once])
            # repeated rows aren't other classes
            right[1:] &= (nodes[1:] != nodes[:-1]) | (unit[1:] != unit[:-1]) | ~right[:-1]
            all_rows, all_values = np.concatenate(found_rows), np.concatenate(found_values)
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(unit)), strict=True):
                a, b = np.searchsorted(all_rows, (lo, hi))
                here = all_rows[a:b] - lo
                linked = exact_links(np.bincount(here, minlength=hi - lo), here, all_values[a:b], threshold)
                linked &= right[lo:hi, None] & right[None, lo:hi]
                if pair[lo]:
                    linked &= block[lo:hi, None] != block[None, lo:hi]
                for i in range(hi - lo):
                    others = np.flatnonzero(linked[i])
                    links[lo + i] = weight[lo:hi][others].sum()
                    later = others[others > i]
                    later = later[root[lo + later] != root[lo + i]]
                    root = _join(root, np.full(len(later), lo + i), lo + later)
            at = np.flatnonzero(right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[at], pa.binary()), pa.array(links[at]), pa.array(nodes[root[at]], pa.binary())],
                ["node", "links", "root"])

    return dealt.mapInArrow(work, "node binary, links long, root binary")


def similar(documents: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, trees: int = TREES,
            depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, digest (xxhash64 of the text), class_id (least id of the texts with the
    same words), group_id (least id of all that links connect), root (the group's name, as ids may be null or
    repeated), n_links (other documents that reach the threshold, those of its own class included)."""
    spark = documents.sparkSession
    folder = fresh_folder(spark, "near-duplicates")
    signatures(documents, size, trees * depth).write.parquet(f"{folder}/signed")
    signed = spark.read.parquet(f"{folder}/signed")
    signed.groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.min(_id()).alias("id"), F.min_by("digest", _id()).alias("digest"),
        F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.min("signature").alias("signature")).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    keys = prefix_keys(classes, trees, shortened(threshold, trees, depth, recall), depth)
    hashes = trees * depth
    least = threshold - SLACK * (threshold * (1 - threshold) / hashes) ** 0.5
    keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1).write.parquet(
        f"{folder}/shared")
    sets = connected(candidate_edges(keys, spark.read.parquet(f"{folder}/shared"), classes, least, BLOCK))
    sets.join(classes.drop("signature"), "node").write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    totals = members.groupBy(F.col("root").alias("of")).agg(
        F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("total"))
    blocks = F.greatest(F.ceil(F.col("members") / (2 * BLOCK)), F.ceil(F.col("total") / (2 * BLOCK_BYTES)))
    dealt = blocked(members.join(totals, F.col("root") == F.col("of")).drop("of"), "root", blocks)
    texts = documents.select(
        _id().alias("id"), F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    sifted = sieve(texts, "digest", members, "digest")
    verified(dealt.join(sifted, ["id", "digest"]), size, threshold).write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    groups = connected(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.select("node", "class_id", "n").join(counted, "node", "left").join(groups, "node", "left") \
        .select("node", "class_id", "n", "links", F.coalesce("root", "node").alias("root"))
    linked.write.parquet(f"{folder}/linked")
    linked = spark.read.parquet(f"{folder}/linked")
    linked.groupBy("root").agg(F.min("class_id").alias("group_id")).write.parquet(f"{folder}/groups")
    named = linked.join(spark.read.parquet(f"{folder}/groups"), "root").select(
        "node", "class_id", "group_id", "root", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named.write.parquet(f"{folder}/named")
    return signed.select("doc_id", "digest", "node").join(
        spark.read.parquet(f"{folder}/named"), "node").select(
            "doc_id", "digest", "class_id", "group_id", "root", "n_links")

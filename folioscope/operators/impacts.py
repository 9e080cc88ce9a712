"""Postings by term, in blocks of like impact, and BM25 that reads only the blocks that can matter.

The impact of a posting is all of its BM25 contribution that doesn't depend on the query. Postings are taken in
segments, as they are stored; a term's postings of a segment are cut into blocks by level of impact, each with the
greatest impact in it (its bound), and stored in folders by term bucket, so building them shuffles nothing. A search
reads the buckets of its terms and asks in turn

1. how high the branch of hits reaches at least: a floor from the least impact of each term's first block;
2. which blocks hold chunks that can reach the floor of some query with all that its other terms add at most; the
   others are not opened;
3. what the chunks of these blocks score. Postings are dealt by chunk, packed and once for all queries, to parts that
   hold all postings of their chunks; a part adds up every query's terms and names its first chunks.

What is shuffled is bounded by the postings of the terms asked for, not by postings times queries. The hits are those
of scoring every chunk.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from folioscope.config import SearchRules
from folioscope.functions import scores
from folioscope.session import stored

#: Bounds are compared with this much room, for sums that add in another order.
ROOM = 1e-6


def impact(weight: Column, length: Column, average_length: Column, rules: SearchRules = SearchRules()) -> Column:
    damped = weight + rules.k1 * (1.0 - rules.b + rules.b * length / average_length)
    return weight * (rules.k1 + 1.0) / damped


def bucket_of(term: Column, rules: SearchRules = SearchRules()) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(rules.term_buckets)).cast("int")


def blocks(postings: DataFrame, term_stats: DataFrame, stats: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """(bucket, term, level, slot, bound, least, postings, entries) with entries of (chunk_id, impact), their greatest
    and least impact and their number.

    Postings are cut into blocks where they are read, segment by segment, and are not shuffled. A term of few postings
    in a segment is one block. Others are cut by level of impact and, so that no block grows with the corpus, into
    as many slots as their number asks for.
    """
    known = postings.join(F.broadcast(stats.select("average_length")), F.lit(True)).select(
        "term", "chunk_id", impact(F.col("weight"), F.col("doc_length"), F.col("average_length"), rules).alias("impact"))
    chunk = known.schema["chunk_id"].dataType.simpleString()
    cut = known.mapInArrow(
        partial(_segments, rules), "term string, level int, slot int, bound double, least double, postings long,"
                                   f" entries array<struct<chunk_id:{chunk},impact:double>>")
    return cut.select(bucket_of(F.col("term"), rules).alias("bucket"), *cut.columns)


def _segments(rules: SearchRules, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings, ``segment_postings`` of them at a time."""
    waiting, held = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            held += batch.num_rows
        if held >= rules.segment_postings:
            yield from _cut(rules, _by_term(waiting))
            waiting, held = [], 0
            pa.default_memory_pool().release_unused()
    if waiting:
        yield from _cut(rules, _by_term(waiting))


#: Postings of a segment that are cut into blocks at once.
SLICE = 50_000


def _by_term(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's postings sorted by term, numbered within it, a slice at a time."""
    rows = pa.Table.from_batches(waiting).combine_chunks()
    waiting.clear()
    term, chunk, impacts = (rows.column(c).combine_chunks() for c in ("term", "chunk_id", "impact"))
    del rows
    term = term.dictionary_encode()
    code = term.indices.to_numpy()
    order = np.argsort(code, kind="stable").astype(np.int32)
    first = np.zeros(len(term.dictionary), np.int32)
    np.cumsum(np.bincount(code)[:-1], out=first[1:])
    for start in range(0, len(order), SLICE):
        taken = order[start:start + SLICE]
        key = code[taken].astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(key), term.dictionary.take(pa.array(key)), pa.array(np.zeros(len(key), np.int32)), pa.nulls(len(key), pa.int64()),
            chunk.take(pa.array(taken)), impacts.take(pa.array(taken)), pa.array(np.arange(start, start + len(key)) - first[key])],
            names=["key", "term", "hot_slot", "hot_df", "chunk_id", "impact", "hash"])


def _cut(rules: SearchRules, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that come sorted by a number of their term and slot. Only the postings of the last term, or of
    its last slot, wait for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _changes(batch, "key")
        if waiting and waiting[-1].column("key")[-1] != batch.column("key")[0]:
            yield _blocks_of(pa.Table.from_batches(waiting), rules)
            waiting = []
        if starts[-1]:
            yield _blocks_of(pa.Table.from_batches([*waiting, batch.slice(0, starts[-1])]), rules)
            waiting = []
        waiting.append(batch.slice(starts[-1]))
    if waiting:
        yield _blocks_of(pa.Table.from_batches(waiting), rules)


def _changes(rows: pa.RecordBatch | pa.Table, *names: str) -> np.ndarray:
    """Where one of these columns differs from the row before; the first row counts."""
    other = np.zeros(rows.num_rows, dtype=bool)
    other[0] = True
    for name in names:
        column = rows.column(name)
        other[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(other)


def _blocks_of(rows: pa.Table, rules: SearchRules) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    starts = _changes(rows, "key", "term", "hot_slot")
    if len(starts) != len(_changes(rows, "key")):  # terms of one hash
        rows = rows.sort_by([(c, "ascending") for c in ("key", "term", "hot_slot")]).combine_chunks()
        starts = _changes(rows, "key", "term", "hot_slot")
    sizes = np.diff(np.append(starts, rows.num_rows))
    run = np.repeat(np.arange(len(starts)), sizes)
    impacts, hashes = (rows.column(c).to_numpy() for c in ("impact", "hash"))
    df = pc.fill_null(rows.column("hot_df"), 0).to_numpy()
    df = np.where(df > 0, df, sizes[run])
    many = df > rules.block_postings
    level = np.where(many, np.floor(impacts * rules.impact_levels), 0).astype(np.int32)
    slot = np.where(many, hashes % -(-df // rules.block_postings), 0).astype(np.int32)
    order = np.lexsort((slot, level, run))
    run, level, slot, impacts = run[order], level[order], slot[order], impacts[order]
    first = np.flatnonzero(np.append(True, (np.diff(run) != 0) | (np.diff(level) != 0) | (np.diff(slot) != 0)))
    counts = np.diff(np.append(first, len(order)))
    entries = pa.StructArray.from_arrays(
        [rows.column("chunk_id").combine_chunks().take(pa.array(order)), pa.array(impacts)], ["chunk_id", "impact"])
    return pa.RecordBatch.from_arrays([
        rows.column("term").combine_chunks().take(pa.array(order[first])), pa.array(level[first]), pa.array(slot[first]),
        pa.array(np.maximum.reduceat(impacts, first)), pa.array(np.minimum.reduceat(impacts, first)), pa.array(counts),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), entries)],
        names=["term", "level", "slot", "bound", "least", "postings", "entries"])


def read_buckets(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Blocks in the buckets of these terms. There are no more than ``term_buckets`` numbers to name."""
    wanted = sorted(r[0] for r in terms.select("bucket").distinct().collect())
    return blocks.where(F.col("bucket").isin(wanted))


def bounded_terms(read: DataFrame, weighed: DataFrame, filtered: bool, rules: SearchRules) -> DataFrame:
    """A row per query term: what the term adds at most (``bound_of_term``), what all do (``total``), all but
    this one (``rest``) and all that aren't essential (``others``), the first ``floor``, and whether a chunk needs
    one of the terms like this to reach it (``essential``). No entry is read: the first block of a term tells
    by itself what its chunks reach, unless some of them are ``filtered`` out."""
    heads = read.join(weighed.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy(
        "bucket", "term").agg(F.max(F.struct("bound", "least", "postings")).alias("head"), F.sum("postings").alias("held"))
    topped = weighed.join(heads, ["bucket", "term"]).withColumn("bound_of_term", F.col("gain") * F.col("head.bound"))
    enough = F.lit(not filtered) & (F.col("head.postings") >= rules.branch_limit)
    whole = W.partitionBy("query_id")
    lesser = whole.orderBy("bound_of_term", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    bound = F.col("bound_of_term")
    placed = topped.withColumn("floor", F.max(F.when(enough, F.col("gain") * F.col("head.least") - ROOM).otherwise(0.0)).over(
        whole)).withColumn("total", F.sum(bound).over(whole)).withColumn("rest", F.col("total") - bound).withColumn(
        "essential", F.sum(bound).over(lesser) >= F.col("floor")).drop("head")
    return stored(placed.withColumn("others", F.sum(F.when(~F.col("essential"), bound).otherwise(0.0)).over(whole)), "terms")


def candidates(read: DataFrame, bounded: DataFrame, eligible: DataFrame | None, rules: SearchRules) -> DataFrame:
    """(query_id, chunk_id, sum) of the chunks that can be among the first, with their scores before rounding.

    The query terms (no more than ``shipped_terms``, see ``top_scores``) are shipped to the tasks. A block is opened if
    the floor of some query can be reached with it. A part of the chunks names no more than ``branch_limit`` of them per
    query, and those that score the same.
    """
    spark = read.sparkSession
    asked = bounded.select("query_id", "bucket", "term", "gain", "rest", "floor", "held").toArrow()
    shipped = _Asked(asked)
    needed = spark.createDataFrame(shipped.needed(asked), "bucket int, term string, code int, threshold double")
    parts = int(max(rules.bucket_parts, spark.sparkContext.defaultParallelism, -(-shipped.held // rules.part_postings)))
    # bounded by shipped_terms
    opened = read.join(F.broadcast(needed), ["bucket", "term"]).where(F.col("bound") >= F.col("threshold")).select("code", "entries")
    dealt = opened.mapInArrow(partial(_deal, parts), "part int, body binary")
    if eligible is not None:
        dealt = dealt.unionByName(eligible.select("chunk_id").mapInArrow(partial(_deal_eligible, parts), "part int, body binary"))
    chunk = read.schema["entries"].dataType.elementType["chunk_id"].dataType
    schema = StructType([StructField("query_id", bounded.schema["query_id"].dataType), StructField("chunk_id", chunk),
                         StructField("sum", DoubleType())])
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(
        partial(_score, spark.sparkContext.broadcast(shipped), eligible is not None, rules.branch_limit, to_arrow_type(chunk)), schema)


class _Asked:
    """Query terms as arrays: the queries' ids and floors, and term codes and gains, query by query."""

    def __init__(self, asked: pa.Table):
        term, query = (asked.column(c).combine_chunks().dictionary_encode() for c in ("term", "query_id"))
        code, of = (c.indices.to_numpy(zero_copy_only=False).astype(np.int32) for c in (term, query))
        order = np.argsort(of, kind="stable")
        gain, rest, floor, held = (asked.column(c).to_numpy() for c in ("gain", "rest", "floor", "held"))
        self.ids, self.starts = query.dictionary, np.searchsorted(of[order], np.arange(len(query.dictionary) + 1))
        self.codes, self.gains = code[order], gain[order]
        self.floors = np.zeros(len(self.ids))
        self.floors[of] = floor
        self.held = int(held[np.unique(code, return_index=True)[1]].sum())
        self.terms = len(term.dictionary)
        self._code, self._bound = code, np.divide(floor - rest, gain, out=np.full(len(gain), -np.inf), where=gain > 0) - ROOM

    def needed(self, asked: pa.Table) -> pa.Table:
        """(bucket, term, code, threshold): the bound a block of the term must have to matter to some query."""
        least = np.full(self.terms, np.inf)
        np.minimum.at(least, self._code, self._bound)
        _, first = np.unique(self._code, return_index=True)
        return asked.select(["bucket", "term"]).take(pa.array(first)).append_column(
            "code", pa.array(np.arange(self.terms, dtype=np.int32))).append_column("threshold", pa.array(least))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


#: Postings that a task packs at once.
PACKED = 1_000_000


def _parts_of(ids: pa.Array, parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(str(i).encode("utf-8", "surrogatepass")) % parts for i in ids.to_pylist()), np.int64, len(ids))


def _packed(part: int, *columns: pa.Array | np.ndarray) -> tuple[int, bytes]:
    """Columns as one value. Numbers take as few bytes as they need, bytes of one place next to each other."""
    plain = []
    for c in columns:
        if isinstance(c, pa.Array):
            plain.append(c.to_pylist())
        elif c.dtype.kind == "f":
            plain.append((c.dtype.str, c.tobytes()))
        else:
            c = c.astype(np.min_scalar_type(c.max(initial=0)))
            plain.append((c.dtype.str, c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()))
    body = pickle.dumps(plain)
    return part, struct.pack("<q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(body: bytes) -> list:
    plain = pickle.loads(pa.decompress(memoryview(body)[8:], decompressed_size=struct.unpack("<q", body[:8])[0], codec="zstd", asbytes=True))
    out = []
    for c in plain:
        if isinstance(c, tuple):
            kind = np.dtype(c[0])
            flat = np.frombuffer(c[1], np.uint8)
            c = flat.view(kind) if kind.kind == "f" else np.ascontiguousarray(flat.reshape(kind.itemsize, len(flat) // kind.itemsize).T).view(kind).ravel()
        out.append(c)
    return out


def _rows(packed: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())],
                                      names=["part", "body"])


def _deal(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of blocks by the part of their chunk: ids of chunks, codes of terms with the number of their
    entries, and for each entry its chunk and impact."""
    codes, ids, values, held = [], [], [], 0
    for batch in batches:
        entries = batch.column("entries")
        sizes = entries.value_lengths().to_numpy(zero_copy_only=False)
        chunk, impacts = entries.flatten().flatten()
        codes.append(np.repeat(batch.column("code").to_numpy(), sizes))
        ids.append(chunk)
        values.append(impacts.to_numpy(zero_copy_only=False))
        held += len(chunk)
        if held >= PACKED:
            yield _rows(_dealt(parts, np.concatenate(codes), pa.chunked_array(ids).combine_chunks(), np.concatenate(values)))
            codes, ids, values, held = [], [], [], 0
    if held:
        yield _rows(_dealt(parts, np.concatenate(codes), pa.chunked_array(ids).combine_chunks(), np.concatenate(values)))


def _dealt(parts: int, code: np.ndarray, ids: pa.Array, impacts: np.ndarray) -> list[tuple[int, bytes]]:
    if ids.null_count:  # a chunk without an id is never named
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        code, ids, impacts = code[known], ids.drop_null(), impacts[known]
    coded = ids.dictionary_encode()
    chunk, names = coded.indices.to_numpy(), coded.dictionary
    part_of = _parts_of(names, parts)
    order = np.lexsort((chunk, code, part_of[chunk]))
    code, chunk, impacts = code[order], chunk[order], impacts[order]
    bounds = np.searchsorted(part_of[chunk], np.arange(parts + 1))
    place, out = np.empty(len(names), np.int64), []
    for part in range(parts):
        at = slice(bounds[part], bounds[part + 1])
        if at.start == at.stop:
            continue
        own = np.flatnonzero(part_of == part)
        place[own] = np.arange(len(own))
        first = np.flatnonzero(np.append(True, np.diff(code[at]) != 0))
        kinds, kind = np.unique(impacts[at], return_inverse=True)
        out.append(_packed(part, names.take(pa.array(own)), code[at][first], np.diff(np.append(first, at.stop - at.start)),
                           place[chunk[at]], kinds, kind))
    return out


def _deal_eligible(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("chunk_id").drop_null()
        part_of = _parts_of(names, parts)
        yield _rows([_packed(p, names.take(pa.array(np.flatnonzero(part_of == p)))) for p in np.unique(part_of)])


def _score(shipped, filtered: bool, limit: int, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first chunks of a part for every query. All postings of its chunks are here."""
    asked, names, eligible = shipped.value, [], []
    codes, chunks, impacts, known = [], [], [], 0
    for batch in batches:
        for body in batch.column("body"):
            own, *rest = _unpacked(body.as_py())
            if not rest:
                eligible += own
                continue
            code, sizes, place, kinds, at = rest
            names.append(pa.array(own, kind))
            codes.append(np.repeat(code.astype(np.int32), sizes))
            chunks.append(place.astype(np.int64) + known)
            impacts.append(kinds[at])
            known += len(own)
    if not known:
        return
    coded = pa.concat_arrays(names).dictionary_encode()
    names, code = coded.dictionary, np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(asked.terms + 1))
    chunk = coded.indices.to_numpy()[np.concatenate(chunks)[order]]
    impact_of = np.concatenate(impacts)[order]
    del codes, chunks, impacts, order, code, coded
    allowed = pc.is_in(names, pa.array(eligible, kind)).to_numpy(zero_copy_only=False) if filtered else None
    found, held = [], 0

    def rows() -> pa.RecordBatch:
        query, place, total = (np.concatenate(c) for c in zip(*found))
        found.clear()
        return pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), names.take(pa.array(place)), pa.array(total)],
                                          names=["query_id", "chunk_id", "sum"])

    for query in range(len(asked.ids)):
        of = [(g, slice(starts[c], starts[c + 1])) for c, g in zip(
            asked.codes[asked.starts[query]:asked.starts[query + 1]], asked.gains[asked.starts[query]:asked.starts[query + 1]])
            if starts[c] < starts[c + 1]]
        if not of:
            continue
        total = np.bincount(np.concatenate([chunk[at] for _, at in of]), np.concatenate([impact_of[at] * g for g, at in of]), len(names))
        if allowed is not None:
            total[~allowed] = 0.0
        least = asked.floors[query] - ROOM
        if len(total) > limit:
            least = max(least, np.partition(total, len(total) - limit)[len(total) - limit] - ROOM)
        place = np.flatnonzero((total >= least) & (total > 0.0))
        if len(place):
            found.append((np.full(len(place), query), place, total[place]))
            held += len(place)
        if held >= PACKED // 10:
            yield rows()
            held = 0
    if found:
        yield rows()


def top_scores(blocks: DataFrame, weighed: DataFrame, eligible: DataFrame | None = None,
               rules: SearchRules = SearchRules()) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that can be among the first ``branch_limit`` of a query.

    ``weighed`` has query_id, term and gain; ``eligible`` names the chunks (chunk_id) that a
    filter leaves. Queries are taken in turn where all their terms are too many to be shipped at once."""
    terms = stored(weighed.withColumn("bucket", bucket_of(F.col("term"), rules)), "query-terms")
    read = read_buckets(blocks, terms)
    bounded = bounded_terms(read, terms, eligible is not None, rules)
    turns = max(1, -(-bounded.count() // rules.shipped_terms))
    found = [stored(candidates(read, bounded if turns == 1 else bounded.where(
        F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn), eligible, rules), "candidates") for turn in range(turns)]
    return reduce(DataFrame.unionByName, found).select("query_id", "chunk_id", F.round("sum", rules.score_digits).alias("score"))


def gains(query_terms: DataFrame, term_stats: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, term, gain): the part of BM25 that depends on the query's term alone."""
    return query_terms.join(term_stats, "term").join(F.broadcast(stats), F.lit(True)).select(
        "query_id", "term", (scores.idf_bm25(F.col("df"), F.col("documents"))
                             * scores.clamp(F.col("weight"), 0.25, 3.0)).alias("gain"))

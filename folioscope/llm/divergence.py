"""How the words of a source differ from those of its language and of other sources: a dominance skyband.

Terms are counted inside the scan's tasks (a task gives at most one row of a term, language and source at a
time) and summed by one shuffle on language and term, where each language keeps the terms of at least
``LEAST`` documents. Terms are then dealt to buckets of about ``ROWS`` rows; each bucket meets the totals of
all sources of its language and gives

* for every ordered pair of sources its part of the sum over the terms. Terms with equal counts in all
  sources are weighed as one, so terms of a single source cost little;
* for every source the terms that fewer than ``TOP`` others of the bucket dominate: others with no lower
  count in the source, no higher count in the language, and an earlier name in UTF-8. A dominated term is
  never ahead, so the first ``TOP`` of a source lie in the union of these skybands, which is ranked exactly.

With p = 1 + floor(SCALE (count + 1) / (N + V)), N being the words of kept terms and V the kept terms, the
value of a term is floor((p - q)^2 / q): whole numbers throughout. Results have a row for each pair of sources
of a language, so the totals of sources, which all buckets meet, are at most the root of the result's rows
for each language.

Defined results: null texts, languages and sources are empty strings; a source without terms still is in all
pairs, with values from V alone; a language without kept terms has pairs of value 0; equal rows count as
documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.tasks import released
from folioscope.llm.words import strings
from folioscope.session import fresh_folder

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Rows of (source, term) in a bucket; entries of a task's counters before they are handed on.
ROWS, ENTRIES = 100_000, 200_000
#: Cells of one matrix of terms by sources.
CELLS = 1 << 20

#: Lower case for A-Z; what is neither a letter nor beyond ASCII becomes a space.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(documents: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, term, count, docs) as tasks count them, in no particular number of rows; a row without
    a term for each group that a task met."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()),
                        ("docs", pa.int64())])

    def handed_on(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for key, own in counts.items():
            names = list(own)
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0]] * (len(names) + 1), pa.string()), pa.array([key[1]] * (len(names) + 1), pa.string()),
                pa.array([*names, None], pa.binary()).cast(pa.string()),
                pa.array([*own.values(), 0], pa.int64()),
                pa.array([*map(docs[key].__getitem__, names), 0], pa.int64())], schema=schema)

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, held = {}, {}, 0
        for batch in batches:
            texts = strings(batch.column(2)).cast(pa.large_binary())
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), texts, strict=True):
                own = counts.get(key)
                if own is None:
                    own, docs[key] = counts.setdefault(key, Counter()), Counter()
                words = text.as_py().translate(_TABLE).split()
                size = len(own)
                own.update(words)
                docs[key].update(set(words))
                held += len(own) - size
                if held > entries:
                    yield from handed_on(counts, docs)
                    counts, docs, held = {}, {}, 0
        yield from handed_on(counts, docs)

    def filled(name: str):
        return F.coalesce(name, F.lit("")).alias(name)

    return documents.select(filled("lang"), filled("source"), "text").mapInArrow(
        work, "lang string, source string, term string, count long, docs long")


def kept_terms(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, count, lang_count, first): counts of the kept terms; ``first`` marks one row of
    each term of a language. A row without a term for each group."""
    key = F.coalesce("term", "source")
    dealt = term_counts(documents).withColumn("key", key).repartition("lang", "key")
    counted = dealt.groupBy("lang", "key", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "key", "term")
    kept = counted.select(
        "lang", "source", "term", "count", F.sum("count").over(every).alias("lang_count"),
        (F.col("term").isNotNull() & (F.col("source") == F.min("source").over(every))).alias("first"),
        F.sum("docs").over(every).alias("lang_docs"))
    folder = fresh_folder(documents.sparkSession, "terms")
    kept.where(F.col("term").isNull() | (F.col("lang_docs") >= least)).drop("lang_docs").write.parquet(folder)
    return documents.sparkSession.read.parquet(folder)


def scaled(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / total), by long division in three steps of a thousand."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def pair_sums(source: np.ndarray, term: np.ndarray, count: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The sum of values over the terms for each (source, other source). ``term`` is sorted."""
    n = len(totals)
    out = np.zeros((n, n), np.int64)
    terms = np.cumsum(np.append(False, term[1:] != term[:-1]))[:len(term)]
    wide = max(1, CELLS // n)
    for low in range(0, int(terms[-1]) + 1 if len(terms) else 0, wide):
        at = slice(*np.searchsorted(terms, (low, low + wide)))
        dense = np.zeros((int(terms[at][-1]) - low + 1, n), np.int64)
        dense[terms[at] - low, source[at]] = count[at]
        dense, times = np.unique(dense, axis=0, return_counts=True)
        p = scaled(dense, totals)
        for a in range(n):
            out[a] += times @ excess(p[:, a:a + 1], p)
    return out


def skyband(count: np.ndarray, lang_count: np.ndarray, name: np.ndarray, k: int = TOP, block: int = 256) -> np.ndarray:
    """Places of the terms that fewer than k others dominate. In the order used a term's dominators come before
    it, and counting those that were kept is enough: what dominates a dominator dominates the term."""
    order = np.lexsort((name, lang_count, -count))
    lang_count, name = lang_count[order], name[order]
    kept = np.zeros(0, np.int64)
    for low in range(0, len(order), block):
        own = np.arange(low, min(low + block, len(order)))
        others = np.concatenate((kept, own))
        over = (lang_count[others] <= lang_count[own, None]) & (name[others] < name[own, None]) & (others < own[:, None])
        kept = np.concatenate((kept, own[over.sum(1) < k]))
    return order[kept]


def _bucket(rows: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """One bucket of terms of a language against the totals of its sources."""
    groups = groups.sort_by("source")
    sources, lang = groups["source"].combine_chunks(), groups["lang"][0].as_py()
    totals = groups["words"].to_numpy() + groups["kept"].to_numpy()
    lang_total = groups["lang_words"][0].as_py() + groups["kept"][0].as_py()
    rows = rows.append_column("bytes", rows["term"].cast(pa.binary())).sort_by("bytes").combine_chunks()
    term = np.unique(rows["bytes"].to_numpy(zero_copy_only=False), return_inverse=True)[1] if len(rows) else np.zeros(0, int)
    source = pc.index_in(rows["source"], sources).to_numpy(zero_copy_only=False).astype(int)
    count, lang_count = rows["count"].to_numpy(), rows["lang_count"].to_numpy()

    n = len(sources)
    a, b = np.divmod(np.arange(n * n), n)
    other = a != b
    sums = pair_sums(source, term, count, totals).ravel()
    parts = [(a[other], sources.take(pa.array(b[other])), sums[other], "pair")]
    if len(rows):
        p, q = scaled(count, totals[source]), scaled(lang_count, lang_total)
        for s in range(n):
            at = np.flatnonzero((source == s) & (p > q))
            at = at[skyband(count[at], lang_count[at], term[at], top)]
            parts.append((source[at], rows["term"].combine_chunks().take(pa.array(at)), excess(p[at], q[at]), "term"))
    return pa.concat_tables([pa.table({
        "lang": pa.array([lang] * len(of), pa.string()), "source": sources.take(pa.array(of, pa.int64())),
        "part": pa.array([part] * len(of), pa.string()), "item": item.cast(pa.string()),
        "value": pa.array(value, pa.int64())}) for of, item, value, part in parts])


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP, rows: int = ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by how far they differ
    (``pair``), and the first ``top`` terms that a source has more of than its language (``term``)."""
    kept = kept_terms(documents, least)
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("words"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_words"), F.count_if("first").alias("kept"))
    terms = kept.where(F.col("term").isNotNull())
    buckets = max(1, -(-terms.count() // rows))
    dealt = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    # aliases make columns of their own, which the cogroup needs
    met = totals.join(langs, "lang").select(*(F.col(c).alias(c) for c in (
        "lang", "source", "words", "lang_words", "kept")), every.alias("bucket"))

    def work(own: pa.Table, groups: pa.Table) -> pa.Table:
        return _bucket(own, groups, top)

    folder = fresh_folder(documents.sparkSession, "divergence")
    dealt.groupBy("lang", "bucket").cogroup(met.groupBy("lang", "bucket")).applyInArrow(
        work, "lang string, source string, part string, item string, value long").write.parquet(folder)
    found = documents.sparkSession.read.parquet(folder)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    first = found.where(F.col("part") == "term").withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(first)

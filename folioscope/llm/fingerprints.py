"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The weighted terms of a text are its word shingles with their counts. A fingerprint is ``SAMPLES`` independent
samples; each is the term that comes first in Ioffe's consistent weighted sampling over all terms of the text:
with gamma variables r and c and a uniform beta drawn from hashes of (term, sample), and
t = floor(ln(weight) / r + beta), the term of least a = c exp(-r (t - beta + 1)) is sampled together with its t.
Samples of two texts agree with a probability equal to the generalised Jaccard similarity, the sum of the
lesser weights over the sum of the greater ones, so the share that agrees is an unbiased estimate of it with
a standard deviation of at most 1 / (2 sqrt(SAMPLES)).

The variables are drawn as parts of each other, which leaves their laws as they are: c = f1 + f2 for exponential f1
and f2; -ln(f1 / c), which is exponential and independent of c, is the part r (1 - beta) of r, and a third
exponential variable is r beta. A term of weight 1 has t = 0 and a = f1, so it needs one hash and no logarithm;
samples order by exp(-a), which for such a term is the uniform number from its hash.

Defined results: a text without words has an empty fingerprint, which agrees with itself alone; a text
of fewer words than a shingle is one term; null texts are empty ones; equal texts have equal fingerprints; texts
of any length are taken whole, their terms counted in one task; other columns are ignored; repeated rows and
ties are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.decontaminate import words
from folioscope.session import cut_lineage, fresh_folder

SIZE, SAMPLES = 5, 64
#: Characters of text in a partition, whose terms are counted in memory; beyond ``MOST_PARTITIONS`` partitions
#: they grow and the count spills.
PARTITION_CHARS, MOST_PARTITIONS = 1 << 20, 100_000
#: Bits of a uniform number; one more would round half a step up to 1.
_BITS = 52


def uniform(term: str, number: str | int) -> str:
    """SQL for what a term of weight 1 offers as a sample: exp(-a) as a whole number of 52 bits."""
    return f"shiftrightunsigned(xxhash64({term}, {number}, 0), {64 - _BITS})"


def sampled(rows: DataFrame) -> DataFrame:
    """Adds ``drawn`` to rows of (term, weight, number): exp(-a) of the term's t for a weight above 0, as a whole
    number of 52 bits, of which the greatest is taken. Equal (term, t) have equal values, others differ but for
    chance. Steps are columns of their own, so that each is computed once."""
    def exponential(salt: int) -> str:
        return f"-ln((shiftrightunsigned(xxhash64(term, number, {salt}), {64 - _BITS}) + 0.5D) * {2.0 ** -_BITS!r}D)"

    # a negative number stands for a row that needs no steps
    steps = {"f1": f"CASE WHEN number >= 0 THEN {exponential(0)} END", "f2": f"CASE WHEN number >= 0 THEN {exponential(1)} END",
             "rest": f"CASE WHEN number >= 0 THEN {exponential(2)} END", "c": "f1 + f2", "r": "ln(c / f1) + rest",
             "beta": "rest / r", "t": "CASE WHEN number >= 0 THEN floor(ln(cast(weight AS double)) / r + beta) END",
             "drawn": f"CASE WHEN t = 0 THEN {uniform('term', 'number')}"
                      f" WHEN t > 0 THEN cast(exp(-c * exp(-r * (t - beta + 1))) * {2.0 ** _BITS!r}D AS bigint) END"}
    made = rows
    for name, step in steps.items():
        made = made.withColumn(f"_{name}", F.expr(re.sub(r"\b(f1|f2|rest|c|r|beta|t)\b", r"_\1", step)))
    return made.withColumnRenamed("_drawn", "drawn").drop(*(f"_{name}" for name in steps))


def fingerprints(frame: DataFrame, keys: list[str], texts: tuple[str, str], size: int = SIZE,
                 samples: int = SAMPLES) -> DataFrame:
    """keys and, for each of two text columns, an array of ``samples`` samples under its name, 16 bits each. A
    frame that is partitioned by some of its keys isn't shuffled. Samples of a text without words are all -1."""
    def terms(i: int) -> Column:
        w, n = F.col(f"_words{i}"), F.size(f"_words{i}")
        return F.when(n > 0, F.arrays_zip(
            F.array_repeat(F.lit(i), n).alias("which"), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("at"),
            w.alias("w0"), *(F.slice(w, F.lit(k + 1), F.greatest(n, F.lit(1))).alias(f"w{k}")
                             for k in range(1, size)))).otherwise(F.array())

    names = [f"w{k}" for k in range(size)]
    # words become numbers before they are lined up, so the many rows that follow hold no strings
    taken = frame.select(*keys, *(F.transform(words(F.col(t)), lambda w: F.xxhash64(w)).alias(f"_words{i}")
                                  for i, t in enumerate(texts)))
    # keys without any words stay as one row of nulls, which offers nothing
    rows = taken.select(*keys, F.inline_outer(F.concat(*(terms(i) for i in range(2)))).alias("which", "at", *names))
    rows = rows.where(F.col(names[-1]).isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    counted = rows.select(*keys, "which", F.xxhash64(*names).alias("term")).groupBy(*keys, "term").agg(
        *(F.sum((F.col("which") == i).cast("int")).alias(f"n{i}") for i in range(2)))

    # Each row is (which text, sample): 2 stands for both texts, where a term has equal weight in both, as most have.
    # A term of weight 1 stays one row for all samples, by the last number; others are a row for each sample.
    def offers(of: int, weight: str) -> str:
        low = of * (samples + 1)
        return (f"CASE WHEN {weight} = 1 THEN array({low + samples}) WHEN {weight} > 1 THEN"
                f" sequence({low}, {low + samples - 1}) ELSE cast(array() AS array<int>) END")

    offered = counted.select(*keys, "term", "n0", "n1", F.expr(
        f"explode_outer(CASE WHEN n0 = n1 THEN {offers(2, 'n0')} WHEN n1 = 0 THEN {offers(0, 'n0')}"
        f" WHEN n0 = 0 THEN {offers(1, 'n1')} ELSE concat({offers(0, 'n0')}, {offers(1, 'n1')}) END) AS offer"))
    weighted = offered.select(*keys, "term", F.expr(f"offer div {samples + 1} AS of"), F.expr(
        f"CASE WHEN offer % {samples + 1} = {samples} THEN -1 ELSE offer % {samples + 1} END AS number"), "n0", "n1").select(
        *keys, "term", "of", "number", F.expr("CASE WHEN of = 1 THEN n1 ELSE n0 END AS weight"))
    numbers = range(samples)
    drawn = sampled(weighted).groupBy(*keys, "of").agg(*(F.expr(
        f"max(CASE WHEN number = -1 THEN {uniform('term', k)} WHEN number = {k} THEN drawn END) AS s{k}") for k in numbers))
    best = drawn.groupBy(*keys).agg(*(F.expr(f"max(CASE WHEN of <> {1 - i} THEN s{k} END) AS s{i}_{k}")
                                      for i in range(2) for k in numbers))

    def shown(i: int, k: int) -> Column:
        return F.expr(f"CASE WHEN s{i}_{k} IS NULL THEN -1 ELSE cast(xxhash64(s{i}_{k}) & 65535 AS int) END")

    return best.select(*keys, *(F.array(*(shown(i, k) for k in numbers)).alias(text) for i, text in enumerate(texts)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the samples that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def packed(values: Column) -> Column:
    """Samples of 16 bits, four in a long; null where there are none, as in a text without words."""
    def lane(i: Column, k: int) -> Column:
        return F.call_function("shiftleft", F.get(values, i * 4 + k).cast("long"), F.lit(48 - 16 * k))

    whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 4).cast("int") - 1), lambda i: lane(i, 0).bitwiseOR(
        lane(i, 1)).bitwiseOR(lane(i, 2)).bitwiseOR(lane(i, 3)))
    return F.when(F.get(values, F.lit(0)) >= 0, whole)


def unpacked(longs: Column, samples: int) -> Column:
    """The samples as they were; -1 for those of a text without words."""
    lanes = F.flatten(F.transform(longs, lambda x: F.array(*(
        F.shiftrightunsigned(x, 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(4)))))
    return F.coalesce(lanes, F.array_repeat(F.lit(-1), samples))


def in_order(documents: DataFrame) -> DataFrame:
    """(id, digest, n_chars, copies, next_id, next_digest): documents by ascending doc_id, each with the one
    after it; the first comes after the last. Rows of equal id and text are one document."""
    seen = documents.groupBy("id", "digest", "doc_id").agg(
        F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranged = cut_lineage(seen.repartitionByRange("doc_id", "digest").withColumn("part", F.spark_partition_id()))
    own = F.struct("doc_id", "digest", "id")
    edges = ranged.groupBy("part").agg(F.min(own).alias("first"))
    # one row for each partition
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = edges.select("part", F.coalesce(F.lead("first").over(every), F.first("first").over(whole)).alias("across"))
    inside = Window.partitionBy("part").orderBy("doc_id", "digest")
    after = F.coalesce(F.col("inside"), F.col("across"))
    return ranged.withColumn("inside", F.lead(own).over(inside)).join(following, "part").select(
        "doc_id", "id", "digest", "n_chars", "copies", after["id"].alias("next_id"),
        after["digest"].alias("next_digest"))


def edited_likeness(documents: DataFrame, size: int = SIZE, samples: int = SAMPLES) -> DataFrame:
    """Every document against its edited text, the last quarter replaced by the head of the next document,
    and against the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Texts are shuffled once; heads travel already cut."""
    if samples % 4:
        raise ValueError("samples are stored in fours")
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("digest"),
        "doc_id", text.alias("text"))
    order = cut_lineage(in_order(keyed.select("id", "digest", "doc_id", F.char_length("text").cast("long").alias("n_chars"))))
    keys = ["id", "digest"]
    chars = order.agg(F.sum("n_chars")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, chars // PARTITION_CHARS))
    texts = keyed.select(*keys, "text").repartition(parts, *keys).dropDuplicates(keys)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    asked = order.select(F.col("next_id").alias("id"), F.col("next_digest").alias("digest"),
                         F.col("id").alias("to_id"), F.col("digest").alias("to_digest"), quarter.alias("quarter"))
    heads = texts.join(asked, keys).select(F.col("to_id").alias("id"), F.col("to_digest").alias("digest"),
                                           F.substring("text", F.lit(1), F.col("quarter")).alias("head"))
    both = texts.join(order.select(*keys, "n_chars"), keys).join(heads, keys).select(*keys, "text", F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), "head").alias("edited"))
    # the checksum goes with the keys, so that texts are sorted, joined and edited once for it and the samples; as
    # numbers, as the keys of many terms hold it
    checksum = [f"sha{i}" for i in range(4)]
    summed = both.withColumn("sha", F.sha2("edited", 256)).select(*keys, "text", "edited", *(F.conv(
        F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long").alias(name) for i, name in enumerate(checksum)))
    found = fingerprints(summed, [*keys, *checksum], ("text", "edited"), size, samples)
    folder = fresh_folder(spark, "fingerprints")
    found.select(
        *keys, F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in checksum)).alias("edited_sha256"),
        packed(F.col("text")).alias("own"), packed(F.col("edited")).alias("edited"),
    ).join(order, keys).write.parquet(folder)
    stored = spark.read.parquet(folder)
    after = stored.select(F.col("id").alias("next_id"), F.col("digest").alias("next_digest"), F.col("own").alias("after"))

    def shown(samples: str) -> Column:
        return F.array_join(F.transform(samples, lambda x: F.when(x < 0, "").otherwise(
            F.lpad(F.lower(F.hex(x)), 4, "0"))), "")

    joined = stored.join(after, ["next_id", "next_digest"])
    return joined.withColumns({c: unpacked(F.col(c), samples) for c in ("own", "edited", "after")}).select(
        "doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"),
        shown("edited").alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")

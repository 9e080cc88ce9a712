"""The registered queries of these operations: each whole table through its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, divergence, fingerprints, licenses, mixing, near_duplicates, packing
from folioscope.llm import periodic, quality, repeats, tokens, toxicity, warc
from folioscope.llm.training import labelled_sample, remainder
from folioscope.session import fresh_folder, ship_package


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(labelled_sample(
        documents, table(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 3) != 1,
        quality.PER_CLASS))
    return quality.score(documents, model).withColumn(
        "held_out", remainder(F.col("doc_id"), 3) == 1)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(documents, tokens.share_vocabulary(spark, vocabulary_path()))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document: a fiftieth is deleted from its first third on, its first forty
    characters are repeated at the middle, and its last twentieth gives way to a mark."""
    documents = table(spark, sf_dir, "documents")
    vocabulary = tokens.share_vocabulary(spark, vocabulary_path())
    n = F.char_length(F.coalesce("text", F.lit("")))
    third, cut, middle = F.floor(n / 3), F.floor(n / 50), F.floor(n / 2)
    size = n - cut + F.least(n, F.lit(40))

    def edit(start: Column, stop: Column, text: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), text.alias("text"))

    edits = F.array(
        edit(third, third + cut, F.lit("")), edit(middle, middle, F.substring("text", 1, 40)),
        edit(size - F.floor(n / 20), size, F.lit(" [cut]")))
    trees = tokens.build_trees(documents.withColumn("edits", edits), vocabulary, keep=("edits",))
    return tokens.recount(trees, vocabulary)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar(table(spark, sf_dir, "documents")).drop("digest", "root")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    index = licenses.build_index(*licenses.document_frequencies(documents))
    return licenses.scan(documents, index)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("text", "rest")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(labelled_sample(
        documents, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 5) != 0,
        toxicity.PER_CLASS))
    return toxicity.score(documents, lexicon).withColumn(
        "held_out", remainder(F.col("doc_id"), 5) == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "digest")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), periodic.planted)
    runs = F.col("runs")
    # the order of structs: greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    shown = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"), F.when(F.size(runs) > 0, F.concat(
        shown, F.lit("\n"))).otherwise("").alias("shown"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.finer")).alias("period"),
        F.expr("(1000 * best.length) div (-best.finer)").alias("exponent_milli"),
        F.sha2("shown", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_packing": op2_packing,
            "op3_token_counts": op3_token_counts, "op4_fingerprints": op4_fingerprints,
            "op5_ngram_join": op5_ngram_join,
            "op6_licenses": op6_licenses,
            "op7_warc": op7_warc,
            "op8_repeats": op8_repeats, "op9_toxicity": op9_toxicity, "op10_decontaminate": op10_decontaminate,
            "op11_periodic_runs": op11_periodic_runs, "op12_divergence": op12_divergence, "op13_mixing": op13_mixing}


def oracle_sql() -> dict[str, str]:
    from folioscope.llm import sql

    return sql.SQL

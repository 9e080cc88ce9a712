"""The driver tables as the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import dense
from folioscope.plans.index import Index, index_chunks, materialize, open_index
from folioscope.session import fresh_folder, only, ship_package, spread, stored

EXTENSIONS = ("md", "py", "java", "txt", "html")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: ten neighbours form one file."""
    number = F.floor(F.col("doc_id") / 10)
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (number % 5 + 1).cast("int"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    start = (F.col("doc_id") % 10 * 1000 + 1).cast("int")
    named = texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("chunk_id"), extension.alias("extension"),
        F.concat(number.cast("string"), F.lit("."), extension).alias("file_name"),
        F.floor(F.col("doc_id") / 1000).cast("string").alias("folder"),
        start.alias("start_line"), (start + lines - 1).cast("int").alias("end_line"),
        F.col("text").alias("content"))
    return named.select(
        "chunk_id", F.concat(F.lit("/corpus/"), "folder", F.lit("/"), "file_name").alias("path"),
        F.lit("/corpus").alias("root"), "file_name", "extension", "start_line", "end_line",
        F.concat(F.lit("L"), F.col("start_line").cast("string"), F.when(
            F.col("end_line") == F.col("start_line"), "").otherwise(F.concat(
                F.lit("-"), F.col("end_line").cast("string")))).alias("source_location"),
        "content", F.lit(0).cast("long").alias("modified_at"))


_indexes: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The corpus as a stored index. It is built once per application; searches read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        folder = fresh_folder(spark, "index")
        built = build(spark, sf_dir)
        materialize(built, folder)
        _indexes[key] = folder
    return open_index(spark, _indexes[key])


def build(spark: SparkSession, sf_dir: str) -> Index:
    return index_chunks(dense.with_vectors(corpus(spark, sf_dir), F.col("content")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def documents(spark: SparkSession, sf_dir: str, extension: str = "md") -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(f".{extension}"))
    return texts(spark, sf_dir).select(
        F.concat(F.lit("/corpus\u0000"), name).alias("document_id"),
        F.concat(F.lit("/corpus/"), name).alias("path"), F.lit("/corpus").alias("root"),
        name.alias("file_name"), F.lit(extension).alias("extension"),
        F.lit(0).cast("long").alias("modified_at"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file listing with every kind of name a scan has to tell apart."""
    tail = F.element_at(F.array(*map(F.lit, (
        ".md", ".py", ".HTML", ".png", ".key", "", ".tar.gz", "/.env.local"))),
        (F.col("doc_id") % 8 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, (
        "src", "docs/a", "Node_Modules/x", ".ssh", "src/deep", "build", "lib", "docs/b/c"))),
        (F.floor(F.col("doc_id") / 8) % 8 + 1).cast("int"))
    stem = F.when(F.col("doc_id") % 8 == 5, "Makefile").otherwise(
        F.col("doc_id").cast("string"))
    parts = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("/"), "source").alias("root"), "doc_id", "text",
        F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), stem, tail)
        .alias("rel_path"),
        (F.col("n_chars") * 200).alias("size"), (F.col("doc_id") * 1000).alias("modified_at"))
    return parts.withColumn("path", F.concat_ws("/", "root", "rel_path"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items asked as several questions: their full stops become question marks."""
    return asked(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\. ?", "? "))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as evaluation cases.

    What counts as found is derived from the corpus: the files whose text holds an item word for
    word. Items are matched through their words' postings first, so that only chunks that hold all
    words of an item are compared with it.
    """
    items = load(spark, sf_dir, "benchmark")
    found = contained(spark, sf_dir)
    per_item = found.groupBy("item_id").agg(
        F.sort_array(F.collect_set("file_name")).alias("expected_documents"))
    return items.join(per_item, "item_id", "left").select(
        F.col("item_id").alias("case_id"), F.col("text").alias("query"),
        F.lit("en").alias("language"),
        F.when(F.length("text") < 200, "short").otherwise("long").alias("category"),
        F.lit("test").alias("split"),
        F.col("expected_documents").isNotNull().alias("answerable"),
        F.coalesce("expected_documents", F.array().cast("array<string>"))
        .alias("expected_documents"),
        F.array("text").alias("expected_passages"),
        F.array(F.concat((F.col("item_id") % 7).cast("string"), F.lit(".md")))
        .alias("must_not_return"),
        F.array(F.concat((F.col("item_id") % 11).cast("string"), F.lit(".py")))
        .alias("hard_negatives"))


#: Code points of an item with fewer than three words that chunks are looked up by.
GRAM = 8


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, chunk_id, file_name) for items whose text stands word for word in a chunk.

    A chunk that holds an item holds the item's longest inner word as a whole word; that word is the join
    key. The first and last word of an item may be parts of longer words in the chunk, so an item without
    inner words is looked up by its first characters, wherever they stand. An empty item stands in every
    chunk, a null one in none.
    """
    words = F.regexp_extract_all("text", F.lit(r"\w+"), 0)
    keyed = (load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"),
                                                     words.alias("w"))
             # The inner words of the item stand as whole words in the chunk, too.
             .withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
             .withColumn("word", F.array_max(F.transform("w", lambda w: F.struct(
                 F.length(w).alias("n"), w.alias("word"))))["word"]))
    chunks = corpus(spark, sf_dir)
    held = chunks.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(
        "content", F.lit(r"\w+"), 0))).alias("word"))
    near = held.join(keyed.select("item_id", "item", "word"), "word").select(
        "chunk_id", "item_id", "item")
    short = keyed.where(F.col("word").isNull() & F.col("item").isNotNull()).select(
        "item_id", "item", F.substring("item", 1, GRAM).alias("gram"))
    # At most GRAM + 1 lengths; none where every item has inner words.
    for row in short.select(F.length("gram").alias("n")).distinct().collect():
        grams = F.array_distinct(F.regexp_extract_all("content", F.lit(f"(?s)(?=(.{{{row.n}}}))"), 1))
        found = chunks.select("chunk_id", F.explode(grams).alias("gram")).join(
            short.where(F.length("gram") == row.n), "gram")
        near = near.unionByName(found.select("chunk_id", "item_id", "item"))
    near = stored(near, "near")
    return near.join(only(chunks.select("chunk_id", "file_name", "content"), near, "chunk_id"), "chunk_id").where(
        F.contains("content", "item")).select("item_id", "chunk_id", "file_name")


def conversation_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").withColumn(
        "source_revision", F.floor(F.col("turn") / 4).cast("long"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for column in columns:
        frame = frame.withColumn(column, F.round(F.col(column), digits))
    return frame



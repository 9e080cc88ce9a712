"""Items that stand word for word in a chunk, and folders that a walk meets first, against plain statements."""

import os

import pandas as pd
from pyspark.sql import functions as F

from folioscope.catalog import tables
from folioscope.config import ScanRules
from folioscope.sources import scan

TEXTS = ["one two three four", "xfoo bary\nfoo bar", "a?!b", "", None, "naïve 中文 text\U0001F600 end", "foo", "three four five six",
         "... ,, 12345678 9", "12345678", "long" * 3000 + " tail foo b"]
ITEMS = ["foo", "foo bar", "o b", "?!", "", None, "中文", "中", "\U0001F600 end", "12345678 9", "12345678", "one two three four", "two three four",
         "absent", "y\nf", "gl", "ta", "four", " ", "tail foo b"]


def test_items_of_any_length_are_found(spark, tmp_path):
    pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": range(len(ITEMS)), "text": ITEMS}).to_parquet(tmp_path / "benchmark.parquet")
    got = sorted((r["item_id"], r["chunk_id"]) for r in tables.contained(spark, os.fspath(tmp_path)).collect())
    want = sorted((i, str(d)) for i, item in enumerate(ITEMS) for d, text in enumerate(TEXTS)
                  if item is not None and text is not None and item in text)
    assert got == want


def test_the_outermost_directory_decides(spark):
    wants = {"a/b.md": "ACCEPTED", "build/.ssh/b.md": "IGNORED", ".ssh/build/b.md": "SENSITIVE_DIRECTORY", "x/.AWS/y/Target/b.md": "SENSITIVE_DIRECTORY",
             "x/target/b.md": "IGNORED", ".ssh/b.md": "SENSITIVE_DIRECTORY", "build": "UNSUPPORTED"}
    files = spark.createDataFrame([("/r", p, f"/r/{p}", 1) for p in wants], "root string, rel_path string, path string, size long")
    registry = scan.reader_registry(spark)
    found = {r["rel_path"]: r["verdict"] for r in scan.classify(files, registry).collect()}
    assert found == wants
    open_to_all = scan.classify(files, registry, ScanRules(skip_sensitive=False)).where(F.col("rel_path").contains("b.md"))
    assert {r["rel_path"]: r["verdict"] for r in open_to_all.collect()} == {
        p: "IGNORED" if "build/" in p or "arget/" in p else "ACCEPTED" for p in wants if p.endswith("b.md")}

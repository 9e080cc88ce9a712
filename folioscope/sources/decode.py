"""Bytes to text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed, text as tx

SNIFFED_CHARS = 2048


def decoded(content: Column) -> Column:
    """Text of a file: by byte-order mark, else strict UTF-8, else ISO-8859-1."""
    def starts(mark: str) -> Column:
        size = len(mark) // 2
        return F.substring(content, 1, size) == F.to_binary(F.lit(mark), F.lit("hex"))

    def rest(skip: int) -> Column:
        return F.substring(content, F.lit(skip + 1), F.length(content))

    return (F.when(starts("EFBBBF"), F.decode(rest(3), "UTF-8"))
            .when(starts("FFFE"), F.decode(rest(2), "UTF-16LE"))
            .when(starts("FEFF"), F.decode(rest(2), "UTF-16BE"))
            .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
            .otherwise(F.decode(content, "ISO-8859-1")))


def looks_binary(text: Column) -> Column:
    """A NUL in the first characters, or more than a twentieth of them control characters. The
    sniffed head is the rule, not a shortcut."""
    head = F.substring(text, 1, SNIFFED_CHARS)
    controls = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F]", ""))
    return F.contains(head, F.lit("\u0000")) | (controls > F.floor(F.length(head) / 20))


def document_id(root: Column, rel_path: Column) -> Column:
    return F.concat(root, F.lit(fixed.IDENTITY_SEPARATOR), F.translate(rel_path, "\\", "/"))


def text_documents(files: DataFrame) -> DataFrame:
    """Readable text files (root, path, rel_path, modified_at, content) as documents."""
    name = tx.file_name(F.col("rel_path"))
    return (files.withColumn("text", decoded(F.col("content")))
            .where(~tx.is_blank(F.col("text")) & ~looks_binary(F.col("text")))
            .select(document_id(F.col("root"), F.col("rel_path")).alias("document_id"), "path",
                    "root", name.alias("file_name"),
                    tx.file_extension(name, "text").alias("extension"), "modified_at", "text"))

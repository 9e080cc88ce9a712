"""Cutting sections of source-addressed units into chunks.

A section row holds its units as an array, so cutting needs no shuffle: one fold over the array
decides the cuts and one transform builds the chunks, both as built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.config import ChunkRules
from folioscope.functions import fixed, text as tx

SECTION_COLUMNS = ("document_id", "path", "root", "file_name", "extension", "modified_at",
                   "section_id", "location_label", "range_label", "units")

_CUT = "struct<first:int,last:int,label:string>"
_STATE = f"struct<start:int,tokens:int,label:string,cuts:array<{_CUT}>>"


def line_units(text: Column) -> Column:
    """Lines with 1-based numbers and stripped ends; nothing for a blank text."""
    lines = F.split(tx.unify_newlines(text), "\n", -1)
    numbered = F.transform(lines, lambda line, i: F.struct(
        (i + 1).alias("number"), tx.strip_end(line).alias("text")))
    return F.when(tx.is_blank(text),
                  F.array().cast("array<struct<number:int,text:string>>")).otherwise(numbered)


def text_sections(documents: DataFrame) -> DataFrame:
    """One section per plain-text document."""
    return documents.select(
        "document_id", "path", "root", "file_name", "extension", "modified_at",
        F.lit("text").alias("section_id"), F.lit("").alias("location_label"),
        F.lit("L").alias("range_label"), line_units(F.col("text")).alias("units"))


def source_location(location_label: Column, range_label: Column, first: Column,
                    last: Column) -> Column:
    numbers = F.concat(range_label, first.cast("string"),
                       F.when(last == first, F.lit("")).otherwise(
                           F.concat(F.lit("-"), last.cast("string"))))
    return F.when(location_label == "", numbers).otherwise(
        F.concat_ws(fixed.LOCATION_SEPARATOR, location_label, numbers))


def chunk_id(document_id: Column, section_id: Column, location: Column, content: Column) -> Column:
    return F.sha1(F.concat_ws(":", document_id, section_id, location, content))


def declaration_symbol(line: Column) -> Column:
    """Name a code line declares, or null."""
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))

    method = F.when(F.contains(line, F.lit("(")), found(fixed.METHOD_PATTERN))
    return F.coalesce(found(fixed.DECLARATION_PATTERN), found(fixed.ARROW_PATTERN),
                      F.when(~method.isin(*fixed.NOT_A_METHOD), method))


def leads_declaration(line: Column) -> Column:
    """Comment, annotation, quote or blank line, which belongs to the declaration below it."""
    stripped = tx.strip(line)
    marks = stripped == ""
    for mark in fixed.LEADING_MARKS:
        marks = marks | stripped.startswith(mark)
    return marks


def with_range_marks(sections: DataFrame) -> DataFrame:
    """Adds ``marks``: per unit, the label of the code range that starts there, or null.

    Symbols and leading lines are columns of their own, so each line is matched once.
    """
    symbols, leads = F.col("symbols"), F.col("leads")

    def lines_above(i: Column) -> Column:
        # How many of the up to four lines right above belong to the declaration at i.
        count, unbroken = F.lit(0), F.lit(True)
        for distance in range(1, fixed.MAX_LEADING_LINES + 1):
            unbroken = unbroken & F.coalesce(F.get(leads, i - distance), F.lit(False))
            count = count + unbroken.cast("int")
        return count

    def starts_here(i: Column) -> Column:
        return F.coalesce(*[F.when(F.get(F.col("above"), i + d) == d, F.get(symbols, i + d))
                            for d in range(fixed.MAX_LEADING_LINES + 1)])

    first_mark = F.lit(fixed.FILE_HEAD_SYMBOL)
    return (sections
            .withColumn("symbols", F.transform("units", lambda u: declaration_symbol(u["text"])))
            .withColumn("leads", F.transform("units", lambda u: leads_declaration(u["text"])))
            .withColumn("above", F.transform("symbols", lambda s, i: F.when(
                s.isNotNull(), lines_above(i))))
            .withColumn("marks", F.when(
                F.exists("symbols", lambda s: s.isNotNull()),
                F.transform("units", lambda _, i: F.concat(
                    F.lit(fixed.SYMBOL_PREFIX),
                    F.coalesce(starts_here(i), F.when(i == 0, first_mark)))))
                .otherwise(F.transform("units", lambda _: F.lit(None).cast("string"))))
            .drop("symbols", "leads", "above"))


def _empty_state() -> Column:
    return F.struct(F.lit(0).alias("start"), F.lit(0).alias("tokens"), F.lit("").alias("label"),
                    F.array().cast(f"array<{_CUT}>").alias("cuts")).cast(_STATE)


def _state(start: Column, tokens: Column, label: Column, cuts: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), tokens.cast("int").alias("tokens"),
                    label.alias("label"), cuts.alias("cuts"))


def _cut(first: Column, last: Column, label: Column) -> Column:
    return F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"),
                            label.alias("label")))


def _walk(tokens: Column, target: int) -> Column:
    """How many leading elements it takes to reach the target, and their sum."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    return F.aggregate(tokens, zero, lambda seen, t: F.when(seen["sum"] >= target, seen).otherwise(
        F.struct((seen["n"] + 1).alias("n"), (seen["sum"] + t).alias("sum"))))


def _walk_back(tokens: Column, i: Column, target: int) -> Column:
    """As ``_walk``, from element i backwards. A unit costs at least one token, so no more than
    ``target`` elements can be needed."""
    first = F.greatest(i - (target - 1), F.lit(0))
    return _walk(F.reverse(F.slice(tokens, first + 1, i - first + 1)), target)


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prose_cuts(items: Column, tokens: Column, rules: ChunkRules) -> Column:
    """Cuts at a blank unit once the minimum is reached, or anywhere once the target is; after a
    cut at the target the next chunk starts some units earlier."""
    def step(state: Column, item: Column) -> Column:
        i, total = item["i"], state["tokens"] + item["tokens"]
        nothing = F.lit("")

        def after_full(back: Column) -> Column:
            earlier = i + 1 - back["n"]
            overlaps = (back["sum"] >= rules.prose_overlap) & (earlier > state["start"])
            return _state(F.when(overlaps, earlier).otherwise(i + 1),
                          F.when(overlaps, back["sum"]).otherwise(0), nothing,
                          F.concat(state["cuts"], _cut(state["start"], i + 1, nothing)))

        return (F.when(total >= rules.prose_target,
                       _let(_walk_back(tokens, i, rules.prose_overlap), after_full))
                .when(item["blank"] & (total >= rules.prose_minimum),
                      _state(i + 1, F.lit(0), nothing,
                             F.concat(state["cuts"], _cut(state["start"], i + 1, nothing))))
                .otherwise(_state(state["start"], total, nothing, state["cuts"])))

    count = F.size(items)
    return F.aggregate(
        items, _empty_state(), step,
        lambda end: F.when(end["start"] < count, F.concat(
            end["cuts"], _cut(end["start"], count, F.lit("")))).otherwise(end["cuts"]))


def code_cuts(items: Column, tokens: Column, rules: ChunkRules) -> Column:
    """Token windows inside each code range; a range's last unit always closes its window."""
    target, overlap = rules.code_target, rules.code_overlap

    def step(state: Column, item: Column) -> Column:
        i = item["i"]
        label = F.coalesce(item["mark"], state["label"])
        total = state["tokens"] + item["tokens"]

        def grown() -> Column:
            return F.concat(state["cuts"], _cut(state["start"], i + 1, label))

        def after_full(back: Column) -> Column:
            earlier = i + 1 - back["n"]
            overlaps = (back["sum"] >= overlap) & (earlier > state["start"])

            # When the repeated units alone fill a window, that window is cut at once.
            def after_refill(refill: Column) -> Column:
                end = earlier + refill["n"]
                return _state(end, back["sum"] - refill["sum"], label,
                              F.concat(grown(), _cut(earlier, end, label)))

            return (F.when(overlaps & (back["sum"] >= target),
                           _let(_walk(F.slice(tokens, earlier + 1, back["n"]), target),
                                after_refill))
                    .otherwise(_state(F.when(overlaps, earlier).otherwise(i + 1),
                                      F.when(overlaps, back["sum"]).otherwise(0), label,
                                      grown())))

        return (F.when(item["closes"], _state(i + 1, F.lit(0), F.lit(""), grown()))
                .when(total >= target, _let(_walk_back(tokens, i, overlap), after_full))
                .otherwise(_state(state["start"], total, label, state["cuts"])))

    return F.aggregate(items, _empty_state(), step, lambda end: end["cuts"])


def _items(units: Column, marks: Column | None) -> Column:
    """Units reduced to what the folds look at."""
    last = F.size(units) - 1

    def item(unit: Column, i: Column) -> Column:
        fields = [i.alias("i"), tx.chunk_tokens(unit["text"]).alias("tokens"),
                  tx.is_blank(unit["text"]).alias("blank")]
        if marks is not None:
            fields += [F.get(marks, i).alias("mark"),
                       ((i == last) | F.get(marks, i + 1).isNotNull()).alias("closes")]
        return F.struct(*fields)

    return F.transform(units, item)


def _built_chunks(sections: DataFrame, rules: ChunkRules) -> DataFrame:
    """Turns each section's cuts into rows."""
    units, items = F.col("units"), F.col("items")

    def build(cut: Column, number: Column) -> Column:
        filled = F.filter(F.slice(items, cut["first"] + 1, cut["last"] - cut["first"]),
                          lambda item: ~item["blank"])

        def from_to(edge: Column) -> Column:
            content = tx.strip(F.array_join(F.transform(
                F.slice(units, edge["a"] + 1, edge["b"] - edge["a"] + 1),
                lambda u: u["text"]), "\n"))
            return F.struct(
                number.alias("cut_no"),
                F.get(units, edge["a"])["number"].alias("start_line"),
                F.get(units, edge["b"])["number"].alias("end_line"),
                cut["label"].alias("label"), content.alias("content"))

        return _let(filled, lambda kept: F.when(F.size(kept) > 0, _let(F.struct(
            F.get(kept, F.lit(0))["i"].alias("a"),
            F.get(kept, F.size(kept) - 1)["i"].alias("b")), from_to)))

    kept = ["document_id", "path", "root", "file_name", "extension", "modified_at",
            "section_id", "location_label", "range_label"]
    # The outer form: a plain inline makes the optimizer infer a "not empty" filter, push it below
    # the arrays it is computed from, and evaluate all of them a second time.
    rows = (sections.withColumn("built", F.filter(F.transform("cuts", build),
                                                  lambda chunk: chunk.isNotNull()))
            .select(*kept, F.inline_outer("built"))
            .where(F.length("content") >= rules.minimum_chars))
    plain = source_location(F.col("location_label"), F.col("range_label"), F.col("start_line"),
                            F.col("end_line"))
    located = rows.withColumn("source_location", F.when(F.col("label") == "", plain).otherwise(
        F.concat_ws(fixed.LOCATION_SEPARATOR, F.col("label"), plain)))
    return located.select(
        chunk_id(F.col("document_id"), F.col("section_id"), F.col("source_location"),
                 F.col("content")).alias("chunk_id"),
        "document_id", "path", "root", "file_name", "extension", "section_id", "cut_no",
        "start_line", "end_line", "source_location", "content", "modified_at")


def _with_tokens(sections: DataFrame) -> DataFrame:
    return sections.withColumn("unit_tokens", F.transform("items", lambda item: item["tokens"]))


def prose_chunks(sections: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    prepared = _with_tokens(sections.withColumn("items", _items(F.col("units"), None)))
    cut = prepared.withColumn("cuts", prose_cuts(F.col("items"), F.col("unit_tokens"), rules))
    return _built_chunks(cut, rules)


def code_chunks(sections: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    marked = with_range_marks(sections)
    prepared = _with_tokens(marked.withColumn("items", _items(F.col("units"), F.col("marks"))))
    cut = prepared.withColumn("cuts", code_cuts(F.col("items"), F.col("unit_tokens"), rules))
    return _built_chunks(cut, rules)


def is_code(extension: Column) -> Column:
    return F.lower(extension).isin(*fixed.CODE_CHUNK_EXTENSIONS)


def chunk_sections(sections: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Chunks every section by the rule its extension calls for."""
    code = is_code(F.col("extension"))
    return code_chunks(sections.where(code), rules).unionByName(
        prose_chunks(sections.where(~code), rules))

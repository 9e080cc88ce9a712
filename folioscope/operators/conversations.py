"""Conversations: transcripts, titles, trimming, token accounting, answer structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.config import HistoryRules
from folioscope.functions import fixed, scores, text as tx
from folioscope.operators import ordered
from folioscope.operators.queries import first_per_query


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with message counts, latest first."""
    counted = messages.groupBy("conv_id").agg(F.count("*").alias("messages"))
    return (conversations.join(counted, "conv_id", "left")
            .withColumn("messages", F.coalesce("messages", F.lit(0)))
            .orderBy(F.desc("updated_at"), F.desc("created_at")))


def transcript(messages: DataFrame) -> DataFrame:
    return messages.orderBy("conv_id", "seq")


def renumber(messages: DataFrame, order: str = "turn", ties: list[str] | None = None) -> DataFrame:
    """Adds seq: 0, 1, 2, … within each conversation."""
    return ordered.row_numbers(messages, ["conv_id"], order, "__n", ties).withColumn(
        "seq", (F.col("__n") - 1).cast("long")).drop("__n")


def complete_turns(batch: DataFrame) -> DataFrame:
    """Messages of a batch that form question and answer, both with text.

    ``batch`` has conv_id, seq (without gaps), role, text.
    """
    spoken = batch.where(~tx.is_blank(F.coalesce("text", F.lit(""))))
    asked = spoken.where("role = 'user'").select("conv_id", F.col("seq").alias("question_seq"))
    answered = spoken.where("role = 'assistant'").select(
        "conv_id", (F.col("seq") - 1).alias("question_seq"))
    pairs = asked.join(answered, ["conv_id", "question_seq"]).select(
        "conv_id", F.explode(F.array("question_seq", F.col("question_seq") + 1)).alias("seq"))
    return batch.join(pairs, ["conv_id", "seq"], "left_semi")


def title(question: Column, longest: int = 24) -> Column:
    return tx.clip(tx.collapse(F.coalesce(question, F.lit(""))), longest, "…")


def titles(messages: DataFrame, order: str = "turn") -> DataFrame:
    """Each conversation named after its first question that has text."""
    asked = messages.where((F.col("role") == "user") & (title(F.col("text")) != ""))
    return asked.groupBy("conv_id").agg(title(F.min_by("text", order)).alias("title"))


def cascade_delete(bases: DataFrame, conversations: DataFrame, messages: DataFrame,
                   deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the deleted bases and everything below them."""
    left_bases = bases.join(deleted.select("base_id"), "base_id", "left_anti")
    left_conversations = conversations.join(left_bases, "base_id", "left_semi")
    return left_bases, left_conversations, messages.join(left_conversations, "conv_id",
                                                         "left_semi")


def current_history(messages: DataFrame, revisions: DataFrame) -> DataFrame:
    """Messages that belong to their conversation's current source revision."""
    return messages.join(revisions, (messages["conv_id"] == revisions["conv_id"]) & (
        messages["source_revision"] == revisions["current_revision"]), "left_semi")


def revision_breaks(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, previous_revision, source_revision) wherever neighbours differ."""
    return (ordered.previous_value(messages, ["conv_id"], "seq", "source_revision",
                                   "previous_revision")
            .where(F.col("previous_revision").isNotNull()
                   & (F.col("previous_revision") != F.col("source_revision")))
            .select("conv_id", "seq", "previous_revision", "source_revision"))


def trim_history(messages: DataFrame, rules: HistoryRules = HistoryRules(),
                 factor: float = 1.0) -> DataFrame:
    """The newest complete turns of each conversation that fit the budgets.

    Only the last twelve messages can stay, and Spark keeps no more than that per conversation
    before it shuffles. Of these the kept part starts at the earliest user message from which the
    rest fits; when no such start fits, at the last user message, whose text is cut if it is the
    only one left.
    """
    latest = first_per_query(messages, ["conv_id"], [F.desc("seq")], rules.max_turns, "from_end")
    backwards = W.partitionBy("conv_id").orderBy(F.desc("seq")).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("conv_id")
    tokens = tx.prompt_tokens(F.col("text"))
    sized = (latest.withColumn("__tokens", tokens)
             .withColumn("__rest", F.ceil(F.sum(
                 F.col("__tokens") + rules.message_overhead).over(backwards) * F.lit(factor))))
    is_user = F.col("role") == "user"
    fitting = F.min(F.when(is_user & (F.col("__rest") <= rules.max_tokens), F.col("seq"))).over(
        whole)
    # A message that is alone in the window stays even when it is too long.
    last_message = F.max("seq").over(whole)
    alone = F.min(F.when(is_user & (F.col("seq") == last_message), F.col("seq"))).over(whole)
    kept = (sized.withColumn("__start", F.coalesce(fitting, alone))
            .where(F.col("seq") >= F.col("__start")))
    estimate = F.greatest(F.lit(1), F.ceil(F.col("__tokens") * F.lit(factor)))
    density = F.greatest(F.lit(0.5), F.length("text") / estimate)
    tail = F.greatest(F.lit(rules.minimum_tail),
                      F.floor(F.lit(rules.max_tokens) * density)).cast("int")
    cut = (F.col("__rest") > rules.max_tokens) & (F.length("text") > tail)
    return (kept.withColumn("text", F.when(cut, F.concat(F.lit("…"), F.substring(
                F.col("text"), F.length("text") - tail + 1, tail))).otherwise(F.col("text")))
            .drop("from_end", "__tokens", "__rest", "__start"))


def conversation_tokens(messages: DataFrame, factor: Column | float = 1.0,
                        rules: HistoryRules = HistoryRules()) -> DataFrame:
    """(conv_id, tokens): the sum is rounded up after the model's factor."""
    by = factor if isinstance(factor, Column) else F.lit(factor)
    return messages.groupBy("conv_id").agg(F.ceil(F.sum(
        tx.prompt_tokens(F.col("text")) + rules.message_overhead) * by).alias("tokens"))


def observed_ratio(estimate: Column, actual: Column) -> Column:
    """A usable observation's clamped ratio, or null."""
    return F.when((estimate >= 50) & (actual > 0), scores.clamp(actual / estimate, 0.25, 4.0))


def calibration(observations: DataFrame, width: int = 4096) -> DataFrame:
    """(model, factor, observations) after all usage reports in order.

    ``observations``: model, seq, raw_estimate, actual_tokens. Each step is
    f -> 0.7 f + 0.3 r, and both f and r lie within the clamp, so the clamp after the step never
    acts and the fold is linear: the factor is a weighted sum with weights 0.3 * 0.7^(age). Sums
    combine map-side, so a model with a third of all reports is no hot spot. Only reports'
    positions are needed, which are counted in buckets of ``seq``.
    """
    key = tx.strip(F.coalesce("model", F.lit("")))
    usable = (observations.withColumn("model", key)
              .withColumn("ratio", observed_ratio(F.col("raw_estimate"), F.col("actual_tokens")))
              .where((F.col("model") != "") & F.col("ratio").isNotNull()))
    numbered = ordered.row_numbers(usable, ["model"], "seq", "position", width=width)
    totals = usable.groupBy("model").agg(F.count("*").alias("observations"))
    aged = numbered.join(totals, "model").withColumn(
        "age", (F.col("observations") - F.col("position")).cast("double"))
    summed = aged.groupBy("model", "observations").agg(F.sum(
        F.lit(0.3) * F.col("ratio") * F.pow(F.lit(0.7), F.col("age"))).alias("learned"))
    return summed.select("model", (
        F.pow(F.lit(0.7), F.col("observations").cast("double")) + F.col("learned"))
        .alias("factor"), "observations")


def usage_rollup(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Token usage per key; a missing total is the sum of the parts, unknown reports are left
    out."""
    prompt = F.greatest(F.lit(0), F.coalesce("prompt_tokens", F.lit(0)))
    completion = F.greatest(F.lit(0), F.coalesce("completion_tokens", F.lit(0)))
    total = F.greatest(F.lit(0), F.coalesce("total_tokens", F.lit(0)))
    known = (reports.withColumn("__p", prompt).withColumn("__c", completion)
             .withColumn("__t", F.when(total == 0, prompt + completion).otherwise(total))
             .where(F.col("__t") > 0))
    return known.groupBy(*keys).agg(
        F.sum("__p").alias("prompt_tokens"), F.sum("__c").alias("completion_tokens"),
        F.sum("__t").alias("total_tokens"), F.count("*").alias("reports"))


def split_reasoning(answers: DataFrame, text: str = "text") -> DataFrame:
    """Moves leading reasoning spans into a column of their own; later tags are plain text."""
    source = F.coalesce(F.col(text), F.lit(""))
    closed = rf"(?s)^(?:\s*{fixed.THINK_OPEN}.*?{fixed.THINK_CLOSE})+"
    opened = rf"(?s)^\s*{fixed.THINK_OPEN}(.*)$"
    staged = (answers.withColumn("__head", F.regexp_extract(source, closed, 0))
              .withColumn("__rest", F.substring(source, F.length("__head") + 1,
                                                F.length(source)))
              .withColumn("__open", F.col("__rest").rlike(opened)))
    spans = F.array_join(F.regexp_extract_all("__head", F.lit(
        rf"(?s){fixed.THINK_OPEN}(.*?){fixed.THINK_CLOSE}"), 1), "")
    blanks = F.regexp_replace("__head", rf"(?s){fixed.THINK_OPEN}.*?{fixed.THINK_CLOSE}", "")
    lead = F.when(F.col("__open"), F.regexp_extract("__rest", r"^\s*", 0)).otherwise("")
    return (staged
            .withColumn("reasoning", F.concat(spans, F.when(
                F.col("__open"), F.regexp_extract("__rest", opened, 1)).otherwise("")))
            .withColumn("answer", F.concat(blanks, F.when(F.col("__open"), lead).otherwise(
                F.col("__rest"))))
            .drop("__head", "__rest", "__open"))


def answer_structure(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, line_no, block, level, marker, text) of each line of a Markdown answer.

    Whether a line is code depends on the fences above it; the lines of one answer stay one array
    until that is known.
    """
    rows = F.split("text", "\n", -1)
    trailing = (F.size("__rows") > 1) & (F.element_at("__rows", -1) == "")
    fence = r"^(```|~~~)"
    lines = (answers.where(F.coalesce("text", F.lit("")) != "")
             .withColumn("__rows", rows)
             .withColumn("__rows", F.when(trailing, F.slice(
                 "__rows", F.lit(1), F.size("__rows") - 1)).otherwise(F.col("__rows")))
             .select(key, F.posexplode_outer("__rows").alias("line_no", "row"))
             .withColumn("trimmed", tx.strip(F.col("row")))
             .withColumn("is_fence", F.col("trimmed").rlike(fence)))
    above = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    coded = (lines.withColumn("__fences", F.coalesce(
                F.sum(F.col("is_fence").cast("int")).over(above), F.lit(0)))
             .where(~F.col("is_fence")).withColumn("code", F.col("__fences") % 2 == 1))
    trimmed = F.col("trimmed")
    indent = F.length(F.regexp_replace(
        F.regexp_extract("row", r"^[ \t]*", 0), "\t", "    "))
    level = F.least(F.lit(3), F.floor(indent / 2)).cast("int")
    block = (F.when(F.col("code"), "CODE").when(trimmed == "", "PARAGRAPH")
             .when(trimmed.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "RULE")
             .when(trimmed.rlike(r"^#{1,6} "), "HEADING")
             .when(trimmed.startswith(">"), "QUOTE")
             .when(trimmed.rlike(r"^[-*+] "), "BULLET")
             .when(trimmed.rlike(r"^\d{1,3}[.)] "), "NUMBERED").otherwise("PARAGRAPH"))
    number = F.regexp_extract(trimmed, r"^(\d{1,3})[.)] ", 1)
    kind = F.col("block")
    return coded.withColumn("block", block).select(
        key, F.col("line_no").cast("int").alias("line_no"), "block",
        F.when(kind == "HEADING", F.length(F.regexp_extract(trimmed, "^#+", 0)))
        .when(kind.isin("BULLET", "NUMBERED"), level).otherwise(0).alias("level"),
        F.when(kind == "BULLET", F.when(level == 0, "•").otherwise("◦"))
        .when(kind == "NUMBERED", F.concat(number, F.lit("."))).otherwise("").alias("marker"),
        F.when(kind == "CODE", F.col("row")).when(kind == "RULE", "")
        .when(kind == "HEADING", tx.strip(F.regexp_replace(trimmed, "^#+ ", "")))
        .when(kind == "QUOTE", tx.strip(F.regexp_replace(trimmed, "^>", "")))
        .when(kind == "BULLET", tx.strip(F.regexp_replace(trimmed, "^[-*+] ", "")))
        .when(kind == "NUMBERED", tx.strip(F.regexp_replace(trimmed, r"^\d{1,3}[.)] ", "")))
        .otherwise(trimmed).alias("text"))

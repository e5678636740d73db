"""The summarization plan: collapse, route, generate, merge, complete, repair, assess."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators import attribution, evaluation, facts, generation, lineage, reliability, structure
from parlance.operators.tokens import BUILT_IN
from parlance.sources import files


def dialogues_of(conversations: DataFrame) -> DataFrame:
    """conv_id, dialogue: turns as ``Role: text`` lines in order. The only shuffle of the engine's
    per-dialogue part; every later step is a map over rows."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return conversations.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("dialogue"))


def prepare(df: DataFrame, dialogue: str = "dialogue", mode: str = "auto", tokens=BUILT_IN) -> DataFrame:
    """Adds clean (the collapsed dialogue), deduplicated_turns, source_facts, full_tokens, actual_mode
    and error_code."""
    columns = df.columns
    work = df.withColumn("_c", structure.collapse(X.turns(F.coalesce(F.col(dialogue), F.lit(""))), F.coalesce(F.col(dialogue), F.lit(""))))
    work = work.withColumns({"clean": F.col("_c.text"), "deduplicated_turns": structure.deduplicated_turns(F.col("_c.provenance"))})
    work = work.withColumn("full_tokens", tokens.count(structure.format_prompt(L.DIRECT_INSTRUCTION, F.col("clean"))))
    work = work.withColumns(
        {
            "source_facts": facts.fact_struct(F.col("clean")),
            "requested_mode": F.lit(mode),
            "actual_mode": structure.route(mode, F.col("full_tokens")),
            "error_code": F.when(F.col("clean") == "", "EMPTY_DIALOGUE"),
        }
    )
    return work.select(*columns, "clean", "deduplicated_turns", "source_facts", "full_tokens", "requested_mode", "actual_mode", "error_code")


def summarize(
    spark: SparkSession, df: DataFrame, generator: generation.Generator = generation.extractive, key: str = "conv_id", dialogue: str = "dialogue", mode: str = "auto", budget: int = L.CHUNK_TOKENS, cut=None, tokens=BUILT_IN
) -> DataFrame:
    """One row per dialogue with the whole result; error_code instead of an exception for a dialogue
    that cannot be done. Direct and hierarchical rows are different frames, so only long dialogues pay
    for chunks and merging; all chunks of all dialogues are generated in one parallel stage. With
    ``lineage.Stages`` as the cut, seconds and rows of each stage are measured; the finished rows are a
    stage then, too. tokens: the tokenizer of all budgets and counts. Every generation is behind a cut, so no
    action on the result asks the model again."""
    cut = cut or lineage.cut
    ready = lineage.named(cut, prepare(df.select(key, F.col(dialogue).alias("dialogue")), "dialogue", mode, tokens), "prepare")
    good = ready.filter("error_code is null")

    direct = good.filter(F.col("actual_mode") == "direct").withColumn("_p", tokens.direct(F.col("clean")))
    fits = F.col("_p").isNotNull()
    direct = direct.withColumns(
        {
            "error_code": F.when(~fits, "DIRECT_TOO_LONG"),
            "summary": generation.asked(fits, F.col("_p.prompt"), generator, L.FINAL_OUT),
            "truncated": F.coalesce(F.col("_p.truncated"), F.lit(False)),
            "input_coverage": F.col("_p.coverage"),
        }
    )
    no_chunks = F.array().cast(f"array<{structure.CHUNK}>")
    direct = direct.withColumns({"chunks": no_chunks, "chunk_summaries": X.no_strings(), "generated": tokens.count(F.coalesce("summary", F.lit("")))})

    long = good.filter(F.col("actual_mode") == "hierarchical").drop("error_code")
    long = lineage.named(cut, structure.chunk_dialogues(long, "clean", budget, tokens=tokens), "chunks")
    parts = long.filter("error_code is null").select(key, F.posexplode("chunks").alias("_at", "_chunk"))
    prompt = structure.format_prompt(L.CHUNK_INSTRUCTION, F.col("_chunk.text"))
    parts = parts.select(key, "_at", generation.asked(tokens.count(prompt) <= L.PROMPT_TOKENS, prompt, generator, L.CHUNK_OUT).alias("_text"))
    merged_in = parts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]).alias("chunk_summaries"), F.bool_or(F.coalesce(F.col("_text") == "", F.lit(True))).alias("_bad")
    )
    long = lineage.named(cut, long.join(merged_in, key, "left"), "sections")
    code = F.coalesce("error_code", F.when(F.col("_bad"), "SECTION_FAILED"))
    long = long.withColumn("error_code", code).drop("_bad")
    several = long.filter("error_code is null and size(chunk_summaries) > 1")
    merged = generation.merge_rounds(spark, several.withColumn("facts", facts.facts_lines(F.col("source_facts"))), generator, key, "chunk_summaries", "facts", cut, tokens=tokens)
    long = long.join(merged.withColumnRenamed("error_code", "_merge_error"), key, "left")
    summed = tokens.total(F.col("chunk_summaries"))
    long = long.withColumns(
        {
            "error_code": F.coalesce("error_code", "_merge_error"),
            "summary": F.when(F.size("chunk_summaries") == 1, F.get("chunk_summaries", F.lit(0))).otherwise(F.col("summary")),
            "truncated": F.lit(False),
            "input_coverage": F.lit(1.0),
            "generated": summed + F.coalesce("merge_tokens", F.lit(0)),
        }
    )
    common = [key, "dialogue", "clean", "deduplicated_turns", "source_facts", "requested_mode", "actual_mode", "error_code", "summary", "truncated", "input_coverage", "chunks", "chunk_summaries", "generated"]
    # completed and repaired before they are cut: what follows asks no model and reads the final text many times
    both = generation.complete(direct.select(*common).unionByName(long.select(*common)), "summary", generator, tokens)
    both = attribution.repair(both, "clean", "summary", "_repaired").withColumn("summary", F.col("_repaired")).drop("_repaired")
    both = lineage.named(cut, both, "drafts")
    done = both.filter("error_code is null")
    done = done.withColumn("error_code", F.when(F.col("summary") == "", "EMPTY_SUMMARY"))
    done = reliability.assess(done, "clean", "summary", F.col("truncated"))
    failed = ready.filter("error_code is not null").select(key, "requested_mode", "actual_mode", "error_code").unionByName(both.filter("error_code is not null").select(key, "requested_mode", "actual_mode", "error_code"))
    result = done.select(
        key, "error_code", "summary", "requested_mode", "actual_mode",
        F.greatest(F.lit(1), F.size("chunks")).alias("chunk_count"), "chunks", "chunk_summaries", "input_coverage", "truncated", "source_facts",
        "deduplicated_turns", (F.col("deduplicated_turns") > 0).alias("deduplication_applied"), "attribution_repairs",
        (F.col("generated") + F.col("completion_tokens")).alias("generated_tokens_total"), tokens.count(F.col("summary")).alias("final_tokens"), "reliability",
    )
    result = result.unionByName(failed, allowMissingColumns=True)
    return cut(result, "finish") if isinstance(cut, lineage.Stages) else result


MODES = ("direct", "hierarchical")


def evaluate_mode(spark: SparkSession, rows: DataFrame, mode: str, generator: generation.Generator = generation.extractive, cut=None, peak: generation.PeakMemory | None = None, tokens=BUILT_IN) -> DataFrame:
    """One mode of every row, scored. For the parameters see ``evaluate``."""
    result = summarize(spark, rows.select("source_index", "input"), generator, "source_index", "input", mode, cut=cut, tokens=tokens)
    if peak is not None:  # known once the mode has run
        result = lineage.named(cut or lineage.cut, result, mode)
    gb = F.lit(peak.gb if peak is not None else None).cast("double")
    result = result.select("source_index", F.lit(mode).alias("mode"), "summary", "input_coverage", "error_code", gb.alias("peak_memory_gb"))
    texts = rows.select("source_index", "eval_type", "input_tokens", F.col("input").alias("dialogue"), F.col("output").alias("reference"))
    return evaluation.score(result.join(texts, "source_index"))


def evaluate(spark: SparkSession, rows: DataFrame, generator: generation.Generator = generation.extractive, done: DataFrame | None = None, **options) -> DataFrame:
    """rows: source_index, eval_type, input_tokens, input, output. Both modes of every row that has no
    record yet, scored: one row per (source_index, mode). Options: cut and tokens, as for ``summarize``; peak: the
    one that the generator notes its workers' memory in; peak_memory_gb is then what a mode's run has reached,
    for all its rows. Without it the memory is unknown, peak_memory_gb null, and the gate on memory fails."""
    rows = evaluation.pending(rows, done) if done is not None else rows
    direct, hierarchical = (evaluate_mode(spark, rows, mode, generator, **options) for mode in MODES)
    return direct.unionByName(hierarchical)


def resume(
    spark: SparkSession, rows: DataFrame, path: str, generator: generation.Generator = generation.extractive, batches: int = 8, split: str = "val", tell: Callable[[str], None] = print, **options
) -> dict:
    """Evaluates what ``path`` has no records of, a batch of rows and a mode at a time, each of which is written
    there as a part of its own (``files.Ledger``). A run that is stopped, wherever, goes on where it was: a part
    that was not finished is made anew, so each (row, mode) has one record. tell: gets a line ``n/N`` after each
    part, n the rows that have both records. Returns split, count (n), complete (all have both),
    seconds_this_run, test_split_read."""
    began = time.perf_counter()
    files.check_split(split)
    ledger = files.Ledger(spark, path)
    keys = StructType([rows.schema["source_index"], StructField("mode", StringType())])
    wanted, both = rows.select("source_index").distinct().count(), 0
    for k in range(batches):
        for mode in MODES:
            part = rows.filter(F.pmod(F.xxhash64("source_index"), F.lit(batches)) == k)
            todo = evaluation.pending(part, ledger.read(keys).filter(F.col("mode") == mode))
            if not todo.isEmpty():
                ledger.add(f"{k}-{mode}", evaluate_mode(spark, todo, mode, generator, **options))
            both = _recorded(rows, ledger.read(keys))
            tell(f"{both}/{wanted}")
    return {"split": split, "count": both, "complete": both == wanted, "seconds_this_run": time.perf_counter() - began, "test_split_read": split == "test"}


def _recorded(rows: DataFrame, records: DataFrame) -> int:
    """How many of the rows have a record of each mode."""
    whole = records.groupBy("source_index").agg(F.count_distinct("mode").alias("modes")).filter(F.col("modes") == len(MODES))
    return rows.select("source_index").distinct().join(whole, "source_index", "left_semi").count()


def smoke(spark: SparkSession, df: DataFrame, generator: generation.Generator = generation.extractive, key: str = "conv_id", dialogue: str = "dialogue", peak: generation.PeakMemory | None = None) -> dict[str, bool]:
    """The longest dialogue, summarized twice by sections: are the runs equal, all turns covered, the
    sections several, the summary not empty, the memory (if peak is given) within the gate?"""
    sized = df.select(key, F.col(dialogue).alias("dialogue"), X.token_count(F.col(dialogue)).alias("input_tokens"))
    longest = lineage.cut(evaluation.longest(sized, 1, key=key))
    runs = [summarize(spark, longest, generator, key, mode="hierarchical").drop("reliability").collect() for _ in range(2)]
    if not runs[0]:
        raise ValueError("there is no dialogue")
    row = runs[0][0]
    found = {"equal": runs[0] == runs[1], "covered": row["input_coverage"] == 1, "sections": (row["chunk_count"] or 0) >= 2, "not_empty": bool(row["summary"])}
    return found | ({"memory": peak.gb is not None and peak.gb <= evaluation.MEMORY_GB} if peak is not None else {})


def compare(spark: SparkSession, df: DataFrame, jobs: Iterable[tuple[str, generation.Generator, str]], key: str = "conv_id", cut=None, tokens=BUILT_IN) -> DataFrame:
    """The same dialogues through several (label, generator, mode) jobs. Each job is cut before the next
    one begins, and a worker lets its model go before it loads the next one, so one model at a time is
    resident there. (Spark ends a worker that has had no task for a minute, and its model with it.)"""
    out: DataFrame | None = None
    for label, generator, mode in jobs:
        result = summarize(spark, df, generator, key, mode=mode, cut=cut, tokens=tokens).withColumn("job", F.lit(label))
        result = lineage.named(cut or lineage.cut, result, f"job {label}")
        out = result if out is None else out.unionByName(result)
    return out

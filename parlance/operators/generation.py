"""Generation as a plug-in, and the merge rounds around it.

A generator is a function from a prompt Column and a token cap to a text Column. ``extractive`` is a
deterministic stand-in made of built-in functions: it copies sentences from the prompt's input, so
pipelines run and can be tested without a model. It says nothing about a model's quality. A real
model goes in through ``arrow_generator``.
"""

from __future__ import annotations

import gc
import resource
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators import lineage, structure
from parlance.operators.tokens import BUILT_IN

Generator = Callable[[Column, int], Column]


def extractive(prompt: Column, cap: int) -> Column:
    """The first sentences of the input that fit into cap tokens; one longer sentence is cut."""
    body = F.regexp_extract(prompt, r"(?s)### Input:\n(.*)\n\n### Response:", 1)
    clean = F.regexp_replace(body, r"(?m)^Section \d+: |\n", " ")
    units = F.transform(X.sentences(clean), lambda s: F.struct(s.alias("line"), X.token_count(s).alias("n"), F.lit(0).alias("idx")))
    packed = F.get(structure.pack(units, cap, " "), F.lit(0))["text"]
    return X.strip(F.coalesce(F.array_join(F.slice(X.tokens(packed), 1, cap), " "), F.lit("")))


#: The model of this Python worker, by the key of its generator: one at a time, kept for the worker's next tasks.
_RESIDENT: dict[str, object] = {}


def resident(key: str, load: Callable[[], object]) -> object:
    """The model of ``key``. Another one goes first, before this one is loaded (its ``close``, if it has
    one, is called), so a worker never holds two."""
    if key not in _RESIDENT:
        while _RESIDENT:
            close = getattr(_RESIDENT.popitem()[1], "close", None)
            if callable(close):
                close()
            del close
        gc.collect()
        _RESIDENT[key] = load()
    return _RESIDENT[key]


class _Greatest(AccumulatorParam):
    def zero(self, value: float) -> float:
        return 0.0

    def addInPlace(self, a: float, b: float) -> float:
        return max(a, b)


class PeakMemory:
    """The most resident memory, in GB, of any Python worker that ran a model; None before one did."""

    def __init__(self, spark: SparkSession):
        self.seen = spark.sparkContext.accumulator(0.0, _Greatest())

    @property
    def gb(self) -> float | None:
        return self.seen.value or None


def _resident_gb() -> float:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if sys.platform == "darwin" else 1024) / 1e9


def arrow_generator(load: Callable[[], Callable[[list[str], int], list[str]]], peak: PeakMemory | None = None) -> Generator:
    """A model loaded once per Python worker, fed with Arrow batches. A null prompt is not sent, and has a
    null text. Marked non-deterministic so that the optimizer never repeats a call. peak: notes the
    workers' memory, the model's included."""
    seen = peak.seen if peak is not None else None

    key = uuid.uuid4().hex

    def generator(prompt: Column, cap: int) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                out, asked = pd.Series([None] * len(batch), dtype=object), batch.notna().to_numpy()
                if asked.any():
                    out[asked] = resident(key, load)(batch[asked].tolist(), cap)
                    if seen is not None:
                        seen.add(_resident_gb())
                yield out

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return X.strip(F.pandas_udf(run, "string").asNondeterministic()(prompt))

    return generator


def asked(condition: Column, prompt: Column, generator: Generator, cap: int) -> Column:
    """A generation for the rows of the condition; the others' prompts are null, so a model never sees them
    (a UDF within ``when`` alone would run for all rows)."""
    return F.when(condition, generator(F.when(condition, prompt), cap))


def complete(df: DataFrame, summary: str, generator: Generator, tokens=BUILT_IN) -> DataFrame:
    """Finishes summaries that end within a sentence: one more generation, used if it is finished;
    else its finished sentences, else the first draft's, else the new text as it is. Only unfinished
    rows are sent to the model."""
    columns = df.columns
    prompt = structure.format_prompt(L.COMPLETE_INSTRUCTION, X.strip(F.col(summary)))
    work = df.withColumn("_again", asked(X.is_incomplete(F.col(summary)), prompt, generator, L.FINAL_OUT))
    best = F.coalesce(
        F.when(~X.is_incomplete(F.col("_again")), X.strip(F.col("_again"))),
        F.nullif(X.complete_sentences(F.col("_again")), F.lit("")),
        F.nullif(X.complete_sentences(F.col(summary)), F.lit("")),
        X.strip(F.col("_again")),
    )
    done = F.when(F.col("_again").isNull(), X.strip(F.col(summary))).otherwise(best)
    repair_tokens = F.coalesce(tokens.count(F.col("_again")), F.lit(0))
    return work.withColumns({summary: done, "completion_tokens": repair_tokens}).select(*columns, "completion_tokens")


def fit_merge_input(summaries: Column, facts: Column, budget: int = L.PROMPT_TOKENS, tokens=BUILT_IN) -> Column:
    """The numbered summaries under as many fact lines (array of up to three) as fit, dropped from the
    end; at last the summaries alone, even if too long."""
    body = structure.sections(summaries)
    whole = F.concat(F.array_join(facts, "\n"), F.lit("\n"), body)
    options = [whole, *[F.array_join(F.concat(F.slice(facts, 1, k), F.array(body)), "\n") for k in (2, 1, 0)]]
    out = body
    for option in reversed(options):
        out = F.when(tokens.count(structure.merge_prompt(option)) <= budget, option).otherwise(out)
    return out


def merge_rounds(spark: SparkSession, df: DataFrame, generator: Generator, key: str, summaries: str = "summaries", facts: str = "facts", cut=None, max_rounds: int = 16, tokens=BUILT_IN) -> DataFrame:
    """df: key, summaries (array), facts (array of lines). Returns key, summary, merge_tokens,
    error_code. Each round merges the groups of every dialogue at once; a dialogue whose merge input
    fits is finished in that round. ``cut`` writes a round's rows and reads them again."""
    cut = cut or lineage.cut
    todo = df.select(key, F.col(summaries).alias("_s"), F.col(facts).alias("_f"), F.lit(0).alias("_n"))
    finished: DataFrame | None = None
    for k in range(1, max_rounds + 1):
        work = todo.withColumn("_input", fit_merge_input(F.col("_s"), F.col("_f"), tokens=tokens))
        fits = (F.size("_s") == 1) | (tokens.count(structure.merge_prompt(F.col("_input"))) <= L.PROMPT_TOKENS)
        last = work.filter(fits).select(key, generator(structure.merge_prompt(F.col("_input")), L.FINAL_OUT).alias("summary"), "_n")
        last = last.select(key, "summary", (F.col("_n") + tokens.count(F.col("summary"))).alias("merge_tokens"), F.lit(None).cast("string").alias("error_code"))
        rest = work.filter(~fits).withColumn("_groups", tokens.groups(F.col("_s")))
        stuck = rest.filter(F.size("_groups") < 2).select(key, F.lit(None).cast("string").alias("summary"), F.col("_n").alias("merge_tokens"), F.lit("MERGE_NOT_REDUCIBLE").alias("error_code"))
        done = last.unionByName(stuck)
        finished = done if finished is None else finished.unionByName(done)
        parts = rest.filter(F.size("_groups") > 1).select(key, "_f", "_n", F.posexplode("_groups").alias("_at", "_group"))
        prompts = parts.withColumn("_text", generator(structure.merge_prompt(fit_merge_input(F.col("_group"), X.no_strings(), tokens=tokens)), L.MERGE_OUT))
        prompts = prompts.withColumn("_used", tokens.count(F.col("_text")))
        todo = lineage.named(
            cut,
            prompts.groupBy(key).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]).alias("_s"),
                F.first("_f").alias("_f"),
                (F.first("_n") + F.sum("_used")).cast("int").alias("_n"),
            ),
            f"merge round {k}",
        )
        if todo.isEmpty():
            return finished
    over = todo.select(key, F.lit(None).cast("string").alias("summary"), F.col("_n").alias("merge_tokens"), F.lit("MERGE_NOT_REDUCIBLE").alias("error_code"))
    return finished.unionByName(over)

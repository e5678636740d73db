"""SQL functions and views for those who query rather than program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.operators import attribution, reliability, structure, tokens
from parlance.plans import summarize


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions, each a plain SQL expression, so that Catalyst sees through them."""
    strip = "btrim({}, '" + "".join(f"\\u{ord(c):04x}" for c in L.WHITE) + "')"
    made = {
        "text_strip(t STRING) RETURNS STRING": strip.format("t"),
        "text_sentences(t STRING) RETURNS ARRAY<STRING>": f"filter(transform(split({strip.format('t')}, {quoted(L.SENTENCE_BREAK)}), x -> {strip.format('x')}), x -> x <> '')",
        "dialogue_speakers(t STRING) RETURNS ARRAY<STRING>": f"array_distinct(transform(regexp_extract_all(t, {quoted(L.SPEAKER)}, 1), x -> {strip.format('x')}))",
        "dialogue_numbers(t STRING) RETURNS ARRAY<STRING>": f"array_distinct(regexp_extract_all(t, {quoted(L.NUMBER)}, 0))",
        "norm_number(t STRING) RETURNS STRING": f"replace(lower(regexp_replace(t, {quoted('(?U)' + L.SPACE + '+')}, '')), ',', '')",
        "is_incomplete(t STRING) RETURNS BOOLEAN": f"{strip.format('t')} <> '' AND NOT {strip.format('t')} RLIKE {quoted(L.ENDED)}",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]


class _WhiteSpace:
    """The built-in tokenizer, as the packer wants it."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, words: list[str]) -> str:
        return " ".join(words)


@F.udtf(returnType="key string, chunk int, text string, turn_indices array<int>, token_count int")
class ChunkDialogue:
    """A row per chunk of each dialogue of a table of (key, dialogue); none of a blank or null one. The budget of
    tokens comes after the table."""

    def eval(self, row, budget: int = L.CHUNK_TOKENS):
        key, dialogue = row[0], row[1]
        turns = [(i, line.strip()) for i, line in enumerate((dialogue or "").splitlines()) if line.strip()]
        for k, chunk in enumerate(tokens.Packer(_WhiteSpace()).chunks(turns, budget)):
            yield None if key is None else str(key), k, chunk["text"], chunk["turn_indices"], chunk["token_count"]


def register_tables(spark: SparkSession) -> list[str]:
    """Table functions: ``SELECT * FROM chunk_dialogue(TABLE(dialogues) PARTITION BY conv_id)``."""
    spark.udtf.register("chunk_dialogue", ChunkDialogue)
    return ["chunk_dialogue"]


def views(spark: SparkSession, conversations: DataFrame) -> None:
    """dialogues and dialogue_chunks as temporary views."""
    dialogues = summarize.dialogues_of(conversations)
    dialogues.createOrReplaceTempView("dialogues")
    structure.chunk_dialogues(dialogues).select("conv_id", F.explode("chunks").alias("chunk")).select("conv_id", "chunk.*").createOrReplaceTempView("dialogue_chunks")


def pair_views(pairs: DataFrame) -> None:
    """repaired_pairs and checked_pairs as temporary views of (dialogue, summary) pairs."""
    attribution.repair(pairs).createOrReplaceTempView("repaired_pairs")
    check_pairs(pairs).createOrReplaceTempView("checked_pairs")


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Repaired and assessed (dialogue, summary) pairs."""
    return reliability.assess(attribution.repair(pairs), "dialogue", "repaired")

"""Consistency of a summary with its dialogue: seven flags, reasons, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators import facts, similar


def unsupported_people(summary: Column, dialogue_words: Column) -> Column:
    tokens = F.filter(X.find_all(summary, L.CAPITALISED), lambda w: ~w.isin(*L.IGNORED) & ~F.array_contains(dialogue_words, F.lower(w)))
    return F.array_distinct(tokens)


def numbers_without(found: Column, other: Column) -> Column:
    """Of ``found`` (raw spellings), those whose normal form ``other`` lacks: in the order of first
    occurrence of the normal form, in the spelling of the last."""
    keyed = F.transform(found, lambda x: F.struct(facts.norm_number(x).alias("key"), x.alias("raw")))

    def without(keyed: Column) -> Column:
        keys = F.array_except(F.transform(keyed, lambda x: x["key"]), F.transform(other, facts.norm_number))
        return F.transform(keys, lambda k: F.element_at(F.filter(keyed, lambda x: x["key"] == k), -1)["raw"])

    return X.let(keyed, without)


def with_evidence(df: DataFrame, dialogue: str, summary: str) -> DataFrame:
    """Adds ``_speakers``, ``_numbers``, ``_words``, ``_pairs``: what the flags are made of."""
    df = df.withColumns({"_speakers": facts.speakers(F.col(dialogue)), "_numbers": facts.numbers(F.col(dialogue)), "_words": F.array_distinct(F.transform(X.words(F.col(dialogue)), F.lower))})
    units = X.let(X.naming(F.col("_speakers")), lambda named: F.transform(X.sentences(F.col(summary)), lambda s: F.struct(X.content_words(s).alias("words"), X.first_named(s, named).alias("speaker"))))
    df = df.withColumn("_units", units)
    return df.withColumn("_pairs", similar.pairs(F.col("_units"), min(L.DUPLICATE, L.CONFLICT))).drop("_units")


_LIST = "array<string>"
_PAIRS = "array<array<int>>"
_CONFLICTS = "array<struct<sentences:array<int>,people:array<string>>>"


def assess(df: DataFrame, dialogue: str = "dialogue", summary: str = "summary", truncated: Column | None = None, into: str = "reliability") -> DataFrame:
    """Adds struct ``into``: risk, reasons, source_facts, flags. A null text counts as empty."""
    columns = df.columns
    cut = F.coalesce(truncated, F.lit(False)) if truncated is not None else F.lit(False)
    work = df.withColumns({"_d": F.coalesce(F.col(dialogue), F.lit("")), "_s": F.coalesce(F.col(summary), F.lit("")), "_cut": cut})
    work = with_evidence(work, "_d", "_s").withColumn("_summary_numbers", facts.raw_numbers(F.col("_s")))
    similar = F.filter("_pairs", lambda p: p["similarity"] >= L.DUPLICATE)
    opposed = F.filter("_pairs", lambda p: (p["similarity"] >= L.CONFLICT) & p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != p["b"]))
    work = work.withColumns(
        {
            "_people": unsupported_people(F.col("_s"), F.col("_words")),
            "_extra": numbers_without(F.col("_summary_numbers"), F.col("_numbers")),
            "_missing": numbers_without(F.col("_numbers"), F.col("_summary_numbers")),
            "_duplicates": F.transform(similar, lambda p: F.array(p["i"], p["j"])),
            "_conflicts": F.transform(opposed, lambda p: F.struct(F.array(p["i"], p["j"]).alias("sentences"), F.array(p["a"], p["b"]).alias("people"))),
            "_unfinished": X.is_incomplete(F.col("_s")),
        }
    )
    present = {
        "empty_summary": X.strip(F.col("_s")) == "",
        "unsupported_person": F.size("_people") > 0,
        "unsupported_number": F.size("_extra") > 0,
        "possible_number_omission": F.size("_missing") > 0,
        "duplicate_event": F.size("_duplicates") > 0,
        "possible_attribution_conflict": F.size("_conflicts") > 0,
        "incomplete_sentence": F.col("_unfinished"),
        "input_truncated": F.col("_cut"),
    }
    values = {"unsupported_person": "_people", "unsupported_number": "_extra", "possible_number_omission": "_missing"}

    def reason(code: str, severity: str, message: str) -> Column:
        return F.when(
            present[code],
            F.struct(
                F.lit(code).alias("code"),
                F.lit(severity).alias("severity"),
                F.lit(message).alias("message"),
                (F.col(values[code]) if code in values else F.lit(None).cast(_LIST)).alias("values"),
                (F.col("_duplicates").cast(_PAIRS) if code == "duplicate_event" else F.lit(None).cast(_PAIRS)).alias("pairs"),
                (F.col("_conflicts").cast(_CONFLICTS) if code == "possible_attribution_conflict" else F.lit(None).cast(_CONFLICTS)).alias("conflicts"),
            ),
        )

    work = work.withColumn("_reasons", F.filter(F.array(*[reason(*r) for r in L.REASONS]), lambda r: r.isNotNull()))
    result = F.struct(
        risk("_reasons").alias("risk"),
        F.col("_reasons").alias("reasons"),
        F.struct(F.col("_speakers").alias("speakers"), F.col("_numbers").alias("numbers")).alias("source_facts"),
        F.struct(*[present[code].alias(code) for code, _, _ in L.REASONS[1:]]).alias("flags"),
    )
    return work.withColumn(into, result).select(*columns, into)


def risk(reasons: str) -> Column:
    high = F.exists(reasons, lambda r: r["severity"] == "high")
    return F.when(high, "high").when(F.size(reasons) > 0, "medium").otherwise("low")


def display(reasons: Column, catalogue: dict[str, str] | None = None) -> Column:
    """One line per reason: the catalogue's text for its code, else its own message; and its values."""
    own = F.create_map(*[F.lit(x) for pair in (catalogue or {}).items() for x in pair]) if catalogue else None

    def line(r: Column) -> Column:
        text = F.coalesce(own[r["code"]], r["message"]) if own is not None else r["message"]
        return F.when(F.size(F.coalesce(r["values"], X.no_strings())) > 0, F.concat(text, F.lit(" "), F.array_join(r["values"], "、"))).otherwise(text)

    return F.transform(reasons, line)

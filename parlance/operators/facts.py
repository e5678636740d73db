"""Facts of a dialogue: speakers, numbers, times and amounts, mentioned people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X


def speakers(dialogue: Column) -> Column:
    """Names before a colon at the start of a line, in order, once each."""
    return F.array_distinct(F.transform(X.find_all(dialogue, L.SPEAKER, 1), X.strip))


def raw_numbers(text: Column) -> Column:
    return X.find_all(text, L.NUMBER)


def numbers(text: Column) -> Column:
    """Numbers, times and amounts as written, in order, once for each spelling."""
    return F.array_distinct(raw_numbers(text))


def norm_number(value: Column) -> Column:
    """Lower case, without white space and commas."""
    return F.replace(F.lower(F.regexp_replace(value, rf"(?U){L.SPACE}+", "")), F.lit(","), F.lit(""))


def mentioned_people(dialogue: Column, names: Column) -> Column:
    """Capitalised words that are neither ignored nor a whole speaker name, in order, once each."""
    found = X.find_all(dialogue, L.CAPITALISED)
    return X.let(F.transform(names, F.lower), lambda low: F.array_distinct(F.filter(found, lambda w: ~w.isin(*L.IGNORED_IN_FACTS) & ~F.array_contains(low, F.lower(w)))))


def fact_struct(dialogue: Column) -> Column:
    """struct<speakers, numbers, mentioned_people>."""
    return X.let(speakers(dialogue), lambda names: F.struct(names.alias("speakers"), numbers(dialogue).alias("numbers"), mentioned_people(dialogue, names).alias("mentioned_people")))


def facts_lines(facts: Column) -> Column:
    """The three labelled lines of a fact struct, as an array."""

    def line(label: str, values: Column) -> Column:
        return F.concat(F.lit(label + ": "), F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("none detected"))

    return F.array(
        line("Dialogue speakers", facts["speakers"]),
        line("Mentioned people", facts["mentioned_people"]),
        line("Numbers/times/amounts from source", F.transform(facts["numbers"], X.strip)),
    )


def facts_text(facts: Column) -> Column:
    return X.let(facts, lambda bound: F.array_join(facts_lines(bound), "\n"))

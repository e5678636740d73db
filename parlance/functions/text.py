"""Text as Column expressions: strip, lines, turns, sentences, words, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicon as L


def strings(values) -> Column:
    """A constant array of strings."""
    return F.array(*[F.lit(v) for v in values])


def no_strings() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(L.WHITE))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines(text: Column) -> Column:
    return F.split(text, L.LINE_END, -1)


def turns(text: Column) -> Column:
    """array<struct<idx, line>>: stripped lines that are not blank; a blank line uses up an index."""
    numbered = F.transform(lines(text), lambda line, i: F.struct(i.alias("idx"), strip(line).alias("line")))
    return F.filter(numbered, lambda t: t["line"] != "")


def _not_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Split at white space that follows a stop; what a stop does not end is a sentence too."""
    return _not_blank(F.split(strip(text), L.SENTENCE_BREAK, -1))


def _ended(parts: Column) -> Column:
    return F.filter(parts, lambda x: x.rlike(L.ENDED))


def sentence_units(text: Column) -> Column:
    """Runs up to exactly one stop. Splits 3.30 in two and drops an unfinished tail. (The tail is
    matched as a whole and filtered out; searched for a stop from each of its characters, a long one
    would take quadratic time.)"""
    return _not_blank(F.filter(find_all(strip(text), L.SENTENCE_UNIT + "|[^.!?]+"), lambda x: x.rlike(r"[.!?]\z")))


def complete_sentences(text: Column) -> Column:
    """The finished sentences, joined by one blank. (Lines' unfinished ends: as above.)"""
    return F.array_join(_ended(F.transform(find_all(strip(text), L.COMPLETE_SENTENCE + "|.+"), strip)), " ")


def is_incomplete(text: Column) -> Column:
    """Not blank, and without a stop (and perhaps a closing quote or bracket) at its end."""
    bare = strip(text)
    return (bare != "") & ~bare.rlike(L.ENDED)


def words(text: Column) -> Column:
    return find_all(text, L.WORD)


def content_words(text: Column) -> Column:
    """Distinct lower-cased words of over two letters; the ignored list is compared before that."""
    kept = F.filter(words(text), lambda w: ~w.isin(*L.IGNORED) & (F.length(w) > 2))
    return F.array_distinct(F.transform(kept, F.lower))


def speaker_words(speakers: Column) -> Column:
    return F.flatten(F.transform(speakers, lambda s: F.split(F.lower(s), rf"(?U){L.SPACE}+", -1)))


def action_words(text: Column, names: Column) -> Column:
    """Distinct lower-cased words of over two letters that are neither stop words nor in ``names``."""
    low = F.transform(F.filter(words(text), lambda w: F.length(w) > 2), F.lower)
    return let(names, lambda own: F.array_distinct(F.filter(low, lambda w: ~w.isin(*L.ACTION_STOP) & ~F.array_contains(own, w))))


def primary_speaker(sentence: Column, speakers: Column) -> Column:
    """The speaker named first in the sentence as a whole word; of equals the least name; or null. One pass
    over the sentence for all names: the alternatives of one pattern, in the order of the names, so that the
    leftmost match is the first one and its alternative the least. For several sentences, bind ``naming`` once and
    use ``first_named``."""
    return let(naming(speakers), lambda named: first_named(sentence, named))


def naming(speakers: Column) -> Column:
    """struct<names, low, pattern>: the sorted names, in lower case too, and the pattern that finds them."""

    def of(both: Column) -> Column:
        each = F.transform(both["low"], lambda s: F.concat(F.lit(r"\Q"), s, F.lit(r"\E")))
        pattern = F.when(F.size(both["low"]) > 0, F.concat(F.lit(r"(?U)\b(?:"), F.array_join(each, "|"), F.lit(r")\b")))
        return F.struct(both["names"].alias("names"), both["low"].alias("low"), pattern.alias("pattern"))

    return let(let(F.sort_array(speakers), lambda names: F.struct(names.alias("names"), F.transform(names, F.lower).alias("low"))), of)


def first_named(sentence: Column, named: Column) -> Column:
    place = F.array_position(named["low"], F.call_function("regexp_extract", F.lower(sentence), named["pattern"], F.lit(0)))
    return F.get(named["names"], place.cast("int") - 1)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """The same of arrays without repeated words: one intersection."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(n > 0, n / (F.size(a) + F.size(b) - n)).otherwise(F.lit(0.0)))


def share(part: Column, whole: Column) -> Column:
    """Part of ``part``'s words that ``whole`` has."""
    return F.size(F.array_intersect(part, whole)) / F.greatest(F.lit(1), F.size(part))


def tokens(text: Column) -> Column:
    """Built-in tokenizer: runs of anything but white space."""
    return F.filter(F.split(text, rf"(?U){L.SPACE}+", -1), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def n_grams(items: Column, n: int) -> Column:
    """All runs of n items, as blank-joined strings; none if there are fewer. Arrays that begin one item
    later are zipped, n - 1 times."""
    out = items
    for k in range(2, n + 1):
        out = F.zip_with(F.slice(out, 1, F.greatest(F.size(items) - k + 1, F.lit(0))), F.slice(items, k, F.size(items)), lambda a, b: F.concat(a, F.lit(" "), b))
    return out

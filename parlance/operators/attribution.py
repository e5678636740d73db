"""Repair of actions that a summary gives to the wrong speaker, and of repeated events.

Speakers are found in the JVM. Who said what, claims, and sentences that go are compared in one Arrow pass, a pair of
texts at a time: nested arrays in the JVM are interpreted, and every word of every sentence meets every speaker. Patterns
there have the classes of Java's (?U), as those of all operators.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators import facts, similar

RECORD = "struct<sentence:int,`from`:string,`to`:string,action:string,removed_sentence:int,kept_sentence:int,reason:string>"
RESULT = f"struct<repaired:string,log:array<{RECORD}>>"
_NOTHING = dict.fromkeys(("sentence", "from", "to", "action", "removed_sentence", "kept_sentence", "reason"))
#: Texts whose words a worker remembers, and their most characters.
REMEMBERED, BRIEF = 1 << 14, 200

#: White space, and the categories and further characters of words, by (?U).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"[{_WHITE}]"
_IN_WORDS = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"))
_LETTERLIKE = ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
#: What equals an ASCII letter if case is ignored, besides its own other case.
_FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}

_OWNER = re.compile(L.OWNER_LINE.removeprefix("(?dU)").replace(r"\s", _SPACE))
_DIRECTED = re.compile(L.DIRECTIVES.replace(r"\s", _SPACE), re.I)
_CLAIM = re.compile((r"\s+" + L.MODALS + r"\s+").replace(r"\s", _SPACE) + r"([A-Za-z'-]+)", re.I)
_WORDS = re.compile(L.WORD)
_UNIT = re.compile(r"[^.!?]+[.!?]?")
_STOP_WORDS = frozenset(L.ACTION_STOP)


def _in_word(text: str, at: int) -> bool:
    if not 0 <= at < len(text):
        return False
    c = text[at]
    if c.isascii():
        return c.isalnum() or c == "_"
    return unicodedata.category(c) in _IN_WORDS or any(a <= ord(c) <= b for a, b in _LETTERLIKE)


def _ends(text: str, at: int) -> bool:
    """A word begins or ends here."""
    around = text[max(0, at - 1) : at + 1]
    if at and len(around) == 2 and around[0].isalpha() and around[1] == " ":
        return True
    return _in_word(text, at - 1) != _in_word(text, at)


def _folded(text: str) -> str:
    """In lower case, as long as before where it equals an ASCII text if case is ignored."""
    return (text if text.isascii() else text.translate(_FOLDED)).lower()


def _opened(text: str, low: str) -> int:
    """Where the name ends that the text begins with, whatever its case; -1 if it does not."""
    if text[: len(low)].lower() == low:
        return len(low)
    at = len(text) - len(text.lstrip(_WHITE))
    return at + len(low) if _folded(text[at : at + len(low)]) == low else -1


def _first_named(sentence: str, named: list[tuple[str, str]]) -> str | None:
    """As ``text.primary_speaker``. named: (lower case, name), sorted by name."""
    low, best = sentence.lower(), None
    place = len(low)
    for key, name in named:
        at = low.find(key, 0, place + len(key) - 1)
        while at >= 0 and not ((at == 0 or _ends(low, at)) and _ends(low, at + len(key))):
            at = low.find(key, at + 1, place + len(key) - 1)
        if 0 <= at < place:
            best, place = name, at
            if at == 0:
                break
    return best


def _found(text: str) -> tuple[frozenset[str], frozenset[str]]:
    """The lower-cased words, and those of them that may tell of an action."""
    words = frozenset(_WORDS.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORDS.findall(text)])
    return words, frozenset(w for w in words if len(w) > 2) - _STOP_WORDS


def _told(line: str) -> tuple[str | None, str, str]:
    """Whose line it is, in lower case, what is said, and its first character; nothing without a colon."""
    found = _OWNER.match(line)
    return (found[1].strip(L.WHITE).lower(), found[2], _folded(found[2].lstrip(_WHITE)[:1])) if found else (None, "", "")


def _remembering(work):
    """work, with the results of the last brief texts kept: people repeat themselves, and each other."""
    kept = lru_cache(REMEMBERED)(work)
    return lambda text: kept(text) if len(text) <= BRIEF else work(text)


_words, _line = _remembering(_found), _remembering(_told)


class Evidence:
    """What each speaker said or was told to do. A line counts for the speaker before its colon, and for a speaker it
    opens by addressing."""

    def __init__(self, dialogue: str, speakers: list[str], names: frozenset[str]):
        lows = {s: s.lower() for s in speakers}
        owners = {low: s for s, low in reversed(lows.items())}  # of equals the first
        firsts = {low[0] for low in owners}
        self.actions: dict[str, list[frozenset[str]]] = {s: [] for s in speakers}
        self.words: dict[str, list[frozenset[str]]] = {s: [] for s in speakers}
        for line in dialogue.splitlines() if speakers else ():
            by, said, first = _line(line)
            owner = owners.get(by)
            mine = [] if owner is None else [owner]
            if first in firsts:
                mine += [s for s, low in lows.items() if s != owner and (end := _opened(said, low)) >= 0 and _DIRECTED.match(said, end)]
            if mine:
                words, telling = _words(said)
                for s in mine:
                    self.actions[s].append(telling - names)
                    self.words[s].append(words)

    def has(self, name: str, verb: str) -> bool:
        for said in self.words[name]:
            if verb in said:
                return True
        return False

    def support(self, unit: dict) -> float:
        return self.share(unit["words"], unit["speaker"])

    def share(self, words: frozenset[str], name: str | None) -> float:
        """The largest share of the words that one of the speaker's utterances has; 0 without utterances."""
        return max((len(words & u) for u in self.actions.get(name, ())), default=0) / max(1, len(words))

    def better(self, words: frozenset[str], assigned: str, verb: str) -> str | None:
        """The speaker whose words support the claim best, and enough, if the assigned one's do not."""
        if self.has(assigned, verb):
            return None
        most, name = max(((self.share(words, s), s) for s in self.words if s != assigned and self.has(s, verb)), default=(0.0, None))
        return name if most >= L.BEST_SUPPORT else None


def _repaired(dialogue: str, summary: str, speakers: list[str]) -> tuple[str, list[dict]]:
    named = [(s.lower(), s) for s in sorted(speakers)]
    names = frozenset(w for low, _ in named for w in low.split(" "))
    evidence = Evidence(dialogue, speakers, names)
    texts = [t for u in _UNIT.findall(summary.strip(L.WHITE)) if u[-1] in ".!?" and (t := u.strip(L.WHITE))]
    units, log = [], []

    def unit(text: str) -> dict:
        return {"text": text, "speaker": _first_named(text, named), "words": _words(text)[1] - names}

    for k, text in enumerate(texts, 1):
        one = unit(text)
        who = one["speaker"]
        end = -1 if who is None else _opened(text, who.lower())
        claim = _CLAIM.match(text, end) if end >= 0 else None
        to = evidence.better(one["words"], who, claim[1].lower()) if claim else None
        if to is not None:
            log.append(_NOTHING | {"sentence": k, "from": who, "to": to, "action": claim[1].lower(), "reason": L.WRONG_ACTOR})
            one = unit(to + text[end:] if _ends(text, end) else text)
        units.append(one)
    drops = similar.dropped(units, evidence.support)
    log += [_NOTHING | {"removed_sentence": d["drop"], "kept_sentence": d["keep"], "reason": d["reason"]} for d in drops]
    gone = {d["drop"] for d in drops}
    return " ".join(u["text"] for k, u in enumerate(units, 1) if k not in gone) or summary.strip(L.WHITE), log


def _pass(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for dialogues, summaries, speakers in batches:
        rows = [_repaired(d, s, names.split("\n") if names else []) for d, s, names in zip(dialogues, summaries, speakers)]
        yield pd.DataFrame({"repaired": pd.Series([r[0] for r in rows], dtype=object), "log": pd.Series([r[1] for r in rows], dtype=object)})


_pass.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}


def repair(df: DataFrame, dialogue: str = "dialogue", summary: str = "summary", into: str = "repaired", log: str = "attribution_repairs") -> DataFrame:
    """Adds the repaired summary and the records of what was done. Null texts count as empty."""
    columns = df.columns
    said = F.coalesce(F.col(dialogue), F.lit(""))
    found = F.pandas_udf(_pass, RESULT)(said, F.coalesce(F.col(summary), F.lit("")), F.array_join(facts.speakers(said), "\n"))  # names have no line ends
    return df.withColumn("_repair", found).withColumns({into: F.col("_repair.repaired"), log: F.col("_repair.log")}).select(*[c for c in columns if c not in (into, log)], into, log)

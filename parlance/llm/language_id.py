"""Language identification by cross-parsing: suffix automata of labelled text, one per language.

A text is parsed against a language from left to right: the longest match with any substring of the
language's sample is one phrase, then the next begins. The fewer phrases, the closer the language.
Phrases are normalised to the cross-parsing entropy, phrases * log2(sample letters) / letters of the
text, and the language of the least wins (ties: the first by name).

The automata are built on the driver from a bounded sample of labelled rows: of each language the
documents of the least hash, until ``sample_chars`` characters. They become one table of transitions
in which a broken match already leads on from the root, so that many documents, in all languages,
advance by one character with one array lookup. The table has columns for the most frequent letters, as
many as TABLE_BYTES hold, DENSE at most; the edges of the others are looked up by state and letter in
one sorted list, a few entries per sampled character. So the size follows the parameters and the
number of languages only, and any number of languages and letters gives the same answers.

Letters are compared in lower case; what is no letter counts as one blank, combining marks as
nothing. Cases: a null text, or one without letters, is ``und`` with score 0. Letters that no sample
has are phrases of their own in every language. Rows with a null label or text teach nothing; with
no labelled row at all, every text is ``und``. Repeated rows are judged alike. Very long texts are
parsed whole. An empty table gives an empty result. Only the id, text and label columns are read, so
others cannot clash, and the label is never read in a prediction.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import carried, crc_bucket, restored, text_slices

SAMPLE_CHARS = 24_000
#: Documents per language from which the sample is taken.
SAMPLE_DOCS = 48
#: Bytes that the table of transitions should not exceed; with many languages it has fewer columns.
TABLE_BYTES = 128 << 20
UNKNOWN = "und"
_BLANK, _OTHER = 0, 1
#: Letters that have a column of the table.
DENSE = 250


def normal(text: str) -> str:
    """Lower-case letters; other characters as single blanks; marks dropped."""
    out, blank = [], True
    for c in text:
        low = c.lower()[0]
        if low.isalpha():
            out.append(low)
            blank = False
        elif not blank and not unicodedata.category(c).startswith("M"):
            out.append(" ")
            blank = True
    return "".join(out)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts the substrings of codes; state 0 is the root."""
    follow: list[dict[int, int]] = [{}]
    link, reach = [-1], [0]
    last = 0
    for code in codes:
        now = len(follow)
        follow.append({})
        link.append(0)
        reach.append(reach[last] + 1)
        p = last
        while p != -1 and code not in follow[p]:
            follow[p][code] = now
            p = link[p]
        if p != -1:
            q = follow[p][code]
            if reach[q] == reach[p] + 1:
                link[now] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                reach.append(reach[p] + 1)
                while p != -1 and follow[p].get(code) == q:
                    follow[p][code] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return follow


@dataclass
class Parser:
    """table[state * width + code]: next state of any language, doubled, plus 1 if a phrase ended. Codes
    from width on: goals at the place of state * span + code in keys, or else begins[language, code - width]."""

    langs: list[str]
    scale: np.ndarray  # log2 of each sample's length
    letters: dict[str, int]
    roots: np.ndarray
    width: int
    table: np.ndarray
    span: int
    keys: np.ndarray
    goals: np.ndarray
    begins: np.ndarray

    @staticmethod
    def fit(samples: dict[str, str], table_bytes: int = TABLE_BYTES) -> Parser:
        langs = sorted(samples)
        texts = [normal(samples[x]) for x in langs]
        seen = Counter("".join(texts))
        seen.pop(" ", None)
        letters = {c: k + 2 for k, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}  # the most frequent first
        automata = [suffix_automaton([letters.get(c, _BLANK) for c in text]) for text in texts]
        roots = np.cumsum([0, *map(len, automata)])
        span = len(letters) + 2
        width = max(2, min(span, DENSE + 2, table_bytes // (4 * max(1, int(roots[-1])))))
        begins = np.zeros((len(langs), span - width), np.int32)
        table = np.empty((int(roots[-1]), width), np.int32)
        keys, goals = [], []
        for lang, (follow, root) in enumerate(zip(automata, roots.tolist())):
            begin = np.full(span, root * 2 + 1, np.int32)
            begin[list(follow[0])] = [(root + s) * 2 + 1 for s in follow[0].values()]
            begins[lang] = begin[width:]
            table[root : root + len(follow)] = begin[:width]
            state = np.repeat(np.arange(root, root + len(follow)), [len(edges) for edges in follow])
            code = np.array([c for edges in follow for c in edges], np.int64)
            goal = (root + np.array([to for edges in follow for to in edges.values()], np.int64)) * 2
            dense = code < width
            table[state[dense], code[dense]] = goal[dense]
            keys.append(state[~dense] * span + code[~dense])
            goals.append(goal[~dense].astype(np.int32))
            automata[lang] = []  # its edges are in the table now
        keys, goals = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, goals))
        order = np.argsort(keys)
        scale = np.array([math.log2(max(2, len(t))) for t in texts])
        return Parser(langs, scale, letters, roots[:-1].astype(np.int64), width, table.ravel(), span, keys[order], goals[order].astype(np.int32), begins)

    def codes(self) -> np.ndarray:
        """The code of every code point; the type's largest number for what is dropped."""
        out = np.full(0x110000, _BLANK, np.uint8 if self.span <= 255 else np.uint16 if self.span <= 65_535 else np.uint32)
        for point in range(0x110000):
            if 0xD800 <= point < 0xE000:
                continue
            c = chr(point)
            low = c.lower()[0]
            if low.isalpha():
                out[point] = self.letters.get(low, _OTHER)
            elif unicodedata.category(c).startswith("M"):
                out[point] = np.iinfo(out.dtype).max
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of coded texts (rows) in each language (columns). A text's last phrase counts."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(t) for t in texts], np.int64)[order]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        k = 0
        while k < len(order) and lengths[k]:
            stop = k + max(1, min(len(order) - k, LANE_CELLS // int(lengths[k])))
            lanes = lengths[k:stop]
            padded = np.zeros((int(lanes[0]), stop - k), texts[order[k]].dtype)
            for j, i in enumerate(order[k:stop].tolist()):
                padded[: lanes[j], j] = texts[i]
            active = np.searchsorted(-lanes, -np.arange(int(lanes[0])), side="left")  # lanes longer than t
            state = np.repeat(self.roots[:, None], stop - k, axis=1)
            count = np.zeros(state.shape, np.int64)
            count[:] = 1
            width, table = self.width, self.table
            for t in range(int(lanes[0])):
                n = active[t]
                if n < state.shape[1]:
                    out[order[k + n : k + state.shape[1]]] = count[:, n:].T
                    state, count = np.ascontiguousarray(state[:, :n]), np.ascontiguousarray(count[:, :n])
                code = padded[t, :n]
                rare = np.flatnonzero(code >= width) if len(self.keys) else ()
                if len(rare):
                    of = code[rare].astype(np.int64)
                    key = state[:, rare] * self.span + of
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    code = np.where(code < width, code, _OTHER)
                    step = table.take(state * width + code)
                    step[:, rare] = np.where(self.keys[at] == key, self.goals[at], self.begins[:, of - width])
                else:
                    step = table.take(state * width + code)
                count += step & 1
                state = (step >> 1).astype(np.int64)
            out[order[k : k + state.shape[1]]] = count.T
            k = stop
        return out


#: Bytes of text that are coded at once.
SLICE_BYTES = 4 << 20
#: Characters that documents of one lockstep group hold, padding included.
LANE_CELLS = 2 << 20


#: Characters whose code points are held at once while texts are coded.
CODED_CHARS = 1 << 20


def code_texts(codes: np.ndarray, texts: list[str | None]) -> list[np.ndarray]:
    """Each text as one code per letter, runs of other characters as one blank. Only the codes of all
    texts are kept; code points and places are held for CODED_CHARS characters (or one text) at a time."""
    out: list[np.ndarray] = []
    drop = np.iinfo(codes.dtype).max
    sizes = np.cumsum([len(t) if t else 0 for t in texts])
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CODED_CHARS, side="right")))
        part = [t or "" for t in texts[at:stop]]
        coded = codes[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(part), dtype=np.int32), [len(t) for t in part])
        keep = coded != drop
        coded, owner = coded[keep], owner[keep]
        if len(coded):
            begins = np.concatenate(([True], owner[1:] != owner[:-1]))
            after_blank = np.concatenate(([True], coded[:-1] == _BLANK))
            keep = ~((coded == _BLANK) & (after_blank | begins))
            coded, owner = coded[keep], owner[keep]
        ends = np.searchsorted(owner, np.arange(len(part) + 1))
        out += [coded[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        at = stop
    return out


def predict_texts(parser: Parser, codes: np.ndarray, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, score, least entropy) of each text. The score is 1 - least / next entropy."""
    parts = code_texts(codes, texts)
    has = [bool((p != _BLANK).any()) for p in parts]
    if not parser.langs:
        return [(UNKNOWN, 0.0, 0.0)] * len(texts)
    entropy = parser.phrases(parts) * parser.scale / np.maximum(1, [len(p) for p in parts])[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(len(texts)), best]
    rest = np.sort(entropy, axis=1)[:, 1] if len(parser.langs) > 1 else np.full(len(texts), np.inf)
    score = np.clip(1 - least / np.maximum(rest, 1e-300), 0, 1)
    return [(parser.langs[b], float(s), float(e)) if h else (UNKNOWN, 0.0, 0.0) for b, s, e, h in zip(best.tolist(), score, least, has)]


def fit_parser(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS) -> Parser:
    """docs: the labelled rows to learn from. Only ids travel until the sample is chosen."""
    useful = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    ids = useful.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.length(text_col)).alias("key"))
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))).filter(F.col("rank") <= sample_docs)
    chosen = F.broadcast(ranked.select("lang", "id", "key").distinct())  # sample_docs per language at most
    own = useful.select(F.col(lang_col).alias("lang_"), F.col(id_col).alias("id_"), F.substring(F.col(text_col), 1, sample_chars).alias("text"), F.xxhash64(F.col(id_col), F.length(text_col)).alias("key"))
    own = own.join(chosen, own.id_.eqNullSafe(chosen.id) & (own.lang_ == chosen.lang) & (own.key == chosen.key), "left_semi")
    # rows that share id and length come along together: the sample is cut again, before it is shuffled
    last = F.row_number().over(Window.partitionBy("lang_").orderBy("key", "text"))
    rows = own.select("lang_", "key", "text").withColumn("rank", last).filter(F.col("rank") <= sample_docs).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang_"], r["key"], r["text"])):
        have = samples.get(r["lang_"], "")
        if len(have) < sample_chars:
            samples[r["lang_"]] = (have + "\n" + r["text"])[:sample_chars]
    return Parser.fit(samples)


def predict(spark: SparkSession, docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Returns id_col, lang_pred, score, entropy. keep: these columns come along in place of id_col, the
    text as ``text``, the others in the struct ``row``."""
    shared = spark.sparkContext.broadcast((parser, parser.codes()))
    row = F.col(id_col) if keep is None else carried(keep, text_col)
    source = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    carry = 1 if keep is None else 2
    schema = T.StructType([*source.schema.fields[:carry], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = shared.value
        for part in (p for b in batches for p in text_slices(b, 1, SLICE_BYTES)):
            found = predict_texts(own, codes, part.column(1).to_pylist())
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:carry], *columns], schema.names)

    out = source.mapInArrow(run, schema)
    return out if keep is not None else out.withColumnRenamed("row", id_col)


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """Learns from the rows outside the held-out fold and judges every row. Returns id_col, held_out,
    lang_pred, score, entropy."""
    parser = fit_parser(docs.filter(crc_bucket(id_col, folds) != held_out), id_col, text_col, lang_col, **options)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), (crc_bucket(id_col, folds) == held_out).alias("fold")).alias("row"), F.col(text_col).alias("text"))
    out = predict(spark, rows, parser, "row", "text")
    return out.select(F.col("row.id").alias(id_col), F.col("row.fold").alias("held_out"), "lang_pred", "score", "entropy")


def keep_identified(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """docs without those that have no language; all columns as they were."""
    parser = fit_parser(docs.filter(crc_bucket(id_col, folds) != held_out), id_col, text_col, lang_col, **options)
    found = predict(spark, docs, parser, id_col, text_col, keep=docs.columns)
    return found.filter(F.col("lang_pred") != UNKNOWN).select(*restored(docs.columns, text_col))

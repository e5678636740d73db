"""Structure of long dialogues: repeated blocks, chunks under a token budget, truncation, routing.

Token counts come from the built-in white-space tokenizer, whose counts add up when texts are
joined; that is what lets a fold pack chunks in one pass. ``parlance.operators.tokens.Subword`` has the same
operators for tokenizers without that property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X

CHUNK = "struct<text:string,turn_indices:array<int>,token_count:int>"
PIECE = "struct<idx:int,line:string,n:int>"


def collapse(turns: Column, text: Column, least: int = 4) -> Column:
    """struct<text, provenance map<int, array<int>>>. If the lines are two or more copies of one block
    of ``least`` lines at least, the (smallest) block and all source lines of each of its lines; else
    the stripped text and each line's own source."""
    lines = F.transform(turns, lambda t: t["line"])
    bound = F.struct(turns.alias("turns"), lines.alias("lines"), F.size(turns).alias("n"))
    return X.let(X.let(bound, lambda x: F.struct(x["turns"].alias("turns"), x["lines"].alias("lines"), x["n"].alias("n"), _block(x["lines"], x["n"], least).alias("size"))), lambda x: _collapsed(x, text))


def _upto(first: Column, last: Column) -> Column:
    """first..last as integers, empty if last is less (``sequence`` alone would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _block(lines: Column, n: Column, least: int) -> Column:
    """The smallest size of a block that the lines repeat, or null."""
    sizes = F.filter(_upto(F.lit(least), F.floor(n / 2).cast("int")), lambda k: n % k == 0)
    fits = F.filter(sizes, lambda k: F.forall(_upto(F.lit(0), n - 1), lambda p: F.get(lines, p) == F.get(lines, p % k)))
    return F.get(fits, F.lit(0))


def _collapsed(x: Column, text: Column) -> Column:
    own = F.coalesce(x["size"], x["n"])
    keys = _upto(F.lit(0), own - 1)
    sources = F.transform(keys, lambda p: F.transform(F.filter(x["turns"], lambda t, q: q % own == p), lambda t: t["idx"]))
    return F.struct(
        F.when(x["size"].isNull(), X.strip(text)).otherwise(F.array_join(F.slice(x["lines"], 1, own), "\n")).alias("text"),
        F.map_from_arrays(keys, sources).alias("provenance"),
    )


def deduplicated_turns(provenance: Column) -> Column:
    return F.aggregate(F.map_values(provenance), F.lit(0), lambda n, x: n + F.size(x) - 1)


def token_windows(tokens: Column, budget: int, overlap: int = L.OVERLAP_TOKENS) -> Column:
    """Overlapping windows of budget tokens, blank-joined; the last one reaches the end."""
    step = max(1, budget - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - budget) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(tokens, k * step + 1, budget), " "))


def pack(parts: Column, budget: int, glue: str) -> Column:
    """Greedy packing of array<struct<idx, line, n>> into array<CHUNK>: a chunk closes when the next
    part would put it over the budget, and never empty."""

    def closed(lines: Column, idx: Column, n: Column) -> Column:
        return F.struct(F.array_join(lines, glue).alias("text"), F.array_distinct(idx).alias("turn_indices"), n.alias("token_count")).cast(CHUNK)

    first = F.struct(
        F.array().cast(f"array<{CHUNK}>").alias("done"), X.no_strings().alias("lines"), F.array().cast("array<int>").alias("idx"), F.lit(0).alias("n")
    )

    def step(acc: Column, part: Column) -> Column:
        full = (F.size(acc["lines"]) > 0) & (acc["n"] + part["n"] > budget)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(closed(acc["lines"], acc["idx"], acc["n"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(part["line"])).otherwise(F.concat(acc["lines"], F.array(part["line"]))).alias("lines"),
            F.when(full, F.array(part["idx"])).otherwise(F.concat(acc["idx"], F.array(part["idx"]))).alias("idx"),
            F.when(full, part["n"]).otherwise(acc["n"] + part["n"]).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["lines"]) > 0, F.concat(acc["done"], F.array(closed(acc["lines"], acc["idx"], acc["n"])))).otherwise(acc["done"])

    return F.aggregate(parts, first, step, finish)


def _parts(idx: Column, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(idx.alias("idx"), t.alias("line"), X.token_count(t).alias("n")).cast(PIECE))


def split_long_turn(idx: Column, turn: Column, budget: int, overlap: int = L.OVERLAP_TOKENS) -> Column:
    """array<PIECE> of one turn over the budget: its sentences, those over the budget as windows, and
    neighbours packed together again with a blank."""
    units = X.sentences(turn)
    units = F.when(F.size(units) > 0, units).otherwise(F.array(turn))
    small = F.flatten(F.transform(units, lambda s: F.when(X.token_count(s) <= budget, F.array(s)).otherwise(token_windows(X.tokens(s), budget, overlap))))
    return F.transform(pack(_parts(idx, small), budget, " "), lambda c: F.struct(idx.alias("idx"), c["text"].alias("line"), c["token_count"].alias("n")).cast(PIECE))


def chunks(turns: Column, budget: int = L.CHUNK_TOKENS, overlap: int = L.OVERLAP_TOKENS, split: bool = True) -> Column:
    """array<CHUNK>: the turns in order, whole where they fit, under the token budget. Without ``split`` all turns
    are whole, and one over the budget is a chunk of its own."""

    def pieces(t: Column) -> Column:
        n = X.token_count(t["line"])
        whole = F.array(F.struct(t["idx"].alias("idx"), t["line"].alias("line"), n.alias("n")).cast(PIECE))
        if not split:
            return whole
        return F.when(n <= budget, whole).otherwise(split_long_turn(t["idx"], t["line"], budget, overlap))

    return pack(F.flatten(F.transform(turns, pieces)), budget, "\n")


def chunk_dialogues(df: DataFrame, dialogue: str = "dialogue", budget: int = L.CHUNK_TOKENS, into: str = "chunks", strict: bool = False, tokens=None) -> DataFrame:
    """Adds chunks and error_code: EMPTY_DIALOGUE for a blank or null dialogue, COVERAGE if the chunks
    and the turns do not hold the same indexes. strict raises instead. tokens: the tokenizer, of
    ``parlance.operators.tokens`` (none: the built-in one)."""
    packed = chunks if tokens is None else tokens.chunks
    columns = [c for c in df.columns if c not in (into, "error_code")]
    work = df.withColumn("_turns", X.turns(F.coalesce(F.col(dialogue), F.lit("")))).withColumn(into, packed(F.col("_turns"), budget))
    expected = F.transform("_turns", lambda t: t["idx"])
    covered = F.array_distinct(F.flatten(F.transform(into, lambda c: c["turn_indices"])))
    differ = (F.size(F.array_except(expected, covered)) > 0) | (F.size(F.array_except(covered, expected)) > 0)
    code = F.when(F.size("_turns") == 0, "EMPTY_DIALOGUE").when(differ, "COVERAGE")
    if strict:
        code = F.when(code.isNotNull(), F.raise_error(code)).otherwise(F.lit(None).cast("string"))
    return work.withColumn("error_code", code).select(*columns, into, "error_code")


def prompt_parts(instruction: str) -> tuple[str, str]:
    """What the public instruction template has before and after its input."""
    head = (
        "Below is an instruction that describes a task, paired with an input that provides further context. "
        f"Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Input:\n"
    )
    return head, "\n\n### Response:\n"


def format_prompt(instruction: str, text: Column) -> Column:
    head, tail = prompt_parts(instruction)
    return F.concat(F.lit(head), text, F.lit(tail))


def sections(summaries: Column) -> Column:
    """The summaries as numbered lines."""
    return F.array_join(F.transform(summaries, lambda s, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(": "), s)), "\n")


def merge_prompt(text: Column) -> Column:
    return format_prompt(L.MERGE_INSTRUCTION, text)


def direct_prompt(text: Column, budget: int = L.PROMPT_TOKENS) -> Column:
    """struct<prompt, truncated, coverage>; null where no truncation fits. The kept length starts at
    80 % (200 at least) and shrinks by a fifth while above 200; 70 % of it is the head."""
    return X.let(X.strip(text), lambda clean: _direct(clean, budget))


def _direct(clean: Column, budget: int) -> Column:
    whole = format_prompt(L.DIRECT_INSTRUCTION, clean)
    n = F.length(clean)

    def less(length: Column) -> Column:
        return F.floor(length.cast("double") * F.lit(0.8)).cast("int")

    first = F.array(F.greatest(F.lit(200), less(n)))
    ladder = F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda acc, _: F.concat(acc, F.array(less(F.element_at(acc, -1))))), lambda k: k > 200)

    def kept(k: Column) -> Column:
        head = F.floor(k.cast("double") * F.lit(0.7)).cast("int")
        short = F.concat(F.substr(clean, F.lit(1), head), F.lit(L.TRUNCATION_MARK), F.right(clean, k - head))
        return F.struct(format_prompt(L.DIRECT_INSTRUCTION, short).alias("prompt"), F.lit(True).alias("truncated"), F.least(F.lit(1.0), k / F.greatest(F.lit(1), n)).alias("coverage"))

    fitting = F.get(F.filter(F.transform(ladder, kept), lambda x: X.token_count(x["prompt"]) <= budget), F.lit(0))
    return F.when(X.token_count(whole) <= budget, F.struct(whole.alias("prompt"), F.lit(False).alias("truncated"), F.lit(1.0).alias("coverage"))).otherwise(fitting)


def route(mode: str, prompt_tokens: Column, budget: int = L.PROMPT_TOKENS) -> Column:
    """direct if asked for, or if ``auto`` and the whole prompt fits; else hierarchical."""
    if mode not in ("auto", "direct", "hierarchical"):
        raise ValueError("mode must be auto, direct, or hierarchical")
    if mode != "auto":
        return F.lit(mode)
    return F.when(prompt_tokens <= budget, "direct").otherwise("hierarchical")

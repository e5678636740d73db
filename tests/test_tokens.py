"""Packing in a subword tokenizer's tokens against plain loops; generation for those who need it; one model at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators import generation, structure, tokens
from parlance.plans import summarize

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def loaders():
    return {"bpe": lambda: tokens.FromFile(BPE), "pieces": lambda: tokens.FromModel(PIECES)}


# ---- plain loops: part after part, measuring the joined text each time ----------------------


def plain_pack(count, parts, budget, glue):
    out = []
    for part in parts:
        if out and count(glue.join(p for _, p in [*out[-1], part])) <= budget:
            out[-1].append(part)
        else:
            out.append([part])
    return out


def plain_chunks(tokenizer, turns, budget, overlap=20):
    count = lambda t: len(tokenizer.encode(t))
    parts = []
    for idx, line in turns:
        if count(line) <= budget:
            parts.append((idx, line))
            continue
        pieces = []
        for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", line) if s.strip()] or [line]:
            ids, at = tokenizer.encode(s), 0
            if len(ids) <= budget:
                pieces.append((idx, s))
                continue
            while True:
                pieces.append((idx, tokenizer.decode(ids[at : at + budget]).strip()))
                if at + budget >= len(ids):
                    break
                at += max(1, budget - overlap)
        parts += [(idx, " ".join(p for _, p in group)) for group in plain_pack(count, pieces, budget, " ")]
    groups = plain_pack(count, parts, budget, "\n")
    return [("\n".join(p for _, p in g), list(dict.fromkeys(i for i, _ in g)), count("\n".join(p for _, p in g))) for g in groups]


def random_dialogue(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "qu", "ing", "x", "é", "中", "0", "'s", "tion", "zz"]) for _ in range(rng.randint(1, 4)))
    lines = []
    for _ in range(rng.randint(1, 25)):
        said = " ".join(word() + rng.choice(["", "", "", ".", "?", ","]) for _ in range(rng.choice([0, 3, 8, 20, 90, 200])))
        lines.append(f"{rng.choice(['Ann', 'Bob'])}: {said}" if rng.random() < 0.9 else rng.choice(["", "  ", "\t"]))
    return "\n".join(lines)


@pytest.mark.parametrize("name", ["bpe", "pieces"])
def test_chunks_equal_a_plain_loop(spark, name):
    load = loaders()[name]
    rows = [(k, random_dialogue(k)) for k in range(40)] + [(90, None), (91, " \n "), (92, "x" * 900)]
    df = spark.createDataFrame(rows, "id int, dialogue string").repartition(3)
    tokenizer, budget = load(), 60
    out = structure.chunk_dialogues(df, budget=budget, tokens=tokens.Subword(load)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.id] or ""
        turns = [(i, line.strip()) for i, line in enumerate(text.splitlines()) if line.strip()]
        assert [(c.text, c.turn_indices, c.token_count) for c in r.chunks] == plain_chunks(tokenizer, turns, budget)
        assert r.error_code == (None if turns else "EMPTY_DIALOGUE")
        assert all(c.token_count <= budget or "\ufffd" in c.text or name == "pieces" for c in r.chunks)


@pytest.mark.parametrize("name", ["bpe", "pieces"])
def test_windows_direct_and_groups_equal_plain_loops(spark, name):
    load = loaders()[name]
    tokenizer, own = load(), tokens.Subword(load)
    count = lambda t: len(tokenizer.encode(t))
    texts = [random_dialogue(100 + k) for k in range(25)] + ["", "short one", "word " * 900, None]
    summaries = [[f"Summary {k} of " + t[:200].replace("\n", " ") for k, t in enumerate(texts[:m]) if t] for m in range(len(texts))]
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(zip(texts, summaries))], "id int, t string, s array<string>")
    out = df.select("id", own.count(F.col("t")).alias("n"), own.total(F.col("s")).alias("total"), own.windows(F.col("t"), 50, 10).alias("w"), own.direct(F.col("t"), 300).alias("d"), own.groups(F.col("s"), 320).alias("g")).collect()
    head, tail = structure.prompt_parts(L.DIRECT_INSTRUCTION)
    mhead, mtail = structure.prompt_parts(L.MERGE_INSTRUCTION)
    for r, text, listed in zip(sorted(out), texts, summaries):
        assert r.total == sum(map(count, listed))
        groups = []
        for s in listed:
            more = [*groups[-1], s] if groups else None
            if more and count(mhead + "\n".join(f"Section {i}: {x}" for i, x in enumerate(more, 1)) + mtail) <= 320:
                groups[-1] = more
            else:
                groups.append([s])
        assert r.g == groups
        if text is None:
            assert (r.n, r.w, r.d) == (None, None, None)
            continue
        ids = tokenizer.encode(text)
        assert r.n == len(ids)
        at, want = 0, []
        while True:
            want.append(tokenizer.decode(ids[at : at + 50]).strip())
            if at + 50 >= len(ids):
                break
            at += 40
        assert r.w == want
        clean = text.strip()
        if count(head + clean + tail) <= 300:
            assert tuple(r.d) == (head + clean + tail, False, 1.0)
            continue
        keep, found = max(200, int(len(clean) * 0.8)), None
        while keep > 200 and not found:
            a = int(keep * 0.7)
            prompt = head + clean[:a] + L.TRUNCATION_MARK + clean[-(keep - a) :] + tail
            found = (prompt, True, min(1.0, keep / len(clean))) if count(prompt) <= 300 else None
            keep = int(keep * 0.8)
        assert (tuple(r.d) if r.d else None) == found


def test_search_measures_few_texts():
    class Words:
        def encode(self, text):
            return text.split()

    own = tokens.Packer(Words())
    turns = [(k, "a b c d") for k in range(2000)]
    chunks = own.chunks(turns, 280)
    assert [c["token_count"] for c in chunks[:-1]] == [280] * (len(chunks) - 1)
    assert own.measured <= 2 * len(turns) + 4 * len(chunks)  # not once for each part of a chunk


def test_summary_in_subword_tokens(spark):
    long = "\n".join(f"{'Ann' if i % 2 else 'Bob'}: I will check the unbelievable item {i} and report the result to the team later today." for i in range(60))
    df = spark.createDataFrame([(1, "Ann: I will go.\nBob: Good."), (2, long), (3, None)], "conv_id long, dialogue string")
    load = loaders()["bpe"]
    out = {r.conv_id: r for r in summarize.summarize(spark, df, tokens=tokens.Subword(load)).collect()}
    tokenizer = load()
    assert out[1].actual_mode == "direct" and out[3].error_code == "EMPTY_DIALOGUE"
    assert out[2].actual_mode == "hierarchical" and out[2].chunk_count > 4
    assert all(c.token_count == len(tokenizer.encode(c.text)) <= L.CHUNK_TOKENS for c in out[2].chunks)
    assert out[2].final_tokens == len(tokenizer.encode(out[2].summary))


# ---- generations ---------------------------------------------------------------------------


def counting(spark, tmp_path, answer=None):
    """A generator that leaves a line for each prompt."""
    marks = str(tmp_path / "prompts")

    def load():
        def model(prompts, cap):
            with open(marks, "a") as f:
                f.write("".join(f"{len(p)}\n" for p in prompts))
            return [answer or "All is done." for _ in prompts]

        return model

    def asked():
        try:
            with open(marks) as f:
                return len(f.readlines())
        except FileNotFoundError:
            return 0

    return generation.arrow_generator(load), asked


def test_only_unfinished_summaries_are_sent(spark, tmp_path):
    generator, asked = counting(spark, tmp_path)
    rows = [(k, "It is done." if k else "It is not") for k in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "id int, summary string").coalesce(2)
    out = {r.id: r.summary for r in generation.complete(df, "summary", generator).collect()}
    assert asked() == 1 and out[0] == "All is done." and out[5] == "It is done."


def test_actions_on_a_result_ask_nothing(spark, tmp_path):
    generator, asked = counting(spark, tmp_path)
    long = "\n".join(f"{'Ann' if i % 2 else 'Bob'}: I will check item {i} and report the result to the team later today." for i in range(60))
    df = spark.createDataFrame([(k, f"Ann: I will take {k}.\nBob: Good.") for k in range(9)] + [(9, long), (10, None)], "conv_id long, dialogue string")
    out = summarize.summarize(spark, df, generator)
    once = asked()
    chunks = out.filter("conv_id = 9").head().chunk_count
    assert chunks > 1 and once == 9 + chunks + 1  # a prompt for each direct dialogue, for each section, for the merge
    assert out.count() == 11 and out.select("summary").distinct().count() == 2 and len(out.collect()) == 11
    assert asked() == once


def test_one_model_is_resident(monkeypatch):
    monkeypatch.setattr(generation, "_RESIDENT", {})
    log = []

    class Model:
        def __init__(self, name):
            log.append(("load", name))
            self.name = name

        def close(self):
            log.append(("close", self.name))

    for name in ("a", "a", "b", "c", "c", "a"):
        assert generation.resident(name, lambda name=name: Model(name)).name == name
        assert len(generation._RESIDENT) == 1
    assert log == [("load", "a"), ("close", "a"), ("load", "b"), ("close", "b"), ("load", "c"), ("close", "c"), ("load", "a")]


def test_jobs_hold_one_model_a_worker(spark, tmp_path):
    held = str(tmp_path / "held")

    def load():
        def model(prompts, cap):
            with open(held, "a") as f:
                f.write(f"{len(generation._RESIDENT)}\n")
            return ["Done." for _ in prompts]

        return model

    df = spark.createDataFrame([(k, f"Ann: I will take {k}.") for k in range(6)], "conv_id long, dialogue string").repartition(3)
    out = summarize.compare(spark, df, [(str(k), generation.arrow_generator(load), "direct") for k in range(4)])
    assert out.count() == 24 and out.select("job").distinct().count() == 4
    with open(held) as f:
        assert set(f.read().split()) == {"1"}


def test_white_space_is_the_built_in(spark):
    row = spark.createDataFrame([("a b  c", ["x y", None, "z"])], "t string, s array<string>").select(
        tokens.BUILT_IN.count(F.col("t")).alias("n"), tokens.BUILT_IN.total(F.col("s")).alias("total"), tokens.BUILT_IN.windows(F.col("t"), 2, 1).alias("w"), X.token_count(F.col("t")).alias("m")
    ).head()
    assert (row.n, row.total, row.w, row.m) == (3, 3, ["a b", "b c"], 3)

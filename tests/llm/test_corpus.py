"""Decontamination, duplicates, language and scoring against brute force and odd rows; the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import common, decontaminate, exact_dedup, fm_index, hmm_score, jaccard_join, language_id, line_dedup, mixing
from parlance.llm.components import components

ODD = [None, "", " \n\t ", "a", "xy " * 10_000, "one two three", "Ünï çödé 中文 😀", "\x00\x1f ", "one two three"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "s" if i % 2 else None, "en" if i % 3 else None, -1, i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, row int")


def empty(df):
    return df.filter("1 = 0")


# ---- FM-index ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_equals_a_scan(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, rng.integers(1, 9), int(rng.integers(0, 400)))
    assert fm_index.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = fm_index.FMIndex(text, sample=5)
    for size in (1, 2, 5):
        phrases = rng.integers(0, 10, (60, size))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), low, high):
            want = [i for i in range(len(text) - size + 1) if text[i : i + size].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_array_of_repeats():
    text = np.tile([3, 1, 2], 500)
    assert fm_index.suffix_array(text).tolist() == sorted(range(1500), key=lambda i: text[i:].tolist())


# ---- decontamination -----------------------------------------------------------------------


def contaminated(docs, items, window):
    out = {}
    for i, text in docs:
        words = decontaminate.words_of(text)
        hit, found = set(), set()
        for name, item in items:
            w = decontaminate.words_of(item)
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add("" if name is None else str(name))
        out[i] = (len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def test_decontamination_equals_brute_force(spark, odd, monkeypatch):
    rng = random.Random(1)
    word = lambda: rng.choice(["aa", "b", "Çe", "d1", "e"])
    items = [(k if k != 2 else None, " ".join(word() for _ in range(rng.choice([0, 2, 4, 5, 9])))) for k in range(8)] + [(20, None), (0, "aa b aa b e")]
    docs = [(i, rng.choice([", ", " "]).join(word() for _ in range(rng.randint(0, 60))).upper() + " zz " + (items[i % 8][1] or "")) for i in range(120)] + [(500, None), (501, "aa " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string")
    for most in (10**6, 8):  # one piece, and several
        out = decontaminate.find_contamination(spark, frame, bench, window=5, max_benchmark_words=most).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out}
        assert got == contaminated(docs, items, 5)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in out)
    monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", 11)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 90)
    phrases = decontaminate.Phrases([("" if i is None else str(i), decontaminate.words_of(t)) for i, t in items], 5)
    cut = decontaminate.search_texts([None if t is None else t.encode() for _, t in docs], phrases)  # shards within documents
    want = contaminated(docs, items, 5)
    for (i, _), (n, spans, names) in zip(docs, cut):
        assert (n, sum(b - a for a, b in spans), names) == want[i][:3]
    monkeypatch.undo()
    kept = decontaminate.drop_contaminated(spark, odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert decontaminate.drop_contaminated(spark, empty(odd), bench).count() == 0
    assert decontaminate.find_contamination(spark, odd, empty(bench)).filter("n_hit > 0").count() == 0


def test_pieces_of_a_benchmark_write_the_texts_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 4, f"w{k} w{k + 1} w{k + 2} tail {k}") for k in range(12)] + [(None, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(12)], "item_id int, text string")
    tables = []
    real = common.written
    note = lambda s, df, name, *a: tables.append(df.columns) or real(s, df, name, *a)
    monkeypatch.setattr(common, "written", note)
    monkeypatch.setattr(decontaminate, "written", note)
    whole = decontaminate.find_contamination(spark, docs, bench, window=2)
    assert tables == []
    cut = decontaminate.find_contamination(spark, docs, bench, window=2, max_benchmark_words=4)  # 6 pieces
    assert sum("text" in t for t in tables) == 1 and len(tables) == 8
    assert sorted(cut.collect(), key=str) == sorted(whole.collect(), key=str)
    kept = [decontaminate.drop_contaminated(spark, docs, bench, window=2, max_benchmark_words=m).collect() for m in (4, 10**6)]
    assert sorted(kept[0], key=str) == sorted(kept[1], key=str) and len(kept[0]) == 1


# ---- exact dedup ---------------------------------------------------------------------------


def test_exact_dedup_equals_grouping(spark, odd, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 40, 41]))) for _ in range(80)]
    rows = [(rng.randint(0, 60) if i % 9 else None, rng.choice(texts)) for i in range(300)] + [(5, None), (7, "é" * 20), (8, "é" * 20), (8, "é" * 20)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 24)  # three blocks of eight bytes
    out = exact_dedup.dedup_exact(spark, df, block_bytes=8).collect()
    monkeypatch.undo()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    most = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    import hashlib

    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(out) == len(rows) and Counter((r.doc_id, sha[r.text_sha256]) for r in out) == Counter((i, t or "") for i, t in rows)
    for r in out:
        t = sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (most[t], len(groups[t])) and (not r.kept or r.doc_id == r.keep_id)
    assert Counter(sha[r.text_sha256] for r in out if r.kept) == Counter(list(groups))
    assert len({(r.n_blocks, r.name) for r in out}) == len(groups)
    assert exact_dedup.dedup_exact(spark, odd).filter("kept").count() == len({t or "" for t in ODD})
    assert exact_dedup.dedup_exact(spark, empty(odd)).count() == 0


# ---- Jaccard join --------------------------------------------------------------------------


def shingles(text):
    w = decontaminate.words_of(text)
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def similar_classes(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if i != j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(rows))]
    return linked, root


def test_jaccard_join_equals_all_pairs(spark, odd):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 5, 12, 60, 120]))] for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 50)}"
        rows.append((i % 200 if i != 17 else None, " ".join(w)))
    rows += [(None, None), (300, ""), (301, "...")]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(2)
    linked, root = similar_classes(rows)
    for block in (256, 3):  # candidate sets whole, and cut into many blocks
        out = sorted(jaccard_join.join_similar(spark, df, block=block).collect(), key=lambda r: r.row)
        assert len(out) == len(rows)
        want = Counter()
        for i, (doc, _) in enumerate(rows):
            members = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
            want[doc, min((m for m in members if m is not None), default=None), len(members), len(linked[i])] += 1
        assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in out) == want
        assert sum(r.kept for r in out) == len(set(root))
    kept = jaccard_join.drop_similar(spark, odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    clash = odd.withColumns({"gone": F.lit(1), "_gone": F.lit(2), "_row": F.lit(3), "kept": F.lit(4)})
    kept = jaccard_join.drop_similar(spark, clash)
    assert kept.columns == clash.columns and kept.count() == len(ODD) - 1
    assert jaccard_join.join_similar(spark, empty(odd)).count() == 0


def test_recall_of_the_forest():
    """Pairs at the threshold: met with the target recall; nearer ones meet before the floor."""
    assert jaccard_join.floor_depth(20, 8, 0.8, 0.999) == 5
    signer, rng = jaccard_join.Signer(20, 8), np.random.default_rng(0)

    def pairs(common, n=400):
        out = []
        for _ in range(n):
            x = rng.integers(0, 2**63, 100, dtype=np.uint64)
            out.append([signer(np.concatenate((x[:common], y))).reshape(20, 8) for y in np.split(x[common:], 2)])
        return np.array(out)

    for common, floor, least in ((80, 5, 0.99), (98, 8, 0.99), (80, 8, 0.9)):
        both = pairs(common)
        sizes = (np.full(1, 90), np.full(1, 90))
        met = [jaccard_join.met_pairs(x[None, 0], x[None, 1], sizes, 0.8, floor)[0, 0] for x in both]
        assert np.mean(met) >= least
    few = pairs(20)
    assert np.mean([jaccard_join.met_pairs(x[None, 0], x[None, 1], sizes, 0.8, 5)[0, 0] for x in few]) < 0.2


def test_prefixes_shorten_per_text():
    """A text that has met all of its size stops; one that has not goes on to the floor."""
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 1 << 16, (4, 3, 8)).astype(">u2")
    labels[1] = labels[0]  # 0 and 1 are alike
    labels[2, 1, :5], labels[3, 2, :4] = labels[0, 1, :5], labels[0, 2, :4]
    sizes = np.array([10, 10, 10, 10])
    met = jaccard_join.met_pairs(labels, labels, (sizes, sizes), 0.8, 5)
    assert met[0].tolist() == [True, True, True, False] and not met[3, :3].any()
    assert not jaccard_join.met_pairs(labels, labels, (sizes, sizes), 0.8, 6)[0, 2]
    far = np.array([10, 10, 100, 10])  # of another size: no pair, however alike the labels
    assert not jaccard_join.met_pairs(labels, labels, (sizes, far), 0.8, 5)[0, 2]


def test_shingles_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(11)
    texts = [None, b"", b"..."] + [" ".join(rng.choice(["ab", "c", "Dé", "x1"]) for _ in range(rng.randint(0, 40))).encode() for _ in range(80)]
    texts += [b"y" * 70_000 + b" a " + b"y" * 70_000, b" ".join(b"w%d" % (k % 977) for k in range(30_000))]
    whole = jaccard_join.Shingler()(texts)
    seen = {}
    for t, got in zip(texts, whole):
        assert len(got) == len(shingles(t)) and seen.setdefault(got.tobytes(), shingles(t)) == shingles(t)
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 50)
    assert all((a == b).all() for a, b in zip(jaccard_join.Shingler()(texts), whole))


def test_links_within_a_group_equal_all_pairs(monkeypatch):
    """Tiles smaller than the group: counts and connections of a group of near copies, by brute force."""
    monkeypatch.setattr(jaccard_join, "TILE", 7)
    rng, signer = np.random.default_rng(3), jaccard_join.Signer(20, 8)
    base = rng.integers(0, 2**63, (3, 60), dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[k % 3, : 60 - k % 7], rng.integers(0, 2**63, k % 5, dtype=np.uint64)))) for k in range(40)]
    rows = [(True, True, k, 1 + k % 2, signer(x).tobytes(), x.tobytes()) for k, x in enumerate(sets)]
    similar = np.array([[i != j and 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    want = {k: (int(n), int(similar[k] @ np.array([1 + j % 2 for j in range(40)]))) for k, n in enumerate(similar.sum(1)) if n}
    root = list(range(40))
    for _ in range(40):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(similar[i]))]) for i in range(40)]
    halves = [[(False, k < 15, *r[2:]) for k, r in enumerate(rows)], [(True, True, *r[2:]) for r in rows[:15]], [(True, True, *r[2:]) for r in rows[15:]]]
    for groups in ([rows], halves):  # one block, and two
        counts, joined = Counter(), Counter()
        links = []
        for group in groups:
            for x, y, texts, documents in jaccard_join._verify_group(group, 0.8, 20, 5):
                if y is None:
                    counts[x] += texts
                    joined[x] += documents
                else:
                    links.append((x, y))
        assert {k: (counts[k], joined[k]) for k in counts} == want and all(similar[x, y] for x, y in links)
        found = list(range(40))
        for _ in range(40):
            for x, y in links:
                found[x] = found[y] = min(found[x], found[y])
        assert found == root


def test_results_survive_other_file_splits(spark, tmp_path, monkeypatch):
    """The tables are cut into other splits after an operator's first write: no row is lost or mistaken."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, base[i] if i < 60 else base[i % 60] + (" extra" if i % 2 else ""), "en", "s") for i in range(360)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = "spark.sql.files.minPartitionNum"
    runs = {
        "join": lambda: sorted((r.doc_id, r.class_id, r.class_size, r.n_links) for r in jaccard_join.join_similar(spark, docs).collect()),
        "dedup": lambda: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_exact(spark, docs).collect()),
        "lm": lambda: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in hmm_score.score_documents(spark, docs, states=2, rounds=2).collect()),
        "stage": lambda: sorted(r.doc_id for r in jaccard_join.drop_similar(spark, docs).collect()),
    }
    for name, run in runs.items():
        spark.conf.set(key, "1")
        plain = run()
        for module in (jaccard_join, exact_dedup, hmm_score):
            monkeypatch.setattr(module, "written", lambda *a, **b: (common.written(*a, **b), spark.conf.set(key, "7"))[0])
        monkeypatch.setattr(jaccard_join, "numbered", lambda *a, **b: (common.numbered(*a, **b), spark.conf.set(key, "7"))[0])
        spark.conf.set(key, "1")
        assert run() == plain and len(plain) == (360 if name != "stage" else 60)
        monkeypatch.undo()
    spark.conf.unset(key)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# ---- language identification ---------------------------------------------------------------


def test_automaton_and_phrases():
    text = "abracadabra"
    follow = language_id.suffix_automaton([ord(c) for c in text])

    def accepts(s):
        state = 0
        for c in s:
            state = follow[state].get(ord(c), -1)
            if state < 0:
                return False
        return True

    subs = {text[a:b] for a in range(len(text)) for b in range(a, len(text) + 1)}
    assert all(accepts("".join(s)) == ("".join(s) in subs) for n in range(1, 5) for s in itertools.product("abrcdx", repeat=n))
    samples = {"x": "the cat sat on the mat", "y": "le chat est sur le tapis"}
    parser = language_id.Parser.fit(samples)
    codes = parser.codes()

    def phrases(s, sample):
        n, at = 0, 0
        while at < len(s):
            size = 1
            while at + size <= len(s) and s[at : at + size] in sample:
                size += 1
            at += max(1, size - 1)
            n += 1
        return n

    texts = ["the cat", "chat le tapis", "zzz q", "a", "The  CAT, sat!", "sur " * 50]
    for s, (lang, score, entropy) in zip(texts, language_id.predict_texts(parser, codes, texts)):
        clean = language_id.normal(s)
        want = {k: phrases(clean, language_id.normal(v)) * math.log2(len(language_id.normal(v))) / len(clean) for k, v in samples.items()}
        assert entropy == pytest.approx(min(want.values())) and want[lang] == pytest.approx(entropy) and 0 <= score <= 1


def test_every_sample_letter_tells_languages_apart():
    rng = random.Random(5)
    han = [chr(0x4E00 + k) for k in range(900)]
    samples = {x: "".join(rng.choice(han[a : a + 600]) for _ in range(3000)) + " plain" for x, a in (("ja", 0), ("zh", 300))}
    parser = language_id.Parser.fit(samples)
    texts = [samples["ja"][40:90], samples["zh"][700:760], samples["zh"][5:9] + " plain " + samples["ja"][9:30], "한국 plain", "".join(rng.choices(han, k=80)), "plain"]

    def phrases(s, sample):
        n, match = 1, ""
        for c in s:
            if match + c in sample:
                match += c
            else:
                n, match = n + 1, c if c in sample else ""
        return n

    got = parser.phrases(language_id.code_texts(parser.codes(), texts))
    assert got.tolist() == [[phrases(language_id.normal(s), language_id.normal(samples[x])) for x in ("ja", "zh")] for s in texts]
    assert [x[0] for x in language_id.predict_texts(parser, parser.codes(), texts[:2])] == ["ja", "zh"]


def test_many_languages_and_small_tables():
    """45 languages of many letters: a table of few columns tells them apart as a whole one does."""
    rng = random.Random(13)
    han = [chr(0x4E00 + k) for k in range(900)]
    samples = {f"l{k:02d}": "".join(rng.choice(han[k * 10 : k * 10 + 400]) for _ in range(600)) + f" plain text {k}" for k in range(45)}
    texts = ["".join(rng.choices(han, k=80)) for _ in range(30)] + ["plain text", "zzz", samples["l07"][5:60], None, "", "12"]
    found = []
    for size in (1 << 30, 1 << 18, 0):
        parser = language_id.Parser.fit(samples, table_bytes=size)
        found.append(language_id.predict_texts(parser, parser.codes(), texts))
    assert found[0] == found[1] == found[2] and found[0][32][0] == "l07" and {x[0] for x in found[0][33:]} == {"und"}


def test_sample_of_rows_without_ids_is_bounded(spark, monkeypatch):
    rows = [(None, "same letters again", "en")] * 400 + [(None, f"autres lettres {k:03}", "fr") for k in range(300)] + [(7, "id twice", "de")] * 90
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(5)
    sizes, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sizes.append(len(out := real(self))) or out)
    parser = language_id.fit_parser(docs, sample_docs=20)
    monkeypatch.undo()
    assert sizes == [60] and sorted(parser.langs) == ["de", "en", "fr"]


def test_small_slices_and_lanes_predict_alike(spark, monkeypatch):
    rows = [(k, ("the cat and the dog " if k % 2 else "le chat et le chien ") * (k % 7) + f"x{k}", "en" if k % 2 else "fr") for k in range(60)] + [(90, "the le " * 500, None), (91, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3)
    want = sorted(language_id.identify(spark, docs).collect())
    monkeypatch.setattr(language_id, "SLICE_BYTES", 64)
    monkeypatch.setattr(language_id, "LANE_CELLS", 50)
    assert sorted(language_id.identify(spark, docs).collect()) == want


def test_stages_take_any_column_name(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, f"the same line\nand number {k} of the text that is long enough to be kept as it is", "s", "en", 3, k, None) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, `a``b.c` int, `row.``` string")
    spark.createDataFrame([(1, "nothing of that")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-2:] == ["a`b.c", "row.`"]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert out and all(r["a`b.c"] == r["doc_id"] for r in out)


def test_coding_in_parts(monkeypatch):
    parser = language_id.Parser.fit({"x": "the cat sat", "y": "le chat est"})
    texts = ["the cat, the cat! " * 50, "", None, "a", "é" * 40, "  le   chat  "]
    whole = [c.tolist() for c in language_id.code_texts(parser.codes(), texts)]
    monkeypatch.setattr(language_id, "CODED_CHARS", 7)
    assert [c.tolist() for c in language_id.code_texts(parser.codes(), texts)] == whole


def test_language_id(spark, odd):
    rng = random.Random(6)
    words = {"aa": ["the", "cat", "and", "house"], "bb": ["der", "hund", "und", "haus"], "cc": ["il", "gatto", "e", "casa"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(150) for x in [rng.choice(list(words))]] + [(900, None, "aa"), (901, "12 !", "aa"), (902, "der hund", None)]
    out = {r.doc_id: r for r in language_id.identify(spark, spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()}
    assert all(out[i].lang_pred == x for i, _, x in rows[:150])
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0 and out[902].lang_pred == "bb"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert language_id.identify(spark, odd).count() == len(ODD)
    assert {r.lang_pred for r in language_id.identify(spark, odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(spark, empty(odd)).count() == 0
    kept = language_id.keep_identified(spark, odd)
    assert kept.columns == odd.columns and kept.filter("text is null or text = ''").count() == 0


# ---- scoring -------------------------------------------------------------------------------


def paths(model, seq):
    for z in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[z[0]] * model.emit[seq[0], z[0]]
        for t in range(1, len(seq)):
            p *= model.move[z[t - 1], z[t]] * model.emit[seq[t], z[t]]
        yield z, p


def test_recursions_equal_all_paths(monkeypatch):
    rng = np.random.default_rng(0)
    model = hmm_score.Hmm.draw(np.ones(6) / 6, 3)
    seqs = [rng.integers(0, 6, n).astype(np.int32) for n in (1, 2, 5, 3, 5, 7)]
    places, block = hmm_score.Lockstep.of(seqs)
    assert [block.symbols[block.lanes() == k].tolist() for k in range(6)] == [seqs[i].tolist() for i in places]
    want = [math.log10(sum(p for _, p in paths(model, seqs[i]))) for i in places]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s in seqs:
        whole = sum(p for _, p in paths(model, s))
        for z, p in paths(model, s):
            start[z[0]] += p / whole
            for t in range(len(s)):
                emit[s[t], z[t]] += p / whole
                if t:
                    move[z[t - 1], z[t]] += p / whole
    for cells in (hmm_score.CELLS, 3, 8):  # whole, and in spans of steps
        monkeypatch.setattr(hmm_score, "CELLS", cells)
        assert hmm_score.log10_likelihoods(model, block) == pytest.approx(want)
        for kind, near in ((np.float64, 1e-9), (np.float32, 1e-5)):
            likely, symbols = hmm_score.expected_counts(model, block, kind)[3]
            assert likely == pytest.approx(float(hmm_score.log10_likelihoods(model, block).sum()) * math.log(10), rel=1e-5) and symbols == len(block.symbols)
            for got, exact in zip(hmm_score.expected_counts(model, block, kind), (start, move, emit)):
                assert np.allclose(got, exact, rtol=near, atol=near)


def test_long_sequences_in_single_precision():
    """Thousands of steps with rare symbols: sums as in double precision."""
    rng = np.random.default_rng(1)
    weight = 1 / np.arange(1, 401) ** 2
    model = hmm_score.Hmm.draw(weight / weight.sum(), 4)
    _, block = hmm_score.Lockstep.of([rng.integers(0, 400, n) for n in (5000, 900, 900, 3)])
    for a, b in zip(hmm_score.expected_counts(model, block, np.float32), hmm_score.expected_counts(model, block)):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3) and np.isfinite(a).all()


def test_word_parts():
    text = b"One two  three\tfour " * 9 + b"a" * 50 + b" end"
    want = [w for w in text.lower().split()]
    for most in (1, 7, 20, 1000):
        assert [w for part in hmm_score.word_parts(text, most) for w in part] == want
    assert list(hmm_score.word_parts(None)) == [] and hmm_score.word_tails([b"ab", b"xxab", b"b", b"abc", b"zabc"], 97).tolist()[3] == hmm_score.word_tails([b"abc"], 97)[0]


def test_scores(spark, odd):
    rng = random.Random(7)
    vocabulary = [[f"{c}{k}" for k in range(12)] for c in "xy"]
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 40)))) for i in range(160) for v in [rng.choice(vocabulary)]] + [(700, None), (701, "Unseen WORDS x1")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    out = {r.doc_id: r for r in hmm_score.score_documents(spark, df, states=2, top_words=16, tails=8).collect()}
    tokens = {i: [*("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()), None] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert (out[i].held_out, out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (i not in train, len(ws), sum(w in c for w in ws), n)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = [i for i in tokens if i not in train]
    assert sum(out[i].score for i in held) > sum(out[i].base_score for i in held)  # two topics: the states pay
    assert hmm_score.score_documents(spark, odd, states=2).count() == len(ODD)
    assert hmm_score.score_documents(spark, empty(odd), states=2).count() == 0


def test_scores_equal_all_paths(spark, monkeypatch):
    """The whole query against a model trained in plain loops over all documents and all state paths."""
    monkeypatch.setattr(hmm_score, "SLICE_BYTES", 60)  # many slices
    monkeypatch.setattr(hmm_score.word_parts, "__defaults__", (5,))  # parts of a text
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.choice('xyz')}{rng.randint(0, 5)}" for _ in range(rng.randint(0, 4)))) for i in range(60)] + [(90, None), (91, "Never seen x0"), (91, "Never seen x0")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    out = sorted((r.doc_id, r.score) for r in hmm_score.score_documents(spark, df, states=2, top_words=4, tails=3, rounds=3).collect())
    tokens = [[*(t or "").lower().split(), ""] for _, t in rows]
    train = [w for (i, _), w in zip(rows, tokens) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    top = sorted((w for w in c if w), key=lambda w: (-c[w], w))[:4]

    def bucket(w):
        return 0 if not w else 1 + top.index(w) if w in top else 5 + int(hmm_score.word_tails([w.encode()], 3)[0])

    size, distinct = np.zeros(8), np.zeros(8)
    for w, n in c.items():
        size[bucket(w)] += n
        distinct[bucket(w)] += 1
    distinct[0] = 1
    weight = (size + 1) / (size + 1).sum()
    model = hmm_score.Hmm.draw(weight, 2)
    for _ in range(3):
        start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((8, 2))
        for t in train:
            seq = [bucket(w) for w in t]
            whole = sum(p for _, p in paths(model, seq))
            for z, p in paths(model, seq):
                start[z[0]] += p / whole
                for k, b in enumerate(seq):
                    emit[b, z[k]] += p / whole
                    if k:
                        move[z[k - 1], z[k]] += p / whole
        model = model.learn(start, move, emit, weight)
    want = []
    for (i, _), t in zip(rows, tokens):
        seq = [bucket(w) for w in t]
        inner = sum(math.log10((c[w] + 1) / max(1, size[b] + distinct[b] + (b > 4))) for w, b in zip(t, seq))
        want.append((i, math.log10(sum(p for _, p in paths(model, seq))) + inner))
    assert [i for i, _ in out] == [i for i, _ in sorted(want)]
    assert [x for _, x in out] == pytest.approx([x for _, x in sorted(want)], rel=1e-4)


def test_training_ends_when_rounds_teach_little(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.choice('xyz')}{rng.randint(0, 5)}" for _ in range(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, text string")

    def scores(rounds):
        return {r.doc_id: r.score for r in hmm_score.score_documents(spark, df, states=3, top_words=9, tails=3, rounds=rounds).collect()}

    three, nine = scores(3), scores(9)
    monkeypatch.setattr(hmm_score, "LEAST_ROUNDS", 2)
    monkeypatch.setattr(hmm_score, "GAIN", 1e9)
    assert scores(9) == pytest.approx(three) and nine != pytest.approx(three)


def test_model_is_a_distribution():
    """The probabilities of all next buckets sum to 1: over one-token texts."""
    model = hmm_score.Hmm.draw(np.ones(7) / 7, 2)
    _, block = hmm_score.Lockstep.of([np.array([k], np.int32) for k in range(7)])
    assert sum(10 ** x for x in hmm_score.log10_likelihoods(model, block)) == pytest.approx(1)


# ---- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = {"en": ["the", "cat", "house", "is", "green", "and", "old"], "de": ["der", "hund", "und", "haus", "ist", "klein", "alt"]}
    passage = " ".join(f"bench{k}" for k in range(30))
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        text = "\n".join(" ".join(rng.choice(words[lang]) + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(4))
        rows.append((i, text + "\nshared menu line", lang, f"src{i % 3}"))
    rows += [(500, rows[0][1], "en", "src0"), (501, rows[1][1].replace("shared", "Shared"), "en", "src1"), (502, "some words before " + passage, "en", "src2"), (503, None, "en", "src0"), (504, "!!", "en", None)]
    docs = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, now = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = now.collect()
        if name != "mixing":
            assert now.columns == docs.columns
        assert stage(spark, docs.filter("1 = 0"), str(tmp_path)).count() == 0
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {503, 504}
    assert not any("shared menu line" in r.text for r in seen["line_dedup"]) and all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert ids["jaccard_join"] == ids["line_dedup"] - {500} - {501} | ({501} & ids["jaccard_join"])
    assert ids["decontamination"] == ids["jaccard_join"] - {502}
    assert ids["mixing"] <= ids["decontamination"] and max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 3
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.copy) for r in whole.collect()) == Counter((r.doc_id, r.copy) for r in seen["mixing"])

"""The pipeline as a whole against plain Python over whole tables."""

import hashlib
import random
import re
from collections import Counter

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SIZE = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def has_letter(row):
    return any(c.isalpha() for c in row["text"] or "")


def without_boilerplate(rows, ratio=0.05):
    pages, seen = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        seen.update({(r["source"], x.strip(BLANKS)) for x in (r["text"] or "").split("\n")} - {(r["source"], "")})
    bad = {key for key, n in seen.items() if n > 1 and n > ratio * pages[key[0]]}
    out = []
    for r in rows:
        text = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(BLANKS)) not in bad)
        out.append({**r, "text": text, "n_chars": len(text) if text != r["text"] else r["n_chars"]})
    return out


def without_near_copies(rows):
    sets = []
    for r in rows:
        w = words_of(r["text"])
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    class_of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and class_of[i] != class_of[j]:
                old, new = class_of[i], class_of[j]
                class_of = [new if c == old else c for c in class_of]
    first = {}
    for r, c in zip(rows, class_of):
        first[c] = min(first.get(c, r["doc_id"]), r["doc_id"])
    return [r for r, c in zip(rows, class_of) if first[c] == r["doc_id"]]


def without_contaminated(rows, items):
    windows = set()
    for item in items:
        w = words_of(item)
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    out = []
    for r in rows:
        w, hit = words_of(r["text"]), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def targets_of(sizes):
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out, room = set(sizes), {}, sum(sizes.values())
    while True:
        total = sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * room / total > 3 * sizes[s]]
        for s in over:
            out[s] = 3.0 * sizes[s]
            left.discard(s)
            room -= 3 * sizes[s]
        if not over:
            return out | {s: weight[s] * room / total for s in left}


def mixed(rows):
    """(row, copy) of the mix: queues in shuffled order, served by finish time until the budget is used."""
    size = {r["doc_id"]: len(SIZE.findall(r["text"] or "")) for r in rows}
    whole, reach, copies = Counter(), Counter(), []
    for r in rows:
        whole[r["source"]] += size[r["doc_id"]]
    targets = targets_of(whole)
    for r in sorted(rows, key=lambda r: (hashlib.md5(f"6:{r['doc_id']}".encode()).hexdigest(), r["doc_id"])):
        reach[r["source"]] += size[r["doc_id"]]
        if size[r["doc_id"]] and targets[r["source"]]:
            copies += [((k * whole[r["source"]] + reach[r["source"]]) / targets[r["source"]], k, r) for k in range(3)]
    budget, out, taken = sum(size.values()), [], Counter()
    for time in sorted({c[0] for c in copies}):
        same = [c for c in copies if c[0] == time]
        budget -= sum(size[r["doc_id"]] for _, _, r in same)
        if budget < 0:
            break
        for _, _, r in same:
            taken[r["doc_id"]] += 1
            out.append((r, taken[r["doc_id"]]))
    return out


def expected(docs, items):
    """Rows after each stage; the last with the number of the copy."""
    kept = [r for r in docs if has_letter(r)]
    lines = without_boilerplate(kept)
    distinct = without_near_copies(lines)
    clean = without_contaminated(distinct, items)
    return [kept, lines, distinct, clean, mixed(clean)]


def made():
    """Rows with every case a stage must decide: near and exact copies, menus, passages, nulls, no letters."""
    rng = random.Random(21)
    bench = [" ".join(f"b{i}x{k}" for k in range(30)) for i in range(4)] + ["short item here", None, "?!"]
    rows, bodies = [], []
    for i in range(240):
        body = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(1, 6))]
        if bodies and rng.random() < 0.4:
            body = list(rng.choice(bodies))
            if rng.random() < 0.6:
                body[0] = body[0] + f" new{i}"
        bodies.append(body)
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None])
        text = "\n".join([*body, *(["  Menu of " + str(source)] if rng.random() < 0.5 else [])])
        if rng.random() < 0.1:
            text += "\n" + rng.choice(bench[:5])
        rows.append({"doc_id": 1000 - i, "text": text, "lang": rng.choice(["en", "de", None]), "source": source, "n_chars": len(text)})
    rows += [{"doc_id": 2000 + k, "text": t, "lang": "en", "source": "s2", "n_chars": len(t or "")} for k, t in enumerate([None, "", "12 !", "é", "Menu of s2", "\n", "long " * 30_000])]
    return rows, bench


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("data", ["made", "/root/testdata/sf0.001"])
def test_pipeline_equals_plain_python(spark, tmp_path, data):
    import corpus_pipeline

    if data == "made":
        docs, bench = made()
        folder = str(tmp_path)
        spark.createDataFrame([tuple(r.values()) for r in docs], SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    else:
        folder = data
        docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
        bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = expected(docs, bench)
    want = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], copy) for r, copy in stages[-1])
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.copy) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    sizes = [len(docs), *map(len, stages[:-1])]
    if data == "made":  # every stage decides something
        assert sizes[0] > sizes[1] and sizes[2] > sizes[3] > sizes[4] and stages[0] != stages[1]

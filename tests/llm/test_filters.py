"""URL filters, line dedup, mixing, token counts and secret scans against brute force and odd rows."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import line_dedup, mixing, secret_scan, token_counts, url_filter

#: Odd texts that every operator must take.
ODD = [None, "", " \n\t ", "a", "x" * 30_000, "same line\nsame line\n\nother", "Ünï çödé 中文 😀", "\x00\x1f ", "same line\nsame line\n\nother"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, "s" if i % 2 else None, "en", -1, i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size int")


def empty(df):
    return df.filter("1 = 0")


# ---- url filters ---------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en/x", "http://sub.example.com/en/", "http://example.com/fr/x", "http://a.net/es/1", "http://net/fr/",
    "http://a.net/de/", "http://x.com", "http://x.com?y=/en/", "ftp://casino-win.example.org/z", "http://m.casino-win.example.org/z", "http://notcasino-win.example.org/", "http://x.org/#://y",
    "http://a.b.c.d.e.f.example.com/en/", "http://" + "a." * 500 + "net/es/" + "p" * 5000, "http://example.com./en/", "http://.com/", "http://exämple.com/en/", "http://a.net/es/1",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)

    def fits(entries):
        return [(h + p, a) for h, p, a in entries if (host == h or host.endswith("." + h)) and path.startswith(p)]

    rules = sorted(fits(url_filter.SITE_RULES), key=lambda x: len(x[0]))
    return host, path, rules[-1][0] if rules else None, rules[-1][1] if rules else "block" if fits(url_filter.BLOCKED_SITES) else "allow"


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "a.net", "net", "spam-farm.example.net", "x.org", "com"]
    urls = URLS + [f"https://{rng.choice(['', 'm.'])}{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'q'])}/{rng.randint(0, 99)}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark, df).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(spark, empty(df)).count() == 0


def test_lists_longer_than_a_cascade(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PLAN_KEYS", 7)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark, df).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"key{i}" for i in range(3000)]
    listed = keys[::7] + ["not in the corpus"]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.build_cascade(spark, universe, listed)
    assert len(cascade.levels) >= 2
    got = {r.key for r in universe.filter(cascade.contains(*url_filter.hashes(F.col("key")))).collect()}
    assert got == set(keys[::7])
    assert url_filter.build_cascade(spark, universe, []).levels == ()


# ---- line dedup ----------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark, odd):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(40)] + ["  spaced ", "", "\t"]
    rows = [(i, "\n".join(rng.choice(lines + ["menu"] * 20) for _ in range(rng.randint(0, 8))), rng.choice(["a", "b", None]), "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, host string").repartition(4)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(spark, df, ratio=0.2, report=True).collect()}
    pages, seen = {}, {}
    for _, text, source, _ in rows:
        pages[source] = pages.get(source, 0) + 1
        for x in {x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")} - {""}:
            seen[source, x] = seen.get((source, x), 0) + 1
    bad = {k for k, n in seen.items() if n > 1 and n > 0.2 * pages[k[0]]}
    assert bad
    for i, text, source, _ in rows:
        parts = text.split("\n")
        kept = [x for x in parts if (source, x.strip(" \t\n\x0b\x0c\r")) not in bad]
        assert got[i] == ("\n".join(kept), len(parts), len(parts) - len(kept))


def test_line_dedup_odd_rows(spark, odd):
    out = line_dedup.drop_boilerplate(spark, odd, length_col="n_chars")
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))  # too few pages to drop a line
    assert line_dedup.drop_boilerplate(spark, empty(odd)).count() == 0
    many = odd.crossJoin(spark.range(6).withColumnRenamed("id", "copy")).drop("copy")
    cut = line_dedup.drop_boilerplate(spark, many, length_col="n_chars", ratio=0.1)
    assert {(r.text, r.n_chars) for r in cut.collect() if r.n_chars != -1} == {("", 0)}
    clash = odd.withColumns({"n_lines": F.lit(1), "N_DROPPED": F.lit(2), "kept": F.lit(3), "host": F.lit(4)})
    out = line_dedup.drop_boilerplate(spark, clash, report=True)
    assert out.columns == [*clash.columns, "n_lines_", "n_dropped_"] and out.count() == len(ODD)


# ---- mixing --------------------------------------------------------------------------------


def test_targets(spark):
    def got(sizes, **options):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        return {r.source: r.target for r in mixing.targets(df, **options).collect()}

    def brute(sizes):
        names = sorted(sizes)
        weight = {s: k % 3 + 1 for k, s in enumerate(names)}
        left, room, out = set(names), float(sum(sizes.values())), {}
        while True:
            total = sum(weight[s] for s in left)
            over = [s for s in left if weight[s] * room / total > 3 * sizes[s]]
            if not over:
                return out | {s: weight[s] * room / total if left else 0.0 for s in left}
            for s in over:
                out[s] = 3.0 * sizes[s]
                left.discard(s)
            room = sum(sizes.values()) - sum(out.values())

    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 10}, {"a": 5, "b": 0, "c": 900, "d": 3}, {"a": 7}, {"a": 0, "b": 0}, {x: 2 ** k for k, x in enumerate("abcdefgh")}):
        assert got(sizes) == pytest.approx(brute(sizes))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "abc"[0 if i % 3 else rng.randint(1, 2)]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(5)
    out = mixing.mix_sources(spark, df).collect()
    again = mixing.mix_sources(spark, df.repartition(2)).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    source = {i: s for i, _, s in rows}
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in out)
    for s in "abc":
        mine = [r for r in out if source[r.doc_id] == s]
        assert mine[0].source_size == sum(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 80
    assert 0 <= sum(r.size for r in out) - sum(r.taken for r in out) <= 40
    copies = mixing.apply_mix(spark, df)
    assert copies.count() == sum(r.copies for r in out) and copies.columns == [*df.columns, "copy"]


def plain_mix(rows, targets):
    """The rule itself: queues in shuffled order, three times over, served by finish time until the budget."""
    queues, copies = {}, []
    for i, size, source in sorted(rows, key=lambda r: (hashlib.md5(f"6:{r[0]}".encode()).hexdigest(), r[0])):
        queues.setdefault(source, []).append((i, size))
    for source, queue in queues.items():
        whole, reach = sum(n for _, n in queue), 0
        for i, size in queue:
            reach += size
            if targets[source]:
                copies += [((k * whole + reach) / targets[source], size, i) for k in range(3) if size]
    left, taken = sum(n for _, n, _ in rows), {i: 0 for i, _, _ in rows}
    for f in sorted({c[0] for c in copies}):
        same = [c for c in copies if c[0] == f]  # equal times go together
        if sum(c[1] for c in same) > left:
            break
        left -= sum(c[1] for c in same)
        for _, size, i in same:
            taken[i] += size
    return taken


def test_mix_serves_until_the_budget(spark):
    """Small mixes whose queues end early: copies past the time at which all targets are met count, too."""
    rng = random.Random(14)
    cases = [{"a": [5], "b": [2, 300], "c": [2, 100, 5], "d": [20, 100, 100], "e": [1000], "f": [100]}]
    cases += [{s: [rng.choice([1, 3, 40, 500]) for _ in range(rng.randint(1, 4))] for s in "abcde"[: rng.randint(1, 5)]} for _ in range(3)]
    for case in cases:
        rows = [(10 * k + j, n, s) for k, (s, sizes) in enumerate(case.items()) for j, n in enumerate(sizes)]
        df = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string")
        out = mixing.mix_sources(spark, df).collect()
        targets = {s: next(r.target for r in out if r.doc_id == i) for i, _, s in rows}
        assert {r.doc_id: r.taken for r in out} == plain_mix(rows, targets)


def test_mix_of_many_buckets_and_ranges(spark, monkeypatch):
    rows = [(k, "w " * (k % 9), "big" if k % 3 else None if k % 2 else "small") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(4)
    want = sorted(mixing.mix_sources(spark, docs).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    assert sorted(mixing.mix_sources(spark, docs).collect()) == want
    parts = spark.createDataFrame([(s, f"{k:03x}", k % 5) for s in ("a", None) for k in range(0, 4096, 7)], "source string, bucket string, part long")
    got = {(r.source, r.bucket): r.start for r in mixing._starts(parts, 3).collect()}
    for s in ("a", None):
        upto = 0
        for k in range(0, 4096, 7):
            assert got[s, f"{k:03x}"] == upto
            upto += k % 5


def test_mix_odd_rows(spark, odd):
    out = mixing.mix_sources(spark, odd).collect()
    assert len(out) == len(ODD) and sum(r.size for r in out) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ODD)
    assert mixing.mix_sources(spark, empty(odd)).count() == 0
    clash = odd.withColumns({"copy": F.lit(1), "copies": F.lit(2), "row": F.lit(3), "at": F.lit(4)})
    mix = mixing.apply_mix(spark, clash)
    assert mix.columns == [*clash.columns, "copy_"] and mix.filter("text is null").count() == 0


# ---- token counts --------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    letters = "aaabcdeehlloinrst  \n\t.,'123é½²ßÇ \xa0\x1c\x85中文😀éAB<|>=-"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["<|endoftext|>" * 3 + "x", "=" * 3001, " " * 700, "ab" * 555]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(spark, df, path).collect()}
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert got[i] == (len((texts[i] or "").encode()), len(e.ids), len(e.ids) > 1024)
    assert token_counts.count_tokens(spark, empty(odd), path).count() == 0


# ---- secret scans --------------------------------------------------------------------------


def test_slices_of_token_counts(spark, odd, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, odd, path).collect()}
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 10)
    monkeypatch.setattr(token_counts.Counter.__init__, "__defaults__", (2,))  # what it remembers
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, odd, path).collect()} == whole


def scanned(text):
    """Base and entropy spans by plain scans from every place, without a regular expression."""
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")

    def run(at, letters):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        return end

    def assign(at):
        names = ("password", "passwd", "secret", "token", "api_key", "apikey")
        for name in names:
            if text[at : at + len(name)].lower() == name and text[at : at + len(name)].isascii():
                for quotes in (1, 0):
                    k = at + len(name)
                    if quotes and text[k : k + 1] not in ('"', "'"):
                        continue
                    k = run(k + quotes, " ")
                    if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                        continue
                    k = run(k + 1, " ")
                    for skip in (1, 0):
                        if skip and (text[k : k + 1] not in ('"', "'") or not text[k : k + 1]):
                            continue
                        if run(k + skip, word) > k + skip:
                            return run(k + skip, word), run(k + skip, word) - k - skip
        return None

    out, at = [], 0
    while at < len(text):
        if found := assign(at):
            out += [(at, "assign", found[0])] if found[1] >= 12 else []
            at = found[0]
        else:
            at += 1
    at = 0
    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    while (at := text.find("AKIA", at)) >= 0:
        end = run(at + 4, upper)
        if end > at + 4:
            out += [(at, "access", end)] if end - at >= 18 else []
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        out += [(at, "hex", end)] if end - at >= 16 else []
        at = max(at + 1, end)
    at = 0
    while at < len(text):
        end = run(at, word)
        whole = text[at:end]
        if end - at >= 20 and not whole.isalpha() and not any(re.fullmatch(x, whole) for x in secret_scan.ALLOWED):
            out += [(at + a, "entropy", at + b) for a, b in secret_scan.hot_windows(whole)]
        at = max(at + 1, end)
    return sorted(out, key=lambda x: (x[0], secret_scan.KINDS.index(x[1]), x[2]))


def test_secret_scan_query_equals_plain_scans(spark, tmp_path):
    from parlance.llm import queries

    rng = random.Random(15)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "api__key", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "abcdef0123456789", "ABCDEF0123456789XY", "é", "x", "short1", "Zx81mQp0Lw7Rt5Vb2Ns9", "123e4567-e89b-12d3-a456-426614174000", "www.site.example.org/a1b2", "\n", "ſ", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", "password: " + "a1B2" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.QUERIES["op8_secret_scan"](spark, str(tmp_path)).collect():
        want = scanned(texts[r.doc_id] or "")
        base = [x for x in want if x[1] != "entropy"]
        shown = [",".join(f"{k}:{a}:{b}" for a, k, b in spans) for spans in (want, base)]
        assert r.spans == shown[0] and r.base_sha256 == hashlib.sha256(shown[1].encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in secret_scan.KINDS[:3])


def test_base_spans():
    text = 'Password = "abcdefghijkl" token:short AKIA' + "A" * 14 + " 0123456789abcdef apikey:'aaaaaaaaaaaa"
    found = secret_scan.scan_text(text)
    base = [(k, text[a:b]) for a, k, b in found if k != "entropy"]
    assert base == [("assign", 'Password = "abcdefghijkl'), ("access", "AKIA" + "A" * 14), ("hex", "0123456789abcdef"), ("assign", "apikey:'aaaaaaaaaaaa")]


def test_entropy_windows_equal_a_recount():
    import math
    from collections import Counter

    rng = random.Random(6)
    for _ in range(60):
        s = "".join(rng.choice(rng.choice(["0123456789abcdef", "abcdefghij0123456789", "ABCxyz019+/", "aaaa1"])) for _ in range(rng.randint(20, 90)))
        hot = set()
        for k in range(len(s) - 19):
            w = s[k : k + 20]
            h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
            lower, upper, other = any(c.islower() for c in w), any(c.isupper() for c in w), any(not c.isalnum() for c in w)
            if not any(c.isdigit() for c in w) or not (lower or upper):
                continue
            kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else "one_case" if not other and not (lower and upper) else "base64"
            if h >= secret_scan.THRESHOLDS[kind] - 1e-12:
                hot.update(range(k, k + 20))
        assert {i for a, b in secret_scan.hot_windows(s) for i in range(a, b)} == hot


def test_allow_list_and_odd_rows(spark, odd):
    assert secret_scan.scan_text("see 123e4567-e89b-12d3-a456-426614174000 and www.some-site.example.org/a1B2c3D4e5F6g7H8") == []
    assert [k for _, k, _ in secret_scan.scan_text("key Zx81mQp0Lw7Rt5Vb2Ns9 end")] == ["entropy"]
    out = {r.doc_id: r.spans for r in secret_scan.scan_secrets(odd).collect()}
    assert len(out) == len(ODD) and all(s == [] for s in out.values())
    assert secret_scan.scan_secrets(empty(odd)).count() == 0
    text = "é" * 5 + " 0123456789abcdef"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [(s.kind, s.start, s.end) for s in secret_scan.scan_secrets(df).head().spans] == [("hex", 6, 22)]


def test_query_digests(spark, tmp_path):
    from parlance.llm import queries

    text = "token = abcdef012345 x"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op8_secret_scan"](spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest() and got[1].n_assign == 1 and got[1].spans == "assign:0:20"
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert os.path.isdir(tmp_path)

"""Cross-tokenizer alignment against a plain walk over both token lists."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from parlance.llm import align
from parlance.llm import queries as Q
from parlance.llm.common import table

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a ", " a", "x  y\n z", "a ▁b", "\n\nq <s> <|endoftext|> </s> z", "é" * 50, "中文 テスト 😀", "\x00\x1f x", "a b", " thin  x", "one two", "one two",
       "tab\t end \t", "a  b  c", "x" * 5000, "word " * 400, "1234 56,78 90%", "don't we'll I'M", "\r\n a\r\n", "<0x41> ▁"]


@pytest.fixture(scope="module")
def sides():
    return align.Sides(*PATHS)


def walked(sides, text):
    """(n_a, n_b, n_groups, n_links, groups, links) of one text."""
    nothing = 0, 0, 0, 0, None, Counter()
    if not text:
        return nothing
    whole = b" " + text.encode()
    a, b = sides.a.encode(" " + text, add_special_tokens=False).ids, sides.b.encode(text)
    if b"".join(sides.bytes_a[i] for i in a) != whole or b"".join(sides.bytes_b[i] for i in b) != whole:
        return nothing
    ends = [np.cumsum(size[x]).tolist() for size, x in ((sides.size_a, a), (sides.size_b, b))]
    links, groups, i, j, first = Counter(), [], 0, 0, (0, 0)
    while i < len(a):
        links[a[i], b[j]] += 1
        if ends[0][i] == ends[1][j]:
            i, j = i + 1, j + 1
            groups.append(",".join(map(str, a[first[0] : i])) + "|" + ",".join(map(str, b[first[1] : j])))
            first = i, j
        elif ends[0][i] < ends[1][j]:
            i += 1
        else:
            j += 1
    return len(a), len(b), len(groups), links.total(), ";".join(groups), links


def aligned_by_force(sides, texts):
    each = [walked(sides, t) for t in texts]
    docs = Counter(pair for x in each for pair in x[5])
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [(*x[:5], sum(n for p, n in x[5].items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in x[5].items())) for x in each]


def texts_of(n=60):
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:n]


@pytest.mark.parametrize(("remembered", "added"), [(1_000_000, 60_000), (3_000, 1_000)])
def test_slices_equal_a_walk(sides, monkeypatch, remembered, added):
    monkeypatch.setattr(align, "ADDED", added)
    own = align.Aligner(*PATHS, remembered=remembered)
    texts = ODD + texts_of()
    for at in (0, 10, 40):
        part = pa.array(texts).slice(at, 45)
        done = own.align(part)
        for k, text in enumerate(part.to_pylist()):
            want = walked(sides, text)
            pairs = slice(done.ends[k], done.ends[k + 1])
            assert (*done.counts[k].tolist(), done.groups[k]) == want[:5], text
            assert {(int(p // own.width), int(p % own.width)): int(n) for p, n in zip(done.pairs[pairs], done.times[pairs])} == want[5]
        assert (done.counts[:, 3] == done.counts[:, 0] + done.counts[:, 1] - done.counts[:, 2]).all()


def test_whole_texts_where_no_cut_is_safe(sides):
    own = align.Aligner(*PATHS)
    assert own.sides.separable
    own.sides.separable = False
    done = own.align(pa.array(ODD))
    for k, text in enumerate(ODD):
        assert (*done.counts[k].tolist(), done.groups[k]) == walked(sides, text)[:5]


@pytest.mark.parametrize("shared", [0, 40, 1 << 20])
def test_counts_over_the_corpus(spark, sides, shared):
    texts = ODD + texts_of(30)
    rows = [(None if k == 5 else k, t, 1, "x", 2, b"") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, pair string, n int, pairs binary").repartition(3)
    got = align.align(spark, docs, *PATHS, shared=shared).collect()
    order = "n_a n_b n_groups n_links groups n_best count_sum".split()
    want = {r[0]: x for r, x in zip(rows, aligned_by_force(sides, texts))}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in order) == want[r["doc_id"]], rows[r["doc_id"] or 5]


def test_empty_table_and_repeated_rows(spark, sides):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, None)], "doc_id int, text string")
    assert align.align(spark, docs.filter("1 = 0"), *PATHS).collect() == []
    got = sorted((r["doc_id"], r["n_links"], r["count_sum"]) for r in align.align(spark, docs, *PATHS).collect())
    n = walked(sides, "same text")[3]
    assert got == [(1, n, 2 * n), (1, n, 2 * n), (2, 0, 0)]


def test_query_equals_a_walk_over_whole_tables(spark, sides):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    want = aligned_by_force(sides, [r["text"] for r in docs])
    got = {r["doc_id"]: r for r in Q.op13_alignment(spark, folder).collect()}
    import hashlib

    for r, x in zip(docs, want, strict=True):
        digest = hashlib.sha256(x[4].encode()).hexdigest() if x[4] is not None else ""
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], *x[:4], *x[5:], digest)

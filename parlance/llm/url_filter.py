"""URL filter by a cascade of Bloom filters, in DataFrame functions only.

A key is ``host + path`` of a listed entry, such as ``example.com/en/``. Every url has a bounded
number of candidate keys: its last host labels (as many as a listed host has) joined with the
prefixes of its path (of the lengths that listed paths have). The cascade answers for each
candidate whether it is listed. Level 0 encodes the listed keys; level 1 the keys of the corpus
that level 0 wrongly accepts; level 2 the listed keys that level 1 wrongly accepts; and so on until
no key is left. Over the key universe it was built from, the answer is exact, and looking a key up
is arithmetic on constant bit words: no join, no shuffle. A cascade holds PLAN_KEYS listed keys at
most, so that its words stay small constants of a plan; a longer list has several cascades, each over
the whole universe, that the urls pass one after another (written in between).

Cases: a null url, or one without ``://``, has the empty host and path, fits no entry and gets the
default verdict. Repeated urls are judged alike. An empty table gives an empty result. Only the id
and url columns are read, so other columns cannot clash. An empty list accepts nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import lower_az, written

#: The site rules of the contract: (host, path, action).
SITE_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The method's own list: these sites are blocked where no rule speaks.
BLOCKED_SITES = tuple(
    (f"{label}.example.{end}", "/", "block")
    for label in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for end in ("com", "net", "org")
)
#: Listed keys of one cascade (a few bytes each in the plan).
PLAN_KEYS = 1_000_000
MAX_HASHES = 12


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits in 63-bit words, and the number of hash functions."""

    words: tuple[int, ...]
    n_bits: int
    n_hashes: int
    seed: int

    def accepts(self, one: Column, two: Column) -> Column:
        """Whether all bits of a key with these hashes are set. Array lambdas keep the code small."""
        words = F.split(F.lit(" ".join(map(str, self.words))), " ").cast("array<bigint>")  # folded into one constant
        return F.forall(_bits(one, two, self), lambda bit: F.get(words, (bit / 63).cast("int")).bitwiseAND(_one_bit(bit)) != 0)


def hashes(key: Column) -> list[Column]:
    """Two hashes of 31 bits; the bits of all levels derive from them."""
    return [F.pmod(F.xxhash64(key), F.lit(1 << 31)), F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 31))]


def _bits(one: Column, two: Column, level: Level) -> Column:
    """Double hashing within the level: its own mix of the key's hashes gives a start and a step."""
    mixed = F.xxhash64(one, two, F.lit(level.seed))
    start, stride = F.pmod(mixed, F.lit(1 << 31)), F.shiftrightunsigned(mixed, 33)
    steps = F.array(*[F.lit(i).cast("long") for i in range(level.n_hashes)])
    return F.transform(steps, lambda i: F.pmod(start + i * stride + i * i * i, F.lit(level.n_bits)))


def _one_bit(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(63)).cast("int"))


def _level(keys: DataFrame, n_keys: int, rate: float, seed: int) -> Level:
    """A filter over keys; its bits are set by a distributed aggregation over 63-bit words."""
    n_bits = max(63, math.ceil(n_keys * -math.log(rate) / math.log(2) ** 2))
    shape = Level((), n_bits, min(MAX_HASHES, max(1, round(n_bits / n_keys * math.log(2)))), seed)
    bits = keys.select(F.explode(_bits(F.col("one"), F.col("two"), shape)).alias("bit"))
    rows = (
        bits.groupBy((F.col("bit") / 63).cast("int").alias("word"))
        .agg(F.bit_or(_one_bit(F.col("bit"))).alias("bits"))
        .collect()
    )  # n_bits / 63 words at most: bounded by PLAN_KEYS, not by the corpus
    words = [0] * (n_bits // 63 + 1)
    for r in rows:
        words[r["word"]] = r["bits"]
    return Level(tuple(words), n_bits, shape.n_hashes, seed)


@dataclass(frozen=True)
class Cascade:
    """Levels in order. A key is listed if the number of levels that accept it, before the first
    that does not, is odd."""

    levels: tuple[Level, ...]

    def contains(self, one: Column, two: Column) -> Column:
        """Exact for every key of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].accepts(one, two), out).otherwise(F.lit(k % 2 == 1))
        return out


def build_cascade(spark: SparkSession, universe: DataFrame, listed: list[str], name: str = "cascade") -> Cascade:
    """universe: column ``key``, the distinct keys of the corpus. The first level's error rate is
    chosen so that the keys it wrongly accepts are about as many as the listed ones; later levels
    halve. So the bits follow the list and only the logarithm of the corpus."""
    mine = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    n_listed = len(set(listed))
    if not n_listed:
        return Cascade(())
    both = written(
        spark,
        universe.select("key", F.lit(0).alias("listed"))
        .unionByName(mine.withColumn("listed", F.lit(1)))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
        .select("listed", *[h.alias(n) for h, n in zip(hashes(F.col("key")), ("one", "two"))]),
        name,
    )
    n_other = both.filter("listed = 0").count()
    rate = max(1e-9, min(0.5, math.sqrt(0.5) * n_listed / max(1, n_other)))
    levels = [_level(both.filter("listed = 1"), n_listed, rate, seed=1)]
    # what is left is the list and about as many false positives: it follows the list's size
    left = written(spark, both.filter((F.col("listed") == 1) | levels[0].accepts(F.col("one"), F.col("two"))), name)
    side = 0
    while n := left.filter(F.col("listed") == side).count():
        if len(levels) == 64:
            raise ValueError("keys that no level tells apart")
        levels.append(_level(left.filter(F.col("listed") == side), n, 0.5, seed=len(levels) + 1))
        left = left.filter((F.col("listed") == side) | levels[-1].accepts(F.col("one"), F.col("two")))
        side = 1 - side
    return Cascade(tuple(levels))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_az(host), path


def candidates(host: Column, path: Column, entries) -> Column:
    """Array of a url's candidate keys: the suffixes of the host of 1 to the most labels a listed
    host has, joined with the prefixes of the path of each listed length."""
    most = max((h.count(".") + 1 for h, _, _ in entries), default=1)
    lengths = sorted({len(p) for _, p, _ in entries})
    labels = F.split(host, r"\.", -1)
    suffixes = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")) for n in range(1, most + 1)]
    prefixes = [F.when(F.length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in lengths]
    return F.filter(F.array_distinct(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes])), lambda x: x.isNotNull())


def filter_urls(
    spark: SparkSession,
    pages: DataFrame,
    rules=SITE_RULES,
    blocked=BLOCKED_SITES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judges every url. Returns id_col, host, path, rule (null if none fits), verdict, listed_site.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    rule wins. Where none fits, a site of ``blocked`` is blocked, and the rest gets ``default``.
    """
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    entries = [*rules, *blocked]
    keyed = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), entries))
    universe = written(spark, keyed.select(F.explode("keys").alias("key")).distinct(), "url-keys")
    hashed = F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), *[h.alias(x) for h, x in zip(hashes(k), ("one", "two"))]))
    judged = keyed.withColumn("keys", hashed).withColumns({kind: F.lit(None).cast("struct<n:int,key:string>") for kind in ("a", "b", "site")})
    lists = {kind: sorted({h + p for h, p, x in part if x == action}) for kind, part, action in (("a", rules, "allow"), ("b", rules, "block"), ("site", blocked, "block"))}

    def longest(cascade: Cascade) -> Column:
        found = F.filter("keys", lambda x: cascade.contains(x["one"], x["two"]))
        return F.array_max(F.transform(found, lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key"))))

    passes = max(1, -(-max(map(len, lists.values())) // PLAN_KEYS))
    for k in range(passes):
        for kind, keys in lists.items():
            cascade = build_cascade(spark, universe, keys[k * PLAN_KEYS : (k + 1) * PLAN_KEYS], f"url-{kind}")
            judged = judged.withColumn(kind, F.greatest(F.col(kind), longest(cascade)))
        if k < passes - 1:
            judged = written(spark, judged, "url-judged")
    judged = judged.withColumn("listed_site", F.col("site").isNotNull())
    wins = F.coalesce(F.col("a.n"), F.lit(-1)) >= F.coalesce(F.col("b.n"), F.lit(-1))
    fits = F.col("a").isNotNull() | F.col("b").isNotNull()
    return judged.select(
        id_col,
        "host",
        "path",
        F.when(fits, F.when(wins, F.col("a.key")).otherwise(F.col("b.key"))).alias("rule"),
        F.when(fits, F.when(wins, F.lit("allow")).otherwise(F.lit("block"))).when(F.col("listed_site"), F.lit("block")).otherwise(F.lit(default)).alias("verdict"),
        "listed_site",
    )

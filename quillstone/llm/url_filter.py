"""URL filters: exact membership in lists of keys by Bloom filter cascades.

Level 1 holds the listed keys. Level 2 holds the keys of the corpus that level 1
passes though they aren't listed, level 3 the listed keys that level 2 passes,
and so on until nothing is passed wrongly. Because every key that can be asked is
known when the cascade is made - the universe - a lookup is exact for all of
them, and it is an expression on the key: no join, no shuffle.

The levels are literals of the plan. Their bits are about 1.44 * log2(universe /
listed) for a listed key at level 1, and less than as much again for all others;
`MAX_BITS` bounds a level, and a larger list raises an error instead of a lossy
answer.

A key is a host followed by the beginning of a path, like `example.com/en/`. A
url asks for each of its host's suffixes with each beginning of its path whose
length occurs in the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, materialise, table

#: (verdict, rule)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Sites blocked where no rule says anything: every host under these names.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{top}/" for name in LISTED_NAMES for top in ("com", "net", "org"))
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        bits = len(self.words) * 64
        return _positions(key, bits, self.hashes, self.seed)

    def passes(self, key: Column) -> Column:
        # A foldable string becomes one array literal when the plan is optimised.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        one = lambda p: F.call_function("shiftright", F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = F.lit(True)
        for p in self.positions(key):
            out = out & one(p)
        return out


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first, step = (F.pmod(F.xxhash64(F.lit(2 * seed + i), key), F.lit(bits)) for i in (0, 1))
    return [F.pmod(first + F.lit(j) * (step + 1), F.lit(bits)) for j in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether key, which must be of the universe or listed, is listed."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.passes(key) & ~out
        return out


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    rate = min(0.5, max(rate, 2.0**-30))
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, 64 * math.ceil(n * 1.4427 * -math.log2(rate) / 64))
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits is above the bound of {MAX_BITS}")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    set_bits = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    words = [0] * (bits // 64)
    for w, b in set_bits.collect():  # at most bits / 64 rows
        words[w] = b
    return Level(tuple(words), hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: tables with a column key; repeats and nulls don't count. Exact for every key of either table."""
    listed = materialise(listed.select("key").filter("key is not null").distinct(), "url-listed")
    n, corpus = listed.count(), universe.select("key").filter("key is not null")
    if n == 0:
        return Cascade(())
    size = max(n, corpus.agg(F.approx_count_distinct("key")).head()[0])  # sizes a level only; exactness doesn't rest on it
    levels = [_level(listed, n, n / (math.sqrt(2) * size), 1)]
    mine, others = listed, corpus.filter(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti")
    while True:
        others = materialise(others, "url-level")
        if (n := others.count()) == 0:
            return Cascade(tuple(levels))
        levels.append(_level(others, n, 0.5, len(levels) + 1))
        mine, others = others, mine.filter(levels[-1].passes(F.col("key")))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there to ? # or the end.
    A null url or one without :// has both empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    after = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumn("host", F.translate(host, upper, lower)).withColumn("path", path)


def candidates(lengths: list[int]) -> Column:
    """The keys that a url with host and path asks for. lengths: those of the paths in the list."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    begins = F.filter(begins, lambda b: b.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda b: F.concat(s, b))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def judge_urls(pages: DataFrame, rules=RULES, listed=LISTED, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest fitting rule, or null) and verdict: the rule's, else block if the host is under a
    listed site, else allow.

    Rules and listed sites are hosts with the beginning of a path and fit all subdomains. A longer rule string wins. Empty hosts
    fit nothing and are allowed. Repeated urls are judged alike; an empty table gives an empty result. Columns of pages with
    these four names are replaced.
    """
    spark: SparkSession = pages.sparkSession
    by_rule = dict((r, v) for v, r in rules)
    keys_of = lambda names: spark.createDataFrame([(k,) for k in names], "key string")
    lengths = lambda names: sorted({len(k) - k.index("/") for k in names})
    parts = with_parts(pages.drop("host", "path", "rule", "verdict"), url)
    both = lengths([*by_rule, *listed])
    asked = parts.select("host", F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in both]).alias("b"))
    asked = asked.distinct().select("host", F.explode("b").alias("path")).filter("path is not null").distinct()
    universe = materialise(asked.select(F.explode(candidates(both)).alias("key")).distinct(), "url-universe")
    ruled, allowed, sites = build_cascade(keys_of(by_rule), universe), build_cascade(keys_of([r for r, v in by_rule.items() if v == "allow"]), keys_of(by_rule)), build_cascade(keys_of(listed), universe)
    longest = lambda keys, cascade: F.reduce(F.filter(keys, cascade.contains), F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))
    out = parts.withColumn("rule", bound(candidates(lengths(by_rule)) if by_rule else F.array().cast("array<string>"), lambda keys: longest(keys, ruled)))
    on_list = bound(candidates(lengths(listed)) if listed else F.array().cast("array<string>"), lambda keys: F.exists(keys, sites.contains))
    by_its_rule = F.when(allowed.contains(F.col("rule")), F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull(), by_its_rule).otherwise(F.when(on_list, F.lit("block")).otherwise(F.lit("allow"))))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
b AS (SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
         FROM b JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT b.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN path LIKE '/%' AND regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN fits ON b.page_id = fits.page_id AND n = 1
"""

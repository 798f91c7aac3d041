"""URL filter with a Bloom filter cascade: exact membership without joins.

The first filter encodes the listed keys of the universe, the second what other
keys of the universe pass the first, the third what listed keys pass the second,
and so on until nothing passes wrongly. For any key of the universe the level at
which it is first refused tells whether it is listed. All of it, building too, is
DataFrame operations; a finished level is one array of longs that goes into the
plan as a scalar subquery's value.

A cascade holds a bounded number of bits. For longer lists the keys are dealt by
their hash to as many cascades as it takes, and rows are judged one shard after the
other, each with the arrays of its own shard only; nothing is ever refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, own_columns, table

#: Bits of a level from which keys are dealt to several cascades (16 MB), and words of a level that are put in order together.
SHARD_BITS, CHUNK = 1 << 27, 1024

#: (host, path, verdict): fixed values of the contract.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: A page is poor if it has one of these characters in fewer than so many, and a
#: host is listed if the share of its poor pages is so many times that of all pages.
POOR_CHARS, POOR_SHARE, TIMES = "[#*$%|]", 50, 2


@dataclass
class Cascade:
    """Levels of a cascade: number of bits, number of hashes, and the bits as a one-row frame."""

    bits: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)

    def passes(self, key: Column, level: int) -> Column:
        """Whether the filter of one level has all bits of ``key``."""
        words, out = self.frames[level].scalar(), F.lit(True)
        for p in positions(key, level, self.bits[level], self.hashes[level]):
            out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
        return out

    def contains(self, key: Column) -> Column:
        """Whether ``key`` is listed: exact for keys of the universe; null counts as not listed."""
        out = F.lit(len(self.bits) % 2 == 1)
        for level in reversed(range(len(self.bits))):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(F.when(key.isNotNull(), out), F.lit(False))


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.shiftrightunsigned(a, 2) + i * F.shiftrightunsigned(b, 8), F.lit(bits)) for i in range(hashes)]


def _bits(n: int, others: int, level: int) -> tuple[int, int]:
    """Bits and hashes of a level that encodes ``n`` keys and should refuse most of the others."""
    # The rate at which the next level is about as large as this one's share of the others.
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * n / max(others, 1))) if level == 0 else 0.5
    return max(64, 64 * math.ceil(n * 1.4427 * -math.log2(rate) / 64)), max(1, round(-math.log2(rate)))


def marked(universe: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys of the universe, with ``l`` = 1 if they are listed."""
    every = own_columns(universe, key).where(F.col(key).isNotNull()).select(key, F.lit(1).alias("u"), F.lit(0).alias("l"))
    named = own_columns(listed, key).where(F.col(key).isNotNull()).select(key, F.lit(0).alias("u"), F.lit(1).alias("l"))
    return every.unionAll(named).groupBy(key).agg(F.max("u").alias("u"), F.max("l").alias("l")).where("u = 1").select(key, "l")


def build(keys: DataFrame, key: str = "key") -> Cascade:
    """A cascade over ``marked`` keys. An empty list gives a cascade without levels."""
    out = Cascade()
    inside, outside = keys.where("l = 1"), keys.where("l = 0")
    while (n := inside.count()) > 0:
        level = len(out.bits)
        bits, hashes = _bits(n, outside.count(), level)
        place = F.explode(F.array(*positions(F.col(key), level, bits, hashes))).alias("p")
        words = inside.select(place).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, int(p % 64))").alias("b"))
        zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
        words = words.unionAll(zeros).groupBy("w").agg(F.bit_or("b").alias("b"))
        in_order = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v])
        chunks = words.groupBy(F.expr(f"w div {CHUNK}").alias("c")).agg(in_order("w", "b").alias("part"))
        out.bits.append(bits)
        out.hashes.append(hashes)
        out.frames.append(cut(chunks.agg(F.flatten(in_order("c", "part")).alias("words"))))
        wrong = cut(outside.where(out.passes(F.col(key), level)))
        inside, outside = wrong, inside
    return out


def shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))


def member(rows: DataFrame, key: str, universe: DataFrame, listed: DataFrame, name: str = "listed", shard_bits: int = SHARD_BITS) -> DataFrame:
    """``rows`` with the column ``name``: whether ``key`` is in column ``key`` of ``listed``.

    Exact for the keys in ``universe`` (column ``key``); listed keys that are not in
    the universe are left out, null keys are in no list, repeats count once. With
    several shards ``rows`` are read once for each, so they must come out alike.
    """
    keys = cut(marked(universe, listed))
    n, every = keys.agg(F.sum("l"), F.count("*")).first()
    shards = math.ceil(_bits(n or 0, every - (n or 0), 0)[0] / shard_bits)
    if shards == 1:
        return rows.withColumn(name, build(keys).contains(F.col(key)))
    out = rows.where(F.col(key).isNull()).withColumn(name, F.lit(False))
    for s in range(shards):
        cascade = build(keys.where(shard(F.col("key"), shards) == s))
        out = out.unionAll(rows.where(F.col(key).isNotNull() & (shard(F.col(key), shards) == s)).withColumn(name, cascade.contains(F.col(key))))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    known = F.coalesce(at > 0, F.lit(False))
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", shard_bits: int = SHARD_BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every page.

    ``listed`` has the listed hosts in column ``key``; a host is blocked if it is
    listed, unless a rule decides. Null urls have an empty host and are allowed.
    Repeated rows and null ids are kept as they are; an empty table gives none.
    """
    rows = own_columns(pages, id_col, url_col)
    host, path = url_parts(F.col(url_col))
    rows = rows.select(id_col, host.alias("host"), path.alias("path"))
    rows = member(rows, "host", rows.select(F.col("host").alias("key")), listed, shard_bits=shard_bits)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def poor_hosts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``key``: hosts with poor pages, ``TIMES`` as many as their number lets expect or more; null pages are not poor, the empty host is not listed."""
    rows = own_columns(pages, url_col, html_col)
    poor = F.coalesce(POOR_SHARE * F.regexp_count(html_col, F.lit(POOR_CHARS)) > F.length(html_col), F.lit(False)).cast("int")
    hosts = rows.select(url_parts(F.col(url_col))[0].alias("key"), poor.alias("poor"))
    hosts = cut(hosts.groupBy("key").agg(F.sum("poor").alias("poor"), F.count("*").alias("n")))
    poor, n = hosts.agg(F.coalesce(F.sum("poor"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return hosts.where(f"poor > 0 and poor * {n}D >= {TIMES} * {poor}D * n and key <> ''").select("key")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are listed by what their pages say."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, poor_hosts(pages))


ORACLE = f"""
WITH parts AS (
  SELECT page_id, html, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
hosts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
pages_of AS (
  SELECT host, count(*) AS n, count(*) FILTER ({POOR_SHARE} * len(regexp_extract_all(html, '{POOR_CHARS}')) > length(html)) AS poor FROM hosts GROUP BY host),
poor AS (
  SELECT host FROM pages_of WHERE host <> '' AND poor > 0
    AND poor * (SELECT sum(n) FROM pages_of) >= {TIMES} * n * (SELECT sum(poor) FROM pages_of)),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    host IN (SELECT host FROM poor) AS listed
  FROM hosts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM judged
"""

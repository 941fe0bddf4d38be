"""URL filter: path rules first, then a Bloom filter cascade over the listed hosts.

Levels alternate: level 0 encodes the listed keys, level 1 those other keys of the corpus that level 0
takes for listed, level 2 the listed keys that level 1 takes for others, and so on until a level makes
no mistake. Over the keys that the corpus holds (its whole universe goes into the build), membership is
exact, and a lookup reads a few bits of arrays inside the plan: no join. All of it is DataFrame
expressions. A level's bits are proportional to the number of listed keys; a list of more than ``MOST_LISTED`` keys, whose
bits would not fit a plan, is looked up by a join of the corpus's distinct hosts instead, with the same result.

Cases: a null url, or one without "://", has an empty host and path, no rule, and is allowed; an empty
table gives an empty result; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.numeric import let
from sigloom.llm._common import Stage, narrow

#: Rules of the query: (verdict, host/path). The longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hosts whose urls are blocked, with all subdomains, where no rule fits.
LISTED = ("spam-farm.example.org", "spam-farm.example.net", "spam-farm.example.com", "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org", "ththon.example.com", "ththhe.example.com", "ththnd.example.net", "m.ththed.example.net")
#: Keys of a cascade; level 0 then takes at most 64 bits a key, 8 MB in all. Longer lists are joined.
MOST_LISTED = 1_000_000
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_LETTERS), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to "?", "#" or the end."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls: a case ladder from the longest on."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column) -> Column:
    """The host and every parent domain of it, distinct."""
    parts = F.split(host, r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    data: bytes

    def holds(self, key: Column) -> Column:
        """Whether all the key's bits are set. The bits are one literal of the plan, bound to a name."""

        def bit(data: Column, at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(data, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        return let(F.lit(self.data), lambda data: all_of([bit(data, at) for at in places(key, self.bits, self.hashes, self.seed)]))


def all_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Positions of a key; every level hashes with seeds of its own, or two keys that clash once would clash at every level."""
    return [F.pmod(F.xxhash64(F.lit(1000 * seed + i), key), F.lit(bits)) for i in range(hashes)]


def bloom(keys: DataFrame, n: int, bits_per_key: float, seed: int = 0) -> Level:
    """A Bloom filter of the column ``key``: 64-bit words, or-ed together by word before they reach the driver."""
    bits = max(64, 64 * math.ceil(n * bits_per_key / 64))
    hashes = max(1, round(bits_per_key * math.log(2)))
    at = keys.select(F.explode(F.array(*places(F.col("key"), bits, hashes, seed))).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))  # at most bits / 64 rows
    full = bytearray(bits // 8)
    for w, v in words.collect():
        full[8 * w : 8 * w + 8] = v.to_bytes(8, "little", signed=True)
    return Level(bits, hashes, seed, bytes(full))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether the key is listed; exact for every key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[depth].holds(key), out).otherwise(F.lit(depth % 2 == 1))
        return out


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """Build from listed keys and all keys of the corpus (column ``key`` each; listed ones may be absent there); None for too long a list."""
    spark = listed.sparkSession
    stage = Stage(spark, "cascade")
    inside = stage.put(listed.select("key").where("key is not null").distinct())
    n_in = inside.count()
    if not 0 < n_in <= MOST_LISTED:
        stage.drop(inside)
        return None if n_in else Cascade(())
    outside = stage.put(universe.where("key is not null").distinct().join(inside, "key", "left_anti"))
    n_out = outside.count()
    sides, sizes, levels = [inside, outside], [n_in, n_out], []
    # Level 0 lets about as many others through as there are listed keys; each next level errs on half of what it sees.
    bits = max(2.0, min(64.0, 1.44 * math.log2(max(2.0, n_out / n_in)) + 1))
    made = [inside, outside]
    while sizes[0]:
        levels.append(bloom(sides[0], sizes[0], bits, len(levels)))
        wrong = stage.put(sides[1].where(levels[-1].holds(F.col("key"))))
        made.append(wrong)
        sides, sizes = [wrong, sides[0]], [wrong.count(), sizes[0]]
        bits = 2.0
    stage.drop(*made)
    return Cascade(tuple(levels))


def joined(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """host, hit for each of distinct hosts: whether it or a parent is listed, by a join on the key."""
    keys = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    found = keys.join(listed.select("key").distinct(), "key", "left_semi").select("host").distinct().withColumn("hit", F.lit(True))
    return hosts.join(found, "host", "left").select("host", F.coalesce("hit", F.lit(False)).alias("hit"))


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, listed, verdict for each row: the longest rule's verdict, else block where the host or a parent is listed."""
    pages = narrow(pages, page_id=id_col, url=url_col).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    hosts = pages.select("host").distinct()
    found = cascade(listed, hosts.select(F.explode(suffixes(F.col("host"))).alias("key")))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    if found is None:
        pages = pages.join(joined(hosts, listed), "host", "left")
        hit = F.col("hit")
    else:
        hit = F.exists(suffixes(F.col("host")), found.holds) if found.levels else F.lit(False)
    out = pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), hit.alias("listed"))
    return out.select("page_id", "host", "path", "rule", "listed", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_frame(spark: SparkSession, keys=LISTED) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("key")) for k in keys]
    return spark.range(1).select(F.inline(F.array(*rows)))

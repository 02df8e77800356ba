"""URL filters: longest-match rules, and a Bloom filter cascade that decides the rest exactly, without joins.

The cascade knows every key (host) of the corpus. Level 1 is a Bloom filter of the listed keys; level 2 one of the other
keys that level 1 lets through; level 3 one of the listed keys that level 2 lets through; and so on until a level lets
nothing through that it shouldn't. The first level that doesn't have a key says on which side the key is, and that is exact for all
keys of the corpus. A lookup is arithmetic on constants; only the building of the levels groups rows. A level is cut into
shards by a hash of the key, so that no constant is longer than MOST_BITS; a level of more than SHARDS shards takes several passes over the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shared_table, table

# Fixed values: (action, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Host names that are blocked with all hosts that have one of them as a label.
BLOCKED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BITS_PER_KEY, HASHES = 12, 5
#: A shard of a level may have about so many bits (2 MiB), and a pass so many shards of all levels.
MOST_BITS, SHARDS = 1 << 24, 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule (host and path) that fits and is longest, and its action; null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


class Level:
    """One Bloom filter: for each shard an array of 64-bit words, as rows of a DataFrame."""

    def __init__(self, keys: DataFrame, level: int, count: int, shards: int):
        spark = keys.sparkSession
        self.level, self.shards, self.bits = level, shards, -(-max(1, count // shards) * BITS_PER_KEY // 64) * 64
        at = keys.select(shard_of(F.col("key"), shards).alias("shard"), F.explode(F.array(*places(F.col("key"), level, self.bits))).alias("at"))
        words = at.groupBy("shard", F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word"))
        every = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.bits // 64 - 1).cast("long"))).alias("place"), F.lit(0).cast("long").alias("word"))
        full = every.unionByName(words).groupBy("shard", "place").agg(F.bit_or("word").alias("word"))
        self.rows = full.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words"))

    def settle(self, path: str) -> Level:
        self.rows = shared_table(self.rows, path)
        return self

    def has(self, key: Column, shards: list[int]) -> Column:
        """Whether it lets a key of one of these shards through."""

        def test(shard: int) -> Column:
            words = self.rows.filter(F.col("shard") == shard).select("words").scalar()
            return reduce(lambda a, b: a & b, [F.getbit(F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(63)) == 1 for p in places(key, self.level, self.bits)])

        out = test(shards[-1])
        for k in shards[:-1]:
            out = F.when(shard_of(key, self.shards) == k, test(k)).otherwise(out)
        return out


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("long")


class Cascade:
    """The levels for a universe of distinct keys (columns key and listed). Builds them when made."""

    def __init__(self, universe: DataFrame):
        work = shared_dir(universe.sparkSession)
        keys = shared_table(universe.select("key", "listed"), f"{work}/keys")
        inside, outside = keys.filter("listed").select("key"), keys.filter("not listed").select("key")
        self.levels: list[Level] = []
        self.shards = max(1, -(-inside.count() * BITS_PER_KEY // MOST_BITS))
        while count := inside.count():
            level = Level(inside, len(self.levels), count, self.shards).settle(f"{work}/level{len(self.levels)}")
            passed = [outside.filter(shard_of(F.col("key"), self.shards).isin(some) & level.has(F.col("key"), some)) for some in self._passes(1)]
            self.levels.append(level)
            inside, outside = shared_table(reduce(DataFrame.unionByName, passed), f"{work}/passed{len(self.levels)}"), inside

    def _passes(self, levels: int) -> list[list[int]]:
        size = max(1, SHARDS // max(1, levels))
        return [list(range(k, min(k + size, self.shards))) for k in range(0, self.shards, size)]

    def _member(self, key: Column, shards: list[int]) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[k].has(key, shards), F.lit(k % 2 == 1)).otherwise(answer)
        return answer

    def marked(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with a column that says whether the key, one of the universe, is listed: the first level without it decides."""
        passes = self._passes(len(self.levels))
        if len(passes) == 1:
            return rows.withColumn(name, self._member(F.col(key), passes[0]))
        return reduce(DataFrame.unionByName, [rows.filter(shard_of(F.col(key), self.shards).isin(some)).withColumn(name, self._member(F.col(key), some)) for some in passes])


def is_blocked(host: Column, names=BLOCKED) -> Column:
    return F.exists(F.split(host, "\\."), lambda label: label.isin(*names))


def url_filter(pages: DataFrame, rules=RULES, names=BLOCKED, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every url.

    The longest fitting rule decides; where none fits, membership of the host in the cascade of listed hosts does: those of a column host of
    the table listed, of any size, or if there is none the hosts with one of the names as a label. A null url or one without "://" has an
    empty host and path, fits no rule and is allowed, unless listed has an empty host. Repeated rows give repeated rows, an empty table none;
    nulls and repeated rows in listed do nothing, and other columns are not read. Builds the cascade when called.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = parts.select(F.col("host").alias("key"))
    if listed is None:
        universe = hosts.distinct().withColumn("listed", is_blocked(F.col("key"), names))
    else:
        both = hosts.withColumn("listed", F.lit(False)).unionByName(listed.filter("host is not null").select(F.col("host").alias("key"), F.lit(True).alias("listed")))
        universe = both.groupBy("key").agg(F.bool_or("listed").alias("listed"))
    rule, action = best_rule(F.col("host"), F.col("path"), rules)
    out = Cascade(universe).marked(parts, "host", "blocked")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _rule_sql() -> tuple[str, str]:
    rows = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return tuple("CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, a)[k]}'" for a, h, p in rows) + " END" for k in (0, 1))


OP9_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {_rule_sql()[0]} AS rule,
       coalesce({_rule_sql()[1]}, CASE WHEN len(list_intersect(string_split(host, '.'), [{", ".join(f"'{x}'" for x in BLOCKED)}])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""

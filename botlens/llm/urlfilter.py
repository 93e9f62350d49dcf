"""URL filter: exact membership in key lists by a Bloom filter cascade.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1
takes for listed by mistake, level 3 the listed keys that level 2 takes for
mistakes, and so on until no key is left.  The cascade knows the corpus's
complete key universe, so the first level that does not hold a key settles its
membership exactly and the pages are judged without a join.

The size follows the list, not the corpus: level 1 gets log2(16 u / n) / ln 2
bits a listed key (n listed, u others), so that about n / 16 mistakes go on to
level 2, and every later level about a sixteenth of the one before.  The bits
enter the plan as literals up to MAX_BITS for a level; a longer list is looked
up by an equi-join instead.  Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlens.session import stage

from .common import let

MAX_BITS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def candidates(labels: list[int], lengths: list[int]) -> Column:
    """Keys that could be listed for a (host, path): the host's suffixes of the
    given label counts, each with the path's prefixes of the given lengths."""
    parts = F.split("host", "\\.")
    hosts = F.filter(F.transform(F.array(*[F.lit(n) for n in labels]), lambda n: F.when(
        (n <= F.size(parts)) & (F.col("host") != ""),
        F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))), lambda x: x.isNotNull())
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(
        n <= F.char_length("path"), F.substring(F.col("path"), 1, n))), lambda x: x.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(
        prefixes, lambda p: F.struct(F.concat(h, p).alias("key"), F.char_length(h).alias("host_chars")))))


class Level:
    """Bits of one Bloom filter and the test for it as an expression."""

    def __init__(self, keys: DataFrame, number: int, n: int, rate: float):
        self.number = number
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.bits = 64 * math.ceil(max(1, n) * math.log2(1 / rate) / math.log(2) / 64)
        if self.bits > MAX_BITS:
            raise OverflowError(f"level {number} needs {self.bits} bits")
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
        held = [0] * (self.bits // 64)
        for row in words.collect():            # at most MAX_BITS / 64 rows
            held[row.word] = row.bits
        self.words = F.from_json(F.lit(json.dumps(held)), "array<bigint>")

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.bits).cast("long"))
                for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        test = F.lit(True)
        for at in self.places(key):
            word = F.get(self.words, (at / 64).cast("int"))
            test = test & (F.call_function("getbit", word, (at % 64).cast("int")) == 1)
        return test


def cascade(keys: DataFrame) -> list[Level]:
    """Levels for a table of distinct (key, listed)."""
    n, others = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    if n == 0:
        return []
    levels, inside, outside = [], keys.filter("listed"), keys.filter("not listed")
    rate = min(1 / 16, n / (16 * max(1, others)))
    while n:
        levels.append(Level(inside, len(levels) + 1, n, rate))
        mistaken = outside.filter(levels[-1].holds(F.col("key")))
        inside, outside = mistaken, inside
        n, rate = mistaken.count(), 1 / 16
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    answer = F.lit(bool(len(levels) % 2))
    for level in reversed(levels):
        answer = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(answer)
    return answer


def held(levels: list[Level], kind: str) -> Column:
    """The candidates of a page (column ``keys``) that the list of this kind holds."""
    return F.transform(F.filter("keys", lambda c: member(levels, c["key"])), lambda c: F.struct(
        c["key"].alias("key"), c["host_chars"].alias("host_chars"), F.lit(kind).alias("kind")))


def listed_by_join(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """Beyond MAX_BITS: the listed candidates of each page by an equi-join."""
    hits = (pages.select("_at", F.explode("keys").alias("k"))
            .join(lists.withColumnRenamed("key", "_key"), F.col("k.key") == F.col("_key"))
            .groupBy("_at").agg(F.collect_set(F.struct("k.key", "k.host_chars", "kind")).alias("hits")))
    return pages.join(hits, "_at", "left")


def judge(pages: DataFrame, lists: DataFrame, keep: list[str], url: str = "url") -> DataFrame:
    """host, path, rule and verdict of every page, beside the columns of ``keep``.

    ``lists`` holds distinct (key, kind): kind ``allow`` or ``block`` for rules
    (key: host and path as text; the longest fitting rule wins, of equally long
    ones that with the longer host), kind ``listed`` for hosts without a path
    that are blocked with their subdomains where no rule fits.  Null urls and
    urls without ``://`` have empty host and path, fit no key and are allowed.
    Repeated pages are judged alike; an empty table gives an empty result.
    """
    lists = lists.select("key", "kind").distinct()
    shape = lists.select(
        F.size(F.split(F.regexp_extract("key", "^([^/]*)", 1), "\\.")).alias("labels"),
        F.char_length(F.regexp_extract("key", "^[^/]*(.*)$", 1)).alias("length"))
    # distinct label counts and prefix lengths of the list: short lists of small numbers
    labels, lengths = shape.agg(F.sort_array(F.collect_set("labels")),
                                F.sort_array(F.collect_set("length"))).first()
    labels, lengths = labels or [1], lengths or [0]      # an empty list
    seen = parsed(pages.select(F.struct(*keep).alias("_row"), F.col(url).alias("_url")), "_url").drop("_url")
    with_keys = seen.withColumn("keys", candidates(labels, lengths))
    universe = with_keys.select(F.explode("keys.key").alias("key")).distinct()
    kinds = ["allow", "block", "listed"]
    flags = lists.groupBy("key").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in kinds])
    universe = stage(universe.join(flags, "key", "left").select(
        "key", *[F.coalesce(k, F.lit(False)).alias(k) for k in kinds]), "url-universe")
    try:
        levels = {k: cascade(universe.select("key", F.col(k).alias("listed"))) for k in kinds}
        hits = F.flatten(F.array(*[held(levels[k], k) for k in kinds]))
        found = with_keys.withColumn("hits", hits)
    except OverflowError:
        found = listed_by_join(with_keys.withColumn("_at", F.monotonically_increasing_id()), lists)
    hits = F.coalesce(F.col("hits"), F.array().cast("array<struct<key:string,host_chars:int,kind:string>>"))
    verdict = let(hits, lambda found_keys: F.struct(
        F.array_max(F.transform(F.filter(found_keys, lambda h: h["kind"] != "listed"), lambda h: F.struct(
            F.char_length(h["key"]).alias("chars"), h["host_chars"].alias("host_chars"),
            h["kind"].alias("kind"), h["key"].alias("key")))).alias("best"),
        F.when(F.exists(found_keys, lambda h: h["kind"] == "listed"), "block").otherwise("allow").alias("other")))
    return found.select("_row", "host", "path", verdict.alias("v")).select(
        "_row.*", "host", "path", F.col("v.best.key").alias("rule"),
        F.coalesce("v.best.kind", "v.other").alias("verdict"))


# words that mark a host: as a whole part of a label, parts being divided by hyphens
MARKS = ["adult", "ads", "bets", "casino", "pills", "spam"]


def marked_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Keys (kind ``listed``) of the corpus's marked hosts, from the marked label on."""
    marked = rf"(?:^|\.)((?:[^.]*-)?(?:{'|'.join(MARKS)})(?:-[^.]*)?\..*)$"
    return (parsed(pages.select(F.col(url).alias("_url")), "_url").select("host").distinct()
            .select(F.regexp_extract("host", marked, 1).alias("key"), F.lit("listed").alias("kind"))
            .filter("key <> ''").distinct())

"""URL rules by a cascade of Bloom filters.

A cascade answers "is this key listed?" exactly for every key of a universe that
is known when it is built: level 1 encodes the listed keys, level 2 the keys of
the universe that level 1 takes for listed, level 3 the listed keys that level 2
catches, and so on until nothing is caught. A key that fails level i is not
listed if i is odd, and listed if i is even. No join is needed to ask.

Level 1 is sized for a rate of wrong hits of about (listed / universe), so that
level 2 holds about as many keys as are listed. The whole cascade therefore takes
O(listed * log(universe / listed)) bits, whatever the number of pages.

Everything is DataFrame functions; a level is a binary literal in the expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, saved, whole_row

#: Most levels; with one more bit a key at each level they shrink by half or more, so this is far off.
MAX_LEVELS = 64


class Rule(NamedTuple):
    action: str  # 'allow' or 'block'
    host: str
    path: str


class Level(NamedTuple):
    filter: bytes  # bit p is bit p % 8 of byte p // 8
    bits: int
    hashes: int
    number: int


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL. Both are empty for null and where `://` is missing."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.when(at > 0, F.regexp_extract(F.substr(rest, F.length(raw_host) + 1), r"^[^?#]*", 0)).otherwise("")
    return F.translate(raw_host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every key a rule that fits could have: the host and its parent domains, with each
    prefix of the path that is as long as some rule's path. Array of (size, host_size, key)."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lengths = F.filter(F.lit(path_lengths), lambda n: n <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.struct(
        (F.length(h) + n).alias("size"), F.length(h).alias("host_size"), F.concat(h, F.substr(path, F.lit(1), n)).alias("key"),
    ))))


def _position(key: Column, level: int, j: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), j), F.lit(bits).cast("bigint"))


def bloom_level(keys: DataFrame, n_keys: int, rate: float, number: int) -> Level:
    """A Bloom filter over column `key`, with about `rate` wrong hits. Built by partial aggregation, one row a word."""
    bits = max(64, math.ceil(n_keys * math.log2(1 / rate) * math.log2(math.e) / 64) * 64)
    hashes = max(1, round(math.log2(1 / rate)))
    each = F.lit(list(range(hashes)))
    places = keys.select(F.explode(F.transform(each, lambda j: _position(F.col("key"), number, j, bits))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(8)).cast("int"))
    rows = places.groupBy(F.floor(F.col("p") / 8).alias("at")).agg(F.bit_or(bit).alias("value"))
    filled = bytearray(bits // 8)
    for row in rows.collect():  # no more rows than the filter has bytes
        filled[row["at"]] = row["value"]
    return Level(bytes(filled), bits, hashes, number)


def hits(key: Column, level: Level) -> Column:
    filled = F.lit(bytearray(level.filter))

    def bit(j: Column) -> Column:
        p = _position(key, level.number, j, level.bits)
        byte = F.conv(F.hex(F.substr(filled, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, F.pmod(p, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(F.lit(list(range(level.hashes))), bit)


class Cascade:
    """Exact membership in `listed` for all keys of `universe` (both with column `key`, no nulls)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = saved(listed.select("key").distinct(), "bloom-listed")
        n_listed = listed.count()
        n_universe = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
        rate = min(0.5, max(n_listed, 1) / (math.sqrt(2) * n_universe))
        self.levels: list[Level] = []
        inside, outside, n_inside = listed, universe, n_listed
        while n_inside:
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("the cascade does not end: two keys hash alike at every level")
            level = bloom_level(inside, n_inside, rate, len(self.levels) + 1)
            self.levels.append(level)
            caught = outside.where(hits(F.col("key"), level)).select("key").distinct()
            if len(self.levels) == 1:
                caught = caught.join(listed, "key", "left_anti")
            caught = saved(caught, "bloom-caught")
            inside, outside, n_inside, rate = caught, inside, caught.count(), 0.5

    def contains(self, key: Column) -> Column:
        """Condition for keys of the universe."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            answer = F.when(hits(key, self.levels[i - 1]), answer).otherwise(F.lit(i % 2 == 0))
        return answer


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with `host`, `path`, `rule` and `verdict`; existing columns of these names are replaced.

    `rules` has `action` ('allow' or 'block'), `host` and `path`. A rule fits its
    host and all subdomains, if the path starts with the rule's path; the longest
    host and path together wins, of equally long ones that with the longer host.
    `rule` is host and path of the rule, null where none fits; then the verdict is
    `default`, as the cascade proves that no listed key covers the page.

    A null URL or one without `://` has empty host and path, and no rule fits
    unless one has both empty. Repeated pages are judged alike; no page and no rule
    give no row and no match.
    """
    key = F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")))
    listed = rules.select(key.alias("key"), F.lower("action").alias("action"), F.length(F.coalesce("path", F.lit(""))).alias("n"))
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())  # as many as there are path lengths
    host, path = host_and_path(F.col(url))
    rows = pages.select(whole_row(pages), host.alias("host"), path.alias("path"))
    keys = rows.select("host", "path").distinct().select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)["key"]).alias("key"))
    in_list = Cascade(listed, keys)
    blocked = Cascade(listed.where("action = 'block'"), listed)
    rows = rows.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    fits = F.array_max(F.filter("_keys", lambda c: in_list.contains(c["key"])))
    rule = fits["key"]
    rows = rows.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), default).when(blocked.contains(F.col("rule")), "block").otherwise("allow")
    made = ["host", "path", "rule", "verdict"]
    return rows.withColumn("verdict", verdict).select(*[F.col("_doc")[c].alias(c) for c in pages.columns if c not in made], *made)

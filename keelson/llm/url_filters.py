"""URL filters: a cascade of Bloom filters decides membership in a list of domains.

Native: built and probed with DataFrame functions only.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that
level 0 takes for listed though they are not; level 2 the listed keys that
level 1 takes for such; and so on until a level errs on no key. Over the keys
that it was built for (every domain that occurs in the corpus), the cascade's
answer is exact, and a probe needs no join: the filters are literals.

Sizes: with r listed and s other keys, level 0 errs on about ``r / sqrt(2)`` of
the others (rate ``r / (s * sqrt(2))``) and every later level on half, so the
whole cascade takes O(r log(s / r)) bits: it grows with the list, not with the
corpus. ``MAX_BITS`` bounds a level; a longer list raises ``ValueError``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: (verdict, host, path): the rule holds for the host and its subdomains, where the path starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The block list: these sites under each of these domains.
BLOCKED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_UNDER = ("example.com", "example.net", "example.org")
MAX_BITS = 1 << 26
MAX_LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def domains(host: Column) -> Column:
    """A host and its parent domains: ``a.b.c`` gives ``[a.b.c, b.c, c]``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


class Level:
    """One Bloom filter: ``n_hashes`` positions among ``n_bits`` bits, kept as longs."""

    def __init__(self, seed: int, n_keys: int, rate: float):
        bits = max(64.0, -n_keys * math.log(rate) / math.log(2) ** 2)
        if bits > MAX_BITS:
            raise ValueError(f"{n_keys} keys need {bits:.0f} bits; a level may have {MAX_BITS}")
        self.seed, self.n_bits = seed, 64 * math.ceil(bits / 64)
        self.n_hashes = max(1, round(self.n_bits / max(n_keys, 1) * math.log(2)))
        self.n_hashes = min(self.n_hashes, max(1, math.ceil(-math.log2(rate))))

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 101 + i)), F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """Set the bits of column ``key``; at most ``MAX_BITS / 64`` longs reach the driver."""
        words = (
            keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
            .groupBy(F.expr("at div 64").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
            .collect()
        )
        held = [0] * (self.n_bits // 64)
        for w in words:
            held[w["word"]] = w["bits"]
        self.words = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")  # folded to one literal
        return self

    def has(self, key: Column) -> Column:
        test = F.lit(True)
        for at in self.positions(key):
            word = F.get(self.words, (at / F.lit(64)).cast("int"))
            test = test & (F.getbit(word, (at % 64).cast("int")) == 1)
        return test


class BloomCascade:
    """Exact membership of ``universe``'s keys in ``listed`` (both with a string column ``key``)."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        listed = scratch(listed.where("key is not null").select("key").distinct(), "listed")
        universe = scratch(universe.where("key is not null").select("key").distinct(), "universe")
        others = universe.join(listed, "key", "left_anti")
        n_listed, n_others = listed.count(), others.count()
        self.levels: list[Level] = []
        ours, theirs, n_ours = listed, others, n_listed
        while n_ours and len(self.levels) < MAX_LEVELS:
            rate = 0.5
            if not self.levels:
                rate = min(0.5, max(1e-9, n_listed / (max(n_others, 1) * math.sqrt(2))))
            level = Level(len(self.levels), n_ours, rate).fill(ours)
            self.levels.append(level)
            wrong = scratch(theirs.where(level.has(F.col("key"))), "wrong")
            ours, theirs, n_ours = wrong, ours, wrong.count()
        if n_ours:
            raise ValueError("the cascade does not end: keys collide in every level")

    def has(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].has(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def block_list(spark) -> DataFrame:
    return spark.createDataFrame([(f"{site}.{under}",) for site in BLOCKED_SITES for under in BLOCKED_UNDER], "key string")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for each row of ``pages``.

    The longest rule that fits decides; without one, a url is blocked if its
    host or a parent domain is in ``listed``. A null url or one without ``://``
    has an empty host and path and is allowed. Repeated rows are judged each;
    other columns of ``pages`` are not looked at; an empty table gives no rows.
    """
    parsed = pages.select("page_id", *(c.alias(n) for n, c in zip(("host", "path"), host_and_path(F.col("url")), strict=True)))
    universe = parsed.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    cascade = BloomCascade(universe, listed)
    is_listed = F.exists(domains(F.col("host")), cascade.has)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return parsed.withColumn("listed", is_listed).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


ORACLE_SQL = """
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages
), raw as (
  select page_id, r, regexp_extract(r, '^([^/?#]*)', 1) as h from rest
), parsed as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(r, length(h) + 1), '^([^?#]*)', 1) as path from raw
), judged as (
  select page_id, host, path,
    regexp_matches(host, '^(.*\\.)?(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$') as listed,
    case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from parsed
)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when listed then 'block' else 'allow' end as verdict, listed
from judged
"""

"""URL filters: rules, then a blocked Bloom filter of listed canonical URLs and an exact join.

A listed URL is a host with a path, as host/path, or a whole host, as host/. Each page has one key
for its canonical URL and one for its host and each domain above it. The filter is a table of
64-bit blocks; a key sets six bits of one block. Keys that the filter passes go to an exact hash
join with the list, which removes false positives. Pages meet the hits by canonical URL, so equal
URLs are looked up once; one URL, or none, may stand for a third of all pages, so that join is
salted. Entries of the list are brought into the form of URLs by the same expressions.

The filter has about 16 bits for each listed URL. It is broadcast if it has at most
BROADCAST_BLOCKS blocks, else joined by shuffle; the list itself is never broadcast by force.

Edge cases: a null URL, or one without ://, has an empty host and path, fits no rule and no list
entry, and is allowed. Repeated rows are judged alike. An empty list hits nothing, an empty table
gives none. Null and blank list entries are left out. Of rules of equal length the one with the
longer host counts, then the later by name. Very long URLs are used whole. Other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted, salts

BITS_PER_KEY = 16
LEAST_BLOCKS = 1024
SALTS = 32
BROADCAST_BLOCKS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z lower-cased, and the path of a URL; both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...], value) -> Column:
    """``value`` of the longest rule that fits, as one CASE expression; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def canonical(host: Column, path: Column) -> Column:
    """host/path without user, default port and a final dot of the host."""
    plain = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:(80|443)?)?$", "")
    return F.when(host != "", F.concat(plain, F.when(path == "", F.lit("/")).otherwise(path)))


def list_key(entry: Column) -> Column:
    """A list entry as a key: a URL, host/path, or a host alone, which stands for host/."""
    whole = F.trim(entry)
    host, path = host_and_path(F.when(whole.contains("://"), whole).otherwise(F.concat(F.lit("//://"), whole)))
    return F.when(whole != "", canonical(host, path))


def _keys(url: Column) -> Column:
    """The canonical URL, and host/ for its host and each domain above."""
    host = F.substring_index(url, "/", 1)
    labels = F.size(F.split(host, r"\."))
    above = F.transform(F.sequence(F.lit(1), labels), lambda n: F.concat(F.call_function("substring_index", host, F.lit("."), -n), F.lit("/")))
    return F.array_distinct(F.concat(F.array(url), above))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    out = F.lit(0).cast("long")
    for n in range(6):
        bit = F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_blocks(listed: DataFrame, n_blocks: int, key: str = "key") -> DataFrame:
    """The filter of the keys: block, bits."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block")
    return listed.select(block, _mask(F.col(key)).alias("m")).groupBy("block").agg(F.bit_or("m").alias("bits"))


def listed_urls(urls: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """The values of ``urls.url`` (canonical) that the list holds, whole or by host; distinct."""
    listed = listed.select(list_key(F.col(key).cast("string")).alias("key")).where("key is not null").distinct()
    n_blocks = max(LEAST_BLOCKS, listed.count() * BITS_PER_KEY // 64)
    blocks = bloom_blocks(listed, n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    probes = urls.where("url is not null").select("url").distinct().select("url", F.explode(_keys(F.col("url"))).alias("key"))
    probes = probes.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    mask = _mask(F.col("key"))
    possible = probes.join(blocks, "block").where(F.col("bits").bitwiseAND(mask) == mask).select("url", "key")
    # each key meets the list once; a host may have a third of all pages, so these are dealt over SALTS tasks
    sure = possible.select("key").distinct().join(listed.hint("shuffle_hash"), "key", "left_semi")
    sure = sure.withColumn("salt", F.explode(salts(SALTS)))
    possible = possible.withColumn("salt", salted(SALTS, "url"))
    return possible.join(sure, ["key", "salt"], "left_semi").select("url").distinct()


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: tuple[UrlRule, ...] = (), id_col: str = "page_id", url_col: str = "url", key: str = "key"
) -> DataFrame:
    """A verdict for each input row: page_id, host, path, rule, listed, verdict."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    df = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    df = df.withColumns(
        {
            "rule": rule_for(F.col("host"), F.col("path"), rules, lambda r: r.name),
            "ruled": rule_for(F.col("host"), F.col("path"), rules, lambda r: r.verdict),
            "url": canonical(F.col("host"), F.col("path")),
        }
    )
    hits = listed_urls(df, listed, key).withColumns({"listed": F.lit(True), "salt": F.explode(salts(SALTS))})
    df = df.withColumn("salt", salted(SALTS, "page_id", "path")).join(hits, ["url", "salt"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", "listed", verdict.alias("verdict"))

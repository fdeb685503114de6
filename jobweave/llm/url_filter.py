"""URL filter, in DataFrame operations only: host and path rules, then a list of blocked canonical URLs.

A blocked Bloom filter of the list (one 256-bit block a key, eight bits of it) passes possible hits; an exact hash join
with the list removes the false positives. The filter is a table of blocks, made by a partial aggregation and met by a join on
the block's number: broadcast up to a size, shuffled beyond, so it serves lists of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach_by_key

#: (action, host, path); a rule's name is host + path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
KEYS_PER_BLOCK = 16  # 16 bits a key
MAX_BROADCAST_BLOCKS = 250_000  # 10 MB of filter, 4 million keys; the blocks of a longer list are joined by shuffling
MAX_BROADCAST_KEYS = 200_000  # a longer list is joined by shuffling


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without a last slash; scheme, query and fragment are left out."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_name(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == at) | host.endswith("." + at)) & path.startswith(start), F.lit(at + start)).otherwise(out)
    return out


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the mask of each of the block's four words: two bits in each, six hash bits a place."""
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    words = []
    for w in range(4):
        one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h2, 12 * w + 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in (0, 1)]
        words.append(one[0].bitwiseOR(one[1]))
    return F.pmod(h1, F.lit(blocks)).cast("int"), words


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: a row for each block that holds a key, with its number and its four words."""
    block, words = _places(F.col("key"), blocks)
    filled = listed.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
    return filled.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def may_hold(key: Column, blocks: int) -> Column:
    """Whether a key's bits are all set in the words w0 to w3 of its block (null: a block without keys)."""
    out = F.col("w0").isNotNull()
    for i, w in enumerate(_places(key, blocks)[1]):
        out = out & (F.col(f"w{i}").bitwiseAND(w) == w)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, listed (the canonical URL is on the list).

    listed: column `url` of canonical URLs; nulls and repeats in it don't count. A null url, or one without "://", has
    an empty host and path, fits no rule and is never on the list. Rules go before the list; a page that no rule fits is
    blocked if listed, else allowed. Repeated pages give repeated rows. Other columns are ignored. An empty table of pages
    gives an empty result, an empty list blocks nothing.
    """
    keys = listed.select(F.col("url").alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
    n = keys.count()
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules)).withColumn("key", canonical(F.col("host"), F.col("path")))
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    asked = F.col("rule").isNull() & (F.col("key") != "")
    out = out.withColumn("block", F.when(asked, _places(F.col("key"), blocks)[0]))
    if blocks <= MAX_BROADCAST_BLOCKS:
        out = out.join(F.broadcast(bloom(keys, blocks)), "block", "left")
    else:
        out = attach_by_key(out, bloom(keys, blocks), "block", F.col("page_id"))
    out = out.withColumn("probe", F.when(asked & may_hold(F.col("key"), blocks), F.col("key")))
    exact = keys.select(F.col("key").alias("probe"), F.lit(True).alias("hit"))
    if n <= MAX_BROADCAST_KEYS:
        out = out.join(F.broadcast(exact), "probe", "left")
    else:
        # Only distinct possible hits meet the list; one hot URL is one row there, and comes back salted.
        out = attach_by_key(out, exact, "probe", F.col("page_id"))
    action = F.lit(None).cast("string")
    for what, at, start in rules:
        action = F.when(F.col("rule") == at + start, what).otherwise(action)
    hit = F.coalesce("hit", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce(action, F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed"))


def block_list(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs of `pages` whose md5 begins with 0, 1, 2 or 3 (a quarter of them), and of
    each a neighbour that no page has."""
    key = canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")
    listed = pages.select(key).where(F.substring(F.md5("key"), 1, 1).isin("0", "1", "2", "3"))
    return listed.select(F.explode(F.array("key", F.concat("key", F.lit("/listed")))).alias("url"))


ORACLE = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '') AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE key <> '' AND md5(key)[1] IN ('0', '1', '2', '3')),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN rule IS NULL AND key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict, rule IS NULL AND key IN (SELECT key FROM l) AS listed FROM r
"""

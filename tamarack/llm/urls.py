"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

The list holds pages (host and path) and whole sites (a bare host, which also stands for its subdomains). A URL is
looked up by its canonical form and by each suffix of its host. Keys that pass the filter are joined with the list
itself, so a false positive never takes a page away, and only the rows behind possible hits are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, materialize, mix64, table, unused

#: Bits for each listed key; a key sets one bit in each of the 8 words of one 512-bit block.
BITS_PER_KEY = 16
#: The filter is broadcast and never larger than this. A list of more than 32 million keys gets fewer bits for each, so that more rows reach the exact join.
FILTER_MB = 64
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: The sites that the registered query lists besides single pages.
SITES = ("spam-farm.example.org", "cheap-pills.example.com")
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def canonical(url: Column) -> Column:
    """Without scheme, user, port, www., fragment, tracking parameters and closing slashes; the host in lower case, parameters in order.

    Null for a null or blank URL.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://|^//", ""), "#.*$", "")
    authority = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), "^www\\.|\\.$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)"))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit(""))))


def lookup_keys(canonical_url: Column) -> Column:
    """The canonical URL, and every suffix of its host that has two labels or more, without repeats."""
    labels = F.split(F.regexp_extract(canonical_url, "^[^/?]*", 0), "\\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.array_distinct(F.concat(F.array(canonical_url), suffixes))


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the 8 words to set in it."""
    h = mix64(h.view(np.uint64) if h.dtype == np.int64 else h)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    shift = (((h & np.uint64(0xFFFFFFFF))[:, None] * SALTS[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block.astype(np.int64), np.uint64(1) << shift


def _partial_filters(blocks: int):
    def run(batches):
        words, any_ = np.zeros((blocks, 8), np.uint64), False
        for batch in batches:
            block, bits = _bits(batch.column("h").to_numpy(), blocks)
            np.bitwise_or.at(words, block, bits)
            any_ = True
        if any_:
            used = np.flatnonzero(words.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(words[used, k].view(np.int64)) for k in range(8)]], ["block", *[f"w{k}" for k in range(8)]])

    return run


def bloom_filter(keys: DataFrame, n: int, most_mb: int = FILTER_MB) -> np.ndarray:
    """The filter of (h long), `n` keys, as an array of blocks of 8 words; partial filters are joined by OR before they reach the driver."""
    blocks = max(1, min(-(-n * BITS_PER_KEY // 512), most_mb << 14))
    partial = keys.mapInArrow(_partial_filters(blocks), "block long, " + ", ".join(f"w{k} long" for k in range(8)))
    t = partial.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]).toArrow()
    words = np.zeros((blocks, 8), np.uint64)
    if t.num_rows:
        words[t.column("block").to_numpy()] = np.stack([t.column(f"w{k}").to_numpy().view(np.uint64) for k in range(8)], 1)
    return words


def _maybe(shared):
    @F.arrow_udf("boolean")
    def maybe(hashes: pa.Array) -> pa.Array:
        words = shared.value
        sizes = np.asarray(hashes.value_lengths().fill_null(0))
        h = hashes.flatten().to_numpy()
        block, bits = _bits(h, len(words))
        hit = ((words[block] & bits) == bits).all(1)
        row = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros(len(sizes), bool)
        out[row[hit]] = True
        return pa.array(out)

    return maybe


def drop_listed(pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", filter_mb: int = FILTER_MB) -> DataFrame:
    """The rows of `pages` whose URL isn't listed, with all their columns.

    Rows with a null or blank URL are never listed and stay; repeated rows fare alike. Null and blank list entries count
    for nothing, and an empty list takes nothing away. What `filter_mb` allows for the filter changes how many rows the
    exact join sees, never the result. A key that many URLs share is a skewed key of semi- and anti-joins, which
    adaptive execution splits.
    """
    spark = pages.sparkSession
    keys = materialize(listed.select(canonical(col(listed_url)).alias("key")).where("key is not null").distinct())
    n = keys.count()
    if not n:
        return pages
    test, hit = unused(pages.columns, "_maybe", "_hit")
    form = canonical(col(url))
    maybe = _maybe(spark.sparkContext.broadcast(bloom_filter(keys.select(F.xxhash64("key").alias("h")), n, filter_mb)))
    tested = pages.withColumn(test, maybe(F.transform(lookup_keys(F.coalesce(form, F.lit(""))), lambda k: F.xxhash64(k))) & form.isNotNull())
    possible, clear = materialize(tested.where(col(test)).drop(test)), tested.where(~col(test)).drop(test)
    exploded = possible.select(col(url).alias("url")).distinct().select("url", F.explode(lookup_keys(canonical(F.col("url")))).alias("key"))
    hits = exploded.join(keys, "key", "left_semi").select(F.col("url").alias(hit)).distinct()
    return clear.union(possible.join(hits, col(url) == col(hit), "left_anti"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that stay: listed are the sites in SITES, and each page of which a copy carries symbol junk in its markup."""
    pages = table(spark, sf_dir, "pages")
    sites = spark.createDataFrame([(s,) for s in SITES], "url string")
    junk = pages.where(F.col("html").contains("*** ") & F.col("html").contains("%%% ")).select("url")
    return drop_listed(pages.select("page_id", "url"), junk.unionByName(sites))


def _canonical_sql(u: str) -> str:
    rest = f"regexp_replace(regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://|^//', ''), '#.*$', '')"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^[^/?]*', 0)), '^.*@', ''), ':[0-9]*$', ''), '^www\\.|\\.$', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    kept = f"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:{TRACKING})(=|$)')))"
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


ORACLE = f"""
WITH p AS (SELECT page_id, url, html, {_canonical_sql('url')} AS c FROM pages),
listed AS (SELECT c AS key FROM p WHERE html LIKE '%*** %' AND html LIKE '%\\%\\%\\% %' ESCAPE '\\' AND c IS NOT NULL UNION {' UNION '.join(f"SELECT '{s}'" for s in SITES)}),
keyed AS (SELECT DISTINCT url, c, string_split(regexp_extract(c, '^[^/?]*', 0), '.') AS l FROM p WHERE c IS NOT NULL),
keys AS (SELECT url, c AS key FROM keyed UNION SELECT url, array_to_string(l[i:], '.') FROM (SELECT url, l, unnest(range(1, greatest(len(l), 2))) AS i FROM keyed)),
hits AS (SELECT DISTINCT url FROM keys WHERE key IN (SELECT key FROM listed))
SELECT page_id, url FROM p WHERE url IS NULL OR url NOT IN (SELECT url FROM hits)
"""

QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": ORACLE}

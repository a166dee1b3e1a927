"""URL filters: a blocked Bloom filter before an exact join with the listed URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_WORDS = 8  # 64-bit words of a block, one bit is set in each: 512 bits
BITS_PER_URL = 16
MOST_BLOCKS = 1 << 20  # 64 MB; longer lists only let more false positives through to the join

RULES = (  # fixed values: verdict, host, path
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules(spark: SparkSession, listed: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(listed), "verdict string, host string, path string")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), blocks)


def _bits(key: Column) -> list[Column]:
    """One bit in each of the words of a block."""
    h = F.xxhash64(F.lit("bits"), key)
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 8 * i).bitwiseAND(63).cast("int")) for i in range(BLOCK_WORDS)]


def bloom(listed: DataFrame) -> tuple[Column, Column]:
    """How many blocks, and their words one after the other: two scalar subqueries.

    The number of blocks follows from the list, up to MOST_BLOCKS.
    """
    keys = listed.select(F.concat("host", "path").alias("key")).distinct()
    count = keys.agg(F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * BITS_PER_URL / (64 * BLOCK_WORDS)))).cast("int"))
    blocks = count.scalar()
    placed = keys.withColumn("_blocks", blocks).withColumn("_block", _block(F.col("key"), F.col("_blocks")).cast("int"))
    words = F.array(*[F.bit_or(b) for b in _bits(F.col("key"))])
    filled = placed.groupBy("_block").agg(words.alias("_words"))
    blank = F.array(*[F.lit(0).cast("long")] * BLOCK_WORDS)
    whole = filled.agg(F.map_from_entries(F.collect_list(F.struct("_block", "_words"))).alias("_map")).withColumn("_blocks", blocks)
    numbers = F.sequence(F.lit(0), F.col("_blocks") - 1)
    full = F.flatten(F.transform(numbers, lambda i: F.coalesce(F.try_element_at(F.col("_map"), i), blank)))
    return blocks, whole.select(full).scalar()


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (page_id, url).

    A rule (host, path) fits its host and all subdomains when the path of the URL
    starts with the rule's; the longest rule wins. Candidate keys of a URL are made
    only for the (labels, path length) shapes that occur in the list. Keys that pass
    the Bloom filter meet the list in a hash join that compares them exactly; URLs
    without such a key skip the join.

    Null URLs and URLs without ``://``: host and path empty, no rule. Repeated rows
    stay. Of equal rules with different verdicts ``block`` wins. Null rules are
    dropped, an empty list gives every page the default, other columns are ignored.
    """
    listed = listed.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").dropna()
    exact = listed.groupBy(F.concat("host", "path").alias("_key")).agg(F.max("verdict").alias("_verdict"))
    shape = F.struct(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    shapes = listed.select(shape.alias("s")).distinct().agg(F.collect_list("s").alias("_shapes"))  # one entry per form of a rule
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    blocks, words = bloom(listed)
    rows = rows.withColumns({"_shapes": shapes.scalar(), "_blocks": blocks, "_filter": words})
    fits = F.filter("_shapes", lambda s: (F.length("path") >= s["length"]) & (F.length("host") > 0))
    keys = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), F.lit(1), s["length"])))

    def possible(key: Column) -> Column:
        begin = (_block(key, F.col("_blocks")) * BLOCK_WORDS).cast("int")
        return reduce(lambda a, b: a & b, [F.get(F.col("_filter"), begin + i).bitwiseAND(bit) != 0 for i, bit in enumerate(_bits(key))])

    rows = rows.withColumn("_hits", F.array_distinct(F.filter(keys, possible))).drop("_shapes", "_blocks", "_filter")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    none = F.lit(None).cast("string")
    clear = rows.where(F.size("_hits") == 0).select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    hits = rows.where(F.size("_hits") > 0).select("_row", "page_id", "host", "path", F.explode("_hits").alias("_key"))
    best = F.max(F.when(F.col("_verdict").isNotNull(), F.struct(F.length("_key").alias("n"), F.col("_key").alias("rule"), F.col("_verdict").alias("verdict"))))
    judged = hits.join(exact, "_key", "left").groupBy("_row", "page_id", "host", "path").agg(best.alias("b"))
    judged = judged.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
    return clear.unionByName(judged)

"""URL rules by a blocked Bloom filter and an exact hash join.

A listed key is a canonical host and the start of a path. A page's candidates are its host and every parent
domain, each with the path's starts of the lengths that occur in the list. All keys are hashed into a
blocked Bloom filter: the key's hash names one block of 256 bits and one bit in each of the block's four
64-bit words. The filter is a table with a row per block; a candidate whose four bits are set is a possible
hit and goes to a hash join with the list itself, which removes false positives. Of a page's rules the
longest wins (host and path together, then the longer host).

Candidates are made distinct before the filter, so a host with a third of all pages is probed once per
path start. The filter has ``bits_per_rule`` bits a rule and is broadcast as long as it has at most
``FILTER_BYTES`` (two million rules), so only possible hits move; a larger one is shuffled. The list itself is
broadcast only up to ``BROADCAST_RULES`` rows (counted); a longer one takes a shuffled join with the possible
hits, whose hot keys AQE splits. Of a host only the parent domains with no more labels than the list's longest
rule are candidates, so a host of any length costs its length. Driver rows: the list's distinct path lengths.

Edge cases: a url that is null or has no ``://`` has empty host and path and takes the default verdict;
rules with a null host, path or verdict are ignored; of two equal rules ``block`` wins; repeated pages and
ties are judged row by row; an empty list or table works; urls of any length are read whole; further columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixplan.llm.common import ASCII_LOWER, ASCII_UPPER
from helixplan.plans.runtime import Scratch

BROADCAST_RULES = 50_000
FILTER_BYTES = 4 << 20
WORDS = 4
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://`` up to ``?`` or ``#``; empty if there is none."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def url_host(url: Column) -> Column:
    return F.translate(F.substring_index(_after_scheme(url), "/", 1), ASCII_UPPER, ASCII_LOWER)


def url_path(url: Column) -> Column:
    rest = _after_scheme(url)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substr(rest, at)).otherwise(F.lit(""))


def _places(key: Column, blocks: int) -> list[Column]:
    """Block and the one bit in each word."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(g, 8 * i), F.lit(64)).cast("int")).alias(f"__w{i}") for i in range(WORDS)]
    return [F.pmod(h, F.lit(blocks)).cast("int").alias("__block"), *bits]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block in use, with its four words."""
    return keys.select(*_places(F.col(key), blocks)).groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__f{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_rule: int = 16) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``. ``rules`` has ``host, path, verdict``."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    listed = scratch.keep(
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("__h"), F.col("path").alias("__p"))
        .agg(F.max("verdict").alias("__v"))
        .withColumn("__key", F.concat("__h", F.lit("\n"), "__p"))
    )
    told = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("__h", r"\.", -1))).alias("labels")).first()
    n, most = told["n"], told["labels"] or 0
    blocks = max(1, -(-n * bits_per_rule // 256))
    lengths = sorted(r[0] for r in listed.select(F.length("__p")).distinct().collect())
    near = F.broadcast if n <= BROADCAST_RULES else (lambda df: df)
    # A block is four longs and its number.
    small = F.broadcast if 40 * blocks <= FILTER_BYTES else (lambda df: df)
    seen = scratch.keep(pages.select(F.col(id_col).alias("__id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")))
    starts = F.array(*[F.lit(int(x)) for x in lengths]) if lengths else F.array().cast("array<int>")
    # The domains of the last 1, 2, ... labels, each no longer than the list's longest host.
    labels = F.split("host", r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    asked = (
        seen.select("host", F.explode(F.transform(F.filter(starts, lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))).alias("__start"))
        .distinct()
        .select("host", "__start", F.explode(domains).alias("__domain"))
        .withColumn("__ask", F.concat("__domain", F.lit("\n"), "__start"))
    )
    possible = asked.select("host", "__start", "__ask", *_places(F.col("__ask"), blocks)).join(small(bloom_filter(listed, "__key", blocks)), "__block")
    for i in range(WORDS):
        possible = possible.where(F.col(f"__w{i}").bitwiseAND(F.col(f"__f{i}")) != 0)
    rank = F.struct((F.length("__h") + F.length("__p")).alias("n"), F.length("__h").alias("hn"), F.concat("__h", "__p").alias("rule"), F.col("__v").alias("verdict"))
    hits = possible.select("host", "__start", "__ask").join(near(listed), F.col("__ask") == F.col("__key")).groupBy("host", "__start").agg(F.max(rank).alias("__best"))
    # A page meets the hits of its host at its own path's starts; the longest of them wins.
    found = scratch.keep(hits)
    by_host = found.groupBy(F.col("host").alias("__host")).agg(F.sort_array(F.collect_list(F.struct(F.col("__best.n").alias("n"), F.col("__best.hn").alias("hn"), F.col("__start").alias("start"), F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict"))), asc=False).alias("__hits"))
    joined = seen.join(near(by_host) if found.count() <= BROADCAST_RULES else by_host, F.col("host") == F.col("__host"), "left")
    best = F.filter("__hits", lambda x: F.startswith(F.col("path"), x["start"]))
    return joined.withColumn("__one", F.get(best, F.lit(0))).select(
        F.col("__id").alias(id_col), "host", "path", F.col("__one.rule").alias("rule"), F.coalesce(F.col("__one.verdict"), F.lit(default)).alias("verdict")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP4_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
q AS (SELECT page_id, split_part(split_part(CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END, '#', 1), '?', 1) AS rest FROM u),
p AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM q),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, p, verdict)),
m AS (SELECT DISTINCT p.host, p.path, arg_max(r.h || r.p, length(r.h) + length(r.p)) AS rule, arg_max(r.verdict, length(r.h) + length(r.p)) AS verdict
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""

"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule is a host and a path, as in ``example.com/en/``, with a verdict. It fits its host and
all subdomains where the url's path starts with the rule's; the longest rule that fits
wins. Canonical keys turn this into prefixes: the labels of a host are reversed and closed
by a separator below every other character, and the path follows. A url with n labels has
n keys, one for each run of labels that ends its host, with the whole path. A rule fits a
url if its key is a prefix of the url's key for as many labels, so each rule is the
interval of keys that begin with its own, and two intervals are nested or disjoint.

The sweep goes through rule and url keys in order. A stack holds the rules whose interval
is open; a url key belongs to the top one, the longest. The state of the stack changes
only where a rule opens or closes, so each such event carries the rule on top after it
(found from the rules alone), and a url takes the last event before its key.

The key line is cut into ranges of about equal numbers of urls, hashed ids breaking ties,
so a host or a path with a third of the pages is cut too. A rule reaches each range that
its interval meets: at most the number of rules plus, for each cut, the rules nested there.

Keys are compared as bytes; a rule's interval ends with its key and the byte FF, which is in no
text, so it holds every key that begins with its own, whatever characters follow.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule
and gets the default verdict; an empty path starts with no rule's path but the empty one;
rules that repeat a host and path count once, ``block`` before ``allow``; rules of equal
length that fit a url go by the longer host, then by text; repeated rows give repeated
results; empty tables (of urls or rules) work; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Closes the host in a key; below every character of a host or a path.
END = "\u0000"
#: Rows of a url sample for the cuts, for each range.
SAMPLED = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rules_table(rules: DataFrame) -> DataFrame:
    """Rules (``rule``, ``verdict``) with host, path and key, each host and path once."""
    text = F.col("rule")
    host = F.translate(F.regexp_extract(text, r"(?s)\A([^/]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(text, r"(?s)\A[^/]*(.*)\z", 1)
    split = rules.filter("rule IS NOT NULL").select(host.alias("host"), path.alias("path"), "verdict")
    once = split.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' is after 'allow'
    return once.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"),
        F.concat(reversed_host(F.split("host", r"\.")), F.lit(END), "path").alias("key"),
    )


def _after(key: Column) -> Column:
    """Bytes above all keys that begin with ``key`` and below all others that are greater."""
    return F.concat(key.cast("binary"), F.unhex(F.lit("FF")))


def _events(rules: DataFrame) -> DataFrame:
    """(``key``, ``closes``, ``key_end``, ``top``): opening and closing events with the rule on top of the stack after each.

    A rule's parent is the longest other rule whose key is a prefix of its own; the prefixes
    of a key are as many as its characters, so rules meet their ancestors by equality.
    """
    own = F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")
    named = rules.select("key", own.alias("own"))
    prefixes = rules.select("key", F.explode(F.expr("transform(sequence(1, length(key)), i -> left(key, i))")).alias("prefix")).filter("prefix <> key")
    up = prefixes.join(named.select(F.col("key").alias("prefix"), F.col("own").alias("upper")), "prefix")
    parent = up.groupBy("key").agg(F.max_by("upper", F.length("prefix")).alias("parent"))
    both = named.join(parent, "key", "left")
    opened = both.select(F.col("key").cast("binary").alias("key"), F.lit(0).alias("closes"), F.col("own").alias("top"), F.col("key").alias("of"))
    closed = both.select(_after(F.col("key")).alias("key"), F.lit(1).alias("closes"), F.col("parent").alias("top"), F.col("key").alias("of"))
    return opened.union(closed)


def _range_of(key: Column, cuts: Sequence[str]) -> Column:
    """The number of ``cuts`` (in hexadecimal) at or below the binary ``key``, by halving."""
    if not cuts:
        return F.lit(0)
    line, own = F.split(F.lit(",".join(cuts)), ","), F.hex(key)  # one constant of the plan, not one for each cut
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda pos, step: F.when((pos + step <= len(cuts)) & (F.try_element_at(line, pos + step) <= own), pos + step).otherwise(pos))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """(``id_col``, ``host``, ``path``, ``rule``, ``verdict``) for each row of ``pages``."""
    spark = pages.sparkSession
    ranges = ranges or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    # Hashed ids after the path spread pages of one address over several ranges.
    tie = F.concat(F.lit(END), F.hex(F.xxhash64("id", "path")))
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(reversed_host(F.slice(labels, -n, n)), F.lit(END), F.col("path")))
    asked = urls.select("id", "host", "path", F.explode(keys).alias("key")).withColumn("key", F.concat("key", tie).cast("binary"))

    table = rules_table(rules)
    cuts = _cuts(pages, id_col, url_col, keys, tie, ranges)
    events = _events(table)
    # The state at the start of each range: every event is repeated in the ranges after it that its rule still covers.
    span = table.select(F.col("key").alias("of"), _range_of(F.col("key").cast("binary"), cuts).alias("lo"), _range_of(_after(F.col("key")), cuts).alias("hi"))
    opened = events.filter("closes = 0").join(span, "of").select(F.explode(F.sequence("lo", "hi")).alias("range"), "key", "closes", "top")
    closed = events.filter("closes = 1").withColumn("range", _range_of(F.col("key"), cuts)).select("range", "key", "closes", "top")
    changes = opened.union(closed).select("range", "key", F.lit(True).alias("event"), "top", *[F.lit(None).cast(t).alias(c) for c, t in _types(asked)])
    asks = asked.withColumn("range", _range_of(F.col("key"), cuts)).select("range", "key", F.lit(False).alias("event"), F.lit(None).cast(changes.schema["top"].dataType).alias("top"), *[c for c, _ in _types(asked)])
    line = Window.partitionBy("range").orderBy("key", F.desc("event"), F.length("top.rule")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.last(F.when(F.col("event"), F.struct(F.col("top").alias("top"))), ignorenulls=True).over(line)
    met = changes.unionByName(asks).withColumn("state", state["top"]).filter(~F.col("event"))
    won = met.groupBy("id", "host", "path").agg(F.max("state").alias("won"), F.count("*").alias("n"))
    # Every row came once for each label: what exceeds that are repeated rows.
    times = F.sequence(F.lit(1), (F.col("n") / F.size(labels)).cast("int"))
    answer = won.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"), F.explode(times).alias("__i"))
    return answer.drop("__i")


def _types(asked: DataFrame) -> list[tuple[str, object]]:
    return [(c, asked.schema[c].dataType) for c in ("id", "host", "path")]


def _cuts(pages: DataFrame, id_col: str, url_col: str, keys: Column, tie: Column, ranges: int) -> list[str]:
    """Keys, in hexadecimal, that cut the line into ranges of about equal numbers of url keys.

    They come from at most ``ranges * SAMPLED`` urls with the least hashes, as a range
    partitioner samples its bounds; they decide where rows are worked on, not what is found.
    """
    if ranges < 2:
        return []
    few = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).orderBy(F.xxhash64("id", "u")).limit(ranges * SAMPLED)
    few = few.select("id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    found = sorted(r[0] for r in few.select(F.explode(keys).alias("key"), tie.alias("tie")).select(F.hex(F.concat("key", "tie").cast("binary"))).collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []

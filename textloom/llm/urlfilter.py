"""URL filters by host-suffix and path-prefix expressions.

A rule is a host, a path and a verdict; it fits a url whose host is the rule's or below it and whose path starts with
the rule's. Each url is expanded into the expressions that some rule could equal: its last labels joined with the
start of its path. The shapes that occur among the rules (number of labels, of slashes, and of characters after the
last slash) tell which expressions those are, so a url of thousands of labels or slashes makes no more of them than
a short one, and no expression that could match is left out. Expressions meet rules by an equi-join on a short hash
prefix, the full digest confirms, and of the rules that fit the longest decides: host and path together, then the host;
where one host and path is both allowed and blocked, block decides. Urls that no rule fits get ``default``.

The urls are grouped once by their own columns before they are expanded, so one exchange of them is all there is where
the rules are small (they are counted; up to ``BROADCAST_RULES`` rules of at most ``LONGEST_RULE`` characters are broadcast, more are
joined by shuffle). A popular expression is no hot key then, and repeated rows of an input partition travel as one.

Defined results: a null url or one without ``://`` has an empty host and path, which only a rule with both empty fits.
Rows stand alone: repeated ones come out as often, each alike. Null hosts and paths of rules are empty, verdicts other
than ``allow`` and ``block`` raise, an empty table of rules leaves everything to ``default``, an empty table
of urls gives an empty result. The caller's columns stay, whatever their names; a result column replaces one of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import guarded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast, and the characters that a rule may have.
BROADCAST_RULES, LONGEST_RULE = 100_000, 8192
#: Hexadecimal digits of the hash prefix that expressions are joined on.
PREFIX = 8
#: Distinct shapes that rules may have; each makes one expression of every url that has one.
MOST_SHAPES = 4096


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with their key (``prefix``, ``digest``), shape and ``weight``, one row per host and path."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    named = rules.select(host.alias("host"), path.alias("path"), F.col("verdict").alias("verdict"))
    one = named.groupBy("host", "path").agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"), F.count(F.when(~F.col("verdict").isin("allow", "block") | F.col("verdict").isNull(), 1)).alias("odd"))
    text = F.concat("host", "path")
    return one.select(
        F.substring(_digest(text), 1, PREFIX).alias("prefix"), _digest(text).alias("digest"), text.alias("rule"),
        F.length(text).alias("weight"), F.length("host").alias("host_weight"), "block", "odd",
        _labels(F.col("host")).alias("labels"), _slashes(F.col("path")).alias("slashes"),
        F.length(F.substring_index("path", "/", -1)).alias("tail"),
    )


def expressions(host: Column, path: Column, shapes: list[tuple[int, int, int]]) -> Column:
    """The expressions of a url that a rule of one of the shapes could equal; null entries where it has none."""
    listed = F.array(*[F.struct(*[F.lit(n).alias(c) for n, c in zip(shape, ("labels", "slashes", "tail"), strict=True)]) for shape in sorted(shapes)])

    def made(shape: Column) -> Column:
        suffix = F.when(shape["labels"] > 0, F.call_function("substring_index", host, F.lit("."), -shape["labels"])).otherwise("")
        start = F.when(shape["slashes"] > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), shape["slashes"]), F.lit("/"))).otherwise("")
        size = F.length(start) + shape["tail"]
        fits = (_labels(host) >= shape["labels"]) & (_slashes(path) >= shape["slashes"]) & (F.length(path) >= size)
        return F.when(fits, F.concat(suffix, F.substring(path, F.lit(1), size)))

    return F.array_distinct(F.transform(listed, made))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``df`` with host, path, the deciding rule (null where none fits) and the verdict.

    All columns of ``df`` travel through the exchange: give the narrow ones.
    """
    listed = rule_table(rules)
    facts = listed.agg(F.count(F.lit(1)), F.max("weight"), F.sum("odd")).first()
    if facts[2]:
        raise ValueError("a rule's verdict is neither allow nor block")
    shapes = [tuple(r) for r in listed.select("labels", "slashes", "tail").distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"the rules have more than {MOST_SHAPES} shapes")
    table = listed.select("prefix", F.col("digest").alias("full"), "rule", "weight", "host_weight", "block")
    if facts[0] <= BROADCAST_RULES and (facts[1] or 0) <= LONGEST_RULE:
        table = F.broadcast(table)
    own, given = guarded(df)
    dealt = own.withColumn("part", F.spark_partition_id()).groupBy(*own.columns, "part").agg(F.count(F.lit(1)).alias("copies"))
    keys = [*own.columns, "part", "copies"]
    dealt = dealt.withColumn("h", host_of(F.col(given[url]))).withColumn("p", path_of(F.col(given[url])))
    if not shapes:
        judged = dealt.withColumn("top", F.lit(None).cast("struct<weight:int,host_weight:int,block:int,rule:string>"))
    else:
        wide = dealt.withColumn("expression", F.explode_outer(expressions(F.col("h"), F.col("p"), shapes))).withColumn("digest", _digest(F.col("expression")))
        wide = wide.withColumn("short", F.substring("digest", 1, PREFIX))
        met = wide.join(table, F.col("short") == F.col("prefix"), "left")
        top = F.when(F.col("digest") == F.col("full"), F.struct("weight", "host_weight", "block", "rule"))
        judged = met.groupBy(*keys, "h", "p").agg(F.max(top).alias("top"))
    verdict = F.when(F.col("top").isNull(), F.lit(default)).when(F.col("top.block") == 1, "block").otherwise("allow")
    made = dict(zip(names, [F.col("h"), F.col("p"), F.col("top.rule"), verdict], strict=True))
    kept = [F.col(new).alias(old) for old, new in given.items() if old not in made]
    out = judged.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select(*kept, *[c.alias(n) for n, c in made.items()])


def rules_frame(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A small table of rules from (host, path, verdict)."""
    return spark.createDataFrame(rows, "host string, path string, verdict string")


__all__ = ["expressions", "host_of", "judge_urls", "path_of", "rule_table", "rules_frame"]

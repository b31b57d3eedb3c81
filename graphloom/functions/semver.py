"""Version ranges of the npm kind: '^', '~', x-ranges, hyphen ranges, comparators and '||', as column expressions.

A version is a text that sorts as versions do (version_key); a range is an array of half-open intervals of such texts
(intervals), so that "satisfies" is containment and can be the condition of a join. Prereleases take part like any
version; an invalid version or range, or null, satisfies nothing.

A key is three numbers, each its digits behind their count, then the prerelease: '0' and a number or '1' and a word,
each closed by '!', or '2!' for a release. '!' sorts before and '~' after all that may follow it, so a number's
successors begin after '~' and nothing lies between a key and the key with END behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VERSION = r"^[v=\s]*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
_PARTIAL = r"^([<>]=?|=|\^|~>?)?\s*v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*])(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?)?$"
END = "\u0001"
_LAST = "~"


def _number(digits: Column) -> Column:
    plain = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def _prerelease(text: Column) -> Column:
    one = lambda x: F.concat(F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x)), F.lit("!"))
    return F.when(text == "", "2!").otherwise(F.array_join(F.transform(F.split(text, r"\.", -1), one), ""))


def version_key(version: str | Column) -> Column:
    """The version as a text in the order of versions; null if it is none."""
    text = F.col(version) if isinstance(version, str) else version
    part = lambda n: F.regexp_extract(text, _VERSION, n)
    return F.when(text.rlike(_VERSION), F.concat(*(_number(part(n)) for n in (1, 2, 3)), _prerelease(part(4))))


def _words(choice: Column) -> Column:
    hyphen = r"^(\S+)\s+-\s+(\S+)$"
    limits = F.array(F.concat(F.lit(">="), F.regexp_extract(choice, hyphen, 1)), F.concat(F.lit("<="), F.regexp_extract(choice, hyphen, 2)))
    joined = F.regexp_replace(choice, r"([<>]=?|=|\^|~>?)\s+", "$1")
    return F.when(choice.rlike(hyphen), limits).otherwise(F.filter(F.split(joined, r"\s+", -1), lambda w: w != ""))


def _parsed(word: Column) -> Column:
    """operator, whether each number is nonzero, how many are known, keys up to each of them, and the prerelease; null for no range word."""
    numbers = [F.regexp_extract(word, _PARTIAL, n) for n in (2, 3, 4)]
    digits = [n.rlike(r"^\d+$") for n in numbers]
    known = F.when(~digits[0], 0).when(~digits[1], 1).when(~digits[2], 2).otherwise(3)
    keys = [F.when(known > n, _number(numbers[n])).otherwise("0000") for n in range(3)]
    return F.when(
        word.rlike(_PARTIAL),
        F.struct(F.regexp_extract(word, _PARTIAL, 1).alias("sign"), known.alias("known"), keys[0].alias("one"), F.concat(*keys[:2]).alias("two"), F.concat(*keys).alias("three"), _prerelease(F.regexp_extract(word, _PARTIAL, 5)).alias("pre")),
    )


def _interval(word: Column) -> Column:
    """The low end, within, and the high end, beyond, of a parsed word."""
    sign, known, one, two, three = (word[c] for c in ("sign", "known", "one", "two", "three"))
    whole = known == 3
    start = F.when(whole, F.concat(three, word["pre"])).otherwise(three)  # of fewer numbers: before the first prerelease
    upper = lambda n: F.concat(F.when(n == 1, one).when(n == 2, two).otherwise(three), F.lit(_LAST))
    beyond = F.when(whole, F.concat(start, F.lit(END))).otherwise(upper(known))
    fixed = F.when((one != "0000") | (known == 1), 1).when((two != "00000000") & (two != F.concat(one, F.lit("0000"))) | (known == 2), 2).otherwise(3)
    least, most = F.lit(""), F.lit(_LAST)
    low = F.when(sign.isin("<", "<="), least).when(sign == ">", beyond).otherwise(start)
    high = F.when(sign.isin(">", ">="), most).when(sign == "<", start).when(sign == "^", upper(fixed)).when(sign.isin("~", "~>"), upper(F.least(known, F.lit(2)))).otherwise(beyond)
    none = sign.isin("<", ">")
    return F.struct(F.when(known == 0, least).otherwise(low).alias("low"), F.when(known == 0, F.when(none, least).otherwise(most)).otherwise(high).alias("high"))


def intervals(wanted: str | Column) -> Column:
    """array<struct<low, high>> of version keys, low within and high beyond, one for each choice of the range that is valid."""
    text = F.col(wanted) if isinstance(wanted, str) else wanted
    choices = F.transform(F.split(text, r"\|\|", -1), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    parsed = F.transform(choices, lambda c: F.transform(_words(c), _parsed))
    valid = F.filter(parsed, lambda words: ~F.exists(words, lambda w: w.isNull()))
    bounds = F.transform(valid, lambda words: F.transform(words, _interval))
    whole = F.struct(F.lit("").alias("low"), F.lit(_LAST).alias("high"))
    meet = lambda a, b: F.struct(F.greatest(a["low"], b["low"]).alias("low"), F.least(a["high"], b["high"]).alias("high"))
    return F.transform(bounds, lambda words: F.aggregate(words, whole, meet))


def within(key: Column, ranges: Column) -> Column:
    """Whether a version key lies in one of the intervals; false for null."""
    return F.coalesce(F.exists(ranges, lambda r: (r["low"] <= key) & (key < r["high"])), F.lit(False))


def with_satisfies(pairs: DataFrame, version: str, wanted: str, name: str = "satisfied") -> DataFrame:
    """pairs with a boolean: whether the version is within the range."""
    return pairs.withColumn(name, within(version_key(version), intervals(wanted)))


def newest_within(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """name, range, version: the newest version of versions(name, version) within each range of wanted(name, range); null where none is.

    An interval holds its newest version if the last key before its high end is not before its low end: keys and high
    ends are ordered together, so a range meets one version, not all of its name. Keys fall into ranges of one leading
    number first, whose last keys are carried on, so that a much-released name is many small orders. Of versions that
    are equal (they differ in build or spelling) the first by text counts.
    """
    asked = wanted.select("name", "range").distinct()
    keyed = versions.select("name", version_key("version").alias("at"), "version").where("at IS NOT NULL").groupBy("name", "at").agg(F.min("version").alias("version"))
    ends = asked.withColumn("i", F.explode(intervals("range"))).select("name", F.col("i.high").alias("at"), "range", F.col("i.low").alias("low"))
    rows = keyed.select("name", "at", F.struct("at", "version").alias("found"), F.lit(None).cast("string").alias("range"), F.lit(None).cast("string").alias("low"), F.lit(1).alias("kind")).unionByName(
        ends.select("name", "at", F.lit(None).cast("struct<at:string,version:string>").alias("found"), "range", "low", F.lit(0).alias("kind"))
    )
    from graphloom.operators.asof import last_before

    placed = last_before(rows.withColumn("block", F.substring("at", 1, 12)), ["name"], "block", ["at", "kind"], "found")
    newest = placed.where("kind = 0 AND last.at >= low").groupBy("name", "range").agg(F.max("last").alias("last"))
    return asked.join(newest, ["name", "range"], "left").select("name", "range", F.col("last.version").alias("version"))

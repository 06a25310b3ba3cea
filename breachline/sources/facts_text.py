"""The text form of facts and updates, parsed as DataFrame columns.

One fact a line: ``predicate(arg, ...).``; blank lines and lines that start with % or # say nothing.
In update files, ``remove(fact).`` takes a fact away. Files are all or nothing: the first bad line
is raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breachline.plans.facts import BASE, FIELD, PRIVILEGES, FactStore, fact_text

ARITY = {p: len(c) - (p == "firewallDeny") for p, c in BASE.items()}
#: Place (from 0) of the privilege among the arguments.
PRIVILEGE_AT = {"vulExists": 3, "localVulExists": 2, "attackerLocated": 2}


class ParseError(Exception):
    """A file that cannot be read or a line that is no fact."""


class LineError(ParseError):
    def __init__(self, line_number: int, reason: str):
        super().__init__(f"line {line_number}: {reason}")
        self.line_number, self.reason = line_number, reason


class ReadError(ParseError):
    def __init__(self, path: str, message: str):
        super().__init__(f"failed to read {path}: {message}")
        self.path, self.message = path, message


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def parsed(lines: DataFrame, updates: bool = False) -> DataFrame:
    """(line_number, line) to (line_number, op, predicate, args, error); lines without a fact drop out.

    Checks come in this order: period, parentheses, empty arguments, predicate, arity, privilege.
    """
    col = F.col
    df = lines.select("line_number", _strip(col("line")).alias("whole"))
    silent = lambda c: (c == "") | c.startswith("%") | c.startswith("#")
    df = df.filter(~silent(col("whole")))
    df = df.withColumn("period", col("whole").endswith("."))
    body = _strip(F.expr("left(whole, length(whole) - 1)"))
    df = df.withColumn("body", F.when(col("period"), body))
    removal = F.coalesce(col("body").startswith("remove(") & col("body").endswith(")"), F.lit(False)) if updates else F.lit(False)
    df = df.withColumn("op", F.when(removal, "remove").otherwise("insert"))
    inner = _strip(F.expr("substring(body, 8, length(body) - 8)"))
    df = df.withColumn("whole", F.when(removal, F.concat(inner, F.lit("."))).otherwise(col("whole")))
    df = df.withColumn("body", F.when(removal, inner).otherwise(col("body")))
    df = df.filter(~silent(col("whole")))
    df = df.withColumn("open", F.locate("(", col("body"))).withColumn("close", F.expr("length(body) - locate(')', reverse(body)) + 1"))
    closed = F.contains(col("body"), F.lit(")"))
    shaped = (col("open") > 0) & closed & (col("close") > col("open")) & (_strip(F.expr("substring(body, close + 1)")) == "")
    df = df.withColumn("shaped", F.coalesce(shaped, F.lit(False)))
    df = df.withColumn("inside", F.when(col("shaped"), F.expr("substring(body, open + 1, close - open - 1)"))).withColumn("predicate", F.when(col("shaped"), _strip(F.expr("left(body, open - 1)"))))
    df = df.withColumn("args", F.transform(F.split("inside", ","), _strip))
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    df = df.withColumn("arity", F.element_at(pairs(ARITY), col("predicate"))).withColumn("level", F.get("args", F.element_at(pairs(PRIVILEGE_AT), col("predicate"))))
    bad = (
        F.when(~col("period"), F.lit("fact must end with a period"))
        .when(~col("shaped"), F.concat(F.lit("malformed fact: "), col("whole")))
        .when(F.exists("args", lambda a: a == ""), F.concat(F.lit("malformed fact: "), col("inside")))
        .when(col("arity").isNull(), F.concat(F.lit("unknown predicate: "), col("predicate")))
        .when(F.size("args") != col("arity"), F.concat(F.lit("predicate "), col("predicate"), F.lit(" expects "), col("arity"), F.lit(" arguments, found "), F.size("args")))
        .when(~col("level").isin(*PRIVILEGES), F.concat(F.lit("invalid privilege value: "), col("level")))
    )
    good = bad.isNull()
    return df.select("line_number", F.when(good, col("op")).alias("op"), F.when(good, col("predicate")).alias("predicate"), F.when(good, col("args")).alias("args"), bad.alias("error"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, line) of a text file, numbered from 1."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"\n\z", "").alias("t"))
    return text.select(F.posexplode(F.split("t", "\n")).alias("n", "line")).select((F.col("n") + 1).cast("long").alias("line_number"), "line")


def _checked(spark: SparkSession, path: str, updates: bool) -> DataFrame:
    try:
        found = parsed(read_lines(spark, path), updates)
        first = found.filter("error IS NOT NULL").orderBy("line_number").select("line_number", "error").first()
    except ParseError:
        raise
    except Exception as why:
        raise ReadError(path, str(why).splitlines()[0]) from why
    if first:
        raise LineError(first.line_number, first.error)
    return found.drop("error")


def store_of(facts: DataFrame) -> FactStore:
    """The six relations of (predicate, args) rows, repeats kept."""

    def frame(predicate: str) -> DataFrame:
        own = facts.filter(F.col("predicate") == predicate)
        columns = [F.coalesce(F.get("args", F.lit(k)), F.lit("deny") if c == "rule_action" else F.lit("")).alias(c) for k, c in enumerate(BASE[predicate])]
        return own.select(*columns)

    return FactStore(**{f: frame(p) for p, f in FIELD.items()})


def read_facts(spark: SparkSession, path: str) -> FactStore:
    """The facts of a file."""
    return store_of(_checked(spark, path, updates=False))


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """The updates of a file as a change log (seq, op, predicate, args)."""
    return _checked(spark, path, updates=True).withColumnRenamed("line_number", "seq")


def write_facts(store: FactStore, path: str) -> None:
    """The deny rules and all other facts of a store, in text form."""
    rows = store.tagged().filter((F.col("predicate") != "firewallDeny") | (F.get("args", F.lit(3)) == "deny"))
    rows.select(F.concat(fact_text(F.col("predicate"), F.col("args")), F.lit("."))).write.mode("overwrite").text(path)

"""A policy's tables, and filters of events and attributes by joins with them.

The tables have a row for each allowed element or attribute: their size is the policy's, which has no more elements than HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgerow.kernel import css
from hedgerow.kernel import tables as T
from hedgerow.kernel.policy import Policy


def policy_elements(spark: SparkSession, policy: Policy) -> DataFrame:
    """(element, skip, holds_text)."""
    rows = [(e, r.skip, e in policy.text_containers) for e, r in policy.elements.items()]
    return spark.createDataFrame(rows, "element string, skip string, holds_text boolean")


def policy_attributes(spark: SparkSession, policy: Policy) -> DataFrame:
    """(element, attribute, n_policies)."""
    rows = [(e, a, len(p)) for e, r in policy.elements.items() for a, p in r.attributes.items()]
    return spark.createDataFrame(rows, "element string, attribute string, n_policies int")


def dim_element(spark: SparkSession) -> DataFrame:
    """(name, holds_text, resumed, void, mode) of all elements."""
    mode = lambda n: "PLAIN_TEXT" if n == "plaintext" else "CDATA" if n in T.CDATA else "RCDATA" if n in T.RCDATA else "VOID" if n in T.VOID else "PCDATA"
    return spark.createDataFrame([(n, n in T.HOLDS_TEXT, n in T.RESUMED, n in T.VOID, mode(n)) for n in T.ELEMENTS], "name string, holds_text boolean, resumed boolean, void boolean, mode string")


def dim_contains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c) for p in T.ELEMENTS for c in sorted(T.MAY_CONTAIN[p])], "parent string, child string")


def dim_css_property(spark: SparkSession) -> DataFrame:
    rows = [(n, r.bits, sorted(r.literals), dict(r.functions), n in css.DEFAULT_SCHEMA.rules) for n, r in css.DEFINITIONS.items()]
    return spark.createDataFrame(rows, "name string, bits int, literals array<string>, functions map<string,string>, is_default boolean")


def allowed(events: DataFrame, elements: DataFrame, name: str = "name") -> DataFrame:
    """Events whose element the policy has."""
    return events.join(F.broadcast(elements), events[name] == elements["element"], "left_semi")


def dropped(events: DataFrame, elements: DataFrame, name: str = "name") -> DataFrame:
    return events.join(F.broadcast(elements), events[name] == elements["element"], "left_anti")


def allowed_attributes(attributes: DataFrame, rules: DataFrame) -> DataFrame:
    """Attributes that the policy has for their element."""
    rule = rules.select(F.col("element"), F.col("attribute").alias("name"))
    return attributes.join(F.broadcast(rule), ["element", "name"], "left_semi")


def first_of_each(attributes: DataFrame, *tag: str) -> DataFrame:
    """Of a tag's attributes with the same name the first."""
    w = Window.partitionBy(*tag, "name").orderBy("pos")
    return attributes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def policy_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of two policies: where each is allowed."""
    left, right = a.select("element", F.lit(True).alias("in_left")), b.select("element", F.lit(True).alias("in_right"))
    return left.join(right, "element", "full_outer").select("element", F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def depths(events: DataFrame, *key: str) -> DataFrame:
    """``events`` with the depth after each, as a running sum."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    return events.withColumn("level", F.sum(step).over(Window.partitionBy(*key).orderBy("seq")))


def runs(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """(key, run, value, n) of adjacent rows, by ``seq``, with the same value: gaps and islands."""
    w = Window.partitionBy(*key).orderBy("seq")
    begins = rows.withColumn("begins", (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("long"))
    return begins.withColumn("run", F.sum("begins").over(w)).groupBy(*key, "run", value).agg(F.count("*").alias("n"))


def reassembled(pieces: DataFrame, key: str) -> DataFrame:
    """(key, html) from (key, seq, piece)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("html"))

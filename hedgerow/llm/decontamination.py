"""Benchmark decontamination by templates.

A text is canonicalised by a few expressions over the whole text: punctuation goes, and numbers, units after a number, and names (words in title case,
wherever they stand) become typed placeholders; their values are slots. Windows of WINDOW template tokens are hashed. An item is in a
text if an occurrence has at least ``share`` of the item's distinct windows and its slots are consistent: an item's
value always stands for the same value of the text. Occurrences are the hits of one alignment (place in the text less place in the item), those
within twice the item's length, which allows for insertions, and those of the whole text. So a question with other numbers or names is caught, and an
accidental mix of values isn't. Items with fewer than WINDOW tokens are one window of their own length; those with fewer than
MIN_TOKENS, and windows with more than MAX_SLOTS placeholders, are too unspecific as templates: they are hashed with their values, so that
verbatim copies are found.

1. Items that differ in nothing but their slots' values, and repeat them alike, are one class: they are in the same texts.
2. Candidates: a text with ``share`` of a class's windows has one of its rarest ``total - need + 1``, need being the least number of hits. Only those are joined
   with the hashed windows of all texts, so that a window that many items share makes no rows for each of them. They are
   broadcast up to MAX_BROADCAST of them, beyond that they are joined by a shuffle.
3. Texts that are candidates, told by a hash join, are canonicalised again with places and slots, and joined with all windows of their candidates.

Nulls: null texts are empty and in nothing; null items and ids are kept apart by their text. Rows with the same id and text share
their verdict; so do ties and repeated items. Empty tables give no contamination. Long texts are read as a whole. Extra columns are kept by ``remove``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import SPACE_CLASS, cut, let, text_or_empty, window_hash

WINDOW = 8
MIN_TOKENS = 5
MAX_SLOTS = 4
SHARE = 0.5
CONSISTENT = 0.8
MAX_BROADCAST = 500_000

#: The placeholders; punctuation is gone when they come.
NUMBER, UNIT, NAME = "#", "%", "@"

#: Units of measure and money: fixed values.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "g", "kg", "mg", "gram", "grams", "kilogram", "kilograms",
    "lb", "lbs", "pound", "pounds", "ounce", "ounces", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds",
    "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "percent", "degree", "degrees", "c", "f", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "kmh", "mph",
]


_WORD = r"[\p{L}\p{N}]"
_PATTERNS = {
    "apart": r"(?<=[0-9])(?=[A-Za-z%°])",
    "punctuation": r"[^\p{L}\p{N}\x20\x09-\x0D]+",
    "number": rf"[0-9](?<!{_WORD}[0-9])[0-9]*+(?!{_WORD})",
    "unit": rf"({NUMBER}{SPACE_CLASS}+)(?i:{'|'.join(UNITS)})(?!{_WORD})",
    "name": rf"\p{{Lu}}(?<!{_WORD}\p{{Lu}})\p{{Ll}}++(?!{_WORD})",
}


def plain_of(text: Column) -> Column:
    """The text without punctuation, with numbers apart from letters."""
    apart = F.when(text.rlike(r"[0-9][A-Za-z%°]"), F.regexp_replace(text, _PATTERNS["apart"], " ")).otherwise(text)
    return F.regexp_replace(apart, _PATTERNS["punctuation"], "")


def template_of(plain: Column) -> Column:
    """``plain_of`` a text with placeholders for what is typed, in lower case, word by word."""
    numbers = F.regexp_replace(plain, _PATTERNS["number"], NUMBER)
    units = let(numbers, lambda t: F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, _PATTERNS["unit"], rf"$1{UNIT}")).otherwise(t))
    return F.lower(F.regexp_replace(units, _PATTERNS["name"], NAME))


def _words(t: Column) -> Column:
    return F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != "")


def _typed(t: Column) -> Column:
    return t.isin(NUMBER, UNIT, NAME)


def _starts(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))


def _dense(template: Column, size: int) -> Column:
    """The starts of windows with more than MAX_SLOTS placeholders."""
    places = F.filter(F.transform(template, lambda t, i: F.when(_typed(t), i + 1)), lambda i: i.isNotNull())

    def around(p: Column) -> Column:
        """Windows that hold the placeholder at each place and the MAX_SLOTS next ones."""
        return F.flatten(F.transform(p, lambda x, k: F.coalesce(F.when(F.get(p, k + MAX_SLOTS) - x < size, F.sequence(F.get(p, k + MAX_SLOTS) - size + 1, x)), F.array().cast("array<int>"))))

    return let(places, around)


def hashes_of(plain: Column, size: int, placed: bool = False) -> Column:
    """array<bigint>: the hash of every window of the text that ``plain_of`` gives, in their order if ``placed``.

    Windows with more than MAX_SLOTS placeholders, or all under MIN_TOKENS tokens, are hashed with their values.
    """
    words = _words(F.lower(plain))

    def values(v: Column, i: Column) -> Column:
        return F.xxhash64(F.lit("literally"), F.slice(v, i, size))

    if size < MIN_TOKENS:
        return let(words, lambda v: F.transform(_starts(F.size(v), size), lambda i: values(v, i)))

    def of(x: Column) -> Column:
        starts = _starts(F.size(x["h"]), size)
        plainly = F.transform(starts, lambda i: window_hash(x["h"], i, size))
        if size <= MAX_SLOTS:
            return plainly
        if placed:
            both = let(words, lambda v: F.transform(starts, lambda i: F.when(F.array_contains(x["dense"], i), values(v, i)).otherwise(window_hash(x["h"], i, size))))
        else:
            sparse = F.transform(F.array_except(starts, x["dense"]), lambda i: window_hash(x["h"], i, size))
            both = F.concat(sparse, let(words, lambda v: F.transform(F.array_distinct(x["dense"]), lambda i: values(v, i))))
        return F.when(F.size(x["dense"]) > 0, both).otherwise(plainly)

    def hashed(t: Column) -> Column:
        dense = F.filter(_dense(t, size), lambda i: (i >= 1) & (i <= F.size(t) - size + 1)) if size > MAX_SLOTS else F.array().cast("array<int>")
        return F.struct(F.transform(t, lambda w: F.xxhash64(w)).alias("h"), dense.alias("dense"))

    return let(let(_words(template_of(plain)), hashed), of)


def windows_of(plain: Column, size: int) -> Column:
    """array<struct<at, h, slots>>: each window's place and hash, and its slots' values between U+0001 ('' if it has none or is hashed with them)."""
    parts = F.struct(_words(template_of(plain)).alias("t"), _words(F.lower(plain)).alias("v"), hashes_of(plain, size, placed=True).alias("h"))

    def of(x: Column) -> Column:
        slots = F.transform(x["t"], lambda t, i: F.when(_typed(t), F.get(x["v"], i)).otherwise(""))

        def one(s: Column, h: Column, k: Column) -> Column:
            own = F.slice(s, k + 1, size)
            n = F.size(F.filter(own, lambda v: v != ""))
            told = (n > 0) & (n <= MAX_SLOTS) if size >= MIN_TOKENS else F.lit(False)
            return F.struct((k + 1).alias("at"), h.alias("h"), F.when(told, F.array_join(own, "\x01")).otherwise("").alias("slots"))

        return let(slots, lambda s: F.transform(x["h"], lambda h, k: one(s, h, k)))

    return let(parts, of)


def _key(id_col: str, text: Column) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), text)


def _classes(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id) of every item, item being its class; and (item, n, size, at, h, slots) of the windows of every class."""
    items = benchmark.select("item_id", plain_of(text_or_empty()).alias("plain")).withColumn("t", _words(template_of(F.col("plain")))).withColumn("n", F.size("t")).where(F.col("n") > 0)
    sized = items.withColumn("size", F.least("n", F.lit(WINDOW)))
    windows = F.coalesce(*[F.when(F.col("size") == k, windows_of(F.col("plain"), k)) for k in range(1, WINDOW + 1)])
    values = let(_words(F.lower(F.col("plain"))), lambda v: F.transform("t", lambda t, i: F.when(_typed(t), F.array_position(v, F.get(v, i)))))
    found = sized.select("item_id", "n", "size", windows.alias("windows"), values.alias("alike"))
    found = cut(found.withColumn("item", F.xxhash64(F.transform("windows", lambda w: w["h"]), "alike")), "benchmark-items")
    one = found.groupBy("item").agg(F.min(F.struct("n", "size", "windows")).alias("x")).select("item", "x.n", "x.size", F.explode("x.windows").alias("w"))
    return found.select("item", "item_id").distinct(), cut(one.select("item", "n", "size", "w.at", "w.h", "w.slots"), "benchmark-windows")


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(key, items, share): the rows of ``docs`` that have an item, told by the hash of their id and text; one row for each key."""
    ids, every = _classes(benchmark)
    sizes = sorted(r["size"] for r in every.select("size").distinct().collect())  # at most WINDOW values
    distinct = every.select("item", "size", "h").distinct()
    totals = distinct.groupBy("item").agg(F.count("*").alias("total"))
    rarity = distinct.groupBy("size", "h").agg(F.count("*").alias("shared"))
    ordered = distinct.join(rarity, ["size", "h"]).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("shared", "h", "size"))).alias("all"))
    rarest = F.slice("all", 1, (F.size("all") - F.greatest(F.ceil(F.size("all") * share), F.lit(1)) + 1).cast("int"))
    aims = ordered.select("item", F.explode(rarest).alias("w")).select("item", "w.size", "w.h")
    text = text_or_empty(text_col)
    rows = docs.select(_key(id_col, text).alias("key"), text.alias("text"))

    def flat(of, own: DataFrame) -> DataFrame:
        def sized(size: int) -> Column:
            return F.transform(of(F.col("plain"), size), lambda w: F.struct(F.lit(size).alias("size"), w.alias("w")))

        parts = map(sized, sizes or [WINDOW])
        return own.select("key", plain_of(F.col("text")).alias("plain")).select("key", F.explode(F.concat(*parts)).alias("x")).select("key", "x.size", "x.w")

    candidates = cut(flat(hashes_of, rows).withColumnRenamed("w", "h").join(_bounded(cut(aims, "benchmark-aims")), ["size", "h"]).select("key", "item").distinct(), "contamination-candidates")
    chosen = rows.join(_bounded(candidates.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
    windows = flat(windows_of, chosen).select("key", "size", "w.at", "w.h", "w.slots")
    # the one variant of a window's slots that counts where hits are not aligned
    plain = every.groupBy("item", "h").agg(F.min(F.struct("slots", "at")).alias("plain"))
    own = every.join(plain, ["item", "h"]).join(totals, "item").select("item", "n", "size", "total", "h", F.col("at").alias("own_at"), F.col("slots").alias("own_slots"), (F.struct("slots", "at") == F.col("plain")).alias("plain"))
    hits = windows.join(candidates.join(own, "item"), ["key", "size", "h"])
    bucket = F.floor(F.col("at") / F.col("n"))
    unaligned = F.array(F.struct(F.lit("text").alias("by"), F.lit(0).cast("long").alias("k")), F.struct(F.lit("near").alias("by"), bucket.alias("k")), F.struct(F.lit("near").alias("by"), (bucket - 1).alias("k")))
    aligned = F.array(F.struct(F.lit("aligned").alias("by"), (F.col("at") - F.col("own_at")).cast("long").alias("k")))
    hits = hits.withColumn("occurrence", F.explode(F.when(F.col("plain"), F.concat(aligned, unaligned)).otherwise(aligned)))
    hits = cut(hits.select("key", "item", "occurrence", "h", "total", "slots", "own_slots").distinct(), "contaminated-windows")
    counted = hits.groupBy("key", "item", "occurrence", "total").agg(F.countDistinct("h").alias("n"))
    # each distinct pair of an item's value and a text's value, for the hits with slots
    pairs = hits.where(F.col("own_slots") != "").select("key", "item", "occurrence", F.explode(F.arrays_zip(F.split("own_slots", "\x01").alias("a"), F.split("slots", "\x01").alias("b"))).alias("p"))
    pairs = pairs.where(F.col("p.a") != "").groupBy("key", "item", "occurrence", F.col("p.a").alias("a")).agg(F.countDistinct("p.b").alias("ways"))
    slots = pairs.groupBy("key", "item", "occurrence").agg(F.avg((F.col("ways") == 1).cast("double")).alias("consistent"))
    judged = counted.join(slots, ["key", "item", "occurrence"], "left").where((F.col("n") >= share * F.col("total")) & (F.coalesce("consistent", F.lit(1.0)) >= CONSISTENT))
    found = judged.groupBy("key", "item").agg(F.max(F.col("n") / F.col("total")).alias("share")).join(ids, "item")
    return found.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("share"))


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, items and the largest share, for every row of ``docs``."""
    found = contaminated(docs, benchmark, id_col, text_col, share)
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_or_empty(text_col)).alias("key")).join(found, "key", "left")
    empty = F.array().cast(found.schema["items"].dataType)
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", empty).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without an item, as they are."""
    found = contaminated(docs, benchmark, id_col, text_col, share).select("key")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key(id_col, text_or_empty(text_col)).alias("key"))
    return packed.join(found, "key", "left_anti").select("doc.*")

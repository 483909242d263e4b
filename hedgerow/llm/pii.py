"""Information-theoretic sanitisation of personal data.

1. Protected entities are found by patterns: e-mail and IP addresses, payment cards (Luhn) and telephone numbers. The patterns
   are possessive and begin only where a run begins or the match before ended, so that they are linear in the text; the
   matches are those of the plain leftmost patterns. Spans come from the lengths of what stands between matches.
2. The words of a text with an entity are its terms. What is protected is an entity's value and its kind. Over the corpus, a term's pointwise mutual
   information with a protected e is ``log2(p(e | t) * N / n(e))``, N being all texts, n(e) those with e, n(t) those with the term, n(t, e) those with both, and
   ``p(e | t) = (n(t, e) + SMOOTHING * n(e) / N) / (n(t) + SMOOTHING)``, so that few texts move it less far from what chance gives. All are counts of
   distinct texts: copies count once. A term discloses e if that reaches e's information content ``log2(N / n(e))`` divided by ALPHA.
3. Every occurrence of such a term, in all texts, is a span too, of kind ``term``, unless an entity overlaps it. ``sanitised`` generalises entities to their kind and removes terms to a mark.

Everything is DataFrame expressions. Word counts are shuffled by hash with partial sums. A term in too many texts to
disclose an entity even if all of the entity's texts have it is left out before the two are paired. Up to MAX_BROADCAST disclosing terms are broadcast to the distinct words
of all texts; more are joined by a shuffle. A text then gets its own disclosing words, by the hash of the text, and is searched for those.

Nulls: a null text is empty; a null id is kept. Rows with the same text share their spans, so do repeated rows. Ties: spans are ordered by kind and start. An empty table
gives an empty result. Long texts are read as a whole. Extra columns are ignored by ``detect`` and kept by ``sanitised``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import ascii_lower, cut, let, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ALPHA = 1.25
SMOOTHING = 1.0
MAX_BROADCAST = 1_000_000
BLOCK = 64

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"\p{L}++"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(d: Column, i: Column) -> Column:
        x = d.cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.when((n - i) % 2 == 0, twice).otherwise(x)

    total = F.aggregate(F.transform(F.split(digits, ""), lambda d, i: F.when(d != "", value(d, i)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _card(m: Column) -> Column:
    return let(F.translate(m, " -", ""), lambda d: F.length(d).between(16, 19) & _luhn(d))


ACCEPTED: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _card,
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15),
}
_MAY_HAVE = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][ -]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}


def sums_before(lengths: Column) -> Column:
    """The sum of the elements before each; in blocks, so that long arrays are not copied once for each element."""

    def running(x: Column, start: Column) -> Column:
        """array of the sums before each element of x, and the total in the end."""
        first = F.struct(start.cast("long").alias("n"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(x, first, lambda a, v: F.struct((a["n"] + v).alias("n"), F.concat(a["all"], F.array(a["n"])).alias("all")), lambda a: a["all"])

    def of(own: Column) -> Column:
        blocks = F.when(F.size(own) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, BLOCK)))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v))
        return let(running(totals, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b, k: running(b, F.get(starts, k)))))

    return F.coalesce(let(lengths, of), F.array().cast("array<bigint>"))


def matches_of(text: Column, pattern: Column | str, accepted: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's matches that are accepted; code points, end exclusive."""
    own = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.split(text, own, -1).alias("between"), F.regexp_extract_all(text, own, 0).alias("found"))

    def of(x: Column) -> Column:
        steps = F.transform(x["found"], lambda m, k: (F.length(m) + F.length(F.get(x["between"], k))).cast("long"))

        def placed(before: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                start = F.get(before, k) + F.length(F.get(x["between"], k))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

            return F.transform(x["found"], one)

        return let(sums_before(steps), placed)

    every = let(both, of)
    return F.filter(every, lambda s: accepted(s["value"])) if accepted else every


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def entities_of(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind as in KINDS, then by start."""
    def of(kind: str) -> Column:
        own = F.transform(matches_of(text, PATTERNS[kind], ACCEPTED[kind]), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(_MAY_HAVE[kind](text), own).otherwise(F.array().cast(_SPAN))

    return F.concat(*map(of, KINDS))


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _term_hash(w: Column) -> Column:
    return F.xxhash64(F.lower(w))


def _terms(rows: DataFrame) -> DataFrame:
    """(key, terms): the distinct terms of each row."""
    return rows.select("key", F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), 0), _term_hash)).alias("terms"))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table


def counted_terms(own: DataFrame, rows: DataFrame) -> DataFrame:
    """(term, n_term): the distinct texts with each term. All rows are counted, and then the copies taken off, so that no text is shuffled."""
    copied = cut(own.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "pii-copied")
    every = _terms(rows).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    again = _terms(rows.join(_bounded(copied), "key")).join(copied, "key").groupBy("key").agg(F.first("terms").alias("terms"), F.first("copies").alias("copies"))
    more = again.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum(F.col("copies") - 1).alias("more"))
    return every.join(more, "term", "left").select("term", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n_term"))


def disclosing(own: DataFrame, rows: DataFrame) -> DataFrame:
    """(term) of every disclosing term; ``own`` has the key and entities of all rows, ``rows`` their key and text."""
    n = float(max(own.select("key").distinct().count(), 1))
    found = own.where(F.size("entities") > 0).dropDuplicates(["key"])
    values = F.array_distinct(F.transform("entities", lambda e: F.xxhash64(e["kind"], ascii_lower(e["value"]))))
    kinds = F.array_distinct(F.transform("entities", lambda e: F.xxhash64(e["kind"])))
    both = F.array(F.struct(F.lit(False).alias("kind"), values.alias("all")), F.struct(F.lit(True).alias("kind"), kinds.alias("all")))
    protected = found.select("key", F.explode(both).alias("x")).select("key", "x.kind", F.explode("x.all").alias("entity"))
    per_entity = protected.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # p(e | t) has to reach (n(e) / N) ** (1 - 1 / ALPHA), and n(t, e) is at most n(e)
    least = F.pow(F.col("n_entity") / n, F.lit(1 - 1 / ALPHA))
    limit = F.col("n_entity") * (1 + SMOOTHING / n) / least - SMOOTHING
    per_entity = cut(per_entity.where(F.col("n_entity") < n).withColumn("limit", limit * (1 + 1e-9)), "pii-protected")
    aims = cut(protected.join(per_entity, "entity").groupBy("key", "kind").agg(F.max("limit").alias("most"), F.collect_list(F.struct("entity", "limit")).alias("aims")), "pii-aims")
    most = aims.agg(F.max("most")).first()[0]
    if most is None:
        return own.select(F.col("key").alias("term")).where(F.lit(False))
    candidates = counted_terms(own, rows).where(F.col("n_term") <= F.lit(most))
    of_texts = _terms(rows.join(_bounded(aims.select("key").distinct()), "key", "left_semi")).groupBy("key").agg(F.first("terms").alias("terms"))
    terms = of_texts.select("key", F.explode("terms").alias("term")).join(candidates, "term")
    aimed = terms.join(aims, "key").where(F.col("n_term") <= F.col("most"))
    aimed = aimed.select("term", "n_term", F.explode(F.filter("aims", lambda e: F.col("n_term") <= e["limit"])).alias("e"))
    shared = aimed.groupBy(F.col("e.entity").alias("entity"), "term", "n_term").agg(F.count("*").alias("n_both")).join(per_entity, "entity")
    information = F.log2(n / F.col("n_entity"))
    given = (F.col("n_both") + SMOOTHING * F.col("n_entity") / n) / (F.col("n_term") + SMOOTHING)
    return shared.where(F.log2(given * n / F.col("n_entity")) >= information / ALPHA).select("term").distinct()


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, key, entities), and (key, terms): the disclosing terms' spans of the texts that have some."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", _key(F.col("text")))
    own = cut(rows.select("doc_id", "key", entities_of(F.col("text")).alias("entities")), "pii-entities")
    told = cut(disclosing(own, rows), "pii-disclosing")
    if told.isEmpty():
        return own, own.select("key", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("terms")).where(F.lit(False))
    words = rows.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), 0))).alias("word")).withColumn("term", _term_hash(F.col("word")))
    marked = cut(words.join(_bounded(told), "term", "left_semi").groupBy("key").agg(F.collect_set("word").alias("words")), "pii-marked")
    # the words are letters only, so nothing in the pattern has to be quoted
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    placed = F.transform(matches_of(F.col("text"), pattern), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end")))
    return own, cut(rows.join(marked, "key").select("key", placed.alias("terms")).groupBy("key").agg(F.first("terms").alias("terms")), "pii-places")


def _spans(own: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, key, entities and terms: spans that no entity overlaps, by start."""
    joined = own.join(terms, "key", "left")
    free = F.filter("terms", lambda t: ~F.exists("entities", lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"])))
    return joined.withColumn("terms", F.sort_array(F.coalesce(free, F.array().cast("array<struct<start:bigint,end:bigint>>"))))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of entities of each kind, base_sha256 and spans, for every row of ``docs``."""
    rows = _spans(*found_in(docs.select(id_col, text_col), id_col, text_col))
    base = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string")))
    more = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))

    def count(kind: str) -> Column:
        return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each entity generalised to its kind in brackets, and each disclosing term removed to ``[...]``."""
    found = _spans(*found_in(docs.select(id_col, text_col), id_col, text_col)).dropDuplicates(["key"])
    entity = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.concat(F.lit("["), F.upper(e["kind"]), F.lit("]")).alias("mark")))
    term = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("[...]").alias("mark")))
    found = found.select("key", F.sort_array(F.concat(entity, term)).alias("marks")).where(F.size("marks") > 0)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"), _key(text_or_empty(text_col)).alias("key"))
    text = F.col("text")

    def rewritten(marks: Column) -> Column:
        """Overlapping entities: the one that begins first stands, and the others are part of it."""
        first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(a: Column, m: Column) -> Column:
            kept = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int")), m["mark"])
            return F.struct(F.greatest(a["at"], m["end"]).alias("at"), F.when(m["start"] >= a["at"], kept).otherwise(a["out"]).alias("out"))

        return F.aggregate(marks, first, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))

    new = F.when(F.col("marks").isNull(), text).otherwise(rewritten(F.col("marks")))
    joined = packed.join(found, "key", "left").withColumn("new", new)
    return joined.select(*[F.col("new").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])

"""Quality rules as weak supervision: they vote or abstain, EM estimates how accurate each is, and the posterior decides.

Everything is DataFrame expressions. A text is reduced to counts in one pass over its own arrays; a rule turns them into a vote,
1 (good), -1 (bad) or 0 (abstains). The votes of a corpus are at most ``3 ** len(RULES)`` patterns, whatever its size, so that
EM runs on the counted patterns: each round is one aggregation, of which one row of sums comes back. The model is the
conditionally independent one: a rule has a probability of each vote given a good and given a bad text. EM starts from
rules that are right more often than not, which tells good from bad. Most rules know one defect and abstain without it.

n_repeat_words is exact: windows of eight words are hashed (64 bits each); texts without two equal windows, nearly all, are
told by the number of distinct hashes; in the others, the starts of repeated windows are sorted and the union of
their words is measured.

Nulls: a null text has no words. Repeated rows are counted and returned each; a null id is kept. An empty table gives an empty
result. Without words a text fails the base. Long texts are measured as a whole; ties in the votes are broken by the posterior of 0.5, which keeps. Extra
columns are ignored by ``judge`` and kept by ``keep``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import cut, let, text_or_empty, window_hash, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
ROUNDS = 12
PRIOR_GOOD = 0.8
#: The first guess of each rule's probabilities of the votes -1, 0 and 1; as so many pseudo-counts it keeps them off 0 and 1.
BAD_FIRST, GOOD_FIRST = (0.4, 0.5, 0.1), (0.02, 0.5, 0.48)
SMOOTH = 4.0

#: Words that most running prose has, by language: fixed values.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "a", "de", "la", "le", "les", "el", "que", "y", "en", "der", "die", "und", "das", "den", "et", "un", "des"]


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad``, else good where ``good``, else no vote; SQL over the counts of ``measured``."""

    name: str
    bad: str
    good: str


NEVER = "false"
RULES = (
    Rule("symbols", "n_symbols > 0.10 * n_words", NEVER),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words", NEVER),
    Rule("repeated_lines", "n_dup_lines > 0.30 * n_lines", NEVER),
    Rule("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    Rule("capitals", "n_upper > 0.4 * n_letters", NEVER),
    Rule("stop_words", "n_stop < 0.01 * n_words", "n_stop >= 0.08 * n_words"),
    Rule("letters", "n_letters < 0.7 * word_chars", "n_letters >= 0.85 * word_chars"),
    Rule("exclamations", "n_exclaim > 0.1 * n_words", NEVER),
    Rule("length", "n_words < 20", NEVER),
)


def _removed(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``hashes`` has a window's hash at each start."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(x: Column, k: Column, every: Column) -> Column:
        before = F.when(k > 0, F.get(every, k - 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(every, k + 1)["h"] == x["h"], F.lit(False))

    def starts(every: Column) -> Column:
        marked = F.transform(every, lambda x, k: F.when(repeated(x, k, every), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def union(at: Column) -> Column:
        own = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(placed, starts), union)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (text without nulls, and others) with the counts that the rules use, all of them long, in columns that begin with ``q_``."""
    rows = docs.withColumn("q_text", F.col("text")).withColumn("q_words", words_of(F.col("q_text")))
    hashed = F.transform(F.col("q_words"), lambda w: F.xxhash64(w))

    def windows(own: Column) -> Column:
        starts = F.when(F.size(own) >= WINDOW, F.sequence(F.lit(1), F.size(own) - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: window_hash(own, i, WINDOW))

    rows = rows.withColumn("q_windows", let(hashed, windows))
    lines = F.filter(F.split(F.col("q_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("q_lines", lines)
    words = F.array_join("q_words", "")
    rows = rows.withColumn("q_joined", words)
    letters = F.length(F.regexp_replace("q_joined", r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace("q_joined", r"[^\p{Lu}]+", ""))
    stop = F.size(F.filter("q_words", lambda w: F.lower(w).isin(STOP_WORDS)))
    counts = {
        "n_words": F.size("q_words"), "word_chars": F.length("q_joined"), "n_symbols": _removed(F.col("q_text"), SYMBOLS),
        "n_dup_lines": F.size("q_lines") - F.size(F.array_distinct("q_lines")), "n_lines": F.size("q_lines"),
        "n_repeat_words": F.when(F.size(F.array_distinct("q_windows")) == F.size("q_windows"), F.lit(0)).otherwise(_repeat_words(F.col("q_windows"))),
        "n_letters": letters, "n_upper": upper, "n_stop": stop, "n_exclaim": _removed(F.col("q_text"), "!"),
    }
    return rows.withColumns({f"q_{k}": v.cast("long") for k, v in counts.items()}).drop("q_text", "q_words", "q_windows", "q_lines", "q_joined")


def _on_counts(condition: str) -> Column:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letters", "n_upper", "n_stop", "n_exclaim")
    out = " ".join(f"q_{t}" if t in names else t for t in condition.replace("(", " ( ").replace(")", " ) ").split())
    return F.expr(out)


def vote(rule: Rule) -> Column:
    cast = F.when(_on_counts(rule.bad), F.lit(-1)).when(_on_counts(rule.good), F.lit(1)).otherwise(F.lit(0))
    return F.when(F.col("q_n_words") > 0, cast).otherwise(F.lit(0)).cast("int")


def base_failed() -> Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))


@dataclass
class Estimate:
    """Share of good texts, and for each rule the probability of the votes -1, 0, 1 given a bad and given a good text."""

    good: float
    given: list[tuple[tuple[float, float, float], tuple[float, float, float]]]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a text with these votes is good."""
        weights = [math.log(self.good / (1 - self.good))]
        for bad, good in self.given:
            weights += [math.log(g / b) for b, g in zip(bad, good, strict=True)]
        # one literal array: the generated code is the same in all rounds
        table = F.array(*map(F.lit, weights))
        odds = F.get(table, F.lit(0))
        for j, v in enumerate(votes):
            odds = odds + F.get(table, v + (3 * j + 2))
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Estimate:
    """EM over ``patterns`` (v_<rule> for each rule, and n)."""
    votes = [F.col(f"v_{r.name}") for r in rules]
    now = Estimate(PRIOR_GOOD, [(BAD_FIRST, GOOD_FIRST)] * len(rules))
    p = F.col("p")
    sums = [F.sum(p * F.col("n")).alias("good"), F.sum("n").alias("n")]
    for r, v in zip(rules, votes, strict=True):
        for k in (-1, 0, 1):
            sums += [F.sum(F.when(v == k, p * F.col("n")).otherwise(0.0)).alias(f"g_{r.name}_{k}"), F.sum(F.when(v == k, F.col("n")).otherwise(0)).alias(f"n_{r.name}_{k}")]
    for _ in range(rounds):
        s = patterns.withColumn("p", now.posterior(votes)).agg(*sums).first()
        if not s["n"]:
            return now
        given = []
        for r in rules:
            good = [s[f"g_{r.name}_{k}"] for k in (-1, 0, 1)]
            bad = [s[f"n_{r.name}_{k}"] - g for k, g in zip((-1, 0, 1), good, strict=True)]
            smoothed = []
            for own, prior in ((bad, BAD_FIRST), (good, GOOD_FIRST)):
                total = sum(own) + SMOOTH
                smoothed.append(tuple((max(x, 0.0) + SMOOTH * q) / total for x, q in zip(own, prior, strict=True)))
            given.append((smoothed[0], smoothed[1]))
        now = Estimate((s["good"] + SMOOTH * PRIOR_GOOD) / (s["n"] + SMOOTH), given)
    return now


def _judged(rows: DataFrame, keep: str) -> DataFrame:
    """``keep``, the counts, base_failed, posterior and kept, of ``rows`` (text without nulls, ``keep``)."""
    found = measured(rows).select(keep, *[f"q_{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed().alias("q_base_failed"), *[vote(r).alias(f"v_{r.name}") for r in RULES])
    found = cut(found, "quality-votes")
    names = [f"v_{r.name}" for r in RULES]
    patterns = cut(found.groupBy(*names).agg(F.count("*").alias("n")), "quality-patterns").coalesce(1)
    posterior = estimate(patterns).posterior([F.col(n) for n in names])
    return found.withColumn("q_posterior", posterior).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_posterior") >= 0.5))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, the posterior quality and kept for every row of ``docs``."""
    rows = _judged(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "doc_id")
    counts = [F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_posterior").alias("posterior"))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, as they are. They are packed meanwhile, so no name clashes."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty(text_col).alias("text"))
    return _judged(packed, "doc").where("q_kept").select("doc.*")

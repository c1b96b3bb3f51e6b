"""Operator 7: quality rules, a threshold table compiled into one projection without user functions."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard.llm.text import let, text_or_empty, window_hashes, words

#: Frequent function words of the four languages.
STOP_WORDS = ("the of and to in is that for with was are this "
              "le la les de des et en du un une que est "
              "der die das und ist von den mit ein eine zu im "
              "el los las del se por para con una su al").split()

#: Fixed value: characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= numerator / denominator <= high; an open bound is None."""
    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


#: Measures are those of `measures`; `one` is 1, for rules on a count.
RULES = (
    Rule("words", "n_words", "one", 20, None),
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 0.9),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 0.3),
)


def repeated_words(w: Column, width: int = 8) -> Column:
    """Words covered by a window of the width that occurs twice or more in w, the first occurrence included.

    Windows are compared by a 64-bit hash of their words. Sorting the (hash, place) pairs brings equal windows together.
    """
    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(pairs, lambda s: F.aggregate(
            F.sort_array(F.transform(
                F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                         | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["at"])),
            F.struct(F.lit(0).alias("total"), F.lit(-width).alias("last")),
            lambda a, at: F.struct((a["total"] + F.least(F.lit(width), at - a["last"])).alias("total"), at.alias("last")),
            lambda a: a["total"]))

    return let(window_hashes(w, width), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))).cast("long")


def measures(text: Column) -> Column:
    """All counts the rules use, as one struct of longs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    stops = [f"{v}{end}" for x in STOP_WORDS for v in (x, x.capitalize()) for end in ("", ".", ",", ";", ":")]

    def of(w, ls):
        n_stop = F.size(F.filter(w, lambda x: x.isin(stops)))
        fields = {"n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")),
                  "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)), "n_lines": F.size(ls),
                  "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)), "n_repeat_words": repeated_words(w),
                  "n_stop_words": n_stop, "one": F.lit(1)}
        return F.struct(*[c.cast("long").alias(n) for n, c in fields.items()])

    return let(words(text), lambda w: let(lines, lambda ls: of(w, ls)))


def passes(rules: tuple[Rule, ...], measured) -> Column:
    """One boolean expression over the whole table of rules; measured(name) is a count. Ratios are compared as
    numerator against bound * denominator, so an empty text needs no division."""
    verdict = F.lit(True)
    for r in rules:
        top, bottom = measured(r.numerator), measured(r.denominator)
        if r.low is not None:
            verdict = verdict & (top >= F.lit(float(r.low)) * bottom)
        if r.high is not None:
            verdict = verdict & (top <= F.lit(float(r.high)) * bottom)
    return verdict


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of docs (doc_id, text, others) -> its id, its measures, base_failed and kept.

    A null or empty text has no words: all counts are 0, base_failed is true and kept is false. Long texts are measured
    whole. Repeated rows give repeated results; null ids pass through; other columns are ignored; an empty table gives an
    empty result. There is no shuffle.
    """
    m = docs.select("doc_id", measures(text_or_empty(docs["text"])).alias("m"))
    flat = m.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in
                                ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "one")])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules, F.col)).drop("one")

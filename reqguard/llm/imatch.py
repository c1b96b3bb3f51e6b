"""Operator 9: I-Match fingerprints over several randomised subsets of a lexicon of mid-frequency terms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard.llm.neighbours import with_ranges, without_ranges
from reqguard.llm.text import let, lower_ascii, text_or_empty, words

#: Terms are kept if they occur in this share of the documents: idf between ln(1/0.3) = 1.2 and ln(1/0.02) = 3.9.
BAND = (0.02, 0.3)
SUBSETS = 32
CELLS = 65_536
#: What stands for a subset of which a text has no term.
NOTHING = "-" * 8


def terms(text: Column) -> Column:
    return words(lower_ascii(text))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[str]:
    """The terms in the band, in order. Exact, over all documents, in two passes.

    The first counts documents per hash cell of terms: a cell below the lower bound holds no term of the band. The
    second counts the terms of the other cells. Both aggregate before they shuffle, by a fixed number of cells and by
    the few terms left. The list has at most (mean distinct terms of a document) / (lower bound) terms, whatever the
    number of documents, so the driver can hold it.
    """
    n, = docs.agg(F.count(F.lit(1))).first()
    low, high = band[0] * n, band[1] * n
    found = docs.select(F.explode(F.array_distinct(terms(text_or_empty(docs["text"])))).alias("term"))
    cell = F.pmod(F.xxhash64("term"), F.lit(CELLS)).cast("int")
    cells = [r[0] for r in found.groupBy(cell.alias("cell")).count().filter(F.col("count") >= low).select("cell").collect()]
    if not cells:
        return []
    kept = found.filter(cell.isin(cells)).groupBy("term").count().filter(F.col("count").between(low, high))
    return sorted(r["term"] for r in kept.select("term").collect())


def subset_of(term: Column) -> Column:
    """The subset that a term was dealt to, by its hash."""
    return F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int") % SUBSETS


def fingerprint(text: Column, lexicon_terms: list[str]) -> Column:
    """Eight hexadecimal digits per subset: the hash of the text's sorted distinct terms in it, as an array. Where the text
    has no term of the lexicon, all of its terms count for every subset, so only texts of equal terms are alike."""
    kept = F.array_distinct(F.filter(terms(text), lambda x: x.isin(lexicon_terms))) if lexicon_terms else F.array().cast("array<string>")
    dealt = F.transform(F.sort_array(kept), lambda t: F.struct(subset_of(t).alias("s"), t.alias("t")))

    subsets = F.sequence(F.lit(0), F.lit(SUBSETS - 1))

    def of(ts):
        some = F.transform(subsets, lambda k: let(
            F.filter(ts, lambda x: x["s"] == k),
            lambda own: F.when(F.size(own) == 0, NOTHING).otherwise(
                F.substring(F.md5(F.array_join(F.transform(own, lambda x: x["t"]), " ")), 1, 8))))
        every = let(F.array_join(F.sort_array(F.array_distinct(terms(text))), " "), lambda joined: F.transform(
            subsets, lambda k: F.substring(F.md5(F.concat(k.cast("string"), F.lit(" "), joined)), 1, 8)))
        return F.when(F.size(ts) == 0, every).otherwise(some)

    return let(dealt, of)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subsets among those of which either has a term."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != NOTHING) | (y != NOTHING)), lambda x: x))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != NOTHING)), lambda x: x))
    return equal / either


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Every row of docs (doc_id, text, others) -> fingerprint of its text and of its edited text, and how alike they are.

    The edited text has its last half replaced by the start of the next document, in descending order of id. A null text
    counts as empty. Rows that repeat an id follow each other in the order of hashes of their texts; a null id comes
    last. A single row follows itself. Texts without a term of the band have the fingerprint of all their terms, and are
    alike only if these are equal. An empty table gives an empty result. Other columns are not read.
    """
    base = docs.select("doc_id", text_or_empty(docs["text"]).alias("text"))
    lex = lexicon(base, band)
    both, order = with_ranges(base, "doc_id", ["text"])
    n = F.length("text")
    with_text = both.withColumn("n_chars", n.cast("long")).withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = F.concat(F.expr("substring(text, 1, n_chars - n_chars div 2)"), F.expr("substring(_next, 1, n_chars div 2)"))
    marked = with_text.withColumn("_edited", edited).select(
        "doc_id", "_k", "_h", "_range", "_halo", "text", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), lex).alias("_own"), fingerprint(F.col("_edited"), lex).alias("_changed"))
    out = marked.withColumn("_after", F.lead("_own").over(order))
    return without_ranges(out).select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("_own", "").alias("fingerprint"),
        F.array_join("_changed", "").alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"))

"""Text expressions shared by the operators; all of them stay in the JVM."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, as the contracts define it.
SPACE = r"[ \t-\r]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def carried(docs: DataFrame, *needed) -> DataFrame:
    """The needed columns of docs, and all its columns in one struct (_doc): whatever their names are, they do not meet
    those that an operator makes."""
    return docs.select(*needed, F.struct("*").alias("_doc"))


def given_back(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from rows with _doc, some with another value; columns that docs lacks are not added."""
    return rows.select(*[changed.get(f.name, F.col("_doc").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def text_or_empty(text) -> Column:
    return F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The runs of characters that are not space or \\x09-\\x0D, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def crc_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def window_hashes(w: Column, width: int) -> Column:
    """A 64-bit hash of each window of width words, in order; w must be bound by let. Windows of a power of two come from
    hashes of half their width, and any other width from two that overlap, so a window costs a few hashes of two longs."""
    def joined(h, shift):
        n = F.greatest(F.size(h) - shift, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + shift), n), lambda a, b: F.xxhash64(a, b))

    def grown(h, have):
        if have == width:
            return h
        step = min(have, width - have)
        return let(joined(h, step), lambda x: grown(x, have + step))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: grown(h, 1))

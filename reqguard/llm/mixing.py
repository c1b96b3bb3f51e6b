"""Operator 6: mixing sources to target weights by hash-random order, distributed prefix sums and exact budgets."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqguard.llm.stage import stage
from reqguard.llm.text import SPACE, carried, given_back, word_count

#: Sources in code point order get these weights in turn.
WEIGHTS = (5, 2, 1)
#: The mix takes SHARE of all words, and of no source more than CAP times its own.
SHARE, CAP = 1.5, 2
#: Hexadecimal digits of the random key that name a range: 4096 ranges for each source.
DIGITS = 3


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size), a row per source -> the same and target, in words.

    A source below its cap gets weight x level, where the level makes all targets add up to the share. Capping the
    sources that are above and sharing their excess by weight, until none is above, ends there too. Sources reach their
    caps in the order of cap / weight, so running sums in that order give the level. These windows see one row per source.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    rows = sources.withColumn("_weight", F.get(turn, (place - 1) % len(weights)))
    rows = rows.withColumn("_full", (cap * F.col("source_size")) / F.col("_weight"))
    filling = Window.orderBy("_full", F.asc_nulls_last("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("_level", (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_weight").over(after))
    # levels of sources that stay below their caps; the first of them in this order counts
    rows = rows.withColumn("_place", F.row_number().over(filling))
    level = F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_place", "_level"))).over(Window.partitionBy())
    target = F.least(F.col("_weight") * F.coalesce(level["_level"], F.lit(float("inf"))), (cap * F.col("source_size")).cast("double"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def with_key(rows: DataFrame) -> DataFrame:
    """Adds _key, a hash of the id that serves as the random order, and _part, the range of keys it lies in."""
    return rows.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) \
               .withColumn("_part", F.substring("_key", 1, DIGITS))


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Rows with doc_id, source, size and any others -> the same with source_size, target and taken.

    Within a source, rows stand in the order of their hashed ids. Whole epochs take all rows; the rest of the budget
    goes to the rows in order, and the row on the cut gives just the words that are missing, so a source's taken words
    are its target rounded down. Sums per range of hashes, added up along the ranges, give each range its start; within
    a range, a window counts on. A hot source is thus cut into 4096 parts, summed before the shuffle.

    Rows of equal id follow each other by size; sizes of null count as 0; a null source is a source of its own, the
    last. A source without words has target 0. An empty table gives an empty result. Columns of rows that have the name
    of a result are replaced; all others keep their values.
    """
    keyed = with_key(carried(rows, "doc_id", "source", F.coalesce(rows["size"], F.lit(0)).cast("long").alias("size")))
    parts = stage(keyed.groupBy("source", "_part").agg(F.sum("size").alias("_sum")), "mix-parts")
    along = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_sum").over(along), F.lit(0))).drop("_sum")
    goals = targets(parts.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    plan = starts.alias("p").join(goals.alias("g"), F.expr("p.source <=> g.source")).select(
        F.col("p.source").alias("_source"), F.col("p._part").alias("_of"), "_start", "source_size", "target")
    placed = keyed.join(plan, keyed["source"].eqNullSafe(plan["_source"]) & (keyed["_part"] == plan["_of"]))
    within = Window.partitionBy("source", "_part").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    left = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    made = ("size", "source_size", "target", "taken")
    return placed.withColumn("taken", (epochs * F.col("size") + left).cast("long")).select(
        *[F.col("_doc").getField(x).alias(x) for x in rows.columns if x not in made], *made)


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, source, others) -> what the mix takes of it; a null text has size 0."""
    narrow = stage(docs.select("doc_id", "source", word_count(docs["text"]).alias("size")), "mix-sizes")
    return mix(narrow).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each epoch that takes a document whole, and one with the
    first words (as they stand, up to the last word's end) where the budget's cut lies in it. Documents of which nothing
    is taken go, those without a word among them."""
    m = mix(carried(docs, "doc_id", "source", "text", word_count(docs["text"]).alias("size")))
    copies = F.transform(F.sequence(F.lit(1), F.expr("cast(ceil(taken / size) as int)")),
                         lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))
    rows = m.filter("taken > 0").withColumn("_words", F.explode(copies))
    pieces = F.regexp_extract_all("text", F.lit(f"{SPACE}*[^ \\t-\\r]+"), F.lit(0))  # a word with what stands before it
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("_words") == F.col("size"), F.col("text")).otherwise(first))
    return given_back(rows, docs, text=F.col("text"), n_chars=F.length("text"))

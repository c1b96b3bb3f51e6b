"""Operator 10 in the dealt form: higher-order functions fold ranked merges over the distinct pieces of the corpus.

Gives the same tokens as `bpe`, in DataFrame functions only, but the pieces of all documents go through two shuffles and a
piece's merges take the square of its length. The registered query uses `bpe`; README has the figures of both.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard.llm.bpe import Vocabulary
from reqguard.llm.text import let

BUCKETS = 1 << 17
NONE = 2**31 - 1


def literal(values, kind: str) -> Column:
    """An array as one literal of the plan (folded from a text, which is quicker to hand over than many values)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def rank_map(v: Vocabulary):
    """Function (left, right) -> the token that two tokens join to, which is also the rank, or NONE. The map is a literal:
    pairs lie in buckets, so a look-up reads the few pairs of one."""
    n = len(v.tokens)
    order = sorted(range(len(v.pairs)), key=lambda i: int(v.pairs[i]) % BUCKETS)
    starts = [0] * (BUCKETS + 1)
    for i in order:
        starts[int(v.pairs[i]) % BUCKETS + 1] += 1
    for b in range(BUCKETS):
        starts[b + 1] += starts[b]
    start, pairs = literal(starts, "int"), literal([int(v.pairs[i]) for i in order], "bigint")
    joined = literal([int(v.joined[i]) for i in order], "int")

    def look_up(left, right):
        def among(pair):
            bucket = (pair % BUCKETS).cast("int")
            first, last = F.get(start, bucket), F.get(start, bucket + 1)
            places = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(places, F.lit(NONE), lambda found, i: F.when(F.get(pairs, i) == pair, F.get(joined, i)).otherwise(found))
        return let(left.cast("long") * n + right, among)

    return look_up


def encoded(pieces: DataFrame, v: Vocabulary) -> DataFrame:
    """Distinct pieces (piece, others) -> the same with ids: the piece's bytes as tokens, joined pair by pair, each time the
    pair of least rank (the leftmost at ties), until none joins."""
    look_up, single = rank_map(v), literal(v.single.tolist(), "int")
    byte = lambda b, i: F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int")
    start = let(F.encode("piece", "UTF-8"), lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.get(single, byte(b, i))))

    def once(ids, _):
        def merged(ranks):
            def at(place):
                joined = F.concat(F.slice(ids, F.lit(1), place - 1), F.slice(ranks, place, F.lit(1)), F.slice(ids, place + 2, F.size(ids)))
                return F.when(F.get(ranks, place - 1) == NONE, ids).otherwise(joined)
            return let(F.array_position(ranks, F.array_min(ranks)).cast("int"), at)
        pairs = F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: look_up(F.get(ids, i), F.get(ids, i + 1)))
        return F.when(F.size(ids) < 2, ids).otherwise(let(pairs, merged))

    rounds = F.when(F.octet_length("piece") > 1, F.sequence(F.lit(1), F.octet_length("piece") - 1)).otherwise(F.array().cast("array<int>"))
    return pieces.withColumn("ids", F.aggregate(rounds, start, once))


def fold_encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Documents (doc_id, text, others; ids distinct and not null) -> doc_id and ids (array of tokens in order), for texts
    with a token. Pieces are the matches of the pattern; the distinct ones of the corpus are encoded once and joined back.
    Other columns are not read; an empty table gives an empty result."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?U)" + v.pattern), F.lit(0))).alias("at", "piece"))
    known = encoded(found.select("piece").distinct(), v)
    rows = found.join(known, "piece").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return rows.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def fold_decode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """Rows with ids (array, others) -> the same with decoded: the bytes of the tokens, joined as binary pieces."""
    tokens = literal([t.hex() for t in v.tokens], "string")
    joined = F.aggregate("ids", F.lit("").cast("binary"), lambda a, i: F.concat(a, F.unhex(F.get(tokens, i))))
    return rows.withColumn("decoded", joined)

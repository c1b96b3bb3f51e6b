"""Text expressions: signatures, payload flags, fingerprints and n-grams."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard import constants as C


def any_match(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """True where one pattern is found; ``(?d)`` makes only a line feed end a line, for ``.``.

    With ``low``, the lower-cased text, a pattern is only searched where a text that all its matches contain is present:
    most rows are decided by plain substring tests.
    """
    def found(p):
        hit = text.rlike("(?d)" + p)
        return contains_any(low, C.NEEDLES[p]) & hit if low is not None and p in C.NEEDLES else hit
    return reduce(lambda a, b: a | b, [found(p) for p in patterns])


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def matched_signatures(text: Column, low: Column) -> Column:
    """Names of the signature categories found in the request text, each once, in table order."""
    hits = [F.when(any_match(text, patterns, low), F.lit(name)) for name, (_, patterns) in C.SIGNATURES.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def signature_score(matched: Column) -> Column:
    parts = [F.when(F.array_contains(matched, name), F.lit(w)).otherwise(F.lit(0.0))
             for name, (w, _) in C.SIGNATURES.items()]
    return F.least(reduce(lambda a, b: a + b, parts), F.lit(100.0))


def signature_match(requests: DataFrame) -> DataFrame:
    """Add ``matched`` (array) and ``signature_score`` to requests with payload, user_agent and endpoint."""
    out = requests.withColumn("_text", F.concat_ws(" ", "payload", "user_agent", "endpoint"))
    out = out.withColumn("_low", F.lower("_text")).withColumn("matched", matched_signatures(F.col("_text"), F.col("_low")))
    return out.drop("_text", "_low").withColumn("signature_score", signature_score(F.col("matched")))


def flag_hit(low: Column, flag: str) -> Column:
    """Whether the lower-cased payload shows the flag."""
    return any_match(low, C.PAYLOAD_FLAGS[flag], low)


def payload_flags(payload: Column) -> Column:
    """Flags found in a payload, sorted by name."""
    def flags(low):
        return F.filter(F.array(*[F.when(flag_hit(low, f), F.lit(f)) for f in sorted(C.PAYLOAD_FLAGS)]),
                        lambda x: x.isNotNull())
    return F.transform(F.array(F.lower(payload)), flags)[0]


def fingerprint(user_agent: Column, path: Column, method: Column, payload: Column) -> Column:
    """Actor fingerprint: hash of the agent, path, method and the first 50 characters of the payload."""
    return F.sha2(F.concat_ws("|", user_agent, path, method, F.substring(payload, 1, 50)), 256)


def structural_fingerprint(payload: Column) -> Column:
    """Shape of a whole payload: digit runs become D, then letter runs (with those D) become A."""
    return F.regexp_replace(F.regexp_replace(payload, "[0-9]+", "D"), "[a-zA-Z]+", "A")


def ngrams(text: Column, n: int) -> Column:
    """All n-grams of a text in order; an empty array for shorter texts. The text is cut into its characters once, as a
    substring would look for its place from the start of the text each time."""
    last = F.length(text) - (n - 1)

    def grams(chars):
        return F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))

    return F.when(last >= 1, F.transform(F.array(F.split(text, "")), grams)[0]).otherwise(F.array().cast("array<string>"))


def trigram_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, gram, n, weight): tri-gram counts of each text, weight L2-normalised per text.

    The grams of one text are counted before the shuffle, since its row sits in one task.
    """
    grams = ngrams(F.col(text_col), 3)
    out = texts.select(F.col(id_col), F.explode(grams).alias("gram")).groupBy(id_col, "gram").agg(
        F.count("*").alias("n"))
    norm = out.groupBy(id_col).agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("_norm"))
    return out.join(norm, id_col).select(id_col, "gram", "n", (F.col("n") / F.col("_norm")).alias("weight"))


def path_numbers(path: Column) -> Column:
    """Numbers that directly follow a slash, as digits without leading zeros, however many there are."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"/(\d+)"), 1), lambda s: F.regexp_replace(s, r"^0+(?=\d)", ""))


def predecessor(digits: Column) -> Column:
    """The number before one given by `path_numbers`; something that is no number before 0."""
    last = r"^(\d*)([1-9])(0*)$"  # the last digit that is not 0, and the zeros behind it, which become nines
    part = lambda i: F.regexp_extract(digits, last, i)
    less = F.concat(part(1), (part(2).cast("int") - 1).cast("string"), F.translate(part(3), "0", "9"))
    return F.when(digits == "0", "none").otherwise(F.regexp_replace(less, r"^0+(?=\d)", ""))


def failed_login(method: Column, path: Column, payload: Column) -> Column:
    return (method == "POST") & F.lower(path).contains("login") & F.lower(payload).contains("failed")


def deceptive_route(path: Column) -> Column:
    return contains_any(F.lower(path), C.DECEPTIVE_ROUTES)


def bot_agent(user_agent: Column) -> Column:
    return contains_any(F.lower(user_agent), C.BOT_WORDS)


def escape_regex(text: Column) -> Column:
    """Literal text as a regular expression."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")

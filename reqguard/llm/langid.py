"""Operator 8: language identification by cross-parsing entropy with suffix automata."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqguard.llm.stage import sent
from reqguard.llm.text import carried, crc_remainder, given_back

#: Bounds of the sample an automaton is built from: labelled texts per language, and bytes per language.
SAMPLE_TEXTS, SAMPLE_BYTES = 200, 24_576
#: Texts are parsed in blocks of so many bytes, so that a long text is as many short lanes.
BLOCK = 384
#: Bytes of text worked on at once in a task.
CHUNK = 1 << 21
UNKNOWN = "und"


def folded(text: bytes) -> np.ndarray:
    """Bytes with A-Z lower-cased and every other ASCII byte that is no letter as one space."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        table[b] = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32
    return table[np.frombuffer(text, dtype=np.uint8)]


def automaton(text: bytes) -> np.ndarray:
    """The suffix automaton of a text as a table: row of a state, column of a byte -> next state, or -1.

    State 0 is the start; the automaton accepts just the strings that occur in the text. Built letter by letter: each
    step adds a state for the longer text, and splits a state whose strings stop ending at the same places.
    """
    moves, link, size, last = [{}], [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = new
    table = np.full((len(moves), 256), -1, dtype=np.int32)
    for s, m in enumerate(moves):
        for c, t in m.items():
            table[s, c] = t
    return table


class Parser:
    """Automata of all languages side by side over a common alphabet of the bytes any of them knows."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        tables = [automaton(folded(samples[x]).tobytes()) for x in self.langs]
        used = np.flatnonzero(sum((t >= 0).any(axis=0).astype(int) for t in tables)) if tables else np.array([], int)
        self.width = len(used) + 1
        self.code = np.zeros(256, dtype=np.int32)  # 0: a byte that no automaton knows
        self.code[used] = np.arange(1, len(used) + 1)
        self.tables = []
        for t in tables:
            flat = np.full((len(t) + 1, self.width), -1, dtype=np.int32)  # no way leads on from the last row
            flat[:-1, 1:] = np.where(t[:, used] >= 0, t[:, used] * self.width, -1)  # states as offsets of their rows
            self.tables.append(flat.ravel())

    def phrases(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block, a column per language: a phrase is the longest match with the language's text from
        where the last one ended, and one byte at least. Blocks are parsed side by side, longest first."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        codes = self.code[text]
        out = np.zeros((len(starts), len(self.tables)), dtype=np.int64)
        alive = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")
        for j, table in enumerate(self.tables):
            nowhere = len(table) - self.width
            state = np.full(len(starts), nowhere, dtype=np.int32)
            count = np.zeros(len(starts), dtype=np.int64)
            first = np.where(table[: self.width] < 0, nowhere, table[: self.width]).astype(np.int32)
            for t, n in enumerate(alive):
                c = codes[starts[:n] + t]
                to = table[state[:n] + c]
                stop = to < 0
                count[:n] += stop
                state[:n] = np.where(stop, first[c], to)
            out[order, j] = count
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Phrases per byte of each text and language."""
        total = np.zeros((len(texts), len(self.tables)))
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        joined = folded(b"".join(texts))
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + within * BLOCK
        lengths = np.minimum(BLOCK, sizes[owner] - within * BLOCK)
        if len(owner):
            np.add.at(total, owner, self.phrases(joined, starts, lengths))
        return total / np.maximum(sizes, 1)[:, None]


def labelled_sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """At most `size` bytes of text per language, from the `texts` labelled texts of it that come first by the hash of
    their id: the bounded sample that the automata are built from.

    The texts of a language share its bytes: none gives more than a level at which all together have `size` characters,
    so few or short texts give all they have, and long ones an equal stretch from anywhere in them (by a hash). Two
    passes: the lengths of the chosen texts, then their stretches. Rows that repeat count once.
    """
    named = docs.filter("lang IS NOT NULL AND text <> ''").select(
        "lang", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), F.xxhash64("text").alias("mark"), "text")
    order = Window.partitionBy("lang").orderBy("key", "mark")
    lengths = named.select("lang", "key", "mark", F.length("text").alias("n")).distinct()
    top = lengths.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= texts).collect()
    by_lang: dict[str, list] = {}
    for r in top:
        by_lang.setdefault(r["lang"], []).append(r)
    chosen = []
    for rows in by_lang.values():
        most = level([r["n"] for r in rows], size)
        chosen += [(r["lang"], r["key"], r["mark"], r["place"], min(r["n"], most), 1 + (r["mark"] % (r["n"] - min(r["n"], most) + 1))) for r in rows]
    if not chosen:
        return {}
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, key string, mark long, place int, n int, start int")
    parts = named.join(F.broadcast(wanted), ["lang", "key", "mark"]).select("lang", "place", F.substring("text", F.col("start"), F.col("n")).alias("part"))
    found: dict[str, list[bytes]] = {}
    for r in sorted(parts.dropDuplicates(["lang", "place"]).collect(), key=lambda r: r["place"]):
        found.setdefault(r["lang"], []).append(r["part"].encode())
    return {k: b" ".join(v)[:size] for k, v in found.items()}


def level(sizes: list[int], total: int) -> int:
    """The least level at which sizes cut to it add up to the total, or the largest size if they do not."""
    left, sizes = total, sorted(sizes)
    for i, n in enumerate(sizes):
        if n * (len(sizes) - i) >= left:
            return max(1, -(-left // (len(sizes) - i)))
        left -= n
    return sizes[-1]


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """Every row of docs (text and any others) -> the same with lang_pred, score and phrase_rate.

    The language whose automaton parses the whole text into the fewest phrases per byte wins; at a tie, the first by
    name. The score is 1 - the winner's phrases / the mean of the other languages' (0 to 1; 1 if only one is known).
    phrase_rate is the winner's phrases per byte. A null text, one without letters, and any text if no language was
    learned, are `und` with score 0 and a null phrase_rate. Long texts are parsed whole; rows that repeat give repeated
    results; an empty table gives an empty one. A column of docs with one of the three names is replaced.
    """
    parser = sent(docs.sparkSession, Parser(samples))  # bounded by the sample
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "phrase_rate")]
    rows = docs.select(*names, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = docs.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("phrase_rate")).schema

    def run(batches):
        p = parser()
        langs = np.array(p.langs + [UNKNOWN], dtype=object)
        for batch in batches:
            known = np.array(batch.column("_letters").to_pylist(), dtype=bool) & bool(p.langs)
            best, score, rate = np.full(len(known), len(p.langs)), np.zeros(len(known)), np.full(len(known), np.nan)
            texts, at, size = [], [], 0

            def flush():
                if texts:
                    s = p.scores(texts)
                    i = np.argmin(s, axis=1)
                    low = s[np.arange(len(s)), i]
                    others = (s.sum(axis=1) - low) / max(1, s.shape[1] - 1)
                    best[at], rate[at] = i, low
                    score[at] = np.clip(1 - low / others, 0, 1) if s.shape[1] > 1 else 1.0
                    texts.clear(), at.clear()

            column = batch.column("text")
            for k in np.flatnonzero(known):
                texts.append(column[int(k)].as_py().encode())
                at.append(k)
                size += len(texts[-1])
                if size > CHUNK:
                    flush()
                    size = 0
            flush()
            cols = [batch.column(n) for n in names] + [pa.array(list(langs[best]), pa.string()), pa.array(score, pa.float64()),
                                                       pa.array(rate, pa.float64(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names + ["lang_pred", "score", "phrase_rate"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id):
    return crc_remainder(doc_id, 5) == 0


def languages(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, lang, others) -> doc_id, held_out, lang_pred and score, learned from the labelled
    rows that are not held out. Rows of null lang are only predicted; repeated rows give repeated results; a null or empty
    text is `und`; an empty table gives an empty result. Other columns are not read."""
    samples = labelled_sample(docs.filter(~held_out(docs["doc_id"])))
    return identify(docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text"), samples).drop("text")


#: Above this many phrases per byte in the best language, a text is in none of those learned.
FOREIGN = 0.6


def in_known_language(docs: DataFrame, foreign: float = FOREIGN) -> DataFrame:
    """The documents in a learned language, with their own columns, whatever these are called: `und` goes, and so does
    text whose best parse needs more phrases per byte than any of the languages. See identify for odd rows."""
    samples = labelled_sample(docs.filter(~held_out(docs["doc_id"])))
    marked = identify(carried(docs, "text"), samples)
    return given_back(marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("phrase_rate") <= foreign)), docs)

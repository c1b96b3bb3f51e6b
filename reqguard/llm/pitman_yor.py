"""Operator 1: scoring texts with a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Each word is a context with a restaurant of its own, where the words after it sit. The restaurants of all contexts share
one parent, the restaurant of words without context, whose customers are their tables. Its new tables order their word
from a hierarchy of letter restaurants. There, a context of three letters has the context of its last two as parent, that one the context of one, then the one
without context, then the uniform distribution. Each table of a word counts as one customer, letter by letter, below.
"""

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqguard.llm.packed import Scramble, packed, packed_steps, unpacked, unpacked_steps
from reqguard.llm.shingles import Hasher, mixed
from reqguard.llm.stage import discard, release, sent, stage
from reqguard.llm.text import crc_remainder

#: Letters: 0 ends a word, 1 to 62 are the bytes that most words have, 63 is any other byte. A table of letters in
#: contexts of three has at most 64 ** 4 entries, whatever the corpus; so the driver and each task can hold it.
LETTERS, OTHER = 64, 63
DEPTH = 3
STRENGTH = 1.0
#: Gibbs sweeps; the first BURN of them are not averaged.
SWEEPS, BURN = 3, 1
#: Up to so many customers, the tables of a dish are drawn from their exact conditional.
EXACT = 48
#: Bytes of text in a block, and hashed at once.
BLOCK_BYTES, CHUNK = 8 << 20, 1 << 20
#: There are as many buckets of words, and parts of pairs, as the texts hold this many bytes.
GROUP_BYTES = 16 << 20


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key, the same in every run."""
    bits = mixed(keys.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: row c, column t is the weight of all ways to seat c customers at t tables."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(EXACT):
        for t in range(1, c + 2):
            stay = s[c, t] + math.log(c - discount * t) if c > discount * t and t <= c else -np.inf
            s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


def tables(customers: np.ndarray, order: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """A draw of the number of tables of each dish, given the rest of its restaurant.

    order is the weight of a new table: (strength + discount * tables of the restaurant) * the parent's probability.
    Up to EXACT customers, t tables have the weight S(c, t) * order ** t, and one is drawn from that. Those beyond take
    their seats in groups that double, a group's new tables being a binomial draw (by its normal approximation) at the
    chance in its middle.
    """
    out = np.minimum(customers, 1)
    u = uniform(keys, salt)
    s, log_order = log_stirling(discount), np.log(np.maximum(order, 1e-300))
    first = np.minimum(customers, EXACT)
    for c in np.unique(first[first > 1]).tolist():
        rows = np.flatnonzero(first == c)
        t = np.arange(1, c + 1)
        for part in np.array_split(rows, len(rows) // 100_000 + 1):
            w = s[c, 1:c + 1] + t * log_order[part, None]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (w < u[part, None] * w[:, -1:]).sum(axis=1)
    seated, step = EXACT, 0
    while True:
        rows = np.flatnonzero(customers > seated)
        if not len(rows):
            return out
        group = np.minimum(customers[rows], 2 * seated) - seated
        chance = order[rows] / (seated + group / 2 - discount * out[rows] + order[rows])
        step += 1
        a, b = uniform(keys[rows], salt + 7919 * step), uniform(keys[rows], salt + 7919 * step + 13)
        normal = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        new = np.rint(group * chance + np.sqrt(group * chance * (1 - chance)) * normal).astype(np.int64)
        out[rows] += np.clip(new, 0, group)
        seated *= 2


def discount_of(customers: np.ndarray) -> float:
    """The usual estimate from dishes with one and with two customers."""
    one, two = int((customers == 1).sum()), int((customers == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


@dataclass
class Spelling:
    """Letter probabilities of one sample: level 0 to DEPTH - 1 dense; at DEPTH the seen ones, and else the weight of the parent."""
    keys: np.ndarray
    seen: np.ndarray
    rest: np.ndarray
    parent: np.ndarray

    def letter(self, grams: np.ndarray) -> np.ndarray:
        """The probability of the last letter of each gram after its others."""
        back = self.rest[grams // LETTERS] * self.parent[grams % LETTERS ** DEPTH]
        if not len(self.keys):
            return back
        i = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return np.where(self.keys[i] == grams, self.seen[i], back)


def spelling(grams: np.ndarray, customers: np.ndarray, before: Spelling | None, levels: list, salt: int) -> tuple[Spelling, list]:
    """One sweep over the letter restaurants, from the longest contexts on: customers of each level are drawn to tables
    given the parents of the last sweep (one table per dish at first), and tables are the customers of the level above
    it in the hierarchy. Then the probabilities are added up from the uniform distribution down.
    `levels` holds the last sweep's probabilities and tables by restaurant."""
    keys, n, seated = grams, customers, []
    for level in range(DEPTH, -1, -1):
        d = discount_of(n)
        context = keys // LETTERS
        if before is None:
            t = np.minimum(n, 1)
        else:
            below, whole = levels[level]
            parent = below[keys % LETTERS ** level] if level else np.full(len(keys), 1 / LETTERS)
            t = tables(n, (STRENGTH + d * whole[context]) * parent, d, keys, salt + level)
        seated.append((keys, n, t, d))
        parents = keys % LETTERS ** level
        keys = np.unique(parents)
        n = np.bincount(parents, weights=t, minlength=LETTERS ** level)[keys].astype(np.int64) if level else n
    prob, made = np.full(1, 1 / LETTERS), []
    for level, (keys, n, t, d) in enumerate(reversed(seated)):
        size = LETTERS ** level
        own = np.bincount(keys // LETTERS, weights=n, minlength=size)
        tabled = np.bincount(keys // LETTERS, weights=t, minlength=size)
        rest = (STRENGTH + d * tabled) / (STRENGTH + own)
        parent = prob if level else np.full(LETTERS, 1 / LETTERS)
        made.append((parent, tabled))
        if level == DEPTH:
            seen = (n - d * t) / (STRENGTH + own[keys // LETTERS]) + rest[keys // LETTERS] * parent[keys % LETTERS ** level]
            return Spelling(keys, seen, rest, parent), made
        cells = np.arange(size * LETTERS)
        prob = rest[cells // LETTERS] * (parent[cells % LETTERS ** level] if level else 1 / LETTERS)
        prob[keys] += (n - d * t) / (STRENGTH + own[keys // LETTERS])
    raise AssertionError("no level")


def spelled(words: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word as grams of DEPTH + 1 letters, one for each of its letters and its end: (grams, first gram of each word,
    how many bytes of each word are none of the letters)."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    raw = code[np.frombuffer(b"".join(words), np.uint8)]
    begin = np.cumsum(sizes + 1) - sizes - 1
    letters = np.zeros(int((sizes + 1).sum()), np.int64)
    place = np.arange(len(raw)) + np.repeat(np.arange(len(words)), sizes)
    letters[place] = raw
    at = np.arange(len(letters)) - np.repeat(begin, sizes + 1)
    grams = letters.copy()
    for j in range(1, DEPTH + 1):
        past = np.zeros_like(letters)
        past[j:] = letters[:-j] if j < len(letters) else 0
        grams += np.where(at >= j, past, 0) * LETTERS ** j
    return grams, begin, np.bincount(np.repeat(np.arange(len(words)), sizes)[raw == OTHER], minlength=len(words)) if len(words) else begin


def word_keys(words: list[bytes]) -> np.ndarray:
    """A key of each word for its draws."""
    h = Hasher().byte
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = h[np.frombuffer(b"".join(words), np.uint8)] * (np.uint64(0x9E3779B97F4A7C15) + mixed(
        (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)))
    part = np.append(np.uint64(0), np.cumsum(flat, dtype=np.uint64))
    ends = np.cumsum(sizes)
    return mixed(part[ends] - part[ends - sizes] + sizes.astype(np.uint64))


def text_words(data: pa.ChunkedArray):
    """Words of the texts of a block: (hash, begin, end, words per text, lower-cased bytes). A text's end is the empty
    word, with hash 0. Hashing goes by parts of the block, as it takes many times the memory of the text."""
    hasher, found, part, size, offset = Hasher(), [], [], 0, 0
    column = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
    for i in range(len(column)):
        part.append((column[i].as_py() or "").encode())
        size += len(part[-1])
        if size > CHUNK or i + 1 == len(column):
            value, begin, end, count, low = hasher.found(part)
            found.append((value, begin + offset, end + offset, count, low))
            offset += len(low)
            part, size = [], 0
    return tuple(np.concatenate(x) for x in zip(*found))


@dataclass
class Letters:
    """What a sweep leaves of the letter restaurants, and the letters of bytes."""
    spelling: Spelling
    code: np.ndarray

    def probability(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        grams, begin, others = spelled(words, self.code)
        p = np.add.reduceat(np.log(self.spelling.letter(grams)), begin) - others * math.log(256 - (OTHER - 1))
        return np.exp(np.maximum(p, -690))


@dataclass
class Seating:
    """What a sweep leaves of the restaurant of words: how many customers and tables it has, its discount, and the part of
    its probability that the words met have from their letters."""
    customers: int
    tables: int
    discount: float
    letters: float = 0.0

    def new_table(self) -> float:
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def probability(self, m: np.ndarray, t: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (m - self.discount * t) / (STRENGTH + self.customers) + self.new_table() * h

    def unseen(self) -> float:
        """The probability of all words together that were never met."""
        return max(1e-12, self.new_table() * (1 - self.letters))


def listed(blob: bytes) -> list[bytes]:
    """Words, each followed by a line feed, which none of them holds."""
    return blob.split(b"\n")[:-1]


def rows_of(table: pa.Table, by: str) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r[by])


def made(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def arrow_schema(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def block_words(buckets: int):
    def run(block: pa.Table) -> pa.Table:
        """A block's distinct words by bucket of their hash, with how often its texts that are not held out have each; and
        its texts as numbers of its words. The end of a text is number 0."""
        value, begin, end, count, low = text_words(block.column("text"))
        learn = ~np.array(block.column("held_out").to_pylist(), dtype=bool)
        keys, first, which = np.unique(value, return_index=True, return_inverse=True)
        n = np.append(int(learn.sum()), np.bincount(which, weights=np.repeat(learn, count), minlength=len(keys)).astype(np.int64))
        bucket = np.append(0, ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
        low = np.append(low, np.uint8(10))
        start, size = np.append(len(low) - 1, begin[first]), np.append(0, end[first] - begin[first]) + 1
        last = np.cumsum(size)
        flat = low[np.repeat(start - (last - size), size) + np.arange(int(last[-1]))]
        flat[last - 1] = 10
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        place, at = np.append(0, last), block.column("block")[0].as_py()
        number, texts = (which + 1).astype("<i4").tobytes(), np.append(0, np.cumsum(count)) * 4
        words = pa.table({
            "block": pa.array([at] * (len(cut) - 1), pa.int32()), "bucket": pa.array(bucket[cut[:-1]], pa.int32()),
            "size": pa.array(np.diff(cut), pa.int32()),
            "words": pa.array([flat[place[a]:place[b]].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
            "n": pa.array([packed(n[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())})
        docs = pa.table({"block": block.column("block"), "doc_id": block.column("doc_id"), "held_out": block.column("held_out"),
                         "tokens": pa.array([number[a:b] for a, b in zip(texts, texts[1:])], pa.binary())})
        names = ["block", "bucket", "size", "words", "n", "doc_id", "held_out", "tokens"]
        both = pa.concat_tables([words, docs], promote_options="default")
        return both.select(names)

    return run


VOCABULARY = "bucket int, block int, size int, total long, words binary, c binary, ids binary"


def bucket_words(rows: pa.Table) -> pa.Table:
    """The words of a bucket, told apart by their bytes and counted: one row with those that the training texts have, and
    one for each block with the places (from 1) of its words there, 0 and the word itself for one that is not there."""
    given = rows_of(rows, "block")
    blob = b"".join(r["words"] for r in given)
    n = np.concatenate([unpacked(r["n"], r["size"]) for r in given])
    offsets = np.append(0, np.flatnonzero(np.frombuffer(blob, np.uint8) == 10) + 1).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(blob)])
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy()
    c = np.bincount(which, weights=n, minlength=len(coded.dictionary)).astype(np.int64)
    met = c > 0
    ids = np.where(met, np.cumsum(met), 0)[which]
    out = [{"bucket": given[0]["bucket"], "size": int(met.sum()), "total": int(c.sum()), "c": packed(c[met]),
            "words": b"".join(coded.dictionary.filter(pa.array(met)).to_pylist())}]
    at = 0
    for r in given:
        own = ids[at:at + r["size"]]
        new = [] if own.all() else words.slice(at, r["size"]).filter(pa.array(own == 0)).to_pylist()
        out.append({"bucket": r["bucket"], "block": r["block"], "size": r["size"], "words": b"".join(new), "ids": packed(own)})
        at += r["size"]
    return made(out, arrow_schema(VOCABULARY))


@dataclass
class Plan:
    """How words are numbered (the first number of each bucket, and the end), and how pairs are dealt into parts."""
    offsets: np.ndarray
    scramble: Scramble

    def laid_out(self, docs: pa.Table, ids: list[dict]):
        """A block's texts, each with its end: (number of each token in the block, the token before it (the end before
        the first), text of each token, which tokens are pairs of words met, key of each of those)."""
        number = np.concatenate([np.where(x > 0, x + self.offsets[r["bucket"]] - 1, -1)
                                 for r in ids for x in [unpacked(r["ids"], r["size"]).astype(np.int64)]])
        texts = docs.column("tokens").to_pylist()
        flat = np.frombuffer(b"".join(t + bytes(4) for t in texts), "<i4")
        before = np.append(0, flat[:-1])
        u, w = number[before], number[flat]
        pair = (u >= 0) & (w >= 0)
        keys = self.scramble.there((u[pair].astype(np.uint64) << self.scramble.bits) | w[pair].astype(np.uint64))
        return flat, before, np.repeat(np.arange(len(texts)), [len(t) // 4 + 1 for t in texts]), pair, keys

    def sides(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context and the word of each pair."""
        both = self.scramble.back(keys)
        return (both >> self.scramble.bits).astype(np.int64), (both & (self.scramble.mask >> self.scramble.bits)).astype(np.int64)

    def by_bucket(self, numbers: np.ndarray):
        """(bucket, slice) of ascending numbers."""
        cut = np.searchsorted(numbers, self.offsets)
        return [(k, slice(cut[k], cut[k + 1])) for k in np.flatnonzero(np.diff(cut)).tolist()]

    def tallies(self, part: int, u: np.ndarray, w: np.ndarray, tables: np.ndarray, single: bool) -> list[dict]:
        """Tables of pairs, added up by word (m: customers it gets) and by context (u: tables of its restaurant)."""
        numbers, which = np.unique(np.concatenate([u, w]), return_inverse=True)
        m = np.bincount(which[len(u):], weights=tables, minlength=len(numbers)).astype(np.int64)
        own = np.bincount(which[:len(u)], weights=tables, minlength=len(numbers)).astype(np.int64)
        return [{"part": part, "bucket": k, "single": single, "size": s.stop - s.start, "ids": packed_steps(numbers[s] - self.offsets[k]),
                 "m": packed(m[s]), "u": packed(own[s])} for k, s in self.by_bucket(numbers)]


PAIRS = "part int, block int, size int, keys binary, n binary"


def block_pairs(plan: Plan):
    def run(docs: pa.Table, ids: pa.Table) -> pa.Table:
        """A block's distinct pairs of a word and the one before it, by part of their keys, with how often its texts that
        are not held out have each."""
        _, _, owner, pair, keys = plan.laid_out(docs, rows_of(ids, "bucket"))
        learn = ~np.array(docs.column("held_out").to_pylist(), dtype=bool)
        keys, which = np.unique(keys, return_inverse=True)
        n = np.bincount(which, weights=learn[owner[pair]], minlength=len(keys)).astype(np.int64)
        cut, block, steps = plan.scramble.bounds(keys), docs.column("block")[0].as_py(), np.diff(keys, prepend=np.uint64(0))
        there = [p for p in range(len(cut) - 1) if cut[p] < cut[p + 1]]
        for p in there:
            steps[cut[p]] = keys[cut[p]] - np.uint64(plan.scramble.low[p])
        return made([{"part": p, "block": block, "size": int(cut[p + 1] - cut[p]), "keys": packed(steps[cut[p]:cut[p + 1]]), "n": packed(n[cut[p]:cut[p + 1]])}
                     for p in there], arrow_schema(PAIRS))

    return run


def counted_pairs(plan: Plan, rows: list[dict]):
    """(distinct keys of a part, place of each row's keys there, training count of each)."""
    steps = np.concatenate([unpacked(r["keys"], r["size"]) for r in rows])
    size = np.array([r["size"] for r in rows])
    sums = np.append(np.uint64(0), np.cumsum(steps, dtype=np.uint64))
    before = np.repeat(sums[np.cumsum(size) - size], size)
    keys, which = np.unique(sums[1:] - before + np.uint64(plan.scramble.low[rows[0]["part"]]), return_inverse=True)
    n = np.concatenate([unpacked(r["n"], r["size"]) for r in rows])
    return keys, which, np.bincount(which, weights=n, minlength=len(keys)).astype(np.int64)


TALLIES = "part int, bucket int, single boolean, size int, ids binary, m binary, u binary, keys binary, t binary, one long, two long"


def part_pairs(plan: Plan):
    def run(rows: pa.Table) -> pa.Table:
        """The pairs of a part, one table each. A pair met once has one table in every sweep, so only the others (with
        their counts, in the row without a bucket) are drawn later; both are added up by word."""
        given = rows_of(rows, "block")
        part = given[0]["part"]
        keys, _, c = counted_pairs(plan, given)
        out = []
        for single, these in ((True, keys[c == 1]), (False, keys[c > 1])):
            u, w = plan.sides(these)
            out += plan.tallies(part, u, w, np.ones(len(u)), single)
        more = c > 1
        out.append({"part": part, "size": int(more.sum()), "keys": packed_steps(keys[more], plan.scramble.low[part]), "t": packed(c[more]),
                    "one": int((c == 1).sum()), "two": int((c == 2).sum())})
        return made(out, arrow_schema(TALLIES))

    return run


SEATS = "bucket int, size int, words binary, c binary, m1 binary, u1 binary, m binary, u binary, t binary, customers long, tables long, one long, two long"


def seat_words(before: Seating | None, sweep: int):
    def run(given: pa.Table, state: pa.Table) -> pa.Table:
        """One sweep over the words of a bucket: their customers are the tables of the pairs that they end, and they are
        drawn to tables given the letters of the last sweep (one table each at first)."""
        row, = state.to_pylist()
        n = row["size"]
        fixed, drawn = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
        if before is not None:
            fixed[0], fixed[1] = unpacked(row["m1"], n), unpacked(row["u1"], n)
        for r in given.to_pylist():
            at = unpacked_steps(r["ids"], r["size"]).astype(np.int64)
            to = fixed if r["single"] else drawn
            to[0, at] += unpacked(r["m"], r["size"]).astype(np.int64)
            to[1, at] += unpacked(r["u"], r["size"]).astype(np.int64)
        m, u = fixed + drawn
        if before is None:
            t = np.minimum(m, 1)
        else:
            order = (STRENGTH + before.discount * before.tables) * np.frombuffer(row["h"])
            t = tables(m, order, before.discount, word_keys(listed(row["words"])), 1_000_003 * sweep)
        return made([{"bucket": row["bucket"], "size": n, "words": row["words"], "c": row["c"], "m1": packed(fixed[0]), "u1": packed(fixed[1]),
                      "m": packed(m), "u": packed(u), "t": packed(t), "customers": int(m.sum()), "tables": int(t.sum()),
                      "one": int((m == 1).sum()), "two": int((m == 2).sum())}], arrow_schema(SEATS))

    return run


def byte_counts(batches):
    """Rows of words and their counts c -> (byte, n): the words that a byte occurs in, counted with each occurrence."""
    total = np.zeros(256, np.int64)
    for batch in batches:
        for words in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(words.replace(b"\n", b""), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])


def letter_counts(code: np.ndarray):
    def run(batches):
        """Rows of words and their tables t -> (gram, n): letters in context, each as often as there are tables."""
        for batch in batches:
            for blob, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = listed(blob)
                if words:
                    grams, begin, _ = spelled(words, code)
                    weight = np.repeat(unpacked(t, len(words)), np.diff(np.append(begin, len(grams))))
                    keys, which = np.unique(grams, return_inverse=True)
                    n = np.bincount(which, weights=weight).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["gram", "n"])

    return run


def with_letters(get_letters):
    def run(batches):
        """Rows of words -> the same with h, the probability of each by its letters, and the sum of those."""
        for batch in batches:
            h = [get_letters().probability(listed(blob)) for blob in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in h], pa.binary()), pa.array([float(x.sum()) for x in h])],
                                             names=[*batch.schema.names, "h", "letters"])

    return run


REPLIES = "part int, bucket int, size int, ids binary, u binary, p binary"


def reply_to_parts(seating: Seating):
    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        """What the pairs of a part have to know of the words of a bucket: their probabilities, and the tables of their
        restaurants as contexts."""
        row, = state.to_pylist()
        m, u, t = (unpacked(row[x], row["size"]) for x in ("m", "u", "t"))
        p, out = seating.probability(m, t, np.frombuffer(row["h"])), []
        for r in asked.to_pylist():
            at = unpacked_steps(r["ids"], r["size"]).astype(np.int64)
            out.append({"part": r["part"], "bucket": r["bucket"], "size": r["size"], "ids": r["ids"], "u": packed(u[at]), "p": p[at].tobytes()})
        return made(out, arrow_schema(REPLIES))

    return run


def draw_pairs(plan: Plan, discount: float, sweep: int):
    def run(replies: pa.Table, pairs: pa.Table) -> pa.Table:
        """One sweep over the pairs of a part: drawn to tables given the words' probabilities of the last sweep."""
        row, = pairs.to_pylist()
        part, n = row["part"], row["size"]
        if not n:
            return made([{"part": part, "size": 0, "t": b""}], arrow_schema(TALLIES))
        known = rows_of(replies, "bucket")
        numbers = np.concatenate([unpacked_steps(r["ids"], r["size"]).astype(np.int64) + plan.offsets[r["bucket"]] for r in known])
        held = np.concatenate([unpacked(r["u"], r["size"]) for r in known]).astype(np.int64)
        p = np.concatenate([np.frombuffer(r["p"]) for r in known])
        keys = unpacked_steps(row["keys"], n, plan.scramble.low[part])
        u, w = plan.sides(keys)
        order = (STRENGTH + discount * held[np.searchsorted(numbers, u)]) * p[np.searchsorted(numbers, w)]
        t = tables(unpacked(row["t"], n).astype(np.int64), order, discount, keys, 2_000_003 * sweep)
        return made([*plan.tallies(part, u, w, t, False), {"part": part, "size": n, "t": packed(t)}], arrow_schema(TALLIES))

    return run


ANSWERS = "block int, bucket int, part int, size int, ids binary, c binary, t binary, u binary, p binary, q binary"


def pairs_to_blocks(plan: Plan):
    def run(asked: pa.Table, drawn: pa.Table) -> pa.Table:
        """The count of each pair of a block, and its tables added up over the samples."""
        if not asked.num_rows:
            return made([], arrow_schema(ANSWERS))
        given = rows_of(asked, "block")
        _, which, c = counted_pairs(plan, given)
        samples = drawn.to_pylist()
        t = np.where(c == 1, len(samples), 0)
        for r in samples:
            t[c > 1] += unpacked(r["t"], r["size"]).astype(np.int64)
        out, at = [], 0
        for r in given:
            own = which[at:at + r["size"]]
            out.append({"block": r["block"], "part": r["part"], "size": r["size"], "c": packed(c[own]), "t": packed(t[own])})
            at += r["size"]
        return made(out, arrow_schema(ANSWERS))

    return run


def words_to_blocks(get_samples):
    def run(asked: pa.Table, states: pa.Table) -> pa.Table:
        """The count of each word of a block and, sample by sample, the tables of its restaurant and its probability; a
        word that was never met has (in q) the probability of its letters. Those of words met travel in single precision."""
        given, known, rows = rows_of(asked, "block"), rows_of(states, "sweep"), []
        samples = get_samples()
        new = [listed(r["words"]) for r in given]
        fresh = [s.new_table() * letters.probability([w for x in new for w in x]) for s, letters in samples]
        c = np.append(0, unpacked(known[0]["c"], known[0]["size"]))
        u = [np.append(0, unpacked(r["u"], r["size"])) for r in known]
        p = [np.append(0, s.probability(unpacked(r["m"], r["size"]), unpacked(r["t"], r["size"]), np.frombuffer(r["h"])))
             for r, (s, _) in zip(known, samples)]
        at = 0
        for r, own in zip(given, new):
            ids = unpacked(r["ids"], r["size"]).astype(np.int64)
            rows.append({"block": r["block"], "bucket": r["bucket"], "size": r["size"], "ids": r["ids"], "c": packed(c[ids]),
                         "u": packed(np.concatenate([x[ids] for x in u])), "p": np.stack([x[ids] for x in p]).astype(np.float32).tobytes(),
                         "q": np.stack([x[at:at + len(own)] for x in fresh]).tobytes()})
            at += len(own)
        return made(rows, arrow_schema(ANSWERS))

    return run


def score_block(plan: Plan, discount: float, samples: list[Seating], base_total: float, schema_names: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a block's texts."""
        rows = answers.to_pylist()
        words = sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])
        pairs = sorted((r for r in rows if r["part"] is not None), key=lambda r: r["part"])
        flat, before, owner, pair, keys = plan.laid_out(docs, words)
        c = np.concatenate([unpacked(r["c"], r["size"]) for r in words]).astype(np.int64)
        u = np.concatenate([unpacked(r["u"], len(samples) * r["size"]).reshape(len(samples), -1) for r in words], axis=1)
        p = np.concatenate([np.frombuffer(r["p"], np.float32).reshape(len(samples), -1) for r in words], axis=1).astype(np.float64)
        p[:, c == 0] = np.concatenate([np.frombuffer(r["q"]).reshape(len(samples), -1) for r in words], axis=1)
        own, distinct = np.zeros(len(flat)), np.unique(keys, return_inverse=True)[1]
        if len(keys):
            of = [np.concatenate([unpacked(r[x], r["size"]) for r in pairs])[distinct] for x in ("c", "t")]
            own[pair] = of[0] - discount * (of[1] / len(samples))
        own /= STRENGTH + c[before]
        rest, one_word = np.zeros(len(flat)), np.zeros(len(flat))
        for s, tabled, prob in zip(samples, u, p):
            back = ((STRENGTH + discount * tabled) / (STRENGTH + c))[before]
            rest += back * prob[flat]
            one_word += back * np.where(c > 0, prob, s.unseen())[flat]

        def summed(v):
            return pa.array(np.bincount(owner, weights=v, minlength=docs.num_rows))

        base = np.log10((c + 0.1) / base_total)
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(np.bincount(owner, minlength=docs.num_rows)),
                         pa.array(np.bincount(owner, weights=(c > 0)[flat], minlength=docs.num_rows).astype(np.int64)), summed(base[flat]),
                         summed(np.log10(own + one_word / len(samples))), summed(np.log10(own + rest / len(samples)))], names=schema_names)

    return run


def grouped(df: DataFrame, by: str, groups: int):
    """Groups in at least as many partitions as there are groups; of few, hardly any fall together."""
    return df.repartition(max(groups, min(4 * groups, 48)), by).groupBy(by)


def letter_code(vocabulary: DataFrame) -> np.ndarray:
    n = np.zeros(256, np.int64)
    for r in vocabulary.select("words").mapInArrow(byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        n[r["byte"]] = r["n"]
    code = np.full(256, OTHER, np.int64)
    code[np.argsort(-n, kind="stable")[: OTHER - 1]] = np.arange(1, OTHER)
    return code


def learn(vocabulary: DataFrame, tallies: DataFrame, plan: Plan, discount: float, groups: int) -> tuple[list, list]:
    """Gibbs sweeps over pairs, words and letters, from the longest contexts on: each is drawn to tables given the
    probabilities that the last sweep left, and its tables are the customers of its parent. Pairs are drawn in their
    parts and words in their buckets; letters' counts are added up before they are sent on, and there are at most
    LETTERS ** (DEPTH + 1) of them. Returns, of the samples: (seating, letters, words), and the pairs' draws."""
    spark = vocabulary.sparkSession
    code = letter_code(vocabulary)
    asked, pairs = tallies.filter("not single").select("part", "bucket", "size", "ids"), tallies.filter("keys is not null").select("part", "size", "keys", "t")
    given = ["bucket", "single", "size", "ids", "m", "u"]
    state, drawn, before, letters, levels, samples, draws = vocabulary, tallies, None, None, [], [], []
    for sweep in range(SWEEPS + 1):
        if sweep:
            replies = grouped(asked, "bucket", groups).cogroup(grouped(state, "bucket", groups)).applyInArrow(reply_to_parts(before), REPLIES)
            drawn = stage(grouped(replies, "part", groups).cogroup(grouped(pairs, "part", groups)).applyInArrow(
                draw_pairs(plan, discount, sweep), TALLIES), "lm-draws")
        seats = stage(grouped(drawn.filter("bucket is not null").select(*given), "bucket", groups).cogroup(grouped(state, "bucket", groups)).applyInArrow(
            seat_words(before, sweep), SEATS), "lm-seats")
        customers, tabled, one, two = (x or 0 for x in seats.agg(*[F.sum(x) for x in ("customers", "tables", "one", "two")]).first())
        if before is None:
            words_discount = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
        got = seats.select("words", "t").mapInArrow(letter_counts(code), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas().sort_values("gram")
        letters, levels = spelling(got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64), letters, levels, 31 * sweep)
        done = state if sweep and sweep - 1 <= BURN else None
        state = stage(seats.mapInArrow(with_letters(sent(spark, Letters(letters, code))), SEATS + ", h binary, letters double"), "lm-words")
        before = Seating(customers, tabled, words_discount, state.agg(F.sum("letters")).first()[0] or 0.0)
        discard(seats, *([done] if done else []), *([drawn] if sweep and sweep <= BURN else []))
        if sweep > BURN:
            samples.append((before, Letters(letters, code), state.withColumn("sweep", F.lit(sweep))))
            draws.append(drawn.filter("bucket is null").select("part", "size", "t"))
    return samples, draws


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Every row of docs (doc_id, text, others) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelled_score and perplexity (10 to the minus score per token), learned from the rows that are not held out.

    score is over the words of the training texts and one more, "some other word", as base_score is: a word not met in
    training has the probability of all such words together, which is what the letters leave besides the words met.
    spelled_score is over all words there can be: such a word has the probability of its own letters. Both go by the
    word before; before the first word of a text is an end.

    Tokens are the words, A-Z lower-cased, and an end for each text; a null text is empty and has its end alone. With
    nothing to learn from, all words are spelled by uniform letters and base_score is that of no counts. Repeated rows
    count repeatedly; a null id is one like any other. An empty table gives an empty result.

    Texts are dealt into blocks by a hash, distinct words into buckets and distinct pairs of words into parts. A block
    sends its distinct words to the buckets, which number and count them, then its distinct pairs of numbers to the
    parts, and in the end fetches from both what it needs to score its texts; so a word or a pair as frequent as may be is
    one entry per block. Words are told apart by their bytes where they are counted, and by 64-bit hashes within a block;
    pairs are told apart exactly. The driver holds a number per bucket and the letters' table.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size, = base.agg(F.sum(F.octet_length("text"))).first()
    blocks, groups = (size or 0) // BLOCK_BYTES + 1, (size or 0) // GROUP_BYTES + 1
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    kept = dealt.select("doc_id", "held_out").schema
    schema = T.StructType().add("block", "integer").add("bucket", "integer").add("size", "integer").add("words", "binary").add("n", "binary")
    schema = T.StructType([*schema.fields, *(T.StructField(f.name, f.dataType) for f in kept.fields)]).add("tokens", "binary")
    read = stage(grouped(dealt, "block", blocks).applyInArrow(block_words(groups), schema), "lm-blocks")
    release(spark)
    texts = read.filter("tokens is not null").select("block", "doc_id", "held_out", "tokens")
    numbered = stage(grouped(read.filter("words is not null").select("block", "bucket", "size", "words", "n"), "bucket", groups).applyInArrow(
        bucket_words, VOCABULARY), "lm-vocabulary")
    vocabulary, ids = numbered.filter("block is null").select("bucket", "size", "words", "c"), numbered.filter("block is not null").select("bucket", "block", "size", "words", "ids")
    sizes, total = np.zeros(groups, np.int64), 0
    for r in numbered.filter("block is null").select("bucket", "size", "total").collect():
        sizes[r["bucket"]] = r["size"]
        total += r["total"]
    distinct = int(sizes.sum())
    plan = Plan(np.append(0, np.cumsum(sizes)), Scramble(max(1, distinct.bit_length()), groups))
    pairs = stage(grouped(texts, "block", blocks).cogroup(grouped(ids.select("bucket", "block", "size", "ids"), "block", blocks)).applyInArrow(
        block_pairs(plan), PAIRS), "lm-pairs")
    release(spark)
    tallies = stage(grouped(pairs, "part", groups).applyInArrow(part_pairs(plan), TALLIES), "lm-tallies")
    release(spark)
    one, two = (x or 0 for x in tallies.agg(F.sum("one"), F.sum("two")).first())
    discount = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    samples, draws = learn(vocabulary, tallies, plan, discount, groups)
    states, drawn = reduce(DataFrame.union, [w for _, _, w in samples]), reduce(DataFrame.union, draws)
    pair_answers = stage(grouped(pairs, "part", groups).cogroup(grouped(drawn, "part", groups)).applyInArrow(pairs_to_blocks(plan), ANSWERS), "lm-answers")
    discard(pairs, tallies)
    release(spark)
    answers = pair_answers.union(grouped(ids, "bucket", groups).cogroup(grouped(states, "bucket", groups)).applyInArrow(
        words_to_blocks(sent(spark, [(s, x) for s, x, _ in samples])), ANSWERS))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "spelled_score"]
    schema = T.StructType(kept.fields).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double").add("spelled_score", "double")
    scored = grouped(texts, "block", blocks).cogroup(grouped(answers, "block", blocks)).applyInArrow(
        score_block(plan, discount, [s for s, _, _ in samples], total + 0.1 * (distinct + 1), names), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score", "spelled_score", F.expr("pow(10, -score / n_tokens)").alias("perplexity"))


def scored_documents(docs: DataFrame) -> DataFrame:
    return score(docs, crc_remainder(docs["doc_id"], 10) == 0)

"""Operator 10: byte-level BPE by ranked merges, and decoding by joining the tokens' bytes."""

import base64
import heapq
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqguard.llm.stage import sent

#: Bytes of text encoded at once in a task, and bytes of pieces and their tokens that a task remembers.
CHUNK, REMEMBERED = 1 << 18, 48 << 20
#: What a remembered piece takes besides its characters and tokens, in bytes.
EACH = 200
#: Pieces beyond so many bytes are merged one by one with a queue instead of side by side.
LONG = 256
NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """Ranked tokens, and for each pair of tokens that joins to a token, that token (sorted by the pair)."""
    pattern: str
    tokens: list[bytes]
    single: np.ndarray
    pairs: np.ndarray
    joined: np.ndarray

    @staticmethod
    def read(path: str, pattern: str) -> "Vocabulary":
        """A rank file: per line a token in base64 and its rank; the ranks are 0, 1, 2, ..."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError(f"ranks of {path} are not 0 to {len(tokens) - 1}")
        found = {}
        for t in tokens:
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    found[a * len(tokens) + b] = ranks[t]
        pairs = np.array(sorted(found), dtype=np.int64)
        return Vocabulary(pattern, tokens, np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32), pairs,
                          np.array([found[p] for p in pairs.tolist()], dtype=np.int32))


class Encoder:
    """Encodes texts; the tokens of a distinct piece are found once and remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pattern = vocabulary, regex.compile(vocabulary.pattern)
        self.sizes = np.array([len(t) for t in vocabulary.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.size = 0
        self.flat = np.empty(0, np.uint32)
        self.count = self.begin = self.hits = np.empty(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair joins to, or NONE."""
        key = left * np.int64(len(self.v.tokens)) + right
        i = np.minimum(np.searchsorted(self.v.pairs, key), len(self.v.pairs) - 1)
        return np.where(self.v.pairs[i] == key, self.v.joined[i], NONE)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces, one after the other, and how many each has. All pieces go side by side: in each round the
        pair of least rank (the leftmost at ties) of every piece is joined, until no piece has one."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.v.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        rank = np.full(len(ids), NONE, dtype=np.int32)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside] = self.rank(ids[inside], ids[inside + 1])
        done_ids, done_piece = [], []
        while len(ids):
            start = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            size = np.diff(np.append(start, len(ids)))
            least = np.minimum.reduceat(rank, start)
            alive = np.repeat(least != NONE, size)
            done_ids.append(ids[~alive])
            done_piece.append(piece[~alive])
            if not alive.any():
                break
            # the first place of the least rank in each piece that goes on
            hit = np.flatnonzero(alive & (rank == np.repeat(least, size)))
            hit = hit[np.append(True, piece[hit[1:]] != piece[hit[:-1]])]
            ids[hit] = rank[hit]
            alive[hit + 1] = False
            moved = np.cumsum(alive) - 1
            ids, piece, rank, at = ids[alive], piece[alive], rank[alive], moved[hit]
            for side in (at, at[at > 0] - 1):  # pairs with the new token on the left, then on the right
                pair = np.minimum(side + 1, len(ids) - 1)
                same = (side + 1 < len(ids)) & (piece[side] == piece[pair])
                rank[side] = np.where(same, self.rank(ids[side], ids[pair]), NONE)
        if not done_ids:
            return np.empty(0, np.uint32), np.zeros(len(pieces), np.int64)
        piece = np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return np.concatenate(done_ids)[order].astype(np.uint32), np.bincount(piece, minlength=len(pieces))

    def merged_long(self, piece: bytes) -> np.ndarray:
        """One long piece, with a queue of its pairs by rank and place."""
        ids = self.v.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        whole = len(ids)
        pair = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        queue = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(pair) if r != NONE]
        heapq.heapify(queue)

        def offer(i):
            j = after[i]
            if j < whole:
                r = int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
                if r != NONE:
                    heapq.heappush(queue, (r, i, ids[i], ids[j]))

        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= whole or ids[j] != b:
                continue  # one of them was joined meanwhile
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < whole:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], dtype=np.uint32)

    def remember(self, pieces: list[str], flat: np.ndarray, count: np.ndarray):
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.hits = np.concatenate([self.hits, np.zeros(len(count), np.int64)])
        self.flat = np.concatenate([self.flat, flat])
        self.known.update(zip(pieces, range(len(self.known), len(self.begin))))
        self.size += sum(map(len, pieces)) + 4 * len(flat) + EACH * len(pieces)

    def learn(self, pieces: list[str]):
        raw = [(p, p.encode()) for p in pieces]
        short = [x for x in raw if len(x[1]) <= LONG]
        self.remember([p for p, _ in short], *self.merged([b for _, b in short]))
        for p, b in raw:
            if len(b) > LONG:
                tokens = self.merged_long(b)
                self.remember([p], tokens, np.array([len(tokens)]))

    def make_room(self):
        """Keeps pieces that came up again and again, in at most half of what fits."""
        keep, size = [], 0
        for p, i in self.known.items():
            if self.hits[i] > 2 and size < REMEMBERED // 2:
                keep.append((p, i))
                size += len(p) + 4 * int(self.count[i]) + EACH
        at = np.array([i for _, i in keep], dtype=np.int64)
        flat, count = runs(self.flat, self.begin[at], self.count[at]), self.count[at]
        self.forget()
        self.remember([p for p, _ in keep], flat, count)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers."""
        pieces = [self.pattern.findall(t) for t in texts]
        every = [p for ps in pieces for p in ps]
        if self.size > REMEMBERED:
            self.make_room()
        new = list(dict.fromkeys(p for p in every if p not in self.known))
        if new:
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        self.hits += np.bincount(which, minlength=len(self.hits))
        count = self.count[which]
        ids = runs(self.flat, self.begin[which], count).astype("<u4")
        ends = np.append(0, np.cumsum(count))[np.cumsum([0, *map(len, pieces)])]
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        return runs(self.bytes, self.starts[i], self.sizes[i]).tobytes()


def runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of each run, one after the other."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def chunks(column, size_of, limit: int = CHUNK):
    """Row ranges of a column whose values have about `limit` bytes together."""
    begin, total = 0, 0
    for i in range(len(column)):
        total += size_of(column[i])
        if total > limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(column):
        yield begin, len(column)


def with_column(docs: DataFrame, source: str, name: str, type_: str, work) -> DataFrame:
    """docs with a column made from another by work(values) on parts of a batch; a column of that name is replaced."""
    names = [c for c in docs.columns if c != name]
    schema = docs.select(*names, F.lit(None).cast(type_).alias(name)).schema
    value = pa.binary() if type_ == "binary" else pa.string()

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            for a, b in chunks(column, lambda v: len(v.as_buffer() or b"") if v.is_valid else 0):
                part = batch.slice(a, b - a)
                made = pa.array(work(column.slice(a, b - a).to_pylist()), value)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [made], names=[*names, name])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every row of docs (text and any others) -> the same with ids: the tokens as little-endian 32-bit integers.

    Each match of the pattern is encoded separately; there are no special tokens. A null or empty text has no tokens.
    """
    encoder = sent(docs.sparkSession, Encoder(vocabulary))
    return with_column(docs, "text", "ids", "binary", lambda texts: encoder().encode([t or "" for t in texts]))


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows with ids (and any others) -> the same with decoded: the bytes of the tokens in a row; of null ids, none."""
    encoder = sent(rows.sparkSession, Encoder(vocabulary))
    return with_column(rows, "ids", "decoded", "binary", lambda ids: [encoder().decode(x or b"") for x in ids])


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every row of docs (doc_id, text, others): doc_id, n_tokens and the SHA-256 of the ids and of the
    decoded bytes. Both happen in one step, so a task has one worker, and only the digests leave it.

    A null or empty text has no tokens and the digests of nothing. Long texts are encoded whole; rows that repeat give
    equal rows; a null doc_id is kept; an empty table gives an empty result. Other columns are not read.
    """
    docs, v = docs.select("doc_id", "text"), Vocabulary.read(path, pattern)
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    encoder = sent(docs.sparkSession, Encoder(v))

    def run(batches):
        e = encoder()
        for batch in batches:
            column = batch.column(1)
            for a, b in chunks(column, lambda x: len(x.as_buffer() or b"") if x.is_valid else 0):
                ids = e.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids]),
                     pa.array([sha256(e.decode(x)).hexdigest() for x in ids])], names=schema.names)
        e.forget()  # a worker goes on to other jobs

    return docs.mapInArrow(run, schema)

"""Operator 11: where the tokens of two tokenizers end together, by a galloping intersection of their end offsets."""

import hashlib
import os
import re
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqguard.llm.bpe import chunks, runs
from reqguard.llm.stage import sent, stage

#: Distinct parts of texts whose alignment a task remembers, in bytes of what is kept, and bytes of text aligned at once.
REMEMBERED, CHUNK = 128 << 20, 1 << 20
#: What a remembered part takes besides its text, its groups and links, in bytes.
EACH = 260
#: Neither tokenizer has a token across a single space between two characters that are not white space.
SEAM = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"


def galloping(short, long) -> list[tuple[int, int]]:
    """Places (i, j) of the values that both ascending lists have. Each value of the shorter drives an exponential search
    into the longer, from where the last one ended, and a binary search in the span that it finds."""
    found, low, n = [], 0, len(long)
    for i, x in enumerate(short):
        high, step = low, 1
        while high < n and long[high] < x:
            low, high, step = high + 1, high + step, step * 2
        low = bisect_left(long, x, low, min(high, n))
        if low == n:
            break
        if long[low] == x:
            found.append((i, low))
            low += 1
    return found


def common_ends(a, b) -> list[tuple[int, int]]:
    """Places (in a, in b) of the offsets at which a token of each ends."""
    if len(a) <= len(b):
        return galloping(a, b)
    return [(i, j) for j, i in galloping(b, a)]


def byte_alphabet() -> dict[str, int]:
    """Byte-level entries write a byte that prints as the character of that number, and the others, in order, as 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(SPACE, " ").encode()


class Tokenizers:
    """A byte-level BPE of the tokenizers library (A) and a sentencepiece model (B), with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            self.a_json = f.read()
        with open(b_path, "rb") as f:
            self.b_model = f.read()
        self.load()
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        b = self.b
        self.b_bytes = [b"" if b.is_control(i) or b.is_unknown(i) else piece_bytes(b.id_to_piece(i), b.is_byte(i)) for i in range(b.get_piece_size())]
        # the seam holds for these tokenizers, or there is none
        inside = any(re.search("[^ ] ", x.decode(errors="replace")) for x in self.b_bytes)
        self.seam = SEAM if not inside and self.splits_before_spaces() else re.compile("(?!)")

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(self.a_json)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    def splits_before_spaces(self) -> bool:
        """A byte-level pre-tokenizer with its own pattern and no normalizer; a piece model that only adds a space."""
        from tokenizers import pre_tokenizers
        plain = isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) and self.a.normalizer is None and not self.a.pre_tokenizer.add_prefix_space
        return plain and self.b.encode("a  b ") == [*self.b.encode("a"), *self.b.encode(" b ")]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("a", "b")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.load()

    def pairs(self) -> np.ndarray:
        """All that can be linked, a * (number of B ids) + b, ascending: as both end at one byte of one text, the bytes of
        one end with the other's. So their number is bounded by the vocabularies, whatever the corpus."""
        found, n = set(), len(self.b_bytes)
        by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
        for known, tokens in zip(by_bytes, (self.a_bytes, self.b_bytes)):
            for i, t in enumerate(tokens):
                if t:
                    known.setdefault(t, []).append(i)
        for a, t in enumerate(self.a_bytes):
            found |= {a * n + b for k in range(len(t)) for b in by_bytes[1].get(t[k:], ())}
        for b, t in enumerate(self.b_bytes):
            found |= {a * n + b for k in range(1, len(t)) for a in by_bytes[0].get(t[k:], ())}
        return np.array(sorted(found), dtype=np.int64)


class Aligner:
    """Aligns texts part by part (between seams); a task remembers what the distinct parts have: facts (numbers of tokens
    of A, of B and of groups, and 1 if the bytes are not those of the text), the linked pairs, and the groups as text."""

    def __init__(self, tokenizers: Tokenizers):
        self.t, self.pairs = tokenizers, tokenizers.pairs()
        self.sizes = [np.array([len(x) for x in tokens], dtype=np.int64) for tokens in (tokenizers.a_bytes, tokenizers.b_bytes)]
        self.most = max(map(len, self.sizes))
        # a token's id with what follows it: a comma, a bar (the last of A in a group) or a semicolon (the last of B)
        self.names = [f"{i}{end}" for end in ",|;" for i in range(self.most)]
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)
        self.links = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.size = 0

    def tokens(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for space+part, and of B for the part (B adds the space)."""
        a = self.t.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
        return [x.ids for x in a], self.t.b.encode(parts, num_threads=1)

    def wrong(self, raw: list[bytes], tokens: list[list[int]], token_bytes: list[bytes]) -> np.ndarray:
        """Which parts' tokens do not join to their bytes."""
        get = token_bytes.__getitem__
        if b"".join(map(get, chain.from_iterable(tokens))) == b"".join(raw):
            return np.zeros(len(raw), bool)
        return np.array([b"".join(map(get, ids)) != r for ids, r in zip(tokens, raw)])

    def learn(self, parts: list[str]) -> None:
        """Aligns new parts, laid end to end as one text: the ends of both tokenizers' tokens are two ascending lists."""
        a, b = self.tokens(parts)
        raw = [b" " + p.encode() for p in parts]
        wrong = self.wrong(raw, a, self.t.a_bytes) | self.wrong(raw, b, self.t.b_bytes)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        if wrong.any():  # they have no groups
            a, b, raw = ([[] if w else v for v, w in zip(x, wrong)] for x in (a, b, raw))
        in_a, in_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, in_a), (b, in_b)))
        cuts = common_ends(np.cumsum(self.sizes[0][a]).tolist(), np.cumsum(self.sizes[1][b]).tolist())
        i, j = np.array(cuts, dtype=np.int64).reshape(-1, 2).T
        part = np.searchsorted(np.cumsum(in_a), i, side="right")
        groups = np.bincount(part, minlength=len(parts))
        links = np.searchsorted(self.pairs, a[i] * len(self.t.b_bytes) + b[j]).astype(np.uint32)
        shown = self.as_text(a, b, i, j, in_a + in_b)
        self.known.update(zip(parts, range(len(self.shown), len(self.shown) + len(parts))))
        self.shown += shown
        self.facts = np.concatenate([self.facts, np.column_stack([n_a, n_b, groups, wrong])])
        self.begin = np.concatenate([self.begin, len(self.links) + np.cumsum(groups) - groups])
        self.links = np.concatenate([self.links, links])
        self.size += sum(map(len, raw)) + sum(map(len, shown)) + 4 * len(links) + EACH * len(parts)

    def as_text(self, a, b, i, j, sizes) -> list[str]:
        """The groups of each part; the last semicolon stays. sizes: tokens of each part, of both kinds."""
        of_a, of_b = (np.diff(x, prepend=-1) for x in (i, j))  # tokens of each group
        at_a = np.arange(len(a)) + np.repeat(np.cumsum(of_b) - of_b, of_a)
        at_b = np.arange(len(b)) + np.repeat(np.cumsum(of_a), of_b)
        code = np.empty(len(a) + len(b), np.int64)
        a, b = a.copy(), b.copy()
        a[i] += self.most
        b[j] += 2 * self.most
        code[at_a], code[at_b] = a, b
        names, ends = list(map(self.names.__getitem__, code.tolist())), np.cumsum(sizes).tolist()
        return ["".join(names[x:y]) for x, y in zip([0, *ends], ends)]

    def parts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers under which the parts of all texts are known, one after the other, and where the texts begin."""
        if self.size > REMEMBERED:
            self.forget()
        cut = [self.t.seam.split(t) if t else [] for t in texts]
        every = list(chain.from_iterable(cut))
        new = [p for p in dict.fromkeys(every) if p not in self.known]
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, every), np.int64, len(every)), np.cumsum([0, *map(len, cut)])


def summed(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of runs of rows that begin at begins[:-1] and end before begins[1:]."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return total[begins[1:]] - total[begins[:-1]]


def of_texts(batch: pa.RecordBatch):
    """The texts of a batch in runs of bounded size, with where they begin and end."""
    column = batch.column(batch.schema.get_field_index("text"))
    for a, b in chunks(column, lambda v: len(v.as_buffer() or b"") if v.is_valid else 0, CHUNK):
        yield a, b, column.slice(a, b - a).to_pylist()


FACTS = ["n_a", "n_b", "n_groups"]


def aligned(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Documents (doc_id, text, others) -> doc_id, n_a, n_b, n_groups, groups_sha256 and links: the linked pairs in turn,
    each as its place in Tokenizers.pairs (32-bit little-endian integers)."""
    docs = docs.select("doc_id", "text")
    schema = docs.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in FACTS), F.lit("").alias("groups_sha256"),
                         F.lit(None).cast("binary").alias("links")).schema
    aligner = sent(docs.sparkSession, Aligner(tokenizers))

    def run(batches):
        al = aligner()
        for batch in batches:
            for first, last, texts in of_texts(batch):
                which, begins = al.parts(texts)
                facts = summed(al.facts[which], begins)
                right = (np.diff(begins) > 0) & (facts[:, 3] == 0)
                facts[~right] = 0
                count = al.facts[which, 2]
                links, ends = runs(al.links, al.begin[which], count).astype("<u4"), np.append(0, np.cumsum(count))[begins]
                shown = [hashlib.sha256("".join([al.shown[i] for i in which[x:y].tolist()])[:-1].encode()).hexdigest() if ok else ""
                         for ok, x, y in zip(right, begins, begins[1:])]
                linked = [links[x:y].tobytes() if ok else b"" for ok, x, y in zip(right, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(facts[:, i]) for i in range(3)),
                                                  pa.array(shown), pa.array(linked, pa.binary())], names=schema.names)
        al.forget()  # a worker goes on to other jobs

    return docs.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, n_pairs: int) -> DataFrame:
    """Rows of `aligned` -> pair, n: how many links of the corpus hold it. A task adds up what it reads, so a shuffle sees
    at most a row for each task and pair of the vocabularies that can end together."""
    def count(batches):
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            total += np.bincount(flat, minlength=n_pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": at, "n": total[at]})

    return rows.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_counts(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Documents (doc_id, text, others) -> a_id, b_id, n: how many links of the corpus hold the two. Texts that are null,
    empty or changed by a tokenizer have no tokens."""
    pairs, n_b = tokenizers.pairs(), len(tokenizers.b_bytes)
    known = docs.sparkSession.createDataFrame(pa.table({"pair": np.arange(len(pairs)), "a_id": pairs // n_b, "b_id": pairs % n_b}))
    return pair_counts(aligned(docs, tokenizers), len(pairs)).join(known, "pair").select("a_id", "b_id", "n")


def alignments(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Documents (text, others) -> the same rows with a_ids, b_ids (token ids) and groups: for each stretch between
    offsets where both tokenizers end a token, the first and last place in a_ids and in b_ids (differences of ranks).

    A null or empty text, or one whose joined tokens differ from space+text, has no tokens and no groups. Long texts are
    aligned whole; rows that repeat are aligned each; an empty table gives an empty result. A column of docs that has one
    of the three names is replaced; all others keep their values.
    """
    names = [c for c in docs.columns if c not in ("a_ids", "b_ids", "groups")]
    group = "struct<a_first:int,a_last:int,b_first:int,b_last:int>"
    schema = docs.select(*names, *(F.lit(None).cast(t).alias(c) for c, t in (("a_ids", "array<int>"), ("b_ids", "array<int>"), ("groups", f"array<{group}>")))).schema
    aligner = sent(docs.sparkSession, Aligner(tokenizers))
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("a_first", "a_last", "b_first", "b_last")]))

    def aligned(text, t):
        none = [], [], []
        if not text:
            return none
        (a,), (b,) = aligner().tokens([text])
        in_a, in_b, raw = [t.a_bytes[i] for i in a], [t.b_bytes[i] for i in b], b" " + text.encode()
        if b"".join(in_a) != raw or b"".join(in_b) != raw:
            return none
        groups, x, y = [], 0, 0
        for i, j in common_ends(list(accumulate(map(len, in_a))), list(accumulate(map(len, in_b)))):
            groups.append((x, i, y, j))
            x, y = i + 1, j + 1
        return a, b, groups

    def align(batches):
        t = aligner().t
        for batch in batches:
            for first, last, texts in of_texts(batch):
                a, b, groups = zip(*[aligned(x, t) for x in texts])
                made = [pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())),
                        pa.array([[dict(zip(("a_first", "a_last", "b_first", "b_last"), g)) for g in gs] for gs in groups], kind)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + made, names=[*names, "a_ids", "b_ids", "groups"])

    return docs.mapInArrow(align, schema)


def alignment_digests(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Documents (doc_id, text, others) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a token of A and one of B that end at the same byte. n_best counts the links whose pair is linked as often
    as any of its B id; count_sum adds up the counts of the links' pairs. groups_sha256 digests the groups as text. The
    counts of pairs that go to the driver and to the tasks are at most those of the vocabularies' possible pairs.

    Texts that are null, empty, or whose joined tokens differ from space+text have zeros and an empty digest. Equal texts
    have equal results; a null doc_id is kept; long texts are aligned whole; an empty table gives an empty result. Other
    columns are not read.
    """
    pairs, n_b = tokenizers.pairs(), len(tokenizers.b_bytes)
    rows = stage(aligned(docs, tokenizers), "alignments")
    count = np.zeros(len(pairs), np.int64)
    for r in pair_counts(rows, len(pairs)).toLocalIterator():  # bounded by the vocabularies
        count[r["pair"]] = r["n"]
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, pairs % n_b, count)
    shared = sent(docs.sparkSession, (count, count == most[pairs % n_b]))
    kept = ["doc_id", *FACTS, "groups_sha256"]
    schema = rows.select(*kept, *(F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum"))).schema

    def score(batches):
        count, is_best = shared()
        for batch in batches:
            links = batch.column(len(kept)).to_pylist()
            flat = np.frombuffer(b"".join(links), "<u4")
            ends = np.cumsum([0, *(len(x) // 4 for x in links)])
            sums = [np.diff(ends), summed(is_best[flat], ends), summed(count[flat], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *map(pa.array, sums)], names=schema.names)

    return rows.select(*kept, "links").mapInArrow(score, schema)

"""Operator 13: token ids in raw shard files, found again through a minimal perfect hash of the documents' keys."""

import os
import re
import sys
import unicodedata
import uuid
from array import array
from dataclasses import dataclass
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqguard.llm.align import byte_alphabet
from reqguard.llm.bpe import chunks
from reqguard.llm.stage import sent, stage
from reqguard.session import shared_dir

#: Bytes of text that go to one shard, what a row counts besides its text, bytes of text encoded at once, bytes of words that a task remembers with their ids.
SHARD, ROW, CHUNK, REMEMBERED = 48 << 20, 64, 1 << 20, 160 << 20
#: What a remembered word takes besides its letters and ids, in bytes.
EACH = 150
#: Keys in one part of the index, and bits of a level of its hash for each key that comes to it.
PART_KEYS, SPARSE = 8192, 2
#: Payload read from a shard at once.
READ = 8 << 20
#: What the word tokenizer's pattern counts as white space, but the marks \x1c to \x1f, at which Python splits too.
MARKS = ("\x1c", "\x1d", "\x1e", "\x1f")
WORD_SPACE = "[ \\t-\\r]+"
PUNCTUATION = frozenset(punctuation)


# Encoding

class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and has no token across it, so that words are encoded one by
    one and the distinct ones remembered."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        self.load()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = {t[-1] for t in self.specials}
        # plain words go to the model itself where that comes to the same
        probe = ["Word", "mot", "ÉTÉ", "ñandú", "Straße", "łódź", "a", "Ωmega"[1:]]
        whole = [x.ids for x in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]
        self.direct = True
        try:
            self.direct = [self.directly(w) for w in probe] == whole
        except Exception:  # a model of another kind
            self.direct = False

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(self.json)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tokenizer", "model", "known")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.load()

    def forget(self, keep=()):
        self.known = {w: self.known[w] for w in keep} if keep else {}
        self.size = sum(map(len, self.known)) + EACH * len(self.known)

    def raw(self, ids: list[int]) -> bytes:
        """Ids as little-endian unsigned integers."""
        a = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def words(self, text: str) -> list[str]:
        """Parts of the text at white space. ASCII capitals are made small first where the tokenizer would come to the
        same: the text is composed before and after, and has no special token."""
        small = text.encode().lower().decode()
        if small != text and not any(s in text or s in small for s in self.specials):
            if small.isascii() or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", small)):
                text = small
        if any(m in text for m in MARKS):
            return [w for w in re.split(WORD_SPACE, text) if w]
        return text.split()

    def parts(self, word: str) -> list[str]:
        """The word, or what comes before its last run of punctuation and that run, if a letter or digit stands between:
        the tokenizer's pattern always cuts there."""
        base = word.rstrip(punctuation)
        if len(base) == len(word) or not base or not (base[-1].isalpha() or base[-1].isdecimal()):
            return [word]
        if word[-1] in self.last and any(s in word for s in self.specials):
            return [word]
        return [base, word[len(base):]]

    def is_plain(self, word: str) -> bool:
        """Whether the normalizer only makes its letters small and the pattern leaves it whole: Latin letters that are
        composed and have one small form each."""
        return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word

    def directly(self, word: str) -> list[int]:
        """The ids of a plain word, from the tokenizer's model, which reads bytes as letters of its own."""
        small = word.lower()
        if not small.isascii():
            small = "".join(map(self.letters.__getitem__, small.encode()))
        return [t.id for t in self.model.tokenize(small)]

    def learn(self, new: list[str]) -> None:
        other = []
        for w in new:
            if self.direct and self.is_plain(w):
                self.known[w] = self.raw(self.directly(w))
            else:
                other.append(w)
        made = self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else []
        self.known.update(zip(other, [self.raw(x.ids) for x in made]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The raw ids of each text; none for null."""
        words = [self.words(t) if t else [] for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(words))
        met = [w for w in distinct if w not in self.known]
        parts = {w: self.parts(w) for w in met if w[-1] in PUNCTUATION}
        new = dict.fromkeys(w for w in met if w[-1] not in PUNCTUATION)
        new |= dict.fromkeys(p for p in chain.from_iterable(parts.values()) if p not in self.known)
        if new:
            self.learn(list(new))
        for w, ps in parts.items():
            if len(ps) > 1:
                self.known[w] = self.known[ps[0]] + self.known[ps[1]]
        self.size += sum(map(len, met)) + EACH * (len(parts) + len(new))
        get = self.known.__getitem__
        out = [b"".join(map(get, ws)) for ws in words]
        if self.size > REMEMBERED:
            self.forget(distinct)
            if self.size > REMEMBERED:
                self.forget()
        return out


# Files in the shared folder

def file_system(folder: str):
    """(file system, path) of a folder's URI, as executors open it."""
    from pyarrow import fs
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


@dataclass
class TokenStore:
    """shards: a file of raw ids for each range of ids of documents. directory: a row per document with its place.
    index: the hash, in parts. files: a row per shard."""
    spark: SparkSession
    folder: str
    width: int
    directory: DataFrame
    files: DataFrame
    index: DataFrame
    parts: int


def ordered(docs: DataFrame, shards: int) -> DataFrame:
    """Documents in ascending order of ids over the partitions (null ids last). Rows that share an id are in the order of
    their texts' hashes, so the rows of a frequent id fill as many partitions as they need."""
    by = [F.col("doc_id").asc_nulls_last(), F.col("_text"), F.col("_row")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return rows.repartitionByRange(shards, *by).sortWithinPartitions(*by).select("doc_id", "text")


def write_shards(docs: DataFrame, encoder: WordEncoder, end_id: int, folder: str) -> DataFrame:
    """A shard for each partition: the ids of its rows, one after the other, each row's followed by the end id ->
    shard, file, doc_id, begin, n (counted in ids), here (0, 1, ... for rows of the shard that share an id). A task that
    runs again writes another file; only rows of the attempt that counts name it."""
    encoder = sent(docs.sparkSession, encoder)
    schema = docs.select(F.lit(0).alias("shard"), F.lit("").alias("file"), "doc_id",
                         *(F.lit(0).cast("long").alias(c) for c in ("begin", "n", "here"))).schema

    def write(batches):
        e, out, at, before, here = encoder(), None, 0, b"", 0
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}.ids"
        end = e.raw([end_id])
        try:
            for batch in batches:
                ids, column = batch.column(0), batch.column(1)
                for a, b in chunks(column, lambda v: len(v.as_buffer() or b"") if v.is_valid else 0, CHUNK):
                    raw = [x + end for x in e.encode(column.slice(a, b - a).to_pylist())]
                    if out is None:
                        fs, path = file_system(folder)
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}")
                    out.write(b"".join(raw))
                    sizes = np.array([len(x) // e.width for x in raw], dtype=np.int64)
                    ends = at + np.cumsum(sizes)
                    at, copies = int(ends[-1]), []
                    for x in ids.slice(a, b - a).to_pylist():
                        before, here = x, here + 1 if x == before else 0
                        copies.append(here)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * (b - a), pa.int32()), pa.array([name] * (b - a)), ids.slice(a, b - a),
                                                      pa.array(ends - sizes), pa.array(sizes), pa.array(copies)], names=schema.names)
        finally:
            e.forget()  # a worker goes on to other jobs
            if out is not None:
                out.close()

    return docs.mapInArrow(write, schema)


def with_copies(places: DataFrame) -> DataFrame:
    """Turns here into copy: 0, 1, ... for all rows that share an id. Rows of an id are neighbours, so only ids that
    begin or end a shard can lie in several; for those, the rows in earlier shards are added."""
    edges = places.groupBy("shard").agg(F.min_by("doc_id", "begin").alias("first"), F.max_by("doc_id", "begin").alias("last"))
    ids = edges.select("shard", F.explode(F.array_distinct(F.array("first", "last"))).alias("doc_id"))
    several = stage(ids.withColumn("_in", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter("_in > 1"), "store-edges")
    if several.isEmpty():
        return places.withColumnRenamed("here", "copy")
    same = lambda a, b: (F.col(f"{a}.shard") == F.col(f"{b}.shard")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    sizes = places.alias("p").join(several.alias("s"), same("p", "s"), "left_semi").groupBy("shard", "doc_id").agg((F.max("here") + 1).alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select("shard", "doc_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return places.alias("p").join(carried.alias("c"), same("p", "c"), "left").select(
        "p.shard", "p.file", "p.doc_id", "p.begin", "p.n", (F.col("here") + F.coalesce("_before", F.lit(0))).alias("copy"))


# The hash

def mixed(k1: np.ndarray, k2: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of keys of 128 bits, another for each level (multiply, shift and add with the odd constants of the
    published splitmix generator)."""
    with np.errstate(over="ignore"):
        x = k1 + k2 * np.uint64(2 * level + 1) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """A minimal perfect hash by levels: on each, a key that is alone in its place has found it, the others go on to the
    next. A key's number is how many places up to its own are taken."""
    sizes: list[int]
    taken: np.ndarray

    @staticmethod
    def of(k1: np.ndarray, k2: np.ndarray) -> "PerfectHash":
        if len(np.unique(np.stack([k1, k2]), axis=1).T) != len(k1):
            raise ValueError("keys of the index repeat")
        sizes, taken = [], [np.zeros(0, bool)]
        while len(k1):
            size = SPARSE * len(k1) + 1
            at = (mixed(k1, k2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            taken.append(alone)
            k1, k2 = k1[~alone[at]], k2[~alone[at]]
        return PerfectHash(sizes, np.concatenate(taken))

    def __call__(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Numbers from 0 on, one for each key it was made of; -1 or any number for other keys."""
        rank, out, todo, base = np.cumsum(self.taken) - 1, np.full(len(k1), -1, np.int64), np.arange(len(k1)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mixed(k1[todo], k2[todo], level) % np.uint64(size)).astype(np.int64)
            here = self.taken[at]
            out[todo[here]] = rank[at[here]]
            todo, base = todo[~here], base + size
        return out


def key_hashes(rows: DataFrame, parts: int) -> DataFrame:
    """Two 64-bit hashes of a key and the part of the index that has it."""
    return rows.withColumn("_k1", F.xxhash64("doc_id", "copy")).withColumn("_k2", F.xxhash64(F.lit("key"), "copy", "doc_id")) \
               .withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), "_k1", "_k2"), F.lit(parts)).cast("int"))


def unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


INDEX = "part int, sizes array<int>, taken binary, n int, prints binary, shards binary, begins binary, counts binary"


def index_part(rows: pa.Table) -> pa.Table:
    """One part: its hash, and for each number the fingerprint of the key and the place of its payload."""
    k1, k2 = unsigned(rows["_k1"]), unsigned(rows["_k2"])
    h = PerfectHash.of(k1, k2)
    order = np.argsort(h(k1, k2))
    column = lambda name, kind: rows[name].to_numpy()[order].astype(kind).tobytes()
    return pa.table({"part": rows["_part"].slice(0, 1), "sizes": pa.array([h.sizes], pa.list_(pa.int32())), "taken": [np.packbits(h.taken).tobytes()],
                     "n": pa.array([len(k1)], pa.int32()), "prints": [k2[order].tobytes()], "shards": [column("shard", "<i4")],
                     "begins": [column("begin", "<i8")], "counts": [column("n", "<i8")]})


def looked_up(keys: pa.Table, part: pa.Table, names: list[str]) -> pa.Table:
    """Keys of one part with the place of their payloads; null for keys that the index lacks."""
    k1, k2 = unsigned(keys["_k1"]), unsigned(keys["_k2"])
    place = {"shard": np.zeros(len(k1), np.int32), "begin": np.zeros(len(k1), np.int64), "n": np.zeros(len(k1), np.int64)}
    absent = np.ones(len(k1), bool)
    if part.num_rows:
        one = part.slice(0, 1).to_pylist()[0]
        sizes = one["sizes"]
        h = PerfectHash(sizes, np.unpackbits(np.frombuffer(one["taken"], np.uint8), count=sum(sizes)).astype(bool))
        slot = h(k1, k2)
        prints = np.frombuffer(one["prints"], np.uint64)
        absent = (slot < 0) | (prints[slot] != k2)
        for name, source, kind in (("shard", "shards", "<i4"), ("begin", "begins", "<i8"), ("n", "counts", "<i8")):
            place[name] = np.frombuffer(one[source], kind)[slot]
    made = [pa.array(v, mask=absent) for v in place.values()]
    return pa.table([keys[c] for c in names] + made, names=[*names, *place])


# The store

def write_store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> TokenStore:
    """Encodes all documents (doc_id, text, others) with the tokenizer in the file and writes their ids to the shared
    folder, in ascending order of doc_id (null last), each document's followed by the end id; then builds the index.

    A null or empty text has the end id alone. Rows that share an id, or repeat, are kept: they are copies 0, 1, ... of
    it, in the order of hashes of their texts. Long texts are written whole. An empty table gives a store without shards.
    Other columns are not read. Ids take two bytes where the vocabulary allows, otherwise four.
    """
    spark, encoder = docs.sparkSession, WordEncoder(tokenizer)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    size, = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW)).first()
    shards = max(1, -(-(size or 0) // SHARD))
    places = stage(write_shards(ordered(docs, shards), encoder, end_id, folder), "store-places")
    totals = places.groupBy("shard", "file").agg(F.sum("n").alias("n_ids"), F.count(F.lit(1)).alias("n_rows"))
    # a row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = stage(totals.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "store-files")
    rows, = files.agg(F.sum("n_rows")).first()
    parts = max(1, -(-(rows or 0) // PART_KEYS))
    directory = stage(with_copies(places), "store-directory")
    index = stage(key_hashes(directory, parts).groupBy("_part").applyInArrow(index_part, INDEX), "store-index")
    return TokenStore(spark, folder, encoder.width, directory, files, index, parts)


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Distinct keys (doc_id, copy, others) -> the same with shard, begin and n, by one probe of the index each; null for
    keys that are not in the store. A probe reads a few bits and one fingerprint of 64 bits."""
    hashed = key_hashes(keys, store.parts)
    names = [c for c in keys.columns if c not in ("shard", "begin", "n")]
    schema = keys.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("n")).schema
    for f in schema.fields[len(names):]:
        f.nullable = True
    return hashed.groupBy("_part").cogroup(store.index.groupBy("part")).applyInArrow(lambda k, p: looked_up(k, p, names), schema)


def payloads(store: TokenStore, places: DataFrame) -> DataFrame:
    """Places (shard, begin, n, others) -> the same with start (ids of all documents before) and ids: little-endian 32-bit
    integers read from the shards. A task reads the ranges of its shards in order, neighbours together."""
    names = [c for c in places.columns if c not in ("shard", "begin", "n", "start", "ids")]
    placed = places.join(store.files.select("shard", "file", "base"), "shard").select(
        *names, "shard", "file", "begin", "n", (F.col("base") + F.col("begin")).alias("start"))
    shards = max(1, store.files.count())
    placed = placed.repartition(shards, "shard").sortWithinPartitions("shard", "begin")
    folder, width = store.folder, store.width
    schema = placed.select(*names, "start", "n", F.lit(None).cast("binary").alias("ids")).schema

    def read(batches):
        fs, path = file_system(folder)
        name, source = None, None
        for batch in batches:
            file, begin, n = (batch.column(batch.schema.get_field_index(c)) for c in ("file", "begin", "n"))
            file, begin, end = file.to_pylist(), begin.to_numpy(), begin.to_numpy() + n.to_numpy()
            first = 0
            while first < len(file):
                # rows that follow each other in the file, up to READ bytes or one row
                last = first + 1
                while last < len(file) and file[last] == file[first] and begin[last] == end[last - 1] and (end[last] - begin[first]) * width <= READ:
                    last += 1
                if file[first] != name:
                    name, source = file[first], fs.open_input_file(f"{path}/{file[first]}")
                raw = source.read_at(int(end[last - 1] - begin[first]) * width, int(begin[first]) * width)
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                cut = [ids[4 * (b - begin[first]):4 * (e - begin[first])] for b, e in zip(begin[first:last].tolist(), end[first:last].tolist())]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in (*names, "start", "n")] + [pa.array(cut, pa.binary())],
                                                 names=[*names, "start", "n", "ids"])
                first = last

    return placed.mapInArrow(read, schema)


def lookup(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Distinct keys (doc_id, copy, others) -> those the store has, with start, n and ids."""
    return payloads(store, locate(store, keys).filter("shard IS NOT NULL"))


def stored_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes all documents to a store, looks every one of them up and reads it back: doc_id, start, n_tokens (with the
    end id) and the CRC-32 of the ids as 32-bit integers. See write_store for nulls, repeats and empty tables."""
    store = write_store(docs, tokenizer, end_id)
    rows = lookup(store, store.directory.select("doc_id", "copy"))
    return rows.select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

"""Operator 3: suffix-array removal of byte strings that repeat an earlier document."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqguard.llm.stage import discard, release, stage
from reqguard.llm.text import carried, given_back

#: Bytes a repeated string has at least.
MATCH = 50
#: A suffix is kept if the gram it starts with has the least hash in some window of MATCH bytes; every window has one.
GRAM = 24
REACH = MATCH - GRAM
#: Bytes hashed at once in a task, and window starts of one document handled at once.
CHUNK, SEGMENT = 1 << 20, 1 << 22
#: Text bytes of a block of documents, and of a partition of suffixes.
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
LAST = 2 ** 63 - 1


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(data: bytes, starts: np.ndarray, sizes: np.ndarray):
    """Sampled suffixes of texts laid end to end: (text, place, first, last, key).

    Each window of MATCH bytes belongs to the suffix in it whose gram hashes least, the leftmost at ties; so equal
    windows belong to equal suffixes. first and last are how far before the suffix its windows start.
    """
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    none = np.empty(0, np.int64)
    if len(b) < MATCH:
        return none, none, none, none, none
    x = b[:-1] << np.uint64(8) | b[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    x = x[:-4] << np.uint64(32) | x[4:]  # the eight bytes from each place on
    n = len(b) - GRAM + 1
    h = mixed(mixed(mixed(x[:n]) ^ x[8:8 + n]) ^ x[16:16 + n])
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    width, full = 1, REACH + 1
    while 2 * width <= full:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < full:
        least = np.minimum(least[: len(least) - (full - width)], least[full - width:])
    owner = np.repeat(np.arange(len(starts)), sizes)[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + MATCH <= (starts + sizes)[owner])
    place = (least[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
    if not len(place):
        return none, none, none, none, none
    turn = np.flatnonzero(np.diff(place, prepend=-1))
    begin, end = inside[turn], inside[np.append(turn[1:], len(inside)) - 1]
    at = place[turn]
    text = owner[begin]
    return text, at - starts[text], at - begin, at - end, (h[at] >> np.uint64(16)).astype(np.int64)


def packed(place, first, last):
    return place << 10 | first << 5 | last


#: Keys from here on are not of grams: they spread suffixes that are known to be shared.
KNOWN = 1 << 62


def spread_known(key, ids, suffix):
    """A gram that a chunk has under two ids or more is known to be shared. Two rows without suffixes, of two of
    these ids, tell the other chunks; the chunk's own suffixes then go anywhere, so that a very frequent gram is two rows
    per chunk."""
    order = np.lexsort((ids, key))
    k, i = key[order], ids[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    count = np.diff(np.append(start, len(k)))
    twice = i[start] != i[start + count - 1]
    known = np.zeros(len(key), bool)
    known[order] = np.repeat(twice, count)
    tell = np.concatenate([start[twice], (start + count - 1)[twice]])
    anywhere = (mixed(suffix.astype(np.uint64) ^ mixed(ids.astype(np.uint64))) >> np.uint64(2)).astype(np.int64) | KNOWN
    return (np.concatenate([np.where(known, anywhere, key), k[tell]]), np.concatenate([ids, i[tell]]),
            np.concatenate([suffix, np.full(len(tell), -1)]))


def suffixes(batches):
    """Batches of (id, data) -> (key, id, suffix): every sampled suffix, its place packed with its windows' reach."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data = batch.column(1)
        pieces, owners, offsets, total = [], [], [], 0

        def flush():
            sizes = np.array([len(p) for p in pieces], dtype=np.int64)
            text, at, first, last, key = anchors(b"".join(pieces), np.cumsum(sizes) - sizes, sizes)
            at = at + np.array(offsets, dtype=np.int64)[text]
            rows = spread_known(key, ids[np.array(owners, dtype=np.int64)[text]], packed(at, first, last))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["key", "id", "suffix"])

        for i in range(len(ids)):
            whole = data[i].as_py()
            for o in range(0, max(1, len(whole) - MATCH + 1), SEGMENT):
                pieces.append(whole[o:o + SEGMENT + MATCH - 1])
                owners.append(i)
                offsets.append(o)
                total += len(pieces[-1])
                if total > CHUNK:
                    yield flush()
                    pieces, owners, offsets, total = [], [], [], 0
        if pieces:
            yield flush()


def shared(batches):
    """Suffixes in the order of their keys -> those whose key occurs under two ids or more. Of a key that is not known
    to be shared yet, only the rows of its one id are held."""
    key, known, held = None, False, None
    for batch in batches:
        k, ids, s = (batch.column(i).to_numpy() for i in range(3))
        if held is not None and len(held[0]):
            k, ids, s = (np.concatenate(x) for x in zip(held, (k, ids, s)))
        if not len(k):
            continue
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        count = np.diff(np.append(first, len(k)))
        twice = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        if known and k[0] == key:
            twice[0] = True
        emit = (np.repeat(twice, count) | (k >= KNOWN)) & (s >= 0)
        key, known = k[-1], bool(twice[-1])
        known = known or key >= KNOWN
        held = None if known else (k[first[-1]:], ids[first[-1]:], s[first[-1]:])
        yield pa.RecordBatch.from_arrays([pa.array(ids[emit]), pa.array(s[emit])], names=["id", "suffix"])


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size], one after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def ordered(docs: pa.Table):
    """Documents of a block by id and text hash, so that every pass sees the same order; bytes laid end to end."""
    ids, mark = docs.column("_sa_id").to_numpy(), docs.column("_sa_mark").to_numpy()
    order = np.lexsort((mark, ids))
    data = docs.column("_sa_data").take(pa.array(order)).to_pylist()
    sizes = np.array([len(x) for x in data], dtype=np.int64)
    return order, ids[order], mark[order], data, sizes, np.cumsum(sizes) - sizes


def first_rows(ids, mark, side: pa.Table):
    """Which documents are the first with their text: those named by a row of suffix -1."""
    s = side.column("suffix").to_numpy()
    named = set(zip(side.column("_sa_id").to_numpy()[s == -1].tolist(), side.column("_sa_mark").to_numpy()[s == -1].tolist()))
    return np.array([x in named for x in zip(ids.tolist(), mark.tolist())], dtype=bool)


CONTEXT = "context binary, id long, suffix long"


def contexts(docs: pa.Table, side: pa.Table) -> pa.Table:
    """The bytes around each shared suffix of a block that its windows span: the suffix, then what precedes it, backwards."""
    _, ids, mark, data, sizes, starts = ordered(docs)
    s = side.column("suffix").to_numpy()
    sid, s = side.column("_sa_id").to_numpy()[s >= 0], s[s >= 0]
    outs = []
    flat = np.frombuffer(b"".join(data), np.uint8)
    # documents that repeat an id are numbered in their order; every one of them takes the id's suffixes
    new = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.empty(0, bool)
    number = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0)) if len(ids) else np.empty(0, int)
    for k in range(int(number.max(initial=-1)) + 1):
        rows = np.flatnonzero((number == k) & first_rows(ids, mark, side))
        if not len(rows) or not len(s):
            continue
        i = np.minimum(np.searchsorted(ids[rows], sid), len(rows) - 1)
        hit = ids[rows][i] == sid
        d, x = rows[i[hit]], s[hit]
        place, first, last = x >> 10, x >> 5 & 31, x & 31
        fits = place + MATCH - last <= sizes[d]
        d, x, place, first, last = d[fits], x[fits], place[fits], first[fits], last[fits]
        at, right = starts[d] + place, MATCH - last
        size = right + first
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        forward = step < np.repeat(right, size)
        where = np.repeat(at, size) + np.where(forward, step, np.repeat(right, size) - step - 1)
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat[where].tobytes())])
        outs.append(pa.table({"context": binary, "id": pa.array(ids[d]), "suffix": pa.array(x | np.int64(k) << 48)}))
    return pa.concat_tables(outs) if outs else pa.table({"context": pa.array([], pa.binary()), "id": pa.array([], pa.int64()), "suffix": pa.array([], pa.int64())})


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes, padded to eights -> rows of big-endian words, which compare as the bytes do."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of words: sort by the first word, then only the rows that tie by the next one, and so on, as
    multikey quicksort does with letters."""
    order = np.argsort(words[:, 0], kind="stable")
    new = np.append(True, np.diff(words[order, 0]) != 0)
    for j in range(1, words.shape[1]):
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        own = order[tied]
        own = own[np.lexsort((words[own, j], group))]
        order[tied] = own
        w = words[order, j]
        new[1:] |= w[1:] != w[:-1]
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in the order shares with the one before it; -1 for the first."""
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    return np.append(-1, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]))


def repeats(right: np.ndarray, left: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each context, the windows (bit o: the one that starts o bytes before the suffix) that also occur under a smaller id.

    A window is a prefix of the suffix and a prefix of what precedes it, backwards. In the sorted suffixes, those that
    share the prefix are neighbours, cut where the common prefix is too short; and so for the other side.
    """
    out = np.zeros(len(ids), dtype=np.int64)
    if len(ids) < 2:
        return out
    by_right, by_left = multikey_order(words_of(right)), multikey_order(words_of(left))
    near_right, near_left = common_prefix(right, by_right), common_prefix(left, by_left)
    class_right, class_left = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for o in range(REACH + 1):
        own = np.flatnonzero((last <= o) & (o <= first))
        if len(own) < 2:
            continue
        class_right[by_right] = np.cumsum(near_right < MATCH - o)
        class_left[by_left] = np.cumsum(near_left < o)
        both = class_right[own] * (len(ids) + 1) + class_left[own]
        order = np.argsort(both, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(both[order]) != 0))
        least = np.repeat(np.minimum.reduceat(ids[own][order], start), np.diff(np.append(start, len(order))))
        hit = own[order][ids[own][order] > least]
        out[hit] |= np.int64(1) << np.int64(o)
    return out


def open_windows(x, masks: np.ndarray, edges: list[bytes]):
    """Windows of sorted contexts that other partitions may hold under a smaller id -> a batch per offset: id, suffix, the
    window's bit and its bytes.

    Contexts that share the part of a window right of the suffix's start follow each other; so one in another partition
    has all between, the first or last context of this partition (edges) too, in common with one in here.
    """
    right, left, first, last, ids, s = x
    for edge in {e[:GRAM] for e in edges}:
        near = np.flatnonzero((right[:, :GRAM] == np.frombuffer(edge, np.uint8)).all(axis=1))
        for o in range(REACH + 1):
            size = MATCH - o
            own = near[(last[near] <= o) & (o <= first[near]) & (masks[near] >> o & 1 == 0)]
            at = np.zeros(len(own), bool)
            for e in {e[:size] for e in edges if len(e) >= size}:
                at |= (right[own, :size] == np.frombuffer(e, np.uint8)).all(axis=1)
            own = own[at]
            if len(own):
                window = np.concatenate([left[own, :o][:, ::-1], right[own, :size]], axis=1)
                offsets = np.arange(len(own) + 1, dtype=np.int32) * MATCH
                binary = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(window.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(s[own]), pa.array(np.full(len(own), 1 << o, np.int64)), binary],
                                                 names=["id", "suffix", "windows", "open"])


RIGHT, LEFT = -(-MATCH // 8) * 8, -(-REACH // 8) * 8


def covered(batches):
    """Contexts in their order (then by id) -> (id, suffix, windows, open): the windows that a smaller id has too; and
    with their bytes as open, each in a row, those for which it takes other partitions to know.

    Suffixes of one gram are worked on together, across the bounds of batches. Of equal contexts, the one with the
    smallest id stands for all; the others repeat it whole, so a passage in very many documents takes no memory.
    """
    held = None

    def rows_of(batch):
        c = batch.column(0)
        offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1].astype(np.int64)
        flat = np.frombuffer(c.buffers()[2], np.uint8)
        ids, s = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        first, last = s >> 5 & 31, s & 31
        right, left = np.zeros((len(ids), RIGHT), np.uint8), np.zeros((len(ids), LEFT), np.uint8)
        n = MATCH - last
        for matrix, begin, size in ((right, offsets[:-1], n), (left, offsets[:-1] + n, first)):
            row = np.repeat(np.arange(len(ids)), size)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            matrix[row, step] = flat[np.repeat(begin, size) + step]
        return right, left, first, last, ids, s

    def out(ids, s, mask):
        found = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(s[found]), pa.array(mask[found]), pa.nulls(int(found.sum()), pa.binary())],
                                          names=["id", "suffix", "windows", "open"])

    def collapsed(x):
        """Rows that stand for equal contexts, and the windows of the others."""
        right, left, first, last, ids, s = x
        same = np.append(False, (right[1:] == right[:-1]).all(axis=1) & (left[1:] == left[:-1]).all(axis=1)
                         & (first[1:] == first[:-1]) & (last[1:] == last[:-1]))
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
        repeat = ids > ids[head]
        whole = (np.int64(2) << first[repeat]) - (np.int64(1) << last[repeat])
        return tuple(v[~repeat] for v in x), out(ids[repeat], s[repeat], whole)

    def context(x, i):
        right, left, first, last = (v[i] for v in x[:4])
        return right[:MATCH - last].tobytes() + left[:first].tobytes()

    def done(x, final):
        nonlocal begun
        right, left, first, last, ids, s = x
        masks = repeats(right, left, first, last, ids)
        yield out(ids, s, masks)
        if begun is None:
            begun = context(x, 0)
        yield from open_windows(x, masks, [begun] + [context(x, -1)] * final)

    waiting, rows, begun = [], 0, None

    def work(final):
        nonlocal held, waiting, rows
        parts = ([held] if held is not None else []) + waiting
        waiting, rows = [], 0
        x = tuple(np.concatenate(v) for v in zip(*parts))
        x, others = collapsed(x)
        yield others
        gram = x[0][:, :GRAM]
        cut = len(gram)
        if not final:
            cut = int(np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]).any(axis=1)))[-1]) if len(gram) else 0
        held = tuple(v[cut:] for v in x)
        if cut:
            yield from done(tuple(v[:cut] for v in x), final)

    for batch in batches:
        if batch.num_rows:
            waiting.append(rows_of(batch))
            rows += batch.num_rows
        if rows >= 50_000:
            yield from work(False)
    if waiting or held is not None:
        yield from work(True)


def cut_out(n_blocks, names, schema):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        order, ids, mark, data, sizes, starts = ordered(docs)
        is_first = first_rows(ids, mark, side)
        s = side.column("suffix").to_numpy()
        real = s >= 0
        sid, s, windows = side.column("_sa_id").to_numpy()[real], s[real], side.column("windows").to_numpy()[real]
        new = np.append(True, ids[1:] != ids[:-1])
        number = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        by = np.lexsort((s >> 48, sid))
        sid, s, windows = sid[by], s[by], windows[by]
        kept, removed, spans = [], [], []
        for i in range(len(ids)):
            text, n = data[i], int(sizes[i])
            runs = np.empty((0, 2), np.int64)
            if not is_first[i]:
                runs = np.array([[0, n]]) if n >= MATCH else runs
            else:
                a, b = np.searchsorted(sid, [ids[i], ids[i] + 1]) if ids[i] < LAST else (np.searchsorted(sid, LAST), len(sid))
                own = slice(a, b) if new[i] and (i + 1 == len(ids) or new[i + 1]) else np.arange(a, b)[s[a:b] >> 48 == number[i]]
                place, w = s[own] >> 10 & (1 << 38) - 1, windows[own]
                if len(w):
                    change = np.zeros(n + 1, np.int32)
                    for o in range(REACH + 1):
                        at = place[(w >> o & 1) == 1] - o
                        np.add.at(change, at, 1)
                        np.add.at(change, at + MATCH, -1)
                    inside = np.cumsum(change) > 0
                    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
                    runs = edge.reshape(-1, 2)
            removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in runs])
            bounds = [0, *runs.ravel().tolist(), n]
            kept.append(b"".join(text[x:y] for x, y in zip(bounds[::2], bounds[1::2])) if len(runs) else text)
        rows = docs.take(pa.array(order))
        cols = [rows.column(c) for c in names] + [pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, schema[0]), pa.array(kept, pa.binary())]
        return pa.table(cols, names=[*names, "n_bytes", "n_removed", "spans", "kept"])

    return run


MADE = ("n_bytes", "n_removed", "spans", "kept")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, others) -> the same with n_bytes, n_removed, spans (start and end of each maximal
    run removed, in bytes) and kept (the remaining bytes); columns of docs with these names are replaced.

    A byte goes if a string of MATCH bytes over it also starts in a row of smaller doc_id. A null text counts as empty; a
    null id as the largest. Rows that repeat an id do not count against each other. An empty table gives an empty result.

    1. Exact copies: only the row with the smallest id of each text goes on; the others go whole.
    2. Candidates: of all suffixes, those stay that start with the least gram of some window (about one in 14). Rows
       dealt by a hash of the gram show which grams occur under two ids; the others can't hold a repeat.
    3. Suffix array: sampled splitters (repartitionByRange) deal the candidates by their leading bytes, each partition
       is sorted and read in order, and groups go on across batches. Windows whose group may go on in another partition
       are compared once more, by the least id that each partition has. Bytes decide, not hashes.
    4. What was found goes back to the documents, which are dealt by a hash of the id.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in MADE]
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(*names, F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("_sa_id"),
                       F.xxhash64(text).alias("_sa_mark"), text.cast("binary").alias("_sa_data"))
    firsts = stage(base.groupBy(F.sha2("_sa_data", 256).alias("digest"))
                   .agg(F.min(F.struct("_sa_id", "_sa_mark")).alias("f"), F.max(F.octet_length("_sa_data")).alias("n"))
                   .select("f._sa_id", "f._sa_mark", "n"), "suffix-firsts")
    size = firsts.agg(F.sum("n")).first()[0] or 0
    blocks, parts = size // BLOCK_BYTES + 1, size // PART_BYTES + 1
    found = base.select("_sa_id", "_sa_data").mapInArrow(suffixes, "key long, id long, suffix long")
    candidates = stage(found.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(shared, "id long, suffix long"), "suffix-shared")
    del found
    release(spark)

    def in_blocks(df):
        return df.withColumn("_sa_block", F.pmod(F.xxhash64("_sa_id"), F.lit(blocks)).cast("int"))

    first_marks = firsts.select("_sa_id", "_sa_mark", F.lit(-1).cast("long").alias("suffix"))
    side = candidates.select(F.col("id").alias("_sa_id"), F.lit(0).cast("long").alias("_sa_mark"), "suffix").unionByName(first_marks)
    grouped = in_blocks(base)
    around = (grouped.select("_sa_block", "_sa_id", "_sa_mark", "_sa_data").groupBy("_sa_block")
              .cogroup(in_blocks(side).groupBy("_sa_block")).applyInArrow(contexts, CONTEXT))
    marked = around.repartitionByRange(parts, "context").sortWithinPartitions("context", F.expr("suffix & 1023"), "id") \
                   .mapInArrow(covered, "id long, suffix long, windows long, open binary")
    marked = stage(marked, "suffix-windows")
    discard(candidates)
    release(spark)
    across = marked.filter("open IS NOT NULL")
    least = across.groupBy("open").agg(F.min("id").alias("least"))
    across = across.join(least, "open").filter("id > least").select("id", "suffix", "windows")
    found = marked.filter("open IS NULL").select("id", "suffix", "windows").unionByName(across)
    back = found.select(F.col("id").alias("_sa_id"), F.lit(0).cast("long").alias("_sa_mark"), "suffix", "windows") \
                 .unionByName(first_marks.withColumn("windows", F.lit(0).cast("long")))
    span = "array<struct<start:bigint,end:bigint>>"
    schema = docs.select(*names, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                         F.lit(None).cast(span).alias("spans"), F.lit(None).cast("binary").alias("kept")).schema
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return grouped.groupBy("_sa_block").cogroup(in_blocks(back).groupBy("_sa_block")).applyInArrow(
        cut_out(blocks, names, (arrow_span,)), schema)


def removed_repeats(docs: DataFrame) -> DataFrame:
    """The digest of remove_repeats: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what remains as text and, if there is the column, its length as n_chars. A character of which a part is
    cut goes whole, and so does a document without a word left."""
    cut = remove_repeats(carried(docs, "doc_id", "text"))
    text = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    left = cut.withColumn("text", F.when(F.col("n_removed") > 0, text).otherwise(F.col("kept").cast("string")))
    return given_back(left.filter(F.col("text").rlike(r"[^ \t-\r]")), docs, text=F.col("text"), n_chars=F.length("text"))

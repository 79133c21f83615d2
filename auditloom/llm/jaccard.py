"""N-gram Jaccard join with a token-group matrix.

Documents are sets of ``WIDTH``-word shingles; two are linked if their Jaccard similarity is at least ``PERCENT`` per cent.
The join is exact (up to collisions of 64-bit hashes) and compares no document with all others:

1. Chunks of documents (see ``chunks``) learn in how many documents each of their shingles occurs. A shingle that occurs
   once links nothing. Shingles are ordered from rare to frequent; two linked documents share one among the first
   n - ceil(n * PERCENT / 100) + 1 of each. Documents whose first shingles are all their own are done.
2. Equal sets become one class. Classes are partitioned into groups of similar ones by their least shingle hash, at most
   ``GROUP`` and about ``GROUP_BYTES`` to a group: a larger one is split by a hash. Members of a group are compared in one task; the roots of what is
   linked are compared again, until the parts of a split group have met.
3. The token-group matrix has a row for every first shingle and an entry for every group that holds it; linked classes form
   groups of their own. Two groups of different components meet if they share a row. For a
   pair of groups the queries between them meet in one task: the size of a query's overlap with the other side's token
   union bounds its similarity to all of the group; only groups that qualify are opened and compared by set.
4. Links are stars of verified pairs; alternating large and small stars give the components.

Defined results: a null text is empty; an empty set has no links and its component is its own doc_id; documents with equal
sets are one class; repeated rows count as documents; a null doc_id never names a component unless all its members have
none; other columns are not read by the join; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.cut import written
from auditloom.llm import chunks as C
from auditloom.llm.common import mixed, per_group, unused

WIDTH, PERCENT = 4, 85
#: Average text bytes of a chunk: a task holds about twenty bytes per byte of text.
CHUNK_BYTES = 3 << 20
#: Classes of a group and, about, bytes of their tokens; a task compares two groups at most.
GROUP, GROUP_BYTES = 256, 16 << 20
#: Classes of a component that ask first, about so many.
SPOKESMEN = 4
COLUMNS = 2048
KEYS = "_chunk int, bucket int, keys binary, counts binary"
SETS = "doc_id long, n long, cls long, least long, firsts array<bigint>, tokens binary, text_md5 string"
LINKS = "a long, b long"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk:
    """Shingle sets of a chunk's documents: ``keys`` sorted, ``row`` and ``key`` (place among keys) of every entry."""

    def __init__(self, table: pa.Table, width: int):
        self.number = table.column("_chunk")[0].as_py()
        self.ids = table.column("doc_id").combine_chunks()
        body, at = C.bytes_of(table)
        word, row = C.words(LOWER[body], at)[:2]
        del body
        n_words = np.bincount(row, minlength=table.num_rows)
        h, ok = C.windows(word, row, width)
        hashes, rows = [h[ok]], [row[:len(h)][ok]]
        first = np.cumsum(n_words) - n_words
        for n in range(1, width):  # shorter documents: their whole sequence
            which = np.flatnonzero(n_words == n)
            x = np.full(len(which), np.uint64(n)) * C.NEXT
            for j in range(n):
                x = x * C.STEP + word[first[which] + j]
            hashes.append(mixed(x))
            rows.append(which)
        del h, ok, word, row
        self.keys, place = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        pair = np.unique(np.concatenate(rows) * max(1, len(self.keys)) + place)
        del place, rows
        self.row, self.key = np.divmod(pair, max(1, len(self.keys)))
        self.size = np.bincount(self.row, minlength=table.num_rows)


def ask_counts(bits: int, width: int):
    def ask(table: pa.Table) -> pa.Table:
        c = Chunk(table, width)
        n = np.minimum(np.bincount(c.key, minlength=len(c.keys)), 255).astype(np.uint8)
        low = ((c.keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        cuts = C.dealt(c.keys, bits)
        return pa.table({"_chunk": pa.array([c.number] * len(cuts), pa.int32()), "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
                         "keys": pa.array([low[s:e].tobytes() for _, s, e in cuts], pa.binary()),
                         "counts": pa.array([n[s:e].tobytes() for _, s, e in cuts], pa.binary())})
    return ask


def total_counts(table: pa.Table) -> pa.Table:
    """For every asked key a byte: eight times the binary logarithm of its documents, 0 for one that occurs once."""
    sets = [np.frombuffer(k.as_py(), "<u4") for k in table.column("keys")]
    keys, place = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.bincount(place, np.frombuffer(b"".join(x.as_py() for x in table.column("counts")), np.uint8), len(keys))
    code = np.minimum(255, np.floor(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)[place]
    at = np.cumsum([0, *map(len, sets)])
    rows = [k for k in range(len(sets)) if code[at[k]:at[k + 1]].any()]
    chunk, bucket = table.column("_chunk").to_pylist(), table.column("bucket").to_pylist()
    return pa.table({"_chunk": pa.array([chunk[k] for k in rows], pa.int32()), "bucket": pa.array([bucket[k] for k in rows], pa.int32()),
                     "round": pa.array([1] * len(rows), pa.int32()), "bits": pa.array([code[at[k]:at[k + 1]].tobytes() for k in rows], pa.binary())})


def describe(bits: int, width: int, percent: int):
    """Set size of every document; for those that may be linked class, least shingle, first and all shared shingles."""
    def use(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = [f.split(" ")[0] for f in SETS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        c = Chunk(table, width)
        code = np.zeros(len(c.keys), np.uint8)
        got = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()))
        for b, s, e in C.dealt(c.keys, bits):
            if b in got:
                code[s:e] = np.frombuffer(got[b], np.uint8)
        own = np.bincount(c.row, code[c.key] == 0, table.num_rows).astype(np.int64)
        n_first = c.size - -(-percent * c.size // 100) + 1
        open_ = (c.size > 0) & (own < n_first)
        # Only shared shingles of documents that may be linked are ordered: rare ones first, then by hash.
        entry = np.flatnonzero(open_[c.row] & (code[c.key] > 0))
        entry = entry[np.lexsort((c.key[entry], code[c.key[entry]], c.row[entry]))]
        token, row = c.keys[c.key[entry]], c.row[entry]
        at = np.searchsorted(row, np.arange(table.num_rows + 1))
        spread = mixed(c.keys)[c.key]
        edge = np.searchsorted(c.row, np.arange(table.num_rows))
        whole = np.add.reduceat(np.r_[spread, np.uint64(0)], edge) if len(edge) else spread
        twist = np.bitwise_xor.reduceat(np.r_[mixed(spread), np.uint64(0)], edge) if len(edge) else spread
        cls = mixed(whole * C.STEP + twist * C.NEXT + c.size.astype(np.uint64)).astype(np.int64)
        least, firsts, tokens = [], [], []
        for k in range(table.num_rows):
            if open_[k]:
                mine = token[at[k]:at[k + 1]]
                least.append(int(mine.min().astype(np.int64)))
                firsts.append(mine[:n_first[k] - own[k]].astype(np.int64))
                tokens.append(mine.astype("<u8").tobytes())
            else:
                least.append(None)
                firsts.append(None)
                tokens.append(None)
        return pa.table([c.ids, pa.array(c.size), pa.array(cls, mask=~open_), pa.array(least, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                         pa.array(tokens, pa.binary()), pa.array([hashlib.md5((t or "").encode()).hexdigest() for t in table.column("text").to_pylist()])], names)
    return use


def linked(cls: np.ndarray, size: np.ndarray, tokens: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Stars (member, least member) of the classes that links join. With two sides, only links between them count, and a
    class is compared only if its overlap with the other side's token union leaves it a chance."""
    two = len(set(side.tolist())) > 1
    if two:
        union = {s: np.unique(np.concatenate([t for t, x in zip(tokens, side) if x == s])) for s in set(side.tolist())}
        need = -(-percent * size // 100)
        keep = np.array([any(np.isin(t, u, assume_unique=True).sum() >= k for s, u in union.items() if s != x)
                         for t, x, k in zip(tokens, side, need)])
        if not keep.any():
            return []
        cls, size, side, tokens = cls[keep], size[keep], side[keep], [t for t, k in zip(tokens, keep) if k]
    m = len(cls)
    row = np.repeat(np.arange(m), [len(t) for t in tokens])
    _, place, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    new = np.cumsum(n > 1) - 1
    shared = n[place] > 1
    row, col = row[shared], new[place[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((m, m), np.float64)
    for s in range(0, int(new[-1]) + 1 if len(new) else 0, COLUMNS):
        a, b = np.searchsorted(col, [s, s + COLUMNS])
        block = np.zeros((m, COLUMNS), np.float32)
        block[row[a:b], col[a:b] - s] = 1
        both += block @ block.T
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    if two:
        link &= side[:, None] != side[None, :]
    label = np.arange(m)
    while True:
        least = np.where(link, label[None, :], m).min(axis=1)
        least = np.minimum(least, label)
        least = least[least]
        if (least == label).all():
            break
        label = least
    root = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(root, label, cls)
    return [(int(a), int(b)) for a, b in zip(cls, root[label]) if a != b]


def compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        found = [] if table.num_rows < 2 else linked(
            table.column("cls").to_numpy(), table.column("n").to_numpy(), [np.frombuffer(t.as_py(), "<u8") for t in table.column("tokens")],
            table.column("side").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
    return run


def grouped(classes: DataFrame) -> DataFrame:
    """Classes with ``grp``: the least shingle, split by a hash so that a group has about ``GROUP`` members, and fewer if
    their tokens are more than ``GROUP_BYTES``."""
    n = classes.groupBy("least").agg(F.count("*").alias("_n"), F.sum(F.octet_length("tokens")).alias("_b"))
    parts = F.least("_n", F.greatest(F.ceil(F.col("_n") / GROUP), F.ceil(F.col("_b") / GROUP_BYTES)))
    return classes.join(n, "least").withColumn("_parts", parts).drop("_b").withColumn(
        "grp", F.when(F.col("_parts") == 1, F.xxhash64("least")).otherwise(F.xxhash64("least", "_parts", F.pmod(F.xxhash64("cls"), F.col("_parts")))))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node that links reach) of every linked node, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                               F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.where("a != b").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def sets_of(docs: DataFrame, width: int, percent: int, chunk_bytes: int) -> DataFrame:
    texts, size = C.chunked(docs, chunk_bytes)
    bits = C.bucket_bits(size)
    counts = C.asked(texts, KEYS, ask_counts(bits, width)).groupBy("bucket").applyInArrow(per_group(total_counts), C.ANSWER)
    return written(C.told(texts, counts, SETS, describe(bits, width, percent)))


def meeting_groups(members: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with their group, and the pairs of groups that share a row of the token-group matrix.

    Members of one part (compared with one another before) that are linked form a group for each component, the others
    one group. Groups of one part or of one component do not meet again.
    """
    every = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    placed = written(members.join(every, members["cls"] == every["node"], "left").select(
        "cls", F.col("grp").alias("part"), F.col("root").alias("one"), F.xxhash64("grp", F.coalesce("root", F.lit(0))).alias("grp"), "firsts"))
    matrix = placed.select("part", "one", "grp", F.explode_outer("firsts").alias("token")).distinct()
    rows = matrix.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("token")
    asking = written(matrix.join(rows, "token"))
    a, b = asking.alias("a"), asking.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.grp") < F.col("b.grp")) & (F.col("a.part") != F.col("b.part"))
                   & ~F.coalesce(F.col("a.one") == F.col("b.one"), F.lit(False)))
    return placed.select("cls", "grp"), pairs.select(F.col("a.grp").alias("x"), F.col("b.grp").alias("y")).distinct()


def links_of(classes: DataFrame, percent: int, rounds: int = 4) -> DataFrame:
    """Stars of verified links that have the same components as all links; ``classes``: cls, n, least, firsts, tokens."""
    run = compare(percent)
    one = F.lit(0).alias("side")
    members = written(grouped(classes).select("cls", "n", "least", "grp", "_n", "_parts", "firsts", "tokens"))
    links = written(members.where("_n > 1").select("cls", "n", "tokens", "grp", one).groupBy("grp").applyInArrow(per_group(run), LINKS))
    # The parts of split groups meet through their roots; all of a family becomes one component without further pairs.
    roots = members.where("_parts > 1").select("cls", "n", "least", "tokens")
    for _ in range(rounds):
        roots = roots.join(links, roots["cls"] == links["a"], "left_anti")
        again = written(grouped(roots).select("cls", "n", "least", "tokens", "grp", "_parts"))
        more = written(again.select("cls", "n", "tokens", "grp", one).groupBy("grp").applyInArrow(per_group(run), LINKS))
        found, open_ = more.count(), again.where("_parts > 1").limit(1).count()
        links = written(links.unionByName(more))
        roots = again.where("_parts > 1").select("cls", "n", "least", "tokens")
        if not found or not open_:
            break
    # Then a few classes of every component, and all that have no link yet, ask for all: the components of one family,
    # whose least shingles differ, become one before the classes behind them ask each other.
    root = components(links)
    size = root.groupBy("root").agg(F.count("*").alias("size"))
    keep = root.join(size, "root").where(F.pmod(F.xxhash64("node", F.lit(5)), F.greatest(F.lit(1), F.floor(F.col("size") / SPOKESMEN))) != 0).select("node")
    few = members.join(keep, members["cls"] == keep["node"], "left_anti")
    root = components(_pairs(root).unionByName(across(few, root, run)))
    return _pairs(root).unionByName(across(members, root, run))


def _pairs(root: DataFrame) -> DataFrame:
    return root.select(F.col("node").alias("a"), F.col("root").alias("b"))


def across(members: DataFrame, root: DataFrame, run) -> DataFrame:
    """Stars of verified links between groups of different parts and components."""
    placed, pairs = meeting_groups(members, root)
    ends = pairs.select("x", "y", F.explode(F.array(F.struct(F.col("x").alias("grp"), F.lit(0).alias("side")),
                                                    F.struct(F.col("y").alias("grp"), F.lit(1).alias("side")))).alias("e")).select("x", "y", "e.*")
    meets = ends.join(placed, "grp").select("x", "y", "cls", "side")
    opened = meets.join(members.select("cls", "n", "tokens"), "cls")
    return written(opened.groupBy("x", "y").applyInArrow(per_group(run), LINKS))


def linked_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every row, class_id (equal sets; null if
    nothing can be linked) and text_md5."""
    sets = sets_of(docs, width, percent, chunk_bytes)
    open_ = sets.where("cls is not null")
    # The lists of equal sets are equal, so any one will do; a set that a third of all rows have combines before the shuffle.
    classes = written(open_.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("least").alias("least"),
                                               F.first("firsts").alias("firsts"), F.first("tokens").alias("tokens")))
    root = components(links_of(classes.drop("first_id"), percent))
    ids = classes.select("cls", "first_id").join(root, F.col("cls") == F.col("node"), "left").select("cls", "first_id", F.coalesce("root", "cls").alias("comp"))
    least = ids.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = written(ids.join(least, "comp").select("cls", "component_id"))
    done = open_.select("doc_id", "n", "cls", "text_md5").join(named, "cls").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cls").alias("class_id"), "text_md5")
    rest = sets.where("cls is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                            F.lit(None).cast("long").alias("class_id"), "text_md5")
    return done.unionByName(rest)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which no linked one has a smaller id, with their columns; of repeated rows one stays.

    Different texts under the least id of a component, and texts without an id in components without ids, all stay.
    """
    name = unused(docs, "_sum")
    keep = linked_documents(docs.select("doc_id", "text"), width, percent).where("component_id <=> doc_id").select("doc_id", F.col("text_md5").alias(name))
    marked = docs.withColumn(name, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return marked.join(keep, marked["doc_id"].eqNullSafe(keep["doc_id"]) & (marked[name] == keep[name]), "left_semi") \
        .dropDuplicates(["doc_id", name]).drop(name)

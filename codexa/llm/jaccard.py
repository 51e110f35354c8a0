"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Texts of equal shingle sets form a class; the join runs over classes. Shingles have a global order, rare ones first, so two
sets that are similar enough share a shingle among the first n - ceil(0.8 n) + 1 of each ("prefix"). The product is taken
over prefixes, in blocks: a block is a range of shingle hashes, and travels as packed arrays.

1. `documents`: id, set size, class and sketch of every text. (Sets of all texts, written, would take twice the input; steps
   2, 3, 5 and 6 make them from the texts again, the last two those of candidates alone.)
2. `common_shingles`: counts of all shingles, block by block; the most common ones (a bounded number of hashes) are
   broadcast and go last in the order. Any order gives the same links; this one keeps buckets small.
3. `postings`: prefix entries, packed by block; entries that one class alone holds are dropped.
4. Buckets (the classes that hold a shingle) of up to SMALL classes give their pairs, whose overlap counts are summed;
   pairs that cannot reach the bound given by both sizes, prefix lengths and entries in large buckets are discarded.
5. Large buckets first give a star: each member with the class whose prefix has the smallest part that no other class
   holds, as that one reaches most. Of pairs of steps 4 and 5 those go whose sketches, a parity bit for each residue of the
   hashes, differ in more bits than two similar sets can (`likely`); the others are verified on the whole sets:
   100 * overlap >= 80 * union.
6. In each large bucket the pairs that can still reach the bound and lie in different components are found (`meet`). Up to
   PAIRS for each member, they are given; their overlap counts are summed as in step 4 and what is left goes the way of step 5. A bucket with more gives its members, and components that meet in
   such a bucket are in one group. Within a group, all classes outside its largest component are held against all classes
   of the group: both are dealt into tiles of bounded bytes, and a task takes one tile of each (`tile_links`). There the
   product of the two incidence matrices accumulates whole overlap counts, pairs below the bound given by both sizes are
   discarded, and of the links only those that join two components of the tile are given. So every pair of classes that
   share a prefix entry, can reach the bound and lie in different components is compared, while rows stay in proportion
   to the members of buckets and, for groups, to members times tiles.
7. Components: by one task up to AT_ONCE links, else by label propagation with pointer jumping over written tables.

Hashes have 64 bits. Two different shingles of one pair's sets would have to collide to change a verdict.

Defined results: a null or empty text, or one of white space, has no shingles, links with nothing and is its own
component; with fewer than five words the whole sequence is the one shingle; rows of equal id all count, and a component
of rows without any id has a null id; a null id never names a component that has another; a text of any length is taken
whole, in a slice of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import column_bytes, mix, ragged, shingle_sets, slices, tidy

WORDS = 5
SMALL = 8
#: Shingles counted more often go last; at most MAX_COMMON of them are broadcast, with the bar raised until they fit.
COMMON = 32
MAX_COMMON = 1 << 20
#: Hash entries of one block, about; blocks are a power of two, MIN_BLOCKS at least.
BLOCK = 2_000_000
MIN_BLOCKS = 1024
#: Candidate ids that may be broadcast to select their texts; beyond it they are joined.
MAX_BROADCAST = 2_000_000
#: Links whose components one task works out; above it labels are propagated over tables.
AT_ONCE = 200_000
FLUSH = 1_500_000
#: Bytes and classes of a tile, about.
TILE_BYTES, TILE_CLASSES = 4 << 20, 4096
#: Counts that a task accumulates at once, and classes of a tile that hold a shingle from which on it is a dense column.
CELLS, DENSE = 1 << 21, 24
#: Pairs for each member that a large bucket gives.
PAIRS = 32


def signature(s: np.ndarray) -> int:
    """A class's key: a hash of its set, as a signed long."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def sets_of(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return shingle_sets(*column_bytes(batch.column(column)), WORDS)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def row_key():
    """A hash of a row's id and text; never null."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def sketch(s: np.ndarray) -> bytes:
    """For each residue of the hashes, modulo the least power of two from the set's size on, whether their number is odd."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def odd_bits(x: bytes, y: bytes) -> int:
    """A number of hashes that one of two sets holds and the other does not, at most their true number, from their sketches."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, and (null for empty sets) sig and sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for x in slices(batch):
                sets = sets_of(x, 1)
                found = [(signature(s), sketch(s)) if len(s) else (None, None) for s in sets]
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), *cols], ["doc_id", "row_key", "n_shingles", "sig", "sketch"])

    return texts(docs).withColumn("row_key", row_key()).mapInArrow(tidy(run), f"doc_id {kind}, row_key long, n_shingles long, sig long, sketch binary")


def task_sets(batches):
    """(sig, set) of the texts of `doc_id, text`, of each class once in a task."""
    seen = set()
    for batch in batches:
        for x in slices(batch):
            for s in sets_of(x, 1):
                if len(s) and (k := signature(s)) not in seen:
                    seen.add(k)
                    yield k, s


def packed(block_bits: int, hashes: np.ndarray, payload: list[np.ndarray]):
    """(block, bytes) rows of records sorted by hash: each a run of the block's payload arrays, one after the other."""
    order = np.argsort(hashes, kind="stable")
    block = (hashes[order] >> np.uint64(64 - block_bits)).astype(np.int64)
    payload = [p[order] for p in payload]
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    ids, data = [], []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
        ids.append(int(block[a]))
        data.append(b"".join(p[a:b].tobytes() for p in payload))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def common_shingles(docs: DataFrame, block_bits: int, scratch: Scratch, bar: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Keys (the hash's first block_bits + 32 bits) and counts of the common shingles, sorted by key."""

    def gather(batches):
        held, n = [], 0
        shift = np.uint64(32 - block_bits)

        def flush():
            h = np.concatenate(held)
            return packed(block_bits, h, [((h >> shift) & np.uint64(0xFFFFFFFF)).astype(np.uint32)])

        for _, s in task_sets(batches):  # copies within the task count once
            held.append(s)
            n += len(s)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def count(key, table):
        v = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]))
        at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        n = np.diff(np.append(at, len(v)))
        keep = n > bar
        return pa.table({"k": pa.array((np.int64(key[0].as_py()) << 32) | v[at[keep]].astype(np.int64)), "n": pa.array(n[keep], pa.int64())})

    counted = texts(docs).mapInArrow(tidy(gather), "block int, data binary").groupBy("block").applyInArrow(count, "k long, n long")
    counted = scratch.keep(counted, "common")
    while counted.where(F.col("n") > bar).count() > MAX_COMMON:
        bar *= 2
    found = counted.where(F.col("n") > bar).toArrow()
    scratch.drop(counted)
    k, n = found.column("k").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(k)
    return k[order], n[order]


def postings(docs: DataFrame, block_bits: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, sig, n, held (classes in the bucket) of the prefix entries that two classes or more hold."""
    keys, counts = common
    shift = np.uint64(32 - block_bits)

    def prefixes(s: np.ndarray) -> np.ndarray:
        p = prefix_length(len(s))
        if len(keys):
            k = (s >> shift).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            often = np.where(keys[at] == k, counts[at], 0)
            if often.any():
                return s[np.lexsort((s, often))[:p]]
        return s[:p]

    def gather(batches):
        held, sigs, sizes, n = [], [], [], 0

        def flush():
            h = np.concatenate(held)
            lens = [len(x) for x in held]
            return packed(block_bits, h, [h, np.repeat(np.array(sigs, np.int64), lens), np.repeat(np.array(sizes, np.int32), lens)])

        for k, s in task_sets(batches):
            held.append(prefixes(s))
            sigs.append(k)
            sizes.append(len(s))
            n += len(held[-1])
            if n >= FLUSH // 2:
                yield flush()
                held, sigs, sizes, n = [], [], [], 0
        if held:
            yield flush()

    def buckets(table):
        parts = []
        for x in table.column("data").to_pylist():
            m = len(x) // 20
            parts.append((np.frombuffer(x, np.uint64, m), np.frombuffer(x, np.int64, m, 8 * m), np.frombuffer(x, np.int32, m, 16 * m)))
        h, sig, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, sig, n = h[order], sig[order], n[order]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        h, sig, n = h[twin], sig[twin], n[twin]
        order = np.lexsort((sig, h))
        h, sig, n = h[order], sig[order], n[order]
        if len(h):  # copies of a class that came from several tasks
            fresh = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))
            h, sig, n = h[fresh], sig[fresh], n[fresh]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        size = np.repeat(np.diff(np.append(at, len(h))), np.diff(np.append(at, len(h))))
        keep = size > 1
        return pa.table({"h": pa.array(h[keep].view(np.int64)), "sig": pa.array(sig[keep]), "n": pa.array(n[keep], pa.int32()), "held": pa.array(size[keep], pa.int32())})

    return texts(docs).mapInArrow(tidy(gather), "block int, data binary").groupBy("block").applyInArrow(buckets, "h long, sig long, n int, held int")


def fits(a, b):
    """Whether sets of these sizes can be similar enough."""
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def small_pairs(posts: DataFrame) -> DataFrame:
    """a, b (a < b) from small buckets whose summed overlap can still reach the bound. posts: h, sig, n, e, l, held; e: the
    class's entries in buckets of two or more, l: those in large ones."""
    p = posts.where(F.col("held") <= SMALL).select("h", "sig", "n", "e", "l")
    q = p.select("h", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("e").alias("eb"), F.col("l").alias("lb"))
    both = p.withColumnsRenamed({"sig": "a", "n": "na", "e": "ea", "l": "la"}).join(q, "h").where((F.col("a") < F.col("b")) & fits("na", "nb") & may_reach("na", "ea", "nb", "eb"))
    pairs = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *(F.first(x).alias(x) for x in ("na", "nb", "la", "lb")))
    # entries in large buckets are not counted in c
    return pairs.where(F.col("c") + F.least("la", "lb") + behind("na", "nb") >= F.ceil(4 * (F.col("na") + F.col("nb")) / 9)).select("a", "b")


def behind(na: str, nb: str):
    """The most shingles that two sets can share behind a prefix: n - prefix = ceil(0.8 n) - 1."""
    return F.greatest(F.floor((4 * F.col(na) + 4) / 5), F.floor((4 * F.col(nb) + 4) / 5)) - 1


def may_reach(na: str, ea: str, nb: str, eb: str):
    """Whether the overlap of two sets can reach the bound if all prefix entries that either shares with any class were common
    to both. n: sizes; e: the classes' entries in buckets of two or more."""
    return F.least(ea, eb) + behind(na, nb) >= F.ceil(4 * (F.col(na) + F.col(nb)) / 9)


def star_pairs(large: DataFrame) -> DataFrame:
    """a, b: members of large buckets with the bucket's centre, where they can be similar enough. large: h, sig, n, e."""
    alone = F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1 - F.col("e")  # prefix entries that no other class holds
    centres = large.groupBy("h").agg(F.min(F.struct((alone / F.col("n")).alias("k"), F.col("sig").alias("c"), F.col("n").alias("nc"), F.col("e").alias("ec"))).alias("m")).select("h", "m.c", "m.nc", "m.ec")
    rows = large.join(centres, "h").where((F.col("sig") != F.col("c")) & fits("n", "nc") & may_reach("n", "e", "nc", "ec"))
    return rows.select(F.least("sig", "c").alias("a"), F.greatest("sig", "c").alias("b"))


def need_of(n: np.ndarray, rows: slice, cols: slice) -> np.ndarray:
    """The prefix entries that two sets must share: the bound on their overlap, less what can lie behind a prefix."""
    rest = (4 * n + 4) // 5 - 1
    return (4 * (n[rows, None] + n[None, cols]) + 8) // 9 - np.maximum(rest[rows, None], rest[None, cols])


def meet(placed: DataFrame, block_bits: int) -> DataFrame:
    """Of each large bucket its pairs of different components that can reach the bound (group false; a, b, and in `n` the
    entries in large buckets that they must share), or if they are many its members (group true; a: the class, b: the
    bucket's smallest component, comp and n of the class). placed: h, sig, n, e, l, comp."""

    def run(table):
        h, sig, n, e, l, comp = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "sig", "n", "e", "l", "comp"))  # noqa: E741
        order = np.argsort(h, kind="stable")
        h, sig, n, e, l, comp = (c[order] for c in (h, sig, n, e, l, comp))  # noqa: E741
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        out = []
        for x, y in zip(at.tolist(), [*at[1:].tolist(), len(h)], strict=True):
            c, s, size, entries, small = comp[x:y], sig[x:y], n[x:y], e[x:y], (e - l)[x:y]
            if (c == c[0]).all():
                continue
            m, found, many = y - x, [], 0
            step = max(1, CELLS // m)
            for k in range(0, m, step):
                rows, cols = slice(k, k + step), slice(k, None)
                need = need_of(size, rows, cols)
                ok = (5 * size[rows, None] >= 4 * size[None, cols]) & (5 * size[None, cols] >= 4 * size[rows, None]) & (c[rows, None] != c[None, cols])
                i, j = np.nonzero(np.triu(ok & (np.minimum(entries[rows, None], entries[None, cols]) >= need), 1))
                many += len(i)
                if many > PAIRS * m:
                    break
                found.append((s[i + k], s[j + k], need[i, j] - np.minimum(small[i + k], small[j + k])))
            if many > PAIRS * m:
                out.append((np.ones(m, bool), s, np.full(m, c.min()), c, size))
            elif many:
                a, b, least = (np.concatenate(f) for f in zip(*found, strict=True))
                out.append((np.zeros(many, bool), np.minimum(a, b), np.maximum(a, b), np.zeros(many, np.int64), least))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, bool), *[np.zeros(0, np.int64)] * 4]
        return pa.table([pa.array(c) for c in cols], ["group", "a", "b", "comp", "n"])

    return placed.groupBy(F.shiftrightunsigned("h", 64 - block_bits)).applyInArrow(run, "group boolean, a long, b long, comp long, n long")


def met_pairs(met: DataFrame) -> DataFrame:
    """a, b of the pairs whose summed entries in large buckets are as many as they must be. Those in buckets that gave their
    members are not summed; pairs that meet there are compared within their group."""
    return met.where("not group").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("least")).where(F.col("c") >= F.col("least")).select("a", "b")


def members_of_groups(met: DataFrame, scratch: Scratch) -> DataFrame:
    """sig, n, comp, group, other, tile, other_tiles, all_tiles: the classes of groups, from the members that `meet` gives.
    other: whether the class lies outside the group's largest component."""
    groups = components(met.select(F.col("comp").alias("a"), "b").distinct(), scratch).select(F.col("node").alias("comp"), F.col("comp").alias("group"))
    members = scratch.keep(met.select(F.col("a").alias("sig"), "comp", "n").distinct().join(groups, "comp"), "members")
    parts = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    tiles = lambda m, size: F.ceil(F.greatest(m / TILE_CLASSES, 8 * size / TILE_BYTES)).cast("int")
    main = parts.groupBy("group").agg(F.max(F.struct("m", "size", "comp")).alias("x"), F.sum("m").alias("m"), F.sum("size").alias("size"))
    main = main.select("group", F.col("x.comp").alias("main"), tiles(F.col("m") - F.col("x.m"), F.col("size") - F.col("x.size")).alias("other_tiles"), tiles(F.col("m"), F.col("size")).alias("all_tiles"))
    return members.join(scratch.keep(main, "main"), "group").select("sig", "n", "comp", "group", (F.col("comp") != F.col("main")).alias("other"), F.xxhash64("sig").alias("tile"), "other_tiles", "all_tiles")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray):
    """Yields (i, j) arrays of the sets of a and b that are similar enough, by blocks of the product of their incidences."""
    n = len(a)
    h = np.concatenate(a)
    row = np.repeat(np.arange(n), size_a)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    keys, held = h[at], np.diff(np.append(at, len(h)))
    dense = np.flatnonzero(held >= DENSE)
    column = np.full(len(keys), -1)
    column[dense] = np.arange(len(dense))
    step = max(1, CELLS // n)
    for first in range(0, len(b), step):
        block = b[first : first + step]
        rows = len(block)
        g = np.concatenate(block)
        mine = np.repeat(np.arange(rows), size_b[first : first + step])
        place = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[place] == g
        place, mine = place[hit], mine[hit]
        counts = np.zeros(rows * n, np.int64)
        wide = column[place] >= 0
        thin, who = place[~wide], mine[~wide]
        total = np.cumsum(held[thin])
        cuts = np.searchsorted(total, np.arange(0, total[-1] + CELLS, CELLS), "right") if len(thin) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            cell = np.repeat(who[x:y], held[thin[x:y]]) * n + row[ragged(at[thin[x:y]], held[thin[x:y]])]
            counts += np.bincount(cell, minlength=rows * n)
        counts = counts.reshape(rows, n)
        used = np.unique(column[place[wide]])
        for k in range(0, len(used), 1024):
            part = used[k : k + 1024]
            left, right = np.zeros((n, len(part)), np.float32), np.zeros((rows, len(part)), np.float32)
            own = dense[part]
            left[row[ragged(at[own], held[own])], np.repeat(np.arange(len(part)), held[own])] = 1
            spot = np.searchsorted(part, column[place[wide]])
            inside = (spot < len(part)) & (part[np.minimum(spot, len(part) - 1)] == column[place[wide]])
            right[mine[wide][inside], spot[inside]] = 1
            counts += (right @ left.T).astype(np.int64)  # sums of up to 1024 ones
        j, i = np.nonzero(9 * counts >= 4 * (size_b[first : first + step, None] + size_a[None, :]))
        yield i, j + first


def forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Positions of edges (a, b) that join two trees of `parent`, which is brought up to date: roots are the smallest nodes."""
    found = []
    while True:
        x, y = parent[a], parent[b]
        live = np.flatnonzero(x != y)
        if not len(live):
            return np.concatenate(found) if found else np.zeros(0, np.int64)
        high, low = np.maximum(x[live], y[live]), np.minimum(x[live], y[live])
        _, one = np.unique(high, return_index=True)  # each root that is not the smallest goes below one other
        parent[high[one]] = low[one]
        found.append(live[one])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between classes of different components of a group, enough of them to join what all links join."""
    rows = members.join(sets, "sig")
    left = rows.where("other").select("group", F.pmod("tile", "other_tiles").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_tiles") - 1)).alias("j"), *(F.col(c).alias(c) for c in ("sig", "comp", "data")))
    right = rows.select(F.col("group").alias("of"), F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)).alias("k"), F.pmod("tile", "all_tiles").cast("int").alias("l"), *(F.col(c).alias(c) for c in ("sig", "comp", "data")))

    def run(_, one, all_):
        sides = [(t.column("sig").to_numpy(), t.column("comp").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()]) for t in (one, all_)]
        found = []
        if one.num_rows and all_.num_rows:
            (sig_a, comp_a, a), (sig_b, comp_b, b) = sides
            comps, node = np.unique(np.concatenate((comp_a, comp_b)), return_inverse=True)
            node_a, node_b, parent = node[: len(a)], node[len(a) :], np.arange(len(comps))
            sizes = [np.array([len(x) for x in s]) for s in (a, b)]
            for i, j in overlaps(a, b, *sizes):
                k = forest(node_a[i], node_b[j], parent)
                found.append((sig_a[i[k]], sig_b[j[k]]))
        x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return left.groupBy("group", "i", "j").cogroup(right.groupBy("of", "k", "l")).applyInArrow(run, "a long, b long")


def sets_of_classes(docs: DataFrame, rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """sig and data (the set's sorted hashes) of the classes of `wanted` (sig), each made from one of its texts."""
    holders = scratch.keep(rows.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("row_key").alias("row_key")), "holders")
    n = holders.count()
    keys = holders.select("row_key").distinct()
    chosen = texts(docs).withColumn("row_key", row_key()).join(F.broadcast(keys) if n <= MAX_BROADCAST else keys, "row_key", "left_semi").select("doc_id", "text")

    def run(batches):
        for k, s in task_sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["sig", "data"])

    out = scratch.keep(chosen.mapInArrow(tidy(run), "sig long, data binary"), "sets")
    return out if out.count() == n else scratch.keep(out.dropDuplicates(["sig"]), "sets")  # equal rows in several tasks


def both_sides(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """a, b, x, y: pairs with what `of` (sig and the column) has of either."""
    rows = pairs.join(of.select(F.col("sig").alias("b"), F.col(column).alias("y")), "b")
    return rows.join(of.select(F.col("sig").alias("a"), F.col(column).alias("x")), "a").select("a", "b", "x", "y")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches leave open that the sets are similar enough. sketches: sig, n, sketch."""

    def run(batches):
        for t in batches:
            n = t.column(4).to_numpy()
            keep = [9 * odd_bits(x, y) <= m for x, y, m in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), n.tolist(), strict=True)]
            yield t.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(sketches.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y")), "b")
    sides = sides.join(sketches.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), "a")
    return sides.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(tidy(run), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough. sets: sig, data."""
    rows = both_sides(pairs, sets, "data")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                t = batch.slice(i, 256)
                keep = []
                for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    n = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * n >= 80 * (len(x) + len(y) - n))
                t = t.select([0, 1]).filter(pa.array(keep, pa.bool_()))
                yield t

    return rows.mapInArrow(tidy(run), "a long, b long")


def components_at_once(edges: DataFrame) -> DataFrame:
    """`components` of few edges, in one task of an executor."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "comp"])

    return edges.select("a", "b").coalesce(1).mapInArrow(tidy(run), "node long, comp long")


def components(edges: DataFrame, scratch: Scratch, at_once: int = AT_ONCE) -> DataFrame:
    """node, comp: the smallest node that each node of the edges (a, b) reaches."""
    if edges.count() <= at_once:
        return scratch.keep(components_at_once(edges), "labels")
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        near = scratch.keep(near, "near")
        hop = scratch.keep(labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low")), "hop")
        jump = hop.join(labels.select(F.col("node").alias("low"), F.col("comp").alias("root")), "low", "left")
        fresh = scratch.keep(jump.select("node", F.least("low", "root").alias("comp"), (F.least("low", "root") != F.col("comp")).alias("moved")), "labels")
        if not fresh.where("moved").limit(1).count():
            return fresh.select("node", "comp")
        labels = fresh.select("node", "comp")


def first_row():
    """Of rows of `documents`, doc_id and row_key of the one with the smallest id; rows without id come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return linked(docs).select("doc_id", "n_shingles", "component_id")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """`join_documents` with row_key and comp, the component's smallest sig (null for empty sets)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(documents(docs), "documents")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(MIN_BLOCKS, int(total) // BLOCK).bit_length() - 1
    bits = min(bits + (1 << bits < total // BLOCK), 30)
    posts = scratch.keep(postings(docs, bits, common_shingles(docs, bits, scratch)), "postings")
    entries = scratch.keep(posts.groupBy("sig").agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("held") > SMALL).alias("l")), "entries")
    entered = scratch.keep(posts.join(entries, "sig"), "entered")
    scratch.drop(posts)
    sketches = rows.where("sig is not null").join(entries.select("sig"), "sig", "left_semi").select("sig", F.col("n_shingles").alias("n"), "sketch")
    sketches = scratch.keep(sketches.dropDuplicates(["sig"]), "sketches")
    large = entered.where(F.col("held") > SMALL).select("h", "sig", "n", "e", "l")
    pairs = scratch.keep(likely(small_pairs(entered).union(star_pairs(large)).distinct(), sketches), "pairs")
    links = scratch.keep(verify(pairs, sets_of_classes(docs, rows, ends_of(pairs), scratch)), "links")
    labels = components(links, scratch)
    placed = large.join(labels.withColumnsRenamed({"node": "sig"}), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    met = scratch.keep(meet(placed, bits), "met")
    more = scratch.keep(likely(met_pairs(met), sketches), "more")
    grouped = met.where("group")
    if not (more.isEmpty() and grouped.isEmpty()):
        sets = sets_of_classes(docs, rows, ends_of(more).union(grouped.select("a")).distinct(), scratch)
        links = links.unionByName(scratch.keep(verify(more, sets), "links"))
        if not grouped.isEmpty():
            links = links.unionByName(scratch.keep(tile_links(members_of_groups(grouped, scratch), sets), "joining"))
        labels = components(links, scratch)
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    roots = classes.join(labels.withColumnsRenamed({"node": "sig"}), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    roots = scratch.keep(roots.select("sig", "comp", "doc_id"), "roots")
    first = scratch.keep(roots.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "first")
    named = scratch.keep(roots.join(first, "comp").select("sig", "comp", "component_id"), "named")
    scratch.drop(entered, entries, sketches, pairs, met, more)
    out = rows.join(named, "sig", "left")
    return out.select("doc_id", "row_key", "n_shingles", "comp", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component: that with the smallest id, or one without id if none has an id.

    Rows are told apart by id and text, so unlinked texts under one id all stay, as do all texts without shingles."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(linked(docs).where("n_shingles > 0").groupBy("comp", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")), "components")
    first = scratch.keep(found.groupBy("comp").agg(first_row().alias("m")).select("m.row_key"), "first")
    drop = scratch.keep(found.join(first, "row_key", "left_anti").select(F.col("row_key").alias("__row")), "drop")
    twice = scratch.keep(found.where("n > 1").join(first, "row_key", "left_semi").select(F.col("row_key").alias("__row")), "twice")
    few = lambda keys: F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys
    rest = docs.withColumn("__row", row_key()).join(few(drop), "__row", "left_anti")
    if twice.isEmpty():
        return rest.select(*docs.columns)
    once = rest.join(few(twice), "__row", "left_semi").dropDuplicates(["__row"])
    return rest.join(few(twice), "__row", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return join_documents(table(spark, sf_dir, "documents"))

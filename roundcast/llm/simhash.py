"""SimHash near-duplicates, linked with BK-trees.

Fingerprints that can link meet in shards: for a small radius, pairs of bit blocks (any two fingerprints that differ
in at most r bits agree in two of r + 2 blocks); for a wide radius, the documents' minimum shingle hashes. A shard's
distinct fingerprints form BK-trees, whose children are keyed by their Hamming distance to the parent; a search
follows only edges within the radius. Each task holds trees of at most ``tree_nodes`` nodes; larger shards are dealt
into blocks, and every pair of blocks is a tree. A search passes over subtrees of its own component, so a crowded
shard yields a spanning set of links, not all pairs. Stars over the links give components.

Where a similarity is asked for, these components only say which texts have to be compared. Their texts meet once more,
with all their shingles, and the trees of each component are searched again: a pair within the radius is a link only if
the exact Jaccard similarity of its shingle sets is high enough, and only links join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundcast.llm.common import mixed, parted, stored, table

RADIUS = 4
TREE_NODES = 20_000
#: Shingles of the sets that a tree holds, on average.
TREE_SHINGLES = 1 << 21
_FRONTIER = 1 << 21


# --- fingerprints


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64, seed 42, of every run of ``size`` words joined by spaces; of all words if there are fewer."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return []
    raw = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(raw, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    view = memoryview(raw)
    parts = map(view.__getitem__, map(slice, starts, ends[size - 1 :].tolist()))
    return list(map(xxhash.xxh64_intdigest, parts, repeat(42)))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that over half of them have; an empty run has none."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    per = (sizes[full] + 254) // 255  # a byte lane counts to 255
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    cuts = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    counts = np.zeros((len(full), 64), np.int64)
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ones, cuts)
        counts[:, bit::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = 2 * counts > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def block_keys(prints: np.ndarray, radius: int) -> np.ndarray:
    """A key for each pair of radius + 2 bit blocks."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [
        (prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]
    keys = [
        (np.uint64(n) << np.uint64(48)) | (blocks[i] << np.uint64(24)) | blocks[j]
        for n, (i, j) in enumerate(combinations(range(len(blocks)), 2))
    ]
    return np.stack(keys, axis=1).view(np.int64)


def minimum_keys(hashes: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """A key for each pair of the least shingle hashes under n orders; runs without shingles share all keys.

    Texts of similarity J share a key unless fewer than two of their n minima agree; a passage that texts share
    without being alike seldom gives two minima of both.
    """
    out = np.zeros((len(sizes), n), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for k in range(n):
            out[full, k] = np.minimum.reduceat(mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), starts)
    pairs = combinations(range(n), 2)
    return np.stack([mixed(out[:, i] + mixed(out[:, j] + np.uint64(k))) for k, (i, j) in enumerate(pairs)], axis=1).view(np.int64)


def fingerprints(
    docs: DataFrame,
    doc_id: str,
    text_col: str,
    shingle: int,
    words64: int = 1,
    minimums: int = 0,
    radius: int = RADIUS,
    sets: bool = False,
) -> DataFrame:
    """doc_id, check (of the text), print (8 x words64 bytes), ``size`` (shingles) and the shard keys of each document.

    ``sets``: each shingle counts once, and a digest of the set (8 bytes) follows the print.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.hash(text).alias("check"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                own = batch.slice(low, 200)
                lists = [shingle_hashes(t or "", shingle) for t in own["text"].to_pylist()]
                if sets:
                    lists = [np.unique(np.array(x, np.uint64)) for x in lists]
                sizes = np.array([len(x) for x in lists], np.int64)
                hashes = np.concatenate([np.array(x, np.uint64) for x in lists])
                prints = np.stack([majority_bits(hashes if k == 0 else mixed(hashes + np.uint64(k)), sizes) for k in range(words64)], axis=1)
                keys = minimum_keys(hashes, sizes, minimums) if minimums else block_keys(prints[:, 0], radius)
                if sets:
                    digests = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in lists], np.uint64)
                    prints = np.concatenate([prints, digests[:, None]], axis=1)
                raw = prints.astype(">u8").tobytes()
                width = 8 * prints.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        own["doc_id"],
                        own["check"],
                        pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(
                            np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel(), pa.int64())
                        ),
                    ],
                    names=["doc_id", "check", "print", "size", "keys"],
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, check int, print binary, size long, keys array<long>")


# --- sets


class ShingleSets:
    """Sorted shingle sets, compared pair by pair."""

    def __init__(self, sets: pa.ListArray, similarity: float) -> None:
        values = sets.flatten().to_numpy(zero_copy_only=False)
        self.size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        # ranks keep apart what differs, and their order that of the values
        ranks, self.rank = np.unique(values, return_inverse=True)
        self.ranks = max(len(ranks), 1)
        self.similarity = similarity

    def _flat(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each set of ``of`` its place there and its ranks, as one key, and the place alone."""
        size = self.size[of]
        place = np.repeat(np.arange(len(of)), size)
        at = np.repeat(self.start[of] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return place * self.ranks + self.rank[at], place

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets a and b have the Jaccard similarity; two empty ones do."""
        out = np.zeros(len(a), bool)
        x, y = self.size[a], self.size[b]
        near = np.flatnonzero(np.minimum(x, y) >= self.similarity * np.maximum(x, y) - 1e-9)
        cut = np.cumsum(x[near] + y[near]) >> 21
        for part in np.split(near, np.flatnonzero(np.diff(cut)) + 1):
            if not len(part):
                continue
            (keys, _), (asked, place) = self._flat(a[part]), self._flat(b[part])
            if len(keys):
                hit = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
                shared = np.bincount(place[hit], minlength=len(part))
            else:
                shared = np.zeros(len(part), np.int64)
            out[part] = shared >= self.similarity * (x[part] + y[part] - shared) - 1e-9
        return out

    def links(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs a-b that are alike and join labels, some thousand at a time, and the labels then."""
        kept = []
        for low in range(0, len(a), 4096):
            x, y = a[low : low + 4096], b[low : low + 4096]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            same = self.alike(x, y)
            x, y = x[same], y[same]
            some = _forest(label[x], label[y], len(label))
            kept.append((x[some], y[some]))
            label = _labels(label, x[some], y[some])
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(empty + [x for x, _ in kept]), np.concatenate(empty + [y for _, y in kept]), label


# --- trees


class BKForest:
    """BK-trees of several shards side by side, one level after another.

    prints: distinct within a shard, shards in runs. A node's children lie in one run, ordered by distance.
    """

    def __init__(self, prints: np.ndarray, shard: np.ndarray) -> None:
        n = len(prints)
        self.prints = prints
        starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        self.root = np.repeat(starts, np.diff(np.concatenate((starts, [n]))))
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        self.levels = [starts]
        rest = np.setdiff1d(np.arange(n), starts)
        at = self.root[rest]
        while len(rest):
            d = self.distance(rest, at)
            _, first, which = np.unique(at * 1024 + d, return_index=True, return_inverse=True)
            nodes = rest[first]
            self.parent[nodes] = at[first]
            self.edge[nodes] = d[first]
            self.levels.append(nodes)
            lower = rest != nodes[which]
            rest, at = rest[lower], nodes[which][lower]
        children = np.flatnonzero(self.parent >= 0)
        key = self.parent[children] * 1024 + self.edge[children]
        order = np.argsort(key)
        self.child, self.key = children[order], key[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).sum(axis=1, dtype=np.int64)

    def links(self, radius: int, sets: ShingleSets | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect whatever nodes of a shard are connected within the radius: fewer than there are nodes.

        ``sets``: a pair is connected only if its sets are alike too, and each is looked at before it joins labels.
        """
        n = len(self.prints)
        close = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        if sets is None:
            found = [(close, self.parent[close])]
            label = _labels(np.arange(n), close, self.parent[close])
        else:
            a, b, label = sets.links(np.arange(n), close, self.parent[close])
            found = [(a, b)]
        # each link between components shows from the smaller one, so the largest of a shard needn't search
        names, size = np.unique(label, return_counts=True)
        order = np.lexsort((size, self.root[names]))
        last = np.concatenate((self.root[names[order]][1:] != self.root[names[order]][:-1], [True]))
        queries = np.flatnonzero(~np.isin(label, names[order][last]))
        for low in range(0, len(queries), 2048):
            least, most = label.copy(), label.copy()
            for nodes in reversed(self.levels[1:]):
                np.minimum.at(least, self.parent[nodes], least[nodes])
                np.maximum.at(most, self.parent[nodes], most[nodes])
            own = queries[low : low + 2048]
            waiting = [(own, self.root[own])]
            a, b = [], []
            now = label
            while waiting:
                q, node = waiting.pop()
                keep = ~((least[node] == label[q]) & (most[node] == label[q]))
                q, node = q[keep], node[keep]
                if len(q) > _FRONTIER:
                    half = len(q) // 2
                    waiting += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                if not len(q):
                    continue
                d = self.distance(q, node)
                hit = (d <= radius) & (now[q] != now[node])
                if hit.any() and sets is not None:
                    at = np.flatnonzero(hit)
                    at = at[np.argsort(d[at], kind="stable")]
                    x, y, now = sets.links(now, q[at], node[at])
                    found.append((x, y))
                elif hit.any():
                    x, y = q[hit], node[hit]
                    some = _forest(label[x], label[y], n)
                    a.append(x[some])
                    b.append(y[some])
                lo = np.searchsorted(self.key, node * 1024 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.key, node * 1024 + d + radius, "right")
                width = hi - lo
                if width.any():
                    to = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
                    waiting.append((np.repeat(q, width), self.child[to]))
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                some = _forest(label[a], label[b], n)
                a, b = a[some], b[some]
                found.append((a, b))
                now = _labels(label, a, b)
            label = now
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Those of the edges a-b that make up a spanning forest: each round every component takes its first edge out."""
    to, left, out = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        x, y = to[a[left]], to[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(out)
        first = np.full(n, len(a))
        np.minimum.at(first, x, left)
        np.minimum.at(first, y, left)
        taken = np.unique(first[first < len(a)])
        out.append(taken)
        to = _labels(np.arange(n), to[a[taken]], to[b[taken]])[to]


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each component once the links a-b are in."""
    to = np.arange(len(label))
    x, y = label[a], label[b]
    while True:
        x, y = to[x], to[y]
        high, low = np.maximum(x, y), np.minimum(x, y)
        if (high == low).all():
            return to[label]
        np.minimum.at(to, high, low)
        while (to != to[to]).any():
            to = to[to]


def tree_links(
    batches: Iterator[pa.RecordBatch], radius: int, words64: int | None = None, similarity: float = 0.0
) -> Iterator[pa.RecordBatch]:
    """Links of all shards in a sorted partition; whole shards are taken together up to some size.

    ``words64`` words of a print count for its distance, all if it is None. With a ``similarity`` the rows have sets.
    """

    def linked(part: pa.Table) -> pa.RecordBatch:
        raw = part["print"].combine_chunks()
        width = len(raw[0].as_py()) // 8
        prints = np.frombuffer(b"".join(raw.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)
        same = np.ones(len(part), bool)
        for c in ("key", "low", "high"):
            x = part[c].to_numpy()
            same[1:] &= x[1:] == x[:-1]
        shard = np.cumsum(~same)
        # rows that repeat give a print again
        once = np.ones(len(part), bool)
        once[1:] = ~same[1:] | (prints[1:] != prints[:-1]).any(axis=1)
        prints, shard, raw = prints[once], shard[once], raw.filter(pa.array(once))
        sets = ShingleSets(part["set"].combine_chunks().filter(pa.array(once)), similarity) if similarity else None
        a, b = BKForest(prints[:, :words64], shard).links(radius, sets)
        return pa.RecordBatch.from_arrays([raw.take(pa.array(a)), raw.take(pa.array(b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = values = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        values += len(batch["set"].flatten()) if similarity else 0
        if rows < 2 * TREE_NODES and values < TREE_SHINGLES:
            continue
        whole = pa.Table.from_batches(held)
        key, low, high = (whole[c].to_numpy() for c in ("key", "low", "high"))
        ends = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        if len(ends):
            yield linked(whole.slice(0, int(ends[-1])))
            whole = whole.slice(int(ends[-1]))
        held, rows = whole.to_batches(), len(whole)
        values = sum(len(x["set"].flatten()) for x in held) if similarity else 0
    if rows:
        yield linked(pa.Table.from_batches(held))


def _units(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of ``rows`` (key, print ...) with ``units``, an array of ``key``, ``low``, ``high``: every two blocks of a
    crowded key are a unit. Keys with one row have none.

    blocks: how many blocks a key has, as an aggregate; one block is a unit by itself.
    """
    # written, so that the join sees a plain table and can split a shard that holds many prints
    crowds = stored(rows.groupBy("key").agg(F.count("*").alias("count"), blocks.cast("int").alias("n")).where("count > 1").drop("count"), "shards")
    dealt = rows.join(crowds, "key").withColumn("block", F.pmod(F.hash("print"), F.col("n")))
    # every two blocks of a crowded shard share a tree
    other = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: j != F.col("block"))
    )
    unit = F.transform(other, lambda j: F.struct(F.col("key"), F.least("block", j).alias("low"), F.greatest("block", j).alias("high")))
    return dealt.withColumn("units", unit).drop("n", "block")


def _sorted_units(units: DataFrame) -> DataFrame:
    return units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "print")


def links(prints: DataFrame, radius: int, tree_nodes: int = TREE_NODES, words64: int | None = None) -> DataFrame:
    """Links between different fingerprints, a and b, from ``print`` and ``keys``.

    Most keys have one print. So keys meet with a 64-bit mark of the print first, and prints come along only to the
    keys that have two marks. (A mark of eight bytes is one to one; of longer prints, two with one mark would have to be
    the only ones of a key to be missed.)
    """
    keyed = prints.select(F.xxhash64("print").alias("mark"), F.explode("keys").alias("key"))
    crowds = keyed.groupBy("key").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least <> most").select("key")
    crowds = stored(crowds, "crowds")
    met = parted(keyed, crowds, ["key"])[0].join(crowds, "key").distinct()
    own = prints.select(F.xxhash64("print").alias("mark"), "print").distinct()
    shards = stored(met.join(own, "mark").select("key", "print"), "shard_prints")
    n = F.count("*")
    dealt = _units(shards, F.when(n <= tree_nodes, F.lit(1)).otherwise(F.ceil(2 * n / tree_nodes)))
    ordered = _sorted_units(dealt.select("print", F.inline("units")))
    return ordered.mapInArrow(lambda batches: tree_links(batches, radius, words64), "a binary, b binary").distinct()


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts`` (print, units, text) with a row for each unit, and the sorted set of the text's shingles for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                own = batch.slice(low, 100)
                sets = [np.unique(np.array(shingle_hashes(t or "", shingle), np.uint64).view(np.int64)) for t in own["text"].to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets), pa.int64()))
                units = own["units"]
                of = pa.array(np.repeat(np.arange(len(own)), np.diff(units.offsets.to_numpy())))
                flat = units.flatten()
                # a text of a crowd goes to many units: some at a time
                for at in range(0, len(of), 1000):
                    part = of.slice(at, 1000)
                    yield pa.RecordBatch.from_arrays(
                        [*(flat.field(c).slice(at, 1000) for c in ("key", "low", "high")), own["print"].take(part), sets.take(part)],
                        names=["key", "low", "high", "print", "set"],
                    )

    return texts.mapInArrow(run, "key long, low int, high int, print binary, set array<long>")


def _blocks_of_sets(size: Column, tree_nodes: int, tree_shingles: int) -> Column:
    n, total = F.count("*"), F.sum(size)
    few = (n <= tree_nodes) & (total <= tree_shingles)
    return F.when(few, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(2 * n / tree_nodes), F.ceil(2 * total / tree_shingles)))


def checked_links(units: DataFrame, radius: int, similarity: float, words64: int) -> DataFrame:
    """Links, a and b, from ``key``, ``low``, ``high``, ``print`` and ``set``."""
    ordered = _sorted_units(units)
    return ordered.mapInArrow(lambda batches: tree_links(batches, radius, words64, similarity), "a binary, b binary").distinct()


def alike_links(
    keyed: DataFrame, radius: int, similarity: float, words64: int, tree_nodes: int = TREE_NODES, tree_shingles: int = TREE_SHINGLES
) -> DataFrame:
    """Links, a and b, between rows of one ``key`` whose prints are within the radius and whose ``set`` are alike."""
    slim = keyed.select("key", "print", F.size("set").cast("long").alias("size"))
    units = _units(slim, _blocks_of_sets(F.col("size"), tree_nodes, tree_shingles)).select("print", F.inline("units"))
    return checked_links(units.join(keyed, ["key", "print"]), radius, similarity, words64)


# --- components


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """Smallest member of every node's component: large and small stars in turn, until nothing moves.

    Every round is a minimum by node and a join with it, so that a node with many links is dealt over tasks.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join sees a plain table and can split a node with many links
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), name)


def grouped(
    docs: DataFrame,
    doc_id: str,
    text_col: str,
    shingle: int,
    radius: int,
    words64: int,
    minimums: int,
    tree_nodes: int,
    similarity: float = 0.0,
) -> DataFrame:
    """doc_id, check, print and ``root``, the print that stands for the component, of each document."""
    prints = stored(fingerprints(docs, doc_id, text_col, shingle, words64, minimums, radius, similarity > 0), "prints")
    stars = components(links(prints, radius, tree_nodes, words64))
    if similarity:
        # one row holds each print's text; a component's prints are compared with each other only
        met = stars.select(F.col("node").alias("print"), "least").unionByName(stars.select(F.col("least").alias("print"), "least").distinct())
        met = stored(met.select("print", F.xxhash64("least").alias("key")), "met")
        place = F.struct("doc_id", "check").alias("row_key")
        held = prints.select("print", "size", place).join(met, "print").groupBy("print", "key").agg(F.min("row_key").alias("row_key"), F.max("size").alias("size"))
        held = stored(_units(stored(held, "held"), _blocks_of_sets(F.col("size"), tree_nodes, TREE_SHINGLES)).select("row_key", "print", "units"), "units")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        texts = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.hash(text).alias("check")).alias("row_key"), text.alias("text"))
        # texts without a component of several prints, most of them, are not shuffled
        texts, _ = parted(texts, held, ["row_key"])
        sets = shingle_sets(texts.join(held, "row_key").select("print", "units", "text"), shingle)
        stars = components(checked_links(sets, radius, similarity, words64))
    stars = stars.withColumnRenamed("node", "print")
    linked, alone = parted(prints.drop("keys", "size"), stars, ["print"])
    rooted = linked.join(stars, "print", "left").unionByName(alone.withColumn("least", F.lit(None).cast("binary")))
    return rooted.select("doc_id", "check", "print", F.coalesce("least", "print").alias("root"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    radius: int = RADIUS,
    words64: int = 1,
    minimums: int = 0,
    tree_nodes: int = TREE_NODES,
) -> DataFrame:
    """Fingerprint and component of each row of ``docs``.

    Returns ``doc_id``, ``fingerprint`` (lower-case hex) and ``component_id``, the smallest id that links of at most
    ``radius`` bits reach, itself included. ``minimums`` = 0 finds every link of 64-bit prints; above that, prints
    (64 x ``words64`` bits) meet where two of so many minimum shingle hashes agree. Null and empty texts have the
    fingerprint zero and link like any other; repeated rows share a component; a null id is above every id, so that a
    component of null ids alone has a null component_id; other columns are not read; no rows give no rows.
    """
    rooted = grouped(docs, doc_id, text_col, shingle, radius, words64, minimums, tree_nodes)
    heads = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    # written, so that the join sees a plain table and can split a component that holds many rows
    heads = stored(heads.where("n > 1").select("root", "component_id", F.lit(True).alias("many")), "heads")
    component = F.when(F.col("many"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rooted.join(heads, "root", "left").select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), component.alias("component_id"))


def without_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    radius: int = 120,
    words64: int = 8,
    minimums: int = 6,
    tree_nodes: int = TREE_NODES,
    similarity: float = 0.8,
) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id; of several texts with that id
    the one with the smallest hash; of repeated rows one.

    Links are pairs whose sets of shingles have at least ``similarity``, by exact Jaccard. The radius only says which
    pairs are compared: at 0.8, 78 of 512 bits differ on average, with a deviation of 8, and about 96 with 9 where one
    text has five shingles and the other four of them.
    """
    own = F.struct(F.col(doc_id).alias("doc_id"), F.hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("check"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "check")
    rooted = grouped(docs, doc_id, text_col, shingle, radius, words64, minimums, tree_nodes, similarity)
    rooted = stored(rooted.select("doc_id", "check", F.xxhash64("root").alias("mark"), "root"), "rooted")
    # components of one row, most of them, have nobody to lose; nor have rows whose place is that of the head
    many = rooted.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    crowd = stored(rooted.join(many, "mark").select("root", place.alias("place")), "crowds")
    heads = stored(crowd.groupBy("root").agg(F.min("place").alias("head")), "heads")
    lost = crowd.join(heads, "root").where(F.col("place") > F.col("head"))
    again = crowd.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    key = F.struct("place.doc_id", "place.check").alias("row_key")
    lost, again = stored(lost.select(key).distinct(), "lost"), stored(again.select(key), "repeated")
    renamed = docs.select(own.alias("row_key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    # of the texts only those that may be lost or repeat are shuffled
    touched, left = parted(renamed, lost.unionByName(again), ["row_key"])
    left = left.unionByName(touched.join(lost.unionByName(again), "row_key", "left_anti"))
    # rows that repeat, none of them lost: one of each
    once = touched.join(again.join(lost, "row_key", "left_anti"), "row_key", "left_semi").dropDuplicates(["row_key"])
    left = left.unionByName(once)
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=RADIUS)

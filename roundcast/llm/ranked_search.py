"""Ranked lexical search for many items at once, with shared partial scores.

Items come in blocks of a bounded number of terms. Of each document only the block's terms are kept (``held``), from
which document frequencies follow. Items are written as sets of term copies: a term that an item has three times gives it
copies 1, 2 and 3. Copies that the same items have are one set, and sets that stand side by side in several items, most
frequent sets first, are joined again and again: a sharing DAG, whose nodes are term sets and whose edges are additions.
A task scores some documents at a time: contributions of the terms, then every shared set once, level by level, and last
the items, each the sum of few nodes. It keeps the best rows of each item; the tasks' best meet for the final ranks.

The block's DAG is broadcast: at most ``block_terms`` pairs of item and term, and the rest of the last item. Nothing of the
documents meets in one place but ``top`` rows of each item and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundcast.llm.common import LOWER, stored, table

TOP = 10
BLOCK_TERMS = 200_000
#: Scores, of nodes for documents, that a task computes together.
CELLS = 1 << 22
_SCALE = 1_000_000_000

#: Bytes that end a term become spaces, A-Z become small letters; letters, digits and all beyond ASCII stay.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER.tolist())


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


# --- sharing


class SharingDag(NamedTuple):
    """Node k < sets is a set of copies: ``set_term`` times ``set_copies``, cut by ``set_start``. Later nodes are the sum
    of two, ``left`` and ``right``, in ``levels``, each a range of nodes. An item is the sum of its nodes."""

    terms: list[bytes]
    items: list
    set_term: np.ndarray
    set_copies: np.ndarray
    set_start: np.ndarray
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    item_node: np.ndarray
    item_start: np.ndarray

    @property
    def nodes(self) -> int:
        return len(self.set_start) - 1 + len(self.left)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Scores, items x documents, from what one copy of each term gives each document, terms x documents."""
        sets = len(self.set_start) - 1
        out = np.empty((self.nodes, parts.shape[1]), np.int64)
        out[:sets] = np.add.reduceat(parts[self.set_term] * self.set_copies[:, None], self.set_start[:-1], axis=0)
        for a, b in self.levels:
            out[a:b] = out[self.left[a - sets : b - sets]] + out[self.right[a - sets : b - sets]]
        return np.add.reduceat(out[self.item_node], self.item_start[:-1], axis=0)


def sharing_dag(items: list[tuple[object, dict[bytes, int]]]) -> SharingDag:
    """items: id, and times of each term; none without terms."""
    terms = sorted({t for _, own in items for t in own})
    number = {t: k for k, t in enumerate(terms)}
    # an item has copies 1 to n of a term: for each number of copies that occurs, a copy of that height
    heights: dict[int, set[int]] = {}
    for _, own in items:
        for t, n in own.items():
            heights.setdefault(number[t], set()).add(n)
    steps = {t: list(zip([0, *sorted(h)], sorted(h), strict=False)) for t, h in heights.items()}
    owners: dict[tuple[int, int, int], list[int]] = {}
    for i, (_, own) in enumerate(items):
        for t, n in own.items():
            k = number[t]
            for low, high in steps[k]:
                if high <= n:
                    owners.setdefault((k, low, high), []).append(i)
    sets: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for (k, low, high), own in sorted(owners.items()):
        sets.setdefault(tuple(own), []).append((k, high - low))
    # the most frequent sets first, so that items that share much begin alike
    ordered = sorted(sets.items(), key=lambda s: (-len(s[0]), s[0]))
    of = np.concatenate([np.array(own) for own, _ in ordered])
    node = np.repeat(np.arange(len(ordered)), [len(own) for own, _ in ordered])
    order = np.lexsort((node, of))
    of, node = of[order], node[order]
    left, right, levels = [], [], []
    total = len(ordered)
    while len(node) > 1:
        beside = of[1:] == of[:-1]
        key = np.where(beside, node[:-1].astype(np.int64) * total + node[1:], -1)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        count = np.where(beside, count[which], 0)
        # a pair is joined where no pair that overlaps it occurs more often; of equal ones the left one is
        before, after = np.concatenate(([0], count[:-1])), np.concatenate((count[1:], [0]))
        taken = np.flatnonzero((count > 1) & (count > before) & (count >= after))
        pairs, place, times = np.unique(key[taken], return_inverse=True, return_counts=True)
        shared = times > 1
        taken = taken[shared[place]]
        if not len(taken):
            break
        pairs, place = np.unique(key[taken], return_inverse=True)
        left.append(pairs // total)
        right.append(pairs % total)
        levels.append((total, total + len(pairs)))
        node[taken] = total + place
        keep = np.ones(len(node), bool)
        keep[taken + 1] = False
        of, node = of[keep], node[keep]
        total += len(pairs)
    empty = [np.zeros(0, np.int64)]
    return SharingDag(
        terms,
        [i for i, _ in items],
        np.array([k for _, own in ordered for k, _ in own], np.int64),
        np.array([n for _, own in ordered for _, n in own], np.int64),
        np.concatenate(([0], np.cumsum([len(own) for _, own in ordered]))),
        np.concatenate(empty + left),
        np.concatenate(empty + right),
        levels,
        node,
        np.searchsorted(of, np.arange(len(items) + 1)),
    )


# --- items


def item_blocks(items: DataFrame, item_id: str, text_col: str, block_terms: int) -> DataFrame:
    """item, term, times and ``block``: blocks of ``block_terms`` rows and the rest of their last item."""
    slim = items.select(F.col(item_id).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    kind = slim.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            for row, text in enumerate(batch["text"].to_pylist()):
                own = Counter(terms_of(text))
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [batch["item"].slice(row, 1).take(pa.array([0] * len(own))), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())],
                        names=["item", "term", "times"],
                    )

    counted = slim.distinct().mapInArrow(run, f"item {kind}, term binary, times long")
    counted = stored(counted.groupBy("item", "term").agg(F.sum("times").alias("times")), "item_terms")
    sizes = counted.groupBy("item").agg(F.count("*").alias("n"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch["n"].to_numpy()
            before = held + np.cumsum(n) - n
            held += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch["item"], pa.array([part] * len(n), pa.int32()), pa.array(before), batch["n"]], names=["item", "part", "before", "n"])

    # sums run through each partition, then through the partitions: blocks don't depend on how many there are
    placed = stored(sizes.mapInArrow(running, f"item {kind}, part int, before long, n long"), "item_sizes")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    block = F.floor((F.col("base") + F.col("before")) / block_terms)
    return stored(counted.join(placed.join(bases, "part").select("item", block.alias("block")), "item"), "item_blocks")


# --- documents


def _held(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, ``n`` (terms with repeats) and, of the given terms, ``t`` (numbers) and ``tf``."""
    spark = docs.sparkSession
    # the terms of one block
    known = spark.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        number = {t: k for k, t in enumerate(known.value)}
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                own = batch.slice(low, 500)
                ids, tfs, ends, sizes = [], [], [0], []
                for text in own["text"].to_pylist():
                    words = terms_of(text) if text else []
                    sizes.append(len(words))
                    for t, n in Counter(filter(number.__contains__, words)).items():
                        ids.append(number[t])
                        tfs.append(n)
                    ends.append(len(ids))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        own["doc_id"],
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                    ],
                    names=["doc_id", "n", "t", "tf"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, n long, t array<int>, tf array<long>")


def _document_frequencies(held: DataFrame, size: int) -> DataFrame:
    """t and df, counted in the tasks before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch["t"].flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], names=["t", "df"])

    return held.select("t").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df"))


def length_factors(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 75 + ((75 n documents) div total); in whole numbers of any size where 64 bits are too few."""
    if len(n) and int(n.max()) * 75 * documents >= 1 << 63:
        return np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
    return 25 + 75 * documents * n // max(total, 1)


def contributions(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((_SCALE * tf) // (1000 * tf + 8 * m))


class Best:
    """The best rows of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, top: int) -> None:
        self.items, self.top = items, top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.none = np.zeros(0, bool)
        self.least = np.ones(items, np.int64)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """scores: items x documents."""
        item, at = np.nonzero(scores >= self.least[:, None])
        if len(item):
            self.waiting.append((item, scores[item, at], doc[at], none[at]))
            self.many += len(item)
        if self.many > 4 * self.top * self.items + 10_000:
            self.settle()

    def settle(self) -> None:
        rows = [(self.item, self.score, self.doc, self.none), *self.waiting]
        item, score, doc, none = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((doc, none, -score, item))
        start = np.searchsorted(item[order], np.arange(self.items))
        order = order[np.arange(len(order)) - start[item[order]] < self.top]
        item, score = item[order], score[order]
        self.item, self.score, self.doc, self.none = item, score, doc[order], none[order]
        size = np.bincount(item, minlength=self.items)
        full = np.flatnonzero(size >= self.top)
        self.least[full] = score[np.cumsum(size)[full] - 1]
        self.waiting, self.many = [], 0


def _best_of_tasks(held: DataFrame, dag: SharingDag, weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """item (its place in the block), doc_id and score: the best of every task."""
    # bounded as the block is
    shared = held.sparkSession.sparkContext.broadcast((dag, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, weights = shared.value
        best = Best(len(dag.items), top)
        width = max(1, CELLS // (dag.nodes + len(dag.set_term) + len(dag.item_node)))
        for batch in batches:
            for low in range(0, batch.num_rows, width):
                own = batch.slice(low, width)
                term, tf = own["t"].flatten().to_numpy(), own["tf"].flatten().to_numpy()
                n = own["n"].to_numpy()
                doc = np.repeat(np.arange(len(n)), np.diff(own["t"].offsets.to_numpy()))
                parts = np.zeros((len(dag.terms), len(n)), np.int64)
                parts[term, doc] = contributions(weights[term], tf, length_factors(n, documents, total)[doc])
                none = own["doc_id"].is_null().to_numpy(zero_copy_only=False)
                best.add(dag.scores(parts), own["doc_id"].fill_null(0).to_numpy(), none)
        best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)), pa.array(best.doc, pa.int64(), mask=best.none), pa.array(best.score)],
            names=["place", "doc_id", "score"],
        )

    return held.mapInArrow(run, "place int, doc_id long, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``top`` documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id`` (long) and ``score`` (above 0).

    Terms are runs of letters, digits and whatever is beyond ASCII, with A-Z in lower case. Equal scores rank by
    ascending id, a null id last. Every row of ``docs`` is a document, rows that repeat too; a null, empty or blank text
    has no terms, is no document in the statistics and never found. Different texts of one item id make up one item,
    repeated rows of an item count once, and items without an id or terms have no rows. Other columns are not read; no
    documents or no items give no rows. A text is held whole.
    """
    spark = docs.sparkSession
    blocks = item_blocks(items, item_id, item_text, block_terms)
    kind = blocks.schema["item"].dataType.simpleString()
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for block in [r.block for r in blocks.select("block").distinct().orderBy("block").collect()]:
        own: dict[object, dict[bytes, int]] = {}
        # one block, which is bounded
        for r in blocks.where(F.col("block") == block).orderBy("item", "term").collect():
            own.setdefault(r["item"], {})[bytes(r["term"])] = r["times"]
        dag = sharing_dag(list(own.items()))
        held = stored(_held(slim, dag.terms), "held")
        documents, total = held.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # a row for each of the block's terms
        ratio = F.lit(2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)
        weighed = _document_frequencies(held, len(dag.terms)).select("t", F.floor(1000.0 * F.log(ratio)).cast("long").alias("w"))
        weights = np.zeros(len(dag.terms), np.int64)
        for r in weighed.collect():
            weights[r.t] = r.w
        best = _best_of_tasks(held, dag, weights, documents, total, top)
        names = spark.createDataFrame(list(enumerate(dag.items)), f"place int, item_id {kind}")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
        found.append(ranked.where(F.col("rank") <= top).join(names, "place").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """All documents ranked for every item of the benchmark."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with dt as (
    select row_number() over () r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
it as (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark where item_id is not null),
q as (select item_id, term, count(*) times from it where term <> '' group by 1, 2),
d as (select r, doc_id, len(w) n, w from dt where len(w) > 0),
s as (select count(*) docs, cast(sum(n) as bigint) total from d),
f as (select r, term, count(*) tf from (select r, unnest(w) term from d) where term in (select term from q) group by 1, 2),
w as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1))) as bigint) w from f, s group by term, docs),
c as (
    select f.r, f.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) score
    from f join d on d.r = f.r join w on w.term = f.term, s),
a as (select item_id, r, cast(sum(times * score) as bigint) score from c join q on q.term = c.term group by 1, 2),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) rank from a join d on d.r = a.r where score > 0)
select item_id, cast(rank as int) rank, doc_id, score from k where rank <= 10
"""

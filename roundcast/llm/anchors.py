"""Where long strings occur again: sampled positions that every window shares with its copies.

A window is ``length`` consecutive units, bytes or words, of one text. Its anchor is the run of ``gram`` units in it
with the least hash, the leftmost of several; equal windows have equal anchors at the same place, so that copies
meet by the anchor's hash. Consecutive windows mostly share an anchor, and an occurrence stands for all of them: its
surrounding is the stretch that those windows cover. Anchors that occur once go at once. An anchor whose occurrences
all have one surrounding, by two independent 64-bit hashes, needs no look at the text; the others' different surroundings, each once, are fetched and
handed to a ``matcher``. An anchor with more than ``crowd`` different surroundings, which a task shouldn't hold
together, has its windows grouped by a 128-bit digest of their own. A text is looked at as a whole, in arrays of
about a hundred bytes for each of its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundcast.llm.common import (
    BYTE_CODE,
    POWERS,
    VISIBLE,
    chunks,
    mixed,
    prefix_sums,
    slice_hash,
    stored,
    words_of,
)


class Units(NamedTuple):
    """The units of some texts: hash of each, its bytes, and each text's first unit, with the end."""

    codes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    of: np.ndarray


def byte_units(data: np.ndarray, starts: np.ndarray) -> Units:
    at = np.arange(len(data))
    return Units(BYTE_CODE[data], at, at + 1, starts)


def word_units(data: np.ndarray, starts: np.ndarray) -> Units:
    import xxhash

    first, last, of = words_of(data, starts, VISIBLE)
    # a sum over powers would do for short words only: long ones can be made to collide whatever the base
    view = memoryview(data.tobytes())
    codes = map(xxhash.xxh64_intdigest, map(view.__getitem__, map(slice, first.tolist(), last.tolist())))
    return Units(np.fromiter(codes, np.uint64, len(first)), first, last, of)


def anchored(units: Units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and last window, by their first unit, of each run of windows with one anchor."""
    n = len(units.codes)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none
    sums = prefix_sums(units.codes)
    grams = n - gram + 1
    hashes = mixed((sums[gram:] - sums[:-gram]) * POWERS.down[:grams])
    bits = np.uint64(max(21, n.bit_length()))
    least = ((hashes >> bits) << bits) | np.arange(grams, dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    ends = np.repeat(units.of[1:], np.diff(units.of))[: len(least)]
    window = np.flatnonzero(np.arange(length, len(least) + length) <= ends)
    if not len(window):
        return none.astype(np.uint64), none, none
    anchor = (least[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(window)])) - 1
    return hashes[anchor[begin]], window[begin], window[end]


class Repeats(NamedTuple):
    """How to look for repeated windows. units: texts to units; match: surroundings of anchors to runs of windows."""

    units: Callable[[np.ndarray, np.ndarray], Units]
    length: int
    gram: int
    match: Callable[[pa.Table], Iterator[tuple[int, list[dict]]]]
    #: Whether only an occurrence in another document, with a smaller id, counts.
    across: bool
    crowd: int
    #: Deals surroundings out by their anchor.
    deal: Callable[[DataFrame], DataFrame]


_RUN = pa.struct([("low", pa.int32()), ("high", pa.int32()), ("first", pa.int64())])


def _keyed(docs: DataFrame, doc_id: str, text_col: str) -> DataFrame:
    """doc_id, check (with the id a key even where ids repeat) and text; null is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.hash(text).alias("check"), text.alias("text"))


def _occurrences(docs: DataFrame, how: Repeats, brief: bool) -> DataFrame:
    """A row for each anchor; brief: with the hash and the document only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, starts in chunks(batch["text"]):
                units = how.units(data, starts)
                hashes, first, last = anchored(units, how.length, how.gram)
                doc = np.searchsorted(units.of, first, "right") - 1
                own = pa.array(doc)
                ids = batch["doc_id"].slice(low, high - low).take(own)
                keys = pa.array(hashes.view(np.int64))
                if brief:
                    yield pa.RecordBatch.from_arrays([keys, ids], names=["anchor", "doc_id"])
                    continue
                begin, end = units.first[first], units.last[last + how.length - 1]
                # of other codes than the anchor's hash, so that both together are a digest of 128 bits
                digest = slice_hash(prefix_sums(mixed(units.codes)), first, last + how.length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(digest),
                        ids,
                        batch["check"].slice(low, high - low).take(own),
                        pa.array((first - units.of[doc]).astype(np.int32)),
                        pa.array((last - first + 1).astype(np.int32)),
                        pa.array((begin - starts[doc]).astype(np.int32)),
                        pa.array((end - starts[doc]).astype(np.int32)),
                    ],
                    names=["anchor", "around", "doc_id", "check", "at", "windows", "start", "end"],
                )

    kind = "anchor long, doc_id long" if brief else "anchor long, around long, doc_id long, check int, at int, windows int, start int, end int"
    return docs.mapInArrow(run, kind)


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of each wanted surrounding, cut from the document that it is first in."""
    asked = wanted.select("sample.doc_id", "sample.check", F.struct("anchor", "around", "first", "n", "crowd", "windows", "sample.start", "sample.end").alias("w"))
    asked = asked.groupBy("doc_id", "check").agg(F.collect_list("w").alias("w"))
    met = docs.alias("d").join(asked.alias("a"), F.expr("d.doc_id <=> a.doc_id and d.check = a.check")).select("d.text", "a.w")
    fields = ("anchor", "around", "first", "n", "crowd", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch["text"][row].as_py().encode()
                w = batch["w"][row].values
                cut = [raw[a:b] for a, b in zip(w.field("start").to_pylist(), w.field("end").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(w.field(c) for c in fields), pa.array(cut, pa.binary())], names=[*fields, "body"])

    return met.mapInArrow(run, "anchor long, around long, first long, n long, crowd long, windows int, body binary")


def _matched(texts: DataFrame, how: Repeats) -> DataFrame:
    """Runs of windows of each surrounding; all surroundings of an anchor meet in one sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(part: pa.Table) -> pa.RecordBatch:
            rows, runs = [], []
            for row, found in how.match(part):
                rows.append(row)
                runs.append(found)
            own = part.take(pa.array(rows, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [own["anchor"].combine_chunks(), own["around"].combine_chunks(), pa.array(runs, pa.list_(_RUN))] if rows else
                [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(_RUN))],
                names=["anchor", "around", "runs"],
            )

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                held.append(batch.slice(low, 1000))
                size += held[-1].num_rows
                if size < 4000:
                    continue
                whole = pa.Table.from_batches(held)
                key = whole["anchor"].to_numpy()
                ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                if len(ends):
                    yield answer(whole.slice(0, int(ends[-1])))
                    whole = whole.slice(int(ends[-1]))
                held, size = whole.to_batches(), len(whole)
        if size:
            yield answer(pa.Table.from_batches(held))

    ordered = how.deal(texts).sortWithinPartitions("anchor", F.asc_nulls_last("first"), "around")
    return ordered.mapInArrow(run, "anchor long, around long, runs array<struct<low:int,high:int,first:long>>")


def _crowded(texts: DataFrame, how: Repeats) -> DataFrame:
    """The same for crowded anchors: every window by its own digest, added up before it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch["body"].to_pylist()
            for row, body in enumerate(bodies):
                data = np.frombuffer(body, np.uint8)
                units = how.units(data, np.array([0, len(data)]))
                low = np.arange(len(units.codes) - how.length + 1)
                sums, other = prefix_sums(units.codes), prefix_sums(mixed(units.codes))
                n = len(low)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([batch[c][row].as_py()] * n, pa.int64()) for c in ("anchor", "around", "first", "n")),
                        pa.array(low.astype(np.int32)),
                        pa.array(slice_hash(sums, low, low + how.length).view(np.int64)),
                        pa.array(slice_hash(other, low, low + how.length).view(np.int64)),
                    ],
                    names=["anchor", "around", "first", "n", "low", "one", "two"],
                )

    windows = texts.mapInArrow(run, "anchor long, around long, first long, n long, low int, one long, two long")
    keys = ["anchor", "one", "two"]
    again = windows.groupBy(*keys).agg(F.min("first").alias("top"), F.sum("n").alias("all")).where("all > 1")
    met = windows.join(again, keys).select("anchor", "around", F.struct("low", F.col("low").alias("high"), F.col("top").alias("first")).alias("run"))
    return met.groupBy("anchor", "around").agg(F.sort_array(F.collect_list("run")).alias("runs"))


def repeated_spans(docs: DataFrame, how: Repeats, doc_id: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents, keyed by doc_id and check, and for those with repeats ``spans``: first unit and end unit."""
    keyed = _keyed(docs, doc_id, text_col)
    seen = _occurrences(keyed, how, True)
    if how.across:
        # a null id counts as larger than any other
        own = seen.groupBy("anchor").agg(F.min("doc_id").alias("top"), F.max("doc_id").alias("end"), F.count("*").alias("n"), F.count("doc_id").alias("named"))
        again = own.where("top <> end or (named > 0 and named < n)").select("anchor")
    else:
        again = seen.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # written, so that joins see plain tables on both sides and can split an anchor that holds many rows
    again = stored(again, "again")
    found = stored(_occurrences(keyed, how, False).join(again, "anchor"), "anchors")

    around = found.groupBy("anchor", "around").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min("windows").alias("windows"), F.min(F.struct("doc_id", "check", "start", "end")).alias("sample")
    )
    around = stored(around, "surroundings")
    crowds = stored(around.groupBy("anchor").agg(F.count("*").alias("crowd")), "crowds")
    judged = around.join(crowds, "anchor")
    alone = judged.where("crowd = 1").select(
        "anchor", "around", F.array(F.struct(F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"), "first")).alias("runs")
    )
    texts = stored(_surroundings(keyed, judged.where("crowd > 1")), "bodies")
    runs = reduce(
        DataFrame.unionByName,
        (alone, _matched(texts.where(F.col("crowd") <= how.crowd), how), _crowded(texts.where(F.col("crowd") > how.crowd).dropDuplicates(["anchor", "around"]), how)),
    )
    hits = found.join(runs, ["anchor", "around"]).select("doc_id", "check", "at", F.explode("runs").alias("run"))
    if how.across:
        hits = hits.where("run.first < doc_id or (doc_id is null and run.first is not null)")
    span = F.struct((F.col("at") + F.col("run.low")).alias("first"), (F.col("at") + F.col("run.high") + how.length).alias("end"))
    return keyed, hits.groupBy("doc_id", "check").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with its spans, null where it has none."""
    return keyed.alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.check = s.check"), "left").select("d.doc_id", "d.text", "s.spans")


def merged(spans: pa.Scalar) -> list[tuple[int, int]]:
    """Spans in order as maximal runs; touching runs are one."""
    out: list[list[int]] = []
    if spans.is_valid:
        parts = spans.values
        for a, b in zip(parts.field("first").to_pylist(), parts.field("end").to_pylist(), strict=True):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


def by_anchor(part: pa.Table) -> Iterator[list[int]]:
    """Rows of each anchor in a sorted table, each surrounding once: rows that repeat as a whole give it again."""
    anchor, around = part["anchor"].to_numpy(), part["around"].to_numpy()
    new = np.ones(len(part), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (around[1:] != around[:-1])
    rows = np.flatnonzero(new).tolist()
    for _, own in groupby(rows, key=anchor.__getitem__):
        yield list(own)


"""Suffix-array dedup of bytes.

The suffixes that matter begin a window of ``length`` bytes whose anchor occurs again (see ``anchors``). They are
dealt by the leading bytes of their anchor: sampled splitters cut the order of anchors into ranges, one bucket each.
A bucket sorts its suffixes by multikey quicksort, eight bytes at a time, and only among suffixes that are equal so
far; what is still together after ``length`` bytes occurs more than once. A window's copies share its anchor, so no
two of them lie in different buckets and nothing needs comparing across a boundary but what a crowded anchor
spreads, which meets by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundcast.llm.anchors import Repeats, by_anchor, byte_units, merged, repeated_spans, with_spans
from roundcast.llm.common import table

LENGTH = 200
GRAM = 64
CROWD = 5000


def equal_suffixes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Those suffixes of which another one of the group begins with the same ``length`` bytes.

    Multikey quicksort: each round orders what is still equal by the next eight bytes and lets go of single ones.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(data)]
    for depth in range(0, length, 8):
        keep = min(8, length - depth)
        token = eight[suffix + depth] >> np.uint64(8 * (8 - keep))
        order = np.lexsort((token, group))
        token, group, suffix = token[order], group[order], suffix[order]
        new = np.ones(len(suffix) + 1, bool)
        new[1:-1] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
        shared = ~(new[:-1] & new[1:])
        group = np.cumsum(new[:-1])[shared]
        suffix = suffix[shared]
        if not len(suffix):
            break
    return suffix


def matcher(length: int):
    def match(part: pa.Table) -> Iterator[tuple[int, list[dict]]]:
        counts, windows = part["n"].to_pylist(), part["windows"].to_pylist()
        bodies = part["body"].to_pylist()
        rows = [(row, g) for g, own in enumerate(by_anchor(part)) for row in own]
        data = np.frombuffer(b"".join([bodies[row] for row, _ in rows]), np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(bodies[row]) for row, _ in rows])))
        suffix = np.concatenate([np.arange(begins[i], begins[i] + windows[row]) for i, (row, _) in enumerate(rows)])
        group = np.repeat([g for _, g in rows], [windows[row] for row, _ in rows])
        hit = np.sort(equal_suffixes(data, suffix, group, length))
        at = np.searchsorted(hit, begins).tolist()
        for i, (row, _) in enumerate(rows):
            if counts[row] > 1:
                yield row, [{"low": 0, "high": windows[row] - 1, "first": None}]
            elif at[i + 1] > at[i]:
                own = hit[at[i] : at[i + 1]] - begins[i]
                cut = np.flatnonzero(np.diff(own) > 1)
                low, high = own[np.concatenate(([0], cut + 1))], own[np.concatenate((cut, [len(own) - 1]))]
                yield row, [{"low": a, "high": b, "first": None} for a, b in zip(low.tolist(), high.tolist(), strict=True)]

    return match


def repeats(length: int, gram: int, crowd: int = CROWD) -> Repeats:
    return Repeats(byte_units, length, gram, matcher(length), False, crowd, lambda texts: texts.repartitionByRange("anchor"))


def dedup_bytes(
    docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD
) -> DataFrame:
    """Documents without the bytes of strings of ``length`` bytes that start anywhere else too.

    Returns, for each row of ``docs``, ``doc_id`` (long), ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of
    bytes) and ``kept``, the bytes that stay. Matches lie within one text; overlapping ones count, in one document
    too; all are judged on the input. A null text is empty, and one below ``length`` bytes loses nothing. A row that
    repeats is another place, so both lose what they share. A null id is an id. Other columns are not read; no rows
    give no rows.
    """
    joined = with_spans(*repeated_spans(docs, repeats(length, gram, crowd), doc_id, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, own in zip(batch["text"], batch["spans"], strict=True):
                raw, runs, out, at = text.as_py().encode(), merged(own), [], 0
                for a, b in runs:
                    out.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"first": a, "end": b} for a, b in runs])
                kept.append(b"".join([*out, raw[at:]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents against each other and themselves."""
    done = dedup_bytes(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

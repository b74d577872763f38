"""Packing by concatenate and cut.

Pass one tokenizes and writes, for every document, its ids with its offset among the ids of its partition. Pass two
adds up the partitions' totals and turns them into prefix sums, which make the offsets global; fixed windows then
cut the whole, and a document that crosses a boundary gets a record for each window. Nothing is shuffled but the
totals, one row for each partition of the first pass. The ids live in the written table, so that both passes see
the same order however often a task runs again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundcast.llm.common import stored, table

LENGTH = 4096
END_ID = 2
#: Entries of a worker's caches, some 160 MB together; workers live on after a task.
CACHED_WORDS, CACHED_PIECES = 400_000, 400_000
#: White space of the tokenizer's own pattern among ASCII; some more split() takes for white space.
_SPACES = re.compile(r"[ \t\n\r\v\f]+")
_ODD = re.compile("[\x1c-\x1f]")
#: The tokenizer's pattern for what it merges within, and the characters that stand for bytes.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([*_PLAIN, *sorted(set(range(256)) - set(_PLAIN))], [*_PLAIN, *range(256, 324)], strict=True))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts. The tokenizer drops white space and no token spans it, so ids are kept by word; a word of
    Latin-1 characters is lowered and parted as the tokenizer does, and its parts' ids are kept as well."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = regex.compile(_PIECES).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if "<|" in word or not word.isprintable():
            return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        out = []
        for piece in self.parts(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= CACHED_PIECES:
                    self.pieces.clear()
                tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTES))
                ids = self.pieces[piece] = _packed([t.id for t in tokens])
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        words = _SPACES.split(text) if _ODD.search(text) else text.split()
        known = self.words
        out = [known.get(w) for w in words]
        if None in out:
            if len(known) >= CACHED_WORDS:
                known.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    ids = known.get(words[i])
                    if ids is None:
                        ids = known[words[i]] = self._word(words[i])
                    out[i] = ids
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker, whatever tasks it runs."""
    return WordTokenizer(path)


def token_table(docs: DataFrame, doc_id: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """A row for each document: ids with the end id, and where they begin among those of the partition."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, at = tokenizer_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                own = batch.slice(low, 1000)
                ids = [tokenizer.encode(t or "") + end for t in own["text"].to_pylist()]
                sizes = [len(x) // 4 for x in ids]
                begins = []
                for n in sizes:
                    begins.append(at)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [
                        own["doc_id"],
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(begins, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "part", "begin", "doc_tokens", "ids"],
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, part int, begin long, doc_tokens long, ids binary")


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    Returns ``doc_id``, ``start`` (the document's tokens before the piece), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence and ``ids`` (little-endian unsigned 32-bit). Every sequence but the
    last is full. A null or empty text is the end id alone, so each row of ``docs`` has a piece; repeated rows are
    packed as often as they occur, a null id is carried, other columns are not read, and an empty table has no
    pieces. A text may span any number of sequences.
    """
    tokens = stored(token_table(docs, doc_id, text_col, path or vocabulary(), end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # one row for each partition of the first pass; the prefix sums are the concatenation's global offsets
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # a row for each partition again, so that no ids move for the join
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("base") + F.col("begin"))
    last = F.floor((F.col("at") + F.col("doc_tokens") - 1) / length)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / length), last)))
    first = F.greatest(F.col("at"), F.col("sequence_id") * length)
    end = F.least(F.col("at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * length)
    return cut.select(
        "doc_id",
        (first - F.col("at")).alias("start"),
        (end - first).alias("length"),
        "doc_tokens",
        "sequence_id",
        (first - F.col("sequence_id") * length).alias("offset"),
        F.substring(F.col("ids"), ((first - F.col("at")) * 4 + 1).cast("int"), ((end - first) * 4).cast("int")).alias("ids"),
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed; the ids as their checksum."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

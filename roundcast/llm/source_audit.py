"""How far the sources of a language diverge: term shares compared, with strings joined in late.

Tasks count terms and ship only digests of fixed width: language, source, digest, occurrences and documents. The strings
stay behind in a table that every task writes, one row for each of its terms. Once document frequencies say which
digests are kept, the least and the greatest string of each kept digest are looked up: where they differ, two terms
collide, and counts of such digests are taken again by string. Strings of all others are joined only to the rows of the
result that show them.

Sums over all kept terms of each two sources of a language come from matrices that tasks fill for a share of the
language's terms: rows for the pairs of sources, which the result has anyway, and never rows for pairs at each term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundcast.llm.common import LOWER, stored, table

MIN_DOCUMENTS = 30
TOP = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: Terms that a task counts before it ships them, and cells of a language that a task sums up together.
HELD_TERMS = 500_000
SHARE_CELLS = 200_000

#: Bytes that end a term become spaces, A-Z become small letters; letters and all beyond ASCII stay.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in LOWER.tolist())
_COUNTS = "lang string, source string, digest long, n long, docs long, term string"
_TERM = ["lang", "digest", "form"]


def _counted(docs: DataFrame, bits: int, by_string: bool = False) -> DataFrame:
    """Counts by (lang, source, digest), some for each task; a row with a null digest for each group; and, without
    language and source, a row for each digest and term of the task. ``by_string``: count rows have the term instead.

    bits: of the digest, the upper ones of XXH64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def digests(terms: list[bytes]) -> pa.Array:
            return pa.array((np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)) >> np.uint64(64 - bits)).view(np.int64))

        def rows(lang, source, digest, n, docs, term) -> pa.RecordBatch:
            size = len(digest)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    digest,
                    pa.array(n, pa.int64()),
                    pa.array(docs, pa.int64()),
                    pa.array([t.decode() for t in term], pa.string()) if term else pa.nulls(size, pa.string()),
                ],
                names=["lang", "source", "digest", "n", "docs", "term"],
            )

        def shipped(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
            every: set[bytes] = set()
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield rows(lang, source, digests(terms), n.values(), map(docs.__getitem__, terms), terms if by_string else None)
                yield rows(lang, source, pa.nulls(1, pa.int64()), [0], [0], None)
                if not by_string:
                    every.update(terms)
            if every:
                terms = sorted(every)
                yield rows(None, None, digests(terms), [0] * len(terms), [0] * len(terms), terms)

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                words = text.encode().translate(TERM_BYTES).split()
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n) - before + 1
                if size >= HELD_TERMS:
                    yield from shipped(held)
                    held, size = {}, 0
        yield from shipped(held)

    return docs.mapInArrow(run, _COUNTS)


def _kept_cells(docs: DataFrame, raw: DataFrame, min_documents: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences ``n`` of every kept term by (lang, source, digest, form), and the strings of digests.

    ``form`` is empty but for digests that several terms have: there it is the term.
    """
    counts = raw.where("lang is not null and digest is not null").select("lang", "source", "digest", "n", "docs")
    kept = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
    kept = stored(kept.select("lang", "digest"), "kept_digests")
    strings = raw.where("lang is null").select("digest", "term").join(kept.select("digest").distinct(), "digest", "left_semi")
    strings = stored(strings.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "strings")
    cells = counts.join(kept, ["lang", "digest"]).groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"))
    cells = cells.select("lang", "source", "digest", F.lit("").alias("form"), "n")
    collided = strings.where("term <> last").select("digest")
    if not collided.isEmpty():
        cells = cells.join(collided, "digest", "left_anti").select(*cells.columns)
        again = _counted(docs, bits, by_string=True).where("digest is not null").join(collided, "digest", "left_semi")
        again = again.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        again = stored(again.withColumnRenamed("term", "form"), "split_digests")
        often = again.groupBy(*_TERM).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents).select(*_TERM)
        cells = cells.unionByName(again.join(often, _TERM).select(*cells.columns))
    return stored(cells, "cells"), strings.select("digest", "term")


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE (n + SMOOTHING) / (total + SMOOTHING kept)), in decimals where 64 bits are too few."""
    top = f"cast({n} + {SMOOTHING} as decimal(20,0)) * {SCALE}BD"
    return F.expr(f"1L + ({top}) div (cast({total} as decimal(20,0)) + {SMOOTHING} * cast(kept as decimal(17,0)))")


def _pair_sums(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| over the terms of each (lang, bucket), for each two sources of the language.

    Of a bucket come first its sources, with the share of a term that they haven't got, then the shares of its terms.
    """

    def summed(lang: str, part: pa.Table) -> Iterator[pa.RecordBatch]:
        digest = part["digest"].combine_chunks()
        heads = np.flatnonzero(digest.is_null().to_numpy(zero_copy_only=False))
        p, source = part["p"].to_numpy(), part["source"].to_pylist()
        names = [source[k] for k in heads]
        place = {name: k for k, name in enumerate(names)}
        none = p[heads]
        term = np.zeros(len(part) - len(heads), np.int64)
        if len(term):
            d, form = digest.slice(len(heads)).to_numpy(), part["form"].slice(len(heads)).to_pylist()
            new = (d[1:] != d[:-1]) | np.fromiter((a != b for a, b in zip(form, form[1:], strict=False)), bool, len(form) - 1)
            term[1:] = np.cumsum(new)
        at, p = np.array([place[s] for s in source[len(heads) :]], np.int64), p[len(heads) :]
        terms, many = (int(term[-1]) + 1 if len(term) else 0), len(names)
        step, block = max(1, cells // max(many, 1)), max(1, cells // max(many, 1))
        for first in range(0, many, block):
            last = min(first + block, many)
            total = np.zeros((last - first, many), np.int64)
            for low in range(0, terms, step):
                a, b = np.searchsorted(term, [low, low + step])
                shares = np.tile(none, (min(step, terms - low), 1))
                shares[term[a:b] - low, at[a:b]] = p[a:b]
                for k in range(first, last):
                    total[k - first, k + 1 :] += np.abs(shares[:, k + 1 :] - shares[:, k : k + 1]).sum(axis=0)
            for k in range(first, last):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (many - k - 1), pa.string()), pa.array([names[k]] * (many - k - 1), pa.string()), pa.array(names[k + 1 :], pa.string()), pa.array(total[k - first, k + 1 :])],
                    names=["lang", "a", "b", "value"],
                )

    def keys(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        return zip(batch["lang"].to_pylist(), batch["bucket"].to_pylist(), strict=True)

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        at = 0
        for key, same in groupby(keys(batch)):
            n = sum(1 for _ in same)
            if key != now and held:
                yield from summed(now[0], pa.Table.from_batches(held))
                held = []
            now = key
            held.append(batch.slice(at, n))
            at += n
    if held:
        yield from summed(now[0], pa.Table.from_batches(held))


def source_audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text_col: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP,
    bits: int = 64,
    share_cells: int = SHARE_CELLS,
) -> DataFrame:
    """Divergence of sources: ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` (from 1, by value, then item).

    Terms are runs of letters and whatever is beyond ASCII, A-Z in lower case; a language keeps those in at least
    ``min_documents`` of its documents. Part ``pair``: every other source of the language, with the sum of differences of
    term shares. Part ``term``: at most ``top`` terms that the source has a larger share of than the language.

    A null language, source or text counts as empty; a group without terms has its pairs. Every row is a document, rows
    that repeat too. Without kept terms all values of a language are 0. Other columns are not read; no rows give no rows.
    The sources of one language are held together, for the result has a row for each two of them; a text is held whole.
    """
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang), ("source", source), ("text", text_col))])
    raw = stored(_counted(slim, bits), "term_counts")
    cells, strings = _kept_cells(slim, raw, min_documents, bits)
    sizes = cells.groupBy(*_TERM).agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    sizes = sizes.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"), F.sum("cells").alias("cells"))
    groups = raw.where("lang is not null").select("lang", "source").distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total", "cells"])
    buckets = F.greatest(F.lit(1), F.ceil(F.col("cells") / share_cells)).cast("int")
    groups = stored(groups.withColumn("buckets", buckets), "groups")

    placed = cells.join(groups, ["lang", "source"])
    shares = placed.select("lang", F.pmod(F.hash("digest", "form"), F.col("buckets")).alias("bucket"), "digest", "form", "source", _share("n", "total").alias("p"))
    none = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    # without kept terms there is nothing to share out
    base = F.when(F.col("kept") > 0, _share("0L", "total")).otherwise(F.lit(0))
    none = none.select("lang", "bucket", F.lit(None).cast("long").alias("digest"), F.lit("").alias("form"), "source", base.alias("p"))
    dealt = none.unionByName(shares).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", F.asc_nulls_first("digest"), "form", "source")
    sums = dealt.mapInArrow(lambda batches: _pair_sums(batches, 1 << 22), "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    # all sources of a term: as many rows as the language has sources, at most
    own = placed.withColumn("lang_n", F.sum("n").over(Window.partitionBy(*_TERM)))
    own = own.withColumn("value", _share("n", "total") - _share("lang_n", "lang_total")).where("n > 0 and value > 0")
    best = own.select("lang", "source", "digest", "form", "value").withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"))))
    named = best.where(F.col("place") <= top).join(strings, "digest")
    item = F.when(F.col("form") == "", F.col("term")).otherwise(F.col("form"))
    named = named.select("lang", "source", F.lit("term").alias("part"), item.alias("item"), "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(named).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    """All sources of all documents."""
    return source_audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with d as (
    select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w
    from documents),
t as (select lang, source, term, count(*) n, count(distinct r) docs from (select r, lang, source, unnest(w) term from d) where term <> '' group by 1, 2, 3),
k as (select lang, term, sum(n) n from t group by 1, 2 having sum(docs) >= 30),
v as (select lang, count(*) v, sum(n) n from k group by 1),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, coalesce(t.n, 0) n from g join k on k.lang = g.lang left join t on t.lang = g.lang and t.source = g.source and t.term = k.term),
gn as (select lang, source, sum(n) n from c group by 1, 2),
p as (select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 5)) // (gn.n + 5 * v.v) p
    from c join gn on gn.lang = c.lang and gn.source = c.source join v on v.lang = c.lang),
q as (select k.lang, k.term, 1 + (1000000000::hugeint * (k.n + 5)) // (v.n + 5 * v.v) q from k join v on v.lang = k.lang),
pair as (select a.lang, a.source, b.source item, coalesce(s.value, 0) value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source, y.source item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, p.term item, p.p - q.q as value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
r as (select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item) rank from pair
    union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 50
"""

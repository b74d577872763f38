"""Line dedup by prefix doubling over line ids.

Every line that isn't blank has an id, a 128-bit digest, and the lines of a document are a sequence of ids. Names of
runs of 1, 2, 4 ... lines come from the names of their halves, and of other lengths from those of two such runs: equal
runs, wherever they are, have equal names, so the ranks of a suffix array need no agreement between tasks.

A run of ``min_words`` words or more that starts at an earlier place too is a copy and goes, whatever its number of
lines. Doubling stops where every run has so many words: each line of a longer copy lies in a copy that can be
shortened at its front or at its end no further, so those are named and no others. Suffixes with one name are an interval
of a common prefix at least that long; the first of an interval, by id and line, is the original. Copies that advance in
step with their originals make up maximal repeated runs, and the length of such a run is the common prefix of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundcast.llm.common import parted, stored, table

MIN_WORDS = 5
_VISIBLE = "[^\\x20\\x09-\\x0D]"


def _pair(a: Column, b: Column) -> Column:
    """The name of two runs side by side."""
    return F.struct(
        F.xxhash64(a["a"], a["b"], b["a"], b["b"]).alias("a"),
        F.xxhash64(F.lit("second"), a["a"], a["b"], b["a"], b["b"]).alias("b"),
    )


def _name(ids: str, at: Column, lines: int) -> Column:
    """The name of the run of ``lines`` lines at ``at``: of its first 2^k lines and the rest."""
    if lines == 1:
        return F.get(ids, at)
    half = 1 << (lines - 1).bit_length() - 1
    return _pair(_name(ids, at, half), _name(ids, at + half, lines - half))


def _least_runs(lines: int, min_words: int) -> Column:
    """Runs of so many lines, from ``ids`` and ``words``, that have enough words, but not without their first or last line."""

    def least(i: Column) -> Column:
        own = [F.get("words", i + k) for k in range(lines)]
        whole = sum(own[1:], own[0])
        return (whole >= min_words) & ((whole - own[0] < min_words) | (whole - own[-1] < min_words))

    starts = F.when(F.size("ids") >= lines, F.sequence(F.lit(0), F.size("ids") - lines)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(F.filter(starts, least), lambda i: F.struct(i.alias("at"), F.lit(lines).alias("lines"), _name("ids", i, lines).alias("name")))


def named_runs(docs: DataFrame, doc_id: str, text_col: str, min_words: int) -> DataFrame:
    """doc_id, check, ``at`` (place among the lines that aren't blank), ``lines`` and the run's name."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.hash(text).alias("check"), text.alias("text"))
    full = F.filter(F.split("text", "\n"), lambda x: x.rlike(_VISIBLE))
    ids = F.transform("full", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b")))
    # words are as many as their starts
    words = F.transform("full", lambda x: F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    df = keyed.select("doc_id", "check", full.alias("full")).select("doc_id", "check", ids.alias("ids"), words.alias("words"))
    # a line has a word, so min_words lines are enough
    every = F.concat(*[_least_runs(n, min_words) for n in range(1, min_words + 1)])
    # outer, for the filter that a plain explode sets below itself would compute all names again for each line
    many = df.select("doc_id", "check", F.explode_outer(every).alias("run")).where("run is not null")
    return many.select("doc_id", "check", "run.at", "run.lines", "run.name")


def later_copies(runs: DataFrame) -> DataFrame:
    """Runs whose name has an earlier place, with that of the original."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")
    heads = runs.groupBy("name", "lines").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1")
    # written, so that the join sees a plain table and can split a name that holds many rows
    return runs.join(stored(heads.drop("n"), "heads"), ["name", "lines"]).where(place > F.col("head"))


def repeated_runs(
    docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Maximal later copies of line runs: ``doc_id``, ``first`` and ``lines``, with the original's ``of_doc`` and ``of_first``.

    Places count the lines that aren't blank. Copies whose originals advance in step make up one run; where the
    original changes, another begins. A null text has no runs.
    """
    copies = later_copies(named_runs(docs, doc_id, text_col, min_words)).select(
        "doc_id", "check", "at", (F.col("at") + F.col("lines")).alias("end"), F.col("head.doc_id").alias("of_doc"), F.col("head.at").alias("of_at")
    )
    step = Window.partitionBy("doc_id", "check", "of_doc", F.col("at") - F.col("of_at")).orderBy("at", "end")
    before = F.max("end").over(step.rowsBetween(Window.unboundedPreceding, -1))
    cut = copies.withColumn("new", F.coalesce(F.col("at") > before, F.lit(True)).cast("int"))
    numbered = cut.withColumn("run", F.sum("new").over(step.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("doc_id", "check", "of_doc", (F.col("at") - F.col("of_at")).alias("by"), "run")
    runs = grouped.agg(F.min("at").alias("first"), F.max("end").alias("end"), F.min("of_at").alias("of_first"))
    return runs.select("doc_id", "first", (F.col("end") - F.col("first")).alias("lines"), "of_doc", "of_first")


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Texts without later copies of line runs of ``min_words`` words or more.

    Returns, for each row of ``docs``, ``doc_id``, ``n_lines``, ``n_removed`` and ``text``: the lines that stay, blank
    ones included, joined by newlines. Lines are parted by \\n and compared as they are; blank ones belong to no run.
    The original is the first by (id, line) and stays; a copy later in the same document goes too. A null text has no
    lines. Rows with one id and one text are one place, so neither is the other's copy. A null id comes last. The
    columns named in ``carry`` come along as c0, c1 ...; others are not read; no rows give no rows.
    """
    copies = later_copies(named_runs(docs, doc_id, text_col, min_words))
    gone = copies.select("doc_id", "check", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lines") - 1)).alias("at"))
    gone = stored(gone.groupBy("doc_id", "check").agg(F.collect_set("at").alias("gone")), "gone_lines")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.hash(text).alias("check"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    along = [f"c{i}" for i in range(len(carry))]
    # texts that lose no line are not shuffled; by the size of its packed file, the table would be broadcast when it is large
    touched, whole = parted(keyed, gone, ["doc_id", "check"])
    met = touched.alias("d").join(gone.hint("merge").alias("g"), F.expr("d.doc_id <=> g.doc_id and d.check = g.check"), "left").select("d.*", "g.gone")
    met = met.unionByName(whole.withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType)))
    split = met.select("doc_id", "text", "gone", *along, F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    # places in the text of the lines that are not blank, then of those that stay
    full = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(_VISIBLE))
    placed = split.withColumn("full", full)
    out = placed.withColumn("out", F.transform("gone", lambda i: F.get("full", i)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    kept = out.withColumn("stay", stay).withColumn(
        "text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    )
    return kept.select(
        "doc_id",
        F.size("full").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        "text",
        *along,
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All lines of all documents."""
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, p, ls[p] line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) p from d)),
f as (select doc_id, p, line, row_number() over (partition by doc_id order by p) nth,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) n
    from l where regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> ''),
w as (select doc_id, nth, list(line) over five ls, list(n) over five ns from f
    window five as (partition by doc_id order by nth rows between current row and 4 following)),
r as (select doc_id, nth, n, ls[1:n] run, list_sum(ns[1:n]) t, ns[1] a, ns[n] z from w, range(1, 6) x(n) where len(ls) >= n),
k as (select *, row_number() over (partition by run order by doc_id, nth) k from r where t >= 5 and (t - a < 5 or t - z < 5)),
gone as (select distinct f.doc_id, f.p from k join f on f.doc_id = k.doc_id and f.nth >= k.nth and f.nth < k.nth + k.n where k.k > 1)
select d.doc_id, cast(any_value(coalesce(c, 0)) as bigint) n_lines, cast(count(gone.p) as bigint) n_removed,
    sha256(coalesce(string_agg(case when gone.p is null then l.line end, chr(10) order by l.p), '')) kept_sha256
from d join l on l.doc_id = d.doc_id left join gone on gone.doc_id = l.doc_id and gone.p = l.p
left join (select doc_id, count(*) c from f group by 1) n on n.doc_id = d.doc_id
group by d.doc_id
"""

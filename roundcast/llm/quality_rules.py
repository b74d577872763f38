"""Document rules compiled into one projection.

The threshold table is data: a row names a ratio, a lower and an upper bound. ``compiled`` turns it into one boolean
column, so that a pass over the texts evaluates all rules with built-in functions only, without a shuffle.

The stop-word bound holds for texts of the four languages of ``STOP_WORDS``: a clean text in another language has none of
these words and fails it, so such a corpus needs thresholds without that row, or words of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundcast.llm.common import table


class Bound(NamedTuple):
    ratio: str
    least: float | None
    most: float | None


#: Length, symbol, stop-word and line ratios that a document must keep within.
THRESHOLDS = (
    Bound("mean_word_chars", 2.0, 14.0),
    Bound("symbols_per_word", None, 0.1),
    Bound("shouts_per_word", None, 0.3),
    Bound("dup_lines", None, 0.5),
    Bound("stop_words", 0.02, None),
)
#: Frequent words of the four languages; a text of any of them has some.
STOP_WORDS = (
    "the of and to in is that it for with on as are was be this by from at an a",
    "der die das und in zu den von mit ist im für auf nicht ein eine dem des als sich auch",
    "le la les de des et un une du en que qui pour dans par sur au aux il elle avec pas",
    "el la los las de del y en que un una por con para es no se su al lo como",
)
LEAST_WORDS = 50
_SPACE = "[\\x20\\x09-\\x0D]+"
_VISIBLE = "[^\\x20\\x09-\\x0D]"
_SYMBOLS = "[#*$%&|<>]"
#: One run for each word in capitals.
_SHOUTS = "\\p{Lu}{2,}"


def stop_words() -> list[str]:
    words = {w for line in STOP_WORDS for w in line.split()}
    return sorted(words | {w.capitalize() for w in words})


def measured(docs: DataFrame, doc_id: str, text_col: str) -> DataFrame:
    """Counts for each document. Words are split once, and windows of three words are hashed and sorted with their
    places, so that repeats stand side by side: n log n in the words of a text, whatever it repeats."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = slim.select("doc_id", text.alias("text"), F.filter(F.split(text, _SPACE), lambda w: w != "").alias("words"))
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(1), n - 2),
                lambda i: F.struct(
                    F.xxhash64(F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)).alias("h"), i.alias("at")
                ),
            )
        ),
    ).otherwise(F.expr("cast(array() as array<struct<h:bigint,at:int>>)"))
    sorted_windows = split.withColumn("windows", windows)
    repeated = F.sort_array(
        F.transform(
            F.filter(
                "windows",
                lambda x, i: (x["h"] == F.get("windows", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("windows", i - 1)["h"])),
            ),
            lambda x: x["at"],
        )
    )
    placed = sorted_windows.withColumn("repeated", repeated).drop("windows")
    covered = F.aggregate(
        "repeated",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, at: F.struct((a["n"] + F.least(F.lit(3), at - a["last"])).alias("n"), at.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_VISIBLE))
    stops = stop_words()
    counted = placed.withColumn("lines", lines).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit(_SHOUTS)).alias("n_shouts"),
        F.size(F.filter("words", lambda w: w.isin(stops))).alias("n_stops"),
    )
    return counted


def _ratios() -> dict[str, Column]:
    def per(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "shouts_per_word": per("n_shouts", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "stop_words": per("n_stops", "n_words"),
    }


def compiled(thresholds: tuple[Bound, ...]) -> Column:
    """The threshold table as one condition."""
    ratios, holds = _ratios(), F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            holds &= ratios[name] >= least
        if most is not None:
            holds &= ratios[name] <= most
    return holds


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    thresholds: tuple[Bound, ...] = THRESHOLDS,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Counts, ratios and verdict for each row of ``docs``.

    ``base_failed``: fewer than ``least_words`` words, or more than half of them in repeated three-word windows.
    ``kept``: not that, and every ratio within its bounds. A null or empty text has zero of everything and fails.
    Repeated rows and null ids give a row each; other columns are not read; an empty table gives no rows.
    """
    counts = measured(docs, doc_id, text_col)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumns(_ratios()).withColumn("kept", ~F.col("base_failed") & compiled(thresholds))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents against the rules."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_bounds() -> str:
    parts = []
    for name, least, most in THRESHOLDS:
        parts += [f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None)
    return " and ".join(parts)


OP6_SQL = rf"""
with t as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') ls from t),
win as (select doc_id, i, w[i:i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) where c > 1),
cov as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 3)) p from rep) group by 1),
c as (select w.doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines,
    coalesce(n, 0) n_repeat_words, len(ls) n_lines,
    len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) n_shouts,
    len(list_filter(w, lambda x: list_contains({_sql_list(stop_words())}, x))) n_stops
    from w left join cov on cov.doc_id = w.doc_id),
r as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    coalesce(word_chars / nullif(n_words, 0), 0) mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) symbols_per_word,
    coalesce(n_shouts / nullif(n_words, 0), 0) shouts_per_word,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) dup_lines, coalesce(n_stops / nullif(n_words, 0), 0) stop_words from c)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
    cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
    not base_failed and {_sql_bounds()} kept
from r
"""

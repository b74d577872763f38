"""A content-addressed WARC archive.

Payload bytes are stored once for each SHA-256 digest; whether the digest really stands for one payload is checked
when they are stored. Exact record headers are stored on their own. A record is its header, the payload that its
digest names, and the record end; joining the two tables by digest gives the original records back, byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundcast.llm.common import stored, table
from roundcast.session import scratch_path

#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 1000
#: Fixed by the WARC format.
_VERSION, _EOL, _END = "WARC/1.1", "\r\n", "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _one_line(value: Column) -> Column:
    """A header value must not end its line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\r\n]+", " ")


def _header(kind: Column, page_id: str, url: str) -> Column:
    revisit = F.lit("revisit")

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    return F.concat(
        F.lit(_VERSION + _EOL),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", _one_line(F.col(url)), F.col(url).isNotNull()),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        line("WARC-Profile", F.lit(_PROFILE), kind == revisit),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">")), kind == revisit),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.col("_bytes").cast("string")),
        line("Content-Length", F.when(kind == revisit, F.lit(0)).otherwise(F.col("_bytes")).cast("string")),
        F.lit(_EOL),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write ``path``/payloads and ``path``/headers.

    The payload is the text in UTF-8; null is empty. Of the pages with equal payloads of at least ``revisit_bytes``
    bytes the one with the largest id is a response, with null below every id, and the others revisit it; of repeated
    rows with that id each is a response. Below that size each page is a response. Other columns are not read; an
    empty table gives an empty archive.
    """
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    slim = pages.select(
        F.col(page_id).alias("_page"), F.col(url).cast("string").alias("_url"), body.alias("_body")
    ).select("_page", "_url", "_body", F.sha2("_body", 256).alias("_sha256"), F.octet_length("_body").cast("long").alias("_bytes"))
    # a fast second hash of all bytes tells apart what a digest would wrongly put together
    payloads = slim.groupBy("_sha256").agg(
        F.max("_body").alias("body"), F.min(F.xxhash64("_body")).alias("low"), F.max(F.xxhash64("_body")).alias("high")
    )
    sound = F.when(F.col("low") == F.col("high"), F.col("_sha256")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    payloads.select(sound.alias("digest"), "body").write.parquet(f"{path}/payloads")

    firsts = slim.where(F.col("_bytes") >= revisit_bytes).groupBy("_sha256").agg(F.max("_page").alias("_first"), F.count("*").alias("n"))
    # written, so that the join sees a plain table and can split a payload that many pages have
    firsts = stored(firsts.where("n > 1").drop("n"), "firsts")
    rows = slim.select("_page", "_url", "_sha256", F.sha1("_body").alias("_sha1"), "_bytes").join(firsts, "_sha256", "left")
    kind = F.when(F.col("_first").isNull() | F.col("_first").eqNullSafe(F.col("_page")), F.lit("response")).otherwise(F.lit("revisit"))
    rows.select(
        F.col("_page").alias("page_id"), F.col("_sha256").alias("digest"), _header(kind, "_page", "_url").alias("header")
    ).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Original records: ``page_id``, ``digest``, ``header``, ``payload`` (the full one, also of a revisit) and
    ``record``, the bytes of the WARC record. A payload whose bytes don't have its digest raises an error."""
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("body", 256) == F.col("digest"), F.col("body")).otherwise(
        F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest")))
    )
    joined = spark.read.parquet(f"{path}/headers").join(payloads.select("digest", checked.alias("payload")), "digest", "left")
    own = F.when(header_value("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "UTF-8"), own, F.encode(F.lit(_END), "UTF-8"))
    return joined.select("page_id", "digest", "header", "payload", record.alias("record"))


def header_value(name: str) -> Column:
    """A field of the header, null where it is missing."""
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; all but the id comes from what was read."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path)
    return back.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"),
        F.regexp_extract("header", r"(?m)^WARC-Refers-To: <urn:page:([^>]*)>", 1).try_cast("bigint").alias("refers_to"),
    )


OP10_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
q as (select page_id, b, octet_length(b) n, sha1(b) d, max(page_id) over (partition by b) top from p)
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
    case when n < 1000 or page_id = top then 'response' else 'revisit' end record_type,
    case when n < 1000 or page_id = top then null else top end refers_to
from q
"""

"""WARC as a content-addressed archive: payload bytes once by strong digest, record headers apart.

An archive is a folder of two tables. `payloads` holds each different payload once under its SHA-256,
`headers` the exact header bytes of every record and the digest of the payload that it is about. Reading
verifies each stored payload against its digest and length, parses the header bytes, and joins the two;
`records` gives back the records' exact bytes, `export` writes them as .warc text files.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is the
response, the others are revisits of it. Defined cases: a null payload is empty; a null url is an empty
header value, line breaks in it are percent-encoded; a null page_id is smaller than any other; rows of
equal page_id and payload are each a record, of which one with the smallest url is the response; an empty table makes an empty
archive; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_dir, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
SALTS = 32
END = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them make four characters."""
    def chars(g: int) -> list[Column]:
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[c for g in range(8) for c in chars(g)])


def digested(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256), "sha1": F.sha1("payload")})


def header(kind: Column, refers: Column) -> Column:
    """The header block's exact text. Revisits have no block of their own."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit(END))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        line("WARC/1.1"), line("WARC-Type: ", kind), line("WARC-Record-ID: <urn:page:", page, ">"), line("WARC-Date: ", DATE), line("WARC-Target-URI: ", url),
        line("WARC-Payload-Digest: sha1:", base32(F.col("sha1"))), line("Content-Type: text/html; charset=utf-8"),
        F.when(revisit, F.concat(line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To: <urn:page:", F.coalesce(refers.cast("string"), F.lit("")), ">"), line("X-Payload-Length: ", F.col("bytes").cast("string")))).otherwise(F.lit("")),
        line("Content-Length: ", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(END),
    )


def write(pages: DataFrame, to: str, least: int = 0) -> None:
    """Make the archive of pages (page_id, url, html) in the folder `to`, which every machine can reach."""
    rows = digested(pages)
    thin = rows.drop("payload").groupBy("page_id", "url", "sha256", "sha1", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    # One response for each content: the largest page_id, of its records that with the smallest url.
    first = thin.groupBy("sha256", "bytes", "page_id").agg(F.min("url").alias("url"), F.sum("copies").alias("n"))
    first = first.groupBy("sha256", "bytes").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("n").alias("n"))
    spread = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > SALTS, SALTS - 1).otherwise(0))).alias("salt")
    first = first.select("sha256", "bytes", "top", "n", spread)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    # Contents that stand once or a few times have one copy of their row, and their records look only there.
    often = thin.withColumn("salt", salt).join(first.where(F.col("n") > SALTS), ["sha256", "bytes", "salt"])
    seldom = thin.join(first.where(F.col("n") <= SALTS).drop("salt"), ["sha256", "bytes"]).withColumn("salt", F.lit(0).cast("long"))
    both = seldom.unionByName(often.withColumn("salt", F.col("salt").cast("long")))
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    lead = F.col("page_id").eqNullSafe(F.col("top.page_id")) & (F.col("url") == F.col("top.url")) & (F.col("copy") == 1)
    kind = F.when((F.col("bytes") < least) | lead, "response").otherwise("revisit")
    each.select("page_id", "sha256", header(kind, F.col("top.page_id")).cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{to}/headers")
    # Payloads move once, copies of one content combined before.
    rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{to}/payloads")


def field(head: str, name: str) -> Column:
    """A field's value from the exact header text, whose lines end at line feeds alone: urls may hold any other sign."""
    return F.regexp_extract(head, rf"(?md)^{name}: ([^\r\n]*)", 1)


def parsed(heads: DataFrame, kind: str, head: str = "head") -> DataFrame:
    """Adds page_id (of the type `kind`), record_type, payload_digest, refers_to and said_bytes from the header text."""
    number = lambda c: F.nullif(F.regexp_extract(c, "(?s)<urn:page:(.*)>", 1), F.lit("")).cast(kind)
    return heads.select(
        "*", number(field(head, "WARC-Record-ID")).alias("page_id"), field(head, "WARC-Type").alias("record_type"), F.regexp_extract(field(head, "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        number(field(head, "WARC-Refers-To")).alias("refers_to"), F.coalesce(F.nullif(field(head, "X-Payload-Length"), F.lit("")), field(head, "Content-Length")).cast("long").alias("said_bytes"),
    )


def read_headers(spark: SparkSession, at: str) -> DataFrame:
    """(sha256, header, page_id, record_type, payload_digest, refers_to, said_bytes), all but sha256 out of the header bytes."""
    h = spark.read.parquet(f"{at}/headers")
    return parsed(h.select("sha256", "header", F.col("header").cast("string").alias("head")), dict(h.dtypes)["page_id"]).drop("head")


def verified(spark: SparkSession, at: str) -> DataFrame:
    """(sha256, payload) of the stored payloads; one that doesn't match its digest fails the read."""
    p = spark.read.parquet(f"{at}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), "sha256"))
    return p.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def records(spark: SparkSession, at: str) -> DataFrame:
    """(page_id, record, payload): exact record bytes, and the full payload, of revisits too."""
    joined = read_headers(spark, at).join(verified(spark, at), "sha256")
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select("page_id", F.concat("header", block, F.lit(END + END).cast("binary")).alias("record"), "payload")


def export(spark: SparkSession, at: str, to: str) -> None:
    """The archive as WARC files: a record's two closing line ends are the text writer's separator."""
    r = records(spark, at).select(F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value"))
    r.write.option("lineSep", END + END).text(to)


def read_back(spark: SparkSession, at: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, rebuilt whole and parsed again:
    a response is measured by its own block, a revisit by the stored payload that it is about."""
    kept = verified(spark, at).select("sha256", "payload", F.octet_length("payload").cast("long").alias("bytes"), base32(F.sha1("payload")).alias("digest"))
    h = spark.read.parquet(f"{at}/headers")
    kind = dict(h.dtypes)["page_id"]
    is_response = F.col("record_type") == "response"
    heads = read_headers(spark, at).select("sha256", "header", "record_type")
    # Responses are as many as contents, or short; payloads go to them alone.
    record = F.concat("header", "payload", F.lit(END + END).cast("binary"))
    whole = heads.where(is_response).join(kept.select("sha256", "payload"), "sha256").select(record.alias("record"))
    head = F.concat(F.substring_index(F.col("record").cast("string"), END + END, 1), F.lit(END))
    cut_ = whole.select(head.alias("head"), "record")
    block = F.expr("substring(record, octet_length(head) + 3, octet_length(record) - octet_length(head) - 6)")
    responses = parsed(cut_.select("head", block.alias("block")), kind).select("page_id", F.octet_length("block").cast("long").alias("bytes"), base32(F.sha1("block")).alias("digest"), "payload_digest", "said_bytes", "record_type", "refers_to")
    text = F.substring_index(F.concat("header", F.lit(END + END).cast("binary")).cast("string"), END + END, 1)
    about = heads.where(~is_response).join(kept.drop("payload"), "sha256").select(F.concat(text, F.lit(END)).alias("head"), "bytes", "digest")
    revisits = parsed(about, kind).select(*responses.columns)
    right = (F.col("digest") == F.col("payload_digest")) & (F.col("bytes") == F.col("said_bytes"))
    checked = F.when(right, F.col("digest")).otherwise(F.raise_error(F.lit("a header contradicts its payload")))
    return responses.union(revisits).select("page_id", F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), at)
    return read_back(spark, at)


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM r
"""

"""License scan by canonical digest lookup: texts are normalised (case, punctuation, white space, copyright lines,
equivalent spellings), hashed, and joined by hash to the digests of known licences; so are their single lines, to those
of known notices. The known side is broadcast while it is within KNOWN_ROWS.

Known are the texts, the digests of long texts, and the notices of license_texts; any other set is a table that is given
(known_licenses, or licenses_in for a folder of licence texts).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .license_texts import DIGESTS, EQUIVALENT, EQUIVALENT_PAIRS, LICENSES, NOTICES

KNOWN_ROWS = 100_000
#: Fixed pattern: a line that states a copyright, not a sentence about one.
COPYRIGHT_LINE = r"^[\s#*/;.\-]*(copyright\s*(\(c\)|©|[0-9<\[{])|\(c\)|©)"

#: Fixed pattern: such a line and those that go on with it, which follow at once and are set in by four places or more.
CONTINUED = (
    r"(?m)(^[ \t]{0,3}[#*/;.\-]*[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)|©)[^\n]*)(?:\n[ \t]{4,}[^ \t\n\r\f\v][^\n]*)+"
)

_COPYRIGHT, _CONTINUED = re.compile(COPYRIGHT_LINE), re.compile(CONTINUED)
_WORD = re.compile(r"[^\W_]+")


def one_spelling(words: str) -> str:
    """Words that are written as one, apart, or with a hyphen, and pairs of words that mean the same, in one way."""
    for apart, together in EQUIVALENT_PAIRS.items():
        if apart in words:
            words = re.sub(f"(^| ){apart}", rf"\1{together}", words)
    return words


def canonical_lines(text: str | None) -> list[str]:
    """The lines that hold words and are not copyright lines, nor go on with one: lower-case words in their first spelling,
    one space apart. Pairs of words are left to one_spelling, since a text may break its lines within one."""
    found = []
    for line in _CONTINUED.sub(r"\1", (text or "").lower()).split("\n"):
        words = _WORD.findall(line)
        if words and not _COPYRIGHT.match(line):
            found.append(" ".join([EQUIVALENT.get(w, w) for w in words]))
    return found


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def text_digest(text: str | None) -> str:
    """Independent of how the text is broken into lines."""
    return digest(one_spelling(" ".join(canonical_lines(text))))


KNOWN = "digest string, kind string, license string"


def known_rows(
    licenses: dict[str, str] | None = None, notices: dict[str, str] | None = None, digests: dict[str, str] | None = None
) -> list[tuple[str, str, str]]:
    """Rows of KNOWN; kind: "text" or "line". licenses, notices: text to name; digests: digest of a whole text to name."""
    rows = [(text_digest(t), "text", n) for t, n in (LICENSES if licenses is None else licenses).items()]
    rows += [(d, "text", n) for d, n in (DIGESTS if digests is None else digests).items()]
    return rows + [(text_digest(t), "line", n) for t, n in (NOTICES if notices is None else notices).items()]


def known_licenses(spark: SparkSession, *known: dict[str, str] | None) -> DataFrame:
    """KNOWN, of known_rows. Of names with one digest the first counts."""
    rows = spark.createDataFrame(known_rows(*known), KNOWN)
    return rows.groupBy("digest", "kind").agg(F.min("license").alias("license"))


def licenses_in(spark: SparkSession, folder: str) -> DataFrame:
    """KNOWN for a folder of whole licence texts, each in a file named after its licence (`GPL-3.0.txt`, `MIT`)."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    name = F.regexp_replace("file", r"\.(txt|md)\z", "")
    digests = scan_licenses(files.select(name.alias("doc_id"), F.col("value").alias("text")), spark.createDataFrame([], KNOWN))
    return digests.select("digest", F.lit("text").alias("kind"), F.col("doc_id").alias("license")).groupBy("digest", "kind").agg(
        F.min("license").alias("license")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines = [], []
        for text in batch.column("text"):
            found = canonical_lines(text.as_py())
            texts.append(digest(one_spelling(" ".join(found))))
            lines.append([digest(x) for x in dict.fromkeys(map(one_spelling, found))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(texts), pa.array(lines, pa.list_(pa.string()))],
            names=["doc_id", "row", "digest", "lines"],
        )


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license, notices for each row of docs(doc_id, text).

    digest: of the whole normalised text (that of the empty text for null, empty and wordless texts). license: the known
    licence that the whole text is, or null. notices: the licences whose notices are lines of the text, sorted and
    joined by commas; empty if none. Repeated rows give repeated rows; other columns are not read. Empty table: empty
    result.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    small = known.count() <= KNOWN_ROWS
    of_kind = {k: known.where(F.col("kind") == k).select(F.col("digest").alias("k_digest"), "license") for k in ("text", "line")}
    of_kind = {k: F.broadcast(v) if small else v for k, v in of_kind.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        _digests, f"doc_id {kind}, row long, digest string, lines array<string>"
    )
    # A null line carries the document's row through the join of lines; only lines that are known leave the task.
    lines = rows.select("doc_id", "row", "digest", F.explode(F.concat("lines", F.array(F.lit(None).cast("string")))).alias("line"))
    key = F.coalesce("line", F.col("row").cast("string"))  # spreads the rows without a line if the join shuffles
    lines = lines.join(of_kind["line"], key == F.col("k_digest"), "left").drop("k_digest")
    lines = materialise(lines.where("line is null or license is not null"), "license-lines")
    notices = lines.where("line is not null").groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("found"))
    notices = notices.select(F.col("row").alias("n_row"), F.array_join("found", ",").alias("notices"))
    out = lines.where("line is null").select("doc_id", "row", "digest")
    out = out.join(notices, F.col("row") == F.col("n_row"), "left")
    out = out.join(of_kind["text"], F.col("digest") == F.col("k_digest"), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))

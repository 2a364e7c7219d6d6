"""Licence scan by canonical digest: entire texts are normalised, digested and joined to digests of known licences.

Normalising follows the usual matching rules for licence texts: case, punctuation
and white space don't count, nor do lines of copyright notice, list marks at a
line's start and lettered marks anywhere, and equivalent spellings are one word. It consists of built-in string
functions only; known texts and documents pass through the same expressions.

The table of known digests is made from the module `licenses`; it has some three dozen
rows whatever the input (checked against MOST_KNOWN), so it is broadcast.

Defined cases: a null text is empty; an empty text, or one of nothing but
punctuation and copyright lines, matches nothing; repeated rows each get their
row; an empty table gives no rows; further columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import licenses

MOST_KNOWN = 200

# Words that licence texts spell in more than one way, and the spelling that stands for both.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while",
    "wilful": "willful", "noncommercial": "non commercial", "sublicence": "sub license", "sublicense": "sub license",
    "sublicensing": "sub licensing", "per cent": "percent", "copyright owner": "copyright holder", "https": "http",
}

MARKS = r"[ \t\r*#/;-]*"
OF_WHEN = r"([<\[{(]?(19|20)[0-9][0-9]|[<\[{]|year|yyyy)"
# A notice has a sign, a year or a place for one, or rights reserved; or it opens a paragraph. Lines of wrapped sentences do neither.
COPYRIGHT_LINE = (
    rf"\n{MARKS}(copyright[ \t:,]*(\(c\)|©|{OF_WHEN})|(\(c\)|©)[ \t]*(copyright|{OF_WHEN})|copyright[^\n]*all rights reserved)[^\n]*"
    rf"|(^|\n{MARKS})(\n{MARKS}(copyright|©)[^\n]*)+"
)
# A letter with a bracket or point, or a digit with a bracket, is a mark wherever it stands, as wrapping may put it at a line's start.
LIST_MARK = r"\n[ \t\r]*([*+•-]|\(?[0-9a-z][.)])[ \t]+|[ \t\n](\(?[0-9a-z]\)|[a-z]\.)"
NOT_WORD = r"[^\p{L}\p{N}]+"


def spaced(words: str) -> str:
    """Words with two spaces between them and one at either end, as `canonical` keeps them while it swaps spellings."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """The words that are left, one space between them; empty if there are none."""
    body = F.lower(F.concat(F.lit("\n"), F.coalesce(text.cast("string"), F.lit(""))))
    body = F.regexp_replace(body, COPYRIGHT_LINE, "")
    body = F.regexp_replace(body, LIST_MARK, "\n")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(body, NOT_WORD, "  ")), F.lit(" "))
    for spelling, stands in EQUIVALENT.items():
        words = F.replace(words, F.lit(spaced(spelling)), F.lit(spaced(stands)))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null where nothing is left of it."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id and license_digest; licences whose canonical texts agree share the first id."""
    rows = sorted((texts or licenses.KNOWN).items())
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"{len(rows)} known licences are more than {MOST_KNOWN}; join them without the broadcast")
    frame = spark.createDataFrame(rows, "license_id string, text string").select("license_id", digest(F.col("text")).alias("license_digest"))
    return frame.filter("license_digest IS NOT NULL").groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """A row per document: doc_id, text_digest, license_id (null where its entire text is no known licence)."""
    own = docs.select("doc_id", digest(F.col("text")).alias("text_digest"))
    joined = own.join(F.broadcast(known(docs.sparkSession, texts)), F.col("text_digest") == F.col("license_digest"), "left")
    return joined.select("doc_id", "text_digest", "license_id")

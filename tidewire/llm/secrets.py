"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for credentials (the three base kinds) and for further candidates (the
kinds in ``MORE``). Candidate values are hashed, and the hashes counted over the whole corpus by
distinct repositories (documents) and distinct owners (sources). A value that many owners carry
is a widely copied example; a value of few owners looks live. Base spans are always reported;
further candidates become spans only when they look live.

Positions come from splitting the text at the matches, so all work stays in DataFrame functions,
and texts are never shuffled: only candidates are.

Defined cases: null counts as an empty text; repeated rows (equal doc_id and text) are one
repository; a null source is an owner of its own; spans of one kind do not overlap, those of several kinds may; texts and values of any
length are read whole; no rows give no rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed patterns: (kind, pattern, group that is the value, least length of that group).
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# Further candidates: well-known token forms.
MORE = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    # through the END line, whatever is between but another BEGIN or END; a key cut off before it, through its header lines and
    # lines of base64 (after a space or a written line break only long ones, since words look like short ones)
    ("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
     r"|(?:\r?\n(?:[A-Za-z0-9-]++:[^\r\n]*+|[A-Za-z0-9+/=]*+)(?=[\r\n]|\z)|(?:\s|\\[rn])*+[A-Za-z0-9+/=]{40,}+)*+)", 0, 20),
]
#: A value carried by at least this many owners and repositories is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 8, 16

SPAN = "array<struct<start:bigint,kind_nr:int,kind:string,end:bigint,value:bigint>>"
# What a text must hold for a kind to match at all: a cheaper test than the pattern itself.
GATES = {"assign": r"[:=]\x20*[\x22']?[A-Za-z0-9+/_.=-]{6}", "access": "AKIA", "hex": "[0-9a-f]{24}", "private_key": "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"}


def spans_of(text: Column, nr: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All spans of one kind, code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(whole)), lambda g: F.length(g)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["whole"])
        one = F.array(F.struct(start.alias("start"), F.lit(nr).alias("kind_nr"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(p["value"]).alias("value"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(F.length(p["value"]) >= least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(SPAN)
    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    return F.when(text.rlike(GATES.get(kind, pattern)), found).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, owner and all candidate spans of each text, in one scan of the texts."""
    text = F.coalesce("text", F.lit(""))
    all_ = [spans_of(text, nr, *kind) for nr, kind in enumerate(BASE + MORE)]
    return docs.select("doc_id", F.col("source").alias("owner"), F.sort_array(F.concat(*all_)).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repositories, n_owners: distinct documents and sources of every candidate value.
    Counts are summed by owner first, so a value in a third of all rows stays a few rows a task."""
    one = found.select("doc_id", "owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value")).dropDuplicates(["doc_id", "owner", "value"])
    by_owner = one.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id and spans: an array of (start, kind_nr, kind, end, value, live), by start, then kind.
    One row per row of ``docs``."""
    found = written(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "candidates")
    known = ownership(found)
    flat = found.select("row", F.explode("found").alias("s")).withColumn("value", F.col("s.value"))
    example = (F.col("n_owners") >= example_owners) & (F.col("n_repositories") >= example_repositories)
    judged = flat.join(known, "value").select("row", F.struct("s.start", "s.kind_nr", "s.kind", "s.end", "s.value", (~example).alias("live")).alias("s"))
    judged = judged.filter((F.col("s.kind_nr") < len(BASE)) | F.col("s.live"))
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans"))  # spans of one text
    none = F.array().cast("array<struct<start:bigint,kind_nr:int,kind:string,end:bigint,value:bigint,live:boolean>>")
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind_nr"] < len(BASE))
    counts = [F.size(F.filter("spans", partial(lambda k, s: s["kind"] == k, kind))).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), live.alias("n_live"), (F.size("spans") - live).alias("n_example"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each live span, or run of overlapping ones, replaced by [SECRET]."""
    live = F.filter(spans, lambda s: s["live"])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("[SECRET]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    out = F.aggregate(live, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(live) > 0, out).otherwise(text)

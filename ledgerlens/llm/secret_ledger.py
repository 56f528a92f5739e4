"""Secret scans over an incremental blob ledger.

Every version of every text is content-addressed (SHA-256).  The ledger has a
row for each blob that was scanned, with the rule versions it was scanned for
and the spans found.  A scan reads only the blobs that lack one of the given
rule versions, once each however many rows hold them, and evaluates only the
missing rules.  Findings are then joined back to all rows (paths) by address.

Only DataFrame functions are used.  Spans come from one regular expression
pass for the matches and, where there are any, one more for the gaps between
them; starts are running sums of gap and match lengths in code points, so the
work is linear in a text and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, sized, store


@dataclass(frozen=True)
class Rule:
    """``kind`` with its version; a match counts if ``group`` has ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of at least n characters are written {n,} where that matches the same
#: spans as "+" and a length check (no shorter match can hide a longer one).
BASE_RULES = (
    Rule("assign", 1, r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Further rules; their spans are added, base spans stay.
MORE_RULES = (
    # to the END line, or without one to the end of the base64 lines
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----"
                   r"|(?:[\x20\t\r\n\\]+[A-Za-z0-9+/=]{12,}){1,80}[A-Za-z0-9+/=\r\n\\]*)?"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("vcs", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("login", 2, r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:long,rank:int,kind:string,end:long,version:int>"


def _blob(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``blob, spans`` for the blobs ``(blob, text, done)`` that have findings of
    a rule whose key isn't in the array ``done``."""
    found = blobs.select("blob", "text", *(
        F.when(~F.array_contains("done", r.key), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m_{i}")
        for i, r in enumerate(rules)))
    found = found.where(" or ".join(f"size(m_{i}) > 0" for i in range(len(rules))))
    hits = found.select("blob", F.explode(F.array(*(
        F.when(F.size(f"m_{i}") > 0, F.struct(
            F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"), F.col(f"m_{i}").alias("matches")))
        for i, r in enumerate(rules)))).alias("h")).where("h is not null").withColumn("rank", F.col("h.rank"))
    hits = hits.dropDuplicates(["blob", "rank"])          # a row that is repeated whole brings its blob twice
    each = hits.select("blob", "rank", "h.kind", "h.version", F.posexplode(F.arrays_zip(
        F.slice("h.gaps", 1, F.size("h.matches")).alias("gap"), F.col("h.matches").alias("text"))).alias("n", "x"))
    run = Window.partitionBy("blob", "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("blob", "rank", "kind", "version", F.col("x.text").alias("text"),
                         F.sum(F.col("x.gap") + F.length("x.text")).over(run).alias("end"))
    keeps = F.lit(False)
    for i, r in enumerate(rules):
        keeps = keeps | ((F.col("rank") == i) & (F.length(F.regexp_extract("text", r.pattern, r.group)) >= r.least))
    return (placed.where(keeps)
            .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
                (F.col("end") - F.length("text")).cast("long").alias("start"), "rank", "kind", F.col("end").cast("long").alias("end"), "version"))).alias("spans")))


def scan(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(paths, entries)``.

    ``entries``: the ledger rows to append, ``blob, done, spans`` — one for each
    blob scanned now, with the rule keys evaluated now and their spans (an empty
    array if nothing was found).  ``paths``: a row for each row of ``docs``,
    ``doc_id, blob, spans`` with all spans known for its blob under ``rules``,
    sorted by start, then by the rules' order.

    A null text is the empty blob.  Repeated rows, and versions of one id, are
    rows of their own; equal texts share a blob.  Null ids stay null.  Empty
    tables give empty results.  A blob held by very many rows is scanned once;
    the findings are stored before the join back, so that they are broadcast if
    small and a hot blob's rows are split by adaptive skew handling if not.
    """
    keys = F.array(*(F.lit(r.key) for r in rules))
    paths = store(docs.select(F.col(id_col).alias("doc_id"), _blob(text_col).alias("blob")), "paths")
    if ledger is None:
        ledger = docs.sparkSession.createDataFrame([], f"blob string, done array<string>, spans array<{SPAN}>")
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"))
    firsts = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    unseen = (firsts.join(done, "blob", "left")
              .select("blob", "doc_id", F.coalesce("done", F.array().cast("array<string>")).alias("done"))
              .where(F.size(F.array_except(keys, "done")) > 0))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the light side is the hash side, so that texts are moved once and not sorted
    todo = unseen.select("blob", F.col("doc_id").alias("first_id"), "done").hint("shuffle_hash")
    blobs = (texts.withColumn("address", _blob("text"))
             .join(todo, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("address") == F.col("blob")))
             .select("blob", "text", "done"))
    spans = store(scan_blobs(blobs, rules), "spans")
    entries = (unseen.join(spans, "blob", "left")
               .select("blob", F.array_except(keys, "done").alias("done"),
                       F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")))
    known = ledger.select("blob", "spans").where(F.size("spans") > 0).union(spans)
    # findings of the given rule versions only, ranked by their order here
    place = F.array_position(keys, F.concat_ws("@", "s.kind", "s.version")).cast("int")
    known = known.select("blob", F.explode("spans").alias("s")).where(place > 0)
    known = known.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
        "s.start", (place - 1).alias("rank"), "s.kind", "s.end", "s.version"))).alias("spans"))
    found = (paths.join(store(known, "known"), "blob", "left")
             .select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")))
    return found, entries


def joined(spans, base: bool = False) -> F.Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = [r.kind for r in BASE_RULES]
    col = F.filter(spans, lambda s: s["kind"].isin(kinds)) if base else F.col(spans)
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, paths: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mark``; overlapping
    spans are one.  Rows are matched by content address alone, so versions of
    one id keep their own spans.  All columns of ``docs`` stay as they are."""
    t = F.col(text_col)
    spans = store(paths.where(F.size("spans") > 0).groupBy(F.col("blob").alias("__blob"))
                  .agg(F.first("spans").alias("__spans")), "blob-spans")
    held = spans.agg(F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()[0]
    # texts stay where they are as long as all spans together are few
    spans = sized(spans) if held <= BROADCAST_ROWS else spans.hint("shuffle_hash")
    rows = docs.withColumn("__address", _blob(text_col)).join(spans, F.col("__address") == F.col("__blob"), "left")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate("__spans", state, lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
        s["end"].alias("at"),
        F.when(s["start"] < a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(
            F.substring(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))).alias("parts"))))
    clean = rows.withColumn("__cut", cut)
    text = F.when(F.col("__spans").isNull(), t).otherwise(F.concat(
        F.array_join("__cut.parts", ""), F.substring(t, (F.col("__cut.at") + 1).cast("int"), F.length(t))))
    return clean.withColumn(text_col, text).select(*docs.columns)

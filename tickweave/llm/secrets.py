"""Secret scan with an incremental blob ledger (operator 3).

Every historical version of every path is addressed by the SHA-256 of its
text.  A blob is scanned once for each rule version, whatever number of paths
and versions hold it; pairs that an earlier run has in its ledger are not
scanned again.  The ledger is a Parquet table of (blob, rule version, spans)
in a shared folder, which every run reads and appends to; findings are what it
says about the blobs, joined back to all paths.  Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import cut, text_or_empty

SPAN = "array<struct<start:bigint,stop:bigint>>"
FOLD = 256


@dataclass(frozen=True)
class Rule:
    """kind: name; pattern: leftmost non-overlapping matches; least: code points that ``group`` of a match needs; sure: a pattern found in every text that has a kept match."""

    kind: str
    pattern: str
    group: int
    least: int
    sure: str
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base patterns.  Runs that are too short for access and hex
# can't hold a longer one, so their least length is part of the pattern.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", _ASSIGN, 2, 8, _ASSIGN[:-2] + "{8})"),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)


def _match_spans(text: Column, rule: Rule) -> Column:
    """Spans of kept matches in code points, end exclusive.

    Text between matches comes from split, the matches from regexp_extract_all
    by the same pattern; their lengths add up to the positions.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p).cast("long"))
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.transform(
        matches,
        lambda m: F.struct(F.length(m).cast("long").alias("n"), (F.length(m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least).alias("kept")),
    )
    zipped = F.zip_with(between, pairs, lambda gap, m: F.struct(F.coalesce(gap, F.lit(0).cast("long")).alias("gap"), F.coalesce(m["n"], F.lit(0).cast("long")).alias("n"), F.coalesce(m["kept"], F.lit(False)).alias("kept")))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["n"]
        return F.struct(stop.alias("at"), F.when(x["kept"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(acc["spans"]).alias("spans"))

    def placed(all_: Column) -> Column:
        # folds copy what they have gathered, so they run over slices of FOLD matches
        slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int"))), lambda i: F.slice(all_, i * FOLD + 1, F.lit(FOLD)))
        lengths = F.transform(slices, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x["gap"] + x["n"]))
        offsets = F.aggregate(
            lengths, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"],
        )
        return F.flatten(F.zip_with(slices, offsets, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])))

    return F.transform(F.array(zipped), placed)[0]


def scan_unseen(versions: DataFrame, text_col: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Additions to the ledger: blob, rule (kind@version), spans of each pair that the ledger lacks, empty spans included."""
    text = text_or_empty(text_col)
    blob = F.sha2(text.cast("binary"), 256)
    blobs = versions.select(blob.alias("blob"), text.alias("text"))
    if ledger is None:
        new = {r: F.lit(True) for r in rules}
    else:
        known = ledger.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(*[F.bool_or(F.col("rule") == r.key).alias(f"_{r.kind}") for r in rules])
        full = known.filter(reduce(Column.__and__, [F.col(f"_{r.kind}") for r in rules]))
        # digests alone tell which blobs have something to scan; only their texts move
        unseen = versions.select(blob.alias("blob")).distinct().join(full, "blob", "left_anti").join(known, "blob", "left")
        blobs = blobs.join(unseen, "blob")
        new = {r: ~F.coalesce(F.col(f"_{r.kind}"), F.lit(False)) for r in rules}
    blobs = blobs.dropDuplicates(["blob"])
    none = F.array().cast(SPAN)
    entries = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.when(new[r] & F.col("text").rlike(r.sure), _match_spans(F.col("text"), r)).otherwise(none).alias("spans"), new[r].alias("new")) for r in rules])
    return blobs.select("blob", F.explode(entries).alias("e")).filter("e.new").select("blob", "e.rule", "e.spans")


def findings_of(versions: DataFrame, path_col: str, text_col: str, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """path, blob, and for each rule an array ``kind`` of (start, stop), of every row: what the ledger says about its blob."""
    held = ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    found = held.groupBy("blob").agg(*[F.max(F.when(F.col("rule") == r.key, F.col("spans"))).alias(r.kind) for r in rules])
    paths = versions.select(F.col(path_col).alias("path"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("blob"))
    return paths.join(found, "blob", "left").select("path", "blob", *[F.coalesce(F.col(r.kind), F.array().cast(SPAN)).alias(r.kind) for r in rules])


def scan_with_ledger(versions: DataFrame, path_col: str, text_col: str, ledger_path: str, first: bool, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One run: reads the ledger (none yet, if it is the first), scans unseen pairs, appends them, and gives all rows' findings.

    A run that fails before its append is committed leaves the ledger as it
    was; one repeated after the append finds nothing unseen.  A pair that two
    runs append has equal spans and counts once.  An empty table appends
    nothing and gives no rows.  Otherwise as scan_versions.
    """
    spark: SparkSession = versions.sparkSession
    known = None if first else spark.read.parquet(ledger_path)
    scan_unseen(versions, text_col, known, rules).write.mode("append").parquet(ledger_path)
    return findings_of(versions, path_col, text_col, spark.read.parquet(ledger_path), rules)


def scan_versions(versions: DataFrame, path_col: str, text_col: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, additions to the ledger).

    findings: a row for each input row: path, blob, and for each rule an array
    ``kind`` of (start, stop).  additions: blob, rule (kind@version), spans, one
    row for each pair not in the given ledger, empty spans included; append
    them to the ledger after the run.

    Null text is the empty blob.  Repeated rows share one blob and give one
    row each.  An empty table gives empty results.  Two rules' spans may
    overlap, one rule's may not.  Other columns are ignored.
    """
    additions = cut(scan_unseen(versions, text_col, ledger, rules))
    full = additions if ledger is None else ledger.select("blob", "rule", "spans").unionByName(additions)
    return findings_of(versions, path_col, text_col, full, rules), additions


def listed(kinds: list[str]) -> Column:
    """'kind:start:end' of all spans by start, then kind in the given order, comma-joined."""
    def marked(kind: str, order: int) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    parts = [marked(k, i) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(text: Column, kinds: list[str], mark: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans count as one."""
    spans = F.array_sort(F.concat(*[F.col(k) for k in kinds]))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, empty, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))))

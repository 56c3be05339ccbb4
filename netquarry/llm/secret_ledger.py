"""Secrets in versioned content, scanned once per blob and rule version.

Every version of every path is addressed by the SHA-256 of its content. A ledger holds which rule
versions have seen which blob, and what they found. A scan takes only the pairs that the ledger
does not hold, in one copy of each blob, writes the findings and then the pairs, and joins
all findings of the blobs at hand back to their paths. Everything is DataFrame operations.

Positions come from the text itself: the matches of a rule are wrapped in marks that no rule can
match, the text is split at the marks, and the lengths of the pieces are added up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.llm.staging import stage, stage_path

OPEN, MIDDLE, CLOSE, OTHER = "\ue000", "\ue001", "\ue002", "\ue003"
NO_PATH = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """``lead`` and ``value`` are matched one after the other; a match counts where the value has
    ``least`` characters. ``hint``: text that every match holds. A change needs a new version."""

    kind: str
    lead: str
    value: str
    least: int
    hint: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"

    @property
    def pattern(self) -> str:
        return f"({self.lead})({self.value})"


#: The three base rules, in the order in which ties are listed.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=-]+",
        12,
    ),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18, "AKIA"),
    Rule("hex", "", r"[0-9a-f]{16,}", 16),
)
#: Further kinds, each with a shape of its own.
RULES = (
    *BASE,
    Rule("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, "PRIVATE KEY"),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, "eyJ"),
    Rule("code_host", "", r"gh[opsu]_[A-Za-z0-9]{36,}", 1, "gh"),
    Rule("chat", "", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, "xox"),
)
FINDINGS_DDL = "blob binary, kind string, start int, end int, rule string"
SEEN_DDL = "blob binary, rules array<string>"


def blob_of(content: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text, blob, path (never null)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        blob_of(F.col("text")).alias("blob"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_PATH)).alias("path"),
    )


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A part of the ledger; empty before the first scan."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pending(rows: DataFrame, seen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, path of one copy, wanted: the rules that have not seen the blob."""
    blobs = rows.groupBy("blob").agg(F.min("path").alias("path"))
    known = seen.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("known"))
    every = F.array(*(F.lit(r.key) for r in rules))
    wanted = F.when(F.col("known").isNull(), every).otherwise(
        F.array_except(every, F.col("known"))
    )
    return (
        blobs.join(known, "blob", "left")
        .select("blob", "path", wanted.alias("wanted"))
        .filter(F.size("wanted") > 0)
    )


def matches(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, start, end (code points, end exclusive), rule from blob, text, wanted."""
    text = F.col("text")
    marked_before = text.contains(OPEN) | text.contains(MIDDLE) | text.contains(CLOSE)
    clean = F.when(
        marked_before, F.translate(text, OPEN + MIDDLE + CLOSE, OTHER * 3)
    ).otherwise(text)
    found = []
    for r in rules:
        hit = text.rlike(r.pattern)
        if r.hint is not None:
            hit = text.contains(r.hint) & hit
        marked = F.regexp_replace(clean, r.pattern, f"{OPEN}$1{MIDDLE}$2{CLOSE}")
        found.append(
            F.when(
                F.array_contains("wanted", r.key) & hit,
                F.struct(
                    F.lit(r.kind).alias("kind"),
                    F.lit(r.key).alias("rule"),
                    F.lit(r.least).alias("least"),
                    F.split(marked, f"[{OPEN}{MIDDLE}{CLOSE}]").alias("pieces"),
                ),
            )
        )
    hits = texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("m"))
    pieces = hits.select(
        "blob", "m.kind", "m.rule", "m.least", F.posexplode("m.pieces").alias("at", "piece")
    ).select("blob", "kind", "rule", "least", "at", F.length("piece").alias("size"))
    # pieces come as outside, lead, value, outside, ...
    order = Window.partitionBy("blob", "rule").orderBy("at")
    placed = pieces.withColumn(
        "end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("lead", F.lag("size").over(order))
    return placed.filter((F.col("at") % 3 == 2) & (F.col("size") >= F.col("least"))).select(
        "blob",
        "kind",
        (F.col("end") - F.col("size") - F.col("lead")).cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        "rule",
    )


def scan(
    rows: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger in the folder ``ledger`` up to date with ``rows`` (see :func:`versions`).
    Returns all findings of the given rules in it, and the pairs scanned now (blob, rules).

    Findings are written before the pairs: a run that dies between the two scans those blobs
    again, and the same findings are stored twice but read once."""
    spark = rows.sparkSession
    seen = stored(spark, f"{ledger}/seen", SEEN_DDL)
    todo = pending(rows, seen, rules)
    work = f"{ledger}/work/{stage_path(spark, 'scan').rsplit('-', 1)[-1]}"
    todo.write.parquet(work)  # the anti-join reads what is appended below
    todo = spark.read.schema("blob binary, path long, wanted array<string>").parquet(work)
    # repeated rows, and rows without an id, share blob and path; their texts are the same
    copies = rows.join(todo, ["blob", "path"]).dropDuplicates(["blob", "path"])
    texts = copies.select("blob", "text", "wanted")
    matches(texts, rules).write.mode("append").parquet(f"{ledger}/findings")
    done = todo.select("blob", F.col("wanted").alias("rules"))
    done.write.mode("append").parquet(f"{ledger}/seen")
    findings = spark.read.schema(FINDINGS_DDL).parquet(f"{ledger}/findings")
    current = findings.filter(F.col("rule").isin([r.key for r in rules]))
    return current.distinct(), done


def digests(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: counts and the joined spans."""
    base = [r.kind for r in BASE]
    rank = F.coalesce(
        *(F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules))
    )
    listed = findings.select(
        "blob", F.struct("start", rank.alias("rank"), "end", "kind").alias("span")
    )
    grouped = listed.groupBy("blob").agg(F.array_sort(F.collect_list("span")).alias("all"))

    def joined(spans: Column) -> Column:
        return F.concat_ws(
            ",",
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])),
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    return grouped.select(
        "blob",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("all", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )


def secrets(
    docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row of ``docs``.

    Null and empty texts hold nothing. Repeated rows share a blob. A null doc_id is kept. Extra
    columns are ignored. Without ``ledger`` the scan starts from an empty one."""
    rows = versions(docs)
    ledger = ledger or stage_path(docs.sparkSession, "secrets", "ledger")
    findings, _ = scan(rows, ledger, rules)
    none = F.lit(0).cast("long")
    # stored, so that the join's sides are both plain exchanges and Spark can split a hot blob
    found = stage(digests(findings, rules), "secret-digests")
    return (
        rows.select("doc_id", "blob")
        .join(found, "blob", "left")
        .select(
            "doc_id",
            *(F.coalesce(f"n_{r.kind}", none).alias(f"n_{r.kind}") for r in BASE),
            F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
            F.coalesce("spans", F.lit("")).alias("spans"),
        )
    )


def merged_spans(findings: DataFrame) -> DataFrame:
    """blob, spans: array of (start, end) in order, overlapping ones joined."""
    order = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int")
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    islands = findings.withColumn("fresh", fresh).withColumn("island", island)
    return (
        islands.groupBy("blob", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )


def redacted(
    docs: DataFrame,
    ledger: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    mask: str = "[secret]",
) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask``; other texts stay as they are.
    The columns, their order and the number of rows do not change."""
    spark = docs.sparkSession
    ledger = ledger or stage_path(spark, "secrets", "ledger")
    findings, _ = scan(versions(docs), ledger, rules)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    text = F.col("d.text")
    spans = F.col("s.spans")

    def lead(span: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, begin + 1, span["start"] - begin), F.lit(mask))

    rest = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    masked = F.when(spans.isNull(), text).otherwise(
        F.concat(F.concat_ws("", F.transform(spans, lead)), rest)
    )
    spans_of = stage(merged_spans(findings), "secret-spans")
    keyed = docs.alias("d").join(
        spans_of.alias("s"), blob_of(F.col("d.text")) == F.col("s.blob"), "left"
    )
    return keyed.select(
        *(masked.alias(c) if c == "text" else column
          for c, column in zip(docs.columns, columns, strict=True))
    )

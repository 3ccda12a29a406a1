r"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed. The ledger, a Parquet folder, holds each pair of
blob and rule version that was scanned, with the spans found, clean pairs too. A scan finds the
blobs that some rule version has not seen, scans those, appends the new pairs to the ledger, and
joins the ledger's findings back to all paths that hold the blob.

All of it is DataFrame expressions. A rule is a pattern; the matches and the pieces of text
between them come from two built-in functions, and running sums of their lengths are the spans.

Plan: patterns are tried where a text is read, before any exchange, and only matches travel; of
equal blobs the findings are summed in each task, so a group of copies sends one row from each.
From an empty ledger no text is shuffled (each copy of a blob is tried where it lies, which costs
less than bringing the copies together). With a ledger, rows first meet the blobs that are not
whole in it: by broadcast where Spark knows that side to be small, else by shuffle. Rows meet
their blob's findings in a salted join.

Edge cases: a null text is an empty blob. Repeated rows are versions of their own with equal
findings. Matches of one rule never overlap; those of different rules may. An empty table gives
none, and an empty ledger is one that has seen nothing. A very long text is scanned whole, in one
task. Other columns of the input are ignored, or, by ``redact``, given back whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, field, restored, salted, salts


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts (0: all), and the least length."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values. In the last two the least length stands in the pattern, which finds the same: a
#: run is either long enough from its first fitting place or nowhere.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

_SPAN = "struct<start int, end int, rank int, kind string>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"
_SIZES = "array<struct<gap int, size int, judged int>>"


def _matches(text: Column, rule: Rule) -> Column:
    """For each match: the length of the text since the match before, its own, and what is judged."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.slice(F.split(text, rule.pattern), F.lit(1), F.size(found))
    pairs = F.zip_with(between, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    sizes = F.zip_with(pairs, judged, lambda p, j: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), F.length(j).alias("judged")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), sizes.cast(_SIZES)).otherwise(F.expr(f"cast(array() as {_SIZES})"))


#: Tasks among which the rows of one blob are dealt when they meet its findings.
SALTS = 16


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows as versions: path and blob, the address of its content, and the content."""
    text = F.coalesce(field(docs, text_col).cast("string"), F.lit(""))
    return carried(docs).select(field(docs, id_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("content"))


def _marks(rules: tuple[Rule, ...]) -> list[str]:
    return [f"{r.kind}@{r.version}" for r in rules]


def _seen(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """For each blob of the ledger the rule versions of ``rules`` that it holds: blob, seen."""
    mark = F.concat_ws("@", "rule", "version")
    return ledger.where(mark.isin(_marks(rules))).groupBy("blob").agg(F.collect_set(mark).alias("seen"))


def _spans(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans of the blobs in ``found`` (blob, content, seen) by the rules not in seen: blob, rule, version, spans; none without a match."""
    entries = []
    for rank, rule in enumerate(rules):
        fresh = ~F.array_contains("seen", f"{rule.kind}@{rule.version}")
        matches = F.when(fresh, _matches(F.col("content"), rule))
        entries.append(F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), matches.alias("m")))
    scanned = found.select("blob", F.explode(F.array(*entries)).alias("e")).select("blob", "e.*").where("size(m) > 0")
    # copies give equal matches
    keys = ("blob", "rank", "rule", "version", "least")
    once = scanned.groupBy(*keys).agg(F.first("m").alias("m"))
    lines = once.select(*keys, F.posexplode("m").alias("n", "m")).select(*keys, "n", "m.*")
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*keys).orderBy("n")).cast("int")
    lines = lines.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("size"))
    span = F.struct("start", "end", "rank", F.col("rule").alias("kind"))
    spans = F.collect_list(F.when(F.col("judged") >= F.col("least"), span))
    return lines.groupBy(*keys).agg(F.array_sort(spans).cast(f"array<{_SPAN}>").alias("spans")).drop("rank", "least")


def _unseen(found: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """The versions whose blob some rule version has not seen, with the ones that have."""
    nothing = F.expr("cast(array() as array<string>)")
    if ledger is None:
        return found.withColumn("seen", nothing)
    known = _seen(ledger, rules)
    blobs = found.select("blob").distinct().join(known, "blob", "left").withColumn("seen", F.coalesce("seen", nothing))
    blobs = blobs.where(F.size("seen") < len(rules)).withColumn("salt", F.explode(salts(SALTS)))
    return found.withColumn("salt", salted(SALTS, "path")).join(blobs, ["blob", "salt"]).drop("salt")


def scan_unseen(found: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, version, spans) for the blobs of ``found``, as ``versions`` gives.

    ``ledger`` has at least blob, rule and version. A pair of blob and rule version that it holds
    is not scanned. Pairs without a finding are rows too.
    """
    new = _unseen(found, ledger, rules)
    each = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(f"{r.kind}@{r.version}").alias("mark")) for r in rules]))
    pairs = new.groupBy("blob").agg(F.first("seen").alias("seen")).select("blob", "seen", each.alias("r"))
    pairs = pairs.where(~F.array_contains("seen", F.col("r.mark"))).select("blob", "r.rule", "r.version")
    out = pairs.join(_spans(new, rules), ["blob", "rule", "version"], "left")
    return out.select("blob", "rule", "version", F.coalesce("spans", F.expr(_NO_SPANS)).alias("spans"))


def _findings(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """All spans of each blob that has one, by the rules at hand, in text order."""
    current = F.concat_ws("@", "rule", "version").isin(_marks(rules)) & (F.size("spans") > 0)
    return rows.where(current).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def _joined_back(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Each version with its blob's spans."""
    hits = hits.withColumn("salt", F.explode(salts(SALTS)))
    out = found.select("path", "blob").withColumn("salt", salted(SALTS, "path")).join(hits, ["blob", "salt"], "left")
    return out.select(F.col("path").alias("doc_id"), "blob", F.coalesce("spans", F.expr(_NO_SPANS)).alias("spans"))


def find_secrets(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Findings for each input row: doc_id, blob, spans (array of start, end, rank, kind in text order).

    ``ledger`` is a former scan's table of blob, rule, version, spans; its findings count too.
    Nothing is written; ``scan_into_ledger`` does that.
    """
    found = versions(docs, id_col, text_col)
    rows = _spans(_unseen(found, ledger, rules), rules)
    if ledger is not None:
        rows = rows.unionByName(ledger.select("blob", "rule", "version", "spans"))
    return _joined_back(found, _findings(rows, rules))


def scan_into_ledger(
    docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``find_secrets`` with the ledger in the folder ``path``, which is made or grows by the new pairs.

    The pairs are written before anything is returned, and findings are read back from there. A
    failed write commits nothing, and the next scan finds the same pairs unseen.
    """
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    found = versions(docs, id_col, text_col)
    scan_unseen(found, spark.read.parquet(path) if exists else None, rules).write.mode("append").parquet(path)
    return _joined_back(found, _findings(spark.read.parquet(path), rules))


def spans_string(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by [kind]; columns as before.

    Rows in which no pattern matches pass where they are read. The others meet the spans of their
    blob, as a scan from an empty ledger finds them, in a salted join, and only they travel.
    """
    rows = carried(docs)
    text = field(docs, text_col).cast("string")
    some = F.lit(False)
    for rule in rules:
        some = some | F.coalesce(F.regexp_like(text, F.lit(rule.pattern)), F.lit(False))
    clean, dirty = rows.where(~some), rows.where(some)
    dirty = dirty.select("row", field(docs, id_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("content"))
    hits = _findings(_spans(_unseen(dirty, None, rules), rules), rules).withColumn("salt", F.explode(salts(SALTS)))
    joined = dirty.withColumn("salt", salted(SALTS, "path", "blob")).join(hits, ["blob", "salt"], "left")
    content = F.col("content")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substr(content, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        inside = s["start"] >= state["at"]
        out = F.when(inside, F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), out.alias("out"))

    without = F.aggregate("spans", start, step, lambda state: F.concat(state["out"], F.substr(content, state["at"] + 1, F.length(content))))
    rewritten = joined.select(F.col("row").withField(f"c{docs.columns.index(text_col)}", F.when(F.col("spans").isNotNull(), without).otherwise(content)).alias("row"))
    return restored(clean.unionByName(rewritten), docs)

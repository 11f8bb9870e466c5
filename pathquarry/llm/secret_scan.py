"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every text is content-addressed by SHA-256.  The ledger holds the (blob, rule,
version) triples scanned so far; a run scans each blob once, and only with
rules whose version the ledger lacks for it.  Findings are kept by blob and
joined back to every path that holds the blob.  Texts under one path are its
versions, all of them scanned.  A ledger kept under a lasting folder makes later
runs read only what they have not seen; without one a run starts from nothing.

Null text counts as empty and has no findings.  Copies share one scan.  Long
texts are scanned whole.  Empty tables give empty results.  Repeated rows give
repeated rows.  Positions count code points, end exclusive.  Other columns are
ignored, or carried along where documents are returned, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch


@dataclass(frozen=True)
class Rule:
    """A pattern; matches shorter than `least` (of the whole or of a group) are dropped."""

    name: str
    version: int
    pattern: str
    least: int
    group: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([_either_case(w) for w in ("password", "passwd", "secret", "token")] + [_either_case("api") + "_?" + _either_case("key")])

#: In the order in which kinds are listed.
RULES = (
    Rule("assign", 1, rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, "[0-9a-f]{24,}", 24),  # a maximal run of 24 or more is what is left of all runs
)


def address(paths: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, text, blob."""
    return paths.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def _found(text: Column, rule: Rule) -> Column:
    """Matches with the text before each: the positions follow from the lengths alone."""
    whole, part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), part.alias("part"))
    return F.transform(parts, lambda x: F.struct(F.lit(rule.name).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, start, end of the rows of (blob, text, due: the kinds to scan for)."""
    hits = None
    blobs = blobs.withColumn("row", F.monotonically_increasing_id())  # a blob may come in several equal rows
    for rule in rules:
        # One condition over both sides of the join that gave the rows, so that no plan tests texts which are not due.
        due = blobs.where(F.when(F.array_contains("due", rule.name), F.col("text").rlike(rule.pattern)).otherwise(F.lit(False)))
        rows = due.select("blob", "row", F.posexplode(_found(F.col("text"), rule)).alias("nth", "m")).select("blob", "row", "nth", "m.*")
        so_far = Window.partitionBy("blob", "row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
        ends = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(so_far)
        kept = rows.withColumn("end", ends).where(F.col("part") >= rule.least)
        kept = kept.select("blob", "kind", (F.col("end") - F.col("hit")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        hits = kept if hits is None else hits.unionByName(kept)
    return hits


class BlobLedger:
    """Scanned triples and findings, as append-only tables under `root` in a folder that all executors share."""

    LEDGER, FINDINGS = "blob string, rule string, version int", "blob string, kind string, version int, start long, `end` long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.ledger_path, self.findings_path = spark, f"{root}/ledger", f"{root}/findings"

    def _read(self, path: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read(self.ledger_path, self.LEDGER)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Findings of these rules in these versions.  A run that broke off may have left rows twice."""
        wanted = " or ".join(f"(kind = '{r.name}' and version = {r.version})" for r in rules)
        return self._read(self.findings_path, self.FINDINGS).where(wanted).distinct()

    def scan(self, addressed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new among the addressed paths; returns the (blob, due) that were scanned."""
        wanted = F.array(*[F.lit(r.name) for r in rules])
        done = self.seen().where(" or ".join(f"(rule = '{r.name}' and version = {r.version})" for r in rules)).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        no_path = F.lit(-(1 << 63))
        key = F.coalesce(F.col("path").cast("long"), no_path)
        blobs = addressed.select("blob", key.alias("key")).groupBy("blob").agg(F.min("key").alias("key"))
        due = blobs.join(done, "blob", "left").select("blob", "key", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("due")).where(F.size("due") > 0)
        due = Scratch(self.spark).put(due)
        # One of the rows that hold a blob gives its text; the others are not read further.
        texts = addressed.select("blob", key.alias("key"), "text").join(due, ["blob", "key"])
        version = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
        found = scan_blobs(texts, rules).distinct()
        # Findings first: a run that breaks off here scans the same blobs again.
        found.select("blob", "kind", version[F.col("kind")].alias("version"), "start", "end").write.mode("append").parquet(self.findings_path)
        due.select("blob", F.explode("due").alias("rule")).withColumn("version", version[F.col("rule")]).write.mode("append").parquet(self.ledger_path)
        return due


HITS = "array<struct<start: long, nth: int, end: long, kind: string>>"


def findings_by_path(addressed: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, hits (array of start, nth kind, end, kind in that order) for every path; no hits: empty."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    hit = F.struct("start", order[F.col("kind")].alias("nth"), "end", "kind")
    by_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return addressed.select("path", "blob").join(by_blob, "blob", "left")


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; over a new ledger if none is given."""
    addressed = address(docs)
    ledger = ledger or BlobLedger(docs.sparkSession, Scratch(docs.sparkSession).root)
    ledger.scan(addressed)
    hits = findings_by_path(addressed, ledger.findings())
    spans = F.coalesce(F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["kind"], h["start"], h["end"])), ","), F.lit(""))
    count = lambda kind: F.size(F.filter(F.coalesce("hits", F.array().cast(HITS)), lambda h: h["kind"] == kind)).cast("long")
    n = {r.name: count(r.name) for r in RULES}
    return hits.select(F.col("path").alias("doc_id"), *[v.alias(f"n_{k}") for k, v in n.items()], spans.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def redact_documents(docs: DataFrame, mask: str = "[REDACTED]", ledger: BlobLedger | None = None) -> DataFrame:
    """The documents with every found span replaced by the mask; columns as before, n_chars follows the text."""
    addressed = address(docs)
    ledger = ledger or BlobLedger(docs.sparkSession, Scratch(docs.sparkSession).root)
    ledger.scan(addressed)
    hit = F.struct("start", "end")
    by_blob = ledger.findings().groupBy("blob").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    text = F.col("row.text")
    # Spans of different kinds may overlap: keep what lies before a span and after all earlier ones.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "hits", start,
        lambda acc, h: F.struct(F.greatest(acc["at"], h["end"]).alias("at"), F.when(h["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (h["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    rows = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    joined = rows.join(by_blob.hint("merge"), "blob", "left").withColumn("masked", F.when(F.col("hits").isNotNull(), cut).otherwise(text))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def _oracle(table: str = "documents") -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, '{r.name}' AS kind, {k} AS nth, e - hit AS s, e FROM (
              SELECT doc_id, hit, part, sum(gap + coalesce(hit, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
                SELECT doc_id, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, length(parts[i]) AS part FROM (
                  SELECT doc_id, gaps, hits, parts, unnest(generate_series(1, len(gaps))) AS i FROM (
                    SELECT doc_id, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {r.group}) AS parts
                    FROM {table} WHERE regexp_matches(text, '{p}')))))
            WHERE part >= {r.least}"""
        )
    return f"""WITH h AS ({' UNION ALL '.join(parts)}),
    s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, nth) AS spans FROM h GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
    FROM {table} d LEFT JOIN s USING (doc_id)"""


ORACLE = _oracle()

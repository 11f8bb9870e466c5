"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule rejects a document whose feature reaches a cutoff.  For each stratum
(language) and rule, cutoffs are tried from the mildest on; one is certified if
the exact binomial tail P(Bin(n, risk) <= k) of its k rejections among n good
labelled documents is at most the test's level, and the first failure ends the
sequence, so its tests need no correction among themselves.  Levels are divided
by the number of sequences (strata times rules), and each rule has its part of
the risk: with confidence 1 - delta, in every stratum at most the sum of the
parts, ALPHA, of good documents are rejected by the certified cutoffs.  The
parts are unequal: rules for what good text has none of can be certified on some
300 documents a stratum, rules for what it has a little of get small parts.  Too
few labels certify nothing, and then only the base rules reject.

Null text: no words, so the base rules reject it.  Null language is a stratum
of its own.  Rows without a label, and labels without a row, take no part in
calibration; a labelled document counts once, however often its row or its label
is repeated, and as good only if all its labels say so (of several texts under
its id the one with the least features counts).  Long texts are judged whole.
Repeated rows give repeated rows.  Empty tables give empty results.  Other
columns are ignored, or carried along where documents are returned, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

DELTA = 0.05
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Feature -> cutoffs from the mildest to the strictest.
RULES = {
    "symbols_per_word": (5.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_share": (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1, 0.08, 0.05, 0.03),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}
#: Each rule's part of the risk.
RISK = {"symbols_per_word": 0.02, "dup_line_share": 0.004, "repeat_share": 0.004, "chars_per_word": 0.02, "upper_share": 0.002}
ALPHA = sum(RISK.values())


def features(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, lang, the counts and the features of every document, and the columns carried along."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", "lang", *carried, text.alias("text"))
    d = d.select(
        "doc_id", "lang", *carried, F.array_remove(F.split("text", f"{SPACE}+", -1), "").alias("words"), lines.alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    )
    d = d.select(
        "doc_id", "lang", *carried, "word_chars", "n_symbols", "n_upper", F.size("words").cast("long").alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.sequence(F.lit(0), F.size("hashes") - WINDOW)
    windows = F.when(F.size("hashes") > WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW)])))
    d = d.withColumn("windows", windows).drop("hashes")
    # Windows in order of their hash stand beside their equals; most documents have none and skip this.
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    n, at = F.size("sorted"), F.col("sorted")
    same = lambda i, j: at[i]["h"] == at[j]["h"]
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < n - 1) & same(i, F.least(i + 1, n - 1))), at[i]["i"]))
    d = d.withColumn("repeated", F.when(at.isNotNull(), F.array_sort(F.array_compact(repeated)))).drop("sorted")
    covered = F.aggregate(
        "repeated", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("repeated")
    words, share = F.greatest(F.col("n_words"), F.lit(1)), lambda x, of: F.col(x) / F.greatest(F.col(of), F.lit(1))
    return d.select(
        "doc_id", "lang", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / words).alias("symbols_per_word"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("chars_per_word"), share("n_upper", "word_chars").alias("upper_share"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(n, k, p):
    """P(Bin(n, p) <= k) as an expression; above the mean it is not needed and given as 1."""
    first = F.struct((n * F.log1p(-p)).alias("log"), F.lit(0.0).alias("sum"))
    odds = F.log(p / (1 - p))
    step = lambda acc, j: F.struct((acc["log"] + F.log((n - j).cast("double")) - F.log((j + 1).cast("double")) + odds).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, step, lambda acc: acc["sum"]))


def certify(feats: DataFrame, labels: DataFrame, risk: dict[str, float] = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum: stratum, and a certified cutoff for each rule (null: none).

    Documents are counted by how many of a rule's cutoffs they reach; all after
    that is a row for each stratum, rule and cutoff.
    """
    stratum = F.coalesce("lang", F.lit("")).alias("stratum")
    named = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = feats.where(~F.col("base_failed")).join(named, "doc_id").groupBy("doc_id").agg(F.min(F.struct(stratum, *RULES)).alias("one")).select("one.*")
    per_rule = lambda values: F.create_map(*[F.lit(x) for r in RULES for x in (r, values(r))])
    cuts = F.create_map(*[x for r, c in RULES.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    each = good.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("f")).select("stratum", "f.*")
    reached = F.size(F.filter(cuts[F.col("rule")], lambda c: c <= F.col("x")))
    counted = each.groupBy("stratum", "rule", reached.alias("reached")).agg(F.count("*").alias("n"))
    counted = counted.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("reached", "n")).alias("found"))  # as many as there are cutoffs
    tested = counted.crossJoin(F.broadcast(counted.agg(F.count("*").alias("sequences"))))  # one row
    many = per_rule(lambda r: len(RULES[r]))[F.col("rule")]
    tested = tested.withColumn("k", F.explode(F.sequence(F.lit(1), many)))
    # Who reaches the k-th cutoff, counted from the mildest, reaches all the stricter ones too.
    hits = F.aggregate("found", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["reached"] > many - F.col("k"), x["n"]).otherwise(F.lit(0)))
    tested = tested.select("stratum", "rule", "k", "n", "sequences", hits.alias("hits"), per_rule(lambda r: risk[r])[F.col("rule")].alias("risk"))
    failed = binomial_tail(F.col("n"), F.col("hits"), F.col("risk")) > F.lit(delta) / F.col("sequences")
    last = tested.groupBy("stratum", "rule").agg((F.coalesce(F.min(F.when(failed, F.col("k"))), F.max("k") + 1) - 1).alias("last"))
    cut = F.when(F.col("last") > 0, F.element_at(cuts[F.col("rule")], F.greatest(F.col("last"), F.lit(1))))
    return last.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, cut)).alias(f"cut_{r}") for r in RULES])


def _rejected():
    """Whether a certified cutoff is reached; the cutoffs stand beside the features."""
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return rejected


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, features, base_failed and kept of every document."""
    feats = Scratch(docs.sparkSession).put(features(docs))
    cuts = certify(feats, labels)
    joined = feats.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(cuts, "stratum", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~_rejected()).drop("stratum", "lang", *[f"cut_{r}" for r in RULES])


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns; each row is judged by its own text, whatever its doc_id.

    Rows are written with their features, so that no join has to find them again.
    """
    feats = Scratch(docs.sparkSession).put(features(docs.withColumn("row", F.struct(*docs.columns)), "row"))
    cuts = certify(feats, labels)
    some = cuts.where(F.coalesce(*[f"cut_{r}" for r in RULES]).isNotNull())  # strata with many labels, so few
    joined = feats.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(F.broadcast(some), "stratum", "left")
    return joined.where(~F.col("base_failed") & ~_rejected()).select("row.*")

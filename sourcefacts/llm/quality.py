"""Quality rules with host-level verdicts.

Rules are counted for every whole text with DataFrame functions only. Some
rules reject a document on their own; the others are doubts. Failures of every
rule are added up by host, a host's rates are shrunk by beta priors that are
fitted to all hosts, and the verdicts of the host go back to its documents: a
doubt is forgiven where the host rarely raises it, and rejects the document
where the host often does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import NON_SPACE_CLASS, materialize

MIN_WORDS = 10
#: Repeated words may be at most this many percent of all words.
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Fixed value: everything that is not a symbol of the contract.
NO_SYMBOLS = "[^#*$%&|<>]+"
#: A host is rejected when its shrunk rate of rejected documents is above this.
HOST_RATE = 0.5
#: A doubt counts in a host whose rate of it is, all but surely, above that of all
#: documents by this factor: by so many deviations of what is known of the rate.
DOUBT_FACTOR, DOUBT_DEVIATIONS = 1.25, 2.0
#: Doubts: repeated lines are more than this many percent of the lines with a word,
#: or there are more symbols than words.
MAX_DUP_PERCENT = 30
#: Every rule whose failures are added up by host; the first rejects by itself.
RULES = ("base_failed", "many_dup_lines", "many_symbols")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NON_SPACE_CLASS})"), 1)


def window_hashes(ws: Column, window: int = WINDOW) -> Column:
    """64-bit hashes of all runs of ``window`` words."""
    spots = F.sequence(F.lit(1), F.size(ws) - (window - 1))
    return F.transform(spots, lambda i: F.xxhash64(F.slice(ws, i, window)))


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the ``RULES``, true where one fails.

    A null text counts as empty. Code points are counted, not bytes.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NON_SPACE_CLASS))
    one = docs.select(
        *kept, words(text).alias("_words"), F.length(F.regexp_replace(text, NO_SYMBOLS, "")).cast("long").alias("n_symbols"), lines.alias("_lines"),
    )
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    two = one.select(
        *carried, "n_symbols", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") > WINDOW, window_hashes(F.col("_words"))).alias("_hashes"),
    )
    # only texts in which a hash repeats are looked at further: hashes are sorted with
    # their places, equal neighbours mark repeated windows, covered words are added up
    repeats = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    three = two.withColumn("_pairs", F.when(repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    four = three.withColumn("_keys", F.transform("_pairs", lambda p: p["h"])).drop("_hashes")
    last = F.size("_keys") - 1
    neighbours = F.filter("_pairs", lambda p, k: (F.get("_keys", F.greatest(k - 1, F.lit(0))) == p["h"]) & (k > 0) | (F.get("_keys", F.least(k + 1, last)) == p["h"]) & (k < last))
    five = four.withColumn("_spots", F.array_sort(F.transform(neighbours, lambda p: p["i"]))).drop("_pairs", "_keys")
    covered = F.aggregate(
        F.zip_with("_spots", F.concat(F.slice("_spots", 2, F.greatest(F.size("_spots") - 1, F.lit(0))), F.array(F.lit(2**30))), lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda acc, x: acc + x,
    )
    six = five.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_spots") > 0, covered), F.lit(0).cast("long"))).drop("_spots")
    return six.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (100 * F.col("n_dup_lines") > MAX_DUP_PERCENT * F.col("_n_lines")).alias("many_dup_lines"),
        (F.col("n_symbols") > F.col("n_words")).alias("many_symbols"),
    )


def host_of(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """Adds ``_host``: the given column, else the source; null hosts are one host."""
    return docs.withColumn("_host", F.coalesce((host if host is not None else F.col("source")).cast("string"), F.lit("")))


def host_rates(counted: DataFrame) -> DataFrame:
    """``_host, n`` and, for each rule, ``rate_<rule>``, its failure rate shrunk to the prior of all hosts,
    and ``often_<rule>``: whether the rate is surely above that of all documents.

    The prior of a rule is a beta distribution fitted by moments to the rates
    of the hosts. Where they don't vary beyond chance, all hosts have the
    common rate, and none is above it; where they vary as much as rates can, a
    host's own documents count for all but one pseudo document. What is known
    of a host's rate is again a beta distribution; its mean less twice its
    deviation must be above the common rate with a margin.
    """
    hosts = counted.groupBy("_host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    share = lambda r: F.col(r) / F.col("n")
    # one row of a few numbers
    moments = hosts.agg(F.avg(1 / F.col("n")).alias("inverse"), *[c for r in RULES for c in ((F.sum(r) / F.sum("n")).alias(f"mean_{r}"), F.var_samp(share(r)).alias(f"var_{r}"))]).first()

    def columns(rule: str) -> list[Column]:
        mean, variance = moments[f"mean_{rule}"] or 0.0, moments[f"var_{rule}"] or 0.0
        chance = mean * (1 - mean)
        between = variance - chance * (moments["inverse"] or 0.0)
        if between <= 0:
            return [F.lit(float(mean)).alias(f"rate_{rule}"), F.lit(False).alias(f"often_{rule}")]
        strength = max(chance / between - 1, 1.0)
        rate = (F.col(rule) + strength * mean) / (F.col("n") + strength)
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        return [rate.alias(f"rate_{rule}"), (rate - DOUBT_DEVIATIONS * deviation > DOUBT_FACTOR * mean).alias(f"often_{rule}")]

    return hosts.select("_host", "n", *[c for r in RULES for c in columns(r)])


def with_verdicts(counted: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """Adds ``host_rate`` and ``kept`` to a table of rule counts with ``_host``.

    A document is kept when it passes the base rules, its host is not
    rejected, and it raises no doubt that its host raises more often than
    others do. A rate that is just the limit is not above it. The table of hosts is written, so that
    Spark sees its size: a small one goes to all tasks, else hosts are joined
    by shuffle, where Spark splits a hot host.
    """
    rates = materialize(host_rates(counted).drop("n"), "host-rates")
    joined = counted.join(rates, "_host", "left").withColumnRenamed("rate_base_failed", "host_rate")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= host_rate)
    for rule in RULES[1:]:
        kept = kept & ~(F.col(rule) & F.col(f"often_{rule}"))
    return joined.withColumn("kept", kept).drop("_host", "often_base_failed", *[f"{x}_{r}" for r in RULES[1:] for x in ("rate", "often")])


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdicts of every document, without its text.

    A null source is a host of its own; repeated rows are documents like any
    others; an empty table gives no rows.
    """
    counted = host_of(rule_counts(docs.select("doc_id", "text", "source"))).drop("text", "source")
    out = with_verdicts(materialize(counted, "rule-counts"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RULES[1:])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    Rows travel in a struct, so that their column names can't clash with ours.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    flat = docs.select(row, F.col("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"))
    counted = materialize(rule_counts(flat).drop("text"), "rule-counts")
    return with_verdicts(counted).where("kept").select("_row.*")

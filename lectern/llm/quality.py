"""Quality rules on words and lines, and verdicts on hosts. Native expressions only.

A host's failures are shrunk by a beta prior that is fitted to all hosts. Its
strength, in documents, is kept from 1 to 10,000: a sample of hosts that differ
less than chance would give an infinite one, and hosts that are all good or all
bad one of 0, with which a host of one document would be judged by that alone.

Edge cases: a null text has no words and fails; documents with a null source
share one host; a null doc_id is kept as it is; repeated rows each count and get
equal verdicts, so there are no ties; a rate equal to the limit passes; a very
long text is measured whole, in arrays of its words; an empty table gives an
empty result; other columns pass through, and the columns added here replace any
of the same name (names that start with _lt_ are not to be used).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bind, null_key, row_hash, skew_join, stored, words

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A host whose shrunken rate of failures is above this is rejected.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 10_000.0

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: Column) -> Column:
    """Number of words in windows of 8 words that are found twice or more; w: a bound array."""
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def found(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        return bind(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(ordered, found))

    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(bind(hashes, count))


def _counted(text: Column, then) -> Column:
    """then(struct n, r) of a text's words and its repeated ones, counted once."""
    return bind(bind(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))), then)


def failed(text: Column) -> Column:
    """Whether a text fails the base rules."""
    return _counted(text, lambda c: (c["n"] < MIN_WORDS) | (100 * c["r"] > MAX_REPEAT_PERCENT * c["n"]))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the metrics and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = _counted(F.col("text"), lambda c: c)
    lines = bind(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (
        docs.withColumn("_lt_w", of_words)
        .withColumns({
            "n_words": F.col("_lt_w")["n"],
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": lines.cast("long"),
            "n_repeat_words": F.col("_lt_w")["r"],
        })
        .drop("_lt_w")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def host_verdicts(flags: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row a host from rows (source, base_failed): _lt_host, host_docs, host_rate, host_rejected.

    The beta prior is fitted by moments to the hosts' own rates, each weighed by
    its documents: mean m, variance v, strength m(1-m)/v - 1 within bounds.
    """
    hosts = flags.groupBy(null_key(F.col("source")).alias("_lt_host")).agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("_lt_f"))
    sums = hosts.agg(F.sum("host_docs").alias("_lt_n"), (F.sum("_lt_f") / F.sum("host_docs")).alias("_lt_m"), F.sum(F.col("_lt_f") * F.col("_lt_f") / F.col("host_docs")).alias("_lt_q"))
    m, v = F.col("_lt_m"), F.col("_lt_q") / F.col("_lt_n") - F.col("_lt_m") * F.col("_lt_m")
    strength = F.when(v <= m * (1 - m) / (MOST_PRIOR + 1), F.lit(MOST_PRIOR)).otherwise(F.greatest(F.lit(LEAST_PRIOR), m * (1 - m) / v - 1))
    prior = sums.select(m, strength.alias("_lt_k"))
    rate = (F.col("_lt_f") + F.col("_lt_m") * F.col("_lt_k")) / (F.col("host_docs") + F.col("_lt_k"))
    return hosts.crossJoin(F.broadcast(prior)).select("_lt_host", "host_docs", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected"))


def _with_verdicts(rows: DataFrame, flags: DataFrame, max_rate: float) -> DataFrame:
    hosts = stored(host_verdicts(flags, max_rate), "hosts").withColumn("_lt_weight", F.col("host_docs"))
    rows = rows.drop("host_docs", "host_rate", "host_rejected").withColumn("_lt_host", null_key(F.col("source")))
    joined = skew_join(rows, hosts, "_lt_host", "_lt_weight", row_hash(F.col("doc_id"), F.col("n_words"), F.col("word_chars")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("_lt_host")


def scores(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, source, the metrics, base_failed, the host's figures and kept, a row for each document."""
    rows = stored(measured(docs.select("doc_id", "text", "source")).drop("text"), "quality")
    return _with_verdicts(rows, rows, max_rate)


def keep(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass the rules and come from hosts that do, with their own columns.

    Two passes over the texts, one for the hosts' counts and one to keep
    documents; storing the texts with their verdicts instead would take as much
    disk again as the documents.
    """
    flags = docs.select("source", failed(F.col("text")).alias("base_failed"))
    hosts = stored(host_verdicts(flags, max_rate), "hosts").withColumn("_lt_weight", F.col("host_docs"))
    rows = docs.filter(~failed(F.col("text"))).select(F.struct(*docs.columns).alias("_lt_doc"), null_key(F.col("source")).alias("_lt_host"))
    joined = skew_join(rows, hosts.select("_lt_host", "host_rejected", "_lt_weight"), "_lt_host", "_lt_weight", F.monotonically_increasing_id())
    return joined.filter("not host_rejected").select(*(F.col("_lt_doc")[c].alias(c) for c in docs.columns))

"""Host-level quality rules, in DataFrame functions only.

Every document is measured against rules; a host's rule failures are counted,
its failure rate is shrunk towards all hosts by a beta prior, and a host whose
shrunk rate of any rule passes ``host_limit`` loses its documents.  The prior is
fitted by the moments of the beta-binomial: what hosts differ by beyond the
binomial noise of their sizes is the correlation rho within a host, and the
prior weighs 1 / rho - 1 documents (within ``PRIOR_RANGE``).  Hosts of a
document each tell nothing of rho, and take the mean of all.

Edge cases: null text has no words; a null host is a host of its own; repeated
rows count once each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import cut

SPACE = "[ \\t\\n\\x0B\\f\\r]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines")
HOST_LIMIT = 0.5
PRIOR_RANGE = (1.0, 1e6)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the text.

    Windows that differ are told apart by themselves, not by a hash; a text
    without a repeated window is settled by one distinct count.
    """

    def covered(windows: Column) -> Column:
        by_window = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twice = let(
            by_window,
            lambda s: F.transform(
                F.filter(
                    F.transform(
                        s,
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            (
                                F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False))
                                | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))
                            ).alias("d"),
                        ),
                    ),
                    lambda y: y["d"],
                ),
                lambda y: y["i"],
            ),
        )
        return F.aggregate(
            F.sort_array(twice),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    def counted(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        return F.when(
            F.size(w) >= 4,
            let(windows, lambda t: F.when(F.size(t) > F.size(F.array_distinct(t)), covered(t)).otherwise(0)),
        ).otherwise(0)

    return let(words, counted)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: the base counts and which rules it fails."""
    base = docs.select(
        "doc_id", F.col(host).alias("__host"), F.coalesce(F.col("text"), F.lit("")).alias("__t")
    ).withColumn("__w", words_of(F.col("__t")))
    lines = F.filter(F.split(F.col("__t"), "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = base.select(
        "doc_id",
        "__host",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("__lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).cast("long").alias("n_repeat_words"),
    )
    return out.withColumns(
        {
            "short": F.col("n_words") < 50,
            "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
            "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
            "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("__lines"),
        }
    )


def prior(n: float, n2: float, hosts: float, bad: float, bad2_by_n: float) -> tuple[float, float]:
    """(mean, weight in documents) of the prior, from sums over the hosts of n, n * n, 1, bad and bad * bad / n."""
    if not n:
        return 0.0, PRIOR_RANGE[1]
    mean, rho = bad / n, 0.0
    room = n - n2 / n - (hosts - 1)
    if 0 < mean < 1 and room > 1e-9:
        rho = ((bad2_by_n - n * mean * mean) / (mean * (1 - mean)) - (hosts - 1)) / room
    if rho <= 1 / PRIOR_RANGE[1]:
        return mean, PRIOR_RANGE[1]
    return mean, min(max(1 / rho - 1, PRIOR_RANGE[0]), PRIOR_RANGE[1])


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, worst): the largest of a host's shrunk failure rates over the rules."""
    hosts = rows.groupBy("__host").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r)).alias(r) for r in RULES]
    )
    hosts = cut(hosts, "hosts")
    # sums over all hosts: one row
    n = F.col("n").cast("double")
    sums = hosts.agg(
        F.sum("n").alias("n"),
        F.sum(n * n).alias("n2"),
        F.count(F.lit(1)).alias("k"),
        *[F.sum(r).alias(r) for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in RULES],
    ).first()
    shrunk = []
    for r in RULES:
        mean, strength = prior(*(float(sums[c] or 0) for c in ("n", "n2", "k", r, f"{r}_sq")))
        shrunk.append((F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))
    return hosts.select("__host", F.greatest(*shrunk).alias("host_rate"))


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Base counts, ``base_failed``, ``host_rate`` and ``kept`` for every document."""
    rows = cut(measured(docs, host), "quality")
    rates = host_rates(rows)
    joined = rows.join(rates.withColumnRenamed("__host", "__h"), F.col("__host").eqNullSafe(F.col("__h")), "left")
    failed = F.col("short") | F.col("repeats")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("host_rate") <= host_limit)).alias("kept"),
        F.round("host_rate", 6).alias("host_rate"),
    )


def op5(docs: DataFrame) -> DataFrame:
    return judge(docs)

"""Quality rules with host verdicts: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, beside, checked_join, let, without, written

MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
SYMBOLS_PER_100_WORDS = 50
DUP_LINES_PERCENT = 50
HOST_RATE = 0.6
#: Documents that the prior stands for where the hosts' rates give no estimate (one host, or no spread).
PRIOR_DOCUMENTS = 20.0
#: Bounds of the correlation within hosts: the hosts differ by chance alone, or their documents are all alike.
LEAST_WITHIN, MOST_WITHIN = 1e-6, 0.999
REJECTED_IDS = 200_000
RESULTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed", "host_rate", "kept"]


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows whose word sequence occurs at least twice in the text."""
    k = REPEAT_WINDOW
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, other: F.coalesce(F.get(s, other)["h"] == e["h"], F.lit(False))
            hit = F.transform(s, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        def length(places: Column) -> Column:
            start = F.struct(F.lit(-k).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"))
            return F.aggregate(places, start, step)["n"]

        return let(let(ordered, twice), length)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def document_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The counts of each document; one pass, no shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    words = F.filter(F.split(text, BLANKS + "+"), lambda w: w != "")
    return docs.withColumns({
        "__c": let(words, counts),
        "__l": line_counts,
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    }).select("*", "__c.*", "__l.*").drop("__c", "__l")


def beta_prior(mean: float | None, var: float | None, inverse: float | None) -> tuple[float, float]:
    """Mean and strength (in documents) of the beta prior: the moments of a beta-binomial.

    mean, var: of the hosts' shares; inverse: the mean of 1 / documents. A share of n documents varies by
    m (1 - m) (r + (1 - r) / n), where r is the correlation within hosts and 1 / r - 1 the strength: chance alone spreads
    small hosts, and what it spreads does not count as a difference between them.
    """
    if mean is None:
        return 0.0, PRIOR_DOCUMENTS
    if var is None or not 0 < mean < 1 or inverse >= 1:
        return mean, PRIOR_DOCUMENTS
    within = (var / (mean * (1 - mean)) - inverse) / (1 - inverse)
    return mean, 1 / min(max(within, LEAST_WITHIN), MOST_WITHIN) - 1


def host_quality(docs: DataFrame, carry: list[str] | None = None, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rule counts and verdict of each document, with its host's failures taken into account.

    base_failed: fewer than 10 words, or more than 20 % of words in repeated 5-word windows. rule_failed: base_failed, or
    more than one symbol for two words, or over half of the lines repeat an earlier line. A host's rate is its share of
    documents with rule_failed, shrunk by a beta prior whose moments fit all hosts' shares as a beta-binomial; hosts above 0.6 are
    rejected with all their documents. Returns ``carry`` (all input columns by default) and the counts; input columns named
    like a result are replaced. Null or empty texts have no words and fail. Documents without a host are judged alone
    (host_rate null). Repeated rows are judged row by row; an empty table gives no rows.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    base = without(docs, RESULTS)
    host = F.col(f"`{host_col}`")
    stats = document_stats(base, text_col).select(*[F.col(f"`{c}`") for c in keep], host.cast("string").alias("__host"), *RESULTS[:6])
    n = F.col("n_words")
    stats = stats.withColumn("base_failed", (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * REPEAT_PERCENT))
    stats = stats.withColumn(
        "rule_failed",
        F.col("base_failed") | (F.col("n_symbols") * 100 > n * SYMBOLS_PER_100_WORDS) | (F.col("n_dup_lines") * 100 > F.col("n_lines") * DUP_LINES_PERCENT),
    )
    stats = written(stats, "quality")
    hosts = written(
        stats.where("__host is not null").groupBy("__host").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("rule_failed").cast("long")).alias("__bad")), "hosts"
    )
    share = F.col("__bad") / F.col("__n")
    mean, strength = beta_prior(*(hosts.agg(F.avg(share), F.var_samp(share), F.avg(1 / F.col("__n"))).first() or (None, None, None)))
    rate = (F.col("__bad") + F.lit(mean * strength)) / (F.col("__n") + F.lit(strength))
    verdicts = hosts.select("__host", F.round(rate, 6).alias("host_rate"))
    judged = checked_join(stats, verdicts, "__host").drop("__host")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_rate") <= HOST_RATE, F.lit(True)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the rules and their host's verdict keep, with their own columns.

    Only the rejected rows' keys (id, digest of host and text) are gathered; up to REJECTED_IDS of them are broadcast.
    All input columns stay as they are, whatever their names. Null and empty texts fail the rules and go; repeated rows go or
    stay together; an empty table gives no rows.
    """
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    keys = {"__d": F.col(f"`{id_col}`").cast("long"), "__h": F.xxhash64(F.coalesce(text, F.lit("")), F.coalesce(host, F.lit("")), host.isNull())}
    judged = host_quality(docs.select(host.alias("source"), text.alias("text"), *[v.alias(k) for k, v in keys.items()]), carry=["__d", "__h"])
    bad = written(judged.where("not kept").select(F.col("__d").alias("__bd"), F.col("__h").alias("__bh")).distinct(), "rejected")
    few = bad.count() <= REJECTED_IDS
    rows = beside(docs, keys)
    kept = rows.join(F.broadcast(bad) if few else bad, F.col("keys.__d").eqNullSafe(F.col("__bd")) & (F.col("keys.__h") == F.col("__bh")), "left_anti")
    return kept.select("own.*")

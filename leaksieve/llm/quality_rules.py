"""Quality rules of documents and hosts, in DataFrame functions only.

Each text gets its counts and a base verdict. Failures are then summed by host (a documents row's
``source``), and each host's failure rate is shrunk towards the rate of all hosts: the hosts' rates are
taken as draws from a beta distribution whose two parameters follow from their mean and variance, and a
host with n documents, f of them failed, has the rate ``(f + a) / (n + a + b)``. Hosts above
``max_host_rate`` are rejected with all their documents. A host with few documents hardly moves from the
mean, so it is not rejected for one bad page.

Shuffles carry counts by host with partial sums, so a host with a third of all documents is a few
rows. The verdicts are joined back as a table: Spark broadcasts it if it is small when it is known, and
splits the host with most documents if it is not.

Defined results: a null or empty text has no words and fails; a document whose host is null is judged
by its text alone; if all hosts have one rate, or there is one host, that rate is everybody's; repeated rows
count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leaksieve.llm.shared import free_name, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def with_base_rules(docs: DataFrame, text: str = "text", into: str = "rules") -> DataFrame:
    """``docs`` and a struct column of the counts and ``base_failed``.

    Arrays stay within the row. Columns that several expressions use are columns of their own, so
    that they are computed once.
    """
    body, words, windows, places = (free_name(docs, x) for x in ("_body", "_words", "_windows", "_places"))
    found = docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    found = found.withColumn(words, F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), ""))
    word = F.col(words)
    found = found.withColumn(windows, F.when(F.size(word) > 2, F.transform(
        F.slice(word, 1, F.size(word) - 2), lambda x, i: F.xxhash64(x, F.get(word, i + 1), F.get(word, i + 2)))
    ).otherwise(F.array().cast("array<long>")))
    window = F.col(windows)
    # Only texts with a repeated window pay for the sort that finds the places.
    found = found.withColumn(places, F.when(
        F.size(F.array_distinct(window)) < F.size(window),
        F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    place = F.col(places)

    def same(x, other):
        return F.coalesce(F.get(place, other)["h"] == x["h"], F.lit(False))

    repeated = F.filter(place, lambda x, k: same(x, k - 1) | same(x, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = free_name(docs, "_lines")
    found = found.withColumn(lines, F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    counts = {
        "n_words": _count(word),
        "word_chars": F.length(F.array_join(word, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(_count(covered), F.lit(0)).cast("long"),
    }
    found = found.withColumn(into, F.struct(*(c.alias(name) for name, c in counts.items())))
    failed = (F.col(into)["n_words"] < MIN_WORDS) | (F.col(into)["n_repeat_words"] * 100 > F.col(into)["n_words"] * MAX_REPEAT_PERCENT)
    return found.withColumn(into, F.col(into).withField("base_failed", failed)).drop(body, words, windows, places, lines)


def host_verdicts(documents: DataFrame, host: str, failed: Column, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, n, n_failed, rate, rejected)`` per host that is not null; ``rate`` is the shrunk one."""
    hosts = documents.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(failed.cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n")
    prior = hosts.agg(F.avg(raw).alias("mean"), F.var_samp(raw).alias("var")).first()
    mean, var = prior["mean"], prior["var"]
    if mean is None or not var:
        rate = F.lit(float(mean or 0.0))
    else:
        strength = mean * (1 - mean) / var - 1
        strength = strength if strength > 0 else 1.0
        rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def quality_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(doc_id, counts, base_failed, kept)`` per row of ``docs`` (doc_id, text, source)."""
    scored = with_base_rules(docs.select("doc_id", "text", "source")).select("doc_id", "source", "rules.*")
    scored = written(scored)
    hosts = host_verdicts(scored, "source", F.col("base_failed"), max_host_rate)
    # Written first: Spark knows the verdicts' size then and moves the documents only if there are very many hosts.
    rejected = written(hosts.where("rejected").select(F.col("host").alias("source"), "rejected"))
    joined = scored.join(rejected, "source", "left")
    return joined.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))


def keep_by_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that neither the base rules nor their host's verdict reject."""
    mark = free_name(docs, "_rules")
    scored = written(with_base_rules(docs, into=mark).withColumn(mark, F.col(mark)["base_failed"]))
    hosts = host_verdicts(scored, "source", F.col(mark), max_host_rate)
    rejected = written(hosts.where("rejected").select(F.col("host").alias("source")))
    return scored.where(~F.col(mark)).join(rejected, "source", "left_anti").select(*docs.columns)

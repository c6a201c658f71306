"""Quality rules by document and by host, with DataFrame operations only.

Each document is tested by base rules and by finer signs of junk. Failures are
added up by host; a host's failure rate is shrunk towards the rate of all hosts
by a beta prior fitted to the hosts themselves (method of moments), so a host
with few documents is not judged by chance. Verdicts are joined back: a document
that fails a base rule goes; on a host judged bad, so does one that shows a sign
of junk. A document without any failure stays wherever it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.rows import bind
from runledger.session import settle

#: Base rules: least words, and the greatest percentage of words in repeated windows.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: Signs of junk: symbols by 100 words, repeated lines by 100 lines, greatest mean word length.
SIGN_SYMBOLS_PERCENT = 10
SIGN_DUP_LINES_PERCENT = 30
SIGN_WORD_CHARS = 15
#: Shrunken failure rate from which on a host is bad.
BAD_HOST_RATE = 0.5

_WORD = "[^\\x20\\x09-\\x0D]+"
_SYMBOL = "[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Words that lie in some window of :data:`WINDOW` words which occurs twice or more.

    Windows are compared by 64-bit hash. Sorting hashes finds those that repeat;
    only texts that have one sort places as well. All steps are linear or
    n log n in the words of a text.
    """

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def has_repeat(found: Column) -> Column:
        return F.size(F.array_distinct(found)) < F.size(found)

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(pairs: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
            # get() is null outside the array, so the ends have one neighbour.
            return F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))

        starts = bind(placed, lambda p: F.sort_array(F.transform(repeated(p), lambda x: x["i"])))
        return bind(
            starts,
            lambda s: F.aggregate(
                F.transform(
                    s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))
                ),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        bind(
            hashed,
            lambda h: bind(
                windows(h), lambda f: F.when(has_repeat(f), covered(f)).otherwise(F.lit(0).cast("long"))
            ),
        )
    )


def measure(docs: DataFrame) -> DataFrame:
    """All columns as struct ``row``, with ``host`` and the counts that the rules test."""
    text = F.coalesce("row.text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    counts = bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    dup_lines = bind(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    host = F.col("row.source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct("*").alias("row")).select(
        "row",
        host.cast("string").alias("host"),
        counts.alias("c"),
        F.size(F.regexp_extract_all(text, F.lit(_SYMBOL), F.lit(0))).cast("long").alias("n_symbols"),
        dup_lines.alias("d"),
    ).select("row", "host", "c.*", "n_symbols", "d.*")


def failures(measured: DataFrame) -> DataFrame:
    """``base_failed`` and ``sign_failed`` beside the counts."""
    words = F.col("n_words")
    return measured.withColumn(
        "base_failed",
        (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * words),
    ).withColumn(
        "sign_failed",
        (100 * F.col("n_symbols") > SIGN_SYMBOLS_PERCENT * words)
        | (100 * F.col("n_dup_lines") > SIGN_DUP_LINES_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") > SIGN_WORD_CHARS * words),
    )


def prior(docs: float, hosts: float, failed: float, squares: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior, from sums over the hosts.

    ``squares`` is the sum of failed^2 / docs. Failures of one host agree with
    correlation rho, whose moment estimate weighs hosts by their documents; the
    weight 1 / rho - 1 is kept between 1 and 1,000.
    """
    mean = failed / docs if docs else 0.0
    even = mean * (1 - mean)
    if not even or docs <= hosts:
        return mean, 1000.0
    rho = ((squares - failed * mean) / even - hosts) / (docs - hosts)
    return mean, 1 / min(0.5, max(1 / 1001, rho)) - 1


def host_verdicts(tested: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed, rate, bad_host``: failure rates with an empirical beta prior.

    The host of rows without one is null, and is a host as others.
    """
    hosts = settle(
        tested.groupBy("host").agg(
            F.count("*").alias("n_docs"),
            F.sum((F.col("base_failed") | F.col("sign_failed")).cast("long")).alias("n_failed"),
        ),
        "quality-hosts",
    )
    docs, count, failed, squares = (
        float(x or 0.0)
        for x in hosts.agg(
            F.sum("n_docs"),
            F.count("*"),
            F.sum("n_failed"),
            F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")),
        ).first()
    )
    mean, weight = prior(docs, count, failed, squares)
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk >= BAD_HOST_RATE).alias("bad_host"))


def judge(docs: DataFrame) -> DataFrame:
    """Every row as struct ``row`` with its counts, its host's verdict and ``kept``.

    Null and empty texts have no words and fail. Rows are judged one by one, so
    repeated ones get the same verdict and count as often as they are there;
    null ids have no effect. A table without ``source``, and rows whose source is
    null, belong to one unnamed host. Further columns are kept in ``row``; an
    empty table gives no rows.
    """
    # Texts are measured again for the verdicts: cheaper than a stored copy of them.
    tested = failures(measure(docs))
    verdicts = host_verdicts(tested).select(F.col("host").alias("of_host"), "rate", "bad_host")
    return tested.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left").withColumn(
        "kept", ~F.col("base_failed") & ~(F.col("bad_host") & F.col("sign_failed"))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return judge(docs).where("kept").select("row.*")


def digests(judged: DataFrame) -> DataFrame:
    """Counts and verdicts of what :func:`judge` returned."""
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "sign_failed", "bad_host", "kept",
    )

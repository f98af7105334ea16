"""URL filter by a character language-model ratio (operator 8, DataFrame
functions only).

Rules decide what they can; the URLs they decide are the accepted and rejected
examples of two character models.  Each model is a Markov model of variable
order: the probability of a character after its last ``order`` characters is
interpolated (Witten-Bell) with all shorter contexts down to a uniform one, so
contexts that were never seen fall through to the longest one that was.  A
URL's score is the mean over its characters of log P(accepted) - log
P(rejected).  The threshold is calibrated on the examples: the point that lies
equally many standard deviations from the mean score of either class.

Plan: (order+1)-grams are counted once per distinct URL with map-side
combining; the model lives in a table of distinct grams; all joins are keyed
by gram or URL, and only the one-row threshold is broadcast.

Defined results: a null URL, or one without ``://``, has empty host and path
and matches no rule that asks for a path; a null URL has no score and is
blocked; if the rules accept or reject nothing there is no threshold and URLs
without a rule are allowed; equal URLs are judged alike and come back each;
extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = 257           # symbols of the uniform model: bytes and the end
Rule = tuple[str, str, str]      # verdict, host, path


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: the longest rule whose host is the
    URL's host or a parent domain of it and whose path starts the URL's path."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumn("rule", name).withColumn("rule_verdict", verdict)


def _grams(text: Column, order: int) -> Column:
    """Every character of the text, and its end, with the ``order`` characters before it."""
    padded = F.split(F.concat(F.lit("\x02" * order), text, F.lit("\x03")), "")
    # the outer transform binds the characters, so that they are split once per text
    return F.flatten(F.transform(F.array(padded), lambda chars: F.transform(
        F.sequence(F.lit(0), F.size(chars) - (order + 1)),
        lambda p: F.concat(*[F.get(chars, p + i) for i in range(order + 1)]))))


def gram_ratios(grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio) for every gram of ``grams`` (gram, yes, no: its counts)."""
    total = grams.select(F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("k"), "gram", "yes", "no")
    tail = total.select(F.expr("right(gram, k)").alias("tail"), "k", "yes", "no") \
        .groupBy("tail", "k").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    tail = tail.withColumn("head", F.expr("left(tail, k - 1)"))
    seen = tail.groupBy("head", "k").agg(
        F.sum("yes").alias("yes_all"), F.sum((F.col("yes") > 0).cast("long")).alias("yes_kinds"),
        F.sum("no").alias("no_all"), F.sum((F.col("no") > 0).cast("long")).alias("no_kinds"))
    model = tail.join(seen, ["head", "k"]).select("tail", F.struct(
        "k", "yes", "yes_all", "yes_kinds", "no", "no_all", "no_kinds").alias("m"))
    by_gram = total.select("gram", F.expr("right(gram, k)").alias("tail")).join(model, "tail") \
        .groupBy("gram").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def mixed(kind: str) -> Column:
        def step(p, m):
            n, kinds = m[f"{kind}_all"], m[f"{kind}_kinds"]
            return F.when(n + kinds == 0, p).otherwise((m[kind] + kinds * p) / (n + kinds))
        return F.aggregate("ms", F.lit(1.0 / ALPHABET), step)
    return by_gram.select("gram", (F.log(mixed("yes")) - F.log(mixed("no"))).alias("ratio"))


def url_scores(urls: DataFrame, order: int = 4) -> DataFrame:
    """``urls`` (url: distinct and not null, rule_verdict) -> url, score."""
    grams = urls.select("url", "rule_verdict", F.explode(_grams(F.translate("url", UPPER, LOWER), order)).alias("gram"))
    counts = grams.groupBy("gram").agg(
        F.sum((F.col("rule_verdict") == "allow").cast("long")).alias("yes"),
        F.sum((F.col("rule_verdict") == "block").cast("long")).alias("no"))
    counts = counts.select("gram", F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"))
    per_url = grams.groupBy("url", "gram").agg(F.count(F.lit(1)).alias("n"))
    return per_url.join(gram_ratios(counts, order), "gram") \
        .groupBy("url").agg((F.sum(F.col("n") * F.round("ratio", 12).cast("decimal(20,12)")).cast("double") / F.sum("n")).alias("score"))


def threshold_of(scored: DataFrame) -> DataFrame:
    """One row: the calibrated threshold (null without examples of both kinds)."""
    yes, no = F.when(F.col("rule_verdict") == "allow", F.col("score")), F.when(F.col("rule_verdict") == "block", F.col("score"))
    s = scored.agg(F.avg(yes).alias("ym"), F.stddev_pop(yes).alias("ys"), F.avg(no).alias("nm"), F.stddev_pop(no).alias("ns"))
    return s.select(F.when(F.col("ys") + F.col("ns") > 0, F.expr("(ym * ns + nm * ys) / (ys + ns)"))
                    .otherwise(F.expr("(ym + nm) / 2")).alias("threshold"))


def url_filter(pages: DataFrame, rules: list[Rule], order: int = 4) -> DataFrame:
    """page_id, url, host, path, rule, score, threshold, verdict per input row."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = with_rule(rows, rules)
    # URLs are short but become many grams: spread by the shuffle width, not by their bytes
    urls = rows.where("url IS NOT NULL").select("url", "rule_verdict").distinct().repartition(C.n_partitions(pages.sparkSession), "url")
    scored = C.materialize(urls.join(url_scores(urls, order), "url"), "url-scores")
    # a global aggregate: one row whatever the data
    judged = rows.join(scored.select("url", "score"), "url", "left").crossJoin(F.broadcast(threshold_of(scored)))
    own = F.when(F.col("score") >= F.col("threshold"), "allow").when(F.col("score").isNull(), "block") \
        .when(F.col("threshold").isNull(), "allow").otherwise("block")
    return judged.select("page_id", "url", "host", "path", "rule", "score", "threshold",
                         F.coalesce("rule_verdict", own).alias("verdict"))

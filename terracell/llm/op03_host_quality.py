"""Host-level quality rules, in DataFrame functions only.

Each document is measured in one pass without a shuffle (`measure`).  Rule failures are summed by host (pre-aggregated in each task), each
host's failure rate has a beta posterior whose prior is fitted to all other hosts: their common rate is its mean, and its weight in documents follows by
moments from how much their rates differ beyond chance.  A host never takes part in its own prior; rogue ones among the others only make the prior
lighter, down to LEAST_WEIGHT.  A host is bad if its posterior rate of any rule is above WORST_RATE, or is likely above a limit
relative to the other hosts' rate; the verdict is joined back to its documents.

Null and empty texts have no words and so fail the base rule.  Documents without a host are judged by the base rule alone.  Repeated rows
count each; other columns are ignored; an empty table gives an empty result.  Texts of any length are measured whole: repeats are found by
sorting a document's own windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import written

#: Rules by name, over the columns of measure(): what makes a document fail.
RULES: dict[str, str] = {
    "base": "base_failed",
    "symbols": "n_symbols > n_words",
    "lines": "n_dup_lines > 3 and 2 * n_dup_lines > n_lines",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "long_words": "word_chars > 30 * n_words",
}
#: A host is bad if the posterior rate of a rule is above this; it then has at least this many documents.
WORST_RATE, LEAST_DOCS = 0.9, 20
#: The prior's weight lies between these many documents: a host of LEAST_DOCS is always judged mostly by its own.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 5.0
#: A host is bad as well if its posterior rate less so many standard deviations is above the rate whose odds are so many times the odds of the other hosts' rate; that limit lies between LEAST_RATE and WORST_RATE.
DEVIATIONS, ODDS, LEAST_RATE = 2.33, 20.0, 0.5
#: Up to so many hosts the verdicts are broadcast (under 1 MB); beyond, they are joined by salted host.
BROADCAST_HOSTS, SALTS = 20_000, 32

SPACE_CLASS = "[ \\t\\n\\u000B\\f\\r]+"


def _repeated(words: str) -> str:
    """SQL: how many words stand in a 3-word window that occurs twice or more.

    Windows are (hash, place) packed in one long, the place in as many low bits as the document needs; sorted, equal ones adjoin,
    and words are compared where hashes agree.  transform(array(x), v -> ...)[0] names a value so that it is worked out once."""
    equal = "w[p] = w[q] and w[p + 1] = w[q + 1] and w[p + 2] = w[q + 2]"
    same = f"exists(array(struct(cast(s[k] & m as int) as p, cast(s[k - 1] & m as int) as q)), z -> {equal.replace('w[p', 'w[z.p').replace('w[q', 'w[z.q')})"
    alike = f"(k > 0 and shiftright(s[k], b) = shiftright(s[k - 1], b) and {same})"
    firsts = f"filter(sequence(1, size(s) - 1), k -> {alike})"  # k such that s[k] repeats s[k - 1]
    places = f"array_sort(array_distinct(flatten(transform({firsts}, k -> array(cast(s[k - 1] & m as int), cast(s[k] & m as int))))))"
    covered = "aggregate(r, named_struct('n', 0L, 'to', -1), (a, p) -> named_struct('n', a.n + cast(p + 3 - greatest(p, a.to) as long), 'to', p + 3), a -> a.n)"
    counted = f"transform(array({places}), r -> {covered})[0]"
    sorted_ = "sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint)))"
    with_s = f"transform(array({sorted_}), s -> if(size(s) < 2, 0L, {counted}))[0]"
    with_b = f"transform(array(length(bin(size(w)))), b -> transform(array(shiftleft(1L, b) - 1L), m -> {with_s})[0])[0]"
    return f"transform(array({words}), w -> if(size(w) < 4, 0L, {with_b}))[0]"


def measure(docs: DataFrame, id_col: str = "doc_id", host: str | Column = "source", text_col: str = "text") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.col(host) if isinstance(host, str) else host).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", SPACE_CLASS), lambda x: x != ""))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t\\n\\u000B\\f\\r]")))
    found = rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE_CLASS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeated("words")).cast("long").alias("n_repeat_words"),
    )
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def prior_weight(k: Column, n: Column, squares: Column, f: Column, spread: Column) -> Column:
    """Documents that a beta prior over k hosts is worth, by moments: n, f are the hosts' documents and failures, squares and spread the sums of n_i ^ 2 and
    f_i ^ 2 / n_i. The hosts' correlation within is the excess of their squared deviations over chance, r, and the weight is 1 / r - 1, between LEAST_WEIGHT and
    MOST_WEIGHT. Without two hosts or both outcomes nothing is known of it: LEAST_WEIGHT; rates as alike as chance makes them: MOST_WEIGHT."""
    p = f / n
    excess = (spread - f * p) / (p * (1 - p)) - (k - 1)
    within = excess / (n - squares / n - (k - 1))
    fitted = F.when(excess <= 0, MOST_WEIGHT).otherwise(F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), 1 / within - 1)))
    return F.when((k >= 2) & (f > 0) & (f < n) & (n - squares / n > k - 1), fitted).otherwise(LEAST_WEIGHT)


def host_verdicts(measured: DataFrame, rules: dict[str, str] = RULES, worst: float = WORST_RATE, least: int = LEAST_DOCS) -> DataFrame:
    """A row for each host: documents, failures and posterior failure rate of each rule, and host_bad.

    The prior is of the other hosts (a lone host's mean is its own rate); all of it follows from sums over hosts, less the host's own part."""
    fails = [F.sum(F.expr(f"cast({rule} as long)")).alias(f"fail_{name}") for name, rule in rules.items()]
    hosts = written(measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails), "hosts")
    square = lambda name: F.col(f"fail_{name}") * F.col(f"fail_{name}") / F.col("n_docs")
    sums = [s for name in rules for s in (F.sum(f"fail_{name}").alias(f"all_{name}"), F.sum(square(name)).alias(f"spread_{name}"))]
    totals = hosts.agg(F.count(F.lit(1)).alias("all_hosts"), F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("all_squares"), *sums)
    out = hosts.join(F.broadcast(totals))  # one row
    own = F.col("n_docs")
    k, n, squares = F.col("all_hosts") - 1, F.col("all_docs") - own, F.col("all_squares") - own.cast("double") * own
    bad = F.lit(False)
    for name in rules:
        fail, every, rate, weight = F.col(f"fail_{name}"), F.col(f"all_{name}"), F.col(f"rate_{name}"), F.col(f"weight_{name}")
        mean = F.when(k == 0, fail / own).otherwise((every - fail) / n)
        out = out.withColumn(f"weight_{name}", prior_weight(k, n, squares, every - fail, F.col(f"spread_{name}") - square(name)))
        out = out.withColumn(f"rate_{name}", (fail + weight * mean) / (own + weight))
        low = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (own + weight + 1))
        limit = F.least(F.lit(worst), F.greatest(F.lit(LEAST_RATE), ODDS * mean / (1 + (ODDS - 1) * mean)))
        bad = bad | (rate > worst) | (low > limit)
    rates = [c for name in rules for c in (f"fail_{name}", f"rate_{name}")]
    return out.select("host", "n_docs", *rates, (bad & (own >= least)).alias("host_bad"))


def judge(docs: DataFrame, id_col: str = "doc_id", host: str | Column = "source", text_col: str = "text") -> DataFrame:
    """measure(), with host_bad and kept of every document."""
    measured = written(measure(docs, id_col, host, text_col), "measured")
    bad = written(host_verdicts(measured).where("host_bad").select(F.col("host").alias("bad_host")), "verdicts")  # only bad hosts take part in the join
    if bad.count() <= BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(bad), F.col("host") == F.col("bad_host"), "left")
    else:
        salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        many = bad.withColumn("bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(many, (F.col("host") == F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left").drop("salt", "bad_salt")
    joined = joined.withColumn("host_bad", F.col("bad_host").isNotNull()).drop("bad_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad"))

"""Quality rules with host verdicts.

Every document is measured by rules; the failures are counted per host, each rate is shrunk towards the rate of all
hosts with a beta prior fitted to the hosts themselves (chance in small hosts left out), and the verdict on the host goes back to its documents: on an
ordinary host a document falls with two failed rules, on a host whose shrunk rate for a rule is too high it falls with
that one rule. A document that fails no rule stays whatever its host is like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import WHITE_CHARS, bind, materialize, white_words

#: Words per window when repeated passages within a document are looked for.
WINDOW = 8
#: The rules, in the order of their bits, over the columns of :func:`measure`.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "mostly_symbols": "n_symbols > n_words",
    "word_length": "word_chars < 2.5BD * n_words OR word_chars > 12 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeated_words": "100 * n_repeat_words > 15 * n_words",
}
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of :data:`WINDOW` words found twice or more among ``words``.

    Windows are 64-bit hashes. Only where two are equal are they sorted, once per row, so the cost stays
    n log n for very long texts; nothing leaves the row.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def starts(s: Column) -> Column:
        twice = F.transform(s, lambda e, i: F.when(
            (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"]))
        return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(p, first, lambda a, x: F.struct(
            x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            bind(pairs, lambda s: bind(starts(s), covered)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(bind(hashes, lambda h: bind(windows(h), count)))


def measure(docs: DataFrame, text: str = "text", carry: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with the measures of each document, in one pass without a shuffle.

    ``n_words`` and ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines`` (of these, equal to an earlier line), ``n_repeat_words``; null text measures 0 everywhere.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(WHITE_CHARS)) != "")
    of_words = bind(white_words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = bind(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))).cast("long")
    out = docs.select(*carry, of_words.alias("_w"), of_lines.alias("_l"), symbols.alias("n_symbols"))
    kept = [c for c in out.columns if c not in ("_w", "_l", "n_symbols")]
    return out.select(*kept, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines",
                      "_w.n_repeat_words")


def failed_rules() -> Column:
    """Bit r is set where rule r fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << r)).otherwise(F.lit(0)) for r, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total


def _prior(hosts: int, docs: int, squares: float | None, failures: int | None,
           quotients: float | None) -> tuple[float, float | None] | None:
    """Mean and strength of the beta prior; no strength (None) where all hosts get the mean, None without documents."""
    if not docs:
        return None
    m = failures / docs
    room = docs - squares / docs - (hosts - 1)
    if not 0 < m < 1 or room <= 0:
        return m, None
    within = ((quotients - failures * m) / (m * (1 - m)) - (hosts - 1)) / room
    return m, max(0.0, 1 / within - 1) if within > 0 else None


def host_verdicts(measured: DataFrame, host: str = "host", limit: float = 0.5) -> DataFrame:
    """One row per host (a null host is one too): ``n_docs`` and ``bad_rules``, the bits of the rules it fails.

    For each rule a beta prior is fitted to the hosts by moments weighted by documents. With f failures in n documents per
    host, m failures per document overall, and H hosts, the spread S = sum(n (f/n - m)^2) is on average
    m (1 - m) ((H - 1) (1 - c) + c (N - sum(n^2)/N)), where the correlation c within hosts is 1 / (k + 1) of the prior's
    strength k: chance in small hosts is taken out of the spread. A host gets the rate (f + m k) / (n + k); hosts that spread
    no more than by chance, or that have one document each, all get m. Documents are added up map-side, so a host with a
    third of all rows costs one row per task.
    """
    sums = [F.sum(F.shiftright("failed", r).bitwiseAND(1)).alias(f"f{r}") for r in range(len(RULES))]
    hosts = materialize(measured.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *sums), "hosts")
    n = F.col("n_docs").cast("double")
    moments = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(n * n).alias("squares"), *[
        x for r in range(len(RULES)) for x in (
            F.sum(f"f{r}").alias(f"f{r}"), F.sum(F.col(f"f{r}") * F.col(f"f{r}") / n).alias(f"q{r}"))]).first()  # two per rule
    bad = F.lit(0)
    for r in range(len(RULES)):
        prior = _prior(moments["hosts"], moments["docs"], moments["squares"], moments[f"f{r}"], moments[f"q{r}"])
        if prior is None:
            continue
        m, k = prior
        rate = F.lit(m) if k is None else (F.col(f"f{r}") + m * k) / (F.col("n_docs") + k)
        bad = bad + F.when(rate > limit, F.lit(1 << r)).otherwise(F.lit(0))
    return hosts.select(host, "n_docs", bad.alias("bad_rules"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: Sequence[str] = ("doc_id",),
          limit: float = 0.5) -> DataFrame:
    """``carry`` columns, the measures, ``failed_rules``, ``bad_rules``, ``base_failed`` and ``kept`` per document.

    Two passes over the documents: the first keeps only counts per host, the second measures again and joins the
    stored verdicts of hosts that fail a rule. So no text is shuffled while that table is small, and beyond Spark's own
    broadcast limit the join is a shuffle join with skew splitting.

    Null text has no words and fails the base rule; empty text too. A null host is a host. Equal rows are judged alike
    and all returned. An empty table gives no rows. Carried columns may have any name: they are packed while the
    measures are made.
    """
    host_key = F.struct(F.col(host).alias("s")).alias("_host")
    first = measure(docs, text, [host_key]).withColumn("failed", failed_rules())
    verdicts = host_verdicts(first, "_host", limit).where("bad_rules > 0")
    packed = [F.struct(*[F.col(c) for c in carry]).alias("_carry"), host_key]
    marked = measure(docs, text, packed).withColumn("failed", failed_rules()).join(verdicts, "_host", "left")
    bad = F.coalesce("bad_rules", F.lit(0))
    base = F.expr(BASE_FAILED)
    kept = ~base & (F.col("failed").bitwiseAND(bad) == 0) & (F.bit_count("failed") < 2)
    return marked.select(
        "_carry", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        F.col("failed").alias("failed_rules"), bad.alias("bad_rules"), base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """The documents that :func:`judge` keeps, with their own columns."""
    return judge(docs, text, host, docs.columns, limit).where("kept").select("_carry.*")

"""Divergence of sources: how the terms of each source of a language differ from the other sources and from the language.

Counting is an Arrow pipeline inside tasks: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and a hash ``group_by``
turn texts into partial counts per (lang, source, term), which Spark merges. All later arithmetic is on whole numbers.

The divergence of two sources sums over all terms of a language, also those that neither holds. Only terms that both
hold are looked at one by one: columnar shards, sorted by term, give what these add beyond the rest. Terms that one holds depend on
their count alone, so a histogram of each source's counts stands for them, and terms that neither holds are all alike:

    sum over terms f(p, q) = sum over terms of s f(p, q0) + sum over terms of t f(p0, q) + (V - |s| - |t|) f(p0, q0)
                           + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

with p0 and q0 for terms of count 0. Work and shuffle grow with the terms that sources share, not with sources times terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.common import materialize, small_side

#: What is between terms, and the scale of the shares.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Partial counts of a task are merged before they are sent on, as soon as there are so many.
PARTIAL_ROWS = 500_000
#: Texts that are split at once, in bytes.
SPLIT_BYTES = 4_000_000

Batches = Iterator[pa.RecordBatch]
KEYS = ["lang", "source", "term"]
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about :data:`SPLIT_BYTES` of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SPLIT_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents per (lang, source, term); a row with an empty term for every (lang, source)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=BETWEEN)
    terms = pc.list_flatten(lists).dictionary_encode()
    places = pa.table({"row": pc.list_parent_indices(lists), "code": terms.indices})
    held = places.group_by(["row", "code"]).aggregate([([], "count_all")])
    found = pa.table({"lang": batch.column("lang").take(held["row"]), "source": batch.column("source").take(held["row"]),
                      "code": held["code"], "n": held["count_all"]})
    found = found.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    named = pa.table([found["lang"], found["source"], terms.dictionary.take(found["code"].combine_chunks()), found["n_sum"],
                      found["count_all"]], schema=COUNTS)
    named = named.filter(pc.not_equal(named["term"], ""))
    pairs = pa.table({"lang": batch.column("lang"), "source": batch.column("source")}).group_by(["lang", "source"]).aggregate([])
    none = pa.array([0] * pairs.num_rows, pa.int64())
    return pa.concat_tables([named, pa.table([pairs["lang"], pairs["source"], pa.array([""] * pairs.num_rows), none, none],
                                             schema=COUNTS)])


def _merged(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([sums[c] for c in ("lang", "source", "term", "n_sum", "docs_sum")], schema=COUNTS)


def _partial_counts(batches: Batches) -> Batches:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in _slices(batch):
            if not part.num_rows:
                continue
            held.append(_counted(part))
            rows += held[-1].num_rows
            if rows > PARTIAL_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > PARTIAL_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (rows that hold it); null columns count as ''.

    Every (lang, source) also has a row with an empty term and zeros.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                          for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = given.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return counts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(:data:`SCALE` (count + 2) / (total + 2 terms)), in whole numbers of any size; null without terms."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)"))
    return F.call_function("div", whole, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)")).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most :data:`SCALE` + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _starts(table: pa.Table) -> np.ndarray:
    """Where a term begins, in rows sorted by lang and term."""
    new = np.ones(table.num_rows, bool)
    for column in ("lang", "term"):
        codes = pc.dictionary_encode(table[column].combine_chunks()).indices.to_numpy(zero_copy_only=False)
        new[1:] &= codes[1:] == codes[:-1]
    return np.concatenate([[0], np.flatnonzero(~new)])


def _shared(table: pa.Table) -> pa.Table:
    """What the terms of ``table``, all rows of each, add to the divergence of the sources that hold them."""
    starts = _starts(table)
    run = np.zeros(table.num_rows, np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    lang, source = (pc.dictionary_encode(table[c].combine_chunks()) for c in ("lang", "source"))
    names = source.dictionary.to_pylist()
    order = np.argsort(np.argsort(np.array([n.encode() for n in names], dtype=object)))
    s, at_lang = order[source.indices.to_numpy()], lang.indices.to_numpy().astype(np.int64)
    p, p0 = (table[c].to_numpy() for c in ("p", "p0"))
    left, lag, keys, sums = np.arange(len(run)), 1, [], []
    while len(left):
        left = left[left + lag < len(run)]
        left = left[run[left] == run[left + lag]]
        x, y = left, left + lag
        keys.append((at_lang[x] * len(names) + np.minimum(s[x], s[y])) * len(names) + np.maximum(s[x], s[y]))
        sums.append(_gap(p[x], p[y]) - _gap(p[x], p0[y]) - _gap(p0[x], p[y]) + _gap(p0[x], p0[y]))
        lag += 1
    keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.zeros(len(keys), np.int64)
    np.add.at(value, place, np.concatenate(sums))
    by_name = pa.array(sorted(names, key=str.encode), pa.string())
    return pa.table([lang.dictionary.take(pa.array(keys // len(names) ** 2)), by_name.take(pa.array(keys // len(names) % len(names))),
                     by_name.take(pa.array(keys % len(names))), pa.array(value)], schema=PAIRS)


def _shard(batches: Batches) -> Batches:
    """Partial sums per pair of sources, ``source`` before ``item``; the rows of a task are sorted by lang and term."""
    rest, held = None, []

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["lang", "source", "item"]).aggregate([("value", "sum")])
        return pa.table([sums[c] for c in ("lang", "source", "item", "value_sum")], schema=PAIRS)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        cut = int(_starts(table)[-1])
        rest = table.slice(cut)
        if cut:
            held.append(_shared(table.slice(0, cut)))
        if len(held) == 64:
            held = [merged()]
    if rest is not None:
        held.append(_shared(rest))
    if held:
        yield from merged().to_batches(max_chunksize=50_000)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10,
                      top: int = 10) -> DataFrame:
    """How far the sources of a language are apart, and which terms set a source apart: ``lang``, ``source``, ``part``,
    ``item``, ``value`` and ``rank`` (1 is the largest value; ties by the bytes of ``item``).

    * part ``pair``: every other source of the language, with the divergence of the two summed over all terms kept.
    * part ``term``: up to ``top`` kept terms that are more frequent in the source than in its language.

    Terms are letters in a row, A-Z in lower case; those in ``least_docs`` rows of the language or more are kept. A null text,
    language or source counts as ''. Empty texts have no terms, but their source takes part. Repeated rows count each. A language
    without kept terms has pairs of value 0. An empty table gives no rows. Other columns are not read, so their names cannot
    clash. Very long texts are split whole, one at a time.
    """
    counts = materialize(term_counts(docs, text, lang, source), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(
        F.sum("n").alias("all_n"), F.sum("docs").alias("in_docs"), F.count(F.lit(1)).alias("holders"))
    kept = materialize(kept.where(F.col("in_docs") >= least_docs).drop("in_docs"), "kept-terms")
    langs = small_side(materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_n")),
                                   "langs"))
    words = materialize(counts.join(kept, ["lang", "term"]), "kept-counts")
    sizes = words.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = (counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "held", "terms", "lang_n"])
              .withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))))
    groups = small_side(materialize(groups, "groups"))
    rows = words.join(groups.drop("held"), ["lang", "source"]).select(
        "lang", "source", "term", "holders", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("all_n"), F.col("lang_n"), F.col("terms")).alias("q"))
    rows = materialize(rows, "shares")

    own = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    own = _ranked(own, "term").where(F.col("rank") <= top)

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("other_held"))
    alone = (rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).join(others, "lang").where("source <> item")
             .groupBy("lang", "source", "item").agg(F.sum(F.col("m") * gap(F.col("p"), F.col("q0"))).alias("value")))
    neither = groups.join(others, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(
        (F.col("terms") - F.col("held") - F.col("other_held")) * gap(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    shards = rows.where("holders > 1").select("lang", "term", "source", "p", "p0").repartition("lang", "term")
    common = shards.sortWithinPartitions("lang", "term").mapInArrow(_shard, "lang string, source string, item string, value long")

    def mirrored(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    one_way = materialize(alone.union(common), "one-way")
    pairs = one_way.union(mirrored(one_way)).union(neither).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return own.unionByName(_ranked(pairs, "pair"))

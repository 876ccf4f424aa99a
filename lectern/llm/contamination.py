"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words; an item of fewer words is one window. A window is a set
of shingles (runs of three words, or the whole window where it is shorter), and it occurs in a document only if all of
them do. So it is enough to look for one necessary shingle per window, and the rarest one gives the fewest candidates:

1. the documents' shingles that occur in any window are stored with their positions (one scan, narrow rows);
2. their counts over all documents order the shingles by rarity; the rarest of a window is its prefix, and a window with
   a shingle that no document holds is dropped;
3. prefixes join positions; the offset of the prefix fixes where the window would start, and starts outside the document
   are cut (positional and length bounds);
4. each candidate is verified: every shingle of the window must stand at its place, so that the document has the words
   of the window there, one after the other.

Texts are read twice and never shuffled: after the first step all work is on positions of benchmark shingles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import bind, lower_ascii, materialize, small_side, text_key

WINDOW, SHINGLE = 10, 3
# What separates words once A-Z is in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """Words of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case; null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, by position."""
    return F.when(F.size(words) < width, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: _shingle(words, i, width)))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item and window: ``item`` (id as text, empty for null), ``win`` (words), ``wid`` (its hash)."""
    def cut(words: Column) -> Column:
        return (F.when(F.size(words) == 0, F.array().cast("array<array<string>>"))
                .when(F.size(words) < WINDOW, F.array(words))
                .otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
                                       lambda i: F.slice(words, i, WINDOW))))

    item = F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item")
    return (items.select(item, F.explode(bind(plain_words(F.col(text)), cut)).alias("win"))
            .withColumn("wid", F.xxhash64("win")).distinct())


def _window_shingles(windows: DataFrame) -> DataFrame:
    """``wid``, ``len``, ``offset`` and ``h`` of every shingle of every window."""
    size = F.size("win")
    hashes = F.when(size >= SHINGLE, _shingles(F.col("win"), SHINGLE))
    for width in range(1, SHINGLE):
        hashes = hashes.when(size == width, F.array(_shingle(F.col("win"), F.lit(0), width)))
    return windows.select("wid", size.alias("len"), F.posexplode(hashes).alias("offset", "h")).distinct()


def _positions(docs: DataFrame, text: str, wanted: DataFrame, widths: Sequence[int]) -> DataFrame:
    """``key`` of the text, ``n`` words, ``pos`` and ``h`` of every document shingle among ``wanted``."""
    def at(words: Column) -> Column:
        per_width = [F.transform(_shingles(words, w), lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
                     for w in widths]
        return F.struct(F.size(words).alias("n"), F.concat(*per_width).alias("s"))

    found = docs.select(text_key(F.col(text)).alias("key"), bind(plain_words(F.col(text)), at).alias("w"))
    return (found.select("key", "w.n", F.explode("w.s").alias("s")).select("key", "n", "s.pos", "s.h")
            .join(small_side(wanted), "h", "left_semi").select("key.a", "key.b", "n", "pos", "h"))


def occurrences(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """``a``, ``b`` (key of the text), ``start``, ``len`` and ``wid`` of every window that occurs in a text.

    Copies of a text count once, so a large group of copies makes no more rows than one of its members.
    """
    shingles = materialize(_window_shingles(windows), "window-shingles")
    widths = sorted(r[0] for r in shingles.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # three at most
    wanted = materialize(shingles.select("h").distinct(), "wanted-shingles")
    positions = materialize(_positions(docs, text, wanted, widths or [SHINGLE]).distinct(), "shingle-positions")
    counts = positions.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("p")
    prefixes = (shingles.join(counts, "h", "left").groupBy("wid", "len").agg(rarest, F.count(F.lit(1)).alias("parts"))
                .where("p.df > 0").select("p.h", "p.offset", "wid", "len", "parts"))
    start = F.col("pos") - F.col("offset")
    places = (positions.join(small_side(materialize(prefixes, "prefixes")), "h")
              .select("a", "b", start.alias("start"), "len", "wid", "parts", "n")
              .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))).drop("n"))
    due = places.join(small_side(shingles.drop("len")), "wid").select(
        "a", "b", "start", "len", "wid", "parts", (F.col("start") + F.col("offset")).alias("pos"), "h")
    there = due.join(positions.drop("n"), ["a", "b", "pos", "h"])
    return (there.groupBy("a", "b", "start", "len", "wid", "parts").agg(F.count(F.lit(1)).alias("met"))
            .where("met = parts").select("a", "b", "start", "len", "wid"))


def _covered(spans: Column) -> Column:
    """Words inside any of the ``spans``, which are sorted by start."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))
    return F.aggregate(spans, first, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_carry``, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items`` and ``items``
    (sorted ids of the items with an occurring window) per document.

    Null or empty text has no words and no hit. Items without words have no window; an item without an id counts as
    the id ``''``; repeated items count once. Equal documents are all returned. Empty tables give no rows (documents)
    or no hits (items).
    """
    windows = materialize(item_windows(items, item_id, item_text), "item-windows")
    found = materialize(occurrences(docs, windows, text), "occurrences")
    spans = found.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"))
    hits = spans.select("a", "b", _covered(F.col("spans")).cast("long").alias("n_hit"))
    named = (found.select("a", "b", "wid").distinct().join(windows.select("wid", "item").distinct(), "wid")
             .select("a", "b", "item").distinct().groupBy("a", "b")
             .agg(F.sort_array(F.collect_list("item")).alias("items")))
    per_text = materialize(hits.join(named, ["a", "b"]), "hits-per-text")
    key = text_key(F.col(text))
    words = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), key["a"].alias("a"), key["b"].alias("b"),
                        F.size(plain_words(F.col(text))).cast("long").alias("n_words"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return words.join(per_text, ["a", "b"], "left").select(
        "_carry", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any hit, with their own columns. Texts move only if the keys of all contaminated texts
    are too many for a broadcast."""
    windows = materialize(item_windows(items), "item-windows")
    hit = small_side(materialize(occurrences(docs, windows, text).select("a", "b").distinct(), "contaminated"))
    key = text_key(F.col(text))
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), key["a"].alias("a"), key["b"].alias("b"))
    return packed.join(hit, ["a", "b"], "left_anti").select("_row.*")

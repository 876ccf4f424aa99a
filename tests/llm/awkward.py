"""Rows that every operator has to take: nulls anywhere, empty and very long texts, repeats, clashing columns."""

CLASHING = ("node", "n", "a", "b", "h", "key", "pos", "start", "label", "cell", "rank", "size", "slice", "shard", "slot",
            "copies", "items", "host", "failed", "n_words", "kept", "id", "tie", "runs", "is_target", "_carry", "_text", "_row")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil old potions in a very dark cave tonight"


def texts() -> list[tuple]:
    """(doc_id, text, lang, source)"""
    long = " ".join(f"w{i % 9000}" for i in range(30_000))
    rows = [(1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t\n ", None, None), (None, PROSE, "en", "s1"),
            (None, None, None, None), (4, PROSE, "en", "s2"), (5, PROSE, None, "s2"), (6, PROSE.upper(), "en", ""),
            (7, PROSE + "\n" + PROSE + "\n" + PROSE, "de", "s3"), (8, long, "en", "s3"), (9, long + " end", "en", "s3"),
            (10, "x", "fr", "s4"), (10, "x", "fr", "s4"), (10, "x", "fr", "s4"), (11, "#$% *** &&& ||| <<<", "en", "s4"),
            (12, "É " * 40, "fr", "s5"), (13, "\x00\x1f weird   spaces   here", "es", "s5"), (13, "same id", "es", "s5"),
            (14, "\U0001F600 " * 25 + "emoji", "en", None)]
    rows += [(100 + i, PROSE.replace("fox", f"fox{i}"), "en", "s6") for i in range(5)]
    return rows


def frame(spark, rows=None, partitions=3):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *CLASHING) for r in rows], SCHEMA
                                 ).repartition(partitions)

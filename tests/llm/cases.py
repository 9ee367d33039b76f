"""Small tables with what operators have to stand: NULLs, empty and long texts, repeated rows, clashing names."""

from __future__ import annotations

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, component_id int, content string, "
    "slot string, shard string, part string, log_p string, kept_id string, `limit` string, word string"
)
LONG = " ".join(f"word{i % 97} und{i % 31}" for i in range(40_000))


def tricky(spark):
    """Documents; rows 3 and 4 are copies, 5 is a repeated row, one has no id, one no text, one nothing."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. MIT License applies here.", "en"),
        (2, None, "en"),
        (3, "Ein kurzer Text über nichts Besonderes, nur ein paar Wörter.", "de"),
        (4, "Ein kurzer Text über nichts Besonderes, nur ein paar Wörter.", "de"),
        (5, "  spaced\tout\n\nlines  and more ", None),
        (5, "  spaced\tout\n\nlines  and more ", None),
        (6, "", "fr"),
        (None, "no id for this one at all, sorry", "en"),
        (7, LONG, "en"),
        (None, None, None),
        (8, "　\U0001f600 éàü ÀÉ <|endoftext|> it's", "xx"),
    ]
    return spark.createDataFrame([_row(*r) for r in rows], SCHEMA)


def _row(doc_id, text, lang):
    return (doc_id, text, lang, "src0", None, "a", 1, "b", "c", "d", "e", "f", "g", "h", "i")


def labels(spark):
    """Labels with gaps, a repeated and a contradicting row."""
    rows = [(1, 1, 0), (3, 1, 0), (3, 1, 0), (5, 1, None), (7, 1, 0), (8, None, 1), (None, 1, 1), (99, 0, 1), (4, 1, 0), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def empty(frame):
    return frame.limit(0)


def as_rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)

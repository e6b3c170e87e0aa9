"""What the tests of this package share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod " * 4000) + "end"
ODD_TEXTS = [None, "", " \n\t ", "a", "a b", "a b c", "A B C", "Ünï cödé ☃ \u00a0 x\u2003y", "x " * 60, LONG, "same text here", "same text here", "l1\nl1\nl2\n\nl1", "\\<turn:user>\n</turn>", "İ ß Σας 日本語 😀 <|endoftext|>"]


def docs(spark, rows):
    return spark.createDataFrame([r if len(r) == 5 else (*r, "en", "s", None if r[1] is None else len(r[1])) for r in rows], DOCS)


def odd_docs(spark):
    """Documents with odd texts, a null id, null metadata and repeated rows."""
    rows = [(i, t, ["en", None][i % 2], ["s0", "s1", None][i % 3], None if t is None or i % 4 == 0 else len(t)) for i, t in enumerate(ODD_TEXTS)]
    return docs(spark, [*rows, (None, "text without an id", "en", "s0", 18), rows[5], rows[5]])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")

"""Small documents that hold the awkward cases, and plain versions of what operators share."""

import re
import string

from pyspark.sql import functions as F

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions under the pale moon tonight".split()

TEXTS = [
    " ".join(BASE),
    " ".join(BASE),  # an exact copy
    " ".join([*BASE, "again"]),  # a near copy
    " ".join(["so", *BASE[2:17], "ends", "here"]),  # a shared passage
    "",
    None,
    "   \t\n\x0b ",
    "one",
    "One two three",
    "ÄÖÜ ß é 日本 😀 " * 3,
    "\x00\x01\x02 odd \x7f bytes",
    " ".join(f"w{i % 977}" for i in range(30_000)),  # very long
    "a" * 5_000,
    "Under the MIT-license and Apache License, Version 2.0; also CC BY-NC. under the mit license",
    "mail a.b@c.example.org or +1 (555) 010-9999, ip 10.0.0.1, card 4111 1111 1111 1111",
]

CLASHES = ("id", "key", "text_2", "_row", "_tag", "_hash", "h", "block", "a", "b", "src", "dst", "n", "m", "c", "rank", "score", "class", "_id", "_own", "more", "base", "tag", "row", "start")


def documents(spark, texts=TEXTS, first=0):
    rows = [(first + i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def awkward(spark):
    """All cases together: repeated rows, a repeated doc_id with another text, a null doc_id, and clashing columns."""
    docs = documents(spark)
    more = spark.createDataFrame([(0, TEXTS[0], "en", "s0", 1), (7, "another text of the same id", "en", None, 2), (None, TEXTS[0], None, None, None), (None, None, None, None, None)], docs.schema)
    return docs.union(more).select("*", *(F.lit("x").alias(c) for c in CLASHES))


def empty(spark):
    return documents(spark, []).select("*")


def words(text):
    return WHITE.findall(text or "")


def lower(text):
    return (text or "").translate(LOWER)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

"""Small tables with everything that may be odd in a table, and plain statements of shared rules."""

import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
#: Names that the operators use inside or return.
CLASHES = ("digest", "key", "node", "start", "w0", "h", "r", "of", "id", "n", "n_words", "score", "kind", "place",
           "signature", "bytes", "label", "edited", "copies", "spans", "which", "term")
BASE = ("Lorem veritas quam solum est, inter duo loca semper idem verbum ponitur; quod erat in libro primo scriptum"
        " manet usque ad finem operis, nisi quis mutat. Ésta línea tiene acentos y números 12345 también. ")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def long_text(n):
    return " ".join(f"w{i * 7919 % 100003}x" for i in range(n))


def odd_rows():
    """(doc_id, text): null ids and texts, empty and one-word texts, ties, repeated rows, a very long text."""
    other = "Quite different words stand in this second text, number by number, one two three four five six seven."
    return [(None, BASE * 2), (None, None), (1, None), (2, ""), (3, BASE * 3), (3, BASE * 3), (4, BASE * 3),
            (5, long_text(40_000)), (6, "one"), (7, " \n\t.,;!"), (8, other), (8, BASE), (9, "a" * 3000),
            (10, BASE[:150] + " x " + BASE[150:]), (11, other + " eight"), (12, "\U0001f600 é ß " * 80)]


def frame(spark, rows, schema="doc_id long, text string", **constant):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, schema)
    names = set(made.columns)
    extra = {c: F.lit(f"clash {c}") for c in CLASHES if c not in names}
    return made.repartition(3).withColumns({**extra, **{k: F.lit(v) for k, v in constant.items()}})


def shingles(text, size=5):
    w = words(text)
    return Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or Counter([tuple(w)] if w else [])


def rows_of(result, *columns):
    return sorted((tuple(r) for r in result.select(*columns).collect()), key=repr)

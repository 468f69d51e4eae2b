"""Small tables with the odd cases: nulls, empty and long texts, repeats, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, word string"


def word(r):
    return "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def rows(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(prose(r, r.randint(5, 40)) for _ in range(r.randint(1, 5)))
        if i % 3 == 0:
            text += "\nAll rights reserved by the site"
        out.append((i, text, "en" if i % 4 else "de", f"src{i % 3}", len(text), i, "x"))
    base = out[5][1]
    out += [
        (100, base, "en", "src1", None, None, None),
        (101, base + " " + word(r), "en", None, 3, 1, None),
        (101, base, None, "src1", 3, 1, None),
        (None, base, "en", "src1", 3, 1, None),
        (102, None, "en", "src0", None, 1, None),
        (103, "", "en", "src0", 0, 1, None),
        (104, " \n\t ", "en", "src0", 4, 1, None),
        (105, "one two", "en", "src0", 7, 1, None),
        (106, "Ünï ñandú ß " * 3000, "en", "src0", 7, 1, None),
        (None, None, None, None, None, None, None),
    ]
    return out


def docs(spark, **kw):
    return spark.createDataFrame(rows(**kw), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

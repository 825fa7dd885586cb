"""Odd documents for every operator: nulls, empty and long texts, repeated rows, extra clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, score double, kept boolean, h long, "
          "spans string, doc_key string, component_id long, start long, n int, value string, label int, words string")


def texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, long = prose(120), prose(60), prose(6000)
    words = base.split()
    near = " ".join(words[:60] + ["other"] + words[61:])
    rows = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, near), (5, near),
        (6, ""), (7, None), (8, "   \n\t "), (9, "one"), (10, "two words"), (11, "one"),
        (12, prose(40) + " " + passage + "\n" + prose(10)), (13, passage + " é ñ ß " + prose(30)),
        (14, prose(5) + "\r\n" + passage), (15, "aaaa " * 200), (16, "x" * 900), (17, "y" * 199 + "é"),
        (18, long), (19, long[2000:9000] + " end"), (None, base), (None, None), (None, passage),
        (20, prose(30)), (20, prose(30)), (21, "日本語 " * 80 + passage), (22, "\x0b".join(prose(50).split())),
        (23, "idiot " + prose(20)), (24, "a\x00b " + passage), (25, passage + passage),
    ]
    return rows


def frame(spark):
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"src{n % 3}", n, 0.5, True, 1, "s", "k", 2, 3, 4,
             "v", 1, "w") for n, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

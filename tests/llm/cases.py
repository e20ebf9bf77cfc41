"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, other columns with clashing names."""

import random

WORDS = "the of and a to in on river stone light garden paper window quiet morning letter bridge yellow answer music small great winter".split()


def prose(seed: int, n: int, lines: bool = True) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + (r.choice([" ", " ", " ", ", ", ".\n"]) if lines else " ") for _ in range(n)).strip()


def edited(text: str, seed: int, k: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(k):
        words[r.randrange(len(words))] = f"changed{r.randrange(1000)}"
    return " ".join(words)


def rows() -> list[tuple]:
    """(doc_id, text) with all of the cases."""
    base = [prose(i, 120) for i in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, base[0]) for i in range(4)]  # copies
    out += [(30 + i, edited(base[1], i, 2)) for i in range(4)]  # near copies
    out += [(40, base[2].replace(" ", "  ")), (41, base[2] + "\n")]  # equal but for white space
    out += [(50, None), (51, ""), (52, " \n\t"), (53, "x"), (54, "two words"), (55, "Größe 中文 😀 naïve é"), (56, None)]
    out += [(60, prose(99, 6000)), (61, prose(99, 6000)[:20000] + " tail")]  # long
    out += [(62, base[3]), (62, base[3])]  # a repeated row
    out += [(None, base[4]), (None, "a text without an id")]
    out += [(70, base[5][:200] + " " + base[6][:200] + " " + base[7][:200])]  # passages of others
    return out


def table(spark, data: list[tuple]):
    """data as a table with the columns of documents and others, whose names operators use themselves."""
    full = [(i, t, None if k % 3 else "en", None if k % 4 else "src", None, f"d{k}", "clash", k, "x", 1.5, [k], f"i{k}", f"s{k}", k, f"m{k}", "r") for k, (i, t) in enumerate(data)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, did string, txt string, tk int, unit string, n double, key array<int>, _id string, _sha string, component int, `meta.x` string, row string")


def empty(spark):
    return table(spark, rows()[:1]).limit(0)

"""Small documents that hold the awkward cases, and brute-force helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile("[A-Z]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return UPPER.sub(lambda m: m.group().lower(), text or "")


def prose(n, seed):
    rng = random.Random(seed)
    syllables = "ka lo mi ten dor sa vel rin tu pos éa ßo".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): null, empty and blank texts, repeated rows, copies, near copies, a very long text, null ids."""
    base = [prose(60 + 7 * i, seed * 100 + i) for i in range(12)]
    near = base[3].split()
    near[10] = "changed"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, " \t\n "), (23, "one"), (24, "two words"), (25, base[3]), (26, " ".join(near))]
    rows += [(27, base[3]), (27, base[3]), (28, prose(20_000, 99)), (29, "same " * 400), (None, base[5]), (None, None)]
    rows += [(30, base[6].upper()), (31, base[0] + "\n" + base[1]), (32, "é x   y"), (-5, base[7])]
    return rows


def frame(spark, rows, extra=False):
    """The rows as a table; `extra` adds columns whose names the operators use themselves."""
    schema = "doc_id bigint, text string"
    if extra:
        rows = [(*r, "a", 1, "b", True, 5, "d") for r in rows]
        schema += ", id string, n int, block string, kept boolean, _k1 int, _drops string"
    return spark.createDataFrame(rows, schema)

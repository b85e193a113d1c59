"""Small documents with every awkward case: nulls, empty, short, long and repeated texts, equal and null ids, extra columns."""

import random

SCHEMA = "doc_id long, text string, score string, row long, n long, node string, cid string"


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["of", "the", "and", "Zeta", "éclair", "naïve", *("w%d" % i for i in range(400))]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(30) for _ in range(3)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = text(rng.randint(0, 120))
        elif kind == 1:
            t = text(10) + "\n" + rng.choice(shared) + "  " + text(12)
        elif kind == 2 and out:
            t = rng.choice(out)[1]
        elif kind == 3 and out:
            base = (rng.choice(out)[1] or "").split(" ")
            if base:
                base[rng.randrange(len(base))] = "changed"
            t = " ".join(base)
        elif kind == 4:
            t = rng.choice(["", None, " ", "one", "two words", "a b c d", "  \n\t "])
        else:
            t = rng.choice(shared).upper() + " " + text(3)
        out.append((i * 3 % (n + 7), t))
    out += [(5, out[3][1]), (5, out[3][1]), (None, out[1][1]), (None, out[1][1]), (7, "loop " * 90), (10_000, text(3000))]
    return out


def frame(spark, rows: list[tuple]):
    wide = [(i, t, "x", 1, 2, "y", "z") for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)

"""Small tables with the awkward cases, for all operators on documents."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, shard string, tokens string, _c int, comp string, grp string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (3, 4, 5, 40, 120, 400)]
    out = [None, "", " \t\n", "é ü 日本 😀 ñ", "123 456", "a" * 49, "b" * 50, "The " * 3000, words(rng, 30_000)]
    for t in base:
        out += [t, t, t + " ", t.upper(), t.replace(" ", "\n")]
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
        out.append(words(rng, 60) + " " + t + " " + words(rng, 60))
    made = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None, "x", "y", "z", 1, "c", "g") for i, t in enumerate(out)]
    made += [made[3], made[12], made[12]]  # repeated rows
    made.append((None, "no id at all here", "en", "s0", 1, "x", "y", "z", 1, "c", "g"))
    rng.shuffle(made)
    return made


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)

"""Small tables with every awkward case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, fp string, own string, r_id string, words string, kept string, k_id string, c0 string"


def texts(seed: int = 3, n: int = 60) -> list:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "é", "st"]) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = prose(40)
    out = [prose(rng.randint(60, 150)) for _ in range(n)]
    out += [out[0], out[0], out[1] + " x", f"{prose(20)} {shared} {prose(30)}", f"{shared} {prose(9)}", f"é{shared}è", f"{prose(3)}\n{shared}"]
    out += ["", None, "a", "a" * 3000, "ab " * 900, "\n\n \t\x0b\x0c\r\n", "line\nline\nline\n" * 30, "<|endoftext|> tail", "\x00nul\x00 " * 20, "😀" * 70, "one two"]
    return out


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    found = [(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts(seed, n))]
    last = found[-1]
    return [*found, last, (found[2][0], "another text of an id met before " * 9, *found[2][2:]), (None, found[3][1], *found[3][2:]), (None, None, *[None] * 11)]


def documents(spark, seed: int = 3, n: int = 60):
    return spark.createDataFrame(rows(seed, n), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)

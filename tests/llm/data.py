"""Small tables with what operators must withstand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, row int, size string, label int, bucket string, copies int, removed_lines string, tokens string"


def words(rng: random.Random, n: int, stock: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(2 + k % 5)) + str(k) for k in (rng.randrange(stock) for _ in range(n))]


def texts(seed: int = 1) -> list[str | None]:
    """NULL, empty and blank texts, copies, near copies, shared passages, ties, long ones, odd characters."""
    rng = random.Random(seed)
    base = words(rng, 120)
    passage = " ".join(words(rng, 30))
    out: list[str | None] = [None, "", " \t\n ", "a", "one two", "one two", "ONE two", "▁ mark ▁", "\n\nx\n", "\x00 nul \x0b vt", "é" * 60, "é 日本語 🙂 text"]
    out += [" ".join(base), " ".join(base), " ".join(base).upper(), "  ".join(base)]
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(len(near))] = rng.choice(("edit", "other", "word"))
        out.append(" ".join(near))
    for _ in range(8):
        out.append("\n".join(["Header line", " ".join(words(rng, 25)), passage, " ".join(words(rng, 15)), "Footer "]))
    out.append("long " + " ".join(words(rng, 5000, 5000)))
    out.append("aaaa" * 200)
    out.append("unbroken" * 300)
    return out


def rows(seed: int = 1) -> list[tuple]:
    """``texts`` as rows in mixed order, with repeated rows, a repeated id, NULL ids, NULL columns and clashing names."""
    out = []
    for i, text in enumerate(texts(seed)):
        source = None if i % 7 == 3 else f"s{i % 3}"
        out.append((i * 3, text, "xx" if i % 5 else None, source, None, "n", i, "big", 7, "b", 3, "r", "t"))
    out += [out[12], out[20], (out[5][0], "another text under a known id", *out[5][2:]), (None, "no id at all", *out[5][2:]), (None, None, *out[5][2:])]
    random.Random(seed).shuffle(out)
    return out


def table(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def ordered(out):
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])

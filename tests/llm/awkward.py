"""A small documents table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node string, bucket int"


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(120))
    out = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 14, 60, 200])))
        if i % 7 == 0:
            text = f"{text}\n{passage}  {text[:40]}"
        if i % 11 == 3:
            text = out[-1][1]
        if i % 13 == 5 and out[-2][1]:
            words = out[-2][1].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        out.append((i * 3, text, "en", ["a", "b", None, "ü"][i % 4], len(text or "")))
    out += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n ", "en", "b", 4), (203, "x", "de", "c", 1), (203, "x", "de", "c", 1), (None, passage, "en", "a", 700)]
    out += [(204, "日本語 テキスト é " * 30 + "-" * 900, "ja", "c", 900), (205, passage + " end " * 300, "en", "a", 2500)]
    return [(*r, 0.5, 1, "n", 2) for r in out]


def frame(spark, n: int = 60):
    return spark.createDataFrame(rows(n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

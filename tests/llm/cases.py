"""Small tables with every awkward case: nulls in any column, empty and very long texts, ties,
repeated rows, no rows, other columns whose names clash with what operators add."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, class string, words string, key long, own int, comp long, size long, sequence_id long, payload string"


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7)))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(word(rng) for _ in range(n))


def edited(rng: random.Random, text: str, k: int) -> str:
    parts = text.split()
    for _ in range(k):
        parts[rng.randrange(len(parts))] = word(rng)
    return " ".join(parts)


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5]) for i in range(20)]  # copies
    rows += [(200 + i, edited(rng, base[i % 7], 1 + i % 3)) for i in range(30)]  # near copies
    rows += [(300, None), (301, ""), (302, "   \n\t "), (303, "a"), (304, "12 345 %%%"), (305, "It's Ünïcode, we'll see. ΣΑΣ 日本語 🙂"), (306, "<|endoftext|>x<|startoftext|> y"), (307, "\x00\x01 nul"), (308, "Straße CC BY-NC 4.0\nAll rights reserved. GENERAL PUBLIC LICENSE; general-public license")]
    rows += [(309, prose(rng, 30_000)), (310, "x" * 5000), (None, base[0]), (None, "lonely row without an id"), (3, base[3]), (3, base[3]), (4, "another text with the same id as before")]
    return rows


def documents(spark: SparkSession) -> DataFrame:
    rows = [(i, t, None if n % 9 == 0 else "en" if n % 2 else "xx", None if n % 5 == 0 else "s", None, 0.5, 1, "c", "w", 7, 1, 2, 3, 4, "p") for n, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def write(df: DataFrame, folder, name: str) -> str:
    df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)

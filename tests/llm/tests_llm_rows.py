"""Rows that operators must take."""

import random


def letters(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, copies and near copies."""
    base = letters(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a"),
        (1, base, "en", "a"),
        (1, "another text with the same id", "en", "b"),
        (2, base.upper(), "en", "a"),
        (3, near, "en", None),
        (4, "", "de", "b"),
        (5, None, None, None),
        (None, "an id that is null", "de", "b"),
        (None, None, None, "a"),
        (6, " \n\t\x0b ", "fr", "c"),
        (7, "1234 !!! 56", "fr", "c"),
        (8, "Ünïcödé ßtraße — 漢字 \U0001f600 don't STOP", "de", "c"),
        (9, letters(2, 30_000), "fr", "c"),
        (10, "word", "fr", "d"),
        (11, "word", "fr", "d"),
        (12, letters(3, 4000).replace(" ", ""), "en", "d"),
    ]
    return rows + [(100 + i, letters(100 + i, 20 + i), ["en", "de", "fr"][i % 3], f"s{i % 4}") for i in range(40)]

"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeats, near copies."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, r string, spans string, kind string, `copies` int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(5)
    shared, long = sentence(rng, 60), sentence(rng, 20_000)
    base = [sentence(rng, rng.randint(1, 200)) for _ in range(12)]
    words = base[3].split()
    near = " ".join(w if i != len(words) // 2 else "changed" for i, w in enumerate(words))
    odd = [None, "", " ", "a", "A a A", "äöü ñ 漢字 " * 30, "x" * 400, "ab" * 300, "\n\n\t", "12 34"]
    return [*base, base[0], base[0], near, f"{base[1]}\n{shared}", f"{shared} {base[2]}", f"{base[4]} {shared} {base[5]}", long, long[5000:9000] + "tail", *odd, *odd]


def rows(more: list[str | None] = ()) -> list[tuple]:
    out = []
    for i, t in enumerate([*texts(), *more]):
        out.append((i * 7 % 101, t, None if i % 9 == 4 else ["en", "fr"][i % 2], None if i % 8 == 5 else f"s{min(i % 6, 2)}", None if t is None else len(t), 1.0, "x", "y", "z", 3))
    return out


def documents(spark, more: list[str | None] = ()):
    return spark.createDataFrame(rows(more), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

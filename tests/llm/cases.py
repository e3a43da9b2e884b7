"""A small table with what tends to break operators, and brute-force versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, name string, n long, kept boolean, rank int, tail string, shard int, word string, label int"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + (".\n" if rng.random() < 0.08 else " ") for w in words)


def documents(seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(3, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    line = "this line stands in very many documents, see the LICENCE file"
    texts = [*base, *base[:8], *(t.replace(" ", "  \t") for t in base[:5])]
    for t in base[8:16]:
        words = t.split(" ")
        texts.append(" ".join(w if k != len(words) // 2 else "changed" for k, w in enumerate(words)))
    texts += [t + passage for t in base[16:20]] + [f"{t}\n  {line}\n{line.upper()}" for t in base[20:28]]
    long = prose(rng, 8000, 5000)
    texts += [long, long, passage + passage, "", "", None, None, " \n\t ", "\n\n", "a", "é\x0bß\x0c" * 30, "x" * 5000, "word " * 300, "</s>[INST] \\ [/INST]", "\U0001f389 \u3000 caf\u00e9\u0301 12\u00bd"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[2], (rows[3][0], "another text with the same id"), (None, base[1]), (None, None), (None, "text of no id")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None, None, 7, "x", 1, True, 1, "t", 2, "w", 0) for k, (i, t) in enumerate(rows)], SCHEMA)


def words(text: str | None, lower: bool = False) -> list[str]:
    data = (text or "").encode()
    return [w.decode() for w in (data.lower() if lower else data).split()]

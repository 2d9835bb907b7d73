from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_words string, "
          "row_key string, q string, segment string, findings string, ids string")


def corpus() -> list[tuple]:
    """Random texts over few words, with copies, near copies, shared passages, nulls, blanks and repeated rows."""
    rng = random.Random(42)
    words = ["the", "Of", "über", "re-ad", "x1", "naïve", "日本語", "a.b", "token", "ENDING", "plain", "wörter", "and", "0815"]
    words += ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)]

    def text(n: int) -> str:
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))

    passage = text(70)
    out: list[str | None] = [None, "", " \t\n ", "one", "two words", text(3), text(49), text(50), text(51)]
    for _ in range(14):
        base = text(rng.randint(20, 160))
        out += [base, base] if rng.random() < 0.4 else [base]
        if rng.random() < 0.5:
            own = base.split(" ")
            own[rng.randrange(len(own))] = "changed"
            out.append(" ".join(own))
        if rng.random() < 0.4:
            out.append(text(12) + passage + text(9))
    out += [passage, text(4000) + passage, "same line here now\n" * 60, "a" * 300, passage * 3]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t))
            for i, t in enumerate(out)]
    rows.append(rows[12])                               # a repeated row
    rows.append((rows[13][0], text(60), "en", "s1", 1))  # an id with another text
    rows.append((None, out[14], "en", "s0", 1))         # a null id with a known text
    rows.append((None, None, None, None, None))
    rng.shuffle(rows)
    return [(*r, *["clash"] * 7) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

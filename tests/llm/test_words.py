"""Operators 11 to 13 against brute force, direct computation and exhaustive search."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.llm import ngrams, queries, repair, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11: periodic runs

def brute_runs(ws: list[str], min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    out, n = [], len(ws)
    for p in range(1, n // min_repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ws[j] == ws[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, min_repeats * p):
                part = ws[i:j + p]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def periodic_texts() -> list[str | None]:
    rng = random.Random(11)
    out: list[str | None] = [None, "", " \t", "a", "a a a a a", "a a a a a a", "a b " * 40, "x " * 5000, "aba ab aba ab " * 9]
    for _ in range(150):
        n, letters = rng.randint(0, 70), "abcdefg"[:rng.choice([1, 2, 3, 6])]
        ws = [rng.choice(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 7)
            ws = [w if i < a else ws[min(n - 1, a + (i - a) % p)] for i, w in enumerate(ws)]
        out.append(rng.choice([" ", "\n", " \t "]).join(ws))
    return out


@pytest.mark.parametrize(("least", "repeats"), [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(spark, least, repeats):
    texts = periodic_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[8], "x"), (6, texts[6], "x"), (6, "b a " * 9, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3)
    found = runs.find_runs(df, min_length=least, min_repeats=repeats, batch_bytes=900).collect()
    got = Counter((r["id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in found)
    want = Counter()
    for i, t, _ in rows:
        ws = WORD.findall(t or "")
        exp = brute_runs(ws, least, repeats)
        want[i, len(ws), tuple(exp), collapsed(ws, exp)] += 1
    assert got == want
    assert any(r["runs"] for r in found)


def test_runs_of_a_very_long_text_and_an_empty_table(spark, empty):
    text = "w0 " + "a b c " * 30_000 + "end"
    got = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 90_000, 3)] and got["collapsed"] == "w0 a b c end"
    assert runs.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(empty, min_repeats=1)


def test_periods_are_planted_by_checksum(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(60)] + [(None, text), (7, None), (8, "")]
    got = Counter(map(tuple, queries.planted_periods(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    want = Counter()
    for i, t in rows:
        ws, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws))
        want[i, t] += 1
    assert got == want and got[0, text] + got[1, text] <= 2 and any(t != text for (i, t) in got if i is not None and t)


# ---------------------------------------------------------------- 12: language-model scores

def direct_scores(rows, order: int, weights) -> Counter:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seqs = [(i, held, ["<begin>", *WORD.findall((t or "").translate(low)), "<end >"]) for i, t, held in rows]
    c = [Counter() for _ in range(order)]
    for _, held, s in seqs:
        if not held:
            for k in range(order):
                c[k].update(tuple(s[j - k:j + 1]) for j in range(k, len(s)))
    total = sum(n for g, n in c[0].items() if g != ("<begin>",))
    types = len([g for g in c[0] if g != ("<begin>",)])

    def p(h, w):
        if not h:
            return (c[0][(w,)] + 0.1) / (total + 0.1 * (types + 1))
        m = weights[len(h) - 1]
        return (c[len(h)][(*h, w)] + m * p(h[1:], w)) / (c[len(h) - 1][h] + m)

    def scored(s, k):
        return round(math.fsum(math.log10(p(tuple(s[max(0, j - k):j]), s[j])) for j in range(1, len(s))), 6)

    return Counter((i, not held, len(s) - 1, sum(c[0][(w,)] > 0 for w in s[1:]), total, scored(s, 0), scored(s, order - 1))
                   for i, held, s in seqs)


def scored(found) -> Counter:
    return Counter((r["id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6),
                    round(r["score"], 6)) for r in found.collect())


@pytest.mark.parametrize(("order", "weights"), [(2, (3.0,)), (3, (128.0, 32.0)), (4, (5.0, 2.0, 0.5))])
def test_scores_equal_direct_computation(spark, rows, docs, order, weights):
    train = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    own = [(r[0], r[1], r[0] is not None and r[0] % 5 == 0) for r in rows]
    want = direct_scores(own, order, weights)
    for size in (1 << 24, 4000):        # one shard, and many
        got = scored(ngrams.score_texts(docs, train, order=order, weights=weights, shard_bytes=size))
        assert got == want


def test_scores_with_more_words_than_products_of_32_bits(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(70_000)]
    rows = [(i, " ".join(words[i * 700:(i + 1) * 700] + rng.sample(words, 20)), i % 10 == 3) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, held boolean")
    assert scored(ngrams.score_texts(df, ~F.col("held"))) == direct_scores(rows, ngrams.ORDER, ngrams.WEIGHTS)


def test_scores_without_training_texts_and_of_an_empty_table(spark, empty, docs):
    got = ngrams.score_texts(docs, F.lit(None).cast("boolean")).collect()
    assert {(r["train"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(False, 0, 0, 0.0, 0.0)}
    assert ngrams.score_texts(empty, F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        ngrams.score_texts(docs, F.lit(True), order=1)


def test_model_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ngrams.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).where("not train")
    row = got.agg(F.avg("score").alias("s"), F.avg("base_score").alias("b")).first()
    assert row["s"] > 0.9 * row["b"]


def test_probabilities_of_a_context_sum_to_one():
    texts = ["a b a c", "b a b", "c"]
    shard = ngrams.Shard([*texts, "a a", "c b d"], 3)
    counts = shard.counted(__import__("numpy").array([True] * 3 + [False] * 2))
    tokens, types = 11, 4
    model = ngrams.Automaton(shard, counts, tokens, types, (2.0, 1.0))

    arcs = {}
    for k, at in enumerate(shard.sample):
        for number, place in enumerate(at):
            gram = int(model.first[k]) + number
            if model.known[gram]:
                source = int(model.first[k - 1] + shard.number[k - 1][place - 1] + 1) if k else 0
                arcs[source, int(shard.number[0][place])] = float(model.weight[gram])

    def weight(state: int, token: int) -> float:
        if (state, token) in arcs:
            return arcs[state, token]
        return float(model.fall[state]) + weight(int(model.fail[state]), token)

    known = [int(t) for t in range(len(counts[0])) if counts[0][t] > 0 and shard.grams[0][t] != ngrams._BEGIN_GRAM[0]]
    unseen = 0.1 / (tokens + 0.1 * (types + 1))
    closed = [int(at) in set(shard.stop.tolist()) for k in range(2) for at in shard.sample[k]]     # nothing follows an end
    for state in range(len(model.fail)):
        if state and closed[state - 1]:
            continue
        total = sum(10 ** weight(state, t) for t in known)
        fall, at = 0.0, state
        while at:
            fall, at = fall + float(model.fall[at]), int(model.fail[at])
        assert math.isclose(total + unseen * 10 ** fall, 1.0, rel_tol=1e-9)


# ---------------------------------------------------------------- 13: structure repair

LEGAL = re.compile(r"(s?(ua)+)?")


def exhaustive(letters: str) -> tuple[int, str]:
    """The least (cost, audit) over all edits with at most two inserts in a gap."""
    moves = []
    for c in letters:
        late = 1 if c != "D" and c.isupper() else 0
        own = [(3, "D", "")]
        if c != "D":
            own += [(late, "K", c.lower()), (2 + late, "R", "u"), (2 + late, "R", "a")]
        moves.append(own)
    gap = [(2 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    for rows in itertools.product(*moves):
        for gaps in itertools.product(gap, repeat=len(rows) + 1):
            parts = [gaps[0], *itertools.chain.from_iterable(zip(rows, gaps[1:], strict=True))]
            if LEGAL.fullmatch("".join(p[2] for p in parts)):
                key = (sum(p[0] for p in parts), "".join(p[1] for p in parts))
                best = key if best is None or key < best else best
    return best


def path_of(letters: str) -> list[repair.Node]:
    path = [repair.LAST]
    for c in reversed(letters):
        path.append(repair.before(c, path[-1]))
    return path


def test_cheapest_edits_equal_exhaustive_search():
    rng = random.Random(13)
    cases = ["", *"suaoSUAOD", *map("".join, itertools.product("suaoSUAOD", repeat=2))]
    cases += ["".join(rng.choice("suaoSUAOD") for _ in range(3)) for _ in range(25)]
    for letters in cases:
        path = path_of(letters)
        assert (path[-1].cost[0], repair.follow(path)[0]) == exhaustive(letters), letters


def slow_repair(conv: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, text) of one conversation's rows (turn, role, text)."""
    conv = sorted(conv, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, letters, faults = set(), "", Counter()
    for _, role, text in conv:
        ends = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        first = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "D" if fault in ("blank", "duplicate") else first.upper() if fault else first
    turns = {t for t, _, _ in conv if t is not None}
    initials = [r[1][:1] for r in conv]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    path = path_of(letters)
    audit, at, roles = repair.follow(path)
    text = "\n".join(f"{conv[i][1] if r is None else r}:{conv[i][2] if i >= 0 else ''}" for i, r in zip(at, roles, strict=True))
    return ((max(turns) - min(turns) + 1 - len(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            illegal, path[-1].cost[0], audit, text)


def test_repair_equals_a_walk_row_by_row(spark, empty):
    rng = random.Random(31)
    texts = ["Fine.", "Really?", "cut off", "", " \n", "Two. parts", "ok!\t ", None]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]),
                         rng.choice(texts), rng.random() < 0.9, "clash"))
    rows += rows[:8]                                                   # repeated rows
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.", True, "x") for t in range(3001)]     # a very long conversation
    rows += [(101, 0, "user", "gone", False, "x"), (102, 0, "user", "who knows", None, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, there boolean, audit string").repartition(4)
    got = {}
    for r in repair.repair(df, present=F.col("there")).collect():
        assert r["conv"] not in got
        got[r["conv"]] = (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")),
                          "\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"]))
    convs: dict = {}
    for conv, turn, role, text, there, _ in rows:
        own = convs.setdefault(conv, [])
        if there:
            own.append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: slow_repair(x) for c, x in convs.items()}
    assert got[101] == (0, 0, 0, 0, 0, 0, "", "") and got[100][5] == 2 and got[100][6].endswith("KI")
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.repair(none).count() == 0


def test_every_suffix_is_one_node(monkeypatch):
    made = []
    plain = repair.before
    monkeypatch.setattr(repair, "before", lambda letter, after: made.append(letter) or plain(letter, after))
    import pyarrow as pa
    signatures = ["ua" * 5, "sua", "uaua", "uDa", "ua", "ua", "", "suaua"]
    ordered = sorted(s[::-1] for s in signatures)
    batch = pa.RecordBatch.from_arrays([pa.array(ordered), pa.array(ordered)], names=["key", "reversed"])
    out = [r for b in repair._walk([batch.slice(0, 3), batch.slice(3)]) for r in b.to_pylist()]
    assert len(made) == len({s[i:] for s in signatures for i in range(len(s))})
    assert [r["cost"] for r in out] == [path_of(s[::-1])[-1].cost[0] for s in ordered]


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"A. b! c? {t}") for c in range(12) for t in range(9)] + [(None, None, None, None)]
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["present"]) for r in queries.damaged_turns(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want[c, t, "user" if k == 4 else role, text, k != 0] += 2 if k == 3 else 1
    assert got == want
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"

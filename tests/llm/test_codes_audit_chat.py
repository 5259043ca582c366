"""Vector codes, filter audit and chat windows against brute force."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from churnkit.llm import chat_windows, filter_audit, vector_codes
from churnkit.llm.queries import op11_vector_codes, op12_filter_audit, op13_chat_windows

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ------------------------------------------------------------------- vector codes
def brute_codes(rows, parts, entries, rounds):
    kept = [(i, lab, v) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    if not kept:
        return [], []
    sizes = [len(v) for _, _, v in kept]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in kept if len(v) == dim]
    w = dim // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[2]))[:entries]
    books = [[r[2][p * w:(p + 1) * w] for r in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                x = v[p * w:(p + 1) * w]
                groups.setdefault(near(x, books[p])[1], []).append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, lab, v in kept:
        got = [near(v[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, lab, [e for _, e in got], min(sum(d for d, _ in got), (1 << 63) - 1)))
    return out, books


def vector_rows(scale):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(5, rows[7][1], 1), (5, rows[7][1], 1), (None, rows[3][1], None), (70, None, 1), (71, [], 1), (72, [1.0, None] * 4, 2),
             (73, [float("nan")] * 8, 2), (74, [float("inf")] * 8, 2), (75, [1.0] * 4, 2), (76, [1.0] * 7, 2), (-3, [0.0] * 8, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("scale", [0.5, 1e5, 1e30])     # one limb, several limbs, beyond int64
def test_codes_equal_brute_force(spark, scale):
    rows = vector_rows(scale)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {"v": F.lit("x"), "n": F.lit(1), "codes": F.lit(2), "error": F.lit("z")})
    got, books = vector_codes.vector_codes(docs.repartition(5), parts=2, entries=16, rounds=3)
    want, want_books = brute_codes(rows, 2, 16, 3)
    assert [[[int(x) for x in e] for e in b] for b in books] == want_books
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], str(r[1]))
    assert sorted([(r.vec_id, r.label, list(r.codes), r.error) for r in got.collect()], key=key) == sorted(want, key=key)
    total = {}
    for _, lab, _, e in want:
        total[lab] = min(total.get(lab, 0) + e, (1 << 63) - 1)
    assert {r.label: r.label_error for r in vector_codes.with_label_error(got).collect()} == total


def test_limb_products_are_exact():
    rng = np.random.default_rng(5)
    for bits in (10, 24, 25, 29):
        x, c = (rng.integers(-(1 << bits), 1 << bits, (40, 6)).astype(float) for _ in range(2))
        x[0] = c[0] = -(2.0 ** bits)
        want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in c] for u in x]
        assert vector_codes.exact_dots(x, c).tolist() == want
    assert vector_codes.nearest(np.array([[1.0, 1.0]]), np.array([[2.0, 1.0], [0.0, 1.0], [1.0, 2.0]]), True)[0].tolist() == [0]


def test_codes_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op11_vector_codes(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


# ------------------------------------------------------------------- filter audit
def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [x for x, u, _ in docs if (u or "") == t and x is not None]
        rows.append((s or "", d, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                                  "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                                  "E": d is not None and min(same) < d}))
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        table, removed_by = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                before = [r for r in mine if r not in left]
                left = [r for r in left if not r[2][f]]
                removed_by[f] += len(gone)
                table.append((order, step, f, len(left), len(gone), sum(r[2][f] for r in before),
                              sum(r[2][f] and sum(r[2].values()) == 1 for r in mine),
                              sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)))
        out |= {(part, o, s, *rest, removed_by[f]) for o, s, f, *rest in table}
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", long, long + " A B C D E F G H I J K L M N O P Q R S T U V W X Y Z" * 2, "x " * 300, "a|b", long + " #", "UPPER",
             long.replace("w1", "é "), " \t\x0b\x0c\r\n", "a b c", "語" * 50_000]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "s", "t"])) for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, b"x", "m") for d in docs], "doc_id long, text string, source string, n int, digest binary, mask string")
    got = filter_audit.filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == brute_audit(docs, [x for x in labels if x[0] is not None])
    # repeated ids and rows without one
    odd = [(1, "same", "s"), (1, "same", "s"), (None, "same", "s"), (None, "same", "t"), (2, "same", "t"), (2, "else", "t"), (0, "else", None)]
    got = filter_audit.filter_audit(spark.createDataFrame(odd, "doc_id long, text string, source string"),
                                    spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int"))
    first = {(r.part, r.removed) for r in got.where("filter_order like 'E%' and step = 1").collect()}
    assert first == {("s", 0), ("t", 2), ("", 0)}
    none = filter_audit.filter_audit(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


def test_removal_steps_and_efficiency(spark):
    orders, steps = filter_audit.removal_steps(3)
    for m in range(8):
        for o, order in enumerate(orders):
            failing = [k for k, f in enumerate(order, 1) if m >> f & 1]
            assert steps[m, o] == min(failing, default=filter_audit.NEVER)
    out = op12_filter_audit(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").groupBy(F.coalesce("source", F.lit("")).alias("part")).count()
    # every order removes and keeps the same documents in the end
    bad = out.groupBy("part", "filter_order").agg(F.sum("removed").alias("r"), F.min("kept").alias("k")).join(n, "part").where("r + k <> count")
    assert bad.count() == 0 and out.count() == 600 * n.count()


# ------------------------------------------------------------------- chat windows
def chat_rows():
    rng = random.Random(6)
    words = ["yes", "<|im_end|>", "<|im_start|>assistant\n", "<\\|im_end|>", "<\\\\|endoftext|>", "é語😀", "\n", "\\n", "<|im_", "ok", "<", "|>"]
    rows = []
    for c in range(12):
        start = [(c, 0, "system", "Be " + rng.choice(words))] if c % 3 else []
        for t in range(rng.randint(1, 40)):
            start.append((c, t + 1, ["user", "assistant"][t % 2], " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 6, 9, 50])))))
        rows += start
    rows += [(20, 0, "system", "alone"), (21, 0, "assistant", None), (22, None, "user", "late"), (22, 1, None, "no role"), (22, 1, "a\\n\nb", "x"),
             (None, 1, "assistant", "no id"), (None, 2, "user", ""), (23, 1, "assistant", "twice"), (23, 1, "assistant", "twice"),
             (24, 0, "system", "s"), (24, 1, "assistant", "long " * 3000), (24, 2, "system", "late system"), (24, 3, "assistant", "end")]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    return {c: sorted(v, key=lambda z: z[:2]) for c, v in out.items()}


def expected(turns):
    said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(chat_windows.render(r, x)[0]) for _, _, r, x in turns))


@pytest.fixture(scope="module")
def chats(spark):
    rows = [r for r in chat_rows() if r[0] != 22]      # ties go by hash; see the test of single rows
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"window": F.lit(1), "block": F.lit("b"), "loss": F.lit(2.0)}).repartition(7)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_windows_read_back(spark, chats, block):
    rows, frame = chats
    got = chat_windows.read_back(*chat_windows.conversation_blocks(frame, RANKS, 200, 60, block)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {c: expected(t) for c, t in in_order(rows).items()} and len(got) == len(in_order(rows))


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_windows_keep_budget_system_and_history(spark, chats, block):
    rows, frame = chats
    budget, history = 200, 60
    windows = {}
    for r in chat_windows.chat_windows(frame, RANKS, budget, history, block).collect():
        windows.setdefault(r.conv_id, []).append(r)
    repeated = split = 0
    for conv, turns in in_order(rows).items():
        turns = [(r, x) for _, _, r, x in turns]
        system = turns[0] if turns[0][0] == "system" else None
        at = 0
        for w in sorted(windows[conv], key=lambda w: w.window):
            said = chat_windows.read_turns(w.text)
            size = [chat_windows.n_tokens(chat_windows.render(*t)[0], RANKS) for t in said]
            assert w.n_tokens == sum(size) and w.over_budget == (sum(size) > budget)
            front, new = said[:w.n_repeated], said[w.n_repeated:]
            assert new == turns[at:at + w.n_new] and w.first_turn == at + 1
            old = front[1:] if system and at else front
            if system and at:
                assert front[0] == system
            assert old == turns[at - len(old):at] and sum(size[w.n_repeated - len(old):w.n_repeated]) <= history
            if w.over_budget:
                assert w.n_new - (system is not None and at == 0) == 1 and not old
            assert [chat_windows.unescape(w.text[s.start:s.end]) for s in w.loss] == [x for r, x in new if r == "assistant"]
            at += w.n_new
            repeated += len(old)
        assert at == len(turns)
        split += len(windows[conv]) > 1
    assert repeated > 20 and split > 5


def test_windows_fill_the_budget():
    got = list(chat_windows.choose_windows([10, 20, 30, 40, 5, 500, 7], 0, 100, 30, 8))
    assert got == [(0, 0, 3), (2, 3, 5), (5, 5, 6), (6, 6, 7)]
    for s in ("<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<<|endoftext|>", "a\\", ""):
        assert chat_windows.unescape(chat_windows.escape(s)) == s and "<|im" not in chat_windows.escape(s)
    assert chat_windows.read_turns(chat_windows.render("r\\n\n", "<|im_")[0]) == [("r\\n\n", "<|im_")]


def test_chat_edges(spark):
    rows = [r for r in chat_rows() if r[0] == 22]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (w,) = chat_windows.chat_windows(frame, RANKS).collect()
    turns = chat_windows.read_turns(w.text)
    assert turns[2] == ("user", "late") and sorted(turns[:2]) == [("", "no role"), ("a\\n\nb", "x")]
    blocks, several = chat_windows.conversation_blocks(frame.limit(0), RANKS)
    assert chat_windows.read_back(blocks, several).count() == 0
    out = {r.conv_id: r for r in op13_chat_windows(spark, SF).collect()}
    assert out[-1].n_turns == 2 and out[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")

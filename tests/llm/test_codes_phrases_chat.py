"""Product codes, phrase collocations and chat formatting against plain versions."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, codes, phrases, q_chat, q_codes, q_phrases

SF = "/root/testdata/sf0.001"


def plain_codes(rows, parts, entries, rounds):
    """Lloyd's rounds in plain loops over Python's integers."""
    vectors = [[int(np.floor(256 * float(np.float32(x)))) for x in v] for _, v, _ in sorted(rows, key=lambda r: r[0])]
    width = len(vectors[0]) // parts
    cut = [[v[q * width : (q + 1) * width] for q in range(parts)] for v in vectors]
    books = [[p[q] for p in cut[:entries]] for q in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(book))
    for turn in range(rounds + 1):
        found = [[near(p[q], books[q]) for q in range(parts)] for p in cut]
        if turn < rounds:
            for q in range(parts):
                for k in range(len(books[q])):
                    own = [p[q] for p, f in zip(cut, found, strict=True) if f[q][1] == k]
                    if own:
                        books[q][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


EMBEDDED = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("spread", [1.0, 1e8])
def test_codes_equal_plain_rounds(spark, monkeypatch, spread):
    monkeypatch.setattr(codes, "BLOCK", 37)
    r = random.Random(5)
    rows = [(k, [r.choice([0.0, 0.5, spread * r.gauss(0, 1)]) for _ in range(8)], r.choice([1, 2, None])) for k in range(300)]
    rows += [(300 + k, rows[k][1], 1) for k in range(40)]
    bad = [(900, None, 1), (901, [float("nan")] + [0.0] * 7, 1), (902, [float("inf")] + [0.0] * 7, 2), (903, [None] + [0.0] * 7, 2)]
    df = spark.createDataFrame(rows + bad, EMBEDDED).withColumn("code", F.lit("clash")).repartition(5)
    got, books = codes.compress(df, parts=4, entries=16, rounds=3)
    code, error, want = plain_codes(rows, 4, 16, 3)
    out = {x.vec_id: x for x in codes.with_label_errors(got.cache()).collect()}
    assert books == want and len(out) == len(rows)
    for (k, _, label), c, e in zip(rows, code, error, strict=True):
        total = sum(x for (_, _, own), x in zip(rows, error, strict=True) if own == label)
        assert (out[k].code, out[k].error, out[k].label_error) == (c, min(e, codes.MOST), min(total, codes.MOST))


def test_heaps_leave_most_parts_alone():
    """Far clusters: after the first round almost no part is compared again, and the result is exact."""
    r = np.random.default_rng(3)
    at = r.integers(-(10**6), 10**6, (8, 4))
    v = (at[r.integers(0, 8, 4000)] + r.integers(-50, 50, (4000, 4))).astype(np.int64)
    first = np.concatenate([at + 7, at[:1] + 90])[None]
    block = codes.Block(v, 1, 9)
    block.assign(first)
    moved = first + r.integers(-3, 3, first.shape)
    drift = codes.steps(first, moved) * (1 + codes.SLIP)
    scanned = block.settle(moved, drift)
    assert scanned < 1000 and (block.codes()[:, 0] == codes.nearest(v, moved[0])[0]).all()
    again = codes.Block.loaded(block.stored(), len(v), 1, 9)
    assert (again.codes() == block.codes()).all() and again.settle(moved, drift) < 1000


def test_codes_of_edge_tables(spark):
    got, books = codes.compress(spark.createDataFrame([(1, None, 2)], EMBEDDED))
    assert got.count() == 0 and books == [] and codes.codebooks_sha256([]) == hashlib.sha256(b"").hexdigest()
    got, books = codes.compress(spark.createDataFrame([(None, [1.0, 2.0], None), (5, [1.0, 2.0], 1), (5, [-1.0, 2.0], 1), (6, [1.0], 1)], EMBEDDED), parts=2)
    assert sorted((str(x.vec_id), x.code, x.error) for x in got.collect()) == [("5", "0000", 0), ("5", "0100", 0), ("None", "0100", 0)]
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 2)], EMBEDDED), parts=2)


def plain_counts(rows, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(c, "\n")
        for piece in t.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    return n, f


def plain_collocations(rows, least, top):
    n, f = plain_counts(rows)
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + m] for q, a in cand.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * a >= 100 * own[q[i : i + m]]}
        scored = []
        for p, a in cand.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def texts(r):
    words = ["Ab", "ab", "ba", "é", "İx", "a b", "w" * 50, "c", "日本", "\x00"]
    joins = [" ", "  ", "\t", ". ", ",", "\n", " ", " ", " \r ", " : "]
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice(joins) for _ in range(r.randrange(60)))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), (None, " \n "), ("und", "ab ba ab ba"), ("en", "ab ba c " * 900), ("en", "c" * 3000 + " ab " * 40 + "," + "d" * 2000 + " ba ba")] + [("de", "ab ba é c ab " * 5)] * 40


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_plain_counts(spark, monkeypatch, small):
    if small:  # many cuts within pieces, flushes, stripes, chunks of cells and of patterns
        for name, value in {"CUT": 90, "FLUSH": 50, "STRIPE": 64, "CELLS": 40, "PATTERN_BYTES": 400, "PHRASES": 20, "LONG_WORD": 70, "COUNTS": 3}.items():
            monkeypatch.setattr(phrases, name, value)
    rows = texts(random.Random(8))
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).repartition(3)
    got = phrases.collocations(df, least=12, top=30)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 12, 30)
    assert phrases.collocations(df.where("false")).count() == 0 and phrases.collocations(df, least=10**6).count() == 0


def test_cuts_keep_every_run_once():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a", "bb", "c" * 40, "é"]) + r.choice([" ", " ", "\t", "  ", ".", ""]) for _ in range(r.randrange(80))).encode()
        seen, n = Counter(), 0
        for part, lead in phrases.cuts(text, 3, 25):
            start, end, word = phrases.words_of(phrases.guarded(part))
            t = phrases.guarded(part)
            n += int((word != 0).sum()) - lead
            for k, at, _ in phrases.runs(word, "", lead, 3, 20):
                seen.update(t[start[i] : end[i + k - 1]] for i in at.tolist())
        total, f = plain_counts([("x", text.decode())], 3)
        assert n == total["x"] and seen == Counter({" ".join(p).encode(): a for p, a in f["x"].items() if len(p) > 1}), text


def test_the_sketch_is_an_upper_bound_and_tight(spark):
    rows = texts(random.Random(9))
    df = spark.createDataFrame([(a or "und", b) for a, b in rows], "lang string, text string")
    heavy = {r.cell for r in phrases.sketch(df, 24, 12, 5).collect()}
    assert len(heavy) < 2000
    want = {(lang, p) for lang, own in plain_counts(rows)[1].items() for p, a in own.items() if len(p) > 1 and a >= 12}
    found = {(r.lang, tuple(r.phrase.split(" "))) for r in phrases.phrases_in(df, np.array(sorted(heavy)), 24, 5).collect()}
    assert want <= found and len(found) <= len(want) + 3


def test_phrases_that_share_a_cell_are_all_found(spark, monkeypatch):
    """With four cells only, most phrases are not in the shard that has most of their cell."""
    monkeypatch.setattr(phrases, "runs", lambda *a, own=phrases.runs: ((k, at, cell & np.uint64(3)) for k, at, cell in own(*a)))
    rows = [("en", f"a{k} b{k} " * 6) for k in range(12) for _ in range(5 - k // 4)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6, "text")
    got = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in phrases.counted(df, least=20, longest=3).collect() if r.phrase}
    want = {("en", p): f for p, f in plain_counts(rows, 3)[1]["en"].items() if len(p) > 1 and f >= 20}
    assert {k: v for k, v in got.items() if len(k[1]) > 1 and v >= 20} == want


def test_chat_layouts_and_marks(spark):
    odd = ["<|im_end|>", "<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|", "<", "|>", "ends with <", "ends with <\\", "", "é日本\n\n", "\\n", "a\\\nb"]
    r = random.Random(2)
    who = lambda: r.choice(["user", "assistant", "system", "tool\nx", "a\\nb", "<|im_end|>", ""])
    lines = ['{"prompt": "p", "completion": null}', '{"prompt": "p", "completion": "c", "extra": 3}', '{"system": "s", "prompt": "p", "response": "c"}', '{"instruction": "i", "input": "x", "output": "o"}',
             '{"instruction": "i", "input": "", "output": "o"}', '{"question": "q", "answer": "a", "context": "c"}', '{"messages": [{"role": "user", "content": null}, {"role": "assistant", "content": "x"}]}',
             '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"messages": []}', '{"prompt": "p", "question": "q"}', "{}", "no json", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").select("k", F.from_json("line", chat.record_schema()).alias("r")).select("k", "r.*")
    out = {x.k: x for x in chat.read_back(chat.template(chat.canonical(df))).collect()}
    said = {k: None if x.turns is None else [tuple(t) for t in x.turns] for k, x in out.items()}
    assert said == {0: None, 1: [("user", "p"), ("assistant", "c")], 2: [("system", "s"), ("user", "p"), ("assistant", "c")], 3: [("user", "i\n\nx"), ("assistant", "o")], 4: [("user", "i"), ("assistant", "o")],
                    5: [("user", "c\n\nq"), ("assistant", "a")], 6: [("user", ""), ("assistant", "x")], 7: [("user", "h"), ("assistant", "g")], 8: [], 9: None, 10: None, 11: None, 12: None}
    assert [out[k].layout for k in range(13)] == [None, "completion", "response", "instruction", "instruction", "question", "messages", "conversations", "messages", None, None, None, None]
    assert len({out[k].fingerprint for k in (1, 2, 3, 5, 6, 7)}) == 6
    for k, x in out.items():
        assert x.turns_back == x.turns and (x.turns is None or x.learned == [t.text if t.role == "assistant" else "" for t in x.turns])
    rows = [(k, [(who(), r.choice(odd) + r.choice(odd)) for _ in range(r.randrange(1, 6))]) for k in range(200)]
    t = spark.createDataFrame(rows, f"k int, turns array<{chat.TURN}>")
    for x in chat.read_back(chat.template(t)).collect():
        assert x.turns_back == x.turns and x.learned == [y.text if y.role == "assistant" else "" for y in x.turns]
        assert x.formatted.count(chat.BEGIN) == x.formatted.count(chat.END) == len(x.turns)
        at, under = 0, []
        for m in x["mask"]:
            at += m.skip
            under.append(x.formatted[at : at + m.take])
            at += m.take
        assert [y for y in under if y] == [y for y in (chat_escaped(t.text) for t in x.turns if t.role == "assistant") if y]


def chat_escaped(s):
    import re

    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def test_conversations_to_records_and_back(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", "a"), (2, 2, "assistant", None), (3, 5, "user", "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"), (3, None, "tool", "z"),
            (5, 0, "user", "q"), (5, 1, "user", "w"), (4, 0, None, "n"), (None, 0, "user", "q"), (None, 1, "user", "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    out = {x.conv_id: x for x in chat.canonical(chat.records(df)).collect()}
    assert {k: x.layout for k, x in out.items()} == {1: "completion", 2: "instruction", 3: "messages", 4: "messages", 5: "conversations", None: "messages"}
    for k, x in out.items():
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == k))
        assert [tuple(t) for t in x.turns] == [y[1:] for y in own]
    assert chat.canonical(chat.records(df.where("false"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("part", [q_codes, q_phrases, q_chat])
def test_query_equals_sql(spark, part):
    from tests.test_entry import same

    for name, run in part.QUERIES.items():
        same(spark, name, run, part.SQL[name])

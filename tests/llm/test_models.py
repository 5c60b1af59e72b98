"""Pieces, graph search, similarity classes, toxicity, language model and pipeline against brute force."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import graph_search, jaccard, lm, pieces, q_lm, q_toxicity, quality, registry, toxicity
from quillon.llm.common import components

from .conftest import LONG, documents

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the tables")
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="needs the vocabulary")


@needs_model
def test_pieces_equal_the_library():
    import sentencepiece

    library, codec, r = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Codec(pieces.Model.load(pieces.MODEL)), random.Random(1)
    texts = ["".join(r.choice(["the", "a", " ", "  ", "é", "報", "ing", "\n", "\t", "1", "ℵ", "▁", "😀", "er", ".", " in", "x", "aaaa", "=="]) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["".join(r.choice("thinganderoflyes") for _ in range(5000)), "a" * 3000, "=" * 700 + "x" + "=" * 700, "ab " * 900 + "e" * 2500, LONG]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(t)
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist()) == t.replace("▁", " ")


@needs_model
def test_pieces_are_committed_as_paths_meet(monkeypatch):
    import sentencepiece

    library, codec = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Codec(pieces.Model.load(pieces.MODEL))
    held, committed = [], codec._committed
    monkeypatch.setattr(codec, "_committed", lambda rows, begin, start, end: held.append(len(rows)) or committed(rows, begin, start, end))
    text = " ".join(t for _, t, *_ in documents() if t)
    ids = codec.encode(text)
    assert ids == library.encode(text) and codec.commits > len(text) / codec.BLOCK / 2
    few = max(held)
    assert codec.encode(text * 4) == library.encode(text * 4) and max(held) == few <= 4 * codec.BLOCK  # however long the text
    monkeypatch.setattr(pieces.Codec, "KEPT", 500)  # steps are forgotten in between
    assert pieces.Codec(codec.model).encode(text[:30_000]) == library.encode(text[:30_000])


def test_unigram_scores_are_best():
    model = pieces.Model([("<unk>", 0, pieces.UNKNOWN), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.2, 1), ("ba", -2.0, 1), ("aba", -2.9, 1), ("▁", -1.0, 1), ("▁a", -1.4, 1)], pieces.UNIGRAM, byte_fallback=False)
    codec, r = pieces.Codec(model), random.Random(3)

    def best(t):
        score, cost = [0.0] + [-1e9] * len(t), model.unknown_score
        for i in range(1, len(t) + 1):
            score[i] = max([score[j] + model.scores[t[j:i]] for j in range(i) if t[j:i] in model.scores] + ([score[i - 1] + cost] if t[i - 1] not in model.scores else []))
        return score[-1]

    for _ in range(300):
        t = "".join(r.choice("ab c") for _ in range(r.randrange(1, 60)))
        ids = codec.encode(t)
        total = sum(model.unknown_score if k == 0 else model.pieces[k][1] for k in ids)
        assert abs(total - best(codec.normalised(t))) < 1e-6


@needs_model
def test_pieces_of_a_table(docs, nothing):
    out = pieces.encode(docs)
    back = {(r.doc_id, r.text): r.decoded for r in pieces.decode(out).collect()}
    assert all(b == (t or "") for (_, t), b in back.items()) and out.count() == docs.count()
    assert pieces.summary(docs).where("NOT round_trip").count() == 0 and pieces.encode(nothing).count() == 0


def brute_classes(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], min(least[find(i)]) if sets[i] and least[find(i)] else r[0] if not sets[i] else None, links[i]) for i, r in enumerate(rows)]


def near_rows(n=120):
    r, out = random.Random(9), []
    base = [" ".join(f"v{r.randrange(500)}" for _ in range(150)) for _ in range(4)]
    for k in range(n):
        w = base[k % 4].split()
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"u{r.randrange(999)}"
        out.append((1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_similarity_classes(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = [r[:2] for r in documents()] + near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # workers get the functions with the limits as they are now
    got = sorted(map(str, (tuple(r) for r in jaccard.join(df).collect())))
    assert got == sorted(map(str, brute_classes(rows)))


def test_empty_blocks_count_no_links_again(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 100)
    rows = near_rows()
    got = sorted(map(str, (tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, brute_classes(rows)))


def test_rows_without_id_meet_their_own_sets_only(spark, monkeypatch):
    rows = [(k if k > 1030 else None, t) for k, t in near_rows(40)]
    met, read = [], jaccard._with_sets
    monkeypatch.setattr(jaccard, "_with_sets", lambda x: met.append(x.count()) or read(x))
    got = sorted(map(str, (tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, brute_classes(rows)))
    assert met[0] <= len(rows)


def test_one_of_each(spark, docs, nothing):
    kept = jaccard.one_of_each(docs).collect()
    rows = documents()
    classes = brute_classes(rows)
    wordless = sum(not (r[1] or "").split() for r in rows)
    want = len({c for (_, c, _), r in zip(classes, rows, strict=True) if (r[1] or "").split()})
    assert len(kept) == wordless + want and jaccard.one_of_each(nothing).count() == 0 and jaccard.join(nothing).count() == 0
    assert [r for r in kept if r.doc_id == 36] == []


def test_pruning_keeps_true_pairs():
    assert jaccard.least_matches(16, 0.8, 1e-9) >= 1 and jaccard.least_matches(128, 0.8, 1e-9) > 60
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([a[: 400 - k], r.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (0, 20, 44)]
    sig = np.array([jaccard.signature(s) for s in sets])
    i, j = jaccard.surviving(sig, sig, same=True)
    assert (0, 1) in set(zip(i.tolist(), j.tolist(), strict=True)) and (0, 2) in set(zip(i.tolist(), j.tolist(), strict=True))
    many = np.arange(64), np.arange(64)[::-1]
    assert (jaccard.overlaps([sets[0]] * 64, [sets[1]] * 64, np.repeat(many[0], 40), np.resize(many[1], 2560)) == len(np.intersect1d(sets[0], sets[1]))).all()


def test_components(spark):
    r, n = random.Random(2), 60
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.id: x.root for x in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_graph_search(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 16))
    x[300:420] = x[7]  # many copies of one vector
    rows = [(k, [float(v) for v in x[k]]) for k in range(900)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, []), (None, rows[3][1]), (2080, [1.0] * 3), (2100, [None] + [1.0] * 15), (40, rows[40][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for q in graph_search.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        out[q.query_id].append((q["rank"], q.vec_id, q.score))
    assert set(out) == set(range(0, 900, 20))  # the one vector of three components has no company
    hits = total = 0
    for q, found in out.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(s, 12)))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hits += len(set(want.tolist()) & {f[1] for f in found})
        total += 20
    assert hits / total > 0.95
    assert [v for _, v, _ in out[300]] == [7, *range(301, 320)]  # ties go to the smaller id
    assert graph_search.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert graph_search.nearest(few, F.col("vec_id") == 0).count() == 4


def test_graph_search_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARD_ROWS", 150)
    monkeypatch.setattr(graph_search, "QUERY_BLOCK", 20)
    x = np.random.default_rng(4).standard_normal((900, 16))
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(900)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for q in graph_search.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        found[q.query_id].append(q.vec_id)
    want = {}
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want[q] = set(np.argsort(-s)[:20].tolist())
    assert set(found) == set(want) and all(len(v) == len(set(v)) == 20 for v in found.values())
    assert sum(len(want[q] & set(found[q])) for q in want) > 0.95 * 20 * len(want)


@pytest.mark.parametrize("rows_per_shard", [8192, 100])
@pytest.mark.parametrize("lengths", ["log-normal", 1e3, 1e200, 1e-200])
def test_graph_search_with_any_lengths(spark, monkeypatch, lengths, rows_per_shard):
    monkeypatch.setattr(graph_search, "SHARD_ROWS", rows_per_shard)
    r = np.random.default_rng(5)
    n = 600
    x = r.standard_normal((n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "log-normal":
        x *= np.exp(1.5 * r.standard_normal((n, 1)))
    else:
        x[[33, 401]] *= lengths
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(n)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for q in graph_search.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        found[q.query_id].append(q.vec_id)
    hits = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(found[q]))
    assert hits >= 0.95 * n


def test_matcher_is_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    words = ["idiot", "moron", "worthless", "scum", "disgusting"]
    lexicon, r = toxicity.Lexicon(dict.fromkeys([*words, "lowei*", "*pfach"], 3.0)), random.Random(4)
    for _ in range(4000):
        w = list(r.choice([*words, "loweich", "enpfach", "theror"]))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "e", "s", "x"])
        w = "".join(w)
        cost = {e: distance(w, e) for e in words if distance(w, e) <= toxicity.edits(e)}
        cost |= {"lowei*": 0} if w.startswith("lowei") else {}
        cost |= {"*pfach": 0} if w.endswith("pfach") else {}
        got = lexicon.match(w)
        assert (got is None) == (not cost) and (not cost or got[1] == min(cost.values())), (w, got, cost)


def test_toxicity(spark, docs, nothing):
    r, rows, labels = random.Random(6), [], []
    for k in range(600):
        words = [f"w{r.randrange(300)}" for _ in range(40)]
        bad = k % 5 == 0
        if bad:
            words[r.randrange(40)] = r.choice(["scumbag", "dimwit"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    lexicon, weights = toxicity.train_model(df, lab)
    assert {"scumbag", "dimwit"} <= set(lexicon)
    new = spark.createDataFrame([(1, "you are a scumbagg and more"), (2, 'he said "scumbag" of them'), (3, "w1 w2 w3"), (4, None), (5, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score(new, lexicon, weights).collect()}
    assert got[1].score > got[3].score and got[2].score < got[1].score and got[4].score == got[5].score == got[3].score
    assert toxicity.score(docs, lexicon, weights).count() == docs.count() and toxicity.score(nothing, lexicon, weights).count() == 0
    assert toxicity.train_model(df, lab.where("false"))[0] == {}


def test_misspellings_of_a_word_whose_part_was_learned_first(spark):
    r, rows = random.Random(8), []
    for k in range(600):
        words = [f"w{r.randrange(300)}" for _ in range(40)]
        if k % 3 == 0:
            words[r.randrange(40)] = "idiotic" if k % 18 == 0 else "idiot"
        rows.append((" ".join(words), int(k % 3 == 0)))
    entries = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    lexicon = toxicity.Lexicon(entries)
    assert any("*" in e and lexicon.match("idiotic") for e in entries)
    for word in ("idjot", "idot", "iidiot", "idiotik", "idjotic"):
        assert lexicon.match(word), (word, entries)


@needs_tables
def test_toxicity_held_out(spark):
    sf = TABLES.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    x = q_toxicity.op7_lexicon_automata(spark, sf).join(labels, "doc_id").where("held_out")
    assert x.where("predicted = toxic").count() / x.count() > 0.93


@needs_tables
def test_language_model(spark, nothing, docs):
    got = {r.doc_id: r for r in q_lm.op1_recurrent_lm(spark, TABLES).collect()}
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = {r.doc_id: [*(r.text or "").encode().translate(table).split(), None] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    c = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(k).encode()) % 7 == 2)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(docs.select("doc_id", "text", "score"), F.col("doc_id") > 5).count() == docs.count()
    assert lm.score(nothing, F.lit(True)).count() == 0 and lm.score(docs, F.lit(False)).count() == docs.count()


def test_head_is_full_among_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    equal = spark.range(600).select(F.concat(F.lit("w"), F.lpad("id", 3, "0")).alias("word"), F.lit(7).cast("long").alias("n"))
    more = spark.createDataFrame([("often", 900), ("w900", 8)], "word string, n long")
    assert [w.decode() for w in lm.vocabulary(equal.union(more), 10).index] == ["often", "w900", *[f"w{k:03d}" for k in range(48)]]
    assert [w.decode() for w in lm.vocabulary(more, 10).index] == ["often", "w900"] and not lm.vocabulary(more.where("false"), 0).index


def test_every_document_trains_and_copies_spread(spark, monkeypatch):
    rows = [(str(k), "one text that stands here many times") for k in range(60)] + [("x", "the same row again")] * 40 + [(None, f"word{k} and word{k + 1}") for k in range(60)]
    df, written, write = spark.createDataFrame(rows, "key string, text string"), {}, lm.durable
    monkeypatch.setattr(lm, "durable", lambda x, name: written.setdefault(name, write(x, name)))
    v = lm.vocabulary(lm.count_words(df), len(rows))
    placed = lm._placed(df.select(F.xxhash64("key", "text").alias("h"), "text"), v, "text")
    got = lm._dealt(placed.select("h", F.col("_places").alias("places")), lm.ROUNDS, 3).collect()
    places = Counter(lm._places(lm.words_of(t), v)[1].astype(np.uint16).tobytes() for _, t in rows)
    assert Counter(bytes(r.places) for r in got) == places
    for text in (rows[0][1], rows[60][1]):
        own = lm._places(lm.words_of(text), v)[1].astype(np.uint16).tobytes()
        assert len({(r.round, r.grp) for r in got if bytes(r.places) == own}) == 3 * lm.ROUNDS


def test_scores_do_not_depend_on_partitions_and_equal_a_plain_pass(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 2000)  # several groups and, with FAN, two levels of averages
    monkeypatch.setattr(lm, "FAN", 2)
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["the", "of", "and", f"w{r.randrange(60)}", f"Z{r.randrange(3000)}."]) for _ in range(r.randrange(90)))) for k in range(400)] + [(900, None), (901, LONG)] + [(1007, "same")] * 30
    df, kept, train = spark.createDataFrame(rows, "doc_id long, text string"), [], lm.train
    monkeypatch.setattr(lm, "train", lambda docs, v: kept.append((v, train(docs, v))) or kept[-1][1])
    some = [sorted((x.doc_id, x.n_tokens, x.score) for x in lm.score(df.repartition(n, "text") if n > 1 else df.coalesce(1), F.col("doc_id") % 7 != 2).collect()) for n in (1, 5)]
    for a, b in zip(*some, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * a[1]
    v, p = kept[0]
    counts = Counter(w for k, t in rows if k % 7 != 2 for w in lm.words_of(t))
    inside, sigmoid = list(v.index)[: v.own], lambda z: 1 / (1 + np.exp(-z))
    shape = lambda w: 1 + lm.shape_of(w)
    totals, singles = Counter(), Counter()
    for w, n in counts.items():
        if w not in inside:
            totals[shape(w)] += n
            singles[shape(w)] += n == 1
    p = {k: x.astype(np.float64) for k, x in p.items()}
    want = {}
    for k, t in rows[:60] + [(900, None)]:
        h, before, total = np.zeros(lm.HIDDEN), v.place[0], 0.0
        for w in [*lm.words_of(t), None]:
            g, u = p["emb"][before] @ p["wx"] + p["b"], h @ p["wh"]
            n = lm.HIDDEN
            z, q = sigmoid(g[:n] + u[:n]), sigmoid(g[n : 2 * n] + u[n : 2 * n])
            h = (1 - z) * np.tanh(g[2 * n :] + q * u[2 * n :]) + z * h
            i = 0 if w is None else 1 + lm.N_SHAPES + inside.index(w) if w in inside else shape(w)
            before = v.place[i]
            group, word = h @ p["wc"] + p["bc"], h @ p["ww"][before // lm.SLOTS] + p["bw"][before // lm.SLOTS]
            total += group[before // lm.SLOTS] - np.logaddexp.reduce(group) + word[before % lm.SLOTS] - np.logaddexp.reduce(word)
            if 0 < i <= lm.N_SHAPES:
                total += math.log((counts[w] or singles[i] + 1) / (totals[i] + singles[i] + 1))
        want[k] = total / math.log(10)
    for k, n, x in some[0]:
        assert k not in want or abs(x - want[k]) < 1e-4 * n, k


def test_windows_carry_state_and_gradients_are_right():
    r = np.random.default_rng(1)
    v = lm.Vocabulary([("a", 50), ("b", 30), ("c", 5)], 10, 95, 4).with_shapes(np.zeros(lm.N_SHAPES), np.zeros(lm.N_SHAPES))
    p = lm.initial(v.freq)
    used = v.place
    texts = [np.append(r.choice(used[1:], n), v.place[0]) for n in (0, 3, 70, 200)]
    whole = lm.score_docs(p, texts)
    one = [float(lm.score_docs(p, [t])[0]) for t in texts]
    assert np.allclose(whole, one, rtol=1e-4)  # the same however texts are laid out
    wide, lm.SCORE_WINDOW = lm.SCORE_WINDOW, 5  # and however they are cut into windows
    assert np.allclose(lm.score_docs(p, texts), whole, rtol=1e-4)
    lm.SCORE_WINDOW = wide
    h = np.zeros((1, lm.HIDDEN), np.float32)
    states, _, _ = lm.run_window(p, np.array([[used[0]]]), np.array([[True]]), h)
    everything, _ = lm.output(p, np.repeat(states[0], lm.CLASSES * lm.SLOTS, 0), np.arange(lm.CLASSES * lm.SLOTS))
    assert abs(np.exp(everything).sum() - 1) < 1e-4
    x, y, valid, fresh = next(lm.laid_out([np.concatenate(texts[2:]), np.concatenate(texts[:2])], [np.array([0, len(texts[2])]), np.array([0, len(texts[0])])], int(v.place[0]), 12))
    p = {k: a.astype(np.float64) for k, a in p.items()}
    grad, _ = lm.train_window(p, x, y, valid, fresh, np.zeros((x.shape[1], lm.HIDDEN)))

    def loss():
        st, _, _ = lm.run_window(p, x, fresh, np.zeros((x.shape[1], lm.HIDDEN)))
        f = valid.ravel()
        return -lm.output(p, st.reshape(-1, lm.HIDDEN)[f], y.ravel()[f])[0].mean()  # states of places that are not valid count nothing

    for k in ("wh", "wx", "emb", "wc", "ww", "b"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        eps, old = 1e-3, p[k][at]
        p[k][at] = old + eps
        up = loss()
        p[k][at] = old - eps
        down = loss()
        p[k][at] = old
        assert abs((up - down) / (2 * eps) - grad[k][at]) < 0.02 * abs(grad[k][at]) + 1e-5, k
    before = lm.score_docs(lm.initial(v.freq), texts).sum()
    trained = lm.fit(lm.initial(v.freq), texts * 20, int(v.place[0]))
    assert lm.score_docs(trained, texts).sum() > before


@needs_tables
def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, TABLES)
    raw = spark.read.parquet(f"{TABLES}/documents.parquet")
    stage1 = corpus_pipeline.quality_rules(spark, raw, TABLES)
    assert stage1.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in stage1.collect()}
    rows = [(r.doc_id, r.text) for r in raw.collect() if r.doc_id in kept]
    want = {c for _, c, _ in brute_classes(rows)}
    stage2 = corpus_pipeline.near_duplicates(spark, stage1, TABLES)
    assert {r.doc_id for r in stage2.collect()} == want
    got = out.collect()
    assert {r.doc_id for r in got} <= want and all(r.ids for r in got) and all(r.n_chars == len(r.text) for r in got)


@needs_model
def test_pipeline_stages_on_edge_rows(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = docs.select(*corpus_pipeline.COLUMNS)
    rows = sorted(map(tuple, plain.collect()), key=str)
    by = {name: stage(spark, plain, TABLES) for name, stage in corpus_pipeline.STAGES}
    out = {name: sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str) for name, df in by.items()}
    judged = sorted((tuple(r)[:5] for r in quality.judge(plain).select(*corpus_pipeline.COLUMNS, "kept").collect() if r.kept), key=str)
    assert out["quality rules"] == judged and len(judged) < len(rows)
    classes = brute_classes([r[:2] for r in rows])
    wordless = [r for r in rows if not (r[1] or "").split()]
    assert len(out["near duplicates"]) == len(wordless) + len({c for (_, c, _), r in zip(classes, rows, strict=True) if (r[1] or "").split()})
    assert Counter(out["near duplicates"]) <= Counter(rows)
    # no personal data here: texts stay, null becomes empty
    assert Counter((r[0], r[1], r[4]) for r in out["personal data"]) == Counter((r[0], r[1] or "", len(r[1] or "")) for r in rows)
    assert set(out["source mixture"]) <= set(rows)
    assert all(list(r.ids) == library.encode(r.text or "") for r in by["token ids"].collect()) and out["token ids"] == rows
    for name, df in by.items():
        assert df.columns[:5] == corpus_pipeline.COLUMNS and (name == "token ids") == ("ids" in df.columns)


@needs_tables
def test_queries_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, TABLES).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        rows = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))  # noqa: B023, E731
        assert rows(got) == rows(want), name


def test_training_takes_no_fresh_pages_for_each_window():
    """What a window's arrays gave back serves the next one."""
    import resource

    v = lm.Vocabulary([(f"w{k}", 900 - k) for k in range(900)], 100, 500_000, 901).with_shapes(np.zeros(lm.N_SHAPES), np.zeros(lm.N_SHAPES))
    texts = [np.append(v.place[1 + lm.N_SHAPES + np.random.default_rng(k).integers(0, 900, 1999)], v.place[0]) for k in range(120)]
    lm.fit(lm.initial(v.freq), texts, int(v.place[0]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    lm.fit(lm.initial(v.freq), texts, int(v.place[0]))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / (240_000 / (lm.LANES * lm.WINDOW)) < 400


def test_words_of_many_texts_at_once(spark):
    """Words, shapes and what is counted from them, as the plain helpers have them one by one."""
    texts = ["", None, "  The\tCAT sat.\x0b", "É été ÉTÉ\u00a0x 7 a7 x- Z ~", "\n", "one*", LONG[:5000], "a\x1cb\x85c 中 文. ,"] * 3
    words, sizes = lm.split(pa.array(texts)[1:])
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts[1:] for w in lm.words_of(t)] and sizes.tolist() == [len(lm.words_of(t)) for t in texts[1:]]
    shapes = [lm.shape_of(w.encode()) for w in words.to_pylist()]
    assert lm.shapes_of(words).tolist() == shapes and lm.shapes_of(words[5:]).tolist() == shapes[5:] and not len(lm.shapes_of(words[:0]))
    df = spark.createDataFrame([(w,) for w in words.to_pylist()], "word string")
    assert {(r.word, r.k) for r in df.select("word", lm.shape_column(F.col("word")).alias("k")).collect()} == set(zip(words.to_pylist(), shapes, strict=True))
    counts = {r.word: r.n for r in lm.count_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert counts == Counter(w.decode() for t in texts for w in lm.words_of(t))


def test_few_long_lanes_take_few_windows_and_rare_classes_few_products(monkeypatch):
    """A long text beside short ones, and classes of a few rows, took a pass of small arrays each."""
    r = np.random.default_rng(3)
    p = lm.initial(1.0 + np.arange(lm.CLASSES * lm.SLOTS)[::-1])
    docs = [np.append(r.integers(1, 4096, n), 0) for n in (9000, *[150] * 300)]
    taken, run = [], lm.run_window
    monkeypatch.setattr(lm, "run_window", lambda p, x, *more: taken.append(x.shape) or run(p, x, *more))
    got = lm.score_docs(p, docs)
    assert len(taken) < 9001 / lm.SCORE_WINDOW / 4 and all(steps * lanes <= lm.SCORE_LANES * lm.SCORE_WINDOW for steps, lanes in taken)
    monkeypatch.undo()
    assert np.allclose(got[:3], [lm.score_docs(p, [d])[0] for d in docs[:3]], rtol=1e-5)
    h, y = np.tanh(r.standard_normal((900, lm.HIDDEN))).astype(np.float32), np.sort(r.integers(0, 4096, 900))
    sizes = np.bincount(y // lm.SLOTS, minlength=lm.CLASSES)
    groups = lm._alike(sizes)
    assert len(groups) < 6 and sorted(np.concatenate(groups)) == np.flatnonzero(sizes).tolist()
    some, single = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    together = lm.output(p, h, y, some)
    monkeypatch.setattr(lm, "FEW", 0)
    alone = lm.output(p, h, y, single)
    assert np.allclose(together[0], alone[0], atol=1e-5) and np.allclose(together[1], alone[1], atol=1e-7)
    assert all(np.allclose(some[k], single[k], atol=1e-7) for k in p)

"""Rules, shards, mixture, personal data and revisits against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, pii, quality, revisits, sharding

from .conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(three)
    covered = {i + k for i, t in enumerate(three) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality(docs, nothing):
    out = quality.judge(docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "odd name").collect()
    assert len(out) == docs.count()
    for r in out:
        assert tuple(r)[2:8] == base(r.text)
        assert not (r.base_failed and r.kept)
    assert quality.judge(nothing).count() == 0


def test_quality_references_count_plain_words(spark, monkeypatch):
    """No structure is made for each word; the lists of documents alike are all summed."""
    seen = []
    monkeypatch.setattr(quality, "durable", lambda df, name: seen.append(df) or df)
    rows = [("the cat 12 the", "en")] * 3 + [("Été, the", "en"), (None, "en"), ("el 7", None)]
    got = {r["_lang"]: r for r in quality.references(quality.with_words(spark.createDataFrame(rows, "text string, lang string"))).collect()}
    en = got["en"]
    assert (en.ref_n, en.common, got[""].ref_n, got[""].common) == (14, ["the", "cat"], 2, ["el"])
    assert en.ref_words == pytest.approx([7 / 14, 3 / 14, 4 / 14])
    # upper, digit, symbol, mark, wide, blank, rest of 3 * 14 + 8 characters
    assert en.ref_chars == pytest.approx([k / 50 for k in (0, 6, 0, 1, 2, 10, 31)])
    assert "inline(" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_quality_rejects_other_language_and_case(spark):
    plain = " ".join("the cat and the dog ran to the sea in the sun but".split()[k % 12] + ("x" * (k % 3) if k % 7 == 0 else "") for k in range(300))
    rows = [(k, " ".join(plain.split()[k:] + plain.split()[:k]) + f" number {k}", "en") for k in range(20)]
    rows += [(100, plain.upper(), "en"), (101, " ".join(f"zq{k}#$" for k in range(200)), "en")]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("NOT base_failed AND kept").collect()}
    assert 100 not in kept and 101 not in kept


def test_sharding(docs, nothing):
    out = sharding.shard_by_bytes(docs.where("doc_id IS NULL OR doc_id <> 33"), 4).collect()
    assert len(out) == docs.count() - 1
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        assert r["_size"] == len((r.text or "").encode()) + 1
        sizes[r.shard] += r["_size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r["_size"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest + 2
    assert sharding.shard_by_bytes(nothing, 4).count() == 0


def test_sharding_splits_one_hot_text(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), "id")).otherwise("the same text").alias("text"))
    sizes = [r.s for r in sharding.shard_by_bytes(df, 8).groupBy("shard").agg(F.sum("_size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 30


@pytest.mark.parametrize("shards", [2, 8])
def test_sharding_splits_rows_of_one_key(spark, shards):
    # half the rows have no id and one text, a sixth one id and one text
    i = F.col("id")
    df = spark.range(6000).select(F.when(i % 2 == 0, None).when(i % 6 == 1, 7).otherwise(i).alias("doc_id"), F.when(i % 2 == 0, "one text").when(i % 6 == 1, "another").otherwise(F.concat(F.lit("text number "), i)).alias("text"), i.alias("_run"))
    out = sharding.shard_by_bytes(df, shards).collect()
    assert len(out) == 6000 and sorted(r["_run"] for r in out) == list(range(6000))
    # against plain sums over the rows in order of their keys
    rows = sorted(out, key=lambda r: (r["_k1"], r["_k2"]))
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    total, below, largest = sum(r["_size"] for r in rows), 0, max(r["_size"] for r in rows)
    before = {}
    for r in rows:
        before.setdefault(r.shard, below)
        below += r["_size"]
    assert set(before) == set(range(shards))
    for j in range(1, shards):
        assert abs(before[j] - total * j / shards) <= sharding.TOLERANCE * total / shards + largest
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_mixing(spark, docs, nothing):
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    out = mixing.mix(docs, size, total=40_000.0)
    again = mixing.mix(docs.repartition(3), size, total=40_000.0)
    key = lambda df: sorted((str(r.doc_id), r.copy, r.mix_key) for r in df.select("doc_id", "copy", "mix_key").collect())
    assert key(out) == key(again) and "odd name" in out.columns
    per = Counter((str(r.doc_id), r.text) for r in out.collect())
    assert set(k for k, _ in per) <= {str(r[0]) for r in documents()}
    assert mixing.mix(nothing, size).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "small").otherwise("large").alias("source"), F.lit(1).cast("long").alias("n"))
    counts = mixing.mix(many, F.col("n"), weights={"small": 1.0, "large": 1.0}, total=80_000.0)
    by = {r.source: (r.n, r.d) for r in counts.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()}
    assert abs(by["small"][0] - 40_000) < 800 and abs(by["large"][0] - 40_000) < 800  # mean 40: drawn in two parts
    zero = 19_000 - by["large"][1]
    assert abs(zero - 19_000 * 2.718281828 ** (-40 / 19)) < 250
    var = counts.where("source = 'small'").groupBy("doc_id").count().agg(F.var_samp("count"), F.avg("count")).first()
    assert 0.8 < var[0] / var[1] < 1.2
    assert mixing.mix(many, F.col("n"), weights={"large": 1.0}).where("source = 'small'").count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if luhn(m[0])]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_patterns():
    import random

    r = random.Random(2)
    for _ in range(30_000):
        t = "".join(r.choice(["a", "b.c", "@", ".", " ", "-", "+1", "(2", ")", "4111111111111111", "7", "99", "255", "256", "é"]) for _ in range(r.randrange(25)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("0001.2.3.4 " + "9" * 5000 + ".1.1.1")[0] == (1, 0, 10)


def test_personal_data(spark, docs, nothing):
    filler = "nothing to see here at all today my friends of the house "
    rows = [(k, filler * 2 + f"call Ragnhild about jo{k % 2}@mail.example now, or 192.168.1.{k} {k}") for k in range(6)] + [(k, filler + f"plain text number {k}") for k in range(10, 60)]
    rows += [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(df).collect()}
    for k, t in rows:
        spans = plain_spans(t or "")
        flat = ",".join(f"{pii.KINDS[a]}:{b}:{c}" for a, b, c in spans)
        assert [out[k].n_email, out[k].n_ip, out[k].n_card, out[k].n_phone] == [sum(s[0] == x for s in spans) for x in range(4)]
        assert out[k].base_sha256 == hashlib.sha256(flat.encode()).hexdigest() and out[k].spans.startswith(flat)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "[IP]" in clean[0] and clean[99] == "" and clean[10] == rows[6][1]
    assert pii.find(docs).count() == docs.count() and pii.find(nothing).count() == 0
    assert pii.sanitise(docs.select("doc_id", "text", "lang")).count() == docs.count()


def test_disclosing_terms_and_the_way_without_broadcast(spark, monkeypatch):
    filler = ["alpha beta gamma delta", "epsilon zeta eta theta", "iota kappa lambda mu"]
    rows = [(k, f"{filler[k % 3]} {k} says Ragnhild uses jo@mail.example every day") for k in range(8)] + [(k, f"{filler[k % 3]} {k} says nothing every day") for k in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.term for r in pii.disclosing_terms(df).collect()}
    assert "ragnhild" in found and not found & {"says", "every", "alpha", "day"}
    some = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[TERM]" in some[0] and "Ragnhild" not in some[0] and some[10] == rows[8][1]
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()} == some


def test_disclosing_terms_by_brute_force(spark):
    import math
    import random

    r = random.Random(7)
    names = ["anna", "bert", "carl", "dora"]
    rows = []
    for k in range(400):
        words = [f"w{r.randrange(40)}x" for _ in range(30)]
        if k % 3 == 0:
            who = r.randrange(4)
            i = r.randrange(29)
            words[i : i + 2] = [f"{names[who]}@mail.example", names[who] if who < 3 or r.random() < 0.5 else r.choice(names)]
        rows.append((k, " ".join(words)))
    rows += rows[:30] + [(None, None), (7, "")]
    texts, both, alone, entities, holds = [t or "" for _, t in rows], defaultdict(int), defaultdict(set), defaultdict(int), Counter()
    for t in texts:
        holds.update(set(t.split()))
        words, spans = [(m[0], *m.span()) for m in WORD.finditer(t) if "@" not in m[0] and len(m[0]) >= 3], plain_spans(t)
        for e in {t[a:b] for _, a, b in spans}:
            entities[e] += 1
            close = set()
            for _, a, b in spans:
                if t[a:b] == e:
                    i = sum(w[1] < a for w in words)
                    close |= {w[0] for w in words[max(0, i - pii.WINDOW) : i + pii.WINDOW]}
            for w in close:
                both[e, w] += 1
                alone[e, w].add(t)
    n = len(texts)
    want = {w for (e, w), k in both.items() if len(alone[e, w]) >= pii.MIN_TEXTS and math.log(k * n / (entities[e] * holds[w])) >= pii.DISCLOSURE * math.log(n / entities[e])}
    got = {x.term for x in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and got


def test_many_spans_in_one_text_take_time_in_proportion():
    import time

    text = " ".join(f"user{k}@mail{k}.example word{k}" for k in range(40_000))
    began = time.process_time()
    spans = pii.base_spans(text)
    assert len(spans) == 40_000 and len(pii.near(text, spans)) == 40_000
    assert time.process_time() - began < 20


def test_disclosing_terms_stand_without_their_entity(spark, monkeypatch):
    rows = [(k, f"number {k} says Ragnhild uses jo@mail.example every day") for k in range(8)] + [(k, f"number {k} says nothing every day") for k in range(10, 200)]
    rows += [(300, "yesterday Ragnhild was here"), (301, "yesterday nobody was here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
        assert out[300] == "yesterday [TERM] was here" and out[301] == rows[-1][1]
        assert {r.doc_id: r.spans for r in pii.find(df).collect()}[300] == "term:10:18"
        monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)


RECORDS = "record_id long, kind string, url string, at long, headers array<struct<name:string,value:string>>, digest string, payload string"


def brute_revisits(rows, canon):
    out = {}
    for r in rows:
        if r[1] != "revisit":
            continue
        seen = [x for x in rows if x[1] == "response" and r[2] and r[3] is not None and x[3] is not None and canon.get(x[2]) == canon[r[2]] and x[3] < r[3]]
        out[r[0]] = max(seen, key=lambda x: (x[3], x[0]))[0] if seen else None
    return out


def test_revisits(spark, monkeypatch):
    import random

    r = random.Random(4)
    urls = ["http://www.A.example:80/x?b=2&a=1&utm_source=q#f", "https://a.example/x?a=1&b=2", "HTTP://A.EXAMPLE/x?a=1&b=2", "http://b.example", "http://b.example/", "not a url", None]
    rows = [(k, r.choice(["response", "revisit", "revisit"]), r.choice(urls), r.choice([None, *range(40)]), [("ETag", f'"{r.choice("ab")}"'), ("Content-Length", "5")], f"d{k}", f"p{k}") for k in range(300)]
    df = spark.createDataFrame(rows, RECORDS)
    canon = {x.url: x.c for x in df.select("url", revisits.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    assert len({canon[u] for u in urls[:3]}) == 1 and canon[urls[3]] == canon[urls[4]] == "b.example/" and canon[None] is None
    want = brute_revisits(rows, canon)
    tags = {x[0]: dict(x[4])["ETag"] for x in rows}
    for span in (50_000, 20):
        monkeypatch.setattr(revisits, "SPAN_ROWS", span)
        got = {x.record_id: x for x in revisits.resolve(df).collect()}
        assert {k: v.response_id for k, v in got.items()} == want
    for k, v in got.items():
        assert v.outcome == ("no_response" if want[k] is None else "merged" if tags[k] == tags[want[k]] else "changed")
        if v.outcome == "merged":
            assert v.digest == f"d{want[k]}" and {h.name.lower() for h in v.headers} == {"etag", "content-length"}
    full = {x.record_id: x.payload for x in revisits.attach_payload(revisits.resolve(df), df).collect()}
    assert all(full[k] == (f"p{want[k]}" if v.outcome == "merged" else None) for k, v in got.items())
    assert revisits.resolve(df.where("false")).count() == 0


def test_a_hot_url_with_outlying_times_splits_evenly(spark, monkeypatch):
    monkeypatch.setattr(revisits, "SPAN_ROWS", 100)
    written, write = {}, revisits.durable
    monkeypatch.setattr(revisits, "durable", lambda df, name: written.setdefault(name, write(df, name)))
    at = [0, 10**12, *range(5_000_000, 5_002_000)]
    known = spark.createDataFrame([("k", t, t) for t in at[::2]], "key string, at long, r long")
    asked = spark.createDataFrame([("k", t) for t in at[1::2]], "key string, at long")
    got = {x["at"]: x.r for x in revisits.latest_before(asked, known).collect()}
    assert got == {t: max((u for u in at[::2] if u < t), default=None) for t in at[1::2]}
    cuts = sorted(set(written["asof-cuts"].first().cuts))
    assert len(cuts) > 15 and max(sum(a < t <= b for t in at) for a, b in zip([-1, *cuts], [*cuts, 10**13], strict=True)) < 250


def test_header_merge(spark):
    h = lambda **k: [(a.replace("_", "-"), b) for a, b in k.items()]
    rows = [(1, "response", "http://x/", 1, h(ETag='"a"', Date="1", Content_Length="9"), "d", "p"), (2, "revisit", "http://x/", 2, h(etag='W/"a"', DATE="2", content_length="0", x_new="n"), None, None),
            (3, "revisit", "http://x/", 3, [], None, None), (4, "revisit", "http://x/", 4, None, None, None)]
    out = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert {(x.name.lower(), x.value) for x in out[2].headers} == {("etag", 'W/"a"'), ("date", "2"), ("content-length", "9"), ("x-new", "n")}
    assert out[3].outcome == out[4].outcome == "unverified"


def test_checksums_of_ids():
    assert zlib.crc32(b"12") % 7 == int(zlib.crc32("12".encode())) % 7


@pytest.mark.parametrize("n", [0, 1, 5])
def test_power_weights(spark, n):
    df = spark.createDataFrame([("s", float(n))], "source string, units double")
    assert mixing.power_weights(df).first().weight == (n**0.7 if n else 0.0)


def test_columns_that_begin_with_an_underscore_stay(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", "x", 7), (2, "c d", "en", "s", "y", 8)], "doc_id long, _text string, lang string, source string, _digest string, _size long")
    out = mixing.mix(df, F.lit(1).cast("long"), total=40.0)
    assert set(df.columns) < set(out.columns) and {(r.doc_id, r._text, r._digest, r["_size"]) for r in out.collect()} == {(1, "a b", "x", 7), (2, "c d", "y", 8)}
    units = df.select("*", F.lit(3).cast("long").alias("_n"))
    out = mixing.mix(units, F.col("_n") + F.col("_size"), total=40.0)  # columns of the table, as the caller names them
    assert set(units.columns) < set(out.columns) and not [c for c in out.columns if "argument" in c] and {(r.doc_id, r["_n"]) for r in out.collect()} <= {(1, 3), (2, 3)}
    out = sharding.shard_by_bytes(df, 2, text="_text")  # adds a size of its own
    assert {(r.doc_id, r._digest, r["_size"]) for r in out.collect()} == {(1, "x", 4), (2, "y", 4)} and out.columns.count("_size") == 1
    out = pii.sanitise(df, text="_text")
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in df.collect()}

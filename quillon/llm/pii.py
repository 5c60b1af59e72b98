"""Personal data: patterns, and terms that disclose what the patterns protect.

Base spans come from four patterns. The information-theoretic part treats each matched value as
a protected entity: over the whole corpus it counts how often terms stand near the entity and how
often at all. A term whose pointwise mutual information with an entity is nearly all of the
entity's own information content tells who or what was masked, and is generalised or removed too,
wherever it stands.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import BROADCAST_ROWS, durable, keeps_names, public, slices

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words on either side of an entity that count as near it.
WINDOW = 8
#: A term needs so many different texts with the entity, and this share of its information content.
MIN_TEXTS, DISCLOSURE = 3, 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a match never starts inside a run of digits, so looking back changes nothing but the cost
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ outwards: linear in the text."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = max(at + 1, done)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def terms_of(text: str) -> Iterator[tuple[str, int, int]]:
    """Lower-case words without the marks around them, with their places; three letters at least."""
    for m in _WORD.finditer(text):
        w = m[0]
        left = len(w) - len(w.lstrip(_EDGE))
        core = w.strip(_EDGE)
        if len(core) >= 3:
            yield core.lower(), m.start() + left, m.start() + left + len(core)


def _vocabulary(text: str) -> set[str]:
    """The distinct terms of a text; cheaper than their places."""
    return {w.strip(_EDGE) for w in set(_WORD.findall(text.lower()))}


def outside(places: list[tuple], spans: list[tuple[int, int, int]]) -> list[tuple]:
    """Those of ``places`` (name, start, end) that touch no span. Spans are joined to
    disjoint ones first, so that a place looks at one of them only."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    if not starts:
        return list(places)
    kept = []
    for w in places:
        k = bisect.bisect_left(starts, w[2]) - 1
        if k < 0 or ends[k] <= w[1]:
            kept.append(w)
    return kept


def near(text: str, spans: list[tuple[int, int, int]]) -> dict[str, set[str]]:
    """entity -> the terms within WINDOW words of one of its mentions, protected text excluded."""
    words = outside(list(terms_of(text)), spans)
    starts = [w[1] for w in words]
    out: dict[str, set[str]] = {}
    for kind, a, b in spans:
        i = bisect.bisect_left(starts, a)
        out.setdefault(f"{KINDS[kind]}:{text[a:b]}", set()).update(w for w, _, _ in words[max(0, i - WINDOW) : i + WINDOW])
    return out


def _texts(batch: pa.RecordBatch, text: str) -> list[str]:
    return [x or "" for x in batch.column(text).to_pylist()]


def disclosing_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, generalised): terms that disclose an entity; counts cover every document of ``df``.

    With N documents, n(e), n(t) and n(e, t) those that hold the entity, the term, or both near:
    log(n(e,t) N / (n(e) n(t))) must reach DISCLOSURE * log(N / n(e)), in MIN_TEXTS different texts.
    """
    only = df.select(F.col(text).alias("text"))
    total = df.count()

    def contexts(batches):
        for batch in slices(batches, "text"):
            seen: Counter = Counter()
            for t in _texts(batch, "text"):
                spans = base_spans(t)
                if not spans:
                    continue
                mark = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                for entity, terms in near(t, spans).items():
                    seen[entity, "", mark] += 1
                    seen.update((entity, w, mark) for w in terms)
            rows = [(e, w, m, n) for (e, w, m), n in seen.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((),) * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["entity", "term", "mark", "n"],
            )

    pairs = only.mapInArrow(contexts, "entity string, term string, mark long, n long")
    pairs = pairs.groupBy("entity", "term", "mark").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("both")).where(F.col("texts") >= MIN_TEXTS)
    pairs = durable(pairs, "pii-pairs")
    entities = pairs.where("term = ''").select("entity", F.col("both").alias("n_entity"))
    pairs = durable(pairs.where("term <> ''").join(entities, "entity"), "pii-candidates")
    wanted = durable(pairs.select("term").distinct(), "pii-terms")
    counts = _document_counts(only, wanted)
    pmi = F.log(F.col("both") * total / (F.col("n_entity") * F.col("n_term")))
    content = F.log(total / F.col("n_entity"))
    found = pairs.join(counts, "term").where((content > 0) & (pmi >= DISCLOSURE * content)).select("term").distinct()
    kind = F.when(F.col("term").rlike("[0-9]"), "NUMBER").otherwise("TERM")
    return durable(found.withColumn("generalised", kind), "pii-disclosing")


def _small(df: DataFrame) -> list | None:
    rows = df.limit(BROADCAST_ROWS + 1).collect()
    return rows if len(rows) <= BROADCAST_ROWS else None


def _document_counts(only: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_term): documents that hold the term, for wanted terms only."""
    few = _small(wanted)
    sent = None if few is None else only.sparkSession.sparkContext.broadcast(frozenset(r.term for r in few))

    def count(batches):
        for batch in slices(batches, "text"):
            seen: Counter = Counter()
            for t in _texts(batch, "text"):
                words = _vocabulary(t)
                seen.update(words if sent is None else words & sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    if few is not None and not few:
        return wanted.withColumn("n_term", F.lit(0).cast("long"))
    counted = only.mapInArrow(count, "term string, n long")
    if few is None:
        counted = counted.join(wanted, "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term"))


def _per_text(df: DataFrame, text: str, terms: DataFrame, schema: T.StructType, row: Callable) -> DataFrame:
    """Map every row by ``row(text, spans, terms)``. Terms are marked in every text: they disclose
    their entity whether it is named there or not.

    Few terms go to the workers. Too many for that: words are joined with them by the text's
    hash, and each row gets the places of its terms from that join.
    """
    added = [f for f in schema.fields if f.name not in df.columns]
    few = _small(terms)
    if few is None:
        marked = df.withColumn("_mark", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))

        def places(batches):
            for batch in slices(batches, "t"):
                rows = [(m, w, a, b) for m, t in zip(batch.column("_mark").to_pylist(), _texts(batch, "t"), strict=True) for w, a, b in terms_of(t)]
                cols = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["_mark", "term", "a", "b"])

        each = marked.select("_mark", F.col(text).alias("t")).dropDuplicates(["_mark"])
        hits = each.mapInArrow(places, "_mark string, term string, a int, b int").join(terms, "term")
        hits = hits.groupBy("_mark").agg(F.collect_list(F.struct("a", "b", "generalised")).alias("_hits"))
        df, sent = marked.join(hits, "_mark", "left").drop("_mark"), None
    else:
        sent = df.sparkSession.sparkContext.broadcast({r.term: r.generalised for r in few})
    arrow = [(f.name, {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[f.dataType.simpleString().replace("bigint", "long")]) for f in added]
    kept = [f.name for f in schema.fields if f not in added]
    replaced = text if text in kept else None

    def run(batches):
        for batch in slices(batches, text):
            out, texts = [], _texts(batch, text)
            given = batch.column("_hits").to_pylist() if sent is None else [None] * len(texts)
            for t, hits in zip(texts, given, strict=True):
                spans = base_spans(t)
                if sent is None:
                    extra = [(h["generalised"], h["a"], h["b"]) for h in hits or []]
                elif sent.value and not sent.value.keys().isdisjoint(_vocabulary(t)):
                    extra = [(sent.value[w], a, b) for w, a, b in terms_of(t) if w in sent.value]
                else:
                    extra = []
                extra = sorted((a, b, name) for name, a, b in outside(extra, spans))
                out.append(row(t, spans, extra))
            cols = dict(zip([replaced] * bool(replaced) + [n for n, _ in arrow], zip(*out, strict=True) if out else [()] * (len(arrow) + bool(replaced)), strict=True))
            arrays = [pa.array(cols[n], dict(arrow).get(n, pa.string())) if n in cols else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def _joined(spans, extra=()) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans] + [f"{KINDS[4]}:{a}:{b}" for a, b, _ in extra])


@keeps_names
def find(df: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """All columns of ``df`` but the text, with n_email, n_ip, n_card, n_phone (base spans),
    base_sha256 and spans (base spans by kind and start, then terms).

    Null and empty texts have no spans. Rows are handled one by one, repeated ones alike; an empty
    table gives no rows. Columns named like the added ones are replaced.
    """
    names = [f"n_{k}" for k in KINDS[:4]]
    df = public(df, *names, "base_sha256", "spans")
    terms = disclosing_terms(df, text) if terms is None else terms
    schema = T.StructType([f for f in df.schema.fields if f.name != text])
    for n in names:
        schema = schema.add(n, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def row(t, spans, extra):
        kinds = [k for k, _, _ in spans]
        return (*[kinds.count(k) for k in range(4)], hashlib.sha256(_joined(spans).encode()).hexdigest(), _joined(spans, extra))

    return _per_text(df, text, terms, schema, row)


def masked(text: str, spans, extra) -> str:
    """Base spans become [EMAIL], [IP], [CARD] or [PHONE]; terms that hold a digit become [NUMBER],
    other terms [TERM]. Of spans that overlap, the first names what stands for all."""
    marks = sorted([(a, b, KINDS[k].upper()) for k, a, b in spans] + list(extra))
    out, at = [], 0
    for a, b, name in marks:
        if a >= at:
            out += [text[at:a], f"[{name}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@keeps_names
def sanitise(df: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """``df`` with personal data in its texts masked, columns as they were; null texts become empty."""
    df = public(df)
    terms = disclosing_terms(df, text) if terms is None else terms
    return _per_text(df, text, terms, df.schema, lambda t, spans, extra: (masked(t, spans, extra),))

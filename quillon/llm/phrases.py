"""Phrase collocations: candidates from a sketch, counted by automata, scored by their weakest cut.

Three passes over the texts. The first hashes each run of 2 to ``longest`` words into the cells of a
sketch that grows with the texts; a cell's sum is an upper bound of the count of any phrase in it. The
sketch lies in stripes: a task sends each stripe its distinct cells and their counts, and a stripe is
summed alone. The second pass takes the phrases of the cells whose sum reaches the threshold, each cell's from the
shard that has most of it. They, and their words, are compiled into automata over bytes, each pattern
between blanks as guards; the third pass counts all matches of each shard of texts, overlapping ones
included, and the counts are summed. Where the counts of a cell's phrases leave as much of its sum as the
threshold, its shard lacked a phrase: such cells are sought in all shards, and what is found is counted
too. So no phrase is missed, whatever shares a cell. Everything after works on exact counts. Cells and
patterns go to the tasks in bounded chunks, a pass over the texts for each chunk.

Texts are lower-cased (A-Z) and split into pieces at sentence marks and line ends, pieces into words at
blanks and tabs. Null texts are empty, a null language is ``und``; repeated rows count each time; ties go by
count, then by the bytes of the phrase; empty tables give no rows. Very long texts are cut at a piece's
end, or within a piece with the words before the cut repeated but not counted again. Other columns are
left out.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import durable, join_small, slices

#: Marks at which pieces end (fixed value): the stops . , ; : ! ? and the characters 0A to 0D.
STOPS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text that are hashed or scanned at once.
CUT = 1 << 20
#: Cells that a task gathers before it sends them on, and that one stripe of the sketch gets in all.
FLUSH, STRIPE = 1 << 22, 1 << 21
#: Cells, bytes of patterns and phrases that a task holds at once.
CELLS, PATTERN_BYTES, PHRASES = 1 << 20, 4 << 20, 1 << 18
#: Counts that one row of a shard's counts holds.
COUNTS = 32
#: Bytes from which a word is hashed alone.
LONG_WORD = 4096

_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + STOPS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(STOPS))
_BASE = 0x9E3779B97F4A7C15
_MIX = tuple(map(np.uint64, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F)))


def guarded(text: bytes) -> bytes:
    """Words and piece ends (a line feed alone), each between single blanks."""
    t = b" " + text.translate(_PLAIN).replace(b"\n", b" \n ") + b" "
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t


def cuts(text: bytes, longest: int = LONGEST, size: int = 0) -> Iterator[tuple[bytes, int]]:
    """(part, lead): parts of a text of about ``size`` bytes; the first ``lead`` words of a part are the last of
    the one before, and only runs that end after them are the part's own."""
    size, at, end, lead = size or CUT, 0, 0, 0
    while len(text) - end > size:
        window = text[end : end + size]
        stop = max(window.rfind(STOPS[k : k + 1]) for k in range(len(STOPS)))
        if stop >= 0:
            yield text[at : end + stop], lead
            at, end, lead = end + stop + 1, end + stop + 1, 0
            continue
        stop = max(window.rfind(b" "), window.rfind(b"\t"))
        if stop <= 0:  # within a word: go on to its end
            found = re.compile(rb"[ \t.,;:!?\x0a-\x0d]").search(text, end + size)
            if not found:
                break
            stop = found.start() - end
        part = text[at : end + stop]
        yield part, lead
        tail = part[-(longest * size) :]
        words = list(re.finditer(rb"[^ \t.,;:!?\x0a-\x0d]+", tail))
        if len(words) < longest and len(tail) < len(part):  # the first could be half a word
            tail = part
            words = list(re.finditer(rb"[^ \t.,;:!?\x0a-\x0d]+", tail))
        words = words[len(words) - longest + 1 :] if len(words) >= longest else words
        lead, back = len(words), len(tail) - (words[0].start() if words else 0)
        end += stop
        at = end - back if words else end
    yield text[at:], lead


def blocks(batches: Iterable[pa.RecordBatch], longest: int = LONGEST) -> Iterator[tuple[str, bytes, int]]:
    """(language, guarded text, lead): texts of one language together, up to about ``CUT`` bytes."""
    waiting: dict[str, list] = {}  # bytes of a language's parts, and the parts
    held = 0
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for part, lead in cuts(text, longest) if text and len(text) > CUT else [(text or b"", 0)]:
                if lead:
                    yield lang, guarded(part), lead
                    continue
                own = waiting.setdefault(lang, [0])
                own.append(part)
                own[0] += len(part)
                held += len(part)
                if own[0] >= CUT:
                    held -= own[0]
                    yield lang, guarded(b"\n".join(waiting.pop(lang)[1:])), 0
            if held >= 8 * CUT:
                for lang, parts in waiting.items():
                    yield lang, guarded(b"\n".join(parts[1:])), 0
                waiting, held = {}, 0
    for lang, parts in waiting.items():
        yield lang, guarded(b"\n".join(parts[1:])), 0


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least n of each; kept for a process."""
    kept = sys.__dict__.setdefault("_quillon_powers", {})
    if len(kept.get("up", ())) < n:
        n = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            kept[name] = np.cumprod(steps, dtype=np.uint64)
    return kept["up"], kept["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word and piece end of a guarded text, and hashes of them; 0 for piece ends."""
    a = np.frombuffer(t, np.uint8)
    blank = np.flatnonzero(a == 32)
    start, end = blank[:-1] + 1, blank[1:]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    if (end - start).max() > LONG_WORD:  # hashed alone, so that powers are needed for short texts only
        short = re.sub(rb"[^ ]{%d,}" % (LONG_WORD + 1), lambda m: hashlib.sha256(m[0]).hexdigest().encode(), t)
        return start, end, words_of(short)[2]
    up, down = _powers(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    h = _mixed((sums[end] - sums[start]) * down[start]) | np.uint64(1)
    h[a[start] == 10] = 0
    return start, end, h


def runs(word: np.ndarray, lang: str, lead: int, longest: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: (length, places of the first words of the runs, cells of the sketch)."""
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    inside, h = word != 0, word ^ seed
    whole = inside
    for k in range(2, longest + 1):
        if len(h) < 2:
            return
        h = _mixed(h[:-1] * _MIX[2] + word[k - 1 :])
        whole = whole[:-1] & inside[k - 1 :]
        at = np.flatnonzero(whole)
        at = at[at + k - 1 >= lead]
        yield k, at, h[at] >> np.uint64(64 - bits)


def sketch(df: DataFrame, bits: int, least: int, longest: int) -> DataFrame:
    """Cells of the sketch of ``df(lang, text)`` whose sum is ``least`` or more: cell, sum, and the shard (a
    partition of ``df``) that has most of it."""
    stripe_bits = max(0, bits - (STRIPE.bit_length() - 1))
    names = ["stripe", "first", "shard", "width", "gaps", "n", "places", "more"]

    def send(cells: list[np.ndarray], shard: int) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        stripe = cell >> np.uint64(bits - stripe_bits)
        ends = np.flatnonzero(np.diff(stripe)) + 1
        for c, m in zip(np.split(cell, ends), np.split(n, ends), strict=True):
            gap = np.diff(c, prepend=c[:1])
            width = next(w for w in (1, 2, 4, 8) if int(gap.max()) < 1 << (8 * w))
            large = np.flatnonzero(m > 255)
            row = [[int(c[0] >> np.uint64(bits - stripe_bits))], [int(c[0])], [shard], [width], [gap.astype(f"<u{width}").tobytes()], [np.minimum(m, 255).astype("u1").tobytes()],
                   [large.astype("<i8").tobytes()], [m[large].astype("<i8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=names)

    def gather(batches):
        held, size, shard = [], 0, TaskContext.get().partitionId()
        for lang, text, lead in blocks(batches, longest):
            for _, _, cells in runs(words_of(text)[2], lang, lead, longest, bits):
                held.append(cells)
                size += len(cells)
            if size >= FLUSH:
                yield from send(held, shard)
                held, size = [], 0
        if size:
            yield from send(held, shard)

    def total(rows):
        cells, counts, shards = [], [], []
        for x in rows.itertuples():
            cells.append(np.uint64(x.first) + np.cumsum(np.frombuffer(x.gaps, f"<u{x.width}"), dtype=np.uint64))
            n = np.frombuffer(x.n, "u1").astype(np.int64)
            n[np.frombuffer(x.places, "<i8")] = np.frombuffer(x.more, "<i8")
            counts.append(n)
            shards.append(np.full(len(n), x.shard, np.int32))
        cell, n, shard = map(np.concatenate, (cells, counts, shards))
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
        begin = np.flatnonzero(np.diff(cell, prepend=cell[:1] + np.uint64(1)))
        sums, heavy = np.add.reduceat(n, begin), []
        ends = np.append(begin[1:], len(cell))
        for k in np.flatnonzero(sums >= least).tolist():
            a = begin[k]
            heavy.append((int(cell[a]), int(sums[k]), int(shard[order[a + n[a : ends[k]].argmax()]])))
        return pd.DataFrame(heavy, columns=["cell", "sum", "shard"])

    parts = df.mapInArrow(gather, "stripe long, first long, shard int, width int, gaps binary, n binary, places binary, more binary")
    return parts.groupBy("stripe").applyInPandas(total, "cell long, sum long, shard int")


def cells_of(df: DataFrame, bits: int, longest: int) -> DataFrame:
    """``df(lang, phrase, f)`` as cell, f; words have no cell."""

    def run(batches):
        for batch in batches:
            cells, counts = [], []
            for lang, phrase, f in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist(), batch.column("f").to_pylist(), strict=True):
                for k, _, cell in runs(words_of(b" " + phrase + b" ")[2], lang, 0, longest, bits):
                    if k == phrase.count(b" ") + 1:
                        cells.append(int(cell[0]))
                        counts.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], names=["cell", "f"])

    return df.select("lang", "phrase", "f").mapInArrow(run, "cell long, f long")


def phrases_in(df: DataFrame, cells: np.ndarray, bits: int, longest: int, shards: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase) of the runs whose cell is one of ``cells``, some of them more than once; each cell's in its
    shard alone, if ``shards`` are given."""
    order = np.argsort(cells)
    sent = df.sparkSession.sparkContext.broadcast((cells[order].astype(np.uint64), None if shards is None else shards[order]))

    def find(batches):
        heavy, owner = sent.value
        if owner is not None:
            heavy = heavy[owner == TaskContext.get().partitionId()]
        if not len(heavy):
            return
        mask = np.uint64((1 << min(bits, 22)) - 1)
        some = np.zeros(int(mask) + 1, bool)
        some[(heavy & mask).astype(np.int64)] = True

        def send(found):
            for lang, texts in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), pa.array(list(texts), pa.binary())], names=["lang", "phrase"])

        found, size = {}, 0
        for lang, text, lead in blocks(batches, longest):
            start, end, word = words_of(text)
            own = found.setdefault(lang, set())
            size -= len(own)
            for k, at, cell in runs(word, lang, lead, longest, bits):
                hit = np.flatnonzero(some[(cell & mask).astype(np.int64)])
                place = np.searchsorted(heavy, cell[hit])
                place[place == len(heavy)] = 0
                at = at[hit[heavy[place] == cell[hit]]]
                own.update([text[a:b] for a, b in zip(start[at].tolist(), end[at + k - 1].tolist(), strict=True)])
            size += len(own)
            if size >= PHRASES:
                yield from send(found)
                found, size = {}, 0
        yield from send(found)

    return df.mapInArrow(find, "lang string, phrase binary").withColumn("phrase", F.col("phrase").cast("string"))


def _automaton(key: str, lang: str, patterns: list[bytes]):
    """The automaton of a chunk's patterns of one language, kept for the tasks of a process; None without patterns."""
    kept = sys.__dict__.setdefault("_quillon_automata", {})
    if kept.get("key") != key:
        kept.clear()
        kept["key"] = key
    if lang not in kept:
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, p in enumerate(patterns):
            found.add_word(f" {p.decode('latin-1')} ", k)
        found.make_automaton()
        kept[lang] = found if patterns else None
    return kept[lang]


def scan(df: DataFrame, patterns: dict[str, list[bytes]], longest: int) -> DataFrame:
    """Matches of each pattern in each shard of ``df``: lang, stripe, n, where n counts the ``COUNTS`` patterns
    from number stripe * COUNTS on. A null stripe has the number of words."""
    sent, key = df.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex

    def count(batches):
        counts, words = {}, Counter()
        for lang, text, lead in blocks(batches, longest):
            words[lang] += text.count(b" ") - 1 - text.count(b" \n") - lead
            automaton = _automaton(key, lang, sent.value.get(lang, []))
            if automaton is None:
                continue
            matches, own = automaton.iter(text.decode("latin-1")), counts.setdefault(lang, Counter())
            if lead:
                last = [m.end() for m in re.finditer(rb"[^ ]+ ", text[: text.find(b"\n") if b"\n" in text else len(text)])][lead - 1] - 1
                matches = ((e, k) for e, k in matches if e > last)
            own.update(map(itemgetter(1), matches))
        for lang, n in words.items():
            rows: dict[int | None, list[int]] = {None: [n]}
            for k, f in counts.get(lang, {}).items():
                rows.setdefault(k // COUNTS, [0] * COUNTS)[k % COUNTS] = f
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.int64()))], names=["lang", "stripe", "n"])

    return df.mapInArrow(count, "lang string, stripe int, n array<long>")


def _counts(docs: DataFrame, phrases: DataFrame | None, longest: int) -> DataFrame:
    """(lang, phrase, f) of ``phrases`` and their words, and with a null phrase the number of words."""
    chunks = 1
    if phrases is not None:
        every = durable(phrases.union(phrases.select("lang", F.explode(F.split("phrase", " ")))).distinct(), "phrases-patterns")
        chunks = max(1, -(-int(every.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0) // PATTERN_BYTES))
        place = F.row_number().over(Window.partitionBy("chunk", "lang").orderBy("phrase")) - 1  # a chunk has about PATTERN_BYTES
        patterns = durable(every.withColumn("chunk", F.pmod(F.xxhash64("lang", "phrase"), F.lit(chunks))).withColumn("place", place), "phrases-places")
    counts = []
    for k in range(chunks):
        own: dict[str, list[bytes]] = {}
        if phrases is not None:
            for r in patterns.where(F.col("chunk") == k).select("lang", F.col("phrase").cast("binary").alias("phrase"), "place").orderBy("lang", "place").collect():
                own.setdefault(r.lang, []).append(bytes(r.phrase))
        part = scan(docs, own, longest)
        sums = part.groupBy("lang", "stripe").agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(COUNTS)]).alias("n"))
        counts.append(sums.select(F.lit(k).cast("long").alias("chunk"), "lang", "stripe", F.posexplode("n").alias("i", "f")).where("f IS NOT NULL"))
    found = durable(reduce(DataFrame.union, counts), "phrases-counted")
    words = found.where("stripe IS NULL AND chunk = 0").select("lang", F.lit(None).cast("string").alias("phrase"), "f")
    if phrases is None:
        return words
    named = found.where("stripe IS NOT NULL").withColumn("place", F.col("stripe") * COUNTS + F.col("i"))
    return words.union(named.join(patterns, ["chunk", "lang", "place"]).where("f > 0").select("lang", "phrase", "f"))


def _chunks(cells: DataFrame, bits: int) -> Iterator:
    """The rows of cells, a table, in parts of about ``CELLS`` (cells are hashes, even over their range)."""
    parts = -(-cells.count() // CELLS)
    width = -(-(1 << bits) // max(1, parts))
    for k in range(parts):
        part = cells.where(F.col("cell").between(k * width, (k + 1) * width - 1)).toPandas()
        if len(part):
            yield part


def counted(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """A table (lang, phrase, f): exact counts of all phrases of 2 to ``longest`` words that stand there ``least``
    times or more, and of their words, with some phrases below that; a null phrase has the number of words."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about as many cells as runs: half as many as bytes
    bits = max(10, (int(size) // 2).bit_length())
    heavy = durable(sketch(docs, bits, least, longest), "phrases-heavy")
    found = [durable(phrases_in(docs, x["cell"].to_numpy(), bits, longest, x["shard"].to_numpy()).distinct(), "phrases-found") for x in _chunks(heavy, bits)]
    if not found:
        return durable(_counts(docs, None, longest), "phrases-counts")
    counts = durable(_counts(docs, reduce(DataFrame.union, found), longest), "phrases-counts")
    # what the counts leave of a cell's sum
    told = cells_of(counts.where("phrase IS NOT NULL"), bits, longest).groupBy("cell").agg(F.sum("f").alias("f"))
    left = durable(heavy.join(told, "cell", "left").where(F.col("sum") - F.coalesce("f", F.lit(0)) >= least).select("cell"), "phrases-left")
    more = [durable(phrases_in(docs, x["cell"].to_numpy(), bits, longest).distinct(), "phrases-found") for x in _chunks(left, bits)]
    if not more:
        return counts
    new = reduce(DataFrame.union, more).join(counts.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    again = _counts(docs, new, longest).where("phrase IS NOT NULL").join(counts.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    return durable(counts.union(again), "phrases-counts")


def _part(first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = 100) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score (see the module).

    a: count of the phrase; l, r: those of the parts of the cut with the least score, floor(1000 a n / l r), ties to
    the first cut; n: the words of the language. Phrases inside a longer one that has ``within`` percent of their
    count or more are dropped. If such a longer phrase exists, so does one that is longer by one word, as a
    phrase between the two is counted no less than the longer; so neighbours in length are compared only."""
    f = counted(df, lang, text, least, longest)
    total = f.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    known = f.where("phrase IS NOT NULL")
    phrases = known.withColumn("words", F.split("phrase", " ")).where((F.size("words") > 1) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    # what a longer phrase covers
    n = F.size("words")
    inner = phrases.where(n > 2).select("lang", F.explode(F.array(_part(1, n - 1), _part(2, n - 1))).alias("phrase"), F.col("a").alias("_outer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("_outer").alias("_outer"))
    free = phrases.join(inner, ["lang", "phrase"], "left").where(F.col("_outer").isNull() | (100 * F.col("_outer") < within * F.col("a"))).drop("_outer")
    cut = join_small(free, durable(total, "phrases-total"), ["lang"]).select("*", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cut = cut.withColumns({"_first": _part(1, F.col("k")), "_rest": _part(F.col("k") + 1, n - F.col("k"))})
    cut = cut.join(known.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"]).join(known.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    wide = lambda c: f"cast({c} as decimal(18,0))"
    cut = cut.withColumn("score", F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b")).select("lang", "phrase", "a", "n", "_b.l", "_b.r", "_b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task orders a whole large one
    few = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Toxicity: Levenshtein automata intersected with a lexicon trie, and windows that tell quotation from abuse.

The lexicon is learned from labelled documents: whole words, word beginnings and word endings that
stand in toxic documents far more often than in others. Every word of a text runs through the
product of the trie and the automaton, made deterministic as it is used, so misspelled terms
match. Words around a match decide whether it is quoted or aimed at someone; a logistic model
weighs the counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, keeps_names, public

#: The model is fitted on at most so many labelled rows, those of the smallest hash of their id.
TRAIN_ROWS = 20_000
#: A lexicon entry stands in so many toxic documents (at least; and as a share of them), with this
#: log odds ratio, and among at least this share of as many different neighbours.
MIN_DOCS, MIN_SHARE, MIN_ODDS, MIN_SPREAD = 5, 0.004, 2.0, 0.5
#: Fragments of words that may become entries.
FRAGMENT_LENGTHS = range(4, 9)
#: Edits that an entry of a length allows: none below 5 characters, one below 9, else two;
#: beginnings and endings, which match more words, one less.
WINDOW = 6
QUOTES = frozenset("\"“”„«»‹›")
REPORTS = frozenset("said says say quote quoted wrote writes called calls reported word dit écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split())
AIMED = frozenset("you your you're u du dich dein deine sie ihr tu toi vous ton ta eres usted tú".split())
EDGE = ".,;:!?\"'()[]{}<>*#$%&|“”„«»‹›"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = ["any", "exact", "misspelled", "part", "quoted", "aimed", "density", "odds", "best"]


def edits(entry: str) -> int:
    core = entry.strip("*")
    most = 0 if len(core) < 5 else 1 if len(core) < 9 else 2
    return max(0, most - 1) if "*" in entry else most


class Matcher:
    """The trie of entries of one direction and its lazily determinised Levenshtein automaton.

    A state is a set of (trie node, edits so far). ``match`` gives (entry, edits) of the entry that
    takes the fewest edits, or None. Transitions that were computed are kept, LIMIT at most.
    """

    LIMIT = 300_000

    def __init__(self, entries: list[tuple[str, str, bool, int]]):
        """(name, string, open end, edits allowed) for each entry."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool]]] = [[]]
        self.most = [0]
        self.entries = entries
        for k, (_, string, open_, most) in enumerate(entries):
            node = 0
            self.most[0] = max(self.most[0], most)
            for c in string:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], most)
            self.ends[node].append((k, open_))
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple[frozenset, tuple | None]] = []
        self.steps: list[dict[str, int]] = []
        self.index: dict[tuple[frozenset, tuple | None], int] = {}
        self.kept = 0
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], best: tuple | None) -> int:
        """Close under skipped trie characters, note open entries reached; -1 if nothing can match."""
        todo = list(nodes)
        while todo:
            n = todo.pop()
            e = nodes[n] + 1
            for child in self.children[n].values():
                if e <= self.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        for n, e in nodes.items():
            for k, open_ in self.ends[n]:
                if open_ and e <= self.entries[k][3]:
                    best = min(best or (99, 0), (e, k))
        nodes = {n: e for n, e in nodes.items() if best is None or e < best[0]}
        if not nodes and best is None:
            return -1
        key = (frozenset(nodes.items()), best)
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.index[key]

    def _step(self, state: int, c: str) -> int:
        nodes, best = self.states[state]
        out: dict[int, int] = {}
        for n, e in nodes:
            for d, child in self.children[n].items():
                cost = e + (c != d)
                if cost <= self.most[child] and cost < out.get(child, 99):
                    out[child] = cost
            if e + 1 <= self.most[n] and e + 1 < out.get(n, 99):
                out[n] = e + 1
        to = self._state(out, best)
        self.steps[state][c] = to
        self.kept += 1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        if self.kept > self.LIMIT:
            self._clear()
        s, steps = self.start, self.steps
        for c in word:
            to = steps[s].get(c)
            s = self._step(s, c) if to is None else to
            if s < 0:
                return None
        nodes, best = self.states[s]
        for n, e in nodes:
            for k, open_ in self.ends[n]:
                if not open_ and e <= self.entries[k][3]:
                    best = min(best or (99, 0), (e, k))
        return None if best is None else (self.entries[best[1]][0], best[0])


class Lexicon:
    """Entries 'word', 'beginning*' and '*ending', in a forward and a backward matcher."""

    def __init__(self, entries: dict[str, float]):
        """Entries with their log odds ratios."""
        self.odds = entries
        rows = [(e, e.strip("*"), "*" in e, edits(e)) for e in entries]
        self.forward = Matcher([r for r in rows if not r[0].startswith("*")])
        self.backward = Matcher([(n, s[::-1], o, m) for n, s, o, m in rows if n.startswith("*")])
        self.reverse = any(n.startswith("*") for n in entries)

    def match(self, word: str) -> tuple[str, int] | None:
        found = self.forward.match(word)
        if self.reverse and (found is None or found[1]):
            back = self.backward.match(word[::-1])
            if back and (found is None or back[1] < found[1]):
                return back
        return found


def fragments(word: str) -> list[str]:
    out = [word] if len(word) >= 3 else []
    for n in FRAGMENT_LENGTHS:
        if len(word) > n:
            out += [word[:n] + "*", "*" + word[-n:]]
    return out


def words_of(text: str) -> list[str]:
    return [w.strip(EDGE) for w in _TOKEN.findall(text.lower())]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Counts of matches by kind and surroundings, for one text."""
    tokens = _TOKEN.findall(text.lower())
    hits = {t: m for t in set(tokens) if (m := lexicon.match(t.strip(EDGE)))}
    if not hits:
        return [0.0] * len(FEATURES)
    n, odds = Counter(), {}
    for i, t in enumerate(tokens):
        if t in hits:
            entry, off = hits[t]
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            own = t.partition(t.strip(EDGE))
            opened = any(QUOTES & set(w) for w in before) or bool(QUOTES & set(own[0]))
            closed = any(QUOTES & set(w) for w in after) or bool(QUOTES & set(own[2]))
            around = {w.strip(EDGE) for w in before + after}
            if opened and closed or REPORTS & around and (opened or closed):
                n["quoted"] += 1
                continue
            n["aimed"] += bool(AIMED & around)
            odds[entry] = max(odds.get(entry, 0.0), lexicon.odds[entry] / (1 + off))
            n["misspelled" if off else "part" if "*" in entry else "exact"] += 1
    plain = n["misspelled"] + n["part"] + n["exact"]
    return [float(plain > 0), *[math.log1p(n[k]) for k in FEATURES[1:6]], math.log1p(100 * plain / len(tokens)), min(20.0, sum(odds.values())), max(odds.values(), default=0.0)]


def _column(batch: pa.RecordBatch, name: str) -> list:
    return [x or "" for x in batch.column(name).to_pylist()]


def _counted(train: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(fragment, n): documents of ``train`` that hold it, of those wanted."""
    sent = None if wanted is None else train.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for t in _column(batch, "text"):
                found = {f for w in set(words_of(t)) for f in fragments(w)}
                seen.update(found if sent is None else found & sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["fragment", "n"])

    return train.select("text").mapInArrow(count, "fragment string, n long").groupBy("fragment").agg(F.sum("n").alias("n"))


def _spread(train: DataFrame, wanted: frozenset) -> DataFrame:
    """(fragment, spread): different pairs of neighbours that its words stand between."""
    sent = train.sparkSession.sparkContext.broadcast(wanted)

    def pairs(batches):
        for batch in batches:
            seen = set()
            for t in _column(batch, "text"):
                words = ["", *words_of(t), ""]
                for a, w, b in zip(words, words[1:], words[2:], strict=False):
                    seen.update((f, f"{a} {b}") for f in fragments(w) if f in sent.value)
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["fragment", "near"])

    return train.select("text").mapInArrow(pairs, "fragment string, near string").distinct().groupBy("fragment").agg(F.count("*").alias("spread"))


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Entries with log odds ratios from ``train`` (text, toxic), which is bounded by TRAIN_ROWS.

    Words stay beside their parts: a part takes inflections, but only the word takes misspellings.
    """
    bad, good = train.where("toxic = 1"), train.where("toxic = 0")
    p, q = bad.count(), good.count()
    if not p:
        return {}
    least = max(MIN_DOCS, MIN_SHARE * p)
    pos = {r.fragment: r.n for r in _counted(bad, None).where(F.col("n") >= least).collect()}
    neg = {r.fragment: r.n for r in _counted(good, frozenset(pos)).collect()}
    odds = lambda f: math.log((pos[f] + 0.5) / (p + 1)) - math.log((neg.get(f, 0) + 0.5) / (q + 1))
    strong = frozenset(f for f in pos if odds(f) >= MIN_ODDS)
    spread = {r.fragment: r.spread for r in _spread(bad, strong).collect()}
    good_ones = [f for f in strong if spread.get(f, 0) >= max(MIN_DOCS, MIN_SPREAD * pos[f])]
    chosen: list[str] = []
    for f in sorted(good_ones, key=lambda f: (-pos[f], "*" in f, -len(f), f)):
        core = f.strip("*")
        for e in chosen:
            c = e.strip("*")
            if "*" in e and "*" not in f:
                continue  # a whole word has edits, which a part has not
            if e[0] != "*" and e[-1] == "*" and core.startswith(c) or e[0] == "*" and core.endswith(c) and f[-1] != "*":
                break  # an entry that matches it is there
            if (c.startswith(core) or c.endswith(core)) and pos[f] < 1.2 * pos[e]:
                break  # it adds little to a longer one
            if "*" not in e and core in c and pos[f] < 1.2 * pos[e]:
                break
        else:
            chosen.append(f)
    return {f: odds(f) for f in sorted(chosen)}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge * max(1, len(x)) ** 0.5)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> tuple[dict[str, float], list[float]]:
    """(lexicon, weights) from the labelled rows of ``docs``, TRAIN_ROWS at most. Null labels and
    keys are left out; a key labelled twice counts by its largest label. Without labels, or with one
    label only, the model has no entries and scores by the share of that label (0.0 without any)."""
    some = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("toxic"))
    some = durable(some.orderBy(F.xxhash64("_key"), "_key").limit(TRAIN_ROWS), "toxicity-labels")
    train = durable(docs.join(F.broadcast(some), F.col(key) == F.col("_key")).select(F.coalesce(F.col(text), F.lit("")).alias("text"), "toxic"), "toxicity-train")
    lexicon = learn_lexicon(train)
    sent = train.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        matcher = Lexicon(sent.value)
        for batch in batches:
            rows = [features(t, matcher) for t in _column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    rows = train.mapInArrow(run, "x array<double>, toxic int").collect()
    if not rows:
        return {}, [0.0] * len(FEATURES) + [-30.0]
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    return lexicon, fit(x, y).tolist()


@keeps_names
def score(docs: DataFrame, lexicon: dict[str, float], weights: list[float], text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with score and predicted. Null and empty texts score as
    texts without a match. Repeated rows score alike; an empty table gives no rows. Columns named
    like the added ones are replaced."""
    docs = public(docs, "score", "predicted")
    names = [c for c in docs.columns if c != text]
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, weights))
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        entries, w = sent.value
        matcher = Lexicon(entries)
        for batch in batches:
            z = [sum(a * b for a, b in zip([*features(t, matcher), 1.0], w, strict=True)) for t in _column(batch, text)]
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z]
            cols = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)

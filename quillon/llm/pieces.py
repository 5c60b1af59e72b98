"""SentencePiece encoding and decoding by a streaming Viterbi search.

At every position the search keeps the best way to end a piece there, for a window of the longest
piece. As soon as the backpointers of all positions in the window meet in one boundary, what lies
before it cannot change any more: its ids are committed and the positions forgotten. Every character
takes a step of this search; equal steps are worked out once, and numpy takes those of many texts together.

For a unigram model the best way has the largest sum of scores. For a merge (BPE) model a path
is feasible when each piece, and each two neighbours, are what the merges make of that string;
one path survives at each position, and it is the model's own encoding.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.common import keeps_names, public, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Penalty of an unknown character below the least score, in a unigram model.
UNKNOWN_PENALTY = 10.0


class Model:
    """What encoding needs of a model file. Models with a normalisation table of their own are refused."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = MERGES, dummy_prefix: bool = True, squeeze: bool = False, byte_fallback: bool = True):
        self.pieces, self.kind, self.dummy_prefix, self.squeeze, self.byte_fallback = pieces, kind, dummy_prefix, squeeze, byte_fallback
        self.ids = {p: k for k, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.scores = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE} if byte_fallback else {}
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    def plain(self) -> tuple:
        """Arguments that make this model again; broadcasts carry plain values only."""
        return self.pieces, self.kind, self.dummy_prefix, self.squeeze, self.byte_fallback

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        normal, trainer = proto.normalizer_spec, proto.trainer_spec
        if normal.precompiled_charsmap or not normal.escape_whitespaces or trainer.model_type not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models without a normalisation table are supported")
        return cls([(p.piece, p.score, p.type) for p in proto.pieces], trainer.model_type, normal.add_dummy_prefix, normal.remove_extra_whitespaces, trainer.byte_fallback)


class Codec:
    """Encodes and decodes texts with one model.

    A state is a window of the search: the text from the first live position on, the live positions
    (those at which a piece that reaches beyond the window can begin, and the end), for each of them
    the piece that ends there on its path ('' if no piece reaches over it; in a unigram model its
    length), and its score. What a character makes of a state - the next state, the piece that ends with
    it, and how far before the end all paths meet - is worked out once and kept, for KEPT steps at most
    (some 120 MB with their windows). Many texts go through these steps side by side, one character each at a time.
    """

    KEPT = 600_000
    #: Steps between two looks for what can be committed, and characters after which a text goes on in
    #: another lane at the next boundary that no piece reaches over.
    BLOCK, LANE = 64, 2048
    _SLOTS, _NONE, _CODE = 1 << 21, 63, 1 << 21

    def __init__(self, model: Model):
        self.model, self.pairs, self.commits = model, {}, 0
        self._forget()
        self.sizes = np.array([len(p) for p, _, _ in model.pieces] or [1], np.int32)
        self.names = {p: p for p in model.ids}
        self.shown = [p.replace(SPACE, " ") if t in (NORMAL, USER) else chr(int(p[3:5], 16)) if t == BYTE and int(p[3:5], 16) < 128 else "" for p, _, t in model.pieces]
        if model.pieces:
            self.shown[model.unknown] = " ⁇ "
        # beginnings of longer pieces, and neighbours that stand together in some piece: between others paths always meet
        self.beginnings = {p[:k] for p in model.ids for k in range(1, len(p))}
        self.joined = {p[k : k + 2] for p in model.ids for k in range(len(p) - 1)}
        self.inner = any(SPACE in p.lstrip(SPACE) for p in model.ids)
        self.high = {k: v for v, k in model.bytes.items() if v >= 128}

    def _forget(self) -> None:
        self.numbers, self.windows, self.kept = {}, [], 0
        self.keys, self.values = np.full(self._SLOTS, -1, np.int64), np.zeros(self._SLOTS, np.int64)
        self._number(("", (0,), ("",), ()) if self.model.kind != UNIGRAM else ("", (0,), (0,), (0.0,)))

    def normalised(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    def merged(self, string: str) -> list[str]:
        """What the merges make of a short string: the best pair first, the leftmost of equals."""
        parts, scores, none = list(string), self.model.scores, -float("inf")
        pairs = [scores.get(a + b, none) for a, b in pairwise(parts)]
        while pairs and (best := max(pairs)) > none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = scores.get(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = scores.get(parts[k] + parts[k + 1], none)
        return parts

    def feasible(self, left: str, right: str) -> bool:
        """Whether the merges leave these two neighbours (or one piece, left empty) as they are."""
        if left and left[-1] + right[0] not in self.joined:
            left = ""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.KEPT // 4:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def _spelt(self, pieces: np.ndarray) -> np.ndarray:
        """Ids of pieces; characters that are none of the model's become bytes, or the unknown id."""
        strange = np.flatnonzero(pieces >= self._CODE)
        if not len(strange):
            return pieces
        out, at = [], 0
        for k in strange:
            raw = chr(pieces[k] - self._CODE).encode("utf-8", "replace")
            out += [pieces[at:k], [self.model.bytes[b] for b in raw] if self.model.bytes else [self.model.unknown]]
            at = k + 1
        return np.concatenate([*out, pieces[at:]]).astype(np.int32)

    def _arrive(self, window: tuple, text: str) -> tuple[int, float]:
        """Where the last piece that ends with the last character begins, and its score: for a unigram
        model the largest sum, for merges the one feasible piece."""
        (_, live, lefts, best), scores = window, self.model.scores
        if self.model.kind != UNIGRAM:
            for j, left in zip(live, lefts, strict=True):
                piece = text[j:]
                if piece in scores and self.feasible(left, piece) and (not left or self.feasible("", piece)):
                    return j, 0.0
            return len(text) - 1, 0.0
        found, score = len(text) - 1, -float("inf")
        for j, so_far in zip(live, best, strict=True):
            own = scores.get(text[j:])
            if own is not None and so_far + own > score:
                found, score = j, so_far + own
        if text[-1] not in scores and best[-1] + self.model.unknown_score > score:
            found, score = len(text) - 1, best[-1] + self.model.unknown_score
        return found, score

    def _number(self, window: tuple) -> int:
        found = self.numbers.get(window)
        if found is None:
            found = self.numbers[window] = len(self.windows)
            self.windows.append(window)
        return found

    def _meeting(self, live: list[int], sizes: dict[int, int | None]) -> int | None:
        """The last boundary in the window that the paths of all live positions share."""
        at = set(live)
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            if sizes[last] is None or last - sizes[last] not in sizes:
                return None  # its path leaves the window's live positions
            at.add(last - sizes[last])
        return at.pop()

    def _step(self, window: tuple, c: str) -> int:
        """What the next character makes of a window: number of the state, piece and cut in one number."""
        before, live, lefts, best = window
        merges = self.model.kind != UNIGRAM
        text = before + c
        end = len(text)
        found, score = self._arrive(window, text)
        last = text[found:]
        last = self.names.get(last, last)
        lefts = dict(zip(live, lefts, strict=True)) | {end: last if merges else len(last)}
        best = {} if merges else dict(zip(live, best, strict=True)) | {end: score}
        live = [j for j in live if text[j:] in self.beginnings] + [end]
        meet = self._meeting(live, {j: len(left) or None if merges else left for j, left in lefts.items()})
        low = live[0]
        if merges:  # a piece before a boundary that no piece reaches over does not matter
            for j in live[:-1]:
                if lefts[j] and lefts[j][-1] + text[j] not in self.joined:
                    lefts[j] = ""
        places = tuple(j - low for j in live)
        scores = () if merges else tuple(round(best[j] - best[low], 9) for j in live)
        after = self._number((text[low:], self.names.setdefault(places, places), tuple(lefts[j] for j in live), scores))
        piece = self.model.ids[last] if last in self.model.ids else self._CODE + ord(last)
        return (after << 28) | (piece << 6) | (self._NONE if meet is None else min(end - meet, self._NONE))

    def _home(self, key):
        return (key * -7046029254386353131 >> 40) & (self._SLOTS - 1)

    def _learn(self, state: np.ndarray, code: np.ndarray, key: np.ndarray, slot: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """Find or make the steps of the lanes that did not find theirs at its first place; the slots of all lanes."""
        for lane in missed:
            k, at = int(key[lane]), int(slot[lane])
            while self.keys[at] != k and self.keys[at] >= 0:
                at = (at + 1) & (self._SLOTS - 1)
            if self.keys[at] < 0:
                self.values[at] = self._step(self.windows[state[lane]], chr(code[lane]))
                self.keys[at] = k
                self.kept += 1
            slot[lane] = at
        return slot

    def _segments(self, text: str) -> Iterator[str]:
        """The normalised text in parts of about LANE characters, cut where no piece reaches over."""
        at = 0
        while at < len(text):
            end = at + self.LANE
            while end < len(text) and text[end - 1 : end + 1] in self.joined:
                end += 1
            yield text[at:end]
            at = end

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; null and empty texts have none."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            some = list(self._segments(self.normalised(t or "")))
            parts += some
            owner += [k] * len(some)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        ids, counts = self._search([parts[i] for i in order])
        place = np.argsort(np.array(order, np.int64), kind="stable")  # lanes back in the order of the texts
        starts = np.concatenate([[0], np.cumsum(counts)])
        out: list[list] = [[] for _ in texts]
        for lane, k in zip(place, owner, strict=True):
            out[k].append(ids[starts[lane] : starts[lane + 1]])
        return [self._spelt(np.concatenate(x)) if x else np.empty(0, np.int32) for x in out]

    def _search(self, lanes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all lanes one after the other, how many each has); longest lanes come first.

        Every BLOCK steps each lane commits what lies before the last boundary that all its paths share;
        kept are the pieces of the positions after it.
        """
        if not lanes:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lengths = np.array(list(map(len, lanes)))
        flat = np.frombuffer("".join(lanes).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state, start = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        rows = np.zeros((2 * self.BLOCK, len(lanes)), np.int32)  # pieces of positions not yet committed
        begin = used = 0  # rows in use
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low in range(0, int(lengths[0]), self.BLOCK):
            n = int(np.searchsorted(-lengths, -low, "left"))  # lanes that go on
            if self.kept >= self.KEPT:
                self._rewind(state[:n])
            if n < rows.shape[1]:
                rows, state, start, first, lengths = rows[:, :n].copy(), state[:n], start[:n], first[:n], lengths[:n]
            if used + self.BLOCK > len(rows):
                size = max(2 * (used - begin), 2 * self.BLOCK) + self.BLOCK
                fresh = np.zeros((size, n), np.int32)
                fresh[: used - begin] = rows[begin:used]
                rows, start, begin, used = fresh, start - begin, 0, used - begin
            commit = start.copy()
            for t in range(low, min(low + self.BLOCK, int(lengths[0]))):
                m = int(np.searchsorted(-lengths, -t, "left"))
                code = flat[first[:m] + t]
                key = (state[:m] << 21) | code
                slot = self._home(key)
                missed = np.flatnonzero(self.keys[slot] != key)
                if len(missed):
                    slot = self._learn(state, code, key, slot, missed)
                value = self.values[slot]
                state[:m] = value >> 28
                rows[used, :m] = (value >> 6) & 0x3FFFFF
                used += 1
                cut = value & self._NONE
                commit[:m] = np.where(cut == self._NONE, commit[:m], np.maximum(commit[:m], used - cut))
            ended = lengths <= low + self.BLOCK
            commit[ended] = used - (min(low + self.BLOCK, int(lengths[0])) - lengths[ended])
            self.commits += int((commit > start).sum())
            done.append(self._committed(rows, begin, start, commit))
            start = commit
            begin = int(start[~ended].min()) if not ended.all() else used
        total = np.zeros(len(done[0][1]), np.int64)
        for _, counts, _ in done:
            total[: len(counts)] += counts
        at = np.cumsum(total) - total
        ids = np.empty(int(total.sum()), np.int32)
        for found, counts, _ in done:
            ids[np.repeat(at[: len(counts)] - (np.cumsum(counts) - counts), counts) + np.arange(len(found))] = found
            at[: len(counts)] += counts
        return ids, total

    def _committed(self, rows: np.ndarray, begin: int, start: np.ndarray, end: np.ndarray) -> tuple:
        """(pieces, how many of each lane): the paths from ``end`` back to ``start``, row numbers of each lane."""
        top = int(end.max())
        on = np.zeros((top - begin, len(start)), bool)
        at = end.copy()
        for r in range(top - 1, begin - 1, -1):
            here = (at == r + 1) & (at > start)
            on[r - begin] = here
            piece = rows[r]
            size = np.where(piece >= self._CODE, 1, self.sizes[np.minimum(piece, len(self.sizes) - 1)])
            at = np.where(here, at - size, at)
        return rows[begin:top].T[on.T], on.sum(axis=0), None

    def _rewind(self, state: np.ndarray) -> None:
        """Forget all steps; lanes under way keep their windows."""
        windows = [self.windows[k] for k in state]
        self._forget()
        state[:] = [self._number(w) for w in windows]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one whole text."""
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces, and runs of bytes as UTF-8, without the space put before the text."""
        ids = list(ids)
        if self.high.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            raw = b"".join(bytes([self.high[k]]) if k in self.high else self.shown[k].encode("utf-8", "replace") for k in ids)
            text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _codec(plain: tuple) -> Codec:
    """The worker's codec for a model: what it has learned serves the tasks that follow in the process."""
    kept = sys.__dict__.setdefault("_quillon_codecs", {})
    key = hash(tuple(plain[0][::97])), len(plain[0]), plain[1:]
    if key not in kept:
        kept.clear()
        kept[key] = Codec(Model(*plain))
    return kept[key]


@keeps_names
def encode(df: DataFrame, model_path: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` with the ids of the text. Null and empty texts get no ids (an empty list);
    repeated rows get the same ones; an empty table gives no rows. A column named like ``ids`` is replaced.
    The model is read by the driver and sent to the workers."""
    df = public(df, ids)
    sent = df.sparkSession.sparkContext.broadcast(Model.load(model_path).plain())
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = _codec(sent.value)
        for part in slices(batches, text):
            found = codec.encode_all(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


@keeps_names
def decode(df: DataFrame, model_path: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``df`` with the text of the ids; null ids give an empty text."""
    df = public(df, text)
    sent = df.sparkSession.sparkContext.broadcast(Model.load(model_path).plain())
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        codec = _codec(sent.value)
        for part in slices(batches, ids):
            found = [codec.decode(x or ()) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


@keeps_names
def summary(df: DataFrame, model_path: str = MODEL, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with ids, n_ids, ids_crc32 (of the ids as 32-bit little-endian numbers)
    and round_trip: whether decoding the ids gives the text again (null: the empty text)."""
    added = ["ids", "n_ids", "ids_crc32", "round_trip"]
    df = public(df, *added)
    names = [c for c in df.columns if c != text]
    sent = df.sparkSession.sparkContext.broadcast(Model.load(model_path).plain())
    schema = df.select(*[f"`{c}`" for c in names]).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "long").add("ids_crc32", "long").add("round_trip", "boolean")

    def run(batches):
        codec = _codec(sent.value)
        for part in slices(batches, text):
            texts = part.column(text).to_pylist()
            found = codec.encode_all(texts)
            cols = [
                pa.array(found, pa.list_(pa.int32())), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in found], pa.int64()),
                pa.array([codec.decode(x.tolist()) == (t or "") for x, t in zip(found, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *cols], names=schema.names)

    return df.select(*[f"`{c}`" for c in names], text).mapInArrow(run, schema)

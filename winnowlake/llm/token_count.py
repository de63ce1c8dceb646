"""Token counts by a compiled finite-state transducer (operator 9).

The transducer reads code points and keeps, on every transition, by how much the number of tokens of
the text so far changes. Its states are what the future of a merge-type segmentation can depend on:
each start of an open piece (a node of the piece trie) with the last token in front of it and the
token count there, relative to now. A piece t may follow the last token u of a prefix if merging the
string u + t gives back u and t; exactly one piece does, so the machine is deterministic. A word mark
after anything but a mark always begins a new token, so the state there is known whatever came
before. States and transitions are compiled when first met and kept by the worker.

A text is cut into chunks of CHUNK code points. All chunks run in lock step, vectorised: from the
first synchronising mark on, a chunk's end state and count do not depend on how it was entered, so
its state map is constant there and the next chunk's entry state is known. Chunks without such a mark
(texts without white space) have maps from the entry states that may be live to (exit state, count);
these are composed through a parallel prefix scan, and widened until it goes through. A text's count
is the sum over its chunks.

Defined cases: a null or empty text has no tokens; texts of any length are read whole; special
strings inside texts are ordinary text; repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, mapped, slices, texts_of, tokenizer_path
from .piece_bpe import MARK, MODEL, PieceBpe

#: Code points of a chunk.
CHUNK = 512
#: Code points in front of a chunk that its likely entry state is taken from.
WARM = 96
#: States and transitions a worker keeps; beyond that it starts anew.
MOST_STATES, TABLE_BITS = 1_500_000, 23

_START = 0  # in front of a word mark: at the start of a text or after anything but a mark
_RUN = 16  # longest run of marks that is one piece; states 1.._RUN have read as many of a run, modulo _RUN


class Transducer:
    def __init__(self, path: str):
        self.bpe = PieceBpe(path)
        pieces = self.bpe.pieces
        chars = sorted({c for p in pieces for c in p})
        self.chars = [None, None, None, None, None, *chars]  # 1..4: unknown code points, by their UTF-8 bytes
        top = 0x110000
        self.classes = np.full(top, 4, np.int64)
        self.classes[:0x10000], self.classes[:0x800], self.classes[:0x80] = 3, 2, 1
        self.classes[[ord(c) for c in chars]] = np.arange(5, 5 + len(chars))
        self.mark = self.classes[ord(MARK)]
        self.nodes: dict[tuple[int, str], int] = {}
        self.inner: set[int] = set()
        for p in pieces:
            if set(p) != {MARK}:
                at = 0
                for c in p:
                    self.inner.add(at)
                    at = self.nodes.setdefault((at, c), len(self.nodes) + 1)
        self.string = [""] * (len(self.nodes) + 1)
        for (at, c), to in sorted(self.nodes.items(), key=lambda x: x[1]):
            self.string[to] = self.string[at] + c
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # marks are joined last, among themselves; the count for a run is periodic
        self.marks = [0, *(len(self.bpe.agenda(MARK * n)) for n in range(1, 4 * _RUN))]
        if any(self.marks[n + _RUN] != self.marks[n] + 1 for n in range(1, 3 * _RUN)):
            raise ValueError("runs of word marks are cut in another way")
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple | None] = [None] * (1 + _RUN)
        self.ids: dict[tuple, int] = {}
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.to = np.zeros(1 << TABLE_BITS, np.int32)
        self.add = np.zeros(1 << TABLE_BITS, np.int8)
        self.filled = 0

    def release(self) -> None:
        self.states, self.ids, self.keys, self.to, self.add = [], {}, None, None, None

    def piece(self, s: str) -> bool:
        """Whether s stays one symbol when it is merged alone."""
        if (ok := self.whole.get(s)) is None:
            p = self.bpe.pieces.get(s)
            ok = self.whole[s] = len(s) == 1 or (p is not None and self.bpe.agenda(s) == [p[1]])
        return ok

    def cost(self, s: str) -> int:
        return 1 if s in self.bpe.pieces else len(s.encode())

    def follows(self, u: str | None, t: str) -> bool:
        if u is None:
            return True
        if (ok := self.pairs.get((u, t))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[u, t] = self.bpe.agenda(u + t) == self.alone(u) + self.alone(t)
        return ok

    def alone(self, s: str) -> list[int]:
        """The ids of a symbol that stays one: its own, or its bytes."""
        p = self.bpe.pieces.get(s)
        return [p[1]] if p else [self.bpe.bytes[b] for b in s.encode()]

    def compile(self, state: int, cls: int) -> tuple[int, int]:
        """Next state and change of the count."""
        if cls == self.mark:
            if 1 <= state <= _RUN:
                return state % _RUN + 1, self.marks[state + 1] - self.marks[state]
            return 1, 1
        if state == _START:
            starts = ((0, None, 0),)
        elif state <= _RUN:  # the last mark may begin a piece or stay with the run
            starts = ((self.nodes[0, MARK], None, self.marks[state - 1] - self.marks[state]), (0, MARK, 0))
        else:
            starts = self.states[state]
        if cls < 5:
            return self.state(((0, None, 0),)), cls
        c = self.chars[cls]
        last, count, alive = None, None, []
        for node, u, n in starts:  # longest first
            to = self.nodes.get((node, c)) if node in self.inner else None
            s = self.string[node] + c
            if last is None and self.piece(s) and (s in self.bpe.pieces or len(s) == 1) and self.follows(u, s):
                last, count = s, n + self.cost(s)
            if to is not None and to in self.inner:
                alive.append((to, u, n))
        assert last is not None
        alive = [(to, u, n - count) for to, u, n in alive]
        return self.state((*alive, (0, last, 0))), count

    def state(self, key: tuple) -> int:
        if (k := self.ids.get(key)) is None:
            k = self.ids[key] = len(self.states)
            self.states.append(key)
        return k

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def step(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states * 65536 + classes
        at = self.slot(keys)
        got = self.keys[at]
        if not (got == keys).all():
            todo = np.flatnonzero(got != keys)
            while len(todo):
                empty = self.keys[at[todo]] == -1
                if empty.any():
                    new = np.unique(keys[todo[empty]])
                    for key, slot in zip(new.tolist(), self.slot(new).tolist(), strict=True):
                        self.insert(key, slot)
                    todo = todo[self.keys[at[todo]] != keys[todo]]
                    continue
                at[todo] = (at[todo] + 1) & ((1 << TABLE_BITS) - 1)
                todo = todo[self.keys[at[todo]] != keys[todo]]
        return self.to[at], self.add[at]

    def insert(self, key: int, at: int) -> None:
        to, add = self.compile(key >> 16, key & 65535)
        while (k := self.keys[at]) != -1:
            if k == key:
                return
            at = (at + 1) & ((1 << TABLE_BITS) - 1)
        self.keys[at], self.to[at], self.add[at] = key, to, add
        self.filled += 1

    def run(self, classes: np.ndarray, lo: np.ndarray, hi: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run the spans [lo, hi) of classes in lock step; end states and changes of the count."""
        order = np.argsort(lo - hi, kind="stable")
        at, left = lo[order], (hi - lo)[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(lo), np.int64)
        active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")  # spans longer than each step
        for k, n in enumerate(active.tolist()):
            to, add = self.step(state[:n], classes[at[:n] + k])
            state[:n] = to
            count[:n] += add
        ends, counts = np.empty_like(state), np.empty_like(count)
        ends[order], counts[order] = state, count
        return ends, counts

    def composed(self, classes: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Changes of the count over chunks that must be entered as the chunk in front is left; `before` is
        that state where it is known already (the first of a row of such chunks), and -1 elsewhere.

        Each chunk has a map from entry states to (exit state, count) over the states that may be live there:
        the one that WARM code points in front lead to at first. A scan composes the maps; where a chunk is left
        in a state that the next one's map lacks, that is put in, until the scan goes through.
        """
        n, head = len(lo), before >= 0
        chain = np.cumsum(head) - 1
        begin = np.flatnonzero(head)[chain]
        guess, _ = self.run(classes, np.maximum(lo - WARM, 0), lo, np.zeros(n, np.int64))
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in range(n)]
        wanted = {(k, int(s)) for k, s in enumerate(np.where(head, before, guess))}
        for again in range(n + 1):
            at = np.array(sorted(wanted), np.int64).reshape(-1, 2)
            ends, adds = self.run(classes, lo[at[:, 0]], hi[at[:, 0]], at[:, 1])
            for k, s, e, c in zip(*at.T.tolist(), ends.tolist(), adds.tolist(), strict=True):
                maps[k][s] = e, c
            width = max(map(len, maps))
            place = [{s: c for c, s in enumerate(m)} for m in maps]
            nxt, cnt, state = (np.full((n, width), -1, np.int64) for _ in range(3))
            for k, m in enumerate(maps):
                follow = place[k + 1] if k + 1 < n and not head[k + 1] else {}
                for c, (e, add) in enumerate(m.values()):
                    nxt[k, c], cnt[k, c], state[k, c] = follow.get(e, -1), add, e
            through = scanned(nxt, head)
            entry = np.array([place[k][int(before[k])] for k in begin.tolist()], np.int64)  # of the first of its row
            pos = np.where(head, entry, through[np.arange(n) - 1, entry])
            if (pos >= 0).all():
                return cnt[np.arange(n), pos]
            # what chunks with a map are left in, and, from the second time on, what the last one that is reached
            # is left in for all behind it: a repeated character keeps its states over any distance
            open_ = np.flatnonzero(pos < 0)
            wanted = {(k, e) for k in open_.tolist() for e, _ in maps[k - 1].values() if e not in maps[k]}
            if again:
                for k in open_[pos[open_ - 1] >= 0].tolist():
                    e = int(state[k - 1, pos[k - 1]])
                    wanted |= {(x, e) for x in open_[(open_ >= k) & (chain[open_] == chain[k])].tolist() if e not in maps[x]}
        raise AssertionError("each time one chunk more is reached at least")

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        claim(self, self.release)
        if self.keys is None or len(self.states) > MOST_STATES or self.filled > (1 << TABLE_BITS) // 2:
            self.clear()
        out = np.zeros(len(texts), np.int64)
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        classes = self.classes[np.frombuffer("".join([" " + texts[k] for k in full]).replace(" ", MARK).encode("utf-32-le"), np.uint32)]
        size = np.fromiter((len(texts[k]) + 1 for k in full), np.int64, len(full))
        begin = np.cumsum(size) - size
        marks = classes == self.mark
        sync = marks.copy()
        sync[1:] &= ~marks[:-1]
        sync[begin] = True
        n = -(-size // CHUNK)
        text = np.repeat(np.arange(len(full)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        lo = begin[text] + k * CHUNK
        hi = np.minimum(lo + CHUNK, (begin + size)[text])
        at = np.flatnonzero(sync)
        first = at[np.minimum(np.searchsorted(at, lo), len(at) - 1)]
        first = np.where((first >= lo) & (first < hi), first, hi)  # where the chunk's map becomes constant
        const = first < hi
        total = np.zeros(len(lo), np.int64)
        exits = np.full(len(lo), -1, np.int64)
        exits[const], total[const] = self.run(classes, first[const], hi[const], np.zeros(int(const.sum()), np.int64))
        rest = np.flatnonzero(first > lo)  # never the first chunk of a text: that begins with a mark
        known = const[rest - 1]
        now, todo = rest[known], rest[~known]
        end, add = self.run(classes, lo[now], first[now], exits[now - 1])
        total[now] += add
        exits[now] = np.where(const[now], exits[now], end)
        if len(todo):
            total[todo] += self.composed(classes, lo[todo], first[todo], exits[todo - 1])
        out[full] = np.bincount(text, weights=total, minlength=len(full)).astype(np.int64)
        return out


def scanned(nxt: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Parallel prefix scan: the composition, from the first of its row (head) to each chunk, of the maps
    nxt[chunk, entry of the chunk] = entry of the next chunk (-1: none), in as many steps as the longest row
    has binary digits."""
    through = nxt.copy()
    far = np.arange(len(nxt)) - np.maximum.accumulate(np.where(head, np.arange(len(nxt)), 0))
    step = 1
    while (rows := np.flatnonzero(far >= step)).size:
        first, then = through[rows - step], through[rows]
        through[rows] = np.where(first >= 0, np.take_along_axis(then, np.maximum(first, 0), 1), -1)
        step *= 2
    return through


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """id, n_bytes and n_tokens of every row."""
    path = path or tokenizer_path(MODEL)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi, _, offs in slices(texts, slice_bytes):
                n = m.counts(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return mapped(rows, run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long", keeps=True)


def op9(spark, sf_dir: str, limit: int = 4096) -> DataFrame:
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

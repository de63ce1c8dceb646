"""Merge-type SentencePiece encoding and decoding (operator 3) by a score-ordered agenda.

A chunk is a run of word marks and what follows up to the next mark. No piece of the vocabularies
taken here stands over a chunk's end (checked when loading), so merges never cross it and chunks
can be encoded one by one. The agenda holds the adjacent symbol pairs whose join is a piece, highest
score first, leftmost first among equals: a heap for long chunks, and for the many short ones arrays
in which all chunks of a slice take the best pair of their agenda in lock step. Workers remember
chunks; every chunk that is encoded is checked against the sentencepiece library, all new chunks of
an Arrow slice in one call, and one whole text of WHOLE is. A difference is an error: no ids but the
agenda's are ever returned.

Defined cases: a null or empty text has no ids and decodes to the empty text; texts of any length
are processed whole; repeated rows give equal rows; there are no ties (of pairs with equal scores the
leftmost is joined first, as the library does); only the id and text columns are read, so columns of
any other name do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashTable, claim, mapped, slices, texts_of, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Chunks a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 300_000, 64
#: Code points of chunks that are encoded in lock step, by upper bounds of their length.
LENGTHS = (6, 9, 12, 16, 24, 32, 48)
#: One text of so many, by its checksum, is also encoded whole by the library and compared.
WHOLE = 64

_NONE = np.iinfo(np.int64).max
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class PieceBpe:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is asked for")
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model without normalisation, with a word mark in front, is asked for")
        kind = model.SentencePiece
        self.pieces = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(p.type == kind.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("a piece crosses a word mark")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # what the memo held before it began anew
        self.decimal = [str(i) for i in range(self.library.vocab_size())]
        self._compile()

    def _compile(self) -> None:
        """Symbols as numbers: pieces, then code points that only occur inside pieces."""
        extra = sorted({c for p in self.pieces for c in p} - set(self.pieces))
        self.symbol = {p: k for k, p in enumerate([*self.pieces, *extra])}
        self.symbol_id = np.array([i for _, i in self.pieces.values()] + [-1] * len(extra), np.int32)
        self.point = np.full(0x110000, -1, np.int32)
        for p, k in self.symbol.items():
            if len(p) == 1:
                self.point[ord(p)] = k
        rank = {x: k for k, x in enumerate(sorted({x for x, _ in self.pieces.values()}))}
        get = self.symbol.get
        joins = [(get(p[:k]), get(p[k:]), rank[x], get(p)) for p, (x, _) in self.pieces.items() for k in range(1, len(p))]
        joins = np.array([j for j in joins if j[0] is not None and j[1] is not None], np.int64)
        self.joins = HashTable((joins[:, 0] << 32 | joins[:, 1]).astype(np.uint64), joins[:, 2] << 32 | joins[:, 3])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (high) and symbol (low) of the join of a and b; the largest number if there is none."""
        found, value = self.joins.find((a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64))
        return np.where(found & (a >= 0) & (b >= 0), value, _NONE)

    def lock_step(self, chunks: list[str]) -> list[list[int]]:
        """agenda() of many chunks of up to LENGTHS[-1] code points, all at once."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.cumsum(size) - size
        final = np.full(len(points), -2, np.int64)  # symbol at the place of its first code point; -2: none
        low = 0
        for top in LENGTHS:
            rows = np.flatnonzero((size > low) & (size <= top))
            low = top
            if not len(rows):
                continue
            at = np.arange(top)[None, :]
            inside = at < size[rows, None]
            where = np.minimum(begin[rows, None] + at, len(points) - 1)
            sym = np.where(inside, self.point[points[where]], -2).astype(np.int64)
            place = where.copy()
            pair = np.full((len(rows), top), _NONE, np.int64)
            pair[:, :-1] = self._pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(rows), -1)
            while len(sym):
                best = (pair >> 32).argmin(axis=1)
                row = np.arange(len(sym))
                value = pair[row, best]
                open_ = value != _NONE
                if not open_.all():
                    done = ~open_
                    keep = sym[done] != -2
                    final[place[done][keep]] = sym[done][keep]
                    sym, place, pair, best, value = sym[open_], place[open_], pair[open_], best[open_], value[open_]
                    row = np.arange(len(sym))
                if not len(sym):
                    break
                sym[row, best] = value & 0xFFFFFFFF
                take = np.minimum(at + (at > best[:, None]), top - 1)
                sym, place, pair = (np.take_along_axis(x, take, 1) for x in (sym, place, pair))
                sym[:, -1], pair[:, -1] = -2, _NONE
                pair[row, best] = self._pairs(sym[row, best], sym[row, np.minimum(best + 1, top - 1)])
                left = best > 0
                pair[row[left], best[left] - 1] = self._pairs(sym[row[left], best[left] - 1], sym[row[left], best[left]])
        at = np.flatnonzero(final != -2)
        ids = np.where(final[at] >= 0, self.symbol_id[final[at]], -1)
        cut = np.searchsorted(at, np.append(begin, len(points))).tolist()
        if (ids >= 0).all():
            flat = ids.tolist()
            return [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        out, points = [], points[at]
        odd = set(np.searchsorted(cut, np.flatnonzero(ids < 0), "right").tolist())
        flat = ids.tolist()
        for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True), 1):
            if k not in odd:
                out.append(flat[x:y])
                continue
            one = []
            for i, p in zip(flat[x:y], points[x:y].tolist(), strict=True):
                if i >= 0:
                    one.append(i)
                else:  # what is no piece is a single code point and stands for its bytes
                    one.extend(self.bytes[b] for b in chr(p).encode())
            out.append(one)
        return out

    def agenda(self, chunk: str) -> list[int]:
        """The ids of a chunk."""
        pieces = self.pieces
        sym: list[str | None] = list(chunk)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(p[0], k, sym[k] + sym[k + 1]) for k in range(n - 1) if (p := pieces.get(sym[k] + sym[k + 1]))]
        heapify(pairs)
        while pairs:
            _, k, piece = heappop(pairs)
            left = sym[k]
            if left is None or (j := nxt[k]) >= n or len(left) + len(sym[j]) != len(piece) or left + sym[j] != piece:
                continue
            sym[k], sym[j] = piece, None
            nxt[k] = m = nxt[j]
            if m < n:
                prv[m] = k
                if p := pieces.get(both := piece + sym[m]):
                    heappush(pairs, (p[0], k, both))
            if (m := prv[k]) >= 0 and (p := pieces.get(both := sym[m] + piece)):
                heappush(pairs, (p[0], m, both))
        out: list[int] = []
        for s in sym:
            if s is not None:
                if p := pieces.get(s):
                    out.append(p[1])
                else:
                    out.extend(self.bytes[b] for b in s.encode())
        return out

    def learn(self, new: list[str]) -> None:
        """Encode chunks and check them. A key is the chunk without its mark, or a chunk of several marks."""
        right = self.library.encode([k[1:] if k.startswith(MARK) else k for k in new])
        chunks = [k if k.startswith(MARK) else MARK + k for k in new]
        ids: list[list[int]] = [[]] * len(new)
        short = [k for k, c in enumerate(chunks) if len(c) <= LENGTHS[-1]]
        for k, x in zip(short, self.lock_step([chunks[k] for k in short]), strict=True):
            ids[k] = x
        for k, c in enumerate(chunks):
            if len(c) > LENGTHS[-1]:
                ids[k] = self.agenda(c)
        if ids != right:
            for k, key in enumerate(new):  # the library gives the empty text no ids; an empty chunk is a lone mark
                if key and ids[k] != right[k]:
                    raise ValueError(f"the agenda gives {ids[k]} for {key!r}, the library {right[k]}")
        self.memo.update(zip(new, map(tuple, ids), strict=True))

    @staticmethod
    def keys(text: str) -> list[str]:
        """The chunks of a text, as learn() takes them."""
        if not text:
            return []
        parts = text.split(" ")
        if MARK not in text and "" not in parts:
            return parts
        found = _CHUNK.findall(MARK + text.replace(" ", MARK))
        return [k if k.startswith(MARK * 2) else k[1:] for k in found]

    def clear(self) -> None:
        self.memo, self.older = {}, {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of every text."""
        claim(self, self.clear)
        split = [self.keys(t) for t in texts]
        used = set(chain.from_iterable(split))
        if len(self.memo) > MEMO // 2:  # begins anew; what is met again moves over, the rest goes the next time
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = used.difference(memo)
        if older:
            known = new.intersection(older)
            memo.update((k, older[k]) for k in known)
            new -= known
        self.learn(list(new))
        get = memo.__getitem__
        for keys in split:
            yield list(chain.from_iterable(map(get, keys)))
        for k in new:
            if len(k) > MEMO_CHARS:
                del memo[k]


_models: dict[str, PieceBpe] = {}


def model(path: str) -> PieceBpe:
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id and the asked columns of every row: ids, decoded, n_tokens, ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256."""
    path = path or tokenizer_path(MODEL)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    types = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        make = {
            "ids": lambda ids, _: np.array(ids, np.int32),
            "decoded": lambda _, text: text,
            "n_tokens": lambda ids, _: len(ids),
            "ids_sha256": lambda ids, _: _sha(",".join(map(bpe.decimal.__getitem__, ids))),
            "decoded_sha256": lambda _, text: _sha(text),
        }
        made = [make[c] for c in columns]
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi, _, _ in slices(texts, 1 << 20):
                out: list[list] = [[] for _ in columns]
                part = texts.slice(lo, hi - lo).to_pylist()
                for whole, ids in zip(part, bpe.encode(part), strict=True):
                    if zlib.crc32(whole.encode()) % WHOLE == 0 and bpe.library.encode(whole) != ids:
                        raise ValueError("the agenda's ids of a text are not the library's")
                    text = bpe.library.decode(ids)
                    for column, f in zip(out, made, strict=True):
                        column.append(f(ids, text))
                arrays = [pa.array(x, types[c][1]) for x, c in zip(out, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *arrays], names=["id", *columns])

    schema = f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} {types[c][0]}" for c in columns)
    return mapped(rows, run, schema, keeps=True).withColumnRenamed("id", id_col)


def op3(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))

"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Merges of this model family never cross from a word into the blanks before the next one, so a text
falls into words (blanks and what follows them). All words of a batch that a task has not met
before are merged together: one flat array of symbols, the best pair rank of each word by a
segmented minimum, all leftmost non-overlapping merges at once, then compaction, until no word has
a pair left. Words with tied ranks, or with a piece whose extensions could outrank it, merge one
pair a round, which keeps the order of the reference implementation. Words longer than
``LONG_WORD`` symbols take the same merges from a heap, since rounds would cost their square.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crosswin.llm.tables import text_rows
from crosswin.llm.text import chunks, column_of, list_array

BLANK = "▁"
NONE = np.int32(2**31 - 1)
LONG_WORD = 1024
REMEMBERED_WORDS = 300_000
codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """A BPE model with byte fallback, read from the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kind, norm = sentencepiece_model_pb2.ModelProto.SentencePiece, proto.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if not plain or norm.precompiled_charsmap or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave text as it is, with a blank before it, are supported")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal):
            raise ValueError("pieces that end one word and begin the next are not supported")
        self.byte_ids = np.zeros(256, np.int32)
        written = []  # bytes of every piece
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                written.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kind.UNKNOWN:
                written.append(proto.trainer_spec.unk_surface.encode())
            else:
                written.append(p.piece.replace(BLANK, " ").encode() if p.type == kind.NORMAL else b"")
        self.control = np.array([p.type == kind.CONTROL for p in proto.pieces])
        self.blank_first = np.array([p.type == kind.NORMAL and p.piece.startswith(BLANK) for p in proto.pieces])
        self.out_bytes = np.frombuffer(b"".join(written), np.uint8)
        self.out_offset = np.concatenate([[0], np.cumsum([len(x) for x in written], dtype=np.int64)])

        scores = sorted({proto.pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        ranks = {p: rank[proto.pieces[i].score] for p, i in normal.items()}
        shared = np.bincount(list(ranks.values()), minlength=len(scores)) > 1
        singles = sorted((ord(p), i) for p, i in normal.items() if len(p) == 1)
        self.code_points = np.array([c for c, _ in singles], np.uint32)
        self.code_ids = np.array([i for _, i in singles], np.int32)
        self.size = len(proto.pieces)
        self.rank = np.full(self.size, NONE, np.int32)
        alone = {p for p in normal if shared[ranks[p]]}  # these merge one at a time
        pairs = []
        for p, i in normal.items():
            self.rank[i] = ranks[p]
            for k in range(1, len(p)):
                if p[:k] in normal and p[k:] in normal:
                    pairs.append((normal[p[:k]] * self.size + normal[p[k:]], i))
                    alone.update(x for x in (p[:k], p[k:]) if len(x) > 1 and ranks[x] >= ranks[p])
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.pair_ids = np.array([i for _, i in pairs] + [-1], np.int32)
        self.one_by_one = np.zeros(self.size, bool)
        self.one_by_one[[normal[p] for p in alone]] = True
        self.split = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        at = np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), at, len(self.pair_ids) - 1)
        return self.pair_ids[at]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of single characters (or -1 - code point) and word lengths."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.code_points, points), len(self.code_points) - 1)
        known = self.code_points[at] == points
        return np.where(known, self.code_ids[at], -1 - points.astype(np.int64)).astype(np.int32), np.array([len(w) for w in words])

    def merge_rounds(self, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, flat, and their number per word."""
        n_words = len(lengths)
        word = np.repeat(np.arange(n_words), lengths)
        done_word, done_sym = [], []
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.empty(0, bool)
        made = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(~last)
        made[inner] = self.merged(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            alive = np.repeat(best != NONE, size)
            if not alive.all():
                done_word.append(word[~alive])
                done_sym.append(sym[~alive])
                best, size = best[best != NONE], size[best != NONE]
                sym, word, last, made, rank = (x[alive] for x in (sym, word, last, made, rank))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            run = np.append(True, at[1:] != at[:-1] + 1)
            in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            at = at[np.where(self.one_by_one[made[at]], lead, in_run % 2 == 0)]
            if (mixed := self.one_by_one[made[at]]).any():  # a tie of a bulk and a single merge: the leftmost alone
                lead = np.append(True, word[at[1:]] != word[at[:-1]])
                tied = np.zeros(n_words, bool)
                tied[word[at[mixed]]] = True
                at = at[lead | ~tied[word[at]]]
            sym[at] = made[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            sym, word, last, made = (x[keep] for x in (sym, word, last, made))
            before = new[new > 0] - 1
            touched = np.concatenate([new, before])
            made[touched] = -1
            touched = touched[~last[touched]]
            made[touched] = self.merged(sym[touched], sym[touched + 1])
        if not done_word:
            return np.empty(0, np.int32), np.zeros(n_words, np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=n_words)

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same merges for one long word, from a heap of (rank, place)."""
        sym, n = sym.tolist(), len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        table = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist()))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0:
                piece = table.get(sym[i] * self.size + sym[j], -1)
                if piece >= 0:
                    heapq.heappush(heap, (int(self.rank[piece]), i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != left or sym[j] != right:
                continue
            sym[i] = table[left * self.size + right]
            gone[j] = 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return np.array([s for s, g in zip(sym, gone) if not g], np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode words not met before and remember their ids."""
        sym, lengths = self.symbols(words)
        ends = np.cumsum(lengths)
        long = np.flatnonzero(lengths > LONG_WORD)
        short = np.repeat(lengths <= LONG_WORD, lengths)
        flat, count = self.merge_rounds(sym[short], np.where(lengths <= LONG_WORD, lengths, 0))
        if len(long):
            cuts = np.concatenate([[0], np.cumsum(count)])
            parts = [flat[cuts[i]:cuts[i + 1]] for i in range(len(words))]
            for i in long:
                parts[i] = self.merge_long(sym[ends[i] - lengths[i]:ends[i]])
                count[i] = len(parts[i])
            flat = np.concatenate(parts)
        strange = np.flatnonzero(flat < 0)
        if len(strange):  # characters without a piece become the bytes of their UTF-8 form
            points, which = np.unique(-1 - flat[strange], return_inverse=True)
            spelled = [self.byte_ids[list(chr(p).encode())] for p in points]
            width = np.ones(len(flat), np.int64)
            width[strange] = np.array([len(x) for x in spelled])[which]
            place = np.cumsum(width) - width
            ids = np.zeros(int(width.sum()), np.int32)
            ids[place[flat >= 0]] = flat[flat >= 0]
            for k in range(4):
                has = np.array([len(x) > k for x in spelled])[which]
                kth = np.array([x[k] if len(x) > k else 0 for x in spelled], np.int32)
                ids[place[strange[has]] + k] = kth[which[has]]
            cuts = np.concatenate([[0], np.cumsum(count)])
            total = np.concatenate([[0], np.cumsum(width)])
            count, flat = np.diff(total[cuts]), ids
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end of every text, flat, and offsets."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words.extend(self.split.findall(BLANK + text.replace(" ", BLANK)))
            ends.append(len(words))
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        fresh = list(dict.fromkeys(w for w in words if w not in self.known))
        if fresh:
            self.learn(fresh)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        count = self.count[index]
        upto = np.concatenate([[0], np.cumsum(count)])
        inner = upto[np.array(ends)]
        ids = self.flat[np.repeat(self.start[index] - upto[:-1], count) + np.arange(upto[-1])]
        n = len(texts)
        offset = inner + 2 * np.arange(n + 1)
        out = np.empty(int(offset[-1]), np.int32)
        out[offset[:-1]], out[offset[1:] - 1] = self.bos, self.eos
        out[np.arange(len(ids)) + 2 * np.repeat(np.arange(n), np.diff(inner)) + 1] = ids
        return out, offset

    def decode(self, ids: np.ndarray, offset: np.ndarray) -> list[str]:
        """Texts of id sequences; control ids are silent, the blank put before a text goes."""
        real = ~self.control[ids]
        upto = np.concatenate([[0], np.cumsum(real)])[offset]
        ids = ids[real]
        size = np.diff(self.out_offset)[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        data = self.out_bytes[np.repeat(self.out_offset[:-1][ids] - place[:-1], size) + np.arange(place[-1])].tobytes()
        out = []
        for a, b in zip(upto[:-1], upto[1:]):
            skip = 1 if b > a and self.blank_first[ids[a]] else 0
            out.append(data[place[a] + skip:place[b]].decode("utf-8", "each-byte"))
        return out


_LOADED: dict[bytes, PieceCodec] = {}  # one model per worker process


def codec(model: bytes) -> PieceCodec:
    mark = hashlib.sha256(model).digest()
    if mark not in _LOADED:
        _LOADED.clear()
        _LOADED[mark] = PieceCodec(model)
    return _LOADED[mark]


def read_model(path: str) -> bytes:
    """The model's bytes, which travel with the job; executors need no file."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>), one row per document, with begin and end ids.

    A null or empty text gives the begin and end ids alone. Rows are independent: repeated
    rows repeat, null doc_ids stay null, an empty table gives none, other columns don't matter.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, offset = codec(model).encode(column_of(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(pa.array(ids), offset)], ["doc_id", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null or empty list gives an empty text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            offset = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            flat = np.array([i for x in lists for i in x], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec(model).decode(flat, offset), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass.

    ids_sha256 is taken over ids as little-endian unsigned 32-bit integers; see encode_documents.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, offset = codec(model).encode(column_of(batch, "text").to_pylist())
            raw = ids.astype("<u4").tobytes()
            sums = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(offset[:-1], offset[1:])]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in codec(model).decode(ids, offset)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offset), pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

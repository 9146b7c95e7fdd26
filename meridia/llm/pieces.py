"""SentencePiece encoding and decoding by the Viterbi algorithm over given pieces.

One Aho-Corasick automaton holds all pieces. It reads a segment once; at each end
its output links give every piece that ends there, and each relaxes the best score
of that position. Characters that no path covers become byte pieces. No piece holds
a space mark after another character, nor a line feed, so texts are cut there without
changing the best path: each distinct token of a batch is encoded once, and its ids are
kept for the next batch. Both directions are then Arrow takes over a batch.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import accumulate
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import parts, tokenizer_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED, LONGEST_REMEMBERED = 300_000, 48
#: bytes of text that are worked on at once; a longer text is one part
PART = 4 << 20


@lru_cache(maxsize=2)
def load_model(path: str) -> tuple:
    """(piece, score, type) of each id; read on the driver and sent to the executors (0.5 MB)."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only identity normalisation with a dummy prefix is supported")
    return tuple((p.piece, p.score, p.type) for p in model.pieces)


class _Kept(dict):
    """Ids by token, packed as int32; forgets all when full, so memory is bounded."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, token):
        got = self.make(token)
        if len(token) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = got
        return got


class Pieces:
    """Encoder and decoder for a list of (piece, score, type)."""

    NORMAL, BYTE = 1, 6

    def __init__(self, pieces: tuple):
        self.automaton = ahocorasick.Automaton()
        self.byte_ids, self.raw, low = {}, [], 0.0
        self.single, self.length = set(), {}
        for i, (piece, score, kind) in enumerate(pieces):
            self.raw.append(b"")
            if kind == self.NORMAL:
                self.automaton.add_word(piece, (len(piece), score, i))
                self.length[i] = len(piece)
                if len(piece) == 1:
                    self.single.add(piece)
                self.raw[i] = piece.replace(MARK, " ").encode()
                low = min(low, score)
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError("a piece crosses a word's or line's end")
            elif kind == self.BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
        self.automaton.make_automaton()
        self.unknown = low - UNKNOWN_PENALTY
        self.kept = _Kept(self._token)
        self.bytes_of_id = pa.array(self.raw + [x.removeprefix(b" ") for x in self.raw], pa.large_binary())
        self.size_of_id = np.array([len(x) for x in self.raw])

    def _bytes(self, text: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in text.encode()]).tobytes()

    def _pack(self, segment: str) -> bytes:
        if self.single.issuperset(segment):
            return array("i", self._known(segment)).tobytes()
        return b"".join(array("i", [i]).tobytes() if i >= 0 else self._bytes(c) for i, c in self.viterbi(segment))

    def _known(self, s: str) -> list[int]:
        """The best path's ids where every character has a piece, so that every position is reached."""
        best, back = [0.0] + [-inf] * len(s), [None] * (len(s) + 1)
        for end, piece in self.automaton.iter(s):
            end += 1
            got = best[end - piece[0]] + piece[1]
            if got > best[end]:
                best[end], back[end] = got, piece
        out, at = [], len(s)
        while at:
            piece = back[at]
            out.append(piece[2])
            at -= piece[0]
        out.reverse()
        return out

    def viterbi(self, s: str) -> list[tuple[int, str]]:
        """The best path as (id, text); -1 where a character has no piece. Of equal
        scores the longer last piece wins."""
        if self.single.issuperset(s):
            ids = self._known(s)
            ends = list(accumulate(self.length[i] for i in ids))
            return [(i, s[b - self.length[i] : b]) for i, b in zip(ids, ends)]
        n = len(s)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        done, unknown = 0, self.unknown
        single = [False] * n

        def settle(to):
            # positions before ``to`` have all their pieces: characters without one are unknown
            nonlocal done
            while done < to:
                if not single[done]:
                    got = best[done] + unknown
                    if best[done + 1] is None or got > best[done + 1]:
                        best[done + 1], back[done + 1] = got, (done, -1)
                done += 1

        # pieces that end at one place come longest first, by the output links
        for end, (length, score, i) in self.automaton.iter(s):
            start = end + 1 - length
            settle(end)
            got = best[start] + score
            if best[end + 1] is None or got > best[end + 1]:
                best[end + 1], back[end + 1] = got, (start, i)
            if length == 1:
                single[end] = True
        settle(n)
        out, at = [], n
        while at:
            start, i = back[at]
            out.append((i, s[start:at]))
            at = start
        return out[::-1]

    def _token(self, token: str) -> bytes:
        """The ids of some blanks, then a word or a line feed and the next line's first word.

        A word has a space mark before it and one more for every blank; before a line feed
        the blanks alone are marks. A literal space mark is kept apart from a space: as bytes."""
        if token[:1] not in " \n" and MARK not in token:
            return self._pack(MARK + token)
        word = token.lstrip(" ")
        marks = MARK * (len(token) - len(word))
        if word[:1] == "\n":
            out, lead, word = [self._pack(marks), self._bytes("\n")], "", word[1:]
        else:
            out, lead = [], marks + MARK
        first, *more = word.split(MARK)
        out.append(self._pack(lead + first))
        for part in more:
            out += [self._bytes(MARK), self._pack(part)]
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids as int32, and where each text's begin (one entry more than texts).

        Texts are cut at spaces and before line feeds, and each distinct token of all of
        them is encoded once. Nulls and empty texts have no ids."""
        texts = texts.cast(pa.large_string()).fill_null("")
        # a line feed ends every text, so blanks at an end stand before a token; its id goes again
        cut = pc.binary_join_element_wise(pc.replace_substring(texts, "\n", " \n"), *pa.array([" \n", ""], pa.large_string()))
        lists = pc.split_pattern(cut, " ")
        tokens, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        real = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
        if not real.all():
            place = np.flatnonzero(real)
            blanks = np.diff(place, prepend=-1) - 1
            tokens, at = tokens.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[at]
            some = blanks > 0
            longer = [" " * n + t for n, t in zip(blanks[some].tolist(), tokens.filter(pa.array(some)).to_pylist())]
            tokens = pc.replace_with_mask(tokens, pa.array(some), pa.array(longer, tokens.type))
        coded = tokens.dictionary_encode()
        packed = [self.kept[t] for t in coded.dictionary.to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
        known = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        lists = known.take(coded.indices)
        ids = lists.flatten().to_numpy()
        at = (lists.offsets.to_numpy() - lists.offsets[0].as_py())[at]
        keep = np.ones(len(ids), bool)
        keep[at[1:] - 1] = False
        for i in np.flatnonzero(pc.equal(texts, "").to_numpy(zero_copy_only=False)).tolist():
            keep[at[i] : at[i + 1]] = False
        return ids[keep], np.concatenate([[0], np.cumsum(keep)])[at]

    def decode(self, ids: pa.Array, at: np.ndarray) -> pa.Array:
        """The texts of some ids, those of each text from ``at``: the dummy prefix goes, byte
        pieces join as UTF-8, invalid UTF-8 becomes replacement characters."""
        ids = np.array(ids.to_numpy(zero_copy_only=False), np.int64)
        some = np.append(np.flatnonzero(self.size_of_id[ids]), len(ids))
        first = some[np.searchsorted(some, at[:-1])]
        # the second half of the table lacks a leading space
        ids[first[first < at[1:]]] += len(self.raw)
        got = self.bytes_of_id.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1] if len(got) else np.zeros(1, np.int64)
        texts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[at])), got.buffers()[2] or pa.py_buffer(b"")])
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())


_made: dict = {}


def _pieces(model: tuple) -> Pieces:
    key = (len(model), hash(model))
    if key not in _made:
        _made.clear()
        _made[key] = Pieces(model)
    return _made[key]


def encode(df: DataFrame, text_col: str = "text", model_path: str | None = None, verify: bool = False) -> DataFrame:
    """df with token_ids array<int>, n_tokens long, and with ``verify`` round_trip boolean
    (does decoding give the text back?). Columns of those names are replaced.

    A null text has null ids, tokens and round trip; an empty text has no ids. Rows are
    encoded where they stand, each on its own: repeated rows get the same result each, an
    empty table gives an empty one, and there is no shuffle.
    """
    added = ["token_ids", "n_tokens"] + ["round_trip"] * verify
    df = df.select(*[c for c in df.columns if c not in added])
    model = df.sparkSession.sparkContext.broadcast(load_model(model_path or tokenizer_path()))
    place = df.columns.index(text_col)

    def run(batches):
        pieces = _pieces(model.value)
        for b in (part for whole in batches for part in parts(whole, place, PART)):
            texts = b.column(place)
            ids, at = pieces.encode(texts)
            null = texts.is_null()
            sizes = pc.if_else(null, pa.scalar(None, pa.int64()), pa.array(np.diff(at), pa.int64()))
            cols = [*b.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids), mask=null), sizes]
            if verify:
                cols.append(pc.equal(pieces.decode(pa.array(ids), at), texts.cast(pa.large_string())))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *added])
        pieces.kept.clear()  # the worker may serve another operator next

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, token_ids array<int>, n_tokens long" + ", round_trip boolean" * verify)


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "text", model_path: str | None = None) -> DataFrame:
    """df with out_col, the text of its ids (null for null; a null among ids is no text).
    A column of that name is replaced."""
    df = df.select(*[c for c in df.columns if c != out_col])
    model = df.sparkSession.sparkContext.broadcast(load_model(model_path or tokenizer_path()))
    place = df.columns.index(ids_col)

    def run(batches):
        pieces = _pieces(model.value)
        for b in batches:
            lists = b.column(place)
            real = np.concatenate([[0], np.cumsum(lists.flatten().is_valid().to_numpy(zero_copy_only=False))])
            at = real[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])]
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), pieces.decode(pc.drop_null(lists.flatten()), at))
            yield pa.RecordBatch.from_arrays([*b.columns, texts.cast(pa.string())], names=[*b.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out_col}` string")

"""Exact subword encoding of long texts by their distinct pieces."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8
from .shingles import mix, powers

#: Pieces whose ids a worker remembers and slots of its table of their hashes, ids it holds, and
#: bytes of text that are looked up at once: some 60 MB a worker, however much text passes.
REMEMBERED, TABLE, HELD_IDS, BLOCK = 1 << 20, 1 << 21, 1 << 23, 1 << 20
#: Bytes given to the library at once, and bytes in which a long text is searched for a place to cut.
BATCH_BYTES, NEAR = 1 << 18, 1 << 13
_loaded: dict[str, "LibraryEncoder"] = {}

# Classes of bytes. UNKNOWN may be anything; OTHER is no ASCII and no white space, a letter or not.
UNKNOWN, LETTER, DIGIT, MARK, BLANK, BREAK, OTHER = range(7)
_CLASS = np.full(256, UNKNOWN, np.uint8)
_CLASS[33:127], _CLASS[128:] = MARK, OTHER
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = DIGIT, LETTER, LETTER
_CLASS[9:14], _CLASS[32] = BREAK, BLANK
#: [a, b]: whether a pre-token always ends between a byte of class a and one of class b.
_ENDS = np.zeros((7, 7), bool)
for _a, _b in ((LETTER, DIGIT), (DIGIT, LETTER), (LETTER, MARK), (DIGIT, MARK), (MARK, LETTER), (MARK, DIGIT), *((x, y) for x in (LETTER, DIGIT, MARK, OTHER) for y in (BLANK, BREAK)), *((BREAK, y) for y in (LETTER, DIGIT, MARK))):
    _ENDS[_a, _b] = True
_ENDS = _ENDS.ravel()

_rng = np.random.default_rng(424242)
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte; white space beyond ASCII and what may be such is UNKNOWN."""
    cls, n = _CLASS[data], len(data)

    def chars(lead: int, size: int) -> np.ndarray:
        at = np.flatnonzero(data == lead)
        return at[at + size <= n]

    at = chars(0xC3, 2)  # U+00C0 to U+00FF are letters but for two signs
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    cls[at] = cls[at + 1] = LETTER
    at = chars(0xC2, 2)  # control characters and the hard blank
    at = at[(data[at + 1] <= 0xA0) | (data[at + 1] == 0xAD)]
    cls[at] = cls[at + 1] = UNKNOWN
    for lead, second, third in ((0xE1, 0x9A, None), (0xE1, 0xA0, None), (0xE2, 0x81, None), (0xE3, 0x80, 0x80), (0xE2, 0x80, range(0x80, 0x90)), (0xE2, 0x80, range(0xA8, 0xB0))):
        at = chars(lead, 3)
        at = at[data[at + 1] == second]
        if third is not None:
            at = at[np.isin(data[at + 2], third if isinstance(third, int) else list(third))]
        cls[at] = cls[at + 1] = cls[at + 2] = UNKNOWN
    return cls


def piece_starts(data: np.ndarray) -> np.ndarray:
    """[i]: whether a text may be cut before byte i without changing its ids (byte 0: yes).

    Holds for the pattern of GPT-2's byte-level pre-tokens: runs of letters, digits and
    marks end where the class changes, and before white space; a mark may take a blank
    before it, an apostrophe letters after it; a line break stands alone if the bytes
    beside it are no white space.
    """
    cls = classes(data)
    ok = np.ones(len(data), bool)
    if len(data) > 1:
        ok[1:] = _ENDS[cls[:-1] * np.uint8(7) + cls[1:]] & (data[:-1] != 39)
        at = np.flatnonzero(ok[1:] & (cls[:-1] == BREAK)) + 1
        before = cls[np.maximum(at - 2, 0)]
        ok[at[(at > 1) & ((before == UNKNOWN) | (before == BLANK) | (before == BREAK))]] = False
        at = np.flatnonzero((data[:-1] == 39) & ((cls[1:] == BLANK) | (cls[1:] == BREAK))) + 1
        ok[at] = True  # after an apostrophe only white space is safe
    return ok


class LibraryEncoder:
    """Whole texts by a file of the tokenizers (.json) or sentencepiece (.model) library; begin and end tokens are not added."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self._batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self._batch = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def library(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids by the library, in batches of about equal bytes."""
        batch, size = [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                yield from self._batch(batch)
                batch, size = [], 0
        if batch:
            yield from self._batch(batch)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of every text."""
        return np.fromiter(map(len, self.library(texts.fill_null("").to_pylist())), np.int64, len(texts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and n + 1 offsets."""
        got = [np.array(x, np.uint32) for x in self.library(texts.fill_null("").to_pylist())]
        return np.concatenate([np.empty(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]).astype(np.int64)


class PieceEncoder(LibraryEncoder):
    """Encodes with a byte-level BPE file, whose texts may be cut wherever `piece_starts` says.

    Pieces repeat, so a worker remembers the ids of each by a 64-bit hash, in tables of
    fixed size that are emptied when full. Texts that hold an added token's string go to
    the library whole.
    """

    def __init__(self, path: str, special: list[str]):
        super().__init__(path)
        self.special = special
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(TABLE, np.uint64)
        self.slot = np.zeros(TABLE, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.n = self.n_ids = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the pieces with these hashes; -1 if not remembered."""
        out = np.full(len(h), -1, np.int64)
        at, row = (h & np.uint64(TABLE - 1)).astype(np.int64), np.arange(len(h))
        while len(row):
            there = self.hash[at]
            hit = there == h[row]
            out[row[hit]] = self.slot[at[hit]]
            more = ~hit & (there != 0)
            row, at = row[more], (at[more] + 1) & (TABLE - 1)
        return out

    def _store(self, h: np.ndarray, first: int) -> None:
        """Distinct new hashes get the numbers from `first` on."""
        at, row = (h & np.uint64(TABLE - 1)).astype(np.int64), np.arange(len(h))
        while len(row):
            free = self.hash[at] == 0
            self.hash[at[free]] = h[row[free]]  # of several for one slot the last stays
            won = free & (self.hash[at] == h[row])
            self.slot[at[won]] = first + row[won]
            row, at = row[~won], (at[~won] + 1) & (TABLE - 1)

    def _library_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, where each piece's begin, and how many it has.

        Pieces without white space, but for a blank that begins them, are given in one
        text with line breaks between: a break there is an id of its own.
        """
        alone = [i for i, t in enumerate(new) if len(t) > 64 or not (t[1:] if t[0] == " " else t).isprintable() or " " in t[1:] or t == " "]
        start, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        held, total = [np.empty(0, np.uint32)], 0
        rows = np.delete(np.arange(len(new)), alone)
        br = self.tokenizer.token_to_id("Ċ")
        for lo in range(0, len(rows), 4096):
            part = rows[lo : lo + 4096]
            ids = np.array(self._batch(["\n".join([new[i] for i in part.tolist()])])[0], np.uint32)
            edges = np.concatenate([[-1], np.flatnonzero(ids == br), [len(ids)]])
            if br is None or len(edges) != len(part) + 1:
                alone += part.tolist()
                continue
            start[part], n[part] = total + edges[:-1] + 1, np.diff(edges) - 1
            held.append(ids)
            total += len(ids)
        for i, ids in zip(alone, self.library([new[i] for i in alone])):
            start[i], n[i] = total, len(ids)
            held.append(np.array(ids, np.uint32))
            total += len(ids)
        return np.concatenate(held), start, n

    def _grow(self, name: str, size: int) -> None:
        have = getattr(self, name)
        if len(have) < size:
            wide = np.zeros(max(size, 2 * len(have)), have.dtype)
            wide[: len(have)] = have
            setattr(self, name, wide)

    def _block(self, data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start (at every head, too) and their numbers, good until the next block."""
        if self.n > REMEMBERED or self.n_ids > HELD_IDS:
            self.clear()
        ok = piece_starts(data)
        ok[heads[heads < len(data)]] = True
        starts = np.flatnonzero(ok)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=run[1:])
        h = np.diff(run[np.append(starts, len(data))])
        size = np.diff(np.append(starts, len(data)))
        h = mix(h * powers(_BACK, len(data) + 1)[starts] ^ size.astype(np.uint64))
        h[h == 0] = 1
        code = self._find(h)
        miss = np.flatnonzero(code < 0)
        if len(miss):
            distinct, first, again = np.unique(h[miss], return_index=True, return_inverse=True)
            raw = data.tobytes()
            new = [raw[s : s + k].decode() for s, k in zip(starts[miss[first]].tolist(), size[miss[first]].tolist())]
            ids, begin, n = self._library_pieces(new)
            self._grow("start", self.n + len(new))
            self._grow("length", self.n + len(new))
            self._grow("ids", self.n_ids + len(ids))
            self.start[self.n : self.n + len(new)] = self.n_ids + begin
            self.length[self.n : self.n + len(new)] = n
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            if self.n + len(new) < TABLE * 3 // 4:
                self._store(distinct, self.n)
            code[miss] = self.n + again
            self.n, self.n_ids = self.n + len(new), self.n_ids + len(ids)
        return starts, code

    def _blocks(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The text in blocks that begin at texts' heads or safe cuts: (first byte, starts, numbers)."""
        at, n = 0, len(data)
        while at < n:
            end = at + BLOCK
            if end >= n:
                end = n
            else:
                head = int(offs[np.searchsorted(offs, end, "right") - 1])
                if head > at:
                    end = head
                else:
                    look = NEAR
                    while True:  # the last safe place, farther back and then farther on if there is none
                        lo = max(at, end - look)
                        safe = np.flatnonzero(piece_starts(data[lo:end])[8:]) + lo + 8
                        if len(safe) or end >= n:
                            end = int(safe[-1]) if len(safe) else n
                            break
                        look, end = (look * 16, end) if lo > at else (2 * look, min(n, end + BLOCK))
            heads = offs[np.searchsorted(offs, at) : np.searchsorted(offs, end)] - at
            yield at, *self._block(data[at:end], heads)
            at = end

    def _whole(self, texts: pa.Array) -> list[int]:
        """Texts that hold an added token's string."""
        hit = np.zeros(len(texts), bool)
        for s in self.special:
            hit |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False).astype(bool)
        return np.flatnonzero(hit).tolist()

    def counts(self, texts: pa.Array) -> np.ndarray:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        data, offs = utf8(texts)
        out = np.zeros(len(texts) + 1, np.int64)
        for at, starts, code in self._blocks(data, offs):
            n = np.concatenate([[0], np.cumsum(self.length[code], dtype=np.int64)])
            lo, hi = np.searchsorted(offs, at, "right") - 1, np.searchsorted(offs, at + starts[-1], "right")
            edges = n[np.searchsorted(starts, np.maximum(offs[lo : hi + 1] - at, 0))]
            out[lo : lo + len(edges) - 1] += np.diff(edges)
        out = out[: len(texts)]
        special = self._whole(texts)
        for i, ids in zip(special, self.library([texts[i].as_py() for i in special])):
            out[i] = len(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        data, offs = utf8(texts)
        parts = [np.empty(0, np.uint32)]
        done, total = 0, 0
        ends = np.zeros(len(offs), np.int64)
        for at, starts, code in self._blocks(data, offs):
            n = self.length[code].astype(np.int64)
            run = np.concatenate([[0], np.cumsum(n)])
            parts.append(self.ids[np.arange(int(run[-1])) + np.repeat(self.start[code] - run[:-1], n)])
            upto = int(np.searchsorted(offs, at + starts[-1], "right"))
            ends[done:upto] = total + run[np.searchsorted(starts, offs[done:upto] - at)]
            done, total = upto, total + int(run[-1])
        ends[done:] = total
        ids = np.concatenate(parts)
        special = self._whole(texts)
        if special:
            rows = np.split(ids, ends[1:-1])
            for i, own in zip(special, self.library([texts[i].as_py() for i in special])):
                rows[i] = np.array(own, np.uint32)
            ids, ends = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
        return ids, ends


def _added(path: str) -> list[str] | None:
    """The added tokens' strings if the file's rules are those that `piece_starts` knows, else None."""
    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, model, added = told.get("pre_tokenizer") or {}, told.get("model") or {}, told.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    bpe = model.get("type") == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    return [t["content"] for t in added] if plain and bpe and simple and told.get("normalizer") is None else None


def encoder(path: str) -> LibraryEncoder:
    """The worker's encoder of that file: by pieces where its rules allow it, else by whole texts."""
    if path not in _loaded:
        special = _added(path)
        _loaded[path] = LibraryEncoder(path) if special is None else PieceEncoder(path, special)
    return _loaded[path]

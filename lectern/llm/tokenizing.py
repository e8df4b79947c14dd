"""Whole-text encoding with a public tokenizer file, one encoder per worker.

Both vocabularies used here split a text before every run of white space
that follows a non-space, and never merge across that split, so a text's ids
are the ids of its space-separated pieces, joined.  Each worker encodes a
piece once with the tokenizers library (a plain word, which is one token run,
with the library's BPE model alone) and keeps its ids in two bounded
generations; texts with a piece whose split depends on its neighbours
(white space next to a space), or that spell one of the file's added tokens,
are encoded whole by the library.  Arrow splits many texts at a time, numbers
their distinct pieces and joins the ids, so a repeated piece is one lookup.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

_ENCODERS: dict[str, Encoder] = {}
_WHITE_END = re.compile(r"\s\Z")
#: Latin letters, and the full stop or comma that is a token run of its own.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)\Z")
#: A line end between two printable characters is a token run of its own.
_TWO_LINES = re.compile(r"([^\n]*[!-~])\n([!-~][^\n]*)\Z")



def _byte_letters() -> dict[int, str]:
    """The published byte-level alphabet: printable bytes stand for
    themselves, the others for letters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(0x100 + n) for n, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    #: Pieces kept per generation, some 200 bytes each; at most two
    #: generations are held.
    KEEP = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.rule = self._rule(spec)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(with_added_tokens=True) <= 0xFFFF else np.dtype("<u4")
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        # A mark that is a token of its own between pieces: many pieces are
        # encoded as one text and its ids are cut at the mark.
        self.mark = {"prefix": "\n", "drop": "\x01", "whole": ""}[self.rule]
        self.lead, self.between = {"prefix": (" ", "\n "), "drop": ("", " \x01 "), "whole": ("", "")}[self.rule]
        ids = self.tok.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else None
        self.stops = dict(zip(".,", self._raw([".", ","]), strict=True))

    @staticmethod
    def _rule(spec: dict) -> str:
        """``prefix``: a word carries the space before it; ``drop``: white
        space is removed; ``whole``: no rule is known for this file."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not norm:
            return "prefix"
        steps = pre.get("pretokenizers") or [{}]
        norms = [n.get("type") for n in norm.get("normalizers", [])]
        if steps[0].get("behavior") == "Removed" and steps[0].get("invert") and norms == ["NFC", "Replace", "Lowercase"]:
            return "drop"
        return "whole"

    def _raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the library; few encodings are alive at a time."""
        out, lo, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= 1 << 17 or i - lo >= 511 or i + 1 == len(texts):
                some = self.tok.encode_batch_fast(texts[lo : i + 1], add_special_tokens=False)
                out += [np.array(e.ids, self.dtype).tobytes() for e in some]
                lo, size = i + 1, 0
        return out

    def _spelt(self, word: str, spaced: bool) -> bytes:
        """The ids of a word of Latin letters, by the library's model: the
        word is one token run, whose bytes stand for the model's letters."""
        if self.rule == "drop":
            word = word.lower()
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        if spaced and self.rule == "prefix":
            letters = "\u0120" + letters
        return array(self.dtype.char, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        if len(self.new) + len(pieces) > self.KEEP:
            self.old, self.new = self.new, {}
        new, old, rest = self.new, self.old, []
        for p in pieces:
            if (ids := old.get(p)) is not None:
                new[p] = ids
            elif m := _WORD.match(p):
                word, stop = m.groups()
                if not stop:
                    new[p] = self._spelt(p, True)
                else:  # the word alone is often known
                    ids = new.get(word) or old.get(word) or self._spelt(word, True)
                    new[p] = ids + self.stops[stop]
            elif self.rule == "prefix" and (not p or _WHITE_END.search(p) or p[0].isspace()):
                new[p] = None  # its ids depend on its neighbours
            else:
                rest.append(p)
        if rest:
            self._add(rest)

    def _add(self, fresh: list[str]) -> None:
        if self.mark_id is None:
            self.new.update(zip(fresh, self._raw([self.lead + p for p in fresh]), strict=True))
            return
        plain = [p for p in fresh if self.mark not in p]
        marked = [p for p in fresh if self.mark in p]
        lines = [(p, m) for p in marked if (m := _TWO_LINES.match(p))] if self.rule == "prefix" else []
        if lines:
            self._add_lines(lines)
            split = {p for p, _ in lines}
            marked = [p for p in marked if p not in split]
        self.new.update(zip(marked, self._raw([self.lead + p for p in marked]), strict=True))
        self.new.update(zip(plain, self._joined(plain, True), strict=True))

    def _add_lines(self, lines: list) -> None:
        """Pieces of two lines: the first line behind a space, the line end,
        and the second line as it begins a text."""
        heads = list({m[1] for _, m in lines})
        tails = list({m[2] for _, m in lines})
        head = dict(zip(heads, self._joined(heads, True), strict=True))
        tail = dict(zip(tails, self._joined(tails, False), strict=True))
        line_end = self.mark_id.to_bytes(self.dtype.itemsize, "little")
        self.new.update((p, head[m[1]] + line_end + tail[m[2]]) for p, m in lines)

    def _joined(self, pieces: list[str], spaced: bool) -> list[bytes]:
        """The ids of pieces without the mark: words by the model, others by
        the library, many to a text."""
        out: list[bytes | None] = [None] * len(pieces)
        others = []
        new, old = (self.new, self.old) if spaced else ({}, {})
        for i, p in enumerate(pieces):
            if m := _WORD.match(p):
                ids = new.get(m[1]) or old.get(m[1]) or self._spelt(m[1], spaced)
                out[i] = ids + self.stops[m[2]] if m[2] else ids
            else:
                others.append(i)
        lead, between = (self.lead, self.between) if spaced else ("", self.mark)
        size = self.dtype.itemsize
        for at in range(0, len(others), 2048):
            some = others[at : at + 2048]
            raw = self._raw([lead + between.join([pieces[i] for i in some])])[0]
            cuts = np.flatnonzero(np.frombuffer(raw, self.dtype) == self.mark_id) * size
            if len(cuts) + 1 != len(some):
                raise AssertionError("the mark is not a token of its own")
            for i, lo, hi in zip(some, [0, *(cuts + size).tolist()], [*cuts.tolist(), len(raw)], strict=True):
                out[i] = raw[lo:hi]
        return out

    def _known(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of distinct pieces; None: they depend on a piece's neighbours."""
        get = self.new.get
        got = list(map(get, pieces))
        if None in got:
            gaps = [j for j, g in enumerate(got) if g is None]
            missing = [pieces[j] for j in gaps]
            self._learn(missing)
            for j, ids in zip(gaps, map(self.new.__getitem__, missing), strict=True):
                got[j] = ids
        return got

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has.

        Arrow splits the texts and numbers the distinct pieces, so each of
        them is looked up once a call, and puts their ids in a row again."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        if self.rule == "whole" or not n:
            raw = self._raw(texts)
            counts = np.fromiter(map(len, raw), np.int64, n) // self.dtype.itemsize
            return np.frombuffer(b"".join(raw), self.dtype), counts
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = split.offsets.to_numpy().astype(np.int64)  # each text has a piece at least
        coded = split.values.dictionary_encode()
        place, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        whole = np.array([any(mark in t for mark in self.added) for t in texts], bool)
        heads = split.values.take(pa.array(first[:-1])).to_pylist() if self.rule == "prefix" else []
        # pieces that are asked for: not the first ones, which no space precedes
        asked = ~np.repeat(whole, np.diff(first))
        if heads:
            asked[first[:-1]] = False
            whole |= np.array([bool(t and _WHITE_END.search(h)) for t, h in zip(texts, heads, strict=True)], bool)
        used = np.zeros(len(pieces), bool)
        used[place[asked]] = True
        known = np.flatnonzero(used)
        got = self._known(pieces.take(pa.array(known)).to_numpy(zero_copy_only=False).tolist())
        alone = np.zeros(len(pieces), bool)  # pieces that need their neighbours
        alone[known[[j for j, g in enumerate(got) if g is None]]] = True
        whole |= np.logical_or.reduceat(alone[place] & asked, first[:-1])
        # a place for each piece: its ids', those of its text's beginning, or none
        spot = np.zeros(len(pieces), np.int64)
        spot[known] = np.arange(1, len(known) + 1)
        place = spot[place]
        table = [b"", *(g or b"" for g in got)]
        place[np.repeat(whole, np.diff(first))] = 0
        begun = np.flatnonzero(whole) if not heads else np.arange(n)
        place[first[begun]] = len(table) + np.arange(len(begun))
        table += self._raw([texts[i] if whole[i] else heads[i] for i in begun.tolist()])
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        ids = pa.array(table, pa.large_binary()).take(pa.array(place)).buffers()[2]
        ids = np.frombuffer(ids, self.dtype, int(sizes[place].sum())) if ids else np.empty(0, self.dtype)
        return ids, np.add.reduceat(sizes[place], first[:-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian ``dtype`` bytes."""
        ids, n = self._flat(texts)
        stops = np.cumsum(n).tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip([0, *stops], stops)]

    def ended(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, as unsigned
        32-bit integers, and how many ids each text has with it."""
        ids, n = self._flat([t or "" for t in texts])
        stops = np.cumsum(n + 1)
        out = np.full(len(ids) + len(n), end_id, "<u4")
        own = np.ones(len(out), bool)
        own[stops - 1] = False
        out[own] = ids
        return out, n + 1


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_batches(texts, max_chars: int = 1 << 21):
    """Slices ``(lo, hi)`` of an Arrow array of texts with a bounded sum of lengths.

    When the caller is through with a slice, the memory that Arrow keeps for
    later goes back to the system: the worker lives on through other stages,
    beside other workers of its executor."""
    import pyarrow as pa
    import pyarrow.compute as pc

    pool = pa.default_memory_pool()
    lo, size = 0, 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        size += n or 0
        if size >= max_chars:
            yield lo, i + 1
            pool.release_unused()
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
        pool.release_unused()

"""Token ids of whole texts. A text falls apart at its white space, and a piece met before is not encoded again."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from grainmill.llm.text import LOWER, steps, word_spans

#: A worker remembers the pieces of the last one to two times so many new ones. Longer pieces are not kept.
REMEMBERED = 150_000
LONGEST = 48
#: White space of one byte, and the bytes that begin white space of more.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_BORDER = np.zeros(256, bool)
_BORDER[[0x20, 0x0A]] = True
#: A word of Latin letters, after its border if it has one.
_WORD = re.compile(rb"[ \n]?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PUNCTUATION, _LETTER, _INNER = (np.zeros(256, bool) for _ in range(3))
_PUNCTUATION[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = True
_LETTER[[x for x in range(0x80) if chr(x).isalpha()]] = True
_INNER[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
#: Pieces that one call encodes.
TOGETHER = 2000
#: Bytes of text whose equal pieces are found together.
STRETCH = 2 << 20
_encoders: dict = {}


def _borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of single spaces and line ends that stand between other characters of one text."""
    solid = ~_SPACE[data]
    leads = np.flatnonzero(_LEADS[data])
    if len(leads):
        second, third = data[np.minimum(leads + 1, len(data) - 1)], data[np.minimum(leads + 2, len(data) - 1)]
        first = data[leads]
        two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
        general = (third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)
        three = ((first == 0xE1) & (second == 0x9A) & (third == 0x80)) | ((first == 0xE3) & (second == 0x80) & (third == 0x80))
        three |= (first == 0xE2) & (((second == 0x80) & general) | ((second == 0x81) & (third == 0x9F)))
        for found, size in ((leads[two], 2), (leads[three], 3)):
            for i in range(size):
                solid[found + i] = False
    border = _BORDER[data]
    border[1:] &= solid[:-1]
    border[:-1] &= solid[1:]
    ends = offsets[(offsets > 0) & (offsets < len(data))]
    border[ends] = border[ends - 1] = False
    border[:1] = border[-1:] = False
    return np.flatnonzero(border)


def _marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of ASCII punctuation right after a Latin letter: no token of either kind of vocabulary goes across."""
    at = np.flatnonzero(_PUNCTUATION[data])
    at = at[at > 0]
    before = data[at - 1]
    return at[_LETTER[before] | (_INNER[before] & (data[at - 2] == 0xC3) & (at > 1))]


class Encoder:
    """Ids of one tokenizer file, as bytes of little-endian unsigned 32-bit numbers.

    With `spaced`, a piece but the first begins with its space or line end (byte-level vocabularies join a space and what
    follows); without, white space is nothing but a border. With `spaced`, only single spaces and line ends between other
    characters are borders: no vocabulary of either kind joins characters across them. A text that holds the string of an
    added token goes to the tokenizer as it is, which gives that token's id; with `plain`, such strings are ordinary text.
    """

    def __init__(self, path: str, spaced: bool, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [] if plain else [x.content for x in added.values()]
        fixed = [i for i, x in added.items() if not (plain or x.lstrip or x.rstrip or x.single_word or x.normalized)]
        self.tokenizer.encode_special_tokens = plain
        #: An added token that parts pieces: the tokenizer works on what stands between two of them alone.
        self.part = (added[fixed[-1]].content, fixed[-1]) if fixed else None
        self.spaced = spaced
        self.lower = not spaced and self._direct(["A"]) == self._direct(["a"])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: Whether an id begins a piece (`spaced`) or ends one, by number; none where the vocabulary does not tell.
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        edge = (lambda x: x[:1] in "ĠĊ") if spaced else (lambda x: x.endswith(suffix)) if suffix else (lambda x: False)
        self.edges = np.zeros(1 + max([0, *self.tokenizer.get_vocab().values()]), bool)
        self.edges[[i for x, i in self.tokenizer.get_vocab().items() if x and edge(x)]] = True

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _each(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without added tokens, many to a call."""
        if self.part is None:
            return self._direct(pieces)
        mark, number = self.part
        joined = [mark.join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        out: list[bytes] = []
        for ids in self._direct(joined):
            numbers = np.frombuffer(ids, np.uint32)
            cuts = np.flatnonzero(numbers == number) * 4
            first = 0
            for cut in cuts.tolist():
                out.append(ids[first:cut])
                first = cut + 4
            out.append(ids[first:])
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, many to a call as one text, which its ids tell apart."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            own = words[i : i + TOGETHER]
            ids = self._direct([(b"" if self.spaced else b" ").join(own).decode()])[0]
            at = np.flatnonzero(self.edges[np.frombuffer(ids, np.uint32)])
            if len(at) != len(own):
                out += self._each([x.decode() for x in own])
                continue
            cuts = ((at if self.spaced else at + 1) * 4).tolist()
            cuts = [*cuts, len(ids)] if self.spaced else [0, *cuts]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = [known.get(x) for x in pieces]
        words, others = [], []
        for i, found in enumerate(out):
            if found is None:
                x = pieces[i]
                if (ids := older.get(x)) is not None:
                    known[x] = out[i] = ids
                elif _WORD.fullmatch(x) and (x[:1] in b" \n") == self.spaced:
                    words.append(i)
                else:
                    others.append(i)
        new = [*zip(words, self._words([pieces[i] for i in words]))]
        new += zip(others, self._each([pieces[i].decode() for i in others]))
        for i, ids in new:
            out[i] = ids
            if len(pieces[i]) <= LONGEST:
                known[pieces[i]] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        return [x for _, found in encoded(pa.array(texts, pa.large_string()), self) for x in found]

    def _holds_added(self, text: str) -> bool:
        """Whether a text, or what folding its letters makes of it, holds the string of an added token."""
        if not any(a[0] in text for a in self.added):
            return False
        if self.lower:
            text = text.lower()
        return any(a in text for a in self.added)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of the texts that are the bytes of `data` between two `offsets` each."""
        raw = data.tobytes()
        if any(a[0].encode() in raw for a in self.added):
            bounds = offsets.tolist()
            texts = [raw[a:b].decode() for a, b in zip(bounds, bounds[1:])]
            whole = [i for i, x in enumerate(texts) if self._holds_added(x)]
            if whole:
                apart = set(whole)
                rest = [x.encode() for i, x in enumerate(texts) if i not in apart]
                sizes = np.cumsum([0, *map(len, rest)])
                found = self._by_pieces(np.frombuffer(b"".join(rest), np.uint8), sizes)
                for i, ids in zip(whole, self._direct([texts[i] for i in whole])):
                    found.insert(i, ids)
                return found
        return self._by_pieces(data, offsets)

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if self.lower:  # A-Z alone, which the vocabulary would fold as well
            data = LOWER[data]
        marks = _marks(data, offsets)
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        if self.spaced:
            starts = np.zeros(len(data), bool)
            for x in (_borders(data, offsets), marks, filled):
                starts[x] = True
            start = np.flatnonzero(starts)
            edges = np.append(start, len(data))
        else:
            start, end = word_spans(data, offsets)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[start] += 1
            inside[end] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            starts = np.zeros(len(data), bool)
            starts[start] = starts[marks] = True
            start = np.flatnonzero(starts)
            data = data[inside]
            edges = np.append(np.flatnonzero(starts[inside]), len(data))
        bounds = np.searchsorted(start, offsets)
        if not len(start):
            return [b""] * (len(offsets) - 1)
        buffers = [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), buffers).dictionary_encode()
        ids = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(sizes) - sizes
        own = sizes[at]
        ends = np.append(0, np.cumsum(own))
        place = np.repeat(first[at] - ends[:-1], own)
        place += np.arange(ends[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[place]
        cuts = ends[bounds].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per worker process and file."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def encoded(texts: pa.Array, coder: Encoder) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, ids) of successive stretches of a batch; null is empty."""
    for at, data, offsets in steps(texts, STRETCH):
        yield at, coder.ids(data, offsets)

"""Ids of whole texts, with a memo of their pieces.

Byte-pair encoding never merges across the points at which a pre-tokenizer splits, so the ids of a
text are those of its pieces in order. Latin texts are cut into pieces as arrays, many texts at once.
Pieces repeat, so most are looked up, each once for all its places. New ones go to the library's
byte-pair model, which spares the alignments that its whole pipeline keeps. Of other texts the chunks
between spaces are looked up, and any other text is encoded by the whole pipeline. All ids come from
the ``tokenizers`` library.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Characters that Python and the pre-tokenizers' patterns do not agree on as white space, and
#: what special tokens begin with.
_DOUBTFUL = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: A space that is not followed by a word begins a run of white space, which stays in one piece.
_RUN = re.compile(r" (?:\s|\Z)")
#: Beyond these, normal forms and classes may depend on the version of Unicode.
_OTHER = re.compile("[^\x00-ɏ]")
#: The first character beyond them stands between texts that are cut together.
_BETWEEN = "ɐ"
# Classes of characters.
_BLANK, _LETTER, _DIGIT, _MARK, _END = range(5)

# The patterns of the two tokenizer files.
PATTERNS = {
    True: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    False: r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Memo:
    """A bounded map: when the young half is full it becomes the old half."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def make_room(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those that are not known. The others are in the young half afterwards."""
        self.make_room()
        out, old, young = [], self.old, self.young
        for key in keys.difference(young):
            if key in old:
                young[key] = old[key]
            else:
                out.append(key)
        return out


class ChunkEncoder:
    """``keeps_space``: the file is a byte-level tokenizer that joins a space to the word after
    it; else one that drops white space and case. ``most`` bounds each memo's entries."""

    def __init__(self, path: str, dtype: str = "<u4", keeps_space: bool = True, most: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        self._dtype, self._keeps = np.dtype(dtype), keeps_space
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = byte_letters()
        self._pattern = regex.compile(PATTERNS[keeps_space])
        kinds = {r"\s": _BLANK, r"\p{L}": _LETTER, r"\p{N}": _DIGIT}
        self._kinds = np.full(ord(_BETWEEN) + 1, _MARK, np.uint8)
        for pattern, kind in kinds.items():
            self._kinds[[c for c in range(ord(_BETWEEN)) if regex.match(pattern, chr(c))]] = kind
        self._kinds[-1] = _END
        size = self._dtype.itemsize
        vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._stored = [i.to_bytes(size, "little") for i in range(vocabulary)]
        self._chunks, self._pieces = _Memo(most), _Memo(most)

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text by the whole pipeline."""
        if not texts:
            return []
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self._dtype).tobytes() for e in found]

    def _split(self, text: str) -> list[str] | None:
        """Chunks of ``text``; None if it is to be encoded whole."""
        if any(odd in text for odd in _DOUBTFUL):
            return None
        if not self._keeps:
            return text.split()
        if _RUN.search(text):
            return None
        first, *rest = text.split(" ")
        chunks = [" " + c for c in rest]
        if first:
            chunks.insert(0, first)
        return chunks

    def _known(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of at least these pieces, which the pre-tokenizer leaves whole."""
        new = self._pieces.missing(pieces)
        known, stored, tokenize = self._pieces.young, self._stored, self._model.tokenize
        space = self._letters[ord(" ")]
        for piece in new:
            if piece.isalpha():
                shown = piece.decode()
            elif piece[:1] == b" " and piece[1:].isalpha():
                shown = space + piece[1:].decode()
            else:
                shown = piece.decode("latin-1").translate(self._letters)
            known[piece] = b"".join([stored[t.id] for t in tokenize(shown)])
        return known

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        new = self._chunks.missing(chunks)
        known = self._chunks.young
        if _OTHER.search("\n".join(new)):
            odd = [c for c in new if _OTHER.search(c)]
            new = [c for c in new if not _OTHER.search(c)]
            known.update(zip(odd, self._whole(odd)))
        find = self._pattern.findall
        cut = [[p.encode() for p in find(c if self._keeps else c.lower())] for c in new]
        get = self._known({p for pieces in cut for p in pieces}).__getitem__
        for chunk, pieces in zip(new, cut):
            known[chunk] = b"".join(map(get, pieces))
        return known

    def _latin(self, text: str) -> str | None:
        """``text`` in the case in which it is cut; None if it is not to be cut as arrays."""
        if any(odd in text for odd in _DOUBTFUL):
            return None
        shown = text if self._keeps else text.lower()
        # Small letters of some others are Latin ones.
        if not text.isascii() and (_OTHER.search(text) or _OTHER.search(shown)):
            return None
        return shown

    def _starts(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character, as the pre-tokenizer's pattern has it."""
        starts = np.ones(len(codes), bool)
        starts[1:] = kinds[1:] != kinds[:-1]
        if self._keeps:
            blank = kinds == _BLANK
            # Blanks go together but for the last one before a word, which it joins if it is a space.
            starts[:-1] |= blank[:-1] & ~blank[1:] & (kinds[1:] != _END)
            starts[1:] &= blank[1:] | (codes[:-1] != ord(" ")) | (kinds[1:] == _END)
        else:
            starts |= kinds == _DIGIT
        # The endings that the pattern names first, where a piece begins with the apostrophe.
        at = np.flatnonzero((codes[:-2] == ord("'")) & starts[:-2])
        one, two = codes[at + 1], codes[at + 2]
        size = 2 * np.isin(one, [ord(c) for c in "stmd"])
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        starts[at + size] = True
        return starts

    def _together(self, texts: list[str]) -> list[bytes]:
        """The ids of each of the texts, none of them empty, that ``_latin`` returned."""
        joined = _BETWEEN.join(texts) + 2 * _BETWEEN
        codes = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        kinds = self._kinds[codes]
        at = np.flatnonzero(self._starts(codes, kinds))
        # Characters from U+0080 on take two bytes.
        offsets = np.cumsum(codes >= 0x80, dtype=np.int64)[at] - (codes[at] >= 0x80) + at
        data = joined.encode()
        bounds = pa.py_buffer(np.append(offsets, len(data)))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(data)])
        pieces = pieces.dictionary_encode()
        which, pieces = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        known = self._known(set(pieces))
        ids = [known[p] for p in pieces]

        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self._dtype.itemsize
        first = np.cumsum(size) - size
        own = kinds[at]
        n = size[which]
        n[(own == _END) if self._keeps else (own == _END) | (own == _BLANK)] = 0
        ends = np.cumsum(n)
        place = np.repeat(first[which] - (ends - n), n) + np.arange(int(ends[-1]))
        found = np.frombuffer(b"".join(ids), self._dtype)[place].tobytes()
        stops = (ends[own == _END] * self._dtype.itemsize).tolist()
        return [found[a:b] for a, b in zip([0, *stops], stops)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes; none for a null or empty text."""
        latin = [self._latin(t) if t else None for t in texts]
        split = [self._split(t) if t and s is None else [] for t, s in zip(texts, latin)]
        together = [s for s in latin if s is not None]
        together = iter(self._together(together) if together else [])
        chunks: set[str] = set()
        for c in split:
            if c:
                chunks.update(c)
        get = self._learn(chunks).__getitem__ if chunks else None
        whole = iter(self._whole([t for t, c in zip(texts, split) if c is None]))
        return [
            next(together) if s is not None else next(whole) if c is None else b"".join(map(get, c)) if c else b""
            for s, c in zip(latin, split)
        ]

"""Token ids by the tokenizers library, with each distinct pre-token encoded once.

Byte-pair merges never cross the borders of pre-tokens, so the ids of a text are those of its pre-tokens in a row.
For texts of Latin letters (all code points below U+0250) the pre-tokens are found here by the tokenizer file's own
pattern, with its letter and number classes written out for that range; the library's model encodes each distinct one
and a bounded table keeps the ids. All other texts, and those that may hold a special token's string, go to the
library whole. Either way the ids are those of `encode(text, add_special_tokens=False)`.

A batch of texts is cut at spaces and line ends first, where a pre-token always starts unless white space stands in a
row (such texts are taken one by one); each distinct piece of the batch is looked up once, and Arrow puts the ids of
all pieces in a row.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the table of pre-tokens in one Python worker (some 200 bytes each).
TABLE = 500_000
#: Longest pre-token that is kept.
LONGEST = 64
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_REST = f"[^{_SPACE}{_LETTER}{_NUMBER}]+"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: By kind of tokenizer: the pattern of a pre-token, and whether text is lower-cased first.
KINDS = {
    "bytes": (re.compile(f"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?{_REST}|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"), False),
    "words": (re.compile(f"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|{_REST}"), True),
}
#: Characters beyond the range, and the one letter in it whose lower case is two characters.
FAR = re.compile("[^\x00-įı-ɏ]")

#: By kind, white space (or the mark that pieces are cut at) that keeps a text from being cut into pieces; any text that is not of the range is kept too.
_HERE = {"bytes": "[ \\n][ \\n]|[\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}]", "words": "[\\x1c-\\x1f]"}
_MARK = "\x01"

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a Python worker and file."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def forget() -> None:
    """Gives back the memory of this worker's encoders; a later task that needs one makes it anew."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Encoder(dict):
    """Pre-token -> packed ids; what is missing is encoded by the library's model."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.pattern, self.lower = KINDS[kind]
        self.letters = dict(enumerate(_byte_letters()))
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        if self.lower:
            self.special = [x[:2] for x in self.special]
        held = "|".join(["[^\\x00-\\x{12f}\\x{131}-\\x{24f}]", _MARK, _HERE[kind], *(re.escape(x) for x in self.special)])
        self.whole_only = held

    def __missing__(self, token: str) -> bytes:
        spelled = token.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [x.id for x in self.model.tokenize(spelled)]).tobytes()
        if len(self) < TABLE and len(token) <= LONGEST:
            self[token] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Packed little-endian ids of a whole text, self.width bytes each."""
        if not text.isascii() and FAR.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.pattern.findall(text.lower() if self.lower else text)))

    def pieces(self, texts: pa.StringArray) -> pa.ListArray:
        """The pieces of texts that hold nothing of `whole_only`; their pre-tokens in a row are those of the text."""
        if self.lower:
            return pc.split_pattern(pc.utf8_lower(pc.replace_substring(texts, "\n", " ")), " ")
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", f"{_MARK}\n{_MARK}"), " ", f"{_MARK} ")
        return pc.split_pattern(marked, _MARK)

    def piece(self, piece: str) -> bytes:
        if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():  # letters are one pre-token
            return self[piece]
        ids = b"".join(map(self.__getitem__, self.pattern.findall(piece)))
        if len(self) < TABLE and len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def batch(self, texts: pa.StringArray) -> list[bytes]:
        """ids() of each text."""
        whole = pc.match_substring_regex(texts, self.whole_only)
        lists = self.pieces(texts.filter(pc.invert(whole)))
        coded = lists.flatten().dictionary_encode()
        get = self.get
        distinct = [get(p) or self.piece(p) for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ids = pa.array(distinct, pa.binary()).cast(pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(lists) + 1)
        raw = memoryview(ids.buffers()[2] or b"")
        plain = iter(zip(ends, ends[1:]))
        out = []
        for t, w in zip(texts, whole.to_pylist()):
            if w:
                out.append(self.ids(t.as_py()))
            else:
                a, z = next(plain)
                out.append(bytes(raw[a:z]))
        return out

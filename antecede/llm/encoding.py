"""Token ids of whole texts, exactly as the `tokenizers` library gives them.

Texts of ordinary characters are cut at white space where no pre-token can span the cut; a
piece that was met lately is remembered with its ids. Every other text goes to the library
whole or, if it is huge, in overlapping chunks (`token_counts.spliced`).
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
from collections.abc import Callable, Iterator

#: Bytes of pieces and their ids that each Python worker remembers, about.
MEMO = 64 << 20
#: What a remembered piece takes besides its characters and ids: two objects' heads and a place in a table.
HEADS = 150
#: Characters of a piece that is remembered, at most.
PIECE = 64
#: Characters of a text that are cut up at a time.
BLOCK = 1 << 20

# Below U+0250 all characters are in NFC and their classes are the same in every Unicode version.
# U+0130 lower-cases to two characters. "<|" may begin a special token. Both go the long way.
ODD_FOR_WORDS = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\\|")
# Here a space belongs to the word after it, and a run of white space is split by what follows it.
ODD_FOR_SPACED = re.compile("[^\n\x20-\x7e\xa1-ɏ]|<\\|")
#: Signs that, after a letter and up to a piece's end, are a pre-token of their own.
SIGNS = ".,;:!?&%#|)"
SPACED = re.compile("\n| ?[^ \n]+").findall
RUNS = ("  ", " \n", "\n ", "\n\n")


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable Latin-1 as itself, the others by counting on from 256."""
    shown = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


BYTE_LETTERS = byte_letters()


SWAP = array.array("H", [1]).tobytes() != b"\x01\x00"


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array.array("I", ids)
    if SWAP:
        out.byteswap()
    return out.tobytes()


class Memo(dict):
    """Pieces and their ids; what isn't there yet is encoded when it is asked for.

    There are two halves: this one fills up, and then becomes the older one, whose former pieces go
    if they weren't asked for meanwhile. Together they are bounded in bytes.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = MEMO):
        super().__init__()
        self.encode, self.half, self.older, self.held = encode, most // 2, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece[-1] in SIGNS:
                word = piece.rstrip(SIGNS)
                if word[-1:].isalpha():
                    return self[word] + self[piece[len(word) :]]  # found again as quickly, and takes no room
            ids = self.encode(piece)
        if len(piece) <= PIECE:
            self.held += HEADS + len(piece) + len(ids)
            if self.held > self.half:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            rules = json.load(f)
        before, words = rules["normalizer"], rules["pre_tokenizer"]
        self.odd = None
        if before is None and words["type"] == "ByteLevel" and words["use_regex"] and not words["add_prefix_space"]:
            self.odd = ODD_FOR_SPACED
        elif before and [x["type"] for x in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and words["type"] == "Sequence" and words["pretokenizers"][0]["behavior"] == "Removed":
            self.odd = ODD_FOR_WORDS
        self.tokenize = self.library.model.tokenize
        self.memo = Memo(self._piece)

    def ordinary(self, text: str) -> bool:
        """Whether the text can be cut up."""
        if self.odd is None or self.odd.search(text):
            return False
        return self.odd is ODD_FOR_WORDS or not (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in RUNS))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Cut at white space that is dropped anyway, or before single spaces and around line ends; a block at a time."""
        start = 0
        while start < len(text):
            end = len(text) if start + BLOCK >= len(text) else text.find(" ", start + BLOCK)
            end = len(text) if end < 0 else end
            if self.odd is ODD_FOR_WORDS:
                yield text[start:end].lower().split()
            else:
                yield SPACED(text, start, end)  # later blocks begin with their space
            start = end

    def _piece(self, x: str) -> bytes:
        """The ids of one piece. A run of letters, with its space, is one pre-token."""
        if not (x[1:] if x[0] == " " else x).isalpha():
            return packed(self.library.encode(x, add_special_tokens=False).ids)
        letters = x if self.odd is ODD_FOR_WORDS and x.isascii() else x.encode().decode("latin-1").translate(BYTE_LETTERS)
        return packed([t.id for t in self.tokenize(letters)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if self.ordinary(text):
            get = self.memo.__getitem__
            return b"".join([b"".join(map(get, x)) for x in self.pieces(text)])
        from antecede.llm.token_counts import CHUNK, spliced

        if len(text) <= CHUNK or self.odd is None:
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(packed(x) for x in spliced(self, text))

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(x) for x in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)

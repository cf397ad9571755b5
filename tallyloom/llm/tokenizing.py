"""Public tokenizer files for use inside tasks: token ids of whole texts."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

#: Characters that are no white space in any version of Unicode. A byte-level BPE file always starts
#: a new piece at a blank between two of them; the blank belongs to what follows.
_INK = "!-~\u00a1-\u024f"
_BREAK = re.compile(f"(?<=[{_INK}]) (?=[{_INK}])")
#: Latin letters: a piece takes all that follow each other.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
_OTHER_BLANK = re.compile(f"[^{_INK}] | [^{_INK}]")
#: How a byte-level vocabulary writes a blank (a fixed value).
BLANK = "\u0120"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _splits_at_blanks(spec: dict) -> bool:
    """Whether the file is plain byte-level BPE, so that texts may be encoded piece by piece."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or model.get("dropout") or spec.get("normalizer") or (spec.get("truncation") or spec.get("padding")):
        return False
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)


class TextTokenizer:
    """Ids as the ``tokenizers`` library gives them for the file, without special tokens added.

    All ids come from that library. With a plain byte-level file, texts are cut at blanks where a new
    piece surely starts, and each different piece is encoded once: words come again and again. At
    most ``most_pieces`` short pieces are remembered. Texts with a special token's string go to the
    library whole, as do all texts with other kinds of files.
    """

    def __init__(self, path: str, most_pieces: int = 1_000_000, longest: int = 64) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.cuts = _splits_at_blanks(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.most_pieces, self.longest = most_pieces, longest
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # How the file's vocabulary writes the Latin letters beyond ASCII.
        self.written = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _remember(self, held: dict[str, bytes], piece: str, found: bytes) -> bytes:
        if len(piece) <= self.longest:
            if len(held) >= self.most_pieces:
                held.clear()
            held[piece] = found
        return found

    def _after_blank(self, piece: str) -> bytes:
        """The ids of a blank and the piece."""
        end = _WORD.match(piece).end()
        if end == 0 or not piece[end : end + 1].isascii():
            return self._remember(self.known, piece, self._encode(f" {piece}"))
        if end < len(piece):  # a word ends before any ASCII character but a letter
            word, tail = piece[:end], piece[end:]
            found = (self.known.get(word) or self._after_blank(word)) + (self.tails.get(tail) or self._remember(self.tails, tail, self._encode(tail)))
            return self._remember(self.known, piece, found)
        # One word: straight to the vocabulary's merges.
        return self._remember(self.known, piece, array("I", [t.id for t in self.model.tokenize(BLANK + (piece if piece.isascii() else piece.translate(self.written)))]).tobytes())

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit little-endian numbers."""
        if not self.cuts or any(s in text for s in self.special):
            return np.frombuffer(self._encode(text), "<u4")
        first, *rest = _BREAK.split(text) if _OTHER_BLANK.search(text) or text[:1] == " " or text[-1:] == " " else text.split(" ")
        known = self.known.get
        return np.frombuffer(b"".join([self._encode(first), *[known(p) or self._after_blank(p) for p in rest]]), "<u4")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> TextTokenizer:
    """One tokenizer for each file and worker process."""
    return TextTokenizer(path)

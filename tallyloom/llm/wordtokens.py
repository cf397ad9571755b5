"""Token ids of whole batches of texts with a lower-casing, white-space-dropping word BPE file.

All ids come from the ``tokenizers`` library. Such a file cuts a text into pieces (runs of letters,
single digits, runs of other signs) and encodes each for itself, so a batch's bytes are cut with
NumPy, equal pieces are found with Arrow's dictionary encoding, and each different one is encoded
once. What the cut can't tell safely (an apostrophe, signs beyond Latin-1 letters, control
characters) goes to the library as a whole chunk between blanks. Any other file's texts do as wholes.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from .common import joined

#: The cut of such a file (a fixed value of its format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[:32] = _ODD
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _ODD
_KIND[127:] = _ODD
_KINDS = _KIND.tobytes()


def _cuts_in_pieces(spec: dict) -> bool:
    """Whether the file is of the kind said above, so that pieces may be encoded one by one."""
    normal, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    steps = normal.get("normalizers", [])
    parts = pre.get("pretokenizers", [])
    if [s.get("type") for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1].get("pattern") != {"Regex": "\\s+"} or steps[1].get("content") != " ":
        return False
    if [p.get("type") for p in parts] != ["Split", "ByteLevel"] or parts[1].get("use_regex", True) or parts[1].get("add_prefix_space", True):
        return False
    split = parts[0]
    if split.get("pattern") != {"Regex": PIECES} or split.get("behavior") != "Removed" or not split.get("invert"):
        return False
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    return plain and not (spec.get("truncation") or spec.get("padding") or spec.get("post_processor"))


class BatchTokenizer:
    """Ids of many texts at a time; at most ``most_pieces`` different short pieces are remembered."""

    def __init__(self, path: str, most_pieces: int = 1_500_000, longest: int = 64) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cuts = _cuts_in_pieces(spec)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.most_pieces, self.longest = most_pieces, longest
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: bytes) -> list[int]:
        if piece.isalpha() or (piece.isascii() and piece.translate(_KINDS).count(_ODD) == 0):  # ASCII letters, a digit, or signs
            return [t.id for t in self.model.tokenize(piece.decode())]
        text = piece.decode()
        if text.isalpha() and max(text) < "\u0100":
            return [t.id for t in self.model.tokenize(self.byte_level.pre_tokenize_str(text)[0][0])]
        return self._whole(text)

    def _learn(self, pieces: list[bytes]) -> list[int]:
        """Where new pieces' ids are held, each as place * 2**24 + number."""
        found = [self._piece(p) for p in pieces]
        flat = np.fromiter((i for ids in found for i in ids), np.uint32)
        if self.used + len(flat) > len(self.held):
            self.held = np.append(self.held[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32))
        self.held[self.used : self.used + len(flat)] = flat
        places = []
        for ids in found:
            places.append(self.used << 24 | len(ids))
            self.used += len(ids)
        self.known.update((p, at) for p, at in zip(pieces, places, strict=True) if len(p) <= self.longest)
        return places

    def ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8, null is empty), and the number of each text."""
        if not self.cuts:
            found = [e.ids for e in self.library.encode_batch([(t or b"").decode() for t in texts], add_special_tokens=False)]
            return np.fromiter((i for f in found for i in f), np.uint32, sum(map(len, found))), np.array([len(f) for f in found], np.int64)
        own = {i: self._whole(t.decode()) for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        if own:
            texts = [None if i in own else t for i, t in enumerate(texts)]
        data, starts = joined(texts)
        kind = np.frombuffer(bytearray(data.tobytes().translate(_KINDS)), np.uint8)
        # Two bytes from C3 80 on are a Latin-1 letter, but for the signs of multiplication and division.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        lower = np.frombuffer(bytearray(data.tobytes().lower()), np.uint8)
        lower[lead + 1] += np.where(lower[lead + 1] < 0x9F, 0x20, 0).astype(np.uint8)
        # A new piece begins where the kind changes, and at each digit.
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        blank = kind == _SPACE
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):  # the whole chunk between blanks is one piece, as it stands
            heads = np.flatnonzero(~blank & np.append(True, blank[:-1]))
            ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
            for c in np.unique(np.searchsorted(heads, odd, side="right") - 1):
                s, e = heads[c], ends[c]
                begins[s + 1 : e] = False
                lower[s:e] = data[s:e]
        begins &= ~blank
        at = np.flatnonzero(begins)
        # A piece ends before the next one or a blank; all texts end with a line feed.
        bounds = np.flatnonzero(begins | blank)
        sizes = np.diff(bounds)[begins[bounds[:-1]]]
        place = np.append(0, np.cumsum(sizes))
        squeezed = lower[~blank]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(place), pa.py_buffer(squeezed)]).dictionary_encode()
        if self.used > 16 * self.most_pieces or len(self.known) > self.most_pieces:
            self._forget()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._learn([words[i] for i in new])
        of = places[pieces.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
        number = of & 0xFFFFFF
        upto = np.append(0, np.cumsum(number))
        out = self.held[np.arange(upto[-1]) + np.repeat((of >> 24) - upto[:-1], number)]
        per_text = np.diff(upto[np.searchsorted(at, starts)])
        for i, ids in own.items():
            spot_at = per_text[:i].sum()
            out = np.concatenate([out[:spot_at], np.array(ids, np.uint32), out[spot_at:]])
            per_text[i] = len(ids)
        return out, per_text


@lru_cache(maxsize=2)
def batch_tokenizer(path: str) -> BatchTokenizer:
    """One tokenizer for each file and worker process."""
    return BatchTokenizer(path)

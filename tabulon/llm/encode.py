"""Token ids of many texts by the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut where one space stands between two characters that are not white space, which is a place where the pre-tokenizer of
these vocabularies cuts too; so the ids of the pieces, one after the other, are the ids of the text. A piece of Latin characters is
cut by the vocabulary's own pattern and its words go straight to the library's BPE model; any other piece goes through the whole library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct pieces kept by a worker where nothing else is said; the memory is given back when they are so many.
KEPT = 200_000
#: Pieces of characters below this one are cut here; Unicode versions agree on them.
LATIN_END = "ɐ"
#: The pattern of byte-level pre-tokenizers that name none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ["Words, and more...", " it's 1234 (x)!", "Größe élève ñandú", " a\nb", "don't--stop", "ÀÉ", " $$$&&&", "İx", "é"]
_ENCODERS: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets show printable bytes as they are, the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        cuts = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.find = regex.compile(cuts[0] if cuts else BYTE_LEVEL).findall
        self.leading = self._whole([" a"]) != self._whole(["a"])
        self.most, self.direct = KEPT, True
        self.direct = all(self._direct(p) in (None, w) for p, w in zip(PROBES, self._whole(PROBES), strict=True))

    @classmethod
    def of(cls, path: str, most: int = KEPT) -> PieceEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        _ENCODERS[path].most = most
        return _ENCODERS[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _direct(self, piece: str, lead: str = "") -> bytes | None:
        if not self.direct or not piece or max(piece) >= LATIN_END or any(s in piece for s in self.special):
            return None
        if not piece.isascii() and self.nfc:
            piece = unicodedata.normalize("NFC", piece)
        if self.lower:
            piece = piece.lower() if piece.isascii() else "".join(map(str.lower, piece))
        if piece.isalpha():
            found = (lead + piece,)
        elif piece[-1] in ",." and piece[:-1].isalpha():
            found = (lead + piece[:-1], piece[-1])
        else:
            found = self.find(lead + piece)
        words = self.words
        for w in found:
            if w not in words:
                shown = w.encode().decode("latin-1").translate(self.letters)
                words[w] = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return b"".join([words[w] for w in found])

    def _learn(self, pieces: set[str], lead: str, kept: dict[str, bytes]) -> bool:
        """Adds the pieces; False if one has white space at an end, so that its text has to be cut with care."""
        rest = []
        for p in pieces:
            if not p or p[0].isspace() or p[-1].isspace():
                return False
            if (ids := self._direct(p, lead)) is None:
                rest.append(p)
            else:
                kept[p] = ids
        if rest:
            kept.update(zip(rest, self._whole([lead + p for p in rest]), strict=True))
        return True

    def _careful(self, text: str) -> bytes:
        pieces = _CUT.split(text)
        if self.leading:
            pieces[1:] = [" " + p for p in pieces[1:]]
        return b"".join(self._whole(pieces)) if text else b""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, of `kind`."""
        for cache in (self.kept, self.words):
            if len(cache) > self.most:
                cache.clear()
        kept, heads, lead, out = self.kept, {}, " " if self.leading else "", []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            head, *pieces = text.split(" ")
            new = {p for p in pieces if p not in kept}
            if (new and not self._learn(new, lead, kept)) or not self._learn({head}, "", heads):
                out.append(self._careful(text))
            else:
                out.append(heads[head] + b"".join([kept[p] for p in pieces]))
        return out

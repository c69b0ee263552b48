"""Token ids of texts by a tokenizer file, equal to the tokenizers library's without special tokens added.

Byte-level vocabularies whose ids follow their merges are encoded by tiktoken, which needs a third of the time;
texts with very long runs, which would be slow there, go to the library itself. Vocabularies with word
ends never merge across a blank, so their words are encoded once while they are remembered; words of
letters skip the library's general normalisation, which changes nothing but their case.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Pieces whose ids a worker keeps, about 200 bytes each; those not met again for a while go first.
KEPT_PIECES = 1_500_000

# Fixed value: the public pattern by which byte-level vocabularies of this kind cut texts into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LONG_RUN = re.compile(r"\S{400}|\s{400}")
_SIGN = frozenset(".,;:!?%&$*|#")
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+"
_SIGNS = r"[.,;:!?%&$*|#]+"
_PLAIN = re.compile(rf"{_LETTERS}(?:{_SIGNS})?(?:\n{_LETTERS}(?:{_SIGNS})?)*")
_PARTS = re.compile(rf"{_LETTERS}|{_SIGNS}|\n")
_WORD = re.compile(_LETTERS)


def byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes without one of their own follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Kept:
    """A dictionary of bounded size in two generations: what is used in the younger one stays."""

    def __init__(self, limit: int):
        self.limit = max(1, limit // 2)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys) -> list[str]:
        """The keys that are in neither generation; the others are in the younger one afterwards."""
        out = []
        for key in dict.fromkeys(keys):
            if key not in self.young:
                code = self.old.get(key)
                if code is None:
                    out.append(key)
                else:
                    self.young[key] = code
        return out

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        return Tokenizer.from_file(path), json.load(file)


class ByteEncoder:
    """Ids by a byte-level vocabulary. ``marks``: strings of added tokens in a text are read as their ids, as the library does; else as text."""

    def __init__(self, path: str, marks: bool = True):
        self.tokenizer, spec = _library(path)
        self.tokenizer.encode_special_tokens = not marks
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        value, names = byte_names(), spec["model"]["vocab"]
        ranks = {bytes(value[c] for c in name): i for name, i in names.items() if name not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        cutter = spec["pre_tokenizer"]
        simple = cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"] and not spec["normalizer"]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        self.fast = None
        if simple and plain and all(names[a + b] == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.marks = tuple(added) if marks else ()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or _LONG_RUN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif any(m in text for m in self.marks):
            ids = self.fast.encode(text, allowed_special="all")
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


class WordEncoder:
    """Ids by a vocabulary whose words carry an end mark; letters are made lower case and white space has no ids."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        from tokenizers import normalizers, pre_tokenizers

        self.tokenizer, spec = _library(path)
        self.bare, _ = _library(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(names.values()) + 1, dtype=bool)
        self.edge[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        stand_in = {b: c for c, b in byte_names().items()}
        letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
        self.fold = str.maketrans({c: "".join(stand_in[b] for b in c.lower().encode()) for c in letters})
        self.pieces, self.words, self.others = Kept(kept), Kept(kept), Kept(kept)

    def _alone(self, texts: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(texts), 1024):
            coded = self.tokenizer.encode_batch_fast(texts[start : start + 1024], add_special_tokens=False)
            out += [np.array(c.ids, dtype="<u4").tobytes() for c in coded]
        return out

    def _words(self, words: list[str]) -> None:
        """Ids of words of letters, in lower case and as bytes' stand-ins; many go to the library as one text."""
        parts = [words[i : i + 256] for i in range(0, len(words), 256)]
        coded = self.bare.encode_batch_fast([" ".join(p).translate(self.fold) for p in parts], add_special_tokens=False)
        for part, code in zip(parts, coded):
            ids = np.array(code.ids, dtype="<u4")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, (np.flatnonzero(self.edge[ids]) + 1).tolist(), strict=True):
                self.words.young[word] = raw[4 * begin : 4 * end]
                begin = end

    def _learn(self, missing: list[str]) -> None:
        """Words of letters, also with one sign behind them, are encoded apart; other pieces by their parts."""
        short, parted, odd = [], [], []
        for piece in missing:
            word, sign = (piece[:-1], piece[-1]) if piece[-1:] in _SIGN else (piece, "")
            if _WORD.fullmatch(word):
                short.append((piece, word.lower(), sign))
            elif _PLAIN.fullmatch(piece):
                parted.append((piece, [x.lower() for x in _PARTS.findall(piece)]))
            else:
                odd.append(piece)
        young = self.pieces.young
        if odd:
            young.update(zip(odd, self._alone([" " + p for p in odd])))
        heads = [w for _, w, _ in short] + [x for _, p in parted for x in p if x[0].isalpha()]
        if new := self.words.missing(heads):
            self._words(new)
        rest = [s for _, _, s in short if s] + [x for _, p in parted for x in p if not x[0].isalpha()]
        if new := self.others.missing(rest):
            self.others.young.update(zip(new, self._alone(new)))
        words, others = self.words.young, self.others.young
        for piece, word, sign in short:
            young[piece] = words[word] + others[sign] if sign else words[word]
        for piece, parts in parted:
            young[piece] = b"".join([words[x] if x[0].isalpha() else others[x] for x in parts])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; strings of added tokens are read as their ids."""
        if self.marks is not None and self.marks.search(text):
            return b"".join([self.added.get(part) or self._encode(part) for part in self.marks.split(text)])
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        for kept in (self.pieces, self.words, self.others):
            kept.turn()
        pieces = text.split(" ")
        codes = list(map(self.pieces.young.get, pieces))
        if None in codes:
            unseen = self.pieces.missing([p for p, c in zip(pieces, codes) if c is None])
            if unseen:
                self._learn(unseen)
            codes = map(self.pieces.young.__getitem__, pieces)
        return b"".join(codes)


def encoder(path: str, blank_leads: bool, kept: int = KEPT_PIECES) -> ByteEncoder | WordEncoder:
    """``blank_leads``: words of the vocabulary begin with their blank (byte-level); otherwise they carry an end mark and ``kept`` of them are remembered."""
    return ByteEncoder(path) if blank_leads else WordEncoder(path, kept)

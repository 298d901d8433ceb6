"""Byte-level BPE ids of whole texts: each pre-token is encoded by the tokenizers library once and then looked up."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

from furrow.llm.common import Generations, keeps, using

#: Bytes of pre-tokens and of what is made of them that a worker keeps, about, in two generations.
CACHED = 96 << 20


#: Texts of these characters alone are split by the built-in module, which gives the same parts for them as the library: ASCII, letters
#: of the Latin blocks up to U+024F, and dashes, quotes and the like. All others are split by the library itself, whose tables of letters
#: and digits are those of its own edition of Unicode.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_OTHER = re.compile(f"[^\\x00-\\x7f{_LETTERS}\u00a1\u00bf\u2010-\u2027\u20ac]")
_LATIN = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\t-\\r {_LETTERS}0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")


class _Cache(Generations):
    """Pre-token -> what `of` makes of its ids. spelled: pre-tokens are in the vocabulary's letters already, as the library's split has them."""

    def __init__(self, tokenizer, of, proven: dict, spelled: bool = False):
        super().__init__(CACHED // 2, proven)
        self.of, self.merge, self.spelled, self.letters = of, tokenizer.model.tokenize, spelled, _byte_letters()

    def make(self, word: str):
        return self.of([t.id for t in self.merge(word if self.spelled else word.encode().decode("latin-1").translate(self.letters))])


class Encoder:
    """Ids and counts of a byte_bpe .json, as the tokenizers library gives them for whole texts.

    Special strings inside a text become their own ids and split it, as is the library's default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("only a byte-level BPE with its own split pattern and no normalizer is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take white space with them aren't supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ids = self._counts = None
        self.unproven: frozenset[int] | None = None  # ids of vocabulary strings without a proof, once it has been made

    def _strings(self) -> dict[str, int]:
        """Vocabulary strings that are UTF-8, with their ids."""
        byte_of = {ord(c): b for b, c in _byte_letters().items()}
        texts = {}
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                texts[bytes(byte_of[ord(c)] for c in piece).decode("utf-8")] = i
            except (KeyError, UnicodeDecodeError):
                continue
        return {t: i for t, i in texts.items() if t and t not in self.special}

    def prove(self) -> frozenset[int]:
        """Ids of the vocabulary strings that don't encode alone as one token, from the vocabulary file alone.

        The library encodes each string once. A pre-token gives one token at least, so a string whose encoding is just its
        own id is one pre-token and its merges end in the whole; in a text, a pre-token equal to it has that id. All
        others, those whose merges stop short or that split, are what is returned: some hundreds.
        """
        if self.unproven is None:
            texts = self._strings()
            made = self.tokenizer.encode_batch(list(texts), add_special_tokens=False)
            self.unproven = frozenset(i for i, e in zip(texts.values(), made, strict=True) if e.ids != [i])
        return self.unproven

    def whole_tokens(self) -> dict[str, int]:
        """The proven vocabulary strings with their ids."""
        unproven = self.prove()
        return {t: i for t, i in self._strings().items() if i not in unproven}

    def _pieces(self, text: str):
        return [text] if self.parts is None or not any(s in text for s in self.special) else self.parts.split(text)

    def _spelled(self, text: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def id_bytes(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit numbers."""
        if self._ids is None:
            of = packed_ids
            self._ids = keeps("bpe", _Cache(self.tokenizer, of, {})), keeps("bpe", _Cache(self.tokenizer, of, {}, True))
        using("bpe")
        plain, spelled = self._ids
        out = []
        for p in self._pieces(text):
            if p in self.special:
                out.append(self.special[p].to_bytes(4, "little"))
            else:
                out += map(spelled.__getitem__, self._spelled(p)) if _OTHER.search(p) else map(plain.__getitem__, _LATIN.findall(p))
        return b"".join(out)

    def count(self, text: str) -> int:
        """Tokens of the text: whole tokens count directly, only the other pre-tokens are merged."""
        if self._counts is None:
            whole = self.whole_tokens()
            names = {i: p for p, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
            self._counts = keeps("bpe", _Cache(self.tokenizer, len, dict.fromkeys(whole, 1))), keeps("bpe", _Cache(self.tokenizer, len, dict.fromkeys(map(names.__getitem__, whole.values()), 1), True))
        using("bpe")
        plain, spelled = self._counts
        n = 0
        for p in self._pieces(text):
            if p in self.special:
                n += 1
            else:
                n += sum(map(spelled.__getitem__, self._spelled(p)) if _OTHER.search(p) else map(plain.__getitem__, _LATIN.findall(p)))
        return n


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """Which letter stands for which byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str, unproven: frozenset[int] | None = None) -> Encoder:
    """One encoder for each path and worker process; unproven: what prove() gave on the driver, so that a worker needn't repeat it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    if unproven is not None:
        _encoders[path].unproven = unproven
    return _encoders[path]


def crc32(body: bytes) -> int:
    return zlib.crc32(body) & 0xFFFFFFFF

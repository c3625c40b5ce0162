"""Token ids of whole texts with a public tokenizer, with a cache of words."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache, partial
from itertools import islice

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .memory import give_back

#: Bytes of pieces that a Python worker remembers, and those that a piece takes beside its letters. A full cache keeps
#: its older half, as frequent pieces come early.
WORD_BYTES, WORD_COST = 96 << 20, 190
#: Bytes of them that a worker still remembers when a partition has ended; the earliest, as for a full cache.
KEPT_BYTES = 20 << 20
#: Texts that are looked up together.
TEXTS = 200

# A stretch of these characters falls into runs of letters, single digits and runs of marks, whatever stands
# beside it: they are in composed form, and no mark among them starts a contraction or a special token.
_ODD = re.compile(r"[^ \t\n\r0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]|<\|")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
# The byte-level form of letters that have more than one byte.
_BYTES = {code: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0] for code in range(0xDF, 0x100)}
_GAP = re.compile(r"[ \n]")


def stretches(text: str) -> list[tuple[bool, str]]:
    """(whether it is plain, stretch): a chunk between spaces or line ends that holds any other character stays whole."""
    found, at = [], 0
    for odd in _ODD.finditer(text):
        if odd.start() < at:
            continue
        first = max(at, text.rfind(" ", at, odd.start()) + 1, text.rfind("\n", at, odd.start()) + 1)
        gap = _GAP.search(text, odd.end())
        if first > at:
            found.append((True, text[at:first]))
        at = gap.start() if gap else len(text)
        found.append((False, text[first:at]))
    if at < len(text):
        found.append((True, text[at:]))
    return found


# How the files of the known form clean and split a text.
KNOWN_STEPS = ["NFC", "Replace", "Lowercase"]
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _known_form(spec: dict) -> bool:
    """Whether a tokenizer file splits texts as ``stretches`` and ``_PIECES`` do."""
    model, steps = spec["model"], spec["normalizer"] or {}
    kinds = [n["type"] for n in steps.get("normalizers", [steps]) if n]
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    patterns = [p["pattern"].get("Regex") for p in splits if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
    rest = [p for p in splits if p["type"] != "Split"]
    bytes_only = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"]
    bpe = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix"))
    plain = not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    starts = all(t["content"].startswith("<|") for t in spec["added_tokens"])
    return bpe and kinds == KNOWN_STEPS and patterns == [KNOWN_PATTERN] and bytes_only and plain and starts


class Encoder:
    """Ids of texts as little-endian bytes, equal to those that the library gives for the whole text.

    Tokenizers of one known form, read from their file, lower-case, drop white
    space, split into runs of letters, single digits and runs of other marks, and
    close each with an end-of-word suffix. A space or line feed always separates,
    so a text is the sequence of its stretches, and a plain stretch is the sequence
    of its pieces. Texts go whole to the library for every other tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_pieces = _known_form(json.load(file))
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pack = partial(array, "H" if size <= 1 << 16 else "I")
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _learn(self, wanted: set[str]) -> None:
        if self.held > WORD_BYTES:
            self._keep(len(self.words) // 2)
        missing = wanted.difference(self.words)
        self.held += sum(map(len, missing)) + WORD_COST * len(missing)
        # The cleaning and splitting steps leave a word of these letters whole, so the merges alone give its ids.
        merged, words, pack = self.tokenizer.model.tokenize, self.words, self.pack
        other = []
        for word in missing:
            if _LETTERS.fullmatch(word):
                words[word] = pack([t.id for t in merged(word.translate(_BYTES))]).tobytes()
            else:
                other.append(word)
        words.update(zip(other, self._direct(other)))

    def _keep(self, number: int) -> None:
        self.words = dict(islice(self.words.items(), number))
        self.held = sum(map(len, self.words)) + WORD_COST * len(self.words)

    def settle(self) -> None:
        """Forget what goes beyond ``KEPT_BYTES``: a worker lives on, and other stages need its memory."""
        if self.held > KEPT_BYTES:
            self._keep(len(self.words) * KEPT_BYTES // self.held)
        give_back()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return [ids for at in range(0, len(texts), TEXTS) for ids in self._direct(texts[at : at + TEXTS])]
        out: list[bytes] = []
        pieces = _PIECES.findall
        for at in range(0, len(texts), TEXTS):
            split = []
            for text in texts[at : at + TEXTS]:
                if _ODD.search(text):
                    parts = [pieces(x.lower()) if plain else [x] for plain, x in stretches(text)]
                    split.append([x for part in parts for x in part])
                else:
                    split.append(pieces(text.lower()))
            self._learn(set().union(*split))
            word = self.words.__getitem__
            out += [b"".join(map(word, parts)) for parts in split]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, kept between tasks."""
    return Encoder(path)

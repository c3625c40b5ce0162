"""Exact token counts of every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import Scratch

#: Bytes of units, in each of two generations, and pairs that a Python worker remembers. A full generation
#: becomes the older one, out of which units that come again move up.
UNIT_BYTES, PAIRS = 80 << 20, 500_000
#: Longer units are computed each time.
UNIT_CHARS = 64
#: Bytes beside its characters that a remembered unit takes.
UNIT_COST = 250

# Classes of the characters below U+0250 and of general punctuation; any other one is replaced by one of its class.
_SPACES, _LETTERS, _NUMBERS = "\t-\r \x85\xa0 -     ", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
# White space and the piece after it. A contraction begins a piece only where no space joins its apostrophe.
_PIECE = f"(?<! )'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]+|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
_UNIT = re.compile(f"[{_SPACES}]*(?:{_PIECE})|[{_SPACES}]+")
_SPACE = re.compile(f"[{_SPACES}]*")
_CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)")
_LATER = re.compile(r"[^\u0000-ɏ -⁯]")


class PrefixCounter:
    """Token counts of all prefixes for a byte-level BPE file of the tokenizers library.

    The last token of a prefix is the one token that ends there and stands stably
    behind the last token of the prefix before it, so the count of a prefix is one
    more than that of the shorter one. Each prefix costs a few look-ups and no
    prefix is encoded.

    Raises ``ValueError`` for files with other models, splitting or added tokens
    that take neighbouring characters or hold one another.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        splits = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or not splits or spec["normalizer"]:
            raise ValueError("needs byte-level BPE that splits by its own pattern and changes no text")
        self.splitter = self.tokenizer.pre_tokenizer
        self._added(spec["added_tokens"])
        self._merges(model["merges"])
        self._drop_unreached()
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.held = 0
        self.classes: dict[int, str] = {}

    def _added(self, tokens: list[dict]) -> None:
        content = sorted((t["content"] for t in tokens), key=len, reverse=True)
        if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip")) or any(a != b and b in a for a in content for b in content):
            raise ValueError("added tokens must stand for themselves only")
        self.added = re.compile("|".join(map(re.escape, content))) if content else None

    def _merges(self, merges: list) -> None:
        """Tokens are numbered by the order in which they arise, single bytes first."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for pair in merges:
            left, right = (bytes(map(byte_of.__getitem__, x)) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if left not in self.number or right not in self.number or left + right in self.number:
                raise ValueError("each token must come from one merge of earlier tokens")
            ends = self.number[left], self.number[right]
            self.merged[ends] = self.number[left + right] = len(self.parts)
            self.parts.append(ends)
        self.longest = max(map(len, self.number))

    def _apart(self, a: int, b: int, end: float) -> bool:
        """Whether no merge before ``end`` joins a part that closes ``a`` to a part that opens ``b``."""
        x, x_gone = a, end
        while True:
            y, y_gone = b, end
            while True:
                made = self.merged.get((x, y))
                if made is not None and made < x_gone and made <= y_gone:
                    return False
                if y < 256:
                    break
                y, y_gone = self.parts[y][0], y
            if x < 256:
                return True
            x, x_gone = self.parts[x][1], x

    def _drop_unreached(self) -> None:
        """Leave the tokens whose own bytes are encoded as that token."""
        whole = [True] * 256
        for token in range(256, len(self.parts)):
            a, b = self.parts[token]
            whole.append(whole[a] and whole[b] and self._apart(a, b, token))
        self.number = {data: token for data, token in self.number.items() if whole[token]}

    def piece(self, text: str) -> list[int]:
        """Tokens of each prefix, the empty one first, of a text that is not split."""
        data = text.encode()
        counts, last = [0], [0]
        number, pairs, longest = self.number.get, self.pairs, self.longest
        for end in range(1, len(data) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):  # most last tokens are short
                token = number(data[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start] << 32 | token
                    stable = pairs.get(pair)
                    if stable is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        stable = pairs[pair] = self._apart(last[start], token, inf)
                    if not stable:
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
        if len(data) == len(text):
            return counts
        return [0] + [counts[i + 1] for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]

    def _unit(self, space: str, rest: str) -> list[int]:
        """Tokens of each prefix of white space and the piece behind it."""
        if space == " " and rest:
            return self.piece(" " + rest)
        run = self.piece(space)
        if not rest:
            return run
        head = self.piece(space[:-1])
        if space[-1:] == " ":
            tail = self.piece(" " + rest)
            return head + [run[-1]] + [head[-1] + c for c in tail[2:]]
        before = head[-1] + (self.piece(space[-1:])[-1] if space else 0)
        counts = self.piece(rest)
        if len(rest) == 3 and _CONTRACTION.fullmatch(rest):  # cut before its last letter it is no contraction
            counts[2] = counts[1] + self.piece(rest[1])[-1]
        return (head + [run[-1]] if space else [0]) + [before + c for c in counts[1:]]

    def _changes(self, unit: str, shape: str) -> list[int]:
        space = _SPACE.match(shape).end()
        counts = self._unit(unit[:space], unit[space:])
        return [b - a for a, b in zip(counts, counts[1:])]

    def _remember(self, unit: str, shape: str) -> None:
        older = self.older.get(unit, b"")
        if older != b"":
            self.units[unit] = older
        else:
            try:
                self.units[unit] = array("b", self._changes(unit, shape)).tobytes()
            except OverflowError:
                self.units[unit] = None
        self.held += UNIT_COST + 2 * len(unit)

    def _class(self, code: int) -> str:
        """A character that the library splits like this one."""
        found = self.classes.get(code)
        if found is None:
            pieces = lambda text: len(self.splitter.pre_tokenize_str(text))
            char = chr(code)
            found = "a" if pieces("a" + char) == 1 else "1" if pieces("1" + char) == 1 else "!" if pieces("!" + char) == 1 else "\n"
            self.classes[code] = found
        return found

    def _plain(self, text: str) -> np.ndarray:
        """Change of the count at each character of a text without added tokens."""
        shape = text
        if _LATER.search(text):
            shape = _LATER.sub(lambda m: self._class(ord(m[0])), text)
            cuts = [m.span() for m in _UNIT.finditer(shape)]
            units, shapes = [text[a:b] for a, b in cuts], [shape[a:b] for a, b in cuts]
        else:
            units = shapes = _UNIT.findall(text)
        distinct = set(units)
        missing = distinct.difference(self.units)
        if self.held + sum(map(len, missing)) * 2 + UNIT_COST * len(missing) > UNIT_BYTES:  # none may go while this text needs it
            self.older, self.units, self.held = self.units, {}, 0
            missing = distinct
        shape_of = dict(zip(units, shapes)) if units is not shapes else None
        own: dict[str, list[int]] = {}
        for u in missing:
            s = shape_of[u] if shape_of else u
            if len(u) > UNIT_CHARS or self.held > UNIT_BYTES:
                own[u] = self._changes(u, s)
            else:
                self._remember(u, s)
        if not own:
            parts = list(map(self.units.__getitem__, units))
            if None not in parts:
                return np.frombuffer(b"".join(parts), dtype=np.int8)
        found = [np.array(own[u] if u in own else self._known(u, s), dtype=np.int32) for u, s in zip(units, shapes)]
        return np.concatenate([*found, np.zeros(0, np.int32)])

    def _known(self, unit: str, shape: str) -> array | list[int]:
        """Changes of a short unit, anew where they did not fit into the cache's bytes."""
        data = self.units[unit]
        return self._changes(unit, shape) if data is None else array("b", data)

    def changes(self, text: str) -> np.ndarray:
        """By how much the token count changes at each code point; sums give the counts of the prefixes."""
        marks = list(self.added.finditer(text)) if self.added else []
        if not marks:
            return self._plain(text)
        found, at = [], 0
        for mark in marks:
            # Cut inside an added token, a text still has the open part as ordinary characters.
            part = self._plain(text[at : mark.end() - 1])
            inside = part[mark.start() - at :].sum(dtype=np.int64)
            found += [part, [1 - inside]]
            at = mark.end()
        return np.concatenate([*found, self._plain(text[at:])]).astype(np.int32)


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    """One counter for a Python worker."""
    return PrefixCounter(path)


def packed(changes: np.ndarray) -> bytes:
    """Width of a change in bytes, then the changes in one zstandard frame."""
    small = changes.astype(np.int8)
    width = 1 if (small == changes).all() else 4
    data = small if width == 1 else changes.astype("<i4")
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    """Token count of each non-empty prefix, shortest first."""
    changes = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.cumsum(np.frombuffer(changes, dtype=np.int8 if data[0] == 1 else "<i4"), dtype=np.int64)


def prefix_table(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, prefix_counts) of every row of ``df``.

    ``prefix_counts`` holds the exact token count of every prefix in code points;
    ``tokens_before`` and ``longest_prefix`` answer from it. Write the table to
    ask it often. Null and empty texts have no tokens; very long texts are taken
    whole, in memory proportional to one text; equal texts and repeated rows give
    a row each; a null key is kept; an empty table gives no rows; other columns
    of ``df`` play no part, whatever their names. Strings of added tokens count as
    the library counts them by default, as one token each.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefixes = counter(tokenizer)
        for batch in batches:
            changes = [prefixes.changes(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "n_bytes": batch["n_bytes"],
                    "n_chars": [len(c) for c in changes],
                    "n_tokens": [int(c.sum(dtype=np.int64)) for c in changes],
                    "prefix_counts": [packed(c) for c in changes],
                }
            )

    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("id"), value.alias("text"), F.octet_length(value).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(counted, f"id {kind}, n_bytes bigint, n_chars bigint, n_tokens bigint, prefix_counts binary")


def tokens_before(counts: Column, chars: Column) -> Column:
    """Exact tokens of the first ``chars`` code points, from a column ``prefix_counts``.

    A number below one gives 0, one beyond the text its whole count; null gives null.
    """

    @F.pandas_udf("bigint")
    def asked(data: pd.Series, at: pd.Series) -> pd.Series:
        found = [None if d is None or pd.isna(n) else unpacked(d)[: max(0, int(n))][-1:].sum() for d, n in zip(data, at)]
        return pd.Series(found, dtype="Int64")

    return asked(counts, chars.cast("long"))


def longest_prefix(table: DataFrame, budget: int, name: str = "fit_chars") -> DataFrame:
    """``table`` with the length in code points of the longest prefix of at most ``budget`` tokens.

    Counts may fall when a prefix grows, so the longest one is not the first that
    fits; texts within the budget are not unpacked. A negative budget gives null.
    """

    @F.pandas_udf("bigint")
    def fitting(data: pd.Series) -> pd.Series:
        fits = [np.flatnonzero(unpacked(d) <= budget) for d in data]
        return pd.Series([int(x[-1]) + 1 if len(x) else 0 for x in fits])

    if budget < 0:
        return table.withColumn(name, F.lit(None).cast("long"))
    within = F.col("n_tokens") <= budget
    return table.where(within).withColumn(name, F.col("n_chars")).unionByName(table.where(~within).withColumn(name, fitting("prefix_counts")))


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_chars) of every row, from a written ``prefix_table``.

    ``fit_chars`` is the most leading code points that ``limit`` tokens hold. Rows
    as for ``prefix_table``.
    """
    table = Scratch(df.sparkSession, "prefix").table(prefix_table(df, tokenizer, key, text), "counts")
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return longest_prefix(table, limit).select(F.col("id").alias(key), "n_bytes", "n_tokens", over, "fit_chars")

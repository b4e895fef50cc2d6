"""Token counts of every prefix of a text, for byte-level BPE vocabularies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word pattern of byte-level BPE pre-tokenizers (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = {"'re", "'ve", "'ll"}
WORDS = regex.compile(PATTERN)
#: The most common stretches: a word with or without the space before it, and one mark after it.
SIMPLE = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+([.,]?)")
#: Longest stretch, in characters, and number of stretches, of word beginnings and of pairs that a
#: worker remembers.  They bound its memory; what is forgotten is computed again.
REMEMBER_CHARS, REMEMBER_SPANS, REMEMBER_STARTS, REMEMBER_PAIRS = 64, 1_000_000, 100_000, 500_000
#: Bytes of a word's beginning that is remembered.
START = 6
ONE = [1]


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """An encoder for the vocabulary of a tokenizers file, with the same ids.

    It accepts byte-level BPE files without normalizer, prefix space or regular expression of their
    own whose ids are in merge order; special strings in a text are special tokens, that library's default.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and not pre["add_prefix_space"]
    odd = spec["normalizer"] or model.get("dropout") or model.get("ignore_merges")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    # byte-level files write printable Latin-1 bytes as themselves and the others from code 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        raise ValueError(f"{path}: ids are not in merge order")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class PrefixCounts:
    """Exact token counts of every prefix of a text.

    Within a word, a table over its bytes holds the last token of each prefix's encoding and its
    length in tokens.  The last token of a prefix is the only vocabulary entry that ends there and
    forms a stable pair with the last token of what precedes it, so each entry follows from shorter
    ones.  Words follow each other independently but for white space, whose last character joins the
    next word: a prefix that ends inside white space counts that white space as one word.
    """

    def __init__(self, path: str):
        self.enc = encoder(path)
        self.ids = dict(self.enc._mergeable_ranks)
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.special = re.compile("|".join(map(re.escape, self.enc._special_tokens)) or r"(?!)")
        # lengths of the tokens that end in two given bytes
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 1:
                lengths.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {k: [*sorted(v, reverse=True), 1] for k, v in lengths.items()}
        self.pairs: dict[int, bool] = {}
        self.starts: dict[bytes, tuple[list[int], list[int]]] = {}
        self.spans: dict[str, bytes] = {}

    def stable(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens encode to just these two."""
        if len(self.pairs) >= REMEMBER_PAIRS:
            self.pairs.clear()
        out = self.enc._encode_single_piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        self.pairs[left << 20 | right] = out
        return out

    def word(self, b: bytes) -> list[int]:
        """Tokens of b[:1], b[:2], ... for one word."""
        ids, pairs, lengths = self.ids, self.pairs, self.lengths
        begun = self.starts.get(b[:START])
        if begun:
            last, count = begun[0][:], begun[1][:]
        else:
            last, count = [-1], [0]
        for end in range(len(last), len(b) + 1):
            for n in lengths.get(b[end - 2 : end], ONE) if end > 1 else ONE:
                start = end - n
                if start < 0:
                    continue
                token = ids.get(b[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start] << 20 | token
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = self.stable(last[start], token)
                    if not ok:
                        continue
                last.append(token)
                count.append(count[start] + 1)
                break
            if end == START:
                if len(self.starts) >= REMEMBER_STARTS:
                    self.starts.clear()
                self.starts[b[:START]] = (last[:], count[:])
        return count[1:]

    def chars(self, word: str) -> list[int]:
        """As word(), for the characters of a word."""
        count = self.word(word.encode())
        if len(count) == len(word):
            return count
        out, at = [], -1
        for c in word:
            at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            out.append(count[at])
        return out

    def span(self, s: str) -> bytes:
        """Changes of the count per character of a stretch that begins with its white space."""
        simple = SIMPLE.fullmatch(s)
        if simple:
            out = self.chars(s[:-1] if simple[1] else s)
            if simple[1]:
                out.append(out[-1] + 1)
        else:
            out = self.any_span(s)
        steps = bytes([(x - y) & 255 for x, y in zip(out, [0, *out])])
        if len(s) <= REMEMBER_CHARS:
            if len(self.spans) >= REMEMBER_SPANS:
                self.spans.clear()
            self.spans[s] = steps
        return steps

    def any_span(self, s: str) -> list[int]:
        out: list[int] = []
        base, run_from, run_base = 0, None, 0
        for m in WORDS.finditer(s):
            a, e = m.span()
            w = s[a:e]
            if w.isspace():
                if run_from is None:
                    run_from, run_base = a, base
                out += [run_base + c for c in self.chars(s[run_from:e])[a - run_from :]]
                base += self.chars(w)[-1]
                continue
            counts = self.chars(w)
            end = counts[-1]
            if w in CONTRACTIONS:  # shorter prefixes are an apostrophe and a letter
                counts = [counts[0], counts[0] + self.chars(w[1])[0], end]
            elif w[0] == " " and run_from is not None:
                counts = [run_base + self.chars(s[run_from : a + 1])[-1] - base, *counts[1:]]
            out += [base + c for c in counts]
            base += end
            run_from = None
        return out

    def plain(self, text: str) -> bytes:
        """Changes per character of a text without special strings."""
        if re.search(r"\s ", text):
            parts = re.split(r"(?<=\S)(?= )", text)
        else:
            parts = text.split(" ")
            parts[1:] = [" " + p for p in parts[1:]]
        known, span = self.spans.get, self.span
        return b"".join([known(p) or span(p) for p in parts if p])

    def text(self, text: str) -> bytes:
        """Changes of the count per character of a whole text, as signed bytes; their sum is its count."""
        out, at = [], 0
        for m in self.special.finditer(text):
            part = self.plain(text[at : m.end()])  # the string is ordinary text until it is complete
            whole = total(self.plain(text[at : m.start()])) + 1
            out += [part[:-1], bytes([(whole - total(part[:-1])) & 255])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        try:
            return self.enc.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a stretch too long for that library's pattern matcher
            out, at = [], 0
            for m in [*self.special.finditer(text), None]:
                for w in WORDS.findall(text[at : m.start() if m else len(text)]):
                    out += self.enc._encode_single_piece(w)
                if m:
                    out.append(self.enc._special_tokens[m[0]])
                    at = m.end()
            return np.array(out, np.uint32)


def total(steps: bytes) -> int:
    """Tokens of the whole text of a table."""
    return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def tokens_at(steps: bytes) -> np.ndarray:
    """Tokens of the first 0, 1, 2, ... characters."""
    return np.concatenate([[0], np.frombuffer(steps, np.int8).cumsum(dtype=np.int64)])


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(tokens_at(steps) <= budget)[-1])


def count_tokens(
    docs: DataFrame,
    path: str,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = 512,
    budgets: tuple[int, ...] = (),
    steps: bool = True,
) -> DataFrame:
    """Token counts of whole texts from their prefix tables.

    Returns the columns of ``keep`` (those named as a result column are replaced), n_bytes, n_tokens,
    over_limit (n_tokens > limit), cut_N for each N of ``budgets`` (characters of the longest prefix of
    at most N tokens) and, with ``steps``, the table itself: one signed byte per character, the change
    of the count there; ``tokens_at`` and ``longest_prefix`` answer further questions from it.  A null
    text counts as empty: 0 bytes, 0 tokens, an empty table.  Every row stands for itself, so ties and
    repeated rows need no rule.  No shuffle; a worker remembers a bounded number of words.
    """
    made = ["n_bytes", "n_tokens", "over_limit", *[f"cut_{b}" for b in budgets], *(["steps"] if steps else [])]
    kept = [c for c in keep if c not in made]
    slim = docs.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType(
        [slim.schema[c] for c in kept]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
        + [T.StructField("over_limit", T.BooleanType())]
        + [T.StructField(f"cut_{b}", T.LongType()) for b in budgets]
        + ([T.StructField("steps", T.BinaryType())] if steps else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(path)
        for batch in batches:
            sizes, totals, tables, cuts = [], [], [], [[] for _ in budgets]
            for value in batch.column("_text"):
                t = value.as_py() or ""
                table = counter.text(t)
                sizes.append(len(t.encode()))
                totals.append(total(table))
                for n, c in zip(budgets, cuts):
                    c.append(longest_prefix(table, n))
                if steps:
                    tables.append(table)
            cols = [batch.column(c) for c in kept]
            cols += [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]
            cols += [pa.array([n > limit for n in totals], pa.bool_())]
            cols += [pa.array(c, pa.int64()) for c in cuts]
            cols += [pa.array(tables, pa.binary())] if steps else []
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *made])

    return slim.mapInArrow(run, schema)

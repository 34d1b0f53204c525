"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

A word starts as its byte symbols in a linked list. A heap holds every adjacent pair that has a
merge rule, by rank and then position; the lowest is popped and merged until none is left. The
number of tokens is the number of initial symbols minus the number of merges.

The vocabulary file is of the ``tokenizers`` library's kind with word ends: text is split at the
special strings (each is one token, the library's default), brought to NFC and lower case, and cut
into words by the file's pattern. The library's Unicode tables needn't be Python's: code points that the two treat
differently, and those that Python doesn't know, are found once, and a text that has one is
normalised and cut by the library's own normaliser and splitter.

Defined results: null and empty texts have no tokens; there is no truncation, and very long texts are cut into words
in blocks; repeated rows are counted row by row; other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from tokenizers import Regex, Tokenizer, pre_tokenizers

from loomwork.llm.common import worker_udf

#: Contractions and classes of the vocabulary file's pattern, for ASCII and for all text.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
ALL_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


#: Words are looked up in runs of this many, so that a very long text isn't held as a list of its words.
RUN = 1 << 16


def plain_lower(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def ranges(points: list[int]) -> str:
    """A character class of code points in ascending order."""
    starts = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    stops = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, stops)) + "]"


def differing(normaliser, splitter) -> list[int]:
    """Code points that Python doesn't know, or that it normalises or cuts in another way than the library does."""
    kind = [unicodedata.category(chr(c)) for c in range(0x110000)]
    known = [c for c, k in enumerate(kind) if k not in ("Cn", "Cs", "Co") and chr(c) != "|"]
    lower = normaliser.normalize_str("|".join(map(chr, known))).split("|")
    odd = {c for c, x in zip(known, lower) if x != plain_lower(chr(c)) and not (x == " " and chr(c).isspace())}
    # between a letter and a sign: a letter joins the first, a sign the second, a digit stands alone, a space goes
    probe = "\n".join(f"a{chr(c)}!" for c in known)
    of = lambda words: {c: [] for c in known} | words
    theirs: dict[int, list[str]] = {}
    for word, (start, _) in splitter.pre_tokenize_str(probe):
        theirs.setdefault(known[start // 4], []).append(word)
    ours: dict[int, list[str]] = {}
    for m in ALL_WORDS.finditer(probe):
        ours.setdefault(known[m.start() // 4], []).append(m[0])
    theirs, ours = of(theirs), of(ours)
    odd |= {c for c in known if theirs[c] != ours[c]}
    return [c for c, k in enumerate(kind) if k in ("Cn", "Cs") or c in odd]


def library_parts(path: str):
    """The library's normaliser, and its splitter of normalised texts."""
    with open(path, encoding="utf-8") as f:
        pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


@functools.cache
def odd_classes(path: str) -> tuple[str, str]:
    """Patterns of a character that may be odd, and of one that is.

    One quick look at each character; only a text that has one beyond U+FFFF, or an odd one, is held against all ranges."""
    odd = differing(*library_parts(path))
    return ranges([*(c for c in odd if c < 0x10000), *range(0x10000, 0x110000)]), ranges(odd)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class TokenCounter:
    """Counts tokens of texts under one vocabulary file. Words seen before are looked up."""

    def __init__(self, path: str, cache_words: int = 300_000, odd: tuple[str, str] | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        expected = model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
        if not expected:
            raise ValueError("not a plain BPE vocabulary")
        self.end = model.get("end_of_word_suffix") or ""
        # symbols are numbered as they turn up; pairs give (rank, merged symbol)
        number: dict[str, int] = {}
        num = lambda s: number.setdefault(s, len(number))
        self.first = [num(c) for _, c in sorted(byte_symbols().items())]
        self.last = [num(c + self.end) for _, c in sorted(byte_symbols().items())]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rules = {(num(a), num(b)): (rank, num(a + b)) for rank, (a, b) in enumerate(pairs)}
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.normaliser, self.splitter = library_parts(path)
        self.unusual, self.odd = map(re.compile, odd or odd_classes(path))
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def word(self, text: str) -> int:
        """Tokens of one word."""
        raw = text.encode("utf-8")
        symbol = [self.first[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        n = len(symbol)
        rules = self.rules
        if n == 1:
            return 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rule = rules.get((symbol[i], symbol[i + 1]))
            if rule:
                heap.append((rule[0], i, rule[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, merged = heapq.heappop(heap)
            if symbol[i] < 0 or (j := after[i]) >= n:
                continue
            rule = rules.get((symbol[i], symbol[j]))
            if rule is None or rule[0] != rank:
                continue  # the pair has changed since it was queued
            symbol[i], symbol[j] = merged, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if rule := rules.get((merged, symbol[k])):
                    heapq.heappush(heap, (rule[0], i, rule[1]))
            if (h := before[i]) >= 0 and (rule := rules.get((symbol[h], merged))):
                heapq.heappush(heap, (rule[0], h, rule[1]))
        return n - merges

    def _words(self, words: list[str]) -> int:
        cache, total = self.cache, 0
        try:
            return sum(map(cache.__getitem__, words))
        except KeyError:
            pass
        for w in words:
            n = cache.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= 64:
                    if len(cache) >= self.cache_words:
                        cache.clear()
                    cache[w] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        if text.isascii():
            text, pattern = text.lower(), ASCII_WORDS
        elif self.unusual.search(text) and self.odd.search(text):
            return self._words([w for w, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))])
        else:
            text, pattern = plain_lower(text), ALL_WORDS
        if len(text) <= RUN:
            return self._words(pattern.findall(text))
        total, words = 0, (m[0] for m in pattern.finditer(text))
        while run := list(itertools.islice(words, RUN)):
            total += self._words(run)
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not (n := len(self.special.findall(text))):
            return self._plain(text)
        return n + sum(map(self._plain, self.special.split(text)))


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(text: Column, vocabulary: str) -> Column:
    """A struct column (n_bytes, n_tokens) of whole texts; ``vocabulary`` is the file's path on the driver and on every worker.

    Odd code points are found once, on the driver, whose Python is that of the workers."""
    odd = odd_classes(vocabulary)

    @worker_udf("struct<n_bytes: bigint, n_tokens: bigint>")
    def count(texts: pa.Array) -> pa.Array:
        counter = _COUNTERS.get(vocabulary) or _COUNTERS.setdefault(vocabulary, TokenCounter(vocabulary, odd=odd))
        sizes, tokens = [], []
        for x in texts:
            t = x.as_py()
            sizes.append(len(t.encode("utf-8")) if t else 0)
            tokens.append(counter.count(t))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["n_bytes", "n_tokens"])

    return count(text)

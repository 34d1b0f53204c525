"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contaminated(text: str | None, items: list[tuple]) -> tuple:
    words, hit, found = WORD.findall(lower(text or "")), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1 if w else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def fingerprint(text: str | None, width: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fingerprints: list[int], r: int = 2) -> list[int]:
    """For each fingerprint the first index that links reach."""
    up = list(range(len(fingerprints)))

    def find(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for i, x in enumerate(fingerprints):
        for j in range(i):
            if (x ^ fingerprints[j]).bit_count() <= r:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fingerprints))]


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = lower(text or "").split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similar_components(texts: list[str | None], num: int = 4, den: int = 5) -> list[int]:
    """For each text the first index that links reach."""
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or (x or sets[j]) and den * len(x & sets[j]) >= num * len(x | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def repeats(texts: list[str | None], threshold: int = 100) -> list[tuple]:
    """(bytes, removed, spans, digest, kept bytes) of texts in order."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - threshold + 1):
            w = raw[p : p + threshold]
            if w in seen:
                gone[p : p + threshold] = b"\1" * threshold
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), sum(1 for run in bytes(gone).split(b"\0") if run), hashlib.sha256(kept).hexdigest(), kept))
    return out


def pieces(text: str, short: int = 96, long: int = 256) -> set[str]:
    """Lines, cut at the first end of a sentence behind ``short`` characters of a piece, or at ``long``."""
    out = set()
    for line in text.split("\n"):
        while line:
            end = min(len(line), short)
            if len(line) >= short:
                while end < min(len(line), long) and line[end] not in ".!?":
                    end += 1
                while end < len(line) and line[end] in ".!?":
                    end += 1
            out.add(line[:end])
            line = line[end:]
    return out


def likeness(a: str, b: str) -> float:
    a, b = pieces(a), pieces(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def _murmur(value: int, seed: int = 42) -> int:
    """Murmur3 (32 bits) of a long."""
    rot = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h = seed
    for k in (value & 0xFFFFFFFF, value >> 32 & 0xFFFFFFFF):
        k = rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def piece_digest(piece: str) -> int:
    top = xxhash.xxh64_intdigest(piece.encode(), 42) >> 19
    return top << 16 | _murmur(top) & 65535


def place(digest: int, t: int, s: int) -> int:
    """The cell of a digest in table t."""
    as_bytes = lambda x: x.to_bytes(8, "little")
    return 3 * (xxhash.xxh64_intdigest(as_bytes(t), xxhash.xxh64_intdigest(as_bytes(digest), 42)) & s - 1) + t


def sketch(text: str, s: int | None = None) -> tuple[int, int, dict[int, tuple[int, int]]]:
    """(tables' size, digests, cells as count and exclusive or)."""
    found = {piece_digest(p) for p in pieces(text)}
    s = s or 1 << (max(len(found), 16) - 1).bit_length()
    cells: dict[int, tuple[int, int]] = {}
    for x in found:
        for t in range(3):
            n, y = cells.get(c := place(x, t, s), (0, 0))
            cells[c] = (n + 1, y ^ x)
    return s, len(found), cells


def peeled(s: int, cells: dict[int, tuple[int, int]]) -> set[int] | None:
    """The digests of a sketch, found from its cells alone."""
    cells, got = dict(cells), set()
    while pure := [(c, x) for c, (n, x) in cells.items() if n == 1 and _murmur(x >> 16) & 65535 == x & 65535 and place(x, c % 3, s) == c]:
        for x in {x for _, x in pure}:
            got.add(x)
            for t in range(3):
                n, y = cells.pop(c := place(x, t, s))
                if (n - 1, y ^ x) != (0, 0):
                    cells[c] = (n - 1, y ^ x)
    return None if cells else got


def read_sketch(text: str) -> tuple[int, int, dict[int, tuple[int, int]]]:
    s, n, rest = text.split(";")
    cells = dict((int(c, 16), (int(k, 16), int(x, 16))) for c, k, x in (e.split(":") for e in rest.split(",") if e))
    return int(s, 16), int(n, 16), cells


def sketch_likeness(a: str, b: str) -> float:
    """Of two fingerprints, from nothing but these."""
    (sa, na, ca), (sb, nb, cb) = read_sketch(a), read_sketch(b)
    one, two = peeled(sa, ca), peeled(sb, cb)
    return 1 - len(one ^ two) / (na + nb) if na + nb else 1.0

"""Plain versions of the operators, for small inputs, written from their contracts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil

import xxhash


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(text: str) -> int:
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def components(nodes, links) -> dict:
    """Node -> least node that links reach."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in up}


# SimHash


def fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] > len(shingles) / 2)


def simhash(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint, component_id)."""
    fps = {d: fingerprint(t) for d, t in docs}
    least: dict[int, int] = {}
    for d, f in fps.items():
        least[f] = min(least.get(f, d), d)
    distinct = sorted(least)
    links = [(least[a], least[b]) for n, a in enumerate(distinct) for b in distinct[n + 1 :] if (a ^ b).bit_count() <= 3]
    comp = components(least.values(), links)
    return {d: (f"{f:016x}", comp[least[f]]) for d, f in fps.items()}


# line dedup


def line_dedup(texts: list[str | None]) -> dict[str, tuple[str, int]]:
    """Text -> (text without its recurring lines, number of lines dropped).

    A line of four tokens or more recurs if three texts hold lines of its leaf (as many tokens, the same first three) of which each agrees with one and
    the same line in 0.7 of the places, the line itself among them. A shorter one with a letter recurs if it is in ten texts and in more than words by
    their shares would put together.
    """
    lines: dict[str, list[str]] = {}
    for t in {t for t in texts if t is not None}:
        masked = re.sub(r"[^ \t\n\x0b\f\r0-9]*[0-9][^ \t\n\x0b\f\r]*", "<*>", re.sub(r"[ \t\r\x0b\f]+", " ", t))
        lines[t] = [x.strip(" ") for x in masked.split("\n")]
    size = lambda x: len(x.split(" ")) if x else 0
    holders: dict[str, set] = defaultdict(set)
    for t, own in lines.items():
        for x in own:
            holders[x].add(t)
    leaves: dict[tuple, list[list[str]]] = defaultdict(list)
    for x in holders:
        if size(x) >= 4:
            leaves[size(x), *x.split(" ")[:3]].append(x.split(" "))
    recurring = set()
    for members in leaves.values():
        for a in members:
            family = [" ".join(b) for b in members if sum(map(str.__eq__, a, b)) >= ceil(0.7 * len(a))]
            if len(set().union(*(holders[x] for x in family))) >= 3:
                recurring.update(family)
    words = lambda x: [w for w in re.split("[ \\n.,;:!?\"'()\\[\\]]", x.lower()) if w]
    all_rows = [x for t in texts if t is not None for x in lines[t]]
    total, uses = sum(map(size, all_rows)), Counter(w for x in all_rows for w in words(x))
    of_length = Counter(size(x) for x, ts in holders.items() for _ in ts)
    for x, ts in holders.items():
        if 0 < size(x) < 4 and len(ts) >= 10 and any(c.isalpha() for c in x):
            chance = of_length[size(x)] * 5 * 50.0 ** (size(x) - 1)
            for w in words(x):
                chance *= uses[w] / total
            if len(ts) >= chance:
                recurring.add(x)
    out = {}
    for t, own in lines.items():
        gone = {k for k, x in enumerate(own) if x in recurring}
        out[t] = ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)) if gone else (t, 0)
    return out


# decontamination


def tokens(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def overlaps(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> set[tuple[int, int, int]]:
    """(doc_id, item_id, offset) at which 13 tokens in a row (all, of a shorter item) agree in 80 of 100 at least. No place is skipped that could qualify: so many
    agreeing tokens among so few leave a run of agreeing ones, and all offsets with such a run are looked at."""
    out = set()
    grams: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
    own = [(i, tokens(t)) for i, t in items]
    for i, toks in own:
        if not toks:
            continue
        width = min(13, len(toks))
        need = ceil(Fraction(8, 10) * width)
        run = ceil(Fraction(need, width - need + 1))
        for at in range(len(toks) - run + 1):
            grams[run][tuple(toks[at : at + run])].append(((i, tuple(toks)), at))
    for d, text in docs:
        toks = tokens(text)
        seen = set()
        for run, table in grams.items():
            for at in range(len(toks) - run + 1):
                seen.update((i, at - place) for i, place in table.get(tuple(toks[at : at + run]), ()))
        for (i, item), start in seen:
            width = min(13, len(item))
            equal = [0 <= start + k < len(toks) and toks[start + k] == x for k, x in enumerate(item)]
            if max(sum(equal[k : k + width]) for k in range(len(item) - width + 1)) / width >= 0.8:
                out.add((d, i, start))
    return out

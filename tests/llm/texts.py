"""Small texts and brute-force answers for the tests."""

from __future__ import annotations

import random

import regex

WORDS = [f"w{i}" for i in range(400)]


def tokens(text):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", (text or "").lower()).split()


def shingles(text, width):
    t = tokens(text)
    return {tuple(t[i : i + width]) for i in range(len(t) - width + 1)} if len(t) >= 20 else set()


def similarity(a, b, width=3):
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y) if x and y else 0.0


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def family(seed, bases=12, copies=5):
    """Texts with near and far variants, exact copies, and odd ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = prose(rng)
        out.append(base)
        out += [edited(rng, base, rng.choice([0, 1, 2, 4, 6, 9, 14])) for _ in range(copies)]
    return [*out, None, "", "  ", "short text", "short text", "a b " * 30, "a b " * 31, "same " * 25, "same " * 40]


def groups(texts, threshold, width=3):
    """Root of each text that is in a group, by its place."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j], width) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    sizes = {}
    for i in range(len(texts)):
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    return {i: find(i) for i in range(len(texts)) if sizes[find(i)] > 1}

"""Plain versions of the operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def one_edit(a: list[str], b: list[str]) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def gone_lines(docs: list[tuple[int, str]], least: int, edit: int) -> dict[int, set[int]]:
    """Line numbers that go, by id, for documents with distinct ids."""
    seen: list[list[str]] = []
    first: dict[tuple, int] = {}
    gone: dict[int, set[int]] = {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        for i, line in enumerate((text or "").split("\n")):
            words = WORD.findall(line)
            if len(words) < least:
                continue
            if tuple(words) in first or len(words) >= edit and any(len(s) >= edit and one_edit(words, s) for s in seen):
                gone.setdefault(doc, set()).add(i)
            if tuple(words) not in first:
                first[tuple(words)] = doc
                seen.append(words)
    return gone


def runs(text: str | None, size: int = 5) -> frozenset:
    found = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))) if found else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def groups(docs: list[tuple[int, str]], percent: int = 80) -> dict[int, int]:
    """The least id that each id reaches over links."""
    sets = [(d, runs(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(d), top(e)
                parent[max(x, y)] = min(x, y)
    return {d: top(d) for d, _ in sets}


def counts(text: str | None) -> dict[str, int]:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    times = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_capitals": len(re.findall("[A-Z]", text)),
    }


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]

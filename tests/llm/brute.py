"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_pii(text: str | None) -> tuple[dict[str, int], str]:
    spans = []
    for k, (kind, pattern, ok) in enumerate(PII):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    counts = {kind: sum(s[1] == k for s in spans) for k, (kind, _, _) in enumerate(PII)}
    return counts, hashlib.sha256(",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def base_quality(text: str | None) -> list[int]:
    text = text or ""
    words = WORD.findall(text)
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j + d for at in seen.values() if len(at) > 1 for j in at for d in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def removed_bytes(docs: list[tuple[int, bytes]], k: int = 100) -> dict[int, list[bool]]:
    """Bytes covered by a k-byte string that also starts earlier."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, raw in sorted(docs):
        gone = [False] * len(raw)
        for i in range(len(raw) - k + 1):
            s = raw[i : i + k]
            if s in seen:
                gone[i : i + k] = [True] * k
            seen.add(s)
        out[doc_id] = gone
    return out


def shingles(text: str | None, width: int = 5) -> frozenset:
    """Shingles of white-space separated words, ASCII letters in lower case."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = WORD.findall((text or "").translate(fold))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def jaccard_links(docs: list[tuple[int, str | None]], threshold: float = 0.8) -> set[tuple[int, int]]:
    """Links between documents with different shingle sets (a < b), by an inverted index without any filter."""
    from collections import Counter

    sets = {d: shingles(t) for d, t in docs}
    holders: dict[tuple, list[int]] = {}
    for d in sorted(sets):
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    common: Counter = Counter()
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    return {(a, b) for (a, b), n in common.items() if sets[a] != sets[b] and n >= threshold * (len(sets[a]) + len(sets[b]) - n)}


def rebuilt_turns(rows: list[tuple], every: int | None, heads: int = 6) -> dict[int, list[tuple[str, str]]]:
    """Turns of each conversation in order; with ``every``, with the beginning of the conversation that starts its range."""
    import zlib

    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    if not every:
        return own
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    return {c: own.get(c - c % every, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def prefix_trie(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """Rows of the trie, from all prefixes of all conversations."""
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out: dict[tuple, tuple] = {}
    for path, m in sorted(members.items(), key=lambda e: -len(e[0])):
        d = len(path)
        below = [out[k] for k in {tuple(convs[c][: d + 1]) for c in m if len(convs[c]) > d}]
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == d)
        saved = (len(m) - 1) * (len(path[-1][1]) if d else 0) + sum(r[6] for r in below)
        parent = min(members[path[:-1]]) if d else None
        out[path] = (min(m), d, parent, len(m), len(below), sum(r[5] for r in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def components(rows: list[tuple[int | None, str | None]], percent: int) -> list[tuple]:
    """``doc_id, n_shingles, component_id, kept`` of each row, by sets; an empty set is alone, a null id takes no part."""
    from collections import Counter

    sets = [shingles(t) for _, t in rows]
    first: dict[frozenset, int] = {}
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        if rows[i][0] is None or not s:
            continue
        j = first.setdefault(s, i)
        parent[top(i)] = top(j)
        if i == j:
            for x in s:
                holders.setdefault(x, []).append(i)
    common = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[top(a)] = top(b)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [(d, len(s), None if d is None else low[top(i)], d is None or low[top(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]

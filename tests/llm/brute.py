"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def exact(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups: dict[str, list] = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t.encode())) for i, t in norm.items()}


def substrings(rows, width=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffixes(rows, width=200):
    data = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k : k + width] for b in data.values() for k in range(len(b) - width + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def near(rows, k=4, least=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def conversations(rows):
    """Threads of messages (conv_id, turn, role, text): {(conv_id, root): [(turn, parent, chat) in reply order]}."""

    def normal(text):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip().lower()

    messages = {}
    for conv, turn, role, text in rows:
        lines = []
        for raw in re.split(r"\r\n|\r|\n", text or ""):
            level, at = 0, 0
            while True:
                k = at
                while k < len(raw) and raw[k] in " \t":
                    k += 1
                if k < len(raw) and raw[k] == ">":
                    level, at = level + 1, k + 1
                else:
                    break
            lines.append((level, raw[at:]))
        shown = []
        for k, (level, content) in enumerate(lines):
            follows = lines[k + 1][0] if k + 1 < len(lines) else 0
            shown.append((follows, "") if level == 0 and follows and re.match(r"On .+ wrote:\s*$", content) else (level, content))
        units, paragraph = set(), []
        for level, content in [*shown, (0, "")]:
            if paragraph and (not content.strip(" ") or level != paragraph[0][0]):
                units.add((paragraph[0][0], normal(" ".join(c for _, c in paragraph))))
                paragraph = []
            if content.strip(" "):
                paragraph.append((level, content))
        units |= {(level, normal(content)) for level, content in shown}
        own = re.sub(r"\n{3,}", "\n\n", "\n".join(c for level, c in shown if level == 0)).strip()
        messages[conv, turn] = ({u for u in units if u[1]}, f"<|{role or 'unknown'}|>\n{own}\n")
    parent = {}
    for (conv, turn), (units, _) in messages.items():
        votes = Counter()
        for level, unit in units:
            origin = min((t for (c, t), (other, _) in messages.items() if c == conv and (0, unit) in other), default=turn)
            if level and origin < turn:
                votes[level, origin] += len(unit)
        if votes:
            level = min(k[0] for k in votes)
            parent[conv, turn] = max((size, origin) for (k, origin), size in votes.items() if k == level)[1]
    threads = {}
    for conv, turn in messages:
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        threads.setdefault((conv, root), []).append((depth, turn))
    return {k: [(t, parent.get((k[0], t), -1), messages[k[0], t][1]) for _, t in sorted(v)] for k, v in threads.items()}

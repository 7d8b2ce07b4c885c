"""Plain versions of the operators, written from their definitions, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def fingerprint(text, k=3):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """prints: list of (id, fingerprint); the smallest id reachable from each row."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(prints))]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(kind, *m.span()) for kind, (pattern, ok) in checks.items() for m in re.finditer(pattern, text) if ok(m.group())]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def license_scan(text, phrases, templates, threshold):
    low = ascii_lower(text or "")
    words = LICENSE_WORD.findall(low)
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    shares = {}
    lines = [w for w in map(LICENSE_WORD.findall, low.split("\n")) if w]
    for i in range(max(1, len(lines) - 3)):  # blocks of four lines
        block = {w for line in lines[i : i + 4] for w in line}
        for label, t in templates.items():
            want = set(LICENSE_WORD.findall(ascii_lower(t)))
            if want and len(want & block) >= math.ceil(threshold * len(want) - 1e-9):
                shares[label] = max(shares.get(label, 0), len(want & block) / len(want))
    base = sorted({x for _, x in places})
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *shares})), max(shares.values(), default=0.0))


def equal_groups(rows):
    """rows: list of (id, text); per row (keep_id, group_size), and per group whether exactly one row is to stay."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[ascii_lower(text or "")].append(i)
    largest = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
    return {t: (largest(ids), len(ids)) for t, ids in groups.items()}


def runs(nodes, fanout):
    return [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]


def tree_levels(nodes, fanout=16):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(r)) for r in runs(levels[-1], fanout)])
    return levels


def merkle(rows, fanout=16):
    """rows: list of (id, source, leaf, tampered leaf or None); per row (id, leaf, subroot, root, proof, folded), in the order of the trees."""
    order = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    sources = sorted({r[1] for r in rows}, key=order)
    of_source = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (order(r[0]), r[2])) for s in sources}
    trees = {s: tree_levels([r[2] for r in of_source[s]], fanout) for s in sources}
    top = tree_levels([trees[s][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(of_source[s]):
            proof, node = [], r[3] or r[2]
            for levels, place in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    start = place - place % fanout
                    before, after = level[start:place], level[place + 1 : start + fanout]
                    proof += before + after
                    node = sha("".join([*before, node, *after]))
                    place //= fanout
            out.append((r[0], r[2], trees[s][-1][0], top[-1][0], sha("".join(proof)), node))
    return out


def trie(convs):
    """convs: {id: list of (role, text)}; a tuple for each node, from its definition."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in inside if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((inside[0], len(path), parent, len(inside), children(path), sum(children(p) == 0 for p in below), saved, sha(ends)))
    return out

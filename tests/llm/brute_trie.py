"""Prefix trie by plain prefixes, for comparison."""

import hashlib
import zlib
from collections import defaultdict


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[p]) or 1
        saved = sum(below[k][1] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        below[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(seqs[c]) == len(p)))
        out.append(
            (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved,
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out)

"""Changes of files found the plain way, in memory, for small inputs."""

import json
import re
from collections import Counter


def kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "fraction"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def text(v):
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))


def profile(rows):
    place, types, ids = {}, {}, Counter()
    for r in rows:
        for i, (k, v) in enumerate(r.items()):
            place[k] = max(place.get(k, 0), i)
            if v is not None:
                types.setdefault(k, Counter())[kind(v)] += 1
                ids[k] += bool(re.fullmatch(r"\d{15,20}", str(v)))
    best = {k: min(c, key=lambda t: (-c[t], t)) for k, c in types.items()}
    return place, best, ids.most_common(1)[0][0] if ids else None


def changes(files):
    """files: list of (feed, seq, file, rows as dicts)."""
    out = set()
    by_feed = {}
    for feed, seq, name, rows in files:
        by_feed.setdefault(feed, []).append((seq, name, rows))
    for group in by_feed.values():
        group.sort(key=lambda x: x[:2])
        for (_, _, old), (_, name, new) in zip(group, group[1:]):
            pa, ta, ia = profile(old)
            pb, tb, ib = profile(new)
            a = {str(r[ia]): r for r in old if ia in r}
            b = {str(r[ib]): r for r in new if ib in r}
            shared = [k for k in a if k in b]
            renamed = {}
            for w in sorted(set(pb) - set(pa)):
                for v in sorted(set(pa) - set(pb)):
                    equal = sum(a[k].get(v) is not None and text(a[k].get(v)) == text(b[k].get(w)) for k in shared)
                    compared = sum(a[k].get(v) is not None or b[k].get(w) is not None for k in shared)
                    if equal and equal * 10 >= 6 * compared:
                        renamed[w] = v
            pair = {k: k for k in pb if k in pa} | renamed
            out |= {(name, "removed", k) for k in pa if k not in pb and k not in renamed.values()}
            out |= {(name, "added", k) for k in pb if k not in pair}
            out |= {(name, "renamed", k) for k in renamed}
            out |= {(name, "retyped", k) for k, v in pair.items() if tb.get(k) and ta.get(v) and tb[k] != ta[v]}
            if sorted(pair, key=lambda k: pb[k]) != sorted(pair, key=lambda k: pa[pair[k]]):
                out.add((name, "reordered", "*"))
    return out

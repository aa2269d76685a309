"""Plain-Python reference implementations used to check the Spark operators on small inputs."""

from __future__ import annotations


def _key(v):
    return (v is not None, v)


def scd2_changes(rows, keys, seq, attrs, tracked):
    """rows: list of dicts.  Returns a sorted list of version tuples (keys, attrs, seq, start, end)."""
    by_key = {}
    for r in rows:
        by_key.setdefault(tuple(r[k] for k in keys), {}).setdefault(r[seq], []).append(r)
    out = []
    for k, per_seq in by_key.items():
        ordered = []
        for s in sorted(per_seq, key=_key):
            cands = per_seq[s]
            ordered.append(min(cands, key=lambda r: tuple(_key(r[a]) for a in attrs)))
        versions = []
        for r in ordered:
            t = tuple(r[c] for c in tracked)
            if versions and versions[-1]["t"] == t:
                versions[-1]["last"] = r
            else:
                versions.append({"t": t, "start": r[seq], "last": r})
        for i, v in enumerate(versions):
            end = versions[i + 1]["start"] if i + 1 < len(versions) else None
            out.append((*k, *(v["last"][a] for a in attrs), v["last"][seq], v["start"], end))
    return sorted(out, key=lambda t: tuple(_key(x) for x in t))


def scd2_snapshots(snapshots, keys, attrs, tracked, times):
    """snapshots: list (in load order) of lists of dicts; times: load time per snapshot."""
    state = {}  # key -> open version dict
    closed = []
    for i, snap in enumerate(snapshots):
        t = times[i]
        seen = set()
        for r in snap:
            k = tuple(r[c] for c in keys)
            seen.add(k)
            cur = state.get(k)
            if cur is not None and tuple(cur["row"][c] for c in tracked) == tuple(r[c] for c in tracked):
                cur["row"] = r
            else:
                if cur is not None:
                    closed.append((cur["row"], cur["start"], t))
                state[k] = {"row": r, "start": t}
        for k in list(state):
            if k not in seen:
                closed.append((state[k]["row"], state[k]["start"], t))
                del state[k]
    allv = closed + [(v["row"], v["start"], None) for v in state.values()]
    out = [(*(row[c] for c in keys), *(row[a] for a in attrs), s, e) for row, s, e in allv]
    return sorted(out, key=lambda t: tuple(_key(x) for x in t))

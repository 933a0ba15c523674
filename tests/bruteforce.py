"""Nested-loop reference semantics, used only to check the blocked joins on small inputs."""
import re


def phrase_pairs(names, texts):
    out = set()
    for nid, n in names:
        if n is None:
            continue
        pat = re.compile(r"(^|\W)" + re.escape(n.lower()) + r"(\W|$)")
        for tid, t in texts:
            if t is not None and pat.search(t.lower()):
                out.add((nid, tid))
    return out


def contains_pairs(names, texts):
    return {(nid, tid) for nid, n in names if n for tid, t in texts if t is not None and n in t}


def greedy_groups(order, links, jobs):
    """Sequential one-hop grouping as in the reference: returns {group_name: sorted members}."""
    checked, groups = set(), []
    for name in order:
        if name in checked:
            continue
        g = {name}
        checked.add(name)
        for t in links.get(name, []):
            if t in jobs:
                g.add(t)
                checked.add(t)
        groups.append(g)
    return {" + ".join(sorted(g)): sorted(g) for g in groups}

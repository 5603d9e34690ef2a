"""Small sequential algorithms on one graph at a time, for use inside grouped functions.

Their results depend on the order of work, so the order is fixed inside: nothing relies on how rows arrive.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

_NODE = re.compile(r"(\w+)\s*(\(\[(?P<proc>.*?)\]\)|\[(?P<box>.*?)\]|\((?P<round>.*?)\))")
_EDGE = re.compile(r"^\s*(\w+)(?:[\[(].*?[\])]+)?\s*-->\s*(?:\|.*?\|\s*)?(\w+)")
# Labels of steps that only gather, and the number of incoming edges from which a step counts as one.
GATHERERS, GATHERING_EDGES = ("version", "multiqc", "mqc"), 5


def break_cycles(edges: list[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """Of (rank, a, b) edges, taken in order, those that close no cycle with the ones taken before."""
    after: dict[str, set[str]] = defaultdict(set)
    taken = set()
    for _, a, b in sorted(set(edges)):
        todo, seen = [b], {b}
        while todo:
            for n in after[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        if a not in seen:
            after[a].add(b)
            taken.add((a, b))
    return sorted(taken)


def smallest_order(edges: list[tuple[str, str]]) -> list[str]:
    """The least topological order, by name, of the nodes on edges; members of cycles and what follows them are left out."""
    after, waits = defaultdict(set), defaultdict(int)
    for a, b in set(edges):
        after[a].add(b)
        waits[b] += 1
        waits[a] += 0
    ready = [n for n, k in waits.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(n := heapq.heappop(ready))
        for b in after[n]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, b)
    return out


def process_edges(text: str) -> list[tuple[int, str, str]]:
    """(rank, producer, consumer) labels of a mermaid flow chart.  Stadium nodes are processes; a producer reaches the
    first processes behind it over nodes that are neither processes nor gatherers.  The rank is the number in the
    producer's node name, the least of its nodes."""
    processes, labels, after, incoming = {}, {}, defaultdict(list), defaultdict(int)
    for line in text.splitlines():
        for m in _NODE.finditer(line):
            if m["proc"] is not None:
                processes[m[1]] = m["proc"].strip(' "').rsplit(":", 1)[-1]
            labels[m[1]] = (m["proc"] or m["box"] or m["round"] or "").lower()
        if m := _EDGE.match(line):
            after[m[1]].append(m[2])
            incoming[m[2]] += 1
    gathers = {n for n in {*labels, *incoming} if any(g in labels.get(n, "") for g in GATHERERS) or incoming[n] >= GATHERING_EDGES}
    best: dict[tuple[str, str], int] = {}
    for start, name in processes.items():
        digits = re.sub(r"\D", "", start)
        rank = int(digits) if digits else 0
        todo, seen = list(after[start]), set()
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            if n in processes:
                if processes[n] != name:
                    key = (name, processes[n])
                    best[key] = min(rank, best.get(key, rank))
            elif n not in gathers:
                todo += after[n]
    return sorted((r, a, b) for (a, b), r in best.items())


def match_steps(gold: list[str], predicted: list[str], same: set[tuple[str, str]]) -> dict[int, int]:
    """A largest matching of gold to predicted positions, each step matching itself or an equivalent; gold steps are
    placed in order and try their own name first."""
    options = [sorted((j for j, p in enumerate(predicted) if p == g or (g, p) in same or (p, g) in same), key=lambda j, g=g: (predicted[j] != g, j)) for g in gold]
    holder: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in options[i]:
            if j not in seen:
                seen.add(j)
                if j not in holder or place(holder[j], seen):
                    holder[j] = i
                    return True
        return False

    for i in range(len(gold)):
        place(i, set())
    return {i: j for j, i in holder.items()}


def parse_answer(text: str | None) -> list[str] | None:
    """The names in the first bracketed span of a text that is a list with a usable name, or an empty list; None without."""
    import json

    if text is None:
        return None
    for start in (i for i, c in enumerate(text) if c == "["):
        depth, quoted, k = 0, False, start
        while k < len(text):
            c = text[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "[]":
                depth += 1 if c == "[" else -1
                if not depth:
                    break
            k += 1
        if depth:
            continue
        try:
            value = json.loads(text[start : k + 1])
        except ValueError:
            continue
        names = [x.strip() for x in value if isinstance(x, str) and x.strip()]
        if names or not value:
            return names
    return None

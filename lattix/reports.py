"""Text reports of small collected results."""

from __future__ import annotations

from collections.abc import Iterable

RULE = "=" * 70


def _section(title: str, lines: Iterable[str]) -> list[str]:
    return ["", RULE, title, RULE, *(f"  {x}" for x in lines)]


def audit_text(checks: list, coverage: list, same_as: list, counts: dict[str, int]) -> str:
    """The whole audit: invariants, how many nodes there are, candidate equivalences and coverage."""
    say = lambda r: f"[PASS] {r['name']}" if r["ok"] else f"[FAIL ({r['violations']} violation(s))] {r['name']}"
    failed = sum(not r["ok"] for r in checks)
    out = _section("INVARIANTS", map(say, sorted(checks, key=lambda r: r["name"])))
    out += _section("NODES AND EDGES", (f"{k}: {n}" for k, n in counts.items()))
    out += _section("SAME_AS CANDIDATES (informational)", [f"total: {sum(r['n'] for r in same_as)}", *(f"{r['basis']}: {r['n']}" for r in sorted(same_as, key=lambda r: r["basis"]))])
    out += _section("METHOD COVERAGE (informational)", (f"{r['metric']}: {r['n']} ({r['percent']}%)" for r in sorted(coverage, key=lambda r: r["metric"])))
    return "\n".join([*out[1:], "", RULE, f"AUDIT RESULT: {failed} CHECK(S) FAILED" if failed else "AUDIT RESULT: ALL CHECKS PASSED", RULE])


def verdict_text(owner: str, verdict, gates: list) -> str:
    lines = [f"{verdict['status']}  ({owner})"]
    if verdict["refusal_reason"]:
        lines.append(f"  refusal: {verdict['refusal_reason']}")
    if verdict["required_facts"]:
        lines.append(f"  facts needed: {', '.join(verdict['required_facts'])} (give them as --fact key=value)")
    for g in sorted(gates, key=lambda g: (g["phase"] == "post_run", g["assumption"])):
        if g["phase"] == "post_run":
            lines.append(f"  [POST-RUN] {g['assumption']}: run {', '.join(g['diagnostics'])}")
        else:
            asked = f"{g['key']} supplied={g['supplied']} >= {g['threshold']}?" if g["key"] else "to be checked by hand"
            lines.append(f"  [{g['result']}] {g['assumption']}: {asked}")
    return "\n".join(lines)


def chain_text(chain, steps: list, handoffs: list) -> str:
    """Steps (ord, method_id, status) of a chain with what goes from each to the next."""
    after = {h["ord"]: h for h in handoffs}
    lines = [f"CHAIN: {chain['status']}"]
    for s in sorted(steps, key=lambda s: s["ord"]):
        lines.append(f"  [{s['status']}] step {s['ord']}: {s['method_id']}")
        if h := after.get(s["ord"]):
            lines.append(f"    --handoff--> [{h['handoff']}]" + (f" via {', '.join(h['shared'])}" if h["shared"] else ""))
    return "\n".join(lines)


def traces_text(owner: str, contract: list, floors: Iterable[str]) -> str:
    """Why a method has the preconditions it has: each assumption with its phase, floors, way and evidence."""
    if not contract:
        return f"{owner}: no evaluability chain"
    lines = [f"{owner}: {len(contract)} grounded assumption(s)"]
    for r in contract:
        gate = " ".join([r["checkable"] or "?", *(f"{d}={r[d]}" for d in floors if r[d] is not None)])
        lines += [f"  {r['assumption']}  [{gate}]", f"      via:      {'; '.join(r['via']) or '(direct)'}  (source={r['source']})", f"      evidence: {r['evidence'] or '(none)'}"]
    return "\n".join(lines)

"""The state of one task under its action log.

The state is a plain dictionary, so that a batch fold holds it as it is and a
stream keeps it as JSON. Entries that refer to something the state does not
have are refused; a refused entry ends the replay, and the state stays as it
was before it.
"""

from __future__ import annotations

import json

TERMINAL = ("COMPLETED", "FAILED")
# Operations that move a tool execution or a model call on, with family, id field, and state.
STARTS = {"START_TOOL_EXECUTION": ("tools", "executionId"), "START_LLM_CALL": ("calls", "callId")}
MOVES = {
    "COMPLETE_TOOL_EXECUTION": ("tools", "executionId", "SUCCEEDED"), "FAIL_TOOL_EXECUTION": ("tools", "executionId", "FAILED"),
    "COMPLETE_LLM_CALL": ("calls", "callId", "COMPLETED"), "TIMEOUT_LLM_CALL": ("calls", "callId", "TIMED_OUT"), "MARK_LLM_CALL_RETRY": ("calls", "callId", "RETRY_PENDING"),
}
RETRYABLE = ("TIMED_OUT", "RETRY_PENDING")
MOST_ACTIVE = 10

OUTPUT = (
    "task_id string, applied bigint, last_seq bigint, status string, finalization string, context string, tools string, calls string, nodes string, edges string, "
    "branches string, conversations string, current_node string, current_branch string, error string, error_seq bigint"
)


class Refused(Exception):
    """An entry that the state can't take; the message is the reason."""


def new_state() -> dict:
    return {
        "seq": 0, "applied": 0, "error": None, "error_seq": None, "status": "RUNNING", "final": "NONE", "node": None, "branch": None,
        "ctx": {}, "nodes": {}, "edges": [], "tools": {}, "calls": {}, "branches": {}, "talks": {},
    }


def _reaches(edges: list, src: str, dst: str) -> bool:
    after: dict[str, list[str]] = {}
    for a, b, *_ in edges:
        after.setdefault(a, []).append(b)
    front, seen = [src], {src}
    while front:
        n = front.pop()
        if n == dst:
            return True
        fresh = [x for x in after.get(n, ()) if x not in seen]
        seen.update(fresh)
        front += fresh
    return False


def _link(s: dict, src: str | None, dst: str | None, kind: str | None) -> None:
    if src not in s["nodes"] or dst not in s["nodes"]:
        raise Refused("UNKNOWN_NODE")
    if [src, dst, kind] in s["edges"]:
        return
    if _reaches(s["edges"], dst, src):
        raise Refused("CYCLE")
    s["edges"].append([src, dst, kind])


def _put_node(s: dict, node: str, kind: str | None, branch: str | None, ts: int | None, status: str = "PENDING") -> None:
    s["nodes"][node] = {"type": kind, "status": status, "branch": branch or None, "ts": ts}
    s["node"] = node


def _newest(s: dict, ids: list[str]) -> str | None:
    """Node of the last time; one without time counts as last."""
    at = lambda n: (s["nodes"][n]["ts"] is None, s["nodes"][n]["ts"] or 0, n)
    return max(ids, key=at, default=None)


def _active(s: dict, branch: str | None) -> dict:
    b = s["branches"].get(branch)
    if b is None or b["status"] != "ACTIVE":
        raise Refused("NO_ACTIVE_BRANCH")
    return b


def _nodes(s: dict, op: str, p: dict, ts: int | None) -> None:
    node = p.get("nodeId")
    if op == "APPEND_NODE":
        # taken back as a whole if its edge is refused
        before, was = s["nodes"].get(node), s["node"]
        _put_node(s, node, (p.get("type") or "").upper(), p.get("branchId"), ts)
        if "targetNodeId" in p and "edgeType" in p:
            try:
                _link(s, p["targetNodeId"], node, p["edgeType"])
            except Refused:
                s["node"] = was
                if before is None:
                    del s["nodes"][node]
                else:
                    s["nodes"][node] = before
                raise
    elif op == "COMPLETE_NODE":
        if node not in s["nodes"]:
            raise Refused("UNKNOWN_NODE")
        s["nodes"][node]["status"] = "COMPLETED"
    elif op == "ADD_EDGE":
        _link(s, p.get("sourceNodeId"), p.get("targetNodeId"), p.get("dependencyType"))
    elif s["nodes"].pop(node, None):
        s["edges"] = [e for e in s["edges"] if node not in e[:2]]
        if s["node"] == node:
            inner = {e[0] for e in s["edges"]}
            s["node"] = _newest(s, [n for n in s["nodes"] if n not in inner])


def _branches(s: dict, op: str, p: dict, seq: int) -> None:
    if op == "CREATE_BRANCH":
        if p.get("sourceNodeId") not in s["nodes"]:
            raise Refused("UNKNOWN_NODE")
        if sum(b["status"] == "ACTIVE" for b in s["branches"].values()) >= MOST_ACTIVE:
            raise Refused("TOO_MANY_BRANCHES")
        own, fork = p.get("branchId") or f"branch-{seq}", p.get("forkNodeId") or f"fork-{seq}"
        _put_node(s, fork, "FORK", own, None, "COMPLETED")
        _link(s, p["sourceNodeId"], fork, "BRANCH")
        s["branches"][own] = {"status": "ACTIVE", "fork": fork}
        s["branch"] = own
    elif op == "SWITCH_BRANCH":
        b = _active(s, p.get("branchId"))
        s["branch"] = p["branchId"]
        s["node"] = _newest(s, [n for n, x in s["nodes"].items() if x["branch"] == p["branchId"] and n != b["fork"]]) or b["fork"]
    elif op == "MERGE_BRANCH":
        source, _ = _active(s, p.get("sourceBranchId")), _active(s, p.get("targetBranchId"))
        source["status"] = "MERGED"
        s["branch"] = p["targetBranchId"]
        _put_node(s, f"merge-{seq}", "MERGE", p["targetBranchId"], None, "COMPLETED")
    else:
        b = s["branches"].get(p.get("branchId"))
        if b is None:
            raise Refused("NO_ACTIVE_BRANCH")
        b["status"] = "ABANDONED"
        if s["branch"] == p["branchId"]:
            s["branch"] = next((k for k, x in s["branches"].items() if x["status"] == "ACTIVE"), s["branch"])


def _values(s: dict, op: str, p: dict, ts: int | None) -> None:
    if op == "UPDATE_CONTEXT":
        if p.get("value"):
            s["ctx"][p.get("key")] = p["value"]
        else:
            s["ctx"].pop(p.get("key"), None)
    elif op == "SET_STATUS":
        s["status"] = p.get("status") or s["status"]
        s["final"] = (p.get("finalizationStatus") or "").strip() or ("PENDING_FINALIZATION" if s["status"] in TERMINAL else "NONE")
    else:
        talk = s["talks"].setdefault(p.get("conversationId"), {"messages": [], "first": ts, "last": ts})
        talk["messages"].append([p.get("messageId"), p.get("role"), p.get("content")])
        talk["last"] = ts


def _lifecycle(s: dict, op: str, p: dict) -> None:
    if op in STARTS:
        family, field = STARTS[op]
        s[family][p.get(field)] = {"state": "RUNNING", "attempts": 1}
        return
    family, field, state = MOVES[op]
    e = s[family].get(p.get(field))
    if e is None:
        raise Refused("UNKNOWN_EXECUTION" if family == "tools" else "UNKNOWN_CALL")
    e["state"] = state
    e["attempts"] += op == "MARK_LLM_CALL_RETRY"


#: Handler of each operation and whether it takes time (1) or sequence (2) as well.
_HANDLERS = (
    {op: (_nodes, 1) for op in ("APPEND_NODE", "COMPLETE_NODE", "ADD_EDGE", "DELETE_NODE")}
    | {op: (_branches, 2) for op in ("CREATE_BRANCH", "SWITCH_BRANCH", "MERGE_BRANCH", "ABANDON_BRANCH")}
    | {op: (_values, 1) for op in ("UPDATE_CONTEXT", "SET_STATUS", "APPEND_CONVERSATION_MESSAGE")}
    | {op: (_lifecycle, 0) for op in (*STARTS, *MOVES)}
)


def apply(s: dict, seq: int, op: str, payload: dict | None, ts: int | None) -> None:
    """Take one entry. After a refusal, and at or below the last sequence, entries are ignored."""
    if s["error"] is not None or seq <= s["seq"]:
        return
    try:
        if op == "DELETE_TASK":
            raise Refused("TASK_DELETED")
        if op not in _HANDLERS:
            raise Refused("UNKNOWN_OPERATION")
        if not payload:
            raise Refused("NO_PAYLOAD")
        work, extra = _HANDLERS[op]
        work(s, op, dict(payload), *([], [ts], [seq])[extra])
    except Refused as e:
        s["error"], s["error_seq"] = str(e), seq
        return
    s["seq"], s["applied"] = seq, s["applied"] + 1


def result(task: str, s: dict) -> tuple:
    """The state as a row of ``OUTPUT``."""

    def dump(d: dict) -> str:
        return json.dumps(dict(sorted(d.items(), key=lambda t: str(t[0]))), separators=(",", ":"), ensure_ascii=False)

    call = lambda c: f"{c['state']} {c['attempts']}{' retryable' if c['state'] in RETRYABLE else ''}"
    edges = sorted(f"{a}>{b} {k}" for a, b, k in s["edges"])
    return (
        task, s["applied"], s["seq"], "RUNNING" if s["status"] == "RECOVERING" else s["status"], s["final"], dump(s["ctx"]), dump({k: t["state"] for k, t in s["tools"].items()}),
        dump({k: call(c) for k, c in s["calls"].items()}), dump({k: n["status"] for k, n in s["nodes"].items()}), json.dumps(edges, separators=(",", ":")),
        dump({k: b["status"] for k, b in s["branches"].items()}), dump({k: len(t["messages"]) for k, t in s["talks"].items()}), s["node"], s["branch"], s["error"], s["error_seq"],
    )

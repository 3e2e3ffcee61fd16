"""One walk over a source's tree: its functions, and the facts that their metrics are aggregates of."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

from sparkloom.functions import jsparse
from sparkloom.functions.jsparse import FUNCTIONS, JsSyntaxError, Node

#: The constructs that each metric counts.
LOOPS_AND_BRANCHES = {"IfStatement", "ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement", "CatchClause", "ConditionalExpression"}
NESTING = LOOPS_AND_BRANCHES | {"SwitchStatement"}
TESTED = {"IfStatement", "WhileStatement", "DoWhileStatement", "ConditionalExpression", "ForStatement"}
COMPARISONS = {"==", "===", "!=", "!==", "<", ">", "<=", ">="}
#: White space of the language, for trimming.
JS_SPACE = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_RUNS = re.compile(f"[{JS_SPACE}]+")
#: Depth of nesting that the parser follows; deeper sources fail like ones with errors.
DEPTH = 20_000


def trim(text: str) -> str:
    return re.sub(f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "", text)


def key_name(node: Node | None, text: str) -> str:
    if node is None:
        return "unknown"
    if node.type in ("Identifier", "PrivateIdentifier"):
        return node.name
    if node.type == "Literal":
        return "unknown" if node.value is None else node.value
    return trim(text[node.start : node.end]) or "computed"


def target_name(node: Node, text: str) -> str:
    if node.type == "Identifier":
        return node.name
    if node.type == "MemberExpression":
        return key_name(node.property, text)
    return _RUNS.sub(" ", text[node.start : node.end])[:48] or "anonymous"


class Roots:
    """The object that a chain of members starts from: (local, provider). Each chain link is resolved once."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[bool, str]] = {}

    def of(self, node: Node) -> tuple[bool, str]:
        path, calls = [], []
        while True:
            path.append(node)
            if id(node) in self.known:
                found = self.known[id(node)]
            elif node.type == "ChainExpression":
                node = node.expression
                continue
            elif node.type == "MemberExpression":
                node = node.object
                continue
            elif node.type == "CallExpression":
                calls.append(len(path))
                node = node.callee
                continue
            elif node.type in ("ThisExpression", "Super"):
                found = (True, "this")
            elif node.type == "Identifier":
                found = (False, node.name)
            else:
                found = (False, "<expression>")
            break
        for i in range(len(path) - 1, -1, -1):
            if calls and calls[-1] == i + 1:
                calls.pop()
                found = (False, "<call>") if found == (False, "<expression>") else found
            self.known[id(path[i])] = found
        return found


def analyse(text: str) -> dict:
    """``error``, ``blanked`` and ``functions`` of a source; the error is null if it parses."""
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, DEPTH))
    try:
        return _analyse(jsparse.units(text))
    except JsSyntaxError as error:
        return {"error": str(error), "blanked": None, "functions": []}
    except RecursionError:
        return {"error": "Maximum nesting exceeded", "blanked": None, "functions": []}
    finally:
        sys.setrecursionlimit(old)


def blank_comments(text: str, comments: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in sorted(comments):
        start, end = max(at, start), max(at, end)
        parts += [text[at:start], re.sub(r"[^\r\n]", " ", text[start:end])]
        at = end
    return "".join([*parts, text[at:]])


def _fact(kind: str, s: int = 0, c: int = 0, n: int = 0, local: bool = False, provider: str = "", call: bool = False) -> dict:
    return {"kind": kind, "s_depth": s, "c_depth": c, "n": n, "local": local, "provider": provider, "is_call": call}


def _analyse(text: str) -> dict:
    tree, comments = jsparse.parse(text)
    begins = [0, *(m.end() for m in jsparse._LINE.finditer(text))]
    line_of = lambda at: bisect_right(begins, at)
    functions: list[dict] = []
    owned: dict[int, tuple[Node, str, str]] = {}
    roots = Roots()
    # node, parent, owner, structural and condition depth, else-if, the sites whose test this is in
    stack: list[tuple] = [(tree, None, None, 0, 0, False, ())]
    while stack:
        node, parent, owner, s, c, elseif, sites = stack.pop()
        kind = node.type
        if kind in ("MethodDefinition", "Property") and isinstance(node.value, Node) and node.value.type in FUNCTIONS:
            shown = kind if kind == "MethodDefinition" else "ObjectMethod" if node.method else node.value.type
            owned[id(node.value)] = (node, shown, key_name(node.key, text))
        if kind in FUNCTIONS:
            if id(node) in owned:
                segment, shown, name = owned[id(node)]
            else:
                segment, shown = node, kind
                if node.id is not None:
                    name = node.id.name
                elif parent is not None and parent.type == "VariableDeclarator":
                    name = target_name(parent.id, text)
                elif parent is not None and parent.type == "AssignmentExpression":
                    name = target_name(parent.left, text)
                elif parent is not None and parent.type == "PropertyDefinition":
                    name = key_name(parent.key, text)
                else:
                    line = line_of(node.start)
                    name = f"anonymous@L{line}:C{node.start - begins[line - 1] + 1}"
            owner = {
                "function_name": jsparse.characters(name),
                "function_type": shown,
                "start_line": line_of(segment.start),
                "end_line": line_of(segment.end),
                "start_offset": segment.start,
                "end_offset": segment.end,
                "nop": len(node.params),
                "source": jsparse.characters(text[segment.start : segment.end]),
                "facts": [],
            }
            functions.append(owner)
            s = c = 0
            sites = tuple(x for x in sites if x["test"] is node)
        test = None
        if owner is not None:
            add = owner["facts"].append
            site = kind in TESTED and node.test is not None
            logical = kind == "LogicalExpression" and node.operator in ("&&", "||")
            if kind in NESTING and not elseif:
                s += 1
            if site and not elseif:
                c += 1
            if kind in LOOPS_AND_BRANCHES or logical or kind == "SwitchCase" and node.test is not None:
                add(_fact("decision"))
            if kind in NESTING:
                add(_fact("struct", s=s))
            if site:
                test = {"test": node.test, "fact": _fact("site", c=c)}
                add(test["fact"])
            if logical or kind == "UnaryExpression" and node.operator == "!" or kind == "BinaryExpression" and node.operator in COMPARISONS:
                for x in sites:
                    x["fact"]["n"] += 1
            if kind == "VariableDeclarator":
                add(_fact("bind", n=len(jsparse.bound(node.id))))
            elif kind == "CatchClause":
                add(_fact("bind", n=len(jsparse.bound(node.param))))
            elif kind == "MemberExpression":
                local, provider = roots.of(node)
                call = parent.type in ("CallExpression", "NewExpression") and parent.callee is node or parent.type == "TaggedTemplateExpression" and parent.tag is node
                add(_fact("member", local=local, provider=jsparse.characters(provider), call=call))
        for child in node.children():
            inside = (*sites, test) if test is not None and child is node.test else sites
            chained = kind == "IfStatement" and child is node.alternate and child.type == "IfStatement"
            stack.append((child, node, owner, s, c, chained, inside))
    functions.sort(key=lambda f: (f["start_offset"], f["end_offset"]))
    return {"error": None, "blanked": jsparse.characters(blank_comments(text, comments)), "functions": functions}

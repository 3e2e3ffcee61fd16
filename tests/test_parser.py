"""Parsing: identity of functions, errors, and sources whose metrics are known by construction."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions import facts, jsparse


def names(source):
    found = facts.analyse(source)
    assert found["error"] is None, found["error"]
    return [(f["function_name"], f["function_type"]) for f in found["functions"]]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("const o = { get v(){ return 1; }, m(){}, k: () => 2 };", [("v", "FunctionExpression"), ("m", "ObjectMethod"), ("k", "ArrowFunctionExpression")]),
        ('class A { #p(){} static s = () => 1; [k](){} "q-r"(){} }', [("p", "MethodDefinition"), ("s", "ArrowFunctionExpression"), ("k", "MethodDefinition"), ("q-r", "MethodDefinition")]),
        ("a.b = function(){}; export default function(){}", [("b", "FunctionExpression"), ("anonymous@L1:C36", "FunctionDeclaration")]),
        ("return 1; function f(){}", [("f", "FunctionDeclaration")]),
        ("x = { 0x10() {}, 1e3() {}, null: () => 1, async *g() {} }", [("16", "ObjectMethod"), ("1000", "ObjectMethod"), ("null", "ArrowFunctionExpression"), ("g", "ObjectMethod")]),
        ("a ||= () => 1; [b] = [() => 2]", [("a", "ArrowFunctionExpression"), ("anonymous@L1:C23", "ArrowFunctionExpression")]),
        ("f(async function named() {}, async x => x, async (x) => x)", [("named", "FunctionExpression"), ("anonymous@L1:C30", "ArrowFunctionExpression"), ("anonymous@L1:C44", "ArrowFunctionExpression")]),
        ("'é😀'; (() => 1)()", [("anonymous@L1:C9", "ArrowFunctionExpression")]),
        ("const {a = () => 1} = b", [("anonymous@L1:C12", "ArrowFunctionExpression")]),
    ],
)
def test_names_and_types(source, expected):
    assert names(source) == expected


@pytest.mark.parametrize(
    "source",
    [
        "x = a / b / c; y = /re[/]g/g.test(z); ({a = 1} = q); [b, ...c] = d; `t${ {a:1}.a }u${`n${1}`}`",
        "a?.b?.[c]?.(d); (a?.b)(); import('x').then(m => m.default); import.meta.url",
        "with (a) { b }",
        "<></>; <a.b c:d='1' {...e}>{/* c */}{...f}<b/> text ' </a.b>",
        "for (const [a,b] of c) ; for (var i = 0, n = 1; i < n; i++) ; for (x in y) ; for (let of of of) ;",
        "class B extends (class {}) { static { this.x = 1 } get a(){return 1} set a(v){} static async *gen(){} static async = 1; get; set; static; 'x' = 1; accessor z = 2; #y; has(o){ return #y in o } }",
        "export * as ns from 'a'; import d, {x as y} from 'b' with {type:'json'}; export {y as default}; export const q = 1",
        "let async; async = 1; let of = 2",
        "a = b\n++c\nl: for (;;) { continue l }",
        "<!-- old\nvar await = 1\n--> also",
        "#!/usr/bin/env node\n1_000n ** 2n; 0b11; .5e-3; 08",
        "if (a) function f() {} else ; do x(); while(0) y()",
        "x = function*() { yield; yield* y; yield a ? b : c }; async () => { await x; for await (const y of z) ; }",
        "function g() { new a.b(c)(d); new (f()); return new.target }",
        "({ __proto__: null, async, get, set, 'x': 1, [y]: 2, async async() {}, get get() { return 1 } })",
        "a = (b, c); (a) = 1; (a.b)++; (async)\n(x)",
    ],
)
def test_accepts(source):
    assert facts.analyse(source)["error"] is None


@pytest.mark.parametrize(
    "source",
    ["function (", "let a; let a;", "let a; var a;", "({a=1})", "while(1) function f(){}", "break", "x: x: ;", "a ?? b || c", "-1 ** 2", "const a", "for (let a, b of c) ;", "/x/gg", "'a\nb'", "`a", "/* x", "<a></b>", "class A { constructor(){} constructor(){} }", "import a from", "({a(){} } = b)", "1 = 2", "a?.`b`", "(a, b) = 1", "{ a", "if", "x = {get a(b){}}", "#p in o", "let let = 1", "1__0", "3in []"],
)
def test_rejects(source):
    assert facts.analyse(source)["error"]


def test_errors_tell_line_and_column():
    assert facts.analyse("f();\n  let a; let a;")["error"] == "Identifier 'a' has already been declared (2:9)"


def test_deep_nesting_is_a_failure_or_parses():
    assert facts.analyse("(" * 60000)["error"]
    assert facts.analyse("[" * 300 + "]" * 300)["error"] is None
    chain = "function f(a) { return a" + ".b" * 3000 + " }"
    assert sum(x["kind"] == "member" for x in facts.analyse(chain)["functions"][0]["facts"]) == 3000


def test_numbers_print_as_in_the_language():
    for raw, shown in (("1e21", "1e+21"), ("0.1", "0.1"), ("1e-7", "1e-7"), ("0.000001", "0.000001"), ("5.", "5"), ("0o17", "15"), ("010", "8"), ("10n", "10"), ("0xFn", "15")):
        assert jsparse.shown("number", raw) == shown


STATEMENTS = st.recursive(
    st.sampled_from([("x.y++;", 0, 0), ("g(1);", 0, 0), ("var z = a && b;", 1, 0)]),
    lambda inner: st.one_of(
        st.tuples(inner).map(lambda t: (f"if (a) {{ {t[0][0]} }}", t[0][1] + 1, t[0][2] + 1)),
        st.tuples(inner).map(lambda t: (f"while (b) {{ {t[0][0]} }}", t[0][1] + 1, t[0][2] + 1)),
        st.tuples(inner).map(lambda t: (f"(() => {{ {t[0][0]} }})();", 0, 0)),
        st.tuples(inner, inner).map(lambda t: (f"{{ {t[0][0]} {t[1][0]} }}", t[0][1] + t[1][1], max(t[0][2], t[1][2]))),
        st.tuples(inner, inner).map(lambda t: (f"if (a) {{ {t[0][0]} }} else if (b) {{ {t[1][0]} }}", t[0][1] + t[1][1] + 2, max(t[0][2], t[1][2]) + 1)),
        st.tuples(inner).map(lambda t: (f"try {{ {t[0][0]} }} catch {{ }}", t[0][1] + 1, max(1, t[0][2]))),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(STATEMENTS)
def test_metrics_known_by_construction(made):
    source, decisions, depth = made
    found = facts.analyse(f"function f(a, b) {{ {source} }}")["functions"][0]["facts"]
    assert sum(x["kind"] == "decision" for x in found) == decisions
    assert max([x["s_depth"] for x in found if x["kind"] == "struct"], default=0) == depth

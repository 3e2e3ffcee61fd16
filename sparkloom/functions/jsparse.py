"""A parser of JavaScript (current ECMAScript, with JSX) into ESTree-shaped nodes.

Recursive descent over a scanner that the parser drives, so that a slash is a regular expression exactly where an
operand may stand, and templates and JSX are read character by character. Parentheses are first tried as arrow
parameters; literals before ``=`` are turned into patterns. Text is read in UTF-16 units, as ``units`` makes them,
so that offsets and columns count as in the language.

Early errors that are checked: redeclared lexical names, assignment targets, break and continue targets, return,
with, octal literals and delete in their goals, reserved words, private names without a class, import and export
places, await and yield, regular expression flags. Others (such as duplicate exports or regular expression syntax) are
not.
"""

from __future__ import annotations

import re


class JsSyntaxError(Exception):
    """Kind of error with line and column (column from 0)."""


class Node:
    """A node: ``type``, ``start``, ``end`` and the fields of its type, in order."""

    def __init__(self, type: str, start: int, **fields: object) -> None:
        self.type, self.start, self.end = type, start, start
        self.__dict__.update(fields)

    def children(self) -> list[Node]:
        out = []
        for v in self.__dict__.values():
            if isinstance(v, Node):
                out.append(v)
            elif isinstance(v, list):
                out += [x for x in v if isinstance(x, Node)]
        return out


def units(text: str) -> str:
    """``text`` with a character for each UTF-16 unit."""
    if all(c <= "\uffff" for c in text):
        return text
    data = text.encode("utf-16-le", "surrogatepass")
    return "".join([chr(data[i] | data[i + 1] << 8) for i in range(0, len(data), 2)])


def characters(text: str) -> str:
    """The reverse of ``units``; lone surrogates become U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


#: The language's words, operators and characters.
KEYWORDS = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
STRICT_WORDS = set("implements interface let package private protected public static yield".split())
PUNCTUATORS = sorted("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @".split(), key=len, reverse=True)
ASSIGNMENTS = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
PRECEDENCE = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
BREAKS = "\n\r\u2028\u2029"
_SPACE = re.compile("[\\t\\x0b\\f \\xa0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff\\n\\r\u2028\u2029]+")
_ID = re.compile(r"(?:[\w$\u200c\u200d\ud800-\udfff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*n|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)")
_PUNCT = re.compile("|".join(map(re.escape, PUNCTUATORS)))
_JSX_NAME = re.compile(r"[\w$\ud800-\udfff][\w$\-\ud800-\udfff]*")
_LINE = re.compile("\r\n|[\n\r\u2028\u2029]")
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")


class Parser:
    def __init__(self, text: str, module: bool) -> None:
        self.s, self.module = text, module
        self.n, self.pos, self.last_end = len(text), 0, 0
        self.comments: list[tuple[int, int]] = []
        self.strict = module
        self.in_function = self.is_async = self.is_generator = False
        self.loops = self.switches = 0
        self.labels: list[tuple[str, bool]] = []
        self.cover: int | None = None
        self.not_arrow: set[int] = set()
        self.class_depth = 0
        self.in_static = self.no_in = False
        self.type = self.value = ""
        self.start = self.end = 0
        self.newline = self.escaped = False

    # -- scanning

    def fail(self, what: str, at: int | None = None) -> None:
        at = self.start if at is None else at
        line, column = place(self.s, at)
        raise JsSyntaxError(f"{what} ({line}:{column})")

    def skip(self) -> None:
        s, n = self.s, self.n
        while self.pos < n:
            c = s[self.pos]
            if m := _SPACE.match(s, self.pos):
                self.newline |= any(x in BREAKS for x in m[0])
                self.pos = m.end()
            elif c == "/" and s.startswith("//", self.pos):
                self.line_comment()
            elif c == "/" and s.startswith("/*", self.pos):
                end = s.find("*/", self.pos + 2)
                if end < 0:
                    self.fail("Unterminated comment", self.pos)
                self.newline |= any(x in BREAKS for x in s[self.pos : end])
                self.comments.append((self.pos, end + 2))
                self.pos = end + 2
            elif not self.module and (s.startswith("<!--", self.pos) or (s.startswith("-->", self.pos) and (self.newline or self.last_end == 0))):
                self.line_comment()
            elif self.pos == 0 and s.startswith("#!"):
                self.line_comment()
            else:
                break

    def line_comment(self) -> None:
        m = re.compile(f"[{BREAKS}]").search(self.s, self.pos)
        end = m.start() if m else self.n
        self.comments.append((self.pos, end))
        self.pos = end

    def next(self) -> None:
        """The next token: name, number, string, template, private, punctuator or end."""
        self.last_end = self.end
        self.newline = self.escaped = False
        self.skip()
        s, at = self.s, self.pos
        self.start = at
        if at >= self.n:
            self.type, self.value, self.end = "end", "", at
            return
        c = s[at]
        if c.isdigit() and c.isascii() or c == "." and s[at + 1 : at + 2].isdigit():
            m = _NUMBER.match(s, at)
            self.type, self.value, self.pos = "number", m[0], m.end()
            if _ID.match(s, self.pos):
                self.fail("Identifier directly after number", self.pos)
            if "__" in m[0] or m[0].rstrip("n").endswith("_"):
                self.fail("Misplaced numeric separator", at)
            if self.strict and re.match(r"0[0-9]", m[0]):
                self.fail("Octal literal in strict mode", at)
        elif c in "'\"":
            self.string(c)
        elif c == "`":
            self.type, self.value, self.pos = "template", "`", at + 1
        elif c == "#" and (m := _ID.match(s, at + 1)):
            self.type, self.value, self.pos = "private", m[0], m.end()
        elif (m := _ID.match(s, at)) and not c.isdigit():
            self.type, self.value, self.pos = "name", m[0], m.end()
            if "\\" in m[0]:
                self.escaped = True
                self.value = units(re.sub(r"\\u\{?([0-9a-fA-F]+)\}?", lambda x: chr(min(int(x[1], 16), 0x10FFFF)), m[0]))
        elif m := _PUNCT.match(s, at):
            value = m[0]
            if value == "?." and s[at + 2 : at + 3].isdigit():
                value = "?"
            self.type, self.value, self.pos = "punctuator", value, at + len(value)
        else:
            self.fail("Unexpected character", at)
        self.end = self.pos

    def string(self, quote: str) -> None:
        s, i = self.s, self.pos + 1
        while True:
            if i >= self.n or s[i] in "\n\r":
                self.fail("Unterminated string constant", self.pos)
            if s[i] == "\\":
                if self.strict and re.match(r"0[0-9]|[1-9]", s[i + 1 : i + 3]):
                    self.fail("Octal literal in strict mode", i)
                i += 3 if s.startswith("\r\n", i + 1) else 2
            elif s[i] == quote:
                break
            else:
                i += 1
        self.type, self.value, self.pos = "string", s[self.pos + 1 : i], i + 1

    def state(self) -> tuple:
        return (self.pos, self.last_end, self.type, self.value, self.start, self.end, self.newline, self.escaped, len(self.comments), self.strict, self.cover)

    def restore(self, state: tuple) -> None:
        self.pos, self.last_end, self.type, self.value, self.start, self.end, self.newline, self.escaped, kept, self.strict, self.cover = state
        del self.comments[kept:]

    def peek(self) -> tuple[str, str, bool]:
        state = self.state()
        self.next()
        seen = (self.type, self.value, self.newline)
        self.restore(state)
        return seen

    def at(self, value: str) -> bool:
        return self.type == "punctuator" and self.value == value

    def word(self, value: str) -> bool:
        return self.type == "name" and self.value == value and not self.escaped

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.next()
            return True
        return False

    def eat_word(self, value: str) -> bool:
        if self.word(value):
            self.next()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.eat(value):
            self.fail("Unexpected token")

    def expect_word(self, value: str) -> None:
        if not self.eat_word(value):
            self.fail("Unexpected token")

    def semicolon(self) -> None:
        if not self.eat(";") and not self.at("}") and self.type != "end" and not self.newline:
            self.fail("Unexpected token")

    def done(self, node: Node) -> Node:
        node.end = self.last_end
        return node

    # -- programs and statements

    def program(self) -> Node:
        self.next()
        node = Node("Program", 0, body=[])
        self.directives(node.body)
        while self.type != "end":
            node.body.append(self.statement(True))
        self.check_scope(node.body, [])
        node.end = self.n
        return node

    def directives(self, body: list[Node]) -> None:
        while self.type == "string":
            raw = self.s[self.start + 1 : self.end - 1]
            body.append(self.statement(True))
            if body[-1].type == "ExpressionStatement" and body[-1].expression.type == "Literal" and raw == "use strict":
                self.strict = True

    def statement(self, top: bool = False, declare: bool = True) -> Node:
        start = self.start
        if self.type == "punctuator":
            if self.value == "{":
                return self.block()
            if self.eat(";"):
                return self.done(Node("EmptyStatement", start))
            if self.value == "@":
                self.decorators()
                return self.statement(top, declare)
        if self.type == "name" and not self.escaped:
            method = getattr(self, f"_{self.value}", None) if self.value in _STATEMENTS else None
            if method:
                return method(start)
            v = self.value
            if v in ("function", "class", "const") and not declare and v != "function":
                self.fail("Unexpected token")
            if v == "function":
                self.next()
                return self.function(Node("FunctionDeclaration", start), True)
            if v == "class":
                return self.class_(Node("ClassDeclaration", start), True)
            if v == "async":
                kind, name, line = self.peek()
                if kind == "name" and name == "function" and not line:
                    self.next()
                    self.next()
                    return self.function(Node("FunctionDeclaration", start), True, is_async=True)
            if v in ("var", "const") or v == "let" and self.let_declares():
                node = self.variables(start)
                self.semicolon()
                return self.done(node)
            if v == "import" and self.peek()[1] not in ("(", "."):
                return self.import_(start, top)
            if v == "export":
                return self.export(start, top)
            if v not in KEYWORDS and self.peek()[:2] == ("punctuator", ":"):
                return self.labeled(start)
        node = Node("ExpressionStatement", start, expression=self.expression())
        self.semicolon()
        return self.done(node)

    def decorators(self) -> None:
        while self.eat("@"):
            self.subscripts(self.primary(), no_call=False)

    def let_declares(self) -> bool:
        kind, value, line = self.peek()
        return kind == "name" and value not in ("in", "instanceof", "of") or (kind == "name" and value == "of") or value in ("[", "{") and kind == "punctuator"

    def block(self, names: list[str] | None = None, kind: str = "BlockStatement") -> Node:
        node = Node(kind, self.start, body=[])
        self.expect("{")
        while not self.at("}"):
            if self.type == "end":
                self.fail("Unexpected token")
            node.body.append(self.statement())
        self.next()
        self.check_scope(node.body, names or [])
        return self.done(node)

    def check_scope(self, body: list[Node], names: list[str], functions_too: bool = False) -> None:
        """Lexical names of a scope are declared once, and not also by var."""
        lexical, others = set(), set(names)
        for x in body:
            x = x.declaration if x.type in ("ExportNamedDeclaration", "ExportDefaultDeclaration") and getattr(x, "declaration", None) else x
            if x.type == "VariableDeclaration" and x.kind != "var":
                found = [n for d in x.declarations for n in bound(d.id)]
            elif x.type == "ClassDeclaration" and x.id:
                found = [x.id.name]
            elif x.type == "ImportDeclaration":
                found = [s.local.name for s in x.specifiers]
            elif x.type == "VariableDeclaration":
                others.update(n for d in x.declarations for n in bound(d.id))
                continue
            elif x.type == "FunctionDeclaration" and x.id:
                others.add(x.id.name)
                continue
            else:
                continue
            for n in found:
                if n in lexical:
                    self.fail(f"Identifier '{n}' has already been declared", x.start)
                lexical.add(n)
        if lexical & others:
            self.fail(f"Identifier '{min(lexical & others)}' has already been declared", body[0].start)

    def paren(self) -> Node:
        self.expect("(")
        node = self.expression()
        self.expect(")")
        return node

    def body_of(self, loop: bool = False) -> Node:
        self.loops += loop
        node = self.statement(declare=False)
        self.loops -= loop
        if node.type == "VariableDeclaration" and node.kind != "var" or node.type == "ClassDeclaration" or node.type == "FunctionDeclaration" and (self.strict or loop):
            self.fail("Unexpected token", node.start)
        return node

    def _if(self, start: int) -> Node:
        self.next()
        node = Node("IfStatement", start, test=self.paren(), consequent=self.body_of(), alternate=None)
        if self.eat_word("else"):
            node.alternate = self.body_of()
        return self.done(node)

    def _while(self, start: int) -> Node:
        self.next()
        return self.done(Node("WhileStatement", start, test=self.paren(), body=self.body_of(True)))

    def _do(self, start: int) -> Node:
        self.next()
        node = Node("DoWhileStatement", start, body=self.body_of(True))
        self.expect_word("while")
        node.test = self.paren()
        self.eat(";")
        return self.done(node)

    def _for(self, start: int) -> Node:
        self.next()
        waits = self.word("await") and (self.is_async or self.module and not self.in_function)
        if waits:
            self.next()
        self.expect("(")
        init, at = None, self.start
        if not self.at(";"):
            if self.type == "name" and (self.value in ("var", "const") or self.value == "let" and self.let_declares()):
                self.no_in = True
                init = self.variables(at, True)
            else:
                self.no_in = True
                init = self.expression(check=False)
            self.no_in = False
        if init is not None and (self.word("of") or self.word("in")):
            kind = "ForOfStatement" if self.word("of") else "ForInStatement"
            if init.type == "VariableDeclaration":
                if len(init.declarations) != 1:
                    self.fail("Invalid left-hand side in for loop", at)
            else:
                init = self.pattern(init)
                self.cover = None
            self.next()
            right = self.assign() if kind == "ForOfStatement" else self.expression()
            self.expect(")")
            return self.done(Node(kind, start, left=init, right=right, body=self.body_of(True)))
        if self.cover is not None:
            self.fail("Shorthand property assignments are valid only in destructuring patterns", self.cover)
        if init is not None and init.type == "VariableDeclaration":
            self.check_initialised(init)
        self.expect(";")
        test = None if self.at(";") else self.expression()
        self.expect(";")
        update = None if self.at(")") else self.expression()
        self.expect(")")
        return self.done(Node("ForStatement", start, init=init, test=test, update=update, body=self.body_of(True)))

    def _switch(self, start: int) -> Node:
        self.next()
        node = Node("SwitchStatement", start, discriminant=self.paren(), cases=[])
        self.expect("{")
        self.switches += 1
        inside: list[Node] = []
        default = False
        while not self.at("}"):
            case = Node("SwitchCase", self.start, test=None, consequent=[])
            if self.eat_word("default"):
                if default:
                    self.fail("Multiple default clauses")
                default = True
            else:
                self.expect_word("case")
                case.test = self.expression()
            self.expect(":")
            while not (self.at("}") or self.word("case") or self.word("default")):
                if self.type == "end":
                    self.fail("Unexpected token")
                case.consequent.append(self.statement())
            inside += case.consequent
            node.cases.append(self.done(case))
        self.switches -= 1
        self.next()
        self.check_scope(inside, [])
        return self.done(node)

    def _try(self, start: int) -> Node:
        self.next()
        node = Node("TryStatement", start, block=self.block(), handler=None, finalizer=None)
        if self.word("catch"):
            clause = Node("CatchClause", self.start, param=None)
            self.next()
            if self.eat("("):
                clause.param = self.binding()
                self.expect(")")
            clause.body = self.block()
            lexical = [n for x in clause.body.body if x.type == "VariableDeclaration" and x.kind != "var" for d in x.declarations for n in bound(d.id)]
            if clause.param is not None and set(lexical) & set(bound(clause.param)):
                self.fail("Identifier has already been declared", clause.start)
            node.handler = self.done(clause)
        if self.eat_word("finally"):
            node.finalizer = self.block()
        if node.handler is None and node.finalizer is None:
            self.fail("Missing catch or finally clause", start)
        return self.done(node)

    def _return(self, start: int) -> Node:
        if not self.in_function and (self.module or self.in_static):
            self.fail("'return' outside of function")
        return self.argument("ReturnStatement", start, True)

    def _throw(self, start: int) -> Node:
        return self.argument("ThrowStatement", start, False)

    def argument(self, kind: str, start: int, optional: bool) -> Node:
        self.next()
        none = self.newline or self.at(";") or self.at("}") or self.type == "end"
        if none and not optional:
            self.fail("Unexpected token")
        node = Node(kind, start, argument=None if none else self.expression())
        self.semicolon()
        return self.done(node)

    def _break(self, start: int) -> Node:
        return self.jump("BreakStatement", start)

    def _continue(self, start: int) -> Node:
        return self.jump("ContinueStatement", start)

    def jump(self, kind: str, start: int) -> Node:
        word = self.value
        self.next()
        node = Node(kind, start, label=None)
        if self.type == "name" and not self.newline and self.value not in KEYWORDS:
            node.label = self.identifier()
            if not any(name == node.label.name and (word == "break" or loop) for name, loop in self.labels):
                self.fail(f"Unsyntactic {word}", start)
        elif not (self.loops or word == "break" and self.switches):
            self.fail(f"Unsyntactic {word}", start)
        self.semicolon()
        return self.done(node)

    def _debugger(self, start: int) -> Node:
        self.next()
        self.semicolon()
        return self.done(Node("DebuggerStatement", start))

    def _with(self, start: int) -> Node:
        if self.strict:
            self.fail("'with' in strict mode")
        self.next()
        return self.done(Node("WithStatement", start, object=self.paren(), body=self.body_of()))

    def labeled(self, start: int) -> Node:
        label = self.identifier()
        self.expect(":")
        if any(name == label.name for name, _ in self.labels):
            self.fail(f"Label '{label.name}' is already declared", start)
        loop = self.type == "name" and self.value in ("for", "while", "do")
        self.labels.append((label.name, loop))
        node = Node("LabeledStatement", start, label=label, body=self.statement(declare=False))
        self.labels.pop()
        return self.done(node)

    def variables(self, start: int, loop: bool = False) -> Node:
        node = Node("VariableDeclaration", start, declarations=[], kind=self.value)
        self.next()
        while True:
            one = Node("VariableDeclarator", self.start, id=self.binding(), init=None)
            if node.kind != "var" and "let" in bound(one.id):
                self.fail("let is disallowed as a lexically bound name", one.start)
            if self.eat("="):
                one.init = self.assign()
            node.declarations.append(self.done(one))
            if not self.eat(","):
                break
        if not loop:
            self.check_initialised(node)
        return self.done(node)

    def check_initialised(self, node: Node) -> None:
        for one in node.declarations:
            if one.init is None and (node.kind == "const" or one.id.type != "Identifier"):
                self.fail("Missing initializer", one.end)

    def import_(self, start: int, top: bool) -> Node:
        if not self.module or not top:
            self.fail("'import' and 'export' may appear only at the top level of a module", start)
        self.next()
        node = Node("ImportDeclaration", start, specifiers=[], source=None)
        if self.type != "string":
            if self.type == "name":
                at = self.start
                node.specifiers.append(self.done(Node("ImportDefaultSpecifier", at, local=self.identifier())))
                if not self.eat(","):
                    return self.import_end(node)
            if self.at("*"):
                at = self.start
                self.next()
                self.expect_word("as")
                node.specifiers.append(self.done(Node("ImportNamespaceSpecifier", at, local=self.identifier())))
            else:
                self.expect("{")
                while not self.eat("}"):
                    at, plain = self.start, self.type == "name" and self.value not in KEYWORDS
                    imported = self.module_name()
                    if self.eat_word("as"):
                        local = self.identifier()
                    elif plain:
                        local = imported
                    else:
                        self.fail("Unexpected token")
                    node.specifiers.append(self.done(Node("ImportSpecifier", at, imported=imported, local=local)))
                    if not self.at("}"):
                        self.expect(",")
        return self.import_end(node)

    def import_end(self, node: Node) -> Node:
        if node.specifiers or self.type != "string":
            self.expect_word("from")
        node.source = self.text_literal()
        self.attributes(node)
        self.semicolon()
        return self.done(node)

    def attributes(self, node: Node) -> None:
        if self.eat_word("with"):
            node.attributes = []
            self.expect("{")
            while not self.eat("}"):
                at = self.start
                key = self.module_name()
                self.expect(":")
                node.attributes.append(self.done(Node("ImportAttribute", at, key=key, value=self.text_literal())))
                if not self.at("}"):
                    self.expect(",")

    def text_literal(self) -> Node:
        if self.type != "string":
            self.fail("Unexpected token")
        return self.literal()

    def module_name(self) -> Node:
        return self.literal() if self.type == "string" else self.identifier(any_word=True)

    def export(self, start: int, top: bool) -> Node:
        if not self.module or not top:
            self.fail("'import' and 'export' may appear only at the top level of a module", start)
        self.next()
        if self.eat("*"):
            node = Node("ExportAllDeclaration", start, exported=None, source=None)
            if self.eat_word("as"):
                node.exported = self.module_name()
            self.expect_word("from")
            node.source = self.text_literal()
            self.attributes(node)
            self.semicolon()
            return self.done(node)
        if self.eat_word("default"):
            node = Node("ExportDefaultDeclaration", start)
            at, (_, after, line) = self.start, self.peek()
            if self.at("@"):
                self.decorators()
            if self.eat_word("function"):
                node.declaration = self.function(Node("FunctionDeclaration", at), True, anonymous=True)
            elif self.word("async") and after == "function" and not line:
                self.next()
                self.next()
                node.declaration = self.function(Node("FunctionDeclaration", at), True, is_async=True, anonymous=True)
            elif self.word("class"):
                node.declaration = self.class_(Node("ClassDeclaration", at), True, anonymous=True)
            else:
                node.declaration = self.assign()
                self.semicolon()
            return self.done(node)
        node = Node("ExportNamedDeclaration", start, declaration=None, specifiers=[], source=None)
        if self.eat("{"):
            while not self.eat("}"):
                at, local = self.start, self.module_name()
                exported = self.module_name() if self.eat_word("as") else local
                node.specifiers.append(self.done(Node("ExportSpecifier", at, local=local, exported=exported)))
                if not self.at("}"):
                    self.expect(",")
            if self.eat_word("from"):
                node.source = self.text_literal()
                self.attributes(node)
            self.semicolon()
        else:
            node.declaration = self.statement()
            if node.declaration.type not in ("VariableDeclaration", "FunctionDeclaration", "ClassDeclaration"):
                self.fail("Unexpected token", node.declaration.start)
        return self.done(node)

    # -- functions and classes

    def function(self, node: Node, declaration: bool, is_async: bool = False, anonymous: bool = False) -> Node:
        """After the word ``function``."""
        generator = self.eat("*")
        node.id = None
        if self.type == "name" and not self.at("("):
            outer = self.is_async, self.is_generator
            if not declaration:
                self.is_async, self.is_generator = is_async, generator
            node.id = self.identifier()
            self.is_async, self.is_generator = outer
        elif declaration and not anonymous:
            self.fail("Unexpected token")
        return self.function_rest(node, is_async, generator)

    def function_rest(self, node: Node, is_async: bool, generator: bool) -> Node:
        outer = self.enter(is_async, generator)
        node.generator, node.is_async = generator, is_async
        node.params = self.parameters()
        node.body = self.function_body(node.params)
        self.leave(outer)
        return self.done(node)

    def enter(self, is_async: bool, generator: bool) -> tuple:
        outer = (self.in_function, self.is_async, self.is_generator, self.loops, self.switches, self.labels, self.strict, self.no_in, self.in_static)
        self.in_function, self.is_async, self.is_generator, self.loops, self.switches, self.labels, self.no_in, self.in_static = True, is_async, generator, 0, 0, [], False, False
        return outer

    def leave(self, outer: tuple) -> None:
        self.in_function, self.is_async, self.is_generator, self.loops, self.switches, self.labels, self.strict, self.no_in, self.in_static = outer

    def parameters(self) -> list[Node]:
        out = []
        self.expect("(")
        while not self.eat(")"):
            if self.at("..."):
                out.append(self.rest(self.binding))
                if not self.at(")"):
                    self.fail("Comma is not permitted after the rest element")
            else:
                out.append(self.binding_default())
                if not self.at(")"):
                    self.expect(",")
        return out

    def function_body(self, params: list[Node]) -> Node:
        node = Node("BlockStatement", self.start, body=[])
        self.expect("{")
        self.directives(node.body)
        while not self.at("}"):
            if self.type == "end":
                self.fail("Unexpected token")
            node.body.append(self.statement())
        names = [n for p in params for n in bound(p)]
        if self.strict and len(set(names)) < len(names):
            self.fail("Argument name clash", node.start)
        self.check_scope([x for x in node.body if x.type != "FunctionDeclaration"], names + [x.id.name for x in node.body if x.type == "FunctionDeclaration"])
        self.next()
        return self.done(node)

    def class_(self, node: Node, declaration: bool, anonymous: bool = False) -> Node:
        self.next()
        strict, self.strict = self.strict, True
        node.id, node.superClass = None, None
        if self.type == "name" and not self.word("extends"):
            node.id = self.identifier()
        elif declaration and not anonymous:
            self.fail("Unexpected token")
        if self.eat_word("extends"):
            node.superClass = self.subscripts(self.primary())
        self.class_depth += 1
        body = Node("ClassBody", self.start, body=[])
        self.expect("{")
        constructors = 0
        while not self.at("}"):
            if self.eat(";"):
                continue
            body.body.append(self.member())
            constructors += getattr(body.body[-1], "kind", "") == "constructor"
        if constructors > 1:
            self.fail("Duplicate constructor in the same class", body.start)
        self.class_depth -= 1
        self.strict = strict
        self.next()
        node.body = self.done(body)
        return self.done(node)

    def ends_key(self) -> bool:
        kind, value, _ = self.peek()
        return kind == "end" or kind == "punctuator" and value in ("(", "=", ";", "}", ",", ":")

    def member(self) -> Node:
        if self.at("@"):
            self.decorators()
        start, static, is_async, generator, kind = self.start, False, False, False, "method"
        if self.word("static") and not self.ends_key():
            self.next()
            static = True
            if self.at("{"):
                outer = self.enter(False, False)
                self.in_function, self.in_static = False, True
                node = self.block(kind="StaticBlock")
                self.leave(outer)
                node.start = start
                return node
        if self.word("accessor") and not self.ends_key() and not self.peek()[2]:
            self.next()
        if self.word("async") and not self.ends_key() and not self.peek()[2]:
            self.next()
            is_async = True
        if self.eat("*"):
            generator = True
        if not is_async and not generator and (self.word("get") or self.word("set")) and not self.ends_key() and self.peek()[1] != "*":
            kind = self.value
            self.next()
        computed = self.at("[")
        key = self.key(private=True)
        if self.at("("):
            value = Node("FunctionExpression", self.start, id=None)
            name = getattr(key, "name", getattr(key, "value", None))
            if not static and not computed and name == "constructor" and key.type != "PrivateIdentifier":
                if kind != "method" or is_async or generator:
                    self.fail("Constructor can't be an accessor, async or a generator", start)
                kind = "constructor"
            value = self.function_rest(value, is_async, generator)
            self.check_accessor(kind, value)
            return self.done(Node("MethodDefinition", start, static=static, computed=computed, key=key, kind=kind, value=value))
        if is_async or generator or kind != "method":
            self.fail("Unexpected token")
        node = Node("PropertyDefinition", start, static=static, computed=computed, key=key, value=None)
        if self.at("="):
            outer = self.enter(False, False)
            self.next()
            node.value = self.assign()
            self.leave(outer)
            self.strict = True
        self.semicolon()
        return self.done(node)

    def check_accessor(self, kind: str, value: Node) -> None:
        if kind == "get" and value.params or kind == "set" and (len(value.params) != 1 or value.params[0].type == "RestElement"):
            self.fail("Wrong number of accessor parameters", value.start)

    def key(self, private: bool = False) -> Node:
        if self.eat("["):
            no_in, self.no_in = self.no_in, False
            node = self.assign()
            self.no_in = no_in
            self.expect("]")
            return node
        if self.type == "private" and private:
            return self.private()
        if self.type in ("string", "number"):
            return self.literal()
        return self.identifier(any_word=True)

    def private(self) -> Node:
        if not self.class_depth:
            self.fail(f"Private field '#{self.value}' must be declared in an enclosing class")
        node = Node("PrivateIdentifier", self.start, name=self.value)
        self.next()
        return self.done(node)

    # -- patterns

    def identifier(self, any_word: bool = False) -> Node:
        if self.type != "name":
            self.fail("Unexpected token")
        v = self.value
        if not any_word and (v in KEYWORDS or v == "enum" or self.strict and v in STRICT_WORDS or v == "await" and (self.module or self.is_async or self.in_static) or v == "yield" and self.is_generator):
            self.fail(f"Unexpected keyword '{v}'")
        node = Node("Identifier", self.start, name=v)
        self.next()
        return self.done(node)

    def rest(self, inner, kind: str = "RestElement") -> Node:
        node = Node(kind, self.start)
        self.next()
        node.argument = inner()
        return self.done(node)

    def binding(self) -> Node:
        start = self.start
        if self.eat("["):
            node = Node("ArrayPattern", start, elements=[])
            while not self.eat("]"):
                if self.eat(","):
                    node.elements.append(None)
                    continue
                if self.at("..."):
                    node.elements.append(self.rest(self.binding))
                    self.expect("]")
                    break
                node.elements.append(self.binding_default())
                if not self.at("]"):
                    self.expect(",")
            return self.done(node)
        if self.eat("{"):
            node = Node("ObjectPattern", start, properties=[])
            while not self.eat("}"):
                if self.at("..."):
                    node.properties.append(self.rest(self.binding))
                    self.expect("}")
                    break
                at, computed = self.start, self.at("[")
                plain = self.type == "name"
                state = self.state()
                key = self.key()
                if self.eat(":"):
                    node.properties.append(self.done(Node("Property", at, method=False, shorthand=False, computed=computed, key=key, kind="init", value=self.binding_default())))
                elif plain:
                    self.restore(state)
                    key = self.identifier()
                    value = key
                    if self.eat("="):
                        value = Node("AssignmentPattern", at, left=key, right=self.assign())
                        self.done(value)
                    node.properties.append(self.done(Node("Property", at, method=False, shorthand=True, computed=False, key=key, kind="init", value=value)))
                else:
                    self.fail("Unexpected token")
                if not self.at("}"):
                    self.expect(",")
            return self.done(node)
        node = self.identifier()
        if self.strict and node.name in ("eval", "arguments"):
            self.fail(f"Binding {node.name} in strict mode", start)
        return node

    def binding_default(self) -> Node:
        start, left = self.start, self.binding()
        if not self.eat("="):
            return left
        no_in, self.no_in = self.no_in, False
        node = Node("AssignmentPattern", start, left=left, right=self.assign())
        self.no_in = no_in
        return self.done(node)

    def pattern(self, node: Node) -> Node:
        """An expression as an assignment target."""
        kind = node.type
        if kind in ("Identifier", "MemberExpression", "ObjectPattern", "ArrayPattern", "AssignmentPattern"):
            if kind == "Identifier" and self.strict and node.name in ("eval", "arguments"):
                self.fail(f"Assigning to {node.name} in strict mode", node.start)
            return node
        if getattr(node, "parenthesized", False):
            self.fail("Assigning to rvalue", node.start)
        if kind == "ObjectExpression":
            node.type = "ObjectPattern"
            for p in node.properties:
                if p.type == "SpreadElement":
                    p.type, p.argument = "RestElement", self.pattern(p.argument)
                elif p.kind != "init" or p.method:
                    self.fail("Object pattern can't contain methods", p.start)
                else:
                    p.value = self.pattern(p.value)
        elif kind == "ArrayExpression":
            node.type = "ArrayPattern"
            for i, e in enumerate(node.elements):
                if e is not None and e.type == "SpreadElement":
                    if i < len(node.elements) - 1:
                        self.fail("Comma is not permitted after the rest element", e.end)
                    e.type, e.argument = "RestElement", self.pattern(e.argument)
                elif e is not None:
                    node.elements[i] = self.pattern(e)
        elif kind == "AssignmentExpression" and node.operator == "=":
            node.type = "AssignmentPattern"
            del node.operator
        else:
            self.fail("Assigning to rvalue", node.start)
        return node

    # -- expressions

    def expression(self, check: bool = True) -> Node:
        start, node = self.start, self.assign(check)
        if self.at(","):
            node = Node("SequenceExpression", start, expressions=[node])
            while self.eat(","):
                node.expressions.append(self.assign(check))
            self.done(node)
        return node

    def assign(self, check: bool = True) -> Node:
        start = self.start
        outer, self.cover = self.cover, None
        node = self.arrow(start) or self.assign_rest(start)
        if self.cover is not None and check:
            self.fail("Shorthand property assignments are valid only in destructuring patterns", self.cover)
        if self.cover is None:
            self.cover = outer
        return node

    def assign_rest(self, start: int) -> Node:
        if self.is_generator and self.word("yield"):
            return self.yield_(start)
        node = self.conditional()
        if self.type == "punctuator" and self.value in ASSIGNMENTS:
            operator = self.value
            if operator == "=":
                node = self.pattern(node)
                self.cover = None
            elif node.type not in ("Identifier", "MemberExpression"):
                self.fail("Assigning to rvalue", start)
            else:
                node = self.pattern(node)
            self.next()
            node = self.done(Node("AssignmentExpression", start, operator=operator, left=node, right=self.assign()))
        return node

    def yield_(self, start: int) -> Node:
        self.next()
        node = Node("YieldExpression", start, argument=None)
        if not self.newline:
            star = self.eat("*")
            if star or not (self.type == "end" or self.type == "punctuator" and self.value in (")", "]", "}", ",", ";", ":") or self.word("in") or self.word("of")):
                node.argument = self.assign()
        return self.done(node)

    def arrow(self, start: int) -> Node | None:
        """An arrow function, if one stands here."""
        is_async = False
        if start in self.not_arrow or not (self.at("(") or self.type == "name"):
            return None
        if self.type == "name":
            kind, value, line = self.peek()
            if self.value in KEYWORDS:
                return None
            single = (kind, value) == ("punctuator", "=>") and not line
            is_async = self.word("async") and not line and not single and ((kind, value) == ("punctuator", "(") or kind == "name" and value not in KEYWORDS)
            if not single and not is_async:
                return None
        state = self.state()
        saved = (self.in_function, self.is_async, self.is_generator, self.loops, self.switches, self.labels, self.strict, self.no_in, self.in_static)
        no_in = self.no_in
        try:
            if is_async:
                self.next()
            node = Node("ArrowFunctionExpression", start, id=None, generator=False, is_async=is_async)
            flags = self.is_async
            self.is_async, self.no_in = self.is_async or is_async, False
            node.params = self.parameters() if self.at("(") else [self.identifier()]
            self.is_async = flags
            if not self.at("=>") or self.newline:
                self.fail("Unexpected token")
        except JsSyntaxError:
            self.leave(saved)
            self.restore(state)
            self.not_arrow.add(start)
            return None
        names = [n for p in node.params for n in bound(p)]
        if len(set(names)) < len(names):
            self.fail("Argument name clash", start)
        self.enter(is_async, False)
        self.in_static = saved[8]
        self.next()
        node.expression = not self.at("{")
        if node.expression:
            self.no_in = no_in
            node.body = self.assign()
            self.leave(saved)
        else:
            body = Node("BlockStatement", self.start, body=[])
            self.expect("{")
            self.directives(body.body)
            while not self.at("}"):
                if self.type == "end":
                    self.fail("Unexpected token")
                body.body.append(self.statement())
            self.check_scope([x for x in body.body if x.type != "FunctionDeclaration"], names + [x.id.name for x in body.body if x.type == "FunctionDeclaration"])
            self.leave(saved)
            self.next()
            node.body = self.done(body)
        return self.done(node)

    def conditional(self) -> Node:
        start, node = self.start, self.binary(0)
        if self.at("?"):
            self.next()
            no_in, self.no_in = self.no_in, False
            yes = self.assign()
            self.no_in = no_in
            self.expect(":")
            node = self.done(Node("ConditionalExpression", start, test=node, consequent=yes, alternate=self.assign()))
        return node

    def binary(self, least: int) -> Node:
        start = self.start
        if self.type == "private":
            left = self.private()
            if not self.word("in"):
                self.fail("Unexpected token")
        else:
            left = self.unary()
        while True:
            operator = self.value if self.type == "punctuator" or self.type == "name" and self.value in ("in", "instanceof") and not self.escaped else ""
            power = PRECEDENCE.get(operator, 0)
            if power <= least and not (operator == "**" and power == least) or not power or operator == "in" and self.no_in:
                return left
            if operator == "**" and left.type in ("UnaryExpression", "AwaitExpression") and not getattr(left, "parenthesized", False):
                self.fail("Unexpected token")
            self.next()
            right = self.binary(power - 1 if operator == "**" else power)
            logical = operator in ("&&", "||", "??")
            if logical:
                for side in (left, right):
                    if side.type == "LogicalExpression" and not getattr(side, "parenthesized", False) and (operator == "??") != (side.operator == "??"):
                        self.fail("Logical expressions and coalesce expressions cannot be mixed", side.start)
            left = self.done(Node("LogicalExpression" if logical else "BinaryExpression", start, left=left, operator=operator, right=right))

    def unary(self) -> Node:
        start = self.start
        if self.type == "punctuator" and self.value in ("!", "~", "+", "-") or self.type == "name" and self.value in ("typeof", "void", "delete") and not self.escaped:
            operator = self.value
            self.next()
            node = self.done(Node("UnaryExpression", start, operator=operator, prefix=True, argument=self.unary()))
            if operator == "delete" and self.strict and node.argument.type == "Identifier":
                self.fail("Deleting local variable in strict mode", start)
            return node
        if self.type == "punctuator" and self.value in ("++", "--"):
            operator = self.value
            self.next()
            return self.done(Node("UpdateExpression", start, operator=operator, prefix=True, argument=self.target(self.unary())))
        if self.word("await") and (self.is_async or self.module and not self.in_function and not self.in_static):
            self.next()
            return self.done(Node("AwaitExpression", start, argument=self.unary()))
        node = self.subscripts(self.primary())
        if self.type == "punctuator" and self.value in ("++", "--") and not self.newline:
            node = Node("UpdateExpression", start, operator=self.value, prefix=False, argument=self.target(node))
            self.next()
            self.done(node)
        return node

    def target(self, node: Node) -> Node:
        if node.type not in ("Identifier", "MemberExpression"):
            self.fail("Assigning to rvalue", node.start)
        return self.pattern(node)

    def subscripts(self, node: Node, no_call: bool = False) -> Node:
        start, chained = node.start if not hasattr(node, "paren_start") else node.paren_start, False
        while True:
            optional = False
            if self.at("?."):
                if no_call:
                    self.fail("Optional chaining cannot appear in the callee of new expressions")
                self.next()
                optional = chained = True
                if not (self.at("[") or self.at("(") or self.type in ("template",)):
                    node = self.member_of(node, start, True)
                    continue
            if self.at(".") and not optional:
                self.next()
                node = self.member_of(node, start, False)
            elif self.at("["):
                self.next()
                no_in, self.no_in = self.no_in, False
                node = Node("MemberExpression", start, object=node, property=self.expression(), computed=True, optional=optional)
                self.no_in = no_in
                self.expect("]")
                self.done(node)
            elif self.at("(") and not no_call:
                node = self.done(Node("CallExpression", start, callee=node, arguments=self.arguments(), optional=optional))
            elif self.type == "template":
                if chained:
                    self.fail("Optional chaining cannot appear in the tag of tagged template expressions")
                node = self.done(Node("TaggedTemplateExpression", start, tag=node, quasi=self.template()))
            else:
                break
        return self.done(Node("ChainExpression", start, expression=node)) if chained else node

    def member_of(self, node: Node, start: int, optional: bool) -> Node:
        name = self.private() if self.type == "private" else self.identifier(any_word=True)
        return self.done(Node("MemberExpression", start, object=node, property=name, computed=False, optional=optional))

    def arguments(self) -> list[Node]:
        out = []
        no_in, self.no_in = self.no_in, False
        self.expect("(")
        while not self.at(")"):
            out.append(self.rest(self.assign, "SpreadElement") if self.at("...") else self.assign())
            if not self.at(")"):
                self.expect(",")
        self.no_in = no_in
        self.next()
        return out

    def primary(self) -> Node:
        start, kind, v = self.start, self.type, self.value
        if kind == "name":
            if not self.escaped:
                if v == "function":
                    self.next()
                    return self.function(Node("FunctionExpression", start), False)
                if v == "async":
                    after = self.peek()
                    if after[:2] == ("name", "function") and not after[2]:
                        self.next()
                        self.next()
                        return self.function(Node("FunctionExpression", start), False, is_async=True)
                if v == "class":
                    return self.class_(Node("ClassExpression", start), False)
                if v == "this":
                    self.next()
                    return self.done(Node("ThisExpression", start))
                if v == "super":
                    self.next()
                    if not (self.at(".") or self.at("[") or self.at("(")):
                        self.fail("Unexpected token")
                    node = Node("Super", start)
                    node.end = self.last_end
                    return node
                if v in ("null", "true", "false"):
                    self.next()
                    return self.done(Node("Literal", start, value={"null": None, "true": "true", "false": "false"}[v]))
                if v == "new":
                    return self.new(start)
                if v == "import":
                    return self.import_expression(start)
            return self.identifier()
        if kind in ("number", "string"):
            return self.literal()
        if kind == "template":
            return self.template()
        if v == "(":
            return self.parenthesized(start)
        if v == "[":
            return self.array(start)
        if v == "{":
            return self.object(start)
        if v in ("/", "/="):
            return self.regex(start)
        if v == "<":
            return self.jsx(start)
        if v == "@":
            self.decorators()
            return self.primary()
        self.fail("Unexpected token")

    def parenthesized(self, start: int) -> Node:
        no_in, self.no_in = self.no_in, False
        self.next()
        node = self.expression()
        self.no_in = no_in
        self.expect(")")
        node.parenthesized, node.paren_start = True, start
        return node

    def literal(self) -> Node:
        node = Node("Literal", self.start, value=shown(self.type, self.value))
        self.next()
        return self.done(node)

    def new(self, start: int) -> Node:
        self.next()
        if self.eat("."):
            if not self.word("target") or not (self.in_function or self.in_static):
                self.fail("'new.target' can only be used in functions")
            self.next()
            return self.done(Node("MetaProperty", start))
        if self.word("import"):
            self.fail("Cannot use new with import()")
        callee = self.subscripts(self.primary(), no_call=True)
        return self.done(Node("NewExpression", start, callee=callee, arguments=self.arguments() if self.at("(") else []))

    def import_expression(self, start: int) -> Node:
        self.next()
        if self.eat("."):
            if not self.word("meta") or not self.module:
                self.fail("Cannot use 'import.meta' outside a module")
            self.next()
            return self.done(Node("MetaProperty", start))
        if not self.at("("):
            self.fail("Unexpected token")
        args = self.arguments()
        if not 1 <= len(args) <= 2:
            self.fail("Unexpected token", start)
        return self.done(Node("ImportExpression", start, source=args[0], options=args[1] if len(args) > 1 else None))

    def array(self, start: int) -> Node:
        node = Node("ArrayExpression", start, elements=[])
        no_in, self.no_in = self.no_in, False
        self.next()
        while not self.at("]"):
            if self.at(","):
                self.next()
                node.elements.append(None)
                continue
            node.elements.append(self.rest(lambda: self.assign(False), "SpreadElement") if self.at("...") else self.assign(False))
            if not self.at("]"):
                self.expect(",")
        self.no_in = no_in
        self.next()
        return self.done(node)

    def object(self, start: int) -> Node:
        node = Node("ObjectExpression", start, properties=[])
        no_in, self.no_in = self.no_in, False
        self.next()
        while not self.at("}"):
            node.properties.append(self.rest(lambda: self.assign(False), "SpreadElement") if self.at("...") else self.property())
            if not self.at("}"):
                self.expect(",")
        self.no_in = no_in
        self.next()
        return self.done(node)

    def property(self) -> Node:
        start, is_async, generator, kind = self.start, False, False, "init"
        if self.word("async") and not self.ends_key() and not self.peek()[2]:
            self.next()
            is_async = True
        if self.eat("*"):
            generator = True
        if not is_async and not generator and (self.word("get") or self.word("set")) and not self.ends_key():
            kind = self.value
            self.next()
        computed, plain, state = self.at("["), self.type == "name", self.state()
        key = self.key()
        node = Node("Property", start, method=False, shorthand=False, computed=computed, key=key, kind=kind)
        if kind != "init" or is_async or generator or self.at("("):
            value = Node("FunctionExpression", self.start, id=None)
            node.method = kind == "init"
            node.value = self.function_rest(value, is_async, generator)
            self.check_accessor(kind, value)
        elif self.eat(":"):
            node.value = self.assign(False)
        elif plain:
            self.restore(state)
            node.key = self.identifier()
            node.shorthand, node.value = True, node.key
            if self.at("="):
                if self.cover is None:
                    self.cover = self.start
                at = self.cover
                self.next()
                node.value = self.done(Node("AssignmentPattern", start, left=node.key, right=self.assign()))
                self.cover = at
        else:
            self.fail("Unexpected token")
        return self.done(node)

    def regex(self, start: int) -> Node:
        s, i, inside = self.s, start + 1, False
        while True:
            if i >= self.n or s[i] in BREAKS:
                self.fail("Unterminated regular expression", start)
            if s[i] == "\\":
                i += 1
            elif s[i] == "[":
                inside = True
            elif s[i] == "]":
                inside = False
            elif s[i] == "/" and not inside:
                break
            i += 1
        m = _ID.match(s, i + 1)
        flags = m[0] if m else ""
        if len(set(flags)) < len(flags) or not set(flags) <= set("dgimsuvy") or {"u", "v"} <= set(flags):
            self.fail("Invalid regular expression flag", start)
        self.pos = self.end = i + 1 + len(flags)
        node = Node("Literal", start, value=s[start : self.pos])
        self.next()
        return self.done(node)

    def template(self) -> Node:
        node = Node("TemplateLiteral", self.start, expressions=[])
        s, i = self.s, self.start + 1
        while True:
            if i >= self.n:
                self.fail("Unterminated template", node.start)
            if s[i] == "\\":
                i += 2
            elif s[i] == "`":
                break
            elif s.startswith("${", i):
                self.pos = self.end = i + 2
                no_in, self.no_in = self.no_in, False
                self.next()
                node.expressions.append(self.expression())
                self.no_in = no_in
                if not self.at("}"):
                    self.fail("Unexpected token")
                i = self.start + 1
            else:
                i += 1
        self.pos = self.end = i + 1
        self.next()
        return self.done(node)

    # -- JSX, by characters

    def jsx(self, start: int) -> Node:
        node, self.pos = self.jsx_element(start)
        self.end = self.pos
        self.next()
        node.end = self.last_end
        return node

    def jsx_space(self, i: int) -> int:
        """Past white space and comments inside a tag."""
        s = self.s
        while True:
            if m := _SPACE.match(s, i):
                i = m.end()
            elif s.startswith("//", i) or s.startswith("/*", i):
                self.pos = i
                end = s.find("*/", i + 2) + 2 if s[i + 1] == "*" else next((m.start() for m in [re.compile(f"[{BREAKS}]").search(s, i)] if m), self.n)
                if end < i + 2:
                    self.fail("Unterminated comment", i)
                self.comments.append((i, end))
                i = end
            else:
                return i

    def jsx_name(self, i: int) -> tuple[Node | None, str, int]:
        s = self.s
        m = _JSX_NAME.match(s, i)
        if not m:
            return None, "", i
        name, i = m[0], m.end()
        node = Node("JSXIdentifier", m.start(), name=name)
        node.end = i
        sep = s[i : i + 1]
        while sep in (".", ":") and (m := _JSX_NAME.match(s, i + 1)):
            outer = Node("JSXMemberExpression" if sep == "." else "JSXNamespacedName", node.start, object=node)
            name += sep + m[0]
            i = outer.end = m.end()
            node, sep = outer, s[i : i + 1]
        return node, name, i

    def jsx_braces(self, i: int, kind: str = "JSXExpressionContainer") -> tuple[Node, int]:
        """An expression in braces; ``i`` is after the opening one."""
        node = Node(kind, i - 1)
        self.pos = self.end = i
        self.next()
        if self.at("..."):
            self.next()
            node.argument = self.assign()
        elif self.at("}"):
            node.expression = None
        else:
            node.expression = self.expression()
        if not self.at("}"):
            self.fail("Unexpected token")
        node.end = self.start + 1
        return node, node.end

    def jsx_element(self, start: int) -> tuple[Node, int]:
        s, i = self.s, self.jsx_space(start + 1)
        name_node, name, i = self.jsx_name(i)
        node = Node("JSXElement" if name else "JSXFragment", start, name=name_node, attributes=[], children_=[])
        while True:
            i = self.jsx_space(i)
            if s.startswith("/", i):
                i = self.jsx_space(i + 1)
                if not name or s[i : i + 1] != ">":
                    self.fail("Unexpected token", i)
                node.end = i + 1
                return node, i + 1
            if s.startswith(">", i):
                break
            if not name:
                self.fail("Unexpected token", i)
            if s.startswith("{", i):
                spread, i = self.jsx_braces(i + 1, "JSXSpreadAttribute")
                node.attributes.append(spread)
                continue
            attribute, _, after = self.jsx_name(i)
            if attribute is None:
                self.fail("Unexpected token", i)
            one = Node("JSXAttribute", i, name=attribute, value=None)
            i = self.jsx_space(after)
            if s.startswith("=", i):
                i = self.jsx_space(i + 1)
                c = s[i : i + 1]
                if c in ("'", '"') and c:
                    end = s.find(c, i + 1)
                    if end < 0:
                        self.fail("Unterminated string constant", i)
                    one.value = Node("Literal", i, value=s[i + 1 : end])
                    i = one.value.end = end + 1
                elif c == "{":
                    one.value, i = self.jsx_braces(i + 1)
                elif c == "<":
                    one.value, i = self.jsx_element(i)
                else:
                    self.fail("JSX value should be either an expression or a quoted JSX text", i)
            one.end = i
            node.attributes.append(one)
        i += 1
        while True:
            if i >= self.n:
                self.fail("Unterminated JSX contents", start)
            c = s[i]
            if c == "{":
                child, i = self.jsx_braces(i + 1)
                node.children_.append(child)
            elif c == "<":
                j = self.jsx_space(i + 1)
                if s.startswith("/", j):
                    _, closing, j = self.jsx_name(self.jsx_space(j + 1))
                    j = self.jsx_space(j)
                    if closing != name or s[j : j + 1] != ">":
                        self.fail(f"Expected corresponding JSX closing tag for <{name}>", i)
                    node.end = j + 1
                    return node, j + 1
                child, i = self.jsx_element(i)
                node.children_.append(child)
            elif c in ">}":
                self.fail("Unexpected token", i)
            else:
                i += 1


_STATEMENTS = {"if", "while", "do", "for", "switch", "try", "return", "throw", "break", "continue", "debugger", "with"}


def shown(kind: str, raw: str) -> str:
    """A literal's value as a string."""
    if kind == "string":
        return unescape(raw) if "\\" in raw else raw
    text = raw.replace("_", "")
    if text.endswith("n") and not text[:2].lower() == "0x" or text.endswith("n"):
        return str(int(text[:-1], 0)) if text[:2].lower() in ("0x", "0o", "0b") else text[:-1].lstrip("0") or "0"
    if text[:2].lower() in ("0x", "0o", "0b"):
        return number(float(int(text, 0)))
    if re.fullmatch(r"0[0-7]+", text):
        return number(float(int(text, 8)))
    return number(float(text))


def number(x: float) -> str:
    """A number as the language prints it."""
    if x == float("inf"):
        return "Infinity"
    if x == int(x) and x < 1e21:
        return str(int(x))
    digits = repr(x)
    mantissa, _, exponent = digits.partition("e")
    if not exponent:
        return digits
    e = int(exponent)
    if -7 < e < 0:
        d = mantissa.replace(".", "")
        return "0." + "0" * (-e - 1) + d
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def unescape(raw: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] == "u" and len(x) > 1:
            return units(chr(min(int(x[1:].strip("{}"), 16), 0x10FFFF)))
        if x[0] == "x" and len(x) == 3:
            return chr(int(x[1:], 16))
        if x[0] in "01234567":
            return chr(int(x, 8))
        return "" if x in ("\n", "\r", "\r\n", "\u2028", "\u2029") else plain.get(x, x)

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[0-3]?[0-7]{1,2}|\r\n|[\s\S])", one, raw)


def bound(node: Node | None) -> list[str]:
    """Names that a pattern binds."""
    if node is None:
        return []
    kind = node.type
    if kind == "Identifier":
        return [node.name]
    if kind == "RestElement":
        return bound(node.argument)
    if kind == "AssignmentPattern":
        return bound(node.left)
    if kind == "ArrayPattern":
        return [n for e in node.elements for n in bound(e)]
    if kind == "ObjectPattern":
        return [n for p in node.properties for n in bound(p.argument if p.type == "RestElement" else p.value)]
    return []


def place(text: str, at: int) -> tuple[int, int]:
    """Line (from 1) and column (from 0) of an offset."""
    line, start = 1, 0
    for m in _LINE.finditer(text, 0, at):
        line, start = line + 1, m.end()
    return line, at - start


def parse(text: str) -> tuple[Node, list[tuple[int, int]]]:
    """The tree and the comments (start, end) of a source: as a module, or else as a script where ``return`` may stand anywhere."""
    try:
        parser = Parser(text, True)
        return parser.program(), parser.comments
    except JsSyntaxError as error:
        try:
            parser = Parser(text, False)
            return parser.program(), parser.comments
        except JsSyntaxError:
            raise error from None

"""A parser for ECMAScript: source text to a tree of dicts with the field names of the public ESTree specification.

One pass, linear in the text: parenthesised expressions are read as
expressions and turned into parameters when an arrow follows.  A module and a
script are read alike.
"""

from __future__ import annotations

import re
import sys

Node = dict

_SPACE = r"(?:[\s\ufeff]+|//[^\n\r]*|/\*[\s\S]*?\*/)*"
_GAP = re.compile(_SPACE)
#: The gap before a token and the token, in one match.
_TOKEN = re.compile(
    rf"(?P<gap>{_SPACE})(?:"
    r"(?P<name>#?(?:[^\W\d]|\$|\\u[\da-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[\da-fA-F]{4})*)"
    r"|(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
    r"|(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.`@]))"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_QUASI = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_ESCAPE = re.compile(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|\r\n|[\s\S])")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}

_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_UNARY = {"!", "~", "+", "-", "typeof", "void", "delete"}
_WORDS = {"if", "for", "while", "do", "return", "break", "continue", "throw", "try", "switch", "var", "const", "function", "class", "import", "export", "with", "debugger"}


class SourceError(ValueError):
    """The text is not a program."""


def _unescape(raw: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if len(e) > 1 and e[0] in "ux":
            code = int(e[1:].strip("{}"), 16)
            return chr(code) if code < 0x110000 else "\ufffd"
        return _SIMPLE.get(e, e)

    return _ESCAPE.sub(one, raw) if "\\" in raw else raw


def _number(raw: str) -> float | int:
    text = raw.replace("_", "").rstrip("n")
    if text[:2].lower() in ("0x", "0b", "0o"):
        return int(text, 0)
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


class _Parser:
    def __init__(self, source: str):
        self.source, self.end, self.last = source, 0, 0
        self.seen = (-1, 0, None)
        if source.startswith("#!"):
            self.end = source.find("\n") if "\n" in source else len(source)
        self.step()

    def scan(self) -> tuple[int, re.Match | None]:
        """Place and match of the token behind ``end``; what was seen last is kept, as most tokens are peeked at."""
        end = self.end
        if self.seen[0] != end:
            m = _TOKEN.match(self.source, end)
            self.seen = (end, _GAP.match(self.source, end).end(), None) if m is None else (end, m.end(1), m)
        return self.seen[1:]

    def step(self) -> None:
        """Read the next token."""
        end = self.last = self.end
        seen = self.seen
        _, at, m = seen if seen[0] == end else (end, *self.scan())
        if at > end:
            gap = self.source[end:at]
            self.newline = "\n" in gap or "\r" in gap
        else:
            self.newline = False
        self.start = at
        if m is None:
            if at < len(self.source):
                raise SourceError(f"unexpected character at {at}")
            self.kind, self.value, self.end = "eof", "", at
            return
        kind = self.kind = m.lastgroup
        self.value, self.end = m[kind], m.end()

    def node(self, type_: str, start: int, **fields) -> Node:
        return {"type": type_, "start": start, "end": self.last, **fields}

    def at(self, value: str) -> bool:
        return self.value == value and self.kind in ("punct", "name")

    def take(self, value: str) -> bool:
        if self.at(value):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise SourceError(f"expected {value!r} at {self.start}, found {self.value!r}")

    def semicolon(self) -> None:
        if not self.take(";") and not (self.at("}") or self.kind == "eof" or self.newline):
            raise SourceError(f"expected ';' at {self.start}, found {self.value!r}")

    def peek(self) -> tuple[str, str, bool]:
        """Kind and text of the token after this one, and whether a line ends before it."""
        at, m = self.scan()
        gap = self.source[self.end : at]
        return (m.lastgroup, m[m.lastgroup], "\n" in gap) if m else ("eof", "", "\n" in gap)

    # Statements

    def program(self) -> Node:
        body = []
        while self.kind != "eof":
            body.append(self.statement())
        return self.node("Program", 0, body=body)

    def block(self) -> Node:
        start, body = self.start, []
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise SourceError("unclosed block")
            body.append(self.statement())
        self.step()
        return self.node("BlockStatement", start, body=body)

    def statement(self) -> Node:
        start, word = self.start, self.value
        if self.kind == "punct":
            if word == "{":
                return self.block()
            if word == ";":
                self.step()
                return self.node("EmptyStatement", start)
        elif self.kind == "name":
            kind, text, line = self.peek()
            if word in ("var", "const") or (word == "let" and (kind == "name" and text not in ("in", "instanceof", "of") or text in ("[", "{"))):
                found = self.declaration()
                self.semicolon()
                return found
            if word == "function" or (word == "async" and text == "function" and not line):
                return self.function(True)
            if word == "class":
                return self.class_(True)
            if word == "import" and text not in ("(", "."):
                return self.import_()
            if word in _WORDS and word != "import":
                return getattr(self, "s_" + word)(start)
            if text == ":" and kind == "punct":
                label = self.identifier()
                self.step()
                return self.node("LabeledStatement", start, label=label, body=self.statement())
        expression = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=expression)

    def declaration(self, no_in: bool = False) -> Node:
        start, kind, found = self.start, self.value, []
        self.step()
        while True:
            at = self.start
            target = self.pattern()
            init = self.assignment(no_in) if self.take("=") else None
            found.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.take(","):
                break
        return self.node("VariableDeclaration", start, kind=kind, declarations=found)

    def in_parens(self) -> Node:
        self.need("(")
        found = self.expression()
        self.need(")")
        return found

    def s_if(self, start: int) -> Node:
        self.step()
        test, then = self.in_parens(), self.statement()
        return self.node("IfStatement", start, test=test, consequent=then, alternate=self.statement() if self.take("else") else None)

    def s_for(self, start: int) -> Node:
        self.step()
        self.take("await")
        self.need("(")
        init = None
        if not self.at(";"):
            init = self.declaration(True) if self.value in ("var", "let", "const") and self.kind == "name" else self.expression(True)
        if self.at("of") or self.at("in"):
            kind = "ForOfStatement" if self.value == "of" else "ForInStatement"
            self.step()
            right = self.assignment() if kind == "ForOfStatement" else self.expression()
            self.need(")")
            left = init if init["type"] == "VariableDeclaration" else self.to_pattern(init)
            return self.node(kind, start, left=left, right=right, body=self.statement())
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        return self.node("ForStatement", start, init=init, test=test, update=update, body=self.statement())

    def s_while(self, start: int) -> Node:
        self.step()
        return self.node("WhileStatement", start, test=self.in_parens(), body=self.statement())

    def s_with(self, start: int) -> Node:
        self.step()
        return self.node("WithStatement", start, object=self.in_parens(), body=self.statement())

    def s_do(self, start: int) -> Node:
        self.step()
        body = self.statement()
        self.need("while")
        test = self.in_parens()
        self.take(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def s_return(self, start: int) -> Node:
        self.step()
        found = None if self.newline or self.at(";") or self.at("}") or self.kind == "eof" else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, argument=found)

    def s_throw(self, start: int) -> Node:
        self.step()
        found = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, argument=found)

    def s_break(self, start: int) -> Node:
        kind = "BreakStatement" if self.value == "break" else "ContinueStatement"
        self.step()
        label = self.identifier() if self.kind == "name" and not self.newline else None
        self.semicolon()
        return self.node(kind, start, label=label)

    s_continue = s_break

    def s_debugger(self, start: int) -> Node:
        self.step()
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def s_try(self, start: int) -> Node:
        self.step()
        body, handler = self.block(), None
        at = self.start
        if self.take("catch"):
            param = None
            if self.take("("):
                param = self.pattern()
                self.need(")")
            handler = self.node("CatchClause", at, param=param, body=self.block())
        return self.node("TryStatement", start, block=body, handler=handler, finalizer=self.block() if self.take("finally") else None)

    def s_switch(self, start: int) -> Node:
        self.step()
        subject, cases = self.in_parens(), []
        self.need("{")
        while not self.take("}"):
            at = self.start
            test = None
            if not self.take("default"):
                self.need("case")
                test = self.expression()
            self.need(":")
            body = []
            while not (self.at("case") or self.at("default") or self.at("}")):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", at, test=test, consequent=body))
        return self.node("SwitchStatement", start, discriminant=subject, cases=cases)

    def specifiers(self, first: str, second: str, type_: str) -> list[Node]:
        found = []
        self.need("{")
        while not self.take("}"):
            at = self.start
            one = self.property_name()[0]
            two = self.property_name()[0] if self.take("as") else one
            found.append(self.node(type_, at, **{first: one, second: two}))
            if not self.at("}"):
                self.need(",")
        return found

    def attributes(self) -> None:
        if self.at("with") and self.peek()[1] == "{":
            self.step()
            self.primary()

    def import_(self) -> Node:
        start, found = self.start, []
        self.step()
        if self.kind != "str":
            while True:
                at = self.start
                if self.at("{"):
                    found += self.specifiers("imported", "local", "ImportSpecifier")
                elif self.take("*"):
                    self.need("as")
                    found.append(self.node("ImportNamespaceSpecifier", at, local=self.identifier()))
                else:
                    found.append(self.node("ImportDefaultSpecifier", at, local=self.identifier()))
                if not self.take(","):
                    break
            self.need("from")
        source = self.primary()
        self.attributes()
        self.semicolon()
        return self.node("ImportDeclaration", start, specifiers=found, source=source)

    def s_export(self, start: int) -> Node:
        self.step()
        if self.take("default"):
            if self.at("function") or (self.at("async") and self.peek()[1] == "function"):
                found = self.function(True)
            elif self.at("class"):
                found = self.class_(True)
            else:
                found = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, declaration=found)
        if self.take("*"):
            name = self.property_name()[0] if self.take("as") else None
            self.need("from")
            source = self.primary()
            self.semicolon()
            return self.node("ExportAllDeclaration", start, exported=name, source=source)
        if self.at("{"):
            found = self.specifiers("local", "exported", "ExportSpecifier")
            source = self.primary() if self.take("from") else None
            self.attributes()
            self.semicolon()
            return self.node("ExportNamedDeclaration", start, declaration=None, specifiers=found, source=source)
        return self.node("ExportNamedDeclaration", start, declaration=self.statement(), specifiers=[], source=None)

    # Functions, classes and patterns

    def identifier(self) -> Node:
        if self.kind != "name":
            raise SourceError(f"expected a name at {self.start}, found {self.value!r}")
        start, name = self.start, self.value
        self.step()
        return self.node("Identifier", start, name=name)

    def pattern(self) -> Node:
        """A target of a binding, without its default."""
        if self.at("[") or self.at("{"):
            return self.to_pattern(self.primary())
        return self.identifier()

    def parameters(self) -> list[Node]:
        found = []
        self.need("(")
        while not self.take(")"):
            start = self.start
            if self.take("..."):
                found.append(self.node("RestElement", start, argument=self.pattern()))
            else:
                target = self.pattern()
                found.append(self.node("AssignmentPattern", start, left=target, right=self.assignment()) if self.take("=") else target)
            if not self.at(")"):
                self.need(",")
        return found

    def function(self, declared: bool) -> Node:
        start = self.start
        is_async = self.take("async")
        self.need("function")
        generator = self.take("*")
        name = self.identifier() if self.kind == "name" else None
        params = self.parameters()
        return self.node("FunctionDeclaration" if declared else "FunctionExpression", start, id=name, params=params, body=self.block(), **{"async": is_async, "generator": generator})

    def method(self, start: int, is_async: bool = False, generator: bool = False) -> Node:
        params = self.parameters()
        return self.node("FunctionExpression", start, id=None, params=params, body=self.block(), **{"async": is_async, "generator": generator})

    def class_(self, declared: bool) -> Node:
        start = self.start
        self.need("class")
        name = self.identifier() if self.kind == "name" and self.value != "extends" else None
        base = self.subscripts(self.primary()) if self.take("extends") else None
        at, body = self.start, []
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                body.append(self.member())
        return self.node("ClassDeclaration" if declared else "ClassExpression", start, id=name, superClass=base, body=self.node("ClassBody", at, body=body))

    def modifiers(self) -> tuple[bool, bool, bool, str]:
        """static, async, generator and get or set before a member's name."""
        static = is_async = False
        kind = ""
        while self.kind == "name" and self.value in ("static", "async", "get", "set"):
            after = self.peek()
            if after[1] in ("(", "=", ";", ",", "}", ":") and after[0] == "punct" or after[2] and self.value == "async":
                break
            if self.value == "static":
                static = True
            elif self.value == "async":
                is_async = True
            else:
                kind = self.value
            self.step()
        return static, is_async, self.take("*"), kind

    def member(self) -> Node:
        start = self.start
        static, is_async, generator, kind = self.modifiers()
        if static and self.at("{"):
            return self.node("StaticBlock", start, body=self.block()["body"])
        key, computed = self.property_name()
        if self.at("("):
            name = key.get("name")
            return self.node("MethodDefinition", start, key=key, computed=computed, static=static, kind=kind or ("constructor" if name == "constructor" and not static else "method"), value=self.method(self.start, is_async, generator))
        value = self.assignment() if self.take("=") else None
        self.semicolon()
        return self.node("PropertyDefinition", start, key=key, computed=computed, static=static, value=value)

    def property_name(self) -> tuple[Node, bool]:
        if self.take("["):
            found = self.assignment()
            self.need("]")
            return found, True
        if self.kind == "name":
            return self.identifier(), False
        if self.kind in ("str", "num"):
            return self.primary(), False
        raise SourceError(f"expected a property name at {self.start}, found {self.value!r}")

    def to_pattern(self, n: Node) -> Node:
        """An expression that turns out to be a target."""
        if n["type"] == "AssignmentExpression" and n["operator"] == "=":
            return {**n, "type": "AssignmentPattern"}
        if n["type"] == "SpreadElement":
            return {**n, "type": "RestElement", "argument": self.to_pattern(n["argument"])}
        if n["type"] == "ArrayExpression":
            return {**n, "type": "ArrayPattern", "elements": [e and self.to_pattern(e) for e in n["elements"]]}
        if n["type"] == "ObjectExpression":
            return {**n, "type": "ObjectPattern", "properties": [self.to_pattern(p) if p["type"] == "SpreadElement" else {**p, "value": self.to_pattern(p["value"])} for p in n["properties"]]}
        if n["type"] in ("Identifier", "MemberExpression", "ObjectPattern", "ArrayPattern", "AssignmentPattern", "RestElement"):
            return n
        raise SourceError(f"cannot assign at {n['start']}")

    # Expressions

    def expression(self, no_in: bool = False) -> Node:
        start, first = self.start, self.assignment(no_in)
        if not self.at(","):
            return first
        found = [first]
        while self.take(","):
            found.append(self.assignment(no_in))
        return self.node("SequenceExpression", start, expressions=found)

    def arrow(self, start: int, params: list[Node], is_async: bool, no_in: bool) -> Node:
        self.need("=>")
        body = self.block() if self.at("{") else self.assignment(no_in)
        return self.node("ArrowFunctionExpression", start, id=None, params=params, body=body, generator=False, **{"async": is_async})

    def assignment(self, no_in: bool = False) -> Node:
        start = self.start
        if self.kind == "name":
            kind, text, line = self.peek()
            if text == "=>" and not line:
                return self.arrow(start, [self.identifier()], False, no_in)
            if self.value == "async" and kind == "name" and not line and text not in ("function", "in", "of", "instanceof"):
                self.step()
                return self.arrow(start, [self.identifier()], True, no_in)
            if self.value == "yield" and not (kind == "punct" and text in ("=", ".", "=>")):
                self.step()
                delegate = self.take("*")
                empty = self.newline or self.kind == "eof" or (self.kind == "punct" and self.value in (")", "]", "}", ",", ";", ":"))
                return self.node("YieldExpression", start, delegate=delegate, argument=None if empty else self.assignment(no_in))
        left = self.binary(self.unary(), 0, no_in)
        if left["type"] == "Cover":
            return self.arrow(start, [self.to_pattern(p) for p in left["items"]], left["async"], no_in)
        if self.at("?"):
            self.step()
            then = self.assignment()
            self.need(":")
            return self.node("ConditionalExpression", start, test=left, consequent=then, alternate=self.assignment(no_in))
        if self.kind == "punct" and self.value in _ASSIGN:
            operator = self.value
            target = self.to_pattern(left) if operator == "=" else left
            self.step()
            return self.node("AssignmentExpression", start, operator=operator, left=target, right=self.assignment(no_in))
        return left

    def binary(self, left: Node, least: int, no_in: bool) -> Node:
        while True:
            operator = self.value
            rank = _BINARY.get(operator, 0) if self.kind in ("punct", "name") else 0
            if rank <= least or (no_in and operator == "in") or left["type"] == "Cover":
                return left
            self.step()
            right = self.binary(self.unary(), rank - (operator == "**"), no_in)
            logical = operator in ("&&", "||", "??")
            left = self.node("LogicalExpression" if logical else "BinaryExpression", left["start"], operator=operator, left=left, right=right)

    def unary(self) -> Node:
        start, word = self.start, self.value
        if self.kind in ("punct", "name"):
            if word in _UNARY:
                self.step()
                return self.node("UnaryExpression", start, operator=word, argument=self.unary())
            if word in ("++", "--"):
                self.step()
                return self.node("UpdateExpression", start, operator=word, prefix=True, argument=self.unary())
            if word == "await" and self.kind == "name" and self.peek()[1] not in (")", "]", "}", ",", ";", "=", "=>", ".", ":", ""):
                self.step()
                return self.node("AwaitExpression", start, argument=self.unary())
        found = self.subscripts(self.primary())
        if self.kind == "punct" and self.value in ("++", "--") and not self.newline:
            operator = self.value
            self.step()
            return self.node("UpdateExpression", start, operator=operator, prefix=False, argument=found)
        return found

    def arguments(self) -> list[Node]:
        found = []
        self.need("(")
        while not self.take(")"):
            found.append(self.spread_or_value())
            if not self.at(")"):
                self.need(",")
        return found

    def spread_or_value(self) -> Node:
        start = self.start
        if self.take("..."):
            return self.node("SpreadElement", start, argument=self.assignment())
        return self.assignment()

    def subscripts(self, found: Node, calls: bool = True) -> Node:
        if found["type"] == "Cover":
            return found
        start = found["start"]
        while self.kind == "punct":
            if self.value == ".":
                self.step()
                found = self.node("MemberExpression", start, object=found, property=self.identifier(), computed=False, optional=False)
                found["end"] = self.last
            elif self.value == "?." and calls:
                self.step()
                if self.at("("):
                    found = self.node("CallExpression", start, callee=found, arguments=self.arguments(), optional=True)
                elif self.take("["):
                    found = self.node("MemberExpression", start, object=found, property=self.expression(), computed=True, optional=True)
                    self.need("]")
                else:
                    found = self.node("MemberExpression", start, object=found, property=self.identifier(), computed=False, optional=True)
            elif self.value == "[":
                self.step()
                inner = self.expression()
                self.need("]")
                found = self.node("MemberExpression", start, object=found, property=inner, computed=True, optional=False)
            elif self.value == "(" and calls:
                line = self.newline
                inner = self.arguments()
                if found.get("name") == "async" and found["type"] == "Identifier" and self.at("=>") and not line:
                    return {"type": "Cover", "start": start, "end": self.last, "items": inner, "async": True}
                found = self.node("CallExpression", start, callee=found, arguments=inner, optional=False)
            elif self.value == "`":
                found = self.node("TaggedTemplateExpression", start, tag=found, quasi=self.template())
            else:
                break
        return found

    def template(self) -> Node:
        start, quasis, inner = self.start, [], []
        while True:
            m = _QUASI.match(self.source, self.end)
            quasis.append(m[0])
            self.end = m.end()
            if self.source.startswith("`", self.end):
                self.end += 1
                self.step()
                return self.node("TemplateLiteral", start, quasis=quasis, expressions=inner)
            if not self.source.startswith("${", self.end):
                raise SourceError("unclosed template")
            self.end += 2
            self.step()
            inner.append(self.expression())
            if not self.at("}"):
                raise SourceError(f"expected '}}' at {self.start}")

    def primary(self) -> Node:
        start, kind, value = self.start, self.kind, self.value
        if kind == "name":
            if value == "function" or (value == "async" and self.peek()[1] == "function"):
                return self.function(False)
            if value == "class":
                return self.class_(False)
            if value == "new":
                return self.new()
            self.step()
            if value in ("true", "false"):
                return self.node("Literal", start, value=value == "true")
            if value == "null":
                return self.node("Literal", start, value=None)
            if value == "this":
                return self.node("ThisExpression", start)
            if value == "super":
                return self.node("Super", start)
            if value == "import":
                return self.node("ImportExpression", start)
            return self.node("Identifier", start, name=value)
        if kind == "num":
            self.step()
            return self.node("Literal", start, value=_number(value))
        if kind == "str":
            self.step()
            return self.node("Literal", start, value=_unescape(value[1:-1]))
        if value in ("/", "/=") and kind == "punct":
            m = _REGEX.match(self.source, start)
            if m is None:
                raise SourceError(f"bad expression at {start}")
            self.end = m.end()
            self.step()
            return self.node("Literal", start, value=None, regex=m[0][1 : m[0].rindex("/")])
        if value == "(":
            return self.parenthesised()
        if value == "[":
            return self.array()
        if value == "{":
            return self.object()
        if value == "`":
            return self.template()
        raise SourceError(f"unexpected {value!r} at {start}")

    def new(self) -> Node:
        start = self.start
        self.step()
        if self.take("."):
            self.step()
            return self.node("MetaProperty", start)
        callee = self.new() if self.at("new") else self.subscripts(self.primary(), calls=False)
        return self.node("NewExpression", start, callee=callee, arguments=self.arguments() if self.at("(") else [])

    def parenthesised(self) -> Node:
        start, found = self.start, []
        self.step()
        only_params = False
        while not self.at(")"):
            if self.at("..."):
                only_params = True
            found.append(self.spread_or_value())
            if not self.take(","):
                break
            only_params = only_params or self.at(")")
        self.need(")")
        if self.at("=>") and not self.newline:
            return {"type": "Cover", "start": start, "end": self.last, "items": found, "async": False}
        if only_params or not found:
            raise SourceError(f"bad parentheses at {start}")
        return found[0] if len(found) == 1 else self.node("SequenceExpression", start, expressions=found)

    def array(self) -> Node:
        start, found = self.start, []
        self.step()
        while not self.take("]"):
            if self.take(","):
                found.append(None)
                continue
            found.append(self.spread_or_value())
            if not self.at("]"):
                self.need(",")
        return self.node("ArrayExpression", start, elements=found)

    def object(self) -> Node:
        start, found = self.start, []
        self.step()
        while not self.take("}"):
            found.append(self.property())
            if not self.at("}"):
                self.need(",")
        return self.node("ObjectExpression", start, properties=found)

    def property(self) -> Node:
        start = self.start
        if self.at("..."):
            return self.spread_or_value()
        _, is_async, generator, kind = self.modifiers()
        key, computed = self.property_name()
        fields = {"key": key, "computed": computed, "kind": kind or "init", "method": False, "shorthand": False}
        if self.at("("):
            return self.node("Property", start, **fields | {"method": not kind, "value": self.method(self.start, is_async, generator)})
        if self.take(":"):
            return self.node("Property", start, value=self.assignment(), **fields)
        value = key
        if self.take("="):  # a default: only right where the object turns out to be a pattern
            value = self.node("AssignmentPattern", start, left=key, right=self.assignment())
        return self.node("Property", start, value=value, **fields | {"shorthand": True})


def parse(source: str) -> Node:
    """The program's tree; :class:`SourceError` where there is none."""
    if sys.getrecursionlimit() < 100_000:
        sys.setrecursionlimit(100_000)
    return _Parser(source).program()


_MARKS = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|//[^\n\r]*|/\*[\s\S]*?\*/|[`/]|[{}()\[\];]+")
_WORD_END = re.compile(r"[\w$]+$")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
#: How a statement goes on behind a semicolon.
_GOES_ON = re.compile(r"\s*(?:else|while)\b")


def _is_regex(source: str, at: int) -> bool:
    """Whether a slash begins a regular expression, by what is before it."""
    before = source[max(0, at - 40) : at].rstrip()
    if not before or before[-1] in ")]}\"'`":
        return not before
    word = _WORD_END.search(before)
    return word is None or word[0] in _BEFORE_REGEX


def split_statements(source: str, size: int) -> list[int]:
    """Places between statements of the program, each at least ``size`` behind the one before.

    Only brackets, strings, comments and slashes are looked at.  A slash can be
    misread, so what is between two places must be parsed to be sure.
    """
    found: list[int] = []
    last = depth = at = 0
    templates: list[int] = []  # depths of the templates that are open
    changes: dict[str, tuple[int, int]] = {}  # of a run of brackets: the depth's change, and its lowest

    def template(at: int) -> int:
        """Behind a template's text: its end, or the expression in it."""
        nonlocal depth
        at = _QUASI.match(source, at).end()
        if source.startswith("${", at):
            templates.append(depth)
            depth += 1
            return at + 2
        return at + 1

    while (m := _MARKS.search(source, at)) is not None:
        text, at = m[0], m.end()
        first = text[0]
        if first == "`":
            at = template(at)
        elif text == "/":
            if _is_regex(source, m.start()) and (r := _REGEX.match(source, m.start())):
                at = r.end()
        elif first in "{}()[];":
            told = changes.get(text)
            if told is None:
                now = low = 0
                for c in text:
                    now += 1 if c in "{([" else -1 if c in "})]" else 0
                    low = min(low, now)
                told = changes[text] = (now, low)
            if depth + told[1] > (templates[-1] + 1 if templates else 0):
                depth += told[0]
                continue
            for k, c in enumerate(text):
                if c in "{([":
                    depth += 1
                elif c in "})]":
                    depth -= 1
                    if templates and depth == templates[-1]:
                        templates.pop()
                        at = template(m.start() + k + 1)
                        break
                elif depth == 0 and m.start() + k + 1 - last >= size and not _GOES_ON.match(source, m.start() + k + 1):
                    last = m.start() + k + 1
                    found.append(last)
    return found if depth == 0 and not templates else []


def lines_before(source: str) -> list[int]:
    """Places of all line ends, to number lines by bisection."""
    return [m.start() for m in re.finditer(r"\n", source)]


#: Fields that hold targets of bindings, not uses of variables.
_TARGETS = {"left", "id", "param", "params", "local"}


#: Fields without nodes, or with names that are neither uses nor targets.
_PLAIN = {"type", "start", "end", "name", "operator", "kind", "label", "imported", "exported", "computed", "optional", "async", "generator", "static", "shorthand", "regex", "quasis", "prefix", "delegate"}
_plans: dict[tuple[str, bool, int], list[tuple[str, int]]] = {}


def _plan(node: Node) -> list[tuple[str, int]]:
    """The fields of a kind of node that may hold others, in order, and whether these are targets: 0 no, 1 yes, 2 as the node itself."""
    kind, found = node["type"], []
    for field in node:
        if field in _PLAIN or (field in ("property", "key") and not node.get("computed")):
            continue
        if field == "left" and kind in ("BinaryExpression", "LogicalExpression"):
            into = 0
        elif field in _TARGETS or kind in ("ArrayPattern", "ObjectPattern", "RestElement"):
            into = 1
        else:
            into = 2 if field == "value" and kind == "Property" else 0
        found.append((field, into))
    return found


def walk(root: Node):
    """(node, is_use) for all nodes, children before their parent; names in patterns, keys and labels are no uses.

    Without recursion, so that long chains do no harm: parents are listed
    before their children, the last child first, and the list is read backwards.
    """
    stack = [(root, False)]
    listed = []
    while stack:
        one = stack.pop()
        listed.append(one)
        node, target = one
        key = (node["type"], node.get("computed", False), len(node))
        plan = _plans.get(key)
        if plan is None:
            plan = _plans[key] = _plan(node)
        for field, into in plan:
            value = node[field]
            kind = value.__class__
            if kind is dict:
                stack.append((value, target if into == 2 else into == 1))
            elif kind is list:
                into = target if into == 2 else into == 1
                for x in value:
                    if x.__class__ is dict:
                        stack.append((x, into))
    for node, target in reversed(listed):
        yield node, not target

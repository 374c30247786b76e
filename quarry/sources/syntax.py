"""Source files to syntax nodes: a tolerant parser of TypeScript, JavaScript and JSX that emits rows.

A node's descendants are those with node_id above its own and up to its ``exit``, so nesting is a range predicate. ``owner`` is the
nearest enclosing function and ``nesting`` counts the branching nodes between the two. What can't be parsed is passed over."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, node_id int, parent_id int, exit int, depth int, owner int, nesting int, kind string, name string, text string, line int, col int"
BRANCHING = frozenset(("If", "For", "While", "Do", "Switch", "Conditional", "Catch"))

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<name>[A-Za-z_$\x80-\U0010FFFF][\w$]*|\#[A-Za-z_$][\w$]*)|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<template>`)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_WORD_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof await yield default extends".split())
_BINARY = frozenset("+ - * / % ** === !== == != < > <= >= & | ^ = += -= *= /= %= &&= ||= ??= in instanceof".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())
_STATEMENTS = frozenset("if for while do switch try return throw const let var function class interface type enum import export break continue".split())


class _Tok:
    __slots__ = ("at", "end", "kind", "newline", "text")

    def __init__(self, kind: str, text: str, at: int, end: int, newline: bool):
        self.kind, self.text, self.at, self.end, self.newline = kind, text, at, end, newline


class Parser:
    def __init__(self, path: str, source: str):
        self.path, self.s, self.rows = path, source, []
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.pos, self.prev, self.tok = 0, None, None
        self.stack: list[int] = []
        self.owners: list[tuple[int, int]] = [(0, 0)]
        self.next()

    # Tokens -----------------------------------------------------------------
    def value_may_start(self) -> bool:
        p = self.prev
        if p is None:
            return True
        if p.kind == "name":
            return p.text in _WORD_BEFORE_VALUE
        return p.kind == "op" and p.text not in (")", "]", "}", "++", "--")

    def next(self) -> _Tok | None:
        if self.tok is not None:
            self.prev = self.tok
        newline = False
        while True:
            if self.pos >= len(self.s):
                self.tok = None
                return None
            m = _TOKEN.match(self.s, self.pos)
            if m is None:
                self.pos += 1
                continue
            kind = m.lastgroup
            if kind in ("space", "comment"):
                newline |= "\n" in m[0]
                self.pos = m.end()
                continue
            if kind == "op" and m[0] in ("/", "/=") and self.value_may_start() and (r := _REGEX.match(self.s, self.pos)):
                kind, m = "regex", r
            self.tok = _Tok(kind, m[0], m.start(), m.end(), newline)
            self.pos = m.end()
            return self.tok

    def back(self, mark) -> None:
        self.pos, self.prev, self.tok = mark

    def mark(self):
        return self.pos, self.prev, self.tok

    def at(self, *texts: str) -> bool:
        return self.tok is not None and self.tok.kind != "string" and self.tok.text in texts

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.next()
            return True
        return False

    # Nodes ------------------------------------------------------------------
    def open(self, kind: str, name: str | None = None, text: str | None = None, at: int | None = None) -> int:
        at = (self.tok.at if self.tok else len(self.s)) if at is None else at
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= at else (lo, mid)
        i = len(self.rows)
        owner, nesting = self.owners[-1]
        self.rows.append([self.path, i, self.stack[-1] if self.stack else None, i, len(self.stack), owner, nesting, kind, name, text, lo + 1, at - self.starts[lo] + 1])
        self.stack.append(i)
        if kind == "Function":
            self.owners.append((i, 0))
        elif kind in BRANCHING:
            self.owners.append((owner, nesting + 1))
        return i

    def close(self, i: int) -> None:
        while self.stack and self.stack[-1] >= i:
            j = self.stack.pop()
            self.rows[j][3] = len(self.rows) - 1
            if self.rows[j][7] == "Function" or self.rows[j][7] in BRANCHING:
                self.owners.pop()

    def leaf(self, kind: str, name: str | None = None, text: str | None = None, at: int | None = None) -> None:
        self.close(self.open(kind, name, text, at))

    # Statements -------------------------------------------------------------
    def parse(self) -> list[list]:
        root = self.open("Program", at=0)
        while self.tok is not None:
            before = self.tok
            self.statement()
            if self.tok is before:
                self.next()
        self.close(root)
        return self.rows

    def block(self, end: str = "}") -> None:
        while self.tok is not None and not self.at(end):
            before = self.tok
            self.statement()
            if self.tok is before:
                self.next()
        self.eat(end)

    def parens(self) -> None:
        if self.eat("("):
            self.values(")")

    def statement(self) -> None:
        t = self.tok
        if t.kind == "op":
            if t.text == "{":
                self.next()
                return self.block()
            if t.text == ";":
                self.next()
                return None
            if t.text == "@":
                self.next()
                return self.expression()
        if t.kind != "name":
            return self.expression_statement()
        word = t.text
        if word == "if":
            n = self.open("If")
            self.next()
            self.parens()
            self.substatement()
            if self.eat("else"):
                self.substatement()
            return self.close(n)
        if word in ("for", "while"):
            n = self.open("For" if word == "for" else "While")
            self.next()
            self.eat("await")
            self.parens()
            self.substatement()
            return self.close(n)
        if word == "do":
            n = self.open("Do")
            self.next()
            self.substatement()
            if self.eat("while"):
                self.parens()
            return self.close(n)
        if word == "switch":
            n = self.open("Switch")
            self.next()
            self.parens()
            if self.eat("{"):
                self.cases()
            return self.close(n)
        if word == "try":
            n = self.open("Try")
            self.next()
            self.substatement()
            if self.at("catch"):
                c = self.open("Catch")
                self.next()
                self.parens()
                self.substatement()
                self.close(c)
            if self.eat("finally"):
                self.substatement()
            return self.close(n)
        if word in ("return", "throw"):
            n = self.open("Return" if word == "return" else "Throw")
            self.next()
            if self.tok is not None and not self.tok.newline and not self.at(";", "}"):
                self.expression()
            self.eat(";")
            return self.close(n)
        if word == "const" and self.lookahead() == "enum":
            self.next()
            word = "enum"
        if word in ("const", "let", "var"):
            return self.variables()
        if word == "import":
            return self.import_()
        if word == "export":
            return self.export()
        if word in ("interface", "enum", "type", "namespace", "module", "declare", "abstract") and self.declared():
            return None
        return self.expression_statement()

    def substatement(self) -> None:
        if self.tok is not None:
            self.statement()

    def cases(self) -> None:
        while self.tok is not None and not self.at("}"):
            before = self.tok
            if self.at("case", "default"):
                n = self.open("Case" if self.at("case") else "Default")
                self.next()
                if not self.at(":"):
                    self.expression(stop=(":",))
                self.eat(":")
                while self.tok is not None and not self.at("case", "default", "}"):
                    inner = self.tok
                    self.statement()
                    if self.tok is inner:
                        self.next()
                self.close(n)
            if self.tok is before:
                self.next()
        self.eat("}")

    def variables(self) -> None:
        flavour = self.tok.text
        self.next()
        while self.tok is not None:
            at = self.tok.at
            name = self.pattern()
            kind = self.annotation()
            n = self.open("Variable", name, f"{flavour} {kind}".strip(), at)
            if self.eat("=") or self.eat("of") or self.eat("in"):
                self.expression(comma=False)
            self.close(n)
            if not self.eat(","):
                break
        self.eat(";")

    def pattern(self) -> str:
        """A name, or a destructuring pattern as text."""
        if self.at("{", "["):
            start = self.tok.at
            self.skip_pair()
            return self.s[start : self.prev.end]
        name = self.tok.text if self.tok is not None and self.tok.kind == "name" else ""
        if name:
            self.next()
        return name

    def annotation(self) -> str:
        self.eat("!")
        if self.at("?"):
            self.next()
        if not self.eat(":"):
            return ""
        start = self.tok.at if self.tok else len(self.s)
        self.skip_type()
        return self.s[start : self.prev.end].strip() if self.prev and self.prev.end > start else ""

    def skip_pair(self) -> None:
        """Past a bracketed group."""
        depth = 0
        while self.tok is not None:
            if self.at("(", "[", "{"):
                depth += 1
            elif self.at(")", "]", "}"):
                depth -= 1
            elif self.tok.kind == "template":
                self.template(record=False)
                continue
            self.next()
            if depth <= 0:
                return

    def skip_type(self) -> None:
        """Past a type: unions, generics, objects, functions, arrays."""
        need = True
        while self.tok is not None:
            t = self.tok
            if self.at("{", "(", "["):
                if not need and (self.at("{") or t.newline):
                    return
                group = self.at("(")
                self.skip_pair()
                need = False
                if group and self.at("=>"):
                    self.next()
                    need = True
            elif self.at("<"):
                self.skip_angles()
                need = False
            elif self.at("|", "&", ".", "?", ":") and (not self.at("?", ":") or self.in_conditional):
                self.next()
                need = True
            elif self.at("=>"):
                return  # an arrow of a type follows a group, see above; this one starts a body
            elif t.kind in ("name", "string", "number"):
                if not need and t.text not in ("extends", "is", "keyof", "in", "infer", "asserts"):
                    return
                need = t.text in ("keyof", "typeof", "readonly", "extends", "is", "infer", "unique", "asserts", "in")
                if t.text == "extends":
                    self.in_conditional = True
                self.next()
            elif t.kind == "template":
                self.template(record=False)
                need = False
            elif self.at("-", "+") and need:
                self.next()
            else:
                return

    in_conditional = False

    def skip_angles(self) -> bool:
        """Past <...> of types; false (and nothing skipped) if it isn't one."""
        mark, depth = self.mark(), 0
        while self.tok is not None:
            if self.at("<"):
                depth += 1
            elif self.at(">"):
                depth -= 1
                if depth == 0:
                    self.next()
                    return True
            elif self.at("(", "[", "{"):
                self.skip_pair()
                continue
            elif self.tok.kind in ("name", "string", "number") or self.at(",", ".", "|", "&", "=>", "=", "?", ":", "]", "..."):
                pass
            else:
                break
            self.next()
        self.back(mark)
        return False

    def import_(self) -> None:
        start = self.tok.at
        mark = self.mark()
        self.next()
        if self.at("(", "."):
            self.back(mark)
            return self.expression_statement()
        names, bound, typed, inside, renamed = [], [], False, False, False
        while self.tok is not None and self.tok.kind != "string" and not self.at(";"):
            if self.at("{", "}"):
                inside = self.at("{")
            elif self.at("*"):
                bound.append(["*", "*"])
            elif self.at("as"):
                renamed = True
            elif self.at("type") and not names and not inside:
                typed = True
            elif self.tok.kind == "name" and not self.at("from", "type"):
                names.append(self.tok.text)
                if renamed and bound:
                    bound[-1][1] = self.tok.text
                else:
                    bound.append([self.tok.text if inside else "default", self.tok.text])
                renamed = False
            self.next()
        if self.tok is not None and self.tok.kind == "string":
            n = self.open("Import", self.tok.text.strip("'\""), ",".join(names), start)
            if typed:
                self.leaf("TypeOnly", at=start)
            for imported, local in bound:
                self.leaf("ImportName", local, imported, start)
            self.close(n)
            self.next()
        self.eat(";")
        return None

    def export(self) -> None:
        n = self.open("Export")
        self.next()
        is_default = self.eat("default")
        self.rows[n][8] = "default" if is_default else None
        if self.at("{", "*"):
            names = []
            while self.tok is not None and not self.at(";") and self.tok.kind != "string":
                if self.tok.kind == "name" and not self.at("as", "from", "type"):
                    names.append(self.tok.text)
                closing = self.at("}")
                self.next()
                if closing and not self.at("from"):
                    break
            self.rows[n][9] = ",".join(names)
            if self.tok is not None and self.tok.kind == "string":
                self.leaf("Import", self.tok.text.strip("'\""), "", self.tok.at)
                self.next()
            self.eat(";")
        elif self.tok is not None:
            if is_default:
                self.expression_statement()
            else:
                self.statement()
        self.close(n)

    def declared(self) -> bool:
        """interface, type, enum, namespace: true if it was one."""
        word, mark = self.tok.text, self.mark()
        start = self.tok.at
        self.next()
        if word in ("declare", "abstract"):
            if self.tok is not None and self.tok.kind == "name" and not self.tok.newline:
                self.statement()
                return True
            self.back(mark)
            return False
        if self.tok is None or self.tok.kind not in ("name", "string") or self.tok.newline:
            self.back(mark)
            return False
        name = self.tok.text
        self.next()
        kind = {"interface": "Interface", "enum": "Enum", "type": "TypeAlias"}.get(word, "Namespace")
        if self.at("<"):
            self.skip_angles()
        if kind == "TypeAlias":
            if not self.at("="):
                self.back(mark)
                return False
            n = self.open(kind, name, at=start)
            self.next()
            self.eat("|")
            begin = self.tok.at if self.tok else start
            if self.at("{"):
                self.members()
            self.in_conditional = False
            self.skip_type()
            self.in_conditional = False
            self.rows[n][9] = self.s[begin : self.prev.end]
            self.eat(";")
            self.close(n)
            return True
        n = self.open(kind, name, at=start)
        if self.eat("extends"):
            begin = self.tok.at if self.tok else start
            while self.tok is not None and not self.at("{"):
                self.next()
            self.rows[n][9] = self.s[begin : self.prev.end]
        if self.at("{"):
            if kind == "Namespace":
                self.next()
                self.block()
            elif kind == "Enum":
                self.next()
                while self.tok is not None and not self.at("}"):
                    if self.tok.kind in ("name", "string"):
                        self.leaf("EnumMember", self.tok.text.strip("'\""))
                    self.next()
                    if self.eat("="):
                        self.expression(comma=False)
                    self.eat(",")
                self.eat("}")
            else:
                self.members()
        self.close(n)
        return True

    def members(self) -> None:
        """The members of an interface or an object type."""
        self.eat("{")
        while self.tok is not None and not self.at("}"):
            t = self.tok
            if t.kind in ("name", "string", "number"):
                while self.at("readonly") and (m := self.mark()):
                    self.next()
                    if self.at(":", "?", "("):
                        self.back(m)
                        break
                name, at = (self.tok.text.strip("'\"") if self.tok else ""), (self.tok.at if self.tok else 0)
                self.next()
                optional = self.eat("?")
                if self.at("<"):
                    self.skip_angles()
                kind = "Method" if self.at("(") else "Property"
                if kind == "Method":
                    self.skip_pair()
                self.leaf(kind, name, ("?" if optional else "") + self.annotation(), at)
            elif self.at("["):
                self.skip_pair()
                self.eat("?")
                self.annotation()
            elif self.at("("):
                self.skip_pair()
                self.annotation()
            else:
                self.next()
            self.eat(";")
            self.eat(",")
        self.eat("}")

    # Functions and classes --------------------------------------------------
    def parameters(self) -> None:
        self.eat("(")
        while self.tok is not None and not self.at(")"):
            before = self.tok
            while self.at("@"):
                self.next()
                self.next()
                self.parens()
            rest = self.eat("...")
            while self.tok is not None and self.tok.text in _MODIFIERS and self.tok.kind == "name":
                m = self.mark()
                self.next()
                if self.at(",", ")", ":", "=", "?"):
                    self.back(m)
                    break
            at = self.tok.at if self.tok else 0
            name = self.pattern()
            optional = self.at("?")
            kind = self.annotation()
            n = self.open("Parameter", ("..." if rest else "") + name, kind, at)
            if self.eat("="):
                self.expression(comma=False)
            self.close(n)
            if optional and not kind:
                self.rows[n][9] = "?"
            self.eat(",")
            if self.tok is before:
                self.next()
        self.eat(")")

    def function(self, name: str | None, flavour: str, at: int) -> None:
        """From the parameters on; flavour tells async, arrow, method and so on."""
        n = self.open("Function", name or self.holder(), flavour, at)
        if self.at("<"):
            self.skip_angles()
        if self.at("("):
            self.parameters()
        elif self.tok is not None and self.tok.kind == "name":
            self.leaf("Parameter", self.tok.text, "")
            self.next()
        if self.at(":"):
            start = self.tok.at
            kind = self.annotation()
            if kind:
                self.leaf("ReturnType", kind, at=start)
        if self.eat("=>"):
            if self.at("{"):
                self.next()
                self.block()
            else:
                r = self.open("Return")
                self.expression(comma=False)
                self.close(r)
        elif self.at("{"):
            self.next()
            self.block()
        self.close(n)

    def holder(self) -> str | None:
        """The name of the variable, property or attribute whose value starts here."""
        for i in reversed(self.stack[-2:]):
            kind = self.rows[i][7]
            if kind in ("Variable", "Property", "JsxAttribute"):
                return self.rows[i][8]
            if kind != "JsxExpression":
                return None
        return None

    def is_arrow(self) -> bool:
        """Whether a group in parentheses here is followed by an arrow."""
        mark = self.mark()
        if self.at("<"):
            if not self.skip_angles():
                return False
        self.skip_pair()
        if self.at(":"):
            self.next()
            self.skip_type()
        out = self.at("=>")
        self.back(mark)
        return out

    def class_(self) -> None:
        at = self.tok.at
        self.next()
        name = None
        if self.tok is not None and self.tok.kind == "name" and not self.at("extends", "implements"):
            name = self.tok.text
            self.next()
        n = self.open("Class", name, at=at)
        if self.at("<"):
            self.skip_angles()
        start = self.tok.at if self.tok else at
        while self.tok is not None and not self.at("{"):
            self.next()
        self.rows[n][9] = self.s[start : self.prev.end] if self.prev.end > start else ""
        self.eat("{")
        while self.tok is not None and not self.at("}"):
            before = self.tok
            self.member()
            if self.tok is before:
                self.next()
        self.eat("}")
        self.close(n)

    def member(self) -> None:
        """A member of a class or an object with the shape of a method or a field."""
        while self.at("@"):
            self.next()
            self.next()
            self.parens()
        flavour, at = "", self.tok.at if self.tok else 0
        while self.tok is not None and self.tok.kind == "name" and self.tok.text in _MODIFIERS:
            m, word = self.mark(), self.tok.text
            self.next()
            if self.at("(", "=", ":", ";", "?", "}", ",", "<"):
                self.back(m)
                break
            flavour += word + " "
        star = self.eat("*")
        if self.at(";"):
            self.next()
            return
        name = ""
        if self.at("["):
            self.next()
            self.values("]")
            name = "[]"
        elif self.tok is not None and self.tok.kind in ("name", "string", "number"):
            name = self.tok.text.strip("'\"")
            self.next()
        if self.at("?", "!"):
            self.next()
        if self.at("(", "<"):
            self.function(name, (flavour + ("generator " if star else "") + "method").strip(), at)
        else:
            kind = self.annotation()
            n = self.open("Property", name, kind, at)
            if self.eat("="):
                self.expression(comma=False)
            self.close(n)
        self.eat(";")

    # Expressions ------------------------------------------------------------
    def expression_statement(self) -> None:
        self.expression()
        self.eat(";")

    def values(self, end: str) -> None:
        """Comma-separated values up to a closing bracket."""
        while self.tok is not None and not self.at(end):
            before = self.tok
            if self.at("const", "let", "var"):
                self.variables()
            else:
                self.expression(comma=False)
            if not (self.eat(",") or self.eat(";")) and self.tok is before:
                self.next()
        self.eat(end)

    def expression(self, comma: bool = True, stop: tuple[str, ...] = ()) -> None:
        """Operands and operators up to a closing bracket, a semicolon or a line that starts something new."""
        operand = False
        while self.tok is not None:
            t = self.tok
            if self.at(*stop) or self.at(";", ")", "]", "}") or (self.at(",") and not comma):
                return
            if operand and t.newline and (t.kind in ("name", "string", "number", "template") or self.at("{", "@", "!", "~")) and t.text not in ("instanceof", "in", "as", "of", "satisfies"):
                return
            if operand and t.kind == "name" and t.text in _STATEMENTS and t.text not in ("type",):
                return
            if t.kind == "op":
                if t.text == "?":
                    n = self.open("Conditional")
                    self.next()
                    self.expression(comma=False, stop=(":", *stop))
                    self.eat(":")
                    self.expression(comma=False, stop=stop)
                    self.close(n)
                    operand = True
                    continue
                if t.text in ("&&", "||"):
                    self.leaf("Logical", t.text)
                elif t.text == "??":
                    self.leaf("Nullish", t.text)
                elif t.text == "?.":
                    self.leaf("OptionalChain", t.text)
                elif t.text in _BINARY and not (t.text == "<" and not operand):
                    self.leaf("Operator", t.text)
                elif t.text in ("!", "~", "++", "--"):
                    self.leaf("Unary", t.text)
                if t.text == "(":
                    if not operand and self.is_arrow():
                        self.function(None, "arrow", t.at)
                    else:
                        self.next()
                        self.values(")")
                    operand = True
                    continue
                if t.text == "[":
                    n = self.open("Array" if not operand else "Index")
                    self.next()
                    self.values("]")
                    self.close(n)
                    operand = True
                    continue
                if t.text == "{":
                    if operand:
                        return
                    self.object()
                    operand = True
                    continue
                if t.text == "<" and not operand:
                    if self.jsx_may_start():
                        self.jsx()
                        operand = True
                        continue
                    if self.is_arrow():
                        self.function(None, "arrow", t.at)
                        operand = True
                        continue
                    if self.skip_angles():
                        continue
                operand = t.text in ("++", "--") and operand
                if t.text in (".", "?."):
                    operand = False
                self.next()
                continue
            if t.kind == "name":
                if self.word(operand):
                    operand = True
                else:
                    operand = False
                continue
            if t.kind == "template":
                self.template()
            else:
                self.leaf({"number": "Number", "string": "String", "regex": "Regex"}[t.kind], text=t.text)
                self.next()
            operand = True

    def word(self, operand: bool) -> bool:
        """A name in an expression; true if a value stands now."""
        t = self.tok
        if operand and t.text in ("as", "satisfies"):
            self.next()
            self.eat("const") or self.skip_type()
            return True
        if t.text == "function" or (t.text == "async" and self.lookahead() == "function"):
            flavour = "function"
            if t.text == "async":
                flavour = "async function"
                self.next()
            self.next()
            if self.eat("*"):
                flavour += " generator"
            name = self.tok.text if self.tok is not None and self.tok.kind == "name" else None
            if name:
                self.next()
            self.function(name, flavour, t.at)
            return True
        if t.text == "class":
            self.class_()
            return True
        if t.text == "async" and self.lookahead() in ("(", "<") or (t.text == "async" and self.lookahead_name_arrow()):
            mark = self.mark()
            self.next()
            if self.tok is not None and (self.tok.kind == "name" or self.is_arrow()):
                self.function(None, "async arrow", t.at)
                return True
            self.back(mark)
        if t.text == "await":
            self.leaf("Await")
            self.next()
            return False
        if t.text in ("in", "instanceof"):
            self.leaf("Operator", t.text)
            self.next()
            return False
        if t.text in ("typeof", "delete", "void"):
            self.leaf("Unary", t.text)
            self.next()
            return False
        if t.text in ("yield", "of", "case"):
            self.next()
            return False
        if self.lookahead() == "=>":
            self.function(None, "arrow", t.at)
            return True
        if t.text == "new":
            self.next()
            start = self.tok.at if self.tok else t.at
            self.chain()
            n = self.open("New", self.s[start : self.prev.end], at=t.at)
            if self.at("<"):
                self.skip_angles()
            self.parens()
            self.close(n)
            return True
        start = t.at
        # What follows a dot belongs to the chain that stands before it.
        if self.prev is not None and self.prev.kind == "op" and self.prev.text in (".", "?."):
            start = t.at
        self.chain()
        name = self.s[start : self.prev.end]
        if self.at("<"):
            mark = self.mark()
            if not (self.skip_angles() and self.at("(")):
                self.back(mark)
        if self.at("("):
            n = self.open("Call", re.sub(r"\s+|\?(?=\.)", "", name), at=start)
            self.next()
            self.values(")")
            self.close(n)
        elif self.tok is not None and self.tok.kind == "template" and not self.tok.newline:
            n = self.open("Call", name, at=start)
            self.template()
            self.close(n)
        else:
            self.leaf("Identifier", name, at=start)
        return True

    def chain(self) -> None:
        """Past name.name?.name."""
        self.next()
        while self.at(".", "?."):
            mark = self.mark()
            optional = self.at("?.")
            dot = self.tok.at
            self.next()
            if self.tok is None or self.tok.kind != "name":
                self.back(mark)
                return
            if optional:
                self.leaf("OptionalChain", "?.", at=dot)
            self.next()

    def lookahead(self) -> str:
        mark = self.mark()
        self.next()
        out = self.tok.text if self.tok is not None else ""
        self.back(mark)
        return out

    def lookahead_name_arrow(self) -> bool:
        mark = self.mark()
        self.next()
        out = self.tok is not None and self.tok.kind == "name"
        if out:
            self.next()
            out = self.at("=>")
        self.back(mark)
        return out

    def object(self) -> None:
        n = self.open("Object")
        self.next()
        while self.tok is not None and not self.at("}"):
            before = self.tok
            if self.eat("..."):
                self.expression(comma=False)
            else:
                self.property()
            self.eat(",")
            if self.tok is before:
                self.next()
        self.eat("}")
        self.close(n)

    def property(self) -> None:
        t = self.tok
        follow = self.lookahead()
        if t.kind in ("name", "string", "number") and follow == ":":
            n = self.open("Property", t.text.strip("'\""), at=t.at)
            self.next()
            self.next()
            self.expression(comma=False)
            return self.close(n)
        if t.kind == "name" and follow in (",", "}", "="):
            n = self.open("Property", t.text, "shorthand", t.at)
            self.next()
            if self.eat("="):
                self.expression(comma=False)
            return self.close(n)
        if self.at("["):
            n = self.open("Property", "[]")
            self.next()
            self.values("]")
            if self.at("("):
                self.function("[]", "method", t.at)
            elif self.eat(":"):
                self.expression(comma=False)
            return self.close(n)
        return self.member()

    def template(self, record: bool = True) -> None:
        """A template literal; its expressions are parsed by a parser of their own and keep their places."""
        start = self.tok.at
        i, n = start + 1, None
        if record:
            n = self.open("Template", at=start)
        while i < len(self.s) and self.s[i] != "`":
            if self.s[i] == "\\":
                i += 2
            elif self.s.startswith("${", i):
                self.pos, self.tok = i + 2, None
                self.next()
                if record:
                    self.expression()
                else:
                    depth = 0
                    while self.tok is not None and not (depth == 0 and self.at("}")):
                        depth += self.at("{") - self.at("}")
                        if self.tok.kind == "template":
                            self.template(record=False)
                        else:
                            self.next()
                i = self.tok.end if self.tok is not None else len(self.s)
            else:
                i += 1
        if n is not None:
            self.rows[n][9] = self.s[start : i + 1]
            self.close(n)
        self.prev = _Tok("string", "`", start, min(i + 1, len(self.s)), False)
        self.pos, self.tok = min(i + 1, len(self.s)), None
        prev = self.prev
        self.next()
        self.prev = prev

    # JSX --------------------------------------------------------------------
    def jsx_may_start(self) -> bool:
        return re.match(r"<(?:>|[A-Za-z_][\w.:-]*(?:\s*/?>|\s+[A-Za-z_{/]))", self.s[self.tok.at : self.tok.at + 200]) is not None and re.match(r"<[A-Za-z_]\w*\s+extends\s", self.s[self.tok.at : self.tok.at + 80]) is None

    def jsx(self) -> None:
        """An element, with the scanner working on characters from here to its end."""
        end = self.jsx_element(self.tok.at)
        self.prev = _Tok("op", ")", max(end - 1, 0), end, False)
        prev = self.prev
        self.pos, self.tok = end, None
        self.next()
        self.prev = prev

    def embedded(self, at: int) -> int:
        """An expression in braces that opens at ``at``; the place behind it."""
        n = self.open("JsxExpression", at=at)
        self.pos, self.tok, self.prev = at + 1, None, _Tok("op", "{", at, at + 1, False)
        self.next()
        self.eat("...")
        self.expression()
        while self.tok is not None and not self.at("}"):
            self.next()
        end = self.tok.end if self.tok is not None else len(self.s)
        self.close(n)
        return end

    def jsx_element(self, at: int) -> int:
        s = self.s
        m = re.compile(r"<\s*([A-Za-z_][\w.:-]*)?").match(s, at)
        n = self.open("JsxElement", m[1] or "", at=at)
        i = m.end()
        while i < len(s):
            i = re.compile(r"\s*").match(s, i).end()
            if s.startswith("/>", i):
                self.close(n)
                return i + 2
            if s.startswith(">", i):
                i += 1
                break
            if s.startswith("{", i):
                i = self.embedded(i)
                continue
            a = re.compile(r"[A-Za-z_$@:][\w$.:@-]*").match(s, i)
            if a is None:
                i += 1
                continue
            v = re.compile(r"\s*=\s*").match(s, a.end())
            if v is None:
                self.leaf("JsxAttribute", a[0], "true", i)
                i = a.end()
            elif s[v.end() : v.end() + 1] in ('"', "'"):
                q = s.find(s[v.end()], v.end() + 1)
                q = len(s) if q < 0 else q
                self.leaf("JsxAttribute", a[0], s[v.end() + 1 : q], i)
                i = q + 1
            else:
                p = self.open("JsxAttribute", a[0], at=i)
                i = self.embedded(v.end()) if s.startswith("{", v.end()) else v.end() + 1
                self.rows[p][9] = s[v.end() : i]
                self.close(p)
        while i < len(s):
            stop = re.compile(r"[<{]").search(s, i)
            j = stop.start() if stop else len(s)
            if s[i:j].strip():
                self.leaf("JsxText", text=" ".join(s[i:j].split()), at=i)
            i = j
            if s.startswith("</", i):
                e = s.find(">", i)
                self.close(n)
                return len(s) if e < 0 else e + 1
            if s.startswith("{", i):
                i = self.embedded(i)
            elif s.startswith("<", i):
                i = self.jsx_element(i) if re.compile(r"<\s*[A-Za-z_>]").match(s, i) else i + 1
        self.close(n)
        return i


def parse(path: str, source: str | None) -> list[list]:
    """The node rows of one file; a file that breaks the parser keeps what was parsed and ends with a ParseError node."""
    p = Parser(path, source or "")
    try:
        return p.parse()
    except (RecursionError, AttributeError, IndexError) as e:
        p.close(0)
        p.rows.append([path, len(p.rows), 0, len(p.rows), 1, 0, 0, "ParseError", type(e).__name__, None, 1, 1])
        return p.rows


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                out = pd.DataFrame(parse(path, content), columns=columns)
                out["parent_id"] = out["parent_id"].astype("Int32")
                yield out

    return files.select("path", "content").mapInPandas(run, SCHEMA)

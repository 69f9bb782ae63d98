"""Token classes and productions of the languages whose syntax is checked.

A token is one character, its class. A bracket group is seen from outside as its opening and
closing character side by side, ``()``, so the inside of every kind of group, and of a whole
file, is a regular language over classes: a production. From the productions follow the pairs
of classes that may stand next to each other.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

#: Opening and closing marks: brackets, Python's indented blocks, and the shell's if, do and case.
CLOSES = {"(": ")", "[": "]", "{": "}", "\u2192": "\u2190", "\u00ab": "\u00bb", "\u2039": "\u203a", "\u27e6": "\u27e7"}
OPENS = {c: o for o, c in CLOSES.items()}
BAD = "\u00a4"  # text that is no token: an open string, a stray character
START, END = "^", "$"


@dataclass
class Language:
    """How to lex a language and what may stand inside each kind of group (``""`` is the whole file).

    ``names`` are productions that stand for themselves: a symbol and its rule. Where ``pieces``
    splits a content (into lines), each piece is replaced by the symbol of the first rule it fits,
    and the rule of the group is about these symbols; otherwise the parts of a content that fit a
    named rule are replaced by its symbol before the rule of the group is tried.
    """

    lex: Callable[[str], Iterator[str]]
    inside: dict[str, str]
    names: dict[str, str] = field(default_factory=dict)
    pieces: str = ""
    by_piece: frozenset[str] = frozenset()
    compiled: dict[str, re.Pattern[str]] = field(default_factory=dict)
    symbols: dict[str, str] = field(default_factory=dict)
    allowed: set[str] = field(default_factory=set)

    def _pattern(self, rule: str) -> re.Pattern[str]:
        if rule not in self.compiled:
            self.compiled[rule] = re.compile(rule)
        return self.compiled[rule]

    def _symbol(self, piece: str) -> str:
        got = self.symbols.get(piece)
        if got is None:
            got = next((n for n, rule in self.names.items() if self._pattern(rule).fullmatch(piece)), BAD)
            if len(piece) <= 80 and len(self.symbols) < 200_000:
                self.symbols[piece] = got
        return got

    def fits(self, kind: str, content: str) -> bool:
        """Whether the content of a group (or of a file) is as a production has it."""
        if kind in self.by_piece:
            parts = self._pattern(self.pieces).findall(content)
            if sum(map(len, parts)) != len(content):
                return False
            content = "".join(map(self._symbol, parts))
        else:
            for name, rule in self.names.items():
                content = self._pattern(rule).sub(name, content)
        return self._pattern(self.inside[kind]).fullmatch(content) is not None

    def pairs(self) -> set[str]:
        """All pairs of neighbouring classes that the productions allow, with START and END for the ends of a file."""
        if self.allowed:
            return self.allowed
        named = {n: _positions(sre.parse(rule), {}) for n, rule in self.names.items()}
        out: set[str] = set()
        ends = {kind: _positions(sre.parse(rule), named if kind in self.by_piece or not self.pieces else {}) for kind, rule in self.inside.items()}
        for _, _, _, follow in ends.values():
            out |= {p for p in follow if p[0] not in CLOSES}
        for kind, (empty, first, last, _) in ends.items():
            left, right = (kind, CLOSES[kind]) if kind else (START, END)
            out |= {left + c for c in first} | {c + right for c in last}
            if empty:
                out.add(left + right)
        self.allowed |= out
        return out


_ALL = frozenset(chr(o) for o in range(33, 127)) | frozenset(CLOSES) | frozenset(OPENS)


def _positions(parsed, named: dict) -> tuple[bool, set[str], set[str], set[str]]:
    """Glushkov's sets of a parsed rule: whether it is empty, first and last classes, neighbouring pairs."""
    empty, first, last, pairs = True, set(), set(), set()
    for op, arg in parsed:
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            e, f, la, p = named.get(chr(arg)) or (False, {chr(arg)}, {chr(arg)}, set())
        elif name == "NOT_LITERAL":
            e, f, p = False, set(_ALL) - {chr(arg)}, set()
            la = f
        elif name == "IN":
            chars, negated = set(), False
            for kind, x in arg:
                if str(kind) == "NEGATE":
                    negated = True
                elif str(kind) == "LITERAL":
                    chars.add(chr(x))
                elif str(kind) == "RANGE":
                    chars |= {chr(o) for o in range(x[0], x[1] + 1)}
            f = set(_ALL) - chars if negated else chars
            e, la, p = False, f, set()
        elif name == "BRANCH":
            parts = [_positions(b, named) for b in arg[1]]
            e = any(x[0] for x in parts)
            f, la, p = (set().union(*(x[i] for x in parts)) for i in (1, 2, 3))
        elif name == "SUBPATTERN":
            e, f, la, p = _positions(arg[3], named)
        elif name == "ATOMIC_GROUP":
            e, f, la, p = _positions(arg, named)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            e, f, la, p = _positions(body, named)
            if high > 1:
                p = p | {a + b for a in la for b in f}
            e = e or low == 0
        else:
            raise ValueError(name)
        pairs |= p | {a + b for a in last for b in f}
        if empty:
            first |= f
        last = last | la if e else set(la)
        empty = empty and e
    return empty, first, last, pairs


def _master(parts: list[tuple[str, str]]) -> tuple[re.Pattern[str], list[str]]:
    """One pattern of all kinds of tokens (no part has groups of its own), and the name of each."""
    return re.compile("|".join(f"({p})" for _, p in parts), re.S), ["", *(name for name, _ in parts)]


def _operators(table: dict[str, str]) -> tuple[str, dict[str, str]]:
    """A pattern of operators, longest first, and the class of each."""
    classes = {op: code for code, ops in table.items() for op in ops.split()}
    return "|".join(re.escape(op) for op in sorted(classes, key=lambda o: (-len(o), o))), classes


def _keywords(table: dict[str, str]) -> dict[str, str]:
    return {word: code for code, words in table.items() for word in words.split()}


def _simple_lexer(parts: list[tuple[str, str]], operators: dict[str, str], keywords: dict[str, str]) -> Callable[[str], Iterator[tuple[str, str]]]:
    """Pairs of kind and class; kinds ``name`` and ``op`` are looked up, ``skip`` and ``line`` have no class."""
    pattern, classes = _operators(operators)
    words = _keywords(keywords)
    master, names = _master([*parts, ("op", pattern), ("bad", ".")])

    def lex(text: str) -> Iterator[tuple[str, str]]:
        for m in master.finditer(text):
            kind = names[m.lastindex]
            if kind == "name":
                yield kind, words.get(m.group(), "i")
            elif kind == "op":
                yield kind, classes[m.group()]
            elif kind == "bad":
                yield kind, BAD
            elif kind not in ("skip", "line"):
                yield kind, kind
            elif kind == "line":
                yield kind, ""

    return lex


_NAME = r"[^\W\d]\w*"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.eE])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"


def _plain(lex: Callable[[str], Iterator[tuple[str, str]]]) -> Callable[[str], Iterator[str]]:
    def run(text: str) -> Iterator[str]:
        for _, code in lex(text):
            if code:
                yield code

    return run


# ---------------------------------------------------------------------------- Python

_PY_STRING = r"""(?i:\b(?:[rbuf]|rb|br|fr|rf))?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')"""
_PY_BRACE = re.compile(r"\{\{|\}\}|\{|\}")
_PY_FIELD = re.compile(r"\{\s*(?:[^\W\d]|[\d\"'(\[{+\-~*.\\])|\{\{|\}\}")


def _bad_fields(literal: str) -> bool:
    """Whether a formatted literal has a replacement field that is open, closed twice or empty."""
    prefix = re.match(r"(?i)[a-z]*", literal).group().lower()
    if "f" not in prefix:
        return False
    depth = 0
    for m in _PY_BRACE.finditer(literal):
        if m.group() == "{{" and depth == 0 or m.group() == "}}" and depth == 0:
            continue
        for c in m.group():
            depth += 1 if c == "{" else -1
            if depth < 0:
                return True
        if m.group() == "{" and not _PY_FIELD.match(literal, m.start()):
            return True
    return depth != 0


_PY_F = re.compile(r"(?i)\b(?:f|fr|rf)(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')", re.S)
_PY_LEAD = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*([ \t\f]*)")


def _lex_python(text: str) -> Iterator[str]:
    """Classes with ``#`` for the end of a logical line and the marks of indented blocks."""
    text = text.removeprefix("\ufeff")
    if not text.endswith("\n"):
        text += "\n"
    if any(_bad_fields(m.group()) for m in _PY_F.finditer(text)):
        yield BAD
    starts: dict[int, int] = {}
    depth, columns, fresh, at = 0, [0], True, 0
    pattern = _PY_MASTER
    while at < len(text):
        if fresh and depth <= 0:
            lead = _PY_LEAD.match(text, at)
            at = lead.end()
            rest = text[at : at + 1]
            if rest in ("", "#", "\n", "\r"):
                if rest == "#":
                    end = text.find("\n", at)
                    at = len(text) if end < 0 else end + 1
                    continue
                if not rest:
                    break
            width = len(lead.group(1).expandtabs(8))
            if width > columns[-1]:
                columns.append(width)
                yield "\u2192"
            while width < columns[-1]:
                columns.pop()
                yield "\u2190"
            if width != columns[-1]:
                yield BAD
            fresh = False
        m = pattern.match(text, at)
        at = m.end()
        kind = _PY_NAMES[m.lastindex]
        if kind == "skip":
            continue
        if kind == "line":
            if depth <= 0:
                yield "#"
                fresh = True
            continue
        code = _PY_WORDS.get(m.group(), "i") if kind == "name" else _PY_OPS[m.group()] if kind == "op" else BAD if kind == "bad" else kind
        if code in "([{":
            depth += 1
        elif code in ")]}":
            depth -= 1
        yield code
    for _ in columns[1:]:
        yield "\u2190"


_PY_OP_PATTERN, _PY_OPS = _operators({"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "A": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", "o": "/ // % << >> & | ^ == != <= >= < >", "-": "+ -", "~": "~", "*": "* **", "@": "@", "W": ":=", "r": "->", "e": "...", "=": "=", ".": ".", ",": ",", ":": ":", ";": ";"})
_PY_WORDS = _keywords({"o": "and or", "N": "not", "I": "in", "q": "is", "f": "if", "l": "else", "F": "elif", "O": "for", "w": "while", "D": "def", "K": "class", "R": "return", "Y": "yield", "L": "lambda", "T": "try", "X": "except", "Z": "finally", "H": "with", "a": "as", "m": "import", "M": "from", "g": "global nonlocal", "p": "pass break continue", "z": "raise", "x": "assert", "d": "del", "y": "async", "u": "await", "c": "None True False"})
_PY_MASTER, _PY_NAMES = _master([("skip", r"[ \t\f]+|\\\r?\n|#[^\n]*"), ("line", r"\r?\n"), ("s", _PY_STRING), ("n", _NUMBER + r"[jJ]?(?!\w)"), ("name", _NAME), ("op", _PY_OP_PATTERN), ("bad", ".")])


def _python_rules() -> tuple[dict[str, str], dict[str, str]]:
    group = r"\(\)|\[\]|\{\}"
    atom = rf"(?:[inec]|s+|{group})(?:\(\)|\[\]|\.i)*"
    operand = rf"N*[-~u]*{atom}"
    binary = r"(?:[o*@-]|qN?|N?I)"
    flat = rf"{operand}(?:{binary}{operand})*"
    no_in = rf"{operand}(?:[o*@-]{operand})*"
    lam = r"(?:L(?:[i,=*o]|[nsce]|\(\)|\[\]|\{\}|\.i|-)*:)*"
    test = rf"(?:iW)?{lam}{flat}(?:f{flat}l{lam}{flat})*"
    star = rf"\*?{test}"
    many = rf"{star}(?:,{star})*,?"
    target = rf"\*?{atom}(?:,\*?{atom})*,?"
    comp = rf"(?:y?O{target}I{flat}(?:f{lam}{flat})*)+"
    value = rf"(?:Y(?:M{test}|(?:{many})?)|{many})"
    arg = rf"(?:\*?{test}(?:{comp})?|i=(?:{test})|i:{star}(?:=(?:{test}))?|\*i:{star}|\*|o|{test}a{atom})"
    dotted = r"i(?:\.i)*"
    name = r"i(?:ai)?"
    simple = rf"(?:p|R(?:{many})?|z(?:{test}(?:M{test})?)?|x{test}(?:,{test})?|d{many}|gi(?:,i)*|m{dotted}(?:ai)?(?:,{dotted}(?:ai)?)*|M[.e]*(?:{dotted})?m(?:\*|{name}(?:,{name})*|\(\))|{atom}:{test}(?:={value})?|{atom}A{value}|ii(?:\[\])?={test}|{value}(?:={value})*)"
    line = rf"{simple}(?:;{simple})*;?#"
    heads = {
        "fg": rf"f{test}:",
        "FG": rf"F{test}:",
        "lm": r"l:",
        "OP": rf"(?:w{test}|y?O{target}I{many}):",
        "TU": r"T:",
        "XY": rf"X\*?(?:{many}(?:ai)?)?:",
        "ZW": r"Z:",
        "DE": rf"(?:y?Di(?:\[\])?\(\)(?:r{star})?|Ki(?:\[\])?(?:\(\))?):",
        "HI": rf"(?:y?H{test}(?:a{atom})?(?:,{test}(?:a{atom})?)*|i{many}(?:a{atom})?(?:f{test})?):",
    }
    # of a header two symbols: with its block on the lines below, and with a statement behind it
    names = {"b": "\u2192\u2190", "@": rf"@{test}#", "s": line}
    names |= {pair[0]: rf"{head}#" for pair, head in heads.items()}
    names |= {pair[1]: rf"{head}{line}" for pair, head in heads.items()}

    def suite(pair: str) -> str:
        return rf"(?:{pair[0]}b|{pair[1]})"

    block = rf"(?:s|{suite('fg')}{suite('FG')}*{suite('lm')}?|{suite('OP')}{suite('lm')}?|{suite('TU')}(?:{suite('XY')}+{suite('lm')}?{suite('ZW')}?|{suite('ZW')})|@*{suite('DE')}|{suite('HI')})"
    inside = {
        "": rf"{block}*+",
        "\u2192": rf"{block}++",
        "(": rf"(?:{arg}(?:,{arg})*,?|{value})?",
        "[": rf"(?:{star}{comp}|(?:{star}|(?:{test})?(?::(?:{test})?){{1,2}})(?:,(?:{star}|(?:{test})?(?::(?:{test})?){{1,2}}))*,?)?",
        "{": rf"(?:(?:{test}:{test}|{star})(?:{comp}|(?:,(?:{test}:{test}|{star}))*,?))?",
    }
    return inside, names


# ---------------------------------------------------------------------------- Go

_GO = _simple_lexer(
    [("line", r"\r?\n|//[^\n]*\n?"), ("skip", r"[ \t\r]+|/\*.*?\*/"), ("s", r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n])[^'\n]{0,10}'"), ("n", _NUMBER + "i?"), ("name", _NAME)],
    {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "A": "+= -= *= /= %= &= |= ^= <<= >>= &^=", "W": ":=", "=": "=", "o": "/ % == != < <= > >= && || | << >> &^", "-": "+ - ^ * &", "!": "!", "~": "~", "r": "<-", "e": "...", "U": "++ --", ".": ".", ",": ",", ";": ";", ":": ":"},
    {"K": "package", "M": "import", "D": "func", "V": "var const", "T": "type", "Q": "struct", "N": "interface", "m": "map", "h": "chan", "f": "if", "l": "else", "O": "for", "G": "range", "w": "switch select", "c": "case", "d": "default", "R": "return", "b": "break continue goto", "p": "fallthrough", "g": "go defer"},
)


def _lex_go(text: str) -> Iterator[str]:
    last = ""
    for kind, code in _GO(text.removeprefix("\ufeff")):
        if kind == "line":
            if last and last in "ins)]}bpRU":
                yield ";"
                last = ";"
            continue
        yield code
        last = code
    if last and last in "ins)]}bpRU":
        yield ";"


def _go_rules() -> dict[str, str]:
    basic = r"(?:i(?:\.i)?(?:\[\])?|\(\)|Q\{\}|N\{\})"
    kind = rf"(?:-|\[\]|m\[\]|hr?|rh)*(?:{basic}|D\(\)(?:\(\)|(?:-|\[\]|m\[\])*{basic})?)"
    literal = rf"(?:\[\]|m\[\])+(?:-|\[\]|m\[\])*{basic}"
    call = r"\(\)|\[\]|\{\}|\.(?:i|\(\))"
    atom = rf"(?:[ins]|\(\)|{literal}|h{kind}|Q\{{\}}|D\(\)(?:{kind})?\{{\}})(?:{call})*"
    expr = rf"[-!r~]*{atom}(?:[o-][-!r~]*{atom})*"
    exprs = rf"{expr}(?:,{expr})*"
    simple = rf"(?:{exprs}(?:[=WA](?:G{expr}|{exprs}))?|{expr}U|{expr}r{expr}|G{expr})"
    spec = rf"i(?:,i)*(?:{kind})?(?:={exprs})?"
    tspec = rf"i(?:\[\])?=?{kind}"
    decl = rf"(?:V(?:{spec}|\(\))|T(?:{tspec}|\(\)))"
    if_ = rf"f(?:(?:{simple})?;)?{expr}\{{\}}(?:lf(?:(?:{simple})?;)?{expr}\{{\}})*(?:l\{{\}})?"
    for_ = rf"O(?:(?:{simple})?;(?:{expr})?;(?:{simple})?|(?:{exprs}[=W])?G{expr}|{expr})?\{{\}}"
    switch = rf"w(?:(?:{simple})?;)?(?:{simple})?\{{\}}"
    stmt = rf"(?:{simple}|{decl}|R(?:{exprs})?|bi?|p|g{expr}|{if_}|{for_}|{switch}|\{{\}})"
    labelled = rf"(?:i:;?)?(?:{stmt})?"
    case = rf"(?:c(?:{simple}|{kind}(?:,{kind})*)|d):"
    block = rf"(?:(?:{case})*{labelled};)*+(?:{case})*(?:{labelled})?"
    element = rf"(?:(?:{expr}|\{{\}}):)?(?:{expr}|\{{\}})"
    fields = rf"(?:(?:i(?:,i)*{kind}|-?i(?:\.i)?(?:\[\])?|i\(\)(?:{kind})?|~?{kind}(?:o~?{kind})*)s?;)*+"
    item = rf"(?:T|{expr}e?|(?:i(?:,i)*)?e?{kind}|{kind},{expr}|{spec}|{tspec}|[i.]?s)"
    func = rf"D(?:\(\))?i(?:\[\])?\(\)(?:{kind})?(?:\{{\}})?"
    return {
        "": rf"(?:;*Ki;+(?:M(?:[i.]?s|\(\));+)*(?:(?:{func}|{decl});+)*+)?",
        "(": rf"(?:{item}(?:[,;]+{item})*[,;]*)?",
        "[": rf"(?:e|{kind}(?:,{kind})*,?|(?:i(?:,i)*~?{kind}(?:o~?{kind})*)(?:,i(?:,i)*~?{kind}(?:o~?{kind})*)*,?|(?:{expr})?(?::(?:{expr})?)*)?",
        "{": rf"(?:{block}|{element}(?:,{element})*,?|{fields})",
    }


# ---------------------------------------------------------------------------- Rust

_RUST = _simple_lexer(
    [
        ("s", r"b?c?\"(?:[^\"\\]|\\.)*\"|[bc]?r(?=\")\"[^\"]*\"|[bc]?r#\".*?\"#(?!#)|[bc]?r##\".*?\"##|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x[\da-fA-F]{2}|.))'"),
        ("t", r"'[^\W\d]\w*"),
        ("skip", r"\s+|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/)*\*/"),
        ("n", r"(?:0[xob][\da-fA-F_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)"),
        ("name", r"(?:r#)?" + _NAME),
    ],
    {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "A": "+= -= *= /= %= ^= &= |= <<= >>=", "R": "=>", "r": "->", "q": "::", "=": "=", "o": "/ % ^ == != <= >= << && +", "-": "- * &", "!": "!", "?": "?", "<": "<", ">": ">", "|": "|", "d": ".. ..= ...", ".": ".", ",": ",", ";": ";", ":": ":", "#": "#", "$": "$", "@": "@"},
    {"D": "fn", "L": "let", "m": "mut ref", "f": "if", "l": "else", "w": "match", "W": "while", "O": "for", "I": "in", "G": "loop", "B": "return break", "p": "pub", "u": "use", "M": "mod", "K": "struct enum", "N": "impl trait", "T": "type", "c": "const static", "x": "unsafe async extern move dyn", "h": "where", "a": "as"},
)


def _rust_rules() -> tuple[dict[str, str], dict[str, str]]:
    attr = r"(?:#!?\[\])*"
    type_atom = r"(?:[iqtmxND?!\-,:=+o<>dcn]|\(\)|\[\]|r|\{\}(?=[>,]))"
    gen = rf"<{type_atom}*>"
    ty = r"(?:[iqtmxNDrc?!\-+o<>]|\(\)|\[\]|(?<=[i<>,])[,=:](?=[itq<&\-(\[x]))+"
    path = rf"(?:<[iqt\-,a<>()\[\]]*>)?q?i(?:q(?:i|{gen}))*"
    lit = r"(?:-?n|s|i)"
    pat_atom = rf"(?:[-m]*(?:{path}(?:!?\(\)|\{{\}})?|n|s)|-*(?:\(\)|\[\])|d|-*m*i@)"
    pat = rf"\|?{pat_atom}(?:(?:\||d|(?<=@)){pat_atom})*d?"
    closure = r"(?:x*\|(?:[iq:,<>mtdo\-@]|\(\)|\[\]|\{\})*\|(?:r[iq<>()\[\]\-t]+)?|x*\|\|)"
    head = rf"(?:{path}(?:!i?(?:\(\)|\[\]|\{{\}}))?(?:\{{\}})?|[ns]|\(\)|\[\]|x+\{{\}}|(?:t:)?\{{\}}|(?:t:)?G\{{\}})"
    post = rf"(?:\?|\.(?:i(?:q{gen})?|n)|\(\)|\[\]|a[-mxc]*(?:{path}(?:{gen})?|\(\)|\[\]))"
    unary = rf"(?:[-!m]|d|{closure})*"

    def chain(first: str) -> str:
        return rf"{unary}{first}{post}*(?:(?:[o<>|d-]|>>|=(?=X))+{unary}{first}{post}*)*d?"

    e0 = chain(head)
    cond = rf"(?:L{pat}={e0}|{e0})(?:o(?:L{pat}={e0}|{e0}))*"
    blocky = rf"(?:(?:t:)?(?:f{cond}\{{\}}(?:lf{cond}\{{\}})*(?:l\{{\}})?|w{e0}\{{\}}|W{cond}\{{\}}|O{pat}I{e0}\{{\}}))"
    # begun by a keyword and ended by its block, so it can be replaced by one symbol beforehand
    names = {"Z": blocky}
    e1 = rf"(?:(?:Bt?)?{chain(rf'(?:{head}|Z)')}|Bt?|d)"
    assign = rf"{e1}(?:[=A]{e1})?"
    let = rf"L{pat}(?::{ty})?(?:={e1}(?:l\{{\}})?)?;"
    vis = r"(?:p(?:\(\))?)?"
    where = r"(?:h(?:[iqtmxND?!\-,:=+o<>drO]|\(\)|\[\])*)?"
    fn = rf"{vis}(?:[xc]s?)*Di(?:{gen})?\(\)(?:r{ty})?{where}(?:\{{\}}|;)"
    item = rf"{attr}(?:{fn}|{vis}u(?:[iqa*\-,]|\{{\}})+;|{vis}Mi(?:;|\{{\}})|{vis}Ki(?:{gen})?{where}(?:\{{\}}|\(\){where};|;)|{vis}x*N!?(?:{gen})?(?:[iqtmxND?!\-,:=+o<>drhcn]|\(\)|\[\])*\{{\}}|{vis}Ti(?:{gen})?(?::{ty})?{where}(?:={ty})?;|{vis}cm?i:{ty}(?:={e1})?;|{vis}xi?i?;|xs?\{{\}}|{path}!i?(?:\{{\}}|(?:\(\)|\[\]);))"
    stmt = rf"(?:;|{attr}{let}|{item}|{attr}Z;?|{attr}x*\{{\}}|{attr}{assign};)"
    block = rf"(?:{stmt})*+(?:{attr}{assign})?"
    field = rf"{attr}{vis}i:{ty}"
    init = rf"{attr}(?:(?:i|n)(?::{e1})?|d(?:{e1})?|[-m]*i(?::{pat})?)"
    variant = rf"{attr}i(?:\(\)|\{{\}})?(?:={e1})?"
    arm = rf"{attr}{pat}(?:f{cond})?R"
    arms = rf"(?:{arm}(?:\{{\}},?|{assign},))*(?:{arm}{assign})?"
    uses = r"(?:[iqa*\-,]|\{\})*"
    param = rf"{attr}(?:{pat}:{ty}|-*t?m*i(?::{ty})?|d|{assign}|{ty}|{vis}{ty})"
    loose = rf"(?:{param}(?:,{param})*,?)?"
    # the patterns and bodies of macros
    macro = r"(?=[^$]*\$)(?:\$?[iqtns,:;=+\-o<>!?|.dR#AKLDfmxc]|\$?(?:\(\)|\[\]|\{\}))*"
    inside = {
        "": rf"{attr}(?:{item}|;)*+",
        "(": rf"(?:{loose}|[ix]?i?(?:q?i)*|{macro})",
        "[": rf"(?:(?:{assign}(?:,{assign})*,?)|{assign};{assign}|{ty};{assign}|{ty}|i(?:qi)*(?:\(\)|=s|=i!\(\))?|{pat}(?:,{pat})*,?)?",
        "{": rf"(?:{block}|(?:{field}(?:,{field})*,?)?|{init}(?:,{init})*,?|{variant}(?:,{variant})*,?|{arms}|{uses}|(?:{item})*+|(?:(?:\(\)|\[\]|\{{\}})R(?:\(\)|\[\]|\{{\}});?)*|{macro})",
    }
    return inside, names


# ---------------------------------------------------------------------------- C

_C = _simple_lexer(
    [("skip", r"\s+|//[^\n]*|/\*.*?\*/|\\\r?\n|(?m:^[ \t]*)#(?:[^\n\\]|\\\r?\n|\\.)*"), ("s", r"(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"|[uUL]?'(?:[^'\\\n]|\\.)+'"), ("n", _NUMBER + r"[uUlLfF]*"), ("name", _NAME)],
    {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "A": "+= -= *= /= %= &= |= ^= <<= >>=", "=": "=", "o": "/ % == != < <= > >= && || | ^ << >>", "-": "+ - * &", "!": "! ~", "U": "++ --", "e": "...", ".": ". ->", ",": ",", ";": ";", ":": ":", "?": "?"},
    {"t": "int char long short unsigned signed void float double const static extern inline volatile register auto restrict _Bool bool", "k": "struct union enum", "f": "if", "l": "else", "O": "for", "w": "while", "D": "do", "W": "switch", "c": "case", "d": "default", "R": "return", "b": "break continue", "g": "goto", "z": "sizeof", "T": "typedef"},
)


def _c_rules() -> dict[str, str]:
    oper = r"(?:[-!Uz]|\(\)(?=[insz(!]))*(?:[in]|s[si]*|\(\)(?:\{\})?)(?:\(\)|\[\]|\.i|U)*"
    flat = rf"{oper}(?:[o-]{oper})*"
    tern = rf"{flat}(?:\?{flat}:{flat})*"
    expr = rf"{tern}(?:[=A]{tern})*"
    exprs = rf"{expr}(?:,{expr})*"
    spec = r"t*(?:t|i|ki?(?:\{\})?)t*"
    dtor = r"(?:[-t])*(?:i|\(\))(?:\[\]|\(\)|:n)*"
    init = rf"(?:=(?:{expr}|\{{\}}))?"
    decl = rf"T?{spec}(?:{dtor}{init}(?:,{dtor}{init})*)?;"
    prefix = rf"(?:f\(\)|l|w\(\)|O\(\)|D|W\(\)|c{tern}(?:e{tern})?:|d:|i:)*"
    stmt = rf"{prefix}(?:;|\{{\}}|{exprs};|R(?:{exprs})?;|b;|gi;|{decl})"
    func = rf"{spec}[-t]*i\(\)(?:{decl})*\{{\}}"
    param = rf"(?:{spec}(?:{dtor}|[-t]*(?:\[\]|\(\))*)|e)"
    element = rf"(?:(?:\.i|\[\])+=|i:)?(?:{expr}|\{{\}})"
    return {
        "": rf"(?:{func}|{decl}|;|i\(\);?)*+",
        "(": rf"(?:(?:{exprs})?;(?:{exprs})?;(?:{exprs})?|{decl}(?:{exprs})?;(?:{exprs})?|{param}(?:,{param})*|(?:{expr}|{spec}[-t]*)(?:,(?:{expr}|{spec}[-t]*))*|-+i?(?:\[\])*)?",
        "[": rf"(?:{expr}|t+{expr}|-)?",
        "{": rf"(?:(?:{stmt})*+|{element}(?:,{element})*,?|i(?:={tern})?(?:,i(?:={tern})?)*,?)",
    }


# ---------------------------------------------------------------------------- Java

_JAVA = _simple_lexer(
    [("skip", r"\s+|//[^\n]*|/\*.*?\*/"), ("s", r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|\"\"(?!\")|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))'"), ("n", _NUMBER + r"[lLfFdD]?"), ("name", r"[^\W\d][\w$]*|\$[\w$]*")],
    {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "A": "+= -= *= /= %= &= |= ^= <<= >>= >>>=", "=": "=", "o": "/ % * == != <= && || | ^ << & >=", "-": "+ -", "!": "! ~", "U": "++ --", "e": "...", "r": "->", "q": "::", "<": "<", ">": ">", ".": ".", ",": ",", ";": ";", ":": ":", "?": "?", "@": "@"},
    {"t": "int char long short byte float double boolean void", "m": "public private protected static final abstract native transient volatile strictfp synchronized", "K": "class interface enum", "x": "extends implements throws", "N": "new", "I": "instanceof", "f": "if", "l": "else", "O": "for", "w": "while", "D": "do", "W": "switch", "c": "case", "d": "default", "R": "return throw", "b": "break continue", "T": "try", "X": "catch", "Z": "finally", "M": "import package", "a": "assert"},
)


def _java_rules() -> dict[str, str]:
    gen = r"<(?:[it.,?o x<>@]|\[\])*>".replace(" ", "")
    mods = r"(?:m|d(?!:|r)|@i(?:\.i)*(?:\(\))?)*"
    ty = rf"(?:t|i(?:{gen})?(?:\.i(?:{gen})?)*)(?:\[\])*"
    new = rf"N(?:t|i(?:{gen})?(?:\.i(?:{gen})?)*)(?:\(\)(?:\{{\}})?|(?:\[\])+(?:\{{\}})?)"
    oper = rf"(?:[-!U]|\(\)(?=[insNtW(!]))*(?:[in]|s|\(\)|{new}|t(?:\[\])*(?=[.q])|i(?:{gen})?(?:\[\])*(?=q)|W\(\)\{{\}})(?:\.(?:{gen})?(?:i|K|N)|\(\)|\[\]|U|q[iN])*"
    lam = r"(?:(?:i|\(\))r)*"
    value = rf"{lam}(?:{oper})"
    flat = rf"{value}(?:(?:[o<-]|>{{1,3}}){value}|Im?{ty}(?:i|\(\))?)*"
    flat = rf"(?:{flat}|(?:(?:i|\(\))r)+\{{\}})"
    tern = rf"{flat}(?:\?{flat}:{flat})*"
    expr = rf"{tern}(?:[=A]{tern})*"
    exprs = rf"{expr}(?:,{expr})*"
    init = rf"(?:=(?:{expr}|\{{\}}))?"
    var = rf"i(?:\[\])*{init}"
    local = rf"{mods}{ty}{var}(?:,{var})*"
    type_ = rf"{mods}(?:@?Ki|ii)(?:{gen})?(?:\(\))?(?:[xi]{ty}(?:,{ty})*)*\{{\}}"
    case = rf"(?:c(?:{tern}|{ty}i?)(?:,{tern})*(?:ii?{tern})?|d)(?::|r)"
    prefix = rf"(?:f\(\)|l|w\(\)|O\(\)|D|W\(\)(?=\{{)|m\(\)|i:|{case})*"
    try_ = r"T(?:\(\))?\{\}(?:X\(\)\{\})*(?:Z\{\})?"
    stmt = rf"{prefix}(?:;|\{{\}}|{exprs};|R(?:{expr})?;|bi?;|a{expr}(?::{expr})?;|{local};|{try_}|{type_}|i{expr};)"
    method = rf"{mods}(?:{gen})?(?:{ty})?i\(\)(?:\[\])*(?:x{ty}(?:,{ty})*)?(?:d{expr})?(?:\{{\}}|;)"
    member = rf"(?:;|{mods}\{{\}}|{method}|{local};|{type_}|{mods}i\{{\}})"
    constant = rf"(?:@i(?:\.i)*(?:\(\))?)*i(?:\(\))?(?:\{{\}})?"
    param = rf"{mods}{ty}(?:e)?(?:i(?:\[\])*)?"
    named = rf"i=(?:{expr}|\{{\}}|@i(?:\(\))?)"
    return {
        "": rf"(?:{mods}Mm?i(?:\.[io*])*;|;|{type_})*+",
        "(": rf"(?:(?:{local}|{exprs})?;(?:{expr})?;(?:{exprs})?|{local}(?:;{local})*;?|{mods}{ty}i:{expr}|{param}(?:,{param})*|{mods}{ty}(?:o{ty})*i?|{exprs}|{named}(?:,{named})*|\{{\}}|{ty}(?:o{ty})*)?",
        "[": rf"(?:{expr})?",
        "{": rf"(?:(?:{stmt})*+|(?:{member})*+|(?:(?:{expr}|\{{\}}|@i(?:\(\))?)(?:,(?:{expr}|\{{\}}|@i(?:\(\))?))*,?)?|{constant}(?:,{constant})*,?(?:;(?:{member})*+)?)",
    }


# ---------------------------------------------------------------------------- JavaScript

_JS_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
_JS_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_JS = _simple_lexer(
    [("line", r"\r?\n|//[^\n]*\n?|/\*(?:[^*]|\*(?!/))*\n(?:[^*]|\*(?!/))*\*/"), ("skip", r"[ \t\f\v\u00a0]+|/\*.*?\*/|\A#![^\n]*"), ("s", r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|" + _JS_TEMPLATE + r"|(?:(?<=[=(,:;!&|?{}\[\n+>])|(?<=[=(,:;!&|?{}\[+>] )|(?<=return ))[ \t]*" + _JS_REGEX), ("n", _NUMBER + "n?"), ("name", r"#?(?:[^\W\d]|\$)[\w$]*")],
    {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "A": "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=", "=": "=", "o": "/ % == != === !== < <= > >= && || ?? | ^ & << >> >>> **", "*": "*", "-": "+ -", "!": "! ~", "U": "++ --", "e": "...", "r": "=>", ".": ". ?.", ",": ",", ";": ";", ":": ":", "?": "?", "@": "@"},
    {"V": "let const var", "D": "function", "y": "async", "K": "class", "x": "extends", "R": "return throw", "f": "if", "l": "else", "O": "for", "w": "while", "H": "do", "W": "switch", "c": "case", "d": "default", "b": "break continue debugger", "T": "try", "X": "catch", "Z": "finally", "N": "new", "I": "in instanceof of", "M": "import", "E": "export", "!": "typeof void delete await", "Y": "yield"},
)


def _lex_js(text: str) -> Iterator[str]:
    """Classes with a ``;`` where a line ends a statement."""
    last, broke = "", False
    for kind, code in _JS(text.removeprefix("\ufeff")):
        if kind == "line":
            broke = True
            continue
        if broke and last and last in "ins)]}URb" and code not in ".,;)]:?=Ao*-r}XZI" and not (code == "l" and last == "}") and not (last == ")" and code == "{"):
            yield ";"
        broke = False
        if last == "." and kind == "name":
            code = "i"  # a keyword after a dot is a name
        yield code
        last = code
    if last and last in "ins)]URb":
        yield ";"


def _js_rules() -> dict[str, str]:
    func = r"y?D\*?i?\(\)\{\}"
    cls = r"Ki?(?:xi(?:\.i|\(\))*)?\{\}"
    oper = rf"(?:[-!U]|N)*(?:[in]|s|\(\)|\[\]|\{{\}}|{func}|{cls}|N\.i|M(?:\(\)|\.i)|y(?=[^iD(]))(?:\.(?:i|\(\)|\[\])|\(\)|\[\]|s|U)*"
    lam = r"(?:y?(?:i|\(\))r)*"
    flat = rf"{lam}{oper}(?:[o*I-]{lam}{oper})*"
    tern = rf"{flat}(?:\?{lam}{flat}:{flat})*"
    expr = rf"(?:Y\*?(?:{tern})?|{tern}(?:[=A](?:Y\*?)?{tern})*)"
    exprs = rf"{expr}(?:,{expr})*"
    bind = rf"(?:i|\[\]|\{{\}})(?:={expr})?"
    var = rf"V{bind}(?:,{bind})*"
    case = rf"(?:c{exprs}:|d:);?"
    prefix = rf"(?:f\(\);?|l;?|w\(\)|O!?\(\)|H|W\(\)(?=\{{)|i:|{case})*"
    try_ = r"T\{\}(?:X(?:\(\))?\{\})?(?:Z\{\})?"
    from_ = r"(?:is)"
    import_ = rf"M(?:s|(?:i|\*ii|\{{\}})(?:,(?:\*ii|\{{\}}))?{from_})"
    export = rf"E(?:d(?:{expr})|\*(?:ii)?{from_}|\{{\}}(?:{from_})?|{var}|{func}|{cls})"
    ended = rf"(?:{exprs}|{var}|R(?:{exprs})?|bi?|{import_}|{export});?"
    # without its semicolon a statement may only stand last, or end in a brace
    stmt = rf"(?:(?:i:)?H\{{\}}w\(\);?|{prefix}(?:;|\{{\}};?|{func};?|{cls};?|{try_};?|E?d?(?:{func}|{cls});?|(?:{exprs}|{var}|R(?:{exprs})?|bi?|{import_}|{export});))"
    key = r"(?:[a-zA-Z]|s|\[\])"
    prop = rf"(?:{key}:{expr}|i(?:={expr})?|(?:y|i)?\*?{key}\(\)\{{\}}|e{expr})"
    member = rf"(?:;|(?:@i(?:\(\))?)*(?:i|y|\*)*{key}(?:\(\)\{{\}}|(?:={expr})?;)|i\{{\}}|(?:i)*{key}={expr})"
    arg = rf"(?:e?{expr}|e?(?:\[\]|\{{\}}|i)(?:={expr})?)"
    name = r"(?:[isd](?:i[isd])?)"
    return {
        "": rf"(?:{stmt})*+(?:{prefix}{ended})?",
        "(": rf"(?:{arg}(?:,{arg})*,?|(?:{var}|{exprs})?;(?:{exprs})?;(?:{exprs})?|V?(?:{bind}|{oper})I{expr})?",
        "[": rf"(?:,*{arg}?(?:,+{arg})*,*)?",
        "{": rf"(?:(?:{stmt})*+(?:{prefix}{ended})?|{prop}(?:,{prop})*,?|(?:{member})*+|{name}(?:,{name})*,?)",
    }


# ---------------------------------------------------------------------------- shell

_SH_SUB = r"\$\((?:[^()'\"]|'[^']*'|\"(?:[^\"\\]|\\.)*\"|\((?:[^()]|\([^()]*\))*\))*\)"
_SH_DOUBLE = rf"\"(?:[^\"\\`$]|\\.|{_SH_SUB}|\$\{{[^}}]*\}}|\$|`[^`]*`)*\""
_SH_WORD = rf"(?:[^\s;&|<>()'\"`\\$]|\\.|\\\n|\$?'[^']*'|\$?{_SH_DOUBLE}|\$\{{[^}}]*\}}|{_SH_SUB}|`[^`]*`|\$(?![({{]))+"
_SH_MASTER, _SH_NAMES = _master(
    [("skip", r"[ \t\r]+|\\\n"), ("line", r"\n"), ("comment", r"(?:(?<=[\s;&|()])|(?<!.))#[^\n]*"), ("dsemi", r";;&?|;&"), ("heredoc", r"\d*<<-?[ \t]*(?:'[^'\n]+'|\"[^\"\n]+\"|[\w.\-]+)"), ("r", r"(?:\d+|\{\w+\})?(?:>>|>\||<<<|<>|[<>]&|&>>|&>|<|>)(?![(])"), ("arith", r"\(\((?:[^()]|\([^()]*\))*\)\)"), ("o", r"&&|\|\|"), ("|", r"\|&?"), (";", r";"), ("&", r"&"), ("sub", r"[<>]\((?:[^()]|\([^()]*\))*\)"), ("(", r"\("), (")", r"\)"), ("w", _SH_WORD), ("bad", r".")]
)
_SH_OPEN = {"if": "\u00ab", "do": "\u2039", "case": "\u27e6", "{": "{"}
_SH_CLOSE = {"fi": "\u00bb", "done": "\u203a", "esac": "\u27e7", "}": "}"}
_SH_WORDS = {"then": "t", "elif": "E", "else": "l", "while": "W", "until": "W", "for": "O", "select": "O", "function": "D", "!": "!"}
_SH_PATTERN = re.compile(rf"\s*(?:#[^\n]*\n\s*)*\(?[ \t]*{_SH_WORD}(?:[ \t]*\|[ \t]*{_SH_WORD})*[ \t]*\)")


def _lex_shell(text: str) -> Iterator[str]:
    text = text.replace("\r\n", "\n")
    at, command, docs, stack, last = 0, True, [], [], ""
    while at < len(text):
        if stack and stack[-1] == "pattern":
            m = _SH_PATTERN.match(text, at)
            if m and not re.match(r"\s*esac\b", text[at : at + 200]):
                at = m.end()
                yield "P"
                command, last, stack[-1] = True, "P", "case"
                continue
        m = _SH_MASTER.match(text, at)
        at = m.end()
        kind, word = _SH_NAMES[m.lastindex], m.group()
        if kind in ("skip", "comment"):
            continue
        if kind == "line":
            for end in docs:
                close = re.compile(rf"^\t*{re.escape(end)}[ \t]*$", re.M).search(text, at)
                at = len(text) if not close else close.end() + 1
            docs = []
            code, command = "#", True
        elif kind == "heredoc":
            docs.append(re.sub(r"^\d*<<-?[ \t]*|['\"]", "", word))
            code = "h"
        elif kind == "dsemi":
            code, command = "S", True
            if stack:
                stack[-1] = "pattern"
        elif kind == "arith":
            code, command = "w", False
        elif kind == "sub":
            code = "w"
        elif kind == "w":
            code = "w"
            if last in "OD" and last:
                command = last == "D"
            elif command and word in _SH_OPEN:
                code = _SH_OPEN[word]
                if word == "case":
                    stack.append("case")
                    command = False
            elif (command or word in ("}",) and last in ";#") and word in _SH_CLOSE:
                code = _SH_CLOSE[word]
                if word == "esac" and stack:
                    stack.pop()
                command = False
            elif command and word in _SH_WORDS:
                code = _SH_WORDS[word]
                command = code not in "OD"
            elif word == "in" and last == "w" and stack and stack[-1] == "case":
                code, command, stack[-1] = "I", True, "pattern"
            elif word == "in" and last == "w":
                code = "I" if not command else "w"
                command = False
            elif word == "do" and last in ";#":
                code, command = _SH_OPEN["do"], True
            else:
                command = bool(re.fullmatch(r"[A-Za-z_]\w*(?:\[[^]]*\])?\+?=.*", word, re.S)) and command
        elif kind == "bad":
            code = BAD
        else:
            code = kind
            if kind in "(;&|o":
                command = True
            elif kind == ")":
                command = True
        yield code
        last = code


def _shell_rules() -> dict[str, str]:
    redirect = r"(?:rw|h)"
    compound = rf"(?:\u00ab\u00bb|\{{\}}|\(\)|\u27e6\u27e7)(?:{redirect})*"
    simple = rf"(?:w|{redirect}|I|\(\)(?<=w\(\)))+"
    define = rf"(?:w\(\)#*|Dw(?:\(\))?#*)(?:{compound})"
    item = rf"!*(?:{define}|{compound}|{simple})"
    steps = rf"[#;]*(?:{item}(?:(?:[o|]#*|[;#&]+){item})*[;#&]*)?"
    some = rf"#*{item}(?:(?:[o|]#*|[;#&]+){item})*[;#&]+"
    loop = rf"(?:Ow(?:I(?:w)*)?[;#]*\u2039\u203a|W{some}\u2039\u203a)"
    compound = rf"(?:\u00ab\u00bb|\{{\}}|\(\)|\u27e6\u27e7|{loop})(?:{redirect})*"
    item = rf"!*(?:{define}|{compound}|{simple})"
    some = rf"#*{item}(?:(?:[o|]#*|[;#&]+){item})*[;#&]+"
    steps = rf"[#;]*(?:{item}(?:(?:[o|]#*|[;#&]+){item})*[;#&]*)?"
    return {
        "": rf"#*(?:{item}(?:(?:[o|]#*|[;#&]+){item})*[;#&]*)?",
        "(": rf"#*(?:{item}(?:(?:[o|]#*|[;#&]+){item})*[;#&]*)?",
        "{": some,
        "\u00ab": rf"{some}t{some}(?:E{some}t{some})*(?:l{some})?",
        "\u2039": some,
        "\u27e6": rf"wI#*(?:P{steps}S#*)*(?:P{steps})?",
    }


@lru_cache(maxsize=1)
def languages() -> dict[str, Language]:
    """By extension in lower case."""
    inside, names = _python_rules()
    python = Language(_lex_python, inside, names, r"\u2192\u2190|[^#\u2192]*#", frozenset({"", "\u2192"}))
    rust, rust_names = _rust_rules()
    return {
        "py": python,
        "pyi": python,
        "go": Language(_lex_go, _go_rules()),
        "rs": Language(_plain(_RUST), rust, rust_names),
        "c": Language(_plain(_C), _c_rules()),
        "java": Language(_plain(_JAVA), _java_rules()),
        "js": Language(_lex_js, _js_rules()),
        "sh": Language(_lex_shell, _shell_rules()),
    }

from __future__ import annotations

import ast

import pytest

from tessera.llm.grammars import BAD, CLOSES, END, OPENS, START, languages
from tessera.llm.syntax import invalid_files, invalid_rates

VALID = {
    "py": [
        "",
        "# only a comment",
        "x = 1",
        "def f(a: int, *, b=2, **k) -> list[str]:\n    return [x for x in a if x not in b]\n",
        "@d.cached(maxsize=3)\nasync def g():\n    async with a as b, c:\n        await b\n    try:\n        pass\n    except (A, B) as e:\n        raise X from e\n    else:\n        ...\n    finally:\n        del a[0], b\n",
        "x = f\"{a!r:>8} {{}} {b['k']}\" 'more'\ny: int = 3\nz += 1; w = lambda q, *r: q if q else None\n",
        "match p:\n    case [1, *rest] if rest:\n        pass\n    case {'a': 1} | Point(x=0):\n        pass\n    case _:\n        pass\n",
        "if a:\n\tpass\nelif b: pass\nelse:\n\n\twhile (n := next()):\n\t\tcontinue\n",
        'd = {**a, "k": 1, 2: [*b]}\ns = {1, 2}\nprint(*a, sep="", **k)\nx[1:2, ::3] = yield_ = -1 ** ~2\nfrom . import a as b\nfrom .x import (c,\n d)\n',
        's = """<<<<<<< not a conflict\n"""\nassert s, "no"\nclass A(B, metaclass=C):\n    x = 1\n    def f(self): return self.x\n',
    ],
    "go": ['package a\n\nimport (\n\t"fmt"\n)\n\nfunc (t *T) Run(a, b int) (int, error) {\n\tfor i := 0; i < 3; i++ {\n\t\tif v, ok := m[i]; ok && !v {\n\t\t\tgo func() { ch <- 1 }()\n\t\t}\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\ts := []map[string]int{{"a": 1}, nil}\n\tfor _, v := range s[1:] {\n\t\tdefer f(v...)\n\t}\n\tvar r rune = \'{\'\n\treturn len(s), err\n}\n\ntype P struct {\n\tName string `json:"n"`\n\t*Q\n}\n\nconst (\n\tA = iota\n\tB\n)\n'],
    "rs": ["use std::{io, fmt as f};\n\n#[derive(Debug)]\npub struct P<'a> { name: &'a str, v: Vec<(String, u64)> }\n\nimpl<'a> P<'a> {\n    pub fn get(&self, n: usize) -> Option<&str> {\n        let x: Vec<(String, u64)> = vec![(\"a\".to_owned(), 1)];\n        /* a /* nested } */ b */\n        for i in 0..n { if i % 2 == 0 { continue; } }\n        let f = |a: i32| a + 1;\n        match x.get(0) { Some((s, _)) if s.len() > 1 => { f(1); } None => return None, _ => (), }\n        let c = '}';\n        let r = r#\"fn \"q\" {\"#;\n        x.iter().map(|(a, b)| a).collect::<Vec<_>>();\n        Some(self.name)\n    }\n}\n"],
    "c": ['#include <stdio.h>\n#define X(a) \\\n  (a)\nstatic int f(const char *p, int n) {\n    long a[] = {1, 2};\n    for (int i = 0; i < n; i++) { if (p[i] == \'{\') break; else n--; }\n    do { n = (int) sizeof(a) + *p; } while (n > 0);\n    switch (n) { case 1: return 2; default: break; }\n    /* don\'t } */\n    return n ? a[0] : -1;\n}\nstruct s { int x; unsigned y : 3; };\ntypedef struct s s_t;\n'],
    "java": ['package a.b;\n\nimport java.util.*;\n\npublic final class A<T extends B> implements C, D {\n    private static final String X = "}";\n    static int f(String a, int... n) throws E {\n        Map<String, List<int[]>> m = new HashMap<>();\n        for (String s : list) { m.forEach((k, v) -> sink.accept(k, 1)); }\n        try (R r = open()) { return n > 1 ? 1 : 2; } catch (A | B e) { throw new X("q"); } finally { }\n    }\n    enum K { A, B; int x; }\n    @Override public boolean equals(Object o) { return o instanceof A<?> && (int) x == 1; }\n}\n'],
    "js": ["const { a, b: c } = require('x')\n// it's\nasync function f(x, y = 1, ...z) {\n  let s = `a ${b} { \\``\n  for (const k of z) { if (k > 3) continue; else break }\n  z.map((q) => ({ ...q, n: 1 }))\n  const re = /^[{(]a\\d{2}\\)/;\n  try { await g() } catch { return }\n}\nclass A extends B { constructor() { super(); } static get x() { return 1 } }\nexport default f;\nmodule.exports.k = 'v';\n"],
    "sh": ['#!/bin/sh\nset -eu\nif [ -f a.lock ]; then\n  echo "it\'s (ok"\nelif true; then :\nelse\n  x=$(ls | wc -l)\nfi\nfor i in 1 2 3; do echo "$i" >> log 2>&1; done\nwhile read -r l; do case "$l" in a|b) echo 1;; *) : ;; esac; done < f\nf() {\n  cat <<EOF\nif ( {\nEOF\n}\n[ -d x ] && cd x || exit 1\n'],
}
MORE = {
    "py": ["async def main():\n    async for x in y:\n        z = [i async for i in x if i]\n    return await asyncio.gather(*z)\n", "x = a if b else c if d else e\nprint(f'{x:{w}}', end='')\nlambda *a, **k: (a, k)\n@property\ndef f(self, /, a, *, b): ...\nglobal q\nif (a and\n        b):  # c\n    pass\n"],
    "go": ["package a\n\ntype S[T any] interface {\n\tGet(k string) (T, error)\n\tio.Reader\n}\n\nfunc Map[K comparable, V any](m map[K]V, f func(V) V) map[K]V {\n\tout := make(map[K]V, len(m))\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\tcase ch <- 1:\n\tdefault:\n\t\tgoto end\n\t}\nend:\n\tfor {\n\t\tbreak\n\t}\n\tx := &P{Name: \"a\", Q: &Q{1, 2}}\n\tif err := f(); err != nil {\n\t\treturn nil\n\t} else if x == nil {\n\t}\n\treturn out\n}\n\nvar e = errors.New(\"x\")\n"],
    "rs": ["pub trait T<K: Ord + 'static>: Sized where K: Clone {\n    type Out;\n    const N: usize = 3;\n    fn f(&mut self, k: K) -> Result<Self::Out, Box<dyn Error>>;\n}\n\npub enum E { A, B(u8), C { x: i32 } }\n\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\n\nasync fn g(x: &[u8]) -> io::Result<()> {\n    let n = x.iter().filter(|&&b| b == b'a').count()?;\n    let Some(y) = h().await? else { return Err(e) };\n    while let Some(z) = it.next() { *p += z as u64; }\n    let a = [0u8; 16];\n    let s = S { a, b: 1, ..Default::default() };\n    if x[0] > 1 && !y { 'o: loop { break 'o; } }\n    println!(\"{}\", if n > 0 { 1 } else { 2 });\n    Ok(())\n}\n\n#[cfg(test)]\nmod tests { use super::*; #[test] fn t() { assert_eq!(1, 1); } }\n"],
    "c": ["typedef int (*fn)(const char *, size_t);\nenum e { A, B = 2, };\nstatic struct s v = { .x = 1, .y = { 2, 3 } };\nextern int g(void);\nint main(int argc, char **argv) {\n    fn f = NULL;\n    char *p = (char *) malloc(n * sizeof(*p)), c = 'x';\n    while (i-- > 0 && p->next != NULL) p = p->next;\n    if (!f) goto out; else if (f) { (*f)(\"a\" \"b\", 1); }\nout:\n    return a ? b : c ? d : e;\n}\n"],
    "java": ["package a;\n\nimport static java.util.Map.*;\n\n@FunctionalInterface\ninterface F<T extends Comparable<? super T>> { T get(int i) throws Exception; default void x() { } }\n\nrecord P(int x, String y) { }\n\nclass B extends C<D> {\n    private final int[] a = {1, 2, 3};\n    static { init(); }\n    B(int x) { this.a[0] = x; super.f(); }\n    <T> List<T> g(List<? extends T> l) {\n        Runnable r = () -> { return; };\n        l.stream().map(String::valueOf).filter(s -> s.length() > 2).toList();\n        switch (x) { case 1: case 2: f(); break; default: throw new E(\"m\" + x); }\n        int y = switch (x) { case A -> 1; default -> 2; };\n        do { i++; } while (i < 3);\n        for (;;) { if (a) continue; else break; }\n        Object[] o = new Object[3];\n        synchronized (this) { a = (List<T>) b; }\n        return x == 1 ? null : (T) y;\n    }\n}\n"],
    "js": ["import d, { x as y } from 'm';\nexport const f = async ({ a, b = 2 }, [c]) => { await a?.b?.[c]; };\nlet o = { a, 'b': 1, [c]: 2, get d() { return 1 }, async *e() { yield* g(); }, ...r };\nfor (let i = 0, n = 3; i < n; i++) if (i) break; else continue;\nlabel: while (true) { do { x ||= y ?? z } while (x) }\nswitch (k) { case 1: f(); break; default: throw new Error(`n ${a ? `b ${c}` : 'd'}`) }\nconst t = typeof x === 'string' ? void 0 : new.target\nvar re = a / b / c, q = x.replace(/[/]\\//g, '')\n(function () { 'use strict' })()\nif (a) b()\nelse c()\n"],
    "sh": ["#!/usr/bin/env bash\nset -o pipefail\nfunction run { local a=$1; shift; \"$@\" || return 1; }\nwhile ! ping -c1 host >/dev/null 2>&1 && [[ $n -lt 3 ]]; do\n  ((n++)); sleep 1\ndone\nuntil false; do break; done\nif grep -q 'a' <<< \"$x\" || test -z \"${y:-}\"; then echo \"$(date +%s) ${arr[@]}\"; fi\ncase $1 in\n  -h|--help) usage ;;\n  *)\n    exit 2\n    ;;\nesac\n(cd /tmp; ls) | sort -u > out &\nfor f in *.txt; do { cat \"$f\"; }; done\n"],
}
for _lang, _texts in MORE.items():
    VALID[_lang] = VALID[_lang] + _texts
INVALID = {
    "py": ["def f(:\n    pass\n", "x = (1, 2", "x = 1)", "if a:\npass\n", "<<<<<<< HEAD\nx = 1\n=======\ny = 2\n>>>>>>> b\n", "use crate::a;\n", "s = 'open\n", "x = \n", "try:\n    pass\n", "for a, b\n", "f\"{}\"", "  x = 1\n", "x = [1}\n", "return freducer):\n", "a b\n", "SPLIT_...\n", "[output cut]\n"],
    "go": ["package a\n\nfunc f() {\n", "func f() {}\n", "package a\n\nfunc f( {\n}\n", "package a\n\nx := \n", "from a import b\n", "package a\n\nvar s = \"open\n", "package a\n\nfunc f() {\n\tif x >\n}\n", "package a\n\nfunc f() {\n\tx := 1 2\n}\n"],
    "rs": ["fn f() {\n", "fn f() { let x = ; }\n", "let x = 1;\n", "package a\n\nfunc f() {}\n", "fn f(a: i32 { }\n", "fn f() { x y z; }\n", "fn f() { \"open }\n"],
    "c": ["int f( {\n}\n", "int f() { return 1 }\n", "int f() { int x = ; }\n", "}\n", "int f() { a b c d; }\n", "int x = 'ab\n;"],
    "java": ["class A {\n", "class A { int f() { return 1 } }\n", "package a\n\nfunc f() {}\n", "class A { void f() { int x = 1 +; } }\n", "}\n"],
    "js": ["function f( {\n}\n", "const x = ;\n", "let a = [1, 2;\n", "use crate::a::B;\n", "if (a {\n}\n", "const s = 'open\n", "package a\n\nimport \"x\"\n\nfunc f() int {\n}\n"],
    "sh": ["if true; then\n", "fi\n", "echo \"open\n", "for i in 1; do echo\n", "<<<<<<< HEAD\n", "f( {\n", "echo ) x\n"],
}


def verdict(lang: str, text: str) -> bool:
    """Brute force over one file with a stack: whether it is valid."""
    known = languages()[lang]
    codes = list(known.lex(text))
    row = [START, *codes, END]
    if BAD in codes or any(a + b not in known.pairs() for a, b in zip(row, row[1:], strict=False)):
        return False
    stack: list[tuple[str, list[str]]] = [("", [])]
    for c in codes:
        if c in OPENS:
            kind, content = stack.pop()
            if not stack or CLOSES.get(kind) != c or not known.fits(kind, "".join(content)):
                return False
        stack[-1][1].append(c)
        if c in CLOSES:
            stack.append((c, []))
    return len(stack) == 1 and known.fits("", "".join(stack[0][1]))


@pytest.mark.parametrize("lang", sorted(VALID))
def test_grammars(lang):
    for text in VALID[lang]:
        assert verdict(lang, text), text
        assert verdict(lang, text.replace("\n", "\r\n")), text
    for text in INVALID[lang]:
        assert not verdict(lang, text), text


def test_python_cases_agree_with_its_parser():
    for text in VALID["py"]:
        ast.parse(text)  # as the interpreter that runs the tests has it
    for text in INVALID["py"]:
        with pytest.raises(SyntaxError):
            ast.parse(text)


def test_on_spark(spark):
    cases = [(lang, t) for group in (VALID, INVALID) for lang, ts in group.items() for t in ts]
    cases += [("pyi", "def f(): ...\n"), ("md", "((("), ("py", "x = [\n" + "1,\n" * 5000 + "]\n"), ("py", "(" * 300 + ")" * 299)]
    rows = [(i, 1 + i % 2, lang, "source", t) for i, (lang, t) in enumerate(cases)] + [(9_000, 1, "py", "text", "((("), (9_001, None, "py", "source", "(((")]
    df = spark.createDataFrame(rows, "file_id long, root_id long, extension string, kind string, content string")
    want = {i for i, _, lang, kind, t in rows if kind == "source" and lang != "md" and not verdict(lang, t)}
    got = [r["file_id"] for r in invalid_files(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rates = {(r["root_id"], r["language"]): (r["files"], r["invalid"]) for r in invalid_rates(df).collect()}
    assert rates[(None, "python")] == (1, 1) and sum(b for _, b in rates.values()) == len(want)
    assert invalid_files(df.limit(0)).count() == 0

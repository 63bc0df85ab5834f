"""Definitions and references of snippets in each language."""

import random

import pytest

from graphloom.sources.languages import EXTENSIONS, LANGUAGES, language_for_path
from graphloom.sources.parse import parse_source

CASES = {
    "go": (
        'package main\nimport (\n\t"fmt"\n\tx "net/http"\n)\ntype Shape struct{ w int }\ntype ID = int\nfunc (s Shape) Area() (int, error) { return scale(s.w), nil }\nfunc main() { fmt.Println(Area()) }\n',
        {("Shape", "class"), ("Area", "method"), ("main", "function")},
        {("scale", "call", "Area"), ("Println", "method", "main"), ("Area", "call", "main")},
        {"fmt", "net/http"},
    ),
    "rust": (
        'use std::io::{self, Read};\npub struct P { x: i32 }\nenum E { A(i32) }\ntrait T { fn f(&self); }\ntype N = u8;\nimpl P { pub fn new() -> P { build(1) } }\nfn main() { let p = P::new(); p.dist(); println!("{}", hidden()); }\n',
        {("P", "class"), ("E", "enum"), ("T", "interface"), ("N", "type"), ("new", "function"), ("main", "function")},
        {("build", "call", "new"), ("new", "call", "main"), ("dist", "method", "main")},
        {"std::io::{self, Read}"},
    ),
    "java": (
        "package app;\nimport java.util.List;\nimport static a.b.C.d;\npublic class Svc extends Base {\n  private int n = make();\n  Svc(int n) { super(n); }\n  @Override public int run() { return load(this.x.go()); }\n}\ninterface Repo { void save(); }\nenum Color { RED(1), BLUE(2); Color(int i) {} }\nrecord Pt(int x) {}\n",
        {("Svc", "class"), ("run", "method"), ("Svc", "method"), ("Repo", "interface"), ("save", "method"), ("Color", "enum"), ("Color", "method"), ("Pt", "class")},
        {("make", "call", "Svc"), ("load", "call", "run"), ("go", "method", "run")},
        {"java.util.List", "a.b.C.d"},
    ),
    "ruby": (
        "module M\nclass Svc < Base\n  def run(a)\n    if a\n      helper(1)\n    end\n    obj.fetch\n  end\n  def self.make\n    puts 'x'\n  end\nend\nend\n",
        {("M", "class"), ("Svc", "class"), ("run", "method"), ("make", "method")},
        {("helper", "call", "run"), ("fetch", "method", "run"), ("puts", "call", "make")},
        set(),
    ),
    "c": (
        '#include <stdio.h>\n#include "own.h"\n#define F(x) hidden(x)\nstruct node { int v; };\nenum kind { A, B };\nint proto(int a);\nstatic int *helper(int a) { return a; }\nint main(void) { p->go(1); return helper(compute()); }\n',
        {("node", "class"), ("kind", "enum"), ("helper", "function"), ("main", "function")},
        {("go", "method", "main"), ("helper", "call", "main"), ("compute", "call", "main")},
        {"stdio.h", "own.h"},
    ),
    "cpp": (
        "#include <vector>\nclass Point { public: Point() : x(0) {} int dist() const { return helper(x); } int x; };\nint Far::away() { return ns::skip(1); }\nint main() { Point p; p.dist(); }\n",
        {("Point", "class"), ("Point", "method"), ("dist", "method"), ("away", "function"), ("main", "function")},
        {("helper", "call", "dist"), ("dist", "method", "main")},
        {"vector"},
    ),
    "csharp": (
        "using System;\nusing A.B;\nnamespace App { public class Svc { public Svc() {} int Run() { return Load(); } int Load() => obj.Fetch(new X(1)); } struct S {} interface I { void F(); } enum E { A } }\n",
        {("Svc", "class"), ("Svc", "method"), ("Run", "method"), ("Load", "method"), ("S", "class"), ("I", "interface"), ("F", "method"), ("E", "enum")},
        {("Load", "call", "Run"), ("Fetch", "method", "Load")},
        {"System", "A.B"},
    ),
    "php": (
        "<?php\nnamespace App;\nuse Other\\Thing;\ninterface I {}\ntrait T {}\nclass Svc { public function run() { return helper($this->load(), Cfg::get()); } }\nfunction top() { return plain(); }\n",
        {("I", "interface"), ("T", "class"), ("Svc", "class"), ("run", "method"), ("top", "function")},
        {("helper", "call", "run"), ("load", "method", "run"), ("get", "method", "run"), ("plain", "call", "top")},
        {"Other\\Thing"},
    ),
    "scala": (
        "import b.C\nclass Svc { def run(): Int = helper()\n  type T = Int }\nobject Main { def go() = obj.run() }\ntrait R\n",
        {("Svc", "class"), ("run", "method"), ("T", "type"), ("Main", "class"), ("go", "method"), ("R", "interface")},
        {("helper", "call", "run"), ("run", "method", "go")},
        {"b.C"},
    ),
    "solidity": (
        'import "./Other.sol";\nimport {X} from "./X.sol";\ncontract Token { modifier only() { check(); _; } function mint(uint x) public only { burn(x); a.b(); } struct S { uint x; } }\nlibrary L {}\n',
        {("Token", "class"), ("only", "function"), ("mint", "method"), ("S", "class"), ("L", "class")},
        {("check", "call", "only"), ("burn", "call", "mint")},
        {"./Other.sol", "./X.sol"},
    ),
    "kotlin": (
        "import a.b.C\nclass Svc { fun run(): Int { return 1 } }\nobject O\nfun String.ext() = 1\nfun main() {}\n",
        {("Svc", "class"), ("run", "method"), ("O", "class"), ("ext", "function"), ("main", "function")},
        set(),
        {"a.b.C"},
    ),
    "zig": ("fn helper() i32 { return 1; }\npub fn main() void { _ = helper(); @import(\"x\"); a.b(); }\n", {("helper", "function"), ("main", "function")}, {("helper", "call", "main")}, set()),
    "bash": ("helper() { echo hi; }\nfunction main { helper; }\n", {("helper", "function"), ("main", "function")}, set(), set()),
    "rescript": ("let helper = (x) => x\nlet run = () => helper(1)\ntype t = int\nmodule M = { let z = 1 }\n", {("helper", "function"), ("run", "function"), ("t", "type"), ("M", "class"), ("z", "function")}, {("helper", "call", "run")}, set()),
    "ocaml": ("let helper x = x\nlet run () = helper 1\ntype t = A | B\nmodule M = struct\n  let z = 1\nend\n", {("helper", "function"), ("run", "function"), ("t", "type"), ("M", "class"), ("z", "function")}, set(), set()),
    "lua": ("local function helper(x) if x then return 1 end end\nfunction M.run() helper(1) end\n", {("helper", "function"), ("M.run", "function")}, set(), set()),
    "objc": (
        "#import <Foundation/Foundation.h>\n@interface Svc : NSObject\n- (void)run:(int)x;\n@end\n@implementation Svc\n- (void)run:(int)x { NSLog(@\"x\"); [self load]; }\n@end\n",
        {("Svc", "class"), ("run", "method")},
        {("NSLog", "call", "run")},
        {"Foundation/Foundation.h"},
    ),
    "python": (
        "import os, sys as s\nfrom app.models import User\nfrom . import z\n\n@deco(1)\ndef greet(name, d=dflt()):\n    return format_name(name)\n\nclass Svc(Base):\n    def run(self):\n        return self.load(\n            other())\n    async def load(self): return os.getcwd()\nprint(greet(1))\n",
        {("greet", "function"), ("Svc", "class"), ("run", "function"), ("load", "function")},
        {("deco", "call", None), ("dflt", "call", "greet"), ("format_name", "call", "greet"), ("load", "method", "run"), ("other", "call", "run"), ("getcwd", "method", "load"), ("print", "call", None), ("greet", "call", None)},
        {"os", "sys", "app.models", "."},
    ),
    "typescript": (
        'import { readFile } from "node:fs/promises";\nimport helper from "./helper";\n\nexport function greet(name: string): string {\n  return format(`${inner(name)}`);\n}\nconst shout = (text: string) => greet(text).toUpperCase();\nexport abstract class Svc {\n  field = () => deep();\n  run() { return this.load(); }\n  private load() { return readFile("x"); }\n  abstract sign(): void;\n}\nexport interface Options { verbose: boolean; go(x: number): void }\nexport type Id = string | number;\nexport enum Color { Red, Green }\nif (x) { new Thing(); }\n',
        {("greet", "function"), ("shout", "function"), ("Svc", "class"), ("field", "function"), ("run", "method"), ("load", "method"), ("sign", "method"), ("Options", "interface"), ("go", "method"), ("Id", "type"), ("Color", "enum")},
        {("format", "call", "greet"), ("inner", "call", "greet"), ("greet", "call", "shout"), ("toUpperCase", "method", "shout"), ("deep", "call", "field"), ("load", "method", "run"), ("readFile", "call", "load")},
        {"node:fs/promises", "./helper"},
    ),
    "javascript": (
        "export class Cart {\n  total() { return sum(this.items); }\n}\nconst add = (a, b) => a + b;\nfunction* gen() { yield go(/[)]/.test(x)); }\n",
        {("Cart", "class"), ("total", "method"), ("add", "function"), ("gen", "function")},
        {("sum", "call", "total"), ("go", "call", "gen"), ("test", "method", "gen")},
        set(),
    ),
    "tsx": ("export function App() {\n  const [n, setN] = useState<number>(0);\n  return <div onClick={() => setN(n + 1)}>it's</div>;\n}\n", {("App", "function")}, {("useState", "call", "App"), ("setN", "call", "App")}, set()),
}


@pytest.mark.parametrize("lang", LANGUAGES)
def test_language(lang):
    text, symbols, calls, imports = CASES[lang]
    got = parse_source(lang, text)
    assert {(s.name, s.kind) for s in got.symbols} == symbols
    assert {(r.name, r.kind, r.from_symbol) for r in got.refs if r.kind != "import"} == calls
    assert {r.name for r in got.refs if r.kind == "import"} == imports


def test_details():
    got = parse_source("typescript", CASES["typescript"][0])
    by = {s.name: s for s in got.symbols}
    assert by["greet"].exported and by["Svc"].exported and not by["load"].exported and not by["shout"].exported
    assert by["run"].container == "Svc" and by["greet"].container is None
    assert by["greet"].signature == "function greet(name: string): string"
    assert (by["greet"].start_row, by["greet"].start_col, by["greet"].end_row, by["greet"].end_col) == (3, 7, 5, 1)
    assert by["load"].signature == "private load()"
    py = {s.name: s for s in parse_source("python", CASES["python"][0]).symbols}
    assert py["run"].container == "Svc" and py["greet"].signature == "def greet(name, d=dflt()):"


def test_long_signature_and_astral():
    text = "def f(" + ", ".join(f"a{i}" for i in range(100)) + "): pass\n"
    sig = parse_source("python", text).symbols[0].signature
    assert len(sig) == 240 and sig.endswith("…")
    s = parse_source("python", "x = '\U0001f600'; y = 1\ndef g(): pass\n").symbols[0]
    assert s.start_byte == len("x = '\U0001f600'; y = 1\n") + 1


@pytest.mark.parametrize("lang", LANGUAGES)
def test_broken_text_never_raises(lang):
    text = CASES[lang][0]
    r = random.Random(3)
    assert parse_source(lang, "").symbols == [] and parse_source(lang, "").refs == []
    for _ in range(150):
        a, b = sorted(r.randrange(len(text) + 1) for _ in range(2))
        cut = text[:a] + r.choice(["", "{", ")", "(", "}", '"', "'", "<", "`", "class", "\n"]) + text[b:]
        parse_source(lang, cut)


def test_unknown_language_and_extensions():
    with pytest.raises(ValueError, match="Unknown language"):
        parse_source("cobol", "x")
    assert len(EXTENSIONS) == 36 and len(LANGUAGES) == 21
    assert language_for_path("a/b.test.TS") == "typescript" and language_for_path("Makefile") is None and language_for_path("x.txt") is None


def test_python_agrees_with_its_own_grammar():
    import ast
    import inspect
    import textwrap

    for module in (textwrap, inspect, random):
        text = inspect.getsource(module)
        tree = ast.parse(text)
        want = sorted((n.name, n.lineno - 1, n.col_offset) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef))
        got = parse_source("python", text)
        assert sorted((s.name, s.start_row, s.start_col) for s in got.symbols) == want
        calls = set()
        for n in ast.walk(tree):
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name):
                    calls.add((f.id, "call", n.lineno - 1))
                elif isinstance(f, ast.Attribute):
                    calls.add((f.attr, "method", n.lineno - 1))
        mine = {(r.name, r.kind, r.start_row) for r in got.refs if r.kind != "import"}
        assert len(mine ^ calls) <= 0.01 * len(calls) + 2, sorted(mine ^ calls)[:8]

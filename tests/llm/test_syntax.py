import pytest
from snippets import INVALID, VALID

from quarrystone.llm import syntax
from quarrystone.llm.grammars import parses, verdict

GOOD = {
    "java": ["package a.b;\nimport java.util.List;\n@Deprecated\npublic final class A<T extends B> extends C implements D, E {\n  private static final int[] X = {1, 2};\n  A(int x) { this.x = x; }\n  public <R> List<R> m(final Map<String, T> a, int... b) throws IOException {\n    for (int i = 0; i < 3; i++) { if (a == null) continue; else b[i]++; }\n    for (String s : list) System.out.println(s + (char) 1);\n    try (var r = open()) { f(x -> x + 1, A::new); } catch (IOException | E2 e) { throw new X(e); } finally { g(); }\n    switch (k) { case 1: break; default: return a ? b : c; }\n    do { x--; } while (x > 0);\n    return new ArrayList<>();\n  }\n}\n", "private int f(long a) {\n  return 1;\n}"],
    "c": ["#include <a.h>\n#define M(x) \\\n  (x)\ntypedef struct { int a, b; } P;\nstatic const char *names[] = {\"a\", \"b\"};\nenum K { A = 1, B };\nint f(const struct s *p, unsigned int n) {\n  for (int i = 0; i < n; ++i) p->x[i] = *q & ~1;\n  if (!p) goto end; else return -1;\n  while (n--) { switch (n) { case 1: break; default: ; } }\nend:\n  return sizeof(int) * (size_t)n;\n}\n"],
    "cpp": ["#include <x>\nnamespace a {\ntemplate <typename T>\nclass B : public C<T> {\n public:\n  explicit B(int x) : x_(x) {}\n  int m(const std::vector<T>& v) const;\n  ~B() = default;\n private:\n  std::map<int, std::string> m_;\n};\n}  // a\nauto f = [&](int x) { return x + 1; };\nint main() {\n  for (const auto& [k, v] : m) std::cout << k << v;\n  auto p = std::make_unique<int>(3);\n  return 0;\n}\n"],
    "javascript": ["import d, { a as b } from './x';\nexport default class A extends B {\n  static x = 1;\n  async m({ a, b = 2 }, ...rest) { await f`t${a}`; }\n  get v() { return this.a?.b ?? /re[/]g/.test(s) }\n}\nconst g = async (x) => ({ ...x, [k]: 1, f() {} })\nfor (const [k, v] of Object.entries(o)) console.log(k)\nlet h = function* () { yield 1 }\nif (a) b(); else { c() }\n", "run(x) {\n  go(x);\n}"],
    "typescript": ["export interface A<T = unknown> extends B { a?: T[]; b: () => void; c(x: number): string }\ntype U = 'a' | { k: number } | Array<string>;\nenum E { A = 1, B }\nexport class K<T> { private readonly x: Map<string, T> = new Map(); constructor(public a: number, b?: string) { super(); } async m<R>(x: R): Promise<R | null> { return x as any; } }\nconst f = (a: number, b = 1): number => a! + b;\nfunction g(x: unknown): x is string { return typeof x === 'string' }\nabstract class Q { abstract z(): void; }\n"],
    "rust": ["#![allow(x)]\nuse a::{b, c as d, *};\n#[derive(Debug)]\npub struct S<'a, T: Clone> { pub a: &'a [T], b: Option<Box<dyn Fn(u8) -> u8>> }\npub struct P(u8, pub String);\nenum E { A, B(u8), C { x: i32 } }\nimpl<'a, T> Tr for S<'a, T> where T: Clone {\n    fn f(&self, (a, b): (u8, u8)) -> Result<Vec<u8>, String> {\n        let mut v: Vec<u8> = vec![1, 2];\n        for (i, x) in v.iter().enumerate() { println!(\"{}\", x); }\n        let c = match a { 0 => 1, n if n > 2 => { 3 } _ => 0 };\n        if let Some(x) = o { return Ok(x?); } else if a == b { loop { break; } }\n        let k = |x: u8| x as u32 + 1;\n        while a < b { a += 1; }\n        let r = r#\"x\"#; let ch = 'a';\n        S { a: &v[..], b: None }\n    }\n}\nconst N: usize = 3;\npub mod m;\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"b/c\"\n)\n\ntype T struct {\n\ta, b int `json:\"a\"`\n\tm map[string][]int\n\tE\n}\n\ntype I interface {\n\tM(x int) (string, error)\n}\n\nconst (\n\tA = iota\n\tB\n)\n\nfunc (t *T) M(x int, y ...string) (s string, err error) {\n\tfor i, v := range t.m {\n\t\tif v, ok := f(i); !ok {\n\t\t\treturn \"\", fmt.Errorf(\"x\")\n\t\t} else if v > 1 {\n\t\t\tgo func() { ch <- 1 }()\n\t\t}\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tdefer g(i)\n\t}\n\tswitch x {\n\tcase 1, 2:\n\t\tbreak\n\tdefault:\n\t}\n\tvar z = []int{1, 2}\n\tp := &T{a: 1, b: 2}\n\treturn s[1:], nil\n}\n"],
    "python": ["class A:\n    def f(self):\n        return 1\n", "    def f(self):\n        x = \"\"\"\ntext at the margin\n\"\"\"\n        return x\n", "﻿x = 1\r\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_well_formed(language, text):
    assert parses(text, language)


@pytest.mark.parametrize("language", [k for k in GOOD if k != "python"])
@pytest.mark.parametrize("damage", [lambda t: t[: len(t) * 2 // 3].rstrip("}\n ;"), lambda t: t.replace("{", "{\n<<<<<<< HEAD\n", 1), lambda t: t + "\n)))", lambda t: "\n".join(f"{n}: {x}" for n, x in enumerate(t.split("\n"), 1)), lambda t: t.replace("=", "= =", 1), lambda t: t.replace('"', "“")])
def test_damaged(language, damage):
    text = damage(GOOD[language][0])
    if text != GOOD[language][0]:
        assert not parses(text, language)


def test_foreign_text_names_its_language():
    assert verdict(GOOD["python"][0], "go") == "python"
    assert verdict(GOOD["go"][0], "java") == "go"
    assert verdict("# title\n\nSome prose, isn't it.\n", "rust") == "corrupt"
    assert verdict("", "c") == "ok"


def test_operator(spark, rows):
    chunks = spark.createDataFrame([(1, "r/a.py", "function", "def f(:\n"), (1, "r/a.py", "function", "def f(:\n"), (2, "r/a.py", "function", "x = 1"), (3, "r/b.go", "file", GOOD["python"][0]), (4, "r/c.md", "file", "))"), (5, None, "file", "))"), (6, "r/d.rs", "file", None), (7, "r/e.rs", "file", ""), (8, "r/x.c", "file", ")")], "id long, path string, kind string, source string")
    files = spark.createDataFrame([("r/a.py",), ("r/a.py",), ("r/b.go",), ("r/c.md",), ("r/d.rs",), ("r/e.rs",), (None,)], "path string")
    told = syntax.file_verdicts(chunks, files)
    assert rows(told.select("path", "verdict")) == [("r/a.py", "corrupt"), ("r/b.go", "python"), ("r/e.rs", "ok")]
    assert rows(syntax.rates(told).select("language", "files", "invalid", "wrong_extension")) == [("go", 1, 1, 1), ("python", 1, 1, 0), ("rust", 1, 0, 0)]
    assert syntax.file_verdicts(chunks.where("false"), files).count() == 0


@pytest.mark.parametrize("language,text", VALID)
def test_ordinary_code_is_well_formed(language, text):
    assert parses(text, language)


@pytest.mark.parametrize("language,text", INVALID)
def test_broken_code_is_not(language, text):
    assert not parses(text, language)


@pytest.mark.parametrize("language", ["java", "c", "cpp", "javascript", "typescript", "rust", "go"])
def test_long_and_deep_texts_end_soon(language):
    import time

    began = time.time()
    parses("x = " + "(" * 400 + "1" + ")" * 400 + ";", language)
    parses("{" * 3000, language)
    parses("f(a, b);\n" * 20_000, language)
    parses("x = <a>" * 2_000 + "</", language)
    parses("`${" * 2_000 + "}", language)
    parses("a < b > c " * 5_000 + "/>;", language)
    assert time.time() - began < 20


def test_short_foreign_text_is_named():
    assert verdict("x := f(1)\n", "java") == "go" and verdict("let x: u8 = y?;", "python") == "rust"

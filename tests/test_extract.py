import pytest

from quarrystone.extract.extractors import extract, extract_deps, extract_symbols

RUST = """use crate::db::{Db, Row as R, *};
use std::fmt;

pub struct Auth {
    db: Db,
}

impl Auth {
    pub fn new(db: Db) -> Self {
        Auth { db }
    }

    fn login(&self) -> bool {
        // not_a_call()
        self.db.find("x(y)") && Db::open()
    }
}

fn free() {
    helper();
}
"""


def names(found):
    return [(s[0], s[1], s[2], s[3], s[5]) for s in found]


def test_rust():
    symbols, deps = extract(RUST, "rust")
    assert names(symbols) == [("Auth", "struct", 4, 6, None), ("Auth", "impl", 8, 17, None), ("new", "method", 9, 11, "Auth"), ("login", "method", 13, 16, "Auth"), ("free", "function", 19, 21, None)]
    assert [(d[2], d[3]) for d in deps if d[4] == "imports"] == [("crate::db", "Db"), ("crate::db", "Row"), ("std", "fmt")]
    assert [(d[1], d[3]) for d in deps if d[4] == "calls"] == [("login", "self.db.find"), ("login", "Db::open"), ("free", "helper")]


def test_python():
    source = "import os, sys as s\nfrom a.b import c\n\nclass K:\n    @deco\n    def m(self):\n        return os.path.join(f(1))\n\nx()\n"
    symbols, deps = extract(source, "python")
    assert names(symbols) == [("K", "class", 4, 7, None), ("m", "method", 6, 7, "K")]
    assert [(d[2], d[3]) for d in deps if d[4] == "imports"] == [(None, "os, sys as s"), ("a.b", "c")] or deps[0][3] == "os, sys as s"
    assert {(d[1], d[3]) for d in deps if d[4] == "calls"} == {("m", "os.path.join"), ("m", "f"), (None, "x")}


@pytest.mark.parametrize(
    "language,source,want",
    [
        ("javascript", "class A {\n  run(x) {\n    go(x);\n  }\n}\nconst f = (a) => {\n  a.b();\n};\n", [("A", "class"), ("run", "method"), ("f", "function")]),
        ("go", "package p\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) Do(a int) {\n\tt.x(a)\n}\n\nfunc Free() {}\n", [("T", "struct"), ("Do", "method"), ("Free", "function")]),
        ("java", "public class A {\n    private int go(int x) {\n        return f(x);\n    }\n}\n", [("A", "class"), ("go", "method")]),
        ("c", "struct S {\n  int a;\n};\n\nstatic int add(int a, int b) {\n  return a + b;\n}\n", [("S", "struct"), ("add", "function")]),
    ],
)
def test_other_languages(language, source, want):
    assert [(s[0], s[1]) for s in extract(source, language)[0]] == want


def test_rows(spark):
    files = spark.createDataFrame([("a.rs", RUST), ("b.txt", "x"), ("c.py", None), ("d.py", "def ("), ("e.go", "")], "path string, source string")
    assert extract_symbols(files).count() == 5
    assert extract_deps(files).where("kind = 'calls'").count() == 3


SEVERAL = """impl Db {
    pub fn upsert(
        &mut self,
        path: &str,
        rows: &[(String, u8)],
    ) -> Result<usize> {
        self.run(
            path,
        )
    }

    fn walk<T>(&self, x: T) -> usize
    where
        T: Clone,
    {
        go(x)
    }
}

fn last() {}
"""


@pytest.mark.parametrize(
    "language,source,want",
    [
        ("rust", SEVERAL, [("Db", "impl", 1, 18, None), ("upsert", "method", 2, 10, "Db"), ("walk", "method", 12, 17, "Db"), ("last", "function", 20, 20, None)]),
        ("java", "class A {\n    public int go(\n            int x,\n            String y)\n            throws IOException {\n        return f(\n            x);\n    }\n}\n", [("A", "class", 1, 9, None), ("go", "method", 2, 8, "A")]),
        ("c", "static int\nadd(int a,\n    int b)\n{\n  return a;\n}\nint sub(int a,\n        int b)\n{\n  return g(a,\n    b);\n}\n", [("sub", "function", 7, 12, None)]),
        ("go", "func Do(\n\ta int,\n\tb string,\n) error {\n\treturn f(a)\n}\n", [("Do", "function", 1, 6, None)]),
        ("typescript", "export async function load(\n  a: string,\n  b = 2,\n): Promise<void> {\n  go(a);\n}\n", [("load", "function", 1, 6, None)]),
    ],
)
def test_declarations_over_several_lines(language, source, want):
    symbols, deps = extract(source, language)
    assert names(symbols) == want
    assert all(d[4] == "calls" for d in deps) and (language != "rust" or ("upsert", "self.run") in {(d[1], d[3]) for d in deps})


def test_signature_goes_up_to_the_body():
    symbols, _ = extract(SEVERAL, "rust")
    assert symbols[1][4] == "pub fn upsert(\n        &mut self,\n        path: &str,\n        rows: &[(String, u8)],\n    ) -> Result<usize>" and symbols[2][4].endswith("T: Clone,")

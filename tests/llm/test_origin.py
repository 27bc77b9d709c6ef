import random

import numpy as np

from quarrystone.llm import origin
from quarrystone.llm.repair import grammars

rng = random.Random(4)
WORDS = [f"{a}{b}" for a in ("load", "store", "trim", "walk", "merge", "score") for b in ("Item", "Node", "Row", "Page", "Edge")]


def handwritten(seed):
    r = random.Random(seed)
    lines = []
    for k in range(r.randint(6, 12)):
        lines.append(f"function {r.choice(WORDS)}{chr(65 + k)}x(arg, {r.choice('abc')}) {{")
        lines += [f"  const {r.choice(WORDS).lower()} = {r.choice(WORDS)}(arg, '{r.choice(WORDS)} {r.choice(WORDS)}');" if r.random() < 0.5 else f"  if (arg.{r.choice(WORDS)} > {r.randint(1, 99)}) return {r.choice(WORDS)};" for _ in range(r.randint(3, 9))]
        lines.append("}")
    return "\n".join(lines)


GENERATED = "// @generated by tool\n" + "\n".join(f"int get_item_{k}(const struct raw *m) {{ return m->slots[{k}]; }}" for k in range(30))
MINIFIED = "".join(f"function {chr(97 + k % 26)}{k}(b){{return b.x?b.y({k}):z}}var {chr(97 + k % 26)}=[b,void 0];" for k in range(60))
TABLE = "var t = [\n" + "\n".join("  " + ", ".join(str(rng.randint(1, 99999)) for _ in range(8)) + "," for _ in range(40)) + "\n];"


def test_repeated_period_is_reused_and_random_is_not():
    period = np.array([1, 2, 3, 4, 5, 6] * 20, np.uint64)
    noise = np.arange(100, 220, dtype=np.uint64)
    g = grammars(np.concatenate([period, noise]), np.repeat([0, 1], [120, 120]), np.zeros(240, bool))
    assert g["reused"][:120].mean() > 0.85 and not g["reused"][120:].any()
    assert (g["own"] == 1).sum() == 120 and (g["own"] == 0).sum() < 20
    assert g["length"][g["own"] == 0].sum() == 120
    empty = grammars(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
    assert len(empty["reused"]) == 0


def test_same_content_has_same_phrases():
    a = np.array([random.Random(1).randint(0, 2**60) for _ in range(500)], np.uint64)
    both = np.concatenate([a, [np.uint64(7)] * 13, a]).astype(np.uint64)
    own, size, h = origin._phrases(both, np.repeat([0, 1], [500, 513]))
    assert size.sum() == 1013
    first, second = set(h[own == 0].tolist()), set(h[own == 1].tolist())
    assert len(first & second) / len(first) > 0.9


def test_origins(spark, rows):
    copy = handwritten(99)
    texts = {
        "a/x/gen.c": GENERATED, "a/x/min.js": MINIFIED, "a/x/data.py": TABLE, "a/lib/copy.js": "// header\n" + copy, "b/lib/copy.js": copy, "a/x/hand.js": handwritten(1), "b/x/hand2.ts": handwritten(2),
        "b/x/readme.md": GENERATED, "b/x/conf.json": TABLE, "b/x/empty.go": "", "b/x/tiny.go": "package a", "b/notindexed.c": GENERATED,
    }
    chunks = [(k, p, "file", 1, t) for k, (p, t) in enumerate(texts.items())]
    chunks += chunks[:2] + [(90, None, "file", 1, GENERATED), (91, "b/x/hand2.ts", "file", None, None)]
    df = spark.createDataFrame(chunks, "id long, path string, kind string, line_start int, source string")
    files = spark.createDataFrame([(p,) for p in texts if p != "b/notindexed.c"] * 2 + [(None,)], "path string")
    assert rows(origin.origins(df, files)) == [("a/lib/copy.js", "vendored"), ("a/x/data.py", "data"), ("a/x/gen.c", "generated"), ("a/x/min.js", "minified"), ("b/lib/copy.js", "vendored")]
    assert origin.origins(df.where("false"), files).count() == 0


def test_copy_inside_one_repo_is_not_vendored(spark):
    df = spark.createDataFrame([(1, "a/1.js", "file", 1, handwritten(5)), (2, "a/2.js", "file", 1, handwritten(5))], "id long, path string, kind string, line_start int, source string")
    assert origin.origins(df, df.select("path")).count() == 0


def test_text_from_parts():
    parts = [{"kind": "method", "line_start": 2, "id": 2, "source": " m()"}, {"kind": "class", "line_start": 1, "id": 1, "source": "class A {\n m()\n}"}, {"kind": "function", "line_start": 9, "id": 3, "source": "f()"}]
    assert origin.whole_text(parts) == "class A {\n m()\n}\nf()"


def test_only_configuration_and_documentation_are_left_out(spark, rows):
    texts = {"a/x/bundle.min": MINIFIED, "a/x/gen.sql": GENERATED, "a/x/gen.KTS": GENERATED, "a/x/c.TOML": TABLE, "a/x/.env": TABLE, "a/x/notes.rst": GENERATED}
    df = spark.createDataFrame([(k, p, "file", 1, t) for k, (p, t) in enumerate(texts.items())], "id long, path string, kind string, line_start int, source string")
    assert rows(origin.origins(df, df.select("path"))) == [("a/x/bundle.min", "minified"), ("a/x/gen.KTS", "generated"), ("a/x/gen.sql", "generated")]


def test_grammar_goes_to_the_end_of_repeats():
    doubled = np.array([1, 2], np.uint64)
    for _ in range(15):  # 2**16 symbols, one rule a level
        doubled = np.concatenate([doubled, doubled])
    g = grammars(doubled, np.zeros(len(doubled), np.int64), np.zeros(len(doubled), bool))
    assert len(g["symbol"]) <= 3 and g["length"].sum() == len(doubled) and len(g["rules"]) <= 20


def test_data_in_strings_of_any_form_and_constants_by_hand(spark):
    import base64

    noise = lambda n, seed: base64.b64encode(random.Random(seed).randbytes(n)).decode()
    words = ["".join(random.Random(k).choices("abcdefghijklmnop", k=5)) for k in range(3000)]
    texts = {
        "a/x/one.py": f'BLOB = "{noise(3000, 1)}"\n', "a/x/triple.py": 'BLOB = """\n' + "\n".join(noise(57, k) for k in range(60)) + '\n"""\n', "a/x/tick.js": f"const b = `{noise(2000, 3)}`;\n",
        "a/x/list.go": "var w = []string{" + ", ".join(f'"{w}"' for w in words) + "}\n", "a/x/same.c": "int t[] = {" + "1, 0, " * 900 + "};\n",
        "a/x/hand.py": "\n".join(f'# the {w} of a lease, as agreed with the owners of the queue\n{w.upper()}_LIMIT = {k}\nNAME_{w.upper()} = "{w}"' for k, w in enumerate(words[:60])),
    }
    df = spark.createDataFrame([(k, p, "file", 1, t) for k, (p, t) in enumerate(texts.items())], "id long, path string, kind string, line_start int, source string")
    got = {r["path"]: r["origin"] for r in origin.origins(df, df.select("path")).collect()}
    assert {p for p, o in got.items() if o == "data"} == {"a/x/one.py", "a/x/triple.py", "a/x/tick.js", "a/x/list.go"} and "a/x/hand.py" not in got

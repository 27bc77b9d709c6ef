"""Short texts that are, and are not, well-formed: (language, text)."""

VALID = [
    ("java", "public record Point(int x, int y) implements Shape { public Point { if (x < 0) throw new IllegalArgumentException(); } static Point zero() { return new Point(0, 0); } }"),
    ("java", "class A { int f(Object o) { return switch (o) { case Integer i when i > 3 -> i; case String s -> s.length(); case null, default -> { yield 0; } }; } }"),
    ("java", "class A { boolean f(Object o) { return o instanceof String s && !s.isEmpty(); } }"),
    ("java", "sealed interface S permits A, B {}\nfinal class A implements S { private final Map<String, List<int[]>> m = new HashMap<>(); }"),
    ("java", "@Override public <T extends Comparable<T>> T max(List<? extends T> xs) throws IOException { for (var x : xs) { xs.forEach(y -> System.out.println(y)); } return null; }"),
    ("java", "enum E { A(1) { int f() { return 2; } }, B(2); private final int v; E(int v) { this.v = v; } int f() { return v; } }"),
    ("java", "class T { static { x = 1; } int[] a = {1, 2, 3}; int[][] b = new int[3][]; Runnable r = Foo::bar; void g() { try (var s = open(); var t = open()) { s.run(); } catch (A | B e) { } finally { } outer: for (;;) { break outer; } } }"),
    ("java", "@interface Ann { int value() default 3; String[] names() default {}; }"),
    ("java", 'class T { String s = """\n  a "quoted" text\n  """; int x = a > b ? c : d; int y = (int) z; long w = (long) (a + b); }'),
    ("c", "struct flags { unsigned int a : 3; unsigned b : 1; int : 0; };"),
    ("c", "static int f(void) __attribute__((noreturn));\nint g(int x) __attribute__((unused)) { return x; }"),
    ("c", "void f(void) { struct point p = (struct point){ .x = 1, .y = 2 }; draw((int[]){1, 2, 3}, 3); }"),
    ("c", "typedef int (*cmp_fn)(const void *, const void *);\nstatic cmp_fn table[4] = { [0] = a, [1] = b };\nint (*get(int x))(int) { return 0; }"),
    ("c", "int main(int argc, char **argv) { for (int i = 0, j = 1; i < 3; i++, j--) { if (a[i] & 1) continue; else goto out; } do { x--; } while (x > 0); out: return sizeof(struct s) + sizeof x; }"),
    ("c", "switch (x) { case 1: case 2: { y = 1; break; } default: break; }"),
    ("c", "union u { int a; struct { char b; float c; }; } v, *w;\nextern const char *const names[];\nenum e { A = 1, B, C = A << 2, };"),
    ("c", "#define MAX(a, b) ((a) > (b) ? (a) : (b))\n#ifdef X\nint x = 0x1FuLL;\n#endif\nchar c = '\\n', *s = \"a\" \"b\";"),
    ("cpp", "auto f = [&](int a, auto b) mutable -> int { return a + b; };\nauto g = [this, x = std::move(y)] { return x; };"),
    ("cpp", "enum class Color : uint8_t { Red, Green = 3 };\nenum Plain : int;"),
    ("cpp", "int x = static_cast<int>(y); auto p = dynamic_cast<const Base *>(q); auto v = reinterpret_cast<uint8_t*>(&z);"),
    ("cpp", "template <typename T, int N = 3> class Box : public Base<T>, private Other { public: explicit Box(T v) : value_(std::move(v)), n_{N} {} ~Box() override = default; Box &operator=(const Box &) = delete; T operator()(int i) const noexcept { return value_; } private: T value_; std::vector<std::map<int, T>> all_; };"),
    ("cpp", "namespace a::b { using std::vector; using V = std::vector<int>; template <class... Ts> void f(Ts &&...ts) { (g(std::forward<Ts>(ts)), ...); } }"),
    ("cpp", "for (const auto &[k, v] : table) { if (auto it = m.find(k); it != m.end()) std::cout << it->second << std::endl; }\ntry { throw std::runtime_error(\"x\"); } catch (const std::exception &e) { } catch (...) { }"),
    ("cpp", "if constexpr (N > 3) { return new int[3]{1, 2, 3}; } else { delete[] p; }\nstd::unique_ptr<Foo> p = std::make_unique<Foo>(1, \"a\");"),
    ("cpp", "auto r = R\"(raw \" text)\";\nint Foo::bar(int a) const { return this->a_ + a; }\nFoo::Foo(int a) : a_(a) {}"),
    ("go", "func Map[T, U any](xs []T, f func(T) U) []U { out := make([]U, 0, len(xs)); for _, x := range xs { out = append(out, f(x)) }; return out }"),
    ("go", "func f(x interface{}) string {\n\tswitch v := x.(type) {\n\tcase int, int64:\n\t\treturn \"int\"\n\tcase *T:\n\t\treturn v.name\n\tcase nil:\n\t\treturn \"\"\n\tdefault:\n\t\treturn fmt.Sprint(v)\n\t}\n}"),
    ("go", "type Number interface {\n\t~int | ~float64\n\tString() string\n}\n\ntype List[T Number] struct {\n\thead *node[T]\n\tn    int `json:\"n,omitempty\"`\n\tsync.Mutex\n}"),
    ("go", "func (s *Store[K, V]) Get(key K) (v V, ok bool) {\n\tif e, found := s.m[key]; found && !e.gone {\n\t\treturn e.v, true\n\t}\n\treturn\n}"),
    ("go", "select {\ncase m := <-in:\n\tout <- m\ncase <-time.After(3 * time.Second):\n\treturn\ndefault:\n}\ngo func() { defer wg.Done(); work() }()"),
    ("go", "var x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\nfor i := 0; i < 3; i++ {\n\tx[\"a\"][i] += 1\n}\nouter:\nfor {\n\tbreak outer\n}"),
    ("rust", "fn f(n: u32) -> &'static str { match n { 0 => \"a\", n @ 1..=5 if n > 2 => \"b\", 6 | 7 => { g(); \"c\" } _ => \"d\" } }"),
    ("rust", "fn f() { 'outer: loop { 'inner: for i in 0..10 { if i == 3 { continue 'outer; } else { break 'inner; } } break; } }"),
    ("rust", "fn f() { let v = vec![1, 2, 3]; println!(\"{} {:?}\", v.len(), v); let w = vec![0u8; 10]; assert_eq!(v[0], 1, \"x {}\", 2); }"),
    ("rust", "impl<'a, T: Clone + 'a> Iterator for It<'a, T> where T: Debug { type Item = &'a T; fn next(&mut self) -> Option<Self::Item> { self.xs.get(self.i).map(|x| { self.i += 1; x }) } }"),
    ("rust", "pub async fn run(&self, path: impl AsRef<Path>) -> Result<Vec<(String, usize)>, Box<dyn Error + Send>> { let x = self.db.lock().await?.get::<_, i64>(0)?; if let Some(y) = x.checked_add(1) { return Ok(vec![(\"a\".into(), y as usize)]); } Err(\"no\".into()) }"),
    ("rust", "#[derive(Debug, Clone)]\npub struct A<T> { pub(crate) x: HashMap<String, Vec<T>>, y: [u8; 4], f: Box<dyn Fn(&str) -> bool> }\n#[cfg(test)]\nmod tests { use super::*; #[test] fn t() { let A { x, .. } = a; let Some(z) = x.get(\"a\") else { panic!(\"no\") }; } }"),
    ("rust", "const X: &[&str] = &[\"a\", \"b\"];\nstatic Y: Lazy<Mutex<i32>> = Lazy::new(|| Mutex::new(0));\nuse std::{collections::{HashMap, HashSet as Set}, io::{self, Read}};\nenum E { A(i32), B { x: u8 }, C = 3 }"),
    ("rust", "fn f(a: &mut [f32]) -> bool { let s: String = a.iter().map(|x| x.to_string()).collect::<Vec<_>>().join(\",\"); let r = if s.is_empty() { 1 } else { 2 } + 3; while let Some(x) = it.next() { *x += 1; } !matches!(r, 1 | 2) && (s, r) == (t, 4) }"),
    ("javascript", "const a = b?.c?.[0]?.(1) ?? d;\na ||= 3; a ??= 4;"),
    ("javascript", "class A extends B { #x = 1; static #y; static { init(); } get x() { return this.#x; } *gen() { yield* other(); } async *[Symbol.asyncIterator]() { } static async load(a = 1, { b, c = 2 }, ...rest) { super.load(); } }"),
    ("javascript", "function* g() { const x = yield 1; yield; return x; }\nasync function f() { for await (const x of g()) { await x; } }"),
    ("javascript", "export default async function main() {}\nexport { a as b, c } from './d.js';\nimport x, { y as z } from 'w';\nimport * as q from \"r\";\nexport * from './s';"),
    ("javascript", "const { a, b: { c = 1 }, ...rest } = obj, [d, , e = 2, ...f] = arr;\nconst g = { a, b() { return 1; }, get c() { return 2; }, [k]: 3, 'x-y': 4, async z() {}, ...rest };"),
    ("javascript", "const re = /a[/]b/gi.test(s) ? `x ${a + `y ${b}`} z` : (x) => ({ v: x });\nlabel: for (const k in o) { if (!k) continue label; }\nnew Foo().bar()\n(function () { return typeof a === 'undefined' })()"),
    ("javascript", "try { a() } catch { b() } finally { c() }\nswitch (x) { case 'a': { y(); break } default: z() }\nif (a) b(); else if (c) d(); else { e() }"),
    ("javascript", "const App = () => <div className=\"x\" {...p}>{items.map(i => <Item key={i.id} v={i} />)} text, and more</div>;"),
    ("typescript", "@Component({ selector: 'app' })\nexport class A<T extends object = {}> implements B<T>, C { @Input() name!: string; private readonly x?: number = 1; constructor(private a: string, public readonly b = 2) { super(); } get v(): T | undefined { return this.#v as T; } abstract f(): void; static g<K>(this: A, k: K): k is K { return true; } [key: string]: unknown; }"),
    ("typescript", "type F<T> = T extends (...args: infer A) => infer R ? [A, R] : never;\ntype M = { readonly [K in keyof T]?: T[K] };\ntype U = 'a' | 'b' | `x-${string}`;\ntype G = typeof x[number]['y'];"),
    ("typescript", "const id = <T,>(x: T): T => x;\nconst f = async <K extends keyof T>(k: K, ...rest: string[]): Promise<T[K]> => { return (await g<T>(k))!; };"),
    ("typescript", "interface I extends A, B<C> { (x: number): string; new (y: string): I; readonly z: Array<{ a: number; b?: string }>; m?(a?: string): void; [k: string]: any }\nenum E { A = 1, B = 'x', C }\ndeclare module 'm' { export function f(a: number): void; }\nnamespace N { export const x = 1; }"),
    ("typescript", "export type { A } from './a';\nimport type { B } from './b';\nexport const x = { a: 1 } as const satisfies Y;\nfunction over(a: string): void;\nfunction over(a: number): void;\nfunction over(a: any) { let v = <any>a; return v!.x; }\nfunction assertIsA(x: unknown): asserts x is A { }"),
    ("typescript", "const el = <Foo<string> a={1} onClick={() => go(1)}>hi {name}</Foo>;\nlet t: [a: string, b?: number, ...rest: boolean[]] = ['x'];\nabstract class Q { protected abstract readonly n: number; declare foo: string; }"),
    ("python", "def f(a, /, b: int = 1, *, c) -> None:\n    match a:\n        case [1, *rest] if rest: pass\n        case _: return (x := b)\n"),
]
INVALID = [
    ("rust", "use a::::b::*c;"), ("rust", "fn f() { a b c }"), ("rust", "fn f() { let x = ; }"), ("rust", "fn f( { }"), ("rust", "match x { 1 => 2 3 => 4 }"), ("rust", "struct A { x: , }"),
    ("typescript", "let m: Map<string,,> = x;"), ("typescript", "class A { x: = 3 }"), ("typescript", "const a = (b, => c;"), ("typescript", "interface I { a: string b: }"),
    ("javascript", "function f( { return 1; }"), ("javascript", "const = 3;"), ("javascript", "if (a { b() }"), ("javascript", "let x = {a: 1, b: };"), ("javascript", "class A { f() { return 1; }"),
    ("java", "int f() { int a = 1; flush() }"), ("java", "class A { void f() { foo(; } }"), ("java", "class A { int x = 3 int y; }"), ("java", "class A { void f() { if x > 3 { } } }"), ("java", "class A { void f() { a.b(1) c.d(2); } }"),
    ("c", "void f(void) { if (x) { foo() } }"), ("c", "int f(void) { foo() }"), ("c", "int x = ;"), ("c", "struct a { int b }"), ("c", "int f(int a, ) { return 1 }"), ("c", "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b"),
    ("cpp", "class A { void f( { } };"), ("cpp", "std::vector<int> v = {1, 2"), ("cpp", "int f() { return 1 }"), ("cpp", "for (int i = 0; i < 3) { }"),
    ("go", "func f() { x := }"), ("go", "func f( { }"), ("go", "if x { else { }"), ("go", "type T struct { a, }"), ("go", "for i := 0; i < 3 { }"), ("go", "func f() { a b c }"),
    ("python", "def f(:\n  pass"), ("python", "print 'x'"),
]

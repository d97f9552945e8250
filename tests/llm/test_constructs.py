"""Constructs that a grammar has to take, and mistakes that it has to refuse."""

import pytest

from codequarry.llm import grammar

VALID = {
    "JavaScript": [
        "class A { static { A.x = 1; } static {} }\nlet y = x => x;\n", "const g = function* () { yield 1; };\n", "const o = { *[Symbol.iterator]() { yield* this.xs; }, async *f() {} };\n", "export * as x from './x';\n",
        "const s = `a ${b ? `c ${d}` : `e`} f`;\n", "x = a\n  ? b\n  : c;\n", "for await (const x of xs) { }\n", "if (a) b();\nelse if (c) d();\nelse e();\n", "const r = x / 2 / y, q = /a[/]b/.test(z);\n",
        "import d, * as ns from \"x\";\n", "export const f = async (x) => { await x; };\n", "do { x(); } while (y)\n", "a?.[0]?.(b);\n", "try { a(); } finally { b(); }\n", "export { a as b, c };\n", "class A { #p = 1; get #q() { return this.#p; } static async f() {} 'x y'() {} }\n",
    ],
    "Java": [
        "public sealed interface Shape permits Circle, Square { }\n", "non-sealed class A implements Shape { }\n", "module a.b {\n  requires java.sql;\n  requires transitive x.y;\n  exports a.b.c to d.e;\n  opens f;\n  uses g.H;\n  provides i.J with k.L, m.N;\n}\n",
        "class A { int f(Object o) { return switch (o) { case Circle c when c.r() > 0 -> 1; case Square(int x, int y) -> x + y; case null, default -> 0; }; } }\n", "class A { boolean f(Object o) { return o instanceof Point(int x, var y) && x > 1; } }\n",
        "record P(int x) { P { if (x < 0) throw new E(); } }\n", "class A { void f() { if (a) b(); else if (c) d(); else { e(); } do { x(); } while (y); } }\n", "class A<T extends Comparable<? super T>> { Map<String, List<Map<K, V>>> m = new HashMap<>(); }\n",
        "class A { String s = \"\"\"\n  a \"b\" c\n  \"\"\"; }\n", "enum E { A { int f() { return 1; } }, B; abstract int f(); }\n", "@interface N { int x() default 1; String[] y() default {}; }\n",
    ],
    "C": [
        "void f(void) { list_for_each(a, b) { g(a); } }\n", "int f(int x) { switch (x) { case 1 ... 5: return 1; default: return 0; } }\n", "int f(void) { int y = ({ int z = g(); z + 1; }); return y; }\n", "void f(void) { asm volatile (\"nop\" : \"=r\"(x) : \"r\"(y), [z] \"m\"(w) : \"memory\"); __asm__(\"cli\"); }\n",
        "int add(a, b) int a; int b; { return a + b; }\n", "void (*signal(int sig, void (*func)(int)))(int) { return 0; }\n", "static int __init foo_init(void) { return 0; }\nmodule_init(foo_init);\n", "struct s { int x; } __attribute__((packed));\n", "int x __attribute__((unused)) = 3;\n",
        "typeof(x) y = x;\n", "void f(void) { if (a) b(); else if (c) d(); else e(); do x(); while (y); }\n", "static void (*const table[])(void) = { a, b };\n", "int f(void) { if (a) do x(); while (y); else z(); return 0; }\n", "int main() { goto *p; }\n", "TEST(a, b) { c(); }\n", "_Static_assert(sizeof(int) == 4, \"x\");\n", "char *s = \"a\" \\\n  \"b\";\n", "int f(const void *, unsigned int);\n", "int (*cmp)(const void *, const void *);\n",
        "void *p = (void (*)(int))q;\n",
    ],
    "Go": [
        "package a\ntype N interface {\n\t~int | ~int64 | string\n}\n", "package a\nfunc f() {\n\tfor _, t := range []struct{ a int }{{1}, {2}} {\n\t\tg(t)\n\t}\n}\n", "package a\nfunc M[K comparable, V int | string](m map[K]V) {}\n", "package a\nfunc f() {\n\tif err := g(); err != nil {\n\t} else if x {\n\t} else {\n\t}\n}\n",
        "package a\ntype T[K any] struct {\n\tx K\n}\nfunc (t *T[K]) F() K { return t.x }\n", "package a\nvar x = []*T{{A: 1}, nil}\n", "package a\nfunc f() (x <-chan int, y chan<- int) { return }\n", "package a\nfunc f() {\n\tswitch {\n\tcase a > b, c:\n\t\tfallthrough\n\tdefault:\n\t}\n}\n", "package a\nfunc f() {\n\tvar p *int = &x\n\t*p = 1\n\tp2 := (*T)(nil)\n\t<-ch\n\tgo func() {}()\n}\n",
        "package a\nfunc f() {\n\tfor _, x := range []string{\"a\"} {\n\t}\n\tfor range 10 {\n\t}\n}\n",
    ],
    "PHP": [
        "<?php\nuse A\\{B, C as D};\nuse function A\\f;\n", "<?php\nclass X { use T, U { T::f insteadof U; U::f as protected g; } }\n", "<?php\nfunction g() { yield 1; yield $k => $v; $x = yield $y; yield from h(); yield; }\n", "<?php\nenum S: string { case A = 'a'; case B = 'b'; public function f(): string { return $this->value; } }\n",
        "<?php\nif ($a): b(); elseif ($c): d(); else: e(); endif;\n", "<?php\n#[A(1)]\nfinal class X { public function __construct(private readonly int $x = 0) {} }\n", "<?php\n$x = <<<EOT\n  a $b {$c['d']}\n  EOT;\n$f = fn(int ...$x): int => $x[0] ?? 1;\n", "<?php\nif ($a) b(); else if ($c) d(); else e();\nforeach ($a as [$x, $y]) {}\ntry { a(); } catch (E) { } finally { }\n",
        "<?php\nfunction f(?int $x, A|B $y, A&B $z): static {}\n$o?->p()?->q;\nA::class;\nnew class { };\n$a = ['x' => 1, ...$b];\n",
    ],
    "Ruby": [
        "x = \"a #{h[\"k\"]} #{y ? \"b #{z}\" : 'c'}\"\n", "foo(<<~A, <<~B)\n  one\nA\n  two\nB\n", "case x\nin {name: String => n, age:}\n  p n\nin [a, *] if a > 1\n  p a\nin nil | 1\n  p 2\nend\n", "undef foo\nalias bar baz\nalias :a :b\n", "def ==(o) = x == o.x\ndef +(o) = P.new(x + o.x)\ndef q? = true\n", "def f(...) = g(...)\n",
        "puts /ab c/.match?(x)\ny = a / b / c\n", "%r{a{2}/b}.match(x)\nw = %w[a b]\n", "x = if a then b else c end\n", "def f\n  g\nrescue A, B => e\n  h\nelse\n  i\nensure\n  j\nend\n", "while x do y end\nuntil a\n  b\nend\n", "foo \"a\" \\\n  \"b\"\n", "a = [1, 2,\n  3]\nh = { a: 1, 'b' => 2, **c }\n", "class << self\n  attr_reader :x\nend\n", "x = a.map do |y|\n  y + 1\nend\n", "loop { |a, (b, c)| break if a }\n",
        "foo.each_with_index { |x, i| puts x unless i.zero? }\n", "private def f(a, b: 1, **o, &k); end\n", "begin\n  x\nend while y\n",
    ],
    "Lua": ["local function f(...)\n  local a <const> = select('#', ...)\n  return a, ...\nend\n", "for i = 1, 10 do if i > 2 then goto out end end\n::out::\n", "t = { [1] = 2, a = function() end, 'x'; y }\n", "repeat x = x - 1 until x < 0 or f(function() return 1 end)\n", "local s = [==[ a ]] b ]==]\n", "a.b['c']:d { 1 } 'x'\n"],
    "Python": ["match x:\n    case {'a': 1, **r}:\n        pass\n", "async def f():\n    async with a as b, c:\n        yield\n", "x = f'{a!r:>{w}}'\n"],
}
INVALID = {
    "JavaScript": ["else { x(); }\n", "if (a) { b(); } c(); else { d(); }\n", "try { a(); }\n", "let x = ;\n", "foo(1, 2;\n", "class A { f( { } }\n", "var a b;\n", "`a ${b\n", "x = /[a;\n", "catch (e) { }\n"],
    "Java": ["class A { void f() { else x(); } }\n", "class A { int x y; }\n", "class A { void f() { try { } } }\n", "class A { void f() { int = 3; } }\n", "class A {\n", "class A { void f( { } }\n"],
    "C": ["int x y;\n", "void f(void) { else x(); }\n", "void f(void) { int y = ; }\n", "int f(void) { return 1 }\n", "struct { int x }\n", "/* never\nint x;\n", "void f(void) { \"abc; }\n"],
    "Go": ["package a\nfunc f() { else { } }\n", "package a\nfunc f() { x := }\n", "func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nvar s = `abc\n"],
    "PHP": ["<?php\nelse { x(); }\n", "<?php\ntry { a(); }\n", "<?php\n$x = ;\n", "<?php\nfunction f( { }\n", "<?php\n$x = 'abc;\n", "<?php\n$x = <<<EOT\nabc\n"],
    "Ruby": ["end\n", "def f\n  x\nend\nend\n", "def f\n  x\n", "x = [1, 2\n", "foo(1 2)\n", "class A\n  def b\nend\n", "x = \"a #{b\n", "if a\n  b\n"],
    "Lua": ["end\n", "if x then y() \n", "local = 3\n", "f(1, )\n", "x = [[ a\n", "for i = 1 do end\n", "return 1 x = 2\n"],
    "Python": ["def f(:\n    pass\n", "x = 'abc\n", "if x\n    y\n", "  x\n y\n"],
}


@pytest.mark.parametrize("language,code", [(x, c) for x, cs in VALID.items() for c in cs])
def test_takes(language, code):
    assert grammar.parses(code, language)
    assert grammar.findings(code, language)[:3] == (True, "valid", language)


@pytest.mark.parametrize("language,code", [(x, c) for x, cs in INVALID.items() for c in cs])
def test_refuses(language, code):
    assert not grammar.parses(code, language)

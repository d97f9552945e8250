import pytest

from codequarry.llm import grammar, lexers
from codequarry.llm.invalid import invalid_rates, parse_findings

NO_CODE = {
    'yaml': 'name: crate\nsteps:\n  - run: cursor\n  - run: build all of it\n',
    'html': '<!DOCTYPE html>\n<html><head><title>Not found</title></head>\n<body><h1>No such ticket</h1></body></html>\n',
    'md': '# record journal\n\nA small journal for every record.\n\n* install it\n* run it twice\n',
    'text': 'This is just a line of text.\nAnd another one.\n',
    'diff': '--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n',
    'log': '2024-01-01 12:00:00 INFO started\n2024-01-01 12:00:01 WARN slow\n',
    'lic': 'MIT License\n\nPermission is hereby granted, free of charge.\n',
}
CODE = {
    'JavaScript': (
        'const a = b ? c : d;\n'
        'let x = (a, b) => ({ a, b: 1, ...c });\n'
        'class A extends B { constructor(x) { super(x); this.y = x?.z ?? 1; } static async *gen() { yield 1; } get v() { return 1 } #p = 2; }\n'
        'export default A;\n'
        'import x, { y as z } from "q";\n'
        'for (const k of ks) { if (!k) continue; else break }\n'
        'switch (a) { case 1: b(); break; default: c() }\n'
        'try { a() } catch { b() } finally { c() }\n'
        'label: for (;;) { break label }\n'
        'var re = /ab+c/gi, t = `x ${a + `y`} z`;\n'
        'async function f({a, b = 2}, [c], ...rest) { await g(); }\n'
        '(function () { "use strict"; })();\n'
        'const o = { f() { return 1 }, get x() { return 2 }, [k]: 3, "s": 4, async g() {}, };\n'
        'new Foo(1).bar().baz;\n'
        'if (a) b(); else c()\n'
        'do { x++ } while (x < 3)\n'
        'a = b\n'
        '  .c()\n'
        '  .d()\n'
        'module.exports = { a, b };\n'
        'delete a.b; typeof x === "y"; void 0;\n'
        'throw new Error("x")\n'
    ),
    'Java': (
        'package a.b;\n'
        'import java.util.*;\n'
        'import static x.Y.z;\n'
        '@A(x = 1, y = {"a"})\n'
        'public final class A<T extends B & C> extends D<T> implements E, F<G<H>> {\n'
        '  private static final Map<String, List<int[]>> M = new HashMap<>();\n'
        '  int[] a = {1, 2}, b[];\n'
        '  static { a = 1; }\n'
        '  public A(int x) throws E1, E2 { super(x); this.x = x; }\n'
        '  <R> R f(Function<? super T, ? extends R> g, int... xs) { return g.apply(null); }\n'
        '  abstract void q();\n'
        '  enum X { A, B(1) { void f() {} }; int y; X() {} }\n'
        '  interface I { default int z() { return 1; } int w(); }\n'
        '  void m() {\n'
        '    for (int i = 0, j = 1; i < n; i++, j--) { }\n'
        '    for (final String s : list) System.out.println(s);\n'
        '    int r = a > b ? c : d < e ? 1 : 2;\n'
        '    Runnable t = () -> { x(); };\n'
        '    list.stream().map(x -> x + 1).filter((a, b) -> a).forEach(System.out::println);\n'
        '    try (R z = new R(); S q = s) { } catch (A | B e) { throw e; } finally { }\n'
        '    switch (x) { case 1: case 2: y(); break; default: z(); }\n'
        '    String u = switch (k) { case A, B -> "x"; default -> { yield "y"; } };\n'
        '    if (o instanceof String s && s.length() > 1) { }\n'
        '    Object o = (String) p; int c = (int) 3.5; long[] l = new long[10];\n'
        '    synchronized (this) { i++; }\n'
        '    Foo<Bar> f = new Foo<Bar>() { @Override public void run() { } };\n'
        '    label: while (true) { continue label; }\n'
        '    assert x > 0 : "m"; char ch = \'\\n\'; a >>>= 2; b = c >> 1; List<String>[] q = null; Class<?> k = int[].class;\n'
        '    do { } while (x); int h = 0x1F, b2 = 0b11; double dd = 1e-3f; ;\n'
        '  }\n'
        '}\n'
        'record P(int x, int y) { }\n'
    ),
    'C': (
        '#include <a.h>\n'
        '#define M(x) \\\n'
        '  ((x) + 1)\n'
        'typedef struct foo { int a; char *b[3]; unsigned c : 3; } foo_t;\n'
        'enum e { A, B = 2, };\n'
        'static const int tab[] = { 1, 2, [5] = 3 };\n'
        'int (*fp)(int, char *);\n'
        'extern void g(void);\n'
        'static inline unsigned long f(const char *s, struct foo *p, int n, ...) {\n'
        '  int i, *q = &n, arr[10] = {0};\n'
        "  for (i = 0; i < n; i++) if (s[i] == 'a') continue; else break;\n"
        '  while (*s++) ;\n'
        '  do { n--; } while (n > 0);\n'
        "  switch (n) { case 1: case 'x': return 2; default: break; }\n"
        '  p->a = (int) sizeof(struct foo) + sizeof n;\n'
        '  goto end;\n'
        '  foo_t z = (foo_t){ .a = 1, .b = { 0 } };\n'
        '  x = a ? b : c ? d : e;\n'
        '  printf("a" "b" PRIu64 "\\n", (unsigned long)x);\n'
        'end:\n'
        '  return -1;\n'
        '}\n'
        'int main(int argc, char **argv) { return f("x", NULL, 3) & ~0x1fUL; }\n'
        'void fn(int), *gp;\n'
    ),
    'Go': (
        'package main\n'
        '\n'
        'import (\n'
        '\t"fmt"\n'
        '\tx "a/b"\n'
        ')\n'
        '\n'
        'const (\n'
        '\tA = iota\n'
        '\tB\n'
        ')\n'
        'var m = map[string][]int{"a": {1, 2}, "b": nil}\n'
        'type T struct {\n'
        '\tA int `json:"a"`\n'
        '\tB, C *string\n'
        '\tsync.Mutex\n'
        '}\n'
        'type I interface {\n'
        '\tF(x int) (int, error)\n'
        '\tfmt.Stringer\n'
        '}\n'
        'type F func(int) string\n'
        'func (t *T) M(a, b int, cs ...string) (n int, err error) {\n'
        '\tif x, ok := m["a"]; ok && len(x) > 0 {\n'
        '\t\treturn 1, nil\n'
        '\t} else if y {\n'
        '\t}\n'
        '\tfor i := 0; i < 10; i++ {\n'
        '\t}\n'
        '\tfor k, v := range m {\n'
        '\t\t_ = k\n'
        '\t\t_ = v\n'
        '\t}\n'
        '\tfor {\n'
        '\t\tbreak\n'
        '\t}\n'
        '\tswitch v := x.(type) {\n'
        '\tcase int, string:\n'
        '\t\tf()\n'
        '\tdefault:\n'
        '\t}\n'
        '\tselect {\n'
        '\tcase c <- 1:\n'
        '\tcase z := <-d:\n'
        '\t\tuse(z)\n'
        '\t}\n'
        '\tgo func() { f() }()\n'
        '\tdefer t.Close()\n'
        '\ta, b = b, a\n'
        '\tp := &T{A: 1}\n'
        '\tq := []byte("x")\n'
        '\tch := make(chan int, 3)\n'
        '\ts := a[1:2]\n'
        '\tfn := func(x int) int { return x }\n'
        '\treturn\n'
        '}\n'
        'func G[K comparable, V any](m map[K]V) []K { return nil }\n'
    ),
    'PHP': (
        '<?php\n'
        'declare(strict_types=1);\n'
        'namespace A\\B;\n'
        'use C\\D as E;\n'
        'use F\\{G, H};\n'
        'abstract class X extends Y implements Z, W\n'
        '{\n'
        '    use T1, T2;\n'
        '    const A = 1;\n'
        '    private ?int $x = null;\n'
        "    public static array $y = [1, 'a' => 2, ...$z];\n"
        '    public function __construct(private readonly int $a, ?string $b = null, int|float ...$c) { parent::__construct(); }\n'
        '    abstract protected function q(): ?string;\n'
        '}\n'
        'function f(array &$a, callable $cb = null): void {\n'
        '    foreach ($a as $k => $v) { echo $k, "x $v\\n"; }\n'
        '    foreach ($a as &$v) : continue; endforeach;\n'
        '    $f = function ($x) use (&$y) { return $x; };\n'
        '    $g = fn($x) => $x * 2;\n'
        '    $r = $a ?: $b ?? $c; $s = $x ? 1 : 2;\n'
        '    if ($a) : elseif ($b) : else : endif;\n'
        '    switch ($x) { case 1: break; default: return; }\n'
        '    try { throw new \\E("x"); } catch (A|B $e) { } finally { }\n'
        '    list($a, $b) = [1, 2]; [$c, $d] = $e;\n'
        '    $o->p()->q[0]::R; static::$y; $x = (int) $y; @f(); $z = &$w; global $h; static $st = 1;\n'
        "    $m = match(true) { $a > 1 => 'x', default => 'y' };\n"
        '    while ($i--): endwhile; for ($i = 0, $j = 1; $i < 3; $i++) {} isset($a[\'b\']) && exit; $v instanceof W; clone $q; print "x"; $x .= "y"; new class(1) extends B { };\n'
        '}\n'
        '?>\n'
        '<html></html>\n'
    ),
    'Ruby': (
        'require "a"\n'
        'module A\n'
        '  class B < C\n'
        '    include D\n'
        '    attr_accessor :x, :y\n'
        '    CONST = %w[a b].freeze\n'
        '    def initialize(a, b = 1, *c, d: 2, **e, &f)\n'
        '      @a, @b = a, b\n'
        '      super\n'
        '    end\n'
        '    def self.z; end\n'
        '    def q? = true\n'
        '    def each(&block)\n'
        '      return enum_for(:each) unless block_given?\n'
        '      @a.each do |x, y|\n'
        '        yield x if y\n'
        '      end\n'
        '    rescue ArgumentError, E => e\n'
        '      raise Foo, "x" unless e\n'
        '    ensure\n'
        '      close\n'
        '    end\n'
        '    private\n'
        '    def h\n'
        '      x = if a then 1 else 2 end\n'
        '      case v\n'
        '      when 1, 2 then p 3\n'
        '      when String\n'
        '        puts "a #{b} c"\n'
        '      else\n'
        '        nil\n'
        '      end\n'
        '      y = begin\n'
        '        1\n'
        '      end while z\n'
        '      h = { a: 1, "b" => 2, c: { d: 3 } }\n'
        '      foo(a, b: 1) { |q| q + 1 }\n'
        '      arr.map(&:to_s).select { |s| s =~ /x+/i }\n'
        '      a ||= b && !c\n'
        '      until a do b end\n'
        '      a ? b : c\n'
        '      -> (x) { x }\n'
        '      puts <<~T\n'
        '        text\n'
        '      T\n'
        '      [1, 2].inject(:+)\n'
        '      x = a +\n'
        '        b\n'
        '      foo.\n'
        '        bar\n'
        '      foo\n'
        '        .bar(1)\n'
        '        .baz\n'
        '      for i in 1..3 do p i end\n'
        '      alias_method :a, :b\n'
        '      a[1], b = 2, 3\n'
        '      not a\n'
        '      return 1, 2\n'
        '    end\n'
        '  end\n'
        'end\n'
    ),
    'Lua': (
        'local a, b = 1, "x"\n'
        'local t = { 1, 2; a = 3, ["b"] = function(x) return x end, }\n'
        'function M.a.b:c(...)\n'
        '  local x <const> = select("#", ...)\n'
        '  if a == 1 and not b then return end\n'
        '  for i = 1, 10, 2 do break end\n'
        '  for k, v in pairs(t) do print(k .. v) end\n'
        '  while true do x = x + 1 end\n'
        '  repeat local y = 1 until y > 0\n'
        '  do local z end\n'
        '  f{1} g"x" (h or j)(1):k()\n'
        '  t.x, t[1] = 1, 2\n'
        '  return function() end\n'
        'end\n'
        'goto l\n'
        '::l::\n'
        'return t\n'
    ),
    'Python': (
        'import os\n'
        '\n'
        '\n'
        'def f(a, *b, c=1, **d) -> int:\n'
        '    """Doc."""\n'
        '    if a:\n'
        '        return [x for x in b if x]\n'
        '    match a:\n'
        '        case 1 | 2:\n'
        '            pass\n'
        '    return f"{a!r}"\n'
    ),
}


@pytest.mark.parametrize("language", lexers.LANGUAGES)
def test_accepts(language):
    code = CODE[language]
    for text in (code, code.replace("\n", "\r\n"), "\ufeff" + code, "", " \n\n"):
        assert grammar.parses(text, language)
    assert grammar.diagnose(code, language) == (True, "valid", language)


@pytest.mark.parametrize("language", lexers.LANGUAGES)
@pytest.mark.parametrize("mark", list("(){}[]\""))
def test_a_lost_mark_is_found(language, mark):
    code = CODE[language]
    lexed = lexers.lex(code, language)
    inside = [(a + 1, b - 1) for a, b in lexed.strings] + lexed.comments
    spots = [i for i, c in enumerate(code) if c == mark and not any(a <= i < b for a, b in inside)]
    if language == "Ruby":  # calls do without parentheses, % is an operator too, and # begins a comment outside a literal
        spots = [i for i in spots if mark in "{}"]
    elif language == "Lua":
        spots = [i for i in spots if mark not in "()"]
    elif language == "C":  # what directives say is up to the preprocessor
        spots = [i for i in spots if i > code.index("typedef")]
    wrong = [i for i in spots if grammar.parses(code[:i] + code[i + 1 :], language)]
    assert len(wrong) <= 0.1 * len(spots), [code[max(0, i - 30) : i + 10] for i in wrong]


@pytest.mark.parametrize("language", lexers.LANGUAGES)
def test_rejects(language):
    for name, text in NO_CODE.items():
        assert not grammar.diagnose(text, language)[0], name
    code = CODE[language]
    torn = code + "\n<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n" if language != "PHP" else code.replace("?>", "<<<<<<< HEAD\n$a;\n=======\n$b;\n>>>>>>> x\n?>")
    assert not grammar.parses(torn, language)
    assert not grammar.parses(code.replace('"x"', "\u201cx\u201d", 1) if '"x"' in code else code + "\u201c", language)
    assert not grammar.parses(code + "\x01\ufffd", language) or language in ("PHP", "Ruby")


@pytest.mark.parametrize("language", lexers.LANGUAGES)
@pytest.mark.parametrize("said", lexers.LANGUAGES)
def test_wrong_extension(language, said):
    if language != said:
        valid, finding, parses_as = grammar.diagnose(CODE[language], said)
        assert (valid, finding, parses_as) == (False, "wrong_extension", language)


def test_findings(spark):
    rows = [(1, "r", "Go", CODE["Go"], "x"), (1, "r", "Go", CODE["Go"], "x"), (2, "r", "Go", CODE["Lua"], "x"), (3, "r", "Lua", "local", "x"), (4, None, "Lua", "", "x"), (5, "r", None, "x", "x"), (6, "r", "Lua", None, "x"), (7, "r", "TOML", "x", "x"), (None, "r", "Lua", "<<<<<<< a\n=======\n>>>>>>> b\n", "x")]
    df = spark.createDataFrame(rows, "file_id long, repo_name string, language string, content string, valid string")
    got = sorted((r.file_id or 0, r.valid, r.finding) for r in parse_findings(df, ["file_id"]).collect())
    assert got == [(0, False, "merge_conflict"), (1, True, "valid"), (1, True, "valid"), (2, False, "wrong_extension"), (3, False, "corrupt"), (4, True, "valid")]
    rates = {(r.repo_name, r.language): (r.n_files, r.n_invalid, r.rate) for r in invalid_rates(df, ["repo_name", "language"]).collect()}
    assert rates == {("r", "Go"): (3, 1, 1 / 3), ("r", "Lua"): (2, 2, 1.0), (None, "Lua"): (1, 0, 0.0)}
    assert parse_findings(df.limit(0), ["file_id"]).count() == 0
    with pytest.raises(ValueError):
        parse_findings(df, ["valid"])


@pytest.mark.parametrize("text,declared", [('foo(1)\nbar("x")', "Java"), ("x = 1\n", "Go"), ("x = y[0]\nprint(public, void, static)\n", "Java")])
def test_few_marks_are_parsed_by_all(text, declared):
    took = [x for x in lexers.LANGUAGES if x != declared and grammar.parses(text, x)]
    valid, finding, language = grammar.diagnose(text, declared)
    assert took and (valid, finding) == (False, "wrong_extension") and language in took


def test_corrupt_only_if_all_fail():
    for text in ("foo(1\n", "public void ) f {", "<<<<<<< a\nfoo(\n=======\nbar)(\n>>>>>>> b\n"):
        assert not any(grammar.parses(text, x) for x in lexers.LANGUAGES)
        assert {grammar.diagnose(text, x)[1] for x in lexers.LANGUAGES} == {"merge_conflict" if text[0] == "<" else "corrupt"}

"""Symbols of languages with braces, by small files written by hand."""

from lodestar.sources import declarations, files

TS = '''import { a, b as c } from "./lib/a";
import type { T } from 'types';
const fs = require("fs");
// class Ghost { run() {} }
/* function ghost() { } */
const text = "function fake() { }", tpl = `class X { ${1} `;

@Component({ selector: "x" })
export class Panel<T extends Base<T>> extends View<T> implements Shown, ui.Closed {
  private items: Map<string, number> = new Map();
  size = compute(3);
  constructor(private readonly api: Api) { super(); this.api.start(); }
  @Input() async load(id: string): Promise<{ ok: boolean }> {
    if (id) { return fetchAll(id); }
    const inner = (x) => { return wrap(x); };
    return inner(id);
  }
  handle = async (e: Event) => { emit(e); };
  get total(): number { return this.sum(1); }
}

export async function main(args: string[]): Promise<void> {
  const p = new Panel(args);
  function nested() { return deep(); }
  nested();
}
export const short = x => twice(x);
interface Shown extends Seen { show(): void; }
'''

GO = '''package store

import "fmt"
import (
	log "github.com/x/log"
	"net/http"
)

// func ghost() {}
type Base struct { ID int }

type Store[K comparable] struct {
	Base
	*sync.Mutex
	items map[string]interface{}
}

type Reader interface {
	Read(p []byte) (int, error)
}

func New(n int) *Store { return &Store{items: make(map[string]interface{})} }

func (s *Store[K]) Get(key string) interface{} {
	raw := `func fake() { }`
	f := func(x int) int { return helper(x) }
	fmt.Println(raw, f(1))
	return s.items[key]
}

func Map[T any](xs []T) []T { return apply(xs) }
'''

JAVA = '''package a.b;
import java.util.List;
import static org.x.Assert.*;

/** class Ghost { } */
@Service
public abstract class Shop<T> extends Base<T> implements Open, a.Closable {
    private final List<String> names = makeNames(3);
    public Shop(int n) { super(n); init(); }
    @Override
    public <R> List<R> all(Map<String, R> m) throws IOException {
        String s = "void fake() { }";
        for (String x : names) { use(x); }
        return Lists.of(new Item(1));
    }
    protected abstract int size();
    enum Kind { A, B; Kind next() { return step(); } }
    static class Part { void go() { run(); } }
}
record Point(int x, int y) { int sum() { return add(x, y); } }
'''


def found(language, text):
    return {r[2].removeprefix("m."): r for r in declarations.symbols(f"m.{language}", language, text)}


def edges(rows, name, kind):
    return [b for a, b in rows[name][8] if a == kind]


def test_typescript():
    got = found("typescript", TS)
    assert set(got) == {"m", "Panel", "Panel.constructor", "Panel.load", "Panel.load.inner", "Panel.handle", "Panel.total", "main", "main.nested", "short", "Shown"}
    assert edges(got, "m", "IMPORTS") == ["./lib/a", "fs", "types"]
    assert edges(got, "Panel", "INHERITS") == ["View", "Shown", "ui.Closed"] and edges(got, "Shown", "INHERITS") == ["Seen"]
    assert edges(got, "Panel.load", "CALLS") == ["fetchAll", "inner", "wrap"] and edges(got, "Panel.handle", "CALLS") == ["emit"]
    assert edges(got, "main", "CALLS") == ["Panel", "deep", "nested"] and edges(got, "Panel.total", "CALLS") == ["this.sum"]
    assert (got["Panel"][4], got["Panel"][5]) == (9, 20) and got["Panel"][6] == "m" and got["Panel.load"][6] == "m.Panel"
    assert "Input" in got["Panel.load"][7] and {r[3] for r in got.values()} == {"module", "class", "function"}


def test_go():
    got = found("go", GO)
    assert set(got) == {"m", "Base", "Store", "Reader", "New", "Store.Get", "Map"}
    assert edges(got, "m", "IMPORTS") == ["fmt", "github.com/x/log", "net/http"]
    assert edges(got, "Store", "INHERITS") == ["Base", "sync.Mutex"] and edges(got, "Reader", "INHERITS") == []
    assert edges(got, "Store.Get", "CALLS") == ["f", "fmt.Println", "helper"] and edges(got, "Map", "CALLS") == ["apply"]
    assert got["Store.Get"][6] == "m.Store" and (got["Store.Get"][4], got["Store.Get"][5]) == (24, 29)


def test_java():
    got = found("java", JAVA)
    assert set(got) == {"m", "Shop", "Shop.Shop", "Shop.all", "Shop.size", "Shop.Kind", "Shop.Kind.next", "Shop.Part", "Shop.Part.go", "Point", "Point.sum"}
    assert edges(got, "m", "IMPORTS") == ["java.util.List", "org.x.Assert.*"]
    assert edges(got, "Shop", "INHERITS") == ["Base", "Open", "a.Closable"]
    assert edges(got, "Shop.all", "CALLS") == ["Item", "Lists.of", "use"] and edges(got, "Shop.size", "CALLS") == []
    assert got["Shop.all"][7] == ["Override"] and got["Shop"][7] == ["Service"] and got["Shop.Part.go"][6] == "m.Shop.Part"


def test_damaged_empty_and_other_files_give_their_module():
    for language in ("typescript", "javascript", "go", "java"):
        for text in ("", "}}}} ) (", "class A {", "func (", "function f(", "/* open", "`open", "type T struct {", "x" * 100000, "class " * 20000, "f(" * 5000, "{" * 5000):
            rows = declarations.symbols("d/x.y", language, text)
            assert rows[0][2:4] == ("d.x", "module")
    assert declarations.symbols("a.rb", "ruby", "class X")[0][2] == "a"


def test_within_spark_with_null_content(spark):
    rows = [("a.ts", "typescript", TS), ("b.go", "go", GO), ("c.java", "java", JAVA), ("d.py", "python", None)]
    out = files.extract_symbols(spark.createDataFrame(rows, "path string, language string, content string")).collect()
    assert len(out) == 11 + 7 + 11 + 1 and {r["language"] for r in out} == {"typescript", "go", "java", "python"}

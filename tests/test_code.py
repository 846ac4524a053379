"""JavaScript, TypeScript and Go with braces in strings, comments and templates, nesting, generics and markup."""

from __future__ import annotations

from quillon.sources import braces, code

JS = r'''
import React, { useState } from "react"
import './side.css'
export * from "./other"
const lazy = () => import("./never")
// function hidden() {
/* class Hidden { */
const re = /[{}"'`]+\/(/g, plain = 3, twice = (x) => x * two(x), obj = { m() { inner() }, k: 1 }
export default async function* walk<T extends Map<string, () => void>>(a: T, b = "}"): Promise<{ a: number }> {
  const t = `text ${ help(`in ${deep(1)}`) } { not a brace`
  step("}{", '"'); this.self.go(1); a?.b.c(2); make().then(x => later(x)).end(); new Thing(arg())
  function nested() { lost() }
  items.forEach(function (x) { lost2() })
  class Local { m() { lost3() } }
  if (check(1)) { return done() }
}
export abstract class Box<K> extends Base<K> implements Z {
  static #count = 0;
  private readonly fn = (x) => { notMethod() }
  label: string = "a {"
  constructor(public a: number) { super(a); this.init() }
  @Input({ a: 1 }) get value(): { x: number } { return read(this) }
  static async *load<T>(k: K): Promise<void> { await fetchAll(k) }
  abstract nothing(): void;
  'quoted'() { q() }
  toString = function () { no() }
}
let view = async function named(a) { await v.w(a) }
var Panel = ({ a }) => (
  <div onClick={() => hide()}>Don't {"}"} <b/></div>
)
function Home() {
  const r = fetch("/api/home"); fetch(`/api/${r}`); fetch('/api/home')
  return cond ? <Main/> : null
}
function lower() { return a < b }
app.get("/users/{id}", (q) => { inside() });
await router.use('/x', y)
   api.post(path, z)
'''

GO = '''
package main

import f "fmt"
import (
	"os"
	str "strings" // "no"
)

type Shape interface {
	Area() float64
}
type (
	Point struct{ X, Y int; Tag string `json:"}"` }
	ID    int
	List[T any] struct { items []T }
)
type Alias = map[string]struct{}

func (p *Point) Move(dx int, fn func(int) error) (interface{}, error) {
	s := "} // {"
	r := '}'
	raw := `func no() { "`
	go work(s)
	defer p.mu.Unlock()
	fn2 := func() { lost() }
	return f.Sprint(os.Args[0], len(raw)), fn2.call(r)
}
func (List[T]) Len() int { return 0 }
func Map[K comparable, V any](m map[K]V) []struct{ k K } {
	for k := range keys(m) {
		use(k)
	}
	return nil
}
func external(x int) int
func main() { run() }
'''


def by_name(units):
    return {(u["kind"], u["name"]): u for u in units}


def said(u):
    return [(c["receiver"], c["name"]) for c in u["calls"]]


def test_scripts():
    u = by_name(code.extract("a.tsx", JS, "tsx"))
    assert u["module", "a"]["imports"] == ["react", "./side.css"]
    assert {k for k in u if k[0] in ("function", "class", "component", "method")} == {
        ("function", "lazy"), ("function", "twice"), ("function", "walk"), ("function", "view"), ("function", "lower"), ("class", "Box"), ("component", "Panel"), ("component", "Home"),
        ("method", "constructor"), ("method", "value"), ("method", "load"), ("method", "'quoted'"),
    }
    assert said(u["function", "twice"]) == [(None, "two")]
    assert said(u["function", "walk"]) == [(None, "help"), (None, "deep"), (None, "step"), ("this", "go"), ("a", "c"), (None, "make"), ("make()", "then"), ("make()", "end"), (None, "arg"), ("items", "forEach"), (None, "check"), (None, "done")]
    assert said(u["method", "constructor"]) == [("this", "init")] and u["method", "load"]["parent"] == "Box" and said(u["method", "load"]) == [(None, "fetchAll")]
    assert said(u["function", "view"]) == [("v", "w")]
    lines = JS.split("\n")
    assert lines[u["function", "walk"]["line_start"] - 1].startswith("export default async") and lines[u["function", "walk"]["line_end"] - 1] == "}"
    assert u["class", "Box"]["line_end"] == next(k for k, x in enumerate(lines, 1) if x.startswith("  toString")) + 1
    assert {k[1] for k in u if k[0] == "route"} == {"GET /users/{id}", "USE /x"} and u["endpoint", "GET /api/home"]["parent"] == "Home"


def test_go():
    u = by_name(code.extract("m.go", GO, "go"))
    assert u["module", "m"]["imports"] == ["fmt", "os", "strings"]
    assert {k for k in u if k[0] != "module"} == {("class", "Shape"), ("class", "Point"), ("class", "List"), ("method", "Move"), ("method", "Len"), ("function", "Map"), ("function", "main")}
    assert u["method", "Move"]["parent"] == "Point" and u["method", "Len"]["parent"] == "List"
    assert said(u["method", "Move"]) == [(None, "work"), ("p", "Unlock"), ("f", "Sprint"), (None, "len"), ("fn2", "call")]
    assert said(u["function", "Map"]) == [(None, "keys"), (None, "use")] and said(u["function", "main"]) == [(None, "run")]


def test_any_text_ends():
    import random

    rng = random.Random(71)
    parts = ["{", "}", "(", ")", "`", "${", '"', "'", "/", "//", "/*", "*/", "class A", "function f", "=>", "func", "type", "const a =", "import", "<", ">", "\n", " ", ";", "x", ".", "[", "]", ":", "@d", "async", "export", "static"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        for lang in ("javascript", "go"):
            assert code.extract("a", text, lang)[0]["kind"] == "module"
            held = braces.tokens(text, lang)
            assert all(t.text in text or t.text == "``" for t in held)


def test_units_as_a_table(spark):
    files = spark.createDataFrame([("a.ts", JS), ("m.go", GO), ("e.js", ""), ("n.ts", None)], "path string, text string")
    k = code.keyed(code.units(files))
    e = {(r["src"], r["dst"], r["relation"]) for r in code.edges(k).collect()}
    assert {("a.ts::Box.load", "a.ts::Box", "method_of"), ("m.go::Point.Move", "m.go::Point", "method_of"), ("a.ts", "a.ts::walk", "defines")} <= e

"""Each language pack on a source of our own: names, kinds, qualified names, summaries, references."""

import json

from lodegraph import packs
from lodegraph.packs.facts import Places


def found(path, text, root="main"):
    facts = packs.extract(root, path, text)
    nodes = {(r["name"], r["kind"]): r for r in facts.rows if r["tag"] == "node"}
    refs = {(r["seeking"], r["kind"]) for r in facts.rows if r["tag"] == "unresolved"}
    ids = {r["node_id"] for r in facts.rows if r["tag"] == "node"}
    edges = [r for r in facts.rows if r["tag"] == "edge"]
    assert all(e["from_id"] in ids and e["to_id"] in ids for e in edges) and len(edges) == len(ids) - 1
    return nodes, refs


def has(nodes, *expected):
    missing = [x for x in expected if x not in nodes]
    assert not missing, (missing, sorted(nodes))


def doc(node):
    return node["attributes"].get("doc_summary")


def test_rust():
    nodes, refs = found("src/pump.rs", '''use std::sync::Arc;
pub use crate::valve::{Open, Shut};
/// A pump with a motor.
/// It turns.
pub struct Pump<T> { speed: u32 /* { */ }
impl<T: Clone> Pump<T> {
    /// Starts it
    pub(crate) fn start(&self) -> bool { let x = "fn nope() {"; fn inner() {} true }
    async fn stop(&mut self) {}
}
trait Turn { fn turn(&self); fn back(&self) { } }
impl Turn for Pump<u8> { fn turn(&self) {} }
#[derive(Debug)]
enum Mode { Slow, Fast }
mod parts { pub fn bolt() {} mod tiny { fn nut() {} } }
fn main() { }
''')
    has(nodes, ("src/pump.rs", "file"), ("Pump", "struct"), ("start", "method"), ("stop", "method"), ("Turn", "trait"), ("turn", "method"), ("back", "method"), ("Mode", "enum"), ("parts", "module"), ("bolt", "function"), ("nut", "function"), ("main", "function"))
    assert ("inner", "function") not in nodes and ("nope", "function") not in nodes
    assert doc(nodes["Pump", "struct"]) == "A pump with a motor. It turns." and doc(nodes["Mode", "enum"]) is None
    assert nodes["start", "method"]["qualified_name"] == "impl Pump<T>::start" and nodes["start", "method"]["attributes"]["visibility"] == "pub(crate)"
    assert nodes["nut", "function"]["qualified_name"] == "parts::tiny::nut"
    assert {("Arc", "imports"), ("{Open, Shut}", "imports")} == refs


def test_minimal_rust():
    facts = packs.extract("main", "a.rs", "use std::fmt;\n\npub fn greet() {}\n")
    assert sorted(r["tag"] for r in facts.rows) == ["edge", "node", "node", "unresolved"]


def test_script():
    nodes, refs = found("web/shop.ts", '''import { Cart } from './cart.js';
import * as path from "node:path";
import 'side-effect';
/**
 * A shop that
 * sells things.
 */
export class Shop<T> extends Base {
  private items: T[] = [];
  handler = (x: number) => { return x; };
  constructor(private cart: Cart) { super(); }
  /** Opens it. */
  async open(day: string): Promise<void> { if (day) { for (const x of []) { run(x); } } }
  static of() { return new Shop(null); }
}
export interface Options { open(): void; }
type Id = string | number;
enum Day { Mon, Tue }
export const close = async (id: Id) => { function hidden() {} };
const limit = 3;
export default function main(args: string[]): void {}
describe("x", () => { function helper() {} });
''')
    has(nodes, ("Shop", "class"), ("open", "method"), ("of", "method"), ("constructor", "method"), ("Options", "interface"), ("Id", "type"), ("Day", "enum"), ("close", "function"), ("main", "function"), ("helper", "function"))
    assert ("hidden", "function") not in nodes and ("if", "method") not in nodes and ("limit", "function") not in nodes
    assert doc(nodes["Shop", "class"]) == "A shop that sells things." and doc(nodes["open", "method"]) == "Opens it."
    assert nodes["open", "method"]["qualified_name"].endswith("open") and nodes["open", "method"]["chain"] == "class Shop"
    assert refs == {("cart", "imports"), ("node:path", "imports"), ("side-effect", "imports")}


def test_python():
    nodes, refs = found("jobs/mill.py", '''import os.path as p, sys
from . import near
from ..grain.store import Bin as B, Sack
LIMIT: int = 3
_hidden_ = 1
__all__ = []
name = "x"
@dec(1)
class Mill(Base, pkg.Other, metaclass=M):
    """Grinds.

    Slowly."""
    stones = 2
    def __init__(self): self.x = 1
    @property
    async def grind(self, n: int) -> bool:
        "Grinds n."
        local = 1
        def deep(): pass
if True:
    def late(): pass
type Weight = int
''')
    has(nodes, ("LIMIT", "constant"), ("__all__", "constant") if ("__all__", "constant") in nodes else ("__all__", "variable"), ("name", "variable"), ("Mill", "class"), ("stones", "field"), ("__init__", "constructor"), ("grind", "method"), ("local", "variable"), ("deep", "function"), ("late", "function"), ("Weight", "type"))
    assert not any(n == "_hidden_" for n, _ in nodes)
    assert doc(nodes["Mill", "class"]) == "Grinds. Slowly." and json.loads(nodes["Mill", "class"]["attributes"]["decorators"]) == ["dec(1)"]
    g = nodes["grind", "method"]["attributes"]
    assert g["is_async"] == "true" and g["return_type"] == "bool" and json.loads(g["decorators"]) == ["property"]
    assert {("os.path", "imports"), ("sys", "imports"), ("near", "imports"), ("Bin", "imports"), ("Sack", "imports"), ("grain.store", "imports"), ("Base", "extends"), ("pkg.Other", "extends")} == refs
    assert packs.extract("r", "bin/go", "#!/usr/bin/env python3\nx = 1\n").language == "python"
    assert packs.extract("r", "types.pyi", "").language == "python" and packs.extract("r", "a.bin", "plain") is None
    broken = packs.extract("r", "bad.py", "def (")
    assert [r["tag"] for r in broken.rows] == ["node", "diagnostic"]


def test_prose():
    nodes, refs = found("docs/tea.md", '''# Tea

See [pots](./pots.md) and [site](https://x.org/a.md).

## Green ##
```
# not a heading
[no](./no.md)
```
Brew [it](../brew.txt), or [again](../brew.txt).

Sub
---
### Deep
# Coffee
''')
    has(nodes, ("docs/tea.md", "document"), ("Tea", "heading"), ("Tea", "section"), ("Green", "heading"), ("Sub", "section"), ("Deep", "heading"), ("Coffee", "section"))
    assert nodes["Deep", "section"]["chain"] == "Tea::Sub" and nodes["Green", "heading"]["chain"] == "Tea" and nodes["Coffee", "heading"]["chain"] == ""
    assert nodes["Green", "heading"]["attributes"]["level"] == "2" and nodes["Tea", "section"]["qualified_name"] == "Section: Tea"
    assert refs == {("./pots.md", "links_to"), ("../brew.txt", "links_to")}


def test_go():
    nodes, refs = found("srv/tank.go", '''// Package tank holds water.
package tank

import "fmt"
import (
	"net/url"
	js "encoding/json"
	_ "image/png"
)

const Depth = 3
const (
	// Wide is wide.
	Wide, Narrow = 1, 2
)
var level int = 0

// Level names a level.
type Level string
// Tank holds it.
type Tank struct {
	// Size of it.
	Size, Height int `json:"size"`
	Base
	*url.URL
	pipes []*Pipe
}
type Filler interface {
	// Fill fills.
	Fill(n int) error
	Closer
}
func check(n int) error { return nil }
// New makes one.
func New(n int) (*Tank, error) {
	if err := check(n); err != nil { fmt.Println("x {"); return nil, err }
	var p Pipe
	return &Tank{Size: len("a")}, nil
}
func (t *Tank) Drain() { t.pipes = append(t.pipes, nil) }
''')
    has(nodes, ("tank", "package"), ("Depth", "constant"), ("Wide", "constant"), ("Narrow", "constant"), ("level", "variable"), ("Level", "type"), ("Tank", "struct"), ("Size", "field"), ("Height", "field"), ("pipes", "field"), ("Filler", "interface"), ("Fill", "method"), ("check", "function"), ("New", "function"), ("Drain", "method"))
    assert doc(nodes["Tank", "struct"]) == "Tank holds it." and nodes["Size", "field"]["attributes"]["tag"] == '`json:"size"`' and doc(nodes["Size", "field"]) == "Size of it." and doc(nodes["Wide", "constant"]) == "Wide is wide."
    assert nodes["Drain", "method"]["qualified_name"] == "Tank::Drain"
    for x in (("fmt", "imports"), ("url", "imports"), ("js", "imports"), ("png", "imports"), ("Base", "extends"), ("URL", "extends"), ("Closer", "extends"), ("check", "calls"), ("Println", "calls"), ("Tank", "instantiates"), ("Pipe", "has_type")):
        assert x in refs, (x, refs)
    assert ("append", "calls") not in refs and ("len", "calls") not in refs


def test_c():
    nodes, refs = found("src/area.c", '''#include <math.h>
#include "deep/shape.h"
#define SIDES 4
#define SQUARE(x) ((x) * \\
   (x))
/// A corner
struct Corner { int x, y; struct Corner *next; };
union Number { int whole; double real; };
typedef enum { RED = 1, GREEN } Colour;
typedef unsigned int count_t;
typedef int (*compare)(int, int);
static const double SCALE = 2.0;
int total = 0, other;
/* Sums
 * them. */
double area(struct Corner *c, count_t n) {
    double a = sqrt(c->x); // call()
    printf("f(x) %d", n);
    return list->sum(a);
}
int declared(int a);
''')
    has(nodes, ("SIDES", "constant"), ("SQUARE", "function"), ("Corner", "struct"), ("x", "field"), ("y", "field"), ("next", "field"), ("Number", "struct"), ("whole", "field"), ("RED", "constant"), ("GREEN", "constant"), ("Colour", "type"), ("count_t", "type"), ("compare", "type"), ("SCALE", "constant"), ("total", "variable"), ("other", "variable"), ("area", "function"))
    assert ("declared", "function") not in nodes
    assert doc(nodes["Corner", "struct"]) == "A corner" and doc(nodes["area", "function"]) == "Sums them."
    assert {("math", "imports"), ("shape", "imports"), ("sqrt", "calls"), ("printf", "calls"), ("sum", "calls")} <= refs and ("call", "calls") not in refs and ("Corner", "has_type") in refs


def test_cpp():
    nodes, refs = found("src/lamp.cpp", '''#include <string>
#include "home/room.hpp"
using namespace std;
using Home::Plug;
namespace home::light {
/// Something that shines
class Shines { public: virtual ~Shines() = default; virtual void shine() = 0; };
template <typename T>
class Lamp final : public Shines, protected Plug<T> {
public:
    explicit Lamp(int w) : watts_(w) { warm_up(); }
    ~Lamp() override {}
    void shine() override { cout << "x" << endl; helper::glow(watts_); auto b = std::make_unique<Bulb>(); }
    bool operator==(const Lamp& o) const { return true; }
private:
    void warm_up() {}
    int watts_ = 3, spare_;
    std::vector<Bulb> bulbs_;
};
struct Bulb { bool on; };
enum class State : int { Off, On = 2 };
using LampRef = Lamp<void>*;
int Lamp<int>::outside(int a) { return a; }
}
int main() { return 0; }
''')
    has(nodes, ("home::light", "namespace"), ("Shines", "class"), ("~Shines", "method"), ("shine", "method"), ("Lamp", "class"), ("Lamp", "constructor"), ("~Lamp", "method"), ("operator==", "method"), ("warm_up", "method"), ("watts_", "field"), ("spare_", "field"), ("bulbs_", "field"), ("Bulb", "struct"), ("on", "field"), ("State", "enum"), ("Off", "constant"), ("On", "constant"), ("LampRef", "type"), ("main", "function"), ("outside", "method"))
    assert doc(nodes["Shines", "class"]) == "Something that shines" and nodes["watts_", "field"]["attributes"]["visibility"] == "private"
    assert {("string", "imports"), ("room", "imports"), ("std", "imports"), ("Plug", "imports"), ("Shines", "extends"), ("Plug", "extends"), ("warm_up", "calls"), ("glow", "calls")} <= refs
    assert packs.extract("r", "a.h", "namespace a { class B {}; }").language == "c"  # the C pack comes first


def test_java():
    nodes, refs = found("org/Mail.java", '''package org.post;
import java.util.List;
import java.util.concurrent.*;
import static org.junit.Assert.fail;
/**
 * Delivers.
 */
public interface Carrier extends Closeable, Comparable<Carrier> { int MOST = 3; void carry(Letter x) throws IOException; }
enum Stamp { RED(1), BLUE(2) { int x() { return 1; } }; private final int cost; Stamp(int c) { cost = c; } }
record Letter(@NotNull String to, List<String> pages) implements Item { Letter { check(to); } }
@interface Marked { }
@Deprecated
public class Mail<T> extends Base<T> implements Carrier {
    public static final int LIMIT = 5;
    private final Map<String, Letter> box = new TreeMap<>();
    int a, b;
    /** Makes one. */
    public Mail() { super(); this.box.clear(); }
    @Override public void carry(Letter x) { if (x == null) { fail("f()"); } new Thread(() -> send(x)).start(); }
    private <R> List<R> all(R r) { Route way = null; return null; }
    static class Inner { void deep() {} }
}
''')
    has(nodes, ("org.post", "package"), ("Carrier", "interface"), ("MOST", "constant"), ("carry", "method"), ("Stamp", "enum"), ("RED", "constant"), ("BLUE", "constant"), ("cost", "field"), ("Stamp", "constructor"), ("Letter", "struct"), ("to", "field"), ("pages", "field"), ("Marked", "interface"), ("Mail", "class"), ("LIMIT", "constant"), ("box", "field"), ("a", "field"), ("b", "field"), ("Mail", "constructor"), ("all", "method"), ("Inner", "class"), ("deep", "method"))
    assert doc(nodes["Carrier", "interface"]) == "Delivers." and doc(nodes["Mail", "constructor"]) == "Makes one." and nodes["deep", "method"]["qualified_name"] == "Mail::Inner::deep"
    assert nodes["LIMIT", "constant"]["attributes"]["visibility"] == "public"
    for x in (("List", "imports"), ("*", "imports"), ("fail", "imports"), ("Closeable", "extends"), ("Comparable", "extends"), ("Base", "extends"), ("Carrier", "implements"), ("Item", "implements"), ("TreeMap", "instantiates"), ("Thread", "instantiates"), ("fail", "calls"), ("send", "calls"), ("start", "calls"), ("Route", "has_type")):
        assert x in refs, (x, refs)
    assert ("if", "calls") not in refs


def test_csharp():
    nodes, refs = found("src/Depot.cs", '''using System;
using System.Collections.Generic;
using static System.Math;
using Alias = Some.Far.Thing;
namespace Rail.Yard;

/// <summary>Moves trains.</summary>
public interface IMoves { Task MoveAsync(string id); int Count { get; } }
public enum Gauge { Narrow = 1, Wide }
public record Train(string Name, int Cars = 3);
public delegate void Moved(object sender);
public class Depot<T> : BaseDepot<T>, Rail.IMoves where T : class
{
    public const int Most = 4;
    private readonly List<Train> _trains = new List<Train>();
    public event Moved OnMoved;
    public int Count => _trains.Count;
    public string Name { get; set; } = "x";
    public Depot(string name) { Name = name; }
    ~Depot() { }
    public async Task MoveAsync(string id) { var t = new Train(id, 1); _trains.Add(t); Console.WriteLine("y()"); await SendAsync(); }
    private Task SendAsync() => Task.FromResult(0);
    public int this[int i] { get { return i; } }
}
''')
    has(nodes, ("Rail.Yard", "namespace"), ("IMoves", "interface"), ("MoveAsync", "method"), ("Count", "property"), ("Gauge", "enum"), ("Narrow", "constant"), ("Wide", "constant"), ("Train", "struct"), ("Name", "field"), ("Cars", "field"), ("Moved", "type"), ("Depot", "class"), ("Most", "constant"), ("_trains", "field"), ("OnMoved", "field"), ("Name", "property"), ("Depot", "constructor"), ("~Depot", "method"), ("SendAsync", "method"), ("this", "property"))
    assert doc(nodes["IMoves", "interface"]) == "Moves trains." and nodes["Depot", "class"]["qualified_name"] == "Rail.Yard::Depot"
    for x in (("System", "imports"), ("Generic", "imports"), ("Math", "imports"), ("Thing", "imports"), ("BaseDepot", "extends"), ("IMoves", "extends"), ("Train", "instantiates"), ("List", "instantiates"), ("Add", "calls"), ("WriteLine", "calls"), ("SendAsync", "calls"), ("FromResult", "calls"), ("List", "has_type")):
        assert x in refs, (x, refs)


def test_discriminators_and_places():
    facts = packs.extract("main", "a.rs", "fn f() {}\nfn f() {}\n// \U0001f980\nfn g() {}\n")
    twice = [r for r in facts.rows if r["tag"] == "node" and r["name"] == "f"]
    assert [r["ordinal"] for r in twice] == [0, 1] and twice[0]["node_id"] != twice[1]["node_id"]
    g = next(r for r in facts.rows if r["tag"] == "node" and r["name"] == "g")
    assert (g["start"], g["start_line"], g["start_column"]) == (28, 4, 1)
    p = Places("fn \U0001f980_run() {}\n")
    assert p.at(3)[1:] == (1, 4) and p.at(4) == (7, 1, 5)


def test_odd_files():
    for path in ("a.rs", "a.ts", "a.py", "a.md", "a.go", "a.c", "a.cpp", "a.java", "a.cs"):
        for text in ("", "\n", "{" * 50, "}" * 50, "(" * 200, '"', "/*", "\x00�", "class", "fn", b"\xff\xfe{", "x" * 100_000):
            assert packs.extract("r", path, text).rows[0]["tag"] == "node", (path, text[:20])

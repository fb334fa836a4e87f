"""Parsers of languages with braces or ``end``: whole declarations, whatever lines, strings and comments do."""

import pytest

from lodestone.sources.code import parse
from lodestone.sources.lexed import GRAMMARS, declarations

#: Sources, and what they declare: label, name, lines, class, bases > calls.
CASES = {
    "typescript": (
        '''
import { a } from "./mod";
import def, * as ns from 'lib';
const fs = require("fs");
/** Adds things.
 * Twice. */
export async function add(
  x: number,
  y: { z: number },
): Promise<number> {
  helper(x); // other(1)
  const s = `text ${call()} function nope() {`;
  return this.svc.compute(y);
}
export const arrow = async (a: string): Promise<void> => {
  run(a);
};
const short = x => twice(x);
const notfn = compute(5);
export abstract class Foo<T extends Bar> extends pkg.Base<T> implements I {
  private field = 5;
  static make(): Foo<any> { return new Foo(); }
  get value(): number { return this.calc(); }
  constructor(private readonly x: X) { super(x); init(); }
  handler = (e: Event) => { this.on(e); };
  abstract later(): void;
}
interface Shape { area(): number; }
type Alias = { a: string };
function* gen() { yield one(); }
''',
        [
            "Import ./mod 2-2 . >",
            "Import lib 3-3 . >",
            "Import fs 4-4 . >",
            "Function add 7-14 . >helper,compute",
            "Function arrow 15-17 . >run",
            "Function short 18-18 . >",
            "Class Foo 20-27 . Base>",
            "Method make 22-22 Foo >",
            "Method value 23-23 Foo >calc",
            "Method constructor 24-24 Foo >init",
            "Method handler 25-25 Foo >on",
            "Method later 26-26 Foo >",
            "Class Shape 28-28 . >",
            "Method area 28-28 Shape >",
            "Class Alias 29-29 . >",
            "Function gen 30-30 . >one",
        ],
    ),
    "go": (
        '''package main
import (
    "fmt"
    str "strings" // note
)
import "os"
type Server struct {
    name string
}
type Store interface { Get() int }
type ID int
type (
    A struct { x int }
    B interface{}
)
/* func commented() {} */
func New(
    name string,
    opts ...Option,
) *Server {
    s := "func fake() {"
    fmt.Println(s)
    return build(name)
}
func (s *Server) Run(ctx context.Context) (err error) {
    return s.loop(func() { inner() })
}
func Map[T any](x []T) interface{} { return x }
''',
        [
            "Import fmt 3-3 . >",
            "Import strings 4-4 . >",
            "Import os 6-6 . >",
            "Class Server 7-9 . >",
            "Class Store 10-10 . >",
            "Class A 13-13 . >",
            "Class B 14-14 . >",
            "Function New 17-24 . >Println,build",
            "Method Run 25-27 Server >loop,inner",
            "Function Map 28-28 . >",
        ],
    ),
    "rust": (
        '''
use std::collections::{HashMap, HashSet};
pub mod inner {
    pub fn helper<'a>(x: &'a str) -> &'a str { x.trim() }
}
/// A point.
/// In space.
#[derive(Debug)]
pub struct Point<T> { x: T }
struct Unit;
struct Tup(i32);
enum E { A, B(i32) }
pub trait Area { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() } }
impl<T: Into<f64>> Area for Point<T>
where T: Copy {
    fn area(&self) -> f64 {
        let c = '{'; let s = r#"fn fake() { "#;
        /* nested /* fn no() {} */ */
        compute::<f64>(self.x.into())
    }
}
impl Unit { pub async fn go(&self) { println!("x"); helper(1); } }
''',
        [
            "Import std::collections::{HashMap, HashSet} 2-2 . >",
            "Function helper 4-4 . >trim",
            "Class Point 8-9 . >",
            "Class Unit 10-10 . >",
            "Class Tup 11-11 . >",
            "Class E 12-12 . >",
            "Class Area 13-13 . >",
            "Method area 13-13 Area >",
            "Method twice 13-13 Area >area",
            "Method area 16-20 Point >compute,into",
            "Method go 22-22 Unit >helper",
        ],
    ),
    "java": (
        '''
package a.b;
import java.util.List;
import static java.lang.Math.*;
/** Doc. */
@Entity
public class Foo<T extends Bar> extends Base<T> implements I {
    private final Map<String, List<Integer>> m = new HashMap<>() {{ put("a", 1); }};
    public Foo(int a,
               int b) {
        super(a);
        init(b);
    }
    @Override
    public <R> List<R> map(Function<T, R> f) throws IOException {
        String s = """
            void fake() {
            """;
        return stream().map(f).collect(toList());
    }
    abstract int later(int x);
    static class Inner { void deep() { x.y(); } }
    enum Color { RED, GREEN; int v() { return get(); } }
}
record P(int x, int y) { int sum() { return add(x, y); } }
''',
        [
            "Import java.util.List 3-3 . >",
            "Import java.lang.Math.* 4-4 . >",
            "Class Foo 6-24 . Base>",
            "Method Foo 9-13 Foo >init",
            "Method map 14-20 Foo >stream,map,collect,toList",
            "Method later 21-21 Foo >",
            "Class Inner 22-22 Foo >",
            "Method deep 22-22 Inner >y",
            "Class Color 23-23 Foo >",
            "Method v 23-23 Color >get",
            "Class P 25-25 . >",
            "Method sum 25-25 P >add",
        ],
    ),
    "kotlin": (
        '''
import a.b.C
import d.e.*
data class User(val name: String, val f: (Int) -> Int) : Base(name), I {
    fun greet(
        who: String
    ): String {
        return format(who)
    }
    companion object { fun make() = User("a") }
}
fun <T> List<T>.second(): T = this.get(1)
fun String.shout() = upper(this)
object Single { fun x() { y() } }
interface Sh { fun area(): Double }
fun plain() {
    val s = "fun fake() {"
    run { inner(1) }
}
''',
        [
            "Import a.b.C 2-2 . >",
            "Import d.e.* 3-3 . >",
            "Class User 4-11 . >",
            "Method greet 5-9 User >format",
            "Method make 10-10 User >User",
            "Function second 12-12 . >get",
            "Function shout 13-13 . >upper",
            "Class Single 14-14 . >",
            "Method x 14-14 Single >y",
            "Class Sh 15-15 . >",
            "Method area 15-15 Sh >",
            "Function plain 16-19 . >inner",
        ],
    ),
    "csharp": (
        '''
using System;
using static System.Math;
namespace A.B {
    public class Foo<T> : Base, IFoo where T : new() {
        public int X { get; set; } = 5;
        public Foo(int a) : base(a) { Init(a); }
        public async Task<int> RunAsync(
            string s)
        {
            var v = @"void Fake() { ""x"" ";
            return await Compute(s);
        }
        public int Twice(int x) => Mul(x, 2);
        struct Inner { void Deep() { Go(); } }
    }
    public interface IFoo { int Get(int a); }
    enum E { A, B }
    record R(int X);
}
''',
        [
            "Import System 2-2 . >",
            "Import System.Math 3-3 . >",
            "Class Foo 5-16 . Base,IFoo>",
            "Method Foo 7-7 Foo >Init",
            "Method RunAsync 8-13 Foo >Compute",
            "Method Twice 14-14 Foo >Mul",
            "Class Inner 15-15 Foo >",
            "Method Deep 15-15 Inner >Go",
            "Class IFoo 17-17 . >",
            "Method Get 17-17 IFoo >",
            "Class E 18-18 . >",
            "Class R 19-19 . >",
        ],
    ),
    "php": (
        '''<?php
namespace App\\Models;
use Illuminate\\Support\\Str;
use A\\{B, C};
abstract class User extends Model implements X
{
    use HasFactory;
    public function __construct(
        private string $name,
    ) {
        parent::__construct();
        $this->boot(strtolower($name));
    }
    public static function make(): static { return new static(helper()); }
    abstract function later();
}
interface Y { public function z(); }
trait T { function t() { return $f(1); } }
function top($x) {
  $s = <<<EOT
  function fake() {
EOT;
  return array_map(fn($y) => g($y), $x);
}
''',
        [
            "Import Illuminate\\Support\\Str 3-3 . >",
            "Import A\\B 4-4 . >",
            "Import A\\C 4-4 . >",
            "Class User 5-16 . Model>",
            "Method __construct 8-13 User >__construct,boot,strtolower",
            "Method make 14-14 User >helper",
            "Method later 15-15 User >",
            "Class Y 17-17 . >",
            "Method z 17-17 Y >",
            "Class T 18-18 . >",
            "Method t 18-18 T >",
            "Function top 19-24 . >array_map,g",
        ],
    ),
    "ruby": (
        '''
require 'json'
require_relative "lib/x"
module Outer
  class Foo < Base::Thing
    attr_reader :x
    def initialize(a,
                   b = {})
      super
      @x = build(a) if a
      while x do
        step.run
      end
      list.each do |i|
        handle(i)
      end
    end
    def self.make(x) = new(x)
    def valid?
      s = "def fake"
      text = <<~EOS
        def nope
        end
      EOS
      return true unless done?(s)
    end
    private def hidden; secret(); end
    class << self
      def meta; go(1); end
    end
  end
end
def top
  puts(1)
end
''',
        [
            "Import json 2-2 . >",
            "Import lib/x 3-3 . >",
            "Class Outer 4-32 . >",
            "Class Foo 5-31 Outer Thing>",
            "Method initialize 7-17 Foo >build,run,each,handle",
            "Method make 18-18 Foo >",
            "Method valid? 19-26 Foo >done?",
            "Method hidden 27-27 Foo >secret",
            "Method meta 29-29 Foo >go",
            "Function top 33-35 . >puts",
        ],
    ),
    "swift": (
        '''
import Foundation
class Foo<T>: Base, Proto where T: X {
    var v: Int { get { calc() } }
    init(a: Int,
         b: String) {
        setup(a)
    }
    func run(_ x: Int) async throws -> [String: Int] {
        let s = "func fake() {"
        return compute(x).map { inner($0) }
    }
    static func make() -> Foo { Foo(a: 1, b: "") }
}
struct P { func f() { g() } }
protocol Q { func need() -> Int
  func other() }
enum E: String { case a; func h() { i() } }
extension P { func extra() { more() } }
func top() { deep() }
''',
        [
            "Import Foundation 2-2 . >",
            "Class Foo 3-14 . Base,Proto>",
            "Method init 5-8 Foo >setup",
            "Method run 9-12 Foo >compute,map,inner",
            "Method make 13-13 Foo >Foo",
            "Class P 15-15 . >",
            "Method f 15-15 P >g",
            "Class Q 16-17 . >",
            "Method need 16-16 Q >",
            "Method other 17-17 Q >",
            "Class E 18-18 . String>",
            "Method h 18-18 E >i",
            "Method extra 19-19 P >more",
            "Function top 20-20 . >deep",
        ],
    ),
    "c": (
        '''
#include <stdio.h>
#include "my.h"
#define M(x) do { x; } while (0)
struct point { int x; };
typedef struct { int a; } Anon;
enum color { RED };
static int helper(int a,
                  char *b);
static inline int *
compute(struct point *p, int (*cb)(int))
{
    char c = '{'; const char *s = "int fake() {";
    if (p) { return cb(helper(1, "a")); }
    return 0;
}
int g = 5;
int arr[] = { 1, 2 };
int main(void) { return compute(0, 0); }
''',
        [
            "Import stdio.h 2-2 . >",
            "Import my.h 3-3 . >",
            "Class point 5-5 . >",
            "Class Anon 6-6 . >",
            "Class color 7-7 . >",
            "Function compute 10-16 . >cb,helper",
            "Function main 19-19 . >compute",
        ],
    ),
    "cpp": (
        '''
#include <vector>
namespace a { namespace b {
template <typename T>
class Foo final : public Base<T>, private Other {
public:
    explicit Foo(int x) : x_(x), y_{2} { init(); }
    ~Foo() { done(); }
    virtual int get() const override { return calc(x_); }
    void later();
    int operator()(int z) { return z; }
private:
    int x_;
};
struct S { int v; };
enum class Color { Red };
} }
void a::b::Foo::later() { go(); }
static std::vector<int> make(std::function<void()> f = [] { x(); }) { f(); return std::move(build<int>(1)); }
''',
        [
            "Import vector 2-2 . >",
            "Class Foo 4-14 . Base,Other>",
            "Method Foo 6-7 Foo >init",
            "Method ~Foo 8-8 Foo >done",
            "Method get 9-9 Foo >calc",
            "Method operator 11-11 Foo >",
            "Class S 15-15 . >",
            "Class Color 16-16 . >",
            "Method later 18-18 Foo >go",
            "Function make 19-19 . >f,move",
        ],
    ),
    "bash": (
        '''#!/bin/bash
source ./lib.sh
. "other.sh"
export NAME="a b"
count=5
run_it() {
  local x=1
  helper "$x" | filter --flag
  if check_it; then
    echo "function fake() {"
  fi
  cat <<EOF
function nope() {
EOF
  result=$(compute 1)
}
function second
{
  run_it && third_step
}
main "$@"
''',
        [
            "Import ./lib.sh 2-2 . >",
            "Import other.sh 3-3 . >",
            "Variable NAME 4-4 . >",
            "Variable count 5-5 . >",
            "Function run_it 6-16 . >helper,filter,check_it,cat,compute",
            "Function second 17-20 . >run_it,third_step",
        ],
    ),
    "puppet": (
        '''
class apache::vhost (
  String $name = 'x',
  $port,
  Hash $opts = { 'a' => 1 },
) inherits apache {
  include apache::base
  # include nothing
  require ntp
  $var = 'x { y'
  file { '/etc/x': ensure => present, require => Package['x'] }
}
define my::thing($a) { }
node 'web1' { include role::web }
''',
        [
            "Class apache::vhost 2-12 . >",
            "Variable name 3-3 apache::vhost >",
            "Variable port 4-4 apache::vhost >",
            "Variable opts 5-5 apache::vhost >",
            "Import apache::base 7-7 . >",
            "Import ntp 9-9 . >",
            "Variable var 10-10 apache::vhost >",
            "Class my::thing 13-13 . >",
            "Variable a 13-13 my::thing >",
            "Class web1 14-14 . >",
            "Import role::web 14-14 . >",
        ],
    ),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_declarations(language):
    text, want = CASES[language]
    got = [f"{d.label} {d.name} {d.line}-{d.end} {d.owner or '.'} {','.join(d.bases)}>{','.join(d.calls)}" for d in declarations(text, language)]
    assert got == want


def test_documentation():
    docs = {d.name: d.doc for k in ("typescript", "rust", "java", "go") for d in declarations(CASES[k][0], k) if d.label in ("Class", "Function")}
    assert docs["add"] == "Adds things.\nTwice." and docs["Point"] == "A point.\nIn space." and docs["Foo"] == "Doc."
    assert docs["Shape"] == "interface" and docs["Alias"] == "type" and docs["Server"] == "struct"


def test_signatures_span_lines():
    found = {d.name: d.signature for d in declarations(CASES["typescript"][0], "typescript")}
    assert found["add"] == "export async function add( x: number, y: { z: number }, ): Promise<number>"


@pytest.mark.parametrize("language", sorted(GRAMMARS))
@pytest.mark.parametrize("text", ["", "\n\n", "{", "}", "(((", "class", "class X", "def", "fn f(", "\"open string", "/* open", "x = {", "function f() {", "<<EOF\nnever closed", "use", "import", "type (", "impl", "#include", "é = 日本", "end end end", "a" * 5000 + "(" * 500])
def test_broken_sources(language, text):
    declarations(text, language)  # read to its end, without an error


def test_rows_of_a_file():
    p = parse("src/A.java", CASES["java"][0])
    edges = {(e["from_name"], e["type"], e["to_name"]) for e in p.edges}
    assert {("A.java", "CONTAINS", "Foo"), ("Foo", "CONTAINS", "Inner"), ("Inner", "CONTAINS", "deep"), ("Foo", "INHERITS", "Base"), ("map", "CALLS", "collect"), ("A.java", "IMPORTS", "java.util.List")} <= edges
    assert not any("fake" in n["name"] for n in p.nodes)
    spans = {n["name"]: (n["line_start"], n["line_end"]) for n in p.nodes if n["label"] == "Method"}
    assert spans["map"] == (14, 20)

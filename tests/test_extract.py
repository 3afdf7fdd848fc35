"""Fact extraction on small sources of every language."""

import pytest

from lodestone.sources.facts import extract_file

TS = """import { a } from './a';
import type { B } from "b";
export * from './c';
/** Says hello. */
export async function greet(name: string, loud?: boolean): Promise<string> { return helper(name); }
export class Service extends Base implements Api {
  private cache: Map<string, User>;
  getName(id: number): string { return this.find(id); }
}
export interface User {
  id: number;
  name: string;
}
type Id = string | number;
enum Role { Admin }
const arrow = async (x: number) => { return x; };
const LIMIT = 3;
"""


def facts(language, text, table):
    return [row for name, row in extract_file("f", language, text) if name == table]


def kinds(language, text):
    return {(r["name"], r["kind"]) for r in facts(language, text, "symbol")}


def test_typescript_symbols():
    found = kinds("typescript", TS)
    assert {("greet", "function"), ("Service", "class"), ("getName", "method"), ("User", "interface"), ("id", "field"), ("Id", "type_alias"), ("Role", "enum"), ("arrow", "arrow_function"), ("LIMIT", "variable")} <= found


def test_typescript_imports_and_parents():
    assert [(r["raw_path"], r["kind"]) for r in facts("typescript", TS, "raw_import")] == [("./a", "static"), ("b", "static"), ("./c", "re_export")]
    method = next(r for r in facts("typescript", TS, "symbol") if r["name"] == "getName")
    assert method["qualified_name"] == "Service.getName"
    assert {(r["parent_leaf"], r["kind"]) for r in facts("typescript", TS, "raw_inheritance")} == {("Base", "extends"), ("Api", "implements")}


def test_calls_have_receivers_and_callers():
    found = {(r["callee_name"], r["receiver"], r["caller_id"].split("|")[3]) for r in facts("typescript", TS, "call_site")}
    assert {("helper", None, "greet"), ("find", "this", "getName")} <= found


def test_doc_comment_names_its_declaration():
    doc = next(r for r in facts("typescript", TS, "comment") if r["is_doc"])
    assert doc["documents_id"].split("|")[3] == "greet"


PY = '''import os.path as p
from .sib import thing
class A(Base):
    """Doc. TODO later"""
    size: int = 1
    @staticmethod
    async def f(a: int, b=None, *c, **d) -> list[str]:
        # FIXME soon
        y = Foo()
        y = Foo()
        (q, r) = 1, 2
        return y.run(a)
'''


def test_python():
    symbols = facts("python", PY, "symbol")
    assert sum(r["name"] == "y" for r in symbols) == 1  # the first assignment declares
    assert not any(r["name"] in ("q", "r") for r in symbols)  # destructuring declares nothing
    method = next(r for r in symbols if r["name"] == "f")
    assert method["is_static"] and method["is_async"] and method["kind"] == "method"
    assert [(r["name"], r["is_optional"], r["has_default"]) for r in facts("python", PY, "parameter")] == [("a", False, False), ("b", True, True), ("c", False, False), ("d", False, False)]
    assert {r["todo_kind"] for r in facts("python", PY, "comment")} == {"TODO", "FIXME"}
    assert {(r["callee_name"], r["receiver"]) for r in facts("python", PY, "call_site")} == {("Foo", None), ("run", "y")}
    assert {r["display_name"]: r["kind"] for r in facts("python", PY, "type")} == {"int": "primitive", "str": "primitive", "list[str]": "array"}


@pytest.mark.parametrize(
    ("language", "text", "wanted"),
    [
        ("go", "package a\nfunc (s *Srv) Run(a int) error { return s.x(a) }\ntype Srv struct { N int }\nvar _ = 1\n", {("Run", "method"), ("Srv", "struct")}),
        ("rust", "pub struct S { a: u8 }\npub fn go(x: i32) -> u8 { x }\npub trait T { fn y(); }\nmacro_rules! m { () => {} }\n", {("S", "struct"), ("go", "function"), ("T", "trait"), ("m", "macro")}),
        ("java", "class A extends B {\n  private int n;\n  @Override public String get(String k) throws IOException { return k; }\n}\n", {("A", "class"), ("n", "field"), ("get", "method")}),
        ("csharp", "namespace App.Models {\n public class M : Base {\n  public int Id { get; set; }\n  public void Go(string s) { throw new Bad(); }\n }\n}\n", {("App.Models", "namespace"), ("M", "class"), ("Id", "property"), ("Go", "method")}),
        ("c", "struct P { int a; };\nstatic int add(int a, int b) { return sub(a, b); }\nint later(int a);\n#define MAX 3\n", {("P", "struct"), ("add", "function"), ("MAX", "macro")}),
        ("cpp", "namespace n {\nclass K : public Base {\n public:\n  virtual int f(int a) const override { return g(a); }\n};\n}\n", {("n", "namespace"), ("K", "class"), ("f", "method")}),
        ("php", "<?php\nnamespace A\\B;\nclass K extends L { public function f(?int $a, $b = 1) { $this->g($a); } }\n", {("A\\B", "namespace"), ("K", "class"), ("f", "method")}),
    ],
)
def test_declarations(language, text, wanted):
    found = kinds(language, text)
    assert wanted <= found
    assert not {("_", "variable"), ("later", "function")} & found


def test_empty_and_broken_files():
    for language in ("python", "typescript", "go"):
        assert facts(language, "", "symbol") == []
    assert facts("python", "def (", "symbol") == []
    extract_file("f", "typescript", "class { ( \"")

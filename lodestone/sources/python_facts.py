"""Facts of Python files, from the standard library's grammar."""

from __future__ import annotations

import ast
import io
import tokenize

from lodestone.sources.facts import Facts, caller_of, innermost

PRIMITIVES = frozenset("int float str bool bytes complex None object".split())
GENERICS = frozenset("list dict set tuple frozenset List Dict Set Tuple FrozenSet Optional Iterable Iterator Sequence Mapping".split())


class Walker(ast.NodeVisitor):
    def __init__(self, facts: Facts, tree: ast.Module):
        self.facts = facts
        self.parents: list[dict] = []
        self.symbols: list[dict] = []
        end = len(facts.raw)
        self.scopes = [facts.scope("file", 0, end, None)]
        self.locals: set[tuple[str, str]] = set()
        self.visit(tree)

    def range(self, node: ast.AST) -> tuple[int, int]:
        at = self.facts.starts
        return at[node.lineno - 1] + node.col_offset, at[node.end_lineno - 1] + node.end_col_offset

    @property
    def owner(self) -> dict | None:
        return self.parents[-1] if self.parents else None

    # declarations

    def _named(self, kind: str, name: str, node: ast.AST, **flags) -> dict:
        start, end = self.range(node)
        made = self.facts.symbol(kind, name, start, end, self.owner, exported=not name.startswith("_"), **flags)
        self.symbols.append(made)
        self.facts.binding(self.scopes[-1], name, start, "parameter" if kind == "parameter" else "definition", made["id"])
        return made

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        marks = [ast.unparse(d) for d in node.decorator_list]
        leaves = {m.split("(")[0].rpartition(".")[2] for m in marks}
        is_async = isinstance(node, ast.AsyncFunctionDef)
        kind = "method" if self.owner and self.owner["kind"] == "class" else "function"
        made = self._named(kind, node.name, node, is_async=is_async, is_static="staticmethod" in leaves, is_abstract="abstractmethod" in leaves)
        yields = any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node))
        self.facts.add("python_attrs", symbol_id=made["id"], decorators=marks, is_generator=yields, is_coroutine=is_async, docstring_style=None)
        for d in node.decorator_list:
            self.visit(d)
        self.parents.append(made)
        self.scopes.append(self.facts.scope("function", made["start"], made["end"], self.scopes[-1]))
        self._parameters(node.args, made)
        if node.returns is not None:
            self.facts.add("returns_type", function_id=made["id"], type_id=self.typed(node.returns))
            self.visit(node.returns)
        self._docstring(node, made)
        for part in node.body:
            self.visit(part)
        self.scopes.pop()
        self.parents.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def _parameters(self, args: ast.arguments, function: dict) -> None:
        plain = [*args.posonlyargs, *args.args]
        defaults: list[ast.expr | None] = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        every = list(zip(plain, defaults))
        every += [(args.vararg, None)] if args.vararg else []
        every += list(zip(args.kwonlyargs, args.kw_defaults))
        every += [(args.kwarg, None)] if args.kwarg else []
        for k, (arg, default) in enumerate(every):
            made = self._named("parameter", arg.arg, arg)
            type_id = self.typed(arg.annotation) if arg.annotation is not None else None
            optional = isinstance(default, ast.Constant) and default.value is None
            self.facts.add("parameter", id=made["id"], name=arg.arg, function_id=function["id"], position=k, type_id=type_id, is_optional=optional, has_default=default is not None, is_taint_source=False)
            if arg.annotation is not None:
                self.visit(arg.annotation)
            if default is not None:
                self.visit(default)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        made = self._named("class", node.name, node, is_abstract=any("ABC" in ast.unparse(b) for b in node.bases))
        self.facts.add("python_attrs", symbol_id=made["id"], decorators=[ast.unparse(d) for d in node.decorator_list], is_generator=False, is_coroutine=False, docstring_style=None)
        for base in node.bases:
            self.facts.inherits(made, ast.unparse(base), "extends")
            self.visit(base)
        for d in [*node.decorator_list, *node.keywords]:
            self.visit(d)
        self.parents.append(made)
        self.scopes.append(self.facts.scope("class", made["start"], made["end"], self.scopes[-1]))
        self._docstring(node, made)
        for part in node.body:
            self.visit(part)
        self.scopes.pop()
        self.parents.pop()

    def _docstring(self, node: ast.AST, made: dict) -> None:
        if ast.get_docstring(node, clean=False) is not None:
            start, end = self.range(node.body[0])
            self.facts.comment(self.facts.raw[start:end].decode("utf-8", "replace"), "doc", start, end, made["id"])

    def _assigned(self, target: ast.expr, node: ast.AST, annotation: ast.expr | None, value: ast.expr | None) -> None:
        if not isinstance(target, ast.Name):  # destructuring and attributes declare nothing
            return
        key = (self.owner["id"] if self.owner else "", target.id)
        if key not in self.locals:  # the first assignment declares
            self.locals.add(key)
            made = self._named("variable", target.id, node, is_mutable=True)
            if annotation is not None and self.owner and self.owner["kind"] == "class":
                self.facts.add("field_type", symbol_id=made["id"], type_id=self.typed(annotation))
        name = ast.unparse(annotation) if annotation is not None else ast.unparse(value.func) if isinstance(value, ast.Call) else ""
        bare = name.split("[")[0].rpartition(".")[2]
        if bare[:1].isupper():
            self.facts.add("local_type", file_path=self.facts.path, name=target.id, type_name=bare, start_byte=self.range(target)[0])

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            self._assigned(target, node, None, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned(node.target, node, node.annotation, node.value)
        self.typed(node.annotation)
        self.generic_visit(node)

    # imports

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.facts.imported(a.name, "import")
            self.facts.binding(self.scopes[-1], a.asname or a.name.split(".")[0], self.range(node)[0], "import_alias" if a.asname else "import")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        for k, a in enumerate(node.names):
            self.facts.imported(base if node.module or a.name == "*" else base + a.name, "from")
            kind = "wildcard_import" if a.name == "*" else "import_alias" if a.asname else "import"
            self.facts.binding(self.scopes[-1], a.asname or a.name, self.range(node)[0] + k, kind)

    # uses

    def visit_Call(self, node: ast.Call) -> None:
        start, end = self.range(node)
        f = node.func
        name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ast.unparse(f).rpartition(".")[2]
        receiver = ast.unparse(f.value) if isinstance(f, ast.Attribute) else None
        caller = caller_of(self.symbols, node.lineno)
        self.facts.call(caller["id"] if caller else None, name, receiver, start, end)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        start, end = self.range(node)
        if isinstance(node.ctx, ast.Store):
            return
        kind = "call" if self.facts.raw[end : end + 1] == b"(" else "read"
        held = innermost(self.symbols, start)
        self.facts.occurrence(node.id, start, end, kind, held["id"] if held else None, self.scopes[-1])

    def _block(self, node: ast.AST) -> None:
        start, end = self.range(node)
        kind = {"For": "for_statement", "AsyncFor": "for_statement", "If": "if_statement", "While": "while_statement", "With": "with_statement", "AsyncWith": "with_statement", "Try": "try_statement", "Match": "match_statement"}[type(node).__name__]
        self.scopes.append(self.facts.scope(kind, start, end, self.scopes[-1]))
        self.generic_visit(node)
        self.scopes.pop()

    visit_For = visit_AsyncFor = visit_If = visit_While = visit_With = visit_AsyncWith = visit_Try = visit_Match = _block

    # types

    def typed(self, node: ast.expr) -> str:
        """The type's row, and rows for the types inside it."""
        display = " ".join(ast.unparse(node).split())
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            kind = "union"
            self.typed(node.left)
            self.typed(node.right)
        elif isinstance(node, ast.Subscript):
            head = ast.unparse(node.value).rpartition(".")[2]
            kind = "union" if head in ("Union", "Optional") else "tuple" if head in ("tuple", "Tuple") else "function" if head == "Callable" else "array" if head in ("list", "List") else "generic"
            parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            for part in parts:
                if isinstance(part, (ast.Name, ast.Attribute, ast.Subscript, ast.BinOp)):
                    self.typed(part)
        else:
            kind = "primitive" if display in PRIMITIVES else "generic" if display in GENERICS else "named"
        return self.facts.type(display, kind, display if kind == "primitive" else None)


def extract(facts: Facts, text: str) -> None:
    """All facts of a Python file; one that doesn't parse yields its file scope alone."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        facts.scope("file", 0, len(facts.raw), None)
        return
    walker = Walker(facts, tree)
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.COMMENT:
            line = token.line[: token.start[1]]
            start = facts.starts[token.start[0] - 1] + len(line.encode())
            after = [s for s in walker.symbols if s["start"] > start and s["kind"] in ("function", "method", "class")]
            following = min(after, key=lambda s: s["start"], default=None)
            facts.comment(token.string, "line", start, start + len(token.string.encode()), following["id"] if following and following["line"] == token.start[0] + 1 else None)

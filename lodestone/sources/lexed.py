"""Facts of files in brace languages, by a tolerant lexer and patterns of declarations.

Comments and strings are blanked first, so that patterns and braces see code alone.  Only
what a pattern states is emitted: the coverage by language is listed in the README.
"""

from __future__ import annotations

import bisect
import re

from lodestone.sources.facts import Facts, caller_of, innermost

LEX = re.compile(
    rb"""(?P<doc>///[^\n]*|//![^\n]*|/\*[*!].*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))"""
    rb"""|(?P<string>"(?:[^"\\]|\\.)*+"|`(?:[^`\\]|\\.)*+`|'(?:[^'\\\n]|\\.){1,8}'|@"[^"]*")""",
    re.S,
)
HASH_COMMENT = re.compile(rb"(?m)^\s*#(?!\[)[^\n]*")

I = r"[A-Za-z_$][A-Za-z0-9_$]*"
MODIFIERS = r"(?P<mods>(?:\b(?:public|private|protected|internal|static|final|abstract|async|export|default|pub(?:\([a-z:\s]+\))?|unsafe|const|extern|inline|virtual|override|sealed|partial|readonly|declare|synchronized|native|constexpr|volatile|unsigned|friend|new)\s+)*)"
GENERIC = r"(?:<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>)?"

# How each language declares things: (kind, pattern with `name`; `mods`, `base` and `args` where there are such).
FUNCTION_C = rf"(?m)^[ \t]*(?:@\w[\w.]*(?:\([^()]*\))?\s+|\[[^\]\n]*\]\s+)*{MODIFIERS}(?P<ret>[A-Za-z_][\w:<>,\s*&\[\]]*?[\s*&>\]])(?P<name>(?:{I}::)*~?{I})\s*(?P<args>\([^(){{}};]*\))\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:throws\s+(?P<throws>[\w.,\s]+?))?\s*(?=\{{)"
JS = [
    ("class", rf"{MODIFIERS}\bclass\s+(?P<name>{I})\s*{GENERIC}(?:\s*\bextends\s+(?P<base>[\w.$]+))?[^{{}}]*?(?:implements\s+(?P<impl>[\w.$,\s<>]+?))?(?=\{{)"),
    ("function", rf"{MODIFIERS}\bfunction\s*\*?\s*(?P<name>{I})\s*{GENERIC}\s*(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\))"),
    ("arrow_function", rf"{MODIFIERS}\b(?:const|let|var)\s+(?P<name>{I})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\)|{I})\s*(?::[^=;{{]+)?=>"),
    ("variable", rf"{MODIFIERS}\b(?P<let>const|let|var)\s+(?P<name>{I})\b(?!\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{I})\s*(?::[^=;{{]+)?=>)"),
    ("method", rf"(?m)^[ \t]+{MODIFIERS}(?:get\s+|set\s+)?(?P<name>(?!(?:if|for|while|switch|catch|function|return)\b){I})\s*{GENERIC}(?P<args>\([^(){{}};]*\))\s*(?::[^{{}};=]+)?(?=\{{)"),
]
TS = [
    *JS,
    ("interface", rf"{MODIFIERS}\binterface\s+(?P<name>{I})\s*{GENERIC}(?:\s+extends\s+(?P<base>[\w.$,\s<>]+?))?\s*(?=\{{)"),
    ("type_alias", rf"{MODIFIERS}\btype\s+(?P<name>{I})\s*{GENERIC}\s*="),
    ("enum", rf"{MODIFIERS}\benum\s+(?P<name>{I})\s*(?=\{{)"),
    ("namespace", rf"{MODIFIERS}\bnamespace\s+(?P<name>{I})\s*(?=\{{)"),
    ("field", rf"(?:(?<=[{{;,\n])|^)\s*{MODIFIERS}(?P<name>{I})\??\s*:\s*(?P<ret>[^;={{}}()\n]+?)\s*(?=[;,=\n}}])"),
]
C = [
    ("function", FUNCTION_C),
    ("struct", rf"\bstruct\s+(?P<name>{I})\s*(?=\{{)"),
    ("union", rf"\bunion\s+(?P<name>{I})\s*(?=\{{)"),
    ("enum", rf"\benum\s+(?:class\s+)?(?P<name>{I})\s*(?::\s*\w+\s*)?(?=\{{)"),
    ("macro", rf"(?m)^[ \t]*#[ \t]*define[ \t]+(?P<name>{I})"),
    ("typedef", rf"\btypedef\s+[^;{{}}]*?(?P<name>{I})\s*;"),
]
PATTERNS = {
    "typescript": TS, "tsx": TS, "javascript": JS, "jsx": JS, "c": C,
    "cpp": [
        *(x for x in C if x[0] != "struct"),
        ("class", rf"\bclass\s+(?P<name>{I})\s*(?:final\s*)?(?::\s*(?P<base>[^{{}};]+?))?\s*(?=\{{)"),
        ("struct", rf"\bstruct\s+(?P<name>{I})\s*(?:final\s*)?(?::\s*(?P<base>[^{{}};]+?))?\s*(?=\{{)"),
        ("namespace", rf"\bnamespace\s+(?P<name>{I}(?:::{I})*)\s*(?=\{{)"),
    ],
    "rust": [
        ("function", rf"{MODIFIERS}\bfn\s+(?P<name>{I})\s*{GENERIC}\s*(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\))"),
        ("struct", rf"{MODIFIERS}\bstruct\s+(?P<name>{I})"),
        ("enum", rf"{MODIFIERS}\benum\s+(?P<name>{I})"),
        ("union", rf"{MODIFIERS}\bunion\s+(?P<name>{I})\s*{GENERIC}\s*(?=\{{)"),
        ("trait", rf"{MODIFIERS}\btrait\s+(?P<name>{I})\s*{GENERIC}(?:\s*:\s*(?P<base>[^{{}};]+?))?\s*(?:where[^{{}}]*)?(?=\{{)"),
        ("type_alias", rf"{MODIFIERS}\btype\s+(?P<name>{I})\s*{GENERIC}\s*="),
        ("constant", rf"{MODIFIERS}\b(?:const|static)\s+(?:mut\s+)?(?P<name>{I})\s*:"),
        ("module", rf"{MODIFIERS}\bmod\s+(?P<name>{I})\s*(?=[{{;])"),
        ("macro", rf"\bmacro_rules!\s*(?P<name>{I})"),
    ],
    "go": [
        ("method", rf"(?m)^func\s+\((?P<recv>[^()]*)\)\s*(?P<name>{I})\s*(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\))"),
        ("function", rf"(?m)^func\s+(?P<name>{I})\s*(?:\[[^\]]*\])?\s*(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\))"),
        ("struct", rf"(?m)^\s*type\s+(?P<name>{I})\s*(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", rf"(?m)^\s*type\s+(?P<name>{I})\s*(?:\[[^\]]*\])?\s+interface\b"),
        ("type_alias", rf"(?m)^\s*type\s+(?P<name>{I})\s*=?\s+(?!struct\b|interface\b)[\w\[\]*.]"),
        ("constant", rf"(?m)^const\s+(?P<name>(?!_\b){I})"),
        ("variable", rf"(?m)^var\s+(?P<name>(?!_\b){I})"),
    ],
    "java": [
        ("class", rf"{MODIFIERS}\b(?:class|record)\s+(?P<name>{I})\s*{GENERIC}(?:\([^()]*\))?(?:\s+extends\s+(?P<base>[\w.]+)\s*{GENERIC})?(?:\s+implements\s+(?P<impl>[^{{}}]+?))?\s*(?=\{{)"),
        ("interface", rf"{MODIFIERS}\binterface\s+(?P<name>{I})\s*{GENERIC}(?:\s+extends\s+(?P<base>[^{{}}]+?))?\s*(?=\{{)"),
        ("enum", rf"{MODIFIERS}\benum\s+(?P<name>{I})(?:\s+implements\s+(?P<impl>[^{{}}]+?))?\s*(?=\{{)"),
        ("method", FUNCTION_C),
        ("field", rf"(?m)^[ \t]+{MODIFIERS}(?P<ret>[A-Z][\w.<>,\[\]]*|int|long|boolean|double|float|char|byte|short)\s+(?P<name>{I})\s*(?=[=;])"),
    ],
    "csharp": [
        ("namespace", rf"\bnamespace\s+(?P<name>{I}(?:\.{I})*)\s*(?=[{{;])"),
        ("class", rf"{MODIFIERS}\b(?:class|record)\s+(?P<name>{I})\s*{GENERIC}(?:\s*:\s*(?P<mixed>[^{{}};]+?))?\s*(?=\{{)"),
        ("struct", rf"{MODIFIERS}\bstruct\s+(?P<name>{I})\s*{GENERIC}(?:\s*:\s*(?P<impl>[^{{}};]+?))?\s*(?=\{{)"),
        ("interface", rf"{MODIFIERS}\binterface\s+(?P<name>{I})\s*{GENERIC}(?:\s*:\s*(?P<base>[^{{}};]+?))?\s*(?=\{{)"),
        ("enum", rf"{MODIFIERS}\benum\s+(?P<name>{I})\s*(?::\s*\w+\s*)?(?=\{{)"),
        ("property", rf"(?m)^[ \t]+{MODIFIERS}(?P<ret>[\w.<>,\[\]?]+)\s+(?P<name>{I})\s*(?=\{{\s*(?:get|set|init)\b)"),
        ("method", FUNCTION_C),
    ],
    "php": [
        ("namespace", r"\bnamespace\s+(?P<name>[\w\\]+)\s*(?=[;{])"),
        ("class", rf"{MODIFIERS}\bclass\s+(?P<name>{I})(?:\s+extends\s+(?P<base>[\w\\]+))?(?:\s+implements\s+(?P<impl>[\w\\,\s]+?))?\s*(?=\{{)"),
        ("interface", rf"\binterface\s+(?P<name>{I})(?:\s+extends\s+(?P<base>[\w\\,\s]+?))?\s*(?=\{{)"),
        ("trait", rf"\btrait\s+(?P<name>{I})\s*(?=\{{)"),
        ("enum", rf"\benum\s+(?P<name>{I})[^{{}};]*(?=\{{)"),
        ("function", rf"{MODIFIERS}\bfunction\s+&?\s*(?P<name>{I})\s*(?P<args>\([^()]*(?:\([^()]*\)[^()]*)*\))"),
        ("constant", rf"{MODIFIERS}\bconst\s+(?P<name>{I})\s*="),
    ],
}
COMPILED = {lang: [(kind, re.compile(p)) for kind, p in pairs] for lang, pairs in PATTERNS.items()}

STRING = r"""["'](?P<path>[^"'\n]+)["']"""
# How each language imports: (kind, pattern with `path`), on text whose strings are kept.
IMPORTS = {
    "js": [
        ("static", rf"(?m)^\s*import\s+(?:type\s+)?(?:[^'\"();]*?\s+from\s+)?{STRING}"), ("re_export", rf"(?m)^\s*export\s+[^'\"();=]*?\s*from\s+{STRING}"),
        ("dynamic", rf"\bimport\(\s*{STRING}"), ("require", rf"\brequire\(\s*{STRING}"),
    ],
    "c": [("include", r'(?m)^[ \t]*#[ \t]*include[ \t]*"(?P<path>[^"\n]+)"'), ("include", r"(?m)^[ \t]*#[ \t]*include[ \t]*<(?P<path>[^>\n]+)>")],
    "rust": [("use", r"\buse\s+(?P<path>[^;]+);")],
    "go": [("import", r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<path>[^"\n]+)"\s*$')],
    "java": [("static", r"\bimport\s+static\s+(?P<path>[\w.]+(?:\.\*)?)\s*;"), ("import", r"\bimport\s+(?!static\b)(?P<path>[\w.]+(?:\.\*)?)\s*;")],
    "csharp": [("using", r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<path>[\w.]+)\s*;")],
    "php": [("use", r"(?m)^\s*use\s+(?:function\s+|const\s+)?(?P<path>[\w\\]+)[^;{]*;"), ("require", rf"\brequire(?:_once)?\s*\(?\s*{STRING}"), ("include", rf"\binclude(?:_once)?\s*\(?\s*{STRING}")],
}
FAMILY = {"typescript": "js", "tsx": "js", "javascript": "js", "jsx": "js", "cpp": "c"}

#: Words that no language lets a declaration or a call be named by.
RESERVED = frozenset("if for while switch catch return sizeof new throw else do try case function fn func".split())
KEYWORDS = RESERVED | frozenset(
    "typeof await match loop import export class struct enum interface trait impl use mod pub let const var static public private protected void int long char bool boolean float double string true false null nil "
    "self this super package namespace using extends implements in of as is and or not default break continue defer type where ref mut unsafe async yield final abstract foreach echo isset unset require include "
    "require_once include_once elif end declare override virtual internal readonly".split()
)
CALL = re.compile(r"(?P<recv>(?:[\w$)\]]+(?:\.|->|::|\?\.))*)(?P<name>[A-Za-z_$][\w$]*)(?P<bang>!?)\s*(?:::<[^()]*>)?\(")
WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


def _statement(code: str, start: int, least: int) -> int:
    """Where what stands before ``start`` begins: after the last end of a statement or block, and ``least`` characters before at any rate."""
    return max(0, min(start - least, max(code.rfind(c, 0, start) for c in ";{}") + 1))


BLOCKS = re.compile(r"\b(if|for|while|switch|match|try|catch|else|loop|do|foreach)\b[^{};]*$")


def blanked(raw: bytes, language: str) -> tuple[bytes, list[tuple[str, int, int]]]:
    """Code with comments and strings overwritten by spaces, byte for byte; and the comments."""
    out, comments = bytearray(raw), []
    spans = [(m.lastgroup, m.start(), m.end()) for m in LEX.finditer(raw)]
    if language == "php":
        spans += [("line", m.start(), m.end()) for m in HASH_COMMENT.finditer(raw)]
    for kind, start, end in spans:
        for k in range(start, end):
            if out[k] != 10:
                out[k] = 32
        if kind != "string":
            comments.append((kind, start, end))
    return bytes(out), comments


def braces(code: str) -> dict[int, int]:
    """The closing place of each opening brace; open ends close at the end."""
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs | dict.fromkeys(stack, len(code))


def visibility(language: str, mods: str, name: str) -> str:
    for word in ("public", "private", "protected", "internal"):
        if re.search(rf"\b{word}\b", mods):
            return word
    if language == "rust":
        return "internal" if "pub(" in mods else "public" if "pub" in mods else "private"
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "java":
        return "internal"
    if language == "csharp":
        return "private"
    if language in ("c", "cpp"):
        return "private" if "static" in mods else "public"
    return "public"


def exported(language: str, mods: str, name: str, seen: str, before: str) -> bool:
    if language in ("typescript", "tsx", "javascript", "jsx"):
        return "export" in mods or bool(re.search(r"\bexport\s+(?:default\s+)?$", before))
    if language in ("rust", "csharp"):
        return seen != "private"
    if language == "php":
        return seen == "public"
    return seen == "public"


def split_list(text: str | None) -> list[str]:
    return [x.strip() for x in re.split(r",(?![^<]*>)", text or "") if x.strip()]


def use_paths(path: str) -> list[str]:
    """Brace groups of an import, spread out: ``a::{b, c}`` is ``a::b`` and ``a::c``."""
    found = re.fullmatch(r"(?s)(.*?)\{(.*)\}", path.strip())
    if not found:
        return [re.sub(r"\s+as\s+\w+$", "", path.strip())]
    return [x for part in split_list(found[2]) for x in use_paths(found[1] + ("" if part == "self" else part))]


def parameters(args: str, language: str) -> list[tuple[str, str | None, bool, bool]]:
    """(name, type, optional, has default) of each parameter."""
    out = []
    for part in split_list(args.strip()[1:-1] if args.strip().startswith("(") else args):
        default = "=" in part
        part = part.split("=")[0].strip()
        if language in ("typescript", "tsx", "javascript", "jsx", "rust"):
            name, _, kind = part.partition(":")
            words = WORD.findall(name.replace("mut ", ""))
            if words and not name.strip().startswith(("{", "[")):
                out.append((words[-1], kind.strip() or None, name.strip().endswith("?"), default))
        elif language == "go":
            words = part.split(None, 1)
            out.append((words[0], words[1] if len(words) > 1 else None, False, default))
        elif language == "php":
            found = re.search(r"(?P<t>[\w\\?|&]+\s+)?&?(?:\.\.\.)?\$(?P<n>\w+)", part)
            if found:
                kind = (found["t"] or "").strip()
                out.append((found["n"], kind or None, kind.startswith("?"), default))
        else:
            found = re.fullmatch(r"(?s)(?P<t>.*?[\s*&>\]])(?P<n>[A-Za-z_]\w*)(?:\[\])?", part)
            if found:
                out.append((found["n"], " ".join(found["t"].split()), False, default))
    return out


def type_kind(display: str) -> str:
    if "|" in display:
        return "union"
    if "&" in display and not display.startswith("&") and not display.endswith("&"):
        return "intersection"
    if "=>" in display or display.startswith(("fn(", "func(")):
        return "function"
    if display.endswith("[]") or display.startswith("[]"):
        return "array"
    if display.startswith("("):
        return "tuple"
    if "<" in display:
        return "generic"
    head = display.strip("&*? ").lower()
    return "primitive" if head in PRIMITIVES else "named"


PRIMITIVES = frozenset("int long short byte char bool boolean float double void string str number any unknown never i8 i16 i32 i64 i128 u8 u16 u32 u64 u128 usize isize f32 f64 int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 rune error mixed object decimal size_t".split())


def attributes(facts: Facts, made: dict, mods: str, lead: str, match: re.Match, language: str) -> None:
    """The language's attribute row of a symbol."""
    marks = [x.strip() for x in re.findall(r"@([\w.]+)", lead)]

    def has(word: str) -> bool:
        return bool(re.search(rf"\b{word}\b", mods))

    ident, text = made["id"], match[0]
    if language == "rust":
        derives = [x for d in re.findall(r"#\[derive\(([^)]*)\)\]", lead) for x in split_list(d)]
        facts.add("rust_attrs", symbol_id=ident, is_unsafe=has("unsafe"), is_const=has("const") or made["kind"] == "constant", derives=derives)
    elif language in ("typescript", "tsx", "javascript", "jsx"):
        params = re.search(rf"{made['name']}\s*<([^<>]*)>", text)
        facts.add("typescript_attrs", symbol_id=ident, is_readonly=has("readonly"), is_optional=False, type_parameters=[x.split()[0] for x in split_list(params[1] if params else "")])
    elif language == "cpp":
        facts.add("cpp_attrs", symbol_id=ident, is_virtual=has("virtual"), is_const=bool(re.search(r"\)\s*const\b", text)), is_noexcept="noexcept" in text, is_template="template" in lead, is_constexpr=has("constexpr"), is_override="override" in text, is_final="final" in text)
    elif language == "c":
        gcc = [x for a in re.findall(r"__attribute__\s*\(\((.*?)\)\)", lead + text) for x in split_list(a)]
        facts.add("c_attrs", symbol_id=ident, is_file_static=has("static"), is_extern=has("extern"), is_inline=has("inline"), is_const=has("const"), is_volatile=has("volatile"), is_restrict="restrict" in text, gcc_attributes=gcc)
    elif language == "csharp":
        names = [x for a in re.findall(r"\[([^\]]+)\]", lead) for x in split_list(a)]
        facts.add("csharp_attrs", symbol_id=ident, attributes=names, is_partial=has("partial"), is_sealed=has("sealed"))
    elif language == "java":
        facts.add("java_attrs", symbol_id=ident, annotations=marks, is_final=has("final"), is_synchronized=has("synchronized"), throws_clause=split_list(match.groupdict().get("throws")))
    elif language == "go":
        tags = re.findall(r"//go:build\s+([^\n]+)", re.split(rb"(?m)^package\b", facts.raw, maxsplit=1)[0].decode("utf-8", "replace"))
        facts.add("go_attrs", symbol_id=ident, is_exported=made["exported"], has_receiver=made["kind"] == "method", build_tags=tags)
    elif language == "php":
        body = facts.raw[made["start"] : made["end"]].decode("utf-8", "replace") if made["kind"] in ("class", "trait") else ""
        uses = [x for u in re.findall(r"(?m)^\s+use\s+([\w\\,\s]+);", body) for x in split_list(u)]
        facts.add("php_attrs", symbol_id=ident, is_final=has("final"), uses_traits=uses, attributes=re.findall(r"#\[([\w\\]+)", lead))


def inheritance(facts: Facts, made: dict, match: re.Match, language: str) -> None:
    groups = match.groupdict()
    for base in split_list(groups.get("base")):
        base = re.sub(r"\b(?:public|private|protected|virtual)\s+", "", base)
        for part in base.split("+") if language == "rust" else [base]:
            if part.strip():
                facts.inherits(made, part.strip(), "extends")
    for base in split_list(groups.get("impl")):
        facts.inherits(made, base, "implements")
    for k, base in enumerate(split_list(groups.get("mixed"))):
        facts.inherits(made, base, "implements" if re.match(r"I[A-Z]", base) or k else "extends")


def extract(facts: Facts, text: str) -> None:
    """All facts of a file of a brace language."""
    language, raw = facts.language, facts.raw
    code_bytes, comments = blanked(raw, language)
    code = code_bytes.decode("latin-1")  # one character a byte, so places are byte offsets
    pairs = braces(code)
    opens = sorted(pairs)
    found: list[tuple[int, int, str, re.Match]] = []
    taken: set[int] = set()
    for kind, pattern in COMPILED.get(language, []):
        for m in pattern.finditer(code):
            name = m["name"]
            at = m.start("name")
            if at in taken or name in RESERVED:
                continue
            words = re.split(r"[\s*&]+", (m.groupdict().get("ret") or "").strip())
            if words and words[-1:] and words[0] in ("return", "else", "new", "throw", "case", "typedef"):
                continue
            taken.add(at)
            k = bisect.bisect_left(opens, m.end())
            end = m.end()
            if k < len(opens) and not re.search(r"[;}]", code[m.end() : opens[k]]) and kind not in ("variable", "constant", "type_alias", "typedef", "macro", "field"):
                end = pairs[opens[k]] + 1
            else:
                stop = re.compile(r"[;\n]").search(code, m.end())
                end = stop.start() if stop else len(code)
            lead = len(m[0]) - len(m[0].lstrip())
            found.append((m.start() + lead, min(end, len(raw)), kind, m))
    found.sort(key=lambda x: (x[0], -x[1]))
    symbols: list[dict] = []
    stack: list[dict] = []
    root = facts.scope("file", 0, len(raw), None)
    scopes = [(0, len(raw), root)]
    for start, end, kind, m in found:
        while stack and stack[-1]["end"] < end:
            stack.pop()
        owner = stack[-1] if stack else None
        name = m["name"].rpartition("::")[2] if kind in ("function", "method") else m["name"]
        if kind == "function" and owner and owner["kind"] in ("class", "struct", "trait", "interface", "enum") and language != "rust":
            kind = "method"
        if kind == "method" and language in ("typescript", "tsx", "javascript", "jsx") and not (owner and owner["kind"] in ("class", "interface")):
            continue
        if kind == "field" and not (owner and owner["kind"] in ("class", "interface", "enum")):
            continue
        mods = (m.groupdict().get("mods") or "") + (m.groupdict().get("ret") or "")
        before = code[_statement(code, start, 200) : start]
        lead = raw[_statement(code, start, 300) : start].decode("utf-8", "replace").rpartition("}")[2].rpartition(";")[2]
        seen = visibility(language, mods, name)
        made = facts.symbol(
            kind, name, start, end, owner, visibility=seen, exported=exported(language, mods, name, seen, before), is_async="async" in m[0].split(name)[0] or kind == "arrow_function" and "async" in m[0],
            is_static=bool(re.search(r"\bstatic\b", mods)), is_abstract=bool(re.search(r"\babstract\b", mods)), is_mutable=kind == "variable" and (m.groupdict().get("let") or "var") != "const" or "mut" in m[0].split(name)[0],
        )
        symbols.append(made)
        stack.append(made)
        attributes(facts, made, mods, lead + m[0].split(name)[0], m, language)
        inheritance(facts, made, m, language)
        holder = max((s for s in scopes if s[0] <= start and end <= s[1]), key=lambda s: s[0])[2]
        facts.binding(holder, name, start, "definition", made["id"])
        if kind in ("function", "method", "arrow_function", "class", "struct", "interface", "trait", "enum", "namespace", "module") and end > m.end():
            inner = {"method": "function", "arrow_function": "function", "struct": "class", "interface": "class", "trait": "class", "enum": "class"}.get(kind, kind)
            scopes.append((start, end, facts.scope(inner, start, end, holder)))
        if m.groupdict().get("args"):
            at = m.start("args")
            for k, (param, kind_text, optional, default) in enumerate(parameters(m["args"], language)):
                where = code.find(param, at)
                p = facts.symbol("parameter", param, max(where, at), max(where, at) + len(param), made)
                type_id = facts.type(kind_text, type_kind(kind_text)) if kind_text else None
                facts.add("parameter", id=p["id"], name=param, function_id=made["id"], position=k, type_id=type_id, is_optional=optional, has_default=default, is_taint_source=False)
                facts.binding(scopes[-1][2], param, max(where, at), "parameter", p["id"])
            after = re.match(r"\s*(?:->|:)?\s*([\w<>\[\]&*.:|?, ]+?)\s*(?=\{|;|=>|where\b)", code[m.end() :]) if language in ("rust", "go", "typescript", "tsx", "php") else None
            ret = after[1].strip() if after else " ".join((m.groupdict().get("ret") or "").split())
            if ret and ret not in ("", "void"):
                facts.add("returns_type", function_id=made["id"], type_id=facts.type(ret, type_kind(ret)))
            for thrown in split_list(m.groupdict().get("throws")):
                facts.add("throws", function_id=made["id"], exception_type_id=facts.type(thrown, "named"))
            if language in ("csharp", "php"):
                for t in sorted(set(re.findall(r"\bthrow\s+new\s+([\w\\.]+)", code[start:end]))):
                    facts.add("throws", function_id=made["id"], exception_type_id=facts.type(t, "named"))
        elif m.groupdict().get("ret") and kind in ("field", "property"):
            shown = " ".join(m["ret"].split())
            facts.add("field_type", symbol_id=made["id"], type_id=facts.type(shown, type_kind(shown)))
    for m in re.finditer(r"\b(?:impl)\s*(?:<[^>]*>)?\s*([\w:]+)[^{}]*?\bfor\s+([\w:]+)", code) if language == "rust" else ():
        child = next((s for s in symbols if s["name"] == m[2].rpartition("::")[2] and s["kind"] in ("struct", "enum", "union")), None)
        if child:
            facts.inherits(child, m[1], "implements")

    for start in opens:
        block = BLOCKS.search(code[_statement(code, start, 200) : start])
        if block:
            holder = max((s for s in scopes if s[0] <= start and pairs[start] <= s[1]), key=lambda s: s[0])[2]
            scopes.append((start, pairs[start], facts.scope(f"{block[1]}_statement", start, pairs[start], holder)))

    kept = bytearray(raw)
    for _, a, b in comments:
        kept[a:b] = re.sub(rb"[^\n]", b" ", raw[a:b])
    plain = kept.decode("latin-1")
    places = sorted((m.start("path"), kind, m["path"]) for kind, p in IMPORTS.get(FAMILY.get(language, language), []) for m in re.finditer(p, plain))
    if language == "go":
        places = [x for x in places if re.search(r"\bimport\b[^)]*$", plain[: x[0]])]
    for at, kind, path in places:
        for one in use_paths(path) if language in ("rust", "php") and kind == "use" else [path]:
            facts.imported(one.encode("latin-1").decode("utf-8", "replace"), kind)
            facts.binding(root, re.split(r"[/\\.:]+", one.rstrip("*./"))[-1] or one, at, "wildcard_import" if one.endswith("*") else "import")

    declared = {m.start("name") for _, _, _, m in found}
    for m in CALL.finditer(code):
        name, at = m["name"], m.start("name")
        if name in RESERVED or name in ("match", "isset", "unset", "require", "include") or at in declared:
            continue
        line = facts.place(at)[0]
        caller = caller_of(symbols, line)
        close = code.find(")", m.end())
        receiver = re.sub(r"(?:\.|->|::|\?\.)$", "", m["recv"]) or None
        facts.call(caller["id"] if caller else None, name, receiver, m.start(), close + 1 if close >= 0 else m.end())
    for m in WORD.finditer(code):
        if m[0] in KEYWORDS or m.start() in declared:
            continue
        prev, nxt = code[max(0, m.start() - 2) : m.start()].strip()[-1:], code[m.end() : m.end() + 3].lstrip()
        if prev == "." and not nxt.startswith("("):
            continue  # a member's tail is no name of its own
        kind = "call" if nxt.startswith("(") else "write" if re.match(r"=[^=>]", nxt) else "type_use" if prev in (":", "<") and m[0][:1].isupper() else "read"
        held = innermost(symbols, m.start())
        scope = max((s for s in scopes if s[0] <= m.start() <= s[1]), key=lambda s: s[0])[2]
        facts.occurrence(m[0], m.start(), m.end(), kind, held["id"] if held else None, scope)
    if language in ("java", "csharp"):
        for m in re.finditer(rf"\b(?P<t>[A-Z]\w*)(?:<[^<>;]*>)?\s+(?P<n>{I})\s*=\s*new\s+(?P<c>[A-Z]\w*)|\bvar\s+(?P<v>{I})\s*=\s*new\s+(?P<d>[A-Z]\w*)", code):
            facts.add("local_type", file_path=facts.path, name=m["n"] or m["v"], type_name=m["t"] or m["d"], start_byte=m.start())
    tops = sorted(symbols, key=lambda s: s["start"])
    for kind, a, b in comments:
        after = next((s for s in tops if s["start"] >= b), None)
        following = after["id"] if after and not code[b : after["start"]].strip() else None
        facts.comment(raw[a:b].decode("utf-8", "replace"), kind, a, b, following)

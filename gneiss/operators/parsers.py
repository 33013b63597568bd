"""Regular-expression parsers of further languages, native projects and route frameworks, one row for each finding.

Each parser is a plain function from path and text to tuples; ``parsed`` runs
one over Arrow batches, and a text that breaks it gives a parse_error row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

_TS = re.compile(r"^[ \t]*(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?:async\s+)?(?P<function>function)\s*\*?|(?P<class>class)|(?P<interface>interface)|(?P<type>type)|(?P<enum>enum)|(?P<const>const|let|var))\s+(?P<name>[A-Za-z_$][\w$]*)(?P<rest>[^\n]*)", re.MULTILINE)
_CS = re.compile(r"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|async|override|virtual|readonly)\s+)*(?:(?P<kind>class|interface|struct|record|enum|namespace)\s+(?P<type>[A-Za-z_][\w.]*)|[\w<>\[\],.?]+\s+(?P<method>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:\{|=>|$))", re.MULTILINE)
_C = re.compile(r"^(?:typedef\s+)?(?P<kind>struct|enum|union|class)\s+(?P<type>[A-Za-z_]\w*)\s*\{|^#define\s+(?P<macro>[A-Za-z_]\w*)|^(?!\s*(?:return|else|if|while|for|switch)\b)[A-Za-z_][\w\s*&:<>]*?[\s*&](?P<function>[A-Za-z_][\w:~]*)\s*\((?P<args>[^;{}()]*)\)\s*(?:const\s*)?(?P<end>[{;])", re.MULTILINE)
_PAS = re.compile(r"^[ \t]*(?:(?P<unit>unit|program|library)\s+(?P<name>[\w.]+)\s*;|(?:type\s+)?(?P<type>[A-Za-z_]\w*)\s*=\s*(?:packed\s+)?(?P<kind>class|record|interface|object)\b|(?:class\s+)?(?P<routine>procedure|function|constructor|destructor)\s+(?P<own>[\w.]+)|(?P<property>property)\s+(?P<prop>\w+))", re.MULTILINE | re.IGNORECASE)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def typescript(path: str, text: str) -> Iterator[tuple]:
    for m in _TS.finditer(text):
        name = m["name"]
        arrow = m["const"] and re.match(r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", m["rest"])
        kind = next(k for k in ("function", "class", "interface", "type", "enum", "const") if m[k])
        if kind == "function" or arrow:
            kind = "hook" if re.match(r"use[A-Z]", name) else "component" if name[0].isupper() and path.endswith(("x", "js")) else "function"
        yield path, kind, name, _line(text, m.start("name")), "default" if m["default"] else "exported" if m["export"] else ""


def csharp(path: str, text: str) -> Iterator[tuple]:
    space = ""
    for m in _CS.finditer(text):
        if m["kind"] == "namespace":
            space = m["type"]
        elif m["kind"]:
            yield path, {"interface": "interface", "class": "class"}.get(m["kind"], "type"), f"{space}.{m['type']}".strip("."), _line(text, m.start("type")), ""
        elif m["method"] not in ("if", "for", "while", "switch", "using", "lock", "catch", "return", "new"):
            yield path, "method", f"{space}.{m['method']}".strip("."), _line(text, m.start("method")), ""


def c_family(path: str, text: str) -> Iterator[tuple]:
    role = "header" if path.endswith((".h", ".hpp", ".hh")) else "source"
    for m in _C.finditer(text):
        kind, group = (m["kind"], "type") if m["type"] else ("macro", "macro") if m["macro"] else ("function" if m["end"] == "{" else "declaration", "function")
        yield path, kind, m[group], _line(text, m.start(group)), role


def pascal(path: str, text: str) -> Iterator[tuple]:
    for m in _PAS.finditer(text):
        group, kind = ("name", "module") if m["unit"] else ("type", m["kind"].lower() if m["kind"] else "") if m["type"] else ("own", "method" if "." in (m["own"] or "") else "function") if m["routine"] else ("prop", "property")
        yield path, kind, m[group], _line(text, m.start(group)), ""


def pascal_form(path: str, text: str) -> Iterator[tuple]:
    """Components of a form, named by the way from the root."""
    open_: list[str] = []
    for number, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*(\w+)", line):
            open_.append(m[1])
            yield path, "component", ".".join(open_), number, m[2]
        elif re.match(r"\s*end\b", line) and open_:
            open_.pop()
        elif (m := re.match(r"\s*(On\w+)\s*=\s*(\w+)", line)) and open_:
            yield path, "event", ".".join([*open_, m[1]]), number, m[2]


def project(path: str, text: str) -> Iterator[tuple]:
    for kind, pattern in (("project_reference", r'<ProjectReference\s+Include="([^"]+)"'), ("package_reference", r'<PackageReference\s+Include="([^"]+)"'), ("project", r'^Project\("[^"]*"\)\s*=\s*"([^"]+)"'), ("target", r"\badd_(?:executable|library)\s*\(\s*([\w.-]+)"), ("dependency", r'^\s*"((?:@[\w-]+/)?[\w.-]+)"\s*:\s*"[\^~]?\d')):
        for m in re.finditer(pattern, text, re.MULTILINE):
            yield path, kind, m[1].replace("\\", "/"), _line(text, m.start(1)), ""


def _balanced(text: str, at: int) -> str:
    """What stands in the parentheses that open at ``at``; strings may hold parentheses."""
    depth, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return text[at + 1 : i]
        i += 1
    return text[at + 1 :]


def _join(*parts: str) -> str:
    return "/" + "/".join(x.strip("/") for x in parts if x.strip("/"))


def decorator_routes(path: str, text: str) -> Iterator[tuple]:
    """Routes of decorators such as @app.get("/x") and @app.route("/x", methods=["GET", "POST"]): kind is the method."""
    for m in re.finditer(r"@[\w.]+\.(route|get|post|put|delete|patch)\s*\(", text):
        inner = _balanced(text, m.end() - 1)
        if route := re.match(r"""\s*r?["']([^"']*)["']""", inner):
            methods = re.findall(r"""["'](\w+)["']""", (re.search(r"methods\s*=\s*[\[(]([^\])]*)", inner) or ["", ""])[1]) if m[1] == "route" else [m[1]]
            handler = re.search(r"\bdef\s+(\w+)", text[m.end() :])
            for method in methods or ["GET"]:
                yield path, method.upper(), _join(route[1]), _line(text, m.start()), handler[1] if handler else ""


def controller_routes(path: str, text: str) -> Iterator[tuple]:
    """Nest, Spring and ASP.NET controllers: the class's prefix and the method's mapping."""
    marks = []
    for m in re.finditer(r"""@Controller\(\s*["']?([^"')]*)["']?\s*\)|@RequestMapping\(\s*(?:value\s*=\s*)?"([^"]*)"[^)]*\)(?=[^;{]*\bclass\b)|\[Route\("([^"]*)"\)\](?=[^;{]*\bclass\s+(\w+?)(?:Controller)?\b)""", text):
        prefix = next((x for x in m.groups()[:3] if x is not None), "")
        marks.append((m.start(), prefix.replace("[controller]", (m[4] or "").lower())))
    for m in re.finditer(r"""(?:@(Get|Post|Put|Delete|Patch)(?:Mapping)?\s*\(\s*(?:value\s*=\s*)?["']?([^"')]*)["']?\s*\)|\[Http(Get|Post|Put|Delete|Patch)(?:\("([^"]*)"\))?\])""", text):
        prefix = next((p for at, p in reversed(marks) if at < m.start()), "")
        yield path, (m[1] or m[3]).upper(), _join(prefix, m[2] or m[4] or ""), _line(text, m.start()), ""


def minimal_routes(path: str, text: str) -> Iterator[tuple]:
    for m in re.finditer(r"""\.Map(Get|Post|Put|Delete|Patch)\(\s*"([^"]*)\"""", text):
        yield path, m[1].upper(), _join(m[2]), _line(text, m.start()), ""


def response_keys(path: str, text: str) -> Iterator[tuple]:
    """Keys of dictionaries that are returned, nested ones with their parent."""
    for m in re.finditer(r"\breturn\s*(?:jsonify\s*\(|res\.json\s*\()?\s*\{", text):
        yield from ((path, "key", k, _line(text, m.start()), "") for k in _keys(_balanced(text, m.end() - 1), ""))


def _keys(body: str, parent: str) -> Iterator[str]:
    at = 0
    for m in re.finditer(r"""["']?([A-Za-z_]\w*)["']?\s*:(?!:)|[\[{(]""", body):
        if m.start() < at:
            continue
        if m[1] is None:
            at = m.start() + len(_balanced(body, m.start())) + 2
            continue
        name = f"{parent}{m[1]}"
        yield name
        rest = body[m.end() :]
        if opened := re.match(r"\s*([\[{])", rest):
            inner = _balanced(rest, opened.end() - 1)
            at = m.end() + opened.end() + len(inner) + 1
            if opened[1] == "{":
                yield from _keys(inner, name + ".")


def consumer_keys(path: str, text: str) -> Iterator[tuple]:
    """Fields read from what a fetch returned: by destructuring, or through a variable that holds it."""
    names = set(re.findall(r"\b(?:const|let|var)\s+(\w+)\s*=\s*await\s+(?:\(await\s+)?\w*(?:fetch|axios|\.json)", text)) | {"data", "response"}
    for m in re.finditer(r"\b(?:const|let|var)\s*\{([^}]*)\}\s*=\s*(?:await\b[^;\n]*|(\w+))", text):
        if m[2] is None or m[2] in names:
            for k in re.findall(r"(\w+)\s*(?::\s*\w+)?\s*(?:=[^,]*)?(?:,|$)", m[1]):
                yield path, "reads", k, _line(text, m.start()), ""
    for m in re.finditer(r"\b(\w+)(?:\?)?\.((?:\w+\??\.)*\w+)", text):
        if m[1] in names and m[2] not in ("json", "text", "ok", "status"):
            yield path, "reads", m[2].replace("?", ""), _line(text, m.start()), ""


def model_shapes(path: str, text: str) -> Iterator[tuple]:
    """Fields of pydantic models and C# records: kind is the type."""
    for m in re.finditer(r"^class\s+(\w+)\([^)]*BaseModel[^)]*\):\n((?:[ \t]+[^\n]*\n?|\n)*)", text, re.MULTILINE):
        for f in re.finditer(r"^[ \t]+(\w+)\s*:\s*([^=\n]+)", m[2], re.MULTILINE):
            yield path, f[2].strip(), f"{m[1]}.{f[1]}", _line(text, m.start(2) + f.start(1)), ""
    for m in re.finditer(r"\b(?:class|record)\s+(\w+)[^{]*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}", text):
        for f in re.finditer(r"public\s+([\w<>?\[\]]+)\s+(\w+)\s*\{\s*get", m[2]):
            yield path, f[1], f"{m[1]}.{f[2]}", _line(text, m.start(2) + f.start(2)), ""


def expanded_macros(path: str, text: str, rounds: int = 3, longest: int = 200) -> Iterator[tuple]:
    """Object-like macros with their bodies, in which macros are replaced for so many rounds."""
    bodies = {m[1]: m[2].strip() for m in re.finditer(r"^#define[ \t]+([A-Za-z_]\w*)[ \t]+([^\n]*)", text, re.MULTILINE) if len(m[2]) <= longest}
    for _ in range(rounds):
        bodies = {k: re.sub(r"\b[A-Za-z_]\w*\b", lambda m, k=k: bodies.get(m[0], m[0]) if m[0] != k else m[0], v)[:longest] for k, v in bodies.items()}
    for name, body in bodies.items():
        yield path, "macro", name, 0, body


def compile_commands(path: str, text: str) -> Iterator[tuple]:
    """Include folders and defines of a compilation database."""
    import json

    for entry in json.loads(text):
        command = entry.get("command") or " ".join(entry.get("arguments", ()))
        for flag, value in re.findall(r"-(I|D|isystem)\s*(\S+)", command):
            yield path, "define" if flag == "D" else "include", value, 0, entry.get("file", "")


PARSERS: dict[str, Callable[[str, str], Iterator[tuple]]] = {f.__name__: f for f in (typescript, csharp, c_family, pascal, pascal_form, project, decorator_routes, controller_routes, minimal_routes, response_keys, consumer_keys, model_shapes, expanded_macros, compile_commands)}
SCHEMA = "file_path string, kind string, name string, line int, detail string"


def parsed(files: DataFrame, parser: str | Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """(path, text) -> file_path, kind, name, line, detail by a registered parser or a function of one's own."""
    parse = PARSERS[parser] if isinstance(parser, str) else parser

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += parse(path, text or "")
                except Exception as e:  # one broken file must not end the run; it is reported
                    rows.append((path, "parse_error", "", 0, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["file_path", "kind", "name", "line", "detail"])

    return files.select("path", "text").mapInPandas(run, SCHEMA)

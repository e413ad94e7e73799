"""Facts of source texts: symbols, imports, calls, inheritance, bindings, routes, mounts, tables, queries.

Parsing is the one step that SQL functions can't express; files are independent, so it is one
mapInArrow over (path, text, language), and every later step is a join. Only the kinds of facts that
are asked for are made.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import FACTS

FACT = "fact string, path string, name string, owner string, detail string, line int, end_line int, extra map<string,string>, items array<string>"
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
SQL_TEXT = re.compile(r"^\s*(select|insert|update|delete|create|alter|drop|with)\b", re.I)


def module_of(path: str) -> str:
    out = re.sub(r"\.[A-Za-z0-9]+$", "", path)
    out = re.sub(r"(^|/)(__init__|index|init)$", "", out)
    return out.replace("/", ".") or "root"


#: expressions that stand before a dot or a bracket as they are
ATOMS = frozenset((ast.Name, ast.Attribute, ast.Call, ast.Subscript))
LITERALS = frozenset((str, int, bool, type(None)))


def listed(nodes: list[ast.AST]) -> str | None:
    texts = [plain(n) for n in nodes]
    return None if None in texts else ", ".join(texts)


def plain(node: ast.AST) -> str | None:
    """What ast.unparse writes of the commonest expressions, at a small part of its cost; None for others."""
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if kind is ast.Constant:
        return repr(node.value) if type(node.value) in LITERALS and node.kind is None else None
    if kind is ast.Attribute:
        x = plain(node.value) if type(node.value) in ATOMS else None
        return None if x is None else f"{x}.{node.attr}"
    if kind is ast.Subscript:
        x, y = plain(node.value) if type(node.value) in ATOMS else None, plain(node.slice)
        return None if x is None or y is None else f"{x}[{y}]"
    if kind is ast.keyword:
        x = None if node.arg is None else plain(node.value)
        return None if x is None else f"{node.arg}={x}"
    if kind is ast.Call:
        x, y = plain(node.func) if type(node.func) in ATOMS else None, listed([*node.args, *node.keywords])
        return None if x is None or y is None else f"{x}({y})"
    if kind is ast.Dict:
        x = None if None in node.keys else [(plain(k), plain(v)) for k, v in zip(node.keys, node.values)]
        return None if x is None or any(None in kv for kv in x) else "{" + ", ".join(f"{k}: {v}" for k, v in x) + "}"
    if kind is ast.arg:
        x = None if node.annotation is None else plain(node.annotation)
        return node.arg if node.annotation is None else None if x is None else f"{node.arg}: {x}"
    if kind is ast.arguments and not (node.posonlyargs or node.vararg or node.kwonlyargs or node.kwarg):
        names, given = [plain(a) for a in node.args], [plain(d) for d in node.defaults]
        if None in names or None in given:
            return None
        bare = len(names) - len(given)
        return ", ".join([*names[:bare], *(f"{a}={d}" for a, d in zip(names[bare:], given))])
    return None


def text_of(node: ast.AST | None) -> str:
    if node is None:
        return ""
    text = plain(node)
    return ast.unparse(node) if text is None else text


#: kinds of facts that each language has
KINDS = {
    "python": ("symbols", "imports", "calls", "inheritance", "bindings", "routes", "mounts", "tables", "queries", "queues", "injects", "env", "fields", "files"),
    "javascript": ("symbols", "imports", "calls", "inheritance", "routes", "mounts", "fetches"), "typescript": ("symbols", "imports", "calls", "inheritance", "routes", "mounts", "fetches"),
    "sql": ("tables", "queries"), "html": ("assets",), "luau": ("symbols", "imports", "services"),
}
#: those that are found in or beside calls and bindings
INNER = frozenset(("calls", "bindings", "mounts", "queries", "queues", "env"))
#: a name without which a module has no such fact
SIGNS = {"tables": ("__tablename__",), "injects": ("Depends",), "env": ("getenv", "environ")}
LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store))


class Python(ast.NodeVisitor):
    """One pass over a module's tree; a stack of scopes names what is found."""

    def __init__(self, path: str, text: str, kinds: Collection[str] = KINDS["python"]):
        self.path, self.lines, self.module = path, text.splitlines(), module_of(path)
        self.kinds = {*kinds, "symbols"} if "queues" in kinds else set(kinds)  # decorators make consumers
        self.inner = not INNER.isdisjoint(kinds)
        self.scopes: list[tuple[str, str]] = []  # (name, kind)
        self.branches = 0
        self.rows: list[tuple] = []

    @property
    def scope(self) -> str:
        return ".".join([self.module, *(n for n, _ in self.scopes)])

    def visit(self, node):
        VISITS.get(type(node), Python.generic_visit)(self, node)

    def generic_visit(self, node):
        for field in node._fields:
            value = getattr(node, field, None)
            for x in value if isinstance(value, list) else (value,):
                if isinstance(x, ast.AST) and type(x) not in LEAVES and (self.inner or not isinstance(x, ast.expr)):
                    self.visit(x)

    def add(self, fact, name, owner="", detail="", line=0, end=None, items=(), **extra):
        if fact not in self.kinds:
            return
        self.rows.append((fact, self.path, name, owner, detail, line, end or line, {k: str(v) for k, v in extra.items()}, list(items)))

    def symbol(self, node, kind: str):
        qualified = f"{self.scope}.{node.name}"
        args = node.args if kind != "class" else None
        if "symbols" in self.kinds:
            self.described(node, kind, qualified, args)
        if "routes" in self.kinds:
            for d in node.decorator_list:
                self.route(d, qualified)
        if args and "injects" in self.kinds:
            defaults = [*args.defaults, *(d for d in args.kw_defaults if d)]
            for d in [*defaults, *(a.annotation for a in args.args if a.annotation)]:
                for c in ast.walk(d):
                    if isinstance(c, ast.Call) and text_of(c.func).split(".")[-1] == "Depends" and c.args:
                        self.add("injects", text_of(c.args[0]), qualified, "Depends", node.lineno)

    def described(self, node, kind: str, qualified: str, args: ast.arguments | None):
        body = "\n".join(x.strip() for x in self.lines[node.lineno - 1 : node.end_lineno])
        decorators = [text_of(d) for d in node.decorator_list]
        names = [a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs]] if args else []
        self.add(
            "symbols", node.name, self.scope, kind, node.lineno, node.end_lineno, decorators, qualified=qualified, signature=f"({text_of(args)})" if args else "", parameters=len(names),
            returns=text_of(getattr(node, "returns", None)), doc=(ast.get_docstring(node) or "").split("\n")[0], hash=hashlib.sha256(body.encode()).hexdigest(),
        )

    def route(self, d: ast.expr, handler: str):
        if not isinstance(d, ast.Call) or not isinstance(d.func, ast.Attribute) or not d.args or not isinstance(d.args[0], ast.Constant) or not isinstance(d.args[0].value, str):
            return
        owner, verb = text_of(d.func.value), d.func.attr
        if verb in VERBS:
            self.add("routes", d.args[0].value, owner, verb.upper(), d.lineno, framework="fastapi", handler=handler)
        elif verb == "route":
            methods = next(([e.value for e in k.value.elts if isinstance(e, ast.Constant)] for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), ["GET"])
            for m in methods:
                self.add("routes", d.args[0].value, owner, m.upper(), d.lineno, framework="flask", handler=handler)

    def nested(self, node, kind: str):
        self.symbol(node, kind)
        self.scopes.append((node.name, kind))
        held, self.branches = self.branches, 0
        for child in node.body:
            self.visit(child)
        self.branches = held
        self.scopes.pop()

    def visit_FunctionDef(self, node):
        self.nested(node, "method" if self.scopes and self.scopes[-1][1] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        for b in node.bases if "inheritance" in self.kinds else ():
            self.add("inheritance", text_of(b), f"{self.scope}.{node.name}", "EXTENDS", node.lineno)
        if "tables" in self.kinds:
            self.model(node)
        if "fields" in self.kinds:
            self.fields(node)
        self.nested(node, "class")

    def fields(self, node):
        """Input fields of a class that validates data: annotated names, with what Field(...) says."""
        if not any(text_of(b).split(".")[-1] in ("BaseModel", "SQLModel", "Schema") for b in node.bases) and not any("dataclass" in text_of(d) for d in node.decorator_list):
            return
        for s in node.body:
            if not isinstance(s, ast.AnnAssign) or not isinstance(s.target, ast.Name):
                continue
            kind, value = text_of(s.annotation), s.value
            optional = "Optional[" in kind or "None" in kind
            call = isinstance(value, ast.Call) and text_of(value.func).split(".")[-1] in ("Field", "field")
            words = {k.arg: text_of(k.value) for k in value.keywords} if call else {}
            given = text_of(value.args[0]) if call and value.args else words.get("default", words.get("default_factory", "..." if call else text_of(value)))
            base = re.sub(r"Optional\[(.*)\]|\s*\|\s*None|None\s*\|\s*", lambda m: m[1] or "", kind)
            self.add("fields", s.target.id, f"{self.scope}.{node.name}", base, s.lineno, required=given in ("", "...") and not (optional and given == ""), nullable=optional, most=words.get("max_length", ""), default="" if given == "..." else given)

    def model(self, node):
        """Columns of a class that names its table."""
        table = next((s.value.value for s in node.body if isinstance(s, ast.Assign) and text_of(s.targets[0]) == "__tablename__" and isinstance(s.value, ast.Constant)), None)
        if not table:
            return
        for s in node.body:
            target = s.targets[0] if isinstance(s, ast.Assign) else s.target if isinstance(s, ast.AnnAssign) else None
            value = getattr(s, "value", None)
            if target is None or not isinstance(value, ast.Call) or text_of(value.func).split(".")[-1] not in ("Column", "mapped_column"):
                continue
            kinds = [text_of(a.func if isinstance(a, ast.Call) else a).split(".")[-1] for a in value.args]
            foreign = next((a.args[0].value for a in value.args if isinstance(a, ast.Call) and text_of(a.func).split(".")[-1] == "ForeignKey" and a.args and isinstance(a.args[0], ast.Constant)), "")
            flags = {k.arg: text_of(k.value) for k in value.keywords}
            data = next((k for k in kinds if k != "ForeignKey"), text_of(getattr(s, "annotation", None)))
            self.add("tables", text_of(target), table, data, s.lineno, nullable=flags.get("nullable", "True") == "True" and flags.get("primary_key") != "True", primary=flags.get("primary_key") == "True", target=foreign, model=f"{self.scope}.{node.name}")

    def visit_Import(self, node):
        for a in node.names:
            self.add("imports", "", a.name, a.asname or "", node.lineno, level=0)

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.add("imports", a.name, node.module or "", a.asname or "", node.lineno, level=node.level)

    def visit_Call(self, node):
        callee = text_of(node.func)
        args = [text_of(a) for a in node.args] if "calls" in self.kinds or "mounts" in self.kinds else []
        self.add("calls", callee, self.scope, "", node.lineno, items=args)
        first = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else None
        keywords = {k.arg: k.value for k in node.keywords}
        last = callee.split(".")[-1]
        if last in ("include_router", "register_blueprint") and args:
            prefix = keywords.get("prefix") or keywords.get("url_prefix")
            self.add("mounts", args[0], callee.rpartition(".")[0], prefix.value if isinstance(prefix, ast.Constant) else "", node.lineno)
        if first is not None and SQL_TEXT.match(first):
            self.add("queries", first, self.scope, "", node.lineno)
        if first is not None and last in ("send", "publish", "produce", "send_message"):
            self.add("queues", first, self.scope, "PRODUCER", node.lineno)
        if first is not None and callee in ("os.getenv", "os.environ.get", "environ.get"):
            self.add("env", first, self.scope, "READS_ENV", node.lineno)
        self.generic_visit(node)

    def bind(self, target, value, line):
        if "bindings" not in self.kinds:
            return
        for t in target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]:
            if isinstance(t, ast.Name):
                kind = {ast.Call: "call", ast.Name: "alias", ast.Attribute: "attribute", ast.Dict: "dict", ast.List: "list", ast.Subscript: "subscript"}.get(type(value), "literal")
                self.add("bindings", t.id, self.scope, kind, line, source=text_of(value), conditional=self.branches > 0)

    def visit_Assign(self, node):
        for t in node.targets:
            self.bind(t, node.value, node.lineno)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if node.value is not None:
            self.bind(node.target, node.value, node.lineno)
        self.generic_visit(node)

    def branch(self, node):
        self.branches += 1
        self.generic_visit(node)
        self.branches -= 1

    visit_If = visit_For = visit_While = visit_Try = branch


VISITS = {getattr(ast, name[6:]): f for name, f in vars(Python).items() if name.startswith("visit_")}


OLD_EXCEPT = re.compile(r"^(\s*except\s+)([A-Za-z_.]+\s*,\s*[A-Za-z_., ]+):", re.M)


def python_facts(path: str, text: str, kinds: Collection[str] = KINDS["python"]) -> list[tuple]:
    """Facts of a module. Text that does not parse is mended once, else only its imports are found."""
    if text.isascii() and all(k in SIGNS and not any(x in text for x in SIGNS[k]) for k in kinds):
        return []  # in other texts a name may be written in several ways
    for source in (text, OLD_EXCEPT.sub(r"\1(\2):", text)):
        try:
            v = Python(path, source, kinds)
            v.visit(ast.parse(source))
            for d in v.rows if "queues" in kinds else ():
                if d[0] == "symbols":
                    for deco in d[8]:
                        if m := re.match(r"[\w.]*(?:consumer|subscriber|task)\((['\"])(.+?)\1", deco):
                            v.add("queues", m[2], d[7]["qualified"], "CONSUMER", d[5])
            return v.rows
        except (SyntaxError, ValueError, RecursionError):
            continue
    rows = [("files", path, "", "", "parse_failed", 0, 0, {}, [])]
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*(?:from\s+(\.*)([\w.]*)\s+)?import\s+([\w*]+)", line):
            rows.append(("imports", path, m[3] if m[2] or m[1] else "", m[2] or (m[3] if not m[1] else ""), "", n, n, {"level": str(len(m[1] or ""))}, []))
    return rows


JS = {
    "symbols": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:(?P<kind>function\*?|class|interface)\s+(?P<name>[A-Za-z_$][\w$]*)|(?:const|let|var)\s+(?P<const>[A-Za-z_$][\w$]*)\s*(?::\s*[^=]+)?=\s*(?:async\s*)?(?:\((?P<arrow>(?:[^()]|\([^()]*\))*)\)\s*(?::\s*(?P<made>[\w$<>\[\]., |]+?)\s*)?|(?P<one>[\w$]+)\s*)=>)"),
    "parameters": re.compile(r"\s*(?:<[^>]*>)?\s*\((?P<list>(?:[^()]|\([^()]*\))*)\)\s*(?::\s*(?P<returns>[\w$<>\[\]., |]+?)\s*)?(?:\{|$)"),
    "extends": re.compile(r"\bextends\s+([\w$.]+)"), "implements": re.compile(r"\bimplements\s+([\w$., ]+)"),
    "method": re.compile(r"^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?P<name>#?[A-Za-z_$][\w$]*)(?P<rest>\s*\((?:[^()]|\([^()]*\))*\)[^;{]*\{)"),
    "imports": re.compile(r"^\s*(?:import\s+(?:(.+?)\s+from\s+)?|export\s+.+?\s+from\s+|.*\brequire\()['\"]([^'\"]+)['\"]"),
    "routes": re.compile(r"\b([A-Za-z_$][\w$]*)\.(get|post|put|patch|delete|all)\(\s*['\"`](/[^'\"`]*)['\"`]\s*,\s*(?:.*?([A-Za-z_$][\w$.]*)\s*\)?;?\s*$)?"),
    "mounts": re.compile(r"\b([A-Za-z_$][\w$]*)\.use\(\s*['\"`](/[^'\"`]*)['\"`]\s*,\s*([A-Za-z_$][\w$.]*)"),
    "fetches": re.compile(r"\b(?:fetch|axios(?:\.(get|post|put|patch|delete))?)\(\s*['\"`]([^'\"`]+)['\"`](?:.*?method:\s*['\"](\w+)['\"])?"),
    "calls": re.compile(r"([A-Za-z_$][\w$.]*)\s*\("),
}
JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "require", "import", "super", "async", "await", "constructor"}


def arguments_of(text: str) -> list[str]:
    """Parts of a list by commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and (depth <= 0 or i == len(text)):
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in out if x]


def script_facts(path: str, text: str) -> list[tuple]:
    """Facts of JavaScript and TypeScript by lines and braces. What a brace opens ends where it closes;
    a symbol's body hash is that of its lines without their margins, as for Python."""
    lines, rows, module = text.splitlines(), [], module_of(path)
    open_: list[tuple[str, str, int, int]] = []  # name, kind, depth, place in rows
    depth = 0
    put = lambda fact, name, owner, detail, line, items=(), **extra: rows.append((fact, path, name, owner, detail, line, line, {k: str(v) for k, v in extra.items()}, list(items)))

    def close(at: int, last: int):
        r = rows[at]
        body = "\n".join(x.strip() for x in lines[r[5] - 1 : last])
        rows[at] = (*r[:6], last, r[7] | {"hash": hashlib.sha256(body.encode()).hexdigest()}, r[8])

    for n, line in enumerate(lines, 1):
        code = re.sub(r"//.*$", "", line) if "://" not in line else line
        scope, own = ".".join([module, *(x[0] for x in open_)]), None
        inside = open_[-1] if open_ else None
        m = JS["symbols"].match(code)
        member = JS["method"].match(code) if not m and inside and inside[1] == "class" and depth == inside[2] + 1 else None
        if m or member:
            kind = "method" if member else (m["kind"] or "function").rstrip("*")
            own = member["name"] if member else m["name"] or m["const"]
            given = JS["parameters"].match(member["rest"]) if member else JS["parameters"].match(code, m.end()) if m["kind"] and kind == "function" else None
            listed = given["list"] if given else (m["arrow"] or m["one"] or "") if m else ""
            returns = (given["returns"] if given else m["made"] if m else "") or ""
            callable_ = kind in ("function", "method")
            put("symbols", own, scope, kind, n, qualified=f"{scope}.{own}", signature=f"({listed.strip()})" if callable_ else "", parameters=len(arguments_of(listed)), returns=returns.strip(), doc="")
            at = len(rows) - 1
            if kind in ("class", "interface"):
                if x := JS["extends"].search(code):
                    put("inheritance", x[1], f"{scope}.{own}", "EXTENDS", n)
                if x := JS["implements"].search(code):
                    for name in arguments_of(x[1]):
                        put("inheritance", name, f"{scope}.{own}", "IMPLEMENTS", n)
            close(at, n)
            if code.count("{") > code.count("}"):
                open_.append((own, kind, depth, at))
        within = ".".join([scope, own]) if own and kind in ("function", "method") else scope
        if x := JS["imports"].match(code):
            put("imports", (x[1] or "").strip("{} "), x[2], "", n, level=0)
        if x := JS["routes"].search(code):
            put("routes", x[3], x[1], x[2].upper(), n, framework="express", handler=x[4] or "")
        if x := JS["mounts"].search(code):
            put("mounts", x[3], x[1], x[2], n)
        for x in JS["fetches"].finditer(code):
            put("fetches", x[2], within, (x[3] or x[1] or "GET").upper(), n)
        for x in JS["calls"].finditer(code):
            if x[1] not in JS_WORDS and not (own and x[1] == own) and not re.search(r"\b(function\*?|class|new)\s+$", code[: x.start()]):
                put("calls", x[1], within, "", n)
        depth += code.count("{") - code.count("}")
        while open_ and depth <= open_[-1][2]:
            close(open_.pop()[3], n)
    return rows


CREATE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\((.*?)\)\s*;", re.I | re.S)


def sql_facts(path: str, text: str) -> list[tuple]:
    """Tables and columns of CREATE TABLE statements, and the other statements."""
    rows = []
    for m in CREATE.finditer(text):
        table, line = m[1].replace('"', "").replace("`", "").split(".")[-1].lower(), text.count("\n", 0, m.start()) + 1
        for part in re.split(r",(?![^()]*\))", m[2]):
            words = part.split()
            if len(words) < 2 or words[0].lower() in ("primary", "foreign", "unique", "check", "constraint", "key", "index"):
                continue
            low = " ".join(words).lower()
            target = re.search(r"references\s+([\w.]+)\s*(?:\(\s*(\w+)\s*\))?", low)
            rows.append(("tables", path, words[0].strip('"`').lower(), table, words[1].lower(), line, line, {"nullable": str("not null" not in low and "primary key" not in low), "primary": str("primary key" in low), "target": ".".join(x for x in target.groups() if x) if target else "", "model": ""}, []))
    for n, statement in enumerate(x for x in text.split(";") if SQL_TEXT.match(x) and not CREATE.match(x.strip() + ";")):
        rows.append(("queries", path, statement.strip(), module_of(path), "", n + 1, n + 1, {}, []))
    return rows


HTML = (("script", r"<script[^>]*\bsrc=[\"']([^\"']+)"), ("stylesheet", r"<link[^>]*\bhref=[\"']([^\"']+)"), ("form", r"<form[^>]*\baction=[\"']([^\"']+)"), ("htmx", r"\bhx-(?:get|post|put|delete)=[\"']([^\"']+)"), ("extends", r"\{%\s*extends\s+[\"']([^\"']+)"), ("include", r"\{%\s*include\s+[\"']([^\"']+)"), ("block", r"\{%\s*block\s+(\w+)"))


def html_facts(path: str, text: str) -> list[tuple]:
    return [("assets", path, m[1], module_of(path), kind, text.count("\n", 0, m.start()) + 1, 0, {}, []) for kind, p in HTML for m in re.finditer(p, text, re.I)]


LUA_FUNCTION = re.compile(r"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\(([^)]*)\)")
LUA_REQUIRE = re.compile(r"\brequire\(\s*([^)]+?)\s*\)")
LUA_SERVICE = re.compile(r"game:GetService\(\s*[\"'](\w+)")


def luau_facts(path: str, text: str) -> list[tuple]:
    rows, module = [], module_of(path)
    for n, line in enumerate(text.splitlines(), 1):
        if m := LUA_FUNCTION.match(line):
            rows.append(("symbols", path, re.split("[.:]", m[1])[-1], module, "method" if ":" in m[1] else "function", n, n, {"qualified": f"{module}.{m[1].replace(':', '.')}", "signature": f"({m[2]})", "parameters": str(len([x for x in m[2].split(',') if x.strip()])), "returns": "", "doc": "", "hash": ""}, []))
        rows += [("imports", path, "", m[1], "", n, n, {"level": "0"}, []) for m in LUA_REQUIRE.finditer(line)]
        rows += [("services", path, m[1], module, "USES_SERVICE", n, n, {}, []) for m in LUA_SERVICE.finditer(line)]
    return rows


PARSERS = {"python": python_facts, "javascript": script_facts, "typescript": script_facts, "sql": sql_facts, "html": html_facts, "luau": luau_facts}


FILES = 1000  # whose facts are one Arrow batch


def parse(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Facts of files (path, text, language), all or only those of the kinds named, in FACT's columns."""
    wanted = {language: [k for k in of if kinds is None or k in kinds] for language, of in KINDS.items()}
    text, number = pa.string(), pa.int32()
    schema = pa.schema(list(zip([c.split()[0] for c in re.sub(r"<[^>]*>", "", FACT).split(", ")], [text] * 5 + [number] * 2 + [pa.map_(text, text), pa.list_(text)])))

    def found(path: str, source: str, language: str) -> list[tuple]:
        if language == "python":
            rows = python_facts(path, source, wanted[language])
        else:
            rows = PARSERS[language](path, source)
        return [r for r in rows if r[0] in wanted[language]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FILES):
                part = b.slice(at, FILES)
                rows = [r for x in zip(*(c.to_pylist() for c in part.columns)) for r in found(*x)]
                columns = list(zip(*rows)) if rows else [()] * len(schema)
                columns[7] = [list(x.items()) for x in columns[7]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ready = files.where(F.col("text").isNotNull() & F.col("language").isin(*(x for x, of in wanted.items() if of))).select("path", "text", "language")
    return ready.mapInArrow(run, FACT)


def fact(facts: DataFrame, kind: str) -> DataFrame:
    """One kind of fact in the columns of its table."""
    x = facts.where(F.col("fact") == kind)
    extra = lambda k: F.coalesce(F.try_element_at("extra", F.lit(k)), F.lit(""))
    c = F.col
    made = {
        "symbols": lambda: [c("path"), c("name"), extra("qualified").alias("qualified_name"), c("detail").alias("kind"), extra("qualified").alias("canonical_id"), c("owner").alias("parent"), c("line").alias("start_line"), c("end_line"), c("items").alias("decorators"), extra("signature").alias("signature"), extra("parameters").try_cast("int").alias("parameter_count"), extra("returns").alias("return_type"), extra("doc").alias("documentation"), extra("hash").alias("body_hash")],
        "imports": lambda: [c("path"), c("owner").alias("module"), c("name"), c("detail").alias("alias"), extra("level").try_cast("int").alias("level"), c("line")],
        "calls": lambda: [c("path"), c("owner").alias("caller"), c("name").alias("callee"), c("line"), c("items").alias("arguments")],
        "inheritance": lambda: [c("path"), c("owner").alias("child"), c("name").alias("parent"), c("line")],
        "bindings": lambda: [c("path"), c("owner").alias("scope"), c("name"), c("line"), c("detail").alias("kind"), extra("source").alias("source"), (extra("conditional") == "True").alias("conditional")],
        "routes": lambda: [c("path"), extra("framework").alias("framework"), c("detail").alias("method"), c("name").alias("route"), extra("handler").alias("handler"), c("line"), c("owner")],
        "mounts": lambda: [c("path"), c("owner").alias("parent"), c("name").alias("child"), c("detail").alias("prefix"), c("line")],
        "tables": lambda: [c("path"), c("owner").alias("table_name"), c("name").alias("column_name"), c("detail").alias("data_type"), (extra("nullable") == "True").alias("nullable"), (extra("primary") == "True").alias("primary_key"), extra("target").alias("target"), extra("model").alias("model"), c("line")],
        "fields": lambda: [c("path"), c("owner").alias("model"), c("name").alias("field"), c("detail").alias("data_type"), (extra("required") == "True").alias("required"), (extra("nullable") == "True").alias("nullable"), extra("most").try_cast("int").alias("max_length"), extra("default").alias("default"), c("line")],
        "queries": lambda: [c("path"), c("owner").alias("caller"), c("name").alias("sql"), c("line")],
    }
    if kind in made:
        return x.select(*made[kind]())
    if kind in FACTS and kind not in made:
        raise ValueError(f"{kind} is derived, not parsed")
    return x.select("path", "name", "owner", "detail", "line")

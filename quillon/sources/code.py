"""Code files as units: modules, declarations, calls, imports, routes and components.

Python is parsed with its own grammar; JavaScript, TypeScript and Go by the tokens of `braces` and a descent over declarations. Extraction runs in Arrow batches, one file at a time, and never raises: a file that does not parse is one module unit.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.braces import MODIFIERS, OPEN, Source
from quillon.sources.files import language

UNIT = "path string, kind string, name string, parent string, line_start int, line_end int, doc string, method string, route string, calls array<struct<receiver:string,name:string,line:int>>, imports array<string>"
VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")
#: Methods of a router that name a route. Fixed values.
ROUTERS = ("get", "post", "put", "delete", "patch", "head", "options", "all", "use")
#: Extractors by language; register more with `EXTRACTORS[language] = f(path, source) -> list[dict]`.
EXTRACTORS: dict[str, object] = {}


def unit(path, kind, name, start, end, parent=None, doc=None, method=None, route=None, calls=(), imports=()):
    return {"path": path, "kind": kind, "name": name, "parent": parent, "line_start": start, "line_end": end, "doc": doc, "method": method, "route": route, "calls": list(calls), "imports": list(imports)}


def python_units(path: str, source: str) -> list[dict]:
    tree = ast.parse(source)
    end = source.count("\n") + 1
    imports = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module]
    first = lambda n: (ast.get_docstring(n) or "").split("\n\n")[0] or None
    out = [unit(path, "module", _stem(path), 1, end, doc=first(tree), imports=imports)]
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def calls(node):
        todo = list(node.body)  # without decorators and defaults
        while todo:
            n = todo.pop()
            if isinstance(n, (*functions, ast.ClassDef)):
                continue
            if isinstance(n, ast.Call):
                if isinstance(n.func, ast.Name):
                    yield {"receiver": None, "name": n.func.id, "line": n.lineno}
                elif isinstance(n.func, ast.Attribute):
                    base = n.func.value
                    while isinstance(base, ast.Attribute):
                        base = base.value
                    yield {"receiver": base.id if isinstance(base, ast.Name) else None, "name": n.func.attr, "line": n.lineno}
            todo += ast.iter_child_nodes(n)

    def routes(node):
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                if d.func.attr in VERBS:
                    yield unit(path, "route", f"{d.func.attr.upper()} {d.args[0].value}", node.lineno, node.end_lineno, node.name, method=d.func.attr.upper(), route=d.args[0].value)
                elif d.func.attr == "route":
                    methods = next((k.value for k in d.keywords if k.arg == "methods"), None)
                    for m in [e.value for e in methods.elts if isinstance(e, ast.Constant)] if isinstance(methods, (ast.List, ast.Tuple)) else ["GET"]:
                        yield unit(path, "route", f"{m} {d.args[0].value}", node.lineno, node.end_lineno, node.name, method=str(m).upper(), route=d.args[0].value)

    for n in tree.body:
        if isinstance(n, functions):
            out.append(unit(path, "function", n.name, n.lineno, n.end_lineno, doc=first(n), calls=sorted(calls(n), key=lambda c: c["line"])))
        elif isinstance(n, ast.ClassDef):
            out.append(unit(path, "class", n.name, n.lineno, n.end_lineno, doc=first(n)))
            out += [unit(path, "method", m.name, m.lineno, m.end_lineno, n.name, first(m), calls=sorted(calls(m), key=lambda c: c["line"])) for m in n.body if isinstance(m, functions)]
        elif isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in n.targets) and isinstance(n.value, ast.List):
            for c in n.value.elts:
                if isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id in ("path", "re_path") and c.args and isinstance(c.args[0], ast.Constant):
                    view = c.args[1] if len(c.args) > 1 else None
                    out.append(unit(path, "route", f"* {c.args[0].value}", c.lineno, c.end_lineno, getattr(view, "attr", getattr(view, "id", None)), method="*", route=c.args[0].value))
    for n in ast.walk(tree):
        if isinstance(n, functions):
            out += routes(n)
    return out


def script_units(path: str, source: str) -> list[dict]:
    """JavaScript and TypeScript: functions, function values, classes with their methods, static imports, routes of `x.verb("/p")`, components and fetched endpoints."""
    s = Source(source, "js")
    out = [unit(path, "module", _stem(path), 1, source.count("\n") + 1, imports=_script_imports(s))]

    def function(name: str, start: int, params: int, kind: str = "function", parent: str | None = None) -> int | None:
        """The unit of a function whose parameters open at `params`; the place after it, or null where it has no body."""
        after = s.end.get(params, len(s.t)) + 1
        arrow = after
        if s.text(arrow) == ":":  # a result type before an arrow
            while arrow < len(s.t) and s.text(arrow) not in ("=>", ";", "="):
                arrow = s.end[arrow] + 1 if s.text(arrow) in OPEN and arrow in s.end else arrow + 1
        if kind != "method" and s.text(arrow) == "=>":
            begin, stop = arrow + 1, s.arrow_end(arrow + 1, len(s.t))
        elif (begin := s.body(after)) is not None:
            stop = s.end[begin] + 1
        else:
            return None
        shown = kind == "function" and name[:1].isupper() and _returns_markup(s, begin, stop)
        out.append(unit(path, "component" if shown else kind, name, s.t[start].line, s.t[min(stop, len(s.t)) - 1].line, parent, calls=s.calls(begin, stop)))
        if shown:
            fetched = [s.text(k + 2)[1:-1] for k in range(begin, stop - 2) if s.text(k) == "fetch" and s.text(k + 1) == "(" and s.t[k + 2].kind == "str" and len(s.text(k + 2)) > 2]
            out.extend(unit(path, "endpoint", f"GET {p}", s.t[start].line, s.t[stop - 1].line, name, method="GET", route=p) for p in dict.fromkeys(fetched))
        return stop

    def members(name: str, k: int, stop: int) -> None:
        while k < stop:
            start = k
            while s.text(k) in MODIFIERS and s.text(k + 1) not in ("(", "=", ";", ":") or s.text(k) in ("*",) or (s.is_id(k) and s.text(k)[:1] == "@"):
                k = s.end[k + 1] + 1 if s.text(k)[:1] == "@" and s.text(k + 1) == "(" else k + 1
            named = s.after_generics(k + 1)
            if (s.is_id(k) or s.t[k].kind == "str") and s.text(named) == "(" and (after := function(s.text(k), start, named, "method", name)):
                k = after
                continue
            line = s.t[k].line
            while k < stop and s.text(k) != ";" and not (s.t[k].line > line and s.new_statement(k)):
                k = s.end[k] + 1 if s.text(k) in OPEN and k in s.end else k + 1
            k += s.text(k) == ";"

    k = 0
    while k < len(s.t):
        start = k
        while s.text(k) in ("export", "default", "declare", "abstract") or (s.text(k) == "async" and s.text(k + 1) == "function"):
            k += 1
        x = s.text(k)
        if x == "function" and s.t[k].kind == "id":
            k += 1 + (s.text(k + 1) == "*")
            named = s.after_generics(k + 1)
            if s.is_id(k) and s.text(named) == "(":
                k = function(s.text(k), start, named) or named + 1
        elif x == "class" and s.is_id(k + 1) and (b := s.body(k + 2)) is not None:
            out.append(unit(path, "class", s.text(k + 1), s.t[start].line, s.t[s.end[b]].line))
            members(s.text(k + 1), b + 1, s.end[b])
            k = s.end[b] + 1
        elif x in ("const", "let", "var") and s.t[k].kind == "id":
            k = _values(s, k, start, function)
        else:
            verb = k + 1 if x == "await" else k
            if s.is_id(verb) and s.text(verb + 1) == "." and s.text(verb + 2) in ROUTERS and s.text(verb + 3) == "(" and verb + 4 < len(s.t) and s.t[verb + 4].kind == "str" and len(s.text(verb + 4)) > 2:
                name, at = s.text(verb + 2).upper(), s.t[verb].line
                out.append(unit(path, "route", f"{name} {s.text(verb + 4)[1:-1]}", at, at, method=name, route=s.text(verb + 4)[1:-1]))
            k = s.end[k] + 1 if x in OPEN and k in s.end else k + 1
    return out


def _values(s: Source, k: int, start: int, function) -> int:
    """Past `const a = ..., b = ...`: a function for each name whose value is one."""
    while k < len(s.t):
        name, at = k + 1, k + 2
        while at < len(s.t) and s.text(at) not in ("=", ",", ";") and s.t[at].line <= s.t[name].line + 20:  # a type
            at = s.end[at] + 1 if s.text(at) in OPEN and at in s.end else at + 1
        if not s.is_id(name) or s.text(at) != "=":
            return max(at, k + 1)
        value = at + 1 + (s.text(at + 1) == "async")
        plain = s.is_id(value) and s.text(value + 1) == "=>"
        made = None
        if s.text(value) == "function":
            opened = value + 1
            while opened < len(s.t) and s.text(opened) != "(":
                opened += 1
            made = function(s.text(name), value if s.text(at + 1) != "async" else at + 1, opened)
        elif plain or s.text(s.after_generics(value)) == "(":
            made = function(s.text(name), at + 1, value if plain else s.after_generics(value))
        if made is None:
            made = at + 1
            while made < len(s.t) and s.text(made) not in (",", ";") and not s.new_statement(made):
                made = s.end[made] + 1 if s.text(made) in OPEN and made in s.end else made + 1
        if s.text(made) != ",":
            return made
        k = made
    return k


def _script_imports(s: Source) -> list[str]:
    out = []
    for k, t in enumerate(s.t):
        if t.text == "import" and t.kind == "id" and s.text(k + 1) not in ("(", "."):
            j = k + 1
            while j < len(s.t) and s.t[j].kind != "str" and s.text(j) != ";":
                j += 1
            if j < len(s.t) and s.t[j].kind == "str":
                out.append(s.text(j)[1:-1])
    return out


def _returns_markup(s: Source, begin: int, stop: int) -> bool:
    """Whether an arrow's value or a returned value opens with a tag."""
    for k in range(begin - 1, stop):
        if s.text(k) in ("return", "=>", "?", ":", "&"):
            j = k + 1
            while s.text(j) == "(":
                j += 1
            if s.text(j) == "<" and (s.is_id(j + 1) or s.text(j + 1) == ">"):
                return True
    return False


def go_units(path: str, source: str) -> list[dict]:
    """Go: functions, methods of types, structs and interfaces, import paths and calls."""
    s = Source(source, "go")
    imports: list[str] = []
    out = [unit(path, "module", _stem(path), 1, source.count("\n") + 1, imports=())]

    def kind(k: int, start: int) -> int:
        """One type at its name k; the place after it."""
        at = s.after_generics(k + 1) if s.text(k + 1) == "[" and s.text(k + 2) != "]" else k + 1
        at += s.text(at) == "="
        if s.text(at) in ("struct", "interface") and s.text(at + 1) == "{":
            out.append(unit(path, "class", s.text(k), s.t[start].line, s.t[s.end[at + 1]].line))
            return s.end[at + 1] + 1
        line = s.t[k].line
        while at < len(s.t) and s.t[at].line == line:
            at = s.end[at] + 1 if s.text(at) in OPEN and at in s.end else at + 1
        return at

    k = 0
    while k < len(s.t):
        x, start = s.text(k), k
        if x == "import":
            stop = s.end[k + 1] if s.text(k + 1) == "(" else next((j for j in range(k, len(s.t)) if s.t[j].kind == "str"), k)
            imports += [s.text(j)[1:-1] for j in range(k, stop + 1) if s.t[j].kind == "str"]
            k = stop + 1
        elif x == "type" and s.text(k + 1) == "(":
            stop, k = s.end[k + 1], k + 2
            while k < stop:
                k = kind(k, k) if s.is_id(k) else k + 1
        elif x == "type" and s.is_id(k + 1):
            k = kind(k + 1, start)
        elif x == "func":
            owner, k = None, k + 1
            if s.text(k) == "(":
                names = [s.text(j) for j in range(k + 1, s.end[k]) if s.is_id(j)]
                typed = [n for j, n in enumerate(names) if j or s.text(k + 2) in (")", "[", ".") or s.text(k + 1) == "*"]
                owner, k = (typed or names or [None])[0], s.end[k] + 1
            opened = s.after_generics(k + 1)
            b = s.body(s.end.get(opened, opened) + 1) if s.is_id(k) and s.text(opened) == "(" else None
            if b is not None:
                out.append(unit(path, "method" if owner else "function", s.text(k), s.t[start].line, s.t[s.end[b]].line, owner, calls=s.calls(b, s.end[b] + 1)))
                k = s.end[b] + 1
        else:
            k = s.end[k] + 1 if x in OPEN and k in s.end else k + 1
    out[0]["imports"] = imports
    return out


EXTRACTORS |= {"python": python_units, "javascript": script_units, "typescript": script_units, "tsx": script_units, "go": go_units}


def _stem(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0] or path


def extract(path: str, source: str, lang: str | None) -> list[dict]:
    try:
        return EXTRACTORS[lang](path, source)
    except (KeyError, SyntaxError, ValueError, RecursionError):
        return [unit(path, "module", _stem(path), 1, source.count("\n") + 1)]


def units(files: DataFrame) -> DataFrame:
    """Units of code files (path, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.sub(r"<[^>]*>+", "", UNIT).split(", ")]
        for part in parts:
            rows = [u for p, t, g in zip(part["path"], part["text"], part["lang"], strict=True) for u in extract(p, t or "", g)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text", language(F.col("path")).alias("lang")).mapInPandas(run, UNIT)


def keyed(found: DataFrame) -> DataFrame:
    """A stable key path::Class.name for each unit; later ones of the same kind get #2, #3 in document order."""
    from pyspark.sql.window import Window

    base = F.when(F.col("kind") == "module", F.col("path")).otherwise(F.concat("path", F.lit("::"), F.concat_ws(".", F.when(F.col("kind") == "method", F.col("parent")), "name")))
    w = Window.partitionBy("path", "kind", "_base").orderBy("line_start", "line_end")
    k = F.row_number().over(w)
    return found.withColumn("_base", base).withColumn("key", F.when(k > 1, F.concat("_base", F.lit("#"), k)).otherwise(F.col("_base"))).drop("_base")


def edges(found: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence): defines, method_of, imports, routes_to and at_endpoint of keyed units."""
    module = found.where("kind = 'module'").select("path", F.col("key").alias("module"))
    defines = found.where("kind IN ('function', 'class', 'component')").join(module, "path").select(F.col("module").alias("src"), F.col("key").alias("dst"), F.lit("defines").alias("relation"), F.lit(1.0).alias("confidence"))
    classes = found.where("kind = 'class'").select("path", F.col("name").alias("parent"), F.col("key").alias("dst"))
    method = found.where("kind = 'method'").join(classes, ["path", "parent"]).select(F.col("key").alias("src"), "dst", F.lit("method_of").alias("relation"), F.lit(1.0).alias("confidence"))
    stems = found.where("kind = 'module'").select(F.col("name").alias("stem"), F.col("key").alias("dst"))
    imports = found.where("kind = 'module'").select(F.col("key").alias("src"), F.explode("imports").alias("i")).select("src", F.regexp_extract("i", r"([^./]+)(?:\.(?:js|ts|jsx|tsx))?$", 1).alias("stem")).join(stems, "stem").where("src <> dst").select("src", "dst", F.lit("imports").alias("relation"), F.lit(0.9).alias("confidence")).distinct()
    handlers = found.where("kind IN ('function', 'method')").select("path", F.col("name").alias("parent"), F.col("line_start").alias("at"), F.col("key").alias("dst"))
    routes = found.where("kind = 'route' AND parent IS NOT NULL").join(handlers, ["path", "parent"]).where("line_start = at OR method = '*'").select(F.col("key").alias("src"), "dst", F.lit("routes_to").alias("relation"), F.lit(0.95).alias("confidence"))
    at = found.where("kind IN ('route', 'endpoint')").select(F.col("key").alias("src"), F.concat(F.lit("endpoint:"), "method", F.lit(":"), "route").alias("dst"), F.lit("at_endpoint").alias("relation"), F.lit(0.9).alias("confidence"))
    return defines.unionByName(method).unionByName(imports).unionByName(routes).unionByName(at)

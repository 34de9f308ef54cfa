"""Security of source files: line rules, tainted data inside and across functions, container and infrastructure files.

Files are rows (path, text) and are read alone; only the step from a dangerous
function to its callers joins, on the function's name, a bounded number of times.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators.quality import numbered_lines
from tessera.sources.arrow import batches
from tessera.sources.code import dotted
from tessera.sources.rulebook import Taint

# ------------------------------------------------------------------ line rules

#: Marks of dummy values.
PLACEHOLDERS = [
    "xxx", "your-", "example", "placeholder", "changeme",
    "todo", "fixme", "replace", "insert", "<your",
    "sk-xxx", "pk-xxx", "test_", "fake_", "mock_",
    "process.env", "os.environ", "os.getenv", "env.",
    "${", "{{", "}}", "params.", "config.",
]
#: What shows that a line only speaks of a password: paths, keys beside a text about passwords, bindings, messages, values of tests.
PASSWORD_PATHS = ["/password", "-password", "_password:", "password/"]
PASSWORD_KEYS = ["password_", "password.", "_password", "password:"]
PASSWORD_BINDINGS = ["v-model", ":password", "@password"]
MESSAGES = ["log(", "error(", "warn(", "info(", "debug("]
TEST_PASSWORDS = ["password123", "test123", "12345678", "testpassword", "admin123"]
#: What shows that a line only speaks of a call.
TALK_STARTS = ["#", "//", "*", '"""', "'''"]
TALK_WORDS = ["without", "instead of", "not use", "assert", "expect"]
TALK_MARKS = ['r"', "r'", '"""', "'''"]
EXTENSIONS = {"python": ["py"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx"], "vue": ["vue"], "go": ["go"], "java": ["java"], "php": ["php"], "ruby": ["rb"]}
SEVERITIES = ["critical", "high", "medium", "low"]


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def has_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def no_password(line: Column) -> Column:
    """Whether a line that names a password holds none: an input field, a path, a type, a variable, a text key, a message, a test's value."""
    low = F.lower(line)
    field = low.contains("type=") & low.contains("password") & (low.contains('type="password"') | low.contains("type='password'") | low.contains(":type="))
    path = has_any(low, PASSWORD_PATHS) & ~low.contains("://")
    quote = r"""["']"""
    typed = low.rlike(rf"password{quote}?\s*:\s*{quote}password")
    variable = low.rlike(r"(?:const|let|var)\s+password\s*=") | line.rlike(rf"password{quote}?\s*[=:]\s*[a-zA-Z_][\w.]*\s*[,)}}]")
    key = has_any(low, PASSWORD_KEYS) & low.rlike(rf"{quote}[^\"']*password[^\"']*{quote}")
    return field | path | typed | variable | key | has_any(low, PASSWORD_BINDINGS) | has_any(low, MESSAGES) | has_any(low, TEST_PASSWORDS)


def only_talk(line: Column, call: str) -> Column:
    """Whether a line only speaks of ``call``: a comment, a text about it, a pattern that looks for it, a check of a test."""
    low, begun = F.lower(line), F.ltrim(line)
    starts = F.lit(False)
    for mark in TALK_STARTS:
        starts = starts | begun.startswith(mark)
    pattern = line.rlike(r"""["'].*\\b""" + re.escape(call.replace("()", "")) + r""".*["']""")
    redis = low.contains("redis") & F.lit("eval" in call)
    return starts | has_any(low, TALK_WORDS) | has_any(line, TALK_MARKS) | pattern | redis


def line_findings(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, rule, severity, code): every rule of a line's language that the line meets; secret values are masked.

    Rules are literals tested in place, so text is neither joined nor shuffled.
    """
    l = numbered_lines(files.where(F.col(text).isNotNull()), path, text).withColumn("e", extension(F.col(path)))  # noqa: E741
    c, code = F.col("content"), F.trim("content")
    dummy, comment = has_any(F.lower(c), PLACEHOLDERS), code.rlike(r"^(?:#|//|\*)")
    hit = lambda when, rule, severity, secret=False: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(secret).alias("secret")))
    tests = [hit(c.rlike("(?i)" + p) & ~dummy & ~comment, n, "critical", True) for p, n in R.SECRETS]
    tests += [hit(c.rlike("(?i)" + R.PASSWORD) & ~dummy & ~comment & ~no_password(c), "Password", "critical", True)]
    tests += [hit(c.rlike(p) & ~comment, n, "high") for p, n in R.SQL_RISKS]
    tests += [hit(c.rlike(p) & ~only_talk(c, n), n, "high") for p, n in R.UNSAFE_CALLS]
    tests += [hit(c.rlike(p) & ~comment, n, "medium") for p, n in R.LEAKS]
    for name, severity, languages, pattern in R.LINE_RULES:
        ends = [e for language in languages.split() for e in EXTENSIONS.get(language, [])]
        tests.append(hit((F.lit(True) if languages == "*" else F.col("e").isin(ends)) & c.rlike(pattern), name, severity))
    found = l.select(path, "line", "content", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("f"))
    masked = F.regexp_replace("content", r"""(["'])([^"']{4})[^"']*\1""", "$1$2****$1")
    return found.select(path, "line", "f.rule", "f.severity", F.substring(F.trim(F.when(F.col("f.secret"), masked).otherwise(F.col("content"))), 1, 80).alias("code")).distinct()


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts per severity, gravest first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy(rank)


def line_flows(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, category, severity): lines of JavaScript, TypeScript and Go files where a source meets a sink and nothing sanitizes."""
    l = numbered_lines(files.where(F.col(text).isNotNull()), path, text).withColumn("e", extension(F.col(path)))  # noqa: E741
    safe = F.lit(False)
    for call, _ in R.SANITIZERS:
        safe = safe | F.col("content").contains(call)
    tables = [(R.JS_TAINT_PATTERNS, ["js", "jsx", "ts", "tsx", "mjs", "cjs", "vue"]), (R.GO_TAINT_PATTERNS, ["go"])]
    tests = [F.when(F.col("e").isin(ends) & F.col("content").rlike(p), F.struct(F.lit(k).alias("category"), F.lit(s).alias("severity"))) for table, ends in tables for p, k, s in table]
    return l.where(~safe).select(path, "line", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("f")).select(path, "line", "f.*").distinct()


# ------------------------------------------------------------------ taint inside functions

FLOW = "path string, row string, function string, line int, origin string, param int, category string, severity string, target string, arg int"
FLOW_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split() for c in FLOW.split(", "))])
HOPS = 3
BUILT_IN = Taint.of(R.SOURCES, R.SINKS, R.SANITIZERS)


def _matches(call: str, pattern: str) -> bool:
    """Whether a call's name holds a pattern that no longer word continues."""
    want = pattern.rstrip("(")
    at = call.find(want)
    return at >= 0 and not call[at + len(want) : at + len(want) + 1].isalnum()


def source_pattern(rules: Taint) -> re.Pattern:
    """What finds a source in Python text; rules without one find nothing."""
    names = sorted(rules.sources.get("python", []), key=len, reverse=True)
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + ")" if names else r"(?!)")


class _Flows:
    """One function's variables and the origins of what they hold: a source's text, or ``param:name``."""

    def __init__(self, path: str, function: str, params: list[str], rules: Taint, sources: re.Pattern):
        self.path, self.function, self.rows = path, function, []
        self.rules, self.sources = rules, sources
        self.params = [p for p in params if p not in ("self", "cls")]  # a call's arguments count from after the receiver
        self.held = {p: f"param:{p}" for p in self.params}

    def source(self, node: ast.AST) -> str | None:
        found = self.sources.findall(ast.unparse(node))
        return max(found, key=len) if found else None

    def cleans(self, node: ast.AST, category: str | None) -> bool:
        """Whether the node is a sanitizer's call, of a category or of all."""
        if not isinstance(node, ast.Call) or not (name := dotted(node.func)):
            return False
        return any((category in kinds or "*" in kinds) and (name + "(" == call or (name + "(").endswith("." + call)) for call, kinds in self.rules.sanitizers)

    def origin(self, node: ast.AST | None) -> str | None:
        """Where an expression's data comes from; None if it is clean."""
        if node is None or isinstance(node, ast.Constant) or self.cleans(node, None):
            return None
        if isinstance(node, ast.Name):
            return self.held.get(node.id)
        known = self.called(node) if isinstance(node, ast.Call) else self.source(node) if isinstance(node, (ast.Attribute, ast.Subscript)) else None
        if known:
            return known
        return next(filter(None, map(self.origin, ast.iter_child_nodes(node))), None)

    def called(self, node: ast.Call) -> str | None:
        name = dotted(node.func)
        return next((s for s in self.rules.sources.get("python", []) if s.endswith("(") and name and (name + "(" == s or (name + "(").endswith("." + s))), None)

    def add(self, row: str, line: int, origin: str, category="", severity="", target="", arg=-1) -> None:
        param = self.params.index(origin[6:]) if origin.startswith("param:") and origin[6:] in self.params else None
        self.rows.append(dict(path=self.path, row=row, function=self.function, line=line, origin=origin, param=param, category=category, severity=severity, target=target, arg=arg))

    def call(self, node: ast.Call) -> None:
        name, text = ast.unparse(node.func), ast.unparse(node)
        origins = [(i, a, self.origin(a)) for i, a in enumerate(node.args)] + [(None, k.value, self.origin(k.value)) for k in node.keywords if k.arg]
        for category, sinks in self.rules.sinks.items():
            sink = next(((p, s) for p, s in sinks if _matches(name, p) and not ("execute" in p and len(node.args) >= 2)), None)
            tainted = [(a, o) for i, a, o in origins if o and i is not None] if sink else []
            clean = [(a, o) for i, a, _ in origins if sink and i is not None and self.cleans(a, category) and (o := next(filter(None, map(self.origin, ast.iter_child_nodes(a))), None))]
            for a, o in tainted:
                if not self.cleans(a, category):
                    self.add("flow", node.lineno, o, category, sink[1], text)
                    break
            for a, o in clean + [(a, o) for a, o in tainted if self.cleans(a, category)]:
                self.add("sanitized", node.lineno, o, category, sink[1], text)
        if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords) and node.args and (o := self.origin(node.args[0])):
            self.add("flow", node.lineno, o, "rce", "critical", text)
        for i, a, o in origins:
            if o and i is not None:
                self.add("argument", node.lineno, o, target=name.rpartition(".")[2], arg=i)

    def expression(self, node: ast.AST | None) -> None:
        for n in ast.walk(node) if node is not None else ():
            if isinstance(n, ast.Call):
                self.call(n)

    def assign(self, targets: list[ast.expr], value: ast.expr | None) -> None:
        if value is None:
            return
        self.expression(value)
        origin = self.origin(value)
        for t in targets:
            for name in [n.id for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]:
                if origin:
                    self.held[name] = origin
                else:
                    self.held.pop(name, None)

    def body(self, statements: list[ast.stmt]) -> None:
        """Statements in order; the branches of a condition are read one after the other, as if all ran."""
        for s in statements:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(s, (ast.Assign, ast.AnnAssign)):
                self.assign(s.targets if isinstance(s, ast.Assign) else [s.target], s.value)
            elif isinstance(s, ast.AugAssign):
                self.expression(s.value)
                if isinstance(s.target, ast.Name) and (o := self.origin(s.value)):
                    self.held[s.target.id] = o
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                self.assign([s.target], s.iter)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for item in s.items:
                    self.assign([item.optional_vars] if item.optional_vars else [], item.context_expr)
            else:
                for field in ("value", "test", "exc"):
                    if isinstance(getattr(s, field, None), ast.AST):
                        self.expression(getattr(s, field))
            for part in ("body", "orelse", "finalbody"):
                self.body(getattr(s, part, []) if isinstance(getattr(s, part, []), list) else [])
            for h in getattr(s, "handlers", []):
                self.body(h.body)
            for case in getattr(s, "cases", []):
                self.body(case.body)


def flows_of(path: str, text: str, rules: Taint = BUILT_IN, sources: re.Pattern | None = None) -> list[dict]:
    """Rows of one Python file: flows into sinks, sanitized ones, and tainted arguments of calls.

    A file that cannot be read as Python has one row, ``unread``, that names the error.
    """
    sources = sources or source_pattern(rules)
    try:
        tree = ast.parse(text)
        rows = []
        for node in [tree, *ast.walk(tree)]:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                f = _Flows(path, node.name, [a.arg for a in node.args.posonlyargs + node.args.args + node.args.kwonlyargs], rules, sources)
            elif node is tree and not rows and isinstance(node, ast.Module):
                f = _Flows(path, "<module>", [], rules, sources)
            else:
                continue
            f.body(node.body)
            rows += f.rows
        unique = {tuple(r.values()): r for r in rows}
        return list(unique.values())
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [dict(path=path, row="unread", function="<module>", line=getattr(e, "lineno", None) or 0, origin=type(e).__name__, param=None, category="", severity="", target="", arg=-1)]


def flows(files: DataFrame, path: str = "path", text: str = "text", rules: Taint = BUILT_IN) -> DataFrame:
    """Tagged rows of every Python file among ``files``: ``row`` is flow, sanitized, argument, or unread for a file that is no Python."""
    sources = source_pattern(rules)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield from flows_of(p, t, rules, sources)

    py = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where((extension(F.col("path")) == "py") & F.col("text").isNotNull())
    return py.mapInArrow(lambda parts: batches(rows(parts), FLOW_ARROW), FLOW)


def taint(rows: DataFrame, hops: int = HOPS) -> DataFrame:
    """(path, function, line, origin, category, severity, sink, hops): data from a source in a sink, here or through up to ``hops`` calls.

    A function whose parameter reaches a sink is dangerous at that place; its
    callers are found by name and place. ``rows`` is read 2 + ``hops`` times:
    write it before. Dangerous places are made distinct before they join, so a
    much called function is one row against its callers.
    """
    f = rows.where("row = 'flow'")
    out = f.where("param is null").select("path", "function", "line", "origin", "category", "severity", F.col("target").alias("sink"), F.lit(0).alias("hops"))
    danger = f.where("param is not null").select(F.col("function").alias("target"), F.col("param").alias("arg"), "category", "severity").distinct()
    args = rows.where("row = 'argument'").select("path", "function", "line", "origin", "param", "target", "arg")
    for hop in range(1, hops + 1):
        met = args.join(danger, ["target", "arg"])
        out = out.unionByName(met.where("param is null").select("path", "function", "line", "origin", "category", "severity", F.col("target").alias("sink"), F.lit(hop).alias("hops")))
        danger = met.where("param is not null").select(F.col("function").alias("target"), F.col("param").alias("arg"), "category", "severity").distinct()
    g = out.groupBy("path", "function", "line", "origin", "category", "sink")
    return g.agg(F.min_by("severity", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))).alias("severity"), F.min("hops").alias("hops"))


# ------------------------------------------------------------------ containers and infrastructure

ISSUES = "path string, line int, rule string, severity string"
ISSUES_ARROW = pa.schema([("path", pa.string()), ("line", pa.int32()), ("rule", pa.string()), ("severity", pa.string())])
SECRET_SET = re.compile(r"(?i)(?:" + "|".join(R.SECRET_WORDS) + r")\w*\s*[=\s:]\s*[\"']?[^\s\"'$]")
PORTS = re.compile(r"""^-\s*["']?(?:\d+(?:\.\d+){3}:)?(\d+):(\d+)""")
TERRAFORM = [  # block's type, what its body must or must not hold, rule, severity
    (r"aws_s3_bucket(?:_acl)?", r'acl\s*=\s*"public-read(?:-write)?"', True, "IAC_TF_PUBLIC_S3", "critical"),
    (r"aws_(?:ebs_volume|db_instance|rds_cluster)", r"(?:storage_)?encrypted\s*=\s*true", False, "IAC_TF_NO_ENCRYPT", "high"),
    (r"aws_security_group(?:_rule)?", r'0\.0\.0\.0/0', True, "IAC_TF_OPEN_SG", "high"),
    (r"aws_(?:db_instance|rds_cluster_instance)", r"publicly_accessible\s*=\s*true", True, "IAC_TF_PUBLIC_RDS", "critical"),
]
TF_SECRET = re.compile(r'(?i)^\s*\w*(?:password|secret|api_key|access_key|token)\w*\s*=\s*"[^"$]{4,}"')
KUBERNETES = [
    (r"privileged:\s*true", "IAC_K8S_PRIVILEGED", "critical"), (r"hostNetwork:\s*true", "IAC_K8S_HOST_NETWORK", "high"), (r"(?:-\s*)?hostPath:", "IAC_K8S_HOST_PATH", "high"),
    (r"(?:-\s*)?image:\s*[\"']?(?:[^\s\"':]+(?::\d+/[^\s\"':]+)?(?::latest)?)[\"']?\s*$", "IAC_K8S_LATEST_TAG", "medium"),
]
WORKLOADS = re.compile(r"(?m)^kind:\s*(?:Deployment|StatefulSet|DaemonSet|Pod|Job|CronJob|ReplicaSet)\b")


def _dockerfile(text: str) -> Iterator[tuple[int, str, str]]:
    joined, user, first = re.sub(r"\\\s*\n", lambda m: " \v", text), False, None
    line = 1
    for raw in joined.split("\n"):
        at, line = line, line + 1 + raw.count("\v")
        s = raw.replace("\v", " ").strip()
        verb, _, rest = s.partition(" ")
        verb, rest = verb.upper(), rest.strip()
        if verb == "FROM":
            first = first or at
            image = next((w for w in rest.split() if not w.startswith("--")), "")
            tagged = ":" in image.rpartition("/")[2] or "@" in image
            if "$" not in image and image != "scratch" and (image.endswith(":latest") or not tagged):
                yield at, "FROM_LATEST", "medium"
        elif verb == "EXPOSE":
            for port in rest.split():
                if port.split("/")[0] in R.SENSITIVE_PORTS:
                    yield at, "EXPOSE_SENSITIVE_PORT", "medium"
        elif verb == "ADD" and not re.search(r"\.t(?:ar\.)?gz$|http", rest.lower()):
            yield at, "ADD_INSTEAD_OF_COPY", "low"
        elif verb == "RUN":
            if re.search(r"apt-get.*install", rest) and "-y" in rest and "--no-install-recommends" not in rest:
                yield at, "APT_NO_RECOMMENDS", "low"
            if re.search(r"(?:curl|wget)\s+.*\|\s*(?:ba)?sh", rest):
                yield at, "PIPE_TO_SHELL", "critical"
        elif verb == "ENV" and SECRET_SET.search(rest):
            yield at, "ENV_SECRET", "high"
        user |= verb == "USER"
    if first and not user:
        yield first, "NO_USER", "high"


def _compose(text: str) -> Iterator[tuple[int, str, str]]:
    limits = re.search(r"(?m)^\s*(?:mem_limit|cpus|limits|mem_reservation):", text)
    services = re.search(r"(?m)^services:", text)
    for at, raw in enumerate(text.split("\n"), 1):
        s = raw.strip()
        if re.match(r"(?i)privileged:\s*true", s):
            yield at, "PRIVILEGED", "critical"
        if (m := PORTS.match(s)) and set(m.groups()) & set(R.SENSITIVE_PORTS):
            yield at, "COMPOSE_SENSITIVE_PORT", "medium"
    if services and not limits:
        yield text.count("\n", 0, services.start()) + 1, "COMPOSE_NO_LIMITS", "low"


def _terraform(text: str) -> Iterator[tuple[int, str, str]]:
    for m in re.finditer(r'(?m)^\s*resource\s+"([^"]+)"\s+"[^"]*"\s*\{', text):
        depth, end = 1, m.end()
        for brace in re.finditer(r"[{}]", text[m.end() :]):
            depth += 1 if brace[0] == "{" else -1
            end = m.end() + brace.end()
            if not depth:
                break
        body = text[m.end() : end]
        if m[1].startswith("aws_security_group"):  # only what comes in is judged
            body = "".join(re.findall(r"ingress\s*\{[^}]*\}", body)) if m[1] == "aws_security_group" else body if re.search(r'type\s*=\s*"ingress"', body) else ""
        for kind, pattern, bad, rule, severity in TERRAFORM:
            if re.fullmatch(kind, m[1]) and bool(re.search(pattern, body)) == bad:
                yield text.count("\n", 0, m.start(1)) + 1, rule, severity
    for at, raw in enumerate(text.split("\n"), 1):
        if TF_SECRET.match(raw):
            yield at, "IAC_TF_HARDCODED_SECRET", "high"


def _kubernetes(text: str) -> Iterator[tuple[int, str, str]]:
    start = 1
    for doc in re.split(r"(?m)^---\s*$", text):
        if re.search(r"(?m)^apiVersion:", doc) and (kind := re.search(r"(?m)^kind:", doc)):
            for at, raw in enumerate(doc.split("\n"), start):
                for pattern, rule, severity in KUBERNETES:
                    if re.match(pattern, raw.strip()):
                        yield at, rule, severity
            if WORKLOADS.search(doc):
                at = start + doc.count("\n", 0, kind.start())
                if not re.search(r"runAsNonRoot:\s*true|runAsUser:\s*[1-9]", doc):
                    yield at, "IAC_K8S_RUN_ROOT", "high"
                if not re.search(r"(?m)^\s*limits:", doc):
                    yield at, "IAC_K8S_NO_LIMITS", "medium"
        start += doc.count("\n")


def infrastructure_issues(path: str, text: str) -> set[tuple[int, str, str]]:
    """(line, rule, severity) of a Dockerfile, compose file, Terraform file or Kubernetes manifest, told by name."""
    base = path.rpartition("/")[2]
    if base.startswith("Dockerfile"):
        return set(_dockerfile(text))
    if re.match(r"(?i)(?:docker-)?compose.*\.ya?ml$", base):
        return set(_compose(text))
    if base.endswith(".tf"):
        return set(_terraform(text))
    return set(_kubernetes(text)) if base.endswith((".yaml", ".yml")) else set()


def infrastructure(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, rule, severity) of all container and infrastructure files; null texts have none."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = sorted(infrastructure_issues(p, t)) if p is not None and t is not None else []
                yield from ({"path": p, "line": a, "rule": r, "severity": s} for a, r, s in found)

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(lambda parts: batches(rows(parts), ISSUES_ARROW), ISSUES)

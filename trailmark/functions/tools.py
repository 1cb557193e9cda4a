"""Column expressions that give tool calls a meaning: action, evidence, outcome, status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import strip

# Names of tools by family, and what a pytest summary counts.
SHELL = ["shell", "bash", "exec", "exec_command", "terminal", "run_command"]
READ = ["read_file", "open_file", "cat_file"]
WRITE = ["write_file", "edit_file", "apply_patch", "patch_file"]
BROWSER = ["browser", "browser_search", "search", "open_url", "navigate", "click"]
HTTP = ["http", "http_request", "request", "fetch"]
PYTEST_SUMMARY = r"\b\d+\s+(?:passed|failed|error|errors|skipped|xfailed|xpassed)\b"


COLUMNS = ["tool_name", "arguments", "output", "error", "exit_code", "metadata"]


@dataclass(frozen=True)
class Call:
    """The columns of a tool call; payloads are JSON or plain text."""

    tool_name: Column
    arguments: Column
    output: Column
    error: Column
    exit_code: Column
    metadata: Column
    #: Payloads that are JSON objects, where they are columns already.
    objects: dict[str, Column] = field(default_factory=dict)

    @classmethod
    def of(cls, prefix: str = "") -> Call:
        return cls(*(F.col(prefix + c) for c in COLUMNS))

    @classmethod
    def parsed(cls, calls: DataFrame) -> tuple[DataFrame, Call]:
        """The calls with their payloads' objects as columns, so that each is parsed once; and the call over them."""
        names = {c: f"__{c}_object" for c in ("arguments", "output", "metadata")}
        return calls.withColumns({to: _object(F.col(c)) for c, to in names.items()}), replace(cls.of(), objects={c: F.col(to) for c, to in names.items()})

    def object(self, payload: str) -> Column:
        """A payload if it is a JSON object, else null."""
        return self.objects[payload] if payload in self.objects else _object(getattr(self, payload))


Handler = Callable[[Call], Column]


def _object(payload: Column) -> Column:
    """The payload if it is a JSON object, else null."""
    return F.when(payload.rlike(r"^\s*\{") & F.try_parse_json(payload).isNotNull(), payload)


def _field(payload: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])


def _truthy(payload: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in names])


def command(call: Call) -> Column:
    """The command line of the call, or an empty string."""
    text = F.when(call.object("arguments").isNotNull(), _field(call.object("arguments"), "command", "cmd")).otherwise(
        F.when(~call.arguments.rlike(r"^\s*\["), call.arguments)
    )
    return strip(F.coalesce(text, F.lit("")))


def path(call: Call) -> Column:
    return strip(F.coalesce(_truthy(call.object("arguments"), "path", "file_path", "file"), F.lit("")))


def output_text(call: Call) -> Column:
    parts = F.concat_ws("\n", *[F.get_json_object(call.object("output"), f"$.{n}") for n in ("stdout", "stderr", "text", "output", "content")])
    return F.when(call.object("output").isNotNull() & (parts != ""), parts).otherwise(F.coalesce(call.output, F.lit("")))


def named(name: Column, aliases: list[str]) -> Column:
    """The name is an alias, or ends with one behind a separator."""
    return name.rlike(r"(?:^|[./:-]|__)(?:" + "|".join(aliases) + r")$")


def failed(call: Call) -> Column:
    return call.error.isNotNull() | F.coalesce(call.exit_code != 0, F.lit(False))


def _semantics(action: Column, evidence: Column, bad: Column, if_bad: str, if_good: str) -> Column:
    return F.struct(
        action.alias("action"),
        evidence.alias("evidence"),
        F.when(bad, if_bad).otherwise(if_good).alias("outcome"),
        F.when(bad, "failure").otherwise("success").alias("status"),
    )


def _exit(call: Call) -> Column:
    return F.concat(F.lit("exit code: "), call.exit_code.cast("string"))


def _error(call: Call) -> Column:
    return F.concat(F.lit("error: "), F.nullif(call.error, F.lit("")))


def _joined(default: str, *parts: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(default))


def pytest_semantics(call: Call) -> Column:
    found = F.regexp_extract_all(output_text(call), F.lit(f"(?iU){PYTEST_SUMMARY}"), F.lit(0))
    tidy = F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", " ")))
    bad = failed(call) | F.exists(tidy, lambda x: x.rlike(r"^0*[1-9]\d* (?:failed|errors?)$"))
    line, summary = F.nullif(command(call), F.lit("")), F.nullif(F.array_join(tidy, ", "), F.lit(""))
    evidence = _joined(
        "pytest executed", F.concat(F.lit("pytest command: "), line), F.concat(F.lit("pytest result: "), summary), _exit(call), _error(call)
    )
    return _semantics(F.lit("run tests"), evidence, bad, "tests fail", "tests pass")


def shell_semantics(call: Call) -> Column:
    line = F.nullif(command(call), F.lit(""))
    head = F.coalesce(F.concat(F.lit("command: "), line), F.lit("shell command executed"))
    return _semantics(F.lit("run shell command"), F.concat_ws("; ", head, _exit(call), _error(call)), failed(call), "command failed", "command succeeded")


def read_semantics(call: Call) -> Column:
    p = F.nullif(path(call), F.lit(""))
    evidence = F.coalesce(F.concat(F.lit("file path: "), p), F.nullif(call.error, F.lit("")), F.lit("file read requested"))
    return _semantics(F.concat_ws(" ", F.lit("read file"), p), evidence, failed(call), "file read failed", "file contents observed")


def write_semantics(call: Call) -> Column:
    p = F.nullif(path(call), F.lit(""))
    action = F.coalesce(F.concat(F.lit("modify file "), p), F.lit("modify repository files"))
    head = F.coalesce(F.concat(F.lit("file path: "), p), F.lit("patch or file update submitted"))
    return _semantics(action, F.concat_ws("; ", head, _error(call)), failed(call), "file modification failed", "file modified")


def browser_semantics(call: Call) -> Column:
    name = F.lower(call.tool_name)
    operation = F.lower(F.coalesce(_field(call.object("arguments"), "operation", "action"), name))
    both = F.concat_ws(" ", operation, name)
    action = F.when(F.contains(both, F.lit("search")), "search the web").when(F.contains(both, F.lit("click")), "interact with web page").otherwise("open web page")
    target = _truthy(call.object("arguments"), "url", "query", "target")
    head = F.coalesce(F.concat(F.lit("browser target: "), target), F.lit("browser action recorded"))
    return _semantics(action, F.concat_ws("; ", head, _error(call)), failed(call), "browser action failed", "browser action completed")


def http_semantics(call: Call) -> Column:
    method = F.upper(F.coalesce(_field(call.object("arguments"), "method"), F.lit("GET")))
    code = F.coalesce(_field(call.object("metadata"), "status_code"), _field(call.object("output"), "status_code", "status")).try_cast("int")
    bad = failed(call) | F.coalesce(code >= 400, F.lit(False))
    evidence = _joined(
        "HTTP request recorded", F.concat(F.lit("url: "), _truthy(call.object("arguments"), "url")), F.concat(F.lit("status code: "), code.cast("string")), _exit(call), _error(call)
    )
    return _semantics(F.concat(F.lit("send "), method, F.lit(" HTTP request")), evidence, bad, "HTTP request failed", "HTTP request succeeded")


def generic_semantics(call: Call) -> Column:
    evidence = F.concat_ws("; ", F.concat(F.lit("tool: "), call.tool_name), _exit(call), _error(call))
    return _semantics(F.concat(F.lit("use tool "), call.tool_name), evidence, failed(call), "tool call failed", "tool call succeeded")


HANDLERS: dict[str, Handler] = {
    "pytest": pytest_semantics, "shell": shell_semantics, "file_read": read_semantics, "file_write": write_semantics,
    "browser": browser_semantics, "http": http_semantics, "generic": generic_semantics,
}


def handler_name(call: Call, custom: dict[str, Handler] | None = None) -> Column:
    """Which handler serves the call; custom ones (by exact name, letter case aside) come first."""
    name = F.lower(call.tool_name)
    chosen = F.when(F.lit(False), "")
    for own in custom or {}:
        chosen = chosen.when(name == own.lower(), f"custom:{own}")
    parts = F.split(name, "[^a-z0-9]+")
    return (
        chosen.when(F.contains(name, F.lit("pytest")) | F.contains(F.lower(command(call)), F.lit("pytest")), "pytest")
        .when(named(name, SHELL), "shell")
        .when(named(name, READ), "file_read")
        .when(named(name, WRITE), "file_write")
        .when(named(name, BROWSER) | F.array_contains(parts, "browser"), "browser")
        .when(named(name, HTTP), "http")
        .otherwise("generic")
    )


def semantics(call: Call, handler: Column, custom: dict[str, Handler] | None = None) -> Column:
    """``action, evidence, outcome, status`` by the named handler."""
    out = F.when(F.lit(False), generic_semantics(call))
    for name, make in {**{f"custom:{k}": v for k, v in (custom or {}).items()}, **HANDLERS}.items():
        out = out.when(handler == name, make(call))
    return out.otherwise(generic_semantics(call))


def record(text: Column, index: Column) -> tuple[Call, dict[str, Column]]:
    """A tool record in JSON, with the names other runtimes use, as a call and its other columns.

    The first name that is present counts, even if it holds null.
    """
    keys = F.json_object_keys(text)

    def first(*names: str) -> Column:
        out = F.when(F.array_contains(keys, names[0]), F.get_json_object(text, f"$.{names[0]}"))
        for n in names[1:]:
            out = out.when(F.array_contains(keys, n), F.get_json_object(text, f"$.{n}"))
        return out

    output = first("output", "result")
    inner = F.json_object_keys(_object(output))
    code = F.when(F.array_contains(inner, "exit_code"), F.get_json_object(_object(output), "$.exit_code")).when(F.array_contains(inner, "returncode"), F.get_json_object(_object(output), "$.returncode"))
    call = Call(
        strip(F.coalesce(first("tool_name", "name", "tool"), F.lit(""))), first("arguments", "input"), output, first("error"),
        F.coalesce(first("exit_code"), code).try_cast("int"), first("metadata"),
    )
    named = {c: first(c) for c in ("node_id", "transition_kind", "state_before", "state_after")}
    own = F.coalesce(strip(first("call_id", "id")), F.concat(F.lit("tool-call-"), index.cast("string")))
    return call, named | {"call_id": own, "occurrence": first("occurrence").try_cast("int")}


def records_events(payload: Column, trusted: Column, custom: dict[str, Handler] | None = None) -> Column:
    """A JSON array of tool records as an array of events: structs in the fields of an event, payloads as they are.

    Records become calls, calls find their handlers, and only then the meaning
    is told, each by a pass over the array, so that no expression is repeated.
    """
    def called(text: Column, index: Column) -> Column:
        call, rest = record(text, index)
        return F.struct(*[getattr(call, n).alias(n) for n in COLUMNS], *[c.alias(n) for n, c in rest.items()])

    def call_of(c: Column) -> Call:
        return Call(*(c[n] for n in COLUMNS))

    calls = F.transform(F.from_json(payload, "array<string>"), called)
    handled = F.transform(calls, lambda c: F.struct(c.alias("c"), handler_name(call_of(c), custom).alias("h")))
    told = F.transform(handled, lambda r: F.struct(r["c"].alias("c"), semantics(call_of(r["c"]), r["h"], custom).alias("x")))

    def event(r: Column) -> Column:
        c, x = r["c"], r["x"]
        return F.struct(
            c["call_id"].alias("event_id"), x["action"].alias("action"), c["node_id"].alias("node_id"), c["occurrence"].alias("occurrence"), x["evidence"].alias("evidence"),
            x["outcome"].alias("outcome"), x["status"].alias("status"), F.lit("runtime").alias("source"), trusted.alias("trusted"), c["transition_kind"].alias("transition_kind"),
            c["tool_name"].alias("tool_name"), c["arguments"].alias("tool_input"), c["output"].alias("tool_output"), c["state_before"].alias("state_before"),
            c["state_after"].alias("state_after"), c["metadata"].alias("metadata"),
        )

    return F.transform(told, event)

"""Settings of an audit: strict coercion, YAML files, one order of precedence.

Defaults give way to a file, a file to explicit options; each is applied once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

#: Words for booleans, keys of suppression rules, formats, default paths and ignored tables.
TRUE_WORDS, FALSE_WORDS = (True, 1, "1", "true", "yes", "on"), (False, 0, "0", "false", "no", "off")
RULE_KEYS = ("code", "column", "model", "severity", "table")
FORMATS = ("text", "json")
DEFAULT_PATHS = ("tablewarden.yml", "config/tablewarden.yml")
IGNORED_TABLES = ("schema_migrations", "ar_internal_metadata")


class AuditError(Exception):
    """What a user of the audit has to mend."""


@dataclass(frozen=True)
class Config:
    dependent_destroy_row_threshold: int = 10_000
    explain_runtime_queries: bool = False
    ignored_findings: tuple[Mapping[str, str], ...] = ()
    where_occurrence_threshold: int = 2
    planner_row_threshold: int = 10_000
    output_format: str = "text"
    runtime_query_report_path: str | None = None
    ignored_tables: tuple[str, ...] = IGNORED_TABLES

    def merged(self, options: Mapping[str, Any] | None) -> Config:
        """A copy with `options` coerced and applied; unknown keys and bad values raise AuditError."""
        if options is None:
            return self
        if not isinstance(options, Mapping):
            raise AuditError(f"settings must be a mapping, not {type(options).__name__}")
        given = {str(k): v for k, v in options.items()}
        known = [f.name for f in fields(self)]
        if unknown := sorted(set(given) - set(known)):
            raise AuditError(f"unknown settings: {', '.join(unknown)}; known are {', '.join(known)}")
        return replace(self, **{key: _COERCE[key](key, value) for key, value in given.items()})


def _integer(minimum: int):
    def coerce(key: str, value: Any) -> int:
        try:
            if isinstance(value, bool) or value is None:
                raise ValueError
            number = int(value) if not isinstance(value, str) else int(value.strip(), 0)
        except (TypeError, ValueError):
            raise AuditError(f"{key} must be an integer, not {value!r}") from None
        if number < minimum:
            raise AuditError(f"{key} must be at least {minimum}, not {value!r}")
        return number

    return coerce


def _boolean(key: str, value: Any) -> bool:
    word = value.lower() if isinstance(value, str) else value
    for words, out in ((TRUE_WORDS, True), (FALSE_WORDS, False)):
        if any(type(word) is type(w) and word == w for w in words):
            return out
    raise AuditError(f"{key} must be true or false, not {value!r}")


def _strings(key: str, value: Any) -> tuple[str, ...]:
    if isinstance(value, str):
        return (value,)
    if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
        raise AuditError(f"{key} must be a string or a list of strings")
    return tuple(value)


def _rules(key: str, value: Any) -> tuple[Mapping[str, str], ...]:
    if not isinstance(value, (list, tuple)):
        raise AuditError(f"{key} must be a list of rules")
    out = []
    for i, rule in enumerate(value):
        if not isinstance(rule, Mapping):
            raise AuditError(f"{key}[{i}] must be a mapping")
        rule = {str(k): v for k, v in rule.items()}
        if not rule:
            raise AuditError(f"{key}[{i}] needs at least one of {', '.join(RULE_KEYS)}")
        if unknown := sorted(set(rule) - set(RULE_KEYS)):
            raise AuditError(f"{key}[{i}] has unknown keys: {', '.join(unknown)}")
        if not all(isinstance(v, str) for v in rule.values()):
            raise AuditError(f"{key}[{i}] must have strings as values")
        out.append(rule)
    return tuple(out)


def one_of(key: str, value: Any, choices: tuple[str, ...]) -> str:
    if not isinstance(value, str) or value.lower() not in choices:
        raise AuditError(f"{key} must be one of {', '.join(choices)}, not {value!r}")
    return value.lower()


def _nullable(key: str, value: Any) -> str | None:
    if value is not None and not isinstance(value, str):
        raise AuditError(f"{key} must be a string or null")
    return value


_COERCE = {
    "dependent_destroy_row_threshold": _integer(0), "explain_runtime_queries": _boolean, "ignored_findings": _rules, "where_occurrence_threshold": _integer(1),
    "planner_row_threshold": _integer(0), "output_format": lambda k, v: one_of(k, v, FORMATS), "runtime_query_report_path": _nullable, "ignored_tables": _strings,
}


def load(path: str | None = None, root: str = ".") -> dict[str, Any]:
    """The mapping in a YAML file: `path` below `root` or as it stands, else the first default path that exists."""
    import yaml

    tries = [Path(root, path), Path(path)] if path else [Path(root, p) for p in DEFAULT_PATHS]
    found = next((p for p in tries if p.is_file()), None)
    if found is None:
        if path:
            raise AuditError(f"no settings file at {path}")
        return {}
    try:
        text = found.read_text(encoding="utf-8")
        if any(isinstance(t, (yaml.AliasToken, yaml.AnchorToken)) for t in yaml.scan(text)):
            raise AuditError(f"{found} uses aliases, which aren't allowed")
        value = yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise AuditError(f"{found} can't be parsed: {error}") from None
    if value is not None and not isinstance(value, Mapping):
        raise AuditError(f"{found} must hold a mapping")
    return dict(value or {})


def resolve(options: Mapping[str, Any] | None = None, path: str | None = None, root: str = ".", base: Config = Config()) -> Config:
    return base.merged(load(path, root)).merged(options)

"""Masking of credentials: flat patterns as column expressions, and the recursive walk over records."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "[MASKED]"
#: The file whose values are masked wherever they occur; one NAME=value a line.
ENV_FILE_VARIABLE = "TIDEWELL_ENV_FILE"

# Token shapes, and the credential names of assignments and of record fields.
TOKEN_SHAPES = r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})"
NAMES = r"[A-Za-z0-9_-]*(?:passwords?|passwd|passphrases?|secrets?|tokens?|api[_-]?keys?|private[_-]?keys?|access[_-]?keys?|credentials?|authorization|auth|db_pass|sshpass|pgpassword|pwd)"
#: Names whose numeric values are masked too; "tokens" are counted often, so they are not among them.
SECRET_NAMES = r"[A-Za-z0-9_-]*(?:passwords?|passwd|passphrases?|secrets?|api[_-]?keys?|private[_-]?keys?|access[_-]?keys?|pwd)"
REFERENCE = r"\s*(?:\$[A-Za-z_][A-Za-z0-9_]*|\$\{[^}]*\}|<[^>]*>|None|none|null)?\s*"

#: Applied one after the other; (pattern, replacement).  Without look-around, so that other engines can run them too.
FLAT = [
    (TOKEN_SHAPES, MARK),
    (rf"(?i)([\"']{SECRET_NAMES}[\"']\s*:\s*)-?[0-9][0-9.]*", rf'$1"{MARK}"'),
    (r"(?i)\b([A-Za-z0-9_-]*passphrases?\s*[=:]\s*)[^\s\"'$<\[{\\][^\"'\n]*", rf"$1{MARK}"),
    (rf"(?i)([\"']{NAMES}[\"']\s*:\s*\")[^\"\n]+(\")", rf"$1{MARK}$2"),
    (rf"(?i)([\"']{NAMES}[\"']\s*:\s*')[^'\n]+(')", rf"$1{MARK}$2"),
    (rf"(?i)\b({NAMES}\s*[=:]\s*\")[^\"\n]+(\")", rf"$1{MARK}$2"),
    (rf"(?i)\b({NAMES}\s*[=:]\s*')[^'\n]+(')", rf"$1{MARK}$2"),
    (rf"(?i)\b({NAMES}\s*[=:]\s*)[^\s\"'$<\[{{\\][^\s\"'\\]*", rf"$1{MARK}"),
    (r"(?i)(--(?:password|passwd|token|secret|api-key)(?:=|\s+))[^\s\[-]\S*", rf"$1{MARK}"),
    (r"(\bsshpass\s+-p\s*)[^\s\[]\S*", rf"$1{MARK}"),
    (r"(\bmysql\b[^\n|;]*?\s-p)[^\s\[]\S*", rf"$1{MARK}"),
    (r"(\bcurl\b[^\n|;]*?\s-u\s+[^\s:]+:)[^\s\[]\S*", rf"$1{MARK}"),
    (r"(\becho\s+)[^\s|\[][^|\n]*?(\s*\|\s*sudo\s+-S)", rf"$1{MARK}$2"),
]
#: Of these a text has one where any of the patterns holds: parts of credential names beside a sign of assignment or an option, token shapes and commands.
NAME_PARTS, SIGNS = ["pass", "secret", "token", "key", "credential", "auth", "pwd"], ["=", ":", "--"]
MARKS = ["sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "AKIA", "xox", "eyJ", "sshpass", "mysql", "curl", "sudo"]
_PYTHON = [(re.compile(p), re.sub(r"\$(\d)", r"\\g<\1>", r)) for p, r in FLAT]
FIELD = re.compile(
    r"(?:^|[_\-. ])(?:passwords?|passwd|passphrases?|pass|pw|pwd|secrets?|tokens?|apikeys?|api[_-]keys?|privatekeys?|private[_-]keys?|accesskeys?|access[_-]keys?|credentials?|authorization|pgpassword|sshpass)$", re.I
)


def _may_hold(text: Column) -> Column:
    """Whether a text may hold what ``FLAT`` masks, by plain searches for fixed strings, which cost far less than the patterns."""
    any_of = lambda c, xs: reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in xs])
    return any_of(text, MARKS) | (any_of(text, SIGNS) & any_of(F.lower(text), NAME_PARTS))


def mask(text: Column) -> Column:
    """``text`` with credentials masked; stays inside the JVM."""
    masked = text
    for pattern, to in FLAT:
        masked = F.regexp_replace(masked, pattern, to)
    return F.when(_may_hold(text), masked).otherwise(text)


def env_values(path: str | None = None) -> list[str]:
    """Values of the environment file, longest first; a file that can't be read is an error."""
    path = path or os.environ.get(ENV_FILE_VARIABLE)
    if not path:
        return []
    from pathlib import Path

    found = re.findall(r"^\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=\s*[\"']?([^\"'\n]+?)[\"']?\s*$", Path(path).read_text(encoding="utf-8"), re.M)
    return sorted({v for v in found if len(v) >= 6}, key=lambda v: (-len(v), v))


def clean(text: str | None, values: list[str] | None = None) -> str | None:
    """The same masking for one text, with the values of the environment file besides."""
    if not text:
        return text
    for v in env_values() if values is None else values:
        text = text.replace(v, MARK)
    for pattern, to in _PYTHON:
        text = pattern.sub(to, text)
    return text


def _words(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)


def is_credential(name: str) -> bool:
    return bool(FIELD.search(_words(name)))


def _counter(name: str, value) -> bool:
    """Numbers under ``..tokens`` are counters, but for access tokens."""
    n = _words(name).lower()
    return isinstance(value, (int, float)) and n.endswith("tokens") and not re.search(r"access[_-]?tokens$", n)


def clean_record(obj, under: str | None = None, values: list[str] | None = None):
    """A record masked value by value; a credential name carries down to all values below it."""
    if isinstance(obj, dict):
        out = {}
        for k, v in obj.items():
            name = str(k)
            below = name if is_credential(name) else under
            out[clean(name, values)] = clean_record(v, below, values)
        return out
    if isinstance(obj, list):
        return [clean_record(x, under, values) for x in obj]
    if obj is None or isinstance(obj, bool):
        return obj
    if under is not None:
        if isinstance(obj, (int, float)):
            return obj if _counter(under, obj) else MARK
        return obj if re.fullmatch(REFERENCE, obj) else MARK
    return clean(obj, values) if isinstance(obj, str) else obj


def clean_metadata(metadata) -> str:
    """Metadata as stored: through JSON (what it can't hold becomes text), masked value by value, then as text."""
    return clean(json.dumps(clean_record(json.loads(json.dumps(metadata, default=str))), ensure_ascii=False))


def record_udf(values: list[str] | None = None):
    """A pandas UDF: JSON text to masked JSON text; what is no JSON is masked as text."""
    values = env_values() if values is None else values

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(s):
            if s is None:
                return None
            try:
                return clean(json.dumps(clean_record(json.loads(s), None, values), ensure_ascii=False), values)
            except ValueError:
                return clean(s, values)

        for batch in batches:
            yield batch.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())


def masked_tail(output: Column, window: int = 64_000, keep: int = 2_000) -> Column:
    """The last characters of an output, masked before the cut."""
    return F.right(mask(F.right(output, F.lit(window))), F.lit(keep))

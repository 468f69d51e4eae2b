"""Secret scan: candidates by pattern, false positives removed by a random forest, in SQL functions only.

Candidates are blocks of private keys; the value behind a credential word and an assignment (quoted: all up to the closing quote, spaces and
all; unquoted: a run without blanks; 6 to 200 characters, whatever they are); and runs of 12 or more token characters that hold a digit
and a letter, or a known prefix, or change from small letters to capitals twice.  The forest decides on each.  Its features are
whole numbers made by SQL expressions: length, shares of character kinds, transitions
between kinds, distinct characters, dictionary coverage, the path (source) and the
neighbouring words.  The forest is trained on the driver from labelled findings, at most
``MAX_LABELLED`` of them, and compiled into one SQL expression, so that scanning runs inside
the JVM without Python.
"""

from __future__ import annotations

import random
import re
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A credential word with what may follow it, an assignment, and the value's opening.
ASSIGNED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)[A-Za-z0-9_-]{0,16}[\"']?[ ]{0,3}(?:=>|[=:])[ ]{0,3}"
VALUE = r"(?:\"[^\"\n]{6,200}|'[^'\n]{6,200}|[^\x20\x09-\x0D\"'<>,;]{6,200})"
KEY_BLOCK = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,20}PRIVATE KEY-----"
CANDIDATE = f"{KEY_BLOCK}|{ASSIGNED}{VALUE}|[A-Za-z0-9+/_-]{{12,}}={{0,2}}"
#: What stands before the value in a match; a match without it is the candidate itself.
LEAD = rf"^{ASSIGNED}[\"']?"
#: Prefixes of known kinds of keys; runs that are candidates without an assignment.
PREFIX = "^(AKIA|ASIA|gh[opsu]_|xox[abp]-|sk-|eyJ)"
LIKELY = PREFIX + "|[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z].*[a-z][A-Z]|^-----BEGIN"
LEFT, RIGHT = 48, 16
MAX_LABELLED = 4000
TREES, DEPTH, LEAF = 15, 5, 8
#: Of 1000; the mean vote from which a candidate is reported as a secret.
THRESHOLD = 500

# Words whose presence tells about a candidate.
CREDENTIAL_WORDS = ["token", "secret", "passw", "pwd", "passphrase", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "bearer", "credential"]
BENIGN_WORDS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "build", "revision", "version", "order", "invoice", "isbn", "href", "src=", "http", "path", "file"]
PATH_WORDS = ["test", "spec", "example", "sample", "fixture", "mock", "doc"]
DICTIONARY = ["example", "sample", "changeme", "replace", "placeholder", "password", "secret", "token", "your", "insert", "dummy", "test", "demo", "here", "value", "default", "config", "service", "server", "client", "account", "user", "admin", "name", "file", "path", "index", "image", "style", "script", "version", "release", "module", "package", "public", "private", "static", "content", "upload", "download", "report", "month", "year", "part", "page", "item", "node", "main", "data", "table", "model", "view", "log", "api", "key", "the", "and", "for"]

FEATURES = ["f_len", "f_digit", "f_upper", "f_runs", "f_distinct", "f_words", "f_hex", "f_cred", "f_benign", "f_assign", "f_quoted", "f_path", "f_dash", "f_other", "f_block", "f_prefix"]


def _any(words: list[str]) -> str:
    return "(" + "|".join(re.escape(w).replace("\\-", "-") for w in words) + ")"


def feature_sql(replace_all, matches, distinct, cand: str = "cand", left: str = "lhs", right: str = "rhs", path: str = "path") -> dict[str, str]:
    """SQL for each feature.  ``replace_all(x, regex, to)``, ``matches(x, regex)`` and ``distinct(x)`` hide the dialect."""
    n = f"length({cand})"
    without = lambda regex: f"length({replace_all(cand, regex, '')})"
    runs = cand
    for regex, to in (("[a-z]+", "a"), ("[A-Z]+", "B"), ("[0-9]+", "1"), ("[^a-zA-Z0-9]+", "-")):
        runs = replace_all(runs, regex, to)
    flag = lambda test: f"(CASE WHEN {test} THEN 1 ELSE 0 END)"
    share = lambda part: f"CAST(floor(({part}) * 100 / {n}) AS BIGINT)"
    return {
        "f_len": f"CAST({n} AS BIGINT)",
        "f_digit": share(f"{n} - {without('[0-9]')}"),
        "f_upper": share(f"{n} - {without('[A-Z]')}"),
        "f_runs": share(f"length({runs})"),
        "f_distinct": share(distinct(cand)),
        "f_words": share(f"{n} - length({replace_all(f'lower({cand})', _any(DICTIONARY), '')})"),
        "f_hex": flag(matches(cand, "^([0-9a-f]+|[0-9A-F]+)$")),
        "f_cred": flag(matches(f"lower({left})", _any(CREDENTIAL_WORDS))),
        "f_benign": flag(matches(f"lower({left})", _any(BENIGN_WORDS))),
        "f_assign": flag(matches(left, "[=:][ ]*[\"']?$")),
        "f_quoted": flag(f"{matches(left, chr(91) + chr(34) + chr(39) + chr(93) + '$')} AND {matches(right, '^' + chr(91) + chr(34) + chr(39) + chr(93))}"),
        "f_path": flag(matches(f"lower({path})", _any(PATH_WORDS))),
        "f_dash": share(f"{n} - {without('[-_/]')}"),
        "f_other": share(f"{n} - {without('[^A-Za-z0-9/_-]')}"),
        "f_block": flag(matches(cand, "^-----BEGIN")),
        "f_prefix": flag(matches(cand, PREFIX)),
    }


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPARK_SQL = {
    "replace_all": lambda x, regex, to: f"regexp_replace({x}, {_quote(regex)}, {_quote(to)})",
    "matches": lambda x, regex: f"({x}) rlike {_quote(regex)}",
    "distinct": lambda x: f"size(array_distinct(split({x}, '')))",
}


def found(match: str) -> tuple[str, str, bool]:
    """A match's lead, its candidate, and whether the forest is asked about it, in plain Python."""
    m = re.match(LEAD, match)
    lead = m.group() if m and len(match) - m.end() >= 6 else ""
    return lead, match[len(lead) :], bool(lead or re.search(LIKELY, match))


def features(cand: str, left: str, right: str, path: str) -> list[int]:
    """The same features in plain Python, for training rows."""
    n = len(cand)
    cut = lambda regex, s=cand: len(re.sub(regex, "", s))
    runs = cand
    for regex, to in (("[a-z]+", "a"), ("[A-Z]+", "B"), ("[0-9]+", "1"), ("[^a-zA-Z0-9]+", "-")):
        runs = re.sub(regex, to, runs)
    has = lambda words, s: int(bool(re.search(_any(words), s.lower())))
    share = lambda part: part * 100 // n
    return [
        n, share(n - cut("[0-9]")), share(n - cut("[A-Z]")), share(len(runs)), share(len(set(cand))), share(n - cut(_any(DICTIONARY), cand.lower())),
        int(bool(re.search("^([0-9a-f]+|[0-9A-F]+)$", cand))), has(CREDENTIAL_WORDS, left), has(BENIGN_WORDS, left), int(bool(re.search("[=:][ ]*[\"']?$", left))),
        int(bool(re.search("[\"']$", left) and re.search("^[\"']", right))), has(PATH_WORDS, path), share(n - cut("[-_/]")),
        share(n - cut("[^A-Za-z0-9/_-]")), int(cand.startswith("-----BEGIN")), int(bool(re.search(PREFIX, cand))),
    ]


def labelled_findings(n: int = MAX_LABELLED, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, text before, text after, path, 1 if a secret), made by rule from a seed."""
    r = random.Random(seed)
    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    text = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(6)) + r.choice([" ", ". ", "\n", ", "])
    hexa = lambda k: text(k, r.choice(["0123456789abcdef"] * 3 + ["0123456789ABCDEF"]))
    shapes = [lambda: hexa(r.choice([32, 40, 64])), lambda: text(r.randint(20, 64), alnum), lambda: "AKIA" + text(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), lambda: "ghp_" + text(36, alnum), lambda: "sk-" + text(r.randint(20, 48), alnum), lambda: text(r.randint(24, 60), alnum + "+/") + r.choice(["", "=", "=="]), lambda: "xoxb-" + text(12, "0123456789") + "-" + text(24, alnum)]
    decoys = [
        lambda: (hexa(40), r.choice(["commit ", "sha1: ", "revision ", "commit=", "checksum = \""])),
        lambda: (hexa(64), r.choice(["sha256:", "digest ", "sha256 = \"", "hash: "])),
        lambda: (str(uuid.UUID(int=r.getrandbits(128))), r.choice(["uuid ", "guid: ", "id=", prose()])),
        lambda: (r.choice(["your_api_key_here", "example-token", "changeme_password", "replace_secret", "insert-token-here", "dummy_value", "default_password"]) + r.choice(["_1", "-123", "01", "2024"]), r.choice(["token = \"", "api_key: ", "password=", "secret = '"])),
        lambda: (r.choice(["x", "X", "0", "1"]) * r.randint(12, 32) + r.choice("019"), r.choice(["token = \"", "key=", prose()])),
        lambda: ("/".join(word() for _ in range(r.randint(2, 5))) + f"/{word()}{r.randint(0, 99)}", r.choice(["path ", "file: ", "src=\"", "http://", prose()])),
        lambda: ("_".join(word() for _ in range(r.randint(2, 5))) + str(r.randint(0, 999)), prose()),
        lambda: (word() + word() + word() + word() + str(r.randint(0, 9)), prose()),
        lambda: (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", prose()),
        lambda: (f"{text(r.randint(1, 3), lower)}{text(r.randint(11, 18), '0123456789')}", r.choice(["order ", "invoice ", "isbn ", prose()])),
        lambda: (f"{word()}-{word()}-{r.randint(1, 9)}-{word()}-{r.randint(0, 99)}", r.choice(["version ", "build ", prose()])),
    ]
    block = lambda: "-----BEGIN " + r.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----\n" + "\n".join(text(64, alnum + "+/") for _ in range(r.randint(3, 12))) + "\n-----END PRIVATE KEY-----"
    mixed = alnum + "!@#%^&*()-_=+.?"
    phrase = lambda: r.choice([" ", "-", "_", "."]).join(word() for _ in range(r.randint(3, 6)))
    short = [lambda: text(r.randint(8, 16), mixed), lambda: text(r.randint(8, 11), alnum), lambda: word() + text(r.randint(2, 4), "0123456789") + r.choice("!?#*$"), lambda: text(r.randint(12, 24), "0123456789"), phrase]
    shapes += [lambda: "AKIA" + text(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")] * 2 + [lambda: "ASIA" + text(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")]
    hints = ["required", "must be changed", "see the manual", "optional", "<your key>", "not set", "disabled", "undefined", "required for login", "to be filled in", "ask the owner", "xxxxxxxx", "********", "changeme", "password", "example", "${TOKEN}", "{{ secret }}", "env.SECRET", "os.environ", "getpass()", "None here", "string", "function", "process.env.KEY"]
    keys = ["token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "private_key"]
    rows = []
    while len(rows) < n:
        path = r.choice(["src%d" % r.randint(0, 30)] * 3 + ["tests/fixture", "docs/example", "conf", "app/settings"])
        if len(rows) % 2:
            quote, p = r.choice(["\"", "\"", "'", ""]), r.random()
            before = prose() + r.choice(keys) + r.choice([" = ", "=", ": ", ":"]) + quote if p < 0.8 else prose() + r.choice(["Bearer ", "bearer ", "Authorization: ", "using token "])
            made = block() if p > 0.95 else r.choice(short)() if p < 0.3 else r.choice(shapes)()
            if " " in made and not quote and not made.startswith("-----"):
                continue
            if made.startswith("-----") or (re.search(PREFIX, made) and r.random() < 0.6):
                before, quote = prose(), ""
            rows.append((made, before, (quote if before.endswith(quote) else "") + " " + prose()[:8], path, 1))
        elif r.random() < 0.3:
            quote = r.choice(["\"", "'", ""])
            made = r.choice([lambda: r.choice(hints), word])() if quote else r.choice([x for x in hints if " " not in x] + [word() + word()] * 8)
            rows.append((made, prose() + r.choice(keys) + r.choice([" = ", "=", ": "]) + quote, quote + " " + prose()[:8], path, 0))
        else:
            cand, before = r.choice(decoys)()
            quote = before[-1] if before[-1] in "\"'" else ""
            rows.append((cand, prose() + before, quote + " " + prose()[:8], path, 0))
    # Findings as the scan itself would report them; the rest (a value of five letters, say) is never asked about.
    kept = []
    for cand, before, after, path, label in rows:
        whole = before + cand + after
        for m in re.finditer(CANDIDATE, whole):
            lead, got, asked = found(m.group())
            if asked and m.start() + len(lead) == len(before) and got == cand:
                kept.append((cand, before[-LEFT:], after[:RIGHT], path, label))
    return kept


def train_forest(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list:
    """Trees as nested tuples (feature, threshold, at most, above); leaves are votes of 1000."""
    rng = np.random.default_rng(seed)

    def grow(idx: np.ndarray, depth: int):
        p = y[idx].mean()
        if depth == 0 or len(idx) < 2 * LEAF or p in (0.0, 1.0):
            return int(round(1000 * p))
        best = (p * (1 - p) * len(idx) - 1e-9, None, None)
        for f in sorted(rng.choice(x.shape[1], 5, replace=False).tolist()):
            v = x[idx, f]
            for t in np.unique(np.quantile(v, [0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9]).astype(int)).tolist():
                low = v <= t
                k = int(low.sum())
                if min(k, len(idx) - k) >= LEAF:
                    a, b = y[idx[low]].mean(), y[idx[~low]].mean()
                    gini = a * (1 - a) * k + b * (1 - b) * (len(idx) - k)
                    if gini < best[0]:
                        best = (gini, f, t)
        if best[1] is None:
            return int(round(1000 * p))
        low = x[idx, best[1]] <= best[2]
        return (best[1], best[2], grow(idx[low], depth - 1), grow(idx[~low], depth - 1))

    return [grow(rng.integers(0, len(y), len(y)), DEPTH) for _ in range(TREES)]


@lru_cache(maxsize=4)
def forest(n: int = MAX_LABELLED) -> tuple:
    rows = labelled_findings(n)
    return tuple(train_forest(np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float)))


def vote(trees: tuple, row: list[int]) -> int:
    total = 0
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t
    return total // len(trees)


def forest_sql(trees: tuple, prefix: str = "") -> str:
    """The mean vote of 1000 as SQL over the columns FEATURES."""

    def of(t) -> str:
        return str(t) if isinstance(t, int) else f"CASE WHEN {prefix}{FEATURES[t[0]]} <= {t[1]} THEN {of(t[2])} ELSE {of(t[3])} END"

    return f"CAST(floor(({' + '.join(f'({of(t)})' for t in trees)}) / {len(trees)}) AS BIGINT)"


def _with_candidates(docs: DataFrame, text_col: str, path_col: str) -> DataFrame:
    """Adds ``__s_gaps`` (texts between candidates) and ``__s_found`` (structs ord, cand, vote, secret) per row."""
    pattern = _quote(CANDIDATE)
    text, path = f"coalesce(`{text_col}`, '')", f"coalesce(`{path_col}`, '')"
    out = docs.withColumns({"__s_cands": F.expr(f"regexp_extract_all({text}, {pattern}, 0)"), "__s_gaps": F.expr(f"split({text}, {pattern}, -1)")})
    feats = feature_sql(cand="x.cand", left="x.lhs", right="x.rhs", path=path, **SPARK_SQL)
    lead = f"regexp_extract(c, {_quote(LEAD)}, 0)"
    led = f"transform(__s_cands, (c, i) -> named_struct('ord', i, 'match', c, 'lead', if(length(c) - length({lead}) >= 6, {lead}, '')))"
    likely = f"filter({led}, x -> x.lead <> '' or x.match rlike {_quote('(?s)' + LIKELY)})"
    shape = f"named_struct('ord', x.ord, 'lead', x.lead, 'cand', substr(x.match, length(x.lead) + 1), 'lhs', right(concat(element_at(__s_gaps, x.ord + 1), x.lead), {LEFT}), 'rhs', left(element_at(__s_gaps, x.ord + 2), {RIGHT}))"
    near = f"transform({likely}, x -> {shape})"
    made = "named_struct('ord', x.ord, 'lead', x.lead, 'cand', x.cand, " + ", ".join(f"'{k}', {v}" for k, v in feats.items()) + ")"
    voted = f"transform(transform({near}, x -> {made}), x -> named_struct('ord', x.ord, 'lead', x.lead, 'cand', x.cand, {', '.join(f"'{f}', x.{f}" for f in FEATURES)}, 'vote', {forest_sql(forest(), 'x.')}))"
    return out.withColumn("__s_found", F.expr(voted))


def scan(docs: DataFrame, text_col: str = "text", path_col: str = "source", keep_cols: list[str] | None = None) -> DataFrame:
    """One row per candidate: the columns of ``docs`` (or ``keep_cols``), ``__s_ord`` (its place among the text's matches),
    ``__s_cand``, ``__s_<feature>`` for each of FEATURES, ``__s_vote`` (of 1000) and ``__s_secret``.

    Null and empty texts have no candidates; a null path counts as empty; repeated rows report repeatedly.
    """
    cols = docs.columns if keep_cols is None else keep_cols
    rows = _with_candidates(docs, text_col, path_col).select(*cols, F.explode("__s_found").alias("__s"))
    return rows.select(*cols, F.col("__s.ord").cast("long").alias("__s_ord"), F.col("__s.cand").alias("__s_cand"), *[F.col(f"__s.{f}").alias(f"__s_{f}") for f in FEATURES], F.col("__s.vote").alias("__s_vote"), (F.col("__s.vote") >= THRESHOLD).alias("__s_secret"))


def redact(docs: DataFrame, text_col: str = "text", path_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text_col`` replaced by ``mark``; the credential word before it stays, as do all rows; null texts stay null."""
    hits = f"map_from_entries(transform(filter(__s_found, x -> x.vote >= {THRESHOLD}), x -> named_struct('k', x.ord, 'v', x.lead)))"
    found = _with_candidates(docs, text_col, path_col).withColumn("__s_hits", F.expr(hits))
    masked = f"concat(__s_gaps[0], array_join(transform(__s_cands, (c, i) -> concat(if(map_contains_key(__s_hits, i), concat(__s_hits[i], {_quote(mark)}), c), __s_gaps[i + 1])), ''))"
    return found.withColumn(text_col, F.when(F.size("__s_hits") > 0, F.expr(masked)).otherwise(F.col(text_col))).select(*docs.columns)

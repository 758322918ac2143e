"""Secrets by patterns and by assignments of source and configuration text.

Patterns give the base spans.  Besides, the text is lexed into names, strings,
bare values and operators, and statements of the form ``name = value``,
``name: value``, ``"name": value``, ``name := value``, ``name => value`` and
``a["name"] = value`` are read as pairs of a name and an expression of literals and other names, joined
by ``+``.  Names in an expression stand for what they were assigned, so a
literal is scored under every name that it reaches.  A literal whose best score,
from the words of the target name and from its own signs, reaches ``least``
becomes a span of kind assign beside the base ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.textcore import arrow_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Words of target names and how much each says.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "pass": 2.0, "secret": 3.0, "token": 2.5, "credential": 2.5, "credentials": 2.5,
    "apikey": 3.0, "bearer": 2.0, "auth": 1.5, "authorization": 2.0, "private": 1.5, "key": 1.5, "access": 0.5, "api": 0.5, "signing": 1.0,
    "encryption": 1.0, "salt": 1.5, "session": 1.0, "cookie": 1.0, "signature": 1.0, "webhook": 1.0,
}
#: Words of target names that say the value is no secret.
HARMLESS = {"id", "name", "path", "file", "url", "uri", "type", "length", "len", "count", "hint", "field", "label", "policy", "public", "expires", "ttl", "header"}
#: Literals that stand for another value.
PLACEHOLDERS = {"none", "null", "nil", "true", "false", "undefined", "changeme", "example", "password", "secret", "token", "placeholder", "redacted", "string", "str", "your_password"}

_LEXEME = re.compile(
    r"""(?P<string>"(?:\\.|[^"\\\n])*+"|(?<!\w)'(?:\\.|[^'\\\n])*+'|`[^`\n]*+`)
    |(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]<>])
    |(?P<line>\n)
    |(?P<word>[^\s"'`=:+,;(){}\[\]<>]++)
    |(?P<other>["'`])""",
    re.VERBOSE,
)
_NAME = re.compile(r"[A-Za-z_$@-][\w$.@/-]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SETS = {"=", ":", ":=", "=>"}
#: Literals that a template or a variable gives, and URLs without a password.
_TEMPLATE = re.compile(r"\$\{[^}]*\}|\$\(|\$[A-Za-z_]\w*$|\{\{|\{\w*\}|%\(\w+\)|%\w+%?$|<[^<>]*>|\*+$")
_URL = re.compile(r"://(?![^/?#\s]*:[^/?#\s]+@)")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """For each kind the spans that its pattern matches and that pass its test."""
    assign = [m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if ":" in text or "=" in text else []
    access = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return [assign, access, [m.span() for m in _HEX.finditer(text)]]


def lex(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Kind (string, op, line, word), value, and where the value begins and ends (inside its quotes)."""
    for m in _LEXEME.finditer(text):
        kind = m.lastgroup
        if kind == "string":
            yield kind, m.group()[1:-1], m.start() + 1, m.end() - 1
        elif kind != "other":
            yield kind, m.group(), m.start(), m.end()


#: An operand: a literal with its place, or a name to look up.
Operand = tuple[str, str, int, int]


def assignments(text: str) -> list[tuple[str, int, list[Operand]]]:
    """Target names, where each stands, and the operands of what is assigned."""
    lexed = list(lex(text))
    if "]" in text:  # a["name"] = value: the name stands before the operator without the bracket
        lexed = [x for k, x in enumerate(lexed) if x[:2] != ("op", "]") or k < 2 or k + 1 == len(lexed) or (lexed[k - 2][:2], lexed[k - 1][0], lexed[k + 1][:2]) != (("op", "["), "string", ("op", "="))]
    out = []
    k, n = 0, len(lexed)
    while k + 1 < n:
        kind, name, at, _ = lexed[k]
        if kind not in ("word", "string") or lexed[k + 1][:2][0] != "op" or lexed[k + 1][1] not in _SETS or not _NAME.fullmatch(name):
            k += 1
            continue
        j = k + 2
        if lexed[k + 1][1] == ":" and j + 1 < n and lexed[j][0] == "word" and lexed[j + 1][1] == "=" and lexed[j + 1][0] == "op":
            j += 2  # name: type = value
        operands: list[Operand] = []
        while j < n and lexed[j][0] in ("word", "string"):
            operands.append(lexed[j])
            if j + 2 < n and lexed[j + 1][:2] == ("op", "+") and lexed[j + 2][0] in ("word", "string"):
                j += 2
                continue
            j += 1
            break
        if operands:
            out.append((name, at, operands))
        k = max(k + 2, j - 1 if operands else k + 2)
        if operands and k < n and lexed[k][0] in ("word", "string") and not (k + 1 < n and lexed[k + 1][:2][0] == "op" and lexed[k + 1][1] in _SETS):
            k += 1
    return out


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _PARTS.findall(name)]
    joined = "".join(words)
    score = max([0.0, *(SENSITIVE.get(w, 0.0) for w in words)]) + 0.5 * sum(w in SENSITIVE for w in words[:-1])
    if any(x in joined for x in ("apikey", "accesskey", "privatekey", "secretkey", "authtoken", "clientsecret")):
        score = max(score, 3.0)
    if words and words[-1] in HARMLESS:
        score -= 3.0
    return score


def looks_secret(literal: str) -> float:
    """How much the signs of a literal say: bits of entropy, classes of signs, length; far below 0 for placeholders."""
    n = len(literal)
    if n < 6 or literal.lower() in PLACEHOLDERS or re.search(r"\s|^\.+$", literal) or _TEMPLATE.match(literal) or _URL.search(literal) or len(set(literal)) < 4:
        return -9.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 0.5 * (bits - 2.5) + 0.5 * (classes - 1) + (0.5 if n >= 16 else 0.0)


def scored(text: str) -> Iterator[tuple[int, int, float]]:
    """Place and best score of each literal that reaches a name."""
    found = assignments(text)
    if not any(sensitivity(name) > 0 for name, *_ in found):
        return
    defined: dict[str, list[int]] = {}
    for k, (name, _, _) in enumerate(found):
        defined.setdefault(name, []).append(k)
    # From the most sensitive target on, so that the first visit of an assignment is the best one.
    seen: set[int] = set()
    best: dict[tuple[int, int], float] = {}
    weighed = sorted(((sensitivity(name), k) for k, (name, _, _) in enumerate(found)), key=lambda x: (-x[0], x[1]))
    for weight, k in weighed:
        if weight <= 0:
            break
        todo = [k]
        while todo:
            where = todo.pop()
            if where in seen:
                continue
            seen.add(where)
            for kind, value, a, b in found[where][2]:
                known = defined.get(value) if kind == "word" else None
                if known:  # the last definition before this use, else the first one after it
                    i = bisect_left(known, where)
                    todo.append(known[i - 1] if i else known[0])
                    continue
                value = value.rstrip(".,;")
                b = a + len(value)
                if (a, b) not in best:
                    best[a, b] = weight + looks_secret(value)
    for (a, b), score in sorted(best.items()):
        yield a, b, score


def find(docs: DataFrame, least: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every text, one row for each row.

    id_col; n_assign, n_access, n_hex (base spans); base_sha256 (of
    kind:start:end by start, then kind, comma-joined; code points); spans (the
    same for base and added spans); n_added.  An added literal has no sign in
    common with a base span.  A null text is empty; null and repeated ids stay
    as they are, and equal texts have equal spans; an empty table gives no rows; a
    very long text is read as a whole, in time in proportion to its length; other
    columns are not read, whatever their names.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def joined(spans: list[list[tuple[int, int]]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, own in enumerate(spans) for a, b in own))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans, added = [], [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t) if t else [[], [], []]
                for c, own in zip(counts, base, strict=True):
                    c.append(len(own))
                text = joined(base)
                digests.append(sha256(text.encode()).hexdigest())
                more = []
                if t and ("=" in t or ":" in t):
                    held = sorted(x for own in base for x in own)
                    reach = list(accumulate((y for _, y in held), max))  # the farthest end so far
                    more = [(a, b) for a, b, score in scored(t) if score >= least and not ((k := bisect_left(held, (b, 0))) and reach[k - 1] > a)]
                spans.append(joined([base[0] + more, base[1], base[2]]) if more else text)
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)

"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  The field is a chain over all tokens of a text, in
which words with neither a digit nor an ``@`` are held at "no entity" and base
spans at theirs, so only the tokens between (the nodes, with the base spans) have
to be kept: what neighbours them is another node or a word.  Tokens of a document
that repeat or resemble each other (the same sign sequence, the same last digits,
the same name before an ``@``) share a skip potential, however far apart they
stand.  Weights, those of skips too, are fitted by pseudo-likelihood on a bounded
sample, in which each base span also comes once more as it might be repeated (in
part, or written in another way), and beside that a token of the same form that
repeats nothing and is no entity.  So forms alone say little and skips decide.  Open
tokens that resemble an entity say nothing in it, as nobody knows what they are.  Marginals come from loopy message passing
over all documents of a batch at once.  A token whose entity has a marginal of
``least`` or more becomes a span beside the base ones.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm import shared
from vicinal.llm.textcore import arrow_batches

KINDS = ("email", "ip", "card", "phone")
N_LABELS = len(KINDS) + 1  # the last: no entity
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A match cannot begin inside a run of digits, nor inside a host name, so these
# begin at the first sign that is rare and give the same matches in linear time.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OPEN = re.compile(r"[0-9@]\S*")
_ENDS = ".,;:!?()[]{}<>\"'#$%&*|"
_DIGITS = re.compile(r"[^0-9]+")
_OTHER = str.maketrans("0123456789", "5678901234")
_TOKEN = re.compile(r"\S+")
_SIGN = re.compile(r"\w")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """For each kind the spans that its pattern matches and that pass its test."""
    email: list[tuple[int, int]] = []
    ip: list[tuple[int, int]] = []
    card: list[tuple[int, int]] = []
    phone: list[tuple[int, int]] = []
    if "@" in text:
        end = 0
        for m in _HOST.finditer(text):
            at = low = m.start()
            while low > end:  # back over the name, in steps, as it may be long
                back = max(end, low - 64)
                part = text[back:low]
                left = len(part.rstrip(_LOCAL))
                low = back + left
                if left:
                    break
            if low < at:
                email.append((low, m.end()))
                end = m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for x in m.groups() for p in (x.lstrip("0") or "0",)):
                ip.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                phone.append(m.span())
    return [email, ip, card, phone]


@dataclass
class Graph:
    """Nodes of one document: span, label (-1: open), features, whether a word stands before and after it; pairs of nodes by kind of potential."""

    spans: list[tuple[int, int]]
    labels: list[int]
    features: list[list[int]]
    words: list[tuple[bool, bool]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


N_FEATURES = 99
#: Features that say which entities a token can be at all.
_CAN_CARD, _CAN_PHONE, _CAN_IP = 96, 97, 98
def features(token: str, before: str, after: str) -> list[int]:
    """Numbers of the features that a token has."""
    n = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots, dashes = token.count("."), token.count("-")
    out = [0, 1 + (n > 0) + (n > 3) + (n > 6) + (n > 8) + (n > 12) + (n > 15) + (n > 19)]
    out.append(10 + min(dots, 4))
    out.append(16 + min(dashes, 3))
    out.append(20 + (letters > 0) + (letters > n))
    if "@" in token:
        out.append(24 + (0 < token.find("@") < len(token) - 1) + 2 * ("." in token[token.rfind("@") :]))
    if token[0] == "+":
        out.append(29)
    if token.isascii() and token.isdigit():
        out.append(30 + (13 <= n <= 19 and luhn(token)))
    digits = _DIGITS.sub("", token)
    if 13 <= n <= 19 and luhn(digits) and n + token.count(" ") + dashes == len(token):
        out.append(_CAN_CARD)
    if 7 <= n <= 15 and not letters:
        out.append(_CAN_PHONE)
    if 3 <= dots <= 4 and n and not letters:
        out.append(_CAN_IP)
    if dots == 3 and all(p.isdigit() for p in token.split(".")):
        out.append(32)
    if any(c in "=:/_" for c in token):
        out.append(33)
    if re.fullmatch(r"[0-9a-f]+", token):
        out.append(34)
    if token.isupper():
        out.append(35)
    for k, word in enumerate((before, after)):
        out.append(36 + 30 * k + sha256(word.lower().encode("utf-8", "replace")).digest()[0] % 30)
    return out


def _keys(token: str, kind: int) -> list[str]:
    low = token.lower()
    out = ["=" + low] if len(low) > 5 else []
    digits = _DIGITS.sub("", token)
    if len(digits) >= 7:
        out.append("#" + digits[-7:])
    name = low.partition("@")[0]
    if kind == 0 or "@" in low:
        out.append("=" + name)
    return out


def _again(token: str, kind: int) -> str | None:
    """An entity as a text may repeat it without its pattern: a name without the domain's end, the last digits of a phone, a card with other signs between; an address has no such form."""
    digits = _DIGITS.sub("", token)
    if kind == 0:
        return token[: token.find(".", token.find("@"))]
    if kind == 2:
        return "--".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return digits[-7:-4] + "-" + digits[-4:] if kind == 3 else None


def _unlike(form: str, kind: int) -> str:
    """A token of the same form that repeats nothing: other digits (of a card with a valid last one), or the name backwards."""
    if kind == 0:
        name, _, host = form.rpartition("@")
        return name[::-1].translate(_OTHER) + "x@" + host
    other = form.translate(_OTHER)
    return next(x for d in "0123456789" for x in (other[:-1] + d,) if kind != 2 or luhn(_DIGITS.sub("", x)))


def graph(text: str, base: list[list[tuple[int, int]]], train: bool = False) -> Graph | None:
    """The nodes and edges of a document; None if no token is open.

    train: documents without open tokens too, and each base span once more (see
    ``_again``), between words and with a skip edge to the span, and ``_unlike`` it.
    """
    held = sorted((a, b, k) for k, spans in enumerate(base) for a, b in spans)
    nodes: list[tuple[int, int, int]] = list(held)
    end = k = 0
    for m in _OPEN.finditer(text):
        low = max(end, *(text.rfind(c, end, m.start()) + 1 for c in " \n\t\r"))
        end = m.end()
        a, b = low, end
        part = text[a:b]
        a += len(part) - len(part.lstrip(_ENDS))
        b = a + len(text[a:b].rstrip(_ENDS))
        if a >= b:
            continue
        while k < len(held) and held[k][1] <= a:
            k += 1
        if any(x < b and y > a for x, y, _ in held[max(0, k - 1) : k + 4]):
            continue
        nodes.append((a, b, -1))
    if not train and all(label >= 0 for *_, label in nodes):
        return None
    nodes.sort()
    begins, ends = zip(*(m.span() for m in _TOKEN.finditer(text)), strict=True) if nodes else ((), ())
    out = Graph([], [], [], [], [], [])
    seen: dict[str, int] = {}

    def add(a: int, b: int, label: int, token: str, words: tuple[bool, bool]) -> int:
        i, j = bisect_left(begins, a) - 1, bisect_right(ends, b)
        before = text[begins[i] : min(ends[i], a)] if i >= 0 else ""
        after = text[max(begins[j], b) : ends[j]] if j < len(ends) else ""
        out.spans.append((a, b))
        out.labels.append(label)
        out.features.append(features(token, before, after))
        out.words.append(words)
        return len(out.spans) - 1

    last = -1
    for i, (a, b, label) in enumerate(nodes):
        low, high = nodes[i - 1][1] if i else 0, nodes[i + 1][0] if i + 1 < len(nodes) else len(text)
        token = text[a:b]
        here = add(a, b, label, token, (bool(_SIGN.search(text, low, a)), bool(_SIGN.search(text, b, high))))
        if last >= 0 and not out.words[here][0]:
            out.chain.append((last, here))
        last = here
        for key in _keys(token, label):
            j = seen.get(key)
            if j is not None and (not out.skip or out.skip[-1] != (j, here)):
                out.skip.append((j, here))
            seen[key] = here
        if train and label >= 0 and (form := _again(token, label)):
            out.skip.append((here, add(a, b, label, form, (True, True))))
            add(a, b, -1, _unlike(form, label), (True, True))
    return out


@dataclass
class Weights:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels: for two nodes with this label


def _matrix(graphs: list[Graph]) -> tuple[np.ndarray, ...]:
    """Features as 0/1 rows, labels, whether words stand before and after, and chain and skip pairs with nodes numbered through."""
    n = sum(len(g.labels) for g in graphs)
    x = np.zeros((n, N_FEATURES), np.float32)
    labels, words, chain, skip = np.zeros(n, np.int64), np.zeros((n, 2), bool), [], []
    at = 0
    for g in graphs:
        for i, f in enumerate(g.features):
            x[at + i, f] = 1
        labels[at : at + len(g.labels)] = g.labels
        words[at : at + len(g.labels)] = np.array(g.words, bool).reshape(-1, 2)
        chain += [(a + at, b + at) for a, b in g.chain]
        skip += [(a + at, b + at) for a, b in g.skip]
        at += len(g.labels)
    return x, labels, words, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def fit(graphs: list[Graph], rounds: int = 800, decay: float = 1e-3) -> Weights:
    """Pseudo-likelihood: each label given its token and the labels of the nodes and words that it shares a potential with."""
    x, labels, words, chain, skip = _matrix(graphs)
    w = Weights(np.zeros((N_FEATURES, N_LABELS), np.float32), np.zeros((N_LABELS, N_LABELS), np.float32), np.zeros(N_LABELS, np.float32))
    if not len(labels):
        w.unary[0, -1] = 9.0
        return w
    none = N_LABELS - 1
    # Open tokens that resemble an entity may be one: they neither count nor say anything.
    unknown = np.zeros(len(labels), bool)
    for a, b in ((skip[:, 0], skip[:, 1]), (skip[:, 1], skip[:, 0])):
        unknown[a[(labels[a] < 0) & (labels[b] >= 0)]] = True
    y = np.where(labels < 0, none, labels)
    one = np.eye(N_LABELS, dtype=np.float32)[y] * ~unknown[:, None]
    near = np.zeros((len(y), N_LABELS), np.float32)  # labels of skip neighbours
    np.add.at(near, skip[:, 0], one[skip[:, 1]])
    np.add.at(near, skip[:, 1], one[skip[:, 0]])
    left, right = np.zeros_like(near), np.zeros_like(near)
    np.add.at(right, chain[:, 0], one[chain[:, 1]])
    np.add.at(left, chain[:, 1], one[chain[:, 0]])
    left[:, none] += words[:, 0]
    right[:, none] += words[:, 1]
    size = 1.0 / len(y)
    # Tokens that look like an entity and yet fail its test are rare and tell the most.
    weight = np.where((labels < 0) & (x[:, 5:9].any(1) | x[:, 24:28].any(1)), 20.0, 1.0).astype(np.float32)[:, None] * size * ~unknown[:, None]
    possible = _possible(x)
    state = [np.zeros_like(v) for v in (w.unary, w.chain, w.skip)]
    for _ in range(rounds):
        score = x @ w.unary + left @ w.chain + right @ w.chain.T + near * w.skip + possible
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        d = (one - p) * weight
        for v, g, s in zip((w.unary, w.chain, w.skip), (x.T @ d, left.T @ d + d.T @ right, (d * near).sum(0)), state, strict=True):
            g -= decay * size * v
            s += g * g
            v += 0.5 * g / (np.sqrt(s) + 1e-8)
    return w


def _possible(x: np.ndarray) -> np.ndarray:
    """0 for the labels that a token can have, far below for the others."""
    out = np.zeros((len(x), N_LABELS), np.float32)
    for label, feature in ((1, _CAN_IP), (2, _CAN_CARD), (3, _CAN_PHONE)):
        out[x[:, feature] == 0, label] = -60.0
    return out


def marginals(graphs: list[Graph], w: Weights, rounds: int = 12) -> np.ndarray:
    """Loopy sum-product over all graphs at once, in logarithms; nodes with a label are held at it."""
    x, labels, words, chain, skip = _matrix(graphs)
    unary = x @ w.unary + words[:, :1] * w.chain[-1] + words[:, 1:] * w.chain[:, -1] + _possible(x)
    fixed = labels >= 0
    unary[fixed] = -60.0
    unary[fixed, labels[fixed]] = 0.0
    pairs = np.concatenate([chain, skip])
    if not len(pairs):
        own = unary - unary.max(1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(1, keepdims=True)
    agree = np.diag(w.skip)
    potential = np.concatenate([np.broadcast_to(w.chain, (len(chain), N_LABELS, N_LABELS)), np.broadcast_to(agree, (len(skip), N_LABELS, N_LABELS))])
    a = np.concatenate([pairs[:, 0], pairs[:, 1]])
    b = np.concatenate([pairs[:, 1], pairs[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    m = len(pairs)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, N_LABELS), np.float32)
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, b, message)
        rest = total[a] - message[back]
        new = np.logaddexp.reduce(rest[:, :, None] + potential, axis=1)
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    total = unary.copy()
    np.add.at(total, b, message)
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, sample: int = 2000, sample_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights from ``sample`` documents, the first by a hash of id and text, and ``sample_bytes`` of text at most; the base spans are the labels.

    Null ids and texts are left out; rows equal in both count once.
    """
    arrow_batches(docs.sparkSession)

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [graph(t, base_spans(t), True) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(g) for g in found if g and g.labels], pa.binary())], ["graph"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).where("id is not null and text <> ''")
    taken = docs.sparkSession.createDataFrame(shared.chosen(rows.select("id", "hash", F.octet_length("text").alias("size")), sample, sample_bytes), f"id {docs.schema[id_col].dataType.simpleString()}, hash long")
    found = rows.join(F.broadcast(taken), ["id", "hash"]).dropDuplicates(["id", "hash"]).select("text").mapInArrow(nodes, "graph binary")
    return fit([pickle.loads(x) for x in sorted(r[0] for r in found.collect())])


def find(docs: DataFrame, weights: Weights | None = None, least: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every text, one row for each row.

    id_col; n_email, n_ip, n_card, n_phone (base spans); base_sha256 (of
    kind:start:end by kind, then start, comma-joined; code points); spans (the
    same for base and added spans); n_added.  A null text is empty; null and
    repeated ids stay as they are, and equal texts have equal spans; of entities
    with equal marginals the first kind is taken; an empty table gives no rows; a
    very long text or token is looked at as a whole; other columns are not read,
    whatever their names.
    """
    arrow_batches(docs.sparkSession)
    w = weights or train(docs, id_col=id_col, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(w)  # some thousand numbers
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def joined(spans: list[list[tuple[int, int]]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=True) for a, b in sorted(own))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) if t else [[], [], [], []] for t in texts]
            graphs = {i: g for i, t in enumerate(texts) if t and (g := graph(t, base[i]))}
            every = [[list(x) for x in b] for b in base]
            added = [0] * len(texts)
            if graphs:
                p = marginals(list(graphs.values()), sent.value)
                at = 0
                for i, g in graphs.items():
                    for j, label in enumerate(g.labels):
                        best = int(p[at + j].argmax())
                        if label < 0 and best < len(KINDS) and p[at + j, best] >= least:
                            every[i][best].append(g.spans[j])
                            added[i] += 1
                    at += len(g.labels)
            base_text = [joined(b) for b in base]
            out = [batch.column(0), *(pa.array([len(b[k]) for b in base], pa.int64()) for k in range(len(KINDS)))]
            out.append(pa.array([sha256(b.encode()).hexdigest() for b in base_text]))
            out.append(pa.array([joined(e) if n else b for e, n, b in zip(every, added, base_text, strict=True)], pa.string()))
            out.append(pa.array(added, pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)

"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns decide alone about what they match. Besides, a semi-Markov CRF
looks for forms that they miss (masked addresses, numbers without a country code,
access tokens): features of whole candidate segments score each type, each type
has a score for following the type before it, and a dynamic program over segments
of bounded length, with the last type as its state, chooses boundaries and types of
a stretch together. The field is trained on sentences from a seeded generator.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, own_columns, table

#: Kinds in the order in which spans of one start are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Longest entity, in tokens and code points, and how far around an anchor the field looks.
MAX_TOKENS, MAX_CHARS, REACH = 24, 96, 96

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind, in order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _HOST.match(text, at + 1)):
            out.append((a, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    if re.search(r"[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Candidate segments and their features.

_TOKEN = re.compile(r"[^\W_]+|\s|[^\w\s]|_")
_TOKEN_REST = re.compile(r"[^\W_]*")
_ANCHOR = re.compile(r"[0-9@]+|[\[(](?i:at)[\])]")
_AT = r"(?:@|\s?[\[(](?i:at)[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(](?i:dot)[\])]\s?)"
_MAIL = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_MASKED_MAIL = re.compile(r"[\[(](?i:at)[\])]")
_QUAD = re.compile(rf"([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}})")
_NUMBER = re.compile(r"[+(]?[0-9](?:[0-9 .()/-]*[0-9])")
_SHAPE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_SINGLE = re.compile(r"(?:\b[0-9]\b\W+){3}")
_DATE = re.compile(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}")
_SECRET = re.compile(r"(?:[A-Za-z]{2,8}[_-]){0,3}(?=[a-zA-Z]*[0-9])(?=(?:[0-9]*[a-zA-Z]){4})[A-Za-z0-9]{16,}")
#: Beginnings of the access keys of well-known services: fixed values.
_KEY = re.compile(r"(?:sk|pk|rk|ghp|gho|ghs|glpat|xoxb|xoxp|key|api)[_-]|AKIA|ASIA|AIza")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_CUES = (
    re.compile(r"(?i)(?:mail|contact|address|write)\W{0,4}(?:\w{1,4}\W{1,3})?$"),
    re.compile(r"(?i)(?:\bip|host|server|address)\W{0,4}(?:\w{1,4}\W{1,3})?$"),
    re.compile(r"(?i)(?:card|visa|credit|account)\W{0,4}(?:\w{1,6}\W{1,3})?$"),
    re.compile(r"(?i)(?:phone|tel|call|mobile|fax)\W{0,4}(?:\w{1,4}\W{1,3})?$"),
    re.compile(r"(?i)(?:token|secret|key|password|passwd|api|bearer)\s?[=:]?\s?[\"']?$"),
    re.compile(r"(?i)(?:commit|revision|rev|hash|md5|sha-?[0-9]*|checksum|digest|etag|uuid|id)(?:sum)?\W{0,4}(?:\w{1,4}\W{1,3})?$"),
)
N_FEATURES = 30


def features(text: str, a: int, b: int) -> list[int] | None:
    """Numbers of the features of the segment ``text[a:b]``; None if it cannot be an entity."""
    s = text[a:b]
    mail, quad, number = _MAIL.fullmatch(s), _QUAD.fullmatch(s), _NUMBER.fullmatch(s)
    secret = _SECRET.fullmatch(s)
    digits = sum("0" <= c <= "9" for c in s)
    if not (mail or quad or secret or number and 7 <= digits <= 19):
        return None
    out = [0]
    if mail:
        out.append(2 if _MASKED_MAIL.search(s) else 1)
    if quad:
        out.append(3 if all(int(x) <= 255 for x in quad.groups()) else 4)
        if "." not in s or "[" in s or "(" in s:
            out.append(5)
    if number and not quad:
        out.append(6)
        if 12 <= digits <= 19:
            out.append(7 if luhn(_NO_DIGIT.sub("", s)) else 8)
        elif 9 <= digits <= 11:
            out.append(9)
        else:
            out.append(10)
        if s[0] in "+(":
            out.append(11)
        if _SHAPE.fullmatch(s):
            out.append(12)
        if s.isdigit():
            out.append(13)
        if _DATE.match(s):
            out.append(14)
        if _SINGLE.search(s):
            out.append(29)
    if secret:
        out.append(15 if _HEX.fullmatch(s) else 16)
        if b - a >= 32:
            out.append(17)
        if _KEY.match(s):
            out.append(25)
        if digits < 4:
            out.append(26)
        if not _HEX.fullmatch(s) and s != s.lower() and s != s.upper():
            out.append(27)
        if b - a in (32, 40, 64, 128) and _HEX.fullmatch(s):
            out.append(28)
    before = text[max(0, a - 24) : a]
    out += [18 + k for k, cue in enumerate(_CUES) if cue.search(before)]
    near = text[a - 1 : a] + text[b : b + 1]
    if re.search(r"[\w+@]", near) or text[a - 1 : a] in ("-", ".", "/") and a or re.match(r"[.@/-]\w", text[b : b + 2]):
        out.append(24)
    return out


def segments(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, int, int, list[int]]]]:
    """Token starts of ``text[a:b]`` (with its end), and candidates (first token, end token, start, end, features)."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    found = []
    odd = [text[x].isspace() for x, _ in tokens]
    plain = [text[x].isdigit() or text[x] in "@[(" for x, _ in tokens]
    sums = np.concatenate(([0], np.cumsum(plain))).tolist()
    for i, (x, _) in enumerate(tokens):
        if odd[i]:
            continue
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            y = tokens[j][1]
            if y - x > MAX_CHARS and j > i:  # a single token may be of any length
                break
            if odd[j] or y - x < 7 or (sums[j + 1] == sums[i] and y - x < 20):
                continue
            if (f := features(text, x, y)) is not None:
                found.append((i, j + 1, x, y, f))
    return [x for x, _ in tokens] + [b], found


# The field.


def _scores(w: np.ndarray, found: list) -> np.ndarray:
    """Score of each candidate as each kind; outside entities every token scores 0."""
    return np.array([w[f].sum(axis=0) for *_, f in found]).reshape(len(found), len(KINDS))


def _ranked(found: list) -> tuple[int, list]:
    """Candidates by the rank of their ends among all ends, and the highest rank: other tokens change no score."""
    rank = {x: k for k, x in enumerate(sorted({x for i, j, *_ in found for x in (i, j)}))}
    return len(rank) - 1, [(rank[i], rank[j], *rest) for i, j, *rest in found]


def _marginals(n: int, found: list, s: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log Z, the probability of each candidate as each kind, and how often each kind is expected to follow another.

    ``t`` scores a kind (column) after the last one before it (row; the last row: none yet).
    """
    kinds = len(KINDS)
    ends: dict[int, list[int]] = {}
    begins: dict[int, list[int]] = {}
    for k, (i, j, *_) in enumerate(found):
        ends.setdefault(j, []).append(k)
        begins.setdefault(i, []).append(k)
    fwd = np.full((n + 1, kinds + 1), -np.inf)
    fwd[0, kinds] = 0.0
    for j in range(1, n + 1):
        fwd[j] = fwd[j - 1]
        for k in ends.get(j, ()):
            fwd[j, :kinds] = np.logaddexp(fwd[j, :kinds], np.logaddexp.reduce(fwd[found[k][0]][:, None] + t, axis=0) + s[k])
    bwd = np.zeros((n + 1, kinds + 1))
    for i in range(n - 1, -1, -1):
        bwd[i] = bwd[i + 1]
        for k in begins.get(i, ()):
            bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(t + (s[k] + bwd[found[k][1], :kinds])[None, :], axis=1))
    z = float(np.logaddexp.reduce(fwd[n], axis=0))
    p, follow = np.zeros((len(found), kinds)), np.zeros_like(t)
    for k, (i, j, *_) in enumerate(found):
        each = np.exp(fwd[i][:, None] + t + (s[k] + bwd[j, :kinds])[None, :] - z)
        p[k] = each.sum(axis=0)
        follow += each
    return z, p, follow


def best(n: int, found: list, s: np.ndarray, t: np.ndarray) -> list[tuple[int, int]]:
    """(candidate, kind) of the best segmentation with its kinds."""
    kinds = len(KINDS)
    ends: dict[int, list[int]] = {}
    for k, (_, j, *_) in enumerate(found):
        ends.setdefault(j, []).append(k)
    value = np.full((n + 1, kinds + 1), -np.inf)
    value[0, kinds] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}  # place and last kind: candidate, kind before it
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for k in ends.get(j, ()):
            ways = value[found[k][0]][:, None] + t + s[k][None, :]
            before, v = ways.argmax(axis=0), ways.max(axis=0)
            for kind in np.flatnonzero(v > value[j, :kinds]).tolist():
                value[j, kind] = v[kind]
                back[j, kind] = k, int(before[kind])
    out, j, kind = [], n, int(value[n].argmax())
    while kind != kinds:
        while (j, kind) not in back:
            j -= 1
        k, before = back[j, kind]
        out.append((k, kind))
        j, kind = found[k][0], before
    return out[::-1]


def _observed(found: list, y: np.ndarray) -> np.ndarray:
    """How often each kind follows another among the true segments."""
    out, last = np.zeros((len(KINDS) + 1, len(KINDS))), len(KINDS)
    for k in sorted(np.flatnonzero(y.any(axis=1)).tolist(), key=lambda k: found[k][0]):
        out[last, kind := int(y[k].argmax())] += 1
        last = kind
    return out


def _invented(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and the (start, end, kind) of its entities."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n: int, good: bool) -> str:
        d = num(n - 1)
        last = next(c for c in "0123456789" if luhn(d + c))
        return d + (last if good else rng.choice([c for c in "0123456789" if c != last]))

    def made(kind: int) -> str:
        if kind == 0:
            name = word() + rng.choice(["", "." + word(), num(2)])
            at = rng.choice(["@", "@", " [at] ", "[at]", " (at) ", "(at)"])
            dot = "." if at == "@" else rng.choice([".", " [dot] ", "[dot]", " (dot) "])
            return name + at + word() + dot + rng.choice(["com", "org", "net", "de"])
        if kind == 1:
            return rng.choice([".", ".", "[.]", " [dot] "]).replace("[.]", "[dot]").join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            d = card(rng.choice([13, 15, 16, 16, 19]), True)
            return rng.choice([d, d, ".".join(d[i : i + 4] for i in range(0, len(d), 4))])
        if kind == 3:
            a, b, c = num(3), num(3), num(4)
            return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{num(1)} ({a}) {b}-{c}", f"+{num(2)} {a} {num(7)}"])
        mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
        return rng.choice([
            some("0123456789abcdef", rng.choice([24, 32, 40, 56, 64])), some(mixed, rng.choice([20, 24, 32, 40])) + "7", "AKIA" + some(mixed[:26], 11) + "2" + some(mixed[:26] + "0123456789", 4),
            rng.choice(["sk-", "sk-proj-", "ghp_", "glpat-", "api_"]) + some(mixed, rng.choice([20, 36, 48])) + "4",
        ])

    def noise() -> str:
        return rng.choice([num(4), f"{num(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{num(4)}", f"{num(2)}.{num(2)}", f"{num(1)},{num(3)}.{num(2)}", num(7), num(8), num(10), card(16, False), f"{num(1)}.{num(1)}.{num(2)}", f"{num(2)}/{num(2)}", f"{num(3)}-{num(4)}", "300.412.7.999", f"{num(5)} {num(5)}", f"{num(4)} {num(4)} {num(4)}", *2 * [rng.choice(["commit ", "md5 ", "sha1: ", "sha256 ", "checksum ", "revision ", "hash: ", "etag: "]) + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))], word() + word() + word() + num(1), " ".join(num(1) for _ in range(rng.randint(7, 11)))])

    cues = (["mail", "contact", "write"], ["ip", "host", "server"], ["card", "visa"], ["phone", "tel.", "call"], ["token =", "secret:", "key =", "Bearer"])
    text, gold, kind = "", [], None
    for _ in range(rng.randint(4, 10)):
        x = rng.random()
        if x < 0.3:
            # Lists repeat a kind, and contact data come together.
            kind = rng.choice([rng.randrange(len(KINDS)), kind if kind is not None else 0, {0: 3, 3: 0, 1: 4, 4: 1}.get(kind, 2)])
            if rng.random() < (0.9 if kind == 4 else 0.4):
                text += rng.choice(cues[kind]) + " "
            quote = '"' if kind == 4 and rng.random() < 0.5 else ""
            entity = made(kind)
            gold.append((len(text) + len(quote), len(text) + len(quote) + len(entity), kind))
            text += quote + entity + quote
        else:
            text += noise() if x < 0.5 else word()
        text += rng.choice([" ", " ", " ", ", ", ". ", "\n"])
    return text, gold


@lru_cache(1)
def train(sentences: int = 300, rounds: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x kinds) and scores of kinds in succession that maximise the conditional likelihood, with a small ridge."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _invented(rng)
        _, found = segments(text, 0, len(text))
        want = {(a, b): k for a, b, k in gold}
        y = np.zeros((len(found), len(KINDS)))
        for k, (_, _, a, b, _) in enumerate(found):
            if (a, b) in want:
                y[k, want[a, b]] = 1
        if found:
            x = np.zeros((len(found), N_FEATURES))
            for k, c in enumerate(found):
                x[k, c[4]] = 1
            n, found = _ranked(found)
            data.append((n, found, x, y, _observed(found, y)))
    w = np.zeros((N_FEATURES + len(KINDS) + 1, len(KINDS)))  # below the features: successions
    w[0] = -2
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(rounds):
        for at in range(0, len(data), 50):
            g = -0.01 * w
            for n, found, x, y, pairs in data[at : at + 50]:
                _, p, follow = _marginals(n, found, x @ w[:N_FEATURES], w[N_FEATURES:])
                g[:N_FEATURES] += x.T @ (y - p)
                g[N_FEATURES:] += pairs - follow
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:N_FEATURES], w[N_FEATURES:]


def windows(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches around anchors, without the base spans (in order); no candidate crosses their ends.

    They reach as far as a candidate with the anchor can, and on to the next white
    space if that is near.
    """
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            a = out[-1][0]
            out.pop()
        else:
            low = max(0, a - REACH)
            while a > low and not text[a - 1].isspace():
                a -= 1
        high = min(len(text), b + REACH)
        while b < high and not text[b].isspace():
            b += 1
        # No long token is cut in two.
        b = _TOKEN_REST.match(text, b).end()
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum() and (not out or a > out[-1][1]):
            a -= 1
        if out and a <= out[-1][1]:
            a = out[-1][0]
            out.pop()
        out.append([a, b])
    free, k = [], 0
    for a, b in out:
        while k < len(base) and base[k][2] <= a:
            k += 1
        i = k
        while i < len(base) and base[i][0] < b:
            if base[i][0] > a:
                free.append((a, base[i][0]))
            a = max(a, base[i][2])
            i += 1
        if a < b:
            free.append((a, b))
    return free


def added_spans(text: str, base: list[tuple[int, int, int]], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the field finds outside the base spans."""
    out, (w, t) = set(), model
    for a, b in windows(text, base):
        _, found = segments(text, a, b)
        if found:
            n, found = _ranked(found)
            out |= {(found[k][2], kind, found[k][3]) for k, kind in best(n, found, _scores(w, found), t)}
    return sorted(out)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans`` of every whole text.

    The counts and the digest are those of the base patterns; ``spans`` has all
    spans as ``kind:start:end`` in code points, ``n_spans`` of them. Null and empty texts have none,
    repeated rows the same; null ids stay; an empty table gives none.
    """
    source = own_columns(docs, id_col, text_col)
    weights = train()

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, more = [], [], [], []
        for x in batch.column(1).to_pylist():
            base = base_spans(x or "")
            added = added_spans(x, base, weights) if x else []
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(sorted(base + added)))
            more.append(len(added))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        total = pa.array([n + sum(c) for n, c in zip(more, counts)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64()), total], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    kind = source.schema[id_col].dataType.simpleString()
    return arrow_map(source, f, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint", 512)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, k, b in sorted(base + added_spans(text, base, train())):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))

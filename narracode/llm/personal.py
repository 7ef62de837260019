"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans. The random field adds spans that the patterns cannot see:
numbers and addresses that are written with other separators. It tags tokens by the shapes of the
token and its neighbours, is trained on a small labelled table that is made from a list of written
forms, and is decoded by Viterbi over padded batches. Only tokens near a digit or an at sign are
tagged, as every span holds one. An added span must pass the same checks as a base span (number
of digits, range of parts, check digit) and touch no other span, so ordinary numbers stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
MASKS = {k: f"[{k.upper()}]" for k in KINDS}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
# a match can only begin where a run of digits begins: later starts meet the same rest
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind number, end


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _good_ip(text: str) -> bool:
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def _good_card(text: str) -> bool:
    digits = _NO_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _good_phone(text: str) -> bool:
    return 9 <= len(_NO_DIGIT.sub("", text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part reaches back from the at sign, but not into the address before."""
    free, at = 0, text.find("@")
    while at >= 0:
        # step back in growing pieces, so a long run before the sign is read once
        size, start = 64, at
        while True:
            low = max(free, at - size)
            m = _LOCAL_BACK.match(text[low:at][::-1])
            start = at - (m.end() if m else 0)
            if start > low or low == free:
                break
            size *= 8
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost and without overlap within a kind. A match that
    fails its check is dropped and not tried again."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    first = _DIGIT.search(text)
    if first:
        at = first.start()
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text, at) if _good_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text, at) if _good_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _good_phone(m[0])]
    return sorted(out)


# ---------------------------------------------------------------- the random field

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_TRIGGER = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
#: Characters around a digit or an at sign that are tagged.
AROUND = 48
#: Tokens of a long sequence whose features are worked out at once.
PART = 2_000
TAGS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind
FEATURES = 1 << 12


def _shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 7)}"
    if token[0].isalpha():
        low = token.lower()
        if low in ("at", "dot", "com", "org", "net", "tel", "phone", "call", "mail", "email", "ip", "card"):
            return low
        return ("A" if token[0].isupper() else "a") + str(min(len(token), 4))
    return token


def token_features(tokens: list[tuple[int, int, str]]) -> np.ndarray:
    """Hashed features of each token: shapes of five neighbouring tokens, pairs of them, and
    whether white space stands before and after."""
    shapes = ["^", "^", *[_shape(t) for _, _, t in tokens], "$", "$"]
    glued = [i > 0 and tokens[i - 1][1] == tokens[i][0] for i in range(len(tokens))] + [False]
    rows = []
    for i in range(len(tokens)):
        a, b, c, d, e = shapes[i : i + 5]
        g, h = glued[i], glued[i + 1]
        named = [c, f"{b}<", f"{a}<<", f"{d}>", f"{e}>>", f"{b}{c}", f"{c}{d}", f"{b}{c}{d}", f"{a}{b}{c}", f"{c}{d}{e}", f"{c}{g}{h}", f"{b}{g}{c}{h}{d}"]
        rows.append([int.from_bytes(hashlib.md5(f"{k}|{n}".encode()).digest()[:4], "little") % FEATURES for k, n in enumerate(named)])
    return np.array(rows, np.int32).reshape(len(tokens), -1)


def labelled_table(rows: int = 360, seed: int = 11) -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences as pieces of text with a kind number, -1 for none.
    Numbers are drawn; the forms around them are listed."""
    rng = np.random.default_rng(seed)

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(rng.choice(list("aeiounrstlmdk"), rng.integers(2, 9)))

    def part() -> str:
        return str(rng.integers(0, 256))

    def email() -> str:
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}.{number(2)}"])
        at, dot = [("@", "."), (" @ ", "."), (" @ ", " . "), ("@", " . ")][rng.integers(0, 4)]
        return f"{name}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def ip() -> str:
        return ["{}.{}.{}.{}", "{}[.]{}[.]{}[.]{}", "{} . {} . {} . {}", "{}(.){}(.){}(.){}"][rng.integers(0, 4)].format(*[part() for _ in range(4)])

    def card() -> str:
        body = number(15)
        digits = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = ["", " ", "-", ".", "/", " - "][rng.integers(0, 6)]
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"+{number(2)} {a} {b}{c}", f"+{number(2)} / {a} / {b} {c}", f"({a}) {b}.{c}"][rng.integers(0, 6)]

    def plain() -> str:
        n = number
        forms = [
            f"{n(1)}.{n(1)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/{n(4)}", n(4), n(2), f"{n(2)}:{n(2)}", f"{n(1)},{n(3)}", n(9), n(12), n(16),
            f"{n(3)}-{n(4)}", f"({n(1)})", f"({n(4)})", f"{n(2)}-{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"${n(3)}.{n(2)}", f"{n(2)}%", f"{word()}{n(3)}", f"@{word()}",
            f"{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(4)} {n(4)}", f"{word()}={n(3)}{word()}{n(5)}", f"{n(3)} {n(3)} {n(4)}", f"{n(1)}.{n(1)}.{n(4)}",
        ]
        return forms[rng.integers(0, len(forms))]

    table = []
    makers = [email, ip, card, phone]
    for _ in range(rows):
        pieces: list[tuple[str, int]] = []
        for _ in range(rng.integers(1, 4)):
            pieces.append((" ".join(word() for _ in range(rng.integers(1, 5))) + " ", -1))
            k = int(rng.integers(0, 8))
            pieces.append((makers[k](), k) if k < len(makers) else (plain(), -1))
            pieces.append((str(rng.choice([" ", ". ", ", "])), -1))
        table.append(pieces)
    return table


def _tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _tagged(pieces: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    text, kinds = "", []
    for piece, kind in pieces:
        kinds.append((len(text), len(text) + len(piece), kind))
        text += piece
    tokens = _tokens(text)
    tags = np.zeros(len(tokens), np.int64)
    for a, b, kind in kinds:
        if kind >= 0:
            inside = [i for i, t in enumerate(tokens) if a <= t[0] and t[1] <= b]
            tags[inside] = 2 + 2 * kind
            tags[inside[:1]] = 1 + 2 * kind
    return token_features(tokens), tags


@dataclass
class RandomField:
    """Weights of features per tag, and of neighbouring tags."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each sequence, by Viterbi over batches of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        held: list[int] = []
        for i in order:
            if held and (len(held) + 1) * len(sequences[i]) > 50_000:
                self._decode(sequences, held, out)
                held = []
            held.append(i)
        self._decode(sequences, held, out)
        return out

    def _decode(self, sequences, held, out) -> None:
        held = [i for i in held if len(sequences[i])]
        if not held:
            return
        x, real = _padded([sequences[i] for i in held])
        # a bounded part of a long sequence at a time
        emit = np.concatenate([self.weights[x[:, j : j + PART]].sum(axis=2) for j in range(0, x.shape[1], PART)], axis=1)
        n, length, tags = emit.shape
        best = np.zeros((n, length, tags), np.int8)
        v = emit[:, 0] + self.steps[0]
        for t in range(1, length):
            all_ = v[:, :, None] + self.steps[None]
            best[:, t] = all_.argmax(axis=1)
            # past its end a sequence keeps its state
            v = np.where(real[:, t, None], all_.max(axis=1) + emit[:, t], v)
        tag = v.argmax(axis=1)
        path = np.zeros((n, length), np.int64)
        for t in range(length - 1, -1, -1):
            path[:, t] = tag
            tag = np.where(real[:, t], best[np.arange(n), t, tag], tag)
        for row, i in enumerate(held):
            out[i] = path[row, : len(sequences[i])]


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, sequences))
    x = np.zeros((len(sequences), length, sequences[0].shape[1]), np.int32)
    real = np.zeros((len(sequences), length), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)] = s
        real[i, : len(s)] = True
    return x, real


def train_field(table: list[list[tuple[str, int]]], rounds: int = 60, rate: float = 0.5) -> RandomField:
    """Maximum likelihood with a small penalty, by forward and backward sums over all rows."""
    pairs = [_tagged(p) for p in table]
    x, real = _padded([f for f, _ in pairs])
    n, length, _ = x.shape
    y = np.zeros((n, length), np.int64)
    for i, (_, tags) in enumerate(pairs):
        y[i, : len(tags)] = tags
    allowed = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        allowed[:, inside] = -30.0
        allowed[[inside - 1, inside], inside] = 0.0
    w, s = np.zeros((FEATURES, TAGS)), np.zeros((TAGS, TAGS))
    gw2, gs2 = np.full_like(w, 1e-6), np.full_like(s, 1e-6)
    hot = np.eye(TAGS)
    last = real.sum(axis=1) - 1
    for _ in range(rounds):
        emit = w[x].sum(axis=2)
        step = s + allowed
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + step[0]
        for t in range(1, length):
            z = alpha[:, t - 1, :, None] + step[None]
            top = z.max(axis=1)
            alpha[:, t] = top + np.log(np.exp(z - top[:, None]).sum(axis=1)) + emit[:, t]
        for t in range(length - 2, -1, -1):
            z = step[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = z.max(axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], top + np.log(np.exp(z - top[:, :, None]).sum(axis=2)), 0.0)
        end = alpha[np.arange(n), last]
        top = end.max(axis=1)
        total = top + np.log(np.exp(end - top[:, None]).sum(axis=1))
        p = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        g = (hot[y] - p) * real[:, :, None]
        gw = np.zeros_like(w)
        for f in range(x.shape[2]):
            np.add.at(gw, x[:, :, f].ravel(), g.reshape(-1, TAGS))
        gs = hot[y[:, 0]].sum(axis=0)[None] * np.r_[1.0, np.zeros(TAGS - 1)][:, None]
        gs = gs - p[:, 0].sum(axis=0)[None] * np.r_[1.0, np.zeros(TAGS - 1)][:, None]
        for t in range(1, length):
            both = alpha[:, t - 1, :, None] + step[None] + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
            r = real[:, t].astype(float)
            gs -= (np.exp(both) * r[:, None, None]).sum(axis=0)
            np.add.at(gs, (y[real[:, t], t - 1], y[real[:, t], t]), 1.0)
        gw, gs = gw - 0.02 * w, gs - 0.02 * s
        gw2, gs2 = gw2 + gw**2, gs2 + gs**2
        w += rate * gw / np.sqrt(gw2)
        s += rate * gs / np.sqrt(gs2)
    return RandomField(w, s + allowed)


def _windows(text: str) -> list[tuple[int, int]]:
    """Ranges around digits and at signs, as far as white space."""
    near: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if near and a <= near[-1][1]:
            near[-1] = (near[-1][0], b)
        else:
            near.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in near:
        low = out[-1][1] if out else 0
        if b <= low:
            continue
        while a > low and not text[a - 1].isspace():
            a -= 1
        space = _SPACE.search(text, b)
        b = space.start() if space else len(text)
        if out and a <= low:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _long_features(tokens: list[tuple[int, int, str]]) -> np.ndarray:
    """``token_features`` of any number of tokens, worked out in parts that see two neighbours
    on each side, as the features do."""
    parts = []
    for j in range(0, len(tokens), PART):
        low = max(0, j - 2)
        parts.append(token_features(tokens[low : j + PART + 2])[j - low : j - low + PART])
    return np.concatenate(parts) if parts else token_features(tokens)


_CHECKS = {
    0: lambda s: re.fullmatch(r"[A-Za-z0-9._%+ -]+@[A-Za-z0-9 -]+(?:[ ]?\.[ ]?[A-Za-z0-9-]+)+", s) is not None and "  " not in s,
    1: _good_ip,
    2: _good_card,
    3: _good_phone,
}


def all_spans(texts: list[str], field: RandomField) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    places, features, tokens = [], [], []
    for i, t in enumerate(texts):
        for a, b in _windows(t):
            found = _tokens(t, a, b)
            places.append(i)
            tokens.append(found)
            features.append(_long_features(found))
    added: dict[int, list[Span]] = {}
    # base spans by start, and the greatest end so far; windows follow each other, and so do added spans
    starts = [[s for s, _, _ in sorted(b)] for b in base]
    ends = [list(accumulate((e for _, _, e in sorted(b)), max)) for b in base]
    for i, found, tags in zip(places, tokens, field.decode(features), strict=True):
        at = 0
        while at < len(tags):
            end = at + 1
            if tags[at] and tags[at] % 2:
                kind = int(tags[at] - 1) // 2
                while end < len(tags) and tags[end] == 2 + 2 * kind:
                    end += 1
                a, b = found[at][0], found[end - 1][1]
                before = bisect_left(starts[i], b)
                mine = added.get(i)
                free = (not before or ends[i][before - 1] <= a) and (not mine or mine[-1][2] <= a)
                if free and _CHECKS[kind](texts[i][a:b]):
                    added.setdefault(i, []).append((a, kind, b))
            at = end
    return [(b, sorted(b + added.get(i, []))) for i, b in enumerate(base)]


def named(spans: list[Span]) -> str:
    """``kind:start:end`` of each span, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with a mark in place of each span; overlapping spans share the first's mark."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], MASKS[KINDS[k]]]
        at = max(at, b)
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- tables


def find_personal(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    The counts and the hash are of the base spans, ``spans`` lists all. Places are code points,
    the end exclusive. A missing or empty text has no spans. Repeated rows are answered each.
    """
    field = docs.sparkSession.sparkContext.broadcast(train_field(labelled_table()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], field.value)
            counts = [[sum(s[1] == k for s in b) for b, _ in found] for k in range(len(KINDS))]
            sha = [hashlib.sha256(named(b).encode()).hexdigest() for b, _ in found]
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string())]
            names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([named(s) for _, s in found], pa.string())], names=names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(find, schema)


def mask_personal(docs: DataFrame) -> DataFrame:
    """``docs`` with a mark such as ``[EMAIL]`` in place of every span. ``n_chars``, if there,
    follows a changed text; everything else stays."""
    field = docs.sparkSession.sparkContext.broadcast(train_field(labelled_table()))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def hide(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], field.value)
            new = [mask(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                old = columns[size].to_pylist()
                kept = [len(n) if s else o for n, o, (_, s) in zip(new, old, found, strict=True)]
                columns[size] = pa.array(kept, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(hide, docs.schema)

"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans to them.

The field tags tokens as the beginning of a secret, inside one, or outside, from their shape, the neighbouring
words and features of the whole file, and is decoded by Viterbi. It is trained here, by gradients of the exact
log-likelihood, on SEQUENCES lines that a seeded generator makes: credentials in many notations against phone and
card numbers, addresses, versions, hashes of commits, dates and plain words. Training takes seconds and no corpus.

Every token of every text is scored. One whose score for `outside` beats the others by more than any neighbours' tags
can make up for is outside in the best sequence (Field.margins); Viterbi runs over what lies between such tokens, which
gives the best sequence of the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

# The kinds in their order, each with its pattern, the group that is measured, and its least length.
KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
ORDER = {kind: i for i, (kind, *_) in enumerate(KINDS)} | {"field": len(KINDS)}
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TELLING = ("key", "secret", "token", "password", "passwd", "pwd", "passphrase", "credential", "credentials", "bearer", "authorization", "auth", "private", "apikey", "api_key", "access_key", "client_secret")
ODD = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{8,}|(?<![A-Za-z])(?:" + "|".join(sorted(TELLING, key=len, reverse=True)) + r")(?![A-Za-z])", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-]")
SHAPES = [(kind, re.compile(signs).search) for kind, signs in (("a", "[a-z]"), ("A", "[A-Z]"), ("9", "[0-9]"), ("s", "[+/=]"), ("-", "[_-]"))]
HEX_ONLY = re.compile("[0-9a-f]+")
#: Every telling word holds one of these.
TOLD = re.compile("key|secret|token|passw|pwd|passphrase|credential|bearer|auth|private")
SEQUENCES, EPOCHS, RATE = 1600, 60, 0.15
B, I, O = 0, 1, 2  # noqa: E741
#: Distances of the neighbours that count, how many tokens' sums are remembered, and how many tokens are scored at a time.
NEAR, REMEMBERED, BLOCK = (-3, -2, -1, 1), 1 << 18, 1 << 14


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the patterns, leftmost and non-overlapping within a kind, that are long enough; in code points."""
    found = []
    low = text.lower()
    if any(s in low for s in STEMS):
        kind, pattern, group, least = KINDS[0]
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        kind, pattern, group, least = KINDS[1]
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    found += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]  # runs are maximal, so short ones needn't be tried
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


def shape(token: str) -> str:
    return "".join(kind for kind, has in SHAPES if has(token)) or token[0]


def disorder(token: str) -> int:
    """Entropy of the characters, in half bits."""
    return entropy(tuple(sorted(map(token.count, set(token)))))


@functools.lru_cache(maxsize=1 << 14)
def entropy(counts: tuple[int, ...]) -> int:
    n = sum(counts)
    return round(-2 * sum(c / n * math.log2(c / n) for c in counts))


def sized(n: int) -> int:
    return n if n < 8 else 8 + min(6, int(2 * math.log2(n / 8)))


def alike(token: str) -> tuple:
    """Equal only for tokens with equal word_features() and as many matches of ODD; of plain words without working these out."""
    if token.isascii() and token.isalpha() and not TOLD.search(low := token.lower()):
        kind = 0 if low == token else 1 if token.isupper() else 2
        return kind, sized(len(token)), disorder(token[:256]), bool(HEX_ONLY.fullmatch(token))
    return len(ODD.findall(token)), *word_features(token)


def word_features(token: str) -> list[str]:
    low = token.lower()
    told = [f"w={low}"] if low in TELLING or not token[0].isalnum() else []
    told += [f"part={t}" for t in TELLING if t in low and t != low and len(token) < 40]
    n = len(token)
    size = sized(n)
    share = round(4 * sum(c.isdigit() for c in token) / n)
    return [*told, f"s={shape(token)}", f"n={size}", f"d={share}", f"s+n={shape(token)}/{size}", f"e={disorder(token[:256])}/{size}", f"hex={bool(HEX_ONLY.fullmatch(token))}/{size}", f"num={token.isdigit()}/{size}"]


def file_features(text: str, odd: int) -> list[str]:
    return [f"f=odd{min(3, odd)}", f"f=code{'{' in text or ';' in text}", f"f=long{len(text) > 4000}"]


def brief(own: list[str]) -> list[str]:
    """What a token tells its neighbours."""
    return own[:1] if own[0][0] in "wp" else own[:2]


def telling(own: list[str]) -> bool:
    return own[0][0] in "wp" and own[0][2:] not in "=:\"'"


def features(tokens: list[str], file: list[str]) -> list[list[str]]:
    own = [word_features(t) for t in tokens]
    out = []
    for k, mine in enumerate(own):
        near = [f"{d}:{x}" for d in NEAR for x in (brief(own[k + d]) if 0 <= k + d < len(tokens) else ["edge"])]
        told = "t" if any(telling(o) for o in own[max(0, k - 4) : k]) else "n"
        out.append([*mine, *near, *file, f"before={told}", f"before={told}/{mine[-3]}", f"{told}/{shape(tokens[k])}"])
    return out


def made_sequence(rng: random.Random) -> tuple[list[str], list[int]]:
    """A line with its tags."""
    pick = rng.choice
    letters, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    run = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    word = lambda: run(letters, rng.randint(1, 11)).capitalize() if rng.random() < 0.15 else run(letters, rng.randint(1, 11))
    mix = letters + letters.upper() + digits
    secret = lambda: pick([lambda: run(hexes, pick([12, 16, 18, 20, 32, 40, 64])), lambda: run(mix, rng.randint(14, 44)), lambda: run(mix + "+/", rng.randint(20, 60)) + pick(["", "=", "=="]), lambda: pick(["gh", "sk", "pk", "xox", "glp"]) + pick("_-") + run(mix, rng.randint(20, 40))])()
    plain = [(word(), O) for _ in range(rng.randint(2, 6))]
    after = [(word() + pick(["", ".", ","]), O) for _ in range(rng.randint(1, 5))]
    kind = rng.random()
    if kind < 0.42:
        key = pick(["password", "passwd", "secret", "token", "api_key", "apikey", "client_secret", "access_key", "pwd", "auth", "private key", "credential", "db_password", "AUTH_TOKEN"])
        key = pick([key, key.upper(), key.capitalize()])
        quote = pick(["", '"', "'"])
        own = [(key + pick([" = ", "=", ": ", " := ", "=", " is "]) + quote, O), (secret(), B), (quote, O)]
    elif kind < 0.5:
        own = [(pick(["Authorization: Bearer ", "bearer ", "Bearer token "]), O), (run(mix + "_-", rng.randint(24, 60)), B)]
    elif kind < 0.56:
        own = [(pick(["", "key ", "id = "]), O), ("AKIA" + run(letters.upper() + digits, 16), B)]
    elif kind < 0.6:
        own = [(pick(["", "use ", "with "]), O), (pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + run(mix, rng.randint(24, 40)), B)]
    else:
        number = lambda n: run(digits, n)
        own = [
            pick(
                [
                    lambda: (f"+1 ({number(3)}) {number(3)}-{number(4)}", O),
                    lambda: (number(rng.choice([8, 10, 12, 13, 16, 16, 16, 19])), O),
                    lambda: (".".join(str(rng.randint(0, 255)) for _ in range(4)), O),
                    lambda: (f"{word()}.{number(2)}@mail{number(1)}.example.com", O),
                    lambda: (f"{number(4)}-{number(2)}-{number(2)}", O),
                    lambda: ("commit " + run(hexes, pick([7, 12, 40])), O),
                    lambda: (f"http://www.{word()}.example/{word()}/{number(5)}?page={number(2)}", O),
                    lambda: ("-".join(run(hexes, n) for n in (8, 4, 4, 4, 12)), O),
                    lambda: (pick(["the token ", "a secret ", "the password ", "key "]) + word() + " " + word(), O),
                    lambda: (run(letters, rng.randint(14, 30)), O),
                    lambda: (f"{word()}{number(rng.randint(4, 8))}", O),
                    lambda: (f"v{number(1)}.{number(2)}.{number(1)} ISBN 978-{number(10)}", O),
                    lambda: (f"order-{number(10)} sku_{number(8)}", O),
                ]
            )()
        ]
    noise = pick(["", "", "", "### ", "*** ", "$$$ ", "!! "])
    tokens, tags = [], []
    for part, tag in [*plain, *own, (noise, O), *after]:
        for m in TOKEN.findall(part):
            tags.append((I if tag == B and tags and tags[-1] in (B, I) and len(tokens) and part.startswith(m) is False else tag) if tag == B else O)
            tokens.append(m)
    return tokens, tags


class Places(dict):
    """The row of a field's table for each token; tokens of up to 64 characters are remembered."""

    def __init__(self, field: Field):
        self.field, self.rows = field, 0

    def __missing__(self, token: str) -> int:
        key = alike(token)
        row = self.get(key)
        if row is None:
            row = self[key] = self.rows
            self.rows += 1
            self.field.row(token, row)
        if len(token) <= 64:
            self[token] = row
        return row


class Field:
    """Weights of features by tag, of transitions, and of first tags."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.names, self.weights, self.moves, self.first = names, weights, moves, first
        self.rows = {f: weights[k].tolist() for f, k in names.items()}
        self.known: dict[str | tuple, tuple[tuple[float, ...], ...]] = {}
        # a row for tokens that are alike: what parts() has, against `outside`, and how many odd ones stand in them
        self.places = Places(self)
        self.table = np.zeros((1 << 10, 2 * (len(NEAR) + 3) + 2))
        # how much more than `outside` the moves from a tag before, and to one behind, may give another tag
        ahead = np.maximum((moves - moves[:, O:]).max(axis=0), first - first[O])
        self.most = (ahead + np.maximum((moves - moves[O]).max(axis=1), 0))[:O]

    def summed(self, names: list[str]) -> tuple[float, ...]:
        found = [self.rows[f] for f in names if f in self.rows]
        return (sum(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found))

    def parts(self, token: str) -> tuple[tuple[float, ...], ...]:
        """What a token adds to the scores: of its own, to those of the tokens at each distance in NEAR, without and with
        a telling word before it; and whether it is one. Those of short tokens are remembered."""
        if token in self.known:
            return self.known[token]
        key = alike(token)  # all that tokens with these features add is equal
        if key in self.known:
            return self.known[key]
        own = word_features(token)
        told = tuple(self.summed([f"before={t}", f"before={t}/{own[-3]}", f"{t}/{shape(token)}"]) for t in "nt")
        found = (self.summed(own), *(self.summed([f"{d}:{x}" for x in brief(own)]) for d in NEAR), *told, (float(telling(own)),))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[key] = found
        if len(token) <= 64:
            self.known[token] = found
        return found

    def scores(self, tokens: list[str], file: list[str]) -> np.ndarray:
        """The sum of the weights of features() by token and tag: as features are of one token each, their sums are added."""
        place = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        found = [self.parts(t) for t in place]
        at, n = np.fromiter((place[t] for t in tokens), np.int64, len(tokens)), len(tokens)
        out = np.array([f[0] for f in found])[at] + np.array(self.summed(file))
        for k, d in enumerate(NEAR):
            near = np.tile(np.array(self.summed([f"{d}:edge"])), (n, 1))
            values = np.array([f[1 + k] for f in found])
            near[max(0, -d) : n - max(0, d)] = values[at[max(0, d) : max(0, n - max(0, -d))]]
            out += near
        seen = np.concatenate(([0], np.cumsum(np.array([f[-1][0] for f in found])[at])))
        before = (seen[:-1] - seen[np.maximum(np.arange(n) - 4, 0)] > 0)[:, None]
        return out + np.where(before, np.array([f[-2] for f in found])[at], np.array([f[-3] for f in found])[at])

    def placed(self, tokens: list[str]) -> np.ndarray:
        """The row of the table that each token has; those of an earlier call no longer hold."""
        if len(self.places) >= REMEMBERED:
            self.places = Places(self)
        return np.fromiter(map(self.places.__getitem__, tokens), np.int32, len(tokens))

    def row(self, token: str, row: int) -> None:
        if row == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        *sums, (told,) = self.parts(token)
        self.table[row] = [s[x] - s[O] for s in sums for x in (B, I)] + [told, len(ODD.findall(token))]

    def odd(self, at: np.ndarray) -> int:
        """How many matches of ODD a text has, given the rows of its tokens: each lies in one token, wherever that stands."""
        return int(self.table[:, -1][at].sum())

    def margins(self, at: np.ndarray, file: list[str]) -> np.ndarray:
        """By token what scores() has for the beginning and the inside of a secret, less that for outside."""
        n, wide = len(at), max(map(abs, NEAR)) + 1
        if n > BLOCK + 2 * wide:  # with what the first and last tokens of a block see around it; edges only count at the ends of all
            blocks = [(a, max(0, a - wide), min(n, a + BLOCK + wide)) for a in range(0, n, BLOCK)]
            return np.concatenate([self.margins(at[low:high], file)[a - low : a - low + BLOCK] for a, low, high in blocks])
        rows = self.table[at]
        less = lambda s: np.array(s[:O]) - s[O]
        out = rows[:, :2] + less(self.summed(file))
        for k, d in enumerate(NEAR):
            values, edge = rows[:, 2 + 2 * k : 4 + 2 * k], less(self.summed([f"{d}:edge"]))
            if d < 0:
                out[-d:] += values[:d]
                out[:-d] += edge
            else:
                out[:-d] += values[d:]
                out[max(0, n - d) :] += edge
        seen = np.concatenate(([0], np.cumsum(rows[:, -2])))
        before = (seen[:-1] - seen[np.maximum(np.arange(n) - 4, 0)] > 0)[:, None]
        return out + np.where(before, rows[:, -4:-2], rows[:, -6:-4])

    def inside(self, at: np.ndarray, file: list[str]) -> dict[int, int]:
        """The tokens, given their rows, that tags() has as anything but outside, and these tags.

        Where `outside` leads by more than `most`, it is better whatever tags stand around, so it is the tag in the best
        sequence; the runs between such tokens are decoded each with `outside` around it.
        """
        margin = self.margins(at, file)
        open_ = (margin > -self.most - 1e-6).any(axis=1)
        left, out = np.flatnonzero(open_), {}
        if not len(left):
            return out
        for run in np.split(left, np.flatnonzero(np.diff(left) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            rows = np.zeros((b - a, 3))
            rows[:, :O] = margin[a:b]
            path = self.best(rows, self.moves[O] if a else self.first, self.moves[:, O] if b < len(at) else np.zeros(3))
            out |= {a + k: tag for k, tag in enumerate(path) if tag != O}
        return out

    def tags(self, tokens: list[str], file: list[str]) -> list[int]:
        """The best sequence of all tokens, by Viterbi."""
        return self.best(self.scores(tokens, file), self.first, np.zeros(3))

    def best(self, scores: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> list[int]:
        """The best sequence by Viterbi; of equal ones that with the lowest tags at the end."""
        rows = scores.tolist()
        (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = self.moves.tolist()
        x, y, z = (v + f for v, f in zip(rows[0], enter.tolist(), strict=True))
        back = []
        for p, q, r in rows[1:]:
            a, b, c = x + m00, y + m10, z + m20
            d, e, f = x + m01, y + m11, z + m21
            g, h, i = x + m02, y + m12, z + m22
            u = (0 if a >= c else 2) if a >= b else 1 if b >= c else 2
            v = (0 if d >= f else 2) if d >= e else 1 if e >= f else 2
            w = (0 if g >= i else 2) if g >= h else 1 if h >= i else 2
            x, y, z = (a, b, c)[u] + p, (d, e, f)[v] + q, (g, h, i)[w] + r
            back.append((u, v, w))
        best = [v + f for v, f in zip((x, y, z), leave.tolist(), strict=True)]
        path = [best.index(max(best))]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]


@functools.lru_cache(maxsize=2)
def trained(sequences: int = SEQUENCES, seed: int = 11) -> Field:
    """Adam on the log-likelihood, forward and backward passes over all sequences at once."""
    rng = random.Random(seed)
    lines = [made_sequence(rng) for _ in range(sequences)]
    told = [features(t, file_features(" ".join(t), min(3, len(ODD.findall(" ".join(t)))))) for t, _ in lines]
    count: dict[str, int] = {}
    for f in (f for line in told for fs in line for f in set(fs)):
        count[f] = count.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 3))}
    n, longest, none = len(lines), max(len(t) for t, _ in lines), len(names)
    wide = max(len(fs) for line in told for fs in line)
    ids = np.full((n, longest, wide), none)
    y, real = np.full((n, longest), O), np.zeros((n, longest), bool)
    for k, (line, (_, tags)) in enumerate(zip(told, lines, strict=True)):
        real[k, : len(tags)], y[k, : len(tags)] = True, tags
        for t, fs in enumerate(line):
            own = [names[f] for f in fs if f in names]
            ids[k, t, : len(own)] = own
    w, moves, first = np.zeros((none + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    params = [w, moves, first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen = np.eye(3)[y] * real[..., None]
    pairs = real[:, 1:]
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for step in range(1, EPOCHS + 1):
        score = w[ids].sum(axis=2)
        a, b = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        a[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            go = lse(a[:, t - 1, :, None] + moves, 1) + score[:, t]
            a[:, t] = np.where(real[:, t, None], go, a[:, t - 1])
        z = lse(a[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            go = lse(moves[None] + (score[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(real[:, t + 1, None], go, b[:, t + 1])
        node = np.exp(a + b - z[:, None, None]) * real[..., None]
        edge = np.exp(a[:, :-1, :, None] + moves + (score[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
        gap = node - seen
        grad = [np.stack([np.bincount(ids.ravel(), np.repeat(gap[..., k].ravel(), wide), none + 1) for k in range(3)], axis=1) / n + 1e-3 * w / n, (edge.sum(axis=(0, 1)) - np.einsum("ntj,ntk->jk", seen[:, :-1] * pairs[..., None], seen[:, 1:])) / n, gap[:, 0].sum(axis=0) / n]
        for k, (p, g) in enumerate(zip(params, grad, strict=True)):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        w[none] = 0
    return Field(names, w[:none], moves, first)


def runs(tags: dict[int, int]) -> list[tuple[int, int]]:
    """(first, last) token of each span; an inside without a beginning begins as well."""
    out: list[tuple[int, int]] = []
    for k in sorted(tags):
        if tags[k] == B or not out or out[-1][1] != k - 1:
            out.append((k, k))
        else:
            out[-1] = (out[-1][0], k)
    return out


def decoded(text: str, parts: list[tuple[int, int]], field: Field, file: list[str]) -> list[tuple[int, int, str]]:
    """Spans of parts of the text, by Viterbi over all of their tokens."""
    out = []
    for a, b in parts:
        places = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
        tags = field.tags([text[i:j] for i, j in places], file) if places else []
        out += [(places[i][0], places[j][1], "field") for i, j in runs({k: tag for k, tag in enumerate(tags) if tag != O})]
    return out


def field_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """What the field tags in the whole text, in code points."""
    tokens = TOKEN.findall(text)
    at = field.placed(tokens)
    tags = field.inside(at, file_features(text, field.odd(at))) if tokens else {}
    if not tags:
        return []
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    return [(places[i][0], places[j][1], "field") for i, j in runs(tags)]


def spans(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans: those the field adds overlap none of the base. Both are sorted, and merged."""
    base = base_spans(text)
    free, k, reach = [], 0, 0
    for s in field_spans(text, field):
        while k < len(base) and base[k][0] < s[1]:  # base spans that begin before s ends; does one end after s begins?
            reach, k = max(reach, base[k][1]), k + 1
        if reach <= s[0]:
            free.append(s)
    return base, sorted([*base, *free], key=lambda s: (s[0], ORDER[s[2]]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_field, base_sha256 and spans for each row of docs; nothing is shuffled.

    Null and empty texts have no spans (the hash of the empty string). Very long texts are scanned whole. Spans of
    one kind don't overlap; the order is by start, then kind. Repeated rows are scanned each.
    """
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [spans(t, field) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == kind for s in every) for _, every in found], pa.int64()) for kind in ORDER]
            hashes = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.record_batch([b.column(0), *counts, hashes, pa.array([joined(every) for _, every in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in ORDER), "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in ORDER) + ", base_sha256 string, spans string")

"""Secret scan: fixed rules, and a linear-chain conditional random field that adds spans to theirs.

Rules (kinds assign, access, hex) give the base spans, which always stay. The field tags tokens as begin (B), inside
(I) or outside (O) of a secret, from the token's shape (length, character classes, changes between them, hex only, share
of vowels, keyword, punctuation), the keywords and punctuation among its neighbours, and features of the whole text
(share of words with digits; presence of assignments). It is trained by gradient steps on the conditional likelihood
(forward and backward recursions in numpy); every document is then decoded whole by Viterbi.

Rules alone would teach it no more than the rules. So each training document gives windows of four sorts: around its base
spans, as they are; the same with the keyword exchanged, the value cut, or its letters' case turned, so that no rule
matches; a place of the text with a made secret set in (other keywords and signs, bearer lines, passwords in
addresses, keys with a prefix or bare ones), or with a decoy (dates, versions, addresses, keywords without a
value); and a plain place. Contexts are the corpus's own. At most SAMPLE_ROWS documents and MAX_SPANS base spans of each
are used.

Decoding runs over few tokens and is exact: relative to the path that is O throughout, a stretch of secret tokens
can gain at most the sum of its tokens' best gains; tokens that lie in no interval whose bound is positive are O
in the best path (two running minima over cumulative sums find them), and Viterbi runs over the others.

Cases: null text counts as empty (no spans); repeated rows are scanned each; ties between labels go to O, then B; a
corpus without any base span trains no field and adds none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import operator
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import bounded_sample, durable, map_batches

SAMPLE_ROWS = 3000
#: Base spans of one training document that give windows.
MAX_SPANS = 4
WINDOW = 24
#: Characters of the text kept on either side of a made secret.
AROUND = 160
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
# The two rules match runs as long as they go, so a least length drops the same matches as a test afterwards.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
#: One of these is in any text that ASSIGN can match.
HINTS = "passw", "secret", "token", "api"
KINDS = "assign", "access", "hex", "crf"
TOKEN = re.compile(r"[\w+/-]+|[^\w\s]")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
# Words that announce a secret, by family.
KEYWORDS = {"password": 1, "passwd": 1, "pwd": 1, "pass": 1, "passphrase": 1, "passcode": 1, "secret": 2, "credential": 2, "credentials": 2, "token": 3, "bearer": 3, "auth": 3, "authorization": 3, "jwt": 3, "session": 3, "key": 4, "apikey": 4, "api_key": 4, "access_key": 4, "private": 4, "signature": 4, "login": 5}
#: Beginnings of issued keys.
PREFIXES = ("ghp_", "gho_", "sk-", "sk_", "pk_", "xoxb-", "glpat-", "npm_", "key-")
PREFIXED = 6
PUNCTUATION = {"=": 1, ":": 2, '"': 3, "'": 3, ",": 4, ".": 4}
O, B, I = 0, 1, 2  # noqa: E741
#: Tokens, of at most LONGEST characters, whose classes a task keeps.
CACHE, LONGEST = 200_000, 32
#: Digits, and the signs that words hold or that have a class of their own.
#: Digits as token_class takes them, superscripts and the like too.
LOUD = re.compile(r"""[\d=:"'_+/%s-]""" % "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal()))


def loud(text: str, low: str) -> bool:
    """Whether a text (low: in lower case) has such a sign or a keyword."""
    return LOUD.search(text) is not None or any(k in low for k in KEYWORDS)

Span = tuple[int, int, int]


def base_spans(text: str, low: str | None = None) -> list[Span]:
    """(start, end, kind number) of the rules' matches that are long enough, sorted; low: the text in lower case."""
    low, out = text.lower() if low is None else low, []
    if any(h in low for h in HINTS):
        out = [(m.start(2), m.end(2), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


# A token's class packs its features: keyword 3 bits, punctuation 3, length 3, characters 5, hex 1, changes 2, few vowels 1.
BITS = 3, 3, 3, 5, 1, 2, 1
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NO_VOWELS = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.I)
LENGTHS = np.array([0, 1, 2, 6, 12, 16, 20, 32])
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c < "\x80" else 4


ASCII_KINDS = bytes(kind_of(chr(i)) for i in range(256))


def keyword_of(token: str) -> int:
    """The family of a keyword, alone or as a part of a name such as db_password or authToken."""
    low = token.lower()
    if low in KEYWORDS:
        return KEYWORDS[low]
    if len(token) >= 12 and low.startswith(PREFIXES):
        return PREFIXED
    if len(token) <= 32 and ("_" in token or "-" in token or not (token.islower() or token.istitle())):
        return next((KEYWORDS[w.lower()] for w in reversed(PARTS.findall(token)) if w.lower() in KEYWORDS), 0)
    return 0


def token_class(token: str) -> int:
    keyword = keyword_of(token)
    punctuation = PUNCTUATION.get(token, 5) if len(token) == 1 and not token.isalnum() else 0
    length = int(np.searchsorted(LENGTHS, len(token), "right")) - 1
    kinds = token.encode().translate(ASCII_KINDS) if token.isascii() else bytes(map(kind_of, token))
    characters = sum(1 << k for k in set(kinds))
    is_hex = len(token) >= 6 and HEX_DIGITS.issuperset(token) and 2 in kinds
    changes = sum(map(operator.ne, kinds, kinds[1:]))
    few = NO_VOWELS.search(token) is not None
    packed, at = 0, 0
    for value, bits in zip((keyword, punctuation, min(length, 7), characters, int(is_hex), min(3, (changes + 1) // 2), int(few)), BITS, strict=True):
        packed |= value << at
        at += bits
    return packed


class Classes(dict):
    """Token to class; plain lower-case words, nearly all tokens, take a short way. Bounded."""

    plain = [token_class("a" * n) for n in range(64)]
    title = [token_class(("A" + "a" * n)[:n]) for n in range(64)]

    def __missing__(self, token: str) -> int:
        if len(token) < 64 and token.isalpha() and token.lower() not in KEYWORDS and not NO_VOWELS.search(token) and (token.islower() or token.istitle()):
            found = self.plain[len(token)] if token.islower() else self.title[len(token)]
        else:
            found = token_class(token)
        if len(self) < CACHE and len(token) <= LONGEST:
            self[token] = found
        return found


def unpack(classes: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in BITS:
        out.append((classes >> at) & ((1 << bits) - 1))
        at += bits
    return out


def own_features(classes: np.ndarray) -> np.ndarray:
    """One-hot own features of classes, with crosses of length and characters."""
    keyword, punctuation, length, characters, is_hex, changes, few = unpack(classes)
    parts = [np.eye(8)[keyword], np.eye(8)[punctuation], np.eye(8)[length], np.eye(32)[characters], is_hex[:, None].astype(float), np.eye(4)[changes]]
    digits = (characters >> 2) & 1
    both = digits * ((characters & 3) > 0)
    parts += [np.eye(8)[length] * both[:, None], np.eye(8)[length] * few[:, None], np.eye(8)[length] * digits[:, None], np.eye(8)[length] * is_hex[:, None], np.eye(8)[length] * (characters == 6)[:, None], few[:, None].astype(float)]
    return np.concatenate(parts, axis=1).astype(np.float32)


def near_features(classes: np.ndarray) -> np.ndarray:
    """What a neighbour shows: its keyword, punctuation, and whether it is long with digits."""
    keyword, punctuation, length, characters, _, _, _ = unpack(classes)
    odd = ((length >= 4) & ((characters >> 2) & 1 == 1)).astype(float)[:, None]
    return np.concatenate([np.eye(8)[keyword], np.eye(8)[punctuation], odd], axis=1).astype(np.float32)


#: Neighbours by distance.
NEAR = -4, -3, -2, -1, 1, 2
FILE_FEATURES = 4
PAD = token_class("a")


def file_features(classes: np.ndarray, text: str) -> np.ndarray:
    characters = unpack(classes)[3]
    share = float((((characters >> 2) & 1) == 1).mean()) if len(classes) else 0.0
    return np.array([1.0, share > 0.02, share > 0.2, "=" in text], dtype=np.float32)


class Field:
    """Parameters: own (features x 3), near (distance x features x 3), file (features x 3), transitions (3 x 3)."""

    def __init__(self, own, near, file, transitions):
        self.own, self.near, self.file, self.transitions = own, near, file, transitions
        self.row = np.full(1 << sum(BITS), -1, dtype=np.int32)  # of each class met so far, in the tables
        self.still: bool | None = None
        self.own_table, self.near_table = np.zeros((0, 3)), np.zeros((len(NEAR), 0, 3))

    @classmethod
    def empty(cls) -> Field:
        n_own, n_near = own_features(np.array([PAD])).shape[1], near_features(np.array([PAD])).shape[1]
        return cls(np.zeros((n_own, 3)), np.zeros((len(NEAR), n_near, 3)), np.zeros((FILE_FEATURES, 3)), np.zeros((3, 3)))

    def scores(self, classes: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Label scores of the tokens of one text (tokens x 3); classes repeat, so each is scored once."""
        index = self.row[classes]
        if (index < 0).any():
            new = np.unique(classes[index < 0])
            self.row[new] = np.arange(len(self.own_table), len(self.own_table) + len(new))
            self.own_table = np.concatenate([self.own_table, own_features(new) @ self.own])
            self.near_table = np.concatenate([self.near_table, near_features(new) @ self.near], axis=1)
            index = self.row[classes]
        out = self.own_table[index] + file @ self.file
        for k, d in enumerate(NEAR):
            moved = self.near_table[k][index]
            if d < 0:
                out[-d:] += moved[:d]
            else:
                out[:-d] += moved[d:]
        return out

    def quiet(self) -> bool:
        """Whether texts without digits, keywords and the signs of PLAIN's complement can hold no secret.

        It bounds what any such token can gain from itself, its neighbours and the text; with twice the best transition
        below zero, no stretch of them gains anything.
        """
        if self.still is None:
            t = self.transitions - self.transitions[O, O]
            most = max(0.0, float(np.delete(t.ravel(), O * 3 + I).max()))
            gain = lambda x: np.maximum(x[:, B], x[:, I]) - x[:, O]
            every = np.arange(1 << sum(BITS))
            keyword, punctuation, _, characters, is_hex, _, _ = unpack(every)
            every = every[(keyword == 0) & np.isin(punctuation, (0, 4, 5)) & ((characters >> 2) & 1 == 0) & (is_hex == 0)]
            near = near_features(every)
            bound = gain(own_features(every) @ self.own).max() + sum(max(0.0, gain(near @ w).max()) for w in self.near) + gain(self.file[:1])[0]
            self.still = bool(bound + 2 * most < 0)
        return self.still

    def decode(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """(first, end) of the secrets on the best path."""
        if not len(scores):
            return []
        t = self.transitions
        relative = scores - scores[:, :1]
        moves = t - t[O, O]
        most = max(0.0, float(np.delete(moves.ravel(), O * 3 + I).max()))
        bound = np.maximum(relative[:, B], relative[:, I]) + most
        if bound.max() <= -most - 1e-9:  # each token's best interval is itself
            return []
        total = np.concatenate([[0.0], np.cumsum(bound)])
        forward = total[1:] - np.minimum.accumulate(total[:-1])
        backward = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        active = np.flatnonzero(forward + backward - bound > -most - 1e-9)
        found = []
        for run in np.split(active, np.flatnonzero(np.diff(active) > 1) + 1):
            if len(run):
                found += self.viterbi(relative[run[0] : run[-1] + 1], moves, int(run[0]))
        return found

    def viterbi(self, relative: np.ndarray, moves: np.ndarray, offset: int) -> list[tuple[int, int]]:
        """Best labels of a run with O before and after it."""
        best, back = [0.0, -np.inf, -np.inf], []
        m, rows = moves.tolist(), relative.tolist()
        for row in rows:
            step, following = [], []
            for y in (O, B, I):
                options = [best[x] + m[x][y] if (x, y) != (O, I) else -np.inf for x in (O, B, I)]
                x = max(range(3), key=options.__getitem__)
                step.append(x)
                following.append(options[x] + row[y])
            back.append(step)
            best = following
        label = max(range(3), key=lambda y: best[y] + m[y][O])
        labels = []
        for step in reversed(back):
            labels.append(label)
            label = step[label]
        labels.reverse()
        spans = []
        for i, y in enumerate(labels):
            if y == B:
                spans.append([offset + i, offset + i + 1])
            elif y == I:
                spans[-1][1] = offset + i + 1
        return [tuple(s) for s in spans]


def train(windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 100, l2: float = 1e-4) -> Field:
    """Fit on (classes, labels, file features) by Adam on the mean conditional log likelihood."""
    field = Field.empty()
    if not any((y != O).any() for _, y, _ in windows):
        field.transitions[O, B] = -50.0
        return field
    length = max(len(c) for c, _, _ in windows)
    n = len(windows)
    classes, labels, mask = np.full((n, length), PAD), np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (c, y, _) in enumerate(windows):
        classes[i, : len(c)], labels[i, : len(c)], mask[i, : len(c)] = c, y, True
    files = np.array([f for _, _, f in windows])
    values, index = np.unique(classes, return_inverse=True)
    index = index.reshape(classes.shape)
    own, shown = own_features(values), near_features(values)
    gold = np.eye(3)[labels] * mask[..., None]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    params = [field.own, field.near, field.file, field.transitions]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        scores = (own @ field.own)[index] + (files @ field.file)[:, None, :]
        for k, d in enumerate(NEAR):
            moved = (shown @ field.near[k])[index]
            if d < 0:
                scores[:, -d:] += moved[:, :d]
            else:
                scores[:, :-d] += moved[:, d:]
        # forward and backward in probabilities, each step scaled to sum to one
        steps_on = np.exp(field.transitions)
        steps_on[O, I] = 0.0
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        alpha, beta = np.empty_like(local), np.ones_like(local)
        first_step = local[:, 0] * np.array([1.0, 1.0, 0.0])
        alpha[:, 0] = first_step / first_step.sum(axis=1, keepdims=True)
        for t in range(1, length):
            move = (alpha[:, t - 1] @ steps_on) * local[:, t]
            alpha[:, t] = np.where(mask[:, t, None], move / move.sum(axis=1, keepdims=True), alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            move = (local[:, t + 1] * beta[:, t + 1]) @ steps_on.T
            beta[:, t] = np.where(mask[:, t + 1, None], move / move.sum(axis=1, keepdims=True), 1.0)
        expected = alpha * beta
        expected = expected / expected.sum(axis=2, keepdims=True) * mask[..., None]
        right = local[:, 1:] * beta[:, 1:]
        total = np.einsum("nta,ab,ntb->nt", alpha[:, :-1], steps_on, right)
        moves = np.einsum("nta,ntb->ab", alpha[:, :-1], right / total[..., None] * mask[:, 1:, None]) * steps_on
        rest = (gold - expected) / n
        by_class = lambda i, r: np.stack([np.bincount(i.ravel(), weights=r[..., y].ravel(), minlength=len(values)) for y in range(3)], axis=1)
        grads = [own.T @ by_class(index, rest), np.zeros_like(field.near), files.T @ rest.sum(1), (gold_moves - moves) / n]
        for k, d in enumerate(NEAR):
            grads[1][k] = shown.T @ (by_class(index[:, :d], rest[:, -d:]) if d < 0 else by_class(index[:, d:], rest[:, :-d]))
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g - l2 * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    field.transitions[O, I] = -1e4
    return field


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text)


class Maker:
    """Made secrets and decoys, drawn by a text's own random numbers."""

    # What secrets are written with.
    NAMES = ("password", "pwd", "passphrase", "pass", "DB_PASSWORD", "userPassword", "client_secret", "credential", "credentials", "auth", "authToken", "access_key", "private_key", "key", "signature", "login", "session_token", "jwt", "passcode", "smtp_pass")
    SIGNS = (" = ", "=", ": ", ":", " : ", " => ", " -> ", " is ", " ")
    QUOTES = ("", "", '"', "'", "`")
    LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def of(self, letters: str, low: int, high: int) -> str:
        return "".join(self.draw.choices(letters, k=self.draw.randint(low, high)))

    def value(self, low: int = 8) -> str:
        every = self.LOWER + self.UPPER + self.DIGITS
        kind = self.draw.randrange(6)
        if kind == 0:
            return self.of("0123456789abcdef", low, 15)
        if kind == 1:
            return self.of("0123456789ABCDEF", max(low, 12), 40)
        if kind == 2:
            return self.of(every + "+/", max(low, 16), 44) + self.draw.choice(["", "=", "=="])
        if kind == 3:  # a word with digits and a sign
            return self.of(self.LOWER, 4, 9) + self.of(self.DIGITS, 1, 4) + self.draw.choice(["", "!", "#", "$", "@"]) + self.of(self.LOWER, 0, 3)
        if kind == 4:
            return "-".join(self.of(self.LOWER + self.DIGITS, 4, 5) + self.of(self.DIGITS, 1, 1) for _ in range(self.draw.randint(3, 5)))
        return self.of(every, max(low, 10), 36) + self.of(self.DIGITS, 1, 2)

    def secret(self) -> tuple[str, int, int]:
        """A line that holds a secret, and where."""
        kind, quote = self.draw.randrange(8), self.draw.choice(self.QUOTES)
        if kind < 4:
            sign, value = self.draw.choice(self.SIGNS), self.value()
            before, after = f"{self.draw.choice(self.NAMES)}{sign}{quote}", quote
        elif kind == 4:
            before, value, after = self.draw.choice(["Authorization: Bearer ", "Bearer ", "authorization: token ", "-H 'Authorization: Bearer "]), self.of(self.LOWER + self.UPPER + self.DIGITS, 16, 48) + "7x", quote
        elif kind == 5:
            before, value, after = f"{quote}", self.draw.choice(PREFIXES) + self.of(self.LOWER + self.UPPER + self.DIGITS, 16, 40), quote
        elif kind == 6:
            before, value, after = f"{self.draw.choice(['postgres', 'mysql', 'https', 'amqp', 'ftp'])}://{self.of(self.LOWER, 3, 8)}:", self.of(self.LOWER + self.UPPER + self.DIGITS, 8, 20) + "5", f"@{self.of(self.LOWER, 3, 8)}.example.com/{self.of(self.LOWER, 3, 6)}"
        else:
            before, value, after = quote, self.of(self.UPPER + self.LOWER + self.DIGITS + self.DIGITS, 22, 44) + "9Q", quote
        return before + value + after, len(before), len(before) + len(value)

    def decoy(self) -> str:
        """A line that looks like one and holds none."""
        word, digits = (lambda: self.of(self.LOWER, 2, 10)), (lambda a, b: self.of(self.DIGITS, a, b))
        return self.draw.choice([
            lambda: f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)} {digits(2, 2)}:{digits(2, 2)}",
            lambda: f"{word()}.{digits(2, 2)}@{word()}{digits(1, 1)}.example.com",
            lambda: f"{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}",
            lambda: f"+{digits(2, 2)} {digits(3, 4)} {digits(6, 8)}",
            lambda: f"https://{word()}.example.com/{word()}/{digits(1, 5)}?page={digits(1, 2)}",
            lambda: f"{self.draw.choice(self.NAMES)} {self.draw.choice(['', 'is ', 'for ', 'of ', 'und ', 'de '])}{word()} {word()}",
            lambda: f"{self.draw.choice(self.NAMES)}: {self.draw.choice(['', '*****', 'none', 'the ' + word(), digits(1, 2)])}",
            lambda: f"{word()} = {digits(1, 6)}",
            lambda: f"{word()} = {quoted(word())}",
            lambda: f"v{digits(1, 1)}.{digits(1, 2)}.{digits(1, 2)}",
            lambda: f"{word()}_{word()}({word()}{digits(1, 1)}, {word()})",
            lambda: f"{word().title()}{word().title()} {word().upper()} {word().upper()}-{digits(1, 4)}",
            lambda: f"{digits(1, 3)},{digits(3, 3)},{digits(3, 3)}.{digits(2, 2)}",
            lambda: f"{word()}{digits(1, 3)} {digits(1, 2)}{self.of(self.LOWER, 1, 2)}",
            lambda: "".join(word() for _ in range(4)),
        ])()


def quoted(text: str) -> str:
    return f'"{text}"'


def window(text: str, spans: list[tuple[int, int]], centre: int, classes: Classes, file: np.ndarray):
    """(classes, labels, file features) of the WINDOW tokens around the one at character `centre`."""
    found = list(TOKEN.finditer(text))
    if not found:
        return None
    codes = np.array([classes[m[0]] for m in found])
    labels, starts = np.zeros(len(found), int), np.array([m.start() for m in found])
    last = -1
    for s, e in sorted(spans):
        if s < last:
            continue
        last = e
        i = max(0, int(np.searchsorted(starts, s, "right")) - 1)
        j = i
        while j < len(found) and starts[j] < e:
            labels[j] = I if j > i else B
            j += 1
    c = max(0, int(np.searchsorted(starts, centre, "right")) - 1)
    low, high = max(0, c - WINDOW // 2), min(len(found), c + WINDOW // 2)
    own = labels[low:high].copy()
    if own[0] == I:
        own[: int(np.argmax(np.append(own != I, True)))] = O  # a secret cut by the window's edge
    return codes[low:high], own, file


def cut(text: str, start: int, end: int) -> tuple[str, str]:
    """AROUND characters or fewer on either side of a place, from white space on."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    return (before.split(" ", 1)[-1] if start > AROUND else before), (after.rsplit(" ", 1)[0] if end + AROUND < len(text) else after)


def labelled_windows(text: str, classes: Classes):
    """Windows of a training text, with labels: of its base spans, of these varied, of a made line, and of a plain place."""
    if not text or text.isspace():
        return
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    made = Maker(seed)
    codes = np.fromiter((classes[t] for t in tokens_of(text)), dtype=np.int32)
    file = file_features(codes, text)
    with_sign = file.copy()
    with_sign[3] = 1
    base = base_spans(text)

    def places(low: int, high: int, by: int) -> list[tuple[int, int]]:
        return [(max(s, low) - by, min(e, high) - by) for s, e, _ in base if s < high and low < e]

    out = []
    for s, e, kind in base[:: max(1, -(-len(base) // MAX_SPANS))] if base else ():
        before, after = cut(text, s, e)
        low, high = s - len(before), e + len(after)
        out.append(window(text[low:high], places(low, high, low), len(before), classes, file))
        value = text[s:e]
        if kind == 0 and made.draw.random() < 0.7:
            stem = re.sub(r"(?i)(password|passwd|secret|token|api_?key)(?=[^A-Za-z]*$)", made.draw.choice(Maker.NAMES), before)
            before = stem if stem != before else before
        if made.draw.random() < 0.5 and any(c.isalpha() for c in value):
            value = value[: made.draw.randint(8, 14)] if made.draw.random() < 0.5 else value.upper()
            if not any(c.isdigit() for c in value):
                value += "4"
        changed = before + value + after
        if kind == 0 or any(c.isalpha() for c in value):
            out.append(window(changed, [(len(before), len(before) + len(value))], len(before), classes, file))
    for _ in range(2):
        # a place between words; what is there stays around it
        place = text.find(" ", made.draw.randrange(len(text)))
        place = len(text) if place < 0 else place
        before, after = cut(text, place, place)
        before = before[: len(before) - len(before.rstrip()) or None].rstrip()
        if made.draw.random() < 0.6:
            line, s, e = made.secret()
            at = [(len(before) + 1 + s, len(before) + 1 + e)]
        else:
            line, at = made.decoy(), []
        whole = f"{before} {line} {after.lstrip()}"
        known = [(s, e) for s, e, _ in base_spans(whole) if not any(s < b and a < e for a, b in at)]
        out.append(window(whole, at + known, len(before) + 1 + len(line) // 2, classes, with_sign if "=" in line else file))
    place = made.draw.randrange(len(text))
    before, after = cut(text, place, place)
    low, high = place - len(before), place + len(after)
    if not any(s < low < e or s < high < e for s, e, _ in base):
        out.append(window(text[low:high], places(low, high, low), len(before), classes, file))
    yield from (w for w in out if w is not None)


WINDOWS = pa.schema([("c", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("f", pa.list_(pa.float32()))])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Field:
    """Train on at most `rows` documents: those with a base span and the others with the smallest identifier hashes, half
    each; of rows that share an identifier, the one with the smallest text hash. Windows of class numbers, not texts, come
    to the driver: 2 * MAX_SPANS + 3 of each document at most."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    likely = texts.filter(F.col("_text").rlike(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}|(?i)(password|passwd|secret|token|api_?key)"))
    drawn = bounded_sample(likely, "_id", rows // 2).union(bounded_sample(texts, "_id", rows // 2)).distinct()

    def run(batches):
        classes = Classes()
        for batch in batches:
            held = []
            for text in batch.column(2):
                found = [{"c": c.tolist(), "y": y.tolist(), "f": f.tolist()} for c, y, f in labelled_windows(text.as_py(), classes)]
                held.append(pa.RecordBatch.from_pylist(found, schema=WINDOWS).serialize().to_pybytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], names=["id", "hash", "windows"])

    # at most `rows` identifiers: small whatever the table holds
    made = map_batches(texts.join(F.broadcast(drawn), "_id").select(F.col("_id").cast("string").alias("id"), F.xxhash64("_text").alias("hash"), "_text"), run, "id string, hash long, windows binary")
    sample = durable(made.groupBy("id").agg(F.min_by("windows", "hash").alias("windows")), "windows")
    windows = []
    for r in sample.toLocalIterator():
        table = pa.ipc.read_record_batch(pa.py_buffer(bytes(r.windows)), WINDOWS)
        windows += [tuple(np.array(x[k]) for k in ("c", "y", "f")) for x in table.to_pylist()]
    windows.sort(key=lambda w: (w[0].tobytes(), w[1].tobytes()))
    return train(windows)


def scan_text(text: str, field: Field, classes: Classes) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those of the field that touch no base span are added."""
    low = text.lower()
    base = base_spans(text, low)
    if not base and field.quiet() and not loud(text, low):
        return base, base
    tokens = tokens_of(text)
    codes = np.fromiter(map(classes.__getitem__, tokens), dtype=np.int32, count=len(tokens))
    secrets = field.decode(field.scores(codes, file_features(codes, text))) if len(tokens) else []
    if not secrets:
        return base, base
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    added = []
    for i, j in secrets:
        start, end = places[i][0], places[j - 1][1]
        if not any(s < end and start < e for s, e, _ in base):
            added.append((start, end, 3))
    return base, sorted(base + added, key=lambda s: (s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, e, k in spans])


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per document."""
    shipped = docs.sparkSession.sparkContext.broadcast((field.own, field.near, field.file, field.transitions))

    def run(batches):
        own, classes = Field(*shipped.value), Classes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                base, spans = scan_text(text.as_py() or "", own, classes)
                for k in range(3):
                    out[k].append(sum(s[2] == k for s in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(spans))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)

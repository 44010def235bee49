"""Operator 3, personal data: a linear-chain conditional random field over word-shape features.

Tokens are cut at white space and at quotes, brackets, commas, semicolons, colons, equals signs, ampersands, question
marks and the full stops of other scripts, so that a span can begin or end at any of them; a name and the colon or
equals sign behind it are one token. A token is reduced to a core without surrounding punctuation. Its class is the set
of its shape features (collapsed and full shape, digits, hexadecimal digits, dots, an at sign and what is around it,
octets in range, the check digit of card numbers, key words); the field scores a label from the classes of a token and of both its neighbours, and from the label before.
Weights are trained in numpy, by gradient ascent on the penalised log-likelihood with forward-backward sums, from
labelled_table(), a small table of made-up sentences in several layouts.

Decoding is Viterbi in numpy batches. A token whose outside label beats every other by more than any two transitions
can make up for is outside in the best sequence whatever its neighbours are; such tokens cut a text into short
segments, which are decoded exactly, all of a batch side by side. The best sequence is the one that decoding the whole
text would give.

Kinds: email, ip, card, phone, secret, ssn, iban. A number without a right check digit is no card, and a hash after a
word such as commit or sha1 no secret; a hash alone is taken for one. Ties: of equal sequences the one whose labels come
first in LABELS, from the end. Defined results: null, empty and clean texts give no rows; a null
doc_id keeps its spans; repeated rows each have theirs; an empty table gives no rows; columns besides doc_id and text
are ignored. Very long texts are decoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
#: Kinds of several tokens have a label for the first and one for the rest.
LONG = {"card", "phone", "iban"}
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in ("BI" if k in LONG else "B")))
MAX_TOKENS = 300_000
SCHEMA = "doc_id bigint, start bigint, end bigint, kind string, surface string"
SENTENCES = 900
APART = "\\s\"`<>\\[\\]{}|,;:=&?\\\\“”„«»。，、；：！？「」（）"
TOKEN = re.compile(rf"[^{APART}]+(?:[\"']?[ \t]?[=:]+)?|[|=]+")
EDGE = "\"'`<>[]{}|,;:!?#$%&*~=_“”«» \t"
SECRETS = ("token", "key", "secret", "password", "passwd", "api_key", "apikey", "bearer")
HASHES = ("commit", "sha", "sha1", "sha256", "md5", "hash", "digest", "checksum", "revision", "etag")
KEYWORDS = {*SECRETS, "ssn", "iban", "phone", "tel", "call", "card", "visa", "=", "+", "|"}


def core(token: str) -> tuple[int, int]:
    """Where the token's core begins and ends: without punctuation around it, but with brackets and plus signs of telephone numbers."""
    left, right = 0, len(token)
    while True:
        before = left, right
        while left < right and token[left] in EDGE:
            left += 1
        while right > left and token[right - 1] in EDGE:
            right -= 1
        if right > left and token[right - 1] == ".":
            right -= 1
        if right > left + 1 and token[left] == "(" and token[right - 1] == ")" and not token[left + 1 : right - 1].isdigit():
            left, right = left + 1, right - 1
        if right > left and token[left] == "(" and ")" not in token[left:right]:
            left += 1
        if right > left and token[right - 1] == ")" and "(" not in token[left:right]:
            right -= 1
        if (left, right) == before:
            return before


def luhn(digits: str) -> bool:
    """Whether the last digit is right as the check digit of the others."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _word(text: str) -> tuple[str, ...]:
    if text in HASHES:
        return ("word", "hashes")
    return ("word", f"key={text}") if text in KEYWORDS else ("word",)


def shape(token: str) -> tuple[str, ...]:
    """The features of a token's class."""
    if token.isalpha():
        return _word(token.lower())
    a, b = core(token)
    text = token[a:b].lower()
    if not text:
        return ("mark", f"key={token}") if token in KEYWORDS else ("mark",)
    given = ("given",) if token[-1] in "=:" else ()
    if text.isalpha() or text in KEYWORDS:
        if given and text in SECRETS:
            return ("word", "secret-follows")
        return (*_word(text), *given)
    full = "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in text)
    digits = sum(c.isdigit() for c in text)
    out = ["other", "short=" + re.sub(r"(.)\1+", r"\1+", full), f"digits={min(digits, 20)}", f"size={min(len(text).bit_length(), 8)}", "full=" + full, *given]
    if re.fullmatch(r"[0-9a-f]{16,}", text) and digits and digits < len(text):
        out.append("hex")
    if re.fullmatch(r"[a-z0-9_\-]{16,}", text) and 3 < digits < len(text) - 3:
        out.append("opaque")
    if re.fullmatch(r"[^@\s]+@[^@\s]+\.[a-z]{2,}", text):
        out.append("mail")
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", text):
        out.append("ip" if all(int(x) < 256 for x in text.split(".")) else "badip")
    if text.isdigit():
        out.append("number")
    if 13 <= digits <= 19 and re.fullmatch(r"[0-9]+(?:-[0-9]+)*", text):
        out.append("checked-number" if luhn(text.replace("-", "")) else "long-number")
    if re.fullmatch(r"(?:akia|asia)[0-9a-z]{16}|(?:ghp_|gho_|xox[abp]-|sk-)[0-9a-z_\-]{16,}", text):
        out.append("secret-prefix")
    if re.fullmatch(r"[a-z]{2}\d{2}[a-z0-9]{10,30}", text):
        out.append("iban")
    return tuple(out)


def labelled_table(n: int = SENTENCES, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences with (start, end, kind) spans."""
    rng = np.random.default_rng(seed)
    syllables = "ba co di fu ge ha ki lo mu na or pe qui ra so tu ve wa xi yo zé ñá ßü ch th ou".split()

    def number(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def word() -> str:
        w = "".join(rng.choice(syllables, rng.integers(1, 5)))
        return w.capitalize() if rng.random() < 0.15 else w

    def checked(k: int) -> str:
        """A number whose last digit is right."""
        first = number(k - 1)
        return next(first + d for d in "0123456789" if luhn(first + d))

    def unchecked(k: int) -> str:
        first = number(k)
        return first if not luhn(first) else first[:-1] + str((int(first[-1]) + 1) % 10)

    def hexa(k: int) -> str:
        return "".join(rng.choice(list("0123456789abcdef"), k))

    def plain() -> str:
        pick = rng.integers(0, 19)
        special = [number(rng.integers(1, 6)), f"{number(4)}-{number(2)}-{number(2)}", f"{number(1)}.{number(2)}", f"v{number(1)}.{number(1)}.{number(1)}", f"({number(4)})", f"{number(2)}:{number(2)}", f"{word()}-{word()}", f"{word()}{number(2)}", f"http://{word()}.example.org/{number(3)}", f"{number(3)},{number(3)}", f"@{word()}", f"{number(2)}%", f"#{number(3)}", "=", f"{number(3)}.{number(2)}.{number(4)}", f"{number(1)}/{number(2)}", unchecked(int(rng.integers(13, 20))), f"{word()}={number(2)}", f'{{"{word()}":"{word()}"}}']
        return special[pick]

    def harmless() -> list[str]:
        """What looks like personal data but for the words before it."""
        key, value = str(rng.choice(SECRETS)), hexa(int(rng.choice([32, 40, 40, 64])))
        return [[str(rng.choice(HASHES)), value], [f"{rng.choice(HASHES)}{'=:'[rng.integers(0, 2)]}{value}"], [f"{rng.choice(HASHES)}:", value], ["order", unchecked(16)], [f"{key}:", word()], [key, "=", word()], [key, word()]][rng.integers(0, 7)]

    def value() -> str:
        """A made-up password: letters, always with digits."""
        return "".join(rng.choice(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ!$*-_"), rng.integers(4, 12))) + number(rng.integers(1, 5)) + "".join(rng.choice(list("abcxyzQRS"), rng.integers(0, 4)))

    def item(kind: str) -> tuple[list[str], list[bool]]:
        """Tokens and which of them are the kind's."""
        one = rng.random()
        if kind == "email":
            name = [f"{word()}.{number(2)}", word(), f"{word()}.{word()}", f"{word()}_{word()}{number(1)}", number(3)][rng.integers(0, 5)]
            return [f"{name}@{[f'mail{number(1)}.example.com', word().lower() + '.org', 'example.net', f'{word().lower()}.co.uk'][rng.integers(0, 4)]}"], [True]
        if kind == "ip":
            return [".".join(str(rng.integers(0, 256)) for _ in range(4))], [True]
        if kind == "card":
            digits = checked(16 if one < 0.45 else int(rng.choice([13, 15, 16, 16, 16, 16])))
            fours = [digits[i : i + 4] for i in range(0, 16, 4)]
            return (fours, [True] * 4) if one < 0.3 else (["-".join(fours)], [True]) if one < 0.45 else ([digits], [True])
        if kind == "phone":
            a, b, c = number(3), number(3), number(4)
            forms = [[f"+{number(rng.integers(1, 3))}", f"({a})", f"{b}-{c}"]] * 4 + [[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{number(2)}", a, f"{b}{c}"], [f"+{number(1)}-{a}-{b}-{c}"], [f"+{number(11)}"]]
            made = forms[rng.integers(0, len(forms))]
            return made, [True] * len(made)
        if kind == "secret":
            made = hexa(int(rng.choice([32, 40, 40, 64]))) if one < 0.55 else value() if one < 0.75 else "sk-" + "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyz23456789"), 28))
            if one > 0.95:
                return ["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))], [True]
            if one > 0.85 or 0.45 < one < 0.55:
                return [made], [True]
            key = str(rng.choice(["token", "token", "api_key", "password", "secret", "passwd"]))
            forms = [([key, "=", ("\"", made, "\"")], [False, False, True])] * 4 + [([(f"{key}=", made, "")], [True]), ([f"{key}:", made], [False, True]), ([(f'{{"{key}":"', made, '"}')], [True]), ([(f"{key}='", made, "'")], [True])]
            return forms[rng.integers(0, len(forms))]
        if kind == "ssn":
            return [f"{number(3)}-{number(2)}-{number(4)}"], [True]
        code = "".join(rng.choice(list("ABCDEFGH"), 2)) + number(2)
        return ([code, *(number(4) for _ in range(4)), number(2)], [True] * 6) if one < 0.4 else ([code + number(18)], [True])

    def wrapped(kind: str, made: str) -> tuple[str, str, str]:
        """One token of a kind with what can stand around it without white space."""
        name = {"email": "email", "ip": "ip", "card": "card", "phone": "phone", "ssn": "ssn", "iban": "iban"}[kind]
        forms = [(f'{{"{name}":"', "\"}"), (f"{name}=", ""), (f"{name}:", ""), ("<", ">"), ("(", ")"), ("", "。"), ("", f",{word()}"), (f"{word()},", f";{word()}"), ("'", "'"), (f"{word()}=", f"&{word()}={number(2)}"), ("“", "”")]
        forms += [("mailto:", ""), ("to:", ";cc"), ("mailto:", f"?{word()}={word()}")] * 2 if kind == "email" else [("", f":{number(4)}"), ("ip=", f":{number(2)}"), ("host:", f":{number(4)}")] * 2 if kind == "ip" else []
        before, after = forms[rng.integers(0, len(forms))]
        return before, made, after

    rows = []
    for _ in range(n):
        tokens: list[tuple[str | tuple[str, str, str], str]] = []
        for _ in range(rng.integers(3, 16)):
            one = rng.random()
            if one < 0.16:
                kind = KINDS[rng.choice(7, p=[0.2, 0.18, 0.18, 0.18, 0.14, 0.06, 0.06])]
                made, own = item(kind)
                if len(made) == 1 and kind != "secret" and rng.random() < 0.35:
                    made = [wrapped(kind, made[0])]
                tokens += [(t, f"{'B' if k == 0 or not own[k - 1] else 'I'}-{kind}" if own[k] else "O") for k, t in enumerate(made)]
            elif one < 0.2:
                tokens += [(t, "O") for t in harmless()]
            else:
                tokens.append((plain() if one < 0.33 else word(), "O"))
        layout = rng.integers(0, 4)
        text, spans = "", []
        for i, (t, label) in enumerate(tokens):
            before, own, after = t if isinstance(t, tuple) else ("", t, "")
            if layout == 1:
                before, own, after = before.upper(), own.upper(), after.upper()
            a, b = core(own) if label != "O" else (0, len(own))
            text += before
            if label[0] == "B":
                spans.append((len(text) + a, len(text) + b, label[2:]))
            elif label[0] == "I":
                spans[-1] = (spans[-1][0], len(text) + b, label[2:])
            inside = i + 1 < len(tokens) and tokens[i + 1][1][0] == "I"
            tail = " " if inside else ["", ",", ".", ""][rng.integers(0, 4)] * int(rng.random() < 0.3) + [" ", "!! ", str(rng.choice(["###", "$$$", "%%%", "***", "&&&"])) + " ", " | "][layout]
            text += own + after + tail
        rows.append((text.rstrip(), spans))
    return rows


@dataclass
class Field:
    """features: numbers of features; emit: weights by place (token, one before, one after), feature and label; step: by label and next label; begin, end: at the edges of a text."""

    features: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def scores(self, feats: tuple[str, ...]) -> np.ndarray:
        """(place, label) scores of a class."""
        known = [self.features[f] for f in feats if f in self.features]
        return self.emit[:, known].sum(axis=1)


def _labels(text: str, spans: list[tuple[int, int, str]]) -> list[int]:
    out = []
    for m in TOKEN.finditer(text):
        label = "O"
        for start, end, kind in spans:
            a, b = core(m.group())
            if m.start() + a < end and m.start() + b > start and b > a:
                label = ("B-" if start >= m.start() or kind not in LONG else "I-") + kind
        out.append(LABELS.index(label))
    return out


def train(table: list[tuple[str, list[tuple[int, int, str]]]] | None = None, steps: int = 100, penalty: float = 1e-3) -> Field:
    table = [row for row in (table or labelled_table()) if row[0].split()]
    shapes = [[shape(m.group()) for m in TOKEN.finditer(text)] for text, _ in table]
    features = {f: i for i, f in enumerate(sorted({f for s in shapes for feats in s for f in feats}))}
    classes = {c: i for i, c in enumerate(sorted({feats for s in shapes for feats in s}))}
    has = np.zeros((len(classes) + 1, len(features)))
    for c, i in classes.items():
        has[i, [features[f] for f in c]] = 1
    n, k, longest = len(table), len(LABELS), max(map(len, shapes))
    none = len(classes)
    ids, gold, mask = np.full((n, longest + 2), none), np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for i, (s, (text, spans)) in enumerate(zip(shapes, table, strict=True)):
        ids[i, 1 : len(s) + 1] = [classes[f] for f in s]
        gold[i, : len(s)] = _labels(text, spans)
        mask[i, : len(s)] = True
    last = mask.sum(axis=1) - 1
    at = (ids[:, 1:-1], ids[:, :-2], ids[:, 2:])
    p = {"emit": np.zeros((3, len(features), k)), "step": np.zeros((k, k)), "begin": np.zeros(k), "end": np.zeros(k)}
    first, second = {x: np.zeros_like(v) for x, v in p.items()}, {x: np.zeros_like(v) for x, v in p.items()}
    rows = np.arange(n)
    for turn in range(steps):
        tables = has @ p["emit"]
        e = sum(tables[j][at[j]] for j in range(3))
        e[rows, last] += p["end"]
        e[:, 0] += p["begin"]
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            x = forward[:, t - 1, :, None] + p["step"]
            top = x.max(axis=1)
            new = np.log(np.exp(x - top[:, None]).sum(axis=1)) + top + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        total = forward[:, -1]
        whole = np.log(np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)) + total.max(axis=1)
        pairs = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            x = p["step"] + (e[:, t + 1] + backward[:, t + 1])[:, None]
            top = x.max(axis=2)
            new = np.log(np.exp(x - top[..., None]).sum(axis=2)) + top
            live = mask[:, t + 1]
            both = np.exp(np.minimum(forward[:, t, :, None] + x - whole[:, None, None], 0))
            pairs += both[live].sum(axis=0)
            backward[:, t] = np.where(live[:, None], new, 0)
        belief = np.exp(np.minimum(forward + backward - whole[:, None, None], 0)) * mask[..., None]
        truth = np.eye(k)[gold] * mask[..., None]
        miss = truth - belief
        g = {"emit": np.zeros_like(p["emit"]), "begin": miss[:, 0].sum(axis=0), "end": miss[rows, last].sum(axis=0)}
        for j in range(3):
            by = np.zeros((none + 1, k))
            np.add.at(by, at[j][mask], miss[mask])
            g["emit"][j] = has.T @ by
        counts = np.zeros((k, k))
        live = mask[:, 1:]
        np.add.at(counts, (gold[:, :-1][live], gold[:, 1:][live]), 1)
        g["step"] = counts - pairs
        for x, v in p.items():
            d = g[x] / n - penalty * v
            first[x] += 0.1 * (d - first[x])
            second[x] += 0.01 * (d * d - second[x])
            v += 0.2 * (1 - turn / steps) * first[x] / (1 - 0.9 ** (turn + 1)) / (np.sqrt(second[x] / (1 - 0.99 ** (turn + 1))) + 1e-8)
    return Field(features, p["emit"], p["step"], p["begin"], p["end"])


class Decoder:
    def __init__(self, field: Field):
        self.field = field
        step = field.step
        # the most that the transitions around a token can favour label k over outside
        self.lead = (step[:, :, None] + step[None, :, :] - step[:, :1, None] - step[None, :1, :]).max(axis=(0, 2))
        edges = np.maximum(field.begin - field.begin[0], 0).max() + np.maximum(field.end - field.end[0], 0).max()
        self.lead = np.maximum(self.lead, 0) + edges
        self.reset()

    def reset(self) -> None:
        self.tokens: dict[str, int] = {}
        self.classes: dict[tuple[str, ...], int] = {(): 0}
        self.tables = [np.zeros((1, len(LABELS))) for _ in range(3)]

    def numbers(self, cut: list[str]) -> np.ndarray:
        """The tokens' classes: features that the field doesn't know make no class of their own."""
        tokens, classes, known = self.tokens, self.classes, self.field.features
        fresh: list[np.ndarray] = []
        for t in set(cut).difference(tokens):
            feats = tuple(f for f in shape(t) if f in known)
            if (c := classes.get(feats)) is None:
                c = classes[feats] = len(classes)
                fresh.append(self.field.scores(feats))
            tokens[t] = c
        if fresh:
            self.tables = [np.concatenate([table, [rows[j] for rows in fresh]]) for j, table in enumerate(self.tables)]
        return np.fromiter(map(tokens.__getitem__, cut), dtype=np.int64, count=len(cut))

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Labels of the tokens of each text."""
        if len(self.tokens) > MAX_TOKENS or len(self.classes) > MAX_TOKENS // 10:
            self.reset()
        ids = [self.numbers(cut) for cut in texts]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        out = [np.zeros(n, dtype=np.int64) for n in lengths]
        some = np.flatnonzero(lengths)
        if not len(some):
            return out
        padded = np.concatenate([np.zeros(1, np.int64), *(np.append(ids[i], 0) for i in some)])
        now, before, after = padded[1:-1], padded[:-2], padded[2:]
        real = np.ones(len(now), dtype=bool)
        ends = np.cumsum(lengths[some] + 1) - 1
        real[ends[:-1]] = False
        a, b, c = self.tables
        # a quick bound by class: places where the three classes' least margins already settle it need no scores
        margin = [(t[:, :1] - t)[:, 1:] for t in self.tables]
        least = [m.min(axis=1) for m in margin]
        sure = least[0][now] + least[1][before] + least[2][after] > self.lead[1:].max()
        maybe = np.flatnonzero(~sure & real)
        e = a[now[maybe]] + b[before[maybe]] + c[after[maybe]]
        open_ = ((e[:, :1] - e + 0)[:, 1:] <= self.lead[1:]).any(axis=1)
        maybe, e = maybe[open_], e[open_]
        if not len(maybe):
            return out
        begins = np.concatenate([[0], ends[:-1] + 1])
        starts_text, ends_text = np.isin(maybe, begins), np.isin(maybe, ends - 1)
        new = np.ones(len(maybe), dtype=bool)
        new[1:] = np.diff(maybe) > 1
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, len(maybe)))
        labels = np.zeros(len(maybe), dtype=np.int64)
        step = self.field.step
        order = np.argsort(sizes, kind="stable")
        for group in np.array_split(order, max(1, len(order) // 2048)):
            longest = int(sizes[group].max())
            item = np.minimum(firsts[group][:, None] + np.arange(longest), len(maybe) - 1)
            live = np.arange(longest) < sizes[group][:, None]
            score = e[item[:, 0]] + np.where(starts_text[item[:, 0]][:, None], self.field.begin, step[0])
            back = np.zeros((len(group), longest, len(LABELS)), dtype=np.int64)
            for t in range(1, longest):
                x = score[:, :, None] + step
                back[:, t] = x.argmax(axis=1)
                score = np.where(live[:, t, None], np.take_along_axis(x, back[:, t][:, None], axis=1)[:, 0] + e[item[:, t]], score)
            finals = firsts[group] + sizes[group] - 1
            score = score + np.where(ends_text[finals][:, None], self.field.end, step[:, 0])
            label = score.argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                own = live[:, t]
                labels[item[own, t]] = label[own]
                if t:
                    label = np.where(own, back[np.arange(len(group)), t, label], label)
        text = np.searchsorted(ends, maybe, side="right")
        for i, place, label in zip(text.tolist(), (maybe - begins[text]).tolist(), labels.tolist(), strict=True):
            out[some[i]][place] = label
        return out


def spans(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) in characters of what the labels mark."""
    if not labels.any():
        return []
    out: list[tuple[int, int, str]] = []
    before = "O"
    for m, k in zip(TOKEN.finditer(text), labels.tolist(), strict=True):
        label = LABELS[k]
        if label != "O":
            a, b = core(m.group())
            if label[0] == "I" and before[2:] == label[2:] and before != "O":
                out[-1] = (out[-1][0], m.start() + b, label[2:])
            elif b > a:  # also a rest without a first token, which the field makes unlikely but doesn't forbid
                out.append((m.start() + a, m.start() + b, label[2:]))
        before = label
    return out


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per span found: doc_id, start and end in characters, kind, surface. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in common.slices(batches, "text"):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = decoder.decode([TOKEN.findall(t or "") for t in texts])
            flat = [(i, *s, t[s[0] : s[1]]) for i, t, labels in zip(ids, texts, found, strict=True) if t for s in spans(t, labels)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.int64()), pa.array([f[3] for f in flat], pa.string()), pa.array([f[4] for f in flat], pa.string())],
                ["doc_id", "start", "end", "kind", "surface"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(search, SCHEMA)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.read(spark, sf_dir, "documents"))

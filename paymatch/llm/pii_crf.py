"""Personal data: exact base patterns, and a linear-chain CRF over word shapes.

The base finds e-mail addresses, IPv4 addresses, payment cards and phone
numbers by pattern. A conditional random field, trained here from a small
labelled table, adds forms that the patterns miss (phone numbers without
a country code, addresses written with "(at)", IPv6, dotted cards). It tags
words by their shapes and their neighbours' shapes; Viterbi runs in numpy over
batches of segments.

Words without a digit, ``@`` or a bracketed "at"/"dot" are *plain*. The model
fixes a plain word between plain words to O, in training and decoding alike, so
the chain falls apart there: decoding the stretches around other words gives
the best labels of the whole text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[int, int, int]  # start, kind by place in KINDS, end

# ---- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches from each ``@``: all before it back to the last match, one domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, 0, host.end()
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, sorted; offsets in code points, end exclusive."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[ -]", "", m[0]) if len(m[0]) < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# ---- the labelled table

_WORDS = ("the report of this month was sent to her and later we met in town with some friends about that plan "
          "please write or come by when it is open again for your visit there").split()
#: Sentences with slots; a slot in capitals is personal data of that kind, one in lower case is not.
_TEMPLATES = (
    "{w} {w} call PHONE {w} {w}", "{w} phone: PHONE, {w} {w}", "tel PHONE {w}", "{w} PHONE {w} {w}",
    "{w} {w} PHONE or PHONE {w}", "{w} fax PHONE. {w}", "my number is PHONE {w} {w}",
    "{w} mail EMAIL {w} {w}", "{w} write to EMAIL, {w}", "EMAIL {w} {w}", "{w} {w} EMAIL. {w}", "contact EMAIL or PHONE",
    "{w} server IP {w} {w}", "{w} from IP, {w}", "host IP {w} {w}", "{w} {w} IP. {w}",
    "{w} card CARD {w} {w}", "{w} paid with CARD, {w}", "CARD {w} {w}", "{w} {w} CARD. {w}",
    "{w} {w} {w} {w} {w}", "{w} {w} year {w} {w}", "{w} {w} number {w} {w}", "{w} hex {w} {w}", "{w} token = hex {w}",
    "{w} price {w} {w}", "{w} date {w} {w}", "{w} version {w} {w}", "{w} link {w} {w}", "{w} {w} number number {w}",
    "{w} clock {w} {w}", "number {w} number {w} number", "{w} id {w} {w}", "license version {w}", "{w} handle {w} {w}",
    "{w} range {w} {w}", "{w}, {w} {w}. {w} {w}", "{w} (see number) {w}", "{w} {w} | number | {w}", "{w}!! {w}*** {w}",
)


def _fill(slot: str, r: random.Random) -> list[str]:
    """Words of one slot."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: r.choice(("anna", "j.doe", "mario", "li_wei", "sara.k")) + r.choice(("", d(2)))
    host = lambda: r.choice(("example", "mail", "corp-net"))
    end = lambda: r.choice(("com", "org", "de", "net"))
    card = lambda: _with_check(r.choice("3456") + d(14))
    if slot == "{w}":
        return [r.choice(_WORDS).capitalize() if r.random() < 0.2 else r.choice(_WORDS)]
    forms = {
        "PHONE": lambda: r.choice((f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)}/{d(7)}",
                                   f"+{d(2)} {d(3)} {d(7)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
                                   f"0{d(3)} {d(3)} {d(4)}")),
        "EMAIL": lambda: r.choice((f"{name()}@{host()}.{end()}", f"{name()} (at) {host()} (dot) {end()}",
                                   f"{name()}(at){host()}.{end()}", f"{name()} [at] {host()} [dot] {end()}",
                                   f"{name()}@{host()}{d(1)}.example.{end()}")),
        "IP": lambda: r.choice((".".join(str(r.randint(0, 255)) for _ in range(4)),
                                ":".join(f"{r.randint(1, 65535):x}" for _ in range(8)),
                                f"{r.randint(4096, 65535):x}:{r.randint(1, 65535):x}::{r.randint(1, 65535):x}")),
        "CARD": lambda: r.choice((card(), re.sub(r"(....)(?=.)", r"\1 ", card()), re.sub(r"(....)(?=.)", r"\1-", card()),
                                  re.sub(r"(....)(?=.)", r"\1.", card()))),
        "year": lambda: str(r.randint(1900, 2030)), "number": lambda: d(r.randint(1, 6)).lstrip("0") or "0",
        "hex": lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40)))) + '"',
        "price": lambda: f"${d(2)}.{d(2)}", "date": lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{d(2)}",
        "version": lambda: f"{d(1)}.{d(1)}" + r.choice(("", f".{d(1)}")), "clock": lambda: f"{d(2)}:{d(2)}",
        "link": lambda: f"https://{host()}.{end()}/{d(3)}", "id": lambda: f"id-{d(8)}", "handle": lambda: f"@{host()}",
        "range": lambda: f"{d(2)}-{d(2)}",
    }
    for key, form in forms.items():
        if key in slot:
            return slot.replace(key, form()).split(" ")
    return [slot]


def _with_check(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def labelled_table(rows: int = 560, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Sentences as (words, labels)."""
    r = random.Random(seed)
    out = []
    for i in range(rows):
        words, labels = [], []
        for slot in _TEMPLATES[i % len(_TEMPLATES)].split(" "):
            filled = _fill(slot, r)
            kind = next((k for k in KINDS if k.upper() in slot), None)
            words += filled
            labels += ["O"] * len(filled) if kind is None else [f"{'I' if j else 'B'}-{kind}" for j in range(len(filled))]
        out.append((words, labels))
    return out


# ---- features

_CUES = frozenset("call phone tel fax number mail email write contact server host ip card paid token id at dot".split())


_SHAPES: dict[str, str] = {}


def shape(word: str) -> str:
    """The shape of a word; those of words of ordinary length are remembered (the store begins anew once it is large)."""
    if len(word) > 80:
        return _shape(word)
    found = _SHAPES.get(word)
    if found is None:
        if len(_SHAPES) > 100_000:
            _SHAPES.clear()
        found = _SHAPES[word] = _shape(word)
    return found


def _shape(word: str) -> str:
    """Collapsed shape of a whole word with the number of its digits; all plain words share one, all long shapes too."""
    bare = word.strip(".,;:!?\"'|*")
    if not _EVIDENCE.search(bare):
        return f"cue:{bare.lower()}" if bare.lower() in _CUES else "plain"
    kept = re.sub(r"(?i)[\[(]at[\])]", "@@", re.sub(r"(?i)[\[(]dot[\])]", "..", bare))
    kept = re.sub(r"[^\W_]+", lambda m: "d" if m[0].isdigit() else "x" if m[0].isalpha() else "m", kept)
    digits = sum(map(str.isdigit, word))
    run = max(map(len, re.findall(r"[0-9]+", word)), default=0)
    return f"{kept if len(kept) <= 24 else 'long'}:{min(run, 8)}/{min(digits, 20)}"


_EVIDENCE = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.IGNORECASE)


def features(words: list[str]) -> list[tuple[str, ...]]:
    """Features of each word: own shape, coarse shape, shapes and coarse shapes beside it."""
    shapes = [shape(w) for w in words]
    coarse = [re.sub(r"[xm_.%+-]+@+[xmd.-]+", "@", re.sub(r"([dm]:+)+[dm]", ":", x.rpartition("/")[0])) for x in shapes]
    bare = [x.startswith(("plain", "cue")) for x in shapes]
    out: list[tuple[str, ...]] = []
    for i, x in enumerate(shapes):
        left = shapes[i - 1] if i else "plain"
        right = shapes[i + 1] if i + 1 < len(words) else "plain"
        if not bare[i]:
            out.append((f"0:{x}", f"c:{coarse[i]}", f"n:{x.rpartition('/')[2]}", f"-:{left}", f"+:{right}"))
        elif (i and not bare[i - 1]) or (i + 1 < len(words) and not bare[i + 1]):
            ends = "." if words[i][-1] in ".,;:!?" else ""
            out.append(("edge" + ends, f"e-:{left}", f"e+:{right}", f"e:{left}:{right}"))
        else:
            out.append(())
    return out


# ---- model


@dataclass(frozen=True)
class Crf:
    names: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label to label; a segment begins as if after O

    def unary(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i, found in enumerate(features(words)):
            if not found:
                out[i] = _ONLY_O
            for f in found:
                k = self.names.get(f)
                if k is not None:
                    out[i] += self.weights[k]
        return out


def _allowed(a: int, b: int) -> bool:
    """An inner label follows its own kind only."""
    return LABELS[b][0] != "I" or LABELS[a][2:] == LABELS[b][2:]


_BAR = np.array([[0.0 if _allowed(a, b) else -1e9 for b in range(len(LABELS))] for a in range(len(LABELS))])
_ONLY_O = np.array([0.0] + [-1e9] * (len(LABELS) - 1))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 130, ridge: float = 0.02) -> Crf:
    """Maximum likelihood with a ridge, by full-batch Adam over the forward-backward gradient."""
    table = table or labelled_table()
    found = [features(w) for w, _ in table]
    names: dict[str, int] = {}
    for row in found:
        for fs in row:
            for f in fs:
                names.setdefault(f, len(names))
    n, longest, k = len(table), max(len(w) for w, _ in table), len(LABELS)
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    rows, cols = [], []
    for i, ((words, labels), fs) in enumerate(zip(table, found)):
        mask[i, :len(words)] = True
        gold[i, :len(words)] = [LABELS.index(x) for x in labels]
        for t, these in enumerate(fs):
            rows += [i * longest + t] * len(these)
            cols += [names[f] for f in these]
    rows, cols = np.array(rows), np.array(cols)
    used, row_at = np.unique(rows, return_index=True)  # rows ascend
    by_feature = np.argsort(cols, kind="stable")
    feature_at = np.searchsorted(cols[by_feature], np.arange(len(names)))
    size = len(names) * k
    fixed = np.array([[_ONLY_O if not f else 0 * _ONLY_O for f in fs] + [0 * _ONLY_O] * (longest - len(fs)) for fs in found])
    w = np.zeros(size + k * k)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        weights, moves = w[:size].reshape(-1, k), w[size:].reshape(k, k) + _BAR
        unary = np.zeros((n * longest, k))
        unary[used] = np.add.reduceat(weights[cols], row_at)
        g_unary, g_moves = _gradient(unary.reshape(n, longest, k) + fixed, moves, mask, gold)
        grad = np.add.reduceat(g_unary.reshape(-1, k)[rows[by_feature]], feature_at)
        g = np.concatenate([grad.ravel(), g_moves.ravel()]) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Crf(names, w[:size].reshape(-1, k).copy(), w[size:].reshape(k, k) + _BAR)


def _gradient(unary: np.ndarray, moves: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts."""
    n, longest, k = unary.shape
    alpha = np.zeros_like(unary)
    beta = np.zeros_like(unary)
    alpha[:, 0] = moves[0] + unary[:, 0]
    for t in range(1, longest):
        new = _logsum(alpha[:, t - 1, :, None] + moves, 1) + unary[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = _logsum(moves + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
    whole = _logsum(alpha[:, -1], 1)
    one_hot = np.eye(k)[gold] * mask[..., None]
    g_unary = (np.exp(alpha + beta - whole[:, None, None]) * mask[..., None]) - one_hot
    g_moves = np.zeros((k, k))
    g_moves[0] = g_unary[:, 0].sum(0)
    for t in range(1, longest):
        on = mask[:, t]
        pair = alpha[on, t - 1, :, None] + moves + (unary[on, t] + beta[on, t])[:, None, :] - whole[on, None, None]
        g_moves += np.exp(pair).sum(0)
        np.add.at(g_moves, (gold[on, t - 1], gold[on, t]), -1.0)
    return g_unary, g_moves


def viterbi(model: Crf, batch: list[np.ndarray]) -> list[np.ndarray]:
    """Best labels of each segment; segments of like length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(batch)
    order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
    for at in range(0, len(order), 256):
        part = order[at:at + 256]
        longest = len(batch[part[-1]])
        unary = np.zeros((len(part), longest, len(LABELS)))
        lengths = np.array([len(batch[i]) for i in part])
        for j, i in enumerate(part):
            unary[j, :len(batch[i])] = batch[i]
        score = model.moves[0] + unary[:, 0]
        back = np.zeros((longest, len(part), len(LABELS)), np.int8)
        back[:] = np.arange(len(LABELS))
        for t in range(1, longest):
            paths = score[:, :, None] + model.moves
            best = paths.max(1) + unary[:, t]
            on = t < lengths
            back[t, on] = paths[on].argmax(1)
            score = np.where(on[:, None], best, score)
        label = score.argmax(1)
        tags = np.zeros((len(part), longest), int)
        for t in range(longest - 1, -1, -1):
            tags[:, t] = label
            label = np.where(t < lengths, back[t, np.arange(len(part)), label], label)
        for j, i in enumerate(part):
            out[i] = tags[j, :lengths[j]]
    return out


# ---- applying the model

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_BESIDE = 1


def _segments(text: str) -> Iterator[list[tuple[int, int]]]:
    """Stretches of words around every word with evidence, as (start, end) of each word."""
    segment: list[tuple[int, int]] = []
    at = 0
    while hit := _EVIDENCE.search(text, at):
        a = hit.start()
        while a > 0 and text[a - 1] not in _SPACE:
            a -= 1
        beside = []  # words before it that are not in the segment yet
        left, bound = a, segment[-1][1] if segment else 0
        for _ in range(_BESIDE):
            b = left
            while b > bound and text[b - 1] in _SPACE:
                b -= 1
            c = b
            while c > bound and text[c - 1] not in _SPACE:
                c -= 1
            if c == b:
                break
            beside.insert(0, (c, b))
            left = c
        gap = text[bound:left].strip(" \t\n\x0b\x0c\r") if segment else ""
        if gap:
            yield segment
            segment = []
        segment += [x for x in beside if not segment or x[0] >= segment[-1][1]]
        word = _WORD.match(text, a)
        if not segment or a >= segment[-1][1]:
            segment.append(word.span())
        at = word.end()
        place = at
        for _ in range(_BESIDE):
            nxt = _WORD.search(text, place)
            if not nxt or _EVIDENCE.search(nxt[0]):
                break
            segment.append(nxt.span())
            place = nxt.end()
        at = max(at, place)
    if segment:
        yield segment


def _proper(kind: int, found: str) -> bool:
    """Exact checks on what the model proposes."""
    digits = re.sub(r"[^0-9]", "", found)
    if kind == 0:
        return bool(re.search(r"@|[\[(]at[\])]", found, re.IGNORECASE)) and bool(
            re.fullmatch(r"[\w.%+-]+ ?(?:@|[\[(]at[\])]) ?[\w-]+(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]+)+", found, re.IGNORECASE))
    if kind == 1:
        return bool(re.fullmatch(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+",
                                 found))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9]+(?:[ .-][0-9]+)*", found))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"(?=[(0-9])[0-9 ()./-]*[0-9]", found)) and bool(
        re.search(r"[-/() .]", found))


def added_spans(model: Crf, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the model finds beside the base spans of each text."""
    where, unary = [], []
    for i, text in enumerate(texts):
        for words in _segments(text):
            where.append((i, words))
            unary.append(model.unary([text[a:b] for a, b in words]))
    out: list[list[Span]] = [[] for _ in texts]
    for (i, words), tags in zip(where, viterbi(model, unary)):
        t = 0
        while t < len(tags):
            name = LABELS[tags[t]]
            stop = t + 1
            if name[0] == "B":
                while stop < len(tags) and LABELS[tags[stop]] == f"I-{name[2:]}":
                    stop += 1
                a, b = words[t][0], words[stop - 1][1]
                found = texts[i][a:b]
                a += len(found) - len(found.lstrip("\"'<[{|*,;:"))
                b -= len(found) - len(found.rstrip("\"'>]}|*,;:.!?"))
                kind = KINDS.index(name[2:])
                if a < b and _proper(kind, texts[i][a:b]) and not any(x < b and a < y for x, _, y in base[i]):
                    out[i].append((a, kind, b))
            t = stop
    return out


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Crf(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            some = [i for i, t in enumerate(texts) if _EVIDENCE.search(t)]
            base = {i: base_spans(texts[i]) for i in some}
            more = dict(zip(some, added_spans(model, [texts[i] for i in some], [base[i] for i in some])))
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                                       ("base", pa.bool_())]))
            rows = []
            for i in range(len(texts)):
                both = [(*s, True) for s in base.get(i, ())] + [(*s, False) for s in more.get(i, ())]
                rows.append([{"kind": KINDS[k], "start": a, "stop": b, "base": x} for a, k, b, x in sorted(both)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, span)],
                                             [*batch.schema.names[:-1], "pii"])

    return run


SPANS = "array<struct<kind: string, start: long, stop: long, base: boolean>>"


def find(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` without ``text``, plus ``pii``: all spans of the whole text in order.

    Offsets are code points of the text as it is, ``stop`` is exclusive; ``base``
    tells the patterns' spans from the model's, which never overlap a base
    span. Null and empty texts have no spans. Other columns go through; one
    called ``pii`` is replaced. No rows give no rows.
    """
    model = model or fit()
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.moves))
    rest = [c for c in docs.columns if c not in ("text", "pii")]
    rows = docs.select(*rest, F.col("text").cast("string").alias("text"))
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return rows.mapInArrow(_finder(shared), f"{schema}pii {SPANS}")

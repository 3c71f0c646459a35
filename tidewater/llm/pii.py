"""Personal data: fixed patterns, and a linear-chain conditional random field for what they can't tell.

The base patterns find mail addresses, IP addresses, card numbers and phone
numbers in international form.  The model adds names, national phone numbers,
document numbers and masked mail addresses, which only their surroundings give
away.

The model is a linear-chain conditional random field.  A token is a run of
anything but white space, a sequence is a whole line.  The features of a token are
its word shape (letters' cases and digits), the shapes of its neighbours, and
the lower-cased words here and before it where the labelled table has them.
Training maximises the likelihood of the labelled table, with a little decay;
decoding is Viterbi in numpy, over many lines at once.  Lines of more than
``BLOCK`` tokens are decoded in blocks that run side by side; the state is
carried across, so the labels are those of the line in one piece.

Most lines can't hold a span.  Spans gain over unlabelled tokens at most what
their first and further tokens and transitions can add; a line where the sum of
these bounds isn't positive decodes to no span, so it need not be decoded.

A span may have any number of tokens.  One word three times or more in a row is
no part of a name or masked address; what stands before and after it is kept.

Spans are in code points.  Added spans that touch a base span are dropped.  A
null or empty text has no spans.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as common
from . import words
from .line_dedup import _SOLID
from .pii_examples import LABELLED

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds that the model adds, by their name in the labelled table.
ADDED = {"name": "name", "phone": "national_phone", "id": "document_id", "mail": "masked_email"}
LABELS = ["O", *(f"{p}-{k}" for k in ADDED for p in "BI")]
#: Tokens of a line that are decoded one after the other.
BLOCK = 512
DECAY = 0.05
STEPS = 150

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each domain after an @, with what stands before it; in one pass over the text."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            out.append((begin, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- word shapes -------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens, and hashes of their shapes and of their words.

    In a shape, a run of letters of one case is one letter, and of a run of
    digits the first four stand.  The word is lower-cased, without marks at its end.
    """
    starts, ends = words.spans(_SOLID[raw], at)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    kind = _CLASS[raw]
    solid = _SOLID[raw] != 0
    first = np.zeros(len(raw), dtype=bool)
    first[starts] = True
    keep = solid.copy()
    letter = (kind[1:] == 65) | (kind[1:] == 97)
    keep[1:] &= ~((kind[1:] == kind[:-1]) & letter & ~first[1:])
    digit = kind == 48
    if len(raw) > 4:
        run = digit[4:] & digit[3:-1] & digit[2:-2] & digit[1:-3] & digit[:-4]
        new = first[4:] | first[3:-1] | first[2:-2] | first[1:-3]
        keep[4:] &= ~(run & ~new)
    place = np.append(0, np.cumsum(keep))
    shape = words.hashes(kind[keep], place[starts], place[ends])
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    stop = ends.copy()
    mark = np.isin(low, np.frombuffer(b".,:;!?)", dtype=np.uint8))
    for _ in range(2):
        stop -= mark[np.maximum(stop - 1, 0)] & (stop - starts > 1)
    return starts, ends, shape, words.hashes(low, starts, stop)


class Features:
    """Numbers of the features that the labelled table has; the last number of each kind stands for all others."""

    def __init__(self, shapes: np.ndarray, vocabulary: np.ndarray) -> None:
        # what stands once in the table trains the number for all others
        self.shapes, self.vocabulary = (u[n > 1] for u, n in (np.unique(x, return_counts=True) for x in (shapes, vocabulary)))

    @staticmethod
    def _number(known: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        return np.where(known[at] == value, at, len(known))

    def of(self, shape: np.ndarray, word: np.ndarray, line_first: np.ndarray, line_last: np.ndarray) -> list[np.ndarray]:
        """For each token: its shape, the one before, the one after, its word, the word before, and whether it repeats that word.  A line's edges have a number of their own."""
        s, w = self._number(self.shapes, shape), self._number(self.vocabulary, word)
        edge_s, edge_w = len(self.shapes) + 1, len(self.vocabulary) + 1
        back = lambda x, edge: np.where(line_first, edge, np.roll(x, 1))
        echo = np.where(line_first, 2, word == np.roll(word, 1))
        return [s, back(s, edge_s), np.where(line_last, edge_s, np.roll(s, -1)), w, back(w, edge_w), echo]

    def sizes(self) -> list[int]:
        return [len(self.shapes) + 2] * 3 + [len(self.vocabulary) + 2] * 2 + [3]


def _lines(raw: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the first token of each sequence."""
    begins = np.searchsorted(starts, np.unique(np.concatenate([at[:-1], np.flatnonzero(raw == 10) + 1])))
    return np.unique(begins[begins < len(starts)])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


_NEVER = 1e4


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, features: Features, tables: list[np.ndarray], moves: np.ndarray) -> None:
        self.features, self.tables, self.moves = features, tables, moves
        # a span begins with B and goes on with its own I
        kind = np.arange(len(LABELS) - 1) // 2
        self.moves = moves.copy()
        self.moves[0, 2::2] = -_NEVER
        self.moves[1:, 2::2][kind[:, None] != kind[None, 1::2]] = -_NEVER
        none = self.moves[0, 0]
        begin, go_on = range(1, len(LABELS), 2), range(2, len(LABELS), 2)
        leave = np.array([max(0.0, self.moves[[b, i], 0].max() - none) for b, i in zip(begin, go_on, strict=True)])
        self.enter = np.array([self.moves[:, b].max() - none for b in begin]) + leave
        self.enter_first = leave  # nothing leads to a sequence's first token
        self.stay = np.array([self.moves[[b, i], i].max() - none for b, i in zip(begin, go_on, strict=True)])

    def emissions(self, numbers: list[np.ndarray]) -> np.ndarray:
        return sum(t[k] for t, k in zip(self.tables, numbers, strict=True))

    def may_have_spans(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sequences (by their first tokens) where some span of one kind could gain: its first token and the best stretch after it."""
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(scores))))
        out = np.zeros(len(first), dtype=bool)
        for k, (enter, enter_first, stay) in enumerate(zip(self.enter, self.enter_first, self.stay, strict=True)):
            begin = scores[:, 2 * k + 1] - scores[:, 0] + enter
            begin[first] += enter_first - enter
            inner = scores[:, 2 * k + 2] - scores[:, 0] + stay
            total = np.cumsum(inner, dtype=np.float64)
            apart = (np.abs(total).max() * 2 + 1) * own  # keeps each sequence above all later ones
            best = np.maximum.accumulate((total - apart)[::-1])[::-1] + apart
            out |= np.maximum.reduceat(begin + np.maximum(best - total, 0), first) > -1e-3
        return out

    def _entries(self, scores: np.ndarray, begin: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Best scores by label just before each block, up to a constant; blocks stand in order, ``start`` marks the first of each sequence."""
        entry = np.zeros((len(begin), len(LABELS)), dtype=scores.dtype)
        full = np.flatnonzero(~np.append(start[1:], True))  # those that another one follows have all BLOCK tokens
        if not len(full):
            return entry
        # best score of a block from the label before it to its last label; before a sequence any label stands for none
        through = np.where(start[full, None, None], np.zeros_like(self.moves), self.moves) + scores[begin[full], None, :]
        through[:, :, 2::2] -= np.where(start[full], _NEVER, 0).astype(scores.dtype)[:, None, None]
        for t in range(1, BLOCK):
            through = (through[..., None] + self.moves).max(axis=2) + scores[begin[full] + t, None, :]
        for b, step in zip(full.tolist(), through, strict=True):
            entry[b + 1] = (entry[b, :, None] + step).max(axis=0)
            entry[b + 1] -= entry[b + 1].max()
        return entry

    def viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of sequences that stand one after the other; all blocks go step by step together."""
        out = np.zeros(len(scores), dtype=np.int8)
        if not len(sizes):
            return out
        parts = -(-sizes // BLOCK)
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        heads = np.repeat(np.cumsum(sizes) - sizes, parts) + within * BLOCK
        lengths = np.minimum(np.repeat(sizes, parts) - within * BLOCK, BLOCK)
        start = within == 0
        entry = self._entries(scores, heads, start)

        order = np.argsort(-lengths, kind="stable")
        begin, longest = heads[order], lengths[order]
        back = np.zeros((len(scores), len(LABELS)), dtype=np.int8)
        every = entry[order][:, :, None] + self.moves
        back[begin] = every.argmax(axis=1)
        best = np.where(start[order, None], np.where(np.arange(len(LABELS)) % 2, 0, -_NEVER), every.max(axis=1)).astype(scores.dtype)
        best[start[order], 0] = 0
        best += scores[begin]
        origin = back[begin]  # label before the block, by the label that it has come to
        for t in range(1, int(longest[0])):
            n = int(np.searchsorted(-longest, -t, side="left"))  # blocks with a token t
            every = best[:n, :, None] + self.moves
            at = begin[:n] + t
            back[at] = every.argmax(axis=1)
            best[:n] = every.max(axis=1) + scores[at]
            origin[:n] = np.take_along_axis(origin[:n], back[at], axis=1)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        state = best.argmax(axis=1)
        for b in np.flatnonzero(~start)[::-1].tolist():
            state[place[b - 1]] = origin[place[b], state[place[b]]]
        for t in range(int(longest[0]) - 1, -1, -1):
            n = int(np.searchsorted(-longest, -t, side="left"))
            at = begin[:n] + t
            out[at] = state[:n]
            if t:
                state[:n] = back[at, state[:n]]
        return out


def _labelled(text: str) -> tuple[list[bytes], list[list[int]]]:
    """Lines of a labelled table without marks, and the label of each token."""
    texts, marks = [], []
    for line in text.strip().split("\n"):
        plain, labels, at = "", [], 0
        spans = []
        for m in re.finditer(r"\[(\w+)\|((?:[^\]\[]|\[\w+\])*)\]", line):
            plain += line[at : m.start()]
            spans.append((len(plain), len(plain) + len(m[2]), m[1]))
            plain += m[2]
            at = m.end()
        plain += line[at:]
        for t in re.finditer(r"\S+", plain):
            hit = next(((a, k) for a, b, k in spans if a < t.end() and t.start() < b), None)
            labels.append(0 if hit is None else LABELS.index(f"{'B' if t.start() <= hit[0] else 'I'}-{hit[1]}"))
        texts.append(plain.encode())
        marks.append(labels)
    return texts, marks


def train(table: str = LABELLED, steps: int = STEPS) -> Field:
    """Weights of greatest likelihood of the labelled table, by Adam over forward-backward marginals."""
    texts, marks = _labelled(table)
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    at = np.array([0, len(raw)])
    starts, _, shape, word = tokens(raw, at)
    first = _lines(raw, at, starts)
    sizes = np.diff(np.append(first, len(starts)))
    head = np.zeros(len(starts), dtype=bool)
    head[first] = True
    tail = np.append(head[1:], True)
    features = Features(shape, word)
    numbers = features.of(shape, word, head, tail)
    gold = np.array([x for m in marks for x in m])
    n, width, k = len(sizes), int(sizes.max()), len(LABELS)
    grid = np.full((n, width), -1)
    grid[np.arange(width) < sizes[:, None]] = np.arange(len(starts))
    real = grid >= 0
    parts = [np.zeros((s, k)) for s in features.sizes()] + [np.zeros((k, k))]
    slow, fast = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    pairs = ~tail[:-1]
    wanted = np.zeros((k, k))
    np.add.at(wanted, (gold[:-1][pairs], gold[1:][pairs]), 1)
    hot = np.eye(k)[gold]
    for step in range(1, steps + 1):
        moves = parts[-1]
        emit = sum(t[x] for t, x in zip(parts[:-1], numbers, strict=True))
        ahead, behind = np.zeros((width, n, k)), np.zeros((width, n, k))
        ahead[0] = emit[grid[:, 0]]
        for t in range(1, width):
            ahead[t] = np.where(real[:, t, None], _logsum(ahead[t - 1][:, :, None] + moves, 1) + emit[grid[:, t]], ahead[t - 1])
        for t in range(width - 2, -1, -1):
            behind[t] = np.where(real[:, t + 1, None], _logsum(moves + (emit[grid[:, t + 1]] + behind[t + 1])[:, None, :], 2), 0)
        whole = _logsum(ahead[-1], 1)
        chance = np.exp(ahead + behind - whole[None, :, None]).transpose(1, 0, 2)[real]
        crossed = np.zeros((k, k))
        for t in range(1, width):
            own = real[:, t]
            crossed += np.exp(ahead[t - 1][own][:, :, None] + moves + (emit[grid[own, t]] + behind[t][own])[:, None, :] - whole[own][:, None, None]).sum(axis=0)
        error = chance - hot
        gradients = [np.stack([np.bincount(x, error[:, j], minlength=len(p)) for j in range(k)], axis=1) for x, p in zip(numbers, parts[:-1], strict=True)] + [crossed - wanted]
        for p, g, m, v in zip(parts, gradients, slow, fast, strict=True):
            g += DECAY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(features, [p.astype(np.float32) for p in parts[:-1]], parts[-1].astype(np.float32))


@lru_cache(maxsize=1)
def field() -> Field:
    """The model of the labelled table; every worker that asks gets the same weights."""
    return train()


_OPENS = frozenset(b"([{<\"'")
_CLOSES = frozenset(b".,:;!?)]}>\"'|")


def added_spans(model: Field, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(text, kind, start, end) of what the model finds, in bytes of the text."""
    starts, ends, shape, word = tokens(raw, at)
    if not len(starts):
        return []
    first = _lines(raw, at, starts)
    head = np.zeros(len(starts), dtype=bool)
    head[first] = True
    numbers = model.features.of(shape, word, head, np.append(head[1:], True))
    sizes = np.diff(np.append(first, len(starts)))
    scores = model.emissions(numbers)
    live = np.flatnonzero(model.may_have_spans(scores, first))
    if not len(live):
        return []
    sizes = sizes[live]
    at_token = np.repeat(first[live] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    labels = model.viterbi(scores[at_token], sizes)
    out: list[tuple[int, str, int, int]] = []
    heads = np.zeros(len(labels), dtype=bool)
    heads[np.cumsum(sizes) - sizes] = True
    same = word[1:] == word[:-1]
    repeats = np.zeros(len(word), dtype=bool)  # tokens of one word three times or more in a row
    for shift in range(3):
        repeats[shift : len(word) - 2 + shift] |= same[1:] & same[:-1]
    kinds = list(ADDED.values())
    open_kind = -1
    for i in np.flatnonzero(labels).tolist():
        label, token = int(labels[i]), int(at_token[i])
        kind = (label - 1) // 2
        if kinds[kind] in ("name", "masked_email") and repeats[token]:
            continue
        if label % 2 == 0 and open_kind == kind and last == i - 1 and not heads[i]:  # noqa: F821
            out[-1] = (*out[-1][:3], int(ends[token]))
        else:
            out.append((int(np.searchsorted(at, starts[token], side="right")) - 1, kinds[kind], int(starts[token]), int(ends[token])))
        open_kind, last = kind, i
    trimmed = []
    for text, kind, a, b in out:
        while a < b and raw[a] in _OPENS and not (kind == "national_phone" and raw[a] == 40):
            a += 1
        while a < b and raw[b - 1] in _CLOSES:
            b -= 1
        if a < b and (kind in ("name", "masked_email") or np.any(_CLASS[raw[a:b]] == 48)):
            trimmed.append((text, kind, a - int(at[text]), b - int(at[text])))
    return trimmed


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_spans array<string>, spans array<string>, base_sha256 string"


def batch(column: pa.Array, model: Field) -> list[dict]:
    data, offsets = common.raw_texts(column)
    whole = np.frombuffer(data, dtype=np.uint8)
    order = [*BASE_KINDS, *ADDED.values()]
    nothing = {"n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "base_spans": [], "spans": [], "base_sha256": hashlib.sha256(b"").hexdigest()}
    rows: list[dict] = []
    for i, j in common.chunks(offsets):
        raw, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        more: dict[int, list] = {}
        for text, kind, a, b in added_spans(model, raw, at):
            more.setdefault(text, []).append((kind, a, b))
        signs = np.flatnonzero((_CLASS[raw] == 48) | (raw == 64))  # each base span has a digit or an @
        some = np.diff(np.searchsorted(signs, at)) > 0
        for k in range(j - i):
            if not some[k] and k not in more:
                rows.append(nothing)
                continue
            own = raw[at[k] : at[k + 1]]
            base = base_spans(own.tobytes().decode()) if some[k] else []
            found = list(base)
            if k in more:
                points = np.append(0, np.cumsum((own & 0xC0) != 0x80))
                for kind, a, b in more[k]:
                    x, y = int(points[a]), int(points[b])
                    if not any(x < q and p < y for _, p, q in base):
                        found.append((kind, x, y))
            text_of = lambda spans: [f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.index(s[0]), s[1]))]
            base_text = text_of(base)
            row = {f"n_{kind}": sum(s[0] == kind for s in base) for kind in BASE_KINDS}
            rows.append(row | {"base_spans": base_text, "spans": text_of(found), "base_sha256": hashlib.sha256(",".join(base_text).encode()).hexdigest()})
    return rows


def find(docs: DataFrame, name: str = "pii", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """``docs`` and, as its last column, a struct of type ``FOUND``; one pass, no shuffle.

    Each row is judged by its own text, so repeated rows have equal results and a
    very long text is one row's work.  A null or empty text has no spans.  If
    ``docs`` has a column ``name``, it stays and the new one gets underscores
    before its name.
    """
    model = model or train()
    return common.append_struct(docs, lambda b: batch(b.column(0).cast(pa.string()), model), [text_col], FOUND, name)

"""Licence scan: an Aho-Corasick automaton over words, and a parser of licence expressions.

Texts become sequences of lower-cased words (runs of letters, digits and
characters beyond ASCII).  One automaton finds all notice phrases and the
identifier tag where their words stand consecutively, overlapping ones too.
What stands in the line after a tag is a licence expression; a shunting-yard
parser puts it in postfix order (``with`` binds before ``and`` before ``or``)
and evaluates it: of alternatives the most permissive holds, of joint terms
the least, and an exception eases its licence.

All phrases have a word that is rare in prose.  Texts without any such word
have no phrase and are only counted.  A null or empty text has no words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as common
from . import words

# Phrases and labels of the base scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 2": "lgpl-2",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license version 2": "epl-2",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc",
    "cc0 1 0 universal": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "unlicense org": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: A word of each phrase that is rare in prose.
ANCHORS = ["mit", "apache", "cc", "gnu", "mozilla", "eclipse", "bsd", "isc", "cc0", "unlicense", "reserved", "spdx"]
#: How freely a text may be used: 1 for any use with notice, 0 for none.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.9,
    "mpl-2": 0.7, "epl-2": 0.7, "lgpl-2": 0.6, "lgpl-3": 0.6, "cc-by-sa": 0.5, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
#: The freedom of a text without any finding, and of a licence that is not listed.
UNKNOWN = 0.5
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_REST = re.compile(r"[ \t]*:[ \t]*([A-Za-z0-9.+:() \t-]+)")


def label_of(identifier: str) -> str:
    """The label of a licence identifier: lower case, no minor version, no "only" or "or later"."""
    out = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    if out.startswith("cc"):
        return re.sub(r"-[0-9.]+$", "", out)
    return re.sub(r"\.[0-9.]+$", "", out)


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, by the shunting-yard method; None if it isn't one."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # the token before ended an operand
    for token in _TOKEN.findall(expression):
        word = token.upper()
        if word in _BINDS:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = False
        elif token == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operand:
            return None
        elif token == "(":
            waiting.append(token)
        else:
            out.append(token)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def leading(text: str) -> str:
    """The expression that a line begins with: it ends before a word that can't continue it."""
    operand, end = False, 0
    for m in _TOKEN.finditer(text):
        token = m[0].upper()
        if operand != (token in _BINDS or token == ")"):
            break
        operand = token not in _BINDS and token != "("
        end = m.end()
    return text[:end].rstrip(".")


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels of an expression and its freedom; None if it isn't one."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token in _BINDS:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if token == "WITH":  # what stands on its right names an exception
                stack.append((a, (x + 1) / 2))
            else:
                stack.append((a | b, max(x, y) if token == "OR" else min(x, y)))
        else:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:  # texts without an anchor are not scanned
        if not set(phrase.split()) & set(ANCHORS):
            raise ValueError(f"no anchor in {phrase!r}")
    for phrase in [*BASE, *NOTICES, TAG]:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


@lru_cache(maxsize=1)
def _anchors() -> np.ndarray:
    folded = np.frombuffer("\0".join(ANCHORS).encode(), dtype=np.uint8)
    return np.sort(words.hashes(folded, *words.spans(folded, np.array([0, len(folded)]))))


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"


def _scan(text: bytes, found: list[bytes], places: np.ndarray) -> dict:
    """Findings in a text; ``found``: its words, ``places``: byte after each of them."""
    joined = " " + b" ".join(found).decode() + " "
    starts: list[int] = []
    base: list[int] = []
    labels, base_labels, score = set(), set(), 1.0
    for end, phrase in automaton().iter(joined):
        if not starts:
            at = 1
            for w in found:
                starts.append(at)
                at += len(w.decode()) + 1
        word = bisect_left(starts, end - len(phrase))
        if phrase in BASE:
            base.append(word)
            base_labels.add(BASE[phrase])
            labels.add(BASE[phrase])
            score = min(score, FREEDOM[BASE[phrase]])
        elif phrase == TAG:
            rest = _REST.match(text[places[word + 2] :].split(b"\n", 1)[0].decode("utf-8", "replace"))
            value = evaluate(leading(rest[1])) if rest else None
            if value:
                labels |= value[0]
                score = min(score, value[1])
        else:
            labels.add(NOTICES[phrase])
            score = min(score, FREEDOM[NOTICES[phrase]])
    return {"n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None), "base_labels": sorted(base_labels), "labels": sorted(labels), "score": score if labels else UNKNOWN}


_NOTHING = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "score": UNKNOWN}


def batch(column: pa.Array) -> list[dict]:
    data, offsets = common.raw_texts(column)
    whole = np.frombuffer(data, dtype=np.uint8)
    rows: list[dict] = []
    for i, j in common.chunks(offsets):
        raw, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        folded = words.ALNUM[raw]
        starts, ends = words.spans(folded, at)
        first = words.per_text(starts, at)
        marked = np.flatnonzero(np.isin(words.hashes(folded, starts, ends), _anchors()))
        some = set((np.searchsorted(first, marked, side="right") - 1).tolist())
        for k, n in enumerate(np.diff(first).tolist()):
            row = _NOTHING
            if k in some:
                own = slice(first[k], first[k + 1])
                text = folded[at[k] : at[k + 1]].tobytes()
                a, b = (starts[own] - at[k]).tolist(), ends[own] - at[k]
                row = _scan(raw[at[k] : at[k + 1]].tobytes(), [text[x:y] for x, y in zip(a, b.tolist(), strict=True)], b)
            rows.append({"n_words": n} | row)
    return rows


def scan(docs: DataFrame, name: str = "licenses", text_col: str = "text") -> DataFrame:
    """``docs`` and, as its last column, a struct of type ``FOUND``; one pass, no shuffle.

    Each row is judged by its own text, so repeated rows have equal results and a
    very long text is one row's work.  If ``docs`` has a column ``name``, it
    stays and the new one gets underscores before its name.
    """
    return common.append_struct(docs, lambda b: batch(b.column(0).cast(pa.string())), [text_col], FOUND, name)

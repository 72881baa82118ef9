"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
``://`` and cue words for accounts and secrets. From each anchor a local
parser expands to the left and right to the boundaries of one kind of item and
validates it. A parser never looks at a character more than a few times, so a
text costs time in proportion to its length; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import bounded_batches, text_of

# Fixed value: the kinds in their order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]

# Cue words in lower case.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@\"'<>]++@[A-Za-z0-9.-]++(?::[0-9]++)?(?:[/?#][^\s\"'<>]*+)?")
_ACCOUNT = re.compile(r"(?:[ ](?:no|nr|number|id))?[ .:#=]{0,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])", re.ASCII)
_SECRET = re.compile(r"[ ]{0,2}[:=][ ]{0,2}(?:\"([^\"\s]{8,})\"|'([^'\s]{8,})'|([A-Za-z0-9_./+=-]{8,}))", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, (1, "digit"))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(word, (len(word), kind))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                found.add_word(form, (len(form), kind))
    found.make_automaton()
    return found


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. Matches of
    one kind don't overlap; one that fails its validation uses up its
    characters."""
    out = []
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for last, (size, anchor) in automaton.iter(text):
        i = last - size + 1
        if anchor == "digit":
            if i >= free["ip"]:
                if m := _IP.match(text, i):
                    free["ip"] = m.end()
                    if all(map(_octet, m.groups())):
                        out.append(("ip", i, m.end()))
                else:
                    free["ip"] = _DIGITS.match(text, i).end()
            if i >= free["card"] and (m := _CARD.match(text, i)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", i, m.end()))
        elif anchor == "plus":
            if i >= free["phone"] and (m := _PHONE.match(text, i)):
                free["phone"] = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", i, m.end()))
        elif anchor == "at":
            start = i
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, i + 1)):
                free["email"] = m.end()
                out.append(("email", start, m.end()))
        elif anchor == "scheme":
            start = i
            while start > free["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < i and (m := _USERINFO.match(text, last + 1)):
                free["url"] = m.end()
                out.append(("url", start, m.end()))
        else:
            whole_word = i == 0 or not text[i - 1].isalnum()
            m = (_ACCOUNT if anchor == "account" else _SECRET).match(text, last + 1) if whole_word else None
            if m and m.start(m.lastindex) >= free[anchor]:
                start, end = m.span(m.lastindex)
                if anchor == "secret" or sum(c.isdigit() for c in text[start:end]) >= 5:
                    free[anchor] = end
                    out.append((anchor, start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = "array<struct<kind: string, start: int, end: int>>"
_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row: an array of (kind, start, end) in code points,
    end exclusive, by start and then kind (``KINDS``).

    The base kinds are email, ip, card and phone by their patterns, leftmost
    and non-overlapping within a kind; added are URLs with user names, account
    numbers after a cue word, and values set to secret names. A null or empty
    text has no spans; a null id passes through; repeated rows come out as
    often; an empty table gives no rows. Other columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            own = [spans(t, automaton) for t in batch.column(1).to_pylist()]
            values = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in one] for one in own], pa.list_(_SPAN_TYPE))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "spans"])

    chosen = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return chosen.mapInArrow(find, f"doc_id long, spans {_SPAN}")


def written(spans_col: str = "spans", kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    own = F.filter(spans_col, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, spans_col: str = "spans") -> Column:
    return F.size(F.filter(spans_col, lambda s: s["kind"] == kind)).cast("long")

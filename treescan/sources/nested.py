"""Nested tree documents, {properties, sourceRange, children} with keys in any order, read without recursion.

A document is a stream of bracket events: an object opens a node, its end closes it, and a stack of open nodes says whose
child comes next. What a node holds besides its children is read as plain JSON and kept as the text it was.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa

NODE = "tu string, node_id string, parent_id string, ordinal long, depth long, path array<int>, bag string, range string, reason string"
_blank = re.compile(r"[ \t\n\r]*").match
#: A key without escapes, up to its value; the begin of an object or array, and its end if it is empty; what follows a
#: value in an object and in an array.
_key = re.compile(r'[ \t\n\r]*"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*').match
_object, _array = (re.compile(rf"[ \t\n\r]*\{a}[ \t\n\r]*(\{b}?)").match for a, b in ("{}", "[]"))
_in_object, _in_array = (re.compile(rf"[ \t\n\r]*([,\{b}]?)[ \t\n\r]*").match for b in "}]")
#: Nodes of a batch, and characters from which a document is read twice: first whether it is JSON, then its nodes.
BATCH, LARGE = 10_000, 1 << 22
#: Characters from which a document that comes in pieces is read as they come, and that are held of it at a time.
WINDOW = 1 << 20
#: Characters before the end of what is held that may belong to a longer token.
MARGIN = 16


def _refuse(name: str) -> None:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_refuse).raw_decode


class _Cut(Exception):
    """The text may go on in the next piece."""


def _taken(pieces: Iterator[str], length: int) -> tuple[str, bool]:
    """At least so many characters of the pieces, and whether there may be more."""
    got, n = [], 0
    for piece in pieces:
        got.append(piece)
        n += len(piece)
        if n >= length:
            return "".join(got), True
    return "".join(got), False


def nodes_of(pieces: Iterable[str], window: int | None = None) -> Iterator[tuple[int, int, list[int], str | None, str | None]]:
    """(number, number of the parent or -1, ordinals of the open nodes down to this one, properties, range), each node when
    it ends, of a document in pieces that are cut anywhere. The list is reused for the next node. Of the text a window is
    held, and a value that is longer; an open node costs about 80 bytes and its own text. Raises ValueError for what is no
    JSON."""
    window = WINDOW if window is None else window
    numbers, ordinals, children = array("q"), [], array("q")
    # texts of the open nodes, one after the other; where a node's begin; and where its properties and range do and end, or 0;
    # of a document that is here as a whole, the places in its text
    held, begins, places, none = bytearray(), array("q"), array("q"), array("q", [0] * 4)
    pieces, number, state = iter(pieces), 0, "node"
    text, more = _taken(pieces, 2 * window)
    whole, at = not more, 0
    while True:
        if more and len(text) - at < window:
            rest, more = _taken(pieces, window)
            text, at = text[at:] + rest, 0
        try:
            if state == "node":
                parent, ordinal = (numbers[-1], children[-1]) if numbers else (-1, 0)
                found = _object(text, at)
                if found:
                    sign, then = found[1], found.end()
                    if not sign and then == len(text):
                        raise _Cut
                    if numbers:
                        children[-1] += 1
                    ordinals.append(ordinal)
                    if sign:
                        yield number, parent, ordinals, None, None
                        ordinals.pop()
                        at, state = then, "ended"
                    else:
                        numbers.append(number)
                        children.append(0)
                        places.extend(none)
                        begins.append(len(held))
                        at, state = then, "member"
                else:  # something else in a node's place has neither properties nor children
                    _, then = _decode(text, _blank(text, at).end())
                    if more and len(text) - then < MARGIN:
                        raise _Cut
                    if numbers:
                        children[-1] += 1
                    ordinals.append(ordinal)
                    yield number, parent, ordinals, None, None
                    ordinals.pop()
                    at, state = then, "ended"
                number += 1
            elif state == "member":
                found = _key(text, at)
                if found:
                    key, then = found[1], found.end()
                else:
                    at = _blank(text, at).end()
                    if text[at : at + 1] != '"':
                        raise json.JSONDecodeError("no key", text, at)
                    key, then = _decode(text, at)
                    then = _blank(text, then).end()
                    if text[then : then + 1] != ":":
                        raise json.JSONDecodeError("no value", text, then)
                    then = _blank(text, then + 1).end()
                found = _array(text, then) if key == "children" else None
                if found:
                    sign, then = found[1], found.end()
                    if not sign and then == len(text):
                        raise _Cut
                    at, state = then, "valued" if sign else "node"
                else:
                    begin = then
                    _, then = _decode(text, begin)
                    if more and len(text) - then < MARGIN:
                        raise _Cut
                    k = -4 if key == "properties" else -2 if key == "sourceRange" else 0
                    if whole:
                        if k:
                            places[k], places[k + 1] = begin, then
                    elif k:
                        places[k] = len(held)
                        held += text[begin:then].encode()
                        places[k + 1] = len(held)
                    at, state = then, "valued"
            elif state == "valued":
                found = _in_object(text, at)
                sign, then = found[1], found.end()
                if sign == ",":
                    at, state = then, "member"
                elif sign == "}":
                    own, (b0, b1, r0, r1) = numbers.pop(), places[-4:]
                    if whole:
                        yield own, numbers[-1] if numbers else -1, ordinals, text[b0:b1] if b1 else None, text[r0:r1] if r1 else None
                    else:
                        yield own, numbers[-1] if numbers else -1, ordinals, held[b0:b1].decode() if b1 else None, held[r0:r1].decode() if r1 else None
                    ordinals.pop()
                    children.pop()
                    del places[-4:], held[begins.pop() :]
                    at, state = then, "ended"
                else:
                    raise json.JSONDecodeError("no end of an object", text, then)
            else:
                if not numbers:
                    at = _blank(text, at).end()
                    if at < len(text):
                        raise ValueError(f"more after the end at {at}")
                    if not more:
                        return
                    raise _Cut
                found = _in_array(text, at)
                sign, then = found[1], found.end()
                if sign == ",":
                    at, state = then, "node"
                elif sign == "]":
                    at, state = then, "valued"
                else:
                    raise json.JSONDecodeError("no end of an array", text, then)
        except (_Cut, json.JSONDecodeError) as e:
            # what has begun at this place is read again with more text, if that may help
            if isinstance(e, json.JSONDecodeError) and (not more or not e.msg.startswith("Unterminated string") and e.pos < len(text) - MARGIN):
                raise
            if not more:
                raise ValueError("no end") from None
            rest, more = _taken(pieces, max(window, len(text) - at))
            text, at = text[at:] + rest, 0


_NAMES = [c.split()[0] for c in NODE.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string()]


def _row(tu: str, node: tuple, paths: bool) -> tuple:
    number, parent, ordinals, bag, place = node
    if paths:
        name, path = ".".join(map(str, ordinals)), tuple(ordinals)
        up = name.rpartition(".")[0] or None
    else:
        name, path, up = str(number), None, None if parent < 0 else str(parent)
    return tu, name, up, ordinals[-1], len(ordinals) - 1, path, bag, place, None


def _batch(rows: list[tuple], *more: str) -> pa.RecordBatch:
    names, kinds = [*_NAMES, *more], [*_KINDS, *[pa.string()] * len(more)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(list(zip(names, kinds, strict=True))))


def _rejected(tu: str) -> tuple:
    return tu, *[None] * (len(_NAMES) - 2), "not JSON"


def read_nodes(paths: bool):
    """Rows (tu, value) to rows of NODE: nodes, or one row with a reason. Ids are the ordinals from the root down, with
    dots, or without paths the numbers of nodes in the order of the document. A batch holds the nodes of many small
    documents; of a large one, no more than a batch and what is open is held besides its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for tu, value in zip(batch.column("tu"), batch.column("value"), strict=True):
                tu, text, kept = tu.as_py(), value.as_py(), len(rows)
                try:
                    if text is None:
                        raise ValueError("null")
                    if len(text) < LARGE:
                        rows.extend(_row(tu, node, paths) for node in nodes_of([text]))
                    else:
                        for _ in nodes_of([text]):
                            pass
                        for node in nodes_of([text]):
                            rows.append(_row(tu, node, paths))
                            if len(rows) >= BATCH:
                                yield _batch(rows)
                                rows.clear()
                except (ValueError, RecursionError):
                    del rows[kept:]
                    rows.append(_rejected(tu))
                while len(rows) >= BATCH:
                    yield _batch(rows[:BATCH])
                    del rows[:BATCH]
        if rows:
            yield _batch(rows)

    return read


def read_pieces(paths: bool, window: int | None = None):
    """Rows (tu, root_id, text), the pieces of a document one after the other, to rows of NODE and root_id, as read_nodes
    gives them. A document of more than a window of characters is read as it comes; if it turns out to be no JSON, its
    nodes up to there are given before the row with the reason, and the caller must drop them."""
    window = WINDOW if window is None else window

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        each = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("tu", "root_id", "text")), strict=True))
        for (tu, root), group in groupby(each, key=itemgetter(0, 1)):
            texts, kept = (text or "" for _, _, text in group), len(rows)
            first, more = _taken(texts, window)
            try:
                if more:
                    for node in nodes_of(chain([first], texts), window):
                        rows.append((*_row(tu, node, paths), root))
                        if len(rows) >= BATCH:
                            yield _batch(rows, "root_id")
                            rows.clear()
                else:
                    rows.extend((*_row(tu, node, paths), root) for node in nodes_of([first]))
            except (ValueError, RecursionError):
                if not more:
                    del rows[kept:]
                rows.append((*_rejected(tu), root))
            while len(rows) >= BATCH:
                yield _batch(rows[:BATCH], "root_id")
                del rows[:BATCH]
        if rows:
            yield _batch(rows, "root_id")

    return read

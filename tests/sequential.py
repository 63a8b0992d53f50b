"""Plain sequential versions of the rules, to test the Spark forms against."""

from __future__ import annotations

import re

from spanlake.functions.inventory import COARSE_TYPES


def cut(tag):
    prefix, hyphen, kind = tag.partition("-")
    return prefix, ("" if not hyphen or kind == "0" else kind)


def ends(prev, cur):
    (p, pt), (c, ct) = cut(prev), cut(cur)
    if p + c in ("BB", "BO", "IB", "IO", "EE", "EI", "EO") or p in ("[", "]"):
        return True
    return p not in ("O", ".") and pt != ct


def starts(prev, cur):
    (p, pt), (c, ct) = cut(prev), cut(cur)
    if p + c in ("BB", "IB", "OB", "OI", "EE", "EI", "OE") or c in ("[", "]"):
        return True
    return c not in ("O", ".") and pt != ct


def side(tags):
    """Of one side of a sentence: kinds of the tags, places of chunk starts and of ends before a place."""
    pairs = list(enumerate(zip(["O", *tags], [*tags, "O"])))
    return (
        [cut(tag)[1] for tag in [*tags, "O"]],
        {at for at, (prev, cur) in pairs if starts(prev, cur)},
        {at for at, (prev, cur) in pairs if ends(prev, cur)},
    )


def count(sentences):
    """Counts per type and overall: gold, guessed, correct.

    Two chunks are in step from a place where both start with one kind up to the first
    place where a side ends or the kinds part. Both are correct if both end there.
    """
    table = {"(overall)": [0, 0, 0]}

    def add(kinds, column):
        for kind in kinds:
            for key in (kind, "(overall)"):
                table.setdefault(key, [0, 0, 0])[column] += 1

    for sentence in sentences:
        (kinds, begin, stop), (kinds2, begin2, stop2) = (side([pair[k] for pair in sentence]) for k in (0, 1))
        add((kinds[at] for at in begin), 0)
        add((kinds2[at] for at in begin2), 1)
        parted = sorted(stop | stop2 | {at for at in range(len(kinds)) if kinds[at] != kinds2[at]})
        in_step = [at for at in begin & begin2 if kinds[at] == kinds2[at]]
        breaks = {next((at for at in parted if at > first), None) for first in in_step}
        add((kinds[at - 1] for at in breaks if at in stop and at in stop2), 2)
    return {k: tuple(v) for k, v in table.items()}


def spans(tags):
    """Chunks of one sentence as (start, end, type), positions from 1."""
    out, tags = [], ["O", *tags, "O"]
    for i in range(1, len(tags) - 1):
        if starts(tags[i - 1], tags[i]):
            j = i
            while not ends(tags[j], tags[j + 1]) and tags[j + 1] != "O" and not starts(tags[j], tags[j + 1]):
                j += 1
            out.append((i, j, cut(tags[i])[1]))
    return out


def mentions(tokens):
    """Mentions of one sentence of (token, pos, tag) triples: a valid B and the I after it."""
    def letter(tag):
        valid = tag[:1] != "B" or tag[2:].split(".")[0] in COARSE_TYPES
        return tag[:1] if valid and tag[:1] in ("B", "I") else "."

    out = []
    for found in re.finditer("BI*", "".join(letter(tag) for *_, tag in tokens)):
        words, pos, tags = zip(*tokens[found.start() : found.end()])
        subtype = tags[0][2:]
        text = " ".join(words)
        out.append((found.start() + 1, subtype.split(".")[0], subtype, text, " ".join(pos), len(words), len(text)))
    return out

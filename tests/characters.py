"""Text repair as walks over characters, to test the expressions against."""

from __future__ import annotations

from spanlake.functions.inventory import HYPHEN_PRONOUNS, LABELS


def capital(char):
    return "A" <= char <= "Z" and len(char) == 1


def escape_once(text):
    out = []
    for at, char in enumerate(text):
        if char == "<":
            begin = at + 1 + text.startswith("/", at + 1)
            end = begin
            while end < len(text) and not text[end].isspace() and text[end] not in "<>":
                end += 1
            bracket_next = text.startswith("<", end)
            if not bracket_next and text[begin:end] not in LABELS:
                char = "*"
        out.append(char)
    return "".join(out)


def unwrap(text):
    out = []
    for at, char in enumerate(text):
        if char == "\n":
            before, after = text[:at], text[at + 1 : at + 2]
            quoted = before.endswith("»") and before[:-1][-2:].rstrip()[-1:] == "." and before[-2:-1] != "»"
            sentence = before.endswith((".", "!", "?")) or (quoted and (before[-2] == "." or before[-2].isspace()))
            char = "\n" if sentence or capital(before[-1:]) or capital(after) else " "
        out.append(char)
    return "".join(out)


def break_sentences(text):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end].isspace():
            end += 1
        if end == at:
            out.append(text[at])
            at += 1
            continue
        run, after = text[at:end], text[end : end + 1]
        if at and text[at - 1] in ".!?":
            lower = "a" <= after <= "z" or after == "<"
            run = "\n" if not lower else "\n" + run[-1] if len(run) > 1 else run
        out.append(run)
        at = end
    return "".join(out)


def word(char):
    return char.isalnum() or char == "_"


def join_halves(text):
    out, at = [], 0
    while at < len(text):
        after = text[at + 2 : at + 3]
        if text.startswith("- ", at) and at and word(text[at - 1]) and after and word(after):
            end = at + 2
            while end < len(text) and word(text[end]):
                end += 1
            half = text[at + 2 : end]
            out.append("-" + half if half in HYPHEN_PRONOUNS else half)
            at = end
        else:
            out.append(text[at])
            at += 1
    return "".join(out)

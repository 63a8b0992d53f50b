"""Text repair as column expressions.

Patterns use ``(?U)`` so that classes follow Unicode; ``WS`` adds the four
separator controls that count as whitespace in the corpus format.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from spanlake.functions.inventory import HYPHEN_PRONOUNS, LABELS

WS = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|\r|\n"
SENTENCE_END = (".", "!", "?")
TOKEN = r"(?U)(\p{L}++['’]|[\p{L}\p{N}]++(?:-[\p{L}\p{N}]++)*+|[^\s\x1c-\x1f])"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where it is used within a lambda."""
    return F.transform(F.array(value), use)[0]


def strip_ws(col: Column) -> Column:
    """Trim every kind of whitespace (``trim`` only removes the space).

    The lookbehind keeps long runs of whitespace inside the text linear.
    """
    return F.regexp_replace(col, rf"(?U)\A{WS}++|(?<!{WS}){WS}++\z", "")


def squash(col: Column) -> Column:
    """Whitespace runs to one space, edges trimmed."""
    return F.trim(F.regexp_replace(col, rf"(?U){WS}+", " "))


def has_text(col: Column) -> Column:
    """Anything but whitespace."""
    return col.rlike(r"(?U)[^\s\x1c-\x1f]")


def clean_lines(col: Column) -> Column:
    """Strip each line; drop blank lines and image references.

    Most lines begin and end with a character that is no white space, and need no pattern.
    """

    def stripped(line: Column) -> Column:
        bare = F.left(line, F.lit(1)).between("!", "~") & _last(line, 1).between("!", "~")
        return F.when(bare, line).otherwise(strip_ws(line))

    def split(text: Column) -> Column:
        return F.when(text.contains("\r"), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))

    lines = F.transform(bound(col, split), stripped)
    kept = F.filter(lines, lambda x: (x != "") & ~x.endswith(".png"))
    return F.array_join(kept, "\n")


def escape_unknown_tags(col: Column, labels: Sequence[str] = LABELS) -> Column:
    """Replace the ``<`` of tags outside the inventory by ``*``.

    Two passes: the first can uncover a tag name that another ``<`` was hiding.
    """
    end = rf"(?:{WS}|>|$)"
    known = "|".join(re.escape(x) for x in labels)
    pattern = rf"(?U)<(?=/?[^<]*?{end})(?!/?(?:{known}){end})"

    def escaped(text: Column) -> Column:
        return F.regexp_replace(text, pattern, "*")

    # What the first pass leaves as it is the second one does too.
    return bound(col, lambda text: bound(escaped(text), lambda once: F.when(once == text, once).otherwise(escaped(once))))


def _last(col: Column, n: int) -> Column:
    return F.right(col, F.lit(n))


def _ends_line(line: Column, above: Column) -> Column:
    """A line that a newline must follow: its end is a sentence's, or a capital.

    A closing quote may stand behind the full stop, and one white space between them,
    which can be the line break ``above`` ends with.
    """
    inner = F.substr(line, F.lit(1), F.length(line) - 1)
    stop = _last(inner, 1)
    spaced = stop.rlike(rf"(?U)^{WS}$") & (_last(F.substr(inner, F.lit(1), F.length(inner) - 1), 1) == ".")
    alone = (line == "»") & (_last(above, 1) == ".")
    quoted = (_last(line, 1) == "»") & ((stop == ".") | spaced)
    return _last(line, 1).isin(*SENTENCE_END) | is_capital(_last(line, 1)) | quoted | alone


def is_capital(char: Column) -> Column:
    return char.between("A", "Z") & (F.length(char) == 1)


def unwrap_lines(col: Column) -> Column:
    """Newline to space, except after a sentence end or around a capital.

    Decided line by line: each line but the first is put behind a newline or a space.
    """
    lines = F.split(col, "\n", -1)
    near = F.arrays_zip(
        F.concat(F.array(F.lit("")), lines).alias("above"), lines.alias("line"),
        F.slice(lines, F.lit(2), F.size(lines)).alias("below"),
    )

    def end(x: Column) -> Column:
        stays = _ends_line(x["line"], x["above"]) | is_capital(F.left(x["below"], F.lit(1)))
        return F.concat(x["line"], F.when(x["below"].isNull(), "").when(stays, "\n").otherwise(" "))

    return F.array_join(F.transform(near, end), "")


def break_after_punct(col: Column) -> Column:
    """White space after ``. ! ?`` to a newline, as far as what follows it allows.

    ``a-z`` and ``<`` go on with the sentence: then the run of white space gives its
    last character back and the rest of it, if any, is the break. The text is cut behind
    those marks alone; every piece but the first begins with such a run.
    """
    pieces = F.split(col, rf"(?U)(?<=[{''.join(SENTENCE_END)}])(?={WS})", -1)

    def decided(piece: Column, number: Column) -> Column:
        body = F.regexp_replace(piece, rf"(?U)\A{WS}++", "")
        run = F.length(piece) - F.length(body)
        goes_on = F.left(body, F.lit(1)).between("a", "z") | body.startswith("<")
        return (
            F.when(number == 0, piece)
            .when(~goes_on, F.concat(F.lit("\n"), body))
            .when(run > 1, F.concat(F.lit("\n"), F.substr(piece, run)))
            .otherwise(piece)
        )

    return F.array_join(F.transform(pieces, decided), "")


def dehyphenate(col: Column, keep: Sequence[str] = HYPHEN_PRONOUNS) -> Column:
    """Join ``half- word``; keep the hyphen before the listed pronouns."""
    pronoun = "|".join(re.escape(x) for x in keep)

    def joined(text: Column) -> Column:
        inverted = F.regexp_replace(text, rf"- (?<={WORD}- )(?=(?:{pronoun})(?!{WORD}))", "-")
        return F.regexp_replace(inverted, rf"- (?<={WORD}- )(?={WORD})", "")

    return bound(col, lambda text: F.when(text.contains("- "), joined(text)).otherwise(text))


def repair(col: Column) -> Column:
    """The three line repairs in their required order."""
    return dehyphenate(break_after_punct(unwrap_lines(col)))


def upper_majority(col: Column) -> Column:
    """Strictly more uppercase than lowercase characters."""
    return F.regexp_count(col, F.lit(r"\p{IsUppercase}")) > F.regexp_count(
        col, F.lit(r"\p{IsLowercase}")
    )


def starts_lower(col: Column) -> Column:
    return col.rlike(r"^\p{IsLowercase}")


def ends_terminal(col: Column) -> Column:
    """Ends in sentence punctuation or an ASCII capital."""
    return col.rlike(r"[.!?A-Z]$")


def _references() -> dict[str, str]:
    """Named references: the predefined five and those of the Latin-1 characters."""
    names = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
    return names | {name: chr(n) for name, n in name2codepoint.items() if 160 <= n <= 255}


def decode_references(col: Column) -> Column:
    """Decode decimal, hexadecimal and named character references, each once.

    What stands for no character (unknown names, numbers beyond Unicode) stays as it is.
    """
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+[0-9]*);"
    names = F.create_map(*(F.lit(x) for pair in _references().items() for x in pair))

    def character(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2), F.length(ref) - 2)
        digits = F.regexp_extract(body, "^#[xX]?(.*)$", 1)
        number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        coded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.coalesce(F.when(body.startswith("#"), F.when(valid, coded)).otherwise(F.try_element_at(names, body)), ref)

    refs = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), character)
    plain = F.split(col, pattern, -1)
    decoded = F.array_join(F.zip_with(plain, refs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(col.contains("&"), decoded).otherwise(col)


def tokens_of(col: Column) -> Column:
    """Default tokeniser: elided prefix, hyphenated word, or single symbol."""
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(1))


def token_shape(col: Column) -> Column:
    """One-letter shape of a token: capital, lower, digit or other.

    Most tokens begin with an ASCII letter or digit and need no pattern.
    """
    first = F.left(col, F.lit(1))
    return (
        F.when(first.between("a", "z"), "x")
        .when(first.between("A", "Z"), "X")
        .when(first.between("0", "9"), "d")
        .when(col.rlike(r"^\p{Lu}"), "X")
        .when(col.rlike(r"^\p{Ll}"), "x")
        .when(col.rlike(r"^\p{N}"), "d")
        .otherwise("p")
    )

"""Markup that does not nest, put right as column expressions.

An opening tag and a closing one of its name right behind it change nothing for the tags around
them, so such pairs are taken out by pattern first, ``PASSES`` times, the innermost ones at each.
Both expressions then fold the tags that are left over the annotations that are open. These are kept
as one string, each name behind a ``>`` (which no name holds), the last opened at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanlake.functions.text import bound

# A tag, its attribute values quoted.
TAG = r"""<[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
TAG_NAME = r"^</?([^\s/>]+)"

MARK = ">"
# Tags that are folded into one string before it joins the others: appending to a string or
# an array copies it, so neither may grow with every tag.
CHUNK = 64


# What is known of a tag without its attributes: the ``/`` of a closing one, and its name.
HEAD = r"(?=<(/?+)([^\s/>]*+))"
PASSES = 4


def _tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(0))


def _is_empty(tag: Column) -> Column:
    """A tag that neither opens nor closes anything."""
    return tag.endswith("/>") & ~tag.startswith("</")


def _without_pairs(heads: Column, rest: str = "") -> Column:
    """Heads of tags, ``name>`` or ``/name>`` with ``rest`` behind the name, less the pairs that nest."""
    for _ in range(PASSES):
        heads = F.regexp_replace(heads, rf"(?<![^>])([^/> ]*+){rest}>/\1{rest}>", "")
    return heads


def _heads(joined: Column) -> Column:
    heads = F.split(joined, MARK, -1)
    return F.slice(heads, F.lit(1), F.size(heads) - 1)


def _without_end(text: Column, end: Column) -> Column:
    return F.substr(text, F.lit(1), F.length(text) - F.length(end))


def _chunks(items: Column) -> Column:
    """The items, one at least, in arrays of ``CHUNK``."""
    last = F.ceil(F.size(items) / F.lit(CHUNK)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def nests(text: Column) -> Column:
    """Every closing tag closes the annotation opened last, and none stays open."""
    tags = _tags(text)
    tags = F.when(text.contains("/>"), F.filter(tags, lambda tag: ~_is_empty(tag))).otherwise(tags)
    heads = F.regexp_replace(F.array_join(tags, ""), HEAD + TAG, f"$1$2{MARK}")

    def step(state: Column, head: Column) -> Column:
        closing = head.startswith("/")
        name = F.concat(F.lit(MARK), F.when(closing, F.substr(head, F.lit(2))).otherwise(head))
        closes = closing & state["opened"].endswith(name)
        opened = F.when(~closing, F.concat(state["opened"], name)).otherwise(_without_end(state["opened"], name))
        # After the first fault nothing more is kept.
        sound = state["sound"] & (~closing | closes)
        return F.struct(F.when(sound, opened).otherwise("").alias("opened"), sound.alias("sound"))

    def fold(left: Column) -> Column:
        start = F.struct(F.lit("").alias("opened"), F.lit(True).alias("sound"))
        sound = F.aggregate(_heads(left), start, step, lambda state: state["sound"] & (state["opened"] == ""))
        return F.when(left == "", True).otherwise(sound)

    return bound(_without_pairs(heads), fold)


def _closing(names: Column) -> Column:
    """Closing tags of ``a>b>c>``, the last one first."""
    each = F.split(names, MARK, -1)
    each = F.reverse(F.slice(each, F.lit(1), F.size(each) - 1))
    return F.array_join(F.transform(each, lambda name: F.concat(F.lit("</"), name, F.lit(">"))), "")


def put_right(text: Column) -> Column:
    """The text with every annotation closed once, in order.

    A closing tag that matches an open annotation closes all that were opened after it
    as well; one that matches none is left out; what is open at the end closes there.
    """
    parts = F.struct(_tags(text).alias("tags"), F.split(text, TAG, -1).alias("plain"))
    return bound(parts, lambda x: _put_right(x["tags"], x["plain"]))


def _put_right(tags: Column, plain: Column) -> Column:
    """``put_right`` of a text's tags and of what stands around them."""
    # Each tag with the text after it; the heads of those that open or close with their place.
    pieces = F.transform(tags, lambda tag, i: F.concat(tag, F.get(plain, i + 1)))
    heads = F.array_join(
        F.transform(
            tags,
            lambda tag, i: F.when(_is_empty(tag), "").otherwise(
                F.concat(F.regexp_replace(tag, f"(?s)^{HEAD}.*$", "$1$2 "), i.cast("string"), F.lit(MARK))
            ),
        ),
        "",
    )
    left = F.struct(_heads(_without_pairs(heads, r" \d++")).alias("left"), pieces.alias("pieces"))
    return bound(left, lambda x: _folded(x["left"], x["pieces"], tags, plain))


def _folded(left: Column, pieces: Column, tags: Column, plain: Column) -> Column:
    """The text put right; only the tags ``left`` are folded, the others belong to the text after them."""

    def place(head: Column) -> Column:
        return F.substring_index(head, " ", -1).cast("int")

    def until(first: Column, nth: Column) -> Column:
        """The pieces from ``first`` up to the tag that is left as ``nth``, or to the end."""
        end = F.when(nth < F.size(left), place(F.get(left, nth))).otherwise(F.size(pieces))
        return F.array_join(F.slice(pieces, first + 1, end - first), "")

    def item(head: Column, nth: Column) -> Column:
        closing = head.startswith("/")
        name = F.substring_index(head, " ", 1)
        at = place(head)
        return F.struct(
            F.get(tags, at).alias("tag"),
            F.when(closing, F.substr(name, F.lit(2))).otherwise(name).alias("name"),
            F.when(closing, -1).otherwise(1).alias("turn"),
            F.concat(F.get(plain, at + 1), until(at + 1, nth + 1)).alias("after"),
        )

    items = F.transform(left, item)
    before = F.concat(F.get(plain, F.lit(0)), until(F.lit(0), F.lit(0)))

    chunks = bound(items, _chunks)

    def step(state: Column, x: Column) -> Column:
        opened = F.concat(state["opened"], F.lit(MARK))
        name = F.concat(F.lit(MARK), x["name"], F.lit(MARK))
        known = opened.contains(name)
        inner = F.call_function("substring_index", opened, name, F.lit(-1))  # opened after it
        outer = F.substr(opened, F.lit(1), F.length(opened) - F.length(inner) - F.length(name))
        now = (
            F.when(x["turn"] == 1, F.concat(opened, x["name"])).when(known, outer).otherwise(state["opened"])
        )
        written = F.when(x["turn"] != -1, x["tag"]).when(known, F.concat(_closing(inner), x["tag"])).otherwise("")
        return F.struct(
            now.alias("opened"), F.concat(state["out"], written, x["after"]).alias("out"), state["done"].alias("done")
        )

    def chunk(state: Column, tags: Column) -> Column:
        start = F.struct(state["opened"].alias("opened"), F.lit("").alias("out"), state["done"].alias("done"))
        return F.aggregate(
            tags, start, step,
            lambda end: F.struct(end["opened"].alias("opened"), F.concat(end["done"], F.array(end["out"])).alias("done")),
        )

    start = F.struct(F.lit("").alias("opened"), F.array(before).alias("done"))

    def finish(state: Column) -> Column:
        still = F.substr(F.concat(state["opened"], F.lit(MARK)), F.lit(len(MARK) + 1))
        return F.concat(F.array_join(state["done"], ""), _closing(still))

    return F.aggregate(chunks, start, chunk, finish)


def balanced(text: Column) -> Column:
    """``put_right`` for the texts whose annotations do not nest, the others as they are."""
    return F.when(~text.contains("<"), text).when(nests(text), text).otherwise(put_right(text))

"""Small documents with every awkward case, and plain versions of shared rules."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    stems = ["the", "of", "ré", "stra", "ße", "na", "ion", "tor", "el", "ka", "mi", "日本"]
    out = ["".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(words)]
    for i in range(rng.randint(3, 9), words, 11):
        out[i] = out[i].capitalize() + rng.choice([".", ",", "!", ".\n"])
    return " ".join(out)


def documents() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 70)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), None, "", " \n\t ", "one", "one", "two words", "Two  WORDS\n",
        prose(3, 40) + " " + passage + " " + prose(4, 40), passage + "\n" + prose(5, 30),
        "a" * 3000, "a" * 1000 + "b", ("x y " * 700).strip(), "\n".join(["same line of text here"] * 30),
        prose(6, 3000), "trailing space ", "  double  spaces and more  ", "tab\there's it're 'll  x's",
        "<|endoftext|> </s>[INST]", "emoji 😀😀 é́ ǅ ﬁ", "\r\n\r\n line\x0b\x0c end",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], "s", None) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "s", 3), (None, passage, None, None, None), (7, "one", "en", "s", 3)]
    return rows


def python_steps_apart(df):
    """Whether no Python step of the plan stands on another one without an exchange between them."""
    above, apart = [], True  # for each open node its depth, and whether Python runs in the task above it
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        node = line.lstrip(" :+-")
        depth, name = len(line) - len(node), node.split()[0]
        while above and above[-1][0] >= depth:
            above.pop()
        python, inside = name.endswith(("InArrow", "EvalPython")), bool(above) and above[-1][1]
        apart = apart and not (python and inside)
        above.append((depth, "Exchange" not in name and (python or inside)))
    return apart

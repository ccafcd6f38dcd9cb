"""Column-level text functions (normalise, clean, tokenise, slice).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
White space is matched by an explicit ASCII class because Java's ``\\s`` and
other regex engines disagree on the vertical tab.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define results.
WS = r"[\t\n\x0B\f\r ]"
EOT = "<|endoftext|>"
WORD_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0B\f\r ]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Strip leading/trailing white space (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def normalize(c) -> Column:
    """B1: strip, collapse white space runs to one space, then EOT -> space."""
    return F.replace(F.trim(F.regexp_replace(_c(c), f"{WS}+", " ")), F.lit(EOT), F.lit(" "))


def light_clean(c) -> Column:
    """B2: strip, then newline and tab become spaces."""
    return F.translate(strip(c), "\n\t", "  ")


def resolve_text(text=None, content=None, title=None) -> Column:
    """Text, else content, else title + text."""
    parts = [x for x in (text, content) if x is not None]
    if title is not None and text is not None:
        parts.append(F.concat_ws(" ", _c(title), _c(text)))
    return F.coalesce(*[_c(p) for p in parts])


def ws_tokens(c, lowercase: bool = True) -> Column:
    """White-space tokens (empty array for blank text)."""
    col = F.lower(_c(c)) if lowercase else _c(c)
    s = F.trim(F.regexp_replace(col, f"{WS}+", " "))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def word_tokens(c, lowercase: bool = True) -> Column:
    """Words (letters/digits runs) and single punctuation marks."""
    col = F.lower(_c(c)) if lowercase else _c(c)
    return F.regexp_extract_all(col, F.lit(WORD_PATTERN), F.lit(0))


def tokens(c, tokenizer: str = "ws", lowercase: bool = True) -> Column:
    if tokenizer == "ws":
        return ws_tokens(c, lowercase)
    if tokenizer == "word":
        return word_tokens(c, lowercase)
    raise ValueError(f"unknown tokenizer {tokenizer}")


def n_words(c) -> Column:
    """Word count column."""
    return F.size(ws_tokens(c, lowercase=False)).cast("bigint")


def truncate_tokens(toks, n: int) -> Column:
    """Keep the first ``n`` tokens of a token array."""
    return F.slice(_c(toks), 1, n)


def truncate_words(c, n: int) -> Column:
    """B4 on text: first ``n`` white-space words re-joined by one space."""
    return F.array_join(F.slice(ws_tokens(c, lowercase=False), 1, n), " ")


def tail_chars(c, n: int) -> Column:
    """The last ``n`` characters (the generation context window)."""
    return F.right(_c(c), F.lit(int(n)))


def head_chars(c, n: int) -> Column:
    """The first ``n`` characters (prompt derivation)."""
    return F.left(_c(c), F.lit(int(n)))


def few_shot(examples, prompt, shots: int | Column) -> Column:
    """First ``shots`` example lines, then the prompt (plain prompt at 0)."""
    s = shots if isinstance(shots, Column) else F.lit(int(shots))
    return F.when(s <= 0, _c(prompt)).otherwise(
        F.concat(F.array_join(F.slice(_c(examples), F.lit(1), s), "\n"), F.lit("\n"), _c(prompt)))


def min_length(c, n: int) -> Column:
    """C1 predicate: stripped length above ``n`` characters."""
    return F.length(strip(c)) > n


def word_count_between(c, lo: int, hi: int) -> Column:
    """C2 predicate."""
    return n_words(c).between(lo, hi)


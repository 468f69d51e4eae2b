"""Text scalars as column expressions: folding, the three tokenisers, cuts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> dict[str, str]:
    """Lower-case Latin letters with marks and the plain letter that they decompose to."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code) and chr(code).islower() and plain.isalpha():
            out[chr(code)] = plain
    return out


ACCENTS = _accents()
COMBINING = "[\\u0300-\\u036f]"

# Words that a prompt's tokens leave out.
STOP_WORDS = """
avec dans pour sans mais donc alors cette votre notre leur sont etre avoir fait
faire faut tout tous toute toutes plus moins bien aussi comme quand ainsi entre
vers chez sous apres avant encore jamais toujours peut veux veut mettre prends
prend continue continuer please thanks thank merci puis donne moi le la les des
une aux ces son ses mes tes nos vos ton fais
this that with from have what when will would could should about there then
which where while your just into over also than them they their been were does
""".split()

# The words of a prompt, of the in-memory ranking, and identifiers.
AMBIENT_WORD = r"[a-zA-ZÀ-ſ0-9_-]{3,}"
OKAPI_WORD = "[a-zàâäéèêëïîôùûüç0-9]+"
IDENTIFIER = r"\b[a-zA-Z]+-\d{4,}\b"


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), "".join(ACCENTS), "".join(ACCENTS.values())), COMBINING, "")


def fts_terms(text: Column) -> Column:
    """Terms of the full-text index: folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: Column) -> Column:
    """Words of two or more word characters, each one a phrase of the query."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def okapi_tokens(text: Column) -> Column:
    """Tokens of the in-memory ranking; accents stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(OKAPI_WORD), F.lit(0))


def prompt_tokens(text: Column, limit: int = 8) -> Column:
    """The first ``limit`` distinct words of a prompt, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(AMBIENT_WORD), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))), 1, limit)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def head_and_tail(text: Column, each: int) -> Column:
    return F.concat(F.substring(text, 1, each), F.lit(" ... "), F.right(text, F.lit(each)))


def embed_text(prompt: Column, context: Column, max_chars: int = 350) -> Column:
    """What the embedder sees: the prompt's head, and as much of the context as fits (whole, or head and tail).  Mask both before."""
    head = F.substring(prompt, 1, max_chars)
    room = F.lit(max_chars) - F.length(head) - 2
    part = F.floor((room - 5) / 2).cast("int")
    cut = F.when(F.length(context) <= room, context).otherwise(F.concat(F.left(context, part), F.lit(" ... "), F.right(context, part)))
    return F.when((room < 40) | (F.coalesce(F.length(context), F.lit(0)) == 0), head).otherwise(F.concat(head, F.lit("\n\n"), cut))


def conversation_context(prompt: Column, reply: Column, max_words: int = 12, each: int = 300) -> Column:
    """Of the reply before a short prompt: all, or head and tail; empty after a long prompt.  Mask the reply before."""
    text = collapse(F.regexp_replace(reply, r"\[(?:SUGGEST|PROPOSE)[^\]]*\]", " "))
    words = F.size(F.regexp_extract_all(prompt, F.lit(r"\S+"), F.lit(0)))
    whole = F.when(F.length(text) <= 2 * each, text).otherwise(head_and_tail(text, each))
    return F.when(reply.isNull() | (words > max_words), F.lit("")).otherwise(whole)

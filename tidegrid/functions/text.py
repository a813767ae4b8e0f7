"""Text columns: markup removal, entity decoding, tokens, class scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spaces that are stripped or collapsed, the classes in their order, the label order of ties.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
CLASSES = ("positive", "negative", "neutral")
HEADLINE_WIDTH = 100
MAX_TOKENS = 512
WORD_BREAK = r"[^\p{L}\p{N}_]+"

# Comments, declarations, and elements whose content is not visible text; unclosed ones run to the end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?[^>]*>|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
# A tag ends at the first > outside the quotes of an attribute's value.
TAG = r"""(?s)</?[a-zA-Z][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^>"'=]?)[^>=]*+)*+>"""


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _where(mark: str, text: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` of those texts that hold ``mark``, others as they are; the text itself is computed once."""
    return F.transform(F.array(text), lambda whole: F.when(whole.contains(mark), change(whole)).otherwise(whole))[0]


def strip(text: Column | str) -> Column:
    """White space off both ends, all of Unicode's."""
    spaces = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())
    return F.btrim(_col(text), F.lit(spaces))


def strip_html(text: Column | str) -> Column:
    """Tags away, runs of newlines to one, three named entities to their characters, outer space off.

    What stands between the tags of a script or style stays.
    """
    bare = _where("<", _col(text), lambda whole: F.regexp_replace(whole, "<[^>]*>", ""))
    lines = _where("\n\n", bare, lambda whole: F.regexp_replace(whole, "\n+", "\n"))
    for entity, character in (("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–")):
        lines = F.replace(lines, F.lit(entity), F.lit(character))
    return strip(lines)


def _entity_names() -> Column:
    """All named character references and their characters, from the standard library's table, as one constant."""
    pairs = sorted((name.removesuffix(";"), character) for name, character in html5.items() if name.endswith(";"))
    return F.str_to_map(F.lit("\x01".join(f"{name}\x02{character}" for name, character in pairs)), F.lit("\x01"), F.lit("\x02"))


def _old_names() -> str:
    """A pattern of the names that need no semicolon, the longest first."""
    names = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
    return f"^({'|'.join(names)})"


def _code_point(number: Column) -> Column:
    """The character of a number: 128 to 159 as in code page 1252, replaced where there is none."""
    old = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    renamed = F.str_to_map(F.lit(",".join(f"{n}:{c}" for n, c in old.items() if c)), F.lit(","), F.lit(":"))
    # the number of a character to UTF-8 by way of its UTF-32 bytes
    wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    none = (number == 0) | (number > 1114111) | number.between(55296, 57343)
    moved = F.when(number.between(128, 159), F.try_element_at(renamed, number.cast("string")))
    return F.when(none, "�").otherwise(F.coalesce(moved, wide))


def decode_entities(text: Column | str) -> Column:
    """Named and numeric character references to characters, each decoded once; unknown ones stay as they are."""
    names, old = _entity_names(), _old_names()
    pattern = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);?"

    def decoded(piece: Column) -> Column:
        reference = F.regexp_extract(piece, pattern, 0)
        body = F.regexp_extract(piece, pattern, 1)
        digits = F.regexp_replace(body, "^#[xX]?", "")
        number = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(body.startswith("#"), digits).try_cast("int")
        named = F.when(reference.endswith(";"), F.try_element_at(names, body))
        character = F.when(body.startswith("#"), _code_point(number)).otherwise(named)
        short = F.regexp_extract(body, old, 1)
        return (
            F.when((body != "") & character.isNotNull(), F.concat(character, F.substr(piece, F.length(reference) + 1)))
            .when(short != "", F.concat(F.try_element_at(names, short), F.substr(piece, F.length(short) + 1)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def put_together(whole: Column) -> Column:
        pieces = F.split(whole, "&")
        rest = F.transform(F.slice(pieces, 2, F.size(pieces)), decoded)
        return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))

    return _where("&", _col(text), put_together)


def clean_html_text(text: Column | str) -> Column:
    """Visible text of a page: hidden parts and tags away, entities decoded, white space collapsed."""
    visible = _where("<", _col(text), lambda whole: F.regexp_replace(F.regexp_replace(whole, HIDDEN, ""), TAG, ""))
    return strip(F.regexp_replace(decode_entities(visible), f"{SPACE}+", " "))


def tokens(text: Column | str) -> Column:
    """Lower-case word tokens of the whole text."""
    return F.array_remove(F.split(F.lower(_col(text)), WORD_BREAK), "")


def article_tokens(headline: Column | str, content: Column | str, max_tokens: int | None = None) -> Column:
    """Tokens of headline and content; ``max_tokens`` is the length limit of a scorer that has one."""
    words = tokens(F.concat_ws(" ", _col(headline), _col(content)))
    return words if max_tokens is None else F.slice(words, 1, max_tokens)


def prepare_text(headline: Column | str, content: Column | str, max_tokens: int | None = None) -> Column:
    """Headline and content as tokens joined by spaces; ``max_tokens`` (such as MAX_TOKENS) only where a scorer has a limit."""
    return F.array_join(article_tokens(headline, content, max_tokens), " ")


def headline_pad(headline: Column | str, width: int = HEADLINE_WIDTH) -> Column:
    return F.rpad(_col(headline), width, " ")


def softmax(scores: Sequence[Column]) -> list[Column]:
    """Scores to probabilities that sum to 1."""
    top = F.greatest(*scores)
    powers = [F.exp(score - top) for score in scores]
    total = sum(powers[1:], powers[0])
    return [power / total for power in powers]


def argmax_label(scores: Sequence[Column], labels: Sequence[str] = CLASSES) -> Column:
    """Label of the largest score, the first one on ties."""
    top = F.greatest(*scores)
    label = F.when(scores[0] == top, labels[0])
    for score, name in zip(scores[1:], labels[1:], strict=True):
        label = label.when(score == top, name)
    return label

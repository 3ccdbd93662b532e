"""Text helpers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# all line boundaries of Unicode plus the three separator controls
_LINE_BREAK = r"\R|[\x1C-\x1E]"
_TRAILING_SPACE = r"(?U)[\s\x1F]+\z"

# each element ends with its own end tag
_UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->"

_ENTITIES = (
    ("&nbsp;", " "),
    ("&middot;", "\u00b7"),
    ("&copy;", "\u00a9"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),  # last, so that an escaped entity stays text
)


def normalise_text(text: Column) -> Column:
    """Drop blank lines and the trailing whitespace of each line."""
    lines = F.transform(F.split(text, _LINE_BREAK), lambda line: F.regexp_replace(line, _TRAILING_SPACE, ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def plain_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles, comments or tags, entities resolved, spaces collapsed."""
    text = F.regexp_replace(html, _UNSEEN, " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def raw_words(text: Column) -> Column:
    """Lower-case words, runs of letters and digits of any script; the ends of a text may add an empty one."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")

"""Column expressions over text. Patterns avoid look-around so that RE2 engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, letter tables and page entities.
NON_WORD = r"[^\p{L}\p{N}]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ -]?[0-9]{3}-?[0-9]{4}"
CARD = r"\b[0-9]{13,16}\b"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
PII = {"email": EMAIL, "phone": PHONE, "card": CARD, "ip": IPV4}
URL = r"https?://[^\s\"'<>]+"
SECRET = r"(?i)(?:token|secret|api_key|password)[ ]*[=:][ ]*\"?([A-Za-z0-9_-]{16,})"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
MONEY = r"[$€£](?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{2})?"
TIMECODE = r"\b(?:[0-9]{1,2}:)?[0-5]?[0-9]:[0-5][0-9]\b"
ENTITIES = {
    "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">",
    "&amp;": "&",
}
CYRILLIC = "абвгдеёзийклмнопрстуфхыэ"
CYRILLIC_LATIN = "abvgdeezijklmnoprstufhye"
CYRILLIC_DIGRAPHS = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu",
                     "я": "ya", "ъ": "", "ь": ""}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe"}


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by a blank; empty when there are fewer words.

    Shifted copies are zipped, so the work is linear in the words. Pass a plain
    column: an expression would be evaluated once per shift.
    """
    runs = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, 1, runs)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(words, j + 1, runs), lambda x, y: F.concat_ws(" ", x, y))
    return out


def normalise(text: Column) -> Column:
    """Single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def visible_text(html: Column) -> Column:
    """Text of a page without comments, scripts, styles and tags."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?is)<script.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style.*?</style>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def latin(text: Column) -> Column:
    """Cyrillic and accented letters (lower case) as plain Latin ones."""
    c = F.translate(text, CYRILLIC + ACCENTED, CYRILLIC_LATIN + PLAIN)
    for letter, plain in {**CYRILLIC_DIGRAPHS, **LIGATURES}.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return c


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of ``text``."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.size(chars)
    return -F.aggregate(
        F.array_sort(F.array_distinct(chars)),
        F.lit(0.0),
        lambda acc, c: acc
        + (F.size(F.filter(chars, lambda x: x == c)) / total)
        * F.log2(F.size(F.filter(chars, lambda x: x == c)) / total),
    )


def mod97_valid(code: Column) -> Column:
    """ISO 7064 mod 97-10: first four characters moved last, letters as 10 to 35, rest 1."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    digits = moved
    for i in range(26):
        digits = F.replace(digits, F.lit(chr(65 + i)), F.lit(str(10 + i)))
    rest = F.aggregate(
        F.filter(F.split(digits, ""), lambda d: d != ""),
        F.lit(0),
        lambda acc, d: (acc * 10 + d.cast("int")) % 97,
    )
    return digits.rlike("^[0-9]+$") & (rest == 1)

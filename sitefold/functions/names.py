"""Object names: clean forms and validity, with built-in functions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a name must match, and what no text may hold.
BUCKET_NAME = r"^[0-9a-z\-]{3,63}$"
OBJECT_NAME = r"^[0-9a-zA-Z_./\-]{1,1024}$"
METADATA_KEY = r"^([a-zA-Z_])([0-9a-zA-Z_]*)$"
FORBIDDEN = ("<![CDATA[", "&lt;![CDATA[", "<!ENTITY", "&lt;!ENTITY", "<script>", "&lt;script&gt;", ";")
CONTROL = r"[\x00-\x1F\x7F]"


def _accents() -> tuple[str, str]:
    """Latin letters with a mark, and without it: a rule, as long as the blocks are."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        plain = "".join(c for c in base if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    pairs += [("ł", "l"), ("Ł", "L")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(name: Column) -> Column:
    marked, plain = _accents()
    return F.regexp_replace(F.translate(name, marked, plain), r"[̀-ͯ]", "")


def sanitized(name: Column) -> Column:
    """The clean form of a name; null for a null or empty one."""
    n = F.coalesce(F.try_url_decode(name), name)
    n = F.replace(F.replace(n, F.lit("\\"), F.lit("/")), F.lit("//"), F.lit("/"))
    n = F.regexp_replace(without_accents(n), r"[\s_]+", " ")
    n = F.regexp_replace(F.regexp_replace(n, r"[^a-zA-Z0-9/_ .\-]", ""), r"-+", "-")
    n = F.regexp_replace(F.trim(n), r"[\s_]+", "_")
    n = F.when(n.startswith("/"), F.substring(n, 2, 1 << 30)).otherwise(n)
    return F.when(F.length(name) > 0, n)


def fault(name: Column, pattern: str) -> Column:
    """Why a name is refused, or null: ``control``, ``tag`` or ``pattern``; an empty name is ``empty``."""
    tags = F.lit(False)
    for tag in FORBIDDEN:
        tags = tags | name.contains(tag)
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "empty")
        .when(name.rlike(CONTROL), "control")
        .when(tags, "tag")
        .when(~name.rlike(pattern), "pattern")
    )

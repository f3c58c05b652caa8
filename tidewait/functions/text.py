"""Character references in markup."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
NAMED = {**name2codepoint, "apos": ord("'")}


def _character(reference: Column) -> Column:
    """The character a reference stands for; a name or number without one stays as written."""
    body = F.regexp_extract(reference, r"^&(.*);$", 1)
    named = F.create_map(*[F.lit(x) for name, code in NAMED.items() for x in (name, chr(code))])
    code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 8)).try_cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(body.startswith("#"), number).otherwise(F.try_element_at(named, body)), reference)


def decode_references(text: Column) -> Column:
    """Text with every character reference replaced, each once: `&amp;lt;` becomes `&lt;`."""
    plain = F.split(text, REFERENCE, -1)
    characters = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _character)
    woven = F.zip_with(plain, characters, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.instr(text, "&") > 0, F.array_join(woven, "")).otherwise(text)

"""SQL pieces that several oracles share."""

from __future__ import annotations

from ..functions.text import STOPWORDS


def subwords_sql(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"list_transform(list_filter(regexp_split_to_array({spaced}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: lower(w))"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


STOPS = in_list(STOPWORDS)
STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"
EXTENSION = "lower(regexp_extract(path, '[^/.][^/]*\\.([^./]+)$', 1))"
FILES = "(SELECT DISTINCT * FROM files)"

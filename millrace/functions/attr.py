"""Attribute functions: a fluent wrapper over Column with the value semantics of flow expressions.

``attr("name").substring_before("-").to_upper().col`` is an ordinary Column. Text functions work on the string form.
"""

from __future__ import annotations

import re
import socket

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.grok import PATTERNS

# Variable names that hold secrets or configuration rather than record attributes.
_SECRET = re.compile(r"password|token|secret|credential|api[_.]?key|private[_.]?key|passphrase", re.I)
_CONFIG_START = re.compile(r"^(s3|kafka|jdbc|aws|azure|gcp|http|ftp|smtp|ssl|sasl)\.", re.I)
_CONFIG_END = re.compile(r"\.(url|host|port|path|bucket|region)$", re.I)


def variable_context(name: str) -> str:
    """``secret``, ``config`` or ``column``: what a variable name refers to."""
    if _SECRET.search(name):
        return "secret"
    return "config" if _CONFIG_START.search(name) or _CONFIG_END.search(name) else "column"


def is_column_name(name: str) -> bool:
    return variable_context(name) == "column"


def attr(value: str | Column) -> Attr:
    return Attr(F.col(value) if isinstance(value, str) else value)


def literal(value) -> Attr:
    return Attr(F.lit(value))


def now() -> Attr:
    return Attr(F.current_timestamp())


def uuid() -> Attr:
    return Attr(F.uuid())


def next_int() -> Attr:
    return Attr(F.floor(F.rand() * F.lit(2147483647.0)))


def hostname() -> Attr:
    return Attr(F.lit(socket.gethostname()))


def math(expression: str, column: str) -> Attr:
    """An arithmetic SQL expression in which ``value`` stands for the column read as a number."""
    return Attr(F.expr(re.sub(r"\bvalue\b", f"try_cast(`{column}` as double)", expression)))


def one_line_base64(data: Column) -> Column:
    """base64 without the line breaks Spark puts after every 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


class Attr:
    """One attribute value; every method returns a new Attr."""

    def __init__(self, col: Column):
        self.col = col

    @property
    def _s(self) -> Column:
        return self.col.cast("string")

    @property
    def _n(self) -> Column:
        return self.col.try_cast("double")

    # text
    def to_upper(self):
        return Attr(F.upper(self._s))

    def to_lower(self):
        return Attr(F.lower(self._s))

    def trim(self):
        return Attr(F.trim(self._s))

    def length(self):
        return Attr(F.length(self._s))

    def substring(self, start: int, end: int | None = None):
        """0-based ``start``, exclusive ``end`` index."""
        size = F.length(self._s) if end is None else F.lit(end - start)
        return Attr(F.substring(self._s, F.lit(start + 1), size))

    def replace(self, old: str, new: str):
        return Attr(F.replace(self._s, F.lit(old), F.lit(new)))

    def replace_all(self, pattern: str, new: str):
        return Attr(F.regexp_replace(self._s, pattern, new))

    def replace_first(self, pattern: str, new: str):
        """First match only: the text before it is captured and put back."""
        shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", new)
        return Attr(F.regexp_replace(self._s, f"(?s)^(.*?)(?:{pattern})", "$1" + shifted))

    def starts_with(self, text: str):
        return Attr(F.coalesce(F.startswith(self._s, F.lit(text)), F.lit(False)))

    def ends_with(self, text: str):
        return Attr(F.coalesce(F.endswith(self._s, F.lit(text)), F.lit(False)))

    def contains(self, text: str):
        return Attr(F.coalesce(F.contains(self._s, F.lit(text)), F.lit(False)))

    def matches(self, pattern: str):
        """The whole text matches."""
        return Attr(self._s.rlike(f"^(?:{pattern})$"))

    def find(self, pattern: str):
        return Attr(self._s.rlike(pattern))

    def split(self, sep: str):
        return Attr(F.split(self._s, re.escape(sep)))

    def get_delimited_field(self, index: int, sep: str = ","):
        """1-based field, empty text if there are fewer."""
        return Attr(F.split_part(self._s, F.lit(sep), F.lit(index)))

    def substring_before(self, sep: str):
        return Attr(F.substring_index(self._s, sep, 1))

    def substring_before_last(self, sep: str):
        cut = F.substring_index(self._s, sep, -1)
        kept = F.length(self._s) - F.length(cut) - len(sep)
        return Attr(F.when(F.contains(self._s, F.lit(sep)), F.substring(self._s, F.lit(1), kept)).otherwise(self._s))

    def substring_after(self, sep: str):
        """Text after the first delimiter, empty if there is none."""
        at = F.locate(sep, self._s)
        return Attr(F.when(at == 0, "").otherwise(F.substring(self._s, at + len(sep), F.length(self._s))))

    def substring_after_last(self, sep: str):
        return Attr(F.when(F.contains(self._s, F.lit(sep)), F.substring_index(self._s, sep, -1)).otherwise(""))

    def pad_left(self, size: int, fill: str = " "):
        return Attr(F.when(F.length(self._s) < size, F.lpad(self._s, size, fill)).otherwise(self._s))

    def pad_right(self, size: int, fill: str = " "):
        return Attr(F.when(F.length(self._s) < size, F.rpad(self._s, size, fill)).otherwise(self._s))

    def index_of(self, text: str):
        """0-based position, -1 if absent."""
        return Attr(F.locate(text, self._s) - 1)

    def append(self, text: str):
        return Attr(F.concat(self._s, F.lit(text)))

    def prepend(self, text: str):
        return Attr(F.concat(F.lit(text), self._s))

    def replace_empty(self, text: str):
        return Attr(F.when(F.trim(self._s) == "", F.lit(text)).otherwise(self._s))

    def replace_null(self, text):
        return Attr(F.coalesce(self.col, F.lit(text)))

    def grok(self, name: str):
        """The first match of a pattern of the library, empty text if there is none."""
        pattern = PATTERNS.get(name) or PATTERNS.get(name.upper()) or name
        return Attr(F.regexp_extract(self._s, pattern, 0))

    # comparison and logic
    def equals(self, other):
        return Attr(self._s.eqNullSafe(F.lit(str(other))))

    def equals_ignore_case(self, other: str):
        return Attr(F.lower(self._s).eqNullSafe(F.lit(other.lower())))

    def gt(self, n):
        return Attr(self._n > F.lit(float(n)))

    def ge(self, n):
        return Attr(self._n >= F.lit(float(n)))

    def lt(self, n):
        return Attr(self._n < F.lit(float(n)))

    def le(self, n):
        return Attr(self._n <= F.lit(float(n)))

    def is_empty(self):
        return Attr(F.coalesce(self._s == "", F.lit(True)))

    def is_null(self):
        """An empty text counts as no value."""
        return Attr(F.coalesce(self._s == "", F.lit(True)))

    def not_null(self):
        return Attr(F.coalesce(self._s != "", F.lit(False)))

    def not_(self):
        return Attr(~self.col.cast("boolean"))

    def and_(self, other: Attr | Column):
        return Attr(self.col & (other.col if isinstance(other, Attr) else other))

    def or_(self, other: Attr | Column):
        return Attr(self.col | (other.col if isinstance(other, Attr) else other))

    def if_else(self, yes, no):
        return Attr(F.when(self.col.cast("boolean"), F.lit(yes)).otherwise(F.lit(no)))

    # numbers
    def to_number(self):
        """A text that is no number counts as 0."""
        return Attr(F.coalesce(self._n, F.lit(0.0)))

    def to_string(self):
        return Attr(self._s)

    def plus(self, n):
        return Attr(self._n + F.lit(float(n)))

    def minus(self, n):
        return Attr(self._n - F.lit(float(n)))

    def multiply(self, n):
        return Attr(self._n * F.lit(float(n)))

    def divide(self, n):
        """Quotient rounded down."""
        return Attr(F.floor(F.try_divide(self._n, F.lit(float(n)))))

    def mod(self, n):
        return Attr(F.try_mod(self.col.try_cast("bigint"), F.lit(int(n))))

    def to_radix(self, base: int, source: int = 10):
        return Attr(F.lower(F.conv(self._s, source, base)))

    def abs(self):
        return Attr(F.abs(self._n))

    def ceil(self):
        return Attr(F.ceil(self._n))

    def floor(self):
        return Attr(F.floor(self._n))

    def round(self):
        return Attr(F.round(self._n))

    # dates
    def format(self, pattern: str):
        return Attr(F.date_format(self.col, pattern))

    def to_date(self, pattern: str):
        return Attr(F.try_to_timestamp(self._s, F.lit(pattern)))

    # JSON
    def json_path(self, path: str):
        return Attr(F.get_json_object(self._s, path))

    def _json_map(self) -> Column:
        """Fields of a JSON object; numbers, truth values and nested objects stay what they are."""
        return F.from_json(self._s, "map<string,variant>")

    def json_path_set(self, field: str, value):
        """Set a top-level field of a JSON object (also adds it) to a text, number or truth value."""
        others = F.map_filter(self._json_map(), lambda k, _: k != field)
        return Attr(F.to_json(F.map_concat(others, F.create_map(F.lit(field), F.lit(value).cast("variant")))))

    json_path_put = json_path_set
    json_path_add = json_path_set

    def json_path_delete(self, field: str):
        return Attr(F.to_json(F.map_filter(self._json_map(), lambda k, _: k != field)))

    # escaping and codecs
    def escape_json(self):
        quoted = F.to_json(F.array(self._s))
        return Attr(F.substring(quoted, F.lit(3), F.length(quoted) - 4))

    def unescape_json(self):
        return Attr(F.from_json(F.concat(F.lit('["'), self._s, F.lit('"]')), "array<string>")[0])

    def _swap(self, pairs) -> Attr:
        out = self._s
        for old, new in pairs:
            out = F.replace(out, F.lit(old), F.lit(new))
        return Attr(out)

    def escape_xml(self):
        return self._swap((("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))

    def unescape_xml(self):
        return self._swap((("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")))

    def escape_csv(self):
        """Quoted only if the text has a comma."""
        quoted = F.concat(F.lit('"'), F.replace(self._s, F.lit('"'), F.lit('""')), F.lit('"'))
        return Attr(F.when(F.contains(self._s, F.lit(",")), quoted).otherwise(self._s))

    def url_encode(self):
        """Percent encoding of a URI component (a blank is %20)."""
        out = F.replace(F.url_encode(self._s), F.lit("+"), F.lit("%20"))
        for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(code), F.lit(char))
        return Attr(out)

    def url_decode(self):
        return Attr(F.try_url_decode(F.replace(self._s, F.lit("+"), F.lit("%2B"))))

    def base64_encode(self):
        return Attr(one_line_base64(F.encode(self._s, "UTF-8")))

    def base64_decode(self):
        return Attr(F.unbase64(self._s).cast("string"))

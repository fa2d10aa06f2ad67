"""Queries of the history store, search, dataset engineering, evaluation and model operators, with their DuckDB equivalents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.search import matches, parse_query
from maskwright.operators import dataset as S
from maskwright.operators import evaluation as E
from maskwright.operators import generation as G
from maskwright.operators import ingest as I
from maskwright.operators import ml
from maskwright.operators import tags as T
from maskwright.plans import oracle as O
from maskwright.settings import Settings
from maskwright.sources import store as R

Query = Callable[[SparkSession, str], DataFrame]
NOW = "timestamp '1995-06-17 00:00:00'"

_ITEMS = """SELECT cast(o_orderkey as string) AS id, concat('w', o_orderkey) AS windows_id, o_orderdate AS created_at, 'Text' AS content_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'Protected' WHEN 1 THEN 'Weird' ELSE 'Normal' END AS protection_state, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS safe_text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Email' ELSE 'Normal' END AS primary_category, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS expires_at, o_orderkey % 7 = 0 AS is_pinned FROM {orders}"""
_SEARCH = "SELECT cast(p_partkey as string) AS item_id, concat(p_name, ' café-', p_size, ' ', p_type) AS search_text FROM {part}"
_LOGS = "SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN concat('  at frame ', event_id) ELSE concat('2024-01-02T03:04:05.', event_id % 1000, 'Z [Info] ', event_type, ': user ', user_id, ' from 10.0.', user_id % 250, '.7 token=t', event_id, ' mail u', user_id, '@x.example.com') END AS line FROM {events}"
#: Records of an order's lines: words by part, tags by supplier; a few tags are broken on purpose.
_LINES = "SELECT l_orderkey AS rec, l_linenumber AS n, concat('w', l_partkey % 50) AS token, CASE WHEN l_suppkey % 3 = 0 THEN 'O' WHEN l_suppkey % 5 = 0 THEN concat('I-', {k}) ELSE concat('B-', {k}) END AS tag FROM {{lineitem}}".format(
    k="CASE l_partkey % 4 WHEN 0 THEN 'SECRET' WHEN 1 THEN 'PII' WHEN 2 THEN 'HOSTINFO' ELSE 'NETWORK' END"
)
_TYPE = "CASE {x} % 4 WHEN 0 THEN 'SECRET' WHEN 1 THEN 'PII' WHEN 2 THEN 'HOSTINFO' ELSE 'NETWORK' END"
_TRUE = f"SELECT DISTINCT l_orderkey AS rec, l_linenumber * 8 AS start, l_linenumber * 8 + 2 + l_partkey % 4 AS `end`, {_TYPE.format(x='l_suppkey')} AS type FROM {{lineitem}} WHERE l_partkey % 9 <> 0"
_PRED = f"SELECT DISTINCT l_orderkey AS rec, l_linenumber * 8 + l_partkey % 3 - 1 AS start, l_linenumber * 8 + 2 + l_partkey % 5 AS `end`, {_TYPE.format(x='(l_suppkey + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END)')} AS type FROM {{lineitem}} WHERE l_partkey % 8 <> 0"


def _load(spark: SparkSession, d: str, sql: str) -> DataFrame:
    tables = ("orders", "part", "events", "lineitem", "documents", "conversations", "supplier", "customer")
    return spark.sql(sql.format(**{t: f"parquet.`{d}/{t}.parquet`" for t in tables}))


def _sql(sql: str) -> str:
    tables = ("orders", "part", "events", "lineitem", "documents", "conversations", "supplier", "customer")
    return sql.format(**{t: t for t in tables}).replace("`", '"')


def _items(spark: SparkSession, d: str) -> DataFrame:
    return R.read_item(_load(spark, d, _ITEMS), ("Normal", "Email"))


def _search_rows(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, "SELECT cast(o_orderkey as string) AS item_id, o_orderpriority AS search_text FROM {orders}")


def _records(spark: SparkSession, d: str) -> DataFrame:
    lines = _load(spark, d, _LINES)
    rows = lines.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("n", "token", "tag"))).alias("x"))
    return rows.select("rec", F.transform("x", lambda t: t["token"]).alias("tokens"), F.transform("x", lambda t: t["tag"]).alias("tags")).withColumn("split", S.hash_split(F.concat(F.lit("t"), F.col("rec") % 97)))


def r_recent_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.recent(_items(spark, d)).select("id", "is_pinned")


def r_get(spark: SparkSession, d: str) -> DataFrame:
    return R.get(_items(spark, d), "77").select("id", "protection_state", "safe_text", "primary_category", "is_pinned")


def r_rows(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("id", "protection_state", "safe_text", "primary_category", "is_pinned")


def r_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = _load(spark, d, "SELECT cast(o_orderkey as string) AS id FROM {orders} WHERE o_orderstatus = 'F'")
    items, search = R.delete(_items(spark, d), _search_rows(spark, d), gone)
    return items.select("id", F.lit("item").alias("kind")).unionByName(search.select(F.col("item_id").alias("id"), F.lit("search").alias("kind")))


def r_clear_unpinned(spark: SparkSession, d: str) -> DataFrame:
    items, search = R.clear_unpinned(_items(spark, d), _search_rows(spark, d))
    return items.select("id", F.lit("item").alias("kind")).unionByName(search.select(F.col("item_id").alias("id"), F.lit("search").alias("kind")))


def r_expire(spark: SparkSession, d: str) -> DataFrame:
    return R.delete_expired(_items(spark, d), _search_rows(spark, d), F.expr(NOW))[0].select("id")


def r_pin(spark: SparkSession, d: str) -> DataFrame:
    return R.set_pinned(_items(spark, d), "5", True).filter("is_pinned").select("id")


def r_migrate_v1(spark: SparkSession, d: str) -> DataFrame:
    old = _load(spark, d, "SELECT cast(o_orderkey as string) AS id, 'w' AS windows_id, o_orderdate AS created_at, 'Text' AS content_type, o_orderkey % 2 AS is_sensitive, o_orderpriority AS masked_preview, 'Normal' AS primary_category, o_orderdate AS expires_at, o_orderkey % 3 AS is_pinned FROM {orders}")
    return R.migrate_v1(old).select("id", "protection_state", "safe_text", "is_pinned")


def r_replay(spark: SparkSession, d: str) -> DataFrame:
    log = _load(spark, d, "SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'pin' WHEN 2 THEN 'unpin' ELSE 'insert' END AS op, cast(user_id as string) AS id, ts AS created_at FROM {events}")
    return R.replay(log).select("id", "is_pinned")


def r_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings from JSON of different quality: what is missing or malformed reads as the default."""
    given = ["", "{", "[1]", '{"mask_emails": false, "allowed_domains": ["a.b"], "mask_phones": "no"}', Settings(ml_threshold=0.5).to_json()]
    read = [Settings.from_json(g) for g in given]
    return spark.createDataFrame([(k, s.mask_emails, s.mask_phones, len(s.allowed_domains), int(s.ml_threshold * 100)) for k, s in enumerate(read)], "id long, mask_emails boolean, mask_phones boolean, domains long, threshold long")


def _searches(raw: str) -> Query:
    return lambda spark, d: _load(spark, d, _SEARCH).filter(matches(F.col("search_text"), parse_query(raw))).select(F.col("item_id").alias("id"))


def f_store_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search_items(_items(spark, d), _search_rows(spark, d), "1 urg*").select("id")


def i_reentrancy(spark: SparkSession, d: str) -> DataFrame:
    events = _load(spark, d, "SELECT concat('t', user_id) AS text, event_id AS seq FROM {events}")
    marks = _load(spark, d, "SELECT concat('t', user_id) AS text, CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END AS n FROM {events} WHERE event_id % 3 = 0")
    return I.own_writes(events, marks).select("text", "seq")


def i_history_match(spark: SparkSession, d: str) -> DataFrame:
    events = _load(spark, d, "SELECT c_custkey AS id, concat('n', c_nationkey) AS text FROM {customer}")
    history = _load(spark, d, "SELECT concat('h', s_suppkey) AS history_id, concat('n', s_nationkey) AS text, s_suppkey % 10 AS at FROM {supplier}")
    return I.history_match(events, history).select("id", "windows_id")


def i_paste_decision(spark: SparkSession, d: str) -> DataFrame:
    items = _load(spark, d, "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Protected' WHEN 1 THEN 'Expired' WHEN 2 THEN 'ReplacementFailed' ELSE 'Normal' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS expires_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'w' END AS windows_id, o_orderkey % 2 = 0 AS restored FROM {orders}")
    return items.select("id", I.paste_decision(F.col("state"), F.col("expires_at"), F.col("windows_id"), F.col("restored"), F.expr(NOW)).alias("decision"))


def i_ttl(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return items.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.expr(NOW))).agg(F.count(F.lit(1)).alias("live"), F.count_if("is_pinned").alias("pinned"))


def s_log_parse(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, _LOGS).select("id", S.parse_log(F.col("line")).alias("p")).select("id", "p.level", "p.category", "p.message")


def s_redact(spark: SparkSession, d: str) -> DataFrame:
    out, found = S.redact(F.col("line"))
    return _load(spark, d, _LOGS).select("id", out.alias("redacted"), F.size(found).cast("long").alias("n"))


def s_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("t"))
    return rows.select("id", F.size("t").cast("long").alias("n"), F.coalesce(F.get("t", F.size("t") - 1)["end"], F.lit(0)).cast("long").alias("last"))


_BIO = "SELECT c_custkey AS id, concat('user ', c_name, ' of nation ', c_nationkey, ' pays ', c_mktsegment) AS text FROM {customer}"


def s_bio(spark: SparkSession, d: str) -> DataFrame:
    rows = _load(spark, d, _BIO)
    spans = F.array(F.struct(F.lit(5).alias("start"), (F.lit(5) + F.length(F.lit("Customer#000000001"))).alias("end"), F.lit("PII").alias("label")))
    return rows.select("id", F.array_join(T.encode(T.tokens(F.col("text")), spans), " ").alias("tags"))


def s_bio_split_space(spark: SparkSession, d: str) -> DataFrame:
    rows = _load(spark, d, _BIO)
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("HOSTINFO").alias("label")), F.struct(F.lit(0).alias("start"), F.lit(60).alias("end"), F.lit("PII").alias("label")))
    return rows.select("id", F.array_join(T.encode_spaced(T.space_tokens(F.col("text")), spans), " ").alias("tags"))


def s_hash_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _load(spark, d, "SELECT p_partkey AS id, concat('tpl_', p_partkey) AS k FROM {part}")
    return rows.select("id", S.hash_split(F.col("k")).alias("split"))


def s_dedup(spark: SparkSession, d: str) -> DataFrame:
    return S.dedup_across(_records(spark, d).withColumn("ord", F.col("rec"))).select("rec", "split")


def s_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.split_statistics(_records(spark, d)).withColumn("split", F.coalesce("split", F.lit("_totals"))).withColumn("avg_tokens", F.round(F.col("avg_tokens") * 100).cast("long"))


def s_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("rec", T.record_errors(F.col("tokens"), F.col("tags")).alias("e"))
    return rows.select("rec", F.array_join("e", ",").alias("errors"))


def s_split_report(spark: SparkSession, d: str) -> DataFrame:
    return S.split_report(_records(spark, d)).select("split", "records", "duplicates")


def s_truncation(spark: SparkSession, d: str) -> DataFrame:
    return S.truncation(_records(spark, d), 5).select(F.col("longest").cast("long").alias("longest"), "over")


def s_family(spark: SparkSession, d: str) -> DataFrame:
    return S.family_distribution(_load(spark, d, "SELECT p_type AS family FROM {part}"))


def s_manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.manifest(_records(spark, d).withColumn("template_id", F.col("rec") % 97)).select("split", "records", "templates")


def e_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("rec", F.explode(T.decode(F.col("tags"))).alias("s"))
    return rows.select("rec", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.type").alias("type"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    true = _load(spark, d, _TRUE)
    judged = E.classify_predictions(_load(spark, d, _PRED), true)
    return judged, E.missed(judged, true)


def e_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[0].groupBy("type", "kind").agg(F.count(F.lit(1)).alias("n"))


def e_scores(spark: SparkSession, d: str) -> DataFrame:
    s = E.scores(*_judged(spark, d))
    return s.select("type", "tp", "fp", "fn", *(F.round(F.col(c) * 1_000_000).cast("long").alias(c) for c in ("precision", "recall", "f1")))


def e_confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(_judged(spark, d)[0])


def e_gates(spark: SparkSession, d: str) -> DataFrame:
    return E.gates(E.scores(*_judged(spark, d)))


def e_boundary_audit(spark: SparkSession, d: str) -> DataFrame:
    return E.boundary_audit(*_judged(spark, d)).select("rec", "type", *(F.col(c).cast("long").alias(c) for c in ("fp_start", "fp_end", "fn_start", "fn_end")))


def e_examples(spark: SparkSession, d: str) -> DataFrame:
    return E.examples(_judged(spark, d)[0]).select("kind", "type", "rec", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))


_LOGITS = "SELECT l_orderkey AS rec, l_linenumber AS n, l_partkey % 9 AS top, l_suppkey % 9 AS second FROM {lineitem}"


def l_bio_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = _load(spark, d, _LOGITS).select("rec", "n", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.when(k == F.col("top"), 5.0).when(k == F.col("second"), 1.0).otherwise(0.0)).alias("row"))
    packed = rows.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("n", "row"))).alias("x"))
    logits = F.transform("x", lambda t: t["row"])
    offsets = F.transform("x", lambda t, i: F.struct((i * 5).alias("start"), F.lit(4).alias("length")))
    out = packed.select("rec", F.explode(T.decode_logits(logits, offsets, 0.75)).alias("e"))
    return out.select("rec", F.col("e.category").alias("category"), F.col("e.start").cast("long").alias("start"), F.col("e.length").cast("long").alias("length"))


def s_tagged(spark: SparkSession, d: str) -> DataFrame:
    rows = _load(spark, d, "SELECT c_custkey AS id, concat('hi <PII>', c_name, '</PII>, see <HOSTINFO>h', c_nationkey, '.x</HOSTINFO> <b>') AS text FROM {customer}")
    parsed = rows.select("id", T.parse_tagged(F.col("text")).alias("p")).select("id", F.col("p.text").alias("text"), F.explode("p.spans").alias("s"))
    return parsed.select("id", "text", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.label").alias("label"))


def s_generate(spark: SparkSession, d: str) -> DataFrame:
    rows = G.generate(_load(spark, d, "SELECT concat('t', p_partkey) AS template_id, p_type AS family, concat(p_type, ' {{IPV4}} and {{VERSION}} by {{NAME}}') AS template FROM {part}"), 2)
    return rows.select("template_id", "n", "split", "text", F.size("spans").alias("spans"))


def s_minimal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.minimal_pairs(spark, _load(spark, d, "SELECT p_partkey AS n FROM {part}")).select("pair", "n", "kind", "text", F.size("spans").alias("spans"))


def i_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = _load(spark, d, "SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 = 0 AS c, CASE WHEN o_orderkey % 7 < 4 THEN o_orderpriority END AS text FROM {orders}")
    kind = I.content_type(F.col("a"), F.col("b"), F.col("c"), F.col("text").isNotNull())
    return rows.select("id", kind.alias("kind"), I.listing(kind, F.col("text")).alias("shown"))


def r_list_edit(spark: SparkSession, d: str) -> DataFrame:
    rows = _load(spark, d, "SELECT p_partkey AS id, array(concat(' ', p_brand), p_brand, '', p_type) AS v, p_name AS n, p_type AS t FROM {part}")
    return rows.select("id", F.array_join(R.edit_list(F.col("v"), F.col("n"), F.col("t")), "|").alias("values"))


def l_wordpiece(spark: SparkSession, d: str) -> DataFrame:
    vocab = ml.load_vocabulary(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *("##" + c for c in "abcdefghijklmnopqrstuvwxyz"), ".", ",", "the", "##ing", "##tion"])
    # whole texts: a text has fewer pieces than this bound, which only a model's input needs lower
    rows = ml.tokenize(spark.read.parquet(f"{d}/conversations.parquet"), vocab, most=1 << 31).select("conv_id", "turn", F.size("pieces.ids").alias("n"), F.size(F.filter("pieces.ids", lambda x: x == 1)).alias("unknown"))
    return rows


_JUDGED = f"""t AS (SELECT * FROM ({_sql(_TRUE)})), p AS (SELECT * FROM ({_sql(_PRED)})),
x AS (SELECT p.rec, p.start, p."end", p.type, t.start AS ts, t."end" AS te, t.type AS tt,
  coalesce(p.start = t.start AND p."end" = t."end" AND p.type = t.type, false) AS same, coalesce(greatest(p.start, t.start) < least(p."end", t."end"), false) AS over FROM p LEFT JOIN t ON t.rec = p.rec),
h AS (SELECT rec, start, "end", type, bool_or(same) AS exact, min(CASE WHEN over THEN struct_pack(a := ts, b := te, c := tt) END) AS f FROM x GROUP BY ALL),
k AS (SELECT rec, start, "end", type, exact, f.a AS ts, f.b AS te, f.c AS tt FROM h),
j AS (SELECT rec, start, "end", type, CASE WHEN exact THEN 'Exact' WHEN ts IS NULL THEN 'Spurious' WHEN tt <> type THEN 'WrongType' WHEN start >= ts AND "end" <= te THEN 'Truncated' WHEN start <= ts AND "end" >= te THEN 'OverExtended' ELSE 'Boundary' END AS kind,
  CASE WHEN exact THEN start ELSE ts END AS ts, CASE WHEN exact THEN "end" ELSE te END AS te, CASE WHEN exact THEN type ELSE tt END AS tt FROM k),
m AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.rec = t.rec AND j.ts = t.start AND j.te = t."end" AND j.tt = t.type)),
c AS (SELECT type, CASE WHEN kind = 'Exact' THEN 'tp' ELSE 'fp' END AS k FROM j UNION ALL SELECT type, 'fn' FROM m),
n AS (SELECT type, count(*) FILTER (WHERE k = 'tp') AS tp, count(*) FILTER (WHERE k = 'fp') AS fp, count(*) FILTER (WHERE k = 'fn') AS fn FROM (SELECT * FROM c UNION ALL SELECT 'ALL', k FROM c) GROUP BY type),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM n)"""
_REC = f"l AS ({_sql(_LINES)}), rec AS (SELECT rec, list(token ORDER BY n, token, tag) AS tokens, list(tag ORDER BY n, token, tag) AS tags FROM l GROUP BY rec)"
_REC_SPLIT = _REC + ", k AS (SELECT DISTINCT rec % 97 AS k FROM rec), ks AS (SELECT k, list_reduce(list_prepend(0, list_transform(range(1, 33), lambda i: strpos('0123456789abcdef', substr(md5('t' || k), i, 1)) - 1)), lambda a, b: (a * 16 + b) % 100) AS b FROM k), sp AS (SELECT rec.*, CASE WHEN b < 15 THEN 'test' WHEN b < 30 THEN 'val' ELSE 'train' END AS split FROM rec JOIN ks ON ks.k = rec.rec % 97)"
_NORMAL = "CASE WHEN protection_state IN ('Normal', 'Protected', 'Expired', 'ReplacementFailed') THEN protection_state ELSE 'Normal' END AS protection_state, coalesce(safe_text, '') AS safe_text, primary_category, is_pinned"
_I = _sql(_ITEMS)
_TOKENS = r"""concat(' ', array_to_string(regexp_extract_all(lower(replace(search_text, 'é', 'e')), '[\p{L}\p{N}]+'), ' '))"""
_SR = f"SELECT item_id AS id FROM ({_sql(_SEARCH)}) WHERE "

QUERIES: dict[str, tuple[Query, str | None]] = {
    "r_recent_topk": (r_recent_topk, f"SELECT id, is_pinned FROM ({_I}) ORDER BY is_pinned DESC, created_at DESC, id LIMIT 50"),
    "r_rows": (r_rows, f"SELECT id, {_NORMAL} FROM ({_I})"),
    "r_get": (r_get, f"SELECT id, {_NORMAL} FROM ({_I}) WHERE id = '77'"),
    "r_delete": (r_delete, "SELECT CAST(o_orderkey AS VARCHAR) AS id, k AS kind FROM orders, (VALUES ('item'), ('search')) v(k) WHERE o_orderstatus IS DISTINCT FROM 'F'"),
    "r_clear_unpinned": (r_clear_unpinned, "SELECT CAST(o_orderkey AS VARCHAR) AS id, k AS kind FROM orders, (VALUES ('item'), ('search')) v(k) WHERE o_orderkey % 7 = 0"),
    "r_expire": (r_expire, f"SELECT id FROM ({_I}) WHERE expires_at IS NULL OR expires_at > {NOW}"),
    "r_pin": (r_pin, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey = 5"),
    "r_migrate_v1": (r_migrate_v1, "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 1 THEN 'Protected' ELSE 'Normal' END AS protection_state, o_orderpriority AS safe_text, o_orderkey % 3 = 1 AS is_pinned FROM orders"),
    "r_replay": (
        r_replay,
        """WITH l AS (SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'pin' WHEN 2 THEN 'unpin' ELSE 'insert' END AS op, CAST(user_id AS VARCHAR) AS id FROM events),
        b AS (SELECT id, max(seq) FILTER (WHERE op = 'insert') AS i, max(seq) FILTER (WHERE op = 'delete') AS d FROM l GROUP BY id)
        SELECT b.id, coalesce((SELECT arg_max(op, seq) FROM l WHERE l.id = b.id AND l.seq > b.i AND op IN ('pin', 'unpin')) = 'pin', false) AS is_pinned FROM b WHERE i IS NOT NULL AND (d IS NULL OR d < i)""",
    ),
    "r_settings": (r_settings, "SELECT * FROM (VALUES (0, true, true, 0, 75), (1, true, true, 0, 75), (2, true, true, 0, 75), (3, false, true, 1, 75), (4, true, true, 0, 50)) v(id, mask_emails, mask_phones, domains, threshold)"),
    "f_phrase_prefix": (_searches("café-1"), _SR + f"contains({_TOKENS}, ' cafe 1')"),
    "f_empty_term": (_searches("caf -"), _SR + "false"),
    "f_store_search": (f_store_search, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "i_reentrancy": (
        i_reentrancy,
        """WITH e AS (SELECT concat('t', user_id) AS text, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
        m AS (SELECT concat('t', user_id) AS text, greatest(sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END), 0) AS n FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
        SELECT e.text, seq FROM e LEFT JOIN m ON m.text = e.text WHERE k > coalesce(n, 0)""",
    ),
    "i_history_match": (
        i_history_match,
        "SELECT c_custkey AS id, w AS windows_id FROM customer LEFT JOIN (SELECT s_nationkey, arg_max(concat('h', s_suppkey), (s_suppkey % 10, concat('h', s_suppkey))) AS w FROM supplier GROUP BY s_nationkey) ON s_nationkey = c_nationkey",
    ),
    "i_paste_decision": (
        i_paste_decision,
        f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 OR (o_orderkey % 3 = 0 AND o_orderdate <= {NOW}) THEN 'Expired' WHEN o_orderkey % 4 = 2 THEN 'ProtectionFailure' WHEN o_orderkey % 4 = 0 THEN 'SafeText'
        WHEN o_orderkey % 5 = 0 THEN 'Unavailable' WHEN o_orderkey % 2 = 0 THEN 'Restored' ELSE 'RestoreFailed' END AS decision FROM orders""",
    ),
    "i_ttl": (i_ttl, f"SELECT count(*) AS live, count(*) FILTER (WHERE is_pinned) AS pinned FROM ({_I}) WHERE expires_at IS NULL OR expires_at > {NOW}"),
    "s_log_parse": (
        s_log_parse,
        f"SELECT id, nullif(regexp_extract(line, '{S.LOG_LINE}', 2), '') AS level, nullif(regexp_extract(line, '{S.LOG_LINE}', 3), '') AS category, CASE WHEN regexp_matches(line, '{S.LOG_LINE}') THEN regexp_extract(line, '{S.LOG_LINE}', 4) ELSE line END AS message FROM ({_sql(_LOGS)})",
    ),
    "s_redact": (
        s_redact,
        "SELECT id, {r} AS redacted, {n} AS n FROM ({src})".format(
            src=_sql(_LOGS),
            n=" + ".join(f"len(regexp_extract_all(line, {O.quoted(p)}))" for p, _ in S.REDACTIONS),
            r=functools.reduce(lambda acc, x: f"CASE WHEN regexp_matches(line, {O.quoted(x[0])}) THEN regexp_replace({acc}, {O.quoted(x[0])}, '{x[1]}', 'g') ELSE {acc} END", S.REDACTIONS[2:5], "line"),
        ),
    ),
    "s_tokens": (s_tokens, r"SELECT doc_id AS id, len(regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]')) AS n, length(regexp_replace(coalesce(text, ''), '\s+$', '')) AS last FROM documents"),
    "s_bio": (s_bio, None),
    "s_bio_split_space": (s_bio_split_space, None),
    "s_hash_split": (s_hash_split, "SELECT p_partkey AS id, CASE WHEN b < 15 THEN 'test' WHEN b < 30 THEN 'val' ELSE 'train' END AS split FROM (SELECT p_partkey, list_reduce(list_prepend(0, list_transform(range(1, 33), lambda i: strpos('0123456789abcdef', substr(md5('tpl_' || p_partkey), i, 1)) - 1)), lambda a, b: (a * 16 + b) % 100) AS b FROM part)"),
    "s_dedup": (s_dedup, f"WITH {_REC_SPLIT} SELECT rec, split FROM (SELECT rec, split, row_number() OVER (PARTITION BY array_to_string(tokens, ' ') ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, rec) AS k FROM sp) WHERE k = 1"),
    "s_stats": (
        s_stats,
        f"""WITH {_REC_SPLIT} SELECT coalesce(split, '_totals') AS split, count(*) AS records, CAST(sum(len(tokens)) AS BIGINT) AS tokens, CAST(round(round_even(avg(len(tokens)), 2) * 100) AS BIGINT) AS avg_tokens, max(len(tokens)) AS max_tokens, min(len(tokens)) AS min_tokens,
        {', '.join(f"CAST(sum(len(list_filter(tags, lambda t: t = 'B-{k}'))) AS BIGINT) AS {k.lower()}" for k in T.TYPES)} FROM sp GROUP BY ROLLUP (split)""",
    ),
    "s_validate": (
        s_validate,
        f"WITH {_REC} SELECT rec, CASE WHEN len(list_filter(range(1, len(tags) + 1), lambda i: tags[i][1:2] = 'I-' AND (i = 1 OR tags[i - 1][3:] IS DISTINCT FROM tags[i][3:]))) > 0 THEN 'transition' ELSE '' END AS errors FROM rec",
    ),
    "s_split_report": (s_split_report, f"WITH {_REC_SPLIT} SELECT split, count(*) AS records, count(*) - count(DISTINCT array_to_string(tokens, ' ')) AS duplicates FROM sp GROUP BY split"),
    "s_truncation": (s_truncation, f"WITH {_REC} SELECT max(len(tokens)) AS longest, count(*) FILTER (WHERE len(tokens) > 5) AS over FROM rec"),
    "s_family": (s_family, "SELECT p_type AS family, count(*) AS n FROM part GROUP BY p_type"),
    "s_manifest": (s_manifest, f"WITH {_REC_SPLIT} SELECT split, count(*) AS records, count(DISTINCT rec % 97) AS templates FROM sp GROUP BY split"),
    "e_spans": (
        e_spans,
        f"""WITH {_REC}, u AS (SELECT rec, unnest(tags) AS tag, unnest(range(len(tags))) AS i FROM rec),
        b AS (SELECT *, lag(tag[3:]) OVER w AS before, lag(tag) OVER w AS ptag FROM u WINDOW w AS (PARTITION BY rec ORDER BY i)),
        g AS (SELECT *, sum(CASE WHEN tag[1:2] = 'I-' AND before = tag[3:] THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY i) AS island FROM b)
        SELECT rec, min(i) AS start, max(i) + 1 AS "end", arg_min(tag[3:], i) AS type FROM g GROUP BY rec, island HAVING arg_min(tag[1:2], i) = 'B-'""",
    ),
    "e_taxonomy": (e_taxonomy, f"WITH {_JUDGED} SELECT type, kind, count(*) AS n FROM j GROUP BY type, kind"),
    "e_scores": (e_scores, f"WITH {_JUDGED} SELECT type, tp, fp, fn, CAST(round(p * 1000000) AS BIGINT) AS precision, CAST(round(r * 1000000) AS BIGINT) AS recall, CAST(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * 1000000) AS BIGINT) AS f1 FROM s"),
    "e_confusion": (e_confusion, f"WITH {_JUDGED} SELECT tt AS true_type, type AS pred_type, count(*) AS n FROM j WHERE kind = 'WrongType' GROUP BY tt, type"),
    "e_gates": (
        e_gates,
        f"WITH {_JUDGED} SELECT g.type, coalesce(p, 0) >= lp AS precision_ok, coalesce(r, 0) >= lr AS recall_ok FROM (VALUES {', '.join(map(str, E.GATES))}) g(type, lp, lr) LEFT JOIN s ON s.type = g.type",
    ),
    "e_boundary_audit": (e_boundary_audit, f'WITH {_JUDGED} SELECT j.rec, j.type, j.start AS fp_start, j."end" AS fp_end, m.start AS fn_start, m."end" AS fn_end FROM j JOIN m ON m.rec = j.rec AND m.type = j.type WHERE kind <> \'Exact\''),
    "e_examples": (e_examples, f'WITH {_JUDGED} SELECT kind, type, rec, start, n FROM (SELECT *, row_number() OVER (PARTITION BY kind, type ORDER BY rec, start, "end") AS n FROM j) WHERE n <= 10'),
    "s_tagged": (
        s_tagged,
        """SELECT id, text, start, "end", label FROM (SELECT c_custkey AS id, concat('hi ', c_name, ', see h', c_nationkey, '.x <b>') AS text, unnest([
          {'start': 3, 'end': 3 + length(c_name), 'label': 'PII'}, {'start': 9 + length(c_name), 'end': 12 + length(c_name) + length(CAST(c_nationkey AS VARCHAR)), 'label': 'HOSTINFO'}], recursive := true) FROM customer)""",
    ),
    "s_generate": (s_generate, None),
    "s_minimal_pairs": (s_minimal_pairs, None),
    "i_listing": (
        i_listing,
        """SELECT id, kind, CASE WHEN kind = 'Image' THEN '[image]' WHEN text <> '' THEN text WHEN kind = 'Html' THEN '[html]' WHEN kind = 'Rtf' THEN '[rich text]' ELSE '[unknown]' END AS shown FROM (
          SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 4 THEN o_orderpriority END AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'Image' WHEN o_orderkey % 3 = 0 THEN 'Html' WHEN o_orderkey % 5 = 0 THEN 'Rtf' WHEN o_orderkey % 7 < 4 THEN 'Text' ELSE 'Unknown' END AS kind FROM orders)""",
    ),
    "r_list_edit": (r_list_edit, "SELECT p_partkey AS id, trim(p_brand) || '|' || trim(p_name) AS values FROM part"),
    "l_bio_decode": (l_bio_decode, None),
    "l_wordpiece": (l_wordpiece, None),
}

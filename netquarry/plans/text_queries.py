"""Registered queries: secrets, pseudonyms, publication audit, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions.secrets import NAME_IN_TEXT, SECRET_PATTERNS
from netquarry.operators import publish as P
from netquarry.operators import redact as R
from netquarry.operators.documents import admit_documents
from netquarry.plans import adapters as A
from netquarry.plans.registry import query

_LEFT, _RIGHT = r"(?:^|[^\p{L}\p{Nd}_])", r"(?:$|[^\p{L}\p{Nd}_])"


def _re2(pattern: str) -> str:
    """The same pattern with Unicode-aware word edges spelled out, for a yes/no match."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern.removeprefix("(?i)").replace(r"credential)\b\s*", r"credential)\s*")
    if body.startswith(r"\b"):
        body = _LEFT + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + _RIGHT
    return (flags + body).replace("'", "''")


def _scan_sql(source: str, key: str) -> str:
    parts = []
    for name, pattern in SECRET_PATTERNS:
        if name == "base64_blob":
            test = (
                "len(list_filter(regexp_extract_all(text, '[A-Za-z0-9+/]{60,}'), lambda x: regexp_matches(x, '[a-z]')"
                " AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]'))) > 0"
            )
        else:
            test = f"regexp_matches(text, '{_re2(pattern)}')"
        parts.append(f"CASE WHEN {test} THEN '{name}' END")
    return f"SELECT {key}, concat_ws(',', {', '.join(parts)}) AS patterns FROM {source}"


# every text is followed by one of nine crafted tails, so that each pattern occurs
_TAILS = [
    "", " AKIA" + "ABCDEFGH1234XY", " -----BEGIN RSA PRIVATE KEY-----", " eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl",
    " Authorization: Bearer abcdefghijklmnop1234", " api_key = s3cr3tvalue", " ghp_abcdefghijkl",
    " MII" + "Ab1" * 15, " " + "aB3d" * 16,
]
_TAIL_SQL = "[" + ", ".join("'" + t + "'" for t in _TAILS) + "]"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.array(*[F.lit(t) for t in _TAILS])
    return A.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("text", F.element_at(tails, (F.col("doc_id") % 9 + 1).cast("int"))).alias("text"),
    )


@query(
    "scan_secrets",
    f"WITH d AS (SELECT doc_id, text || {_TAIL_SQL}[doc_id % 9 + 1] AS text FROM documents) " + _scan_sql("d", "doc_id"),
)
def q_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.scan_secrets(_documents(spark, sf_dir), "text")
    return found.select("doc_id", F.array_join("patterns", ",").alias("patterns"))


@query(
    "clean_free_text",
    f"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0a-\\x1f\\x7f-\\x9f]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text
                   FROM conversations),
    s AS ({_scan_sql("c", "conv_id, turn, text")})
    SELECT conv_id, turn, CASE WHEN text <> '' AND patterns = '' THEN text END AS clean FROM s""",
)
def q_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.clean_free_text(A.table(spark, sf_dir, "conversations"), "text")
    return rows.select("conv_id", "turn", "clean")


# text with addresses at known places: built in both engines from the row's numbers
_LOG = """'host ' || src || ' reached ' || dest || ' and 10.0.0.1 not 10.0.0.10 via gw' || (k % 3) || '.example.com (n=' || k || ')'"""
_LOG_SQL = f"""
WITH {A.FLOWS_SQL},
l AS (SELECT src_num % 40 AS c, id, src, dest, back AS k, {_LOG.replace("src", "src").replace(" k ", " back ").replace("(k", "(back").replace("|| k ||", "|| back ||")} AS text FROM flows),
m AS (SELECT c, id, unnest([src, dest, '10.0.0.1', '10.0.0.10', 'gw' || (k % 3) || '.example.com']) AS value,
             unnest([0, 1, 2, 3, 4]) AS pos FROM l),
f AS (SELECT c, value, min(id || '-' || pos) AS seen FROM m GROUP BY c, value),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY seen) AS r FROM f),
t AS (SELECT c, value, kind || '-' || row_number() OVER (PARTITION BY c, kind ORDER BY r) AS token
      FROM (SELECT *, CASE WHEN value LIKE '10.%' THEN 'int' WHEN value LIKE '203.%' THEN 'ext' ELSE 'domain' END AS kind FROM r))"""


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = A.flows(spark, sf_dir)
    k = F.col("pkts_toclient")
    last = F.element_at(F.split("src_ip", r"\."), 4).cast("bigint")
    third = F.element_at(F.split("src_ip", r"\."), 3).cast("bigint")
    second = F.element_at(F.split("src_ip", r"\."), 2).cast("bigint")
    number = F.lit(10 * 2**24) + second * 65536 + third * 256 + last
    return flows.select(
        (number % 40).alias("c"),
        "id",
        F.concat(
            F.lit("host "), "src_ip", F.lit(" reached "), "dest_ip",
            F.lit(" and 10.0.0.1 not 10.0.0.10 via gw"), (k % 3).cast("string"),
            F.lit(".example.com (n="), k.cast("string"), F.lit(")"),
        ).alias("text"),
    )


@query("token_numbers", _LOG_SQL + " SELECT c, value, token FROM t")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mapping = R.pseudonymize(_log_lines(spark, sf_dir), "c", "text", ["id"])
    return mapping


@query(
    "pseudonymize",
    _LOG_SQL
    + """ SELECT l.id, 'host ' || a.token || ' reached ' || b.token || ' and ' || x.token || ' not ' || y.token || ' via ' || z.token
          || ' (n=' || l.k || ')' AS text
     FROM l JOIN t a ON a.c = l.c AND a.value = l.src JOIN t b ON b.c = l.c AND b.value = l.dest
     JOIN t x ON x.c = l.c AND x.value = '10.0.0.1' JOIN t y ON y.c = l.c AND y.value = '10.0.0.10'
     JOIN t z ON z.c = l.c AND z.value = 'gw' || (l.k % 3) || '.example.com'""",
)
def q_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scrubbed, _ = R.pseudonymize(_log_lines(spark, sf_dir), "c", "text", ["id"])
    return scrubbed.select("id", "text")


_NAME_SQL = NAME_IN_TEXT.replace("'", "''")


@query(
    "names_in_documents",
    f"""SELECT page_id, len(regexp_extract_all(html, '{_NAME_SQL}')) > 0 AS has_names FROM pages""",
)
def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netquarry.functions.secrets import names_in_text

    return A.table(spark, sf_dir, "pages").select(
        "page_id", (F.size(names_in_text(F.col("html"))) > 0).alias("has_names")
    )


@query("pseudonymize_documents")
def q_pseudonymize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    scrubbed, _ = R.pseudonymize(docs, "source", "text", ["doc_id"])
    return scrubbed.select("doc_id", F.md5("text").alias("digest"))


# ------------------------------------------------------------------ publication

_RECORD_SQL = """
WITH r AS (SELECT event_id, event_type, user_id, event_id % 9 AS shape,
  CASE event_id % 9
    WHEN 0 THEN '{"event_type":"flow","src_ip":"10.0.0.' || (user_id % 250) || '","dest_ip":"8.8.8.8","flow":{"age":' || event_id || '}}'
    WHEN 1 THEN '{"event_type":"http","http":{"hostname":"a.example.com","url":"/x?token=1","cookie":"c' || event_id || '"}}'
    WHEN 2 THEN '{"event_type":"stats","uptime":' || event_id || '}'
    WHEN 3 THEN '{"event_type":"dns","dns":{"answers":[{"rdata":"192.0.2.1"},{"rdata":"mail.acme.org"}]}}'
    WHEN 4 THEN '{"event_type":"alert","alert":{"signature":"ok","extra":{"rdata":"1.2.3.4"}}'
    WHEN 5 THEN '{"event_type":"flow","src_ip":"192.168.1.1","proto":"TCP"}'
    WHEN 6 THEN '{"event_type":"flow","flow":' || repeat('{"flow":', 25) || event_id || repeat('}', 26)
    WHEN 7 THEN '[' || event_id || ',2]'
    ELSE '{"src_ip":"10.0.0.' || (user_id % 250) || '"}' END AS line FROM events)"""
# shape 4 lacks a brace, so it is not JSON; 6 is too deep, 7 not an object, 8 has no type
_PROBLEMS_SQL = """
SELECT event_id, path, problem FROM r JOIN (VALUES
  (0, 'dest_ip', 'address'), (1, 'http.url', 'secret_parameter'), (1, 'http.cookie', 'content_key'),
  (2, 'event_type', 'sensor_record'), (2, 'uptime', 'unclassified_key'),
  (3, 'dns.answers[1].rdata', 'name'), (4, '', 'not_json'),
  (6, rtrim(repeat('flow.', 25), '.'), 'too_deep'), (7, '', 'not_an_object'),
  (8, '', 'no_event_type')) AS v(shape, path, problem) USING (shape)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id").cast("string")
    uid = (F.col("user_id") % 250).cast("string")
    shapes = [
        F.concat(F.lit('{"event_type":"flow","src_ip":"10.0.0.'), uid, F.lit('","dest_ip":"8.8.8.8","flow":{"age":'), eid, F.lit("}}")),
        F.concat(F.lit('{"event_type":"http","http":{"hostname":"a.example.com","url":"/x?token=1","cookie":"c'), eid, F.lit('"}}')),
        F.concat(F.lit('{"event_type":"stats","uptime":'), eid, F.lit("}")),
        F.lit('{"event_type":"dns","dns":{"answers":[{"rdata":"192.0.2.1"},{"rdata":"mail.acme.org"}]}}'),
        F.lit('{"event_type":"alert","alert":{"signature":"ok","extra":{"rdata":"1.2.3.4"}}'),
        F.lit('{"event_type":"flow","src_ip":"192.168.1.1","proto":"TCP"}'),
        F.concat(F.lit('{"event_type":"flow","flow":' + '{"flow":' * 25), eid, F.lit("}" * 26)),
        F.concat(F.lit("["), eid, F.lit(",2]")),
        F.concat(F.lit('{"src_ip":"10.0.0.'), uid, F.lit('"}')),
    ]
    line = F.element_at(F.array(*shapes), (F.col("event_id") % 9 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("publish_audit", _RECORD_SQL + _PROBLEMS_SQL)
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.publish_audit(_records(spark, sf_dir), "line", "event_id")


@query(
    "strip_content",
    _RECORD_SQL
    + """ SELECT event_id, path, value FROM (
     SELECT event_id, unnest(['event_type', 'src_ip', 'dest_ip', 'flow.age']) AS path,
            unnest(['flow', '10.0.0.' || (user_id % 250), '8.8.8.8', CAST(event_id AS VARCHAR)]) AS value FROM r WHERE shape = 0
     UNION ALL SELECT event_id, unnest(['event_type', 'http.hostname', 'http.url']), unnest(['http', 'a.example.com', '/x?token=1']) FROM r WHERE shape = 1
     UNION ALL SELECT event_id, unnest(['event_type', 'dns.answers[0].rdata', 'dns.answers[1].rdata']), unnest(['dns', '192.0.2.1', 'mail.acme.org']) FROM r WHERE shape = 3
     UNION ALL SELECT event_id, unnest(['event_type', 'src_ip', 'proto']), unnest(['flow', '192.168.1.1', 'TCP']) FROM r WHERE shape = 5)""",
)
def q_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, _ = P.strip_content(_records(spark, sf_dir), "line", "event_id")
    return leaves.select("event_id", "path", "value")


@query(
    "strip_content_dropped",
    _RECORD_SQL
    + """ SELECT reason, count(*) AS n FROM r JOIN (VALUES (2, 'sensor_record'), (4, 'unreadable'),
     (6, 'too_deep'), (7, 'not_an_object'), (8, 'no_event_type')) AS v(shape, reason) USING (shape)
     GROUP BY reason""",
)
def q_strip_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dropped = P.strip_content(_records(spark, sf_dir), "line", "event_id")
    return dropped


@query(
    "sanitize_problems",
    _RECORD_SQL
    + """ SELECT event_id, path, problem FROM r JOIN (VALUES (0, 'dest_ip', 'address'),
     (1, 'http.url', 'secret_parameter'), (3, 'dns.answers[1].rdata', 'name')) AS v(shape, path, problem)
     USING (shape)""",
)
def q_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, problems = P.sanitize(_records(spark, sf_dir), "line", "event_id")
    return problems


@query(
    "flatten_json",
    """SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS value
       FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
)
def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.flatten_json(A.table(spark, sf_dir, "events"), "props", "event_id")
    return nodes.filter("depth = 1").select(
        "event_id", F.concat(F.lit("$."), "path").alias("path"), "value"
    )


# ------------------------------------------------------------------ documents

_DOC_TAIL = '"recommendations":[{"action":"monitor","detail":"watch"}],"citations":[{"id":1,"url":"'


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored response per order; what is wrong with it follows from its number."""
    key = F.col("o_orderkey")
    n = key.cast("string")
    bad = (key % 7).cast("int")
    summary = F.when(bad == 1, F.lit("we should hack back ")).otherwise(F.lit("seen order ")) 
    kind = F.when(bad == 2, F.lit("external")).otherwise(F.lit("observed"))
    cited = F.when(bad == 3, F.lit("[2]")).when(bad == 2, F.lit("[]")).otherwise(F.lit("[1]"))
    url = F.when(bad == 4, F.lit("http://x.example/a")).otherwise(F.lit("https://x.example/a"))
    extra = F.when(bad == 5, F.lit(',"note":1')).otherwise(F.lit(""))
    end = F.when(bad == 6, F.lit("")).otherwise(F.lit("}"))
    doc = F.concat(
        F.lit('{"summary":"'), summary, n, F.lit('","claims":[{"text":"c","kind":"'), kind,
        F.lit('","citations":'), cited, F.lit("}],"), F.lit(_DOC_TAIL), url,
        F.lit('","title":"t"}]'), extra, end,
    )
    return A.table(spark, sf_dir, "orders").select(key.alias("doc"), doc.alias("body"))


@query(
    "admit_documents",
    """SELECT o_orderkey AS doc, o_orderkey % 7 = 2 AS has_unverified FROM orders WHERE o_orderkey % 7 IN (0, 2)""",
)
def q_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted, _ = admit_documents(_responses(spark, sf_dir), "body")
    return admitted.select("doc", "has_unverified")


@query(
    "refuse_documents",
    """SELECT o_orderkey AS doc, ['safety:offensive_action', '', 'dangling_citation', 'schema', 'schema', 'not_json'][o_orderkey % 7] AS reason
       FROM orders WHERE o_orderkey % 7 IN (1, 3, 4, 5, 6)""",
)
def q_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, refused = admit_documents(_responses(spark, sf_dir), "body")
    return refused.select("doc", "reason")

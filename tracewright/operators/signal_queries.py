"""Queries of text attention over documents, conversations and events.

The event log is one text for each user and one line for each event. Its SQL knows from the event's
number what each line is like (template, features, delimiter), so it shares no pattern with the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import signal as S
from tracewright.operators import signal_lists as L
from tracewright.queries import query, table

_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM documents),
n AS (SELECT *, trim(line, ' ') = '' AS blank FROM l)"""


def _docs(spark, sf_dir):
    return S.lines(table(spark, sf_dir, "documents"), "doc_id")


@query("signal_segments", f"""WITH {_LINES}, s AS (SELECT *, (blank AND NOT coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true))::INTEGER AS b FROM n)
SELECT doc_id, line_no, blank, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no)::INTEGER AS block FROM s""")
def _segments(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "line_no", "blank", "block")


@query("signal_validation", """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s, len(string_split(text, chr(10))) AS n FROM t)
SELECT doc_id, strlen(text)::INTEGER AS bytes, (CASE WHEN text = '' THEN 0 ELSE n END)::INTEGER AS lines,
  list_filter([CASE WHEN len(s) = 0 THEN 'empty' END, CASE WHEN strlen(text) > 2097152 THEN 'too_large' END, CASE WHEN n > 20000 THEN 'too_many_lines' END], lambda x: x IS NOT NULL)::VARCHAR[] AS errors,
  list_filter([CASE WHEN len(s) < 5 THEN 'small' END], lambda x: x IS NOT NULL)::VARCHAR[] AS warnings FROM l""")
def _validation(spark, sf_dir):
    return S.validation(table(spark, sf_dir, "documents"), "doc_id")


_RECORDS = "CASE event_id % 5 WHEN 0 THEN '{{' || {nl} || '\"id\": ' || event_id || '}}' WHEN 1 THEN '<row>' || {nl} || event_id || '</row>' WHEN 2 THEN 'a,b,c' || {nl} || event_id || ',2,3' || {nl} || '4,5,6' WHEN 3 THEN 'a: 1' || {nl} || 'b: 2' || {nl} || '- c: 3' || {nl} || 'd: ' || event_id ELSE 'a line' || {nl} || 'and {{ a line' END"


@query("signal_routing", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'JSON' WHEN 1 THEN 'XML' WHEN 2 THEN 'CSV' WHEN 3 THEN 'YAML' END AS format FROM events")
def _routing(spark, sf_dir):
    return S.routing(table(spark, sf_dir, "events").select("event_id", F.expr(_RECORDS.format(nl="char(10)")).alias("text")), "event_id")


@query("signal_transitions", """WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS symbol FROM events)
SELECT previous, symbol, count(*) AS n FROM p WHERE previous IS NOT NULL GROUP BY ALL""")
def _transitions(spark, sf_dir):
    return S.transitions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


_LOG = """CASE event_id % 64 WHEN 0 THEN 'ERROR job ' || (event_id + 100) || ' failed after 12 ms' WHEN 1 THEN '0 errors found' WHEN 2 THEN 'Users must not share keys'
WHEN 3 THEN 'unless an admin is present.' WHEN 4 THEN 'WARN: deprecated call' WHEN 5 THEN '' WHEN 6 THEN '  ' WHEN 7 THEN '' WHEN 8 THEN '  nested a=1 b=2'
ELSE 'INFO job ' || (event_id + 100) || ' done, took ' || (event_id % 90 + 10) || ' ms' END"""
#: What each line is like; c is its template.
_KNOWN = f"""e AS (SELECT user_id, event_id AS line_no, event_id % 64 AS k, event_id + 100 AS id, {_LOG} AS line FROM events),
a AS (SELECT *, k IN (5, 6, 7) AS blank, CASE WHEN k NOT IN (5, 6, 7) THEN least(k, 9) END AS c, CASE WHEN k = 4 THEN ':' WHEN k = 8 THEN '=' WHEN k > 8 THEN ',' ELSE 'none' END AS delimiter, CASE WHEN k = 8 THEN 2 ELSE 0 END AS indent,
  CASE k WHEN 0 THEN ['failure', 'error'] WHEN 2 THEN ['prohibition', 'obligation'] WHEN 3 THEN ['exception'] WHEN 4 THEN ['warning'] ELSE [] END AS feats, (k IN (0, 4) OR k > 8)::INTEGER AS s, (k = 3)::INTEGER AS d FROM e),
b AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY line_no) AS block FROM (SELECT *, (blank AND NOT coalesce(lag(blank) OVER (PARTITION BY user_id ORDER BY line_no), true))::INTEGER AS opens FROM a))"""
_BREAKS = f"""{_KNOWN},
w AS (SELECT *, coalesce(list({{'c': c, 'd': delimiter, 'i': indent}}) FILTER (WHERE NOT blank) OVER (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING EXCLUDE CURRENT ROW), []) AS near, count(*) OVER (PARTITION BY user_id) AS every_line FROM b),
g AS (SELECT *, len(near) AS k8, count(*) OVER (PARTITION BY user_id) AS nonblank, count(*) OVER (PARTITION BY user_id, c) AS own, count(*) OVER (PARTITION BY user_id, line) AS same, min(line_no) OVER (PARTITION BY user_id, c) AS first_line, lag(c) OVER (PARTITION BY user_id ORDER BY line_no) AS prev,
  count(*) OVER (PARTITION BY user_id, block) AS in_block, count(*) OVER (PARTITION BY user_id, block, c) AS own_in_block FROM w WHERE NOT blank),
h AS (SELECT *, sum((own > 1)::INTEGER) OVER (PARTITION BY user_id) / nonblank AS shared, count(*) OVER (PARTITION BY user_id, prev) AS out_of, count(*) OVER (PARTITION BY user_id, prev, c) AS step, max(own_in_block) OVER (PARTITION BY user_id, block) AS top,
  list_filter(list_transform(near, lambda x: x.c), lambda x: x <> c) AS oc, list_filter(list_transform(near, lambda x: x.d), lambda x: x <> delimiter) AS od, list_filter(list_transform(near, lambda x: x.i), lambda x: x <> indent) AS oi FROM g),
m AS (SELECT *, coalesce(len(list_filter(oc, lambda x: x = list_aggregate(oc, 'mode'))), 0) AS mc, coalesce(len(list_filter(od, lambda x: x = list_aggregate(od, 'mode'))), 0) AS md, coalesce(len(list_filter(oi, lambda x: x = list_aggregate(oi, 'mode'))), 0) AS mi FROM h),
f AS (SELECT *, k8 >= 3 AND mc / k8 >= 0.6 AS f1, in_block >= 5 AND own_in_block = 1 AND top >= 3 AS f2, prev IS NOT NULL AND step = 1 AND out_of >= 3 AS f3, k8 >= 4 AND md / k8 >= 0.75 AS f4, k8 >= 4 AND mi / k8 >= 0.75 AS f5, own = 1 AND shared >= 0.35 AS f6, own <= 2 AND shared >= 0.35 AND first_line = line_no AS f7 FROM m),
k AS (SELECT *, list_filter([CASE WHEN f1 THEN 'neighbours' END, CASE WHEN f2 THEN 'section' END, CASE WHEN f3 THEN 'transition' END, CASE WHEN f4 THEN 'delimiter' END, CASE WHEN f5 THEN 'indentation' END, CASE WHEN f6 THEN 'rare' END, CASE WHEN f7 THEN 'introduced' END], lambda x: x IS NOT NULL) AS kinds,
  greatest(0, CASE WHEN f1 THEN 6200 + (5600 * mc + k8) // (2 * k8) END, CASE WHEN f2 THEN 6600 END, CASE WHEN f3 THEN 5800 END, CASE WHEN f4 THEN 4200 END, CASE WHEN f5 THEN 3600 END, CASE WHEN f6 THEN 2800 END) AS strength,
  greatest(0, CASE WHEN f1 THEN (20000 * mc + k8) // (2 * k8) END, CASE WHEN f2 THEN (20000 * top + in_block) // (2 * in_block) END, CASE WHEN f3 THEN 6500 END) AS local FROM f)"""
#: Novelty of ASCII lines, whose bytes are their characters, in ten-thousandths.
_NOVEL = """u AS (SELECT user_id, line_no, len(line) AS n, line, unnest(range(1, len(line) - 2, CASE WHEN len(line) > 48 THEN 2 ELSE 1 END)) AS i FROM e WHERE trim(line) <> ''),
v AS (SELECT user_id, g, min(line_no) AS line_no FROM (SELECT user_id, line_no, substr(line, i, 4) AS g FROM u) GROUP BY ALL),
z AS (SELECT u.user_id, u.line_no, any_value(u.n) AS n, count(*) AS sampled, any_value(coalesce(new, 0)) AS new FROM u LEFT JOIN (SELECT user_id, line_no, count(*) AS new FROM v GROUP BY ALL) q USING (user_id, line_no) GROUP BY ALL),
nov AS (SELECT user_id, line_no, least(CASE WHEN n < 20 THEN 4500 ELSE 10000 END, (20000 * new * greatest(0, least(48, n - 7)) + 48 * sampled) // (96 * sampled)) AS novelty FROM z)"""


def _log(spark, sf_dir):
    return S.marked(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), F.expr(_LOG).alias("line")), "user_id")


@query("signal_templates", f"""WITH {_KNOWN} SELECT user_id, CASE c WHEN 0 THEN 'ERROR job <integer> failed after <duration>' WHEN 8 THEN 'nested a=1 b=2' WHEN 9 THEN 'INFO job <integer> done, took <duration>' ELSE any_value(line) END AS template, count(*) AS lines, min(line_no) AS first_line
FROM a WHERE c IS NOT NULL GROUP BY user_id, c""")
def _templates(spark, sf_dir):
    return S.templates(_log(spark, sf_dir), "user_id")


#: The tokens in the dialect of DuckDB's patterns, which have no look-around and no back-references.
_CHAIN = (
    (r"(?i)\b\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d(:[0-5]\d(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?\b", "<timestamp>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<date>"),
    (r"\b[0-2]\d:[0-5]\d(:[0-5]\d(\.\d+)?)?\b", "<time>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b(\d{1,3}\.){3}\d{1,3}\b", "<ipv4>"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<email>"),
    (r"(?i)\bhttps?://[^\s<>\"')\]]+", "<url>"),
    (r"""\"(\\.|[^\"])*\"|'(\\.|[^'])*'""", "<quoted>"),
    (r"(?i)\b\d+(\.\d+)?\s?(ns|µs|us|ms|s|sec|secs|seconds?|m|min|mins|minutes?|h|hrs?|hours?)\b", "<duration>"),
    (r"\b\d+(\.\d+)?\s?(B|KB|KiB|MB|MiB|GB|GiB|TB)\b", "<bytes>"),
    (r"(?i)\b0x[0-9a-f]+\b|\b[0-9a-f]{16,}\b", "<hex>"),
    (r"\b[A-Za-z]:\\([^\\\s:*?\"<>|]+\\)*[^\\\s:*?\"<>|]*", "<windows-path>"),
    (r"^/([\w.@+-]+/)*[\w.@+-]+", "<unix-path>"),
    (r"([\s=(])/([\w.@+-]+/)*[\w.@+-]+", r"\1<path>"),
    *[(r"(^|[^\w.])-?\d+\.\d+($|[^\w.])", r"\1<decimal>\2")] * 2,  # twice: neighbours share what is between them
    (r"(\B-)?\b\d{2,}\b", "<integer>"),
    (r"[ \t]+", " "),
)


def _chain() -> str:
    sql = "line"
    for pattern, name in _CHAIN:
        sql = "regexp_replace({}, '{}', '{}', 'g')".format(sql, pattern.replace("'", "''"), name)
    return f"trim({sql})"


@query("signal_document_templates", f"WITH {_LINES} SELECT doc_id, {_chain()} AS template, count(*) AS lines, min(line_no) AS first_line FROM n WHERE NOT blank GROUP BY ALL")
def _document_templates(spark, sf_dir):
    return S.templates(_docs(spark, sf_dir), "doc_id")


@query("signal_exact_groups", f"WITH {_LINES} SELECT doc_id, line, count(*) AS lines, min(line_no) AS first_line FROM n WHERE NOT blank GROUP BY ALL")
def _exact(spark, sf_dir):
    return S.exact_groups(_docs(spark, sf_dir), "doc_id")


@query("signal_token_classes", f"""WITH {_KNOWN} SELECT user_id, line_no, CASE c WHEN 0 THEN '<upper> <word> <integer> <word> <word> <duration>' WHEN 1 THEN '<mixed> <word> <word>' WHEN 2 THEN '<word> <word> <word> <word> <word>' WHEN 3 THEN '<word> <word> <word> <word> <mixed>' WHEN 4 THEN '<mixed> <word> <word>'
WHEN 8 THEN '<word> <mixed> <mixed>' ELSE '<upper> <word> <integer> <mixed> <word> <duration>' END AS classes FROM a WHERE NOT blank""")
def _classes(spark, sf_dir):
    return _log(spark, sf_dir).where(~F.col("blank")).select("user_id", "line_no", F.array_join(S.token_classes(F.col("line")), " ").alias("classes"))


@query("signal_features", f"""WITH {_KNOWN}, t(k, feature, role, strength, value) AS (VALUES (0, 'failure', 'failure', 1.0, 'failed'), (0, 'error', 'failure', 0.88, 'ERROR'), (2, 'prohibition', 'constraint', 1.0, 'must not'), (2, 'obligation', 'constraint', 0.86, 'must'), (3, 'exception', 'exception', 0.9, 'unless'), (4, 'warning', 'warning', 0.72, 'WARN'))
SELECT user_id, line_no, feature, role, strength::DOUBLE AS strength, value FROM a JOIN t USING (k)""")
def _features(spark, sf_dir):
    return S.features(_log(spark, sf_dir), "user_id")


@query("signal_evidence", f"""WITH {_KNOWN} SELECT user_id, line_no, 'quantity' AS kind, CASE k WHEN 0 THEN '12 ms' WHEN 8 THEN '1 b' ELSE (line_no % 90 + 10) || ' ms' END AS value FROM a WHERE k = 0 OR k > 7""")
def _evidence(spark, sf_dir):
    return S.evidence(_log(spark, sf_dir), "user_id")


@query("signal_exception_link", f"""WITH {_KNOWN}, w AS (SELECT *, last_value(CASE WHEN k = 2 THEN line_no END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rule_line FROM a WHERE NOT blank)
SELECT user_id, line_no, rule_line FROM w WHERE k = 3 AND rule_line IS NOT NULL""")
def _links(spark, sf_dir):
    return S.exception_links(_log(spark, sf_dir), "user_id")


@query("signal_pattern_breaks", f"WITH {_BREAKS} SELECT user_id, line_no, unnest(kinds) AS kind, strength / 10000 AS strength, local / 10000 AS local FROM k")
def _breaks(spark, sf_dir):
    return S.breaks(_log(spark, sf_dir), "user_id")


#: Lines of a user that say nearly the same in other words.
_SAID = "CASE event_id % 5 WHEN 0 THEN 'Every service rotates its ' WHEN 1 THEN 'Note that every service rotates its ' WHEN 2 THEN 'every second service sometimes forgets ' WHEN 3 THEN 'Once more, every service rotates its ' ELSE 'nothing ' END || event_type || ' keys within days'"


@query("signal_restatements", f"""WITH c AS (SELECT user_id, event_id AS line_no, {_SAID} AS line FROM events),
t AS (SELECT user_id, line_no, list_distinct(list_filter(regexp_extract_all(lower(line), '[a-z0-9_]{{3,}}'), lambda w: w NOT IN ('and', 'are', 'for', 'from', 'that', 'the', 'this', 'with'))) AS t, line FROM c),
p AS (SELECT b.user_id, b.line_no, a.line_no AS earlier, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS similarity FROM t a JOIN t b ON a.user_id = b.user_id AND a.line_no < b.line_no AND a.line <> b.line WHERE len(a.t) >= 4 AND len(b.t) >= 4)
SELECT user_id, line_no, earlier, round(similarity, 3) AS similarity FROM p WHERE similarity >= 0.64 QUALIFY row_number() OVER (PARTITION BY user_id, line_no ORDER BY similarity DESC, earlier) = 1""")
def _restatements(spark, sf_dir):
    said = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), F.expr(_SAID).alias("line"))
    return S.restatements(S.marked(said, "user_id"), "user_id")


@query("signal_novelty", f"WITH {_KNOWN}, {_NOVEL} SELECT user_id, line_no, novelty / 10000 AS novelty FROM nov")
def _novelty(spark, sf_dir):
    return S.novelty(_log(spark, sf_dir), "user_id")


_MODE = """md1 AS (SELECT user_id, count(*) AS e, count(*) FILTER (WHERE NOT blank) AS n, sum(s) FILTER (WHERE NOT blank) AS s, sum(d) FILTER (WHERE NOT blank) AS d FROM a GROUP BY ALL),
md2 AS (SELECT user_id, sum(q) FILTER (WHERE q > 1) AS rep FROM (SELECT user_id, c, count(*) AS q FROM a WHERE NOT blank GROUP BY ALL) GROUP BY ALL),
md3 AS (SELECT user_id, least(1.0::DOUBLE, coalesce(s, 0)::DOUBLE / greatest(n, 1) * 1.25::DOUBLE + coalesce(rep, 0)::DOUBLE / greatest(n, 1) * 0.55::DOUBLE + CASE WHEN (e - n) / e < 0.08 THEN 0.12::DOUBLE ELSE 0::DOUBLE END) AS st, least(1.0::DOUBLE, coalesce(d, 0)::DOUBLE / greatest(n, 1) * 0.95::DOUBLE + least(0.22::DOUBLE, (e - n) / e * 1.8::DOUBLE)) AS dc FROM md1 LEFT JOIN md2 USING (user_id)),
mode AS (SELECT user_id, st, dc, CASE WHEN abs(st - dc) < 0.14 THEN 'uncertain' WHEN st > dc THEN 'stream' ELSE 'document' END AS mode FROM md3)"""


@query("signal_modes", f"""WITH {_KNOWN}, {_MODE} SELECT user_id, mode, round(st, 3) AS stream, round(dc, 3) AS document, round(CASE WHEN mode = 'uncertain' THEN greatest(0.35::DOUBLE, 0.55::DOUBLE - abs(st - dc)) ELSE least(0.98::DOUBLE, 0.58::DOUBLE + abs(st - dc) * 0.65::DOUBLE) END, 3) AS confidence FROM mode""")
def _modes(spark, sf_dir):
    return S.modes(_log(spark, sf_dir), "user_id")


_SCORED = f"""{_BREAKS}, {_NOVEL}, {_MODE},
x AS (SELECT k.*, mode, coalesce(novelty, 0) AS novelty, CASE k WHEN 0 THEN 10000 WHEN 2 THEN 10000 WHEN 3 THEN 9000 WHEN 4 THEN 7200 ELSE 0 END AS concrete, CASE k WHEN 0 THEN 10000 WHEN 4 THEN 7200 ELSE 0 END AS severity FROM k LEFT JOIN nov USING (user_id, line_no) JOIN mode USING (user_id)),
y AS (SELECT *, (30 * strength + 13 * round(CASE WHEN shared >= 0.25 THEN 10000 ELSE 1200 END / sqrt(own))::BIGINT + 17 * concrete + 24 * severity + 7 * novelty + 13 * local
  + 8 * CASE WHEN k IN (0, 2, 4) THEN least(10000, round(2000 * log2(own + 1)))::BIGINT ELSE 0 END - 12 * CASE WHEN len(feats) = 0 AND strength < 4500 THEN CASE WHEN mode = 'uncertain' THEN 5500 ELSE 2800 END ELSE 0 END + 50) AS p FROM x),
z1 AS (SELECT *, least(10000, greatest(0, floor(p / 100)::BIGINT, CASE WHEN k = 0 THEN 6800 WHEN k = 2 THEN 6600 ELSE 0 END)) AS score FROM y),
sc AS (SELECT *, CASE WHEN score >= 6200 THEN 'attention' WHEN score >= 3600 THEN 'notable' ELSE 'context' END AS level, CASE k WHEN 0 THEN 'failure' WHEN 2 THEN 'constraint' WHEN 3 THEN 'exception' WHEN 4 THEN 'warning' END AS role,
  least(98, 42 + 12 * ((strength >= 4500)::INTEGER + (len(feats) > 0)::INTEGER + (same > 1)::INTEGER + (own > 1)::INTEGER + (len(line) >= 40.6)::INTEGER) + CASE WHEN len(kinds) > 1 THEN 8 ELSE 0 END) / 100 AS confidence FROM z1)"""


@query("signal_scores", f"WITH {_SCORED} SELECT user_id, line_no, score / 10000 AS score, level, confidence FROM sc")
def _scores(spark, sf_dir):
    return S.scored(_log(spark, sf_dir), "user_id").select("user_id", "line_no", "score", "level", "confidence")


@query("signal_log_findings", f"""WITH {_SCORED} SELECT user_id, line_no, score / 10000 AS score, level, confidence, coalesce(role, CASE WHEN strength >= 4200 THEN 'pattern-break' WHEN own > 1 THEN 'observation' WHEN mode = 'uncertain' THEN 'uncertain' ELSE 'context' END) AS kind,
CASE role WHEN 'failure' THEN 'Failure marker' WHEN 'exception' THEN 'Exception near a rule' WHEN 'constraint' THEN 'Concrete constraint' WHEN 'warning' THEN 'Warning marker' ELSE CASE WHEN strength >= 4200 THEN 'Pattern break' ELSE 'Line observation' END END AS title,
(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, line_no))::INTEGER AS rank FROM sc WHERE level <> 'context' OR role IS NOT NULL OR strength >= 4200""")
def _log_findings(spark, sf_dir):
    return S.findings(_log(spark, sf_dir), "user_id")


@query("signal_evidence_pack", f"""WITH {_SCORED}, c1 AS (SELECT user_id, line_no, 'attention' AS reason FROM sc WHERE level = 'attention' UNION ALL SELECT DISTINCT user_id, first_line, 'representative' FROM sc),
c2 AS (SELECT DISTINCT user_id, line_no, reason FROM (FROM c1 UNION ALL SELECT user_id, line_no + o, 'context' FROM c1, (VALUES (-1), (1)) t(o)))
SELECT user_id, line_no, line, level, array_to_string(list(reason ORDER BY reason), ',') AS reasons FROM sc JOIN c2 USING (user_id, line_no) GROUP BY ALL""")
def _pack(spark, sf_dir):
    pack = S.evidence_pack(_log(spark, sf_dir), "user_id", representatives=True, context=1)
    return pack.select("user_id", "line_no", "line", "level", F.array_join("reasons", ",").alias("reasons"))


@query("signal_findings")
def _findings(spark, sf_dir):
    return S.findings(_docs(spark, sf_dir), "doc_id")


# documents: real texts, whole

#: Novelty of the lines of all documents, byte by byte.
DOCUMENT_NOVELTY = """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS line_no FROM documents),
n AS (SELECT doc_id, line_no, line, octet_length(encode(line)) AS n, hex(encode(line)) AS h FROM l WHERE NOT regexp_full_match(line, '[\\s\\p{Z}\\x{FEFF}]*')),
u AS (SELECT doc_id, line_no, n, substr(h, 2 * i - 1, 8) AS g FROM (SELECT *, unnest(range(1, n - 2, CASE WHEN n > 48 THEN 2 ELSE 1 END)) AS i FROM n)),
v AS (SELECT doc_id, g, min(line_no) AS line_no FROM u GROUP BY ALL),
w AS (SELECT doc_id, line_no, count(*) AS new FROM v GROUP BY ALL),
s AS (SELECT doc_id, line_no, count(*) AS sampled FROM u GROUP BY ALL)
SELECT n.doc_id, n.line_no::BIGINT AS line_no, least(CASE WHEN n < 20 THEN 4500 ELSE 10000 END, coalesce((20000 * coalesce(new, 0) * greatest(0, least(48, n - 7)) + 48 * sampled) // (96 * sampled), 0)) / 10000 AS novelty
FROM n LEFT JOIN s USING (doc_id, line_no) LEFT JOIN w USING (doc_id, line_no)"""


@query("signal_document_novelty", DOCUMENT_NOVELTY)
def _document_novelty(spark, sf_dir):
    return S.novelty(_docs(spark, sf_dir), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


@query("signal_document_restatements", f"""WITH {_LINES}, w AS (SELECT doc_id, line_no, {_chain()} AS template, list_sort(list_distinct(list_filter(regexp_extract_all(lower(line), '[a-z0-9_]{{3,}}'), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in L.STOP_WORDS)})))) AS t FROM n WHERE NOT blank),
p AS (SELECT b.doc_id, b.line_no, a.line_no AS earlier, len(list_intersect(a.t, b.t)) AS s, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS u FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.line_no < b.line_no AND a.template <> b.template AND len(a.t) >= 4 AND len(b.t) >= 4)
SELECT doc_id, line_no, earlier, round(s / u, 3) AS similarity FROM p WHERE s / u >= 0.64 QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY s / u DESC, earlier) = 1""")
def _document_restatements(spark, sf_dir):
    return S.restatements(_docs(spark, sf_dir), "doc_id")

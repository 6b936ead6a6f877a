"""Queries of the operators over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, exact, html, jaccard, langid, lines, pieces, pii, search, secrets, shard, urls
from .common import ids_text, settle, sha256_hex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register fn(table reader) -> DataFrame."""
    def wrap(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return wrap


@query("op1_sentencepiece")
def op1(read):
    coded = pieces.round_trip(read("documents").select("doc_id", "text"), pieces.installed_model())
    return coded.select(
        "doc_id", F.size("coded.ids").cast("long").alias("n_pieces"), F.xxhash64("coded.ids").alias("ids_hash"),
        F.coalesce("coded.text", F.lit("")).eqNullSafe(F.coalesce("text", F.lit(""))).alias("lossless"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query("op2_language_id")
def op2(read):
    docs = read("documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def _span_sql(rule: secrets.Rule, number: int) -> str:
    """List of structs (start, no, end, kind) of one rule over a column t."""
    pattern = rule.pattern.replace("'", "''")
    starts = "CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""(SELECT list_transform(list_filter(range(1, len(h) + 1), lambda i: length(z[i]) >= {rule.min_chars}),
      lambda i: struct_pack(s := {starts}, k := {number}, e := {starts} + length(h[i]), n := '{rule.kind}'))
      FROM (SELECT regexp_extract_all(t, '{pattern}', 0) AS h, regexp_extract_all(t, '{pattern}', {rule.group}) AS z,
                   regexp_split_to_array(t, '{pattern}') AS g))"""


_JOINED = "array_to_string(list_transform(list_sort({}), lambda x: x.n || ':' || x.s || ':' || x.e), ',')"
_OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, {", ".join(f"{_span_sql(r, i)} AS s{i}" for i, r in enumerate(secrets.RULES))} FROM d)
SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex,
       sha256({_JOINED.format("s0 || s1 || s2")}) AS base_sha256,
       {_JOINED.format(" || ".join(f"s{i}" for i in range(len(secrets.RULES))))} AS spans
FROM s
"""


@query("op3_secret_scan", _OP3)
def op3(read):
    found = secrets.scan(read("documents").select("doc_id", "text"))
    joined = lambda spans: ids_text(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    of = lambda n: F.filter("secrets", lambda x: x["kind_no"] == n)
    return found.select(
        "doc_id", *[F.size(of(i)).cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(secrets.BASE)],
        sha256_hex(joined(F.filter("secrets", lambda x: x["kind_no"] < len(secrets.BASE)))).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def _op4_sql(steps: int = 400) -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: "coalesce(" + low.format(f"regexp_extract({u}, '{urls.URL}', 1)") + ", '')"
    fits = []
    for _, rule in sorted(urls.RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    verdicts = " ".join(f"WHEN '{rule}' THEN '{v}'" for v, rule in urls.RULES)
    link = urls.LINK.replace("'", "''")
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '{urls.URL}', 2), '') AS path FROM pages),
r AS (SELECT *, CASE {" ".join(fits)} END AS rule FROM p),
v AS (SELECT *, CASE rule {verdicts} END AS verdict FROM r),
l AS (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p),
t AS (SELECT host AS src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM l),
e AS (SELECT DISTINCT src, {host("link")} AS dst FROM t),
e1 AS (SELECT * FROM e WHERE src <> '' AND dst <> '' AND src <> dst),
e2 AS (SELECT 0 AS kind, src, dst FROM e1 UNION ALL SELECT 1, dst, src FROM e1),
b AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM e2),
s AS (SELECT host, count(*) FILTER (verdict = 'allow') * {urls.UNIT} // count(*) AS trust, count(*) FILTER (verdict = 'block') * {urls.UNIT} // count(*) AS distrust
      FROM v WHERE host <> '' GROUP BY 1),
m0 AS (SELECT 0 AS kind, host AS src, trust AS mass FROM s WHERE trust > 0 UNION ALL SELECT 1, host, distrust FROM s WHERE distrust > 0),
w AS (SELECT kind, src, mass * {urls.STAY} // 20 AS mass, 0 AS k FROM m0
  UNION ALL SELECT b.kind, b.dst, CAST(sum(w.mass * {urls.WALK} // (20 * degree)) AS BIGINT), w.k + 1 FROM w JOIN b ON b.kind = w.kind AND b.src = w.src
  WHERE w.k < {steps} GROUP BY b.kind, b.dst, w.k HAVING sum(w.mass * {urls.WALK} // (20 * degree)) > 0),
f AS (SELECT src, sum(CASE WHEN kind = 1 THEN mass ELSE -mass END) AS excess FROM w GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(excess, 0) >= {urls.UNIT * urls.STAY // 40} THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN f ON v.host = f.src
"""


@query("op4_url_filter", _op4_sql())
def op4(read):
    return urls.judge(read("pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


@query("op5_pii")
def op5(read):
    docs = read("documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    joined = lambda spans: ids_text(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("pii", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS],
        sha256_hex(joined(base)).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


_OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


@query("op6_jaccard_join", _OP6)
def op6(read):
    return jaccard.near_classes(read("documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op7(read):
    return exact.exact_groups(read("documents"), keep="max")


@query("op8_decontamination", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
f AS (SELECT doc_id, item_id, i, p.m FROM dw JOIN p ON dw.win = p.win AND dw.m = p.m),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM f) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op8(read):
    docs = decontaminate.decontaminate(read("documents").select("doc_id", "text"), read("benchmark"))
    hit = F.aggregate("contamination.hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return docs.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"), sha256_hex(ids_text(F.col("contamination.items"))).alias("items_sha256"),
        (F.size("contamination.hits") > 0).alias("contaminated"),
    )


@query("op9_sharding")
def op9(read):
    return shard.shard_documents(read("documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op10_html_extraction")
def op10(read):
    return html.extract(read("pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_ranked_search", f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM q),
p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
c AS (SELECT doc_id, term, any_value(p.n) AS n, count(*) AS tf FROM p JOIN v USING (term) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY 1),
g AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * c.n * s.n) // s.l))) AS part FROM c JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY 1, 2 HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM r
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50
""")
def op11(read):
    return search.search(read("documents"), read("benchmark"), k=50)


@query("op12_line_dedup", r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND doc_id > first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR doc_id <= first), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY 1
""")
def op12(read):
    docs = lines.drop_repeated_lines(read("documents").select("doc_id", "text"))
    return docs.select("doc_id", "kept.n_lines", "kept.n_dropped", sha256_hex(F.col("kept.text")).alias("kept_sha256"))


@query("op13_alignment")
def op13(read):
    a, b = align.installed("byte_bpe_50k.json"), align.installed("piece_bpe_32k.model")
    found = align.align(read("documents").select("doc_id", "text"), a, b)
    digest = F.when(F.col("n_a") > 0, sha256_hex(F.col("groups"))).otherwise("").alias("groups_sha256")
    rows = settle(found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    return align.count_links(rows, align.b_size(a, b)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import collocations, conversations, decontaminate, linededup, mainhtml, mixing, nearjoin, neighbours, private, quality, repeats, tokens, urlfilter
from quillspark.llm.common import read_table

MIX_SEED = 7

#: The rules of the URL query, in the order given.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Listed canonical URLs; pages below them are blocked where no rule says otherwise.
LISTED_URLS = [
    (f"{site}.example.{top}", "/")
    for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
]


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokens.load_pieces(tokens.DEFAULT_MODEL))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs, distance=2)
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_LETTERS = "etaoinsrhldu"
OP3_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
f AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line),
c AS (SELECT *, strlen(line) AS n, {', '.join(f"strlen(line) - strlen(replace(line, '{x}', '')) AS n_{x}" for x in _LETTERS)} FROM f),
near AS (
  SELECT y.line, min(x.first) AS before
  FROM c y JOIN c x ON x.n BETWEEN y.n - 2 AND y.n + 2 AND x.n > 2 AND y.n > 2
    AND {' AND '.join(f'abs(x.n_{x} - y.n_{x}) <= 2' for x in _LETTERS)}
    AND x.first < y.first AND levenshtein(x.line, y.line) <= 2
  GROUP BY y.line),
k AS (SELECT f.line, coalesce(before, f.first) AS kept FROM f LEFT JOIN near USING (line)),
g AS (SELECT l.doc_id, l.pos, l.line, coalesce((l.doc_id, l.pos) > k.kept, false) AS gone FROM l LEFT JOIN k USING (line))
SELECT d.doc_id, CAST(count(g.line) AS BIGINT) AS n_lines, CAST(count(g.line) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(g.line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_counts(read_table(spark, sf_dir, "documents"), seed=MIX_SEED)
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken")
    )


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
r AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS per,
         CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS wanted
  FROM w),
l AS (
  SELECT *,
    (wanted - CAST(coalesce(sum(source_size) OVER (ORDER BY per, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 2.0::DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY per, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)
      AS level
  FROM r),
f AS (SELECT arg_min(level, per) AS level FROM l WHERE level <= per),
t AS (
  SELECT w.source, w.source_size, least(w.source_size * 2.0::DOUBLE, coalesce(f.level, 0) * w.weight) AS target FROM w, f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies,
    CAST(('0x' || substr(md5('{MIX_SEED}:' || coalesce('s' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.copies, e.shift,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor((place + 1) * copies + shift) - floor(place * copies + shift)) AS BIGINT) AS taken
FROM p
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = nearjoin.near_duplicates(docs, threshold=0.8, width=5)
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in range(1, len(w) - least(len(w), 5) + 2)]) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE m * 5 >= (na.n + nb.n - m) * 4),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT d.doc_id, min(r.root) AS class_id, CAST(coalesce(any_value(k.n), 0) AS BIGINT) AS n_links
FROM d JOIN r USING (doc_id) LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = d.doc_id
GROUP BY d.doc_id
"""


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.remove_repeats(docs, length=200, keep_text=False)
    return out.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")


OP6_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, unnest(range(1, octet_length(b) - 198)) AS p, b FROM d WHERE octet_length(b) >= 200),
w AS (SELECT doc_id, p, md5(b[p:p + 199]) AS h FROM g),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM m)),
e AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 200 AS new FROM r),
s AS (SELECT doc_id, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
t AS (SELECT doc_id, k, min(p) AS a, max(p) + 199 AS z FROM s GROUP BY doc_id, k),
u AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, k = max(k) OVER (PARTITION BY doc_id) AS last FROM t),
x AS (
  SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans,
    list((before, a) ORDER BY a) AS cuts, max(z) AS tail FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE
    list_reduce(list_concat([''::BLOB], list_transform(cuts, lambda y: b[y[1] + 1:y[2] - 1])), lambda p, q: p || q) || b[tail + 1:] END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = mainhtml.extract(pages, text_col="text", keep_html=False)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (c.n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    unnest([array_to_string(w[s:s + least(len(w), 10) - 1], ' ') for s in range(1, len(w) - least(len(w), 10) + 2)]) AS win
  FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s,
    unnest([array_to_string(w[s:s + n - 1], ' ') for s in range(1, len(w) - n + 2)]) AS win
  FROM d, ns WHERE len(w) >= n),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def url_entries(spark: SparkSession) -> DataFrame:
    rows = [(h, p, v, True) for h, p, v in URL_RULES] + [(h, p, "block", False) for h, p in LISTED_URLS]
    names = ("host", "path", "verdict", "is_rule")
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(read_table(spark, sf_dir, "pages"), url_entries(spark))
    return judged.select("page_id", "url_verdict.host", "url_verdict.path", "url_verdict.rule", "url_verdict.verdict")


OP9_SQL = f"""
WITH e(host, path, verdict, is_rule) AS (VALUES
  {', '.join(f"('{h}', '{p}', '{v}', true)" for h, p, v in URL_RULES)},
  {', '.join(f"('{h}', '{p}', 'block', false)" for h, p in LISTED_URLS)}),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '[.]$', '') AS c_host,
         CASE WHEN path = '' THEN '/' ELSE path END AS c_path
  FROM h),
m AS (
  SELECT c.page_id, c.host, c.path, e.verdict, e.host || e.path AS key, e.is_rule,
    row_number() OVER (PARTITION BY c.page_id ORDER BY e.is_rule DESC NULLS LAST, length(e.host || e.path) DESC) AS rn
  FROM c LEFT JOIN e ON CASE WHEN e.is_rule
    THEN (c.host = e.host OR ends_with(c.host, '.' || e.host)) AND starts_with(c.path, e.path)
    ELSE c.host <> '' AND (c_host = e.host OR ends_with(c_host, '.' || e.host)) AND starts_with(c_path, e.path) END)
SELECT page_id, host, path, CASE WHEN is_rule THEN key END AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""

ACCEPTED = 0.7


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, score_col="score", keep_text=False)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(read_table(spark, sf_dir, "documents").select("text", "lang"), top=2000, least=30, longest=4, share=80)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS g FROM p, range(1, 5) AS x(k) WHERE len(w) >= k),
f AS (SELECT lang, g, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, g, k, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, u.g, u.k, u.a, u.cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * u.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.g = array_to_string(w[1:cut], ' ')
    JOIN f y ON y.lang = u.lang AND y.g = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS g, m, a AS above
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS y(m) WHERE m < k)),
j AS (SELECT lang, g, max(above) AS above FROM i GROUP BY lang, g),
r AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank, b.g AS phrase, a, l, r, score
  FROM b LEFT JOIN j ON j.lang = b.lang AND j.g = b.g WHERE NOT coalesce(100 * above::HUGEINT >= 80 * a::HUGEINT, false))
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, repaired = conversations.repair(conversations.damage(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = rows.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    done = found.join(conversations.digests(repaired).withColumnRenamed("conv_id", "made"), F.col("conv_id").eqNullSafe(F.col("made")), "left")
    joined = every.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_BARE = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_CRC_BYTE = "list_reduce([xor(c, b) & 255] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


def _least_of(*ways: str) -> str:
    return f"list_min([w FOR w IN [{', '.join(ways)}] IF w.c IS NOT NULL])"


def _way(state: str, cost: str, letter: str, made: str = "''", ok: str = "true") -> str:
    """A way to a state in SQL: cost and letters so far, and the rows made."""
    row = f"m: p.{state}.m || CASE WHEN p.{state}.m <> '' AND {made} <> '' THEN chr(10) ELSE '' END || {made}"
    return f"CASE WHEN {ok} AND p.{state}.c IS NOT NULL THEN {{c: p.{state}.c + {cost}, a: p.{state}.a || '{letter}', {row}}} END"


def _turn_sql() -> str:
    """What a turn makes of the cheapest way to each grammar state; adding a turn never pays, as deleting one is cheaper."""
    stays, goes = "NOT r.gone", "CASE WHEN r.truncated THEN 5 ELSE 0 END"
    keep = lambda q, x: _way(q, goes, "K", "r.role || ':' || r.text", f"{stays} AND left(r.role, 1) = '{x}'")
    change = lambda q, x: _way(q, f"1 + {goes}", "R", f"'{x}:' || r.text", stays)
    cut = lambda q: _way(q, "2", "D")
    to_u = [f(q, x) for q in ("z", "s", "a") for f, x in ((keep, "u"), (change, "user"))]
    return (
        f"{cut('z')} AS z, {_least_of(cut('s'), keep('z', 's'))} AS s, {_least_of(cut('u'), *to_u)} AS u, "
        f"{_least_of(cut('a'), keep('u', 'a'), change('u', 'assistant'))} AS a"
    )


OP12_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(4294967295, list_reduce([4294967295] || [CAST(ascii(k[i]) AS BIGINT) FOR i IN range(1, length(k) + 1)],
    lambda c, b: xor(c >> 8, {_CRC_BYTE}))) % 20 AS h FROM o),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (
  SELECT *, {_BARE} = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    right({_BARE}, 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
r AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND cut AS truncated FROM f),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size FROM r GROUP BY conv_id),
p AS (
  SELECT conv_id, 0::BIGINT AS i, {{c: 0, a: '', m: ''}} AS z, {{c: NULL::INTEGER, a: '', m: ''}} AS s, {{c: NULL::INTEGER, a: '', m: ''}} AS u,
    {{c: NULL::INTEGER, a: '', m: ''}} AS a FROM c
  UNION ALL
  SELECT p.conv_id, r.i, {_turn_sql()} FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1),
e AS (SELECT p.conv_id, {_least_of('p.z', 'p.a')} AS w FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.size = p.i)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.a, '') AS audit,
  sha256(coalesce(w.m, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private.find_private(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("private.base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(private.KINDS.index(kind)))).cast("long").alias(f"n_{kind}") for kind in private.KINDS]
    base, spans = (private.named_spans(F.col(f"private.{x}")) for x in ("base", "spans"))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


#: The contract's base patterns as they stand, and the operator's strings like numbers and addresses.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PII_RUN = r"[0-9+][0-9 ().+-]*"
_PII_ADDRESS = r"[A-Za-z0-9._%+-]+ ?(@|[(\[]at[)\]]) ?[A-Za-z0-9-]+( ?(\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)*"


def _pii_passes(kind: str, v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    doubled = f"CAST({d}[i] AS INTEGER) * 2 - CASE WHEN CAST({d}[i] AS INTEGER) > 4 THEN 9 ELSE 0 END"
    luhn = f"list_sum([CASE WHEN (length({d}) - i) % 2 = 1 THEN {doubled} ELSE CAST({d}[i] AS INTEGER) END FOR i IN range(1, length({d}) + 1)]) % 10 = 0"
    return {
        "email": "true",
        "ip": f"coalesce(list_bool_and([coalesce(TRY_CAST(q AS HUGEINT) <= 255, false) FOR q IN string_split({v}, '.')]), false)",
        "card": f"CASE WHEN length({d}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({d}) BETWEEN 10 AND 15",
    }[kind]


def _pii_placed(pattern: str, text: str, source: str) -> str:
    """Matches of a pattern: v, s, and the texts around, from rows (id, ``text``)."""
    return f"""
  SELECT id, i, v[i] AS v, g[i] AS before, g[i + 1] AS after, len(v) AS n,
    CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN v[1:i - 1]]), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM (
    SELECT id, regexp_extract_all({text}, '{pattern}') AS v, string_split_regex({text}, '{pattern}') AS g FROM {source}))"""


def _pii_sql() -> str:
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"[w FOR w IN regexp_split_to_array({low(x)}, '[ \\x09-\\x0D]+') IF w <> '']"
    base = " UNION ALL ".join(f"SELECT id, {k} AS kind, s, s + length(v) AS e FROM b{k} WHERE {_pii_passes(kind, 'v')}" for k, kind in enumerate(_PII))
    seeds = " ".join(f"WHEN {'address AND ' if k == 0 else 'NOT address AND '}regexp_full_match(v, '{p}') AND {_pii_passes(kind, 'v')} THEN {k}" for k, (kind, p) in enumerate(_PII.items()))
    inside = " OR ".join(f"len([q FOR q IN regexp_extract_all(v, '{_PII[kind]}') IF {_pii_passes(kind, 'q')}]) > 0" for kind in ("ip", "card", "phone"))
    quad, line, digits = (f"regexp_full_match(v, '{_PII['ip']}')", f"regexp_full_match(v, '{_PII['card']}')", "length(regexp_replace(v, '[^0-9]', '', 'g'))")
    shapes = f"""[k FOR k IN [CASE WHEN address AND NOT regexp_matches(v, '{_PII['email']}') THEN 0 END, CASE WHEN NOT address AND {quad} THEN 1 END,
      CASE WHEN NOT address AND {line} AND {digits} BETWEEN 12 AND 19 THEN 2 END, CASE WHEN NOT address AND NOT {quad} AND {digits} BETWEEN 7 AND 15 THEN 3 END]
      IF k IS NOT NULL]"""
    rounds = ["f0 AS (SELECT '' AS v, false AS address, 0 AS kind, 0 AS score WHERE false)"]
    for i in range(1, private.ROUNDS + 1):
        rounds.append(f"""
c{i} AS (
  SELECT pattern, kind, (1000 * seeds + more) // (n + 1) AS score FROM (
    SELECT pt.pattern, pt.kind, pt.n, pt.seeds, coalesce(sum(f.score), 0) AS more, count(f.v) AS new
    FROM pt LEFT JOIN (SELECT u.pattern, u.kind, u.v, f.score FROM u JOIN f{i - 1} f USING (v, address, kind)) f ON f.pattern = pt.pattern AND f.kind = pt.kind
    GROUP BY ALL) WHERE seeds + new >= {private.LEAST} AND (1000 * seeds + more) // (n + 1) >= {private.TRUSTED}),
f{i} AS (
  SELECT v, address, kind, score FROM u JOIN c{i} USING (pattern, kind)
  QUALIFY row_number() OVER (PARTITION BY v, address ORDER BY score DESC, kind) = 1)""")
    placed = ",".join(f"\nb{k} AS ({_pii_placed(p, 't', 'd')})" for k, p in enumerate(_PII.values()))
    named = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(_PII))
    joined = lambda t: f"string_agg(CASE {t}.kind {named} END || ':' || {t}.s || ':' || {t}.e, ',' ORDER BY {t}.s, {t}.kind, {t}.e)"
    return f"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),{placed},
base AS ({base}),
r AS ({_pii_placed(_PII_RUN, 't', 'd')}),
ad AS ({_pii_placed(_PII_ADDRESS, 't', 'd')}),
sl AS (
  SELECT id, {low("rtrim(v, ' ().+-')")} AS v, s, s + length(rtrim(v, ' ().+-')) AS e, false AS address, before, after, i, n FROM r
  WHERE rtrim(v, ' ().+-') <> '' AND NOT regexp_matches(right(before, 1), '[A-Za-z_@\\x{{80}}-\\x{{10FFFF}}]')
    AND (rtrim(v, ' ().+-') <> v OR NOT regexp_matches(left(after, 1), '[A-Za-z_@\\x{{80}}-\\x{{10FFFF}}]'))
  UNION ALL SELECT id, {low("v")}, s, s + length(v), true, before, after, i, n FROM ad),
w AS (
  SELECT *, {words("CASE WHEN i = 1 THEN '^ ^ ' ELSE '# # ' END || right(before, 64)")} AS le,
    {words("left(after, 64) || CASE WHEN i = n THEN ' $ $' ELSE ' # #' END")} AS ri FROM sl),
ed AS (
  SELECT * FROM (SELECT DISTINCT v, address, unnest(['L ' || le[-2] || ' ' || le[-1], 'M ' || le[-1] || ' ' || ri[1], 'R ' || ri[1] || ' ' || ri[2]]) AS pattern FROM w)
  WHERE NOT regexp_full_match(pattern, '[LMR] [#$^] [#$^]')),
ev AS (SELECT DISTINCT v, address FROM ed),
es AS (SELECT v, address, CASE {seeds} END AS seed, {shapes} AS shapes, NOT address AND ({inside}) AS holds FROM ev),
eg AS (SELECT ed.v, ed.address, pattern, seed, CASE WHEN seed IS NULL AND NOT holds THEN shapes ELSE [] END AS shapes FROM ed JOIN es USING (v, address)),
pn AS (SELECT pattern, count(*) AS n FROM eg GROUP BY pattern HAVING count(*) >= {private.LEAST}),
pt AS (
  SELECT pn.pattern, n, k.kind, (SELECT count(*) FROM eg WHERE eg.pattern = pn.pattern AND eg.seed = k.kind) AS seeds FROM pn, range({len(_PII)}) AS k(kind)),
u AS (SELECT v, address, pattern, unnest(shapes) AS kind FROM eg WHERE pattern IN (SELECT pattern FROM pn)),
{",".join(rounds)},
new AS (SELECT DISTINCT id, kind, s, e FROM sl JOIN f{private.ROUNDS} USING (v, address)),
every AS (SELECT id, kind, s, e FROM base UNION SELECT id, kind, s, e FROM new),
x AS (SELECT id, {joined('base')} AS a, {', '.join(f'count(*) FILTER (kind = {k}) AS n_{kind}' for k, kind in enumerate(_PII))} FROM base GROUP BY id),
y AS (SELECT id, {joined('every')} AS a FROM every GROUP BY id)
SELECT d.id AS doc_id, {', '.join(f'CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}' for kind in _PII)},
  sha256(coalesce(x.a, '')) AS base_sha256, coalesce(y.a, '') AS spans
FROM d LEFT JOIN x ON x.id = d.id LEFT JOIN y ON y.id = d.id
"""


OP13_SQL = _pii_sql()


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_main_text": op7_main_text,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filters": op9_url_filters,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_private_data": op13_private_data,
}
ORACLES = {"op3_line_dedup": OP3_SQL, "op4_mix_sources": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op6_suffix_array_dedup": OP6_SQL, "op8_decontaminate": OP8_SQL, "op9_url_filters": OP9_SQL, "op11_collocations": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_private_data": OP13_SQL}
